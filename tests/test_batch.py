"""Mixed batches against a replay, whole and cut into pieces."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import batch
from tessera.operators import commands as cmd
from tessera.schemas import PAYLOAD, SOURCE, TABLES
from tessera.streaming.intake import LedgerIntake
from tests.helpers import rows_of

T0 = dt.datetime(2026, 1, 1)
SCHEMA = (
    "key string, ts timestamp_ntz, seq bigint, op string, request string, record_id bigint, "
    "expected_revision bigint, label_id bigint, target_record_id bigint, relation_kind string, "
    "relation_id bigint, to string, title string, sources array<string>, reason string, actor string, "
    "thread string, client string"
)
N = 5


def start(spark):
    tables = {
        "records": [dict(id=i, scope_id=1, kind="note", title="t", lifecycle="active", current_revision=1,
                         readable=i != N) for i in range(1, N + 1)],
        "labels": [dict(id=i, facet="f", key=str(i), active=i < 4) for i in range(1, 5)],
        "label_assertions": [dict(id=i, record_id=i, label_id=1) for i in range(1, N + 1)],
        "record_relations": [dict(id=1, source_record_id=1, target_record_id=2, kind="supports"),
                             dict(id=2, source_record_id=2, target_record_id=3, kind="mentions")],
        "write_keys": [dict(key="old", operation="add_label", request_hash="x", result_id=1)],
    }
    names = ["record_revisions", "source_references", "label_retractions", "relation_retractions",
             "lifecycle_transitions", "scopes", "label_aliases", *tables]
    return {n: rows_of(spark, n, tables.get(n, [])) for n in names}


def random_commands(seed, n):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        op = rng.choice(["revise_record", "add_label", "retract_label", "add_relation", "retract_relation",
                         "transition_record", "strange"])
        key = "old" if rng.random() < 0.03 else f"k{rng.randrange(n // 2)}"
        record, number = rng.randint(1, N), rng.randint(1, 3)
        kind = rng.choice(["supports", "mentions"])
        request = f"{op}{record}{number}{kind}"
        out.append(dict(key=key, ts=T0, seq=seq, op=op, request=request, record_id=record, to="retracted",
                        expected_revision=number, label_id=rng.randint(1, 4), target_record_id=number,
                        relation_kind=kind, relation_id=rng.randint(1, 2), reason="r", actor="a",
                        thread="t", client="c", title="new"))
        out[-1]["request"] += str(out[-1]["label_id"]) + str(out[-1]["relation_id"])
    return out


def replay(commands):
    revision = dict.fromkeys(range(1, N), 1)
    held = {i: {1} for i in range(1, N)}
    ended, retracted, edges = set(), set(), {(1, 2, "supports"): 1, (2, 3, "mentions"): 2}
    keys = {"old": ("add_label", "x")}
    out = {}
    for c in commands:
        if c["key"] in keys:
            same = keys[c["key"]] == (c["op"], c["request"])
            out[c["seq"]] = "replayed" if same else "conflict"
            continue
        i, op, result = c["record_id"], c["op"], "applied"
        edge = (i, c["target_record_id"], c["relation_kind"])
        if op == "strange" or (op != "retract_relation" and i == N):
            result = "invalid"
        elif op == "revise_record":
            if revision[i] != c["expected_revision"]:
                result = "conflict"
            else:
                revision[i] += 1
        elif op == "add_label":
            if c["label_id"] == 4:
                result = "invalid"
            elif c["label_id"] in held[i]:
                result = "conflict"
            else:
                held[i].add(c["label_id"])
        elif op == "retract_label":
            if c["label_id"] not in held[i] or len(held[i]) == 1:
                result = "conflict"
            else:
                held[i].remove(c["label_id"])
        elif op == "add_relation":
            if i == c["target_record_id"]:
                result = "invalid"
            elif edge in edges:
                result = "conflict"
            else:
                edges[edge] = 0
        elif op == "retract_relation":
            if c["relation_id"] in retracted:
                result = "conflict"
            else:
                retracted.add(c["relation_id"])
                edges = {e: r for e, r in edges.items() if r != c["relation_id"]}
        elif op == "transition_record":
            if i in ended:
                result = "conflict"
            else:
                ended.add(i)
        if result == "applied":
            keys[c["key"]] = (op, c["request"])
        out[c["seq"]] = result
    return out, revision, held, ended


def frame(spark, commands):
    rows = [tuple(c.get(f.split()[0]) for f in SCHEMA.split(", ")) for c in commands]
    kind = TABLES["record_revisions"]["payload"].dataType.simpleString()
    return spark.createDataFrame(rows, SCHEMA).withColumn("sources", F.array().cast(f"array<{SOURCE.simpleString()}>")).withColumn(
        "payload", F.when(F.col("op") == "revise_record", F.expr("named_struct('kind', 'note', 'body', 'b')")).cast(
            "struct<kind:string,body:string>")).withColumn("payload", whole_payload(kind))


def whole_payload(kind):
    names = [f.name for f in PAYLOAD.fields]
    fields = [F.col(f"payload.{n}").alias(n) if n in ("kind", "body") else F.lit(None).cast(PAYLOAD[n].dataType).alias(n)
              for n in names]
    return F.when(F.col("payload").isNotNull(), F.struct(*fields)).cast(kind)


@pytest.mark.parametrize("pieces", [2])
def test_any_cut_gives_the_same(spark, tmp_path, pieces):
    commands = random_commands(8, 60)
    want, revision, held, ended = replay(commands)
    base = start(spark)
    intake = LedgerIntake(spark, str(tmp_path / "ledger"), base.__getitem__)
    size = -(-len(commands) // pieces)
    for i, at in enumerate(range(0, len(commands), size)):
        intake(frame(spark, commands[at : at + size]), i)
    got = {r["seq"]: r["outcome"] for r in intake.outcomes().collect()}
    tables = {n: intake.table(n) for n in base}
    assert got == want
    records = {r["id"]: r for r in tables["records"].collect()}
    assert {i: records[i]["current_revision"] for i in revision} == revision
    assert {i for i in records if records[i]["lifecycle"] == "retracted"} == ended
    gone = {r["assertion_id"] for r in tables["label_retractions"].collect()}
    active = {}
    for r in tables["label_assertions"].collect():
        if r["id"] not in gone and r["record_id"] != N:
            active.setdefault(r["record_id"], set()).add(r["label_id"])
    assert active == held
    keys = tables["write_keys"].collect()
    assert len({r["key"] for r in keys}) == len(keys) == 1 + sum(v == "applied" for v in want.values())
    assert all(r["result_id"] for r in keys)
    for r in tables["label_assertions"].filter("id > 5").collect():
        assert (r["actor"], r["thread"], r["client"]) == ("a", "t", "c")


def test_key_of_a_refused_command_is_free(spark):
    rows = [
        dict(key="k", ts=T0, seq=1, op="retract_label", request="a", record_id=1, label_id=1),
        dict(key="k", ts=T0, seq=2, op="add_label", request="b", record_id=1, label_id=2),
        dict(key="k", ts=T0, seq=3, op="add_label", request="b", record_id=1, label_id=2),
        dict(key="k", ts=T0, seq=4, op="retract_label", request="a", record_id=1, label_id=1),
    ]
    rows = [dict(r, actor="a", thread="t", client="c") for r in rows]
    df = spark.createDataFrame([tuple(c.get(f.split()[0]) for f in SCHEMA.split(", ")) for c in rows], SCHEMA)
    tables = start(spark).__getitem__
    outcomes = batch.apply_batch(df.drop("sources", "title", "reason"), tables)
    got = outcomes.collect()
    assert {r["seq"]: (r["outcome"], r["reason"]) for r in got} == {
        1: ("conflict", cmd.LAST_LABEL), 2: ("applied", None), 3: ("replayed", None), 4: ("conflict", cmd.KEY_REUSED)}
    after = batch.next_ledger(frame(spark, rows), outcomes, tables)
    assert {r["key"]: r["result_id"] for r in after["write_keys"].collect()} == {"old": 1, "k": 1}
    assert after["label_assertions"].filter("record_id = 1").count() == 2
