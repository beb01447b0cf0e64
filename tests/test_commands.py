import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.limits import DIRECT_RELATIONS
from tessera.operators import commands as cmd
from tessera.operators import ordering, views
from tessera.schemas import PAYLOAD, SOURCE
from tests.helpers import payload, rows_of

T0 = dt.datetime(2026, 1, 1)


def at(seq):
    return T0 + dt.timedelta(seconds=seq // 3)


def records(spark, n, hidden=(), ended=(), revision=None):
    return rows_of(spark, "records", [
        dict(id=i, scope_id=1, kind="note", lifecycle="retracted" if i in ended else "active",
             current_revision=(revision or {}).get(i, 1), readable=i not in hidden)
        for i in range(1, n + 1)
    ])


def outcomes(df, column="outcome"):
    return {r["seq"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("slice_rows", [1_000_000, 40])
def test_revise_against_replay(spark, slice_rows):
    rng = random.Random(slice_rows)
    start = {i: rng.randint(1, 3) for i in range(1, 6)}
    rows = []
    for seq in range(400):
        # Record 1 takes a third of all commands.
        record = 1 if rng.random() < 0.34 else rng.randint(1, 6)
        rows.append((f"k{seq}", at(seq), seq, record, rng.randint(1, 12)))
    # A long chain on record 2.
    rows += [(f"k{400 + i}", at(400 + i), 400 + i, 2, e) for i, e in enumerate(list(range(1, 40)))]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, record_id bigint, expected_revision bigint")
    current, want = dict(start), {}
    for _, _, seq, record, expected in rows:
        if record not in current:
            want[seq] = "invalid"
        elif current[record] == expected:
            current[record] += 1
            want[seq] = "applied"
        else:
            want[seq] = "conflict"
    got = cmd.apply_revise(df, records(spark, 6, hidden=[6], revision=start), slice_rows)
    assert outcomes(got) == want
    assert max(r["new_revision"] or 0 for r in got.filter("record_id = 2").collect()) == current[2]


@pytest.mark.parametrize("slice_rows", [1_000_000, 9])
def test_revise_in_full_against_replay(spark, slice_rows):
    """Argument rules, revision before kind, one timestamp, half of all commands on one record."""
    rng = random.Random(slice_rows)
    current, rows, want = dict.fromkeys(range(1, 5), 1), [], {}
    for seq in range(120):
        record = 1 if rng.random() < 0.5 else rng.randint(1, 5)
        expected = rng.choice([current.get(record, 1), current.get(record, 1) - 1, rng.randint(1, 6)])
        kind, body = rng.choice(["note", "note", "idea"]), rng.choice(["text", "text", " "])
        title = rng.choice(["t", "t", "t", ""])
        p = payload(kind, body=body) if kind == "note" else payload(kind, proposal=body)
        rows.append((f"k{seq}", T0, seq, record, expected, title, "why", p, []))
        if expected < 1 or not title or body == " ":
            want[seq] = ("invalid", None)
        elif record not in current:
            want[seq] = ("invalid", f"record {record} does not exist")
        elif current[record] != expected:
            want[seq] = ("conflict", f"revision conflict: expected {expected}, current {current[record]}")
        elif kind != "note":
            want[seq] = ("invalid", cmd.KIND_CHANGED)
        else:
            current[record] += 1
            want[seq] = ("applied", None)
    schema = (f"key string, ts timestamp_ntz, seq bigint, record_id bigint, expected_revision bigint, title string, "
              f"reason string, payload {PAYLOAD.simpleString()}, sources array<{SOURCE.simpleString()}>")
    got = cmd.apply_revise(spark.createDataFrame(rows, schema), records(spark, 4, revision=dict.fromkeys(range(1, 5), 1)), slice_rows)
    for r in got.collect():
        outcome, reason = want[r["seq"]]
        assert r["outcome"] == outcome, (r, want[r["seq"]])
        assert reason is None or r["reason"] == reason


@pytest.mark.parametrize(("seed", "slice_rows"), [(1, 1_000_000), (2, 60), (3, 25)])
def test_labels_against_replay(spark, seed, slice_rows):
    rng = random.Random(seed)
    n, n_labels = 8, 3
    base = {i: set(rng.sample([1, 2, 3], rng.randint(1, 2))) for i in range(1, n + 1)}
    rows = []
    for seq in range(600):
        record = 1 if rng.random() < 0.34 else rng.randint(1, n + 1)
        op = "retract_label" if rng.random() < 0.6 else "add_label"
        rows.append((f"k{seq}", at(seq), seq, op, record, rng.randint(1, n_labels + 1)))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, op string, record_id bigint, label_id bigint")
    held, want = {i: set(v) for i, v in base.items()}, {}
    for _, _, seq, op, record, label in rows:
        if record > n:
            want[seq] = f"record {record} does not exist"
        elif op == "add_label" and label > n_labels:
            want[seq] = f"label {label} does not exist"
        elif op == "add_label":
            want[seq] = cmd.LABEL_ACTIVE if label in held[record] else None
            held[record].add(label)
        elif label not in held[record]:
            want[seq] = cmd.LABEL_INACTIVE
        elif len(held[record]) == 1:
            want[seq] = cmd.LAST_LABEL
        else:
            held[record].remove(label)
            want[seq] = None
    assert cmd.LAST_LABEL in want.values()
    labels = rows_of(spark, "labels", [dict(id=i, facet="f", key=str(i), active=True) for i in range(1, 4)])
    active = spark.createDataFrame([(r, x) for r, v in base.items() for x in v], "record_id bigint, label_id bigint")
    got = cmd.apply_labels(df, records(spark, n), labels, active, slice_rows)
    reasons = outcomes(got, "reason")
    assert {s: (want[s], reasons[s]) for s in want if want[s] != reasons[s]} == {}
    kinds = outcomes(got)
    assert all((kinds[s] == "applied") is (want[s] is None) for s in want)


def test_merges_against_replay(spark):
    rng = random.Random(9)
    rows = []
    for seq in range(80):
        size = rng.choice([1, 2, 2, 3, 4])
        # Record 1 is wanted by a third of the merges.
        ids = rng.sample(range(2, 61), size - 1) + [1] if rng.random() < 0.34 else rng.sample(range(2, 61), size)
        rows.append((f"m{seq}", at(seq), seq, ids + ids[:1]))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, record_ids array<bigint>")
    active, want, ids_left = set(range(1, 61)) - {50, 55}, {}, {}
    next_id = 1000
    for _, _, seq, ids in rows:
        ids = list(dict.fromkeys(ids))
        if len(ids) < 2 or 50 in ids:
            want[seq] = "invalid"
        elif set(ids) <= active:
            active -= set(ids)
            want[seq] = "applied"
            next_id += 1
            ids_left[seq] = next_id
        else:
            want[seq] = "conflict"
    made = cmd.apply_merge(df, records(spark, 60, hidden=[50], ended=[55]), 1000)
    assert outcomes(made["outcomes"]) == want
    assert {s: i for s, i in outcomes(made["outcomes"], "result_id").items() if i} == ids_left
    edges = made["edges"].collect()
    assert len(edges) == made["transitions"].count() == len({e["source_record_id"] for e in edges})
    assert {e["kind"] for e in edges} == {"merged_into"}


def test_supersede(spark):
    df = spark.createDataFrame([("a", T0, 1, 1), ("b", T0, 2, 1), ("c", T0, 3, 9)],
                               "key string, ts timestamp_ntz, seq bigint, record_id bigint")
    made = cmd.apply_supersede(df, records(spark, 2), 10)
    assert outcomes(made["outcomes"]) == {1: "applied", 2: "conflict", 3: "invalid"}
    edge = made["edges"].first()
    assert (edge["source_record_id"], edge["target_record_id"], edge["kind"]) == (11, 1, "supersedes")
    assert edge["idempotency_key"] == "a:relation:11:1:supersedes"
    step = made["transitions"].first()
    assert (step["record_id"], step["to_state"], step["idempotency_key"]) == (1, "superseded", "a:lifecycle:1")


def test_transition_only_to_retracted(spark):
    df = spark.createDataFrame([("a", T0, 1, 1, "merged"), ("b", T0, 2, 1, "retracted"), ("c", T0, 3, 1, "retracted"),
                                ("d", T0, 4, 2, "retracted")],
                               "key string, ts timestamp_ntz, seq bigint, record_id bigint, to string")
    got = cmd.apply_transition(df, records(spark, 2, ended=[2]))
    assert outcomes(got) == {1: "invalid", 2: "applied", 3: "conflict", 4: "conflict"}


def test_label_creation_against_replay(spark):
    rng = random.Random(4)
    rows = []
    for seq in range(60):
        key = rng.choice(["red", "green", "blue", "Bad Key"])
        names = [rng.choice([" A1", "a2", "A3 ", "a4", "a5"]) for _ in range(rng.randint(0, 3))]
        rows.append((f"c{seq}", T0, seq, "color", key, "Name", names))
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, facet string, label_key string, "
                                     "display_name string, aliases array<string>")
    owner, want, created = {"a5": "blue"}, {}, ["blue"]
    for _, _, seq, _, key, _, names in rows:
        wanted = {a.strip().lower() for a in names}
        if key == "Bad Key":
            want[seq] = "invalid"
        elif any(owner.get(a, key) != key for a in wanted):
            want[seq] = "conflict"
        else:
            owner.update(dict.fromkeys(wanted, key))
            want[seq] = "applied"
            if key not in created:
                created.append(key)
    labels = rows_of(spark, "labels", [dict(id=7, facet="color", key="blue", display_name="Blue", active=True)])
    aliases = rows_of(spark, "label_aliases", [dict(label_id=7, alias="A5")])
    new, new_aliases, got = cmd.apply_create_label(df, labels, aliases)
    assert outcomes(got) == want
    ids = {"blue": 7, **{r["key"]: r["id"] for r in new.collect()}}
    assert [k for k, _ in sorted(ids.items(), key=lambda kv: kv[1])] == created
    assert {(r["alias"], r["label_id"]) for r in new_aliases.collect()} == {
        (a, ids[k]) for a, k in owner.items() if a != "a5"}


def test_intake(spark):
    rows = [("k1", "add", 1, "r"), ("k1", "add", 2, "r"), ("k1", "add", 3, "other"), ("k1", "del", 4, "r"),
            ("k2", "add", 5, "r"), ("k3", "add", 6, "r"), ("k3", "del", 7, "r")]
    df = spark.createDataFrame([(k, op, T0, s, r) for k, op, s, r in rows],
                               "key string, op string, ts timestamp_ntz, seq bigint, request string")
    stored = spark.createDataFrame([("k3", "add", "r")], "key string, operation string, request string").select(
        "key", "operation", cmd.request_hash(F.col("request")).alias("request_hash"), F.lit(5).alias("result_id"))
    got = outcomes(cmd.idempotent_intake(df, stored))
    assert got == {1: "applied", 2: "replayed", 3: "conflict", 4: "conflict", 5: "applied", 6: "replayed", 7: "conflict"}


def test_relations(spark):
    kinds = DIRECT_RELATIONS
    rows = [(f"k{i}", T0, i, 1, 2, k) for i, k in enumerate(kinds)]
    rows += [("x", T0, 90, 1, 2, "supports"), ("y", T0, 91, 1, 1, "supports"), ("z", T0, 92, 1, 3, "supports"),
             ("w", T0, 93, 1, 2, "supersedes")]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, record_id bigint, "
                                     "target_record_id bigint, relation_kind string")
    none, none_gone = rows_of(spark, "record_relations", []), rows_of(spark, "relation_retractions", [])
    recs = records(spark, 3, hidden=[3])
    got = outcomes(cmd.apply_add_relation(df, recs, none, none_gone))
    assert [got[i] for i in range(6)] == ["applied"] * 6
    assert [got[i] for i in (90, 91, 92, 93)] == ["conflict", "invalid", "invalid", "invalid"]
    edges = rows_of(spark, "record_relations", [
        dict(id=i + 1, source_record_id=1, target_record_id=2, kind=k) for i, k in enumerate(kinds)])
    gone = rows_of(spark, "relation_retractions", [dict(relation_id=2, reason="r")])
    assert views.relations_visible(recs, edges, gone).filter("record_id = 2").count() == 5
    assert views.relations_visible(recs, edges, gone, True).filter("record_id = 2").count() == 6
    ask = spark.createDataFrame([("a", T0, 1, 2), ("b", T0, 2, 3), ("c", T0, 3, 3), ("d", T0, 4, 77)],
                                "key string, ts timestamp_ntz, seq bigint, relation_id bigint")
    got = outcomes(cmd.apply_retract_relation(ask, recs, edges, gone))
    assert got == {1: "conflict", 2: "applied", 3: "conflict", 4: "invalid"}


def test_create_record_fans_out(spark):
    from tessera.schemas import PAYLOAD, SOURCE

    rows = [("k1", T0, 1, 1, " One ", payload(body="b"), [(" s ", "l", " v ", None, None, "q")], [1, 2, 1]),
            ("k2", T0, 2, 5, "Two", payload(body="b"), [], [1]),
            ("k3", T0, 3, 1, "Three", payload(body="b"), [], [9]),
            ("k4", T0, 4, 1, "Four", payload(body="b"), [], [2])]
    df = spark.createDataFrame(rows, f"key string, ts timestamp_ntz, seq bigint, scope_id bigint, title string, "
                               f"payload {PAYLOAD.simpleString()}, sources array<{SOURCE.simpleString()}>, label_ids array<bigint>")
    scopes = rows_of(spark, "scopes", [dict(id=1, name="work")])
    labels = rows_of(spark, "labels", [dict(id=i, facet="f", key=str(i), active=i < 9) for i in (1, 2, 9)])
    made = cmd.apply_create_record(df, scopes, labels, 40)
    assert outcomes(made["outcomes"], "result_id") == {1: 41, 2: None, 3: None, 4: 42}
    assert [(r["id"], r["title"]) for r in made["records"].orderBy("id").collect()] == [(41, "One"), (42, "Four")]
    source = made["sources"].first()
    assert (source["record_id"], source["position"], source["identity"], source["version"]) == (41, 0, "s", "v")
    assert {(r["record_id"], r["idempotency_key"]) for r in made["assertions"].collect()} == {
        (41, "k1:label:1"), (41, "k1:label:2"), (42, "k4:label:2")}


def test_ids_follow_the_order_over_partitions(spark):
    rng = random.Random(1)
    seqs = rng.sample(range(10_000), 2_000)
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=s % 7), s) for s in seqs], "ts timestamp_ntz, seq bigint")
    rows = ordering.allocate_ids(df.repartition(6), ["ts", "seq"], 100).collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: (r["ts"], r["seq"]))] == list(range(101, 2_101))
    assert ordering.allocate_ids(df.limit(0), ["ts", "seq"], 5).count() == 0


def test_scopes_ignore_case(spark):
    rows = [("a", T0, 1, "Team"), ("b", T0, 2, " team "), ("c", T0, 3, "GLOBAL"), ("d", T0, 4, " "), ("e", T0, 5, "New")]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, seq bigint, name string")
    scopes = rows_of(spark, "scopes", [dict(id=1, name="global")])
    created, got = cmd.apply_create_scope(df, scopes)
    assert outcomes(got, "result_id") == {1: 2, 2: 2, 3: 1, 4: None, 5: 3}
    assert {(r["id"], r["name"]) for r in created.collect()} == {(2, "Team"), (3, "New")}
