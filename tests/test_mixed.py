"""Mixed batches that create: every operation and symbolic ids against a replay, whole and cut."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import batch
from tessera.operators import commands as cmd
from tessera.schemas import PAYLOAD, SOURCE
from tessera.streaming.intake import LedgerIntake
from tests.helpers import rows_of

T0 = dt.datetime(2026, 1, 1)
SCHEMA = (
    "key string, ts timestamp_ntz, seq bigint, op string, request string, record_id bigint, record_ref string, "
    "target_record_id bigint, target_record_ref string, relation_kind string, relation_id bigint, "
    "expected_revision bigint, label_id bigint, label_ref string, to string, scope_id bigint, scope_ref string, "
    "title string, body string, label_ids array<bigint>, label_refs array<string>, record_ids array<bigint>, "
    "record_refs array<string>, name string, facet string, label_key string, display_name string, "
    "aliases array<string>, reason string, actor string, thread string, client string"
)
FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]
MAKERS = {"create_scope": "scope", "create_label": "label", "create_record": "record",
          "supersede_record": "record", "merge_records": "record"}
TABLES = ["records", "labels", "label_aliases", "scopes", "label_assertions", "label_retractions", "record_relations",
          "relation_retractions", "record_revisions", "source_references", "lifecycle_transitions", "write_keys"]


def start(spark):
    tables = {
        "scopes": [dict(id=1, name="work"), dict(id=2, name="Global")],
        "records": [dict(id=i, scope_id=1, kind="note", title="t", lifecycle="active", current_revision=1, readable=True)
                    for i in range(1, 4)],
        "labels": [dict(id=1, facet="f", key="a", display_name="A", active=True),
                   dict(id=2, facet="f", key="b", display_name="B", active=True)],
        "label_aliases": [dict(label_id=1, alias="first")],
        "label_assertions": [dict(id=i, record_id=i, label_id=1) for i in range(1, 4)],
    }
    return {n: rows_of(spark, n, tables.get(n, [])).coalesce(1) for n in TABLES}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A judged batch is many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def frame(spark, commands):
    df = spark.createDataFrame([tuple(c.get(f) for f in FIELDS) for c in commands], SCHEMA).coalesce(2)
    wants = F.col("body").isNotNull()
    fields = [F.when(F.col("body") != "", F.col("body")).alias("body") if f.name == "body"
              else (F.lit("note") if f.name == "kind" else F.lit(None)).cast(f.dataType).alias(f.name) for f in PAYLOAD.fields]
    payload = F.when(wants, F.struct(*fields)).cast(PAYLOAD)
    return df.withColumns({"payload": payload, "sources": F.array().cast(f"array<{SOURCE.simpleString()}>")}).drop("body")


def random_commands(seed, n):
    rng = random.Random(seed)
    out = []

    def some_ref(what):
        """Mostly the key of an earlier command that would make such a thing, else any key."""
        fit = [c["key"] for c in out if MAKERS.get(c["op"]) == what]
        return rng.choice(fit) if fit and rng.random() < 0.85 else f"k{rng.randrange(n)}"

    for seq in range(n):
        if out and rng.random() < 0.08:
            out.append(dict(rng.choice(out), seq=seq))
            continue
        op = rng.choice([*MAKERS, *MAKERS, "create_record", "revise_record", "add_label", "retract_label", "add_relation",
                         "transition_record", None, "strange"])
        c = dict(key=f"k{seq if rng.random() < 0.9 else rng.randrange(n)}", ts=T0, seq=seq, op=op, reason="r", actor="a",
                 thread="t", client="c" if rng.random() < 0.97 else "", request=f"{op}{rng.randrange(3)}", to="retracted")
        if op == "create_scope":
            c["name"] = rng.choice(["Work", " new ", "NEW", "more", "", "other"])
        if op == "create_label":
            c |= dict(facet="f", label_key=rng.choice(["a", "c", "d", "Bad Key"]), display_name="D",
                      aliases=rng.choice([[], ["first"], ["x"], ["x", "y"], ["z"]]))
        if op in ("create_record", "supersede_record", "merge_records"):
            c |= dict(title=rng.choice([" t", "u", "v", ""]) if rng.random() < 0.2 else "new", body=rng.choice(["b"] * 9 + [""]))
            c |= dict(scope_ref=some_ref("scope")) if rng.random() < 0.3 else dict(scope_id=rng.choice([1, 2, 2, 99]))
            c["label_ids"] = rng.choice([[1], [2, 1], [1, 1], [99], None])
            if rng.random() < 0.3:
                c["label_refs"] = [some_ref("label")]
        if op in ("supersede_record", "revise_record", "add_label", "retract_label", "add_relation", "transition_record"):
            c |= dict(record_id=rng.choice([1, 2, 3, 99])) if rng.random() < 0.3 else dict(record_ref=some_ref("record"))
        if op == "merge_records":
            c["record_ids"] = rng.sample(range(1, 4), rng.randint(0, 2))
            c["record_refs"] = [some_ref("record") for _ in range(rng.randint(0, 2))]
        if op == "revise_record":
            c |= dict(title="rev", body="b2", expected_revision=rng.randint(1, 2))
        if op in ("add_label", "retract_label"):
            c |= dict(label_ref=some_ref("label")) if rng.random() < 0.4 else dict(label_id=rng.choice([1, 2, 99]))
        if op == "add_relation":
            c |= dict(target_record_ref=some_ref("record")) if rng.random() < 0.6 else dict(target_record_id=rng.choice([1, 2, 3, 99]))
            c["relation_kind"] = "supports"
        out.append(c)
    return out


class Invalid(Exception):
    pass


class Conflict(Exception):
    pass


class Replay:
    """The ledger, one command after the other."""

    def __init__(self):
        self.scopes, self.labels, self.aliases = {"work": 1, "global": 2}, {"a": 1, "b": 2}, {"first": 1}
        self.records = {i: dict(state="active", revision=1, held={1}, scope=1) for i in range(1, 4)}
        self.keys, self.edges, self.outcomes = {}, {}, {}
        self.assertions = 3

    def named(self, c, id_col, ref_col, what):
        ref = c.get(ref_col)
        if ref is None:
            return c.get(id_col)
        if ref not in self.keys or MAKERS.get(self.keys[ref][0]) != what:
            raise Invalid
        return self.keys[ref][2]

    def listed(self, c, id_col, ref_col, what):
        return list(c.get(id_col) or []) + [self.named({"r": r}, "x", "r", what) for r in c.get(ref_col) or []]

    def resolve(self, c):
        c = dict(c)
        for id_col, what in (("record_id", "record"), ("target_record_id", "record"), ("scope_id", "scope"), ("label_id", "label")):
            c[id_col] = self.named(c, id_col, id_col[:-3] + "_ref", what)
        for id_col, what in (("record_ids", "record"), ("label_ids", "label")):
            c[id_col] = self.listed(c, id_col, id_col[:-4] + "_refs", what)
        return c

    def new_record(self, c):
        if not c["title"].strip() or not c["body"] or not c["label_ids"]:  # repeated labels count once
            raise Invalid
        if c["scope_id"] not in self.scopes.values() or not set(c["label_ids"]) <= set(self.labels.values()):
            raise Invalid

    def store(self, c):
        new = max(self.records) + 1
        self.records[new] = dict(state="active", revision=1, held=set(c["label_ids"]), scope=c["scope_id"])
        self.assertions += len(set(c["label_ids"]))
        return new

    def edge(self, a, b, kind):
        self.edges[a, b, kind] = len(self.edges) + 1

    def end(self, c, old, state):
        if any(i not in self.records for i in old):
            raise Invalid
        if any(self.records[i]["state"] != "active" for i in old):
            raise Conflict
        for i in old:
            self.records[i]["state"] = state

    def run(self, c):
        op = c["op"]
        if op not in [*MAKERS, "revise_record", "add_label", "retract_label", "add_relation", "transition_record"] or not c["client"]:
            raise Invalid
        c = self.resolve(c)
        if op == "create_scope":
            name = c["name"].strip()
            if not name:
                raise Invalid
            return self.scopes.setdefault(name.lower(), len(self.scopes) + 1)
        if op == "create_label":
            if " " in c["label_key"]:
                raise Invalid
            own = self.labels.get(c["label_key"], len(self.labels) + 1)
            if any(self.aliases.get(a, own) != own for a in c["aliases"]):
                raise Conflict
            self.labels[c["label_key"]] = own
            self.aliases |= dict.fromkeys(c["aliases"], own)
            return own
        if op == "create_record":
            self.new_record(c)
            return self.store(c)
        if op == "supersede_record":
            self.new_record(c)
            self.end(c, [c["record_id"]], "superseded")
            new = self.store(c)
            self.edge(new, c["record_id"], "supersedes")
            return new
        if op == "merge_records":
            ids = sorted(set(c["record_ids"]))
            if len(ids) < 2:
                raise Invalid
            self.new_record(c)
            self.end(c, ids, "merged")
            new = self.store(c)
            for i in ids:
                self.edge(i, new, "merged_into")
            return new
        if c["record_id"] not in self.records:
            raise Invalid
        record = self.records[c["record_id"]]
        if op == "revise_record":
            if record["revision"] != c["expected_revision"]:
                raise Conflict
            record["revision"] += 1
        elif op == "transition_record":
            self.end(c, [c["record_id"]], "retracted")
        elif op == "add_label":
            if c["label_id"] not in self.labels.values():
                raise Invalid
            if c["label_id"] in record["held"]:
                raise Conflict
            record["held"].add(c["label_id"])
            self.assertions += 1
        elif op == "retract_label":
            if c["label_id"] not in record["held"] or len(record["held"]) == 1:
                raise Conflict
            record["held"].remove(c["label_id"])
        elif op == "add_relation":
            if c["record_id"] == c["target_record_id"] or c["target_record_id"] not in self.records:
                raise Invalid
            if (c["record_id"], c["target_record_id"], "supports") in self.edges:
                raise Conflict
            self.edge(c["record_id"], c["target_record_id"], "supports")
            return len(self.edges)
        return c["record_id"]

    def __call__(self, commands):
        for c in commands:
            if c["key"] in self.keys:
                same = self.keys[c["key"]][:2] == (c["op"], c["request"])
                self.outcomes[c["seq"]] = "replayed" if same else "conflict"
                continue
            try:
                result = self.run(c)
            except Invalid:
                self.outcomes[c["seq"]] = "invalid"
            except Conflict:
                self.outcomes[c["seq"]] = "conflict"
            else:
                self.outcomes[c["seq"]] = "applied"
                self.keys[c["key"]] = (c["op"], c["request"], result)
        return self


def compare(want, tables):
    rows = {n: tables(n).collect() for n in TABLES if n != "source_references"}
    records = {r["id"]: (r["lifecycle"], r["current_revision"], r["scope_id"]) for r in rows["records"]}
    assert records == {i: (r["state"], r["revision"], r["scope"]) for i, r in want.records.items()}
    gone = {r["assertion_id"] for r in rows["label_retractions"]}
    held = {}
    for r in rows["label_assertions"]:
        if r["id"] not in gone:
            held.setdefault(r["record_id"], set()).add(r["label_id"])
    assert held == {i: r["held"] for i, r in want.records.items()}
    assert sorted(r["id"] for r in rows["label_assertions"]) == list(range(1, want.assertions + 1))
    assert {(r["source_record_id"], r["target_record_id"], r["kind"]): r["id"] for r in rows["record_relations"]} == want.edges
    assert {r["name"].lower(): r["id"] for r in rows["scopes"]} == want.scopes
    assert {r["key"]: r["id"] for r in rows["labels"]} == want.labels
    assert sorted((r["alias"], r["label_id"]) for r in rows["label_aliases"]) == sorted(want.aliases.items())
    assert {r["key"]: r["result_id"] for r in rows["write_keys"]} == {k: v[2] for k, v in want.keys.items()}
    changed = {r["record_id"] for r in rows["lifecycle_transitions"] if r["from_state"] == "active"}
    assert changed == {i for i, r in want.records.items() if r["state"] != "active"}
    firsts = [r["record_id"] for r in rows["record_revisions"] if r["revision"] == 1]
    assert sorted(firsts) == [i for i in sorted(want.records) if i > 3]


@pytest.mark.parametrize("seed, pieces", [(32, 2), (15, 1)])
def test_replay(spark, tmp_path, seed, pieces):
    commands = random_commands(seed, 60)
    want = Replay()(commands)
    assert set(want.outcomes.values()) == {"applied", "invalid", "conflict", "replayed"}
    base = start(spark)
    intake = LedgerIntake(spark, str(tmp_path / "ledger"), base.__getitem__)
    size = -(-len(commands) // pieces)
    for i, at in enumerate(range(0, len(commands), size)):
        intake(frame(spark, commands[at : at + size]), i)
    got = {r["seq"]: r["outcome"] for r in intake.outcomes().collect()}
    assert {s: (o, want.outcomes[s]) for s, o in got.items() if o != want.outcomes[s]} == {}
    assert len(got) == len(commands)
    compare(want, intake.table)


def made(key, seq, op, **more):
    return dict(key=key, ts=T0, seq=seq, op=op, request=key, reason="r", actor="a", thread="t", client="c", **more)


def test_names_and_reasons(spark):
    new = dict(title="n", body="b", label_ids=[1])
    rows = [
        made("early", 1, "add_label", record_ref="one", label_id=2),
        made("s", 2, "create_scope", name="fresh"),
        made("one", 3, "create_record", scope_ref="s", **new),
        made("two", 4, "supersede_record", record_ref="one", scope_ref="s", **new),
        made("three", 5, "merge_records", record_refs=["two"], record_ids=[1], scope_id=1, **new),
        made("late", 6, "supersede_record", record_ref="two", scope_id=1, **new),
        made("few", 7, "merge_records", record_ids=[2, 2], scope_id=1, **new),
        made("l", 8, "create_label", facet="f", label_key="c", display_name="C", aliases=["q", "first"]),
        made("wrong", 9, "add_label", record_ref="s", label_id=2),
        made("none", 10, None),
        made("nobody", 11, "transition_record", record_id=1) | {"actor": " "},
    ]
    base = start(spark)
    outcomes = batch.apply_batch(frame(spark, rows), base.__getitem__)
    got = {r["key"]: (r["outcome"], r["reason"], r["made_id"]) for r in outcomes.collect()}
    assert got == {
        "early": ("invalid", "no earlier command made a record under the key one", None),
        "s": ("applied", None, 3),
        "one": ("applied", None, 4),
        "two": ("applied", None, 5),
        "three": ("applied", None, 6),
        "late": ("conflict", cmd.NOT_SUPERSEDABLE, None),
        "few": ("invalid", got["few"][1], None),
        "l": ("conflict", "label alias first belongs to another label", None),
        "wrong": ("invalid", "no earlier command made a record under the key s", None),
        "none": ("invalid", batch.UNKNOWN_OP, None),
        "nobody": ("invalid", got["nobody"][1], None),
    }
    assert got["few"][1] and "actor" in got["nobody"][1]
    after = batch.next_ledger(frame(spark, rows), outcomes, base.__getitem__)
    states = {r["id"]: r["lifecycle"] for r in after["records"].collect()}
    assert states == {1: "merged", 2: "active", 3: "active", 4: "superseded", 5: "merged", 6: "active"}


def test_rounds(spark, monkeypatch):
    """Chains of names, and repeated keys whose later commands change nothing, take one round; so do rows
    that come twice."""
    rounds, judge = [], batch.judge

    def counted(*args):
        rounds.append(1)
        assert len(rounds) < 4
        return judge(*args)

    monkeypatch.setattr(batch, "judge", counted)
    base, new = start(spark), dict(title="n", body="b", label_ids=[1])
    chain = [
        made("s", 1, "create_scope", name="fresh"),
        made("one", 2, "create_record", scope_ref="s", **new),
        made("two", 3, "supersede_record", record_ref="one", scope_ref="s", **new),
        made("end", 4, "transition_record", record_ref="two"),
    ]
    got = batch.apply_batch(frame(spark, chain), base.__getitem__).orderBy("seq").collect()
    assert [(r["outcome"], r["made_id"]) for r in got] == [("applied", 3), ("applied", 4), ("applied", 5), ("applied", None)]
    assert len(rounds) == 1
    rounds.clear()
    again = [made("b", 1, "transition_record", record_id=1), made("b", 2, "transition_record", record_id=1),
             made("c", 3, "transition_record", record_id=2)]
    got = batch.apply_batch(frame(spark, again + again[2:]), base.__getitem__).select("seq", "outcome").distinct()
    assert {tuple(r) for r in got.collect()} == {(1, "applied"), (2, "replayed"), (3, "applied")}
    assert len(rounds) == 1
