import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from tessera.operators import commands as cmd
from tessera.operators import ledger_rows
from tessera.plans import catalog_commands
from tessera.streaming import intake as intake_module
from tessera.streaming.intake import CommandIntake
from tests.helpers import rows_of

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "key string, op string, ts timestamp_ntz, seq bigint, request string"


def batch(spark, *rows):
    return spark.createDataFrame([(k, op, T0, s, r) for k, op, s, r in rows], SCHEMA)


def state(intake):
    return {r["seq"]: r["outcome"] for r in intake.outcomes().collect()}


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "key string, operation string, request_hash string, result_id bigint")
    intake = CommandIntake(spark, str(tmp_path / "in"), none, lambda b: b)
    first = batch(spark, ("a", "add", 1, "x"), ("a", "add", 2, "x"), ("b", "add", 3, "y"))
    second = batch(spark, ("a", "add", 4, "x"), ("b", "add", 5, "z"), ("c", "add", 6, "w"))
    intake(first, 0)
    intake(second, 1)
    want = {1: "applied", 2: "replayed", 3: "applied", 4: "replayed", 5: "conflict", 6: "applied"}
    assert state(intake) == want
    intake(second, 1)
    assert state(intake) == want
    whole = first.union(second)
    judged = cmd.idempotent_intake(whole, none)
    assert {r["seq"]: r["outcome"] for r in judged.collect()} == want
    assert {r["key"] for r in intake.keys().collect()} == {"a", "b", "c"}


def test_a_restarted_stream_goes_on(spark, tmp_path):
    none = spark.createDataFrame([], "key string, operation string, request_hash string, result_id bigint")
    source = str(tmp_path / "commands")
    batch(spark, ("a", "add", 1, "x"), ("b", "add", 2, "y")).coalesce(1).write.parquet(source)
    intake = CommandIntake(spark, str(tmp_path / "in"), none, lambda b: b)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        intake.start(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()

    run()
    batch(spark, ("a", "add", 3, "x"), ("a", "add", 4, "q")).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert state(intake) == {1: "applied", 2: "applied", 3: "replayed", 4: "conflict"}


def test_applied_batches_move_the_state_and_refused_keys_stay_free(spark, tmp_path):
    records = rows_of(spark, "records", [
        dict(id=i, scope_id=1, kind="note", lifecycle="active", current_revision=1, readable=True) for i in (1, 2)])
    none = spark.createDataFrame([], "key string, operation string, request_hash string, result_id bigint")
    ended = str(tmp_path / "transitions")

    def apply(commands, batch_id):
        asked = commands.withColumn("record_id", F.col("request").cast("bigint")).withColumn("actor", F.lit("a"))
        earlier = records
        if batch_id:
            done = spark.read.option("basePath", ended).parquet(ended).filter(F.col("batch") < batch_id)
            earlier = ledger_rows.updated_records(records, transitions=done)
        outcomes = cmd.apply_transition(asked, earlier)
        ledger_rows.new_transitions(asked.withColumn("reason", F.lit("r")), outcomes).write.mode(
            "overwrite").parquet(f"{ended}/batch={batch_id}")
        return outcomes

    intake = CommandIntake(spark, str(tmp_path / "in"), none, apply=apply)
    intake(batch(spark, ("a", "transition_record", 1, "1"), ("b", "transition_record", 2, "1"),
                 ("a", "transition_record", 3, "1"), ("c", "transition_record", 4, "9")), 0)
    again = batch(spark, ("d", "transition_record", 5, "1"), ("b", "transition_record", 6, "2"))
    intake(again, 1)
    intake(again, 1)
    assert state(intake) == {1: "applied", 2: "conflict", 3: "replayed", 4: "invalid", 5: "conflict", 6: "applied"}
    assert {r["key"] for r in intake.keys().collect()} == {"a", "b"}
    assert spark.read.parquet(ended).count() == 2


def test_delivered_commands_are_made_once(spark, monkeypatch):
    passes = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            passes.add(len(frame))
            yield frame

    rows = [(f"k{i}", "add", T0 + dt.timedelta(hours=i), i, "x") for i in range(8)] + [("n", "add", None, 9, "y")]
    delivered = spark.createDataFrame(rows, SCHEMA).mapInPandas(counted, SCHEMA)
    none = spark.createDataFrame([], "key string, operation string, request_hash string, result_id bigint")
    monkeypatch.setattr(catalog_commands.corpus, "n_documents", lambda *_: 1)
    monkeypatch.setattr(catalog_commands.corpus, "ledger", lambda *_: SimpleNamespace(read=lambda name: none))
    monkeypatch.setattr(catalog_commands.corpus, "delivered_commands", lambda *_: delivered)
    outcomes = catalog_commands.stream_intake(spark, "none").collect()
    assert sorted((r["seq"], r["outcome"]) for r in outcomes) == [(i, "applied") for i in [*range(8), 9]]
    assert passes.value == len(rows)


def test_a_batch_reads_texts_of_its_own_records(spark, tmp_path, monkeypatch):
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 3)], "record_id bigint")
    revisions = ids.withColumn("text", F.concat(F.lit("t"), "record_id"))
    records = ids.select(F.col("record_id").alias("id"), F.lit(1).alias("current_revision")).distinct()
    initial = ids.distinct().selectExpr("record_id", "'m' AS model", "'v' AS model_revision", "1 AS revision")
    seen = []

    def sync(changed, texts, known, *_, **__):
        seen.append([sorted(r[0] for r in part.collect()) for part in (changed.select("id"), texts, known)])
        return None, initial.limit(0).selectExpr("*", "'' AS outcome", "1L AS current_revision")

    monkeypatch.setattr(intake_module, "embedding_sync", sync)
    made = intake_module.VectorSync(spark, str(tmp_path), lambda: (records, revisions), None, "m", "v", 1, initial)
    made(ids.filter("record_id = 3"), 0)
    monkeypatch.setattr(intake_module, "BROADCAST_IDS", 0)
    made(ids.filter("record_id <> 1"), 1)
    assert seen == [[[3], [3, 3], [3]], [[2, 3], [2, 3, 3], [2, 3]]]
