"""Order-dependent steps without one task per key: ids, time slices, chains, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import cut

ROWS_PER_SLICE = 1_000_000
ORDER = ["ts", "seq"]


def allocate_ids(rows: DataFrame, order: list[str], start: int, name: str = "id") -> DataFrame:
    """Consecutive ids after ``start``, in the given order.

    Rows are range-partitioned and counted per partition; only those counts, one per
    partition, pass through the driver. The ranged rows are checkpointed first so that both
    passes see the same partitions, also after an executor is lost.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(
        "_at", F.monotonically_increasing_id()
    )
    part = F.shiftright("_at", 33)
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    offsets, total = [], start
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], total))
        total += row["n"]
    known = rows.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(known), "_part")
        .withColumn(name, F.col("_offset") + within + 1)
        .drop("_at", "_part", "_offset")
    )


def with_slices(commands: DataFrame, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Cut the batch into slices (column ``slice``) of about equal size, in command order.

    Steps that look at other commands of a key work on (key, slice) groups, so a key with a
    third of all commands is spread over all slices. Slices are the range partitions of
    (ts, seq), so a batch with a single timestamp is cut like any other; they are checkpointed,
    so that a command stays in its slice.
    """
    wanted = -(-commands.count() // rows_per_slice)
    if wanted <= 1:
        return commands.withColumn("slice", F.lit(0))
    ranged = cut(commands.repartitionByRange(wanted, *ORDER))
    return ranged.withColumn("slice", F.spark_partition_id())


def previous_value(
    rows: DataFrame, keys: list[str], value: Column, name: str, initial: Column
) -> DataFrame:
    """``value`` of the row before, per key in command order; ``initial`` for the first row.

    Rows are ordered within (key, slice); the value carried in from earlier slices comes from
    one row per key and slice.
    """
    local = Window.partitionBy(*keys, "slice").orderBy(*ORDER)
    carried = Window.partitionBy(*keys).orderBy("slice")
    ends = (
        rows.groupBy(*keys, "slice")
        .agg(F.max_by(value, F.struct(*ORDER)).alias("_end"))
        .withColumn("_carry", F.lag("_end").over(carried))
        .drop("_end")
    )
    return (
        rows.withColumn("_local", F.lag(value).over(local))
        .join(ends, [*keys, "slice"])
        .withColumn(name, F.coalesce("_local", "_carry", initial))
        .drop("_local", "_carry")
    )


def running_sum(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Sum up to and including each row, per key in command order; sums of earlier slices come
    from one row per key and slice."""
    local = Window.partitionBy(*keys, "slice").orderBy(*ORDER).rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*keys, "slice")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
        .drop("_total")
    )
    return (
        rows.withColumn("_local", F.sum(value).over(local))
        .join(totals, [*keys, "slice"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before")
    )


def latest_value(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to and including each row, per key in command order."""
    local = Window.partitionBy(*keys, "slice").orderBy(*ORDER).rowsBetween(
        Window.unboundedPreceding, 0
    )
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        rows.groupBy(*keys, "slice")
        .agg(F.max(F.when(value.isNotNull(), F.struct(*ORDER, value.alias("value")))).alias("_last"))
        .withColumn("_carry", F.last("_last.value", ignorenulls=True).over(earlier))
        .drop("_last")
    )
    return (
        rows.withColumn("_local", F.last(value, ignorenulls=True).over(local))
        .join(ends, [*keys, "slice"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry")
    )


def following_value(
    rows: DataFrame, keys: list[str], value: Column, name: str, order: list[str] = ORDER
) -> DataFrame:
    """The first non-null ``value`` of a later row, per key in command order; null if there is
    none."""
    local = (
        Window.partitionBy(*keys, "slice")
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    later = (
        Window.partitionBy(*keys).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        rows.groupBy(*keys, "slice")
        .agg(F.min(F.when(value.isNotNull(), F.struct(*order, value.alias("value")))).alias("_first"))
        .withColumn("_carry", F.last("_first.value", ignorenulls=True).over(later))
        .drop("_first")
    )
    return (
        rows.withColumn("_local", F.last(value, ignorenulls=True).over(local))
        .join(starts, [*keys, "slice"])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry")
    )


def reachable(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids on the chains that start at ``roots``.

    ``nodes`` is (id, next), every chain ends. Jumps double their length each round, so a
    chain of n links takes log2(n) rounds. Joins are on unique ids.
    """
    found = cut(roots.select("id"))
    jump = cut(nodes.filter("next IS NOT NULL").select("id", "next"))
    while not jump.isEmpty():
        found = cut(found.union(found.join(jump, "id").select(F.col("next").alias("id"))))
        onward = jump.select(F.col("id").alias("next"), F.col("next").alias("after"))
        jump = cut(jump.join(onward, "next").select("id", F.col("after").alias("next")))
    return found


def resolve_claims(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Ids of the commands that succeed when commands take resources one after another.

    ``claims`` is (command, ord, resource, owner); a command succeeds when each of its
    resources is free or already has the same owner, and then owns them all. ``held`` is
    (resource, owner) before the batch.

    A command is decided once nothing undecided before it wants one of its resources for
    another owner. Each round decides all such commands at once, as in the parallel form of
    greedy maximal independent set (Blelloch, Fineman and Shun, 2012), which needs few rounds.
    """
    open_claims = cut(claims.select("command", "ord", "resource", "owner"))
    owned = cut(held.select("resource", F.col("owner").alias("holder")))
    accepted = open_claims.select("command").limit(0)
    while not open_claims.isEmpty():
        blocked = (
            open_claims.join(owned, "resource")
            .filter(F.col("holder") != F.col("owner"))
            .select("command")
            .distinct()
        )
        alive = open_claims.join(blocked, "command", "left_anti")
        # Per resource: who comes first, and the first that wants it for another owner.
        per_owner = alive.groupBy("resource", "owner").agg(F.min("ord").alias("ord"))
        first = (
            per_owner.withColumn(
                "place", F.row_number().over(Window.partitionBy("resource").orderBy("ord"))
            )
            .filter("place <= 2")
            .groupBy("resource")
            .agg(
                F.max(F.when(F.col("place") == 1, F.col("owner"))).alias("leader"),
                F.max(F.when(F.col("place") == 2, F.col("ord"))).alias("rival"),
            )
        )
        ready = (F.col("owner") == F.col("leader")) & (
            F.col("rival").isNull() | (F.col("ord") < F.col("rival"))
        )
        waiting = (
            alive.join(first, "resource")
            .filter(~ready)
            .select("command", F.lit(True).alias("waits"))
            .distinct()
        )
        decided = cut(alive.join(waiting, "command", "left"))
        won = decided.filter("waits IS NULL")
        owned = owned.union(won.select("resource", "owner"))
        accepted = accepted.union(won.select("command").distinct())
        open_claims = decided.filter("waits").drop("waits")
    return accepted
