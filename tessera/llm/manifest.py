"""Merkle manifest of a dataset: digests go up to parents, proofs go down to leaves."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.store import saved

#: Children of a node.
FANOUT = 8
#: Levels of the tree that one group works through; a group has at most FANOUT ** LEVELS nodes.
LEVELS = 4

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PATH = "before array<string>, after array<string>, subroot string"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field as its length in UTF-8 bytes, a colon and its text; ``-`` if null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def digest_of(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_of(nodes: int, size: int, levels: int) -> int:
    """Levels that a block of ``nodes`` nodes goes up: all, or to the root of a tree of ``size`` nodes."""
    if size > FANOUT**levels:
        return levels
    high = 0
    while nodes > 1:
        nodes, high = -(-nodes // FANOUT), high + 1
    return high


def rise(digests: Sequence[str], levels: int) -> list[list[list[str]]]:
    """The runs of every level of a block, processed forward in time.

    Nodes are labelled (level, place). A priority queue holds the digests that are on their way,
    ordered by the label of the sender, which orders them by receiver as well: the next receiver's
    children lie in front. Its own digest joins the queue. The last run has the block's one digest.
    """
    queue = [(0, place, digest) for place, digest in enumerate(digests)]  # sorted, so a heap
    runs: list[list[list[str]]] = [[] for _ in range(levels)]
    while queue and queue[0][0] < levels:
        level, place, digest = heapq.heappop(queue)
        parent, run = place // FANOUT, [digest]
        while queue and queue[0][0] == level and queue[0][1] // FANOUT == parent:
            run.append(heapq.heappop(queue)[2])
        runs[level].append(run)
        heapq.heappush(queue, (level + 1, parent, digest_of(run)))
    runs.append([[digest for _, _, digest in sorted(queue)]])
    return runs


def fall(runs: list[list[list[str]]], before: list[str], after: list[str]) -> list[tuple[list[str], list[str]]]:
    """What comes before and after every leaf of a block, level by level, processed backward in time.

    Parents go in reversed order of labels; each sends every child its siblings and the suffix
    that it got itself.
    """
    above = [(before, after)]
    for level in range(len(runs) - 2, -1, -1):
        here = []
        for run, (left, right) in zip(runs[level], above, strict=True):
            for i in range(len(run)):
                here.append((["".join(run[:i]), *left], ["".join(run[i + 1 :]), *right]))
        above = here
    return above


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("at", levels * (FANOUT.bit_length() - 1)))


def up(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, size, at, digest): the nodes a round higher, each the root of one block."""

    def run(keys: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        size = rows["size"][0].as_py()
        runs = rise(rows["digest"].to_pylist(), levels_of(rows.num_rows, size, levels))
        one = {"tree": keys[0].as_py(), "size": -(-size // FANOUT**levels), "at": keys[1].as_py(), "digest": runs[-1][0][0]}
        return pa.Table.from_pylist([one])

    blocks = in_blocks(nodes.select("tree", "size", "at", "digest"), levels)
    return blocks.groupBy("tree", "block").applyInArrow(run, "tree bigint, size bigint, at bigint, digest string")


def down(nodes: DataFrame, paths: DataFrame, levels: int, carry: Sequence[str] = ()) -> DataFrame:
    """(tree, at, digest, carried columns, path): the nodes with the paths of their blocks prolonged."""
    names = ["tree", "at", "digest", *carry]

    def run(rows: pa.Table, path: pa.Table):
        rows = rows.sort_by("at")
        digests = rows["digest"].to_pylist()
        runs = rise(digests, levels_of(len(digests), rows["size"][0].as_py(), levels))
        found = fall(runs, path["before"][0].as_py(), path["after"][0].as_py())
        out = {name: rows[name] for name in names}
        out["before"] = pa.array([x for x, _ in found], pa.list_(pa.string()))
        out["after"] = pa.array([x for _, x in found], pa.list_(pa.string()))
        out["subroot"] = pa.array(path["subroot"].to_pylist() * len(found), pa.string())
        return pa.table(out)

    blocks = in_blocks(nodes, levels)
    kinds = [f"{n} {nodes.schema[n].dataType.simpleString()}" for n in names]
    of_blocks = paths.select("tree", F.col("at").alias("block"), "before", "after", "subroot")
    return (
        blocks.groupBy("tree", "block")
        .cogroup(of_blocks.groupBy("tree", "block"))
        .applyInArrow(run, ", ".join([*kinds, PATH]))
    )


def climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round, and the roots: (tree, size = 1, at = 0, digest)."""
    rounds = []
    while not nodes.filter("size > 1").isEmpty():
        rounds.append(nodes)
        nodes = saved(up(nodes, levels), "nodes")
    return rounds, nodes


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``tree`` (number of the group among all), ``size`` and ``at`` (place in its group).

    Rows are range-partitioned by group, order and a number that was written with them, so any
    group, and any repeated row, is spread over tasks. What is summed over partitions is one row per
    partition and group in it.
    """
    rows = saved(rows.withColumn("written", F.monotonically_increasing_id()), "rows")
    by = [group, *order, "written"]
    placed = saved(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("written")
        .withColumn("serial", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("serial", 33)),
        "placed",
    )
    spans = placed.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("serial").alias("first"))
    spans = saved(spans, "spans")
    sizes = spans.groupBy(group).agg(F.sum("n").alias("size"))
    # a partition's groups follow one another, so groups are numbered per partition in which they begin
    begun = spans.groupBy(group).agg(F.min("part").alias("part"), F.min("first").alias("first"))
    opened = begun.groupBy("part").agg(F.count("*").alias("opened"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    opened = opened.select("part", F.coalesce(F.sum("opened").over(so_far), F.lit(0)).alias("opened"))
    trees = begun.join(opened, "part").select(
        F.col(group).alias("_group"),
        (F.col("opened") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1).alias("tree"),
    )
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(group, "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("passed"))
    spans = spans.join(sizes.withColumnRenamed(group, "_of"), F.col(group).eqNullSafe(F.col("_of")))
    spans = spans.join(trees, F.col(group).eqNullSafe(F.col("_group"))).select(
        F.col(group).alias("_group"), F.col("part").alias("_part"), "first", "passed", "size", "tree"
    )
    joined = placed.join(spans, (F.col("part") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn("at", F.col("passed") + F.col("serial") - F.col("first")).drop(
        "_group", "_part", "first", "passed", "serial", "part"
    )


def manifest(
    leaves: DataFrame, group: str, order: Sequence[str], carry: Sequence[str] = (), levels: int = LEVELS
) -> tuple[DataFrame, str | None]:
    """Proofs of all leaves, and the root.

    ``leaves`` has ``digest`` and the columns ``group``, ``order`` and ``carry``, none of them called
    like a column of this module. Returns (digest, carried columns, before, after, subroot) and the
    root's digest (None for no leaves). A proof has, level by level from the leaf up, the digests of
    the siblings before and after the node, as joined hex text. Every group is a tree of its own,
    whose root is ``subroot``; the subroots in the order of their groups are the leaves of the last.

    Time-forward processing: nodes are labelled (tree, level, place). What a node sends waits for
    its receiver in a priority queue ordered by label. Within a block of FANOUT ** levels leaves that
    queue is a heap in one task; between blocks it is external: a written table, which Spark's
    shuffle deals out by the receiver's block and sorts. The reversed sweep reads the same
    tables from the last round to the first and sends proofs down. A group has at most a block's rows,
    so no tree, however large, is one task's work; rounds grow with the logarithm of the leaves.
    """
    nodes = saved(
        numbered(leaves, group, [*order, "digest"]).select("tree", "size", "at", "digest", *carry), "leaves"
    )
    rounds, subroots = climb(nodes, levels)
    if subroots.isEmpty():
        nothing = nodes.select(
            "digest", *carry, *[F.lit(None).cast("array<string>").alias(n) for n in ("before", "after")]
        )
        return nothing.withColumn("subroot", F.lit(None).cast("string")), None
    trees = subroots.count()
    top, root = climb(
        subroots.select(
            F.lit(0).cast("bigint").alias("tree"), F.lit(trees).cast("bigint").alias("size"), F.col("tree").alias("at"), "digest"
        ),
        levels,
    )
    empty = F.array().cast("array<string>")
    paths = root.select("tree", "at", "digest", empty.alias("before"), empty.alias("after"), F.lit(None).cast("string").alias("subroot"))
    for below in reversed(top):
        paths = saved(down(below, paths, levels), "paths")
    paths = paths.select(
        F.col("at").alias("tree"), F.lit(0).cast("bigint").alias("at"), "before", "after", F.col("digest").alias("subroot")
    )
    for below in reversed(rounds[1:]):
        paths = saved(down(below, paths, levels), "paths")
    proofs = down(nodes, paths, levels, carry)
    return proofs.drop("tree", "at"), root.first()["digest"]


def folded(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(
        F.arrays_zip(before.alias("before"), after.alias("after")),
        leaf,
        lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]).cast("binary"), 256),
    )


def proof_text(before: Column, after: Column) -> Column:
    """All siblings of a proof, level by level, from left to right."""
    levels = F.transform(F.arrays_zip(before.alias("before"), after.alias("after")), lambda s: F.concat(s["before"], s["after"]))
    return F.array_join(levels, "")


def verify_dataset(
    docs: DataFrame,
    changed: Column,
    id_col: str = "doc_id",
    fields: Sequence[str] = FIELDS,
    group_col: str = "lang",
    text_col: str = "text",
    levels: int = LEVELS,
) -> DataFrame:
    """Every row's proof against the manifest of ``docs``, after rows where ``changed`` holds had A-Z lower-cased.

    Returns ``doc_id, leaf, subroot, root, before, after, proof_sha256, folded_root, verified``, one
    row per input row; ``before`` and ``after`` are the proof.

    - Leaves are ordered by id within a group (null ids first), groups bytewise (null first). Rows
      with an equal id are ordered by their digests, so any order of equal rows gives the same result.
    - A null in any field is ``-``; an empty text is ``0:``. A null text isn't changed, nor is a row
      where ``changed`` is null. Texts without A-Z stay as they are, so they verify.
    - A lone leaf is its group's subroot; a lone subroot is the root; then a proof is empty.
    - An empty table gives an empty result; other columns are ignored.

    Text is read and hashed once by Spark's own functions; what is shuffled are ids and digests.
    """
    values = [docs[c] for c in fields]
    lowered = [F.translate(docs[c], UPPER, LOWER) if c == text_col else docs[c] for c in fields]
    leaves = docs.select(
        docs[group_col].alias("g"),
        docs[id_col].cast("bigint").alias("doc_id"),
        leaf_digest(values).alias("digest"),
        F.when(changed, leaf_digest(lowered)).alias("tampered"),
    )
    proofs, root = manifest(leaves, "g", ["doc_id"], ["doc_id", "tampered"], levels)
    root_digest = F.lit(root).cast("string")
    out = proofs.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        root_digest.alias("root"),
        "before",
        "after",
        F.sha2(proof_text(F.col("before"), F.col("after")).cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "digest"), F.col("before"), F.col("after")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0
    return verify_dataset(docs, tampered).drop("before", "after")
