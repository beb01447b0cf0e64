"""Near-duplicates: one-permutation MinHash, banded buckets, stars of candidates, exact check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, Windows, keyed, map_batches, mix, of_ids, table, utf8
from tessera.llm.graph import components, extended
from tessera.llm.store import drop, saved

WORDS = 5
PERCENT = 75
#: A pair at the limit shares none of the bands in about 3 of 10 million cases.
BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
#: Stars are drawn until this many rounds in a row link nothing; then the pairs that are left follow.
QUIET_ROUNDS = 1
#: All pairs follow at once, without stars, if they are at most so many for each place in a bucket.
PAIRS_A_PLACE = 128
#: Pairs of a bucket that the first turn over them looks at; each later turn looks at twice as many.
TURN_PAIRS = 1_000_000

#: Longs of a set's parities: for each of 64 times as many bins, whether it holds an odd number.
PARITY_LONGS = 8

_U = np.uint64


def _preferences() -> np.ndarray:
    """For each bin a fixed random order of all bins: [bin, other] is the other's place in it."""
    at = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
    return np.argsort(np.argsort(mix(at + _U(1)), axis=1), axis=1)


class Sketcher:
    """Shingle sets and their signatures."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes, self.windows = words, WordHashes(), Windows()
        self.preferences = _preferences()

    def shingles(self, text: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of runs of words, A-Z lower-cased; a short text is one run."""
        values = self.hashes.of((text or b"").lower().split())
        n = len(values)
        if not n:
            return values
        if n < self.words:
            return mix(self.windows.of(values, n) + _U(n))
        return np.unique(self.windows.of(values, self.words))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash of each bin; an empty bin takes that of the full bin it prefers most.

        The preference is fixed per bin, so two sets agree in such a bin as often as in a full one
        (optimal densification).
        """
        full, first = np.unique(shingles % _U(BINS), return_index=True)
        full = full.astype(np.int64)
        out = np.empty(BINS, np.uint64)
        out[full] = shingles[first]
        empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
        if len(empty):
            out[empty] = out[full[self.preferences[np.ix_(empty, full)].argmin(axis=1)]]
        return out

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        rows = self.signature(shingles).reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            key = mix(key * _U(31) + rows[:, i])
        return key


def parities(shingles: np.ndarray) -> np.ndarray:
    """Bits in which two sets differ: at most as many as there are elements in only one of them."""
    bins = 64 * PARITY_LONGS
    odd = np.bincount((shingles >> _U(32)).astype(np.int64) % bins, minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, print, bands, parity): print identifies the set, bands are bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(words)
        for b in batches:
            sizes, prints, bands, odd = [], [], [], []
            for text in utf8(b.column("text")):
                found = sketcher.shingles(text)
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(sketcher.bands(found).view(np.int64) if len(found) else None)
                odd.append(parities(found) if len(found) else None)
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(odd, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "print", "bands", "parity"],
            )

    schema = "doc_id bigint, n_shingles bigint, print binary, bands array<bigint>, parity array<bigint>"
    return map_batches(docs, run, schema)


def measured(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """(center, member, far, near): the Jaccard distance of full sets, and whether it is small enough."""
    members = texts.select(F.col("doc_id").alias("member"), F.col("text").alias("text_m"))
    centers = texts.select(F.col("doc_id").alias("center"), F.col("text").alias("text_c"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(words)
        last, of_last = None, None
        for b in batches:
            far, near = [], []
            for one, other in zip(utf8(b.column("text_c")), utf8(b.column("text_m")), strict=True):
                if of_last is None or one != last:  # rows of a center follow one another
                    last, of_last = one, sketcher.shingles(one)
                found = sketcher.shingles(other)
                both = len(np.intersect1d(of_last, found, assume_unique=True))
                either = len(of_last) + len(found) - both
                far.append(1 - both / either if either else 0.0)
                near.append(both > 0 and 100 * both >= percent * either)
            yield pa.record_batch(
                [b.column("center"), b.column("member"), pa.array(far, pa.float64()), pa.array(near, pa.bool_())],
                names=["center", "member", "far", "near"],
            )

    rows = pairs.join(members, "member").join(centers, "center")
    schema = "center bigint, member bigint, far double, near boolean"
    return map_batches(rows.select("center", "member", "text_c", "text_m"), check, schema)


def drawn(members: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """A random member of each component in each bucket, and the buckets with several components.

    (bucket, component, rep, n) and (bucket, center, own, most, size, most_n): the star's center with
    its component, the component that has most of the bucket, the members of both.
    """
    pick = F.xxhash64("rep", "bucket", F.lit(turn))
    place = saved(
        with_component(members, labels)
        .groupBy("bucket", "component")
        .agg(F.min_by("rep", pick).alias("rep"), F.count("*").alias("n")),
        "places",
    )
    stars = saved(
        place.groupBy("bucket")
        .agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min_by("rep", pick).alias("center"),
            F.min_by("component", pick).alias("own"),
            F.max(F.struct("n", "component")).alias("most"),
            F.sum("n").alias("size"),
        )
        .filter("low < high")
        .select("bucket", "center", "own", F.col("most.component").alias("most"), "size", F.col("most.n").alias("most_n")),
        "stars",
    )
    return place, stars


def remaining(
    members: DataFrame, labels: DataFrame, stars: DataFrame, traits: DataFrame, from_center: DataFrame
) -> DataFrame:
    """(bucket, rep, component, sizes, far, main, slice) of the buckets that hold several components.

    ``main`` marks the members of the component that has most of the bucket; the others are dealt
    over slices, so that a slice and the bucket make about TURN_PAIRS pairs. ``far`` is the distance
    to the bucket's center where it was measured.
    """
    slices = F.ceil(F.col("size") * (F.col("size") - F.col("most_n")) / TURN_PAIRS)
    mixed = stars.select("bucket", "most", slices.alias("slices"))
    distances = from_center.select("center", F.col("member").alias("rep"), "far")
    return saved(
        with_component(members, labels)
        .join(mixed, "bucket")
        .join(distances, ["center", "rep"], "left")
        .join(traits, "rep")
        .select(
            "bucket",
            "rep",
            "component",
            "n_shingles",
            "parity",
            F.when(
                F.col("n_shingles").isNotNull(), F.when(F.col("rep") == F.col("center"), 0.0).otherwise(F.col("far"))
            ).alias("far"),
            (F.col("component") == F.col("most")).alias("main"),
            F.pmod(F.xxhash64("rep", "bucket"), F.col("slices")).alias("slice"),
        ),
        "remaining",
    )


def with_component(members: DataFrame, labels: DataFrame) -> DataFrame:
    joined = members.join(labels, members["rep"] == labels["node"], "left")
    return joined.select(*[members[c] for c in members.columns], F.coalesce("component", "rep").alias("component"))


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    for name in ("center", "member"):
        ends = labels.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
        pairs = pairs.join(ends, name, "left").withColumn(f"of_{name}", F.coalesce(f"of_{name}", name))
    return pairs.filter("of_center <> of_member").select("center", "member")


def possible(placed: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """(center, member) of pairs across components that have a member in slices from low to below high.

    A pair comes up with the lower of its two slices; members of ``main`` have none. Left out are
    only pairs that can't be similar enough: sets of sizes too different, sets whose distances to
    the bucket's center differ by more than the limit (Jaccard distance is a metric), and sets whose
    parities differ in more bins than similar sets have elements apart. A pair comes up in each of
    its buckets.
    """
    one = placed.filter(~F.col("main") & F.col("slice").between(low, high - 1)).alias("one")
    other = placed.alias("other")
    first = (
        F.col("other.main")
        | (F.col("other.slice") > F.col("one.slice"))
        | ((F.col("other.slice") == F.col("one.slice")) & (F.col("other.rep") > F.col("one.rep")))
    )
    sizes = F.col("one.n_shingles"), F.col("other.n_shingles")
    known = sizes[0].isNotNull() & sizes[1].isNotNull()
    least, most = F.when(known, F.least(*sizes)), F.when(known, F.greatest(*sizes))
    apart = sum(
        F.bit_count(F.col("one.parity")[i].bitwiseXOR(F.col("other.parity")[i])) for i in range(PARITY_LONGS)
    )
    rows = one.join(
        other,
        (F.col("one.bucket") == F.col("other.bucket"))
        & (F.col("one.component") != F.col("other.component"))
        & first
        & F.coalesce(100 * least >= percent * most, F.lit(True))
        & F.coalesce((100 + percent) * apart <= (100 - percent) * (least + most), F.lit(True))
        & F.coalesce(F.abs(F.col("one.far") - F.col("other.far")) <= 1 - percent / 100 + 1e-9, F.lit(True)),
    )
    ends = F.least("one.rep", "other.rep").alias("center"), F.greatest("one.rep", "other.rep").alias("member")
    return rows.select(*ends)


def few_possible(left: DataFrame, stars: DataFrame, places: int, percent: int) -> bool:
    """Whether all pairs of a bucket across components, of all buckets, can follow at once.

    They can if they are at most PAIRS_A_PLACE for each place in a bucket, so that looking at sizes,
    distances and parities costs no more than stars would, and if those that could be similar are
    no more than the places, so that measuring them doesn't either.
    """
    pairs = stars.agg(F.sum(F.col("size") * (F.col("size") - F.col("most_n")))).first()[0] or 0
    return pairs <= PAIRS_A_PLACE * places and possible(left, 0, 1 + pairs, percent).count() <= places


def link_near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = PERCENT,
    words: int = WORDS,
) -> DataFrame:
    """Components of documents whose sets of word runs have a Jaccard similarity of ``percent``.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row. The component's id
    is the smallest id that links reach; kept means doc_id = component_id.

    - Null, empty and blank texts have an empty set and link with nothing.
    - Rows with equal ids are judged by their own texts and all get the smallest component that
      one of them reaches. Rows with a null id link with nothing: null component, kept.
    - An empty table gives an empty result; other columns are ignored.

    Documents with equal sets become one class, represented by its smallest id. Representatives
    meet in the buckets of their bands. A bucket gives a star: its smallest id as the center, one
    edge to each other member, so the number of candidates is that of bucket places. Candidates are
    confirmed on full sets: first each member and the center that it shares most buckets with, so a
    text goes out once; then the other edges of stars that still join two components. Links are
    kept as components, which later links join; they are not followed anew. Then all pairs across
    components follow in the buckets that still hold several of these, at once if they are few for
    the number of bucket places. If not, such buckets first draw stars among their components: one
    randomly chosen member of each, one of them the center, until a round links nothing new. That
    joins most of what belongs together with few pairs, but proves nothing; the pairs that then
    still lie across components follow in turns that look at twice as many pairs each and know the
    links of the turns before. Only pairs that can't be similar enough are left out. In the end
    every similar pair that shares a bucket lies in one component.

    Nothing gathers a bucket, a class or a component in one task: minima combine before they are
    shuffled, and the joins on hot keys read both sides straight from a shuffle, where Spark splits
    large partitions.
    """
    spark = docs.sparkSession
    docs = keyed(docs, id_col, text_col)
    sketched = saved(sketches(docs, words), "sketches")
    with_set = sketched.filter("doc_id is not null and n_shingles > 0")
    first = saved(with_set.groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    classed = saved(
        with_set.join(first, "print").select(
            "doc_id",
            "rep",
            *[F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("n_shingles", "parity", "bands")],
        ),
        "classed",
    )
    # an id with several sets has no size and no parities that would hold for all of them
    traits = (
        classed.filter("bands is not null")
        .groupBy("rep")
        .agg(*[f(c).alias(f"{n}_{c}") for c in ("n_shingles", "parity") for n, f in (("low", F.min), ("high", F.max))])
        .withColumn("one", (F.col("low_n_shingles") == F.col("high_n_shingles")) & (F.col("low_parity") == F.col("high_parity")))
        .select("rep", *[F.when(F.col("one"), F.col(f"low_{c}")).alias(c) for c in ("n_shingles", "parity")])
    )
    places = classed.filter("bands is not null").select("rep", F.explode("bands").alias("bucket"))
    shared = saved(
        places.groupBy("bucket")
        .agg(F.min("rep").alias("center"), F.max("rep").alias("last"))
        .filter("center < last")
        .select("bucket", "center"),
        "buckets",
    )
    members = saved(places.join(shared, "bucket").select("bucket", "rep", "center"), "members")
    drop(first, shared)
    texts = saved(of_ids(docs, members.select(F.col("rep").alias("doc_id")).distinct()), "texts")
    votes = saved(
        members.filter("rep <> center").groupBy("center", F.col("rep").alias("member")).agg(F.count("*").alias("n")),
        "votes",
    )

    # each member and the center it shares most buckets with; then centers that this has not joined to it
    closest = F.max(F.struct("n", (-F.col("center")).alias("back")))["back"]
    tested = saved(votes.groupBy("member").agg((-closest).alias("center")).select("center", "member"), "pairs")
    from_center = saved(measured(tested, texts, percent, words), "measured")
    labels = components(from_center.filter("near").select("center", "member"), "center", "member")
    pairs = saved(
        across(votes.select("center", "member"), labels).join(tested, ["center", "member"], "left_anti"), "pairs"
    )
    more = saved(measured(pairs, texts, percent, words), "measured")
    labels = extended(labels, more.filter("near"), "center", "member")
    from_center, tested = from_center.unionByName(more), tested.unionByName(pairs)
    drop(votes)

    turn = 1
    place, stars = drawn(members, labels, turn)
    left = remaining(members, labels, stars, traits, from_center)
    at_once = few_possible(left, stars, members.count(), percent)
    if not at_once:
        drop(left)
        quiet = 0
        while True:
            pairs = (
                place.join(stars.select("bucket", "center", "own"), "bucket")
                .filter("component <> own")
                .select(F.least("center", "rep").alias("center"), F.greatest("center", "rep").alias("member"))
                .distinct()
                .join(tested, ["center", "member"], "left_anti")
            )
            pairs = saved(pairs, "pairs")
            if pairs.isEmpty():
                break
            more = saved(measured(pairs, texts, percent, words).filter("near"), "edges")
            tested = tested.unionByName(pairs)
            quiet = quiet + 1 if more.isEmpty() else 0
            labels = extended(labels, more, "center", "member")
            drop(more)
            if quiet == QUIET_ROUNDS:
                break
            drop(place, stars)
            turn += 1
            place, stars = drawn(members, labels, turn)
        # the last round has linked nothing, so its buckets are those of the labels
        left = remaining(members, labels, stars, traits, from_center)

    slices = left.agg(F.coalesce(F.max("slice") + 1, F.lit(0))).first()[0]
    placed, low, size = left, 0, slices if at_once else 1
    while low < slices:
        found = saved(possible(placed, low, low + size, percent).distinct(), "turn")
        pairs = saved(found.join(tested, ["center", "member"], "left_anti"), "pairs")
        drop(found)
        low, size = low + size, 2 * size
        if pairs.isEmpty():
            continue
        tested = tested.unionByName(pairs)
        more = saved(measured(pairs, texts, percent, words).filter("near"), "edges")
        labels = extended(labels, more, "center", "member")
        drop(more)
        if low < slices:
            if placed is not left:
                drop(placed)
            placed = saved(with_component(left.drop("component"), labels), "placed")
    if placed is not left:
        drop(placed)
    drop(place, stars)
    drop(members, texts, left)

    reached = classed.select("doc_id", "rep").join(
        labels.withColumnRenamed("node", "rep"), "rep", "left"
    )
    # rows of one id may hold several sets: the smallest component is that of the document
    by_doc = reached.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = sketched.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that a smaller id of their component stands for."""
    gone = (
        link_near_duplicates(docs, id_col, text_col)
        .filter("not kept")
        .select(F.col("doc_id").alias("_gone"))
        .distinct()
    )
    gone = saved(gone, "gone")
    return docs.join(gone, docs[id_col].cast("bigint") == gone["_gone"], "left_anti")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near_duplicates(table(spark, sf_dir, "documents"))
