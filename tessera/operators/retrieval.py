"""Batch text retrieval: query phrases, phrase match, AND search, OR with BM25 ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import tokens, words
from tessera.limits import BM25_B, BM25_K1, GLOBAL_SCOPE
from tessera.operators.textindex import TextIndex

# Score contributions are added as whole multiples of 1e-14. Integer sums do not depend on
# the order of addition, so equal documents always tie and partial sums can be combined early.
SCORE_SCALE = 1e14
# A query is at most 256 bytes, so at most 128 phrases; two scopes each. A batch up to this
# many queries therefore has a side of bounded size, which is broadcast to the postings scan.
BROADCAST_QUERIES = 2_000


def few(queries: DataFrame) -> bool:
    """True for a batch of at most ``BROADCAST_QUERIES`` queries; reads no more rows than that."""
    return queries.select("query_id").limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES


def query_phrases(queries: DataFrame) -> DataFrame:
    """One row per whitespace term of a query, with the tokens of the term.

    A term without letters or digits stays, with no tokens: it matches nothing.
    """
    return queries.select(
        "query_id", F.posexplode(words(F.col("query"))).alias("ix", "term")
    ).select(
        "query_id",
        F.col("ix").cast("bigint").alias("term_ix"),
        "term",
        tokens(F.col("term")).alias("tokens"),
    )


def phrase_id() -> Column:
    """Name of a phrase. Terms without tokens have the empty one, which is in no index."""
    return F.coalesce(F.array_join("tokens", " "), F.lit(""))


def query_scopes(queries: DataFrame, scopes: DataFrame) -> DataFrame:
    """(query_id, scope_id) rows of the scopes a query may read: its own, and the global one."""
    own = queries.select("query_id", "scope_id")
    # Scope names are unique, so this is one id or null.
    global_id = scopes.filter(F.col("name") == GLOBAL_SCOPE).select("id").scalar()
    shared = queries.filter("include_global").select("query_id", global_id.alias("scope_id"))
    return own.unionByName(shared.filter("scope_id IS NOT NULL")).distinct()


@dataclass(frozen=True)
class QueryBatch:
    """Queries cut into phrases. ``scoped`` is None when the whole index may be read.

    ``bounded`` and ``long_phrases`` come from one look at the batch: whether it is small
    enough to broadcast, and whether any term has more than one token.
    """

    phrases: DataFrame
    scoped: DataFrame | None
    bounded: bool
    long_phrases: bool

    @classmethod
    def of(cls, queries: DataFrame, scopes: DataFrame | None = None) -> QueryBatch:
        phrases = query_phrases(queries)
        look = (
            phrases.agg(
                F.count("*").alias("terms"),
                F.coalesce(F.max(F.size("tokens")), F.lit(0)).alias("longest"),
            )
        ).first()
        scoped = None if scopes is None else query_scopes(queries, scopes)
        return cls(phrases, scoped, look["terms"] <= BROADCAST_QUERIES * 128, look["longest"] > 1)

    @property
    def keys(self) -> list[str]:
        return ["phrase_id"] if self.scoped is None else ["phrase_id", "scope_id"]

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast a side derived from the queries when their number was found small.

        Past that the join shuffles on the term; a frequent term is then split by Spark's
        skew join.
        """
        return F.broadcast(df) if self.bounded else df

    def with_scopes(self, df: DataFrame) -> DataFrame:
        return df if self.scoped is None else df.join(self.scoped, "query_id")

    def asked(self) -> DataFrame:
        """Phrases that can match, keyed by their tokens."""
        return self.phrases.filter(F.size("tokens") > 0).withColumn("phrase_id", phrase_id())


def _lookup(index: TextIndex, batch: QueryBatch, wanted: DataFrame, scoped: bool) -> DataFrame:
    """Postings of one-token phrases, joined with every row of ``wanted``."""
    single = (
        wanted.filter(F.size("tokens") == 1)
        .withColumn("term", F.col("tokens")[0])
        .withColumn("bucket", index.bucket(F.col("term")))
    )
    on = ["bucket", "term", "scope_id"] if scoped else ["bucket", "term"]
    return index.postings().join(batch.hint(single.drop("tokens")), on)


def _long_hits(index: TextIndex, batch: QueryBatch, distinct: DataFrame, scoped: bool) -> DataFrame:
    """Matches of phrases of several tokens, in title and body apart.

    The postings of a phrase's rarest token give its possible starts; the other tokens are
    looked up only for those records. A phrase with a token the index lacks is gone early.
    """
    keys = ["phrase_id", "scope_id"] if scoped else ["phrase_id"]
    tokens_of = (
        distinct.filter(F.size("tokens") > 1)
        .select("phrase_id", "tokens")
        .distinct()
        .select("phrase_id", F.size("tokens").alias("n"), F.posexplode("tokens").alias("offset", "term"))
        .withColumn("bucket", index.bucket(F.col("term")))
    )
    part = F.struct("offset", "term", "bucket")
    phrases = (
        index.term_stats()
        .join(batch.hint(tokens_of), ["bucket", "term"])
        .groupBy("phrase_id", "n")
        .agg(F.min(F.struct("df", part.alias("part"))).alias("rarest"), F.collect_list(part).alias("parts"))
        .filter(F.size("parts") == F.col("n"))
        .select(
            "phrase_id",
            F.col("rarest.part.offset").alias("offset"),
            F.col("rarest.part.term").alias("term"),
            F.col("rarest.part.bucket").alias("bucket"),
            F.filter("parts", lambda p: p["offset"] != F.col("rarest.part.offset")).alias("others"),
        )
    )
    on = ["bucket", "term"]
    if scoped:
        phrases = phrases.join(batch.hint(distinct.select(*keys).distinct()), "phrase_id")
        on = [*on, "scope_id"]

    def shifted(column: str) -> Column:
        return F.transform(F.col(column), lambda p: p - F.col("offset"))

    starts = (
        index.postings()
        .join(batch.hint(phrases), on)
        .select(
            *keys, "record_id", "dl", F.size("others").alias("n"), "others",
            shifted("title_pos").alias("t"), shifted("body_pos").alias("b"),
        )
        .select("*", F.inline("others"))
        .drop("others")
    )
    # Only the terms asked for are shuffled, each (term, record) once.
    asked_terms = tokens_of.select("bucket", "term").distinct()
    found = (
        index.postings()
        .join(batch.hint(asked_terms), ["bucket", "term"], "left_semi")
        .select("bucket", "term", "record_id", "title_pos", "body_pos")
    )
    met = (
        starts.join(found, ["bucket", "term", "record_id"])
        .withColumn("t", F.array_intersect("t", shifted("title_pos")))
        .withColumn("b", F.array_intersect("b", shifted("body_pos")))
        .filter((F.size("t") > 0) | (F.size("b") > 0))
    )
    # One row per further token of the phrase, fewer than the query has bytes.
    grouped = (
        met.groupBy(*keys, "record_id", "dl", "n")
        .agg(F.collect_list(F.struct("t", "b")).alias("lists"))
        .filter(F.size("lists") == F.col("n"))
    )

    def common(side: str) -> Column:
        first = F.col("lists")[0][side]
        return F.aggregate("lists", first, lambda acc, s: F.array_intersect(acc, s[side]))

    return (
        grouped.withColumn("tf", (F.size(common("t")) + F.size(common("b"))).cast("bigint"))
        .filter("tf > 0")
        .select(*keys, "record_id", "tf", "dl")
    )


def phrase_matches(index: TextIndex, batch: QueryBatch, shared: bool = False) -> DataFrame:
    """(query_id, term_ix, record_id, tf, dl): occurrences of each phrase per record.

    ``shared`` gives those of a phrase once, whoever asks for it: (phrase_id, record_id, tf, dl).
    """
    scoped = batch.scoped is not None
    if shared and scoped:
        raise ValueError("matches of a batch with scopes differ by query")
    asked = batch.with_scopes(batch.asked())
    distinct = asked.select(*batch.keys, "tokens").distinct()
    if shared:
        out = ["phrase_id", "record_id", "tf", "dl"]
        hits = _lookup(index, batch, distinct, scoped).select(*out)
        return hits.unionByName(_long_hits(index, batch, distinct, scoped)) if batch.long_phrases else hits
    out = ["query_id", "term_ix", "record_id", "tf", "dl"]
    hits = _lookup(index, batch, asked.drop("term"), scoped).select(*out)
    if batch.long_phrases:
        long = _long_hits(index, batch, distinct, scoped)
        hits = hits.unionByName(
            long.join(batch.hint(asked.drop("tokens", "term")), batch.keys).select(*out)
        )
    return hits


def match_any(matches: DataFrame) -> DataFrame:
    """Records that hold at least one phrase of the query."""
    return matches.select("query_id", "record_id").distinct()


def search_and(matches: DataFrame, phrases: DataFrame, bounded: bool = False) -> DataFrame:
    """Records that hold every phrase of the query.

    ``matches`` are per query, or shared by all queries. Shared ones of a ``bounded`` batch are judged record by
    record, so that none becomes a row per query and only (phrase, record) pairs are shuffled.
    """
    if "phrase_id" in matches.columns:
        terms = phrases.withColumn("phrase_id", phrase_id())
        if bounded:
            return _held(matches, phrases, terms)
        matches = matches.join(terms, "phrase_id")
    asked = phrases.groupBy("query_id").agg(F.count("*").alias("asked"))
    found = matches.groupBy("query_id", "record_id").agg(F.count("*").alias("found"))
    return found.join(asked, "query_id").filter("found = asked").select("query_id", "record_id")


def _held(matches: DataFrame, phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """``search_and`` of shared matches and a batch that is broadcast.

    A record's phrases are one array, no longer than the record has tokens. A query is looked at where the
    record holds that phrase of it which fewest queries ask for; the others are looked up in the array.
    """
    # Sorted, so that all passes over the batch number its phrases alike.
    numbers = terms.agg(F.sort_array(F.collect_set("phrase_id")).alias("ids")).select(
        F.posexplode("ids").alias("no", "phrase_id")
    )
    asking = terms.groupBy("phrase_id").agg(F.count("*").alias("asking"))
    numbered = (
        terms.join(F.broadcast(numbers), "phrase_id")
        .join(F.broadcast(asking), "phrase_id")
        .select("query_id", "no", "asking")
    )
    parts = F.array_sort(F.collect_set(F.struct("asking", "no")))["no"]
    queries = (
        numbered.filter("query_id IS NOT NULL")
        .groupBy("query_id")
        .agg(parts.alias("parts"))
        .select(
            "query_id",
            "parts",
            F.col("parts")[0].alias("no"),
            F.coalesce(F.get("parts", F.lit(1)), F.col("parts")[0]).alias("second"),
        )
    )
    records = (
        matches.join(F.broadcast(numbers), "phrase_id")
        .groupBy("record_id")
        .agg(F.collect_list("no").alias("have"))
    )

    def held(part: Column) -> Column:
        return F.array_contains("have", part)

    once = F.size("have") == F.size(F.array_distinct("have"))
    whole = (
        records.filter(once)
        .select("record_id", "have", F.explode("have").alias("no"))
        .join(F.broadcast(queries), "no")
        .filter(held(F.col("second")) & ((F.size("parts") <= 2) | F.forall("parts", held)))
        .select("query_id", "record_id")
    )
    # Copies of a record that differ in length have matches each, which all count.
    copies = records.filter(~once).select("record_id", F.explode("have").alias("no"))
    return whole.unionByName(search_and(copies.join(F.broadcast(numbered), "no"), phrases))


def phrase_idf(index: TextIndex, batch: QueryBatch) -> DataFrame:
    """(phrase_id, idf): stored document frequency for one token, counted matches for more.

    Frequencies are taken over the whole index, whatever the scope.
    """
    distinct = batch.asked().select("phrase_id", "tokens").distinct()
    single = (
        distinct.filter(F.size("tokens") == 1)
        .withColumn("term", F.col("tokens")[0])
        .withColumn("bucket", index.bucket(F.col("term")))
    )
    df = index.term_stats().join(batch.hint(single), ["bucket", "term"]).select("phrase_id", "df")
    if batch.long_phrases:
        long = _long_hits(index, batch, distinct, False)
        df = df.unionByName(long.groupBy("phrase_id").agg(F.count("*").alias("df")))
    return df.select("phrase_id", index.idf(F.col("df")).alias("idf"))


def bm25_scores(index: TextIndex, batch: QueryBatch) -> DataFrame:
    """(query_id, record_id, units, score); repeated query terms count again."""
    scoped = batch.scoped is not None
    wanted = (
        batch.asked()
        .groupBy("query_id", "phrase_id", "tokens")
        .agg(F.count("*").alias("times"))
        .join(batch.hint(phrase_idf(index, batch)), "phrase_id")
    )
    wanted = batch.with_scopes(wanted)
    out = ["query_id", "record_id", "times", "idf", "tf", "dl"]
    hits = _lookup(index, batch, wanted, scoped).select(*out)
    if batch.long_phrases:
        distinct = batch.with_scopes(batch.asked()).select(*batch.keys, "tokens").distinct()
        long = _long_hits(index, batch, distinct, scoped)
        hits = hits.unionByName(
            long.join(batch.hint(wanted.drop("tokens")), batch.keys).select(*out)
        )
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    norm = BM25_K1 * (1.0 - BM25_B + BM25_B * dl / F.lit(index.avgdl))
    gain = F.col("idf") * (tf * (BM25_K1 + 1.0)) / (tf + norm)
    return (
        hits.withColumn("units", F.col("times") * F.round(gain * SCORE_SCALE).cast("bigint"))
        .groupBy("query_id", "record_id")
        .agg(F.sum("units").alias("units"))
        .withColumn("score", F.col("units") / SCORE_SCALE)
    )


def top_k(rows: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per query; the limit is applied before and after the shuffle."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return (
        rows.withColumn(rank, F.row_number().over(window))
        .filter(F.col(rank) <= k)
        .withColumn(rank, F.col(rank).cast("bigint"))
    )


def bm25_topk(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, k, F.desc("units"), F.desc("record_id"), rank="bm25_rank")
