"""Byte-level BPE: ranked merges folded over byte arrays of distinct words; decoding joins bytes."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, large_tasks, map_batches, table
from tessera.llm.store import saved

#: A word is frequent if it makes up at least one in FREQUENT of all words, so there are at most
#: FREQUENT of them; their ids go to every task.
FREQUENT = 400_000
#: Words whose ids a task remembers.
REMEMBERED = 600_000
#: Parts of the literal rank map, each searched from its start.
PARTS = 1 << 15


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by bytes of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def java_pattern(pattern: str) -> str:
    """The same pattern for Spark's functions: classes over all of Unicode."""
    return "(?U)" + pattern


class RankMap:
    """The ranks as a literal of Spark: an array of small maps, chosen by a checksum of the key."""

    def __init__(self, ranks: dict[bytes, int]):
        parts: list[dict[str, int]] = [{} for _ in range(PARTS)]
        for token, rank in ranks.items():
            parts[zlib.crc32(token) % PARTS][token.hex().upper()] = rank
        # parsed once, while the plan is optimized
        self.literal = F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), "array<map<string,int>>")

    def of(self, key: Column) -> Column:
        """Rank of a binary column, null if there is none."""
        part = F.get(self.literal, (F.crc32(key) % PARTS).cast("int"))
        return F.try_element_at(part, F.hex(key))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_merges(word: Column, ranks: RankMap) -> Column:
    """Ids of a binary word: its bytes, of which the pair with the least rank is joined again and
    again, the leftmost of equal ones, until no pair has a rank. A word with a rank is one id."""

    def joined(parts: Column, place: Column) -> Column:
        pair = F.concat(F.element_at(parts, place), F.element_at(parts, place + 1))
        return F.concat(F.slice(parts, 1, place - 1), F.array(pair), F.slice(parts, place + 2, F.size(parts)))

    def step(parts: Column, _: Column) -> Column:
        def merge(found: Column) -> Column:
            least = F.array_min(found)
            return F.when(least.isNull(), parts).otherwise(
                joined(parts, F.array_position(found, least).cast("int"))
            )

        pairs = F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: ranks.of(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))),
        )
        return F.when(F.size(parts) < 2, parts).otherwise(_let(pairs, merge))

    size = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
    folded = F.aggregate(F.sequence(F.lit(1), size), single, step)
    whole = ranks.of(word)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(folded, ranks.of))


def fold_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold for a word that isn't frequent: pairs wait in a heap, by rank and place."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    ends = list(range(1, n + 1))  # of the part that starts here; 0 once it is joined to another
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, at, end = heapq.heappop(heap)
        middle = ends[at]
        if not middle or middle >= n or ends[middle] != end:
            continue  # one of the two has changed meanwhile
        ends[at], ends[middle] = end, 0
        if end < n:
            before[end] = at
            rank = ranks.get(word[at : ends[end]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, ends[end]))
        left = before[at]
        if left >= 0:
            rank = ranks.get(word[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def frequent_words(docs: DataFrame, pattern: str, ranks: dict[bytes, int], frequent: int = FREQUENT) -> dict[str, list[int]]:
    """Ids of the words that make up at least one in ``frequent`` of all words of the texts.

    Words are counted over all texts and folded once each by Spark. At most ``frequent`` of them
    can exist, however large the corpus.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(java_pattern(pattern)), F.lit(0))).alias("word"))
    counts = saved(words.groupBy("word").agg(F.count("*").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.filter(F.col("n") * F.lit(frequent) >= F.lit(total)).select("word")
    # few rows: spread them, as each takes a while
    spread = often.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    folded = spread.select("word", fold_merges(F.encode("word", "utf-8"), RankMap(ranks)).alias("ids"))
    return {r["word"]: r["ids"] for r in folded.collect()}


def encode(
    docs: DataFrame,
    ranks: dict[bytes, int],
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = FREQUENT,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Token ids of whole texts: the pattern's matches, each folded by the ranks.

    Returns ``doc_id, ids[, row]``, one row per input row. All 256 single bytes need a rank.

    - Null and empty texts have no ids. Rows with equal or null ids are encoded one by one. An empty
      table gives an empty result.
    - A match of any length is folded whole, in time that grows with n log n.

    Frequent words are folded in Spark, once for the whole corpus, by the higher-order functions of
    ``fold_merges``; the tasks look them up. The many rare words would each have to be sent to their
    documents through two shuffles; a task folds them itself, with the same rule, and remembers a
    bounded number.
    """
    docs = keyed(docs, id_col, text_col, carry)
    known = frequent_words(docs, pattern, ranks, frequent)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matches = regex.compile(pattern).findall
        ranks, known = shared.value

        class Words(dict):
            def __missing__(self, word: str) -> list[int]:
                ids = known.get(word)
                if ids is None:
                    ids = fold_word(word.encode("utf-8", "surrogatepass"), ranks)
                if len(word) < 100:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[word] = ids
                return ids

        words = Words()
        for b in batches:
            values, offsets = [], [0]
            for text in b.column("text").to_pylist():
                for word in matches(text or ""):
                    values += words[word]
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            columns = [b.column("doc_id"), ids] + ([b.column("row")] if carry else [])
            yield pa.record_batch(columns, names=["doc_id", "ids", "row"][: len(columns)])

    schema = "doc_id bigint, ids array<int>"
    if carry:
        schema += f", row {docs.schema['row'].dataType.simpleString()}"
    return map_batches(large_tasks(docs), run, schema)


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids: their pieces, one after another. Unknown ids raise."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token.hex().upper()
    literal = F.split(F.lit(",".join(pieces)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(literal, i + 1)), ""))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), ranks), 256).alias("decoded_sha256"),
    )
