"""Language ID by cross-parsing: how few phrases of a language's sample make up a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import keyed, map_batches, table

#: A language's sample: from each of SLOTS slots the labelled document with a letter that has the
#: smallest hash of its id. Its SYMBOLS are dealt evenly among them, and each gives a window from a
#: hashed place of its text. So an automaton has under 65,535 states.
SLOTS, SYMBOLS = 64, 30_000
LETTER = r"\p{L}"
#: Symbols that are parsed as one piece; phrases don't cross from piece to piece.
PIECE = 2048
UNKNOWN = "und"
#: How fast the score falls with the bits per symbol that separate languages.
SHARPNESS = 8.0

_GAP = ord(" ")
_NONE = 0xFFFF


def lower_letters() -> np.ndarray:
    """Per code point the lower case of a letter, and a gap for what is no letter."""
    out = np.full(0x110000, _GAP, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            out[code] = ord(c.lower()[0])
    return out


def symbols_of(text: str, letters: np.ndarray) -> np.ndarray:
    """UTF-8 bytes of the lower-cased letters; a run of anything else is one gap."""
    found = letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = found == _GAP
    keep = np.ones(len(found), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return np.frombuffer(found[keep].tobytes().decode("utf-32-le").encode(), np.uint8)


def automaton(symbols: np.ndarray, size: int) -> np.ndarray:
    """The suffix automaton of a sequence as a table [state, symbol] of next states, _NONE if none.

    State 0 is the start; what can be read from it are exactly the sequence's substrings.
    """
    follow: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in follow[at]:
            follow[at][c] = new
            at = link[at]
        if at >= 0:
            to = follow[at][c]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(follow)
                follow.append(dict(follow[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and follow[at].get(c) == to:
                    follow[at][c] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    out = np.full((len(follow), size), _NONE, np.uint16)
    for state, by_symbol in enumerate(follow):
        for c, to in by_symbol.items():
            out[state, c] = to
    return out


@dataclass(frozen=True)
class Model:
    """Automata of the languages, each over the bytes that its own sample has.

    ``columns`` numbers a language's bytes; all others share a last column that leads nowhere.
    """

    letters: np.ndarray
    languages: tuple[str, ...]
    columns: tuple[np.ndarray, ...]
    automata: tuple[np.ndarray, ...]
    log_sizes: np.ndarray


def sample_symbols(texts: list[str], letters: np.ndarray) -> np.ndarray:
    """All excerpts of a language, each with an even share of SYMBOLS at most, gaps between them."""
    share = max(SYMBOLS // max(len(texts), 1) - 1, 1)
    gap = np.array([_GAP], np.uint8)
    return np.concatenate([part for t in texts for part in (symbols_of(t, letters)[:share], gap)])


def fit(samples: dict[str, list[str]]) -> Model:
    """A model of sample texts per language; languages without a letter are left out."""
    letters = lower_letters()
    languages, columns, automata, sizes = [], [], [], []
    for lang in sorted(samples):
        if not any(c.isalpha() for t in samples[lang] for c in t):
            continue
        joined = sample_symbols(samples[lang], letters)
        own = np.unique(joined)
        number = np.full(256, len(own), np.uint8)
        number[own] = np.arange(len(own))
        languages.append(lang)
        columns.append(number)
        automata.append(automaton(number[joined], len(own) + 1))
        sizes.append(np.log2(len(joined) + 1))
    return Model(letters, tuple(languages), tuple(columns), tuple(automata), np.array(sizes))


def phrases(pieces: list[np.ndarray], next_state: np.ndarray) -> np.ndarray:
    """Number of phrases of each piece: longest matches one after another, unknown symbols alone.

    All pieces advance together, one symbol at a time. Pieces must come longest first.
    """
    n, size = len(pieces), next_state.shape[1]
    lengths = np.array([len(p) for p in pieces])
    grid = np.zeros((int(lengths[0]) if n else 0, n), np.uint8)
    for i, p in enumerate(pieces):
        grid[: len(p), i] = p
    flat, start = next_state.ravel(), next_state[0]
    state = np.zeros(n, np.int64)
    count = np.zeros(n, np.int64)
    active = n - np.searchsorted(lengths[::-1], np.arange(len(grid)), side="right")
    for t, m in enumerate(active.tolist()):
        c = grid[t, :m]
        s = state[:m]
        to = flat[s * size + c]
        miss = np.flatnonzero(to == _NONE)
        if len(miss):
            again = start[c[miss]]
            lost = again == _NONE
            count[miss] += (s[miss] != 0).astype(np.int64) + lost
            to[miss] = np.where(lost, 0, again)
        state[:m] = to
    return count + (state != 0)


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and score of every text; all its symbols are parsed."""
    lang = [UNKNOWN] * len(texts)
    score = np.zeros(len(texts))
    owners, pieces, lengths = [], [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        if not text or not model.languages:
            continue
        symbols = symbols_of(text, model.letters)
        if (symbols == _GAP).all():
            continue
        lengths[i] = len(symbols)
        for a in range(0, len(symbols), PIECE):
            owners.append(i)
            pieces.append(symbols[a : a + PIECE])
    if not pieces:
        return lang, score
    order = np.argsort([-len(p) for p in pieces], kind="stable")
    pieces, owners = [pieces[i] for i in order], np.array(owners)[order]
    judged = np.flatnonzero(lengths)
    bits = np.empty((len(model.languages), len(judged)))
    for k, (number, next_state) in enumerate(zip(model.columns, model.automata, strict=True)):
        count = np.bincount(owners, weights=phrases([number[p] for p in pieces], next_state), minlength=len(texts))
        bits[k] = count[judged] * model.log_sizes[k] / lengths[judged]
    best = bits.argmin(axis=0)
    share = 1 / np.exp2(-SHARPNESS * (bits - bits.min(axis=0))).sum(axis=0)
    for i, b, s in zip(judged.tolist(), best.tolist(), share.tolist(), strict=True):
        lang[i], score[i] = model.languages[b], s
    return lang, score


def learn(docs: DataFrame, lang_col: str, learns: Column) -> Model:
    """The model of a bounded sample of the labelled rows of (doc_id, text, lang) to learn from.

    A first pass keeps one hash per language and slot, of documents that have a letter; a second
    reads windows of those texts. SYMBOLS code points per language reach the driver.
    """
    labelled = docs.filter(
        learns & F.col(lang_col).isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(LETTER)
    )
    mark = F.xxhash64("doc_id")
    least = (
        labelled.groupBy(lang_col, F.pmod(F.hash("doc_id"), F.lit(SLOTS)).alias("slot"))
        .agg(F.min(mark).alias("mark"))
        .collect()
    )
    if not least:
        return fit({})
    shares = {lang: SYMBOLS // n for lang, n in Counter(r[lang_col] for r in least).items()}
    long = F.create_map(*[F.lit(v) for pair in shares.items() for v in pair])[F.col(lang_col)]
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.length("text") - long, F.lit(0)) + 1) + 1
    window = F.substr("text", start.cast("int"), long)
    # A window without a letter gives way to one that starts with the text's first letter.
    lettered = F.when(window.rlike(LETTER), window).otherwise(
        F.substr("text", F.regexp_instr("text", F.lit(LETTER)), long)
    )
    rows = (
        labelled.filter(mark.isin(sorted({r["mark"] for r in least})))
        .groupBy("doc_id", lang_col)
        .agg(F.min(lettered).alias("text"))
        .orderBy(mark, lang_col)
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for r in rows:
        samples.setdefault(r[lang_col], []).append(r["text"])
    return fit(samples)


def held_out(doc_id: Column) -> Column:
    """A third of the documents by a checksum of their id; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_language(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Predicts the language of every whole text.

    Learns from labelled documents that are not held out, a bounded sample of each language. A text
    is parsed into longest phrases that a language's sample contains; phrases times the log of the
    sample's size, per symbol, are its bits in that language. The language with the fewest wins,
    ties to the first in alphabetical order. The score is the winner's share when a bit per symbol
    weighs 2 to the power SHARPNESS; it is 1 if only one language was learned.

    Returns ``doc_id, held_out, lang_pred, score[, row]``, one row per input row.

    - Null texts and texts without a letter are ``und`` with score 0, and so is all text if nothing
      could be learned. Rows with a null label or id aren't learned from.
    - Rows with equal ids are judged one by one. An empty table gives an empty result.
    - The label, the id and all other columns have no part in a prediction.
    """
    keys = keyed(docs, id_col, text_col)
    labelled = docs.select(
        docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("label")
    )
    model = learn(labelled, "label", ~held_out(F.col("doc_id")))
    plain = (model.letters, model.languages, model.columns, model.automata, model.log_sizes)
    shared = keys.sparkSession.sparkContext.broadcast(plain)
    keys = keyed(docs, id_col, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for b in batches:
            lang, score = predict(b.column("text").to_pylist(), model)
            columns = [b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)]
            if carry:
                columns.append(b.column("row"))
            names = ["doc_id", "lang_pred", "score", "row"]
            yield pa.record_batch(columns, names=names[: len(columns)])

    schema = "doc_id bigint, lang_pred string, score double"
    if carry:
        schema += f", row {keys.schema['row'].dataType.simpleString()}"
    out = map_batches(keys, run, schema)
    rest = ["row"] if carry else []
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", *rest)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
