"""Quality rules, graded quality and language ID."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import grades, language, quality
from tests.llm.helpers import by_id, edge_docs, edge_rows, labels, no_docs, row, words

SF = "/root/testdata/sf0.01"


def measures(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    marked = {j for i in range(len(found) - 2) if runs[tuple(found[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (
        len(found),
        sum(map(len, found)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(marked),
    )


def test_rules(spark):
    known = labels(spark, [(7, 1, 0), (14, 1, 0), (16, 0, 0), (17, 0, 0), (None, 1, 0), (9, None, 0), (99, 1, 0), (7, 0, 1)])
    got = quality.quality_rules(edge_docs(spark), known).collect()
    want = [(r[0], *measures(r[1])) for r in edge_rows()]
    assert by_id(tuple(r)[:6] for r in got) == by_id(want)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_ratio_against_counts(spark):
    texts = {1: "alpha beta alpha", 2: "gamma delta", 3: "alpha gamma"}
    docs = spark.createDataFrame([row(i, t) for i, t in texts.items()], edge_docs(spark).schema)
    got = {r["doc_id"]: r["score"] for r in quality.quality_rules(docs, labels(spark, [(1, 1, 0), (2, 0, 0)])).collect()}
    hashes = quality.WordHashes()
    counts = {i: np.bincount(quality.grams(t.encode(), hashes.of(t.encode().split())), minlength=quality.BUCKETS) for i, t in texts.items()}
    raw = sum(counts.values())
    ratio = np.log(counts[1] + 1) - np.log(counts[1].sum() + quality.BUCKETS) - np.log(raw + 1) + np.log(raw.sum() + quality.BUCKETS)
    for i, c in counts.items():
        assert got[i] == pytest.approx((c * ratio).sum() / c.sum(), abs=1e-4)
    assert got[1] > got[3] > got[2]


def test_rules_without_labels_or_documents(spark):
    none = labels(spark, [])
    assert quality.quality_rules(no_docs(spark), none).collect() == []
    kept = quality.quality_rules(edge_docs(spark), none).filter("kept").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 7, 8, 9, 9, 10, 13, 14]


def good_and_bad(n, seed):
    rng = random.Random(seed)
    rows, known = [], []
    for i in range(n):
        text = words(rng.randint(60, 200), seed + i, "abcdefghijklmnop")
        kind = i % 3
        if kind == 1:
            text[5 : 5 + rng.randint(1, 3)] = ["awful"] * 2
        if kind == 0:
            text = [w + "$$$" for w in text]
        rows.append(row(i, " ".join(text)))
        known.append((i, int(kind > 0), int(kind == 1)))
    return rows, known


def test_grades(spark):
    rows, known = good_and_bad(450, 3)
    docs = spark.createDataFrame(rows, edge_docs(spark).schema)
    got = grades.grade_documents(docs, labels(spark, known[:300]), carry=["row"]).collect()
    right = [r["kept"] == (r["doc_id"] % 3 == 2) for r in got if r["doc_id"] >= 300]
    assert np.mean(right) > 0.97
    assert all(0 <= r["expected_grade"] <= 2 for r in got)
    again = grades.grade_documents(docs.repartition(3), labels(spark, known[:300])).collect()
    assert {r["doc_id"]: r["tail_probability"] for r in got} == {r["doc_id"]: r["tail_probability"] for r in again}


def test_grades_at_the_edges(spark):
    none = labels(spark, [])
    assert grades.grade_documents(no_docs(spark), none).collect() == []
    unseen = grades.grade_documents(edge_docs(spark), none).collect()
    assert len(unseen) == len(edge_rows()) and {r["tail_probability"] for r in unseen} == {0.0}
    odd = labels(spark, [(7, 1, 0), (7, 0, 0), (None, 1, 0), (9, None, None), (10, 1, None), (77, 1, 0), (14, 1, 0)])
    assert grades.grade_documents(edge_docs(spark), odd).count() == len(edge_rows())


def test_slopes_of_the_fit():
    """The fit's result is a minimum: no single threshold or weight can be moved for the better."""
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, rng.integers(1, 9), replace=False)) for _ in range(600)]
    strength = rng.standard_normal(40) * 2
    score = np.array([strength[r].sum() for r in rows]) + rng.logistic(size=600)
    grade = np.digitize(score, [-2.0, 0.5, 3.0])
    model = grades.fit(rows, grade, decay=0.0)
    assert (np.diff(model.thresholds) > 0).all()

    def loss(weights, thresholds):
        p = grades.Model(weights, thresholds).probabilities(np.array([weights[r].sum() for r in rows]))
        assert np.allclose(p.sum(axis=1), 1)
        return -np.log(p[np.arange(600), grade]).mean()

    best = loss(model.weights, model.thresholds)
    for move in (0.15, -0.15):
        for k in range(3):
            assert loss(model.weights, model.thresholds + move * (np.arange(3) == k)) > best - 1e-5
        for at in np.flatnonzero(model.weights)[:10]:
            assert loss(model.weights + move * (np.arange(len(model.weights)) == at), model.thresholds) > best - 1e-5


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 250
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_ignores_labels_of_the_judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = language.held_out(docs["doc_id"])
    other = docs.withColumn("lang", language.F.when(~kept, docs["lang"]).otherwise("xx")).withColumn("source", language.F.lit("q"))
    a, b = (by_id(language.identify_language(d).collect()) for d in (docs, other))
    assert a == b


def test_language_edges(spark):
    got = {r["doc_id"]: r for r in language.identify_language(edge_docs(spark)).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3)} == {"und"}
    assert got[7]["lang_pred"] == "en"
    assert language.identify_language(no_docs(spark)).collect() == []
    blank = edge_docs(spark).withColumn("lang", language.F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_language(blank).collect()} == {"und"}


#: First letter and number of letters: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari,
#: Bengali, Tamil, Telugu, Thai, Lao, Georgian, Amharic, Khmer, kana, Han, Hangul.
SCRIPTS = [(0x61, 26), (0x3B1, 17), (0x430, 32), (0x561, 38), (0x5D0, 27), (0x628, 19), (0x915, 37), (0x995, 20),
           (0xB95, 1), (0xC15, 20), (0xE01, 46), (0xE94, 4), (0x10D0, 33), (0x1200, 70), (0x1780, 35), (0x3042, 80),
           (0x4E00, 5000), (0xAC00, 11000)]


def made_languages(draw, n_docs):
    """(doc_id, text, lang) of a random vocabulary per script, two of them Latin."""
    rows = []
    for k, (first, n) in enumerate([*SCRIPTS, SCRIPTS[0]]):
        known = [chr(c) for c in range(first, first + max(n, 30)) if chr(c).isalpha()]
        vocabulary = ["".join(draw.choices(known, k=draw.randrange(2, 7))) for _ in range(300)]
        for _ in range(n_docs):
            rows.append((len(rows), "12 " + " ".join(draw.choices(vocabulary, k=60)), f"l{k:02d}"))
    return rows


def test_many_scripts(spark):
    rows = made_languages(random.Random(4), 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    right = Counter()
    tried = Counter()
    for r in language.identify_language(docs).filter("held_out").collect():
        lang = rows[r["doc_id"]][2]
        tried[lang] += 1
        right[lang] += r["lang_pred"] == lang
    assert len(tried) == len(SCRIPTS) + 1
    assert {lang: right[lang] / n for lang, n in tried.items() if right[lang] / n <= 0.97} == {}


def test_languages_are_learned_beside_empty_texts_and_from_any_place(spark):
    draw = random.Random(6)
    by_lang = {lang: ["".join(draw.choices("abcdefghij", k=5)) for _ in range(80)] for lang in ("en", "fr")}
    rows = []
    for i in range(6000):
        lang = "fr" if i % 150 == 0 else "en"
        body = " ".join(draw.choices(by_lang[lang], k=50))
        # Most rows of the rare language are empty, and all texts begin alike.
        rows.append((i, "1 2 3 " * 200 + "same head " * 120 + body, lang))
        rows.append((6000 + i, draw.choice(["", "12 !", None]), "fr"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify_language(docs).collect()}
    seen = [got[i]["lang_pred"] == "fr" for i in range(0, 6000, 150)]
    assert sum(seen) >= 0.9 * len(seen)
    assert got[6001]["lang_pred"] == "und"


def test_predictions_equal_a_plain_parse():
    draw = random.Random(8)
    rows = made_languages(draw, 4)
    samples = {}
    for _, text, lang in rows:
        samples.setdefault(lang, []).append(text)
    model = language.fit(samples)

    def plain(text):
        return "".join(c.lower()[0] if c.isalpha() else " " for c in text)

    def squeezed(text):
        return re.sub(" +", " ", plain(text)).encode()

    joined = {lang: b"".join(squeezed(t) + b" " for t in texts) for lang, texts in samples.items()}

    def bits(text, sample):
        n = at = 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in sample:
                end += 1
            at, n = end, n + 1
        return n * np.log2(len(sample) + 1) / len(text)

    texts = [" ".join(draw.choices(" ".join(t for _, t, _ in draw.sample(rows, 2)).split(), k=30)) for _ in range(40)]
    texts += [None, "", "7 !", "\u0130I \ud800x", "zz"]
    found, scores = language.predict(texts, model)
    for text, lang, score in zip(texts, found, scores, strict=True):
        if not text or not any(map(str.isalpha, text)):
            assert (lang, score) == ("und", 0)
            continue
        want = {x: bits(squeezed(text), sample) for x, sample in joined.items()}
        best = min(sorted(want), key=want.get)
        assert lang == best
        total = sum(2.0 ** (-language.SHARPNESS * (b - want[best])) for b in want.values())
        assert abs(score - 1 / total) < 1e-9


def test_automaton_and_phrases():
    rng = random.Random(2)
    text = [rng.randrange(3) for _ in range(200)]
    table = language.automaton(np.array(text), 4)
    joined = "".join(map(str, text))

    def accepted(s):
        state = 0
        for c in s:
            state = table[state, int(c)]
            if state == language._NONE:
                return False
        return True

    def greedy(s):
        n = at = 0
        while at < len(s):
            size = 1
            while at + size <= len(s) and s[at : at + size] in joined:
                size += 1
            at, n = at + max(1, size - 1), n + 1
        return n

    probes = ["".join(rng.choices("0123", [5, 5, 5, 1], k=rng.randint(1, 40))) for _ in range(200)]
    assert all(accepted(s) == (s in joined) for s in probes)
    probes.sort(key=len, reverse=True)
    pieces = [np.array([int(c) for c in s], np.uint8) for s in probes]
    assert language.phrases(pieces, table).tolist() == [greedy(s) for s in probes]
