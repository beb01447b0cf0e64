"""URL filters against plain Python: parts, rules, models, limit."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from tessera.llm import urls
from tests.compare import compare, connect
from tests.llm.helpers import by_id

SCHEMA = "page_id bigint, url string, html string, host string, path string, rule string, step string, row string"
RULES = dict((r, v) for v, r in urls.RULES)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return low(host), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_for(host, path):
    fit = []
    for rule in RULES:
        of, tail = rule[: rule.index("/")], rule[rule.index("/") :]
        if ("." + host).endswith("." + of) and path.startswith(tail):
            fit.append(rule)
    return max(fit, key=len, default=None)


def pieces(url, order):
    text = "" if url is None else url.split("://", 1)[-1]
    text = "\x02" * order + text + "\x03"
    return [text[i : i + order + 1] for i in range(len(text) - order)]


class Model:
    def __init__(self, texts, order):
        self.n, self.follow = defaultdict(int), defaultdict(lambda: defaultdict(int))
        for piece in texts:
            for k in range(order + 1):
                tail = piece[len(piece) - k - 1 :]
                self.follow[tail[:-1]][tail[-1]] += 1

    def p(self, piece):
        out = 1 / 1_114_112
        for k in range(len(piece)):
            tail = piece[len(piece) - k - 1 :]
            seen = self.follow.get(tail[:-1])
            if seen:
                out = (seen.get(tail[-1], 0) + len(seen) * out) / (sum(seen.values()) + len(seen))
        return out


def brute(rows, order):
    judged = []
    for page_id, url, *_ in rows:
        host, path = parts(url)
        rule = rule_for(host, path)
        half = None if rule is None else int(hashlib.md5(url.encode()).hexdigest()[0] >= "8")
        judged.append((page_id, url, host, path, rule, RULES.get(rule), half))
    models = {}
    for m in (0, 1, None):
        for verdict in ("allow", "block"):
            models[m, verdict] = Model(
                [p for j in judged if j[5] == verdict and j[6] != m for p in pieces(j[1], order)], order
            )
    steps = []
    for j in judged:
        asked = pieces(j[1], order)
        total = sum(
            round((math.log2(models[j[6], "allow"].p(p)) - math.log2(models[j[6], "block"].p(p))) * 2**20) for p in asked
        )
        steps.append(max(-8192, min(8191, math.floor(total / (len(asked) * 4096)))))
    allow = [s for s, j in zip(steps, judged, strict=True) if j[5] == "allow"]
    block = [s for s, j in zip(steps, judged, strict=True) if j[5] == "block"]
    limit = 0
    if allow and block:
        limit = max(  # the first of equals
            sorted(range(min(allow + block + [0]), max(allow + block + [0]) + 1), key=lambda t: (abs(t), t)),
            key=lambda t: sum(a >= t for a in allow) * len(block) + sum(b < t for b in block) * len(allow),
        )
    return [
        (j[0], j[2], j[3], j[4], j[5] or ("allow" if s >= limit else "block"), s)
        for s, j in zip(steps, judged, strict=True)
    ]


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        host = rng.choice(["a.Example.net", "news.example.com", "www.example.org", "example.net", "net", "pills.buy.com"])
        tail = rng.choice(["/en/", "/de/", "/fr/", "/es/", "", "/EN/", "/en"])
        out.append((i, f"http://{host}{tail}{rng.randrange(50)}{rng.choice(['', '?q=1', '#x', '/?a#b'])}", *[None] * 6))
    return out


ODD = [
    (1, None),
    (2, ""),
    (3, "no scheme/en/"),
    (4, "://"),
    (5, "http://"),
    (6, "http://net"),
    (7, "http://net/"),
    (8, "http://planet/x"),
    (9, "HTTP://WWW.EXAMPLE.NET/en/A?b://c"),
    (9, "HTTP://WWW.EXAMPLE.NET/en/A?b://c"),
    (9, "http://other.example.com/de/1"),
    (None, "http://example.com/de/ü\U0001f600\n\x02\x03x"),
    (10, "http://example.com?x/de/"),
    (11, "http://example.com#/de/"),
    (12, "http://user:pw@Example.ORG:80/fr/"),
    (13, "http://example.org/fr/" + "y" * 20_000),
    (14, "http://EXAMPLE.İorg/fr/"),
    (15, "http://a.org/fr/x\ny?z"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * (8 - len(r))) for r in rows], SCHEMA)


@pytest.mark.parametrize("order", [0, 2, urls.ORDER])
def test_against_brute_force(spark, order):
    rows = made(300, order) + ODD
    got = urls.filter_urls(frame(spark, rows), order=order)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "step"]
    assert by_id(got.collect()) == by_id(brute(rows, order))


def test_hot_url_and_shuffled_ratios(spark, monkeypatch):
    rows = made(60, 5) + [(7, "http://x.example.com/es/1")] * 40
    want = by_id(brute(rows, urls.ORDER))
    assert by_id(urls.filter_urls(frame(spark, rows)).collect()) == want
    monkeypatch.setattr(urls, "SMALL_RATIOS", 3)
    assert by_id(urls.filter_urls(frame(spark, rows)).collect()) == want


@pytest.mark.parametrize("rows", [[], ODD[:5], [(1, "http://a.net/")], [(1, "http://a.org/fr/"), (2, "http://b.com/")]])
def test_few_rows(spark, rows):
    assert by_id(urls.filter_urls(frame(spark, rows)).collect()) == by_id(brute(rows, urls.ORDER))


def test_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    scored = urls.filter_urls(pages)
    plan = scored._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_rules_decide_and_models_learn(spark):
    """Texts of their own for both sides: the models tell unruled URLs apart."""
    rng = random.Random(1)
    rows = []
    for i in range(400):
        good = i % 2 == 0
        name = rng.choice(["garden", "library", "school"] if good else ["casino", "pills", "xxxbet"])
        host = rng.choice(["example.org" if good else "some.net", "unknown.com"])
        rows.append((i, f"http://{host}/{'fr/' if good and host == 'example.org' else ''}{name}/{rng.randrange(9999)}"))
    got = {r["page_id"]: r for r in urls.filter_urls(frame(spark, rows)).collect()}
    unruled = [i for i in got if got[i]["rule"] is None]
    right = sum((got[i]["verdict"] == "allow") == (i % 2 == 0) for i in unruled)
    assert len(unruled) > 100 and right >= 0.97 * len(unruled)


def test_statement(spark):
    sf = "/root/testdata/sf0.01"
    from tessera.llm.queries import ORACLES, QUERIES

    name = "op13_url_filters"
    df = QUERIES[name](spark, sf)
    assert df.groupBy("verdict").count().count() == 2 and not df.filter("rule is null").isEmpty()
    assert compare(df, connect(sf), ORACLES[name]) is None
