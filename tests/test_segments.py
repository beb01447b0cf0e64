"""Segments of a text index against an index written anew from the same documents."""

import random
from pathlib import Path

from tessera.operators import retrieval as rt
from tessera.operators import segments as sg
from tessera.operators import textindex as ti

DOCS = "record_id bigint, revision bigint, scope_id bigint, title string, body string"
QUERIES = ["red", "blue red", "green tea", "tea", "red blue green", "none"]


def frame(spark, texts):
    return spark.createDataFrame([(i, 1, 1, f"t{i}", body) for i, body in texts.items()], DOCS)


def gone(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "record_id bigint")


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def hits(spark, index):
    asked = spark.createDataFrame(list(enumerate(QUERIES)), "query_id bigint, query string")
    return rows(rt.bm25_scores(index, rt.QueryBatch.of(asked)).select("query_id", "record_id", "units"))


def same(spark, index, texts, root):
    """All tables, statistics and answers of ``index`` are those of an index of ``texts``."""
    want = ti.write_index(frame(spark, texts), str(root), buckets=3, spread=2)
    assert rows(index.postings().select(*ti.POSTINGS.names)) == rows(want.postings())
    assert rows(index.doc_stats()) == rows(want.doc_stats())
    assert rows(index.term_stats()) == rows(want.term_stats())
    assert (index.n_docs, index.avgdl) == (want.n_docs, want.avgdl)
    assert hits(spark, index) == hits(spark, want)


def test_refreshes_and_compaction_equal_a_new_index(spark, tmp_path):
    draw = random.Random(5)

    def text():
        return " ".join(draw.choices(["red", "blue", "green", "tea", "x", "."], k=draw.randrange(9)))

    texts = {i: text() for i in range(1, 31)}
    index = sg.write_segments(frame(spark, texts), str(tmp_path / "s"), buckets=3, spread=2)
    for turn in range(3):
        change = {i: text() for i in [*draw.sample(sorted(texts), 4), 31 + turn]}
        out = draw.sample(sorted(set(texts) - set(change)), 2)
        index = sg.refresh_segments(index, frame(spark, change), gone(spark, *out, 999), spread=2)
        texts = {i: t for i, t in {**texts, **change}.items() if i not in out}
    assert len(index.segments) == 4
    same(spark, index, texts, tmp_path / "w1")
    later = sg.compact(index, 1)
    assert later.segments[0] == index.segments[0] and len(later.segments) == 2
    same(spark, later, texts, tmp_path / "w2")
    whole = sg.compact(later)
    assert len(whole.segments) == 1 and whole.sizes == (len(texts),)
    same(spark, whole, texts, tmp_path / "w3")
    assert sg.open_segments(spark, str(tmp_path / "s")) == whole
    assert len(sg.sweep(whole)) == 5
    assert hits(spark, whole)


def test_a_removed_record_returns(spark, tmp_path):
    index = sg.write_segments(frame(spark, {1: "red", 2: "blue"}), str(tmp_path / "s"), buckets=3)
    index = sg.refresh_segments(index, frame(spark, {}), gone(spark, 1, 1))
    same(spark, index, {2: "blue"}, tmp_path / "w1")
    index = sg.refresh_segments(index, frame(spark, {1: "green tea"}), gone(spark, 1))
    same(spark, index, {1: "green tea", 2: "blue"}, tmp_path / "w2")
    same(spark, sg.compact(index, 1), {1: "green tea", 2: "blue"}, tmp_path / "w3")


def test_empty_tables(spark, tmp_path):
    index = sg.write_segments(frame(spark, {}), str(tmp_path / "s"), buckets=3)
    assert (index.n_docs, index.avgdl, index.postings().count()) == (0, 0.0, 0)
    index = sg.refresh_segments(index, frame(spark, {}))
    index = sg.refresh_segments(index, frame(spark, {4: None, 5: "", 6: "red"}))
    same(spark, index, {4: None, 5: "", 6: "red"}, tmp_path / "w")


def test_a_broken_off_refresh_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "s")
    index = sg.write_segments(frame(spark, {1: "red", 2: "blue"}), root, buckets=3)
    change = frame(spark, {2: "tea"})
    # What a writer leaves that is lost before its manifest row, or within it.
    change.select("record_id").write.parquet(f"{root}/segment-lost/ids")
    (tmp_path / "s" / "manifest" / "generation=2" / "_temporary").mkdir(parents=True)
    assert sg.open_segments(spark, root) == index
    again = sg.refresh_segments(index, change)
    # The same refresh, run again from the generation before, counts once.
    once = sg.refresh_segments(index, change)
    same(spark, once, {1: "red", 2: "tea"}, tmp_path / "w")
    assert set(sg.sweep(once)) == {"segment-lost", again.segments[1]}
    assert hits(spark, once)


def test_bytes_written_follow_the_change(spark, tmp_path):
    texts = {i: " ".join(f"w{(i * 7 + j * j) % 4001}" for j in range(300)) for i in range(600)}
    index = sg.write_segments(frame(spark, texts), str(tmp_path / "s"), buckets=3)
    index = sg.refresh_segments(index, frame(spark, {5: "red tea", 6: texts[7]}), gone(spark, 9))

    def size(segment):
        return sum(p.stat().st_size for p in Path(index.root, segment).rglob("*.parquet"))

    assert size(index.segments[1]) < size(index.segments[0]) / 20


def test_tidy(spark, tmp_path, monkeypatch):
    texts = {i: "red" for i in range(20)}
    index = sg.write_segments(frame(spark, texts), str(tmp_path / "s"), buckets=3)
    monkeypatch.setattr(sg, "MOST_SEGMENTS", 2)
    index = sg.refresh_segments(index, frame(spark, {1: "blue"}))
    assert sg.tidy(index) is index
    index = sg.tidy(sg.refresh_segments(index, frame(spark, {2: "blue"})))
    assert index.sizes == (20, 2)
    index = sg.tidy(sg.refresh_segments(index, frame(spark, {i: "tea" for i in range(3, 8)})))
    assert index.sizes == (20,)
    same(spark, index, {**texts, 1: "blue", 2: "blue", **{i: "tea" for i in range(3, 8)}}, tmp_path / "w")


def test_more_ids_than_are_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sg, "BROADCAST_IDS", 0)
    index = sg.write_segments(frame(spark, {1: "red", 2: "blue"}), str(tmp_path / "s"), buckets=3)
    index = sg.refresh_segments(index, frame(spark, {2: "tea"}))
    same(spark, index, {1: "red", 2: "tea"}, tmp_path / "w")


def test_lists_of_terms_are_not_gathered_by_the_number_of_parts(spark, tmp_path):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "6")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        index = sg.write_segments(frame(spark, {i: "red tea" for i in range(90)}), str(tmp_path / "s"), buckets=2)
        index = sg.refresh_segments(index, frame(spark, {i: "tea tea" for i in range(60)}))
        whole = sg.compact(index)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    for segment in (*index.segments, *whole.segments):
        assert len(list(Path(index.root, segment).glob("documents/part=0/*.parquet"))) > 3
    # A record that comes twice has the terms of both rows, whose postings count both.
    twice = frame(spark, {1: "red"}).union(frame(spark, {1: "red tea tea"}))
    held = sg.write_segments(twice, str(tmp_path / "t"), buckets=2).documents().collect()
    assert [(r["record_id"], r["dl"], sorted(r["terms"])) for r in held] == [(1, 4, ["red", "red", "t1", "t1", "tea"])]
