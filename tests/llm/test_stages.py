"""Each stage of the pipeline by itself, and very long texts in the operators that the other tests give short ones."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from slotwise.llm import decontam, quality, url_filter
from slotwise.llm.queries import URL_RULES

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, copy int"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    """Labels without rows, and a benchmark of one passage."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words("item", 60)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, 1, "k", 2) for i, t, s in rows], DOCS)


def texts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


def test_quality_stage_keeps_what_is_judged_good(spark, folder):
    good, spam = words(1, 120), "buy now here " * 60
    docs = frame(spark, [(1, good, "a"), (1, good, "a"), (2, "short", "a"), (3, None, "a"), (4, "", None), (5, spam, "a"), (None, good, "b")])
    out = corpus_pipeline.quality_rules(spark, docs, folder)
    assert out.columns == docs.columns and texts(out) == [(-1, good), (1, good), (1, good)]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id for r in quality.judge_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, FOLDER).collect()} == kept and 0 < len(kept) < docs.count()


def test_line_dedup_stage_follows_the_text(spark, folder):
    passage = words(2, 60)
    docs = frame(spark, [(1, f"head\n{passage}", "a"), (2, f"{passage}\nown words", "a"), (3, passage, "a"), (None, passage, "a"), (4, None, "a"), (5, "", "a")])
    out = corpus_pipeline.line_dedup_stage(spark, docs, folder)
    assert out.columns == docs.columns
    assert texts(out) == [(-1, passage), (1, f"head\n{passage}"), (2, "own words"), (4, ""), (5, "")]
    assert {r.doc_id: r.n_chars for r in out.collect()}[2] == len("own words") and {r.doc_id: r.n_chars for r in out.collect()}[4] is None


def test_near_dup_stage_leaves_rows_without_words(spark, folder):
    text = words(3, 80)
    docs = frame(spark, [(2, text, "a"), (1, text + " more", "a"), (1, text + " more", "z"), (3, None, "a"), (3, None, "a"), (None, None, "a"), (None, " ", "a"), (None, text, "a"), (9, words(4, 50), "a")])
    out = corpus_pipeline.near_dup_stage(spark, docs, folder)
    assert out.columns == docs.columns
    assert texts(out) == sorted([(-1, ""), (-1, " "), (1, text + " more"), (3, ""), (3, ""), (9, words(4, 50))])


def test_decontaminate_stage_takes_leaks_only(spark, folder):
    leak = f"{words(5, 200)} {words('item', 60)} {words(6, 200)}"
    docs = frame(spark, [(1, leak, "a"), (1, words(7, 90), "a"), (2, words(8, 90), "a"), (None, leak, "a"), (3, None, "a"), (4, "", "a"), (5, words(9, 40_000) + " " + words("item", 60), "a")])
    out = corpus_pipeline.decontaminate(spark, docs, folder)
    assert out.columns == docs.columns and {i for i, _ in texts(out)} >= {1, 2, 3, 4}
    assert leak not in {t for _, t in texts(out)} and 5 not in {i for i, _ in texts(out)} and (1, words(7, 90)) in texts(out)


def test_mix_stage_copies_whole_rows(spark, folder):
    docs = frame(spark, [(i, words(i, 5), "abc"[i % 3] if i % 4 else None) for i in range(60)]).drop("copy")
    out = corpus_pipeline.mix(spark, docs, folder)
    rows = out.collect()
    assert out.columns == [*docs.columns, "copy"]
    by_id: dict = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by_id.values())
    assert {(r.doc_id, r.text) for r in rows} <= {(r.doc_id, r.text) for r in docs.collect()}


def test_stages_in_order_are_the_run(spark, tmp_path):
    """The run is its stages, one after another; what one takes, none after it sees."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False)) and len(seen[-2]) > 50
    key = lambda df: sorted((r.doc_id, r.text, r.copy) for r in df.select("doc_id", "text", "copy").collect())
    assert key(corpus_pipeline.run(spark, FOLDER)) == key(docs)


def test_very_long_texts(spark, folder):
    long = words(10, 60_000)
    docs = frame(spark, [(1, long, "a"), (2, long[:-6] + "\n" + "x" * 300_000, "a")])
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: (r.n_words, r.base_failed) for r in quality.judge_quality(docs, labels).collect()}
    assert got[1][0] == 60_000 and got[2][0] >= 60_000
    pages = spark.createDataFrame([(1, "http://example.com/en/" + "a" * 500_000), (2, "http://" + "a." * 20_000 + "com/")], "page_id long, url string")
    judged = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES)).collect()}
    assert judged == {1: ("example.com/en/", "block"), 2: ("com/", "allow")}
    leaks = decontam.find_leaks(docs.union(frame(spark, [(3, long + " " + words("item", 60) + " " + long, "a")])), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()
    assert [(r.doc_id, r.start_word) for r in leaks] == [(3, 60_000)]
