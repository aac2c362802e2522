"""Odd inputs (nulls, empty and long texts, repeated rows, empty tables, clashing columns) and brute-force twins."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm import decontam, html_extract, lang_id, line_dedup, lm_score, mixing, near_dup, quality, queries, url_filter
from slotwise.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy int, n_words int"
_rng = random.Random(4)
WORDS = [f"w{i}" for i in range(400)]


def words(n):
    return " ".join(_rng.choice(WORDS) for _ in range(n))


BASE = words(120)
LONG = words(30_000)
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE.replace(" ", "  ", 1).upper().replace("W", "w"), "en", "b", 1), (4, BASE + " extra tail words", "en", "b", 1),
    (5, None, None, None, None), (6, "", "en", "a", 0), (7, "   \n\n ", "en", "a", 4), (8, "one two", "de", "a", 7), (9, "One two", "de", None, 7), (None, words(80), "de", "a", 1), (10, LONG, "de", "a", 1), (11, words(60) + "\n" + words(60), "de", "b", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 7) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    by_id = {g[0]: g for g in got}
    assert [by_id[i][2] for i in (1, 2, 3, 4, 8, 9)] == [1, 1, 1, 1, 8, 8]
    assert by_id[5] == (5, 0, 5, True) and by_id[6] == (6, 0, 6, True) and by_id[8][1] == 1
    assert near_dup.near_duplicates(docs).count() == len(ROWS) and near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 6])):
            own[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(own)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    root = list(range(150))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(150):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rounds=0, block=16)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in range(150)}


def test_quality_counts_and_rules(spark, docs, none):
    rows = {r.doc_id: r for r in quality.with_counts(docs.filter("doc_id is not null")).collect()}
    assert (rows[5].n_words, rows[6].n_words, rows[8].word_chars, rows[10].n_words) == (0, 0, 6, 30_000)
    text = "é a\n#a b\né a\n\n" + "x y z " * 3
    one = quality.with_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (one.n_words, one.n_symbols, one.n_dup_lines, one.n_repeat_words) == (15, 1, 1, 9)
    many = spark.createDataFrame([(i, words(60) + (" #$%" * 40 if i % 4 == 0 else "")) for i in range(400)], "doc_id long, text string")
    labels = many.select("doc_id", (F.col("doc_id") % 4 != 0).cast("int").alias("quality"), F.lit(None).alias("toxic"))
    judged = quality.judge_quality(many, labels).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in judged)
    assert quality.keep_good(none, labels).count() == 0 and quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_url_rules(spark):
    urls = ["https://www.Example.com/en/x?q", "http://example.com/en/", "https://a.example.com/fr/", "https://x.net/es/1", "http://net/fr/a#b", "nothing", None, "", "https://www.example.com?x", "a://b.com/c://d.net/es/", "https://www.Example.com/en/x?q", "http://notexample.com/en/", "http://" + "a." * 500 + "net/es/"]
    got = url_filter.judge_urls(spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string"), url_filter.rule_table(spark, URL_RULES))
    for r in got.collect():
        m = re.search(r"://([^/?#]*)([^?#]*)", r.url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    nested = url_filter.rule_table(spark, [("com", "", "block"), ("com", "/a", "allow"), ("com", "/ab/", "block"), ("com", "/a", "block")])
    pages = spark.createDataFrame([("http://x.com/abc",), ("http://x.com/ab/c",), ("http://x.com/b",), ("http://x.com",)], "url string")
    assert [r.rule for r in url_filter.judge_urls(pages, nested).orderBy("url").collect()] == ["com", "com/ab/", "com/a", "com"]
    assert url_filter.judge_urls(pages.limit(0), nested).count() == 0


def test_mixing(docs, none):
    mixed = mixing.mix_sources(docs, weights={"a": 3.0, "b": 1.0}, seed=2)
    assert mixed.columns == [*[c for c in docs.columns if c != "copy"], "copy"] and mixed.filter("source is null").count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix_sources(docs.repartition(3), weights={"a": 3.0, "b": 1.0}, seed=2).collect()))
    assert mixing.mix_sources(none).count() == 0
    joined = mixing.mix_sources(docs, weights={"a": 3.0, "b": 1.0}, seed=2, broadcast_bytes=0)
    assert sorted(map(str, joined.collect())) == sorted(map(str, mixed.collect()))
    clash = docs.select("doc_id", "text", "source", *[F.lit(1).alias(c) for c in ("row", "of", "key", "u", "rate", "cdf", "least", "at", "n", "text_hash")])
    assert mixing.mix_sources(clash).columns == [*clash.columns, "copy"]
    many = docs.sparkSession.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("source"))
    share = {r["source"]: r["count"] for r in mixing.mix_sources(many, weights={"x": 1, "y": 1}).groupBy("source").count().collect()}
    assert abs(share["x"] - 2000) < 200 and abs(share["y"] - 2000) < 200


def test_mixing_order_is_random_and_fixed(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.lit("x").alias("source"))
    rows = rows.union(rows.filter("doc_id < 500").withColumn("text", F.lit("other")))  # two texts of one id
    once, again = ([(r.doc_id, r.text, r.copy) for r in mixing.mix_sources(d).collect()] for d in (rows, rows.repartition(5)))
    assert once == again
    ids = [i for i, _, _ in once]
    ups = sum(a < b for a, b in zip(ids[:-1], ids[1:], strict=True)) / len(ids)
    assert 0.45 < ups < 0.55 and abs(sum(ids[: len(ids) // 2]) / (len(ids) // 2) - sum(ids) / len(ids)) < 60


def test_decontamination(spark, docs, none):
    item = words(30)
    items = spark.createDataFrame([(1, item), (2, "just three words"), (3, None), (4, ""), (None, "x")], "item_id long, text string")
    rows = [(1, words(50) + " " + item.upper().replace("W", "w") + " " + words(50)), (2, words(100)), (3, " ".join(item.split()[:29]) + " other"), (4, "it is just three words long"), (5, item.replace(" ", ", ")), (6, item.split()[0]), (7, None), (1, words(9))]
    found = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 1), (3, 1), (4, 2), (5, 1)}
    parts = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items, part_bytes=2000)
    assert sorted(map(str, parts.collect())) == sorted(map(str, found.collect()))
    assert decontam.drop_leaks(docs, items).count() == len(ROWS) and decontam.drop_leaks(none, items).count() == 0 and decontam.drop_leaks(docs, items.limit(0)).count() == len(ROWS)


def test_line_dedup(spark, docs, none):
    p, q = words(12), words(30)
    rows = [(1, f"alpha\n{p}\n{q}"), (2, f"{q}\nbeta\n{p}\n{p}"), (3, "alpha\nbeta"), (4, f"  {p} "), (5, None), (None, p), (2, f"{q}\nbeta\n{p}\n{p}")]
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, rows[0][1], 0), (2, "beta", 3), (2, "beta", 3), (3, "alpha\nbeta", 0), (4, "", 1), (5, None, 0), (None, p, 0)], key=str)
    assert line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.aligned_blocks([(0, 5, 1), (1, 6, 1), (2, 0, 2), (7, 8, 1), (9, 8, 1)]) == ([(0, 2)], [(2, 4), (7, 8), (9, 10)])


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><a>Home</a></nav><div class='cookie-banner'><p>We use cookies on this site</p></div><article><h1>Big &amp; small</h1><p>One\n two<br>three <b>four<p>" + "word " * 40 + "</p><div id=comments><p>nice one</p></div></article><script>var a = '</p>'</script><footer>&copy; us</footer>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<a =\"" * 20000, "x")]
    got = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = "Big & small\n\nOne two three four\n\n" + ("word " * 40).strip()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "", 0)]


def test_language(spark, none):
    rng = random.Random(2)
    kinds = {"aa": "lorana melo tira", "bb": "šćek žrvul đok"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(40)), k) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa"), (901, "12 34", "aa"), (None, "lorana melo", None), (902, "lorana " * 5000, "aa")]
    got = lang_id.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=80).collect()
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(got) == len(rows) and sum(r.lang_pred == ("aa", "bb")[r.doc_id % 2] for r in held if r.doc_id < 300) >= 0.9 * len([r for r in held if r.doc_id < 300])
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (900, 901)} == {("und", 0.0)}
    assert lang_id.identify_languages(none).count() == 0


def test_language_gradient():
    import numpy as np

    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in lang_id._new_net(3, 2, rng).items()}
    codes, labels = rng.integers(0, 256, (5, 4)), np.array([0, 1, 1, 0])

    def loss(n):
        both = np.concatenate([lang_id._run(n, d, codes, False)[0] for d in "fb"], axis=2)
        return -np.log(lang_id._probabilities(n, both)[:, np.arange(4), labels]).mean()

    grad = lang_id._gradients(net, codes, labels)
    for k, at in (("gf", (0, 1)), ("cb", (1, 2)), ("o", (2, 1)), ("xf", (codes[0, 0], 4))):
        up, down = ({n: v.copy() for n, v in net.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert grad[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, abs=2e-3)


def test_lm_scores(docs, none):
    got = lm_score.score_documents(docs, order=2, chunk_bytes=40_000).collect()
    assert len(got) == len(ROWS) and {r.score for r in got if r.doc_id in (5, 6, 7)} == {None}
    assert all(r.known == r.n_words - 1 for r in got if r.doc_id == 2)
    trigram = {r.doc_id: r for r in lm_score.score_documents(docs, order=3).collect()}
    assert trigram[4].known > 100 and lm_score.score_documents(none).count() == 0


def test_pipeline(spark, docs, tmp_path):
    docs.drop("copy", "n_words").withColumn("text", F.concat_ws(" ", "text", F.lit(words(60)))).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "copy"}
    assert not out.filter("doc_id in (2, 3)").count()


def test_line_dedup_inside_longer_lines(spark):
    passage, head, tail = words(80), words(40), words(40)
    rows = [(1, passage), (2, f"x\n{head} {passage} {tail}\ny"), (3, f"{tail[::-1]}\n{words(30)}")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = got[2][0].split()
    assert got[1] == (passage, 0) and got[3] == (rows[2][1], 0) and got[2][1] == 1
    assert left[:41] == ["x", *head.split()] and left[-41:] == [*tail.split(), "y"] and len(left) <= 82 + 40


def test_line_dedup_of_frequent_short_lines(spark):
    lines = [words(8) for _ in range(10)]
    rows = [(i, "\n".join([lines[i], words(20)])) for i in range(10)]  # each line alone in an earlier document
    rows += [(i, "\n".join([words(9), *lines, words(9)])) for i in range(10, 80)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (rows[i][1], 0) for i in range(11))
    assert all(got[i] == ("\n".join(rows[i][1].split("\n")[:: 11]), 10) for i in range(11, 80))


def test_lm_query_counts_three_words(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x b c"), (4, "a b c")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op6_lm_score(spark, str(tmp_path)).collect()}
    assert [got[i].known for i in (1, 2, 3, 4)] == [1, 0, 0, 1]  # only "a b c" is elsewhere as a whole


def test_mixing_at_large_rates(spark):
    few = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("x").alias("source"))
    many = spark.range(40, 60_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("y").alias("source"))
    for share, rate in ((2 / 5, 600), (2 / 3, 1000)):
        mixed = mixing.mix_sources(few.union(many), weights={"x": share, "y": 1 - share}).filter("source = 'x'")
        counts = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
        assert len(counts) == 40 and len(set(counts)) > 20
        assert abs(sum(counts) / 40 - rate) < 5 * (rate / 40) ** 0.5 and 0.5 * rate < sum((c - rate) ** 2 for c in counts) / 40 < 2 * rate


def test_near_dup_stage_keeps_one_row_of_each_group(spark):
    a, b, c, d = (words(60) for _ in range(4))
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "x"), (2, b, "x"), (None, c, "x"), (None, c, "x"), (None, c + " tail", "x"), (3, d, "x"), (None, d, "x"), (5, "", "x"), (5, "", "x"), (None, None, "x"), (None, None, "x")]
    left = corpus_pipeline.near_dup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.text and "tail" not in r.text and r.text != c) == sorted([("1", a), ("2", b), ("3", d)])
    assert sum(r.text in (c, c + " tail") for r in left) == 1 and sum(not r.text for r in left) == 4


def test_decontamination_in_parts_of_items_that_share_text(spark):
    own, shared = [words(20) for _ in range(24)], [words(12) for _ in range(12)]
    items = spark.createDataFrame([(i, f"{t} {shared[i // 2]}") for i, t in enumerate(own)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{words(9)} {t} {shared[(i // 2 + 5) % 12]} {words(9)}") for i, t in enumerate(own)], "doc_id long, text string")
    whole, parts = ({(r.doc_id, r.item_id, r.start_word, round(r.similarity, 9)) for r in decontam.find_leaks(docs, items, threshold=0.2, radius=31, part_bytes=n).collect()} for n in (1 << 26, 10_000))
    assert whole and parts == whole


def test_rates_take_linear_time(spark):
    """A row beside very many: a rate of a million, whose counts lie about it; and the distribution against the exact one."""
    import math
    import time

    from slotwise.llm import mixing

    began = time.perf_counter()
    least, cdf = mixing._distribution(1e6)
    assert time.perf_counter() - began < 5
    middle = cdf[1_000_000 - least]
    assert abs(middle - 0.5) < 1e-3 and cdf[-1] == 1.0 and 1e-30 < cdf[0] < 1e-20 or cdf[0] < 1e-20
    for rate in (0.3, 4.0, 499.0, 501.0, 800.0):
        least, cdf = mixing._distribution(rate)
        total = 0.0
        for k in range(least + len(cdf)):
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            if k >= least:
                assert abs(cdf[k - least] - total) < 1e-9
    docs = spark.createDataFrame([(1, "x", "big"), (2, "y", "small")], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, weights={"big": 1.0, "small": 1e-7}).groupBy("source").count().collect()
    assert {r.source for r in got} <= {"big", "small"}
