"""Scores, counts, pooling and components against plain Python."""

from __future__ import annotations

import os
import random
import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import lang_id, lm_score, mixing, quality, url_filter

_rng = random.Random(11)


def words(n, kinds=60):
    return " ".join(_rng.choice([f"w{i}" for i in range(kinds)]) for _ in range(n))


def scores(docs, order, backoff=0.4):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for _, t in docs]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in texts]
    every = sum(grams, Counter())
    total = sum(map(len, texts))
    out = []
    for w, own in zip(texts, grams, strict=True):
        rest = lambda g: every[g] - own[g]  # noqa: B023, E731
        sums, known = 0.0, 0
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    sums += log(max(rest(g), 0.5) / max(total - len(w), 1)) + (order - 1) * log(backoff)
                    known += order == 1 and rest(g) > 0
                    break
                if rest(g) > 0:
                    sums += log(rest(g) / rest(g[:-1])) + (order - n) * log(backoff)
                    known += n == order
                    break
        out.append((len(w), known, sums / len(w) if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores(spark, order):
    docs = [(i, words(_rng.choice([0, 1, 2, 3, 20, 80]))) for i in range(60)] + [(60, None), (61, words(30) * 2), (None, words(9)), (1, "A b C d")]
    got = sorted(lm_score.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order, chunk_bytes=1000).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.n_words))
    want = [(i, *s) for (i, _), s in sorted(zip(docs, scores(docs, order), strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[1][0]))]
    assert [(r.doc_id, r.n_words, r.known) for r in got] == [w[:3] for w in want]
    assert all((r.score is None) == (w[3] is None) and (r.score is None or abs(r.score - w[3]) < 1e-9) for r, w in zip(got, want, strict=True))


def test_packed_values():
    rng = np.random.default_rng(5)
    for values in ([], [0], [2**64 - 1], [1] * 5, rng.integers(0, 2**64, 300, dtype=np.uint64), rng.integers(1, 4, 5000), rng.integers(0, 2**44, 5000)):
        values = np.asarray(values, np.uint64)
        assert (lm_score._unpack(lm_score._pack(values), len(values)) == values).all()


def test_lm_counts_are_looked_up_in_the_order_of_hashes(monkeypatch):
    """A search at random in a chunk's millions of n-grams misses the cache at nearly every step."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefgh"), rng.integers(0, 30))) for _ in range(200)]
    (w,) = lm_score._chunk_words(pa.array(texts))
    grams, counts, _ = lm_score._chunk_table([(w.hash, w.row)], 3, 1)
    asked = []
    search = np.searchsorted
    monkeypatch.setattr(lm_score.np, "searchsorted", lambda a, v: asked.append(v) or search(a, v))
    split = [t.split() for t in texts]
    for n in (1, 2, 3):
        rows = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in split]
        every = sum(rows, Counter())
        expected = [every[g] - own[g] if len(g) == n else -1 for x, own in zip(split, rows, strict=True) for i in range(len(x)) for g in [tuple(x[max(0, i - n + 1) : i + 1])]]
        assert lm_score._rest(w, n, grams, counts).tolist() == expected
    assert len(asked) == 3 and all((v[1:] >= v[:-1]).all() for v in asked)


def test_quality_counts(spark):
    alphabet = ["a", "b ", "#", "é", "\n", "\n\n", "|x", " ", "\t", "word ", "word word ", "\x0b", "日本 "]
    texts = ["".join(_rng.choice(alphabet) for _ in range(_rng.randrange(120))) for _ in range(200)] + ["", None]
    got = {r.doc_id: r for r in quality.with_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        t = text or ""
        own = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(own[j : j + 3]) for j in range(len(own) - 2))
        repeated = {j + k for j in range(len(own) - 2) if windows[tuple(own[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got[i][c] for c in quality.COUNTS) == want, repr(text)


def test_quality_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, words(80, 400), i, i, i) for i in range(20)], "doc_id long, text string, n_words int, _n_words int, row int")
    kept = quality.keep_good(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_urls_of_a_hot_host(spark):
    urls = [(i, f"http://a{i % 3}.example.com/{('en', 'fr')[i % 2]}/{i}") for i in range(300)] + [(i, f"http://x.net/es/{i % 50}") for i in range(300, 420)]
    rules = url_filter.rule_table(spark, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/1", "block")])
    one, many = (sorted(map(tuple, url_filter.judge_urls(spark.createDataFrame(urls, "row long, url string"), rules, parts=n).collect())) for n in (1, 60))
    assert one == many and len(one) == 420 and sum(r[5 - 1] is not None for r in one) == 300 + sum(1 for _, u in urls if "/es/1" in u)


def test_language_pooling():
    """Each position's probability by a plain loop over the bytes of its window."""
    rng = np.random.default_rng(1)
    net = lang_id._new_net(4, 3, rng)
    texts = [b"", b"a", bytes(rng.integers(0, 256, 500, dtype=np.uint8)), b"hello world"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = lang_id.pooled(net, data, np.cumsum([0, *map(len, texts)]))

    def states(d, codes):
        h, out = np.zeros(4), []
        for c in codes if d == "f" else codes[::-1]:
            gates = np.clip((h @ net[f"g{d}"] + net[f"x{d}"][c, :8]) / 4 + 0.5, 0, 1)
            h = h + gates[:4] * (np.clip((gates[4:] * h) @ net[f"c{d}"] + net[f"x{d}"][c, 8:], -1, 1) - h)
            out.append(h)
        return out if d == "f" else out[::-1]

    for text, p in zip(texts, got, strict=True):
        sums = np.zeros(3)
        for a in range(0, len(text), lang_id.SPAN):
            codes = list(text[a : a + lang_id.SPAN])
            for f, b in zip(states("f", codes), states("b", codes), strict=True):
                s = np.concatenate([f, b]) @ net["o"] + net["ob"]
                sums += np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert p == pytest.approx(sums / max(len(text), 1), abs=1e-3)


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_url_filter", "op4_near_dup"])
def test_sql_twins(spark, name):
    import duckdb

    from slotwise.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("needs the test tables")
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = db.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, folder)
    order = sorted(got.columns)
    assert order == sorted(want.columns) and mixing
    index = [want.columns.index(c) for c in order]
    assert sorted(str([r[c] for c in order]) for r in got.collect()) == sorted(str([r[i] for i in index]) for r in want.fetchall())
