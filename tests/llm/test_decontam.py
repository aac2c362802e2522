"""Decontamination against all windows of all documents, and the SimHash radius."""

from __future__ import annotations

import random
from collections import Counter
from math import log1p

import numpy as np

from slotwise.llm import decontam
from slotwise.llm import text_arrays as ta

K = 5


def shingles(words):
    return [" ".join(words[i : i + min(K, len(words))]) for i in range(len(words) - min(K, len(words)) + 1)]


def brute(docs, items, threshold):
    """{(doc, item): best similarity} over every window of the item's size."""
    lists = {i: shingles(t.split()) for i, t in items}
    holders = Counter(s for x in lists.values() for s in set(x))
    weight = lambda s: log1p(len(items) / holders.get(s, 1))
    out = {}
    for d, text in docs:
        words = text.split()
        for i, own in lists.items():
            size = len(dict(items)[i].split())
            best = 0.0
            for a in range(max(len(words) - size, 0) + 1):
                x, y = Counter(shingles(words[a : a + size])) if words else Counter(), Counter(own)
                both = sum(weight(s) * min(n, y[s]) for s, n in x.items())
                every = sum(weight(s) * n for s, n in x.items()) + sum(weight(s) * n for s, n in y.items()) - both
                best = max(best, both / every)
            if best >= threshold:
                out[d, i] = best
    return out


def test_same_as_all_windows(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common = words(8)  # stands in many items
    items = [(i, " ".join(words(rng.choice([20, 30, 45])) + (common if i % 2 else []))) for i in range(20)] + [(20, "just three words"), (21, "again again again again again again again")]
    docs = []
    for d in range(120):
        own = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(own))
            own[at : at + rng.choice([0, 1])] = words(rng.choice([0, 1]))
        cut = rng.choice([0, 0, 0, 3])
        docs.append((d, " ".join(words(rng.randrange(40)) + own[cut:] + (common if d % 3 else []) + words(rng.randrange(40)))))
    want = brute(docs, items, 0.8)
    tables = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([*items, items[3]], "item_id long, text string")
    for bytes_held in (1 << 26, 20_000):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontam.find_leaks(*tables, part_bytes=bytes_held).collect()}
        assert len(want) > 60 and got.keys() <= want.keys() and len(got) >= 0.97 * len(want)
        assert sum(abs(got[p] - want[p]) < 1e-9 for p in got) >= 0.97 * len(got)


def test_radius_holds_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    far = []
    for _ in range(2000):
        item = rng.integers(0, 2**63, 90, dtype=np.uint64)
        window = item.copy()
        window[rng.choice(90, 10, replace=False)] = rng.integers(0, 2**63, 10, dtype=np.uint64)  # 80 of 100 in common
        a, b = (np.int64(decontam.simhash(x, np.ones(90))).view(np.uint64) for x in (item, window))
        far.append(int(np.bitwise_count(a ^ b)))
    assert np.mean(np.array(far) <= 20) > 0.995
    masks = decontam._block_masks(20)
    assert len(masks) == 21 and int(masks.sum()) == 2**64 - 1
    for _ in range(200):
        bits = sum(1 << int(b) for b in rng.choice(64, 20, replace=False))
        assert np.any((np.uint64(bits) & masks) == 0)  # within the radius, a block agrees


def test_two_texts_of_an_item_and_clashes(spark):
    item, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(25))
    items = spark.createDataFrame([(1, item), (1, other), (1, item), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {other} y", 0), (2, f"{item} {other}", 0), (2, f"{item} {other}", 0), (None, item, 0), (3, "", 0), (4, None, 0)], "doc_id long, text string, text_hash int")
    found = {(r.doc_id, r.item_id, r.start_word, r.n_words, round(r.similarity, 6)) for r in decontam.find_leaks(docs, items).collect()}
    assert found == {(1, 1, 1, 25, 1.0), (2, 1, 0, 30, 1.0), (None, 1, 0, 30, 1.0)}
    left = decontam.drop_leaks(docs.withColumnsRenamed({"text_hash": "bad_hash"}), items)
    assert left.columns == ["doc_id", "text", "bad_hash"] and sorted(r.doc_id for r in left.collect()) == [3, 4]
    assert ta.SLICE_BYTES  # texts longer than a slice are one slice
