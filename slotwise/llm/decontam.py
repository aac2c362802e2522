"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted similarity.

1. A window with similarity ``threshold`` to an item shares shingles of that share of the item's weight. So it holds one of the item's rarest shingles, which
   make up the rest and a little more. Texts are looked up in those alone, so a passage that many items hold brings no candidates, and none is lost.
2. In each text and item so found, windows of the item's size are put where a shared shingle falls on its place, and where one begins.
3. Windows and items get 64-bit weighted SimHashes, cut in ``radius + 1`` blocks. Two fingerprints within ``radius`` agree in
   at least one block; windows that agree in none, or are farther apart, are dropped.
4. The rest is confirmed by the exact weighted Jaccard similarity of their shingle counts.

Words are lowered in A-Z and free of ASCII punctuation. A shingle's weight is ln(1 + items / items that hold it); one that no item holds counts as held by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from slotwise.llm import text_arrays as ta

_BITS = np.arange(64, dtype=np.uint64)


def _words(data: np.ndarray, offsets: np.ndarray) -> ta.Words:
    return ta.words(data, offsets, punctuation=False)


def simhash(shingles: np.ndarray, weights: np.ndarray) -> int:
    """Signed as Spark's long."""
    votes = weights @ np.where((shingles[:, None] >> _BITS) & np.uint64(1), 1.0, -1.0)
    return int(((votes > 0).astype(np.uint64) << _BITS).sum(dtype=np.uint64).astype(np.int64))


def item_shingles(items: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(item_id, size in words, its shingles in order), without items that have no words. An item of fewer words than k has one shingle."""
    kind = items.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in ta.slices(batch, "text"):
                w = _words(data, offsets)
                lists = [ta.run_hash(w.hash[i:j], min(k, j - i)) if j > i else np.zeros(0, np.uint64) for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
                out = pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a), pa.array(np.diff(w.first), pa.int32()), ta.lists([x.view(np.int64) for x in lists], pa.int64())], ["item_id", "size", "shingles"])
                yield out.filter(pa.array(np.diff(w.first) > 0))

    return items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(each, f"item_id {kind}, size int, shingles array<long>")


@dataclass
class _Index:
    """Items of one part of the benchmark: ids, sizes, shingles, their weights, prints; and lookups of their shingles."""

    ids: list
    size: np.ndarray
    shingles: list[np.ndarray]
    weights_of: list[np.ndarray]
    prints: np.ndarray
    shingle: np.ndarray
    weight: np.ndarray
    other: float
    rare: np.ndarray
    holders: np.ndarray
    first: np.ndarray
    filter: np.ndarray
    lengths: list[int]

    def weights(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.shingle, h), len(self.shingle) - 1)
        return np.where(self.shingle[at] == h, self.weight[at], self.other)


def _index(rows: list, n_items: int, holders: dict[int, int], k: int, threshold: float) -> _Index:
    shingles = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
    size = np.array([r["size"] for r in rows], np.int64)
    shingle = np.unique(np.concatenate(shingles))
    weight = np.log1p(n_items / np.array([holders[x] for x in shingle.view(np.int64).tolist()]))
    weights = [weight[np.searchsorted(shingle, s)] for s in shingles]
    rare: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    for n, (s, v) in enumerate(zip(shingles, weights, strict=True)):
        by = np.lexsort((s, -v))
        need = int(np.searchsorted(np.cumsum(v[by]), (1 - threshold) * v.sum() + 1e-9)) + 1
        # all places of a shingle count, so what is left out weighs less than a match must
        own = np.unique(s[by[:need]])
        rare.append(own)
        owner.append(np.full(len(own), n))
    flat, own = np.concatenate(rare), np.concatenate(owner)
    by = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[by], return_index=True)
    bits = np.zeros(1 << 22, bool)
    bits[(keys >> np.uint64(42)).astype(np.int64)] = True
    prints = np.array([simhash(s, v) for s, v in zip(shingles, weights, strict=True)], np.int64).view(np.uint64)
    return _Index([r["item_id"] for r in rows], size, shingles, weights, prints, shingle, weight, float(np.log1p(n_items)), keys, own[by], np.append(first, len(flat)), bits, sorted({min(k, int(x)) for x in size}))


def _candidates(w: ta.Words, ix: _Index) -> tuple[list[tuple[int, int]], dict[int, np.ndarray]]:
    """(row, item number) where the row holds a rare shingle of the item; and the hashes of runs by their length."""
    runs = {m: ta.run_hash(w.hash, m) for m in ix.lengths}
    found: set[tuple[int, int]] = set()
    for m, run in runs.items():
        at = np.flatnonzero(ix.filter[(run >> np.uint64(42)).astype(np.int64)])
        at = at[ta.whole_runs(w, m)[at]] if len(at) else at
        place = np.minimum(np.searchsorted(ix.rare, run[at]), len(ix.rare) - 1)
        hit = ix.rare[place] == run[at]
        for row, p in sorted(set(zip(w.row[at[hit]].tolist(), place[hit].tolist(), strict=True))):
            found.update((row, n) for n in ix.holders[ix.first[p] : ix.first[p + 1]].tolist())
    return sorted(found), runs


def _windows(w: ta.Words, ix: _Index, runs: dict[int, np.ndarray], row: int, item: int, k: int) -> tuple[list[int], list[int]]:
    """First words, within the row, of the windows for an item: those at which a shared shingle falls on its first place in the item; and those that begin with one."""
    size = int(ix.size[item])
    m = min(k, size)
    begin, end = int(w.first[row]), int(w.first[row + 1])
    own = runs[m][begin : end - m + 1]
    known, offset = np.unique(ix.shingles[item], return_index=True)
    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
    at = np.flatnonzero(known[place] == own)
    most = max(end - begin - size, 0)
    return np.unique(np.clip(at - offset[place[at]], 0, most)).tolist(), np.unique(np.minimum(at, most)).tolist()


def _window_shingles(w: ta.Words, runs: dict[int, np.ndarray], row: int, start: int, size: int, k: int) -> np.ndarray:
    a = int(w.first[row]) + start
    b = min(a + size, int(w.first[row + 1]))
    m = min(k, b - a)
    return runs.setdefault(m, ta.run_hash(w.hash, m))[a : b - m + 1]


def _block_masks(radius: int) -> np.ndarray:
    """``radius + 1`` blocks of the 64 bits: two prints within ``radius`` differ in none of the bits of at least one."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return np.array([((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.uint64)


def _confirmed(ix: _Index, item: int, shingles: np.ndarray, weights: np.ndarray, masks: np.ndarray, radius: int) -> float:
    """The exact similarity of a window and an item whose prints agree in a block and lie within the radius; else 0."""
    apart = np.int64(simhash(shingles, weights)).view(np.uint64) ^ ix.prints[item]
    if not np.any((apart & masks) == 0) or int(np.bitwise_count(apart)) > radius:
        return 0.0
    return _similarity(shingles, ix.shingles[item], weights, ix.weights_of[item])


def _similarity(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray) -> float:
    """Weighted Jaccard of two multisets; wa, wb are the weights of their members."""
    x, xi, xn = np.unique(a, return_index=True, return_counts=True)
    y, yi, yn = np.unique(b, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = float((wa[xi][i] * np.minimum(xn[i], yn[j])).sum())
    return both / (float((wa[xi] * xn).sum()) + float((wb[yi] * yn).sum()) - both)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, threshold: float = 0.8, radius: int = 20, part_bytes: int = 64 << 20
) -> DataFrame:
    """Pairs of document and benchmark item with a window of similarity ``threshold`` or more, the best window of each.

    Columns: doc_id, text_hash (xxhash64 of the text), item_id, start_word, n_words (the window's), similarity. Each doc_id and text counts once, so
    repeated rows add nothing; null or empty texts and items have no windows. An item_id with several texts has several items, of which the best counts; repeated
    rows of an item are one. Items are held in the tasks in parts of about ``part_bytes`` (by a hash of the item, 64 bytes a shingle); a larger benchmark is searched part by part, each over all documents, with the same results.
    Weights come from the whole benchmark: with several parts, the windows' shingles are joined to all items' counts. A pair at the threshold is beyond the radius with a chance of about 2e-4.
    """
    spark = docs.sparkSession
    listed = item_shingles(items, item_id_col, item_text_col, k).filter("item_id is not null").dropDuplicates(["item_id", "size", "shingles"])
    n_items, n_shingles = listed.agg(F.count("*"), F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()
    id_kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    if not n_items:
        return spark.createDataFrame([], f"doc_id {id_kind}, text_hash long, item_id {item_kind}, start_word int, n_words int, similarity double")
    holders = listed.select(F.xxhash64("item_id", "shingles").alias("i"), F.explode(F.array_distinct("shingles")).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    n_parts = -(-64 * n_shingles // part_bytes)
    out = None
    for part in range(n_parts):
        own = listed.filter(F.pmod(F.xxhash64("shingles"), F.lit(n_parts)) == part)
        rows = own.collect()  # part_bytes, about
        if not rows:
            continue
        wanted = own.select(F.explode("shingles").alias("shingle")).distinct()
        index = _index(rows, n_items, {r["shingle"]: r["n"] for r in holders.join(wanted, "shingle", "left_semi").collect()}, k, threshold)
        found = _part_leaks(docs, index, id_col, text_col, id_kind, item_kind, k, threshold, radius, holders if n_parts > 1 else None, n_items)
        out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("doc_id", "text_hash", "item_id").orderBy(F.desc("similarity"), "start_word", "n_words")
    return out.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def _part_leaks(docs: DataFrame, index: _Index, id_col: str, text_col: str, id_kind: str, item_kind: str, k: int, threshold: float, radius: int, holders: DataFrame | None, n_items: int) -> DataFrame:
    """``holders``: (shingle, n items that hold it) of the whole benchmark, where the index has only a part of its shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    id_type = to_arrow_type(T._parse_datatype_string(item_kind))
    masks = _block_masks(radius)
    names = ["doc_id", "text_hash", "item_id", "start_word", "n_words", "similarity"]

    def rows_of(batch: pa.RecordBatch, ix: _Index, found: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
        """From (row of the batch, item number, first word, similarity)."""
        keys = [batch.column(c).take(pa.array([f[0] for f in found], pa.int64())) for c in ("doc_id", "text_hash")]
        made = [pa.array([ix.ids[f[1]] for f in found], id_type), pa.array([f[2] for f in found], pa.int32()), pa.array([int(ix.size[f[1]]) for f in found], pa.int32()), pa.array([f[3] for f in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*keys, *made], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for a, _, data, offsets in ta.slices(batch, "text"):
                w = _words(data, offsets)
                pairs, runs = _candidates(w, ix)
                found = []
                for row, item in pairs:
                    best = (0.0, 0)
                    for starts in _windows(w, ix, runs, row, item, k):
                        for start in starts if best[0] < 1 else []:
                            s = _window_shingles(w, runs, row, start, int(ix.size[item]), k)
                            best = max(best, (_confirmed(ix, item, s, ix.weights(s), masks, radius), -start))
                    if best[0] >= threshold - 1e-12:
                        found.append((a + row, item, -best[1], best[0]))
                if found:
                    yield rows_of(batch, ix, found)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for a, _, data, offsets in ta.slices(batch, "text"):
                w = _words(data, offsets)
                pairs, runs = _candidates(w, ix)
                made = [(a + row, item, start, _window_shingles(w, runs, row, start, int(ix.size[item]), k).view(np.int64)) for row, item in pairs for start in sorted(set().union(*_windows(w, ix, runs, row, item, k)))]
                if made:
                    keys = [batch.column(c).take(pa.array([m[0] for m in made])) for c in ("doc_id", "text_hash")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([m[1] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()), ta.lists([m[3] for m in made], pa.int64())], ["doc_id", "text_hash", "item", "start_word", "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            found = []
            for n, (item, start, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item", "start_word", "s")), strict=True)):
                value = _confirmed(ix, item, np.array([x["shingle"] for x in s], np.int64).view(np.uint64), np.array([x["weight"] for x in s]), masks, radius)
                if value >= threshold - 1e-12:
                    found.append((n, item, start, value))
            if found:
                yield rows_of(batch, ix, found)

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    kind = f"doc_id {id_kind}, text_hash long, item_id {item_kind}, start_word int, n_words int, similarity double"
    if holders is None:
        return source.mapInArrow(search, kind)
    window = ["doc_id", "text_hash", "item", "start_word"]
    seen = source.mapInArrow(windows, f"doc_id {id_kind}, text_hash long, item int, start_word int, shingles array<long>")
    weight = F.log1p(F.lit(float(n_items)) / F.coalesce("n", F.lit(1)))
    known = seen.dropDuplicates(window).select(*window, F.posexplode("shingles").alias("at", "shingle")).join(holders, "shingle", "left").withColumn("s", F.struct("at", "shingle", weight.alias("weight")))
    return known.groupBy(*window).agg(F.array_sort(F.collect_list("s")).alias("s")).mapInArrow(confirm, kind)


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` with no window like an item's; their columns as they are, whatever their names. Rows with null or empty texts, and all rows if there are no items, stay."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.struct(*docs.columns).alias("row"))
    bad = find_leaks(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    left = rows.join(bad, (F.col("text_hash") == F.col("bad_hash")) & F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
