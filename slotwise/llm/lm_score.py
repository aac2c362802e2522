"""Stupid-backoff scores from n-gram counts of the whole corpus.

1. Documents are dealt to chunks by a hash. A chunk's n-grams, each once with its count, go to count tables partitioned by the
   hash of the n-gram: one packed row for each chunk and partition, so a very common n-gram is one entry a chunk. (One row for each n-gram of a document would
   be the plain relational form; with n-grams of three words it takes several times the disk.) A partition is a range of hashes, so a row is
   the gaps between its sorted hashes, which need two bytes less each than the hashes.
2. Each count table adds up its entries and answers every chunk with the corpus counts of that chunk's n-grams.
3. Chunks join their answers to their documents and sum the scores.

A document's own occurrences are taken off the counts, else every n-gram would be known: the score tells how
well the rest of the corpus predicts the document.
"""

from __future__ import annotations

import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import text_arrays as ta


def _rest(w: ta.Words, n: int, grams: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Of the run of n words that ends at each word, its occurrences in other rows (``corpus`` counts those of the sorted ``grams``); -1 where its row is too short.

    Runs are taken in the order of their hashes, so a row's own occurrences lie together, and the table of the whole chunk is read from front to back, not at random.
    """
    out = np.full(len(w.hash), -1, np.int64)
    at = np.flatnonzero(ta.whole_runs(w, n))
    if len(at):
        h = ta.run_hash(w.hash, n)[at]
        by = np.argsort(h, kind="stable")
        at, h = at[by], h[by]
        row = w.row[at]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
        own = np.diff(first, append=len(at))
        out[at + n - 1] = np.repeat(corpus[np.searchsorted(grams, h[first])] - own, own)
    return out


def _pack(values: np.ndarray) -> list[bytes]:
    """The eight byte planes of 64-bit values, lowest first; each deflated where that makes it shorter."""
    out = []
    for plane in values.astype("<u8").view(np.uint8).reshape(-1, 8).T:
        raw = plane.tobytes()
        deflate = zlib.compressobj(strategy=zlib.Z_RLE)
        short = deflate.compress(raw) + deflate.flush()
        out.append(short if len(short) < len(raw) else raw)
    return out


def _unpack(planes: list[bytes], n: int) -> np.ndarray:
    """The n values that ``_pack`` packed."""
    out = np.empty((n, 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = np.frombuffer(plane if len(plane) == n else zlib.decompress(plane), np.uint8)
    return out.view("<u8").reshape(-1)


def _chunk_table(columns: list[tuple[np.ndarray, np.ndarray]], order: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct n-gram hashes of a chunk in order; their counts; the partitions' bounds (a partition is a range of hashes)."""
    every = np.concatenate([ta.run_hash(h, n)[np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])] for h, row in columns for n in range(1, order + 1) if len(h) >= n] or [np.zeros(0, np.uint64)])
    every.sort()
    new = np.ones(len(every), bool)
    np.not_equal(every[1:], every[:-1], out=new[1:])
    first = np.flatnonzero(new)
    grams, counts = every[first], np.diff(first, append=len(every))
    part = ((grams >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    return grams, counts, np.searchsorted(part, np.arange(parts + 1))


def _chunk_words(texts: pa.ChunkedArray | pa.Array) -> list[ta.Words]:
    """Words of a chunk's rows, slice by slice, without their places."""
    none = np.zeros(0, np.int64)
    arrays = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    return [replace(ta.words(data, offsets), start=none, end=none) for x in arrays for _, _, data, offsets in ta.slices(pa.RecordBatch.from_arrays([x], ["text"]), "text")]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, backoff: float = 0.4, chunk_bytes: int = 12 << 20) -> DataFrame:
    """Per row: id, ``n_words``, ``known`` (words whose full n-gram the rest of the corpus has) and ``score``.

    ``score`` is the mean over words of ln S, S(w | context) = count(context, w) / count(context) for the longest context (up to ``order - 1`` words) at which the
    rest of the corpus has the n-gram, times ``backoff`` for each word of context given up; a word that the rest of the corpus lacks has a count of one half. The corpus is all words of
    all rows (A-Z lowered), less the document's own; copies in other rows count. The score is null for a text without words (or null).
    Chunks of documents take about ``chunk_bytes`` of text (less where that leaves shuffle partitions idle), counted from the table; there are as many count tables as chunks.
    Rows that repeat id and text fall in one chunk, so very many equal rows make one large chunk. Counts have 64 bits. Texts are read whole; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    size, n_all = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)), F.coalesce(F.sum(n_words), F.lit(0))).first()
    chunks = parts = max(1, -(-size // chunk_bytes), min(tasks, -(-size // (1 << 20))))
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(chunks)).cast("int").alias("chunk"))

    def count(table: pa.Table) -> pa.Table:
        words = _chunk_words(table["text"])
        grams, counts, bounds = _chunk_table([(w.hash, w.row) for w in words], order, parts)
        chunk = table["chunk"][0].as_py()
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in rows], pa.int32()),
                "chunk": pa.array([chunk] * len(rows), pa.int32()),
                "n": pa.array([b - a for _, a, b in rows], pa.int64()),
                "gaps": pa.array([_pack(np.diff(grams[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.list_(pa.binary())),
                "counts": pa.array([_pack(counts[a:b]) for _, a, b in rows], pa.list_(pa.binary())),
            }
        )

    def add(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        grams = np.concatenate([np.cumsum(_unpack(x.as_py(), n), dtype=np.uint64) for x, n in zip(table["gaps"], sizes, strict=True)])
        counts = np.concatenate([_unpack(x.as_py(), n) for x, n in zip(table["counts"], sizes, strict=True)])
        by = np.argsort(grams, kind="stable")
        first = np.flatnonzero(np.diff(grams[by], prepend=~grams[by[:1]]))
        corpus = np.empty(len(grams), np.uint64)
        corpus[by] = np.repeat(np.add.reduceat(counts[by], first), np.diff(first, append=len(by)))
        answers = np.split(corpus, np.cumsum(sizes)[:-1])
        return pa.table({"part": table["part"], "chunk": table["chunk"], "counts": pa.array([_pack(x) for x in answers], pa.list_(pa.binary()))})

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = _chunk_words(table["text"])
        grams, _, bounds = _chunk_table([(w.hash, w.row) for w in words], order, parts)
        corpus = np.zeros(len(grams), np.int64)
        for p, x in zip(answers["part"].to_pylist(), answers["counts"], strict=True):
            corpus[bounds[p] : bounds[p + 1]] = _unpack(x.as_py(), bounds[p + 1] - bounds[p])
        sizes, known, sums = [], [], []
        for w in words:
            n_rows = len(w.first) - 1
            size = np.diff(w.first)
            rest = [_rest(w, n, grams, corpus) for n in range(1, order + 1)]
            others = np.maximum(n_all - size, 1)[w.row]
            value = np.log(np.maximum(rest[0], 0.5) / others) + (order - 1) * np.log(backoff)
            full = rest[0] > 0 if order == 1 else np.zeros(len(w.hash), bool)
            for n in range(2, order + 1):
                before = np.concatenate([[-1], rest[n - 2][:-1]]) if len(w.hash) else rest[n - 2]
                has = rest[n - 1] > 0
                value[has] = np.log(rest[n - 1][has] / before[has]) + (order - n) * np.log(backoff)
                full = has
            sizes.append(size)
            known.append(np.bincount(w.row[full], minlength=n_rows))
            sums.append(np.bincount(w.row, weights=value, minlength=n_rows))
        size = np.concatenate(sizes)
        mean = np.concatenate(sums) / np.maximum(size, 1)
        return pa.table({"id": table["id"], "n_words": pa.array(size.astype(np.int64)), "known": pa.array(np.concatenate(known).astype(np.int64)), "score": pa.array(mean, pa.float64(), mask=size == 0)})

    counted = dealt.groupBy("chunk").applyInArrow(count, "part int, chunk int, n long, gaps array<binary>, counts array<binary>")
    answers = counted.groupBy("part").applyInArrow(add, "part int, chunk int, counts array<binary>")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, f"id {kind}, n_words long, known long, score double").withColumnRenamed("id", id_col)
