"""Line dedup against all pairs of documents, and the cases that a pointer to one holder of one line would lose."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import line_dedup
from slotwise.llm import text_arrays as ta

LEAST = 10


def units(text):
    """(bytes, words, whether it ends its line) of the units of a text."""
    for _, _, data, offsets in ta.slices(pa.RecordBatch.from_arrays([pa.array([text])], ["text"]), "text"):
        w, first, last, line = line_dedup._cut_units(data, offsets)
        ends = [*(a != b for a, b in zip(line[:-1], line[1:], strict=True)), True]
        return [(data[w.start[f] : w.end[e]].tobytes(), int(e - f) + 1, end) for f, e, end in zip(first, last, ends, strict=False)]
    return []


def windows(own):
    """(first, end) of all runs of ``LEAST`` words or more that lose that without the last unit, or, at the end of a line, without the first."""
    for i in range(len(own)):
        for j in range(i + 1, len(own) + 1):
            size = sum(u[1] for u in own[i:j])
            if size >= LEAST and ((own[j - 1][2] and size - own[i][1] < LEAST) or size - own[j - 1][1] < LEAST):
                yield i, j
            if size - own[i][1] >= LEAST and size - own[j - 1][1] >= LEAST:
                break


def brute(rows):
    """For each document the units that lie in a run which an earlier one has, by looking at all pairs."""
    docs = {i: units(t) for i, t in rows}
    out = {}
    for i, own in docs.items():
        known = {tuple(u[0] for u in other[a:b]) for j, other in docs.items() if j < i for a, b in windows(other)}
        gone = {u for a, b in windows(own) if tuple(u[0] for u in own[a:b]) in known for u in range(a, b)}
        if gone:
            out[i] = sorted(gone)
    return out


def cut(spark, rows, parts=1):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return {r.id: r.units for r in line_dedup.repeated_units(df).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 14, 30]))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice([*lines, "", " ".join(rng.choice(words) for _ in range(12))]) for _ in range(rng.randrange(12)))) for i in range(60)]
    want = brute(rows)
    assert want and cut(spark, rows) == want and cut(spark, rows, 7) == want


def test_over_small_documents_of_the_table(spark, tmp_path):
    path = "/root/testdata/sf0.001/documents.parquet"
    if not __import__("os").path.exists(path):
        pytest.skip("needs the test tables")
    df = spark.read.parquet(path)
    rows = [(r.doc_id, r.text) for r in df.filter("length(text) < 1500").collect()]
    assert cut(spark, rows, 5) == brute(rows)


def test_scattered_lines_and_many_holders(spark):
    a, b, c = "one two three four five", "six seven eight nine ten", "alpha beta gamma delta epsilon"
    rows = [(1, f"{a}\nx y\n{b}\nz\n{c}"), (2, f"{a}\n{b}\n{c}"), (3, f"head\n{a}\n{b}\n{c}\ntail")]
    rows += [(i, f"{a}\n{b}\n{c}\nown {i}") for i in range(10, 110)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[2] == rows[1][1] and got[3] == "head\ntail" and all(got[i] == f"own {i}" for i in range(10, 110))


def test_clashing_columns_and_moved_blocks(spark):
    rng = random.Random(5)
    p, q, r = (" ".join(f"v{rng.randrange(900)}" for _ in range(40)) for _ in range(3))
    df = spark.createDataFrame([(1, f"{p}\n{q}\n{r}", 7, 8, "x", 9), (2, f"{r}\nmid\n{p}\n{p}\nend", 7, 8, "x", 9)], "doc_id long, text string, id int, text_hash int, units string, n_removed int")
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "id", "text_hash", "units", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, f"{p}\n{q}\n{r}", 7, 8, "x", 0), (2, "mid\nend", 7, 8, "x", 3)]
    blocks = line_dedup.repeated_units(df).first()
    assert blocks.aligned >= 1 and blocks.moved >= 1 and re.fullmatch(r"\d+", str(len(blocks.units))) and np.all(np.diff(blocks.units) > 0)
