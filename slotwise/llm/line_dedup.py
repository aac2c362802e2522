"""Line dedup by pairwise alignment.

1. Every line with words is cut in units at content-defined words, about seven words each, so that a passage gives the same units in whatever
   line it stands. A unit has a hash (its bytes without outer white space). A run is a shortest sequence of units with ten words or more, counted from any unit
   on, or back from the last unit of a line. What two documents share in ten words or more of whole lines is covered by runs that both have; of what they
   share in units that end inside a line, the last ones, nine words at most, may be left.
2. Each run of a document points to an earlier document that has it, with both places. Within a task the runs of its documents are held against
   each other; only the first document of each run goes on to the shuffle by run, where it is held against the first ones of the other tasks. So the row
   count of a run that a third of all documents have is the number of tasks, not of documents, and no group of copies is expanded into pairs.
3. Each pair of documents so found is aligned by patience diff on these places: the longest chain that increases in both, over the runs that
   stand once on either side. Runs that follow one another in both are one block. What the chain leaves out, for it moved or repeats, makes blocks of its own.
4. The units of the blocks are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from slotwise.llm import text_arrays as ta

#: Words on each side among which a unit's first word has the least hash.
REACH = 3


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing chain of ``values`` (patience sorting)."""
    tops: list[int] = []
    pile_of: list[int] = []
    before: list[int] = []
    for n, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            pile_of.append(n)
        else:
            tops[pile], pile_of[pile] = v, n
        before.append(pile_of[pile - 1] if pile else -1)
    out, n = [], pile_of[-1] if pile_of else -1
    while n >= 0:
        out.append(n)
        n = before[n]
    return out[::-1]


def aligned_blocks(matches: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Blocks (first unit, end) of the later document: those that patience diff aligns, and those that moved or repeat.

    ``matches``: (unit of the later document, unit of the earlier one, number of units) of the runs that both have.
    """
    left, right = Counter((x, n) for x, _, n in matches), Counter((y, n) for _, y, n in matches)
    once = sorted((x, y, n) for x, y, n in matches if left[x, n] == 1 and right[y, n] == 1)
    chain = {(once[k][0], once[k][2]) for k in _increasing([y for _, y, _ in once])}
    parts: tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]] = ([], [])
    for m in sorted(set(matches)):
        parts[(m[0], m[2]) not in chain].append(m)
    return _joined(parts[0]), _joined(parts[1])


def _joined(matches: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap at the same distance of their places, put together."""
    out: list[tuple[int, int]] = []
    open_at: dict[int, list[int]] = {}
    for x, y, n in matches:
        block = open_at.get(x - y)
        if block and x <= block[1]:
            block[1] = max(block[1], x + n)
        else:
            if block:
                out.append((block[0], block[1]))
            open_at[x - y] = [x, x + n]
    return sorted([*out, *((a, b) for a, b in open_at.values())])


def _cut_units(data: np.ndarray, offsets: np.ndarray) -> tuple[ta.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words; the first word of each unit; the last; the number of line breaks before each unit.

    A line is cut before each word whose hash is the least among ``REACH`` words on both sides in the line, so a passage is cut
    at the same words in whatever line it stands, but for those near its ends.
    """
    w = ta.words(data, offsets)
    line = np.searchsorted(np.flatnonzero(data == 10), w.start)
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (w.row[1:] != w.row[:-1])
    held = np.cumsum(new)
    least = np.ones(len(line), bool)
    for s in range(1, REACH + 1):
        same = held[s:] == held[:-s]
        least[s:] &= same & (w.hash[s:] <= w.hash[:-s])
        least[:-s] &= same & (w.hash[:-s] <= w.hash[s:])
        least[:s] = least[max(len(least) - s, 0) :] = False
    first = np.flatnonzero(new | least)
    return w, first, np.append(first[1:], len(line))[: len(first)] - 1, line[first]


def _runs(hashes: np.ndarray, n_words: np.ndarray, row: np.ndarray, line: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First units, numbers of units and hashes of the shortest runs of ``least`` words: from each unit on, and back from each that ends a line where that is another run."""
    ends = np.cumsum(n_words, dtype=np.int64)
    begins = ends - n_words
    n = len(hashes)
    at = np.arange(n)
    on = np.searchsorted(ends, begins + least)  # the unit at which the words from ``at`` on reach ``least``
    back = np.searchsorted(begins, ends - least, side="right") - 1  # the unit from which the words up to ``at`` reach it
    fits = on < n
    fits[fits] = row[on[fits]] == row[fits.nonzero()[0]]
    held = back >= 0
    held[:-1] &= (line[1:] != line[:-1]) | (row[1:] != row[:-1])
    held[held] = row[back[held]] == row[held.nonzero()[0]]
    held[held] = on[back[held]] != at[held]
    first, last = np.concatenate([at[fits], back[held]]), np.concatenate([on[fits], at[held]])
    size = last - first + 1
    made = np.zeros(len(first), np.uint64)
    for step in range(int(size.max()) if len(size) else 0):
        more = size > step
        made[more] = ta.mix(made[more] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[more] + step] + np.uint64(step + 1))
    return first, size, made


_RUN = "h long, kind boolean, id long, text_hash long, at long, e_id long, e_hash long, e_at long"


def _held_against_each_other(run: np.ndarray, doc: np.ndarray, least: int) -> pa.RecordBatch:
    """Rows of ``_RUN`` from runs (hash) and documents (id, text hash, at): each run's first document as it is (kind true), the others as matches with it."""
    by = np.lexsort((doc[:, 2], doc[:, 1], doc[:, 0], run))
    run, doc = run[by], doc[by]
    new = np.ones(len(run), bool)
    new[1:] = np.any(doc[1:] != doc[:-1], axis=1) | (run[1:] != run[:-1])
    run, doc = run[new], doc[new]  # repeated rows of a document are one
    head = np.ones(len(run), bool)
    head[1:] = run[1:] != run[:-1]
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    own = np.all(doc[:, :2] == doc[first][:, :2], axis=1)
    early = [pa.array(doc[first, c], pa.int64(), mask=own) for c in range(3)]
    key = np.where(own, run, ta.mix(doc[:, 0].astype(np.uint64) + doc[:, 2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    columns = [pa.array(key.view(np.int64)), pa.array(own), *(pa.array(doc[:, c]) for c in range(3)), *early]
    near = pa.array(np.lexsort((doc[:, 2], doc[:, 1], doc[:, 0])))  # by document, so that its id and hash shrink when they are written
    return pa.RecordBatch.from_arrays([c.take(near) for c in columns], ["h", "kind", "id", "text_hash", "at", "e_id", "e_hash", "e_at"])


def _document_runs(docs: DataFrame, id_col: str, text_col: str, least: int, most: int = 1 << 21) -> DataFrame:
    """Rows of ``_RUN``. A place ``at`` is the first unit times ``least`` plus the number of units less one. At most about ``most`` runs are held at once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held = 0
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("id", "text_hash")], axis=1)
            for a, _, data, offsets in ta.slices(batch, "text"):
                w, first, last, line = _cut_units(data, offsets)
                if not len(first):
                    continue
                row = w.row[first]
                unit, size, run = _runs(ta.span_hash(data, w.start[first], w.end[last]), last - first + 1, row, line, least)
                place = (unit - np.searchsorted(row, row[unit])) * least + size - 1
                runs.append(run)
                places.append(np.column_stack([keys[a + row[unit]], place]))
                held += len(run)
                if held >= most:
                    yield _held_against_each_other(np.concatenate(runs), np.concatenate(places), least)
                    runs, places, held = [], [], 0
        if held:
            yield _held_against_each_other(np.concatenate(runs), np.concatenate(places), least)

    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return source.mapInArrow(each, _RUN)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """(id, text_hash, units, aligned, moved): the numbers, from 0, of the units to delete from each later document, and how many blocks of it are aligned and moved.

    Documents are ordered by id, then by a hash of the text; rows that repeat both are one document. ``min_words`` is the size of an aligned block.
    """
    same_run = Window.partitionBy("kind", "h").orderBy("id", "text_hash", "at")
    first = F.first(F.struct(F.col("id").alias("e_id"), F.col("text_hash").alias("e_hash"), F.col("at").alias("e_at"))).over(same_run)
    own = F.struct("e_id", "e_hash", "e_at")
    pointed = _document_runs(docs, id_col, text_col, min_words).select("id", "text_hash", "at", F.when(F.col("kind"), first).otherwise(own).alias("e"))
    matched = pointed.filter((F.col("e.e_id") != F.col("id")) | (F.col("e.e_hash") != F.col("text_hash")))
    held = matched.groupBy("id", "text_hash").agg(F.collect_set(F.struct("e.e_id", "e.e_hash", "e.e_at", "at")).alias("m"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for matches in batch.column("m").to_pylist():
                pairs: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
                for m in matches:
                    (x, n), y = divmod(m["at"], min_words), m["e_at"] // min_words
                    pairs.setdefault((m["e_id"], m["e_hash"]), []).append((x, y, n + 1))
                gone: set[int] = set()
                counts = [0, 0]
                for found in pairs.values():
                    for k, blocks in enumerate(aligned_blocks(found)):
                        counts[k] += len(blocks)
                        for a, b in blocks:
                            gone.update(range(a, b))
                made.append((sorted(gone), *counts))
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.list_(pa.int32()), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), *columns], ["id", "text_hash", "units", "aligned", "moved"])

    return held.mapInArrow(align, "id long, text_hash long, units array<int>, aligned int, moved int")


def _without(text: bytes, spans: list[tuple[int, int, bool]]) -> tuple[bytes, int]:
    """A text without its gone units (line, first byte, gone), and the number of lines that lost any. A line that loses all its units goes with its break."""
    of_line: dict[int, list[tuple[int, bool]]] = {}
    for n, start, gone in spans:
        of_line.setdefault(n, []).append((start, gone))
    out, lost, base = [], 0, 0
    for n, row in enumerate(text.split(b"\n")):
        units = of_line.get(n, [])
        end = base + len(row)
        if any(gone for _, gone in units):
            lost += 1
            stops = [*(start for start, _ in units[1:]), end]
            left = b"".join(text[start:stop] for (start, gone), stop in zip(units, stops, strict=True) if not gone)
            if left:
                out.append(text[base : units[0][0]] + (left.rstrip(b" \t\n\x0b\x0c\r") if units[-1][1] else left))
        else:
            out.append(row)
        base = end + 1
    return b"\n".join(out), lost


@F.arrow_udf(returnType=StructType([StructField("text", StringType()), StructField("lost", IntegerType())]))
def _cut_text(text: pa.Array, cut: pa.Array) -> pa.Array:
    out: list[dict[str, object] | None] = []
    numbers = cut.to_pylist()
    for a, b, data, offsets in ta.slices(pa.RecordBatch.from_arrays([text], ["text"]), "text"):
        w, first, _, line = _cut_units(data, offsets)
        breaks = np.searchsorted(np.flatnonzero(data == 10), offsets)
        bounds = np.searchsorted(w.row[first], np.arange(b - a + 1))
        for r in range(b - a):
            if numbers[a + r] is None:
                out.append(None)
                continue
            at = slice(bounds[r], bounds[r + 1])
            gone = np.zeros(bounds[r + 1] - bounds[r], bool)
            gone[numbers[a + r]] = True
            left, lost = _without(data[offsets[r] : offsets[r + 1]].tobytes(), list(zip((line[at] - breaks[r]).tolist(), (w.start[first[at]] - offsets[r]).tolist(), gone.tolist(), strict=True)))
            out.append({"text": left.decode("utf-8", "replace"), "lost": lost})
    return pa.array(out, pa.struct([("text", pa.string()), ("lost", pa.int32())]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """``docs`` with those units cut from the text, and ``n_removed``, the number of lines that lost any (a column of that name is replaced).

    A block counts from ``min_words`` words on. Other columns pass, whatever their names.

    A text without removed units is as it was, byte for byte; one that loses all its lines is empty. Null and empty texts, and rows with a
    null id, stay as they are. Rows that repeat both id and text are one document and are cut alike. Ids are whole numbers (text that holds none raises). Texts are read whole; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_removed")]
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"), F.struct(*rest).alias("rest"))
    marked = whole.join(repeated_units(docs, id_col, text_col, min_words).select("id", "text_hash", "units"), ["id", "text_hash"], "left")
    done = marked.select("text", "rest", _cut_text(F.when(F.col("units").isNotNull(), F.col("text")), F.col("units")).alias("done"))
    columns = {text_col: F.coalesce("done.text", "text"), **{c: F.col(f"rest.`{c}`") for c in rest}}
    return done.select(*[columns[c].alias(c) for c in docs.columns if c in columns], F.coalesce("done.lost", F.lit(0)).alias("n_removed"))
