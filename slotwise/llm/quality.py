"""Quality rules as learned decision lists: counts of each text, rules from labelled rows, a Spark conditional expression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm import text_arrays as ta
from slotwise.llm.storage import cut_lineage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_ROW = np.uint64(0xA24BAED4963EE407)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    w = ta.words(data, offsets, fold=False)
    letters = ((data & 0xC0) != 0x80) & ~ta._SPACE[data]
    # lines: the spans between line breaks and row ends
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([offsets[1:], breaks]))
    row = np.searchsorted(offsets, start, side="right") - 1 if len(data) else np.zeros(0, np.int64)
    spoken = np.searchsorted(w.start, end[: len(row)]) > np.searchsorted(w.start, start[: len(row)])
    start, end, row = start[: len(row)][spoken], end[: len(row)][spoken], row[spoken]
    unique = np.unique(ta.mix(ta.span_hash(data, start, end) + row.astype(np.uint64) * _ROW), return_index=True)[1]
    dup = np.bincount(row, minlength=n) - np.bincount(row[unique], minlength=n)
    # words in windows of three that are found twice in their row
    runs = ta.run_hash(w.hash, 3)
    at = np.flatnonzero(ta.whole_runs(w, 3))
    twice = np.zeros(len(w.hash), bool)
    if len(at):
        _, inverse, times = np.unique(ta.mix(runs[at] + w.row[at].astype(np.uint64) * _ROW), return_inverse=True, return_counts=True)
        again = at[times[inverse] > 1]
        for j in range(3):
            twice[again + j] = True
    return [np.diff(w.first), _per_row(letters, offsets), _per_row(_SYMBOL[data], offsets), dup, np.bincount(w.row[twice], minlength=n)]


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns and those of ``COUNTS`` (columns of these names are replaced). A null text counts as an empty one."""
    docs = docs.drop(*COUNTS)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in ta.slices(batch, text_col):
                part = batch.slice(a, b - a)
                made = [pa.array(x.astype(np.int64)) for x in _counts(data, offsets)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *COUNTS])

    return docs.mapInArrow(each, schema)


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "chars_per_word": per_word("word_chars"),
        "symbols_per_word": per_word("n_symbols"),
        "n_dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": per_word("n_repeat_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        f = features()[self.feature]
        return f > self.threshold if self.above else f <= self.threshold


def _all(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _thresholds(v: np.ndarray, most: int) -> np.ndarray:
    """Middles of neighbouring values; ``most`` of them, evenly by rank, where there are more."""
    distinct = np.unique(v)
    middle = (distinct[1:] + distinct[:-1]) / 2
    return middle if len(middle) <= most else middle[np.linspace(0, len(middle) - 1, most).astype(int)]


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 5, precision: float = 0.9, least: int = 5, most_rules: int = 12, most_conditions: int = 3, most_thresholds: int = 64) -> list[list[Condition]]:
    """Rules for bad rows by sequential covering, in order.

    Each rule is grown on two thirds of the uncovered rows by the gain of information on bad rows, then loses last
    conditions while that does not worsen (p - n) / (p + n) on the other third. It is taken if at least ``precision`` of all rows
    it covers, and at least ``least`` rows, are bad; the first that is not ends the list.
    The size of the list and its search are parameters: at most ``most_rules`` rules of ``most_conditions`` conditions, each of ``most_thresholds`` thresholds a feature.
    """
    n = len(bad)
    left = np.ones(n, bool)
    grow_part = np.random.default_rng(seed).random(n) < 2 / 3
    rules: list[list[Condition]] = []
    while len(rules) < most_rules and (bad & left).sum() >= least:
        grow, prune = left & grow_part, left & ~grow_part
        rule: list[Condition] = []
        inside = grow.copy()
        while len(rule) < most_conditions and (inside & ~bad).any():
            p0, n0 = (inside & bad).sum(), (inside & ~bad).sum()
            best, gain = None, 0.0
            for f, v in x.items():
                for t in _thresholds(v[inside], most_thresholds):
                    for above in (True, False):
                        c = Condition(f, above, float(t))
                        now = inside & c.holds(x)
                        p1 = (now & bad).sum()
                        if p1:
                            g = p1 * (np.log2(p1 / now.sum()) - np.log2(p0 / (p0 + n0))) if p0 else 0.0
                            if g > gain + 1e-9:
                                best, gain = c, g
            if best is None:
                break
            rule.append(best)
            inside &= best.holds(x)

        def worth(r: list[Condition], prune: np.ndarray = prune) -> float:
            hit = _all(r, x, n) & prune
            return ((hit & bad).sum() - (hit & ~bad).sum()) / hit.sum() if hit.any() else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = _all(rule, x, n) & left
        if not rule or (covered & bad).sum() < max(least, precision * covered.sum()):
            break
        rules.append(rule)
        left &= ~covered
    return rules


def list_expression(rules: list[list[Condition]]) -> Column:
    """Whether a row with ``COUNTS`` stays: the first rule that holds rejects it; none keeps it."""
    out = None
    for rule in rules:
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_from(counted: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = 5_000, **search: int) -> list[list[Condition]]:
    """The decision list (``search``: see ``learn_list``) from at most ``sample`` labelled rows that pass the base rules, those of the smallest hash of id.

    Rows with a null label or id are left out; label 0 is bad. No usable row gives the empty list, which keeps everything.
    """
    named = features()
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).filter("_id is not null and _label is not null")
    labelled = counted.filter(~base_failed()).select(F.col(id_col).alias("_id"), *(c.alias(f) for f, c in named.items())).join(known, "_id")
    rows = labelled.orderBy(F.xxhash64("_id"), *named, "_label").limit(sample).collect()
    if not rows:
        return []
    return learn_list({f: np.array([r[f] for r in rows], float) for f in named}, np.array([r["_label"] == 0 for r in rows]), **search)


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 5_000) -> DataFrame:
    """Per row: id, ``COUNTS``, ``base_failed`` and ``kept`` (false if ``base_failed``, else the learned list's verdict).

    A null or empty text has counts of 0 and fails the base rules. Each row stands for itself: repeated rows are judged alike, and a row with a null id is judged but not learned
    from. Texts are read whole, however long. The list is learned from at most ``sample`` labelled rows, the first by a hash, so ties fall alike on every run; without labels the base
    rules decide. An empty table gives an empty one. Other columns are ignored.
    """
    counted = cut_lineage(with_counts(docs.select(id_col, text_col), text_col).drop(text_col))
    rules = learn_from(counted, labels, id_col, sample=sample)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & list_expression(rules))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 5_000) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps, with their columns, whatever their names. Null and empty texts fail the base rules; repeated rows stay or go alike."""
    rules = learn_from(with_counts(docs.select(id_col, text_col), text_col).drop(text_col), labels, id_col, sample=sample)
    others = [c for c in docs.columns if c != text_col]
    held = docs.select(F.col(text_col).alias("text"), F.struct(*others).alias("row"))
    kept = with_counts(held, "text").filter(~base_failed() & list_expression(rules))
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
