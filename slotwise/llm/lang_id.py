"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time, on windows of labelled documents. Every position of a text
gets a probability for each language; a document's is their mean. Gates are piecewise linear (clip(x / 4 + 1/2)), candidates
clip(x), so that a step over many windows is a few passes over small arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm import text_arrays as ta

SPAN, LANES = 160, 1024
Net = dict[str, np.ndarray]


def _new_net(h: int, n: int, rng: np.random.Generator) -> Net:
    small = lambda *s, by=1.0: (rng.standard_normal(s) * by).astype(np.float32)
    net: Net = {}
    for d in "fb":
        codes = small(257, 3 * h, by=0.5)
        codes[256] = 0
        codes[256, :h] = -1e4  # beyond a window's end the update gate is shut, so states pass as they are and get no gradient
        net |= {f"x{d}": codes, f"g{d}": small(h, 2 * h, by=0.5 / np.sqrt(h)), f"c{d}": small(h, h, by=0.5 / np.sqrt(h))}
    return net | {"o": small(2 * h, n, by=1 / np.sqrt(2 * h)), "ob": np.zeros(n, np.float32)}


def _run(net: Net, d: str, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps x lanes x h) of one direction over codes (steps x lanes); backward states stand at the step they end on."""
    steps, lanes = codes.shape
    h = net[f"c{d}"].shape[0]
    wx, ug, uc = net[f"x{d}"], net[f"g{d}"], net[f"c{d}"]
    states = np.empty((steps, lanes, h), np.float32)
    state = np.zeros((lanes, h), np.float32)
    gates, cand, x = np.empty((lanes, 2 * h), np.float32), np.empty((lanes, h), np.float32), np.empty((lanes, 3 * h), np.float32)
    tape = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        np.take(wx, codes[t], axis=0, out=x, mode="clip")
        np.matmul(state, ug, out=gates)
        gates += x[:, : 2 * h]
        gates *= 0.25
        gates += 0.5
        np.maximum(gates, 0, out=gates)
        np.minimum(gates, 1, out=gates)
        z, r = gates[:, :h], gates[:, h:]
        np.matmul(r * state, uc, out=cand)
        cand += x[:, 2 * h :]
        np.maximum(cand, -1, out=cand)
        np.minimum(cand, 1, out=cand)
        if keep:
            tape.append((t, state.copy(), gates.copy(), cand.copy()))
        cand -= state
        cand *= z
        state = np.add(state, cand, out=states[t])
    return states, tape


def _probabilities(net: Net, both: np.ndarray) -> np.ndarray:
    scores = both @ net["o"]
    scores += net["ob"]
    scores -= scores.max(axis=-1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=-1, keepdims=True)
    return scores


def _gradients(net: Net, codes: np.ndarray, labels: np.ndarray) -> Net:
    """Of the mean cross-entropy over all positions; label of each lane."""
    steps, lanes = codes.shape
    h = net["cf"].shape[0]
    runs = {d: _run(net, d, codes, keep=True) for d in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    p = _probabilities(net, both)
    p[:, np.arange(lanes), labels] -= 1
    p *= (codes < 256)[:, :, None] / max(1, (codes < 256).sum())
    g: Net = {"o": np.einsum("tlh,tln->hn", both, p), "ob": p.sum(axis=(0, 1))}
    out = p @ net["o"].T
    for d, own in (("f", out[:, :, :h]), ("b", out[:, :, h:])):
        ug, uc = net[f"g{d}"], net[f"c{d}"]
        gx, gg, gc = np.zeros_like(net[f"x{d}"]), np.zeros_like(ug), np.zeros_like(uc)
        carry = np.zeros((lanes, h), np.float32)
        for t, state, gates, cand in reversed(runs[d][1]):
            carry = carry + own[t]
            z, r = gates[:, :h], gates[:, h:]
            d_cand = carry * z * (np.abs(cand) < 1)
            back = d_cand @ uc.T
            d_gates = np.concatenate([carry * (cand - state), back * state], axis=1) * 0.25 * ((gates > 0) & (gates < 1))
            gc += (r * state).T @ d_cand
            gg += state.T @ d_gates
            np.add.at(gx, codes[t], np.concatenate([d_gates, d_cand], axis=1))
            carry = carry * (1 - z) + back * r + d_gates @ ug.T
        g |= {f"x{d}": gx, f"g{d}": gg, f"c{d}": gc}
    return g


def train(windows: list[bytes], labels: np.ndarray, n: int, hidden: int = 8, steps: int = 300, batch: int = 128, span: int = 48, seed: int = 3) -> Net:
    """Adam on random pieces of ``span`` bytes; classes are drawn alike."""
    rng = np.random.default_rng(seed)
    net = _new_net(hidden, n, rng)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    groups = [np.flatnonzero(labels == c) for c in range(n)]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(groups[c]) for c in rng.integers(0, n, batch)])
        codes = np.full((span, batch), 256, np.int64)
        for lane, i in enumerate(pick):
            at = rng.integers(0, max(1, len(windows[i]) - span + 1))
            piece = np.frombuffer(windows[i][at : at + span], np.uint8)
            codes[: len(piece), lane] = piece
        rate = 0.03 * min(1.0, step / 20) * (1 - step / (steps + 1)) ** 0.5
        for k, v in _gradients(net, codes, labels[pick]).items():
            v = np.clip(v, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities over all byte positions of each row; windows of ``SPAN`` bytes start with empty states."""
    n = net["ob"].shape[0]
    sizes = np.diff(offsets)
    pieces = -(-sizes // SPAN)
    row = np.repeat(np.arange(len(sizes)), pieces)
    start = offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPAN
    total = np.zeros((len(sizes), n))
    order = np.argsort(np.minimum(offsets[row + 1] - start, SPAN), kind="stable") if len(row) else np.zeros(0, np.int64)
    for a in range(0, len(order), LANES):
        own = order[a : a + LANES]
        length = np.minimum(offsets[row[own] + 1] - start[own], SPAN)
        span = int(length.max())
        at = start[own][None, :] + np.arange(span)[:, None]
        inside = np.arange(span)[:, None] < length[None, :]
        codes = np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int64), 256)
        both = np.concatenate([_run(net, d, codes, keep=False)[0] for d in "fb"], axis=2)
        p = _probabilities(net, both)
        p *= inside[:, :, None]
        np.add.at(total, row[own], p.sum(axis=0))
    return total / np.maximum(sizes, 1)[:, None]


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, chars: int) -> DataFrame:
    """(lang, window): at most ``per_lang`` pieces of ``chars`` characters a language, from documents that are not held out, drawn by a hash of the id."""
    key = F.xxhash64(F.col(id_col).cast("string"))
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 != 2))
    at = F.pmod(key, F.greatest(F.length(text_col) - chars, F.lit(1)).cast("long")).cast("int") + 1
    drawn = known.select(F.col(lang_col).alias("lang"), F.pmod(key, F.lit(per_lang)).alias("slot"), F.struct(key.alias("k"), F.substring(F.col(text_col), at, F.lit(chars)).alias("window")).alias("w"))
    return drawn.groupBy("lang", "slot").agg(F.min("w").alias("w")).select("lang", "w.window", "w.k")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 256, chars: int = 600, most: int = 20_000, hidden: int = 8, steps: int = 300) -> DataFrame:
    """Per row: id, ``held_out``, ``lang_pred`` and ``score`` (the mean probability of the language over the positions of the whole text).

    The network learns from at most ``per_lang`` windows of ``chars`` characters a language (``most`` in all), of documents with crc32(id) mod 4 other than 2.
    Null texts and texts without a letter are ``und`` with score 0; so is every text if there is nothing to learn from. A row with
    a null id is not held out and not learned from. Each row stands for itself, so repeated rows are labelled alike; texts are read whole, however long; an empty table gives an empty one.
    """
    rows = training_windows(docs, id_col, text_col, lang_col, per_lang, chars).orderBy("k", "lang").limit(most).collect()
    rows = [r for r in rows if r["window"]]
    names = sorted({r["lang"] for r in rows})
    net = train([r["window"].encode() for r in rows], np.array([names.index(r["lang"]) for r in rows]), len(names), hidden, steps) if names else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in ta.slices(batch, "text"):
                p = pooled(net, data, offsets)
                best = p.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("id", "held_out", "spoken")), pa.array([names[x] for x in best], pa.string()), pa.array(p.max(axis=1))], ["id", "held_out", "spoken", "pred", "p"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("spoken"), F.col(text_col).alias("text"))
    if net is None:
        judged = source.select("id", "held_out", F.lit(False).alias("spoken"), F.lit(None).cast("string").alias("pred"), F.lit(0.0).alias("p"))
    else:
        judged = source.mapInArrow(each, f"id {kind}, held_out boolean, spoken boolean, pred string, p double")
    return judged.select(F.col("id").alias(id_col), "held_out", F.when(F.col("spoken"), F.col("pred")).otherwise("und").alias("lang_pred"), F.when(F.col("spoken"), F.least("p", F.lit(1.0))).otherwise(0.0).alias("score"))
