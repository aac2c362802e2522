"""MinHash near-duplicates with odd sketches.

1. Each text gets the set of its 5-word shingles, a 128-bit digest of that set, 24 x 5 MinHash samples and an
   odd sketch: the samples folded into a bitmap of parities. Equal digests make one class, so copies never meet as pairs.
2. Classes that agree in a band share a bucket. In each bucket every member is held against the first and the
   last member only; the popcount of two sketches' XOR drops pairs below the threshold, full sets confirm the rest.
3. Links make components. Where a bucket still holds several components, members are held against two others drawn by hash,
   bucket by bucket, in one or more rounds, which joins the bulk of a large group with few pairs.
4. Where a bucket holds several components even then, its members are dealt to blocks of bounded
   size, and every pair of different components in a block is held against finer sketches, then the full sets;
   a pair that shares several buckets is taken in the first. So no link that shares a bucket is lost, and no group is ever one task.
   Steps 2 and 3 only save pairs here: a link that they miss is between two components still, so this step finds it. Hence
   their ``slack`` may be small; that of the finer sketches, ``fine_slack``, is over five standard deviations of an estimate.

A pair at the threshold shares no bucket with a chance of (1 - 0.85**5)**24, about 8e-7; one at half the threshold's similarity shares one with a chance of 0.28.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import text_arrays as ta
from slotwise.llm.storage import cut_lineage

BANDS, ROWS = 24, 5
#: MinHash samples and bits of the sketch that every text has, and of the finer one for large groups.
COARSE, FINE = (BANDS * ROWS, 256), (2048, 4096)
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**31, FINE[0], dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, FINE[0], dtype=np.uint32)
_ROW_STEP = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _minhash(u: np.ndarray, samples: int) -> np.ndarray:
    x = (u >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    step = (1 << 18) // samples
    for a in range(0, len(x), step):
        least = np.minimum(least, (x[a : a + step, None] * _A[:samples] + _B[:samples]).min(axis=0))
    return least


def _odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """Rows of MinHash samples as bitmaps in words of 64 bits: bit ``h(i, sample i)`` is flipped for each i."""
    n, k = samples.shape
    place = ta.mix(samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flat = place.astype(np.int64) + np.arange(n)[:, None] * bits
    odd = (np.bincount(flat.ravel(), minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.uint64)


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket hashes (rows x BANDS) and coarse sketches."""
    samples = np.stack([_minhash(u, COARSE[0]) for u in sets])
    sig = samples.astype(np.uint64).reshape(len(sets), BANDS, ROWS)
    buckets = ta.mix((sig * _ROW_STEP).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return buckets, _odd_sketch(samples, COARSE[1])


def _digest(u: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([ta.mix(u).sum(dtype=np.uint64), ta.mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes()


def _far_apart(sketch: tuple[int, int], similarity: float) -> int:
    """The XOR popcount above which the estimated similarity is under ``similarity``."""
    samples, bits = sketch
    return math.ceil(bits / 2 * (1 - math.exp(-4 * samples * (1 - similarity) / bits)))


def _fine_sketches(texts: DataFrame, k: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in ta.slices(batch, "text"):
                made = _odd_sketch(np.stack([_minhash(u, FINE[0]) for u in ta.shingle_sets(ta.words(data, offsets), k)]), FINE[1])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array([x.tobytes() for x in made], pa.binary())], ["key", "sketch"])

    return texts.select("key", "text").mapInArrow(each, "key binary, sketch binary")


def set_keys(docs: DataFrame, id_col: str, text_col: str, k: int, signed: bool) -> DataFrame:
    """Per row: id, hash of the text, set size, digest of the set (null: no words) and, if ``signed``, buckets and sketch, else the text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in ta.slices(batch, "text"):
                sets = ta.shingle_sets(ta.words(data, offsets), k)
                key = pa.array([_digest(u) if len(u) else None for u in sets], pa.binary())
                part = batch.slice(a, b - a)
                if not signed:
                    yield pa.RecordBatch.from_arrays([key, part.column("text")], ["key", "text"])
                    continue
                full = [i for i, u in enumerate(sets) if len(u)]
                none = np.zeros(0, np.uint64)
                buckets, sketch = [none] * len(sets), [none] * len(sets)
                if full:
                    made = _signatures([sets[i] for i in full])
                    for i, x, y in zip(full, *made, strict=True):
                        buckets[i], sketch[i] = x, y
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_hash"), pa.array([len(u) for u in sets], pa.int64()), key, ta.lists([x.view(np.int64) for x in buckets], pa.int64()), ta.lists([x.view(np.int64) for x in sketch], pa.int64())],
                    ["id", "text_hash", "n_shingles", "key", "buckets", "sketch"],
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    if signed:
        return source.mapInArrow(each, "id long, text_hash long, n_shingles long, key binary, buckets array<long>, sketch array<long>")
    return source.select("text").mapInArrow(each, "key binary, text string")


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A sort-merge join, whose hot keys Spark splits: the rounds would else hold dozens of broadcast tables in the driver at once."""
    return left.join(right.hint("merge"), on, how)


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Labels (la, lb) of those pairs (a, b, la, lb) of which the full sets have ``den * intersection >= num * union``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [u for _, _, d, o in ta.slices(batch, "text_a") for u in ta.shingle_sets(ta.words(d, o), k)]
            right = [u for _, _, d, o in ta.slices(batch, "text_b") for u in ta.shingle_sets(ta.words(d, o), k)]
            keep = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["la", "lb"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return _join(_join(pairs, left, "a"), right, "b").select("la", "lb", "text_a", "text_b").mapInArrow(each, "la binary, lb binary")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for edges (a, b): the smallest node reachable. Label propagation with pointer jumping, all in joins."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    while True:
        near = _join(both, labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = _join(labels, near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = cut_lineage(_join(lower, up, "label").select("node", "old", F.least("label", "above").alias("label")))
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels


def _cross_pairs(members: DataFrame, buckets: DataFrame, texts: DataFrame, k: int, block: int, far: int) -> DataFrame:
    """Pairs (a, b) of different labels (la, lb) in a bucket whose fine sketches are near, found in blocks of at most about 2 x ``block`` rows.

    ``buckets`` has each key's buckets by band. A pair is made once, in its first common bucket: that too holds two labels, so it is dealt.
    """
    mixed = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("c"))
    held = cut_lineage(_join(members, mixed, "bucket").select("bucket", "c", "key", "label"))
    mine = held.select("key").distinct()
    fine = cut_lineage(_join(_fine_sketches(_join(texts, mine, "key", "left_semi"), k), buckets, "key"))
    dealt = (
        _join(held, fine, "key")
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("c")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "label", "sketch", "buckets")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j")
    )

    def near(rows: pa.Table) -> pa.RecordBatch:
        keys, labels = np.array(rows["key"].to_pylist(), object), np.array(rows["label"].to_pylist(), object)
        _, code = np.unique(labels, return_inverse=True)
        own, i, j = (rows[c].to_numpy() for c in ("own", "i", "j"))
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(rows), -1)
        left = np.flatnonzero(own == i[0])
        right = np.flatnonzero(own == j[0])
        bands = pc.list_flatten(rows["buckets"]).to_numpy().reshape(len(rows), BANDS)
        wanted = code[left][:, None] != code[right][None, :]
        if i[0] == j[0]:
            wanted &= left[:, None] < right[None, :]
        for band in range(int(np.flatnonzero(bands[0] == rows["bucket"][0].as_py())[0])):
            wanted &= bands[left, band][:, None] != bands[right, band][None, :]
        x, y = (at[z] for at, z in zip((left, right), np.nonzero(wanted), strict=True))
        close = np.zeros(len(x), bool)
        for a in range(0, len(x), 1 << 15):
            close[a : a + (1 << 15)] = np.bitwise_count(sketch[x[a : a + (1 << 15)]] ^ sketch[y[a : a + (1 << 15)]]).sum(axis=1, dtype=np.int32) <= far
        x, y = x[close], y[close]
        x, y = np.where(keys[x] < keys[y], x, y), np.where(keys[x] < keys[y], y, x)
        return pa.RecordBatch.from_arrays([pa.array(z, pa.binary()) for z in (keys[x], keys[y], labels[x], labels[y])], ["a", "b", "la", "lb"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        for batch in batches:
            table = pa.Table.from_batches([batch])
            kept = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
            ids = [kept[c].to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            bounds = [0, *cuts.tolist()]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    yield near(kept.slice(a, b - a))
            kept = kept.slice(bounds[-1])
        if kept is not None and len(kept) > 1:
            yield near(kept)

    return dealt.mapInArrow(each, "a binary, b binary, la binary, lb binary")


def _near(sketch: Column, other: Column, far: int) -> Column:
    """Whether two odd sketches differ in at most ``far`` bits."""
    return F.aggregate(F.zip_with(sketch, other, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v) <= far


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return _join(members, labels, "key").select("bucket", "key", "sketch", "label")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (key, label) once the links (la, lb) between labels hold too. Only labels are searched for components, not all keys and links again."""
    up = connected_components(links.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("up"))
    return cut_lineage(_join(labels, up, "label", "left").select("key", F.coalesce("up", "label").alias("label")))


def _judged(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, slack: float, fine_slack: float, rounds: int, block: int) -> DataFrame:
    """Per row of ``docs``: doc, n_shingles, key (null: no words), component_id, and ``first``, the least doc of its component.

    A doc is (no_id, id, text_hash), so a null id is larger than any.
    """
    far = _far_apart(COARSE, num / den - slack)
    signed = cut_lineage(set_keys(docs, id_col, text_col, k, signed=True))
    doc = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    classes = signed.filter("key is not null").groupBy("key").agg(F.min(doc).alias("doc"), F.min_by(F.struct("buckets", "sketch"), F.coalesce("id", F.lit(2**63 - 1))).alias("s"))
    buckets = classes.select("key", F.col("s.buckets").alias("buckets"))
    exploded = classes.select("key", F.explode("s.buckets").alias("bucket"), F.col("s.sketch").alias("sketch"))
    one = F.struct("key", "sketch")
    shared = exploded.groupBy("bucket").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo.key <> hi.key")
    met = [F.when((F.col("key") != F.col(f"{end}.key")) & _near(F.col("sketch"), F.col(f"{end}.sketch"), far), F.col(f"{end}.key")) for end in ("lo", "hi")]
    members = cut_lineage(_join(exploded, shared, "bucket").select("bucket", "key", "sketch", F.array_compact(F.array(*met)).alias("near")))
    labels = cut_lineage(members.select("key", F.col("key").alias("label")).distinct())
    texts = cut_lineage(_join(set_keys(docs, id_col, text_col, k, signed=False), labels.select("key"), "key").groupBy("key").agg(F.min("text").alias("text")))

    def linked(pairs: DataFrame) -> DataFrame:
        """Links (la, lb) between the labels of those pairs (key, label, other, other_label) that full sets confirm."""
        one, two = F.struct(F.col("key").alias("k"), F.col("label").alias("l")), F.struct(F.col("other").alias("k"), F.col("other_label").alias("l"))
        ordered = pairs.select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y")).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), F.col("x.l").alias("la"), F.col("y.l").alias("lb"))
        return cut_lineage(_confirmed(ordered.distinct(), texts, k, num, den).distinct())

    met = members.select("key", F.col("key").alias("label"), F.explode("near").alias("other")).withColumn("other_label", F.col("other"))
    labels = _merged(labels, linked(met))
    for turn in range(rounds):
        held = _labelled(members, labels)
        at = F.xxhash64("key", "bucket", F.lit(turn))
        one = F.struct("key", "label", "sketch")
        heads = held.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by(one, at).alias("p"), F.max_by(one, at).alias("q")).filter("lo <> hi").select("bucket", F.explode(F.array("p", "q")).alias("head"))
        apart = (F.col("label") != F.col("head.label")) & _near(F.col("sketch"), F.col("head.sketch"), far)
        more = linked(_join(held, heads, "bucket").filter(apart).select("key", "label", F.col("head.key").alias("other"), F.col("head.label").alias("other_label")))
        if more.isEmpty():
            break
        labels = _merged(labels, more)

    rest = cut_lineage(_confirmed(_cross_pairs(_labelled(members, labels), buckets, texts, k, block, _far_apart(FINE, num / den - fine_slack)), texts, k, num, den).distinct())
    if not rest.isEmpty():
        labels = _merged(labels, rest)

    found = _join(classes.select("key", "doc"), labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = found.groupBy("label").agg(F.min("doc").alias("first"))
    answer = _join(found, least, "label").select("key", "first")
    return _join(signed.select(doc.alias("doc"), "n_shingles", "key"), answer, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("doc.id")).otherwise(F.col("first.id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100, slack: float = 0.1, fine_slack: float = 0.055, rounds: int = 1, block: int = 512) -> DataFrame:
    """Per row of ``docs``: id, ``n_shingles``, ``component_id`` (smallest id reachable by links) and ``kept``.

    Texts are linked if ``den * intersection >= num * union`` of their sets of ``k``-word shingles (A-Z lowered).
    A text of fewer words has its whole sequence as its set; a null or empty one has no set, no links, and its own id.
    Repeated rows and repeated ids are rows like others; a null id counts as larger than any (its row is kept only if
    nothing else of its component has an id; then component_id is null). Ids are whole numbers (text that holds none raises). Other columns are ignored; an empty table gives an empty one.
    """
    judged = _judged(docs, id_col, text_col, k, num, den, slack, fine_slack, rounds, block)
    return judged.select(F.col("doc.id").alias("doc_id"), "n_shingles", "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 85, den: int = 100, slack: float = 0.1, fine_slack: float = 0.055, rounds: int = 1, block: int = 512) -> DataFrame:
    """One row of ``docs`` of each component (see ``near_duplicates``): that of the smallest id, then text hash, a null id last.

    Of rows that repeat both, the one with the smallest hash of all columns stays. Rows without words belong to no component and all stay.
    """
    judged = _judged(docs, id_col, text_col, k, num, den, slack, fine_slack, rounds, block).filter("key is not null")
    kept = judged.groupBy(F.col("doc").alias("_doc")).agg(F.max(F.col("doc") == F.col("first")).alias("_kept")).filter("_kept").drop("_kept")
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    named = docs.filter(words).withColumn("_doc", F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash")))
    # rows that repeat id and text are brought to one before they are shuffled; rows without words meet nowhere
    one = _join(named, kept, "_doc").groupBy("_doc").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row"))
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.filter(~words))
