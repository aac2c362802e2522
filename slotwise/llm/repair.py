"""Conversations brought to ``(s?(ua)+)?`` by the cheapest edits: bidirectional Dijkstra over the edit lattice.

A lattice node is (rows consumed, state); the state is what the repaired rows so far end with. Edges keep, rerole or delete the next row, or
insert an empty one. Forward and reverse heaps meet; all crossings of equal cost are finished, and the least joined audit wins.

Conversations are cut in blocks of at most ``BLOCK`` rows where they cross a partition or are long. A block's edits are searched for every way in and out,
and the ways are joined over blocks by their costs and ranks alone, so no task holds a long conversation's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import count, zip_longest

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.llm import storage

BLOCK = 1024
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_INSERTS = [(s, "I", INSERT, t) for s, t in _NEXT.items()]
_ENDS = (START, ASSISTANT)
#: Ways through a block: from each state to each (index 4 * entry + exit), then from each state to an end (16 + entry).
_WAYS = [(s, (t,), False) for s in range(4) for t in range(4)] + [(s, _ENDS, True) for s in range(4)]


def _moves(symbol: str) -> list[tuple[int, str, int, int]]:
    """(state, letter, cost, next state) of a row. Its symbol is its role's initial, in capitals if truncated; ``d`` must go."""
    out = [(s, "D", DELETE, s) for s in range(4)]
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        kept = _AFTER.get(symbol.lower(), {})
        out += [(s, "K", KEEP + more, t) for s, t in kept.items()] + [(s, "R", REROLE + more, t) for s, t in _NEXT.items() if kept.get(s) != t]
    return out


_MOVES = {c: _moves(c) for c in "dsuaxSUAX"}
_OUT = {c: [[m for m in moves if m[0] == s] for s in range(4)] for c, moves in _MOVES.items()}
_IN = {c: [[m for m in moves if m[3] == t] for t in range(4)] for c, moves in _MOVES.items()}


class _Side:
    """One heap with what it has settled. Nodes of equal cost are settled in the direction of travel, so every label of that cost has been seen by then."""

    def __init__(self, starts: Iterable[tuple[int, int]], way: int) -> None:
        self.way, self.heap, self.best, self.settled = way, [], {}, {}
        for node in starts:
            self.offer(node, 0, "")

    def offer(self, node: tuple[int, int], cost: int, label: str) -> None:
        have = self.best.get(node)
        if have is None or (cost, label) < have:
            self.best[node] = (cost, label)
            if have is None or cost < have[0]:
                heappush(self.heap, (cost, self.way * node[0], node[1]))

    def top(self) -> float:
        while self.heap and (self.way * self.heap[0][1], self.heap[0][2]) in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, int]:
        _, i, s = heappop(self.heap)
        node = (self.way * i, s)
        self.settled[node] = self.best[node]
        return node


def search(symbols: str, entry: int = START, exits: tuple[int, ...] = _ENDS, last: bool = True) -> tuple[int, str] | None:
    """(cost, least audit) of the cheapest edits of ``symbols`` from state ``entry`` to one of ``exits``; rows may be inserted behind the last symbol only if ``last``."""
    n = len(symbols)

    def leaving(i: int, s: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
        if i < n:
            yield from ((letter, cost, (i + 1, t)) for _, letter, cost, t in _OUT[symbols[i]][s])
        if i < n or last:
            yield from ((letter, cost, (i, t)) for a, letter, cost, t in _INSERTS if a == s)

    def entering(j: int, t: int) -> Iterator[tuple[str, int, tuple[int, int]]]:
        if j:
            yield from ((letter, cost, (j - 1, s)) for s, letter, cost, _ in _IN[symbols[j - 1]][t])
        if j < n or last:
            yield from ((letter, cost, (j, s)) for s, letter, cost, b in _INSERTS if b == t)

    ahead, back, least = _Side([(0, entry)], 1), _Side([(n, e) for e in exits], -1), float("inf")
    while True:
        a, b = ahead.top(), back.top()
        if min(a, b) == float("inf") or sum(c for c in (a, b) if c < float("inf")) > least:  # an empty heap has settled all it can reach
            break
        here, there, edges = (ahead, back, leaving) if a <= b else (back, ahead, entering)
        node = here.settle()
        cost, label = here.settled[node]
        if node in there.settled:
            least = min(least, cost + there.settled[node][0])
        for letter, more, other in edges(*node):
            here.offer(other, cost + more, label + letter if here is ahead else letter + label)
            if other in there.settled:
                least = min(least, cost + more + there.settled[other][0])
    audits = []
    for node, (cost, label) in ahead.settled.items():
        if node in back.settled and cost + back.settled[node][0] == least:
            audits.append(label + back.settled[node][1])
        audits += [label + letter + back.settled[other][1] for letter, more, other in leaving(*node) if other in back.settled and cost + more + back.settled[other][0] == least]
    return (int(least), min(audits)) if audits else None


_short = lru_cache(maxsize=1 << 14)(search)


def _solve(symbols: str, *way: object) -> tuple[int, str] | None:
    return (_short if len(symbols) <= 48 else search)(symbols, *way)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of a conversation table, damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (``here`` is false), 1 empties it, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls of the key, role and text are one space."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kinds = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("kind"))
    return kinds.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("here"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


_STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}
_ORDER = [F.asc_nulls_first, F.asc, F.asc]


def _order() -> list[Column]:
    return [way(c) for way, c in zip(_ORDER, ("turn", "role", "digest"), strict=True)]


def _coded(turns: DataFrame) -> DataFrame:
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    coded = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.unhex(F.md5(text)).alias("digest"), "here", text.alias("text"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return coded.withColumn("fault", F.when(blank, 1).when(cut, 2).otherwise(0))


def _row_kinds(coded: DataFrame) -> DataFrame:
    """One row of each (conversation, turn, role, digest) with its number of copies ``n`` and whether its role and text were ``seen`` at an earlier turn. Copies are counted before the shuffle, and rows meet on digests, so neither a hot conversation nor a hot text gathers in a task."""
    kinds = coded.groupBy("conv_id", "turn", "role", "digest", "here", "fault").agg(F.count("*").alias("n"))
    many = kinds.filter("here and fault <> 1").groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("first"), F.count("turn").alias("placed"), F.count("*").alias("turns")).filter("turns > 1")
    many = many.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first", (F.col("placed") < F.col("turns")).alias("null_first"))
    met = kinds.join(many, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    return met.select(*kinds.columns, (F.col("turn").isNotNull() & F.coalesce(F.col("null_first") | (F.col("first") < F.col("turn")), F.lit(False))).alias("seen"))


class _Run:
    """What is known of a run of rows of one conversation."""

    def __init__(self, first: str = "", last: str = "") -> None:
        self.symbols: list[str] = []
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first, self.last = first, last

    def follow(self, initial: str, times: int = 1) -> None:
        if self.last:
            self.illegal += self.last + initial not in _LEGAL
        self.illegal += times - 1  # a role beside itself is never legal
        self.first, self.last = self.first or initial, initial

    def add(self, turn: int | None, initial: str, fault: int, seen: bool, n: int, more: bool) -> None:
        """``n`` copies of a row; ``more`` if copies of it went to the block before."""
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        self.follow(initial, n)
        fresh = fault != 1 and not seen and not more
        self.blank += n if fault == 1 else 0
        self.duplicate += n - fresh if fault != 1 else 0
        self.truncated += fresh and fault == 2
        self.symbols += [initial.upper() if fault == 2 else initial] * fresh + ["d"] * (n - fresh)


_BLOCK_SCHEMA = "conv_id {}, part int, seq long, complete boolean, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>, audits array<string>"


def _blocks(batches: Iterable[pa.RecordBatch], schema: pa.Schema, block: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of the sorted partition, at most ``block`` long. A conversation that neither begins nor ends the partition and fits one block is complete."""
    part, made, seq = TaskContext.get().partitionId(), [], count()
    begun, conv, run, opened, blocks = False, None, _Run(), True, 0

    def close(ended: bool) -> None:
        nonlocal blocks
        complete = ended and not opened and blocks == 0
        symbols = "".join(run.symbols)
        found = [_solve(symbols)] if complete else [_solve(symbols, *way) for way in _WAYS]
        row = (conv, part, next(seq), complete, run.low, run.high, run.distinct, run.blank, run.duplicate, run.truncated, run.illegal, run.first, run.last, [f and f[0] for f in found], [f and f[1] for f in found])
        made.append(dict(zip(schema.names, row, strict=True)))
        blocks += 1

    for batch in batches:
        for own, turn, initial, fault, seen, n, here in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "seen", "n", "here")], strict=True):
            if not begun or own != conv:
                if begun:
                    close(ended=True)
                    opened = False
                begun, conv, run, blocks = True, own, _Run(), 0
            more = False
            while here and n:
                if len(run.symbols) == block:
                    close(ended=False)
                    run = _Run()
                take = min(n, block - len(run.symbols))
                run.add(turn, initial, fault, seen, take, more)
                n, more = n - take, True
        if len(made) >= 2000:
            yield pa.RecordBatch.from_pylist(made, schema)
            made.clear()
    if begun:
        close(ended=False)
    if made:
        yield pa.RecordBatch.from_pylist(made, schema)


def _joined(blocks: pa.Table) -> list[dict]:
    """The way taken through each block of a conversation, from costs and ranks; the first row carries the conversation's counts."""
    rows = sorted(blocks.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    ahead, ways = {s: rows[-1]["costs"][16 + s] for s in range(4)}, []
    for row in reversed(rows[:-1]):
        options = {s: [(row["costs"][4 * s + e] + ahead[e], row["ranks"][4 * s + e], e) for e in range(4) if row["costs"][4 * s + e] is not None and ahead[e] is not None] for s in range(4)}
        best = {s: min(found) for s, found in options.items() if found}
        ways.append({s: e for s, (_, _, e) in best.items()})
        ahead = {s: best[s][0] if s in best else None for s in range(4)}
    state, whole, out = START, _Run(), []
    for row, way in zip_longest(rows, reversed(ways)):
        pick = 16 + state if way is None else 4 * state + way[state]
        state = state if way is None else way[state]
        out.append({"conv_id": row["conv_id"], "part": row["part"], "seq": row["seq"], "pick": pick})
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(whole, name, getattr(whole, name) + row[name])
        if row["first"]:
            whole.follow(row["first"])
            whole.last = row["last"]
        if row["low"] is not None:
            whole.distinct += row["distinct"] - (row["low"] == whole.high)
            whole.low, whole.high = row["low"] if whole.low is None else whole.low, row["high"]
    gaps = whole.high - whole.low + 1 - whole.distinct if whole.low is not None else 0
    counts = {"gaps": gaps, "blank": whole.blank, "duplicate": whole.duplicate, "truncated": whole.truncated, "illegal": whole.illegal, "cost": ahead[START]}
    return [row | (counts if i == 0 else dict.fromkeys(counts)) for i, row in enumerate(out)]


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Counts, cost and audit of each conversation (one row each, also where no row is ``here``): gaps, blank, duplicate, truncated, illegal, cost, audit.

    ``turns`` has conv_id (any orderable type), turn, role, text and perhaps ``here`` (false: the row is gone, its conversation still counts); other columns are
    ignored. Rows are taken by turn (nulls first), ties by role, then by the MD5 of the text; equal rows are repeats. Null roles and texts are one space, so a null text is
    blank. A null conv_id is a conversation of its own. A conversation without rows has zeros and an empty audit; an empty table gives an empty one. Texts are read whole,
    once, and only digests of them are sorted.
    """
    if "here" not in turns.columns:
        turns = turns.withColumn("here", F.lit(True))
    return _repair(_coded(turns), block)


def _repair(coded: DataFrame, block: int) -> DataFrame:
    initial = F.substring("role", 1, 1)
    light = _row_kinds(coded.drop("text")).withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("x"))
    ordered = light.repartitionByRange("conv_id", *_order()).sortWithinPartitions("conv_id", *_order())
    kind = coded.schema["conv_id"].dataType.simpleString()
    schema = _BLOCK_SCHEMA.format(kind)
    shape = _arrow(coded.sparkSession, schema)
    blocks = storage.cut_lineage(ordered.select("conv_id", "turn", "initial", "fault", "seen", "n", "here").mapInArrow(lambda batches: _blocks(batches, shape, block), schema))

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    done = blocks.filter("complete").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    rest = blocks.filter("not complete")
    ranks = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter(F.slice("audits", F.floor(i / 4).cast("int") * 4 + 1, 4), lambda a: a < F.element_at("audits", i + 1))))
    picks_schema = f"conv_id {kind}, part int, seq long, pick int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    picks_shape = _arrow(coded.sparkSession, picks_schema)
    picks = rest.withColumn("ranks", ranks).drop("audits", "complete").groupBy("conv_id").applyInArrow(lambda t: pa.Table.from_pylist(_joined(t), picks_shape), picks_schema)
    chosen = picks.join(rest.select("part", "seq", "audits"), ["part", "seq"]).withColumn("one", F.element_at("audits", F.col("pick") + 1))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "seq", "one"))), lambda p: p["one"])
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return done.unionByName(chosen.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in names], F.array_join(pieces, "").alias("audit")))


def _arrow(spark: object, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _with_audits(turns: DataFrame, block: int) -> tuple[DataFrame, str]:
    """Rows of each conversation behind its audit, in order, each conversation in one partition: the head row (``head``) has the counts, the others role and text. Sorting may spill; nothing is gathered."""
    if "here" not in turns.columns:
        turns = turns.withColumn("here", F.lit(True))
    coded = _coded(turns)
    heads = _repair(coded, block).withColumn("head", F.lit(True))
    rows = coded.filter("here").select("conv_id", "turn", "role", "digest", "text").withColumn("head", F.lit(False))
    both = heads.unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *_order()), coded.schema["conv_id"].dataType.simpleString()


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, None, counts) at each head, then (conversation, letter, turn, role, text) of each repaired row, in order."""
    conv, audit, at, state = None, "", 0, START

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield conv, "I", None, "user" if state == USER else "assistant", ""

    for batch in batches:
        columns = batch.to_pydict()
        counts = list(zip(*[columns[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], strict=True))
        for i, head in enumerate(columns["head"]):
            if head:
                yield from inserts()
                conv, audit, at, state = columns["conv_id"][i], columns["audit"][i], 0, START
                yield conv, None, counts[i]
                continue
            yield from inserts()
            letter, role = audit[at], columns["role"][i]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                state = _NEXT[state]
                role = "user" if state == USER else "assistant"
            else:
                state = _AFTER[role[0]][state]
            yield conv, letter, columns["turn"][i], role, columns["text"][i]
    yield from inserts()


def repaired_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired rows: conv_id, position (from 0), edit (K, R or I), turn (null if inserted), role, text. See ``repair`` for order and nulls; a null text that stays is one space."""
    ordered, kind = _with_audits(turns, block)
    schema = f"conv_id {kind}, position long, edit string, turn long, role string, text string"
    shape = _arrow(turns.sparkSession, schema)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size, position = [], 0, 0
        for found in _walk(batches):
            if found[1] is None:
                position = 0
                continue
            made.append(dict(zip(shape.names, (found[0], position, *found[1:]), strict=True)))
            position, size = position + 1, size + len(found[4])
            if len(made) >= 4000 or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(made, shape)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, shape)

    return ordered.mapInArrow(rows, schema)


def repair_digests(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``repair`` with ``repaired_sha256``: of the repaired rows as ``role:text``, joined by newlines, hashed as they stream by."""
    ordered, kind = _with_audits(turns, block)
    schema = f"conv_id {kind}, {_STATS}, repaired_sha256 string"
    shape = _arrow(turns.sparkSession, schema)

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, head, sha, empty = [], None, hashlib.sha256(), True
        for found in _walk(batches):
            if found[1] is None:
                if head:
                    made.append(dict(zip(shape.names, (*head, sha.hexdigest()), strict=True)))
                head, sha, empty = (found[0], *found[2]), hashlib.sha256(), True
                if len(made) >= 4000:
                    yield pa.RecordBatch.from_pylist(made, shape)
                    made = []
                continue
            sha.update(f"{'' if empty else chr(10)}{found[3]}:{found[4]}".encode())
            empty = False
        if head:
            made.append(dict(zip(shape.names, (*head, sha.hexdigest()), strict=True)))
        if made:
            yield pa.RecordBatch.from_pylist(made, shape)

    return ordered.mapInArrow(digests, schema)
