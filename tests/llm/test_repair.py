"""Conversation repair against all edits, against plain Python, and over blocks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm import queries, repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(symbols: str) -> tuple[int, str]:
    """By relaxing every node of the lattice until nothing changes; labels are whole audits."""
    best = {(0, ""): (0, "")}
    while True:
        new = dict(best)
        for (i, state), (cost, audit) in best.items():
            steps = [((i, NEXT[state]), 5, "I")]
            if i < len(symbols):
                c = symbols[i]
                steps.append(((i + 1, state), 2, "D"))
                if c != "d":
                    more = 5 if c.isupper() else 0
                    if c.lower() == "s" and state == "" or c.lower() in "ua" and NEXT[state] == c.lower():
                        steps.append(((i + 1, c.lower()), more, "K"))
                    steps.append(((i + 1, NEXT[state]), more + 1, "R"))
            for node, more, letter in steps:
                if cost + more <= 2 * len(symbols) and new.get(node, (9e9, "")) > (cost + more, audit + letter):
                    new[node] = (cost + more, audit + letter)
        if new == best:
            return min(v for (i, s), v in best.items() if i == len(symbols) and s in ("", "a"))
        best = new


@settings(max_examples=500, deadline=None)
@given(st.text("dsuaxSUAX", max_size=9))
def test_search_is_cheapest_and_least(symbols):
    assert repair.search(symbols) == cheapest(symbols)


def plain(rows: list[tuple]) -> dict:
    """The contract for damaged rows (turn, role, text) of one conversation."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    seen, symbols, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        symbols += "d" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    initials = [r[:1] for _, r, _ in rows]
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = cheapest(symbols)
    out, state, it = [], "", iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(it)
        if letter == "D":
            continue
        state = row[1][0] if letter == "K" else NEXT[state]
        name = row[1] if letter == "K" else {"u": "user", "a": "assistant"}[state]
        out.append(f"{name}:{row[2] if row else ''}")
    return counts | {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def plain_damage(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _check(got: list, want: dict) -> None:
    assert len(got) == len(want)
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "conv_id"} == plain(want[r.conv_id]), r


SCHEMA = "conv_id long, turn long, role string, text string, audit string, here string"


def _random(n: int, seed: int, convs: list) -> list[tuple]:
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "uncle"], ["Yes.", "No!", "what?\n", "cut off", "", " \t", "Ok.", "été?", None, "a.\x0b", "x" * 3000 + "."]
    return [(rng.choice(convs), rng.choice([None, *range(-2, 30)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_rows_against_plain(spark):
    rows = _random(600, 7, [None, *range(60)])
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).drop("here").repartition(5)
    want: dict = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, role, text))
    _check(repair.repair_digests(turns.select("conv_id", "turn", "role", "text")).collect(), want)


def test_damage_and_clashing_columns(spark):
    rows = _random(400, 8, [None, *range(40)])
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    _check(repair.repair_digests(repair.damaged(turns)).collect(), plain_damage(rows))
    assert repair.repair_digests(repair.damaged(turns.filter("false"))).collect() == []


def test_long_conversation_over_blocks(spark):
    """A conversation with half of all rows, cut in blocks of seven rows over many partitions, and many copies of one row."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b!", "cut", "", f"{t}?", f"{t}.", f"{t}!"])) for t in range(160)] + [(1, 40, "user", "same.")] * 25 + [(2, None, "user", "Hi.")] * 30 + _random(60, 9, [3, 4, 5])
    want: dict = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, role, text))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check(repair.repair_digests(turns, block=7).collect(), want)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_repaired_rows_alternate(spark):
    turns = spark.createDataFrame([("a", 0, "assistant", "One."), ("a", 1, "assistant", "Two."), ("a", 5, "user", None), ("b", 0, "system", "S."), ("b", 1, "user", "U?"), ("b", 2, "assistant", "A!")], "conv_id string, turn int, role string, text string")
    got = sorted((r.conv_id, r.position, r.edit, r.turn, r.role, r.text) for r in repair.repaired_turns(turns).collect())
    assert got == [("a", 0, "R", 0, "user", "One."), ("a", 1, "K", 1, "assistant", "Two."), ("b", 0, "K", 0, "system", "S."), ("b", 1, "K", 1, "user", "U?"), ("b", 2, "K", 2, "assistant", "A!")]
    stats = {r.conv_id: (r.gaps, r.blank, r.illegal, r.cost, r.audit) for r in repair.repair(turns).collect()}
    assert stats == {"a": (3, 1, 1, 3, "RKD"), "b": (0, 0, 0, 0, "KKK")}


def test_query_against_plain(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    _check(queries.op12_conversation_repair(spark, folder).collect(), plain_damage(rows))


def test_sql_twin_of_odd_rows(spark, tmp_path):
    """Nulls, repeats, odd roles and conversations that lose all rows, in Spark, SQL and plain Python."""
    import duckdb

    rows = _random(500, 12, [None, *range(70)]) + [(1000 + i, 0, "user", "Hi.") for i in range(40)]
    spark.createDataFrame([r for r in rows], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(queries.oracle_sql()["op12_conversation_repair"])
    got = queries.op12_conversation_repair(spark, str(tmp_path))
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
    assert any(r.audit == "" and r.cost == 0 for r in got.collect())
    _check(got.collect(), plain_damage(rows))
