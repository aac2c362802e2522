"""Personal data against plain patterns, planted cases and hostile texts."""

from __future__ import annotations

import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from slotwise.llm import pii, queries

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(text: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(text)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _plain(text: str | None) -> list[str]:
    """The base rule as it is written: plain patterns, then checks."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def _base(text: str) -> list[str]:
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in pii.spans_of(text) if s["base"]]


@settings(max_examples=600, deadline=None)
@given(st.text("a.@-1 2+9()_é:%", max_size=40))
def test_base_spans_as_plain_patterns(text):
    assert _base(text) == _plain(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4785380592391140", "-", " ", "1.2.3.4", "255.256.1.1", ".", "a@b.co", "_d@e.f", "+1 (743) 555-3824", "+49 30 1234567", "007", "é", "(", "+"]), max_size=12))
def test_base_spans_of_joined_pieces(parts):
    assert _base("".join(parts)) == _plain("".join(parts))


def test_method_adds_and_keeps():
    found = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in pii.spans_of(t)]
    assert found("IBAN DE89 3704 0044 0532 0130 00 OF ANNA") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("ID99 GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert found("GB82WEST12345698765431") == []
    assert found("4111111111111111 4012888888881881") == [("card", "4111111111111111"), ("card", "4012888888881881")]
    assert found("anna.b [at] mail [dot] example.com") == [("email", "anna.b [at] mail [dot] example.com")]
    assert found("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert found("200 300 4000") == [] and found("tel 200 300 4000") == [("phone", "200 300 4000")]
    assert found("743-555-3824") == [("phone", "743-555-3824")]
    assert found("ssn 536-22-8741") == [("ssn", "536-22-8741")]
    assert found("part 536-22-8741") == []
    assert found("at 2001:db8::ff00:42:8329.") == [("ipv6", "2001:db8::ff00:42:8329")]
    assert found("std::vec at 12:30:45 fa::") == []
    assert found("+1 (743) 555-3824") == [("phone", "+1 (743) 555-3824")]


def test_context_moves_scores():
    near, far, against = (pii.spans_of(t)[0]["score"] for t in ("my card 4111111111111111", "4111111111111111", "order 4111111111111111"))
    assert near > far > against
    assert pii.spans_of("visa " + "x" * 60 + " 4111111111111111")[0]["score"] == far


def test_long_texts_take_linear_time():
    n = 1_000_000
    for text in ("a" * n, "1" * n, "1." * (n // 2), "a@" * (n // 2), "+1" + ")" * n, ":" * n, "AB12" * (n // 4), "1 " * (n // 2), "(at)" * (n // 4), "a." * (n // 2) + "@", "." * n, "+" * n):
        began = time.perf_counter()
        pii.spans_of(text)
        assert time.perf_counter() - began < 8, text[:10]


def test_find_and_redact_rows(spark):
    rows = [(1, "mail a@b.co", "x"), (1, "mail a@b.co", "x"), (None, "é 1.2.3.4", "y"), (2, None, None), (3, "", "z"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string")
    got = sorted(map(str, ((r.doc_id, r.text, [(s.kind, s.start, s.end, s.base) for s in r.pii]) for r in pii.find_pii(docs).collect())))
    want = [(1, "mail a@b.co", [("email", 5, 11, True)])] * 2 + [(None, "é 1.2.3.4", [("ip", 2, 9, True)]), (2, None, []), (3, "", []), (None, None, [])]
    assert got == sorted(map(str, want))
    assert sorted(str(r.text) for r in pii.redact(docs).collect()) == sorted(["mail [EMAIL]"] * 2 + ["é [IP]", "None", "", "None"])
    assert pii.find_pii(docs.filter("false")).collect() == []
    touching = spark.createDataFrame([("x 4111111111111111@b.co y",)], "text string")
    assert pii.redact(touching).first().text == "x [EMAIL] y"


def test_query_against_plain_rule(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op11_pii(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = _plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone")]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert sum(r.n_email for r in rows) and sum(r.n_card for r in rows)


def test_random_bytes_have_ordered_spans():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["12", "4111111111111111", "@", "a.b", " ", "+1 743 555 3824", "(743) 555-3824", "DE89370400440532013000", "-", "::1"]) for _ in range(30))
        spans = pii.spans_of(text)
        added = [s for s in spans if not s["base"]]
        assert all(s["end"] <= o["start"] or o["end"] <= s["start"] for s in added for o in spans if o is not s)
