"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score.

Every scan is linear in the text, whatever it holds: runs are taken whole and cut afterwards, so no pattern is tried again within a run that failed.
Positions are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]

# Lengths of International Bank Account Numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_CAPITALS = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HEX = "0123456789ABCDEFabcdef:."
_HEX_RUN = re.compile(r"[0-9A-Fa-f:.]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_SPELLED = re.compile(r"[ ]?[\[(]at[\])][ ]?([A-Za-z0-9-]++(?:(?:\.|[ ]?[\[(]dot[\])][ ]?)[A-Za-z0-9-]++)+)", re.I)
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\(([2-9][0-9]{2})\)[ ]?|([2-9][0-9]{2})[-. ])([2-9][0-9]{2})[-. ]([0-9]{4})(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?=[ ]?[0-9A-Z])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number (no spaces) passes the mod-97 check."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _plain(text: str, start: int, end: int) -> str:
    return re.sub("[^0-9A-Za-z]", "", text[start:end])


def emails(text: str) -> Iterator[Span]:
    last = seen = 0
    at = text.find("@")
    while at >= 0:
        if at >= last:
            head = text[seen:at]
            start = seen + len(head.rstrip(_LOCAL))
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            seen = at + 1
            if domain:
                last = seen = domain.end()
                yield start, last
        at = text.find("@", at + 1)


def spelled_emails(text: str) -> Iterator[Span]:
    """name (at) domain (dot) com"""
    last = 0
    for m in _SPELLED.finditer(text):
        head = text[last : m.start()]
        start = last + len(head.rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
        last = m.end()


def addresses(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(_small, four)):
                yield at, end
            at = end + 1


def long_addresses(text: str) -> Iterator[Span]:
    """IPv6 with three groups or more, not inside a longer word."""
    last = 0
    for m in _COLONS.finditer(text):
        if m.start() < last:
            continue
        start = last + len(text[last : m.start()].rstrip(_HEX))
        last = _HEX_RUN.match(text, m.start()).end()
        found = text[start:last].rstrip(".")
        if found.endswith(":") and not found.endswith("::"):
            found = found[:-1]
        end = start + len(found)
        if len(found) <= 45 and sum(1 for g in found.split(":") if g) >= 3 and not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()):
            try:
                IPv6Address(found)
            except ValueError:
                continue
            yield start, end


def cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        digits = _plain(text, *m.span()) if m.end() - m.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def cards_in_runs(text: str) -> Iterator[Span]:
    """Cards written beside other numbers: whole groups of a run, as 13 to 19 digits in one or as 4-4-4-4 or 4-6-5, with an issuer's first digit."""
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 14:
            continue
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m.group())]
        at = 0
        while at < len(groups):
            sizes = [b - a for a, b in groups[at : at + 4]]
            take = 1 if 13 <= sizes[0] <= 19 else 4 if sizes == [4, 4, 4, 4] else 3 if sizes[:3] == [4, 6, 5] else 0
            start, end = groups[at][0], groups[at + max(take, 1) - 1][1]
            if take and text[start] in "23456" and luhn(_plain(text, start, end)):
                yield start, end
                at += take
            else:
                at += 1


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if m.end() - m.start() < 10:
            continue
        if 9 <= sum(m.group().count(d) for d in "0123456789") <= 15:
            yield m.span()


def national_phones(text: str) -> Iterator[Span]:
    """(234) 567-8901 or 234-567-8901"""
    return (m.span() for m in _NATIONAL.finditer(text) if m[1] or " " not in m.group())


def spaced_phones(text: str) -> Iterator[Span]:
    """234 567 8901, which may be any three numbers, so words nearby must speak of a telephone."""
    return (m.span() for m in _NATIONAL.finditer(text) if not m[1] and " " in m.group())


def social_numbers(text: str) -> Iterator[Span]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def accounts(text: str) -> Iterator[Span]:
    """IBANs of their country's length that pass mod 97, whatever capital words follow."""
    last = 0
    for m in _IBAN.finditer(text):
        size, account, at = IBAN_LENGTHS.get(m.group()[:2], 0), m.group(), m.end()
        while len(account) < size:
            at += text[at : at + 1] == " "
            if text[at : at + 1] not in _CAPITALS:
                break
            account += text[at]
            at += 1
        after = text[at : at + 1]
        if m.start() >= last and len(account) == size and not (after.isascii() and after.isalnum()) and mod97(account):
            last = at
            yield m.start(), at


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``base`` spans stay whatever their score; others need the threshold and must not touch a span kept before."""

    name: str
    propose: Callable[[str], Iterator[Span]]
    score: float
    near: frozenset[str] = frozenset()
    against: frozenset[str] = frozenset()
    base: bool = False


_TEL = frozenset("phone telephone tel call mobile cell fax whatsapp sms telefon handy anruf appel mobil telefono teléfono móvil llamar téléphone portable".split())
_CARD = frozenset("card credit visa mastercard amex debit payment karte kreditkarte carte tarjeta pay".split())
_MAIL = frozenset("mail email contact write e-mail correo courriel kontakt".split())
_NET = frozenset("ip host address server client login ssh".split())
_BANK = frozenset("iban bank account konto compte cuenta transfer".split())
_ID = frozenset("ssn social security taxpayer".split())
_NUMBER = frozenset("order part invoice serial isbn issn version model item sku article ticket".split())

#: Base kinds first; the order is that of the spans of a text.
KINDS = (
    Kind("email", emails, 0.9, _MAIL, base=True),
    Kind("ip", addresses, 0.6, _NET, frozenset({"version", "section", "chapter", "release"}), base=True),
    Kind("card", cards, 0.8, _CARD, _NUMBER, base=True),
    Kind("phone", phones, 0.8, _TEL, _NUMBER, base=True),
    Kind("iban", accounts, 0.9, _BANK),
    Kind("ssn", social_numbers, 0.5, _ID, _NUMBER),
    Kind("card", cards_in_runs, 0.6, _CARD, _NUMBER),
    Kind("email", spelled_emails, 0.6, _MAIL),
    Kind("phone", national_phones, 0.5, _TEL, _NUMBER),
    Kind("phone", spaced_phones, 0.3, _TEL, _NUMBER),
    Kind("ipv6", long_addresses, 0.6, _NET),
)
SPANS = "array<struct<kind string, start int, end int, score double, base boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def _score(kind: Kind, text: str, start: int, end: int, window: int) -> float:
    around = {w.lower() for w in _WORD.findall(text[max(0, start - window) : start]) + _WORD.findall(text[end : end + window // 2])}
    score = kind.score + (0.3 if around & kind.near else 0) - (0.3 if around & kind.against else 0)
    return round(min(1.0, max(0.0, score)), 3)


def spans_of(text: str, kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.5, window: int = 48) -> list[dict]:
    """All spans of one text, by kind in the order of ``kinds``, then by start. The rule in plain Python; ``find_pii`` applies it in Spark."""
    kept: list[dict] = []
    taken: list[Span] = []
    for kind in kinds:
        found = []
        for start, end in kind.propose(text):
            score = _score(kind, text, start, end, window)
            if kind.base or (score >= threshold and not _touches(taken, start, end)):
                found.append({"kind": kind.name, "start": start, "end": end, "score": score, "base": kind.base})
        if found:
            kept += found
            taken = _merged(taken + [(s["start"], s["end"]) for s in found])
    order = {name: i for i, name in reversed(list(enumerate(k.name for k in kinds)))}
    return sorted(kept, key=lambda s: (order[s["kind"]], s["start"]))


def _merged(spans: list[Span]) -> list[Span]:
    """The union of spans, as disjoint spans in order."""
    out: list[Span] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _touches(taken: list[Span], start: int, end: int) -> bool:
    """Whether a span overlaps one of disjoint ordered spans."""
    at = bisect_left(taken, (end,))
    return at > 0 and taken[at - 1][1] > start


def _finder(kinds: tuple[Kind, ...], threshold: float, window: int) -> Callable[[Column], Column]:
    @F.arrow_udf(returnType=SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([spans_of(t, kinds, threshold, window) if t else [] for t in texts.to_pylist()], _SPAN_TYPE)

    return find


def find_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.5, window: int = 48) -> DataFrame:
    """Each row with ``pii``: its spans (kind, start, end, score, base), by kind as in ``kinds``, then by start; end is exclusive, both are code points.

    Base kinds stay as their pattern and checksum say; the words within ``window`` code points before and half as many behind move their score only. Other kinds
    need ``threshold`` and must not overlap a span of a kind listed before them. A null or empty text has no spans; texts are read whole, in one pass a kind, however
    long. Rows are judged one by one, without a shuffle, so repeated rows and null ids need nothing special, and an empty table stays empty. Other columns pass
    through; a column named ``pii`` is replaced.
    """
    return docs.withColumn("pii", _finder(kinds, threshold, window)(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text", **options: object) -> DataFrame:
    """``find_pii``, with every span replaced by its kind in capitals and brackets; of overlapping spans the first to start names all. A null text stays null."""
    found = find_pii(docs, text_col, **options)

    @F.arrow_udf(returnType="string")
    def hide(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            if not own:
                out.append(text)
                continue
            parts, last, open_until = [], 0, 0
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= open_until:
                    parts += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
                last = open_until = max(open_until, s["end"])
            out.append("".join(parts) + text[last:])
        return pa.array(out, pa.string())

    return found.withColumn(text_col, hide(F.col(text_col), F.col("pii")))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
