"""License scans against a plain Python scan with the same model, and odd inputs."""

from __future__ import annotations

import re

import numpy as np
import pytest

from slotwise.llm import license_scan as L

MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction'
TEXTS = [
    "words here\nReleased under the MIT License.\nmore", "All rights reserved.", None, "", "nothing at all", "the general public of this work", f"Intro text.\n{MIT}\n\nother line here",
    "Permission to use, copy, modify, and distribute this software for any purpose\nwith or without fee is hereby granted", "Boost Software License - Version 1.0", "All rights reserved.\nReleased under CC0 1.0 Universal.",
    "Licensed under the EUPL, Version 1.2", "licencia de obras\n\n \nüber die Lizenz\n", "He got his driving license in May.", "licensed", "Licensed under CC BY-SA 4.0." + " word" * 3000, "All rights reserved.\n" * 400,
    "\n\n" + "\n".join(t for f in L.TEMPLATES for t in L.TEMPLATES[f]), "A licence\nof the software\nof\n\nthe software",
]


def scan(text, m):
    """(first line, family, probability, similarity) of each licence paragraph, one by one."""
    cue = re.compile("|".join(L.CUES), re.I | re.A)
    units, last = [], None
    for i, line in enumerate((text or "").split("\n")):
        words = L.words_of(line)
        cued = bool(cue.search(line))
        if cued or (words and sum(w in m.words for w in words) >= L.CONTINUES * len(words)):
            if last is None or last[0] + 1 != i or re.search(r"[.!?]\s*$", last[1]):
                units.append([])
            units[-1].append((i, line, cued))
            last = (i, line)
    for unit in units:
        words = L.words_of("\n".join(x[1] for x in unit))
        if any(x[2] for x in unit) and words:
            grams = L.grams_of(words)
            s = m.bias.astype(float) + m.strange(words) * m.strange_weight.astype(float) + sum((m.weights[m.place[g]].astype(float) for g in grams if g in m.place), np.zeros(len(m.bias)))
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            best = int(p[:-2].argmax())
            if 1 - p[-1] > 0.5:
                if p[best] >= m.cut:
                    share = max(len(grams & own) / len(own) for own in (L.grams_of(L.words_of(t)) for t in m.templates[m.families[best]]))
                    yield unit[0][0], m.families[best], p[best], share
                else:
                    yield unit[0][0], L.UNKNOWN, 1 - p[-1], 0.0


def test_same_as_plain_scan(spark):
    m = L.default_model()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, TEXTS[0]])] + [(None, "All rights reserved.", "x")], "doc_id long, text string, family string").repartition(3)
    got = sorted((str(r.doc_id), r.paragraph, r.family, r.confirmed, round(r.probability, 5), round(r.similarity, 5)) for r in L.scan_licenses(docs).collect())
    want = sorted((str(i), at, family, share >= 0.5, round(p, 5), round(share, 5)) for i, t in [*enumerate([*TEXTS, TEXTS[0]]), (None, "All rights reserved.")] for at, family, p, share in scan(t, m))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(g[4:] == pytest.approx(w[4:], abs=1e-4) for g, w in zip(got, want, strict=True))


def test_families_and_unknown(spark):
    rows = L.scan_licenses(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert found[0] == [(1, "mit")] and found[1] == [(0, "proprietary")] and found[6] == [(1, "mit")]  # the last over three lines
    assert {f for i in (7, 8, 10) for _, f in found[i]} == {L.UNKNOWN}
    assert sorted(found[9]) == [(0, "proprietary"), (1, "public-domain")]
    assert not {2, 3, 4, 5, 11, 12} & found.keys()
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_family_left_out_is_not_believed():
    """Texts of families that training never saw are taken for a family in few cases."""
    wrong = total = 0
    for own in ("apache", "bsd", "gpl", "mpl"):
        m = L.LicenseModel({f: t for f, t in L.TEMPLATES.items() if f != own})
        for t in L.TEMPLATES[own]:
            words = L.words_of(t)
            s = m.bias + m.strange(words) * m.strange_weight + sum((m.weights[m.place[g]] for g in L.grams_of(words) if g in m.place), np.zeros(len(m.bias)))
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            wrong += p[:-2].max() >= m.cut
            total += 1
    assert wrong / total < 0.5
