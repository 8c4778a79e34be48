"""Loose spans of personal data: which are admitted, and the estimate behind it."""

import math
import random

import numpy as np
import pytest
from llm_data import frame, prose

from segrules.llm.pii import ALL_KINDS, SAID_OF_OTHERS, SAID_OF_REAL, estimate_reliabilities, find_personal_data, train_span_classifier


def planted():
    """(doc_id, text, kind of the loose span or None, the span)."""
    rnd = random.Random(8)
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    out = []
    for i in range(0, 400, 8):
        key, token, word, value = "AKIA" + "".join(rnd.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), hexes(40), "password", hexes(18) + "a1b2"
        mail, phone = f"ann{i} [at] mail{i} [dot] org", f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
        slug = f"chapter-on-the-merchant-navy-{i + 1000}"
        for j, (kind, span, text) in enumerate(
            [
                ("secret", key, f"{prose(i, 20)} {key} {prose(i + 1, 20)}"),
                ("secret", token, f'{prose(i, 20)} token = "{token}" {prose(i + 1, 20)}'),
                ("secret", value, f"{prose(i, 20)} {word}={value} {prose(i + 1, 20)}"),
                ("email", mail, f"{prose(i, 20)} e-mail {mail} {prose(i + 1, 20)}"),
                ("phone", phone, f"{prose(i, 20)} call {phone} {prose(i + 1, 20)}"),
                (None, "", f"{prose(i, 20)} see section {slug} and {prose(i + 1, 20)}"),
                (None, "", f"version {prose(i, 20)} release {slug.replace('-', '_')}"),
                (None, "", prose(i, 60)),
            ]
        ):
            out.append((i + j, text, kind, span))
    return out


@pytest.fixture(scope="module")
def found(spark):
    rows = planted()
    got = {r["doc_id"]: r["spans"] for r in find_personal_data(frame(spark, [r[:2] for r in rows])).collect()}
    return rows, got


def test_loose_spans_are_admitted(found):
    rows, got = found
    real = [r for r in rows if r[2]]
    caught = sum([(ALL_KINDS[s["kind"]], t[s["start"] : s["end"]]) for s in got[i] if not s["base"]] == [(k, span)] for i, t, k, span in real)
    assert caught >= 0.95 * len(real)


def test_loose_spans_are_rejected(found):
    rows, got = found
    assert [(t, got[i]) for i, t, k, _ in rows if not k and got[i]] == []


def test_a_base_span_keeps_loose_ones_off(spark):
    text = "password=a1b2c3d4+12345678901 and a1b2c3d4e5f6a1b2@x.org"
    spans = find_personal_data(frame(spark, [(1, text)])).collect()[0]["spans"]
    base = [(s["start"], s["end"]) for s in spans if s["base"]]
    assert len(base) == 2
    assert all(s["base"] or all(s["end"] <= a or s["start"] >= b for a, b in base) for s in spans)


def test_reliabilities_against_a_plain_version():
    rnd = random.Random(3)
    cases = sorted({(rnd.randrange(3), *[rnd.choice((-1, 0, 1)) for _ in range(5)]) for _ in range(60)})
    counts = [rnd.randint(1, 90) for _ in cases]
    want = {}
    for kind in range(3):
        own = [(c, n) for c, n in zip(cases, counts) if c[0] == kind]
        p = {c: min(max(0.5 + 0.2 * sum(c[1:]), 0.1), 0.9) for c, _ in own}
        for _ in range(50):
            real = sum(n * p[c] for c, n in own)
            others = sum(n * (1 - p[c]) for c, n in own)
            new = {}
            for c, _n in own:
                odds = (real + 1) / (others + 1)
                for j in range(1, 6):
                    yes = SAID_OF_REAL[c[j] + 1] + sum(n * p[d] for d, n in own if d[j] == c[j])
                    no = SAID_OF_OTHERS[c[j] + 1] + sum(n * (1 - p[d]) for d, n in own if d[j] == c[j])
                    odds *= (yes / (real + 3.5)) / (no / (others + 3.5))
                new[c] = 1 / (1 + 1 / odds) if abs(math.log(odds)) < 30 else 1 / (1 + math.exp(-math.copysign(30, math.log(odds))))
            p = new
        want |= p
    got = estimate_reliabilities(np.array([c[0] for c in cases]), np.array([c[1:] for c in cases]), np.array(counts, float))
    assert np.allclose(got, [want[c] for c in cases], atol=1e-9)


def test_classifier_follows_a_trait_that_no_labeler_sees():
    x = np.array([[1.0, 0.0], [0.0, 1.0]])
    w = train_span_classifier(x, np.array([0.9, 0.1]), np.array([500.0, 500.0]))
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert abs(p[0] - 0.9) < 0.02 and abs(p[1] - 0.1) < 0.02
