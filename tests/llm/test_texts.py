"""Personal data, line dedup, decontamination and near-duplicates against brute force."""

import re

import pytest

from llm_data import PASSAGE, by_row, frame, odd_rows, ordered
from segrules.llm.decontam import contamination
from segrules.llm.line_dedup import dedup_lines
from segrules.llm.near_dup import connected_components, near_duplicates
from segrules.llm.pii import KINDS, find_personal_data

# The contract's patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(values)) % 10 == 0


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text or "") if valid(k, m.group())]


def test_personal_data(spark):
    rows = odd_rows()
    got = [
        (r["doc_id"], str([(KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"] if s["base"]]), sum(not s["base"] for s in r["spans"]))
        for r in find_personal_data(frame(spark, rows)).collect()
    ]
    assert ordered(g[:2] for g in got) == ordered((i, str(base_spans(t))) for i, t in rows)
    assert all(n == 0 for i, _, n in got if i not in (16,))
    assert find_personal_data(frame(spark, [])).collect() == []


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    docs = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        hot = [len(key(x)) >= 40 and len(docs[key(x)]) >= 5 and i != max(docs[key(x)], key=lambda d: -1 if d is None else d) for x in lines]
        out.append((i, len(lines), sum(hot), "\n".join(x for x, h in zip(lines, hot) if not h)))
    return out


def test_line_dedup(spark):
    rows = odd_rows()
    got = dedup_lines(frame(spark, rows), keep=("cid",))
    assert by_row(got, "doc_id", "n_lines", "n_dropped", "text") == ordered(brute_lines(rows))
    assert {r["cid"] for r in got.collect()} == {3}
    assert sum(r["n_dropped"] for r in got.collect()) > 10
    assert dedup_lines(frame(spark, [])).collect() == []


def brute_contamination(rows, items):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    out = []
    for i, t in rows:
        ws, hit, named = cut(t), set(), set()
        for item, text in items:
            b = cut(text)
            n = min(13, len(b))
            wins = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if b else set()
            for j in range(len(ws) - n + 1):
                if tuple(ws[j : j + n]) in wins:
                    hit |= set(range(j, j + n))
                    named |= {str(item)} if item is not None else set()
        out.append((i, len(ws), len(hit), str(sorted(named)), len(hit) > 0 and 20 * len(hit) >= len(ws)))
    return out


def test_decontamination(spark):
    rows = odd_rows()
    items = [(7, PASSAGE), (70, PASSAGE), (8, "one two"), (9, "tiny"), (10, None), (11, "..."), (12, "x " * 40), (None, "word3 bench4 word4"), (7, PASSAGE)]
    benchmark = frame(spark, items, "item_id")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], str(list(r["item_ids"])), r["contaminated"]) for r in contamination(frame(spark, rows), benchmark).collect()]
    assert ordered(got) == ordered(brute_contamination(rows, items))
    assert sum(g[4] for g in got) >= 4
    assert contamination(frame(spark, []), benchmark).collect() == []
    assert not any(r["n_hit"] for r in contamination(frame(spark, rows[:5]), frame(spark, [], "item_id")).collect())


def brute_near(rows):
    def shingles(t):
        w = lower(t).encode().split()
        return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {}
    for c, (i, _) in zip(comp, rows):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return [(i, len(s), least[c], i == least[c]) for (i, _), s, c in zip(rows, sets, comp)]


def test_near_duplicates(spark):
    rows = odd_rows()
    assert by_row(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id", "kept") == ordered(brute_near(rows))


def test_near_duplicates_in_crowded_nodes(spark):
    """Many near copies of one text, linked in chains, and tiny nodes: branching and block pairs lose no link."""
    import random

    rnd = random.Random(3)
    rows, words = [], [f"w{j}" for j in range(120)]
    for i in range(90):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[rnd.randrange(120)] = f"n{i}"
    got = near_duplicates(frame(spark, rows), node=8, depth=4, wide=8)
    assert by_row(got, "doc_id", "n_shingles", "component_id", "kept") == ordered(brute_near(rows))


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("rounds", [None, 1])
def test_components_of_a_path(spark, rounds):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    comp = {r["v"]: r["comp"] for r in connected_components(edges, rounds).collect()}
    assert set(comp) == {*range(41), 100, 101, 102}
    assert not {comp[i] for i in range(41)} & {comp[i] for i in (100, 101, 102)}
    if rounds is None:
        assert len({comp[i] for i in range(41)}) == len({comp[i] for i in (100, 101, 102)}) == 1
