"""Pairs at the threshold whose nodes all stay large."""

import numpy as np

from llm_data import by_row, frame
from segrules.llm import near_dup
from segrules.llm.common import mix64
from segrules.llm.near_dup import near_duplicates


def test_pairs_at_the_threshold_share_a_node_six_levels_down():
    rnd = np.random.default_rng(5)
    n = 200
    x = rnd.integers(0, 2**32, (n, near_dup.POSITIONS), dtype=np.uint32)
    y = np.where(rnd.random(x.shape) < near_dup.SIMILARITY / 100, x, x + np.uint32(1))
    pair = np.tile(np.arange(n), near_dup.TREES)
    path = np.repeat(mix64(np.arange(1, near_dup.TREES + 1, dtype=np.uint64)), n)
    for _ in range(6):
        (rows, left), (_, right) = (near_dup._children(path, s[pair], near_dup.SIMILARITY) for s in (x, y))
        pair, path = pair[rows][left == right], left[left == right]
    assert len(np.unique(pair)) == n


def test_single_partners_in_large_nodes(spark):
    """Every text shares half its shingles with all others and 0.77 with its one partner."""
    rows = []
    for i in range(80):
        words = [f"c{j}" for j in range(200)] + [f"p{i // 2}_{j}" for j in range(64)] + [f"o{i}_{j}" for j in range(38)]
        rows.append((i, " ".join(words)))
    got = by_row(near_duplicates(frame(spark, rows), node=8, depth=3, wide=8), "doc_id", "component_id")
    assert sorted(map(tuple, got)) == [(i, i // 2 * 2) for i in range(80)]


def test_partner_of_one_member_of_a_large_group(spark):
    """One large group and a text that is linked to a single member of it, far from the others."""
    base = [f"w{j}" for j in range(300)]
    rows = [(i, " ".join(base[:290] + [f"n{i}_{j}" for j in range(10)])) for i in range(1, 60)]
    rows.append((60, " ".join(base[:290] + [f"z{j}" for j in range(60)])))
    rows.append((61, " ".join(base[30:290] + [f"z{j}" for j in range(60)])))
    got = by_row(near_duplicates(frame(spark, rows), node=8, depth=2, wide=8), "doc_id", "component_id")
    assert sorted(map(tuple, got)) == [(i, 1) for i in range(1, 62)]


def edited_copies(seed, n, words, most):
    """Copies of one text with up to ``most`` random words changed each: some near it, some near nothing."""
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(n):
        text = [f"b{j}" for j in range(words)]
        for j in rnd.choice(words, rnd.integers(0, most), replace=False):
            text[j] = f"e{rnd.integers(0, 40)}x{rnd.integers(0, 3)}"
        out.append(" ".join(text))
    return out


def brute_components(texts):
    sets = [set(near_dup.shingle_set(t.encode()).tolist()) for t in texts]
    comp = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = [new if c == old else c for c in comp]
    return comp


def test_links_within_a_family_are_those_of_all_pairs():
    texts = edited_copies(2, 150, 120, 14)
    sets = [near_dup.shingle_set(t.encode()) for t in texts]
    for colour in (np.arange(150), np.arange(150) % 7, np.zeros(150, np.int64), np.where(np.arange(150) < 100, 0, np.arange(150))):
        found = near_dup.links_within(sets, colour, 75)
        assert all(near_dup.linked(sets[a], sets[b]) and colour[a] != colour[b] for a, b in found)
        start = {c: c for c in colour.tolist()}

        def merged(pairs):
            label = dict(start)
            for a, b in pairs:
                x, y = label[int(colour[a])], label[int(colour[b])]
                label = {k: x if v == y else v for k, v in label.items()}
            return {frozenset(k for k in label if label[k] == v) for v in set(label.values())}

        every = [(i, j) for i in range(150) for j in range(i) if near_dup.linked(sets[i], sets[j])]
        assert merged(found) == merged(every) and len(found) == len(start) - len(merged(every))


def test_a_large_group_of_edited_copies(spark):
    texts = edited_copies(3, 500, 260, 16)
    want = brute_components(texts)
    assert len(set(want)) > 50 and max(want.count(c) for c in set(want)) > 100
    rows = list(enumerate(texts))
    for wide in (near_dup.WIDE, 100):
        got = by_row(near_duplicates(frame(spark, rows), node=64, wide=wide), "doc_id", "component_id")
        assert sorted(map(tuple, got)) == list(enumerate(want))
