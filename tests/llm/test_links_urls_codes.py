"""Tokenizer alignment, url rules and vector codes against brute force."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest import SF_SMALL
from llm_data import by_row, frame, odd_rows, ordered
from segrules.llm import token_links, url_rules, vector_codes

# -- tokenizer alignment ---------------------------------------------------------


class Plain:
    """Whole texts through both libraries, groups by sets of offsets, counts by a dictionary."""

    def __init__(self):
        self.a = Tokenizer.from_file(token_links.BYTE_MODEL)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=token_links.PIECE_MODEL)
        self.alphabet = token_links.byte_alphabet()

    def groups(self, text):
        if not text:
            return []
        raw = (" " + text).encode()
        a = self.a.encode(" " + text, add_special_tokens=False)
        b = self.b.encode(text)
        a_bytes = [bytes(self.alphabet[c] for c in t) for t in a.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(self.b.id_to_piece, b))]
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            return []
        a_ends, b_ends = (list(itertools.accumulate(map(len, x))) for x in (a_bytes, b_bytes))
        cuts = sorted(set(a_ends) & set(b_ends))
        place = lambda ends: [next(k for k, c in enumerate(cuts) if c >= e) for e in ends]
        pa, pb = place(a_ends), place(b_ends)
        return [([i for i, p in zip(a.ids, pa) if p == k], [i for i, p in zip(b, pb) if p == k]) for k in range(len(cuts))]

    def rows(self, rows):
        every = [(i, self.groups(t)) for i, t in rows]
        links = [collections.Counter((x, y) for a, b in g for x in a for y in b) for _, g in every]
        count = collections.Counter(p for c in links for p in c)
        top = collections.defaultdict(int)
        for (a, _), n in count.items():
            top[a] = max(top[a], n)
        said = lambda g: ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        return [
            (
                i,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                sum(c.values()),
                sum(n for (a, b), n in c.items() if count[a, b] == top[a]),
                sum(n * count[p] for p, n in c.items()),
                hashlib.sha256(said(g).encode()).hexdigest() if g else "",
            )
            for (i, g), c in zip(every, links)
        ], count, sum(links, collections.Counter())


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD_TEXTS = [" ", "  ", "a ", " a", "a  b", "\n \n x", "x\xa0 y", "x\x1c y", "▁x a", "<|endoftext|> a</s>", "don't 'll", " \n\n ", "\x00 a", "ab" * 700 + " c"]


def aligned_rows():
    odd = [(i, t[:900] if t else t) for i, t in odd_rows()]
    return odd + [(200 + i, t) for i, t in enumerate(ODD_TEXTS)]


def test_tokenizer_alignment(spark):
    rows = aligned_rows()
    want, _, _ = Plain().rows(rows)
    got = token_links.align_tokenizers(frame(spark, rows).repartition(3), digest=True)
    assert by_row(got, *ALIGNED) == ordered(want)
    assert token_links.align_tokenizers(frame(spark, []), digest=True).collect() == []


def test_alignment_returns_groups_and_small_blocks_add_up(spark, monkeypatch):
    monkeypatch.setattr(token_links, "POSTINGS", 50)
    monkeypatch.setattr(token_links, "BATCH", 300)
    monkeypatch.setattr(token_links, "LEXICON", 200)
    rows = aligned_rows()
    plain = Plain()
    want, count, links = plain.rows(rows)
    got = token_links.align_tokenizers(frame(spark, rows).coalesce(2)).collect()
    assert ordered(tuple(r[c] for c in ALIGNED[:-1]) for r in got) == ordered(w[:-1] for w in want)
    assert ordered((r["doc_id"], str([(g["a"], g["b"]) for g in r["groups"]])) for r in got) == ordered((i, str(plain.groups(t))) for i, t in rows)
    pairs = token_links.pair_counts(token_links.link_rows(frame(spark, rows))).collect()
    assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"]) for r in pairs} == {p: (n, links[p]) for p, n in count.items()}
    assert all(r["best"] == (r["n_docs"] == max(n for (a, _), n in count.items() if a == r["a"])) for r in pairs)


def test_alignment_of_a_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if not r["text"] or len(r["text"]) < 4000]
    want, _, _ = Plain().rows(rows)
    got = token_links.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), digest=True)
    assert by_row(got, *ALIGNED) == ordered(want)


def test_large_groups_and_long_stretches():
    encoders = token_links.Encoders(open(token_links.BYTE_MODEL, "rb").read(), open(token_links.PIECE_MODEL, "rb").read())
    found = token_links.Aligned(encoders, [" b"])
    found.a, found.b = np.tile([5, 6], 60), np.tile([7, 8, 9], 40)
    found.a_group, found.b_group = np.zeros(120, np.int64), np.zeros(120, np.int64)
    found.a_first, found.b_first, found.group_at = np.array([0, 120]), np.array([0, 120]), np.array([0, 1])
    stretch, pair, times = found.links()
    assert pair.tolist() == [a << 16 | b for a in (5, 6) for b in (7, 8, 9)] and times.tolist() == [60 * 40] * 6 and not stretch.any()
    long = token_links.Aligned(encoders, [" " * 30_000 + "x", " " + "é" * 5_000])
    assert long.exact.all() and long.a_at[-1] == len(long.a)


def test_bitmaps_round_trip():
    rnd = np.random.default_rng(1)
    keys = np.sort(rnd.choice([3, 4, 9], 400, p=[0.9, 0.08, 0.02]))
    positions = np.concatenate([np.sort(rnd.choice(1000, n, replace=False)) for n in np.unique(keys, return_counts=True)[1]])
    back = {}
    for found, dense, sizes, bitmaps in token_links.compress(keys, positions, 1000):
        for k, n, x in zip(found, sizes, bitmaps.to_pylist()):
            back[k] = np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) if dense else np.frombuffer(x, "<u2")
            assert len(back[k]) == n and len(x) == (125 if dense else 2 * n)
    assert {k: x.tolist() for k, x in back.items()} == {k: positions[keys == k].tolist() for k in (3, 4, 9)}


# -- url rules -------------------------------------------------------------------

RULES = [
    ("allow", "org", "/"),
    ("block", "Example.ORG", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "example.org", "/en/12"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
    ("block", "net", None),
    ("allow", "net", "/ok/"),
    ("allow", "both.net", "/x"),
    ("block", "both.net", "/x"),
    (None, "edu", "/"),
]
URLS = [
    None, "", "no scheme.org/x", "http://example.org", "http://example.org/", "HTTP://A.EXAMPLE.ORG/es/1", "http://example.org/es", "x://b.example.org/en/123?q=/de/",
    "x://b.example.org/en/13#/es/", "http://notexample.org/es/", "http://m.example.com/fr/1", "http://example.com/de/", "http://com/de/x/", "http://com?/de/", "http://a.net",
    "http://net/ok/1", "http://net/okay", "http://both.net/xyz", "http://edu/", "http://a..org//x", "http://.org/", "http://org:80/", "a://b://c.org/d", "http://ÄB.org/é\n/x",
    "http://" + "a." * 3000 + "org/" + "s/" * 3000, "http://" + "x" * 20000 + ".com/de/" + "y" * 20000, "://org/", "http:///path",
]


def plain_verdict(url, rules, default):
    rest = (url or "").partition("://")[2]
    host = rest[: min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for action, h, p in rules:
        h, p = (h or "").lower(), p or ""
        if action and (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append(((len(h.split(".")) if h else 0, len(p), action == "block"), h + p, action))
    _, rule, verdict = max(fits, default=(0, None, default))
    return host, path, rule, verdict


@pytest.mark.parametrize("by_join", [False, True])
def test_url_rules(spark, by_join):
    rows = list(enumerate(URLS)) + [(None, "http://x.org/"), (3, "http://example.org")]
    for rules in (RULES, [*RULES, ("block", None, "/es")], []):
        table = spark.createDataFrame([(*r, 1) for r in rules], "action string, host string, path string, rule_dir int")
        got = url_rules.judge_urls(frame(spark, rows, "page_id", "url"), table, "block", trie_rules=0 if by_join else 100)
        want = [(i, *plain_verdict(u, rules, "block")) for i, u in rows]
        assert by_row(got, "page_id", "host", "path", "rule", "verdict") == ordered(want)
        assert url_rules.judge_urls(frame(spark, [], "page_id", "url"), table, trie_rules=0 if by_join else 100).collect() == []


def test_url_rules_at_random(spark):
    rnd = random.Random(5)
    host = lambda: ".".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4)))
    path = lambda: "".join(rnd.choice(["/", "/", "a", "b"]) for _ in range(rnd.randint(0, 6)))
    rules = [(rnd.choice(["allow", "block"]), host(), rnd.choice(["", "/"]) + path()) for _ in range(300)]
    trie = url_rules.build_trie(rules)
    urls = [f"http://{host()}/{path()}" for _ in range(3000)]
    for u in urls:
        h, p, rule, verdict = plain_verdict(u, rules, "none")
        assert (url_rules.longest_rule(trie, h, p) or ("none", None)) == (verdict, rule)
    table = spark.createDataFrame(rules, "action string, host string, path string")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by_trie, by_join = (by_row(url_rules.judge_urls(pages, table, trie_rules=n), "page_id", "rule", "verdict") for n in (1000, 10))
    assert by_trie == by_join


def test_url_rules_refuse_other_actions(spark):
    table = spark.createDataFrame([("deny", "org", "/")], "action string, host string, path string")
    with pytest.raises(ValueError, match="action"):
        url_rules.judge_urls(spark.createDataFrame([(1, "x")], "page_id long, url string"), table)


# -- vector codes ----------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    kept = [r for r in kept if len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in kept[:entries]] for p in range(parts)]

    def nearest():
        dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
        return [[min((dist(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        found = nearest()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(r[1], p) for r, f in zip(kept, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own)]
    found = nearest()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    per_label = collections.Counter()
    for (_, _, lab), e in zip(kept, errors):
        per_label[lab] += e
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, per_label[r[2]], digest) for r, f, e in zip(kept, found, errors)]


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def vectors(spark, rows):
    wide = [(*r, 1, "x") for r in rows]
    return spark.createDataFrame(wide, "vec_id long, embedding array<float>, label int, near int, v string")


def test_vector_codes(spark):
    rnd = np.random.default_rng(3)
    draw = lambda n, spread: np.round(rnd.normal(0, spread, (n, 8)), 2).astype(np.float32).astype(float).tolist()
    rows = [(int(i), v, None if i % 7 == 0 else int(i % 3)) for i, v in zip(rnd.permutation(260), draw(160, 0.2) + draw(100, 3))]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0] * 7, 1), (303, [1.0] * 16, 2), (304, [None] + [0.0] * 7, 1), (305, [float("nan")] * 8, 1)]
    rows += [(306, [float("inf")] * 8, 1), (None, [0.5] * 8, None), (0, [0.0] * 8, 0), (0, [0.0] * 8, 0), (307, [-0.001] * 8, 5)]
    for rounds, entries in ((0, 16), (2, 16), (5, 64), (3, 3)):
        got = vector_codes.compress_vectors(vectors(spark, rows), parts=4, entries=entries, rounds=rounds, scale=64)
        assert by_row(got, *CODES) == ordered(plain_codes(rows, 4, entries, rounds, 64))


def test_vector_codes_few_none_and_large(spark):
    few = [(2, [1.0] * 4, 1), (1, [2.0] * 4, None), (3, [1.0] * 4, 1)]
    assert by_row(vector_codes.compress_vectors(vectors(spark, few), parts=2), *CODES) == ordered(plain_codes(few, 2, 64, 2, 256))
    assert vector_codes.compress_vectors(vectors(spark, [])).collect() == []
    assert vector_codes.compress_vectors(vectors(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(Exception, match="2\\^27"):
        vector_codes.compress_vectors(vectors(spark, [(1, [1e30] * 16, 1)])).collect()


def test_bounds_settle_what_they_can():
    """Assignments through the bounds are those over all entries, and most parts look at few entries."""
    rnd = np.random.default_rng(8)
    v = rnd.integers(-300, 300, (3000, 4))
    book = v[:64].copy()
    near, low, outer, least = vector_codes.look_at_all(v, book, 16)
    looked = []
    for turn in range(4):
        moved_book = book + rnd.integers(-12, 12, book.shape) // (turn + 1)
        moved = vector_codes.roots(((moved_book - book) ** 2).sum(axis=1), up=True)
        book = moved_book
        near, low, outer, least, needed = vector_codes.look_again(v, book, moved, near, low, outer)
        d = vector_codes.distances(v, book)
        assert (near[:, 0] == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
        true = np.sqrt(np.take_along_axis(d, near.astype(int), axis=1))
        assert (low <= true + 1e-9).all()
        others = d.astype(float)
        np.put_along_axis(others, near.astype(int), np.inf, axis=1)
        assert (outer <= np.sqrt(others.min(axis=1)) + 1e-9).all()
        assert (np.diff(low[:, 1:], axis=1) >= 0).all()
        looked.append(needed.mean())
    assert max(looked) < 10
