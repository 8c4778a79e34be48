"""Awkward documents shared by the operator tests."""

import random

PASSAGE = " ".join(f"bench{i} word{i}" for i in range(12))  # 24 words, a benchmark item
SHARED = "This licence line stands in a good many of the documents here."
_RND = random.Random(4)
VOCAB = ["".join(_RND.choice(["tha", "re", "ion", "ße", "ño", "qu", "x"]) for _ in range(_RND.randint(1, 4))) for _ in range(300)]


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def odd_rows():
    """(doc_id, text): nulls, empty, blank, tiny and long texts, repeats, copies, near copies, shared lines and passages."""
    base = prose(1, 200).split()
    near = base[:100] + ["changed"] + base[101:]
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\r\n "),
        (4, "One"),
        (5, "one two THREE"),
        (6, "one two three"),
        (7, " ".join(base)),
        (8, " ".join(base).upper()),
        (9, " ".join(near)),
        (10, prose(2, 60) + " " + PASSAGE + " " + prose(3, 60)),
        (11, PASSAGE.upper().replace(" ", ", ")),
        (12, prose(5, 600) + " " + PASSAGE),
        (13, "a" * 30_000),
        (14, "1 " * 8_000 + "a@b.c%x@y.z"),
        (15, "Mail bob.x@example.com, call +1 (555) 123-4567 from 10.0.0.255 or 10.0.0.256; card 4111 1111 1111 1111, not 4111111111111112."),
        (16, "é𠮷 ip 001.2.3.4.5.6.7.8 write to jane [at] example [dot] com +12 +1-2345-6789-0123-4567"),
        (16, "é𠮷 ip 001.2.3.4.5.6.7.8 write to jane [at] example [dot] com +12 +1-2345-6789-0123-4567"),
        (17, "tiny"),
        (17, "tiny"),
        (None, "no id at all " + SHARED),
        (18, "▁ odd   spaces\x0b\x0c here"),
    ]
    for i in range(20, 27):
        rows.append((i, f"{prose(i, 30)}\n  {SHARED if i % 2 else SHARED.upper()} \n{prose(i + 50, 20)}\n\n{SHARED}"))
    return rows


def frame(spark, rows, key="doc_id", value="text"):
    """The rows with extra columns whose names clash with what operators use inside."""
    wide = [(*r, "x", 1, 2.0, "y", "z", 3) for r in rows]
    return spark.createDataFrame(wide, f"{key} long, {value} string, row_id string, n long, score double, h1 string, words string, cid long")


def by_row(df, *columns):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
