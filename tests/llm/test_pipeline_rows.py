"""Stages of the pipeline on awkward rows and on an empty table."""

import collections
import itertools
import re

import pytest
from llm_data import odd_rows, ordered

import corpus_pipeline
from conftest import SF_ORACLE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id string, h1 string, words string, score double, kept boolean"
STAGES = dict(corpus_pipeline.STAGES)


def odd_frame(spark, rows):
    wide = [(i, t, None if j % 3 else "en", None if j % 4 else "web", None if t is None else len(t), "x", "y", "z", 2.0, False) for j, (i, t) in enumerate(rows)]
    return spark.createDataFrame(wide, SCHEMA)


def whole(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def kept_ids(rows):
    """Ids that are the smallest of their group, by comparing all pairs; here equal ids have equal texts."""
    sets = {}
    for i, t in rows:
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.split("[ \\t\\n\\x0b\\x0c\\r]+", t or "") if w]
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    group = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]), key=lambda i: (i is None, i or 0))
            group = {i: low if g == high else g for i, g in group.items()}
    assert 0 < sum(i != g for i, g in group.items()) < len(group)
    return {i for i, g in group.items() if i == g}


@pytest.mark.parametrize("name", ["quality", "near_dedup", "decontamination"])
def test_a_filtering_stage_keeps_rows_as_they_are(spark, name):
    docs = odd_frame(spark, odd_rows())
    out = STAGES[name](spark, docs, SF_ORACLE)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    got, given = collections.Counter(whole(out)), collections.Counter(whole(docs))
    assert not got - given
    assert all(n == given[row] for row, n in got.items())  # repeated rows share a verdict
    if name == "near_dedup":
        assert {r[0] for r in got} == kept_ids(odd_rows())


def test_line_dedup_keeps_every_row(spark):
    docs = odd_frame(spark, odd_rows())
    out = STAGES["line_dedup"](spark, docs, SF_ORACLE)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    got = whole(out)
    assert ordered((r[0], r[2], r[3]) for r in got) == ordered((r[0], r[2], r[3]) for r in whole(docs))
    assert all(r[4] == len(r[1]) for r in got)


@pytest.mark.parametrize("name", list(STAGES))
def test_a_stage_of_no_rows(spark, name):
    assert STAGES[name](spark, odd_frame(spark, []), SF_ORACLE).collect() == []
