"""Class model, segmentation sampling, sharding, quality, HTML text, top-k search and the pipeline."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SF_ORACLE
from llm_data import by_row, frame, odd_rows, ordered, prose
from segrules.llm import brown_lm, quality_gbt, sharding, spm_sample, topk_search
from segrules.llm.html_extract import extract_main_text, main_text


def test_class_model(spark):
    rows = odd_rows() + [(100 + i, prose(i, 80)) for i in range(60)]
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = [
        (i, held(i), len(tokens(t)), sum(w in count for w in tokens(t)), n, f"{sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)):.6f}")
        for i, t in rows
    ]
    got = brown_lm.score_texts(frame(spark, rows), n_classes=6, rounds=2).collect()
    assert ordered((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6f}") for r in got) == ordered(want)
    assert all(r["score"] < 0 for r in got)
    assert brown_lm.score_texts(frame(spark, [])).collect() == []


def fit_rows(spark, rows, **kw):
    """(model, class of each word outside the core with its count, resolved) with every text in training."""
    df = spark.createDataFrame([(i, False, t.encode()) for i, t in rows], "doc_id long, held_out boolean, text binary")
    model, others, resolved = brown_lm.fit_class_model(df, **kw)
    return model, {bytes(r["word"]): (r["n"], r["class"]) for r in others.collect()}, resolved


def test_class_model_is_a_distribution(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CORE", 30)
    model, others, _ = fit_rows(spark, [(i, prose(i, 50)) for i in range(40)], n_classes=5, rounds=3)
    count = collections.Counter(w for i in range(40) for w in brown_lm.tokens(prose(i, 50).encode()))
    assert {w: n for w, (n, _) in others.items()} == {w: n for w, n in count.items() if w not in model.core}
    mass = [0.0] * 5
    for w, n in count.items():
        mass[others[w][1] if w in others else model.classes[brown_lm.ENDINGS + model.core.index(w)]] += n + 0.5
    assert np.allclose(mass, model.mass)
    known = (10**model.factor * model.mass[None, :]).sum(axis=1)
    assert (known > 0.9).all() and (known < 1).all()


@pytest.mark.parametrize("copies", [0, 10])
def test_word_classes_and_scores_by_brute_force(spark, monkeypatch, copies):
    """Words seen often enough have the class of their own contexts, in a table ten times as large too."""
    monkeypatch.setattr(brown_lm, "CORE", 40)
    rows = [(i, prose(i, 60)) for i in range(30)]
    rows += [(100 + i, " ".join(f"filler{(i * j) % 97} and" for j in range(40))) for i in range(30 * copies)]
    model, others, resolved = fit_rows(spark, rows, n_classes=6, rounds=3)
    texts = {i: brown_lm.tokens(t.encode()) for i, t in rows}
    count = collections.Counter(w for t in texts.values() for w in t)
    assert model.core[1:] == sorted((w for w in count if w), key=lambda w: (-count[w], w))[:40]
    at = {w: i for i, w in enumerate(model.core)}
    symbol = lambda w: brown_lm.ENDINGS + at[w] if w in at else brown_lm.ending(w)
    by_symbol = lambda w: model.classes[symbol(w)]
    cells, contexts = np.zeros((6, 6)), {w: np.zeros(12) for w in others}
    for t in texts.values():
        for last, w, following in zip([b"", *t], t, [*t[1:], None]):
            cells[by_symbol(last), by_symbol(w)] += 1
            if w in others:
                contexts[w][by_symbol(last)] += 1
                contexts[w][6 + by_symbol(following)] += 1
    log_next, log_size = brown_lm._offers(cells)
    own = 0
    for w, (n, got) in others.items():
        assert n == count[w]
        gain = [sum(contexts[w][d] * log_next[d, c] + contexts[w][6 + d] * log_next[c, d] for d in range(6)) - n * log_size[c] for c in range(6)]
        assert got == (int(np.round(gain, 6).argmax()) if n >= brown_lm.SEEN else by_symbol(w))
        own += got != by_symbol(w)
    assert own > 5
    often = {w for i in range(30) for w in texts[i] if count[w] >= brown_lm.SEEN}
    assert often <= set(at) | set(others)

    cls = lambda w: others[w][1] if w in others else by_symbol(w)
    final = collections.Counter((cls(a), cls(b)) for t in texts.values() for a, b in zip([b"", *t], t))
    out, into = collections.Counter(), collections.Counter()
    for (a, b), n in final.items():
        out[a] += n
        into[b] += n
    size, bottom = sum(final.values()), sum(final.values()) + 0.5 * (len(count) + 1)

    def log_p(last, w):
        a, b = cls(last), cls(w)
        following = (final[a, b] + brown_lm.PRIOR * into[b] / size) / (out[a] + brown_lm.PRIOR)
        mass = 0.5 + sum(n + 0.5 for x, n in count.items() if cls(x) == b)
        return math.log10((count[w] + 0.5) * (brown_lm.MIX * following / mass + (1 - brown_lm.MIX) / bottom))

    scored = resolved.mapInArrow(brown_lm._score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    for i in range(30):
        assert abs(got[i] - sum(log_p(a, b) for a, b in zip([b"", *texts[i]], texts[i]))) < 1e-6


def test_class_model_beats_the_unigram_model_on_held_out_texts(spark):
    pattern = lambda i: " ".join(f"det{(i + j) % 4} noun{(i * 7 + j * 3) % 50} verb{(i * 5 + j) % 40}" for j in range(40))
    got = brown_lm.score_texts(frame(spark, [(i, pattern(i)) for i in range(300)]), n_classes=8).where("held_out")
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.85 * base and got.count() > 30


def test_groups_end_at_their_bounds(spark, monkeypatch):
    rows = odd_rows() + [(100 + i, prose(i, 80)) for i in range(60)]
    want = by_row(brown_lm.score_texts(frame(spark, rows), n_classes=6, rounds=2), "doc_id", "n_tokens", "n_known", "base_score", "score")
    monkeypatch.setattr(brown_lm, "GROUP_WORDS", 100)
    monkeypatch.setattr(brown_lm, "MERGE", 50)
    got = by_row(brown_lm.score_texts(frame(spark, rows), n_classes=6, rounds=2), "doc_id", "n_tokens", "n_known", "base_score", "score")
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want])


@pytest.fixture(scope="module")
def vocabulary():
    return spm_sample.load_vocabulary()


def enumerate_segmentations(text, v):
    surface = {s.decode(): i for i, s in enumerate(v.surface) if i >= 259}
    out = {}

    def walk(at, ids, weight):
        if at == len(text):
            out[tuple(ids)] = weight
        for j in range(at + 1, len(text) + 1):
            i = surface.get(text[at:j])
            if i is not None:
                walk(j, [*ids, i], weight + v.log_weight[i])

    walk(0, [], 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {s: w - total for s, w in out.items()}


def test_sampling_matches_enumeration(vocabulary):
    p = {s: math.exp(x) for s, x in enumerate_segmentations(" the cat", vocabulary).items()}
    n = 4000
    first, second = collections.Counter(), collections.Counter()
    for rows in spm_sample.sample_texts(["the cat"] * n, np.arange(n), 3, vocabulary):
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == 3 and rows[0][2] >= rows[1][2] >= rows[2][2]
        assert all(abs(math.exp(r[1]) - p[i]) < 1e-9 for r, i in zip(rows, ids))
        first[ids[0]] += 1
        second[ids[1]] += 1
    for s in sorted(p, key=p.get)[-3:]:
        then = sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)
        assert abs(first[s] / n - p[s]) < 0.02 and abs(second[s] / n - then) < 0.03


def test_all_segmentations_of_a_short_text(vocabulary):
    want = enumerate_segmentations(" the", vocabulary)
    rows = spm_sample.sample_texts(["the"], np.array([3]), 100, vocabulary)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(want) and all(r[3] == 1.0 for r in rows)


def test_segmentations_of_odd_texts(spark):
    rows = odd_rows()
    got = spm_sample.sample_segmentations(frame(spark, rows), k=3, digest=True).collect()
    assert all(r["round_trip"] for r in got)
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    assert len({(r["doc_id"], r["ids_sha256"]) for r in got if r["doc_id"] == 7}) == 3
    again = spm_sample.sample_segmentations(frame(spark, rows[::-1]).repartition(5), k=3, digest=True)
    assert by_row(again, "doc_id", "sample", "ids_sha256") == ordered((r["doc_id"], r["sample"], r["ids_sha256"]) for r in got)
    ids = spm_sample.sample_segmentations(frame(spark, rows[6:9]), k=1)
    assert by_row(spm_sample.decode_column(ids), "doc_id", "text") == ordered(rows[6:9])
    assert spm_sample.sample_segmentations(frame(spark, [])).collect() == []


def test_pieces_are_found_by_one_addition_a_character(vocabulary):
    v = vocabulary
    pieces = {s.decode().replace(" ", chr(spm_sample.SPACE)): i for i, s in enumerate(v.surface) if i >= 259}
    for text, i in pieces.items():
        chars = v.char_of[[ord(c) for c in text]].tolist()
        node = int(v.roots[chars[0]])
        for c in chars[1:]:
            child = int(v.base[node]) + c
            assert v.parent[child] == node
            node = child
        assert v.piece[node] == i
    assert np.count_nonzero(v.piece >= 0) == len(pieces)
    # no character leads on from the empty node, and nothing lies outside the arrays
    assert not (v.parent[v.base[0] + np.arange(v.n_chars)] == 0).any() and v.base.max() + v.n_chars <= len(v.parent)


def test_lattice_knows_its_segmentations(vocabulary):
    lattice = spm_sample.Lattices(["the", "cat" * 30, "the a"], vocabulary)
    units = lattice.unit
    assert lattice.ways[lattice.begin[units[0]]] == len(enumerate_segmentations(" the", vocabulary))
    assert lattice.ways[lattice.begin[units[3]]] == len(enumerate_segmentations(" a", vocabulary))
    # probabilities of a place's edges sum to 1, in units of any length
    for unit in (0, 1):
        at = int(lattice.begin[units[unit]])
        assert abs(lattice.p[lattice.head[at] : lattice.tail[at]].sum() - 1) < 1e-9
        assert lattice.cdf[lattice.tail[at] - 1] == 1.0


def test_samples_decode_at_once_as_one_by_one(vocabulary):
    texts = ["the cat", "", " two  spaces ", "\u65e5\U0001f600\x00", chr(spm_sample.SPACE) + " x"]
    found = spm_sample.sample_texts(texts, np.arange(len(texts)), 3, vocabulary)
    samples = [s[0] for f in found for s in f]
    surface = pa.array(vocabulary.surface, pa.large_binary())
    got = spm_sample.decode_samples(samples, surface)
    assert got == [spm_sample.decode_ids(s, vocabulary) for s in samples] == [t for t, f in zip(texts, found) for _ in f]
    assert spm_sample.decode_samples([], surface) == [] and spm_sample.decode_samples([samples[3][:0]], surface) == [""]


def brute_slots(names, size):
    hashed = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    lists = {s: [(hashed("offset:" + s) + j * (1 + hashed("skip:" + s) % (size - 1))) % size for j in range(size)] for s in names}
    owner, turn = {}, itertools.cycle(sorted(names))
    while len(owner) < size:
        s = next(turn)
        owner[next(x for x in lists[s] if x not in owner)] = s
    return [owner[i] for i in range(size)]


def test_sharding(spark, tmp_path):
    names = ["a", "b", "c", "d", "e"]
    assert sharding.slot_table(names, 101) == brute_slots(names, 101)
    more = sharding.slot_table([*names, "f"])
    moved = sum(x != y for x, y in zip(sharding.slot_table(names), more))
    assert moved < 0.35 * len(more)  # a sixth has to move
    sizes = collections.Counter(more)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    weighed = collections.Counter(sharding.slot_table({"a": 3, "b": 1}, 1009))
    assert abs(weighed["a"] - 3 * weighed["b"]) <= 4
    table = sharding.slot_table(names, 101)
    want = [(i, table[int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16) % 101]) for i, _ in odd_rows()]
    assert by_row(sharding.assign_shards(frame(spark, odd_rows()), names, 101), "doc_id", "shard") == ordered(want)
    assert sharding.assign_shards(frame(spark, []), names, 101).collect() == []
    sharding.write_shards(frame(spark, odd_rows()), str(tmp_path / "out"), names, 101)
    assert by_row(spark.read.parquet(str(tmp_path / "out")), "doc_id", "shard") == ordered(want)
    for bad in ([], ["a"]):
        with pytest.raises(ValueError):
            sharding.slot_table(bad, 100)


def test_a_hot_key_is_spread_over_files_and_columns_stay(spark, tmp_path):
    docs = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source"), F.lit("mine").alias("shard"), F.lit(1).alias("slot"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which joins files as small as these
    try:
        sharding.write_shards(docs, str(tmp_path / "out"), ["a", "b"], 101, key="source", files_per_shard=2, rows_per_file=50)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == ["id", "shard", "shard_1", "slot", "source"]
    assert back.drop("shard_1").exceptAll(docs.select(back.drop("shard_1").columns)).isEmpty() and back.count() == 900
    assert back.groupBy("source").agg(F.countDistinct("shard_1").alias("n")).where("n > 1").isEmpty()
    hot = back.where("source = 'hot'").groupBy(F.input_file_name()).count().collect()
    assert len(hot) >= 4 and max(r["count"] for r in hot) < 200


def test_products_that_do_not_fit_are_refused(spark):
    fits = spark.createDataFrame([(0, [1000.0, -3.0]), (1, [2.0, 5000.0])], "vec_id long, embedding array<double>")
    got = topk_search.exact_top_k(fits, F.col("vec_id") == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1024 * 1024 * (2000 - 15000))]
    with pytest.raises(Exception, match="64 bits"):
        topk_search.exact_top_k(spark.createDataFrame([(0, [2.0**40]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_ORACLE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gbt.fit_quality(docs, labels)
    held = quality_gbt.score_quality(docs, model).where(quality_gbt.is_held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    assert len(held) > 50 and sum((r["score"] >= 0.7) == r["quality"] for r in held) / len(held) >= 0.97
    odd = quality_gbt.score_quality(frame(spark, odd_rows()), model).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_gbt.score_quality(frame(spark, []), model).collect() == []


def test_trees_without_a_choice():
    flat = quality_gbt.grow_trees(np.zeros((0, 3)), np.zeros(0))
    assert flat.scores(np.ones((2, 3))).tolist() == [0.5, 0.5]
    assert quality_gbt.grow_trees(np.zeros((9, 3)), np.ones(9)).scores(np.zeros((1, 3)))[0] > 0.9
    x = np.random.default_rng(1).random((400, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality_gbt.grow_trees(x, y).scores(x) > 0.5) == y).mean() > 0.98


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><p>Site name and slogan</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="layout with-sidebar"><div class="ad">Buy now!</div><article><h1>Caf&eacute; &amp; more</h1><p>First <b>bold
text<br>goes on.<p>Second&nbsp;block.</p><!-- no --><ul><li>one<li>two</ul><aside>Aside</aside><table><tr><td>cell</table></article>
<div id="comments"><p>Great post, I really enjoyed reading this long reader comment.</p></div><div class="sidebar"><p>Related</p></div></div>
<form><p>Sign up</p><input></form><footer>&copy; me</footer></body>"""


def test_main_text():
    assert main_text(PAGE) == "Café & more\n\nFirst bold text goes on.\n\nSecond block.\n\none\n\ntwo\n\ncell"
    bare = "<body><div class=menu><a>Home</a></div><div><p>" + "Long text here. " * 20 + "</p><p>Short end.</p></div><div class=footer>x</div>"
    assert main_text(bare) == ("Long text here. " * 20).strip() + "\n\nShort end."
    assert main_text("") == main_text(None) == main_text("<html><nav>Home</nav></html>") == ""
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert main_text("<article><p>a<</p>b<x y") .startswith("a<")


def test_pages(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    want = [(i, u, main_text(h), len(main_text(h))) for i, u, h in rows]
    assert by_row(extract_main_text(pages), "page_id", "url", "text", "n_chars") == ordered(want)
    assert extract_main_text(pages.where("false")).collect() == []


def test_top_k(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(0, 0.2, 12)]) for i in range(1500)]
    rows += [(2000, None), (2100, [None] * 12), (2200, [float("nan")] * 12), (2300, [float("inf")] + [0.0] * 11), (2400, [0.5] * 5), (2500, [])]
    rows += [(7, rows[7][1]), (2600, rows[9][1]), (2601, rows[9][1]), (None, [9.0] * 12)]
    df = spark.createDataFrame([(*r, 1.5, 3) for r in rows], "vec_id long, embedding array<float>, score double, rank int")
    x = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    full = [(i, np.pad(x[i], (0, 12 - len(x[i])))) for i, _ in rows if i in x]
    want = []
    for q, qv in full:
        if q % 100 == 0:
            best = sorted((-int(qv @ v), i) for i, v in full if i != q)[:10]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    got = topk_search.exact_top_k(df, F.col("vec_id") % 100 == 0, block_rows=400, query_rows=4)
    assert by_row(got, "query_id", "rank", "vec_id", "score") == ordered(want)
    assert topk_search.exact_top_k(df.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").where("doc_id < 150")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "segmentation"]
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_ORACLE)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        path = f"{spark.sparkContext.getCheckpointDir()}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] >= sizes[4] > 0
