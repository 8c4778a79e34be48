"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

A document is cut where a space follows a non-space: neither tokenizer joins the two
sides, so a stretch is encoded and aligned once and looked up afterwards.  Documents are numbered
in blocks.  For every pair of ids that a block links there is one compressed bitmap of the block's
documents (16-bit positions, or one bit a document where that is shorter), and one more for each
binary digit of how many links beyond the first the documents hold.  Blocks are gathered from batches of texts
whose bitmaps are OR-merged; popcounts summed over blocks give the corpus-wide counts, and the
bitmaps, read as postings, carry the scores back to the documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrules.llm.common import pick
from segrules.session import cut_lineage

FOLDER = "/opt/tokenizers"
BYTE_MODEL, PIECE_MODEL = f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model"
BATCH = 1_000_000  # code points aligned at a time
POSTINGS = 2_000_000  # a block ends after about so many (document, pair) postings ...
BLOCK = 65_536  # ... or so many documents
LONG = 1_000  # code points of a stretch from which the slower of two encoders is used: the faster one gives up on long runs
LEXICON = 4_000_000  # code points of stretches that are remembered
# Fixed value: how the byte-level vocabulary's tokenizer cuts a text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = re.compile(r"(?<=\S)(?= )")
UNEVEN = re.compile(r"^ |\s ")  # a space that does not follow a non-space

_GROUPS = "array<struct<a: array<int>, b: array<int>>>"
_SCHEMA = (
    "block long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, {text}, "
    "a int, b int, plane int, dense boolean, n long, docs binary"
)


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoders:
    """Both tokenizers, from the contents of their files, with the bytes of every id."""

    def __init__(self, byte_model: bytes, piece_model: bytes) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        model = json.loads(byte_model)["model"]
        alphabet = byte_alphabet()
        in_bytes = {t: bytes(alphabet[c] for c in t) for t in model["vocab"] if all(c in alphabet for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [model["vocab"][x + y] for x, y in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError("the byte-level vocabulary has to number its merges in their order")
        ranks = {in_bytes[t]: i for t, i in model["vocab"].items() if i < 256 + len(pairs)}
        self.a = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.long_a = Tokenizer.from_str(byte_model.decode())
        self.long_a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.a_bytes = [b for b, _ in sorted(ranks.items(), key=lambda kv: kv[1])]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each stretch, which starts with a space (the one that B adds by itself)."""
        a = [
            self.a.encode_ordinary(s) if len(s) <= LONG else self.long_a.encode(s, add_special_tokens=False).ids for s in stretches
        ]
        return a, [y or [self.space] for y in self.b.encode([s[1:] for s in stretches], num_threads=1)]


def stretches_of(text: str) -> list[str]:
    """``" " + text`` cut before every space that follows a non-space."""
    if UNEVEN.search(text):
        return SPLIT.split(" " + text)
    return [" " + w for w in text.split(" ")]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All items, and where each list starts (with the end of the last)."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


class Aligned:
    """Groups of some stretches: ids of both sides in order, and the group of every id."""

    def __init__(self, encoders: Encoders, stretches: list[str]) -> None:
        a_lists, b_lists = encoders.encode(stretches)
        raw = [s.encode() for s in stretches]
        self.exact = np.ones(len(raw), bool)
        if b"".join(map(encoders.a_bytes.__getitem__, chain.from_iterable(a_lists))) != b"".join(raw) or b"".join(
            map(encoders.b_bytes.__getitem__, chain.from_iterable(b_lists))
        ) != b"".join(raw):
            for i, (r, x, y) in enumerate(zip(raw, a_lists, b_lists)):
                self.exact[i] = b"".join([encoders.a_bytes[t] for t in x]) == r == b"".join([encoders.b_bytes[t] for t in y])
                if not self.exact[i]:
                    a_lists[i] = b_lists[i] = []
        (self.a, self.a_at), (self.b, self.b_at) = _flat(a_lists), _flat(b_lists)
        a_end, b_end = np.cumsum(encoders.a_size[self.a]), np.cumsum(encoders.b_size[self.b])
        a_cut, b_cut = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        self.a_group, self.b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        self.groups = int(a_cut.sum())
        self.a_first = np.searchsorted(self.a_group, np.arange(self.groups + 1))
        self.b_first = np.searchsorted(self.b_group, np.arange(self.groups + 1))
        self.group_at = np.searchsorted(self.a_first, self.a_at)  # a stretch starts with a group

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, pair as ``a << 16 | b``, links) for each pair of each stretch."""
        m, n = np.diff(self.a_first), np.diff(self.b_first)
        stretch = np.repeat(np.arange(len(self.exact)), np.diff(self.group_at))
        large = m * n > 4096  # of their ids the distinct ones are paired, times their occurrences
        a_sizes = np.where(large, 0, n)[self.a_group]
        left = np.repeat(np.arange(len(self.a)), a_sizes)
        at = np.arange(len(left)) - np.repeat(np.cumsum(a_sizes) - a_sizes, a_sizes) + np.repeat(self.b_first[self.a_group], a_sizes)
        codes, times = [stretch[self.a_group[left]] << 32 | self.a[left] << 16 | self.b[at]], [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(large):
            x, x_times = np.unique(self.a[self.a_first[g] : self.a_first[g + 1]], return_counts=True)
            y, y_times = np.unique(self.b[self.b_first[g] : self.b_first[g + 1]], return_counts=True)
            codes.append((stretch[g] << 32 | x[:, None] << 16 | y[None, :]).ravel())
            times.append((x_times[:, None] * y_times[None, :]).ravel())
        code, times = merged(np.concatenate(codes), np.concatenate(times))
        return code >> 32, code & 0xFFFFFFFF, times

    def texts(self, words: list[str]) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each stretch; ``words`` are the ids after each of ``"" ";" "," "|"``."""
        sign_a = np.where(np.arange(len(self.a)) > self.a_first[self.a_group], 2, 1)
        sign_a[self.a_at[:-1][np.diff(self.a_at) > 0]] = 0
        sign_b = np.where(np.arange(len(self.b)) > self.b_first[self.b_group], 2, 3)
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + self.b_first[self.a_group]] = sign_a << 16 | self.a
        order[np.arange(len(self.b)) + self.a_first[self.b_group + 1]] = sign_b << 16 | self.b
        said, ends = [words[i] for i in order.tolist()], (self.a_at + self.b_at).tolist()
        return ["".join(said[i:j]) for i, j in zip(ends[:-1], ends[1:])]

    def lists(self) -> list[list[dict]]:
        a, b = self.a.tolist(), self.b.tolist()
        cut = [
            {"a": a[i:j], "b": b[k:n]}
            for i, j, k, n in zip(self.a_first[:-1], self.a_first[1:], self.b_first[:-1], self.b_first[1:])
        ]
        return [cut[i:j] for i, j in zip(self.group_at[:-1], self.group_at[1:])]


class Lexicon:
    """Stretches met so far: sizes, links and text of each, by number."""

    def __init__(self, encoders: Encoders, digest: bool) -> None:
        self.encoders, self.digest = encoders, digest
        self.words = [f"{sign}{i}" for sign in ("", ";", ",", "|") for i in range(1 << 16)] if digest else []
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.size = 0
        self.said: list = []  # digest text, or groups
        self.exact = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)  # ids of A, ids of B, groups, links
        self.links_at = np.zeros(1, np.int64)
        self.links = np.zeros((0, 2), np.int64)  # rows (pair, links) by stretch

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of the stretches of each text; new stretches are encoded together."""
        number, known = self.number, len(self.said)
        out = [np.array([number.setdefault(s, len(number)) for s in stretches_of(t)], np.int64) for t in texts]
        if len(number) > known:
            new = list(islice(number, known, None))
            self.size += sum(map(len, new))
            self._add(Aligned(self.encoders, new))
        return out

    def _add(self, found: Aligned) -> None:
        stretch, pair, times = found.links()
        sizes = np.bincount(stretch, minlength=len(found.exact))
        ends = np.cumsum(sizes)
        sums = np.diff(np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], ends])])
        counts = np.stack([np.diff(found.a_at), np.diff(found.b_at), np.diff(found.group_at), sums], axis=1)
        self.exact = np.concatenate([self.exact, found.exact])
        self.counts = np.concatenate([self.counts, counts])
        self.links_at = np.concatenate([self.links_at, ends + self.links_at[-1]])
        self.links = np.concatenate([self.links, np.stack([pair, times], axis=1)])
        self.said += found.texts(self.words) if self.digest else found.lists()


def merged(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes with the sums of their weights."""
    if not len(codes):
        return codes, weights
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(weights[order], first)


def compress(keys: np.ndarray, positions: np.ndarray, n_docs: int) -> Iterator[tuple[np.ndarray, bool, np.ndarray, pa.Array]]:
    """(keys, dense, popcounts, bitmaps) of the sorted (key, position) rows: 16-bit positions where
    they are shorter than one bit for each of the block's ``n_docs`` documents, else the bits."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    dense = 16 * sizes > n_docs
    of_dense = np.repeat(dense, sizes)
    sparse = positions[~of_dense].astype("<u2").tobytes()
    ends = np.concatenate([[0], np.cumsum(2 * sizes[~dense])]).astype(np.int32)
    yield keys[first[~dense]], False, sizes[~dense], pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(sparse)]
    )
    bitmaps = []
    for at, size in zip(first[dense], sizes[dense]):
        bits = np.zeros(n_docs, np.uint8)
        bits[positions[at : at + size]] = 1
        bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
    yield keys[first[dense]], True, sizes[dense], pa.array(bitmaps, pa.binary())


class Block:
    """Documents and postings of one block, gathered batch by batch."""

    def __init__(self, name: int, schema: pa.Schema) -> None:
        self.name, self.schema, self.docs, self.codes, self.weights, self.postings = name, schema, 0, [], [], 0

    def add(self, docs: np.ndarray, pairs: np.ndarray, weights: np.ndarray) -> None:
        """Postings of a batch; ``docs`` are positions in the block."""
        codes, weights = merged(pairs << 16 | docs, weights)
        self.codes.append(codes), self.weights.append(weights)
        self.postings += len(codes)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row a pair and plane: plane 0 holds the documents, plane k > 0 those whose links less one have binary digit k - 1."""
        if not self.postings:
            return
        codes, weights = merged(np.concatenate(self.codes), np.concatenate(self.weights))
        rest = weights - 1
        for plane in range(1 + int(rest.max()).bit_length()):
            chosen = np.ones(len(codes), bool) if plane == 0 else (rest >> (plane - 1)) & 1 == 1
            if not chosen.any():
                continue
            for keys, dense, sizes, bitmaps in compress(codes[chosen] >> 16, codes[chosen] & 0xFFFF, self.docs):
                if len(keys):
                    yield record(self.schema, len(keys), {
                        "block": np.full(len(keys), self.name), "a": (keys >> 16).astype(np.int32), "b": (keys & 0xFFFF).astype(np.int32),
                        "plane": np.full(len(keys), plane, np.int32), "dense": np.full(len(keys), dense), "n": sizes, "docs": bitmaps,
                    })


def record(schema: pa.Schema, n: int, columns: dict) -> pa.RecordBatch:
    """A batch of ``schema``; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in columns else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and (size + len(t or "") > BATCH or i - start == BLOCK):
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def describe(lexicon: Lexicon, block: Block, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of a batch of documents; their postings go to the block."""
    n = len(texts)
    numbers = lexicon.numbers([t for t in texts if t])
    spoken = np.flatnonzero([bool(t) for t in texts])
    good = np.array([lexicon.exact[x].all() for x in numbers], bool)
    spoken, numbers = spoken[good], [x for x, g in zip(numbers, good) if g]
    sums = np.zeros((n, 4), np.int64)
    said: list = ["" if lexicon.digest else [] for _ in range(n)]
    for i, x in zip(spoken, numbers):
        sums[i] = lexicon.counts[x].sum(axis=0)
        parts = [lexicon.said[j] for j in x.tolist()]
        said[i] = hashlib.sha256(";".join(parts).encode()).hexdigest() if lexicon.digest else [g for p in parts for g in p]
    if len(spoken):
        doc = np.repeat(spoken, [len(x) for x in numbers])
        used, times = merged(doc << 32 | np.concatenate(numbers), np.ones(len(doc), np.int64))
        doc, stretch = used >> 32, used & 0xFFFFFFFF
        sizes = lexicon.links_at[stretch + 1] - lexicon.links_at[stretch]
        at = np.repeat(lexicon.links_at[stretch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        pair, links = lexicon.links[at].T
        block.add(np.repeat(doc, sizes) + block.docs, pair, links * np.repeat(times, sizes))
    out = record(block.schema, n, {
        "block": np.full(n, block.name), "pos": np.arange(block.docs, block.docs + n, dtype=np.int32), "doc_id": ids,
        "n_a": sums[:, 0], "n_b": sums[:, 1], "n_groups": sums[:, 2], "n_links": sums[:, 3], block.schema.names[7]: said,
    })
    block.docs += n
    return out


def link_rows(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, digest: bool = False) -> DataFrame:
    """Rows of documents (``pos`` set) and of pair bitmaps (``plane`` set) of all blocks, written to the shared folder."""
    with open(byte_model, "rb") as x, open(piece_model, "rb") as y:
        models = docs.sparkSession.sparkContext.broadcast((x.read(), y.read()))  # the size of the two vocabulary files
    text = ("groups_sha256", "string") if digest else ("groups", _GROUPS)
    groups = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
    schema = pa.schema(
        [("block", pa.int64()), ("pos", pa.int32()), ("doc_id", pa.int64())]
        + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
        + [(text[0], pa.string() if digest else groups)]
        + [("a", pa.int32()), ("b", pa.int32()), ("plane", pa.int32()), ("dense", pa.bool_()), ("n", pa.int64()), ("docs", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(Encoders(*models.value), digest)
        name = TaskContext.get().partitionId() << 32
        block = Block(name, schema)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, stop in batches_of(texts):
                if block.docs + stop - start > BLOCK or block.postings >= POSTINGS:
                    yield from block.rows()
                    name += 1
                    block = Block(name, schema)
                yield describe(lexicon, block, b.column(0).slice(start, stop - start), texts[start:stop])
                if lexicon.size > LEXICON:
                    lexicon.clear()
        yield from block.rows()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return cut_lineage(rows.mapInArrow(run, _SCHEMA.format(text=" ".join(text))), "links")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best) for every linked pair: documents that hold it linked, its links, and
    whether no other pair of ``a`` is in more documents."""
    weight = F.expr("shiftleft(1L, greatest(plane - 1, 0))")
    counted = (
        rows.where("plane is not null")
        .groupBy("a", "b")
        .agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links"))
    )
    # a group holds at most one row for each id of B's vocabulary
    return counted.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a")))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, plane, dense, docs, n_docs, best), a block in one task, to (block, pos, n_best, count_sum)."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        block, plane, dense, count, best = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
        weight = np.left_shift(np.int64(1), np.maximum(plane.astype(np.int64) - 1, 0))
        values = np.stack([weight * best, weight * count])
        bitmaps = [
            np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) if d else np.frombuffer(x, "<u2")
            for x, d in zip(b.column(3).to_pylist(), dense)
        ]
        sizes = np.array([len(x) for x in bitmaps])
        for name in np.unique(block):
            chosen = np.flatnonzero(block == name)
            at = np.concatenate([bitmaps[i] for i in chosen]).astype(np.int64)
            own = sums.get(name, np.zeros((2, 0), np.int64))
            if at.max() >= own.shape[1]:
                own = np.pad(own, ((0, 0), (0, int(at.max()) + 1 - own.shape[1])))
            for k in (0, 1):
                np.add.at(own[k], at, np.repeat(values[k, chosen], sizes[chosen]))
            sums[name] = own
    for name, own in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(own.shape[1], name)), pa.array(np.arange(own.shape[1], dtype=np.int32)), pa.array(own[0]), pa.array(own[1])],
            ["block", "pos", "n_best", "count_sum"],
        )


def align_tokenizers(docs: DataFrame, byte_model: str = BYTE_MODEL, piece_model: str = PIECE_MODEL, digest: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    ``groups``, an array of (a ids, b ids), or with ``digest`` groups_sha256 of its text form.

    Both tokenizers encode a space and the text, without special tokens.  Byte offsets where tokens
    of both end cut them into groups; all tokens of A in a group are linked with all of B in it.
    The count of a pair is the number of rows of ``docs`` that hold it linked; ``n_best`` counts the links
    whose count is the highest of their A id, ties included, ``count_sum`` adds the counts of all links.

    Edge cases: a null or empty text, and one whose bytes one of the tokenizers doesn't give back
    (a text with U+2581, which B takes for a space), has no tokens: zeros, no groups (and no digest: '').
    Every row is a document, rows that repeat an id too; a null id stays null.  Other columns are
    ignored; an empty table gives an empty result.

    Scale: one scan; what is shuffled are bitmaps of blocks, a row for each pair of a block, so a pair
    in every document weighs one bit a document.  Counts are summed from one number per block and
    pair, and a block's scores are added in one task: 65,536 documents at most.  A task holds the postings of one
    block and ``LEXICON`` code points of stretches, or the distinct pairs of one longer text.
    """
    rows = link_rows(docs, byte_model, piece_model, digest)
    scores = cut_lineage(pair_counts(rows), "scores").select("a", "b", "n_docs", "best")
    planes = rows.where("plane is not null").select("a", "b", "block", "plane", "dense", "docs")
    scored = planes.join(scores, ["a", "b"]).select("block", "plane", "dense", "docs", "n_docs", "best")
    returned = scored.repartition("block").mapInArrow(_returned, "block long, pos int, n_best long, count_sum long")
    own = rows.where("pos is not null").drop("a", "b", "plane", "dense", "n", "docs")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")}
    return own.join(returned, ["block", "pos"], "left").drop("block", "pos").withColumns(zero)
