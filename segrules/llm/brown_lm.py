"""Class-based bigram language model: exchange clustering of words, class transitions and word emissions.

Words seen at least :data:`SEEN` times in training have a class by their own contexts, at any size of the corpus.
Classes come from exchange clustering of the :data:`CORE` most frequent words and of :data:`ENDINGS` endings
that stand for the others as neighbours: half of them at a time are offered the class in which their contexts are
likeliest, and a half-round that does not raise the likelihood of the training bigrams is undone.  Every other
word is then offered the classes once, by its contexts over all training texts; that is a table
(word, n, class) which grows with the corpus and stays distributed.  Words seen less often, and unseen ones, take the class of their ending.
A word's probability is that of its class after the last word's class, times its share of the
class, mixed with its unigram share.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import id_bucket, pick
from segrules.session import cut_lineage

CORE = 8192  # most frequent words, which take part in every round
SEEN = 3  # occurrences from which a word's own contexts decide its class
ENDINGS = 1024
CLASSES = 64  # at most 255
ROUNDS = 8  # half-rounds
MIX = 0.95  # weight of the class model against the unigram model
PRIOR = 20.0  # how many observations the unigram class shares count for in a transition
END = b""  # no word is empty
OPEN = 255  # in a class sequence: not known yet
GROUP_WORDS = 600_000  # different words outside the core in one unit of lookup
GROUP_TOKENS = 4_000_000  # tokens in one unit of lookup; a longer text is one by itself
FLUSH = 600_000  # different words that a task counts before it hands them on
MERGE = 1_000_000  # items between two merges of a task's counts


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end token."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def ending(word: bytes) -> int:
    return crc32(word[-3:]) % ENDINGS


class Codes(dict):
    """Codes of words: a place in the core, or from ``self.core`` on the number of another word, with the symbols of their endings."""

    def __init__(self, core: list[bytes]) -> None:
        super().__init__((w, i) for i, w in enumerate(core))
        self.core = len(core)
        self.ends = array("h")

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        self.ends.append(crc32(word[-3:]) % ENDINGS)  # as ``ending``, without a call
        return code

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol of each word, places of those outside the core, their numbers)"""
        codes = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        at = np.flatnonzero(codes >= self.core)
        numbers = codes[at] - self.core
        symbols = (codes + ENDINGS).astype(np.int16)
        symbols[at] = np.frombuffer(self.ends, np.int16)[numbers] if len(at) else 0
        return symbols, at, numbers

    def others(self) -> list[bytes]:
        return list(self)[self.core :]


class Tally:
    """Counts of integer keys, merged every :data:`MERGE` items."""

    def __init__(self) -> None:
        self.keys, self.ns, self.parts, self.waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(keys)
        self.waiting += len(keys)
        if self.waiting >= MERGE:
            self.merge()

    def merge(self) -> None:
        if self.parts:
            new, n = np.unique(np.concatenate(self.parts), return_counts=True)
            both, where = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
            self.ns = np.bincount(where, np.concatenate([self.ns, n]), len(both)).astype(np.int64)
            self.keys, self.parts, self.waiting = both, [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.keys, self.ns
        self.__init__()
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(tally: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.binary()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])

    tally: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            tally.update(tokens(text))
            if len(tally) >= FLUSH:
                yield out(tally)
                tally = Counter()
    if tally:
        yield out(tally)


ENCODED = "grp long, number int, word binary, doc_id long, held_out boolean, ids binary, others binary"


def _encode(core: list[bytes]):
    """Rows (doc_id, held_out, text) to one row per text, its tokens' symbols (``ids``) and the numbers of its words outside the
    core (``others``), and to one row per number of each group of texts.  A group ends when its dictionary or its texts fill a task."""
    names = [c.split()[0] for c in ENCODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(core)
        task, turn, held = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        others: list[bytes] = []

        def texts(group: int, b: pa.RecordBatch, first: int) -> pa.RecordBatch:
            n = len(ids)
            columns = [
                pa.array(np.full(n, group), pa.int64()),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.binary()),
                b.column(0).slice(first, n),
                b.column(1).slice(first, n),
                pa.array(ids, pa.binary()),
                pa.array(others, pa.binary()),
            ]
            ids.clear(), others.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        def dictionary(group: int) -> pa.RecordBatch:
            n = len(codes.ends)
            columns = [
                pa.array(np.full(n, group), pa.int64()),
                pa.array(np.arange(n), pa.int32()),
                pa.array(codes.others(), pa.binary()),
                *[pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.binary(), pa.binary())],
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            first = 0
            for i, text in enumerate(b.column(2)):
                words = tokens(text.as_py())
                s, _, numbers = codes.of(words)
                ids.append(s.tobytes())
                others.append(numbers.tobytes())
                held += len(words)
                if len(codes.ends) >= GROUP_WORDS or held >= GROUP_TOKENS:
                    group = (task << 24) + turn
                    yield texts(group, b, first)
                    yield dictionary(group)
                    codes, first, turn, held = Codes(core), i + 1, turn + 1, 0
            if ids:
                yield texts((task << 24) + turn, b, first)
        if codes.ends:
            yield dictionary((task << 24) + turn)

    return run


def _shifted(parts: list[bytes], dtype: type, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, the item before each) of all sequences; ``first`` comes before the first of each."""
    items = np.frombuffer(b"".join(parts), dtype).astype(np.int64)
    before = np.empty_like(items)
    before[1:] = items[:-1]
    before[np.cumsum([0] + [len(p) // np.dtype(dtype).itemsize for p in parts[:-1]])] = first
    return items, before


def _bigrams(end: int, width: int):
    """Counts of symbol pairs, from the column ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                items, before = _shifted(b.column(0).slice(at, 500).to_pylist(), np.int16, end)
                tally.add(before * width + items)
                if len(tally.keys) >= 2 * MERGE:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.take()], ["pair", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.take()], ["pair", "n"])

    return run


def _word_contexts(core: list[bytes], classes: np.ndarray, n_classes: int):
    """Per word outside the core: how often each class comes before it (slot below ``n_classes``) and after it.

    One row per word and task's turn, its slots and their counts side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tally = Codes(core), Tally()
        first = classes[ENDINGS]

        def out() -> pa.RecordBatch:
            _, slots, counts = _packed(*tally.take(), 2 * n_classes)  # every word has some
            return pa.RecordBatch.from_arrays([pa.array(codes.others(), pa.binary()), slots, counts], ["word", "slots", "counts"])

        for b in batches:
            for text in b.column(0):
                s, at, numbers = codes.of(tokens(text.as_py()))  # the last token is in the core
                if not len(at):
                    continue
                c = classes[s]
                before = np.where(at > 0, c[at - 1], first)
                row = numbers.astype(np.int64) * (2 * n_classes)
                tally.add(np.concatenate([row + before, row + n_classes + c[at + 1]]))
                if len(codes.ends) >= GROUP_WORDS or len(tally.keys) >= 2 * MERGE:
                    yield out()
                    codes = Codes(core)
        if codes.ends:
            yield out()

    return run


def _gains(counts: np.ndarray, log_next: np.ndarray, log_size: np.ndarray) -> np.ndarray:
    """Class in which contexts (before, then after) are likeliest: transitions into and out of it, and a symbol's share of it."""
    n_classes = len(log_size)
    before, after = counts[:, :n_classes], counts[:, n_classes:]
    gain = before @ log_next + after @ log_next.T - before.sum(axis=1)[:, None] * log_size[None, :]
    return gain.round(6).argmax(axis=1)  # rounded: ties go to the first class however rows are batched


def _choose(classes: np.ndarray, log_next: np.ndarray, log_size: np.ndarray):
    """Rows (word, slots, counts), sorted by word and all of a word in one partition, to (word, n, class)."""
    slots = 2 * len(log_size)

    def chosen(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
        n = counts[:, : slots // 2].sum(axis=1).astype(np.int64)
        best, often = np.zeros(len(n), np.int64), n >= SEEN
        best[often] = _gains(counts[often], log_next, log_size)
        rare = np.flatnonzero(~often)
        best[rare] = classes[[ending(words[i]) for i in rare.tolist()]]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n), pa.array(best.astype(np.int32))], ["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[bytes] = []  # the word that the next batch may go on with
        kept = np.zeros((0, slots))
        for b in batches:
            if not b.num_rows:
                continue
            coded = b.column(0).dictionary_encode()
            words = coded.dictionary.to_pylist()
            counts = _unpacked(coded.indices.to_numpy(), len(words), slots, b)
            if last and last[0] == words[0]:
                counts[0] += kept[0]
            else:
                words, counts = last + words, np.concatenate([kept, counts])
            if len(words) > 1:
                yield chosen(words[:-1], counts[:-1])
            last, kept = words[-1:], counts[-1:]
        if last:
            yield chosen(last, kept)

    return run


def _class_counts(classes: np.ndarray, width: int, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes)
        for b in batches:
            pair, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            total += np.bincount(classes[pair // width] * n_classes + classes[pair % width], n, n_classes * n_classes)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell].astype(np.int64))], ["cell", "n"])

    return run


def _packed(keys: np.ndarray, n: np.ndarray, slots: int) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Sorted cells (row * slots + slot) and their counts to (rows met, slots of each, counts of each)."""
    row = keys // slots
    starts = np.flatnonzero(np.diff(row, prepend=-1))

    def lists(items: np.ndarray) -> pa.Array:
        offsets = (np.append(starts, len(items)) * items.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(items)])

    return row[starts], lists((keys % slots).astype(np.int16)), lists(n.astype(np.int64))


def _unpacked(row: np.ndarray, n_rows: int, slots: int, b: pa.RecordBatch) -> np.ndarray:
    """Counts by row and slot of a batch whose last two columns are such lists."""
    parts = b.column(1).to_pylist()
    cell = np.repeat(row.astype(np.int64), [len(x) // 2 for x in parts]) * slots + np.frombuffer(b"".join(parts), np.int16)
    return np.bincount(cell, np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64), n_rows * slots).reshape(-1, slots)


def _contexts(classes: np.ndarray, width: int, n_classes: int, half: int):
    """Per symbol of one half (even or odd): how often each class comes before it (slot below ``n_classes``) and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = 2 * n_classes
        total = np.zeros(width * slots, np.int64)
        for b in batches:
            pair, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            left, right = pair // width, pair % width
            cell = np.concatenate([right * slots + classes[left], left * slots + n_classes + classes[right]])
            total += np.bincount(cell, np.concatenate([n, n]), len(total)).astype(np.int64)
        cell = np.flatnonzero(total)
        cell = cell[cell // slots % 2 == half]
        symbol, seen, counts = _packed(cell, total[cell], slots)
        yield pa.RecordBatch.from_arrays([pa.array(symbol.astype(np.int32)), seen, counts], ["symbol", "slots", "counts"])

    return run


def _best_class(log_next: np.ndarray, log_size: np.ndarray):
    """Rows (symbol, slots, counts), all of a symbol in one partition, to (symbol, class)."""
    slots = 2 * len(log_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for b in batches:
            symbols, row = np.unique(b.column(0).to_numpy(), return_inverse=True)
            for symbol, own in zip(symbols.tolist(), _unpacked(row, len(symbols), slots, b)):
                counts[symbol] = counts[symbol] + own if symbol in counts else own
        if counts:
            best = _gains(np.array(list(counts.values())), log_next, log_size)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(best.astype(np.int32))], ["symbol", "class"])

    return run


@dataclass(frozen=True)
class ClassModel:
    """What scoring needs, bounded by the numbers of symbols and classes.

    log10 P(word | last word) = log10(n + 0.5) + factor[class of the last word, class of the word], n its training count.
    """

    core: list[bytes]
    classes: np.ndarray  # of each symbol
    counts: np.ndarray  # of each symbol, in training tokens
    mass: np.ndarray  # of each class: sum of n + 0.5 over its training words
    factor: np.ndarray  # classes x classes
    size: int  # training tokens
    types: int

    def log_bottom(self) -> float:
        return float(np.log10(self.size + 0.5 * (self.types + 1)))


def _transitions(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(next class | class), tokens of each class) from class bigram counts."""
    size = cells.sum(axis=0)
    share = size / max(1.0, size.sum())
    return (cells + PRIOR * share[None, :]) / (cells.sum(axis=1, keepdims=True) + PRIOR), size


def _collect_cells(pairs: DataFrame, classes: np.ndarray, width: int, n_classes: int) -> np.ndarray:
    return _square(pairs.mapInArrow(_class_counts(classes, width, n_classes), "cell long, n long"), n_classes)


def likelihood(cells: np.ndarray) -> float:
    """What the classes add to the log likelihood of the training bigrams: their mutual information in tokens."""
    left, right, total = cells.sum(axis=1), cells.sum(axis=0), cells.sum()
    a, b = np.nonzero(cells)
    return float((cells[a, b] * np.log(cells[a, b] * total / (left[a] * right[b]))).sum())


def exchange(pairs: DataFrame, symbol_counts: np.ndarray, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each symbol, class bigram counts) after ``rounds`` half-rounds of exchange.

    Symbols start in the classes in turn, by falling frequency.  In a half-round the symbols of even or odd number are offered the
    class in which their contexts are likeliest, the others fixed; one that does
    not raise the likelihood is undone, and two such in turn end the search.
    """
    width = len(symbol_counts)
    classes = np.zeros(width, np.int64)
    classes[np.argsort(-symbol_counts, kind="stable")] = np.arange(width) % n_classes
    cells = _collect_cells(pairs, classes, width, n_classes)
    lost = 0
    for turn in range(rounds):
        log_next, log_size = _offers(cells)
        contexts = pairs.mapInArrow(_contexts(classes, width, n_classes, turn % 2), "symbol int, slots binary, counts binary")
        moves = contexts.repartition("symbol").mapInArrow(_best_class(log_next, log_size), "symbol int, class int").collect()  # one per symbol
        moved = classes.copy()
        for symbol, c in moves:
            moved[symbol] = c
        new_cells = _collect_cells(pairs, moved, width, n_classes)
        if likelihood(new_cells) > likelihood(cells):
            classes, cells, lost = moved, new_cells, 0
        elif lost:
            break
        else:
            lost = 1
    return classes, cells


def _offers(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    following, size = _transitions(cells)
    return np.log(np.maximum(following, 1e-12)), np.log(np.maximum(size, 1.0))


def _resolve(model_classes: np.ndarray, symbol_counts: np.ndarray):
    """A group's texts and the counts and classes of its dictionary to class sequences and sums of log10(n + 0.5)."""
    log_count = np.log10(symbol_counts + 0.5)
    of_symbol = model_classes.astype(np.uint8)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_words", "classes"]

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        number = words["number"].to_numpy()
        size = 1 + max((int(np.frombuffer(o.as_py(), np.int32).max(initial=-1)) for o in texts["others"]), default=-1)
        n, cls = np.zeros(size), np.full(size, OPEN, np.uint8)  # words that training has not seen have no row
        n[number] = words["n"].to_numpy()
        cls[number] = words["class"].to_numpy()
        log_n = np.log10(n + 0.5)
        sizes, known, log_words, sequences = [], [], [], []
        for ids, others in zip(texts["ids"], texts["others"]):
            s = np.frombuffer(ids.as_py(), np.int16)
            o = np.frombuffer(others.as_py(), np.int32)
            own = s >= ENDINGS
            sequence = of_symbol[s]
            found = np.where(cls[o] == OPEN, sequence[~own], cls[o])  # an unseen word: the class of its ending
            sequence[~own] = found
            sizes.append(len(s))
            known.append(int((symbol_counts[s[own]] > 0).sum()) + int((n[o] > 0).sum()))
            log_words.append(float(log_count[s[own]].sum() + log_n[o].sum()))
            sequences.append(sequence.tobytes())
        columns = [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(log_words, pa.float64()), pa.array(sequences, pa.binary())]
        return pa.table([texts["doc_id"], texts["held_out"], *columns], names=names)

    return run


def _sequence_cells(end: int, n_classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                items, before = _shifted(b.column(0).slice(at, 500).to_pylist(), np.uint8, end)
                total += np.bincount(before * n_classes + items, minlength=n_classes * n_classes)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell])], ["cell", "n"])

    return run


def _square(counted: DataFrame, n_classes: int) -> np.ndarray:
    cells = np.zeros(n_classes * n_classes)
    for cell, n in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most classes squared
        cells[cell] = n
    return cells.reshape(n_classes, n_classes)


def fit_class_model(rows: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[ClassModel, DataFrame, DataFrame]:
    """(model, others, resolved) from ``rows`` (doc_id, held_out, text binary); it learns from all that are not held out.

    ``others`` (word binary, n, class) has every training word outside the core, ``resolved`` every row of ``rows``:
    doc_id, held_out, n_tokens, n_known, log_words (sum of log10(n + 0.5)) and classes, one byte per token.
    """
    train = rows.where(~F.col("held_out")).select("text")
    counted = train.mapInArrow(_count, "word binary, n long")
    words = cut_lineage(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    size, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    is_end = F.col("word") == F.lit(END)
    top = words.where(~is_end).orderBy(F.desc("n"), "word").limit(CORE).select("word", "n").collect()  # at most CORE
    n_end = words.where(is_end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    core = [END, *[bytes(r["word"]) for r in top]]
    counts = np.zeros(ENDINGS + len(core))
    endings = (F.crc32(F.substring("word", -3, 3)) % ENDINGS).cast("int")  # as ``ending``
    for e, n in words.groupBy(endings.alias("ending")).agg(F.sum("n")).collect():  # at most ENDINGS
        counts[e] = n
    counts[ENDINGS:] = [n_end, *[r["n"] for r in top]]
    for w, n in zip(core, counts[ENDINGS:]):  # what is left to an ending
        counts[ending(w)] -= n

    encoded = cut_lineage(rows.mapInArrow(_encode(core), ENCODED), "encoded")
    texts = encoded.where(F.col("number").isNull())
    width = len(counts)
    tallied = texts.where(~F.col("held_out")).select("ids").mapInArrow(_bigrams(ENDINGS, width), "pair long, n long")
    pairs = cut_lineage(tallied.groupBy("pair").agg(F.sum("n").alias("n")), "symbol_pairs")
    n_classes = max(1, min(n_classes, width, OPEN))
    classes, cells = exchange(pairs, counts, n_classes, rounds)

    contexts = train.mapInArrow(_word_contexts(core, classes, n_classes), "word binary, slots binary, counts binary")
    by_word = contexts.repartition("word").sortWithinPartitions("word")
    others = cut_lineage(by_word.mapInArrow(_choose(classes, *_offers(cells)), "word binary, n long, class int"), "word_classes")

    asked = encoded.where(F.col("number").isNotNull()).select(F.col("grp").alias("unit"), "number", "word").join(others, "word")
    found = asked.select("unit", "number", "n", "class")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, log_words double, classes binary"
    grouped = texts.select("grp", "doc_id", "held_out", "ids", "others").groupBy("grp")
    resolved = cut_lineage(grouped.cogroup(found.groupBy("unit")).applyInArrow(_resolve(classes, counts), schema), "class_sequences")

    end = int(classes[ENDINGS])
    sequences = resolved.where(~F.col("held_out")).select("classes")
    final = _square(sequences.mapInArrow(_sequence_cells(end, n_classes), "cell long, n long"), n_classes)
    own = counts[ENDINGS:] > 0
    mass = np.bincount(classes[ENDINGS:][own], counts[ENDINGS:][own] + 0.5, n_classes)
    for c, n, t in others.groupBy("class").agg(F.sum("n"), F.count("*")).collect():  # at most one row a class
        mass[c] += n + 0.5 * t
    following, _ = _transitions(final)
    bottom = size + 0.5 * (types + 1)
    factor = np.log10(MIX * following / (mass + 0.5)[None, :] + (1 - MIX) / bottom)
    return ClassModel(core, classes, counts, mass, factor, int(size), int(types)), others, resolved


def _score(model: ClassModel):
    end, n_classes = int(model.classes[ENDINGS]), len(model.mass)
    factor = model.factor.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array(b.column("log_words").to_numpy())
            for i, seq in enumerate(b.column("classes")):
                items, before = _shifted([seq.as_py()], np.uint8, end)
                score[i] += factor[before * n_classes + items].sum()
            base = b.column("log_words").to_numpy() - b.column("n_tokens").to_numpy() * model.log_bottom()
            columns = [b.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
            columns += [pa.array(np.full(b.num_rows, model.size), pa.int64()), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, the log10 probabilities of the whole text under the smoothed
    unigram model and under the class model.

    Learns from the rows whose crc32 of the id as text, modulo 5, is not 1; the others
    are held out.  Perplexity is ``10 ** (-score / n_tokens)``.

    Edge cases: a null or empty text is the end token alone; a null id counts as the empty
    text in the fold; repeated rows are scored, and learnt from, each time; other columns are
    ignored.  Without training rows every word is unknown; an empty table gives an empty result.

    Scale: three scans of the texts.  Words, symbol pairs and contexts are counted per task before they are
    shuffled.  Only the core, the endings and what is counted by class go to the driver and the tasks.  Counts and classes
    of all other words, an unbounded table, come by a join: each group of texts, bounded in words and tokens, asks for its own
    words once, and gets them in one cogroup.
    """
    rows = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"), (id_bucket(F.col("doc_id"), 5) == 1).alias("held_out"), F.col("text").cast("binary").alias("text")
    )
    model, _, resolved = fit_class_model(rows, n_classes, rounds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return resolved.mapInArrow(_score(model), schema)
