"""Sampled SentencePiece segmentations: Gumbel top-k without replacement over the segmentation lattice.

A text's lattice has an edge for every vocabulary piece that matches at a place; a
piece's weight follows its rank in the vocabulary, and backward sums turn weights into
exact probabilities of whole segmentations.  The search keeps regions of the set of
segmentations, each with the perturbed maximum of its probability mass as an exact
bound (an A-star heuristic without error).  The best region yields its winner, a
segmentation drawn from it, and is split along that segmentation into the regions that leave it at
each unit; their maxima are Gumbels truncated at the winner's.  So the results come
in falling perturbed order, distinct, and every random number is a hash of row key and place.

No piece crosses the start of a run of spaces, so the lattice is a chain of units (a run of
spaces with the word after it, or one character that no piece covers).  Equal units of a
batch share one lattice.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segrules.llm.common import give_back, mix64, pick

#: Default place of the public tokenizer's model; a parameter, never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 400_000  # code points whose lattices a task holds at a time

SPACE = 0x2581  # stands for a space in pieces
_LITERAL = 0x10FFFF + 1  # stands for that character itself where a text holds it
_FIRST = np.array([SPACE], np.int32)
_LINEAR = 60  # units up to which sums of weights cannot underflow
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Vocabulary:
    """Arrays of fixed size from the tokenizer's model."""

    char_of: np.ndarray  # code point -> number of the character in the trie, 0 if no piece holds it
    n_chars: int
    roots: np.ndarray  # node that each character leads to from the root, or the empty node 0
    base: np.ndarray  # the child of a node by a character is node base[node] + character, if ...
    parent: np.ndarray  # ... that node's parent is the node
    piece: np.ndarray  # of each node, or -1
    log_weight: np.ndarray  # of each piece
    byte_id: np.ndarray  # id of each byte's piece
    surface: list[bytes]  # of each piece
    longest: int


def load_vocabulary(model: str = MODEL) -> Vocabulary:
    """Read the pieces on the driver.

    The model holds merge ranks, not probabilities, so a piece's weight falls as one over its rank
    (Zipf's law); byte pieces have the least weight.  Control pieces take no part.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.vocab_size()
    log_weight = -np.log(np.arange(n) + 2.0)
    surface, byte_id = [b""] * n, np.zeros(256, np.int32)
    pieces: dict[str, int] = {}
    for i in range(n):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_id[int(text[3:5], 16)] = i
            surface[i] = bytes([int(text[3:5], 16)])
            log_weight[i] = -np.log(n + 2.0)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            if chr(SPACE) in text.lstrip(chr(SPACE)):
                raise ValueError(f"piece {i} has a space after another character")
            pieces[text] = i
            surface[i] = text.replace(chr(SPACE), " ").encode()
    chars = {c: j for j, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
    char_of = np.zeros(_LITERAL + 1, np.int32)
    for c, j in chars.items():
        char_of[ord(c)] = j
    n_chars = len(chars) + 1
    nodes: dict[tuple[int, int], int] = {}
    end = {}
    for text, i in pieces.items():
        at = 0
        for c in text:
            at = nodes.setdefault((at, chars[c]), len(nodes) + 1)
        end[at] = i
    place, base, parent = _double_array(nodes, n_chars)
    piece = np.full(len(base), -1, np.int32)
    piece[place[list(end)]] = list(end.values())
    roots = np.zeros(n_chars, np.int64)
    for (a, c), node in nodes.items():
        if a == 0:
            roots[c] = place[node]
    return Vocabulary(char_of, n_chars, roots, base, parent, piece, log_weight, byte_id, surface, max(map(len, pieces)))


def _double_array(nodes: dict[tuple[int, int], int], n_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each node, base, parent): trie nodes put so that a child is found by one addition and one comparison.

    Children of a node lie at its base plus their characters. Nodes with most children are put first, each at the next
    base at which all places are free; single children fill what is left."""
    edges = np.array([(a, c, node) for (a, c), node in nodes.items()], np.int64)
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    first = np.flatnonzero(np.append(True, edges[1:, 0] != edges[:-1, 0]))
    sizes = np.diff(np.append(first, len(edges)))
    place, base_of = np.ones(len(nodes) + 1, np.int64), np.zeros(len(nodes) + 1, np.int64)  # place 1: the root, 0: the empty node
    window = 128
    used = np.zeros(2 * len(edges) + 4 * n_chars + window, bool)
    used[: n_chars + 1] = True
    at = n_chars + 1
    for i in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
        c = edges[first[i] : first[i] + sizes[i], 1]
        while True:
            if at + window + n_chars > len(used):
                used = np.append(used, np.zeros(len(used), bool))
            free = at + np.flatnonzero(~used[at : at + window]) - c[0]
            fits = free[~used[free[:, None] + c].any(axis=1)]
            if len(fits):
                break
            at += window
        base_of[edges[first[i], 0]] = fits[0]
        place[edges[first[i] : first[i] + sizes[i], 2]] = fits[0] + c
        used[fits[0] + c] = True
    single = first[sizes == 1]
    used = np.append(used, np.zeros(len(single), bool))
    free = np.flatnonzero(~used)[: len(single)]
    base_of[edges[single, 0]] = free - edges[single, 1]
    place[edges[single, 2]] = free
    n = int(place.max()) + n_chars + 1
    base, parent = np.zeros(n, np.int32), np.full(n, -1, np.int32)
    base[place] = base_of
    parent[place[edges[:, 2]]] = place[edges[:, 0]]
    return place, base, parent


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of piece ids; the space that encoding puts first is taken off."""
    raw = b"".join(map(vocabulary.surface.__getitem__, ids.tolist()))
    return raw.decode()[1:] if raw else ""


def decode_samples(samples: list[np.ndarray], surface: pa.LargeBinaryArray) -> list[str]:
    """:func:`decode_ids` of several rows of ids at once; ``surface`` has each piece's bytes."""
    ends = np.cumsum([0, *map(len, samples)])
    pieces = surface.take(pa.array(np.concatenate([*samples, np.zeros(0, np.int32)])))
    raw = pieces.buffers()[2]
    if raw is None:
        return [""] * len(samples)
    at = np.frombuffer(pieces.buffers()[1], np.int64)[ends].tolist()
    raw = memoryview(raw)
    return [str(raw[a:z], "utf-8")[1:] for a, z in zip(at[:-1], at[1:])]


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from mixed 64-bit integers."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _numbers(seeds: np.ndarray, start: int, n: int) -> list[list[float]]:
    """The numbers from ``start`` on of each seed's row of uniform ones."""
    return _uniform(mix64(seeds[:, None] + np.arange(start, start + n, dtype=np.uint64) * _STEP[2])).tolist()


def _salt(turn: int) -> np.ndarray:
    return np.array([turn], np.uint64) * _STEP[2]


class Lattices:
    """Units of a batch of texts, one lattice for each different unit."""

    def __init__(self, texts: list[str], v: Vocabulary) -> None:
        self.v = v
        parts, sizes = [], []
        for t in texts:
            if t:
                parts += [_FIRST, np.frombuffer(t.encode("utf-32-le"), np.int32)]
            sizes.append(len(t) + 1 if t else 0)
        sizes = np.array(sizes, np.int64)
        text_start = np.concatenate([[0], np.cumsum(sizes)])
        cps = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        cps[cps == SPACE] = _LITERAL
        cps[cps == 32] = SPACE
        cps[text_start[:-1][sizes > 0]] = SPACE
        chars = v.char_of[cps]
        space, unknown = cps == SPACE, chars == 0
        starts = unknown.copy()
        starts[1:] |= (space[1:] & ~space[:-1]) | unknown[:-1]
        starts[text_start[:-1][sizes > 0]] = True
        at = np.flatnonzero(starts)
        #: units of text i are first[i] : first[i + 1]
        self.first = np.searchsorted(at, text_start)
        if not len(at):
            self.unit = np.zeros(0, np.int64)
            return
        length = np.append(at[1:], len(cps)) - at
        power = np.full(int(length.max()), _STEP[0], np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        place = np.arange(len(cps), dtype=np.int32) - np.repeat(at.astype(np.int32), length)
        names = power[place]
        names *= cps.view(np.uint32)
        names = mix64(np.add.reduceat(names, at) + length.astype(np.uint64) * _STEP[1])
        _, example, self.unit = np.unique(names, return_index=True, return_inverse=True)
        self._build(cps, chars, at[example], length[example])

    def _build(self, cps: np.ndarray, chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Places of all units in one row of arrays, each unit with one more place for its end.

        Edges lie by their place's distance to the unit's end, so that backward sums take them slice by slice; long units,
        whose sums are logarithms, come last."""
        v = self.v
        stop = np.cumsum(length + 1) - 1
        self.begin = stop - length
        n = int(stop[-1]) + 1
        source = np.minimum(np.arange(n) + np.repeat(start - self.begin, length + 1), len(cps) - 1)
        left = (np.repeat(stop, length + 1) - np.arange(n)).astype(np.int32)  # places to the unit's end
        cps, chars = cps[source], chars[source].astype(np.int64)
        chars[stop] = -1
        found = []
        at = np.flatnonzero(chars > 0)
        node = v.roots[chars[at]]
        size = 1
        while True:
            p = v.piece[node]
            whole = np.flatnonzero(p >= 0)
            found.append((size, at[whole], p[whole]))
            size += 1
            if size > v.longest:
                break
            more = np.flatnonzero(left[at] >= size)
            at, node = at[more], node[more]
            child = v.base[node] + chars[at + (size - 1)]
            hit = np.flatnonzero(v.parent[child] == node)
            at, node = at[hit], child[hit]
            if not len(at):
                break
        bare = np.flatnonzero(chars == 0)
        degree = np.zeros(n, np.int64)
        for _, a, _ in found:
            degree[a] += 1
        degree[bare] += 1
        longest = int(length.max())
        rank = left
        if longest > _LINEAR:
            rank = left + np.repeat(np.where(length > _LINEAR, longest + 1, 0).astype(np.int32), length + 1)
        order = np.argsort(rank.astype(np.uint16) if 2 * longest < 65535 else rank, kind="stable")
        own_degree = degree[order]
        first = np.cumsum(own_degree) - own_degree
        m = int(own_degree.sum())
        #: edges of a place are head[place] : tail[place]
        self.head = np.empty(n, np.int64)
        self.head[order] = first
        self.tail = self.head + degree
        size_of, self.id = np.ones(m, np.int32), np.zeros(m, np.int32)
        fill = self.head.copy()
        for size, a, p in reversed(found):  # long pieces first: they hold most of the mass
            e = fill[a]
            size_of[e], self.id[e] = size, p
            fill[a] = e + 1
        log_weight = v.log_weight[self.id]
        self.id[self.head[bare]] = -1 - cps[bare]  # a character by its bytes
        log_weight[self.head[bare]] = 0.0
        after = np.repeat(order, own_degree) + size_of
        # Backward sums, and numbers of segmentations, from each place to its unit's end.
        p = np.empty(m)
        self.ways = np.zeros(n)
        self.ways[stop] = 1.0
        cut = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=longest + 1))])
        value = np.zeros(n)
        value[stop[length <= _LINEAR]] = 1.0
        weight = np.exp(log_weight)
        ends = np.append(first, m)
        for r in range(len(cut) - 1):
            at = order[cut[r] : cut[r + 1]]
            low, high = int(ends[cut[r]]), int(ends[cut[r + 1]])
            if low == high:
                continue
            heads = first[cut[r] : cut[r + 1]] - low
            if len(at) and not own_degree[cut[r] : cut[r + 1]].all():  # no piece goes on from there
                some = np.flatnonzero(own_degree[cut[r] : cut[r + 1]])
                at, heads = at[some], heads[some]
            to, degrees = after[low:high], np.diff(np.append(heads, high - low))
            if r <= longest:
                part = weight[low:high] * value[to]
                total = np.add.reduceat(part, heads)
                value[at] = total
                p[low:high] = part / np.repeat(np.maximum(total, 1e-300), degrees)
            else:
                part = log_weight[low:high] + value[to]
                total = np.logaddexp.reduceat(part, heads)
                value[at] = total
                p[low:high] = np.exp(np.minimum(part - np.repeat(total, degrees), 0.0))
            self.ways[at] = np.minimum(np.add.reduceat(self.ways[to], heads), 1e300)
        self.p = np.minimum(p, 1.0)
        with np.errstate(divide="ignore"):
            self.log_p = np.log(self.p)
        total = np.cumsum(self.p)
        self.cdf = total - np.repeat(np.concatenate([[0.0], total])[first], own_degree)
        self.cdf[first[own_degree > 0] + own_degree[own_degree > 0] - 1] = 1.0  # whatever rounding says
        self.after = np.where(left[after] == 0, -1, after)  # -1: the edge ends its unit

    def draw(self, units: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, first, log_p): a segmentation of each unit, its edges at first[i] : first[i + 1]."""
        active = np.arange(len(units))
        pos = self.begin[units]
        count = np.zeros(len(units), np.int64)
        steps = []
        while len(active):
            u = _uniform(mix64(seeds + _salt(len(steps) + 1)))
            e = self.head[pos]
            late = np.flatnonzero(u > self.cdf[e])
            while len(late):
                e[late] += 1
                late = late[u[late] > self.cdf[e[late]]]
            steps.append((active, e))
            pos = self.after[e]
            on = pos >= 0
            count[active[~on]] = len(steps)
            on = np.flatnonzero(on)
            active, pos, seeds = active[on], pos[on], seeds[on]
        first = np.concatenate([[0], np.cumsum(count)])
        edges = np.zeros(int(first[-1]), np.int64)
        for turn, (a, e) in enumerate(steps):
            edges[first[a] + turn] = e
        return edges, first, np.add.reduceat(self.log_p[edges], first[:-1]) if len(units) else np.zeros(0)

    def draw_other(self, unit: int, taken: list[np.ndarray], seed: np.uint64, numbers: list[float]) -> list[int]:
        """A segmentation of the unit, drawn from those not in ``taken``; ``numbers`` are the first that :func:`_numbers` gives for the seed.

        Walks from the start; the weight of an edge is its probability without the
        mass of taken segmentations that begin like this."""
        pos, out = int(self.begin[unit]), []
        rest = [(t.tolist(), float(self.log_p[t].sum())) for t in taken]
        while True:
            if len(out) == len(numbers):
                numbers = numbers + _numbers(np.array([seed]), len(numbers), 64)[0]
            low = int(self.head[pos])
            weight = self.p[low : int(self.tail[pos])].tolist()
            if rest:
                for t, log_p in rest:
                    weight[t[0] - low] -= math.exp(log_p)
                for e in {t[0] for t, _ in rest}:
                    # An edge all of whose segmentations are taken has nothing left, whatever rounding says.
                    own = sum(t[0] == e for t, _ in rest)
                    after = int(self.after[e])
                    ways = 1.0 if after < 0 else self.ways[after]
                    weight[e - low] = max(weight[e - low], 1e-300) if ways > own else 0.0
            u = numbers[len(out)] * sum(weight)
            e = -1
            for i, w in enumerate(weight):
                if w > 0:
                    e = low + i
                    if u <= w:
                        break
                    u -= w
            out.append(e)
            if rest:
                rest = [(t[1:], log_p - float(self.log_p[e])) for t, log_p in rest if t[0] == e and len(t) > 1]
            pos = int(self.after[e])
            if pos < 0:
                return out

    def ids(self, edges: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges and where each segmentation starts; a character that no piece covers becomes its bytes."""
        ids = self.id[edges]
        bare = np.flatnonzero(ids < 0)
        if not len(bare):
            return ids, first
        size = np.ones(len(ids), np.int64)
        raw = {}
        for code in np.unique(ids[bare]).tolist():
            cp = -1 - code
            raw[code] = self.v.byte_id[list(chr(SPACE if cp == _LITERAL else cp).encode())]
        codes = np.array(sorted(raw))
        which = np.searchsorted(codes, ids[bare])
        size[bare] = np.array([len(raw[c]) for c in codes.tolist()])[which]
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(ids, size)
        for j, c in enumerate(codes.tolist()):
            for i, byte in enumerate(raw[c]):
                out[at[bare[which == j]] + i] = byte
        return out, at[first]


class _Sample:
    """One segmentation of a text, and the regions that leave it at each unit from ``since`` on."""

    def __init__(self, edges: np.ndarray, first: np.ndarray, log_p: np.ndarray, score: float, since: int, taken: list[np.ndarray]) -> None:
        self.edges, self.first, self.log_p, self.score = edges, first, log_p, score  # log_p of each unit; score perturbed
        self.since, self.taken = since, taken  # taken at unit ``since``, this one's included
        self.bound = np.zeros(0)  # perturbed maximum of each region, the first of which leaves at ``since``
        self.best, self.top = -1, -np.inf  # the unit of the best region, and its maximum

    def unit(self, j: int) -> np.ndarray:
        return self.edges[self.first[j] : self.first[j + 1]]

    def choose(self) -> None:
        j = int(self.bound.argmax())
        self.best, self.top = self.since + j, float(self.bound[j])


def _split(lattice: Lattices, samples: list[_Sample], units: list[np.ndarray], seeds: np.ndarray) -> None:
    """Bounds of the regions of each sample: like it up to unit j, none of the taken at j, free after it."""
    since = np.array([s.since for s in samples])
    sizes = np.array([len(s.log_p) for s in samples]) - since
    at = np.concatenate([[0], np.cumsum(sizes)])
    log_p = np.concatenate([s.log_p[s.since :] for s in samples])
    row = np.repeat(np.arange(len(samples)), sizes)
    place = np.arange(len(row)) - (at[:-1] - since)[row]
    mass = -np.expm1(log_p)
    small = np.flatnonzero((mass < 1e-9) & (mass > 0))
    if len(small):
        start = lattice.begin[np.concatenate([u[s.since :] for s, u in zip(samples, units)])[small]]
        mass[small[lattice.ways[start] <= 1]] = 0.0
    for i, s in enumerate(samples):
        if len(s.taken) > 1:
            gone = sum(math.exp(lattice.log_p[t].sum()) for t in s.taken)
            mass[at[i]] = max(1.0 - gone, 1e-300) if lattice.ways[lattice.begin[units[i][s.since]]] > len(s.taken) else 0.0
    before = np.concatenate([[0.0], np.cumsum(log_p)])
    same = np.array([s.log_p[: s.since].sum() for s in samples]) - before[at[:-1]]
    score = np.array([s.score for s in samples])[row]
    with np.errstate(divide="ignore", over="ignore"):
        mass = np.log(mass) + (before[:-1] + same[row])
        u = _uniform(mix64(seeds[row] + (place + 1).astype(np.uint64) * _STEP[0]))
        # A Gumbel at ``mass``, truncated at the sample's own score.
        bound = np.where(np.isfinite(mass), np.minimum(mass - np.log(np.exp(mass - score) - np.log(u)), score), -np.inf)
    for i, s in enumerate(samples):
        s.bound = bound[at[i] : at[i + 1]]
        s.choose()


def sample_texts(texts: list[str], keys: np.ndarray, k: int, v: Vocabulary) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``k`` distinct segmentations (ids, log_p, perturbed score, inclusion score), best first.

    A text with fewer segmentations gives all of them; an empty text gives one without pieces."""
    lattice = Lattices(texts, v)
    seeds = mix64(keys.astype(np.int64).view(np.uint64) + _STEP[1])
    first = lattice.first
    sizes = np.diff(first)
    found: list[list[_Sample]] = [[] for _ in texts]
    left_out = np.full(len(texts), -np.inf)  # perturbed maximum of what is not among the samples
    doc = np.repeat(np.arange(len(texts)), sizes)
    place = (np.arange(int(first[-1])) - first[doc]).astype(np.uint64)
    units = [lattice.unit[first[i] : first[i + 1]] for i in range(len(texts))]
    new: list[tuple[int, _Sample]] = []
    if len(doc):
        # The root's maximum is a standard Gumbel; its winner is a draw from the whole lattice.
        root = -np.log(-np.log(_uniform(mix64(seeds ^ _STEP[0]))))
        edges, at, log_p = lattice.draw(lattice.unit, mix64(seeds[doc] + place * _STEP[0]))
        for i in np.flatnonzero(sizes).tolist():
            a, b = first[i], first[i + 1]
            s = _Sample(edges[at[a] : at[b]], at[a : b + 1] - at[a], log_p[a:b], float(root[i]), 0, [])
            s.taken.append(s.unit(0))
            new.append((i, s))
    for turn in range(1, k + 1):
        if not new:
            break
        rows = np.array([i for i, _ in new])
        _split(lattice, [s for _, s in new], [units[i] for i in rows], mix64(seeds[rows] + _salt(turn)))
        plans = []
        for i, s in new:
            found[i].append(s)
            parent = max(found[i], key=lambda x: x.top)
            left_out[i] = parent.top
            if turn < k and left_out[i] > -np.inf:
                plans.append((i, parent, parent.best))
        new = []
        if not plans:
            break
        # Draw anew what comes after the unit at which each winner leaves its parent.
        tails = [np.arange(first[i] + j + 1, first[i + 1]) for i, _, j in plans]
        tokens = np.concatenate(tails)
        planned = np.array([p[0] for p in plans])
        salt = np.repeat(mix64(seeds[planned] + _salt(turn) * _STEP[1]), [len(t) for t in tails])
        edges, at, log_p = lattice.draw(lattice.unit[tokens], mix64(salt + place[tokens] * _STEP[0]))
        other = mix64(seeds[planned] ^ (np.array([p[2] for p in plans], np.uint64) * np.uint64(64) + np.uint64(turn)))
        cursor = 0
        for (i, parent, j), tail, seed, numbers in zip(plans, tails, other, _numbers(other, 0, 8)):
            taken = parent.taken if j == parent.since else [parent.unit(j)]
            score = parent.top
            parent.bound[j - parent.since] = -np.inf
            parent.choose()
            own = np.array(lattice.draw_other(int(units[i][j]), taken, seed, numbers), np.int64)
            z = cursor + len(tail)
            s = _Sample(
                np.concatenate([parent.edges[: parent.first[j]], own, edges[at[cursor] : at[z]]]),
                np.concatenate([parent.first[: j + 1], at[cursor : z + 1] + (parent.first[j] + len(own) - at[cursor])]),
                np.concatenate([parent.log_p[:j], [lattice.log_p[own].sum()], log_p[cursor:z]]),
                score,
                j,
                [*taken, own],
            )
            cursor = z
            new.append((i, s))
    every = [s for samples in found for s in samples]
    ids, at = (
        lattice.ids(np.concatenate([s.edges for s in every]), np.concatenate([[0], np.cumsum([len(s.edges) for s in every])]))
        if every
        else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    )
    out, cursor = [], 0
    for i, samples in enumerate(found):
        rows = []
        for s in samples:
            p = float(s.log_p.sum())
            inclusion = -math.expm1(-math.exp(min(p - left_out[i], 700.0))) if left_out[i] > -np.inf else 1.0
            rows.append((ids[at[cursor] : at[cursor + 1]], p, s.score, inclusion))
            cursor += 1
        out.append(rows or [(np.zeros(0, np.int32), 0.0, 0.0, 1.0)])
    return out


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > CHUNK:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def sample_segmentations(docs: DataFrame, k: int = 4, model: str = MODEL, digest: bool = False, key: Column | None = None) -> DataFrame:
    """Up to ``k`` rows per row of ``docs`` (doc_id, text): doc_id, sample (from 1, best first), n_pieces,
    log_prob (natural log, of the segmentation among all of the text), perturbed (its
    score in the search), inclusion (the probability of scoring above the first segmentation left out), and
    ids array<int>, or with ``digest`` ids_sha256 (of the ids as little-endian 32-bit integers) and
    round_trip, whether decoding the ids gives the text again.

    ``key`` (default: a hash of the id) seeds all random numbers, so results do not depend on
    order, partitions or retries.

    Edge cases: a null or empty text has one segmentation without pieces, with probability 1; a text
    with fewer than ``k`` segmentations has that many rows; characters outside the vocabulary, and the
    sign that stands for a space, go by their bytes, so decoding is always exact; rows with the
    same key and text get the same result; other columns are ignored; an empty table
    gives an empty result.

    Scale: one scan without a shuffle; a task holds the lattices of about
    ``CHUNK`` code points, or of one longer text.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(load_vocabulary(model))  # bounded by the tokenizer's vocabulary
    rows = pick(docs, "doc_id", "text")
    key = F.xxhash64("doc_id") if key is None else key
    rows = rows.select(F.col("doc_id").cast("long"), "text", key.alias("key"))
    names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion"]
    schema = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double"
    schema += ", ids_sha256 string, round_trip boolean" if digest else ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        surface = pa.array(v.surface, pa.large_binary())
        give_back()
        for b in batches:
            doc_ids, keys = b.column(0), b.column(2).to_numpy(zero_copy_only=False)
            for a, z in _chunks(pc.fill_null(pc.utf8_length(b.column(1)), 0).to_pylist()):
                texts = [t or "" for t in b.column(1).slice(a, z - a).to_pylist()]
                found = sample_texts(texts, keys[a:z], k, v)
                row = np.repeat(np.arange(a, z), [len(f) for f in found])
                flat = [s for f in found for s in f]
                columns = [
                    doc_ids.take(pa.array(row)),
                    pa.array([j for f in found for j in range(1, len(f) + 1)], pa.int32()),
                    pa.array([len(s[0]) for s in flat], pa.int64()),
                    *[pa.array([s[j] for s in flat], pa.float64()) for j in (1, 2, 3)],
                ]
                if digest:
                    columns.append(pa.array([hashlib.sha256(s[0].tobytes()).hexdigest() for s in flat], pa.string()))
                    decoded = decode_samples([s[0] for s in flat], surface)
                    columns.append(pa.array([text == texts[i - a] for i, text in zip(row.tolist(), decoded)], pa.bool_()))
                    del decoded
                    yield pa.RecordBatch.from_arrays(columns, [*names, "ids_sha256", "round_trip"])
                else:
                    ends = np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s[0] for s in flat]), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*columns, ids], [*names, "ids"])
                del found, flat, columns
        give_back()

    return rows.mapInArrow(run, schema)


def decode_column(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text for rows with doc_id and ids array<int>; null ids decode to the empty text."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(np.array(ids or [], np.int64), vocabulary.value) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(rows, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")
