"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's segmentations into vocabulary pieces are the paths of a lattice; a path's weight
is the product of its pieces' probabilities.  Backward sums give the exact weight of every
sub-lattice, so a perturbed A* search can run top-down: the best perturbed value in a
sub-lattice is a Gumbel variable located at its log weight; the path that attains it is
drawn piece by piece, and each step leaves aside "the same start, another piece here",
whose best value is a Gumbel variable truncated at the popped one.  Popping the largest
value again and again emits distinct segmentations in order of their perturbed values: a
sample without replacement.  With the (k+1)-th value as threshold, a segmentation's
inclusion score is 1 - exp(-exp(log p - threshold)), given as its logarithm.

Pieces never hold a non-space before a space mark, nor one of the characters that have no
multi-character piece, so texts are cut there into units whose lattices are independent;
each distinct unit of a batch has its lattice built once, and all texts of the batch are
searched together.  Random numbers are hashes of the row's key, the sample, the unit and
the step, so results depend on nothing else.

The vocabulary gives merge ranks, not probabilities; a piece of rank r weighs
1 / (r + `ZIPF_SHIFT`), and each byte of a character without a piece weighs as much as the
last rank.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.textkeys import U, mix
from trailmill.session import bounded_batches

MARK = 0x2581
ZIPF_SHIFT = 10.0
SLICE_CHARS = 1_000_000
NONE = -np.inf
#: Bound of -log u and of -log(-log u) for the numbers that `uniform` gives.
FURTHEST = 40.0


@dataclass
class Vocabulary:
    """Pieces as a trie over code points, with log weights."""

    table: np.ndarray  # hash slots of (node, char) keys
    child: np.ndarray
    root: np.ndarray  # the start's child by code point, or -1
    piece: np.ndarray  # piece of a node, or -1
    weight: np.ndarray  # log weight by piece
    longest: int
    byte_ids: np.ndarray
    byte_weight: float
    joined: np.ndarray  # characters that occur in pieces of several characters
    text: np.ndarray  # bytes of all pieces end to end, marks as spaces
    text_ends: np.ndarray

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = (node.astype(U) << U(21)) | char.astype(U)
        slot = (mix(key) & U(len(self.table) - 1)).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            held = self.table[slot[todo]]
            hit = held == key[todo] + U(1)
            out[todo[hit]] = self.child[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
            slot[todo] = (slot[todo] + 1) & (len(self.table) - 1)
        return out


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    byte_ids, usable, names = np.zeros(256, np.int64), [], []
    for i in range(size):
        name = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            names.append(bytes([int(name[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            names.append(b"")
        else:
            usable.append((i, name))
            names.append(name.replace("▁", " ").encode())
    ranks = {i: r for r, (i, _) in enumerate(sorted(usable, key=lambda x: (-model.get_score(x[0]), x[0])))}
    weight = np.zeros(size)
    nodes: dict[tuple[int, int], int] = {}
    piece = [-1]
    for i, name in usable:
        weight[i] = -np.log(ranks[i] + ZIPF_SHIFT)
        node = 0
        for ch in name:
            key = (node, ord(ch))
            if key not in nodes:
                nodes[key] = len(piece)
                piece.append(-1)
            node = nodes[key]
        piece[node] = i
    slots = 1 << (len(nodes) * 4).bit_length()
    table, child = np.zeros(slots, U), np.zeros(slots, np.int64)
    keys = np.array([(n << 21) | c for n, c in nodes], U)
    at = (mix(keys) & U(slots - 1)).astype(np.int64).tolist()
    for key, slot, value in zip(keys.tolist(), at, nodes.values()):
        while table[slot]:
            slot = (slot + 1) & (slots - 1)
        table[slot], child[slot] = key + 1, value
    root = np.full(0x110000, -1, np.int32)
    for (node, char), value in nodes.items():
        if node == 0:
            root[char] = value
    joined = np.unique(np.array([ord(c) for _, n in usable if len(n) > 1 for c in n], np.int64))
    return Vocabulary(
        table, child, root, np.array(piece), weight, max((len(n) for _, n in usable), default=1), byte_ids, -np.log(len(usable) + ZIPF_SHIFT),
        joined, np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0], np.cumsum([len(n) for n in names])]).astype(np.int64),
    )


# --- lattices -------------------------------------------------------------


@dataclass
class Lattice:
    """Edges of all distinct units: edge e of position i goes to target[e] (0: the unit's end)."""

    first: np.ndarray  # first edge of each position
    target: np.ndarray
    piece: np.ndarray  # piece id, or -1 - code point for a character in bytes
    share: np.ndarray  # log probability of the edge among its position's
    ladder: np.ndarray  # cumulated probability within the position, times 2^32


def build_lattice(chars: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary) -> Lattice:
    """Lattice of the units that begin at `starts` in `chars` (the last ends with it)."""
    n = len(chars)
    ends = np.append(starts[1:], n)[: len(starts)]
    left = np.repeat(ends, ends - starts) - np.arange(n)  # characters to the unit's end
    at, node, found = np.arange(n), vocabulary.root[chars], []
    for length in range(1, vocabulary.longest + 1):
        if length > 1:
            node = vocabulary.step(node, chars[at + length - 1])
        alive = node >= 0
        at, node = at[alive], node[alive]
        piece = vocabulary.piece[node]
        whole = piece >= 0
        found.append((at[whole], piece[whole]))
        more = left[at] > length
        at, node = at[more], node[more]
        if not len(at):
            break
    # A position's first character is an edge always; longer ones are likely and come before it.
    counts = np.ones(n, np.int64)
    for at, _ in found[1:]:
        counts[at] += 1
    first = np.concatenate([[0], np.cumsum(counts)])
    pieces, lengths, free = np.empty(first[-1], np.int64), np.ones(first[-1], np.int64), first[:-1].copy()
    for length in range(len(found), 1, -1):
        at, piece = found[length - 1]
        place = free[at]
        pieces[place], lengths[place], free[at] = piece, length, place + 1
    pieces[free] = -1 - chars
    at, piece = found[0]
    pieces[free[at]] = piece
    froms = np.repeat(np.arange(n), counts)
    weight = vocabulary.weight[np.maximum(pieces, 0)]
    lone = np.flatnonzero(pieces < 0)
    code = -1 - pieces[lone]
    weight[lone] = (1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)) * vocabulary.byte_weight
    target = froms + lengths
    done = lengths == left[froms]
    target[done] = n
    # Backward sums, all units at once: positions by their distance from the unit's end.
    beta = np.zeros(n + 1)
    most = int(left.max()) if n else 0
    by_left = np.argsort(left.astype(np.uint16) if most < 1 << 16 else left, kind="stable")
    bounds = np.searchsorted(left[by_left], np.arange(1, most + 2))
    share, probability = np.empty(len(froms)), np.empty(len(froms))
    for a, b in zip(bounds[:-1], bounds[1:]):
        rows = by_left[a:b]
        size = counts[rows]
        heads = np.cumsum(size) - size
        row = np.repeat(np.arange(len(rows)), size)
        edges = (first[rows] - heads)[row] + np.arange(len(row))
        value = weight[edges] + beta[target[edges]]
        top = np.maximum.reduceat(value, heads)
        value -= top[row]
        part = np.exp(value)
        total = np.add.reduceat(part, heads)
        log_total = np.log(total)
        beta[rows] = top + log_total
        share[edges] = value - log_total[row]
        probability[edges] = part / total[row]
    run = np.concatenate([[0.0], np.cumsum(probability)])
    within = np.clip((run[1:] - np.repeat(run[first[:-1]], counts)) * 2**32, 0, 2**32 - 1).astype(np.uint32)
    within[first[1:] - 1] = 2**32 - 1
    share[first[:-1][counts == 1]] = 0.0
    target[done] = -1
    return Lattice(first, target, pieces, share, within)


def unit_starts(chars: np.ndarray, doc_starts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Positions where a unit begins: texts, space marks after other characters, and lone characters."""
    cut = np.zeros(len(chars) + 1, bool)
    cut[doc_starts] = True
    mark = chars == MARK
    cut[1:-1] |= mark[1:] & ~mark[:-1]
    low = np.zeros(1 << 16, bool)
    low[vocabulary.joined[vocabulary.joined < 1 << 16]] = True
    lone = ~np.where(chars < 1 << 16, low[np.minimum(chars, 0xFFFF)], np.isin(chars, vocabulary.joined[vocabulary.joined >= 1 << 16]))
    cut[:-1] |= lone
    cut[1:] |= lone
    return np.flatnonzero(cut[:-1])


_POWER = np.ones(1, U)


def _unit_keys(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    global _POWER
    base = 0x9E3779B97F4A7C15
    if len(_POWER) < 2 * (len(chars) + 1):
        up, down = np.full(len(chars) + 1, base, U), np.full(len(chars) + 1, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _POWER = np.concatenate([np.cumprod(up), np.cumprod(down)])
    half = len(_POWER) // 2
    sums = np.zeros(len(chars) + 1, U)
    np.cumsum((chars.astype(U) + U(1)) * _POWER[: len(chars)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POWER[half + starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


# --- search ---------------------------------------------------------------


def folded(key: np.ndarray, *parts) -> np.ndarray:
    """A hash of `key` and integer parts, one after another."""
    for part in parts:
        key = mix(key * U(0x9E3779B97F4A7C15) + np.asarray(part).astype(np.int64).view(U) + U(1))
    return key


def fraction(key: np.ndarray) -> np.ndarray:
    return ((key >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def uniform(*parts) -> np.ndarray:
    """Numbers in (0, 1) from integer parts."""
    return fraction(folded(np.zeros(1, U), *parts))


def truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at `location`, given that it is below `bound`."""
    with np.errstate(over="ignore", divide="ignore"):
        return location - np.log(np.exp(location - bound) - np.log(u))


@dataclass
class Paths:
    """One path of each text: its steps end to end, and the values set aside at each."""

    ends: np.ndarray  # steps before each text and in all
    unit: np.ndarray  # place of the step's unit in the batch
    position: np.ndarray  # lattice position
    edge: np.ndarray
    before: np.ndarray  # log probability of the path up to the step
    mass: np.ndarray  # probability of the edges not yet taken at the step
    taken: np.ndarray  # those taken, as bits
    value: np.ndarray  # best perturbed value set aside

    def log_probability(self, lattice: Lattice) -> np.ndarray:
        run = np.concatenate([[0.0], np.cumsum(lattice.share[self.edge])])
        return run[self.ends[1:]] - run[self.ends[:-1]]


class Search:
    """Top-down sampling of all texts of a batch."""

    def __init__(self, lattice: Lattice, head: np.ndarray, unit_ends: np.ndarray, keys: np.ndarray):
        self.lattice, self.head, self.unit_ends, self.keys = lattice, head, unit_ends, keys
        self.doc_of_unit = np.repeat(np.arange(len(keys)), np.diff(unit_ends))
        self.unit_in_doc = np.arange(len(head)) - unit_ends[:-1][self.doc_of_unit]

    def walk(self, unit: np.ndarray, position: np.ndarray, step: np.ndarray, sample: int):
        """Draw from each position to the end of its unit: (unit, position, edge) in order."""
        lattice, out, segment, units = self.lattice, [], np.arange(len(unit)), unit
        taken = np.zeros(len(unit), np.int64)
        key = folded(np.zeros(1, U), self.keys[self.doc_of_unit[unit]], sample, self.unit_in_doc[unit])
        while len(segment):
            level = (fraction(folded(key, step)) * 2**32).astype(np.uint32)
            edge, todo = lattice.first[position], np.arange(len(segment))
            while len(todo):
                todo = todo[lattice.ladder[edge[todo]] < level[todo]]
                edge[todo] += 1
            out.append((segment, position, edge))
            taken[segment] += 1
            target = lattice.target[edge]
            go = target >= 0
            segment, key, position, step = segment[go], key[go], target[go], step[go] + 1
        positions, edges = np.empty(taken.sum(), np.int64), np.empty(taken.sum(), np.int64)
        first = np.cumsum(taken) - taken
        for k, (segment, position, edge) in enumerate(out):
            place = first[segment] + k
            positions[place], edges[place] = position, edge
        return np.repeat(units, taken), positions, edges

    def aside(self, ends, unit, position, edge, bound, sample: int, fresh=None) -> Paths:
        """A path with the values of what each of its steps leaves aside, all below `bound`.

        Steps that are not `fresh` leave nothing: theirs belong to the path branched from.
        """
        lattice = self.lattice
        share = lattice.share[edge]
        run = np.concatenate([[0.0], np.cumsum(share)])
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        before = run[:-1] - run[ends[:-1]][doc]
        # A position's only edge has share 0 and leaves nothing.
        open_ = np.flatnonzero(share < 0 if fresh is None else (share < 0) & fresh)
        mass, location = np.zeros(len(edge)), np.full(len(edge), NONE)
        mass[open_] = -np.expm1(share[open_])
        location[open_] = before[open_] + np.log(mass[open_])
        # -log(-log u) is at most FURTHEST, so a step far below the others can't be the best
        # and needs no number.  What is sure of a step's value grows with its location.
        limit = np.full(len(ends) - 1, NONE)
        full = np.diff(ends) > 0
        if full.any():
            top = np.maximum.reduceat(location, ends[:-1][full])
            with np.errstate(over="ignore", invalid="ignore"):
                limit[full] = np.where(top > NONE, top - np.logaddexp(top - bound[full], np.log(FURTHEST)), NONE)
        can = open_[location[open_] + FURTHEST >= limit[doc[open_]]]
        value = np.full(len(edge), NONE)
        u = uniform(self.keys[doc[can]], sample, self.unit_in_doc[unit[can]], (position - self.head[unit])[can], 7)
        value[can] = truncated(location[can], bound[doc[can]], u)
        return Paths(ends, unit, position, edge, before, mass, np.int64(1) << (edge - lattice.first[position]), value)

    def first_paths(self) -> tuple[Paths, np.ndarray]:
        top = -np.log(-np.log(uniform(self.keys, 0, -1, -1)))
        unit, position, edge = self.walk(np.arange(len(self.head)), self.head, np.zeros(len(self.head), np.int64), 0)
        ends = np.searchsorted(unit, self.unit_ends)
        return self.aside(ends, unit, position, edge, top, 0), top

    def branch(self, source: list[Paths], which: np.ndarray, at: np.ndarray, value: np.ndarray, sample: int) -> Paths:
        """Paths that leave path `which` of each text at its step `at` (an index into that path); -1 for none."""
        lattice, docs = self.lattice, len(self.keys)
        parts = []
        for k, path in enumerate(source):
            mine = np.flatnonzero((which == k) & (at >= 0))
            if not len(mine):
                continue
            step = at[mine]
            position, unit = path.position[step], path.unit[step]
            # Another edge, among those not yet taken, by its share.
            size = lattice.first[position + 1] - lattice.first[position]
            row = np.repeat(np.arange(len(mine)), size)
            edge = np.repeat(lattice.first[position] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            free = (path.taken[step][row] >> (edge - lattice.first[position][row]) & 1) == 0
            noise = -np.log(-np.log(uniform(self.keys[mine][row], sample, self.unit_in_doc[unit][row], position[row] - self.head[unit][row], edge - lattice.first[position][row], 11)))
            score = np.where(free, lattice.share[edge] + noise, NONE)
            best = np.lexsort((-score, row))[np.cumsum(size) - size]
            chosen = edge[best]
            # What is still left aside there, below the value just popped.
            path.taken[step] |= np.int64(1) << (chosen - lattice.first[position])
            mass = np.bincount(row, np.where(free, np.exp(lattice.share[edge]), 0.0), len(mine)) - np.exp(lattice.share[chosen])
            others = np.bincount(row, free, len(mine)) > 1
            path.mass[step] = np.where(others, np.maximum(mass, 1e-300), 0.0)
            with np.errstate(divide="ignore"):
                location = path.before[step] + np.log(path.mass[step])
            u = uniform(self.keys[mine], sample, self.unit_in_doc[unit], position - self.head[unit], 13)
            path.value[step] = np.where(others, truncated(location, value[mine], u), NONE)
            # The path up to there, the new edge, the rest of its unit, and all later units.
            keep = step - path.ends[mine]
            doc = np.repeat(np.arange(len(mine)), keep)
            old = np.repeat(path.ends[mine] - (np.cumsum(keep) - keep), keep) + np.arange(keep.sum())
            parts.append((path.unit[old], path.position[old], path.edge[old], np.zeros(len(old), bool)))
            parts.append((unit, position, chosen, np.zeros(len(mine), bool)))
            target = lattice.target[chosen]
            later = self.unit_ends[mine + 1] - unit - 1
            go = target >= 0
            depth = np.searchsorted(path.unit, unit, "left")
            seg_unit = [unit[go]]
            seg_pos = [target[go]]
            seg_step = [(step - depth + 1)[go]]
            rest = np.repeat(unit + 1 - (np.cumsum(later) - later), later) + np.arange(later.sum())
            seg_unit.append(rest)
            seg_pos.append(self.head[rest])
            seg_step.append(np.zeros(len(rest), np.int64))
            u2, p2, e2 = self.walk(*(np.concatenate(x) for x in (seg_unit, seg_pos, seg_step)), sample)
            parts.append((u2, p2, e2, np.ones(len(u2), bool)))
        if not parts:
            empty = np.zeros(0, np.int64)
            return self.aside(np.zeros(docs + 1, np.int64), empty, empty, empty, value, sample)
        unit, position, edge, fresh = (np.concatenate(x) for x in zip(*parts))
        # Positions grow along a unit's path, so they give the order of its steps.
        order = np.argsort((unit << 32) | (position - self.head[unit]), kind="stable")
        unit, position, edge, fresh = (x[order] for x in (unit, position, edge, fresh))
        made = self.aside(np.searchsorted(unit, self.unit_ends), unit, position, edge, value, sample, fresh)
        return made

    def best(self, paths: list[Paths]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(path, step, value) of the largest value set aside of each text."""
        docs = len(self.keys)
        which, at, value = np.zeros(docs, np.int64), np.full(docs, -1), np.full(docs, NONE)
        for k, path in enumerate(paths):
            full = np.flatnonzero(np.diff(path.ends) > 0)
            if not len(full):
                continue
            top = np.maximum.reduceat(path.value, path.ends[full])
            doc = np.repeat(np.arange(len(full)), np.diff(path.ends)[full])
            hit = np.flatnonzero(path.value == top[doc])
            place = hit[np.searchsorted(doc[hit], np.arange(len(full)))]
            better = top > value[full]
            which[full[better]], at[full[better]], value[full[better]] = k, place[better], top[better]
        return which, at, value


@dataclass
class Sample:
    """One drawn segmentation of each text that has so many."""

    docs: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    log_probability: np.ndarray
    value: np.ndarray


def edge_ids(pieces: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids, with characters without a piece as bytes, and the texts' new ends."""
    lone = np.flatnonzero(pieces < 0)
    if not len(lone):
        return pieces, ends
    code = -1 - pieces[lone]
    size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    sizes = np.ones(len(pieces), np.int64)
    sizes[lone] = size
    run = np.concatenate([[0], np.cumsum(sizes)])
    out = np.repeat(pieces, sizes)
    for total in (1, 2, 3, 4):
        these = size == total
        c = code[these]
        for k in range(total):
            shift = 6 * (total - 1 - k)
            byte = c if total == 1 else ((0xFF00 >> total & 0xFF) | (c >> shift)) if k == 0 else (0x80 | (c >> shift & 0x3F))
            out[run[lone[these]] + k] = vocabulary.byte_ids[byte]
    return out, run[ends]


def sample_texts(texts: list[str], keys: np.ndarray, k: int, vocabulary: Vocabulary) -> tuple[list[Sample], np.ndarray]:
    """k samples without replacement (fewer where a text has fewer segmentations), and the threshold.

    Texts are as SentencePiece normalises them for this kind of model: a space in front,
    spaces as marks; an empty text stays empty and has one, empty, segmentation.
    """
    prepared = [" " + t if t else "" for t in texts]
    sizes = np.array([len(t) for t in prepared])
    chars = np.frombuffer("".join(prepared).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    chars[chars == 0x20] = MARK
    doc_ends = np.concatenate([[0], np.cumsum(sizes)])
    starts = unit_starts(chars, doc_ends[:-1][sizes > 0], vocabulary) if len(chars) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(chars)) if len(chars) else starts
    _, index, inverse = np.unique(_unit_keys(chars, starts, ends), return_index=True, return_inverse=True)
    length = (ends - starts)[index]
    heads = np.cumsum(length) - length
    distinct = chars[np.repeat(starts[index] - heads, length) + np.arange(length.sum())]
    lattice = build_lattice(distinct, heads, vocabulary)
    search = Search(lattice, heads[inverse], np.searchsorted(starts, doc_ends), keys)
    first, value = search.first_paths()
    paths, samples = [first], []
    present = np.arange(len(texts))
    for r in range(k):
        path = paths[r]
        ids, id_ends = edge_ids(lattice.piece[path.edge], path.ends, vocabulary)
        grown = np.diff(id_ends)
        samples.append(Sample(present, np.concatenate([[0], np.cumsum(grown[present])]), ids, path.log_probability(lattice)[present], value[present]))
        which, at, value = search.best(paths)
        present = np.flatnonzero(value > NONE)
        if r + 1 < k:
            at = np.where(value > NONE, at, -1)
            paths.append(search.branch(paths, which, at, value, r + 1))
    return samples, value


def decode_bytes(ids: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """UTF-8 bytes of each id sequence, without the space in front."""
    size = np.diff(vocabulary.text_ends)[ids]
    run = np.concatenate([[0], np.cumsum(size)])
    raw = vocabulary.text[np.repeat(vocabulary.text_ends[ids] - run[:-1], size) + np.arange(run[-1])].tobytes()
    cuts = run[ends].tolist()
    return [raw[a + 1 : b] if raw[a : a + 1] == b" " and b > a else raw[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def log_inclusion(log_probability: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        x = log_probability - threshold
        return np.where(x < -30, x, np.where(x > 30, 0.0, np.log(-np.expm1(-np.exp(x)))))


# --- DataFrame ------------------------------------------------------------


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def row_keys(batch, seed: int) -> np.ndarray:
    return mix(batch.column("_key").to_numpy().view(U) ^ mix(np.array([seed], np.int64).view(U))).view(np.int64)


def _sampled(kept: list[str], k: int, seed: int, model: str):
    def run(batches):
        vocabulary = load_vocabulary(vocabulary_path(model))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = row_keys(batch, seed)
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_CHARS):
                    size, to = size + len(texts[to]), to + 1
                samples, threshold = sample_texts(texts[at:to], keys[at:to], k, vocabulary)
                for r, s in enumerate(samples, 1):
                    if not len(s.docs):
                        continue
                    inclusion = log_inclusion(s.log_probability, threshold[s.docs])
                    rows = pa.array(s.docs + at)
                    ids = pa.ListArray.from_arrays(pa.array(s.ends.astype(np.int32)), pa.array(s.ids.astype(np.int32)))
                    crc = [zlib.crc32(b) for b in decode_bytes(s.ids, s.ends, vocabulary)]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(rows) for c in kept), pa.array(np.full(len(rows), r, np.int32)), ids, pa.array(s.log_probability), pa.array(s.value), pa.array(inclusion), pa.array(crc, pa.int64())],
                        names=[*kept, "sample", "ids", "log_probability", "perturbed", "log_inclusion", "decoded_crc32"],
                    )
                at = to

    return run


def sample_segmentations(docs: DataFrame, key: str = "doc_id", k: int = 2, seed: int = 0, model: str = "piece_bpe_32k.model") -> DataFrame:
    """`docs` without text, one row per sampled segmentation.

    sample counts from 1 in order of the perturbed value; ids are piece ids;
    log_probability is the segmentation's share of its text's lattice; log_inclusion is 0
    where a text has no more than k segmentations.  decoded_crc32 is that of the decoded ids'
    UTF-8 bytes, which are the text's.  A null or empty text has one empty segmentation.
    Equal texts under equal keys get equal samples.  Columns of these names in the input
    are replaced.
    """
    own = ("text", "sample", "ids", "log_probability", "perturbed", "log_inclusion", "decoded_crc32", "_key")
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in own]
    ready = docs.select(*kept, F.col("text").cast("string").alias("text"), F.xxhash64(key).alias("_key"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields), "sample int, ids array<int>, log_probability double, perturbed double, log_inclusion double, decoded_crc32 long"])
    return ready.mapInArrow(_sampled(kept, k, seed, model), schema)


def decode(sequences: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """`sequences` with `text` decoded from `ids` (null for null); bytes that are no UTF-8 become U+FFFD."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in sequences.drop("text").schema.fields]

    def run(batches):
        vocabulary = load_vocabulary(vocabulary_path(model))
        for batch in batches:
            lists = batch.column("ids")
            filled = [x or [] for x in lists.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in filled])]).astype(np.int64)
            flat = np.array([i for x in filled for i in x], np.int64)
            texts = [b.decode("utf-8", "replace") for b in decode_bytes(flat, ends, vocabulary)]
            texts = [t if valid else None for t, valid in zip(texts, lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return sequences.drop("text").mapInArrow(run, ", ".join([*fields, "text string"]))
