"""Sampled SentencePiece segmentations without replacement, and decoding.

A text's lattice has a node at each character and an edge for each vocabulary piece that spells what lies between two
nodes; a character outside the vocabulary is a chain of byte pieces. A piece weighs ``(2 + rank) ** -alpha``, the rank
being its place in the model by score, and a segmentation's probability is proportional to its pieces' weights.
Between two characters that stand side by side in no piece no edge passes, so the lattice of a text is a chain of the
lattices of its units, cut there (before most spaces, at signs, within rare words); a unit's backward sums, which turn
weights into exact probabilities of each next edge, are computed once a distinct unit.

Gumbel top-k by a perturbed A* search. The frontier holds sets of segmentations: those that leave a path met before
at one of a range of its nodes, by an edge not yet taken. A set's priority is its perturbed log-probability, the maximum
over its members. Popping the largest fixes one member: the node where it leaves the path and the edge it takes are
drawn by the mass behind them, and then it follows edges at random to the end, which is how the member that attains the
maximum is distributed; it keeps the set's priority. What else was in the set returns to the frontier as four sets, the
nodes before that node, the node's other edges, the nodes after it, and what leaves the new path, each with a
priority drawn from the Gumbel law about its mass, truncated at the popped one. A range's mass is a difference of two
prefixes' probabilities, so a set costs the same whatever it holds. Complete paths leave the search in falling order
of priority: k draws without replacement. The (k+1)th priority, ``kappa``, gives each draw's inclusion probability
1 - exp(-exp(log p - kappa)).

All texts of a slice are searched side by side in numpy. Random numbers are hashes of (key, purpose, draw, unit, step): a
row's samples depend on its key and text alone, not on its batch or task.

Defined results: a null or empty text is the model's lone space, one segmentation; a text with fewer than k
segmentations gives them all, each with inclusion 1; equal keys and texts give equal rows; a null key counts as 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, texts

SPACE = "▁"
SLICE = 1 << 19
IDS = 1 << 18
MOST_EDGES = 4_000_000  # a task's memory; forgotten beyond it, without a change of results
C1, C2, C3, C4, C5 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
FIRST, STEP, NODE, EDGE, BEFORE, SIBLING, AFTER, INSIDE = range(8)  # purposes of random numbers


def mixture(key: np.ndarray, purpose: int, draw: int, unit: np.ndarray | int = 0) -> np.ndarray:
    """What ``spread`` makes random numbers of."""
    with np.errstate(over="ignore"):
        x = key * C1
        x += np.asarray(unit).astype(np.uint64) * C3 + np.uint64((int(C2) * draw + int(C5) * purpose) & 0xFFFFFFFFFFFFFFFF)
    return x


def spread(x: np.ndarray, step: int = 0) -> np.ndarray:
    """In (0, 1): a hash of each number and the step."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(int(C4) * step & 0xFFFFFFFFFFFFFFFF)
        for m in (C2, C4):
            x ^= x >> np.uint64(31)
            x *= m
    x ^= x >> np.uint64(29)
    x >>= np.uint64(12)
    u = x.astype(np.float64)
    u += 0.5
    u *= 2.0**-52
    return u


def uniform(key: np.ndarray, purpose: int, draw: int) -> np.ndarray:
    """In (0, 1): a hash of the three numbers."""
    return spread(mixture(key, purpose, draw))


def truncated(place: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates about ``place`` given that they are at most ``most``."""
    with np.errstate(invalid="ignore"):
        g = place - np.logaddexp(np.log(-np.log(u)), place - most)
    return np.where(np.isfinite(place), np.minimum(g, most), -np.inf)


class Grown:
    """Numbers that are appended to; views of what was there before stay as they are."""

    def __init__(self, kind: str) -> None:
        self.held, self.n = np.empty(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    def extend(self, values: np.ndarray) -> None:
        size = self.n + len(values)
        if size > len(self.held):
            larger = np.empty(max(size, 2 * len(self.held)), self.held.dtype)
            larger[: self.n] = self.held[: self.n]
            self.held = larger
        self.held[self.n : size] = values
        self.n = size

    def view(self) -> np.ndarray:
        return self.held[: self.n]


class Trie:
    """The vocabulary as a hash table of (node, character) to node; many walks advance together."""

    def __init__(self, pieces: dict[str, tuple[int, float]]) -> None:
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for spelling, entry in pieces.items():
            at = 0
            for c in spelling:
                at = nodes.setdefault((at, ord(c)), len(nodes) + 1)
            ends[at] = entry
        keys = np.array([a << 21 | c for a, c in nodes], np.uint64)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.keys, self.child = np.full(1 << (64 - int(self.shift)), C5), np.zeros(1 << (64 - int(self.shift)), np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # each free slot to one of the keys that ask for it; the others ask for the next
            free = np.flatnonzero(self.keys[at] == C5)
            slots, who = np.unique(at[free], return_index=True)
            won = free[who]
            self.keys[slots], self.child[slots] = keys[left[won]], left[won] + 1
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & (len(self.keys) - 1)
        self.piece, self.weight = np.full(len(nodes) + 1, -1, np.int32), np.zeros(len(nodes) + 1)
        for at, (piece, weight) in ends.items():
            self.piece[at], self.weight[at] = piece, weight

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * C1 >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The node that each character leads to; 0: none."""
        keys = (state << 21 | characters).view(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.child[at], 0)
        open_ = np.flatnonzero(~hit & (found != C5))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.child[at[open_[hit]]]
            open_ = open_[~hit & (found != C5)]
        return out

    def matches(self, cp: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece, weight) of every piece found at any place of ``cp`` and before that place's end."""
        alive, state, length, found = np.arange(len(cp)), np.zeros(len(cp), np.int64), 0, []
        while len(alive):
            state = self.step(state, cp[alive + length])
            hit = np.flatnonzero(state)
            alive, state, length = alive[hit], state[hit], length + 1
            whole = self.piece[state] >= 0
            found.append((alive[whole], np.full(int(whole.sum()), length), self.piece[state[whole]], self.weight[state[whole]]))
            inside = alive + length < end[alive]
            alive, state = alive[inside], state[inside]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Lattices:
    """Edges of the lattices of the units met so far, by node."""

    def __init__(self, path: str, alpha: float) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes_of = np.zeros(256, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.bytes_of[int(model.id_to_piece(i)[1:-1], 16)] = i
        by_score = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.trie = Trie({model.id_to_piece(i): (i, (2.0 + rank) ** -alpha) for rank, i in enumerate(by_score)})
        self.rare = (2.0 + n) ** -alpha
        joined = [model.id_to_piece(i) for i in plain if len(model.id_to_piece(i)) > 1]
        letters = sorted({c for p in joined for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # its number among those that stand beside another in a piece; 0: none
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        pairs = self.letter[np.array([(ord(a), ord(b)) for p in joined for a, b in zip(p, p[1:], strict=False)])]
        self.beside[pairs[:, 0], pairs[:, 1]] = True
        raw = [b""] * n
        for i in plain:
            raw[i] = model.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes_of):
            raw[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(raw), np.uint8)
        self.spelt_length = np.array([len(r) for r in raw], np.int64)
        self.spelt_start = np.cumsum(self.spelt_length) - self.spelt_length
        self.forget()

    def forget(self) -> None:
        self.start: dict[str, int] = {}
        self.first, self.piece, self.to, self.log, self.upto = map(Grown, "iiidd")
        self.first.extend(np.zeros(1, np.int32))  # of each node, its first edge; one more at the end

    def add(self, units: list[str]) -> np.ndarray:
        """Add the lattices of distinct ``units``, not empty; their first nodes. A unit's nodes are its characters and its
        end, one after another; the nodes inside byte chains follow those of all units. An edge to a unit's end leads to
        the node's number below -1 (``~``)."""
        sizes = np.array([len(u) for u in units])
        cp = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), sizes)
        end = np.cumsum(sizes)[unit]
        source, length, piece, weight = self.trie.matches(cp, end)
        alone = np.zeros(len(cp), bool)
        alone[source[length == 1]] = True
        lone = np.flatnonzero(~alone)
        spelt = [chr(cp[c]).encode("utf-8", "surrogatepass") for c in lone.tolist()]
        links = np.array([len(b) - 1 for b in spelt], np.int64)
        source, length = np.concatenate([source, lone]), np.concatenate([length, np.ones(len(lone), np.int64)])
        piece = np.concatenate([piece, self.bytes_of[[b[0] for b in spelt]]]) if spelt else piece
        weight = np.concatenate([weight, self.rare ** (links + 1)])
        node = np.arange(len(cp)) + unit
        to = node[source] + length
        n_nodes = len(cp) + len(units)
        chain_first = n_nodes + np.cumsum(links) - links
        into = np.flatnonzero(links) + len(source) - len(lone)
        sum_to = to.copy()
        to[into] = chain_first[links > 0]
        order = np.argsort(source, kind="stable")
        source, piece, weight, to, sum_to = (x[order] for x in (source, piece, weight, to, sum_to))
        chance = self._chances(source, weight, node, sum_to, end - np.arange(len(cp)), n_nodes)
        counts = np.bincount(node[source], minlength=n_nodes)
        starts = np.cumsum(counts) - counts
        run = np.cumsum(chance)
        upto = run - (run[starts[node]] - chance[starts[node]])[source]
        last = starts[node] + counts[node] - 1
        upto = np.minimum(upto, 1.0)
        upto[last] = 1.0
        chain_node = n_nodes + np.arange(int(links.sum()))
        chain_to = chain_node + 1
        ends = (np.cumsum(links) - 1)[links > 0]
        chain_to[ends] = node[lone[links > 0]] + 1
        chain_piece = self.bytes_of[np.frombuffer(b"".join(b[1:] for b in spelt), np.uint8)]
        base = len(self.first) - 1
        self.first.extend(len(self.piece) + np.cumsum(np.concatenate([counts, np.ones(len(chain_node), np.int64)])))
        self.piece.extend(np.concatenate([piece, chain_piece]))
        last = np.zeros(n_nodes + len(chain_node), bool)
        last[np.cumsum(sizes) + np.arange(len(units))] = True
        to = np.concatenate([to, chain_to])
        self.to.extend(np.where(last[to], ~(base + to), base + to))
        self.log.extend(np.concatenate([np.log(chance), np.zeros(len(chain_node))]))
        self.upto.extend(base + np.concatenate([node[source] + upto, chain_node + 1.0]))
        starts = base + np.cumsum(sizes) - sizes + np.arange(len(units))
        self.start.update(zip(units, starts.tolist(), strict=True))
        return starts

    @staticmethod
    def _chances(source: np.ndarray, weight: np.ndarray, node: np.ndarray, to: np.ndarray, distance: np.ndarray, n_nodes: int) -> np.ndarray:
        """Probability of each edge at its source: its weight times all that follows it, summed from the units' ends
        backwards, all characters at one distance from their end together."""
        log_sum, chance = np.zeros(n_nodes), np.empty(len(source))
        far = distance[source]
        by = np.argsort(far.astype(np.uint16) if far.max(initial=0) < 1 << 16 else far, kind="stable")
        levels = np.flatnonzero(np.diff(far[by], prepend=0))
        for low, high in zip(levels, [*levels[1:], len(by)], strict=True):
            edges = by[low:high]
            at = source[edges]
            heads = np.flatnonzero(np.diff(at, prepend=-1))
            here = node[at[heads]]
            reference = log_sum[here + 1]
            each = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(at)))
            value = weight[edges] * np.exp(np.minimum(log_sum[to[edges]] - reference[each], 700.0))
            total = np.add.reduceat(value, heads)
            log_sum[here] = reference + np.log(total)
            chance[edges] = value / total[each]
        return chance

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(text of each unit, its index among the distinct units, those)."""
        marked = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), pc.replace_substring(column, " ", SPACE), pa.scalar("", pa.large_string()))
        ends = np.cumsum(pc.binary_length(marked).to_numpy(zero_copy_only=False).astype(np.int64))
        data = pa.py_buffer(np.frombuffer(marked.buffers()[2], np.uint8)[: ends[-1] if len(ends) else 0])
        cp = np.frombuffer(data.to_pybytes().decode().encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))
        place = np.concatenate([[0], place])  # of each character in the bytes, and their end
        letters = self.letter[cp]
        heads = np.ones(len(cp), bool)
        heads[1:] = ~self.beside[letters[:-1], letters[1:]]
        texts = np.searchsorted(place, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
        heads[texts] = True
        first = np.flatnonzero(heads)
        offsets = np.concatenate([place[first], place[-1:]]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), data).dictionary_encode()
        row = np.searchsorted(texts, first, side="right") - 1
        return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()

    def starts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first node of each unit of each text in order, units of each text)."""
        row, code, units = self.units(column)
        known = self.start.get
        at = np.array([known(u, -1) for u in units], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self.add([units[k] for k in new.tolist()])
        return at[code], np.bincount(row, minlength=len(column))

    def views(self) -> tuple[np.ndarray, ...]:
        return tuple(a.view() for a in (self.first, self.piece, self.to, self.log, self.upto))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def log_difference(more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """log(exp(more) - exp(less)); -inf where they are equal."""
    with np.errstate(divide="ignore"):
        return more + np.log(-np.expm1(np.minimum(less - more, 0)))


class Paths:
    """One path of some texts: edges and units of all, and the log-probability of each path up to and with each edge."""

    def __init__(self, texts: np.ndarray, edges: np.ndarray, units: np.ndarray, counts: np.ndarray, log: np.ndarray, n: int) -> None:
        self.edges, self.units, self.counts = edges, units, counts
        ends = np.cumsum(counts)
        starts = ends - counts
        steps = log.copy()
        steps[starts[1:]] -= np.add.reduceat(log, starts)[:-1]  # sums start anew at each text
        self.upto = np.cumsum(steps)
        self.start, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[texts], self.end[texts] = starts, ends
        base = self.upto[starts] - log[starts]  # what rounding left of the texts before
        self.upto -= np.repeat(base, counts)

    def before(self, texts: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log-probability of the texts' paths up to these places."""
        return np.where(places > self.start[texts], self.upto[np.maximum(places, 1) - 1], 0.0)


class Search:
    """The searches of all texts of a slice."""

    def __init__(self, lattices: Lattices, column: pa.Array, keys: np.ndarray) -> None:
        if len(lattices.piece) > MOST_EDGES:
            lattices.forget()
        self.unit_start, counts = lattices.starts(column)
        self.text = np.repeat(np.arange(len(column)), counts)
        self.number = np.arange(len(self.text)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.keys, self.n = keys, len(column)
        self.first, self.piece, self.to, self.log, self.upto = lattices.views()
        self.last_unit = np.cumsum(counts)

    def walk(self, units: np.ndarray, nodes: np.ndarray, draw: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Follow edges at random from each unit's node, below 0 at its end, to the end: (edges, their log-probabilities,
        their pieces, places among ``units``) in order. Units go by node, so that equal ones read the same lattice."""
        found = []
        lengths = np.zeros(len(units), np.int64)
        live = np.argsort(nodes)
        live = live[np.searchsorted(nodes[live], 0) :]
        now, step = nodes[live], 0
        own = units[live]
        seeds = mixture(self.keys[self.text[own]], STEP, draw, self.number[own])
        while len(live):
            edge = self._choose(now, spread(seeds, step))
            found.append((live, edge, self.log[edge], self.piece[edge]))
            now, step = self.to[edge], step + 1
            lengths[live] = step
            go = np.flatnonzero(now >= 0)
            live, now, seeds = live[go], now[go], seeds[go]
        starts = np.cumsum(lengths) - lengths
        edges, logs, ids = (np.empty(int(lengths.sum()), kind) for kind in (np.int32, np.float64, np.int32))
        for step, (owner, edge, log, piece) in enumerate(found):
            place = starts[owner] + step
            edges[place], logs[place], ids[place] = edge, log, piece
        return edges, logs, ids, np.repeat(np.arange(len(units)), lengths)

    def _choose(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node in whose share of 0 to 1 ``u`` lies."""
        edge, target = self.first[nodes], nodes + u
        low = np.flatnonzero(self.upto[edge] < target)
        while len(low):
            edge[low] += 1
            low = low[self.upto[edge[low]] < target[low]]
        return edge

    def run(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each draw: (texts that have it, ids, counts, log-probability, priority); last, kappa of all texts."""
        every, n = np.arange(self.n), self.n
        edges, logs, ids, units = self.walk(np.arange(len(self.text)), self.unit_start, 0)
        counts = np.bincount(self.text[units], minlength=n)
        found = Paths(every, edges, units, counts, logs, n)
        log_p = found.upto[found.end - 1]
        perturbed = -np.log(-np.log(uniform(self.keys, FIRST, 0)))
        yield every, ids, counts, log_p, perturbed
        paths, taken = [found], {}
        #: A column a set: its path, the range of places where its members leave it, whether taken edges are listed.
        path, low, high, listed = np.zeros((n, 1), np.int64), found.start[:, None].copy(), found.end[:, None].copy(), np.zeros((n, 1), bool)
        priority = truncated(log_difference(np.zeros(n), log_p), perturbed, uniform(self.keys, INSIDE, 0))[:, None]
        for draw in range(1, k + 1):
            column = priority.argmax(1)
            best = priority[every, column]
            alive = np.flatnonzero(np.isfinite(best))
            if draw == k or not len(alive):
                yield every, None, None, None, best
                return
            column, most = column[alive], best[alive]
            q, a, b, single = path[alive, column], low[alive, column], high[alive, column], listed[alive, column]
            priority[alive, column] = -np.inf
            place = self._leaves(paths, alive, q, a, b, uniform(self.keys[alive], NODE, draw))
            own, before, after = np.empty(len(alive), np.int64), np.empty(len(alive)), np.empty(len(alive))
            unit, start = np.empty(len(alive), np.int64), np.empty(len(alive), np.int64)
            base, total = np.empty(len(alive)), np.empty(len(alive))
            for p in np.unique(q):
                its = q == p
                of, t = paths[p], alive[its]
                own[its], unit[its], start[its] = of.edges[place[its]], of.units[place[its]], of.start[t]
                before[its], after[its] = of.before(t, place[its]), of.upto[place[its]]
                base[its], total[its] = of.before(t, a[its]), of.upto[b[its] - 1]
            known = {x: taken[int(alive[x]), int(column[x])] for x in np.flatnonzero(single).tolist()}
            pick, rest = self._branches(own, known, uniform(self.keys[alive], EDGE, draw))

            sizes = self.last_unit[alive] - unit
            tails = ranges(unit, sizes)
            nodes = self.unit_start[tails]
            nodes[np.cumsum(sizes) - sizes] = self.to[pick]
            tail, tail_logs, tail_ids, tail_owner = self.walk(tails, nodes, draw)
            tail_units = tails[tail_owner]
            tail_counts = np.bincount(np.searchsorted(alive, self.text[tail_units]), minlength=len(alive))
            head = place - start
            counts = head + 1 + tail_counts
            starts = np.cumsum(counts) - counts
            edges, units, logs, ids = (np.empty(int(counts.sum()), kind) for kind in (np.int32, np.int64, np.float64, np.int32))
            for p in np.unique(q):
                its = q == p
                into, source = ranges(starts[its], head[its]), ranges(start[its], head[its])
                edges[into], units[into] = paths[p].edges[source], paths[p].units[source]
            edges[starts + head], units[starts + head] = pick, unit
            before_tail = ranges(starts, head + 1)
            logs[before_tail], ids[before_tail] = self.log[edges[before_tail]], self.piece[edges[before_tail]]
            into = ranges(starts + head + 1, tail_counts)
            edges[into], units[into], logs[into], ids[into] = tail, tail_units, tail_logs, tail_ids
            found = Paths(alive, edges, units, counts, logs, n)
            log_p = found.upto[found.end[alive] - 1]
            paths.append(found)
            yield alive, ids, counts, log_p, most

            whole = np.where(single, -np.inf, 0.0)  # a listed node has nothing before or after it
            begun = starts + head + 1
            sets = (
                (BEFORE, q, a, place, log_difference(base, before) + whole),
                (SIBLING, q, place, place + 1, before + rest),
                (AFTER, q, place + 1, b, log_difference(after, np.minimum(total, after)) + whole),
                (INSIDE, np.full(len(alive), len(paths) - 1), begun, found.end[alive], log_difference(before + self.log[pick], log_p)),
            )
            width = path.shape[1]
            for x in range(len(alive)):
                taken[int(alive[x]), width + 1] = [*known.get(x, [int(own[x])]), int(pick[x])]
            wider = lambda old, fill: np.concatenate([old, np.full((n, len(sets)), fill, old.dtype)], 1)
            path, low, high, listed, priority = wider(path, 0), wider(low, 0), wider(high, 0), wider(listed, False), wider(priority, -np.inf)
            for c, (purpose, its_path, first, last, mass) in enumerate(sets, width):
                path[alive, c], low[alive, c], high[alive, c], listed[alive, c] = its_path, first, last, purpose == SIBLING
                some = np.where(last > first, mass, -np.inf)
                priority[alive, c] = truncated(some, most, uniform(self.keys[alive], purpose, draw))

    @staticmethod
    def _leaves(paths: list[Paths], texts: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, u: np.ndarray) -> np.ndarray:
        """A place of each range, drawn by the mass that leaves there: the first where the share of the range's mass
        that has left exceeds ``u``, by bisection."""
        place = low.copy()
        for p in np.unique(q):
            its = np.flatnonzero(q == p)
            of, t = paths[p], texts[its]
            base, end = of.before(t, low[its]), of.upto[high[its] - 1]
            bound = base + np.log1p(u[its] * np.expm1(np.minimum(end - base, 0)))
            bound = np.maximum(bound, np.nextafter(end, np.inf))  # where rounding left none: the last place with any mass
            a, b = low[its].copy(), high[its] - 1
            while (a < b).any():
                middle = (a + b) >> 1
                left = of.upto[middle] < bound
                a, b = np.where(left, a, np.minimum(middle + 1, b)), np.where(left, middle, b)
            place[its] = a
        return place

    def _branches(self, own: np.ndarray, known: dict[int, list[int]], u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An edge beside each of ``own`` and the log of what its node's edges weigh without both; ``known``: edges
        that are taken, ``own`` among them, where that is not the only one."""
        node = np.searchsorted(self.first, own.astype(self.first.dtype), side="right") - 1
        starts, counts = self.first[node].astype(np.int64), (self.first[node + 1] - self.first[node]).astype(np.int64)
        edges, owner = ranges(starts, counts), np.repeat(np.arange(len(own)), counts)
        weight = np.exp(self.log[edges])
        weight[edges == own[owner]] = 0
        begins = np.cumsum(counts) - counts
        for x, gone in known.items():
            weight[begins[x] + np.array(gone) - starts[x]] = 0
        total = np.add.reduceat(weight, begins)
        run = np.cumsum(weight)
        run -= np.repeat(run[begins] - weight[begins], counts)
        fits = (run >= (u * total)[owner]) & (weight > 0)
        last = np.maximum.reduceat(np.where(weight > 0, np.arange(len(edges)), 0), begins)  # where rounding left none
        at = np.minimum(np.minimum.reduceat(np.where(fits, np.arange(len(edges)), len(edges)), begins), last)
        weight[at] = 0
        with np.errstate(divide="ignore"):
            return edges[at], np.log(np.add.reduceat(weight, begins))


_lattices: dict[tuple[str, float], Lattices] = {}


def lattices(path: str, alpha: float) -> Lattices:
    """One store of lattices a worker process."""
    if (path, alpha) not in _lattices:
        _lattices[path, alpha] = Lattices(path, alpha)
    return _lattices[path, alpha]


def sample(docs: DataFrame, model: str, k: int = 3, alpha: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sample from 0, ids, log_prob, perturbed, inclusion, text_hash): up to ``k`` distinct segmentations of
    each text, in falling order of perturbed log-probability. text_hash: xxhash64 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = lattices(model, alpha)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                numbers = np.array([x or 0 for x in part.column(1).to_pylist()], np.int64).view(np.uint64)
                search = Search(store, texts(part, "_text"), numbers)
                *draws, (_, _, _, _, kappa) = search.run(k)
                for d, (own, pieces, counts, log_p, perturbed) in enumerate(draws):
                    with np.errstate(over="ignore"):
                        inclusion = np.where(np.isfinite(kappa[own]), -np.expm1(-np.exp(log_p - kappa[own])), 1.0)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(pieces, pa.int32()))
                    places = pa.array(own)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(places), pa.array(np.full(len(own), d), pa.int32()), ids, pa.array(log_p), pa.array(perturbed), pa.array(inclusion), part.column(2).take(places)], [key, "sample", "ids", "log_prob", "perturbed", "inclusion", "text_hash"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("_key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, text_hash long")


def spell(store: Lattices, lists: pa.ListArray) -> list[str]:
    """The text of each list of ids, without the space before it."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = store.spelt_length[flat]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    spelt = store.spelt[np.arange(total) + np.repeat(store.spelt_start[flat] - ends + lengths, lengths)].tobytes()
    at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])].tolist()
    return [spelt[a + 1 : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def decode(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Replace ``ids`` by the text that its pieces spell."""
    kept = [c for c in rows.columns if c not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = lattices(model, 1.0)
        for batch in batches:
            lists = batch.column(len(kept))
            upto = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:  # some IDS at a time, or one longer row
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + IDS, side="right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(len(kept))], pa.array(spell(store, part.column(len(kept))), pa.string())], [*kept, out])
                at = to

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], f"`{out}` string"])
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`")).mapInArrow(run, schema)
