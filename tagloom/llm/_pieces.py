"""Lattices of vocabulary pieces over many byte strings at once.

A vocabulary comes from a tokenizer's model file, whose path is a parameter; it is read on the driver
(its size is fixed) and sent to the tasks. A word's space is the byte 32 in front of it; a literal
space mark of the model in a text is spelled in bytes, as are all characters outside the vocabulary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import _text

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


class Lattice(NamedTuple):
    """Edges of all units: unit ``u`` has nodes ``base[u] .. base[u + 1] - 1``, one per byte and one for its end."""

    base: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    unit: np.ndarray


class Vocabulary:
    """Pieces as bytes with log scores; ids are those of the model."""

    def __init__(self, path: str = TOKENIZER):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size, self.byte_ids, self.bytes_of = size, np.full(256, -1, np.int64), [b""] * size
        usable = []
        for k in range(size):
            if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                continue
            name = model.id_to_piece(k)
            if model.is_byte(k):
                byte = int(name[3:5], 16)
                self.byte_ids[byte], self.bytes_of[k] = k, bytes([byte])
            else:
                self.bytes_of[k] = name.replace("▁", " ").encode()
                usable.append(k)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        # the model's scores order the pieces; a Zipf law over their ranks makes them log probabilities
        rank = np.full(size, size, np.float64)
        order = sorted(usable, key=lambda k: (-model.get_score(k), k))
        rank[order] = np.arange(len(order))
        real = [*usable, *self.byte_ids]
        weight = 1 / (rank + 10)
        self.logp = np.full(size, -np.inf)
        self.logp[real] = np.log(weight[real] / weight[real].sum())
        self.real = np.array(sorted(set(map(int, real))))
        self.longest = max(len(self.bytes_of[k]) for k in usable)
        packed = np.frombuffer(b"".join(self.bytes_of[k] for k in usable), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(self.bytes_of[k]) for k in usable])])
        hasher, keys, ids = _text.Hasher(packed), [], []
        for k, a, b in zip(usable, bounds[:-1], bounds[1:], strict=True):
            at = np.arange(a + 1, b + 1)
            keys.append(hasher(np.full(len(at), a), at))
            ids.append(np.append(np.full(len(at) - 1, -1), k))
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.lexsort((-ids, keys))
        keys, ids = keys[order], ids[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        self.keys, self.ids = keys[first], ids[first]
        # bytes that stand in no longer piece: texts can be cut on both sides of them
        joined = np.zeros((256, 256), bool)
        for k in usable:
            b = np.frombuffer(self.bytes_of[k], np.uint8)
            joined[b[:-1], b[1:]] = True
        joined[128:, 128:192] = joined[192:, 128:192] = True  # never inside a character
        self.joined = joined
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes_of])])
        self.packed = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places before which no piece can span: no piece has the two bytes around them in a row."""
        return np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1 if len(data) > 1 else np.zeros(0, np.int64)

    def lattice(self, data: np.ndarray, offsets: np.ndarray) -> Lattice:
        """All edges over the units whose bytes ``offsets`` bound, in order of end within the unit."""
        units = len(offsets) - 1
        base = offsets + np.arange(units + 1)
        place = np.flatnonzero((data & 0xC0) != 0x80)
        unit = np.searchsorted(offsets, place, "right") - 1
        limit = offsets[unit + 1]
        hasher = _text.Hasher(data)
        size = 1 + (data[place] >= 0xC0).astype(np.int64) + (data[place] >= 0xE0) + (data[place] >= 0xF0)
        whole = np.zeros(len(place), bool)
        alive, starts, ends, pieces, owner = np.arange(len(place)), [], [], [], []
        for length in range(1, self.longest + 1):
            alive = alive[place[alive] + length <= limit[alive]]
            if not len(alive):
                break
            p = place[alive]
            key = hasher(p, p + length)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive, at = alive[hit], at[hit]
            found = np.flatnonzero(self.ids[at] >= 0)
            some = alive[found]
            whole[some[size[some] == length]] = True
            starts.append(place[some])
            ends.append(place[some] + length)
            pieces.append(self.ids[at[found]])
            owner.append(unit[some])
        odd = np.flatnonzero(~whole)
        for k in range(4):
            some = odd[(size[odd] > k) & (place[odd] + k < limit[odd])]
            starts.append(place[some] + k)
            ends.append(place[some] + k + 1)
            pieces.append(self.byte_ids[data[place[some] + k]])
            owner.append(unit[some])
        # bytes that begin no character, where a unit starts inside one
        stray = np.flatnonzero(((data & 0xC0) == 0x80) & np.isin(np.arange(len(data)), offsets[:-1])) if len(data) else odd[:0]
        while len(stray):
            of = np.searchsorted(offsets, stray, "right") - 1
            starts.append(stray)
            ends.append(stray + 1)
            pieces.append(self.byte_ids[data[stray]])
            owner.append(of)
            stray = stray[stray + 1 < offsets[of + 1]] + 1
            stray = stray[(data[stray] & 0xC0) == 0x80]
        start, end, piece, of = (np.concatenate(x) for x in (starts, ends, pieces, owner))
        order = np.lexsort((start, end, end - offsets[of]))
        of = of[order]
        return Lattice(base, start[order] + of, end[order] + of, piece[order], of)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of pieces."""
        return _text.gather(self.packed, self.starts[ids], self.starts[ids + 1])[0]


def _steps(key: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key))


def best(lattice: Lattice, weight: np.ndarray) -> np.ndarray:
    """The best score of reaching each node from its unit's first; ``weight`` by piece."""
    value = np.full(lattice.base[-1], -np.inf)
    value[lattice.base[:-1][np.diff(lattice.base) > 0]] = 0
    w = weight[lattice.piece]
    edges = _steps(lattice.end - lattice.base[lattice.unit])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        end = lattice.end[a:b]
        first = np.flatnonzero(np.diff(end, prepend=-1))
        value[end[first]] = np.maximum.reduceat(value[lattice.start[a:b]] + w[a:b], first)
    return value


def _logsum(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(x, first)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, np.diff(np.append(first, len(x))))), first))


def forward(lattice: Lattice, logp: np.ndarray) -> np.ndarray:
    """Log probability of all segmentations up to each node."""
    value = np.full(lattice.base[-1], -np.inf)
    value[lattice.base[:-1]] = 0
    w = logp[lattice.piece]
    edges = _steps(lattice.end - lattice.base[lattice.unit])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        end = lattice.end[a:b]
        first = np.flatnonzero(np.diff(end, prepend=-1))
        value[end[first]] = _logsum(value[lattice.start[a:b]] + w[a:b], first)
    return value


def expected(lattice: Lattice, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, over all segmentations of units that count ``weight`` times."""
    ahead = forward(lattice, logp)
    last = lattice.base[1:] - 1
    value = np.full(lattice.base[-1], -np.inf)
    value[last] = 0
    relative = lattice.start - lattice.base[lattice.unit]
    order = np.lexsort((lattice.start, -relative))
    start, end, w = lattice.start[order], lattice.end[order], logp[lattice.piece[order]]
    edges = _steps(relative[order].max(initial=0) - relative[order])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        s = start[a:b]
        first = np.flatnonzero(np.diff(s, prepend=-1))
        value[s[first]] = _logsum(value[end[a:b]] + w[a:b], first)
    share = np.exp(ahead[lattice.start] + logp[lattice.piece] + value[lattice.end] - ahead[last][lattice.unit])
    return np.bincount(lattice.piece, share * weight[lattice.unit], len(logp))


def trace(lattice: Lattice, value: np.ndarray, weight: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of each unit's best path to node ``to[u]``, and how many each unit has; longer last pieces win ties."""
    reach = value[lattice.start] + weight[lattice.piece]
    good = np.flatnonzero((reach == value[lattice.end]) & np.isfinite(reach))
    ends, at = np.unique(lattice.end[good], return_index=True)
    edge = np.full(lattice.base[-1], -1)
    edge[ends] = good[at]
    now, begin, units, pieces = to.copy(), lattice.base[:-1], [], []
    live = np.flatnonzero(now > begin)
    while len(live):
        e = edge[now[live]]
        units.append(live)
        pieces.append(lattice.piece[e])
        now[live] = lattice.start[e]
        live = live[now[live] > begin[live]]
    if not units:
        return np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
    unit, piece = np.concatenate(units), np.concatenate(pieces)
    order = np.argsort(unit[::-1], kind="stable")
    return piece[::-1][order], np.bincount(unit, minlength=len(begin))
