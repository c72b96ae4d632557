"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks of ``BLOCK``. A block starts afresh, carries its length and CRC-32, and is decoded and checked
alone. It lists its distinct ids, so any 32-bit id can occur, and codes their ranks.

Three predictions are mixed for each rank: order 2 names the rank that last followed the same two, order 1 the one that
last followed the same one, each with a confidence that grows with hits; order 0 is a distribution over all ranks,
learned from those that neither had named. How often either was right, for this pair of confidences and for whether
both agree, is learned too and gives the weights. The mixture gives each rank its part of the range, so one arithmetic
coding step codes it.

A block is cut into ``LANES`` runs that share the model and are coded side by side, a numpy step for one id of each: all
lanes are predicted from what the block's earlier steps have taught, then all of them teach. The decoder repeats it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES = 1 << 20, 8192
#: A lane codes at least so many ids, or there are fewer lanes.
LEAST_RUN = 64
MAGIC = b"TLCM4\0"
#: Of a block: ids, lanes, bytes of the id list, bytes of the lanes' lengths, bytes of code, CRC-32 of the ids.
_HEAD = struct.Struct("<IIIIII")
_WEIGHT_BITS, _SLOT_BITS, _TOP_CONFIDENCE = 12, 20, 7
_STATES = 1 << 7
#: Steps after which order 0 is brought up to date, and what one occurrence adds there.
_REFRESH, _GAIN = 8, 24
#: What a miss (first) and a hit (second) change a confidence by; a guess that has none left is replaced.
_REPLACE = 100
_CHANGE = np.array([_REPLACE if c < 2 else -((c + 1) >> 1) for c in range(8)] + [c < _TOP_CONFIDENCE for c in range(8)], np.int32)
_U = np.uint64
#: The range has 64 bits and moves out 16 at a time; it never stays under ``_BOTTOM``.
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 40)
_SHIFT, _WORD = _U(16), _U(48)


class _Model:
    """What the block's earlier steps have taught; encoder and decoder go through the same states.

    Ranks are counted from 1 here. A guess is kept with its confidence in the last 3 bits; 0 is none.
    """

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.scale = 20 if symbols <= 1 << 18 else 24
        self.counts = np.ones(symbols, np.int64)
        self.first = np.zeros(symbols + 1, np.int32)
        self.second = np.zeros(1 << _SLOT_BITS, np.int32)
        # hits of order 2, of order 1, of neither
        self.hits = np.ones((_STATES, 3), np.int64)
        self.hits[:, 2] = 4
        self.step, self.news = 0, []
        self._settle_order0()

    def _settle_order0(self) -> None:
        room = (1 << self.scale) - self.symbols
        part = self.counts * room // self.counts.sum() + 1
        ends = np.zeros(self.symbols + 1, np.int64)
        np.cumsum(part, out=ends[1:])
        ends[-1] = 1 << self.scale
        self.ends = ends.astype(np.uint64)
        # where a rank starts and how wide it is; rank 0 doesn't occur
        self.start = np.concatenate([self.ends[:1], self.ends[:-1]])
        self.width = np.concatenate([self.ends[:1], np.diff(self.ends)])

    def expect(self, one: np.ndarray, two: np.ndarray) -> None:
        """Find guesses and weights, from the two ranks before (0 at a lane's start)."""
        spread = one.view(np.uint32) * np.uint32(0x2545F491) + two.view(np.uint32) * np.uint32(0x9E3779B1)
        self.slot, self.one = (spread >> np.uint32(32 - _SLOT_BITS)).astype(np.intp), one.astype(np.intp)
        self.a, self.b = self.first[self.one], self.second[self.slot]
        self.guess1, self.guess2 = self.a >> 3, self.b >> 3
        self.state = ((self.b & 7) << 4 | (self.a & 7) << 1 | (self.guess1 == self.guess2)).astype(np.intp)
        weights = self.hits * ((1 << _WEIGHT_BITS) - 3) // self.hits.sum(1)[:, None] + 1
        two_, both, rest = weights[:, 0], weights[:, 0] + weights[:, 1], (1 << _WEIGHT_BITS) - weights[:, 0] - weights[:, 1]
        none = np.zeros_like(rest)
        # by state and outcome: start and width of its part, and what multiplies order 0 there
        self.base = (np.stack([none, two_, both], 1) << self.scale).astype(np.uint64).ravel()
        self.fixed = (np.stack([two_, weights[:, 1], none], 1) << self.scale).astype(np.uint64).ravel()
        self.times = np.stack([none, none, rest], 1).astype(np.uint64).ravel()

    def bounds(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the part of each rank starts and how wide it is, of ``2 ** (weights + scale)``."""
        # outcome 0: order 2 was right, 1: order 1 was, 2: neither
        self.outcome = (rank != self.guess2) * (1 + (rank != self.guess1).view(np.int8))
        self.cell = self.state * 3 + self.outcome
        times = self.times[self.cell]
        return self.base[self.cell] + self.start[rank] * times, self.fixed[self.cell] + self.width[rank] * times

    def find(self, at: np.ndarray) -> np.ndarray:
        """The rank in whose part ``at`` lies."""
        cell = self.state * 3
        rank = np.where(at < self.base[cell + 1], self.guess2, self.guess1)
        base = self.base[cell + 2]
        other = np.flatnonzero(at >= base)
        if len(other):
            within = (at[other] - base[other]) // self.times[cell[other] + 2]
            rank[other] = np.minimum(np.searchsorted(self.ends, within, "right"), self.symbols)
        return rank

    def learn(self, rank: np.ndarray) -> None:
        """Take in the ranks whose ``bounds`` were asked for."""
        self.hits += 2 * np.bincount(self.cell, minlength=3 * _STATES).reshape(_STATES, 3)
        full = self.hits.sum(1) > 1 << 16
        if full.any():
            self.hits[full] = (self.hits[full] >> 1) + 1
        self.news.append(rank[self.outcome == 2])
        self.step += 1
        if self.step % _REFRESH == 0 or self.step in (1, 2, 4):
            self.counts += _GAIN * np.bincount(np.concatenate(self.news) - 1, minlength=self.symbols)
            self.news = []
            self._settle_order0()
        fresh = rank << 3 | 1
        for table, at, old, guess in ((self.first, self.one, self.a, self.guess1), (self.second, self.slot, self.b, self.guess2)):
            change = _CHANGE[(guess == rank) * 8 + (old & 7)]
            table[at] = np.where(change == _REPLACE, fresh, old + change)


def _settle(low: np.ndarray, span: np.ndarray, shift) -> None:
    """Bring every lane's span back to ``_BOTTOM`` or more; ``shift(lanes)`` moves 16 bits out or in."""
    lanes = np.flatnonzero(((low ^ (low + span)) < _TOP) | (span < _BOTTOM))
    while len(lanes):
        a, b = low[lanes], span[lanes]
        straddles = (a ^ (a + b)) >= _TOP
        b = np.where(straddles, (~a + _U(1)) & (_BOTTOM - _U(1)), b)
        shift(lanes)
        low[lanes] = a = a << _SHIFT
        span[lanes] = b = b << _SHIFT
        lanes = lanes[((a ^ (a + b)) < _TOP) | (b < _BOTTOM)]


def _lanes(n: int) -> tuple[int, int]:
    """Lanes of a block and ids of each (the last may have fewer)."""
    lanes = max(1, min(LANES, n // LEAST_RUN))
    run = -(-n // lanes)
    return -(-n // run), run


def _encode_block(ids: np.ndarray) -> bytes:
    known, ranks = np.unique(ids, return_inverse=True)
    lanes, run = _lanes(len(ids))
    grid = np.zeros(lanes * run, np.int32)
    grid[: len(ids)] = ranks
    grid = np.ascontiguousarray(grid.reshape(lanes, run).T) + 1
    out, size = np.zeros((lanes, run + 32), "<u2"), np.zeros(lanes, np.int64)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def shift(go):
        out[go, size[go]] = low[go] >> _WORD
        size[go] += 1

    model = _Model(len(known))
    unit = _U(model.scale + _WEIGHT_BITS)
    one = two = np.zeros(lanes, np.int32)
    for step, now in enumerate(grid):
        model.expect(one, two)
        start, wide = model.bounds(now)
        part = span >> unit
        low += start * part
        span = part * wide
        if step % 4 == 0 and size.max() + 16 > out.shape[1]:  # a step moves out 4 words at most
            out = np.pad(out, ((0, 0), (0, run)))
        _settle(low, span, shift)
        model.learn(now)
        one, two = now, one
    # the span holds a number whose last 32 bits are 0; what isn't written reads as 0
    low = (low + _U((1 << 32) - 1)) & ~_U((1 << 32) - 1)
    for _ in range(2):
        shift(np.arange(lanes))
        low = low << _SHIFT
    listed = zlib.compress(np.diff(known, prepend=0).astype("<u4").tobytes())
    lengths = zlib.compress(size.astype("<u4").tobytes())
    code = out[np.arange(out.shape[1]) < size[:, None]].tobytes()
    head = _HEAD.pack(len(ids), lanes, len(listed), len(lengths), len(code), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + listed + lengths + code


def _decode_block(head: tuple, body: bytes) -> np.ndarray:
    n, lanes, listed, lengths, _, _ = head
    known = np.cumsum(np.frombuffer(zlib.decompress(body[:listed]), "<u4").astype(np.int64))
    size = np.frombuffer(zlib.decompress(body[listed : listed + lengths]), "<u4").astype(np.int64)
    run = _lanes(n)[1]
    code = np.zeros((lanes, size.max() + 8), "<u2")
    code[np.arange(code.shape[1]) < size[:, None]] = np.frombuffer(body[listed + lengths :], "<u2")
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    value, place = np.zeros(lanes, np.uint64), np.full(lanes, 4, np.int64)
    for k in range(4):
        value = (value << _SHIFT) | code[:, k]

    def shift(go):
        value[go] = (value[go] << _SHIFT) | code[go, np.minimum(place[go], code.shape[1] - 1)]
        place[go] += 1

    model = _Model(len(known))
    unit = _U(model.scale + _WEIGHT_BITS)
    most = _U((1 << (model.scale + _WEIGHT_BITS)) - 1)
    grid = np.empty((run, lanes), np.int32)
    one = two = np.zeros(lanes, np.int32)
    for step in range(run):
        model.expect(one, two)
        part = span >> unit
        now = np.maximum(model.find(np.minimum((value - low) // part, most)), 1)
        start, wide = model.bounds(now)
        low += start * part
        span = part * wide
        _settle(low, span, shift)
        model.learn(now)
        grid[step] = now
        one, two = now, one
    return known[grid.T.ravel()[:n] - 1]


def encode(ids: np.ndarray) -> bytes:
    """All ids (0 to ``2 ** 32 - 1``) as blocks behind a magic and their number. Others raise ValueError."""
    ids = np.asarray(ids, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >> 32):
        raise ValueError("ids are unsigned 32-bit integers")
    blocks = [_encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    return b"".join([MAGIC, struct.pack("<I", len(blocks)), *blocks])


def decode(data: bytes) -> np.ndarray:
    """The ids; a block whose CRC-32 doesn't hold raises ValueError."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of coded ids")
    (count,) = struct.unpack_from("<I", data, len(MAGIC))
    at, out = len(MAGIC) + 4, []
    for i in range(count):
        head = _HEAD.unpack_from(data, at)
        body = data[at + _HEAD.size : at + _HEAD.size + sum(head[2:5])]
        at += _HEAD.size + len(body)
        try:
            ids = _decode_block(head, body).astype("<u4")
        except (zlib.error, IndexError, ValueError, OverflowError) as error:
            raise ValueError(f"block {i} is damaged") from error
        if zlib.crc32(ids.tobytes()) != head[5]:
            raise ValueError(f"block {i} is damaged")
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
