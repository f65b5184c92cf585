"""A context-mixing range coder for token ids that codes many independent blocks side by side.

Every block is a lane. A lane predicts the next id by three distributions: all mass on what last followed the
last two ids (order 2), all mass on what last followed the last one (order 1), and the frequencies of ids
(order 0), which a table in front of the blocks gives. The three are mixed, id by id:

    P(x) = w2 [x = guess 2] + w1 [x = guess 1] + w0 P0(x)

The weights are learned in each lane for each state of the two guesses: how often each held before, and
whether they agree. The mixture's cumulative distribution in id order has a closed form, so one
arithmetic-coding step codes an id whichever parts of the mixture hold it. All lanes take a step at once as
numpy arrays, which is what makes an adaptive coder affordable in Python; blocks are reset independently, so
lanes never wait for each other's contents.

The coder keeps 64-bit bounds without carries: when an interval straddles a 32-bit boundary and has become
small, it is cut at the boundary. Ids below 2 ** 18 are supported.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import xxhash

U = np.uint64
MASK = U(0xFFFFFFFF)
#: Entries of each table of guesses of a lane, as a power of two.
TABLE_BITS = 10
#: Weights are in units of 2 ** -WEIGHT_BITS, and learned in units of 2 ** -12.
WEIGHT_BITS = 6
#: Learned shares lose a sixteenth and gain this where a guess holds: leaves order 0 a weight of its own.
GAIN = 243
#: Lanes that are turned into columns of steps together.
TURNED = 64
HEADER = struct.Struct("<4sIIII")
MAGIC = b"TKB3"


def _check(data: bytes | np.ndarray) -> int:
    """Checksum of 32 bits; a thirtieth of the time of zlib's CRC."""
    return xxhash.xxh3_64_intdigest(data) & 0xFFFFFFFF


class IdTable:
    """Ids that occur, ascending, and their shares of ``2 ** bits``: the order-0 distribution of blocks."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        if len(ids) and int(ids[-1]) >= 1 << 18:
            raise ValueError("ids of 18 bits at most")
        self.ids, self.shares = ids.astype(np.int64), shares.astype(np.int32)
        self.bits = int(self.shares.sum()).bit_length() - 1
        self.starts = np.concatenate([[0], np.cumsum(self.shares)]).astype(np.int32)
        self.slots = np.repeat(np.arange(len(ids), dtype=np.int32), self.shares)
        self.ranks = np.zeros(int(ids[-1]) + 1 if len(ids) else 0, np.int32)
        self.ranks[self.ids] = np.arange(len(ids))

    @classmethod
    def of(cls, ids: np.ndarray) -> IdTable:
        """Table for some ids; every one of them has a share."""
        counts = np.bincount(ids)
        seen = np.flatnonzero(counts)
        bits = 16 if len(seen) <= 1 << 14 else 20
        shares = 1 + counts[seen] * ((1 << bits) - len(seen)) // max(1, int(counts.sum()))
        if len(seen):
            shares[np.argmax(shares)] += (1 << bits) - int(shares.sum())
        return cls(seen, shares)

    def to_bytes(self) -> bytes:
        steps = np.diff(self.ids, prepend=0)
        return zlib.compress(b"".join(a.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes() for a in (steps, self.shares)), 9)

    @classmethod
    def from_bytes(cls, data: bytes) -> IdTable:
        planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 4, -1)
        steps, shares = (np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes)
        return cls(np.cumsum(steps), shares)


def _first_shares() -> np.ndarray:
    """Weights of both guesses before anything is learned, by (held 2, held 1, agree): order 2 in the upper half."""
    two, one = np.zeros((4, 4, 2), np.int32), np.zeros((4, 4, 2), np.int32)
    for held in range(4):
        two[held, :, 0] = 400 + 600 * held
        two[held, :, 1] = 1000 + 700 * held
        one[:, held, 0] = 200 + 300 * held
    return (two << 16 | one).ravel()


class Lanes:
    """Models and coder state of a number of blocks. Arrays of two rows hold order 1, then order 2."""

    STATES = 32

    def __init__(self, lanes: int, table: IdTable):
        self.n = lanes
        self.bits = table.bits
        self.starts, self.shares, self.slots = table.starts, table.shares, table.slots
        self.base = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes) << TABLE_BITS
        self.table = np.zeros(2 * lanes << TABLE_BITS, np.int32)
        self.share = np.tile(_first_shares(), lanes)
        self.state = np.arange(lanes, dtype=np.int64) * self.STATES
        self.last = np.zeros(lanes, np.uint32)
        self.before = np.zeros(lanes, np.uint32)
        self.low = np.zeros(lanes, U)
        self.range = np.full(lanes, U(0xFFFFFFFFFFFFFFFF))

    def predict(self) -> None:
        """Guesses and weights at this step."""
        # unsigned 32-bit products wrap; their upper bits are the hash
        hashes = np.empty((2, self.n), np.uint32)
        np.multiply(self.last, np.uint32(0x9E3779B1), out=hashes[0])
        np.add(hashes[0], self.before * np.uint32(0x85EBCA6B), out=hashes[1])
        self.at = self.base + (hashes >> 32 - TABLE_BITS)
        entries = self.table.take(self.at)
        self.guess = entries >> 2
        self.held = entries & 3
        self.at_share = self.state + ((self.held[1] * 4 + self.held[0]) * 2 + (self.guess[0] == self.guess[1]))
        self.learned = self.share.take(self.at_share)
        self.weight = np.empty((2, self.n), np.int32)
        np.right_shift(self.learned, 28 - WEIGHT_BITS, out=self.weight[1])
        np.bitwise_and(self.learned >> 12 - WEIGHT_BITS, (1 << WEIGHT_BITS) - 1, out=self.weight[0])
        self.rest = (1 << WEIGHT_BITS) - self.weight[0] - self.weight[1]
        self.unit = self.range >> U(WEIGHT_BITS + self.bits)

    def find(self, code: np.ndarray) -> np.ndarray:
        """Ids (ranks) whose intervals hold ``code``."""
        t = np.minimum((code - self.low) // self.unit, U((1 << WEIGHT_BITS + self.bits) - 1)).astype(np.int32)
        mass = self.weight << self.bits
        # where the guesses' intervals start: the other guess's mass lies before the greater one, if equal before order 2
        first = self.rest * self.starts.take(self.guess)
        greater = self.guess[0] > self.guess[1]
        first[0] += mass[1] * greater
        first[1] += mass[0] * ~greater
        past = t - first
        # negative distances are large unsigned ones
        inside = past.view(np.uint32) < (self.rest * self.shares.take(self.guess) + mass).view(np.uint32)
        over = mass * (past >= 0)
        plain = t - over[0] - over[1]
        # inside holds; a guess's own interval is wider than its order-0 share, and is told first
        found = self.slots.take((plain / self.rest).astype(np.intp), mode="clip")  # quotients of small integers floor exactly
        return np.where(inside[1], self.guess[1], np.where(inside[0], self.guess[0], found))

    def code(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Narrow the intervals to ``ids`` (ranks) and learn from them.

        Gives the lanes whose interval became too small, and the word of 32 bits that each of them shifts out.
        """
        hit = self.guess == ids
        below, held = self.weight * (self.guess < ids), self.weight * hit
        self.low += self.unit * (self.rest * self.starts.take(ids) + (below[0] + below[1] << self.bits)).astype(U)
        self.range = self.unit * (self.rest * self.shares.take(ids) + (held[0] + held[1] << self.bits)).astype(U)
        # both halves at once; order 1 learns how often it alone holds
        self.learned -= self.learned >> 4 & 0x0FFF0FFF
        self.learned += hit[1] * np.int32(GAIN << 16)
        self.learned += (hit[0] > hit[1]) * np.int32(GAIN)
        self.share[self.at_share] = self.learned
        self.table[self.at] = (ids << 2) + np.minimum(self.held + 1, 3) * hit
        self.before, self.last = self.last, ids.view(np.uint32)
        at = np.flatnonzero(self.range <= MASK)
        low, width = self.low[at], self.range[at]
        straddles = (low ^ (low + (width - U(1)))) > MASK
        self.range[at] = np.where(straddles, (MASK - (low & MASK)) + U(1), width) << U(32)
        self.low[at] = low << U(32)
        return at, (low >> U(32)).astype(np.uint32)

    def keep(self, lanes: int) -> None:
        """Drop all lanes but the first ones."""
        self.n = lanes
        self.base = self.base[:, :lanes]
        for name in ("state", "last", "before", "low", "range"):
            setattr(self, name, getattr(self, name)[:lanes])


def _by_length(lengths: list[int]) -> tuple[list[int], np.ndarray, list[int]]:
    """Blocks from long to short, their lengths, and how many are longer than each step."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    sizes = np.array([lengths[i] for i in order])
    return order, sizes, np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left").tolist()


def encode_blocks(blocks: list[np.ndarray], table: IdTable) -> list[bytes]:
    """One block of bytes per array of ids (none empty), to be decoded with the same table."""
    if not blocks:
        return []
    order, lengths, alive = _by_length([len(b) for b in blocks])
    grid = np.zeros((len(alive), len(blocks)), np.int32)
    for first in range(0, len(blocks), TURNED):
        some = np.zeros((min(TURNED, len(blocks) - first), len(alive)), np.int32)
        for row, i in zip(some, order[first : first + TURNED]):
            row[: len(blocks[i])] = table.ranks[blocks[i]]
        grid[:, first : first + TURNED] = some.T
    model = Lanes(len(blocks), table)
    words = np.zeros((len(blocks), len(alive) + 3), np.uint32)
    flat = words.ravel()
    start = np.arange(len(blocks)) * words.shape[1]
    place = start.copy()
    lows = np.zeros(len(blocks), U)
    for step, n in enumerate(alive):
        if n < model.n:
            lows[n : model.n] = model.low[n:]
            model.keep(n)
        model.predict()
        at, out_words = model.code(grid[step, :n])
        here = place[at]
        flat[here] = out_words
        place[at] = here + 1
    lows[: model.n] = model.low
    for half in (lows >> U(32), lows & MASK):  # the lower bound itself lies in the interval
        flat[place] = half.astype(np.uint32)
        place += 1
    used = place - start
    out: list[bytes] = [b""] * len(blocks)
    for lane, i in enumerate(order):
        body = words[lane, : used[lane]].astype("<u4").tobytes()
        ids = np.ascontiguousarray(blocks[i], "<u4")
        out[i] = HEADER.pack(MAGIC, len(blocks[i]), len(body), _check(ids), _check(body)) + body
    return out


def split_blocks(data: bytes) -> list[bytes]:
    """Blocks that were joined into one string of bytes."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise ValueError("a block's header is cut short")
        magic, _, size, _, _ = HEADER.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token block")
        end = at + HEADER.size + size
        if end > len(data):
            raise ValueError("a block is cut short")
        out.append(data[at:end])
        at = end
    return out


def decode_blocks(blocks: list[bytes], table: IdTable) -> list[np.ndarray]:
    """Ids of each block; checksums are verified."""
    if not blocks:
        return []
    heads = [HEADER.unpack_from(b) for b in blocks]
    for block, (magic, _, size, _, check) in zip(blocks, heads, strict=True):
        if magic != MAGIC or len(block) != HEADER.size + size or _check(block[HEADER.size :]) != check:
            raise ValueError("a token block is damaged")
    order, lengths, alive = _by_length([h[1] for h in heads])
    n_words = [heads[i][2] // 4 for i in order]
    words = np.zeros((len(blocks), max(n_words) + 2), np.uint32)
    for lane, i in enumerate(order):
        words[lane, : n_words[lane]] = np.frombuffer(blocks[i], "<u4", offset=HEADER.size)
    model = Lanes(len(blocks), table)
    flat = words.ravel()
    place = np.arange(len(blocks)) * words.shape[1] + 2
    code = words[:, 0].astype(U) << U(32) | words[:, 1]
    grid = np.zeros((len(alive), len(blocks)), np.uint32)
    for step, n in enumerate(alive):
        if n < model.n:
            model.keep(n)
            code = code[:n]
        model.predict()
        ids = model.find(code)
        grid[step, :n] = ids
        at, _ = model.code(ids)
        here = place[at]
        code[at] = code[at] << U(32) | flat.take(here, mode="clip")
        place[at] = here + 1
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    ids_of = table.ids.astype(np.uint32)
    for first in range(0, len(blocks), TURNED):
        some = ids_of.take(np.ascontiguousarray(grid[:, first : first + TURNED].T))
        for row, i in zip(some, order[first : first + TURNED]):
            out[i] = row[: heads[i][1]].copy()
            if _check(out[i].astype("<u4", copy=False)) != heads[i][3]:
                raise ValueError("decoded ids differ from those encoded")
    return out
