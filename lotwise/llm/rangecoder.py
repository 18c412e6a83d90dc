"""Adaptive context-mixing range coder for token ids, many independent blocks in step.

For each id two contexts predict: the two ids before it (order 2) and the one before (order 1), each with a
confidence from 0 to 7 (both hashed into tables that stay in the processor's cache). How often a prediction with this
pair of confidences has come true in the block so far gives its
share of the coding range; the rest is for the block's own id frequencies (order 0, every id possible). Shares, tables
and frequencies start anew in each block, so a block is decoded by itself.

Work on a sequence of ids is sequential. So a block is cut into up to ``STRANDS`` strands of equal length that share its
tables and have their own coding range, and position ``t`` of all strands of up to ``LANES`` blocks is coded at once with
array operations, one lane per strand. Where strands of a block would change the same entry in a step, the last one does.
The range is an asymmetric numeral system's (a state of 63 bits, refilled by 32): shares are gathered forwards, and
states run backwards over them.

Bytes of a block, little endian: magic ``LWC2``, crc32 of all that follows, then unsigned 32-bit numbers (vocabulary, ids,
documents, 16-bit units), for each document or part of one its id (64 bit), marks (8 bit: null id, begun before, goes on)
and its number of ids (32 bit), the
crc32 of the ids (32 bit each), and the units of the coder: the number of 32-bit words of each strand, then their words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"LWC2"
LANES = 256
STRANDS = 16
# Ids of a strand, at least, before a block is cut into more of them.
STRAND_IDS = 256
TABLE = 1 << 13
# Ids of a block: a lane's frequencies stay within its span, and a wave's lanes within memory.
LONGEST = 1 << 17
WEIGHT = 24  # of a seen id against one for every id of the vocabulary
RATE = 5
# Shares lie between LEAST and MOST of 2^16; what both leave over, of 2^BITS, is more than all frequencies of a block.
LEAST, MOST = 64, 65536 - 2900
BITS = 31
LOW = 1 << 31  # a state is at least this


def _rebuild_at(t: int) -> bool:
    return t in (0, 4, 16, 64) or t % 256 == 0


class _Model:
    def __init__(self, n: int, vocabulary: int) -> None:
        self.v, self.n = vocabulary, n
        # An entry is a predicted id times 8 plus the confidence in it.
        self.entries = [np.zeros(n * TABLE, np.int32) for _ in range(2)]
        self.hits = [np.full(n * 128, 1 << 13, np.int32) for _ in range(2)]
        self.seen = np.zeros((n, vocabulary), np.int32)
        self.span = (vocabulary + WEIGHT * LONGEST) * 2  # times LANES it stays below 2^31
        self.sums = np.zeros((n, vocabulary + 1), np.int32)
        self.total = np.zeros(n, np.int64)

    def lay(self, block: np.ndarray) -> None:
        """``block``: the block of each lane."""
        self.block, self.at, self.state_at = block, block * TABLE, (block * 128).astype(np.int32)
        self.one, self.two = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)

    def count(self, ids: np.ndarray, there: np.ndarray) -> None:
        """Adds a stretch of ids (by step and lane) where they are ``there``."""
        lanes = np.argsort(self.block, kind="stable")
        ends = np.searchsorted(self.block[lanes], np.arange(self.n + 1))
        for b in range(self.n):
            mine = lanes[ends[b] : ends[b + 1]]
            new = np.bincount(ids[:, mine][there[:, mine]])
            self.seen[b, : len(new)] += new

    def rebuild(self, k: int) -> None:
        """Cumulative frequencies of the first ``k`` blocks; each one's start at a multiple of the span, so one search serves all.

        They are kept once, in place, and made block by block: they are the largest arrays of a wave.
        """
        once = np.arange(self.v + 1, dtype=np.int32)
        for a in range(k):
            row = self.sums[a]
            row[0] = 0
            np.cumsum(self.seen[a], dtype=np.int32, out=row[1:])
            row *= np.int32(WEIGHT)
            row += once
            self.total[a] = row[-1]
            row += np.int32(a * self.span)
        self.flat = self.sums[:k].reshape(-1)
        # Every 64th of them, which stay in the processor's cache: a search begins there.
        self.coarse = np.ascontiguousarray(self.sums[:k, ::64])

    def below(self, lanes: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How much lies below ``x`` in each block."""
        return self.flat.take(lanes * (self.v + 1) + x).astype(np.int64) - lanes * self.span

    def parts(self, block: np.ndarray, x: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of ids in the range from ``base`` up by the frequencies of their blocks."""
        wide, total = (1 << BITS) - base, self.total[block]
        start = self.below(block, x) * wide // total
        return start + base, self.below(block, x + 1) * wide // total - start

    def find(self, block: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The ids whose part holds ``at``."""
        below = ((at - base + 1) * self.total[block] - 1) // ((1 << BITS) - base)
        key = (below + block * self.span).astype(np.int32)
        line = block * (self.v + 1)
        at = line + (np.searchsorted(self.coarse.reshape(-1), key, side="right") - 1 - block * self.coarse.shape[1]) * 64
        for step in (32, 16, 8, 4, 2, 1):  # a step past the block's end meets a larger sum
            at += (self.flat.take(at + step, mode="clip") <= key) * step
        return at - line

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Predicted ids of the first ``k`` lanes and where their shares end: order 2, order 1, end of 2, end of 1."""
        one, two, at = self.one[:k], self.two[:k], self.at[:k]
        mixed = one * 40503
        self.slot = [at + ((mixed >> 7) & (TABLE - 1)), at + ((mixed + two * 60493 + (two >> 5)) & (TABLE - 1))]
        self.entry = [e.take(s) for e, s in zip(self.entries, self.slot)]
        self.level = [e & 7 for e in self.entry]
        self.guess = [e >> 3 for e in self.entry]
        self.agree = self.guess[0] == self.guess[1]
        self.state = self.state_at[:k] + self.level[1] * 8 + self.level[0] + self.agree * np.int32(64)
        self.old = [h.take(self.state) for h in self.hits]
        share2 = self.old[1].astype(np.int64)
        share1 = ((65536 - share2) * self.old[0]) >> 16
        share1[self.agree] = 0
        return self.guess[1], self.guess[0], share2 << (BITS - 16), (share2 + share1) << (BITS - 16)

    def learn(self, k: int, x: np.ndarray) -> None:
        right = [g == x for g in self.guess]
        fresh = (x << 3) + np.int32(1)
        for j in (0, 1):
            old, level, entry = self.old[j], self.level[j], self.entry[j]
            new = old + ((right[j] * np.int32(MOST - LEAST) + np.int32(LEAST) - old) >> RATE)
            if j:
                self.hits[1][self.state] = new
            else:
                counted = np.flatnonzero(~(self.agree | right[1]))
                self.hits[0][self.state[counted]] = new[counted]
            wrong = np.where(level == 0, fresh, entry - ((level + 1) >> 1))
            self.entries[j][self.slot[j]] = np.where(right[j], entry + (level < 7), wrong)
        self.two[:k], self.one[:k] = self.one[:k], x


def _strands(n: int) -> np.ndarray:
    """Lengths of the strands of a block of ``n`` ids, longer ones first."""
    s = min(STRANDS, max(1, n // STRAND_IDS))
    return n // s + (np.arange(s) < n % s)


def _waves(sizes: list[int]):
    """Of up to ``LANES`` blocks: (blocks, lanes' blocks within the wave, begins within them, lengths), longest strands first."""
    order = np.argsort([-_strands(n)[0] for n in sizes], kind="stable")
    for i in range(0, len(order), LANES):
        wave = order[i : i + LANES]
        lengths = [_strands(sizes[w]) for w in wave]
        block = np.repeat(np.arange(len(wave)), [len(s) for s in lengths])
        begin = np.concatenate([np.cumsum(s) - s for s in lengths])
        length = np.concatenate(lengths)
        lanes = np.argsort(-length, kind="stable")
        yield wave, block[lanes], begin[lanes], length[lanes]


def _active(block: np.ndarray, length: np.ndarray, t: int) -> tuple[int, int]:
    """How many lanes and how many blocks go on at ``t``."""
    k = int(np.searchsorted(-length, -t, side="left"))
    return k, int(block[:k].max(initial=-1)) + 1


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[np.ndarray]:
    """16-bit units of each block of at most ``LONGEST`` ids (all below ``vocabulary``, at most 65,536)."""
    if max(map(len, blocks), default=0) > LONGEST:
        raise ValueError(f"a block holds at most {LONGEST} ids")
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    for wave, block, begin, length in _waves([len(b) for b in blocks]):
        steps, n = int(length.max(initial=0)), len(length)
        ids = np.zeros((steps, n), np.int32)
        for lane in range(n):
            ids[: length[lane], lane] = blocks[wave[block[lane]]][begin[lane] : begin[lane] + length[lane]]
        starts, widths = np.zeros((steps, n), np.uint32), np.zeros((steps, n), np.uint32)
        model = _Model(len(wave), vocabulary)
        model.lay(block)
        rebuilt = 0
        for t in range(steps + 1):
            if t == steps or _rebuild_at(t):
                # Shares of ids without a right prediction since the frequencies were made last.
                row, lane = np.nonzero((widths[rebuilt:t] == 0) & (length > np.arange(rebuilt, t)[:, None]))
                row += rebuilt
                if len(row):
                    starts[row, lane], widths[row, lane] = model.parts(block[lane], ids[row, lane].astype(np.int64), starts[row, lane].astype(np.int64))
                if t == steps:
                    break
                model.count(ids[rebuilt:t], length > np.arange(rebuilt, t)[:, None])
                k, going = _active(block, length, t)
                model.rebuild(going)
                rebuilt = t
            elif length[k - 1] <= t:
                k, _ = _active(block, length, t)
            guess2, guess1, end2, end1 = model.predict(k)
            x = ids[t, :k]
            two, one = guess2 == x, guess1 == x
            # Of an id that no context predicts, the start of the rest and a width of 0 for now.
            starts[t, :k] = np.where(two, 0, np.where(one, end2, end1))
            widths[t, :k] = np.where(two, end2, np.where(one, end1 - end2, 0))
            model.learn(k, x)
        state, words, at = np.full(n, LOW, np.uint64), np.zeros((n, steps + 2), np.uint32), np.zeros(n, np.int64)
        flat, line = words.reshape(-1), np.arange(n) * (steps + 2)
        for t in range(steps - 1, -1, -1):
            k = n if length[n - 1] > t else _active(block, length, t)[0]
            width, now = widths[t, :k].astype(np.uint64), state[:k]
            full = np.flatnonzero(now >= width << np.uint64(32))
            flat[line[full] + at[full]] = now[full].astype(np.uint32)
            at[full] += 1
            now[full] >>= np.uint64(32)
            times = now // width
            state[:k] = (times << np.uint64(BITS)) + (now - times * width) + starts[t, :k]
        for shift in (0, 32):
            flat[line + at] = (state >> np.uint64(shift)).astype(np.uint32)
            at += 1
        lanes = np.lexsort((begin, block))
        ends = np.searchsorted(block[lanes], np.arange(len(wave) + 1))
        for i, w in enumerate(wave):
            mine = lanes[ends[i] : ends[i + 1]]
            parts = [words[lane, : at[lane]][::-1] for lane in mine]
            out[w] = np.concatenate([at[mine].astype("<u2"), np.concatenate(parts).astype("<u4").view("<u2")])
    return out


def decode_blocks(units: list[np.ndarray], sizes: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of each block again."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(units)
    for wave, block, begin, length in _waves(list(sizes)):
        steps, n = int(length.max(initial=0)), len(length)
        model = _Model(len(wave), vocabulary)
        model.lay(block)
        # The words of all strands one after the other, and where each lane reads.
        lanes = np.lexsort((begin, block))
        counts = [np.asarray(units[w][: len(_strands(sizes[w]))], np.int64) for w in wave]
        words = np.concatenate([np.ascontiguousarray(units[w][len(c) :]).astype("<u2").view("<u4") for w, c in zip(wave, counts)])
        counts = np.concatenate(counts)
        at = np.zeros(n, np.int64)
        at[lanes] = np.cumsum(counts) - counts
        state = (words[at].astype(np.int64) << 32) | words[at + 1]
        at += 2
        ids = np.zeros((steps, n), np.int32)
        rebuilt = 0
        for t in range(steps):
            if _rebuild_at(t):
                model.count(ids[rebuilt:t], length > np.arange(rebuilt, t)[:, None])
                k, going = _active(block, length, t)
                model.rebuild(going)
                rebuilt = t
            elif length[k - 1] <= t:
                k, _ = _active(block, length, t)
            guess2, guess1, end2, end1 = model.predict(k)
            now = state[:k]
            place = now & ((1 << BITS) - 1)
            two = place < end2
            x = np.where(two, guess2, guess1)
            start = np.where(two, 0, end2)
            width = np.where(two, end2, end1 - end2)
            rest = np.flatnonzero(place >= end1)
            if len(rest):
                base, mine = end1[rest], block[rest]
                found = model.find(mine, place[rest], base)
                x[rest] = found
                start[rest], width[rest] = model.parts(mine, found, base)
            now = width * (now >> BITS) + place - start
            empty = np.flatnonzero(now < LOW)
            now[empty] = (now[empty] << 32) | words[at[empty]]
            at[empty] += 1
            state[:k] = now
            ids[t, :k] = x
            model.learn(k, x)
        for i, w in enumerate(wave):
            out[w] = np.zeros(sizes[w], np.int64)
        for lane in range(n):
            out[wave[block[lane]]][begin[lane] : begin[lane] + length[lane]] = ids[: length[lane], lane]
    return out


NULL, BEGUN, GOES_ON = 1, 2, 4


def pack(
    keys: list[int | None], sizes: list[int], ids: np.ndarray, units: np.ndarray, vocabulary: int, begun: bool = False, goes_on: bool = False
) -> bytes:
    """The bytes of a block; ``begun``: its first document began in an earlier block, ``goes_on``: its last one does."""
    marks = np.array([NULL if k is None else 0 for k in keys], "u1")
    if len(marks):
        marks[0] |= BEGUN * begun
        marks[-1] |= GOES_ON * goes_on
    body = struct.pack("<4I", vocabulary, len(ids), len(keys), len(units))
    body += np.array([0 if k is None else k for k in keys], "<i8").tobytes() + marks.tobytes()
    body += np.array(sizes, "<u4").tobytes() + struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes())) + units.astype("<u2").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def unpack(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int, int, np.ndarray]:
    """(document ids, their sizes, units, vocabulary, crc32 of the ids, marks); raises if the bytes are not what was written."""
    if block[:4] != MAGIC or struct.unpack_from("<I", block, 4)[0] != zlib.crc32(block[8:]):
        raise ValueError("damaged block")
    vocabulary, n, docs, units = struct.unpack_from("<4I", block, 8)
    at = 24
    keys = np.frombuffer(block, "<i8", docs, at)
    marks = np.frombuffer(block, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(block, "<u4", docs, at + 9 * docs).astype(np.int64)
    (crc,) = struct.unpack_from("<I", block, at + 13 * docs)
    if int(sizes.sum()) != n:
        raise ValueError("damaged block")
    names = [None if m & NULL else int(k) for m, k in zip(marks, keys)]
    return names, sizes, np.frombuffer(block, "<u2", units, at + 13 * docs + 4), vocabulary, crc, marks
