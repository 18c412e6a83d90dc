"""Alignment of two tokenizers' tokens by byte offsets, with document counts of linked id pairs by external spill counting.

A text is cut before each space that follows something else: neither tokenizer's tokens cross such a place, so a piece is
encoded and aligned once per task and remembered. Tokens of the two sides are linked where their byte ranges overlap, and
cut into groups where both sides have a token's end.

Counting: a task holds the records (pair, document, links) of its documents up to ``HELD``, sorts them and spills one run
per radix. The leading digit of a pair is the last bits of its id on side A, then come the rest of that id and the id on
side B, so a sorted run has one radix after another, and within it all pairs of one A id together. A run is a directory
(pairs, documents of each) and its records, both compressed by zstd; runs are rows of a table Spark writes. Directories
alone are merged, by a heap over the runs' blocks of a radix: a pair in a third of all documents is one entry a run. The
merged order is by A id, so each id's largest count is known when its pairs have passed. Then the runs stream past the
counts of their radix, dealt over as many tasks as their size asks, and give each document its share.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import stage, whole_text

RADIX_BITS = 5
# Records held before a spill, pieces of text remembered, pieces handled at once, entries of a block, runs merged at once.
HELD, REMEMBERED, CHUNK, BLOCK, AT_ONCE = 2_000_000, 400_000, 100_000, 1 << 15, 64
# Bytes of runs that one task reads against the counts of their radix.
TASK_BYTES = 128 << 20
# White space as either tokenizer sees it and, to be safe, as Python does.
_ASCII_WHITE = r"\t-\r\x1c-\x1f"
_WIDE_WHITE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = " " + _ASCII_WHITE + _WIDE_WHITE
# Letters by any version of Unicode; others are never cut after.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f"
_REST = f"[{_WHITE}]*[^{_WHITE}{_LETTER}]*[{_LETTER}]*"
# Cut before a plain space behind anything but white space, and between a letter and an ASCII character that is none.
_FINE = f"{_REST}(?:(?:(?=[^\\x00-\\x7f{_LETTER}])|(?<=[^{_WHITE}{_LETTER}])(?=[{_ASCII_WHITE}])){_REST})*"
# Cut before such a space only.
_COARSE = f"[{_WHITE}]*[^{_WHITE}]+(?:[{_ASCII_WHITE}{_WIDE_WHITE}][{_WHITE}]*(?:[^{_WHITE}]+|$))*|[{_WHITE}]+"
SPACE = "▁"


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 itself, others from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, and the aligned pieces of texts met so far."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_b = self.b.get_piece_size()
        self.bits_b = max(1, (self.size_b - 1).bit_length())
        self.bits_a = max(RADIX_BITS + 1, (self.a.get_vocab_size() - 1).bit_length())
        if self.bits_a + self.bits_b > 32:
            raise ValueError("the ids of a pair must fit into 32 bits")
        chars = byte_of_char()
        self.chars = {b: c for c, b in chars.items()}
        self.is_word = re.compile(f" ?[{_LETTER}]+").fullmatch
        self.bytes_a = {i: bytes(chars.get(c, 63) for c in t) for t, i in self.a.get_vocab().items()}
        self.bytes_b = []
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # Ids as text with each of the signs that may follow.
        self.signed = [[b"%d%s" % (i, sign) for i in range(max(len(self.length_a), self.size_b))] for sign in (b",", b"|", b";")]
        self.cut = self._cutter()
        self.clear()

    def _cutter(self):
        """How texts are cut: as finely as no piece of side B and no boundary of side A forbids."""
        pieces = [self.bytes_b[i].decode() for i in range(self.size_b) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        crossed = lambda pattern: any(re.search(pattern, p) for p in pieces)
        if crossed(f"[^{_WHITE}] ") or crossed(r"[^\n]\n|\n[^\n]") or self.b.encode("\n", out_type=str) != [SPACE, "<0x0A>"]:
            return lambda text: [text]
        find = re.compile(_COARSE if crossed(f"[{_LETTER}](?=[\\x00-\\x7f])[^{_LETTER}]") else _FINE).findall
        return lambda text: list(filter(None, find(text)))

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.used = np.zeros(0, np.int64)
        self.sizes = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, exact
        self.first = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.uint32)

    def forget(self) -> None:
        """Only the more frequent half of the pieces stays."""
        least = int(np.median(self.used))
        keep = np.flatnonzero(self.used > least)
        place = np.full(len(self.used), -1)
        place[keep] = np.arange(len(keep))
        self.known = {p: int(place[i]) for p, i in self.known.items() if place[i] >= 0}
        self.groups = [self.groups[i] for i in keep]
        n = np.diff(self.first)[keep]
        at = np.repeat(self.first[keep] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.pairs, self.first = self.pairs[at], np.concatenate([[0], np.cumsum(n)])
        self.sizes, self.used = self.sizes[keep], np.zeros(len(keep), np.int64)

    def encode_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of each). Letters behind at most a space are one word to the tokenizer."""
        model, chars, every = self.a.model, self.chars, {}
        words = [p for p in pieces if self.is_word(p)]
        for p in words:
            every[p] = [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(chars))]
        rest = [p for p in pieces if p not in every]
        every |= zip(rest, [e.ids for e in self.a.encode_batch_fast(rest, add_special_tokens=False)])
        return _flat([every[p] for p in pieces])

    def encode_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Side B puts a space in front itself; behind a line feed, which is its byte and joins nothing, there is none.
        every = self.b.encode([p[1:] if p[0] == " " and len(p) > 1 else "\n" + p for p in pieces], num_threads=1)
        every = [e if p[0] == " " and len(p) > 1 else e[2:] for p, e in zip(pieces, every)]
        return _flat(every)

    def learn(self, pieces: Iterable[str]) -> None:
        wanted = set(pieces)
        new = list(wanted - self.known.keys())
        if new and len(self.known) > REMEMBERED:
            self.forget()
            new = list(wanted - self.known.keys())
        if not new:
            return
        size = np.fromiter((len(p.encode()) for p in new), np.int64, len(new))
        (a, n_a), (b, n_b) = self.encode_a(new), self.encode_b(new)
        unit_a, unit_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        exact = np.bincount(unit_a, self.length_a[a], len(new)) == size
        exact &= np.bincount(unit_b, self.length_b[b], len(new)) == size
        for ids, unit, known in ((a, unit_a, self.bytes_a), (b, unit_b, self.bytes_b)):
            rest = map(known.__getitem__, ids[exact[unit]].tolist())
            if b"".join(rest) != "".join(compress(new, exact)).encode():
                data: list[list[bytes]] = [[] for _ in new]
                for u, i in zip(unit.tolist(), ids.tolist()):
                    data[u].append(known[i])
                exact &= [b"".join(x) == p.encode() for x, p in zip(data, new)]
        a, unit_a, b, unit_b = a[exact[unit_a]], unit_a[exact[unit_a]], b[exact[unit_b]], unit_b[exact[unit_b]]
        groups, linked, unit_l, n_groups = self.align(a, b, unit_a)
        n_links = np.bincount(unit_l, minlength=len(new))
        text = iter(groups)
        base = len(self.groups)
        self.known.update(zip(new, range(base, base + len(new))))
        self.groups += [next(text) if e else b"" for e in exact]
        self.sizes = np.concatenate([self.sizes, np.column_stack([n_a, n_b, np.bincount(unit_a, n_groups, len(new)), n_links, exact]).astype(np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        self.pairs = np.concatenate([self.pairs, linked])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def align(self, a: np.ndarray, b: np.ndarray, unit: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(groups of each unit as text, codes of linked pairs, the unit of each, 1 for each of ``a`` that ends a group).

        ``a`` and ``b`` are ids of the same bytes, ``unit`` the ascending units of ``a``, which end on both sides.
        """
        if not len(a):
            return [], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # Between neighbouring ends of either side lies one token of each: these are linked.
        ends = np.union1d(end_a, end_b)
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        closes_a, closes_b = np.isin(end_a, end_b), np.isin(end_b, end_a)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        # Texts of the groups: A's tokens, then B's, a sign after each; those of a unit in a row.
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        ids = np.concatenate([a, b])[order].tolist()
        sign = np.concatenate([closes_a * 1, closes_b * 2])[order].tolist()
        parts = [self.signed[s][x] for s, x in zip(sign, ids)]
        upto = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        whole = b"".join(parts)
        unit_of = np.concatenate([unit, unit[np.flatnonzero(closes_a)][group_b]])[order]
        stops = upto[np.flatnonzero(np.append(unit_of[1:] != unit_of[:-1], True))].tolist()
        texts = [whole[x : y - 1] for x, y in zip([0, *stops[:-1]], stops)]
        return texts, self.code(a[i], b[j]).astype(np.uint32), unit[i], closes_a.astype(np.float64)

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a & ((1 << RADIX_BITS) - 1)) << (self.bits_a - RADIX_BITS) | a >> RADIX_BITS) << self.bits_b | b

    def ids(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids on both sides of codes of pairs."""
        a, b = code >> np.uint32(self.bits_b), code & np.uint32((1 << self.bits_b) - 1)
        high = self.bits_a - RADIX_BITS
        return (a & np.uint32((1 << high) - 1)) << np.uint32(RADIX_BITS) | a >> np.uint32(high), b


def _flat(every: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, every), np.int64, len(every))
    return np.fromiter(chain.from_iterable(every), np.int64, int(sizes.sum())), sizes


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of one length by planes of bytes, compressed; behind the length and the items' sizes."""
    raw = b"".join([np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in arrays])
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(arrays[0])], np.uint32).tobytes() + raw)


def _spread(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def _steps_of(pairs: np.ndarray) -> np.ndarray:
    return np.diff(pairs, prepend=np.uint32(0))


class _Spill:
    """Records of a task's documents on their way into runs."""

    def __init__(self, task: int, shift: int) -> None:
        self.task, self.shift = task, shift
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, pairs: np.ndarray, docs: np.ndarray, links: np.ndarray) -> None:
        self.parts.append((pairs, docs, links))
        self.held += len(pairs)

    def runs(self) -> list[tuple]:
        """(task, radix, directory, records) of all that is held, in order of pairs and documents."""
        if not self.held:
            return []
        pairs, docs, links = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.sort(pairs.astype(np.uint64) << np.uint64(32) | np.arange(len(pairs), dtype=np.uint64))
        pairs, at = (order >> np.uint64(32)).astype(np.uint32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        docs, links = docs[at], links[at]
        radix = pairs >> np.uint32(self.shift)
        cuts = np.searchsorted(radix, np.arange((1 << RADIX_BITS) + 1))
        out = []
        for r in range(1 << RADIX_BITS):
            a, b = cuts[r], cuts[r + 1]
            if a < b:
                part = pairs[a:b]
                begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                size = np.diff(np.append(begin, b - a)).astype(np.uint32)
                directory = _squeeze(_steps_of(part[begin]), size)
                out.append((self.task, r, directory, _squeeze(docs[a:b].astype(np.uint32), links[a:b].astype(np.uint32))))
        return out


_OUT = "task long, local long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, radix int, directory binary, records binary"
_DOC = ["task", "local", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
_RUN = ["task", "radix", "directory", "records"]


def _chunks(aligner: Aligner, texts: list[str]) -> Iterator[tuple[int, list[list[str]]]]:
    """Pieces of some texts at a time, with the place of the first of them."""
    held, total, first = [], 0, 0
    for n, text in enumerate(texts):
        held.append(aligner.cut(" " + text) if text else [])
        total += len(held[-1])
        if total >= CHUNK:
            yield first, held
            held, total, first = [], 0, n + 1
    if held:
        yield first, held


def _linked(aligner: Aligner, number: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, pair, links) of pieces given by text number and place: pairs of a text come once, with their sum."""
    key, times = np.unique(number.astype(np.uint64) << np.uint64(32) | code.astype(np.uint64), return_counts=True)
    code = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = aligner.first[code + 1] - aligner.first[code]
    at = np.repeat(aligner.first[code] - np.cumsum(n) + n, n) + np.arange(n.sum())
    key = np.repeat(key & ~np.uint64(0xFFFFFFFF), n) | aligner.pairs[at]
    times = np.repeat(times, n)
    order = np.argsort(key)
    key, times = key[order], times[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    links = np.add.reduceat(times, begin) if len(key) else times
    key = key[begin]
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), links


def _align(path_a: str, path_b: str, keep_groups: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner, task, local = Aligner(path_a, path_b), TaskContext.get().partitionId(), 0
        spill = _Spill(task, aligner.bits_a - RADIX_BITS + aligner.bits_b)
        for batch in batches:
            keys, texts = batch["doc_id"], batch["text"].tolist()
            for first, pieces in _chunks(aligner, texts):
                rows = len(pieces)
                aligner.learn([p for x in pieces for p in x])
                codes = [list(map(aligner.known.__getitem__, x)) for x in pieces]
                each = np.array([len(c) for c in codes], np.int64)
                number = np.repeat(np.arange(rows), each)
                flat = np.fromiter(chain.from_iterable(codes), np.int64, int(each.sum()))
                sizes = aligner.sizes[flat]
                np.add.at(aligner.used, flat, 1)
                good = np.bincount(number, 1 - sizes[:, 4], rows) == 0
                sums = [np.where(good, np.bincount(number, sizes[:, k], rows), 0).astype(np.int64) for k in range(4)]
                group = [b";".join(map(aligner.groups.__getitem__, c)) if g and c else b"" for c, g in zip(codes, good)]
                use = good[number]
                docs, pairs, links = _linked(aligner, number[use], flat[use])
                spill.add(pairs, docs + local, links)
                out = {
                    "task": task, "local": np.arange(local, local + rows), "doc_id": keys.iloc[first : first + rows].to_numpy(),
                    **dict(zip(("n_a", "n_b", "n_groups", "n_links"), sums)),
                    "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in group],
                    "groups": [g.decode() for g in group] if keep_groups else None,
                }
                yield pd.DataFrame(out).assign(radix=None, directory=None, records=None).astype({"doc_id": keys.dtype})
                local += rows
                if spill.held >= HELD:
                    yield _as_rows(spill.runs())
        yield _as_rows(spill.runs())

    return run


def _as_rows(runs: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(runs, columns=_RUN).assign(**{c: None for c in _DOC if c != "task"})


def merge_runs(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One sorted stream of (pairs, counts) of sorted streams, counts of equal pairs added; it advances by blocks.

    The heap has each stream's last loaded pair. Up to the smallest of them nothing is missing from any stream.
    """
    blocks, heap = {}, []

    def load(i: int) -> None:
        for keys, counts in runs[i]:
            if len(keys):
                blocks[i] = (keys, counts)
                heapq.heappush(heap, (int(keys[-1]), i))
                return

    for i in range(len(runs)):
        load(i)
    while heap:
        bound = heap[0][0]
        keys, counts = [], []
        for i in list(blocks):
            k, c = blocks[i]
            at = int(np.searchsorted(k, bound, "right"))
            keys.append(k[:at])
            counts.append(c[:at])
            blocks[i] = (k[at:], c[at:])
        while heap and heap[0][0] == bound:
            _, i = heapq.heappop(heap)
            del blocks[i]
            load(i)
        every, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        every, n = every[order], n[order]
        begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        yield every[begin], np.add.reduceat(n, begin)


def _blocks_of(keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a in range(0, len(keys), BLOCK):
        yield keys[a : a + BLOCK], counts[a : a + BLOCK]


def _together(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = zip(*merge_runs([_blocks_of(*r) for r in runs]))
    return np.concatenate(keys), np.concatenate(counts)


def _best(keys: np.ndarray, counts: np.ndarray, bits_b: int) -> np.ndarray:
    """Which pairs have the largest count of their A id; all pairs of an id lie side by side."""
    side = keys >> np.uint32(bits_b)
    begin = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    largest = np.maximum.reduceat(counts, begin)
    return counts == np.repeat(largest, np.diff(np.append(begin, len(keys))))


def _count(bits_b: int):
    """Counts of the pairs of each radix, whose directories come together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, runs = None, []

        def done() -> pd.DataFrame:
            keys, counts = _together(runs)
            runs.clear()
            best = _best(keys, counts, bits_b)
            cuts = range(0, len(keys), 1 << 20)
            rows = [_squeeze(_steps_of(keys[a : a + (1 << 20)]), counts[a : a + (1 << 20)].astype(np.uint64), best[a : a + (1 << 20)].astype(np.uint8)) for a in cuts]
            return pd.DataFrame({"radix": key, "piece": range(len(rows)), "counts": rows})

        for batch in batches:
            for radix, blob in zip(batch["radix"].tolist(), batch["directory"]):
                if radix != key:
                    if runs:
                        yield done()
                    key = radix
                steps, n = _spread(blob, "<u4", "<u4")
                runs.append((np.cumsum(steps, dtype=np.uint32), n.astype(np.int64)))
                if len(runs) >= AT_ONCE:
                    runs[:] = [_together(runs)]
        if runs:
            yield done()

    return run


def _contribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each run, its documents' sums over its pairs. The counts of a (radix, salt) come before its runs."""
    key, pieces, table = None, [], None
    for batch in batches:
        for radix, salt, task, counts, directory, records in zip(*(batch[c] for c in ("radix", "salt", "task", "counts", "directory", "records"))):
            if (radix, salt) != key:
                key, pieces, table = (radix, salt), [], None
            if counts is not None:
                steps, n, best = _spread(counts, "<u4", "<u8", "u1")
                pieces.append((np.cumsum(steps, dtype=np.uint32), n.astype(np.int64), best))
                continue
            if table is None:
                table, pieces = [np.concatenate(x) for x in zip(*pieces)], []
            steps, size = _spread(directory, "<u4", "<u4")
            docs, links = _spread(records, "<u4", "<u4")
            at = np.searchsorted(table[0], np.cumsum(steps, dtype=np.uint32))
            low = int(docs.min())
            docs, links = docs.astype(np.int64) - low, links.astype(np.int64)
            sums, best = np.zeros(int(docs.max()) + 1, np.int64), np.zeros(int(docs.max()) + 1, np.int64)
            # Whole numbers, added as such: a sum may pass what a double holds exactly.
            order = np.argsort(docs, kind="stable")
            begin = np.flatnonzero(np.diff(docs[order], prepend=-1))
            sums[docs[order][begin]] = np.add.reduceat((links * np.repeat(table[1][at], size))[order], begin)
            best[docs[order][begin]] = np.add.reduceat((links * np.repeat(table[2][at].astype(np.int64), size))[order], begin)
            there = docs[order][begin]
            yield pd.DataFrame({"task": task, "local": there + low, "count_sum": sums[there], "n_best": best[there]})


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are ignored) with its aligned tokens' figures.

    ``path_a`` is a byte-level tokenizer's file, ``path_b`` a SentencePiece model with byte fallback, both on every machine.
    Columns: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with ``keep_groups``, groups: ids
    as ``a1,a2|b1;a3|b2``. ``count_sum`` adds, over a document's links, the number of rows of ``docs`` that hold the pair
    linked; ``n_best`` counts links of pairs whose number is the largest of their A id, ties included. A null or empty
    text, or one whose tokens don't give back a space and the text, has zeros and an empty string. Repeated rows count
    each; a null doc_id is kept. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    every = stage(rows.mapInPandas(_align(path_a, path_b, keep_groups), _OUT.format(kind)))
    runs = every.where("radix IS NOT NULL")
    size_b = _vocabulary(path_b)
    radices = 1 << RADIX_BITS
    counted = runs.select("radix", "directory").repartition(radices, "radix").sortWithinPartitions("radix")
    counted = stage(counted.mapInPandas(_count(max(1, (size_b - 1).bit_length())), "radix int, piece int, counts binary"))
    # One row per radix.
    dealt = runs.groupBy("radix").agg(F.ceil(F.sum(F.octet_length("records")) / TASK_BYTES).cast("int").alias("salts"))
    dealt = F.broadcast(dealt)
    empty = F.lit(None).cast("binary")
    front = counted.join(dealt, "radix").select(
        "radix", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "piece", F.lit(None).cast("long").alias("task"),
        "counts", empty.alias("directory"), empty.alias("records"),
    )
    salt = F.pmod(F.xxhash64("task", F.crc32("directory")), F.col("salts")).cast("int")
    back = runs.join(dealt, "radix").select("radix", salt.alias("salt"), F.lit(1 << 30).alias("piece"), "task", empty.alias("counts"), "directory", "records")
    met = front.unionByName(back).repartition("radix", "salt").sortWithinPartitions("radix", "salt", "piece")
    shares = met.drop("piece").mapInPandas(_contribute, "task long, local long, count_sum long, n_best long")
    shares = shares.groupBy("task", "local").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    found = every.where("radix IS NULL").join(shares, ["task", "local"], "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256", *(["groups"] if keep_groups else []))


def _vocabulary(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
