"""Token-id files: an adaptive context-mixing range coder over blocks of ids.

Layout of a frame (all integers little-endian)::

    magic "QTK2" | n_ids u32 | n_docs u32 | n_blocks u32 | n_different u32 | crc32 of the tables u32
    tables: per document id i64, has_id u8, length u32
            the different ids, u16 (u32 if n_ids > 65536), the most frequent first; their frequencies, u8 (8 log2, rounded)
    per block: n u32 | payload bytes u32 | crc32 of the ids u32 | crc32 of the payload u32 | payload

Blocks hold ``BLOCK`` ids, the last of a frame may hold fewer, and each starts
from the frame's model, that of its tables, so any block can be decoded alone.

Model.  Ids are coded by their rank among the frame's.  The rank ``x`` after ``a, b`` has three
predictions: what last followed ``(a, b)`` in the block (order 2), what last followed ``b``
(order 1), and adaptive frequencies that begin with the frame's (order 0).  Two experts, one reading the
order-2 slot's confidence and one the order-1 slot's, each give a distribution
over {order 2 is right, order 1 is right, neither}; a weight that follows the
better expert mixes them.  After "neither" the rank is coded as high part and low
byte, by counts that are re-read at doubling intervals.

The coder is sequential within a block, so a numpy vector holds one lane for
each of many blocks and all step together.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
MAGIC = b"QTK2"
_ONE = 1 << 16
_LEAST = 32
_RATE = 5
_SURE = 1 << 12  # weight of an expert that is always better
_S1, _S2 = 10, 12  # log2 of the slots of order 1 and 2
_LOW = 4  # groups of 256 ranks with low-byte counts of their own; the others share one
_GIVEN = 1 << 13  # what the frame's frequencies add up to in a block's counts, and what an id adds
_ADDED = 16

_HEAD = struct.Struct("<4sIIIII")
_BLOCK_HEAD = struct.Struct("<IIII")
_INDEX = np.dtype([("id", "<i8"), ("has", "u1"), ("n", "<u4")])

#: A slot's confidence after a miss and after a hit.
_NEXT = np.array([[0, 0, 1, 2], [1, 2, 3, 3]], np.int8)

_M32 = np.uint64(0xFFFFFFFF)
_32, _16 = np.uint64(32), np.uint64(16)


def _groups(n_ids: int) -> int:
    return (max(n_ids, 1) - 1 >> 8) + 1


def given_counts(sizes: np.ndarray, n_ids: int) -> np.ndarray:
    """The counts that a block begins with: of groups of ranks, then of low bytes in each; ``sizes``: 8 log2 of the frequencies by rank."""
    groups = _groups(n_ids)
    own = np.zeros((groups, 256))
    own.ravel()[: len(sizes)] = 2.0 ** (sizes / 8)
    low = np.vstack([own[:_LOW], np.zeros((max(0, _LOW - groups), 256)), own[_LOW:].sum(axis=0, keepdims=True)])
    scaled = lambda w: 1 + np.floor(w / np.maximum(w.sum(axis=-1, keepdims=True), 1) * _GIVEN)
    return np.concatenate([scaled(own.sum(axis=1)), scaled(low).ravel()]).astype(np.uint16)


class _Model:
    """Adaptive state of some lanes; ``n`` of the functions is the number of lanes that still run."""

    def __init__(self, given: np.ndarray, n_ids: int):
        """given: lanes x counts, from ``given_counts``."""
        lanes = len(given)
        self.lanes, self.high = lanes, _groups(n_ids)
        at = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2 = at << _S1, at << _S2
        kind = _kind(n_ids)
        self.id1, self.id2 = np.zeros(lanes << _S1, kind), np.zeros(lanes << _S2, kind)
        self.sure1, self.sure2 = np.zeros(lanes << _S1, np.int8), np.zeros(lanes << _S2, np.int8)
        # thresholds of the three-way choice by confidence, two for each expert
        first, second = np.full(lanes * 4, _ONE // 8, np.int32), np.full(lanes * 4, _ONE // 4, np.int32)
        self.a1, self.a2, self.b1, self.b2 = first, second, first.copy(), second.copy()
        self.weight = np.full(lanes, _SURE // 2, np.int32)
        self.lane4 = at << 2
        self.count = given
        self.next_reading = 16
        self._read_counts()

    def _read_counts(self):
        high = self.high
        cut = np.empty((self.lanes, high + 1), np.int32)
        self.cut_high = self._cuts(self.count[:, :high], cut)
        low = self.count[:, high:].reshape(self.lanes * (_LOW + 1), 256)
        self.cut_low = self._cuts(low, np.empty((len(low), 257), np.int32))

    @staticmethod
    def _cuts(count, cut):
        """Cumulative counts, scaled to 2**16 such that each symbol keeps at least one."""
        k = count.shape[1]
        cut[:, 0] = 0
        np.cumsum(count, axis=1, dtype=np.int32, out=cut[:, 1:])
        scale = ((_ONE - k) / cut[:, -1]).astype(np.float32)
        for at in range(0, len(cut), 4096):  # a few rows at a time, for the cache
            np.multiply(cut[at : at + 4096], scale[at : at + 4096, None], out=cut[at : at + 4096], casting="unsafe")
        cut += np.arange(k + 1, dtype=np.int32)
        cut[:, -1] = _ONE
        return cut

    def predict(self, a, b, n):
        k1 = self.base1[:n] + ((b * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - _S1))
        k2 = self.base2[:n] + (((a * 0x85EBCA6B + b * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - _S2))
        s1, s2 = self.sure1[k1], self.sure2[k2]
        ia, ib = self.lane4[:n] + s2, self.lane4[:n] + s1
        a1, a2, b1, b2, w = self.a1[ia], self.a2[ia], self.b1[ib], self.b2[ib], self.weight[:n]
        d1, d2 = a1 - b1, a2 - b2
        c1 = np.minimum(np.maximum(b1 + (d1 * w >> 12), _LEAST), _ONE - 2 * _LEAST)
        c2 = np.minimum(np.maximum(b2 + (d2 * w >> 12), c1 + _LEAST), _ONE - _LEAST)
        self.now = (k1, k2, s1, s2, ia, ib, a1, a2, b1, b2, d1, d2)
        return self.id2[k2], self.id1[k1], c1, c2

    def learn(self, x, right2, right1, n):
        k1, k2, s1, s2, ia, ib, a1, a2, b1, b2, d1, d2 = self.now
        either = right2 | right1
        lo, hi = right2.astype(np.int32) << 16, either.astype(np.int32) << 16
        self.a1[ia], self.a2[ia] = a1 + (lo - a1 >> _RATE), a2 + (hi - a2 >> _RATE)
        self.b1[ib], self.b2[ib] = b1 + (lo - b1 >> _RATE), b2 + (hi - b2 >> _RATE)
        # by how much the order-2 expert gave what came a larger share
        gain = np.where(right2, d1, np.where(either, d2 - d1, -d2))
        w = self.weight[:n]
        w += (np.where(gain > 0, _SURE, 0) - w) >> 6
        self.sure1[k1] = _NEXT[right1.view(np.int8), s1]
        self.sure2[k2] = _NEXT[right2.view(np.int8), s2]
        self.id1[k1] = x
        self.id2[k2] = x

    def count_ids(self, lanes, high, low):
        self.count[lanes, high] += _ADDED
        self.count[lanes, self.high + np.minimum(high, _LOW) * 256 + low] += _ADDED

    def turn(self, step):
        if step + 1 == self.next_reading:
            self._read_counts()
            self.next_reading *= 2


class _Encoder:
    def __init__(self, lanes, cap):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.out, self.n = np.empty((lanes, cap), "<u4"), np.zeros(lanes, np.int64)

    def put(self, lanes, cum, freq):
        r = self.range[lanes] >> _16
        low = self.low[lanes] + cum.astype(np.uint64) * r
        r *= freq.astype(np.uint64)
        small = np.flatnonzero(r <= _M32)
        if len(small):
            l, s = low[small], r[small]
            across = (l >> _32) != ((l + s - np.uint64(1)) >> _32)
            s = np.where(across, np.uint64(1 << 32) - (l & _M32), s)
            at = small if isinstance(lanes, slice) else lanes[small]
            self.out[at, self.n[at]] = l >> _32
            self.n[at] += 1
            # a range that reaches the boundary is one short of it, or it would not fit
            low[small], r[small] = l << _32, np.where(s > _M32, ~np.uint64(0), s << _32)
        self.low[lanes], self.range[lanes] = low, r

    def finish(self, n):
        at = np.arange(n)
        for word in (self.low[:n] >> _32, self.low[:n] & _M32):
            self.out[at, self.n[:n]] = word
            self.n[:n] += 1


class _Decoder:
    def __init__(self, words, starts):
        """words: all payloads in one array; starts: where each lane's begins."""
        self.words, self.at = words, starts + 2
        self.low = np.zeros(len(starts), np.uint64)
        self.range = np.full(len(starts), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = (words[starts].astype(np.uint64) << _32) | words[starts + 1]

    def look(self, lanes):
        self.step = self.range[lanes] >> _16
        return np.minimum((self.code[lanes] - self.low[lanes]) // self.step, np.uint64(_ONE - 1)).astype(np.int64)

    def take(self, lanes, cum, freq):
        low = self.low[lanes] + cum.astype(np.uint64) * self.step
        r = freq.astype(np.uint64) * self.step
        small = np.flatnonzero(r <= _M32)
        if len(small):
            l, s = low[small], r[small]
            across = (l >> _32) != ((l + s - np.uint64(1)) >> _32)
            s = np.where(across, np.uint64(1 << 32) - (l & _M32), s)
            at = small if isinstance(lanes, slice) else lanes[small]
            self.code[at] = (self.code[at] << _32) | self.words[self.at[at]]
            self.at[at] += 1
            low[small], r[small] = l << _32, np.where(s > _M32, ~np.uint64(0), s << _32)
        self.low[lanes], self.range[lanes] = low, r


def _by_length(lengths):
    order = np.argsort(-lengths, kind="stable")
    return order, lengths[order]


def encode_blocks(ids: np.ndarray, cuts: np.ndarray, given: np.ndarray, n_ids: int) -> list[bytes]:
    """Payload of each block ids[cuts[i]:cuts[i + 1]] of ranks; ``given``: the counts that it begins with."""
    order, lengths = _by_length(np.diff(cuts))
    lanes, longest = len(order), int(lengths[0]) if len(order) else 0
    grid = np.zeros((longest, lanes), np.int32)
    for at in range(0, lanes, 64):  # a few lanes at a time, for the cache
        own = np.zeros((min(64, lanes - at), longest), np.int32)
        for row, (block, n) in zip(own, zip(order[at : at + 64], lengths[at : at + 64])):
            row[:n] = ids[cuts[block] : cuts[block] + n]
        grid[:, at : at + 64] = own.T
    model, coder = _Model(given[order], n_ids), _Encoder(lanes, 2 * longest + 4)
    b = a = np.zeros(lanes, np.int64)
    for step in range(longest):
        n = int(np.searchsorted(-lengths, -step, "left"))
        x, a, b, all_n = grid[step, :n].astype(np.int64), a[:n], b[:n], slice(0, n)
        p2, p1, c1, c2 = model.predict(a, b, n)
        right2, right1 = p2 == x, p1 == x
        cum = np.where(right2, 0, np.where(right1, c1, c2))
        coder.put(all_n, cum, np.where(right2, c1, np.where(right1, c2, _ONE)) - cum)
        rest = np.flatnonzero(~(right2 | right1))
        if len(rest):
            y = x[rest]
            high, low = y >> 8, y & 255
            cut = model.cut_high[rest, high]
            coder.put(rest, cut, model.cut_high[rest, high + 1] - cut)
            row = rest * (_LOW + 1) + np.minimum(high, _LOW)
            cut = model.cut_low[row, low]
            coder.put(rest, cut, model.cut_low[row, low + 1] - cut)
            model.count_ids(rest, high, low)
        model.learn(x, right2, right1, n)
        model.turn(step)
        a, b = b, x
    coder.finish(lanes)
    out: list[bytes] = [b""] * lanes
    for lane, block in enumerate(order):
        out[block] = coder.out[lane, : coder.n[lane]].tobytes()
    return out


def _search(cuts, rows, v, width):
    """The symbol whose interval holds v: binary search in each row."""
    flat, base = cuts.ravel(), rows * cuts.shape[1]
    lo = np.zeros(len(v), np.int64)
    step = 1 << max(width - 1, 1).bit_length() - 1
    while step:
        probe = lo + step
        fits = probe < width
        fits &= flat[base + np.minimum(probe, width - 1)] <= v
        lo += fits * step
        step >>= 1
    return lo


def decode_blocks(payloads: list[bytes], lengths: np.ndarray, given: np.ndarray, n_ids: int) -> np.ndarray:
    """All ranks of the blocks, one block after the other."""
    order, sizes = _by_length(np.asarray(lengths, np.int64))
    lanes, longest = len(order), int(sizes[0]) if len(order) else 0
    parts = [payloads[i] for i in order]
    starts = np.cumsum([0, *[len(p) // 4 + 2 for p in parts]])[:-1].astype(np.int64)
    words = np.frombuffer(b"".join(p + bytes(8) for p in parts), "<u4").astype(np.uint64)
    grid = np.zeros((longest, lanes), np.int32)
    if not lanes:
        return np.zeros(0, np.int32)
    model, coder = _Model(given[order], n_ids), _Decoder(words, starts)
    b = a = np.zeros(lanes, np.int64)
    for step in range(longest):
        n = int(np.searchsorted(-sizes, -step, "left"))
        a, b, all_n = a[:n], b[:n], slice(0, n)
        p2, p1, c1, c2 = model.predict(a, b, n)
        v = coder.look(all_n)
        above1, above2 = v >= c1, v >= c2
        cum = np.where(above2, c2, np.where(above1, c1, 0))
        coder.take(all_n, cum, np.where(above2, _ONE, np.where(above1, c2, c1)) - cum)
        x = np.where(above1, p1, p2).astype(np.int64)
        rest = np.flatnonzero(above2)
        if len(rest):
            v = coder.look(rest)
            high = _search(model.cut_high, rest, v, model.high)
            cut = model.cut_high[rest, high]
            coder.take(rest, cut, model.cut_high[rest, high + 1] - cut)
            row = rest * (_LOW + 1) + np.minimum(high, _LOW)
            v = coder.look(rest)
            low = _search(model.cut_low, row, v, 256)
            cut = model.cut_low[row, low]
            coder.take(rest, cut, model.cut_low[row, low + 1] - cut)
            model.count_ids(rest, high, low)
            x[rest] = high << 8 | low
        model.learn(x, p2 == x, p1 == x, n)
        model.turn(step)
        grid[step, :n] = x
        a, b = b, x
    ends = np.cumsum(np.asarray(lengths, np.int64))
    out = np.empty(int(ends[-1]), np.int32)
    for at in range(0, lanes, 64):
        own = np.ascontiguousarray(grid[:, at : at + 64].T)
        for row, block, n in zip(own, order[at : at + 64], sizes[at : at + 64]):
            out[ends[block] - n : ends[block]] = row[:n]
    return out


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, most frequent first, 8 log2 of their frequencies, and the ranks of all ids."""
    kinds, back, n = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    return kinds[order], np.minimum(np.rint(8 * np.log2(n[order])), 255).astype(np.uint8), rank.astype(np.int32)[back]


def write_frames(frames: list[tuple[list[int | None], list[np.ndarray]]], n_ids: int, block: int = BLOCK) -> list[bytes]:
    """Encode frames together, so that many blocks share the numpy calls."""
    if _GIVEN + 512 + block * _ADDED > 0xFFFF:
        raise ValueError("a block of so many ids would overflow its counts")
    streams = [np.concatenate([np.zeros(0, np.int32), *docs], dtype=np.int32, casting="unsafe") for _, docs in frames]
    told = [_ranked(s) for s in streams]
    cuts, at, spans = [0], 0, []
    for s in streams:
        edges = list(range(block, len(s), block)) + ([len(s)] if len(s) else [])
        spans.append((len(cuts) - 1, len(edges)))
        cuts += [at + e for e in edges]
        at += len(s)
    cuts = np.asarray(cuts, np.int64)
    given = np.repeat(np.array([given_counts(t[1], n_ids) for t in told]), [n for _, n in spans], axis=0) if frames else np.zeros((0, 0), np.uint16)
    ranks, told = np.concatenate([np.zeros(0, np.int32), *(t[2] for t in told)]), [t[:2] for t in told]
    payloads = encode_blocks(ranks, cuts, given, n_ids)
    out = []
    for (doc_ids, docs), ids, (kinds, sizes), (first, n) in zip(frames, streams, told, spans):
        index = np.zeros(len(docs), _INDEX)
        index["id"] = [0 if i is None else i for i in doc_ids]
        index["has"] = [i is not None for i in doc_ids]
        index["n"] = [len(d) for d in docs]
        raw = index.tobytes() + kinds.astype(_kind(n_ids)).tobytes() + sizes.tobytes()
        parts = [_HEAD.pack(MAGIC, n_ids, len(docs), n, len(kinds), zlib.crc32(raw)), raw]
        for k in range(first, first + n):
            own = ids[cuts[k] - cuts[first] : cuts[k + 1] - cuts[first]].astype("<u4").tobytes()
            parts += [_BLOCK_HEAD.pack(len(own) // 4, len(payloads[k]), zlib.crc32(own), zlib.crc32(payloads[k])), payloads[k]]
        out.append(b"".join(parts))
    return out


def _kind(n_ids: int) -> np.dtype:
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


def _tables(frame: bytes, at: int = 0) -> tuple[int, int, int, int, int]:
    """n_ids, n_docs, n_blocks, n_different and the offset of the first block of the frame that begins at ``at``."""
    magic, n_ids, n_docs, n_blocks, n_kinds, _ = _HEAD.unpack_from(frame, at)
    if magic != MAGIC:
        raise ValueError("not a token frame")
    return n_ids, n_docs, n_blocks, n_kinds, at + _HEAD.size + n_docs * _INDEX.itemsize + n_kinds * (_kind(n_ids).itemsize + 1)


def frame_index(frame: bytes) -> np.ndarray:
    """The document index of a frame, checked."""
    _, n_docs, _, _, end = _tables(frame)
    raw = frame[_HEAD.size : end]
    if zlib.crc32(raw) != _HEAD.unpack_from(frame)[5]:
        raise ValueError("a frame's tables are damaged")
    return np.frombuffer(raw, _INDEX, n_docs)


def frame_size(data: bytes, at: int = 0) -> int:
    """Bytes of the frame that begins at ``at``."""
    _, _, n_blocks, _, end = _tables(data, at)
    for _ in range(n_blocks):
        end += _BLOCK_HEAD.size + _BLOCK_HEAD.unpack_from(data, end)[1]
    return end - at


def read_frames(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(index, ids) of each frame; raises ValueError on a damaged block."""
    payloads, lengths, crcs, spans, given, n_ids = [], [], [], [], [], 1
    for f in frames:
        index = frame_index(f)
        n_ids, n_docs, n_blocks, n_kinds, at = _tables(f)
        kinds = np.frombuffer(f, _kind(n_ids), n_kinds, _HEAD.size + n_docs * _INDEX.itemsize).astype(np.int32 if n_ids <= 1 << 31 else np.int64)
        given += [given_counts(np.frombuffer(f, np.uint8, n_kinds, at - n_kinds), n_ids)] * n_blocks
        for _ in range(n_blocks):
            n, size, crc_ids, crc_payload = _BLOCK_HEAD.unpack_from(f, at)
            payload = f[at + _BLOCK_HEAD.size : at + _BLOCK_HEAD.size + size]
            if len(payload) != size or zlib.crc32(payload) != crc_payload:
                raise ValueError("a block's payload is damaged")
            payloads.append(payload)
            lengths.append(n)
            crcs.append(crc_ids)
            at += _BLOCK_HEAD.size + size
        spans.append((index, n_blocks, kinds))
    ranks, out, block, at = decode_blocks(payloads, np.asarray(lengths, np.int64), np.array(given or [[]], np.uint16), n_ids), [], 0, 0
    for index, n_blocks, kinds in spans:
        n = sum(lengths[block : block + n_blocks])
        ids = kinds[ranks[at : at + n]]
        first = 0
        for k in range(block, block + n_blocks):
            if zlib.crc32(ids[first : first + lengths[k]].astype("<u4").tobytes()) != crcs[k]:
                raise ValueError("a block's ids are damaged")
            first += lengths[k]
        block, at = block + n_blocks, at + n
        out.append((index, ids))
    return out
