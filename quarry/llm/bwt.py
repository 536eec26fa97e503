"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Strings are arrays of symbols.  Round j puts the suffixes of length j, one per string,
into the sorted sequence of all shorter ones.  A suffix ``c X`` goes behind all
suffixes that begin with less than ``c`` and those ``c Y`` with Y before X; where X stands is known
from the round before.  The sequence is held as columns of equal length:

``key``    symbol that the suffix begins with (0: the empty suffix of a string), in the high
           half, and the place of the suffix without it, in the low half: ascending
``bwt``    symbol before the suffix (0: it is a whole string)
``lcp``    symbols shared with the suffix before it in the sequence, up to ``cap``
``name``   which suffix it is: its place in the joined strings

Each round reads the columns once from front to back and writes them anew; with
``on_disk`` they lie in files between the rounds, a file a column, else in memory.
"""

from __future__ import annotations

import tempfile

import numpy as np

_COLUMNS = {"key": np.int64, "bwt": np.int32, "lcp": np.uint8, "name": np.int32}
_LOW = np.int64(0xFFFFFFFF)


class _Store:
    """The columns: each a file that is rewritten from front to back and so read again; in memory without ``on_disk``."""

    def __init__(self, on_disk: bool):
        # without a name and gone with this object, like what a task of Spark's spills
        self.files = {k: tempfile.TemporaryFile(buffering=0) for k in _COLUMNS} if on_disk else {}
        self.held, self.n = {}, 0

    def put(self, **columns):
        for k, v in columns.items():
            v = np.ascontiguousarray(v, _COLUMNS[k])
            if self.files:
                self.n = len(v)
                self.files[k].seek(0)
                v.tofile(self.files[k])
            else:
                self.held[k] = v

    def get(self, k):
        if not self.files:
            return self.held[k]
        self.files[k].seek(0)
        return np.fromfile(self.files[k], _COLUMNS[k], self.n)

    def close(self):
        for f in self.files.values():
            f.close()


def _shared(text, ends, a, b, known, cap):
    """Symbols that the suffixes a and b share, up to cap; ``known`` of them need no look."""
    n = known.copy()
    most = np.minimum(np.minimum(ends[a] - a, ends[b] - b), cap)
    at = np.flatnonzero(n < most)
    while len(at):
        k = n[at]
        same = text[a[at] + k] == text[b[at] + k]
        at = at[same]
        n[at] += 1
        at = at[n[at] < most[at]]
    return n


def build(text: np.ndarray, cuts: np.ndarray, cap: int, on_disk: bool = False) -> dict[str, np.ndarray]:
    """Columns for the strings text[cuts[i]:cuts[i + 1]] (symbols from 1 on; ranks, so that 32 bits hold them).

    The empty suffixes come first, in the order of the strings; ``name`` of an
    empty suffix is the end of its string.
    """
    lengths = np.diff(cuts)
    m = len(lengths)
    text = np.append(text, 0).astype(np.int32)
    ends = np.append(np.repeat(cuts[1:], lengths), len(text) - 1)
    place = np.arange(m)
    store = _Store(on_disk)
    last = np.where(lengths > 0, text[np.maximum(cuts[1:] - 1, 0)], 0)
    store.put(key=np.arange(m), bwt=last, lcp=np.zeros(m), name=cuts[1:])
    for length in range(1, int(lengths.max(initial=0)) + 1):
        live = np.flatnonzero(lengths >= length)
        name = cuts[1:][live] - length
        key = store.get("key")
        asked = text[name].astype(np.int64) << 32 | place[live]
        order = np.argsort(asked)
        live, name, asked = live[order], name[order], asked[order]
        new = np.searchsorted(key, asked) + np.arange(len(live))
        total = len(key) + len(live)
        is_old = np.ones(total, bool)
        is_old[new] = False
        moved = np.flatnonzero(is_old)  # where each old suffix goes

        def merged(old, added):
            out = np.empty(total, old.dtype)
            out[moved] = old
            out[new] = added
            return out

        low = key & _LOW
        key = merged((key ^ low) | moved[low], (asked & ~_LOW) | moved[asked & _LOW])
        names = merged(store.get("name"), name)
        lcp = merged(store.get("lcp"), 0)
        # a new suffix against the one before it, then the one behind it against it
        lcp[new] = _shared(text, ends, names[new - 1], names[new], np.zeros(len(new), np.int64), cap)
        # the old value there was against the suffix before the new ones: it is the least of all parts
        begin = np.flatnonzero(np.diff(new, prepend=-2) != 1)
        after = np.append(new[begin[1:] - 1], new[-1:]) + 1
        own = np.minimum.reduceat(lcp[new], begin)[after < total]
        after = after[after < total]
        old = lcp[after]
        more = (own <= old) & (old < cap)
        lcp[after[more]] = _shared(text, ends, names[after[more] - 1], names[after[more]], old[more].astype(np.int64), cap)
        before = np.where(length < lengths[live], text[np.maximum(name - 1, 0)], 0)
        store.put(key=key, bwt=merged(store.get("bwt"), before), lcp=lcp, name=names)
        place = moved[place]
        place[live] = new
    columns = {k: store.get(k) for k in _COLUMNS}
    store.close()
    return columns
