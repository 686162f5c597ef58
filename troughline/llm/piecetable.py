"""Bounded table of encoded text pieces, looked up for a whole batch of words at once.

A piece is known by the 64-bit hash of its bytes. Values of all pieces lie end to end in one array, so
that the values of a batch are gathered without a Python step a word. New pieces enter a small recent
part first, which joins the main part when it has grown to an eighth of it; a table that is full, in
pieces or in bytes of their values, starts anew.
"""

import numpy as np

#: Bytes of values, over all pieces, for each piece that a table may have.
PIECE_BYTES = 32


def gather(values, starts, lengths):
    """``values`` of all pieces end to end, in the order of ``starts``."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    begin = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - begin, lengths) + np.arange(total)]


class _Part:
    def __init__(self, keys, starts, lengths):
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts, self.lengths = ([x.astype(np.uint32, copy=False)[order] for x in xs] for xs in (starts, lengths))

    def find(self, keys):
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == keys) if len(self.keys) else np.zeros(len(keys), dtype=bool)


class PieceTable:
    """Maps piece hashes to one variable-length entry in each of several value arrays."""

    def __init__(self, dtypes, limit):
        self.dtypes, self.limit = dtypes, limit
        self.clear()

    def clear(self):
        self.values = [np.zeros(0, dtype=d) for d in self.dtypes]
        self.parts = [self._empty(), self._empty()]

    def _empty(self):
        none = [np.zeros(0, dtype=np.int64) for _ in self.dtypes]
        return _Part(np.zeros(0, dtype=np.uint64), none, none)

    def __len__(self):
        return sum(len(p.keys) for p in self.parts)

    def look(self, keys, encode):
        """Starts and lengths, for each value array, of every key.

        ``encode(positions)`` gets the first position of each unknown key and returns, for each value
        array, (values end to end, lengths).
        """
        if len(self) >= self.limit or sum(v.nbytes for v in self.values) >= self.limit * PIECE_BYTES:
            self.clear()
        starts = [np.zeros(len(keys), dtype=np.int64) for _ in self.dtypes]
        lengths = [np.zeros(len(keys), dtype=np.int64) for _ in self.dtypes]
        open_at = np.arange(len(keys))
        for part in self.parts:
            at, there = part.find(keys[open_at])
            rows, at = open_at[there], at[there]
            for k in range(len(self.dtypes)):
                starts[k][rows], lengths[k][rows] = part.starts[k][at], part.lengths[k][at]
            open_at = open_at[~there]
        if len(open_at):
            fresh, first, back = np.unique(keys[open_at], return_index=True, return_inverse=True)
            encoded = encode(open_at[first])
            new_starts, new_lengths = [], []
            for k, (values, sizes) in enumerate(encoded):
                sizes = np.asarray(sizes, dtype=np.int64)
                new_starts.append(len(self.values[k]) + np.cumsum(sizes) - sizes)
                new_lengths.append(sizes)
                self.values[k] = np.concatenate([self.values[k], values])
                starts[k][open_at], lengths[k][open_at] = new_starts[k][back], sizes[back]
            self._add(fresh, new_starts, new_lengths)
        return starts, lengths

    def _add(self, keys, starts, lengths):
        main, recent = self.parts
        recent = self._joined(recent, _Part(keys, starts, lengths))
        if len(recent.keys) * 8 > len(main.keys):
            main, recent = self._joined(main, recent), self._empty()
        self.parts = [main, recent]

    def _joined(self, a, b):
        return _Part(
            np.concatenate([a.keys, b.keys]),
            [np.concatenate(pair) for pair in zip(a.starts, b.starts)],
            [np.concatenate(pair) for pair in zip(a.lengths, b.lengths)],
        )
