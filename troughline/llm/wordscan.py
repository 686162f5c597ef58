"""Words and word shingles of a batch of texts as numpy arrays of positions and hashes.

Works on the UTF-8 bytes of whole Arrow batches. All hashes are 64-bit and depend on the words
alone, never on the batch, so that tables of hashes from different tasks can be joined.
"""

import hashlib

import numpy as np

#: Bytes of text that are hashed at once; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = []

#: Byte -> byte with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte -> the same byte.
AS_IS = np.arange(256, dtype=np.uint8)

#: Words are runs of bytes that are not ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words are runs of 0-9, a-z (after lower-casing) and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x41:0x5B] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(h):
    """Finaliser that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables():
    """Powers of the base and of its inverse modulo 2**64, for every position in a chunk."""
    if not _powers:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base in (_BASE, inverse):
            powers = np.full(CHUNK_BYTES + 1, base, dtype=np.uint64)
            powers[0] = 1
            _powers.append(np.multiply.accumulate(powers))
    return _powers


def _hashes(data, starts, ends, fold):
    """Hash of every word; a word that is longer than a chunk is digested on its own."""
    powers, inverse = _tables()
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        folded = fold[data[lo:hi]]
        if hi - lo > CHUNK_BYTES:
            out[i] = int.from_bytes(hashlib.blake2b(folded.tobytes(), digest_size=8).digest(), "little")
        else:
            running = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * powers[: hi - lo], out=running[1:])
            first, last = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((running[last] - running[first]) * inverse[first] + (last - first).astype(np.uint64))
        i = j
    return out


def chunks(array, limit=CHUNK_BYTES):
    """Split an Arrow string array into (first row, last row, bytes, offsets) chunks.

    ``offsets`` has one entry more than rows and starts at 0. Null texts are empty.
    """
    import pyarrow as pa

    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0:
        return
    offsets = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data, offsets, inside, fold=LOWER):
    """Starts and ends of all words in bytes, the row of each word, and its hash.

    Words never cross a row. ``fold`` maps bytes before hashing.
    """
    n = len(data)
    is_word = inside[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = is_word[edges]
    ends[edges - 1] = is_word[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(ends) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows, _hashes(data, starts, ends, fold)


def grams(hashes, size):
    """Hash of every run of ``size`` words; entry i covers words i to i + size - 1."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= _STEP
        total += hashes[k : k + n]
    return mix(total)


def row_bounds(rows, n):
    """First word of each row, with one entry more than rows."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingle_sets(data, offsets, inside=SPACED, size=5):
    """Per row the sorted distinct shingle hashes; a text of fewer words is one shingle, an empty one none."""
    _, _, rows, hashes = words(data, offsets, inside)
    n = len(offsets) - 1
    bounds = row_bounds(rows, n)
    all_grams = grams(hashes, size)
    sets = []
    for row in range(n):
        lo, hi = bounds[row], bounds[row + 1]
        if hi - lo >= size:
            sets.append(np.unique(all_grams[lo : hi - size + 1]))
        elif hi > lo:
            sets.append(grams(hashes[lo:hi], int(hi - lo)) ^ np.uint64(hi - lo))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets
