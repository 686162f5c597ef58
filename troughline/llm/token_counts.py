"""Token counts of whole texts under a piece vocabulary, without writing any token.

The vocabulary file (its path is a parameter) scores pieces. A text gets a blank in front, blanks become
the blank mark, and each character is a symbol at first; one that is no piece counts as its UTF-8 bytes.
Of all adjacent pairs that join to a piece, the one of the best score (the leftmost of equals) is joined,
until none is left. Symbols form a linked list and open pairs a heap, so that a word of any length takes
n log n steps. Every join makes one symbol of two, so the count is the first symbols less the joins.

Pairs that no piece contains are never joined, so a text may be cut there: before a run of blanks, and on
both sides of a character that stands in no longer piece. Equal parts are counted once; each worker keeps
a bounded table of the parts it has met, looked up for a whole batch at once.

Defined cases: null text is empty; an empty text has no tokens and no bytes; blanks alone are counted; the
strings of special tokens are ordinary text; a text of any length is counted whole (its symbols are held by
one worker); rows that repeat are counted again; null ids stay; no rows give no rows; extra columns, whatever
their names, are left out.
"""

import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from troughline.llm import wordscan
from troughline.llm.base import python_ready, read_file, worker_cache
from troughline.llm.piecetable import PieceTable

#: Parts of texts that a worker remembers; a full table starts anew.
REMEMBERED = 2_000_000
BLANK = "▁"
_BLANK_BYTES = np.frombuffer(BLANK.encode(), dtype=np.uint8)

# Fixed numbers of the file format: fields of the model and of a piece, kinds of pieces, and settings.
PIECE_FIELD, TRAINER_FIELD, NORMALIZER_FIELD = 1, 2, 3
TEXT, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, BYTE_FALLBACK, PAIR_MERGES = 3, 35, 2
CHARACTER_MAP, BLANK_IN_FRONT, SQUEEZE_BLANKS, BLANK_MARKS = 2, 3, 4, 5


def _fields(raw):
    """(number, value) of each field of a message: an integer, or the bytes of the field."""
    at = 0

    def integer():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        key = integer()
        kind = key & 7
        if kind == 0:
            yield key >> 3, integer()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else integer()
        yield key >> 3, raw[at : at + size]
        at += size


class PieceCounter:
    """Counts of one vocabulary file."""

    def __init__(self, raw):
        self.scores, trainer, normalizer = {}, {}, {}
        for number, value in _fields(raw):
            if number == PIECE_FIELD:
                piece = dict(_fields(value))
                kind = piece.get(KIND, NORMAL)
                if kind == NORMAL:
                    (score,) = struct.unpack("<f", piece.get(SCORE, bytes(4)))
                    self.scores[piece[TEXT].decode()] = score
                elif kind in (USER_DEFINED, UNUSED):
                    raise ValueError("vocabularies with user-defined or unused pieces are not supported")
            elif number == TRAINER_FIELD:
                trainer = dict(_fields(value))
            elif number == NORMALIZER_FIELD:
                normalizer = dict(_fields(value))
        if trainer.get(MODEL_TYPE, 1) != PAIR_MERGES or not trainer.get(BYTE_FALLBACK, 0):
            raise ValueError("only pair merges with byte fallback are supported")
        if normalizer.get(CHARACTER_MAP) or normalizer.get(SQUEEZE_BLANKS, 1) or not normalizer.get(BLANK_MARKS, 1):
            raise ValueError("only texts that are taken as they are, but for blank marks, are supported")
        self.blank_in_front = bool(normalizer.get(BLANK_IN_FRONT, 1))
        longer = [piece for piece in self.scores if len(piece) > 1]
        if any(c not in self.scores for piece in longer for c in piece):
            raise ValueError("a character of a piece is no piece itself")
        self.longest = max(map(len, longer), default=1)
        joined = {c for piece in longer for c in piece}
        #: bytes that are a part of their own: ASCII characters that are never joined
        self.alone = np.array([b < 128 and b != 0x20 and chr(b) not in joined for b in range(256)])
        #: whether a text may be cut before a run of blanks
        self.cut = not any(a != BLANK and b == BLANK for piece in longer for a, b in zip(piece, piece[1:]))
        self.table = PieceTable([np.dtype(np.int64)], REMEMBERED)

    def count(self, text):
        """Tokens of a part of a text, with blanks as they are in the text and none added."""
        text = text.replace(" ", BLANK)
        scores, longest, n = self.scores, self.longest, len(text)
        total = sum(1 if c in scores else len(c.encode()) for c in text)
        # a symbol is named by where it begins; end 0 marks one that was joined to its left neighbour
        ends, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(left):
            right = after[left]
            if right < n:
                end = ends[right]
                if end - left <= longest:
                    score = scores.get(text[left:end])
                    if score is not None:
                        heapq.heappush(heap, (-score, left, end))

        for left in range(n - 1):
            offer(left)
        while heap:
            _, left, end = heapq.heappop(heap)
            right = after[left]
            if not ends[left] or right >= n or ends[right] != end:
                continue  # one of the two has been joined otherwise
            total -= 1
            ends[left], ends[right] = end, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return total

    def count_column(self, texts):
        """Tokens of every text of an Arrow array, as arrays for chunks of rows."""
        for _, _, data, offsets in wordscan.chunks(texts):
            n = len(offsets) - 1
            if self.blank_in_front:
                filled = np.flatnonzero(offsets[1:] > offsets[:-1])
                data = np.insert(data, offsets[:-1][filled], 0x20)
                offsets = offsets.copy()
                offsets[1:] += np.cumsum(np.isin(np.arange(n), filled, assume_unique=True))
            starts, ends, rows, ones = self._parts(data, offsets)
            keys = wordscan._hashes(data, starts, ends, wordscan.AS_IS)

            def counted(at):
                raw = data.tobytes()
                got = [self.count(raw[s:e].decode("utf-8")) for s, e in zip(starts[at].tolist(), ends[at].tolist())]
                return ((np.array(got, dtype=np.int64), np.ones(len(got), dtype=np.int64)),)

            begins, _ = self.table.look(keys, counted)
            totals = np.concatenate([[0], np.cumsum(self.table.values[0][begins[0]])])
            bounds = wordscan.row_bounds(rows, n)
            yield totals[bounds[1:]] - totals[bounds[:-1]] + ones

    def _parts(self, data, offsets):
        """Starts, ends and rows of the parts that may be joined inside, and the lone characters of each row."""
        n = len(data)
        alone = self.alone[data]
        begins = alone.copy()
        begins[1:] |= alone[:-1]
        if self.cut:
            blank = data == 0x20
            begins[1:] |= blank[1:] & ~blank[:-1]
            # a blank mark that the text itself holds joins the blanks behind it
            a, b, c = _BLANK_BYTES
            mark = np.flatnonzero((data[:-3] == a) & (data[1:-2] == b) & (data[2:-1] == c)) + 3
            begins[mark[blank[mark]]] = False
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[filled] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n) if len(starts) else starts
        rows = np.searchsorted(offsets, starts, side="right") - 1
        lone = alone[starts] if len(starts) else np.zeros(0, dtype=bool)
        ones = np.bincount(rows[lone], minlength=len(offsets) - 1)
        return starts[~lone], ends[~lone], rows[~lone], ones


_loaded = worker_cache()


def _loader(shared, key):
    """The counter of this worker, built once from the broadcast file."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceCounter(shared.value)
    return _loaded[key]


def count_tokens(df, path, limit, id_col="doc_id", text_col="text"):
    """Per row doc_id, n_bytes (UTF-8), n_tokens and over_limit (more tokens than ``limit``)."""
    spark = df.sparkSession
    python_ready(spark)
    raw = read_file(path)
    PieceCounter(raw)  # a file that is not supported is an error here, not in a task
    shared, key = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches):
        counter = _loader(shared, key)
        for batch in batches:
            counts = np.concatenate([np.zeros(0, dtype=np.int64), *counter.count_column(batch.column("text"))])
            arrays = [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
