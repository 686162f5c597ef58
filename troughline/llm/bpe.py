"""Byte-pair encoding and decoding with a contiguous rank array a word.

The vocabulary file (its path is a parameter) fixes the text rules: canonical composition, white
space that only divides, lower case character by character, words by a pattern, bytes written as
printable characters, and an end mark on the last symbol of a word. The merges are applied here:
a short word holds its part boundaries and, beside each, the rank of the pair that starts there, in
one contiguous array; the smallest rank is found by a scan, its boundary deleted, and the ranks of
the two neighbours are looked up anew. For words beyond ``SHORT_WORD`` symbols, where repeated scans
would be quadratic, the same merges run off a heap of ranks.

Spark spreads the documents; each worker keeps a bounded table of the words it has encoded.

Defined cases: null text is empty and has no ids; an empty text decodes to an empty one; special
tokens written in a text are their ids; a row that repeats is encoded again; extra columns are left out.
"""

import hashlib
import heapq
import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from troughline.llm import wordscan
from troughline.llm.base import python_ready, read_file, trim, worker_cache
from troughline.llm.piecetable import PieceTable, gather

#: Symbols up to which a word's smallest rank is found by scanning.
SHORT_WORD = 64
#: Parts of texts (some 50 bytes each), and words (some 300), that a worker remembers; a full table starts anew.
REMEMBERED = 800_000
REMEMBERED_WORDS = 20_000
REMEMBERED_CHARS = 48

_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_NO_RANK = 1 << 60
_MARKS = frozenset(".,;:!?")


def byte_symbols():
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols = {byte: chr(byte) for byte in printable}
    spare = 0x100
    for byte in range(256):
        if byte not in symbols:
            symbols[byte] = chr(spare)
            spare += 1
    return [symbols[byte] for byte in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file with end-of-word marks."""

    def __init__(self, raw):
        import regex

        spec = json.loads(raw)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        added = spec["added_tokens"]
        names = {i: token for token, i in self.vocab.items()}
        names.update({token["id"]: token["content"] for token in added})
        self.names = [names.get(i) for i in range(max(names) + 1)]
        self.special = {token["content"]: token["id"] for token in added}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.special_hint = os.path.commonprefix(list(self.special))
        # pair of ids -> rank and, in the low bits, the id of the joined symbol
        self.merges = {
            (self.vocab[left], self.vocab[right]): rank << _ID_BITS | self.vocab[left + right]
            for rank, (left, right) in enumerate(model["merges"])
        }
        (split,) = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.inner = [self.vocab[s] for s in byte_symbols()]
        self.last = [self.vocab[s + self.end] for s in byte_symbols()]
        self.pieces, self.words = PieceTable([np.dtype("<u4"), np.uint8], REMEMBERED), {}

    # --- words -----------------------------------------------------------------------------

    def encode_word(self, word):
        """Ids of one word of the pattern."""
        raw = word.encode("utf-8")
        inner = self.inner
        ids = [inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        if len(ids) > SHORT_WORD:
            return self._encode_long(ids)
        get = self.merges.get
        # entry i: the merge of part i with part i + 1
        ranks = [get(pair, _NO_RANK) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NO_RANK:
                break
            at = ranks.index(best)
            ids[at] = best & _ID_MASK
            del ids[at + 1]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], ids[at]), _NO_RANK)
            if at < len(ranks):
                ranks[at] = get((ids[at], ids[at + 1]), _NO_RANK)
        return ids

    def _encode_long(self, ids):
        """The same merges, leftmost of the smallest rank first, with a heap instead of scans."""
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def push(left):
            right = after[left]
            if right < n:
                merge = merges.get((ids[left], ids[right]))
                if merge is not None:
                    heapq.heappush(heap, (merge >> _ID_BITS, left, ids[left], ids[right], merge & _ID_MASK))

        for left in range(n - 1):
            push(left)
        while heap:
            _, left, first, second, joined = heapq.heappop(heap)
            right = after[left]
            if not alive[left] or right >= n or ids[left] != first or ids[right] != second:
                continue
            ids[left] = joined
            alive[right] = False
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            if before[left] >= 0:
                push(before[left])
            push(left)
        return [i for i, live in zip(ids, alive) if live]

    # --- texts -----------------------------------------------------------------------------

    # Encoded parts are pairs: ids as little-endian 32-bit bytes, and their decoded text with a blank after
    # each symbol (the vocabulary has no decoder of its own, so symbols are joined by blanks).

    def _plain(self, text):
        """A text without special tokens."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # character by character: only the capital sigma has a lower case that depends on its neighbours
        text = text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))
        # the two common shapes of a part, which the pattern would cut the same way
        if text.isalpha():
            return self._word(text)
        if text[-1:] in _MARKS and text[:-1].isalpha():
            word, mark = self._word(text[:-1]), self._word(text[-1])
            return word[0] + mark[0], word[1] + mark[1]
        found = [self._word(word) for word in self.pattern.findall(text)]
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])

    def _word(self, word):
        got = self.words.get(word)
        if got is None:
            ids = self.encode_word(word)
            got = array("I", ids).tobytes(), self.decode(ids) + " "
            if len(word) <= REMEMBERED_CHARS:
                if len(self.words) >= REMEMBERED_WORDS:
                    self.words.clear()
                self.words[word] = got
        return got

    def _piece(self, piece):
        """A part of a text that no blank divides."""
        if self.special_hint not in piece:
            return self._plain(piece)
        found = []
        for k, part in enumerate(self.specials.split(piece)):
            if k % 2:
                found.append((array("I", [self.special[part]]).tobytes(), part + " "))
            elif part:
                found.append(self._plain(part))
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])

    def encode(self, text):
        """Ids of a whole text (little-endian unsigned 32-bit bytes) and the text they decode to."""
        found = [self._piece(piece) for piece in text.split()]
        return b"".join([f[0] for f in found]), "".join([f[1] for f in found])[:-1]

    def encode_column(self, texts):
        """For an Arrow array of texts: per chunk of rows ids, id bounds, decoded bytes and their bounds.

        White space divides words under every rule, so the parts between it are encoded one by one,
        and a part that was met before is looked up. Decoded rows keep the blank after the last symbol.
        """
        for _, _, data, offsets in wordscan.chunks(texts, wordscan.CHUNK_BYTES // 4):
            starts, ends, rows, keys = wordscan.words(data, offsets, wordscan.SPACED, fold=wordscan.AS_IS)

            def encode(at):
                raw = data.tobytes()
                got = [self._piece(raw[s:e].decode("utf-8")) for s, e in zip(starts[at].tolist(), ends[at].tolist())]
                ids, texts = [g[0] for g in got], [g[1].encode("utf-8") for g in got]
                return (
                    (np.frombuffer(b"".join(ids), dtype="<u4"), [len(i) // 4 for i in ids]),
                    (np.frombuffer(b"".join(texts), dtype=np.uint8), [len(t) for t in texts]),
                )

            begins, lengths = self.pieces.look(keys, encode)
            bounds = wordscan.row_bounds(rows, len(offsets) - 1)
            out = []
            for k in range(2):
                total = np.concatenate([[0], np.cumsum(lengths[k])])
                out += [gather(self.pieces.values[k], begins[k], lengths[k]), total[bounds]]
            yield out

    def decode(self, ids):
        """Text of ids; ids that the vocabulary does not have are left out."""
        names, n = self.names, len(self.names)
        return " ".join([names[i] for i in ids if i < n and names[i] is not None])


_loaded = worker_cache()


def _loader(shared, key):
    """The encoder of this worker, built once from the broadcast file."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(shared.value)
    return _loaded[key]


def encode_documents(df, path, id_col="doc_id", text_col="text", tokens=True):
    """Per row doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``tokens``, ids and decoded text."""
    spark = df.sparkSession
    python_ready(spark)
    raw = read_file(path)
    shared, key = spark.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if tokens:
        schema += ", ids array<int>, decoded string"

    def encode(batches):
        bpe = _loader(shared, key)
        trim()
        for batch in batches:
            counts, ids_sha, text_sha, all_ids, texts = [], [], [], [], []
            for ids, id_bounds, decoded, text_bounds in bpe.encode_column(batch.column("text")):
                raw_ids, raw_text = memoryview(ids).cast("B"), memoryview(decoded)
                for lo, hi in zip(id_bounds[:-1].tolist(), id_bounds[1:].tolist()):
                    counts.append(hi - lo)
                    ids_sha.append(hashlib.sha256(raw_ids[4 * lo : 4 * hi]).hexdigest())
                    if tokens:
                        all_ids.append(ids[lo:hi].astype(np.int32))
                for lo, hi in zip(text_bounds[:-1].tolist(), text_bounds[1:].tolist()):
                    hi = max(lo, hi - 1)  # without the blank after the last symbol
                    text_sha.append(hashlib.sha256(raw_text[lo:hi]).hexdigest())
                    if tokens:
                        texts.append(raw_text[lo:hi].tobytes().decode("utf-8"))
            arrays = [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.array(ids_sha, pa.string()),
                pa.array(text_sha, pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if tokens:
                arrays += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            del all_ids, texts, arrays
            trim()  # workers are many and wait with what they hold

    return rows.mapInArrow(encode, schema)
