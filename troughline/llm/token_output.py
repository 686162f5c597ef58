"""Token ids as Parquet list columns, written in document order and read selectively.

The files hold one row a document, in ascending order of id over all files: ``doc_id``, ``part`` (the
file's number in that order), ``offset`` (ids of the file's documents before this one), ``n_tokens``
and ``tokens``, a list of ids. Token lists are dictionary-encoded (a vocabulary's ids fit one
dictionary page) and positions delta-encoded; row groups and pages are of set sizes, and the page
indexes that the writer adds let a reader skip pages by ``doc_id``. A reader of ``offset`` and
``n_tokens`` never touches the token pages.

Encoding goes through the tokenizers library in the tasks. Words repeat, so a text is cut at blanks,
each part (with its blank) is encoded once by the library and remembered in a bounded table; where a
cut could change the result (runs of white space) the library gets the whole text.

Defined cases: null text is empty and has the end id alone; null ids come first; rows that share an
id are ordered by the hash of their text, and rows that repeat are written again; extra columns are
left out; no rows give no rows.
"""

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from troughline.llm import wordscan
from troughline.llm.base import python_ready, read_file, stage_path, worker_cache
from troughline.llm.piecetable import PieceTable, gather

#: Bytes of a row group, of a page, and the size that one dictionary may have.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
DICTIONARY_BYTES = 2 << 20
#: Parts of texts that a worker remembers.
REMEMBERED = 1_500_000

#: The sign that stands for a blank in byte-level vocabularies.
BLANK = "\u0120"
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[0x20] = False
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20]] = True

WRITER_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.dictionary.page.size": str(DICTIONARY_BYTES),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#offset": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


class LibraryEncoder:
    """The library's encoding of whole texts, with the encoded parts of texts remembered."""

    def __init__(self, raw):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode("utf-8"))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        # tokens that begin with a blank, as byte-level vocabularies write it
        self.begins = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocab.items() if token[0] == BLANK]] = True
        self.pieces = PieceTable([np.dtype("<u4")], REMEMBERED)

    def _each(self, texts):
        """Ids end to end, and how many each text has."""
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array([i for ids in lists for i in ids], dtype="<u4")
        return ids, np.array([len(ids) for ids in lists], dtype=np.int64)

    def _after_blank(self, pieces):
        """The same for parts that follow a blank: one text for the library, cut where a blank begins."""
        ids, _ = self._each([" " + " ".join(pieces)])
        at = np.flatnonzero(self.begins[ids])
        if len(at) != len(pieces) or at[0] != 0:
            return self._each([" " + piece for piece in pieces])
        return ids, np.diff(np.append(at, len(ids)))

    def encode_column(self, texts):
        """For an Arrow array of texts: per chunk of rows the ids end to end and how many each row has."""
        for _, _, data, offsets in wordscan.chunks(texts, 2 * wordscan.CHUNK_BYTES):
            n = len(offsets) - 1
            whole = _cut_matters(data, offsets)
            starts, ends, rows, keys = wordscan.words(data, offsets, NOT_BLANK, fold=wordscan.AS_IS)
            cut = ~whole[rows]
            starts, ends, rows, keys = starts[cut], ends[cut], rows[cut], keys[cut]
            first = starts == offsets[rows]  # no blank before
            keys = np.where(first, ~keys, keys)
            raw = data.tobytes()

            def text(lo, hi):
                return raw[lo:hi].decode("utf-8")

            def encode(at):
                ids, lengths = [], np.zeros(len(at), dtype=np.int64)
                names = [text(lo, hi) for lo, hi in zip(starts[at].tolist(), ends[at].tolist())]
                for chosen, how in ((np.flatnonzero(first[at]), self._each), (np.flatnonzero(~first[at]), self._after_blank)):
                    if len(chosen):
                        got, lengths[chosen] = how([names[i] for i in chosen.tolist()])
                        ids.append((chosen, got))
                if len(ids) == 1:
                    return ((ids[0][1], lengths),)
                # both kinds: put them back into the order of ``at``
                where, order = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), dtype="<u4")
                for chosen, got in ids:
                    sizes = lengths[chosen]
                    order[np.repeat(where[chosen] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(got))] = got
                return ((order, lengths),)

            (begins,), (lengths,) = self.pieces.look(keys, encode)
            ids = gather(self.pieces.values[0], begins, lengths)
            total = np.concatenate([[0], np.cumsum(lengths)])
            counts = np.diff(total[wordscan.row_bounds(rows, n)])
            if whole.any():
                at = np.flatnonzero(whole)
                extra, sizes = self._each([text(offsets[r], offsets[r + 1]) for r in at.tolist()])
                ids = np.insert(ids, np.repeat(np.cumsum(counts)[at], sizes), extra)
                counts[at] = sizes
            yield ids, counts


def _cut_matters(data, offsets):
    """Rows in which a blank meets other white space or ends the text: there the pattern looks across it."""
    n = len(data)
    space = WHITE[data]
    # white space beyond ASCII, as UTF-8: U+0085, U+00A0, U+1680, U+2000-200A, U+2028-9, U+202F, U+205F, U+3000
    if n > 1:
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        space[:-1] |= two
        space[1:] |= two
    if n > 2:
        a, b, c = data[:-2], data[1:-1], data[2:]
        three = (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        three |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        three |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        three |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        space[:-2] |= three
        space[2:] |= three
    blank = data == 0x20
    odd = np.zeros(n + 1, dtype=bool)
    odd[1:n] = space[1:] & space[:-1] & (blank[1:] | blank[:-1])
    edges = offsets[1:]
    odd[offsets[:-1]] = False  # neighbours in different rows
    last = edges[edges > offsets[:-1]] - 1
    odd[last] |= blank[last]
    counts = np.concatenate([[0], np.cumsum(odd[:n])])
    return counts[edges] > counts[offsets[:-1]]


_loaded = worker_cache()


def _loader(shared):
    key = zlib.crc32(shared.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = LibraryEncoder(shared.value)
    return _loaded[key]


def write_tokens(df, path, vocabulary, end_id, id_col="doc_id", text_col="text"):
    """Encode ``df`` and write its token files to ``path``."""
    spark = df.sparkSession
    python_ready(spark)
    shared = spark.sparkContext.broadcast(read_file(vocabulary))
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").drop("th")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        encoder, part, before = _loader(shared), TaskContext.get().partitionId(), 0
        for batch in batches:
            values, counts = [], []
            for ids, sizes in encoder.encode_column(batch.column("text")):
                values.append(np.insert(ids, np.cumsum(sizes), end_id))
                counts.append(sizes + 1)
            if not counts:
                continue
            counts = np.concatenate(counts)
            ends = np.cumsum(counts)
            bounds = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(counts), part, dtype=np.int32)),
                    pa.array(before + ends - counts),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(values).astype(np.int32))),
                ],
                names=["doc_id", "part", "offset", "n_tokens", "tokens"],
            )
            before += int(ends[-1])

    encoded = rows.mapInArrow(encode, f"doc_id {kind}, part int, offset long, n_tokens long, tokens array<int>")
    encoded.write.options(**WRITER_OPTIONS).parquet(path)


def _with_start(rows, counts):
    """``rows`` of the files with ``start``, the ids of all documents before; ``counts`` are those of all rows."""
    # one row a file: where its ids begin in the whole
    files = counts.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    files = files.select(F.col("part").alias("file"), (F.sum("ids").over(every) - F.col("ids")).alias("begin"))
    joined = rows.join(files, F.col("part") == F.col("file"))
    return joined.withColumn("start", F.col("begin") + F.col("offset")).drop("file", "begin")


def read_positions(spark, path):
    """doc_id, start, n_tokens, part and offset of every document; the token pages are not read."""
    rows = spark.read.parquet(path).drop("tokens")
    return _with_start(rows, rows)


def read_tokens(spark, path, where=None):
    """doc_id and tokens of the documents that ``where`` selects; pages that cannot hold one are skipped."""
    rows = spark.read.parquet(path)
    return (rows if where is None else rows.where(where)).select("doc_id", "tokens")


def token_digests(spark, path):
    """Per document doc_id, start, n_tokens and the CRC-32 of its ids, from the files."""
    rows = spark.read.parquet(path)
    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "part", "offset", "n_tokens"]

    def digest(batches):
        for batch in batches:
            tokens = batch.column("tokens")
            values = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            bounds = tokens.offsets.to_numpy()
            sums = [zlib.crc32(values[lo:hi].tobytes()) for lo, hi in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sums, pa.int64())], names=[*columns, "ids_crc32"]
            )

    # the ids stay in the task that reads them: only their digest goes on
    digests = rows.select(*columns, "tokens").mapInArrow(
        digest, f"doc_id {kind}, part int, offset long, n_tokens long, ids_crc32 long"
    )
    return _with_start(digests, rows.select("part", "n_tokens")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "part", "offset"
    )


def token_store(df, vocabulary, end_id, path=None):
    """Write the token files of ``df`` (to the shared folder unless ``path`` is given) and return their place."""
    path = path or stage_path(df.sparkSession, "tokens")
    write_tokens(df, path, vocabulary, end_id)
    return path
