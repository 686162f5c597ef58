"""Bloom filters over a column of 64-bit hashes, built by Spark and of bounded size.

Tasks turn their hashes into bit positions, combine them (each bit counts at most twice), and send
blocks of positions; one task a segment merges them. Only the finished bitmap, at most
``MAX_BITS / 8`` bytes, reaches the driver and is broadcast. A filter that is too small for its
hashes lets more rows through and never loses one: every user decides exactly afterwards.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from troughline.llm.base import python_ready
from troughline.llm.wordscan import mix

#: The largest filter: 2**28 bits are 32 MB in the driver and in each worker.
MAX_BITS = 1 << 28
SEGMENT_BITS = 1 << 21
PROBES = 2
#: Positions that a task holds before it sends them on; joining and counting them takes some 60 bytes each.
HELD = 1_000_000


def positions(hashes, bits, probes):
    """Bit positions of the hashes, an array for each probe."""
    hashes = np.asarray(hashes).astype(np.uint64)
    for probe in range(probes):
        yield (mix(hashes + np.uint64(0x1000003 * (probe + 1))) & np.uint64(bits - 1)).astype(np.int64)


class BitFilter:
    """Finished filter; ``has`` is true for every hash that was put in (or was, twice)."""

    def __init__(self, bits, bitmap, probes):
        self.bits, self.bitmap, self.probes = bits, bitmap, probes

    def has(self, hashes):
        if len(hashes) == 0:
            return np.zeros(0, dtype=bool)
        found = np.ones(len(hashes), dtype=bool)
        for row in positions(hashes, self.bits, self.probes):
            found &= (self.bitmap[row >> 3] >> (row & 7).astype(np.uint8)) & 1 == 1
        return found


def bits_for(rows, bits_per_row=16):
    bits = SEGMENT_BITS
    while bits < rows * bits_per_row and bits < MAX_BITS:
        bits *= 2
    return bits


def column_hashes(batch):
    """The hashes of a batch whose first column holds them."""
    return batch.column(0).to_numpy(zero_copy_only=False)


def build(df, rows, twice=False, bits_per_row=16, probes=PROBES, hashes=column_hashes):
    """Broadcast a filter of the hashes of ``df`` (with ``twice``: of those seen at least twice).

    ``hashes`` takes them from an Arrow batch of ``df``; ``rows`` is their number, for the filter's size.
    Returns a Spark broadcast.
    """
    spark = df.sparkSession
    python_ready(spark)
    bits = bits_for(rows, bits_per_row)
    schema = pa.schema([("segment", pa.int32()), ("times", pa.int32()), ("wide", pa.bool_()), ("steps", pa.binary())])

    def blocks(once, again):
        found, counts = np.unique(np.concatenate(once), return_counts=True)
        if again:
            counts[np.searchsorted(found, np.concatenate(again))] = 2
        out = []
        for times in (1, 2) if twice else (1,):
            chosen = found if times == 1 else found[counts > 1]
            segments = chosen // SEGMENT_BITS
            starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]]) if len(chosen) else []
            for lo, hi in zip(starts, [*starts[1:], len(chosen)]):
                steps = np.diff(chosen[lo:hi] % SEGMENT_BITS, prepend=0)
                wide = bool(steps.max() > 0xFFFF)
                packed = steps.astype(np.uint32 if wide else np.uint16).tobytes()
                out.append((int(segments[lo]), times, wide, packed))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def mark(batches):
        once, again, held = [], [], 0
        for batch in batches:
            values = hashes(batch)
            if not len(values):
                continue
            for probe in positions(values, bits, probes):
                found, counts = np.unique(probe, return_counts=True)
                once.append(found)
                again.append(found[counts > 1])
                held += len(found)
            if held > HELD:
                yield blocks(once, again)
                once, again, held = [], [], 0
        if once:
            yield blocks(once, again)

    def merge(batches):
        """Rows come sorted by segment; one segment is held at a time."""
        current, seen = None, np.zeros(SEGMENT_BITS, dtype=np.uint8)

        def finished():
            bitmap = np.packbits(seen >= (2 if twice else 1), bitorder="little").tobytes()
            return pa.RecordBatch.from_pydict({"segment": pa.array([current], pa.int32()), "bitmap": [bitmap]})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("segment", "wide", "steps"))
            for segment, wide, steps in zip(*columns):
                if segment != current:
                    if current is not None:
                        yield finished()
                    current = segment
                    seen[:] = 0
                at = np.cumsum(np.frombuffer(steps, dtype=np.uint32 if wide else np.uint16), dtype=np.int64)
                seen[at] = np.minimum(seen[at] + 1, 2)
        if current is not None:
            yield finished()

    marked = df.mapInArrow(mark, "segment int, times int, wide boolean, steps binary")
    merged = (
        marked.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bitmap binary")
    )
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    size = SEGMENT_BITS // 8
    # all segments in one job: an iterator would run one for each shuffle partition
    for row in merged.collect():
        bitmap[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.bitmap, dtype=np.uint8)
    return spark.sparkContext.broadcast(BitFilter(bits, bitmap, probes))


def without_keys(df, key, losers):
    """The rows of ``df`` whose ``key`` (a struct column) is not in ``losers`` (a table of a ``key`` column).

    A row that the filter of the losers does not know passes straight through; only the others are shuffled.
    """
    loser = "loser"
    while loser in df.columns:
        loser += "_"
    losers = losers.select(F.col("key").alias(loser)).distinct()
    known = build(losers.select(F.xxhash64(loser)), losers.count())

    @F.pandas_udf(BooleanType())
    def listed(hashes: pd.Series) -> pd.Series:
        return pd.Series(known.value.has(hashes.to_numpy().astype(np.int64)))

    may = listed(F.xxhash64(key))
    doubtful = df.where(may).join(losers, key.eqNullSafe(F.col(loser)), "left_anti")
    return df.where(~may).unionByName(doubtful)
