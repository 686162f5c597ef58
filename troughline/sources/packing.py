"""Tables packed for the disk: chunks of consecutive rows, each column as compressed differences.

Any rows in any order come back as they were; rows of a smooth curve in the order of time take the least room. Columns
are integers, doubles, and doubles of a fixed number of digits, which are held as whole numbers below 2**53.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .shipping import ship_package

ROWS = 5000  # rows of a chunk
LIMIT = 2**53


def _order(kind, digits):
    """How often neighbours are subtracted: four times on curves, once on integers, never on other doubles."""
    return 4 if digits is not None else 0 if isinstance(kind, DoubleType) else 1


def _put(column, kind, digits):
    """The column of a chunk as bytes: whether it has nulls, then compressed the valid bits and the differences."""
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    if digits is not None:
        values = np.rint(values * 10.0**digits)
        if not (np.abs(values) < LIMIT).all():
            raise ValueError(f"a value cannot be held with {digits} digits")
    whole = values.view(np.int64) if isinstance(kind, DoubleType) and digits is None else values.astype(np.int64)
    order = _order(kind, digits)
    steps = np.diff(whole, order, prepend=np.zeros(order, dtype=np.int64)) if order else whole
    # small steps of either sign have zeros in the same bytes, which lie together
    steps = np.ascontiguousarray((steps << 1) ^ (steps >> 63)).astype("<i8", copy=False)
    planes = steps.view(np.uint8).reshape(-1, 8).T.tobytes()
    valid = np.packbits(column.is_valid().to_numpy(zero_copy_only=False)).tobytes() if column.null_count else b""
    return bytes([bool(valid)]) + pa.Codec("zstd").compress(valid + planes, asbytes=True)


def _get(packed, rows, kind, digits):
    """The Arrow array that ``_put`` took."""
    begin = -(-rows // 8) if packed[0] else 0
    raw = pa.Codec("zstd").decompress(packed[1:], begin + 8 * rows, asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=begin).reshape(8, rows)
    steps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    whole = ((steps >> np.uint64(1)) ^ (np.uint64(0) - (steps & np.uint64(1)))).view(np.int64)
    for _ in range(_order(kind, digits)):
        whole = np.cumsum(whole)
    if digits is not None:
        whole = whole / 10.0**digits
    elif isinstance(kind, DoubleType):
        whole = whole.view(np.float64)
    nulls = np.unpackbits(np.frombuffer(raw, dtype=np.uint8, count=begin), count=rows) == 0 if packed[0] else None
    return pa.array(whole, _arrow(kind), mask=nulls)


def _arrow(kind):
    return {DoubleType: pa.float64(), LongType: pa.int64(), IntegerType: pa.int32()}[type(kind)]


def packed(df, by, digits):
    """A row a chunk: the value of ``by`` its rows share, their number, and a binary column for each other column."""
    ship_package(df.sparkSession)
    fields = [(f.name, f.dataType, digits.get(f.name)) for f in df.schema if f.name != by]
    for _, kind, _ in fields:
        _arrow(kind)
    out = pa.schema([(by, pa.string()), ("_rows", pa.int32()), *[(name, pa.binary()) for name, _, _ in fields]])

    def chunks(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        for value in table[by].unique():
            mine = table.filter(pc.equal(table[by], value) if value.is_valid else pc.is_null(table[by])).combine_chunks()
            rows = [mine.slice(at, ROWS) for at in range(0, len(mine), ROWS)]
            columns = [[_put(r[name].combine_chunks(), kind, n) for r in rows] for name, kind, n in fields]
            arrays = [[value.as_py()] * len(rows), [len(r) for r in rows], *columns]
            yield pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, out)], schema=out)

    def pack(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ROWS:
                yield from chunks(held)
                held = []
        if sum(map(len, held)):
            yield from chunks(held)

    return df.mapInArrow(pack, _stored(by, [name for name, _, _ in fields]))


def _stored(by, names):
    binary = [StructField(name, BinaryType()) for name in names]
    return StructType([StructField(by, StringType()), StructField("_rows", IntegerType()), *binary])


def read(spark, path, by, schema, digits, columns, only=None):
    """The named columns, and ``by``, of the rows of ``schema`` that were stored packed; ``only`` some values of ``by``."""
    ship_package(spark)
    fields = [(f.name, f.dataType, digits.get(f.name)) for f in schema if f.name in columns and f.name != by]
    stored = spark.read.schema(_stored(by, [name for name, _, _ in fields])).parquet(path)
    if only is not None:
        stored = stored.where(F.col(by).isin(list(only)))
    out = pa.schema([(by, pa.string()), *[(name, _arrow(kind)) for name, kind, _ in fields]])

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                arrays = [_get(row[name], row["_rows"], kind, n) for name, kind, n in fields]
                names = pa.repeat(pa.scalar(row[by], pa.string()), row["_rows"])
                yield pa.RecordBatch.from_arrays([names, *arrays], schema=out)

    back = StructType([StructField(by, StringType()), *[StructField(name, kind) for name, kind, _ in fields]])
    return stored.select(by, "_rows", *[name for name, _, _ in fields]).mapInArrow(unpack, back)
