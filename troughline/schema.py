"""Fixed schemas of the exchanged tables."""

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(**columns):
    return StructType([StructField(name, kind()) for name, kind in columns.items()])


PROFILE = _table(
    ID=LongType, time=DoubleType, CRCL=DoubleType, IPRE=DoubleType, AUC=DoubleType,
    PERI=DoubleType, method=StringType,
)


CUSTOMER = _table(
    c_custkey=LongType, c_name=StringType, c_nationkey=IntegerType, c_acctbal=DoubleType,
    c_mktsegment=StringType,
)
