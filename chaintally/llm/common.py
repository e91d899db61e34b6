"""What the text operators share: reading tables, Arrow functions, slices of long texts."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F


def travels(name):
    """Send the functions of this module by value, so that executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


travels(__name__)

#: Words are looked for in slices of about this many bytes of a long text.
SLICE = 1 << 22
#: Bytes of texts to an Arrow batch.
TEXTS = 4_000_000


def slices(data: bytes, cut: re.Pattern, size: int = SLICE):
    """Consecutive (offset, bytes) slices of ``data`` that end after a match of ``cut``."""
    begin = 0
    while len(data) - begin > size:
        found = cut.search(data, begin + size)
        end = found.end() if found else len(data)
        yield begin, data[begin:end]
        begin = end
    if begin < len(data):
        yield begin, data[begin:] if begin else data


def as_bytes(column="text"):
    """The UTF-8 bytes of a text column; NULL as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def struct_udf(make, ddl, schema: pa.Schema):
    """An Arrow function from one column to a struct.

    ``make()`` runs once per task and returns a function from one value to a tuple of fields.
    """

    def run(batches):
        work = make()
        for batch in batches:
            rows = [work(value) for value in batch.to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], fields=list(schema))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ddl)


@contextmanager
def short_batches(spark, size=TEXTS):
    """Jobs run inside send texts to Python by ``size`` bytes; 10,000 texts at once would be held in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def read(spark, root, name):
    return spark.read.parquet(f"{root}/{name}.parquet")
