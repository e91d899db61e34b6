"""A zone index of a layer: per file the range of a column and a small bitmap of its values."""

from __future__ import annotations

from pyspark.sql import functions as F

from chaintally.sources.layers import rows_of

#: Values are hashed to so many bits per file.
BITS = 32_768
ZONES = "file string, least string, most string, bits binary"


class ZoneIndex:
    """Says whether a layer holds a value, from the few files that can hold it.

    The index is a table of one row per file beside the layer. Files that were added since are
    indexed before the next answer, and rows of files that are gone are passed over, so an
    answer is always that of the layer as it is. A layer stored in the order of the column
    (``write_layer(cluster_by=...)``) has a value in neighbouring files, and a rare one in one or two.
    """

    def __init__(self, spark, layer, column="contract_address", path=None):
        self.spark, self.layer, self.column = spark, layer, column
        self.path = path or f"{layer.rstrip('/')}.zones"
        self.opened = 0

    def _spot(self, value):
        return F.pmod(F.xxhash64(value), F.lit(BITS))

    def refresh(self):
        """Index the files that the index does not know; returns the layer's files."""
        files = set(self.spark.read.parquet(self.layer).inputFiles())
        known = {r["file"] for r in rows_of(self.spark, self.path, "file string")}
        new = sorted(files - known)
        if new:
            rows = self.spark.read.parquet(*new).select(F.input_file_name().alias("file"), F.col(self.column).alias("v"))
            # distinct first: the range of a text sorts all rows of a task, here one per file and value
            rows.distinct().groupBy("file").agg(
                F.min("v").alias("least"), F.max("v").alias("most"),
                F.bitmap_construct_agg(self._spot("v")).alias("bits")).write.mode("append").parquet(self.path)
        return files

    def candidates(self, value):
        """The files that can hold a value."""
        files, spot = self.refresh(), self._spot(F.lit(value))
        byte = F.conv(F.hex(F.substring("bits", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, (spot % 8).cast("int")).bitwiseAND(F.lit(1))
        rows = self.spark.read.schema(ZONES).parquet(self.path).filter(
            (F.col("least") <= value) & (F.col("most") >= value) & (bit == 1))
        return sorted({r["file"] for r in rows.select("file").collect()} & files)

    def holds(self, value):
        """Whether a row has the value; candidates are opened two at a time, then four, until it is found."""
        files, at, size, self.opened = self.candidates(value), 0, 2, 0
        while at < len(files):
            chunk = files[at:at + size]
            self.opened += len(chunk)
            if self.spark.read.parquet(*chunk).filter(F.col(self.column) == value).select(self.column).head(1):
                return True
            at, size = at + size, 2 * size
        return False
