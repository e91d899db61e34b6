"""Stored views: each is computed once per contract, day and version of its inputs, and read by every report."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException

MANIFEST = "view string, contract string, as_of date, version string, path string"


class StaleLayer(RuntimeError):
    """A stored view does not fit the day or the inputs that are asked for."""


def rows_of(spark, path, schema):
    """The rows of a small table that other tables are found by; none if nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def add_row(spark, path, schema, row):
    """Append one row; what it names counts from then on, and not before."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def version_of(src, tables):
    """Names the state of source tables: their files, or their plan where they have none."""
    parts = []
    for name in sorted(tables):
        df = src.table(name)
        files = df.inputFiles()
        parts.append(f"{name}:{src.chain}:" + ("|".join(sorted(files)) if files else str(df.semanticHash())))
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class LayerStore:
    """A folder of views, given to ``Sources(layers=...)``.

    A report asks for a view; the first one writes it, all later ones, also of other sessions,
    read it. Views are keyed by name, contract, last day and the version of the source tables,
    so a view of other inputs is never served: it is built anew, or refused by ``frozen`` stores.
    A job that dies while it writes leaves no row in the manifest, and its files are not read.
    """

    def __init__(self, spark, path, frozen=False):
        self.spark, self.path, self.frozen = spark, path, frozen
        self._known = {}

    def resolve(self, src, view, contract, tables, build):
        key = (view, contract, src.as_of, version_of(src, tables))
        if key not in self._known:
            for r in rows_of(self.spark, f"{self.path}/manifest", MANIFEST):
                self._known[tuple(r)[:4]] = r["path"]
        if key not in self._known:
            if self.frozen:
                there = sorted({str(k[2]) for k in self._known if k[:2] == key[:2]})
                raise StaleLayer(f"{view} of {contract} up to {src.as_of} is not stored for these inputs; days stored: {there}")
            path = f"{self.path}/{view}-{uuid.uuid4().hex[:12]}"
            build().write.parquet(path)
            add_row(self.spark, f"{self.path}/manifest", MANIFEST, (*key, path))
            self._known[key] = path
        return self.spark.read.parquet(self._known[key])
