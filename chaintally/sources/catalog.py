"""Where reports get their tables from, and where finished layers are written."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from chaintally import schemas
from chaintally.functions.columns import hex_address
from chaintally.operators.flows import BROADCAST_ROWS
from chaintally.sources.layers import LayerStore


def normalise(df, name):
    """Bring address and hash columns to lowercase ``0x`` text.

    Done once when a table is ingested: a filter on a stored lowercase column reaches the
    Parquet scan, a filter on ``lower(column)`` does not.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for column in schemas.ADDRESS_COLUMNS.get(name, ()):
        if isinstance(kinds.get(column), T.BinaryType):
            df = df.withColumn(column, hex_address(F.col(column)))
        elif column in kinds:
            df = df.withColumn(column, F.lower(F.col(column)))
    return df


def read_table(spark, root, name, normalised=True):
    """Scan one source table with its declared columns.

    Amounts may be stored as text because they can be 256 bits wide, and stay as they are
    stored. Item ids become text.
    """
    df = schemas.require_columns(spark.read.parquet(f"{root}/{name}"), schemas.SOURCES[name], name)
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def stored(f):
        named = f.name in ("tokenId", "id", "ids", "token_id") and kinds[f.name] != f.dataType
        return F.col(f.name).cast(f.dataType).alias(f.name) if named else F.col(f.name)

    when = [c for c in (schemas.EVENT_TIME.get(name),) if c in kinds and c not in schemas.SOURCES[name].names]
    df = df.select(*[stored(f) for f in schemas.SOURCES[name].fields], *when)
    return df if normalised else normalise(df, name)


def require_utc(spark):
    """Days are calendar days of the chain, so zoned timestamps need a session in UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone.upper() not in ("UTC", "ETC/UTC", "GMT", "ETC/GMT", "Z", "UCT", "ZULU", "+00:00", "UTC+00:00"):
        raise ValueError(f"the session's time zone is {zone}; set spark.sql.session.timeZone to UTC")


@dataclass
class Sources:
    """The source tables of a run plus the day the run looks at.

    ``tables`` maps a source name to a DataFrame, or to a function returning one so that
    unused tables are never resolved. Every report ends at ``as_of``.
    """

    tables: dict
    as_of: dt.date
    chain: str = "ethereum"
    #: Stored layers that reports read in place of the raw events: frames by (layer, contract), or a LayerStore.
    layers: dict | LayerStore = field(default_factory=dict)
    #: Zone indexes of stored ledgers by source name; they answer whether a contract occurs.
    zones: dict = field(default_factory=dict)
    #: Address sets up to this many rows are sent to every task, larger ones as a filter of bounded size.
    broadcast_rows: int = BROADCAST_ROWS
    _seen: dict = field(default_factory=dict, repr=False)

    @classmethod
    def from_parquet(cls, spark, root, as_of, chain="ethereum", normalised=True):
        def opener(name):
            return lambda: read_table(spark, root, name, normalised)

        return cls({name: opener(name) for name in schemas.SOURCES}, as_of, chain)

    def table(self, name):
        if name not in self._seen:
            entry = self.tables[name]
            df = entry if isinstance(entry, DataFrame) else entry()
            schemas.require_columns(df, schemas.SOURCES[name], name)
            if "blockchain" in df.columns:
                df = df.filter(F.col("blockchain") == self.chain)
            when = schemas.EVENT_TIME.get(name)
            if when in df.columns:
                if isinstance(df.schema[when].dataType, T.TimestampType):
                    require_utc(df.sparkSession)
                df = df.filter(F.col(when) < F.lit(self.as_of + dt.timedelta(days=1)))
            self._seen[name] = df
        return self._seen[name]

    def view(self, name, contract, tables, build):
        """A stored view of a contract, written by ``build()`` if a store lacks it; None where no layer holds it."""
        if isinstance(self.layers, LayerStore):
            return self.layers.resolve(self, name, contract, tables, build)
        return self.layers.get((name, contract))

    @property
    def today(self):
        return F.lit(self.as_of).cast("date")

    def register_views(self, spark, names=None):
        """Offer the tables to ``spark.sql`` users under their source names."""
        for name in names or self.tables:
            self.table(name).createOrReplaceTempView(name)


def write_layer(df, path, partition_by=("date",), mode="overwrite", cluster_by=None):
    """Store a finished layer as Parquet, split by day.

    Rows are dealt by ranges of (day, cluster column, hash of the row): a heavy day or value is
    split, light ones share a task, and there are about as many files as days and tasks together.
    Inside its files the cluster column is sorted, so row-group statistics prune lookups by it.
    Overwriting replaces only the days that ``df`` holds.
    """
    by = [c for c in partition_by if c in df.columns]
    cluster = cluster_by or next((c for c in df.columns if c not in by), None)
    order = [*by, *([cluster] if cluster else [])]
    if order:
        hashed = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        df = df.repartitionByRange(*order, F.xxhash64(*hashed)).sortWithinPartitions(*order)
    writer = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)
