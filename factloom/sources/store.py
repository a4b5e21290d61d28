"""A store of saved records with revisions, caps and compare-and-set commits.

Records live in a folder of versions: the data of each version is a Parquet
table, and a manifest, a small file numbered by version, names it. A commit reads
the newest version, decides every save against it, writes the next table and
creates the next manifest, which only one of several writers can do; the others
find that it exists and decide again on what won. Nothing that was saved is
lost, and a save of a record that has changed since it was read is refused.

The file system must create files exclusively (HDFS does). Readers see whole
versions only; data of commits that lost is never named.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.fold import folded

#: Bytes of a scope's records, keys included, and their number.
MAX_BYTES, MAX_RECORDS = 2_097_152, 50
RECORDS = "scope string, key string, value string, generated_at timestamp, expires_at timestamp, revision long"


class Changed(RuntimeError):
    """Another commit came first, again and again."""


def utf16_bytes(*parts: Column) -> Column:
    """Bytes of strings in UTF-16, as a browser counts them."""
    wide = F.regexp_replace(F.concat(*parts), r"[\x{10000}-\x{10FFFF}]", "xx")
    return (2 * F.length(wide)).cast("long")


def decided(records: DataFrame, saves: DataFrame, *, most_bytes: int = MAX_BYTES, most_records: int = MAX_RECORDS) -> DataFrame:
    """``saves(scope, ord, key, value, generated_at, expires_at, expected)`` with ``outcome`` and the ``revision`` after it.

    In order within a scope: ``changed`` if the record's revision is not ``expected`` (0: there is none) or its dates differ,
    ``full`` if a new record is one too many or the scope would be too large, else ``saved``. Nulls in ``expected`` count as
    0; records and saves without a key are refused as ``changed``. A fold: only sizes and dates go through it."""
    columns = ["scope", "key", F.col("generated_at"), F.col("expires_at"), F.coalesce(utf16_bytes(F.col("key"), F.coalesce("value", F.lit(""))), F.lit(0)).alias("_size")]
    stamp = lambda c: F.unix_micros(F.col(c))
    has = records.select(*columns, F.lit(None).cast("long").alias("ord"), F.col("revision").alias("_revision"))
    asks = saves.select(*columns, "ord", F.coalesce("expected", F.lit(0)).cast("long").alias("_revision"))
    rows = has.unionByName(asks).withColumns({"_generated": stamp("generated_at"), "_expires": stamp("expires_at")}).drop("generated_at", "expires_at")

    def start():
        held: dict[str, tuple[int, int, int | None, int | None]] = {}
        total = 0

        def step(key, ord_, size, revision, generated, expires):
            nonlocal total
            if ord_ is None:
                held[key] = (revision, size, generated, expires)
                total += size
                return None
            now = held.get(key)
            if key is None or revision != (now[0] if now else 0) or (now and now[2:] != (generated, expires)):
                return "changed", now[0] if now else 0
            own = total - (now[1] if now else 0) + size
            if (now is None and len(held) >= most_records) or own > most_bytes:
                return "full", now[0] if now else 0
            held[key], total = (revision + 1, size, generated, expires), own
            return "saved", revision + 1

        return step

    made = folded(rows, ["scope"], [F.col("ord").asc_nulls_first(), F.col("key")], ["key", "ord", "_size", "_revision", "_generated", "_expires"], "outcome string, revision long", start)
    return saves.join(made.select("scope", "ord", "outcome", "revision"), ["scope", "ord"])


class Versions:
    """Versions of one table under ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), T._parse_datatype_string(schema)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))

    def version(self) -> int:
        """The newest version; 0 if nothing was committed."""
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/manifest")))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def records(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        named = self.spark.read.text(f"{self.folder}/manifest/{version:020d}").first()[0]
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{named}")

    def publish(self, records: DataFrame, after: int) -> bool:
        """Writes ``records`` as the version ``after`` + 1; false if that is there already."""
        name = uuid.uuid4().hex
        records.select(*self.schema.names).write.parquet(f"{self.folder}/data/{name}")
        try:
            out = self._fs.create(self._path(f"{self.folder}/manifest/{after + 1:020d}"), False)
        except Exception as refused:
            if "exist" not in str(refused).lower():
                raise
            self._fs.delete(self._path(f"{self.folder}/data/{name}"), True)
            return False
        out.write(bytearray(name.encode()))
        out.close()
        return True


class Store(Versions):
    """Saved records."""

    def __init__(self, spark: SparkSession, folder: str, *, most_bytes: int = MAX_BYTES, most_records: int = MAX_RECORDS):
        super().__init__(spark, folder, RECORDS)
        self.caps = {"most_bytes": most_bytes, "most_records": most_records}

    def attempts(self, saves: DataFrame, now: Column | datetime) -> Iterator[tuple[int, DataFrame, DataFrame]]:
        """``(version, outcomes, records after)``, decided on the newest version each time."""
        while True:
            version = self.version()
            held = self.records(version).where(F.col("expires_at") > F.lit(now))
            outcomes = decided(held, saves, **self.caps)
            stored = outcomes.where("outcome = 'saved'")
            last = stored.groupBy("scope", "key").agg(F.max("ord").alias("ord"))
            new = stored.join(last, ["scope", "key", "ord"], "left_semi")
            yield version, outcomes, held.join(last, ["scope", "key"], "left_anti").unionByName(new.select(*held.columns))

    def save(self, saves: DataFrame, now: Column | datetime, *, tries: int = 8) -> DataFrame:
        """Commits ``saves`` and gives their outcomes. Records that have expired by ``now`` go first; no valid one is ever removed."""
        for _, (version, outcomes, after) in zip(range(tries), self.attempts(saves, now)):
            kept = f"{self.folder}/outcomes/{uuid.uuid4().hex}"
            outcomes.write.parquet(kept)  # decided once; the commit can only be of this decision
            if self.publish(after, version):
                return self.spark.read.schema(outcomes.schema).parquet(kept)
        raise Changed(f"{tries} commits lost to others")

    def listed(self, scope: str, most: int = MAX_RECORDS) -> DataFrame:
        """The newest records of a scope."""
        return self.records().where(F.col("scope") == scope).orderBy(F.desc("generated_at"), "key").limit(most)
