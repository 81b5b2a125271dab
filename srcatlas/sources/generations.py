"""Sinks and snapshots: generations of tables under a manifest, result sets with an expiry, a cache of facts."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import parse_cursor


class Warming(Exception):
    """Nothing is published yet."""


class Generations:
    """A folder of generations.  A writer fills ``gen=N`` and then replaces the manifest in one rename; a reader resolves
    the manifest once and stays with that generation."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        p = self._path(f"{self.folder}/manifest.json")
        if not self.fs.exists(p):
            return {"generation": 0, "fingerprint": None}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest.json", wholetext=True).first()[0])

    def publish(self, tables: dict[str, DataFrame], fingerprint: str | None = None) -> int:
        """Write a generation and make it the current one; the same fingerprint as the last one's writes nothing."""
        last = self.manifest()
        if fingerprint is not None and fingerprint == last.get("fingerprint"):
            return last["generation"]
        gen = last["generation"] + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.folder}/gen={gen}/{name}")
        tmp, final = self._path(f"{self.folder}/.manifest-{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifest.json")
        out = self.fs.create(tmp)
        out.write(bytearray(json.dumps({"generation": gen, "fingerprint": fingerprint, "tables": sorted(tables)}).encode()))
        out.close()
        ctx = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        opts = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        opts[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        ctx.rename(tmp, final, opts)
        return gen

    def snapshot(self) -> Snapshot:
        return Snapshot(self, self.manifest())

    def prune(self, keep: int = 2) -> None:
        """Remove all but the last ``keep`` generations."""
        gen = self.manifest()["generation"]
        for s in self.fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name.startswith("gen=") and int(name[4:]) <= gen - keep:
                self.fs.delete(s.getPath(), True)


class Snapshot:
    def __init__(self, store: Generations, manifest: dict):
        self.store, self.info = store, manifest

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        """A table of this generation; before the first one an empty frame of ``schema``, or ``Warming``."""
        if self.info["generation"] == 0:
            if schema is None:
                raise Warming(self.store.folder)
            return self.store.spark.createDataFrame([], schema)
        return self.store.spark.read.parquet(f"{self.store.folder}/gen={self.info['generation']}/{name}")


def unreferenced(contents: DataFrame, files: DataFrame) -> DataFrame:
    return contents.join(files.select("revision").where("revision IS NOT NULL").distinct(), "revision", "left_anti")


class ResultSets:
    """Result sets as Parquet with an expiry; an unknown or expired id is an error."""

    def __init__(self, spark: SparkSession, folder: str, seconds: int = 600, most: int = 10_000):
        self.spark, self.folder, self.seconds, self.most = spark, folder.rstrip("/"), seconds, most

    def save(self, hits: DataFrame, now: float | None = None) -> str:
        """Keep the first ``most`` hits by rank; returns the set's id."""
        sid = uuid.uuid4().hex[:12]
        expires = (time.time() if now is None else now) + self.seconds
        hits.orderBy("rank").limit(self.most).withColumn("expires", F.lit(expires)).write.parquet(f"{self.folder}/{sid}")
        return sid

    def load(self, sid: str, now: float | None = None) -> DataFrame:
        if not sid.isalnum():
            raise KeyError(sid)
        try:
            df = self.spark.read.parquet(f"{self.folder}/{sid}")
        except Exception as e:
            raise KeyError(sid) from e
        first = df.select("expires").limit(1).collect()
        if first and first[0][0] <= (time.time() if now is None else now):
            raise KeyError(sid)
        return df.drop("expires").orderBy("rank")


def page_of(sets: ResultSets, cursor: str, size: int, now: float | None = None) -> tuple[DataFrame, str | None]:
    """(rows of the page that a cursor SET@OFFSET names, the next page's cursor or None)."""
    sid, offset = parse_cursor(cursor)
    rows = sets.load(sid, now)
    part = rows.where((F.col("rank") > offset) & (F.col("rank") <= offset + size))
    more = not rows.where(F.col("rank") > offset + size).limit(1).isEmpty()
    return part, f"{sid}@{offset + size}" if more else None


def seed_cache(own: DataFrame, sibling: DataFrame, key: list[str]) -> DataFrame:
    """Content-keyed rows of a sibling's cache that one's own lacks, with it; publications are never copied."""
    return own.unionByName(sibling.join(own.select(*key), key, "left_anti"))


def write_json_lines(df: DataFrame, folder: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)
