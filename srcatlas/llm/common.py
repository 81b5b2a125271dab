"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexers import EXTENSIONS


def current_files(files: DataFrame) -> DataFrame:
    """One row per ``id``: the one with the highest ``generation`` (null lowest; ties are exact copies).

    A partial aggregation, so many repeated rows of one id cost no skew.
    """
    cols = [c for c in ("member", "path", "revision", "language", "status", "bytes") if c in files.columns]
    order = F.struct(F.coalesce("generation", F.lit(-1)), F.coalesce("revision", F.lit("")), F.coalesce("path", F.lit("")))
    best = files.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*cols, "generation"), order).alias("r"))
    return best.select("id", "r.*")


def family(path: Column, extensions: dict[str, str] = EXTENSIONS) -> Column:
    """Language family that a path's extension denotes, null where it denotes none."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    by: dict[str, list[str]] = {}
    for e, f in extensions.items():
        by.setdefault(f, []).append(e)
    out = None
    for f, es in by.items():
        out = F.when(ext.isin(es), f) if out is None else out.when(ext.isin(es), f)
    return out


def join_bodies(keys: DataFrame, contents: DataFrame) -> DataFrame:
    """Bodies of the keys' revisions.  The hash table is built of the keys, so the bodies are never sorted;
    each body is shuffled once, whatever the number of files that point to it."""
    bodies = contents.select("revision", "bytes").where(F.col("revision").isNotNull() & F.col("bytes").isNotNull())
    return bodies.join(keys.hint("shuffle_hash"), "revision")


#: rows of one key that one task of a join may get
HOT = 200_000


def hot_keys(counted: DataFrame, keys: list[str], rows: str, limit: int = HOT) -> DataFrame:
    """(keys, salts) of the keys with more than ``limit`` rows: at most one for every ``limit`` rows of the table, small enough to broadcast."""
    return counted.where(F.col(rows) > limit).select(*keys, F.ceil(F.col(rows) / limit).cast("int").alias("salts"))


def join_split(many: DataFrame, one: DataFrame, hot: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has one row a key; hot keys are cut in ``salts`` parts by a hash of ``by``, with a copy of the one row for each."""
    hot = F.broadcast(hot)
    left = many.join(hot, keys, "left").withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64(by), F.col("salts")).cast("int")).otherwise(0)).drop("salts")
    right = one.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop("salt")
