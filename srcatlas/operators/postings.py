"""An inverted index of regions: one row per term and region, read by the terms of a query alone.

Rows hold the term's positions in each column, the region's length in tokens, its path, kind and language, so that
scores, phrases and filters need no other table.  Files are partitioned by a hash of the term and cut by a hash of the region, so
a term that a third of all regions have lies in many files; rows are sorted by term, and
row groups are skipped by their least and greatest term.
"""

from __future__ import annotations

import math
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN, lowered
from ..session import shared_dir, write_stage

#: constants of the published ranking function (fixed values)
K1, B = 1.2, 0.75
COLUMN_WEIGHTS = {"name": 8.0, "expanded": 2.0, "body": 1.0, "path": 0.5}
BUCKETS = 16
#: bits of a position: a region has fewer tokens
SHIFT = 28
#: written partitions may be none, so the schemas are given when they are read
ROWS = "id long, path string, kind string, language string, len int, term string, " + ", ".join(f"p_{c} array<int>, n_{c} int" for c in COLUMN_WEIGHTS) + ", bucket int"
TERMS = "term string, df long, bucket int"


def idf(n: int, df: int) -> float:
    return max(1e-6, math.log((n - df + 0.5) / (df + 0.5)))


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _places(column: str, number: int) -> Column:
    """The tokens of a column as (col, pos, term)."""
    found = F.regexp_extract_all(lowered(F.col(column)), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda x, i: F.struct(F.lit(number).cast("byte").alias("col"), i.cast("int").alias("pos"), x.alias("term")))


def _successive(places: list[Column]) -> Column:
    """Those places of the first token that the others follow, one after the other."""

    def follow(p: Column) -> Column:
        ok: Column = F.lit(True)
        for k, q in enumerate(places[1:], 1):
            ok = ok & F.array_contains(q, p + k)
        return ok

    return F.filter(places[0], follow)


def _of_column(number: int) -> Column:
    """The places of one column among ``codes``."""
    low = number << SHIFT
    return F.transform(F.filter("codes", lambda x: (x >= low) & (x < low + (1 << SHIFT))), lambda x: x - low)


@dataclass
class Postings:
    spark: SparkSession
    path: str
    n: int
    average: float
    rows: DataFrame = field(repr=False, default=None)
    terms: DataFrame = field(repr=False, default=None)

    @classmethod
    def build(cls, regions: DataFrame, path: str | None = None) -> Postings:
        """Index of regions (id, path, and any of name, expanded, body, kind, language); ids are unique.

        A null text has no terms; a region without any counts in the averages alone.  Written to ``path``, or to a
        folder of its own in the shared folder, where it stays until it is removed: build it anew when regions change.
        """
        spark = regions.sparkSession
        path = path or f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
        cols = [c for c in COLUMN_WEIGHTS if c in regions.columns]
        more = [F.col(c) if c in regions.columns else F.lit(None).cast("string").alias(c) for c in ("kind", "language")]
        words = [_places(c, k) for k, c in enumerate(cols)]
        # the texts are shuffled once, by region: their terms, several times as large, are then aggregated where they are
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        texts = regions.select("id", "path", *[c for c in ("name", "expanded", "body", "kind", "language") if c in regions.columns]).repartition(tasks, "id")
        base = texts.select("id", "path", *more, F.concat(*words).alias("words")).withColumn("len", F.size("words"))
        base.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average")).write.parquet(f"{path}/stats")
        each = base.where("len > 0").select(F.col("id").cast("long").alias("id"), "path", "kind", "language", "len", F.explode("words").alias("w"))
        # one list of places a term, the column in the bits above the position
        code = F.shiftleft(F.col("w.col").cast("int"), SHIFT) + F.col("w.pos")
        rows = each.groupBy("id", "path", "kind", "language", "len", F.col("w.term").alias("term")).agg(F.sort_array(F.collect_list(code)).alias("codes"))
        rows = rows.select("id", "path", "kind", "language", "len", "term", *[_of_column(k).alias(f"p_{c}") for k, c in enumerate(cols)])
        missing = [F.array().cast("array<int>").alias(f"p_{c}") for c in COLUMN_WEIGHTS if c not in cols]
        rows = rows.select("*", *missing).withColumns({f"n_{c}": F.size(f"p_{c}") for c in cols} | {f"n_{c}": F.lit(0) for c in COLUMN_WEIGHTS if c not in cols})
        rows = rows.withColumn("bucket", F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int"))
        # a term has one row a region, so a bucket is never much larger than its share; it is cut by region all the same
        rows = rows.repartition(tasks, "bucket", F.pmod(F.xxhash64("id"), F.lit(max(1, tasks // BUCKETS))))
        rows.sortWithinPartitions("bucket", "term", "id").write.partitionBy("bucket").parquet(f"{path}/rows")
        written = spark.read.schema(ROWS).parquet(f"{path}/rows")
        written.groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Postings:
        stats = spark.read.parquet(f"{path}/stats").first()
        return cls(spark, path, stats["n"], stats["average"] or 1.0, spark.read.schema(ROWS).parquet(f"{path}/rows"), spark.read.schema(TERMS).parquet(f"{path}/terms"))

    def lookup(self, terms: list[str], table: DataFrame | None = None) -> DataFrame:
        """The rows of some terms: their buckets' partitions, and in these what the terms' order lets through."""
        return (self.rows if table is None else table).where(F.col("bucket").isin(sorted({bucket(t) for t in terms})) & F.col("term").isin(terms))

    def counts(self, groups: list[list[str]]) -> list[int]:
        """Regions that hold each group of successive tokens."""
        single = [g[0] for g in groups if len(g) == 1]
        df = {r.term: r.df for r in self.lookup(single, self.terms).select("term", "df").collect()} if single else {}
        many = [g for g in groups if len(g) > 1]
        got = {}
        if many:
            f = self.features(many)
            got = f.agg(*[F.coalesce(F.sum((F.col(f"f{i}") > 0).cast("long")), F.lit(0)).alias(str(i)) for i in range(len(many))]).first()
        return [df.get(g[0], 0) if len(g) == 1 else got[str(many.index(g))] for g in groups]

    def features(self, groups: list[list[str]], phrase: list[str] | None = None) -> DataFrame:
        """(id, path, kind, language, len, f0, f1, ..., phrase): weighted places of each group of successive tokens, and of the phrase.

        One scan of the tokens' rows and one aggregation by region.
        """
        tokens = list(dict.fromkeys(t for g in [*groups, phrase or []] for t in g))
        spread = list(dict.fromkeys(t for g in [*groups, phrase or []] if len(g) > 1 for t in g))
        rows = self.lookup(tokens)
        at = {t: i for i, t in enumerate(tokens)}
        weighed = sum((F.col(f"n_{c}") * w for c, w in COLUMN_WEIGHTS.items()), F.lit(0.0))
        cols = [F.coalesce(F.max(F.when(F.col("term") == t, weighed)), F.lit(0.0)).alias(f"w{at[t]}") for t in tokens]
        cols += [F.coalesce(F.max(F.when(F.col("term") == t, F.col(f"p_{c}"))), F.array().cast("array<int>")).alias(f"p{at[t]}_{c}") for t in spread for c in COLUMN_WEIGHTS]
        one = rows.groupBy("id", "path", "kind", "language", "len").agg(*cols)

        def places(g: list[str]) -> Column:
            if len(g) == 1:
                return F.col(f"w{at[g[0]]}")
            total = F.lit(0.0)
            for c, w in COLUMN_WEIGHTS.items():
                total = total + F.size(_successive([F.col(f"p{at[t]}_{c}") for t in g])) * w
            return total

        out = one.select("id", "path", "kind", "language", "len", *[places(g).alias(f"f{i}") for i, g in enumerate(groups)], (places(phrase) if phrase else F.lit(0.0)).alias("phrase"))
        return out

    def paths(self, any_groups: list[list[str]], phrase: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """(path, any, all, phrase) - each the best (score, id) of the path's regions in that lane, or null - written once for all three lanes.

        Relevance takes its counts from all regions; ``where`` (on path, kind, language) only decides which may be hits.
        """
        df = self.counts(any_groups)
        f = self.features(any_groups, phrase)
        if where is not None:
            f = f.where(where)
        norm = K1 * (1 - B + B * F.col("len") / F.lit(float(self.average)))
        score = sum((F.lit(idf(self.n, d)) * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm) for i, d in enumerate(df)), F.lit(0.0))
        some: Column = F.lit(False)
        every: Column = F.lit(bool(any_groups))
        for i in range(len(any_groups)):
            some, every = some | (F.col(f"f{i}") > 0), every & (F.col(f"f{i}") > 0)
        best = lambda test, s, name: F.max(F.when(test, F.struct(s.alias("score"), (-F.col("id")).alias("id")))).alias(name)
        score = F.round(score, 6)
        got = f.groupBy("path").agg(best(some, score, "any"), best(every, score, "all"), best(F.col("phrase") > 0, F.col("phrase"), "phrase"))
        return write_stage(got, "paths")


def lane(paths: DataFrame, name: str, limit: int) -> DataFrame:
    """(id, path, score) of one lane of ``Postings.paths``, the best first."""
    return paths.where(F.col(name).isNotNull()).select((-F.col(f"{name}.id")).alias("id"), "path", F.col(f"{name}.score").alias("score")).orderBy(F.desc("score"), "path").limit(limit)
