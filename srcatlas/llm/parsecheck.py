"""Problem 4: source files that do not parse.

Bodies are lexed into rows; a row holds a body's distinct adjacent token pairs,
its bracket residues in blocks and its statement faults.  The pairs are
anti-joined against the pairs that the language's grammar permits
(``grammars.adjacent``); nesting is decided by reducing the blocks in order
(running depth over a window, kinds by an ordered fold).  Statement productions are tested level by level of brackets, from the
innermost groups out: every window of three successive symbols of a level, a reduced group being one, must be one that
the grammar's productions have (``grammars.windows``).  A body is valid if all its
pairs are permissible, its nesting closes and no statement fault was found.

Each distinct (body, language) is lexed once, however many files point to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import write_stage
from .common import HOT, current_files, family, hot_keys, join_bodies, join_split
from .grammars import SOURCES

_LEXED = T.StructType(
    [
        T.StructField("revision", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.IntegerType())),
        T.StructField("blocks", T.ArrayType(T.StringType())),
        T.StructField("faults", T.IntegerType()),
    ]
)


@cache
def _windows() -> dict[str, bytes]:
    """Permissible windows of all grammars as bits, under 2 MB: fixed by the grammars and not by the data."""
    from .lexcheck import packed_windows

    return {f: packed_windows(f) for f in SOURCES}


def lex(bodies: DataFrame) -> DataFrame:
    """(revision, families array, bytes) -> one row of lexical facts per revision and family."""
    bits = _windows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .lexcheck import check

        for batch in batches:
            revisions, families, bodies = (batch.column(batch.schema.get_field_index(c)) for c in ("revision", "families", "bytes"))
            out: list[list] = [[], [], [], [], []]
            for rev, fams, body in zip(revisions.to_pylist(), families.to_pylist(), bodies):
                data = body.as_py()
                for fam in fams:
                    pairs, blocks, faults = check(fam, data, bits[fam])
                    for col, x in zip(out, (rev, fam, pairs, blocks, faults)):
                        col.append(x)
            kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=_LEXED.names)

    return bodies.select("revision", "families", "bytes").mapInArrow(run, _LEXED)


def permissible_pairs(spark: SparkSession) -> DataFrame:
    """(family, pair) of all grammars: some 30,000 rows, fixed by the grammars and not by the data."""
    from .lexcheck import permissible

    rows = [(f, c) for f in SOURCES for c in sorted(permissible(f))]
    return spark.createDataFrame(rows, "family string, pair int")


def _fold(blocks: Column) -> Column:
    """Openers left after all blocks in order, or '!' where a closer met another opener or none."""

    def step(acc: Column, b: Column) -> Column:
        closers = F.regexp_extract(b, r"^[)\]}>u]*", 0)
        openers = F.substr(b, F.length(closers) + 1)
        n, have = F.length(closers), F.length(acc)
        top = F.when(n > 0, F.reverse(F.translate(F.substr(acc, F.greatest(have - n + 1, F.lit(1))), "([{<r", ")]}>u"))).otherwise(F.lit(""))
        sound = (have >= n) & (top == closers) & ~openers.rlike(r"[)\]}>u]")
        return F.when(acc.startswith("!"), acc).when(sound, F.concat(F.substr(acc, F.lit(1), have - n), openers)).otherwise(F.lit("!"))

    return F.aggregate(blocks, F.lit(""), step)


def verdicts(lexed: DataFrame) -> DataFrame:
    """(revision, family, bad_pairs, nesting_fault, fault_block, statement_faults, valid) per lexed row."""
    spark = lexed.sparkSession
    seen = lexed.select("revision", "family", F.explode("pairs").alias("pair"))
    bad = seen.join(F.broadcast(permissible_pairs(spark)), ["family", "pair"], "left_anti").groupBy("revision", "family").agg(F.count("*").alias("bad_pairs"))
    # nesting: only bodies with something left over in some block need the ordered reduction
    left = lexed.where(F.exists("blocks", lambda b: b != "")).select("revision", "family", F.posexplode("blocks").alias("block", "residue"))
    w = Window.partitionBy("revision", "family").orderBy("block")
    closers = F.length(F.regexp_replace("residue", r"[(\[{<r]", ""))
    running = left.withColumn("low", F.coalesce(F.sum(F.length("residue") - 2 * closers).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - closers)
    ordered = running.groupBy("revision", "family").agg(
        F.array_sort(F.collect_list(F.struct("block", "residue"))).alias("b"), F.min(F.when(F.col("low") < 0, F.col("block"))).alias("fault_block")
    )
    nest = ordered.select("revision", "family", "fault_block", (_fold(F.transform("b", lambda x: x["residue"])) != "").alias("nesting_fault")).where("nesting_fault")
    out = lexed.select("revision", "family", F.col("faults").alias("statement_faults")).join(bad, ["revision", "family"], "left").join(nest, ["revision", "family"], "left")
    out = out.withColumn("bad_pairs", F.coalesce("bad_pairs", F.lit(0))).withColumn("nesting_fault", F.coalesce("nesting_fault", F.lit(False)))
    return out.withColumn("valid", (F.col("bad_pairs") == 0) & ~F.col("nesting_fault") & (F.col("statement_faults") == 0))


def check_files(files: DataFrame, contents: DataFrame, hot_rows: int = HOT) -> DataFrame:
    """Verdict per current file with a body and a path that denotes a language.

    Columns: file_id, member, path, language (as reported), status, revision, family,
    bad_pairs, nesting_fault, fault_block, statement_faults, valid.

    Files without revision, body or known extension give no row.  Null languages and
    statuses are kept as they are; an empty body is valid.  Further columns of
    either table are ignored.  A body that more than ``hot_rows`` files point to is joined with them in parts.
    """
    now = current_files(files).withColumn("family", family(F.col("path"))).where("family IS NOT NULL AND revision IS NOT NULL")
    keys = now.groupBy("revision").agg(F.sort_array(F.collect_set("family")).alias("families"))
    # a body that stands in several rows of contents counts once; the facts are small, the bodies aren't
    lexed = write_stage(lex(join_bodies(keys, contents)), "lexed").dropDuplicates(["revision", "family"])
    found = verdicts(lexed)
    cols = ["id", "member", "path", "language", "status", "revision", "family"]
    hot = hot_keys(now.groupBy("revision", "family").agg(F.count("*").alias("n")), ["revision", "family"], "n", hot_rows)
    return join_split(now.select(*cols), found, hot, ["revision", "family"], "id").withColumnRenamed("id", "file_id")


def rates(checked: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per member and family: files, invalid, rate, reported parse errors, and the member's last reported parse failures."""
    last = coverage.where("member IS NOT NULL").groupBy("member").agg(F.max_by("parse_failures", F.struct("generation", "captured_at")).alias("reported_parse_failures"))
    per = checked.groupBy("member", "family").agg(
        F.count("*").alias("files"), F.sum((~F.col("valid")).cast("long")).alias("invalid"), F.sum(F.coalesce((F.col("status") == "parse_error").cast("long"), F.lit(0))).alias("status_parse_error")
    )
    per = per.withColumn("invalid_rate", F.round(F.col("invalid") / F.col("files"), 6))
    return per.join(last, "member", "left")
