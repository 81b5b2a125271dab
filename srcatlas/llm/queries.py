"""Queries and oracle SQL of this subpackage, by the names the entry registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, table, write_stage
from . import handwritten, leakage, mixing, neighbours, parsecheck, readability, secrets, splitting


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(table(spark, d, "files"), table(spark, d, "contents")).where("NOT hand_written").select("file_id")


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    """Files by member and origin; a file of several origins counts in each."""
    c = handwritten.classify(table(spark, d, "files"), table(spark, d, "contents"))
    n = lambda x: F.sum(F.col(x).cast("long")).alias(x)
    return c.groupBy("member").agg(F.count("*").alias("files"), n("generated"), n("minified"), n("vendored"), n("data"), n("hand_written"))


def p1_routes(spark: SparkSession, d: str) -> DataFrame:
    """What statements, paths, token measures and winnowed fingerprints each find, and find alone."""
    return handwritten.routes(handwritten.classify(table(spark, d, "files"), table(spark, d, "contents")))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_pieces(table(spark, d, "contents"), table(spark, d, "region_spans"), table(spark, d, "definitions"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0").select("revision")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p2_audit(spark: SparkSession, d: str) -> DataFrame:
    return splitting.audit(_pieces(spark, d), table(spark, d, "contents"))


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    return splitting.against_coverage(_pieces(spark, d), table(spark, d, "files"), table(spark, d, "coverage"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "vector_cache")).select("key_a", "key_b")


def p3_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest of every key that, read as a hexadecimal number, is divisible by 100."""
    v = table(spark, d, "vector_cache")
    # 256 mod 100 = 56 and 16**8 mod 100 = 96: the whole number's remainder from its 8-digit parts
    part = lambda i: F.conv(F.substring("key", i, 8), 16, 10).cast("long")
    rest = F.lit(0).cast("long")
    for i in (1, 9, 17, 25):
        rest = F.pmod(rest * 96 + part(i), F.lit(100))
    return neighbours.top_k(v, v.where(rest == 0).select("key")).withColumn("similarity", F.round("similarity", 5))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.check_files(table(spark, d, "files"), table(spark, d, "contents")).where("NOT valid").select("file_id")


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsecheck.rates(parsecheck.check_files(table(spark, d, "files"), table(spark, d, "contents")), table(spark, d, "coverage"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(table(spark, d, "files"), table(spark, d, "contents")).select("revision", "line_no").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that held a credential: how many, and the body with them overwritten."""
    return secrets.redacted(table(spark, d, "files"), table(spark, d, "contents")).where("credentials > 0")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items that leaked: documents that hold them and the largest share held."""
    found = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    sized = write_stage(mixing.with_tokens(table(spark, d, "documents")), "sized")
    return mixing.planned(sized, table(spark, d, "mix_targets"))[1].where("NOT reachable").select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _tempered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix whose weights the exponent alone decides: token shares to the power whose weights have the targets' entropy, without the targets' shares."""
    t = table(spark, d, "mix_targets")
    # the mix's configuration: one row a source
    shares = {r.source: r.target_share for r in t.select("source", "target_share").collect() if r.target_share}
    return mixing.mix(table(spark, d, "documents"), t.withColumn("target_share", F.lit(None).cast("double")), target_entropy=mixing.entropy(shares))


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    return _tempered(spark, d)[0]


def p8_tempered_shares(spark: SparkSession, d: str) -> DataFrame:
    return _tempered(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return readability.grades(table(spark, d, "documents"), table(spark, d, "reading_labels")).where("grade >= 4").select("doc_id")


def p9_grades(spark: SparkSession, d: str) -> DataFrame:
    return readability.grades(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Marks against grades of documents whose marks the model was not fitted on, in five folds."""
    return readability.held_out(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        p1_found, p1_origins, p1_routes, p2_found, p2_pieces, p2_audit, p2_coverage, p3_found, p3_topk, p4_found, p4_rates, p5_found, p5_redacted,
        p7_found, p7_items, p8_found, p8_mix, p8_shares, p8_tempered, p8_tempered_shares, p9_found, p9_grades, p9_heldout,
    )
    return {f.__name__: _shipped(f) for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": "SELECT revision FROM contents WHERE octet_length(bytes) > 4096",
        "p2_audit": "SELECT DISTINCT revision, octet_length(bytes) AS total_bytes, octet_length(bytes) AS covered_bytes, CAST(0 AS BIGINT) AS long_pieces, CAST(0 AS BIGINT) AS wrong_starts FROM contents WHERE octet_length(bytes) > 4096",
        "p3_found": """
            WITH cur AS (SELECT key, arg_max(vector, touched) AS v FROM vector_cache GROUP BY key),
            ok AS (SELECT key, v FROM cur WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
            u AS (SELECT key, list_transform(v, lambda x: CAST(x AS DOUBLE) / m) AS v FROM (SELECT key, v, list_max(list_transform(v, lambda x: abs(CAST(x AS DOUBLE)))) AS m FROM ok))
            SELECT a.key AS key_a, b.key AS key_b FROM u a JOIN u b ON a.key < b.key WHERE list_cosine_similarity(a.v, b.v) >= 0.9""",
    }
