"""Problem 6 on the commits table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return H.commit_hierarchy(table(spark, d, "commits"), with_path=False).where("cyclic").select("oid")


def p6_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Path as the oids from the root, joined by '/'."""
    return H.commit_hierarchy(table(spark, d, "commits")).select("oid", "root", "depth", F.array_join("path", "/").alias("path"), "cyclic")


def p6_subtrees(spark: SparkSession, d: str) -> DataFrame:
    return H.commit_subtrees(table(spark, d, "commits"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every commit: the rows of its root with a place above its own and up to its last."""
    return H.commit_descendants(table(spark, d, "commits"))


QUERIES = {"p6_found": p6_found, "p6_hierarchy": p6_hierarchy, "p6_subtrees": p6_subtrees, "p6_descendants": p6_descendants}

_CURRENT = r"""
WITH RECURSIVE raw AS (SELECT oid, regexp_replace(lower(arg_max(coalesce(parent, ''), observed_at)), '\s', '', 'g') AS p FROM commits WHERE oid IS NOT NULL GROUP BY oid),
cur AS (SELECT r.oid, q.oid AS parent FROM raw r LEFT JOIN raw q ON q.oid = r.p AND r.p <> '' AND trim(r.p, '0') <> ''),
down AS (
  SELECT oid, oid AS root, CAST(0 AS BIGINT) AS depth, oid AS path FROM cur WHERE parent IS NULL
  UNION ALL
  SELECT c.oid, d.root, d.depth + 1, d.path || '/' || c.oid FROM cur c JOIN down d ON c.parent = d.oid)
"""
SQL = {
    "p6_found": _CURRENT + "SELECT oid FROM cur WHERE oid NOT IN (SELECT oid FROM down)",
    "p6_hierarchy": _CURRENT + "SELECT c.oid, d.root, d.depth, d.path, d.oid IS NULL AS cyclic FROM cur c LEFT JOIN down d ON c.oid = d.oid",
    "p6_subtrees": _CURRENT
    + """, up AS (SELECT oid, unnest(string_split(path, '/')) AS ancestor, depth, unnest(range(depth + 1)) AS place FROM down)
SELECT ancestor AS oid, count(*) - 1 AS descendants, CAST(max(depth - place) AS BIGINT) AS height FROM up GROUP BY ancestor""",
    # '/' is below every hexadecimal digit, so paths sort in pre-order
    "p6_descendants": _CURRENT
    + """, n AS (SELECT oid, root, path, row_number() OVER (PARTITION BY root ORDER BY path) - 1 AS place FROM down),
up AS (SELECT unnest(string_split(path, '/')) AS ancestor FROM down), c AS (SELECT ancestor, count(*) - 1 AS n FROM up GROUP BY ancestor)
SELECT n.oid, root, place, place + c.n AS last FROM n JOIN c ON c.ancestor = n.oid""",
}
