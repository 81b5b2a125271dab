"""Problem 8: mixing sources to target weights.

Sizes are counted in tokens of a public tokenizer.  Weights are the given target
shares; a source without one, or all sources where the target table is empty, has a
part of what the shares leave, by the sources' token shares to an exponent that is bisected until
no source must be repeated more often than allowed.  Weights become token budgets; a
budget is realised as whole passes over the source and a part of one more,
taken along a pseudo-random permutation in blocks: whole blocks by the sums of
blocks, and one block by a running sum within it.

Scale: one map-only pass counts tokens; sums per source and per (source, block) are
partial aggregates.  The only windows are over the table of block sums and
within one block of each source, so a source that holds a third of all rows is
never gathered in one task.  The vocabulary (about 1 MB) is read by the driver and
sent to the tasks.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import write_stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the published pre-tokenisation pattern of that vocabulary (fixed value)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MAX_VOCABULARY_BYTES = 16 << 20


def with_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens): token count of every document's whole text, 0 for a null or empty one."""
    with open(vocabulary, "rb") as f:
        ranks = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than the bound for sending it to tasks")
    holder: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "enc" not in holder:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}
            holder["enc"] = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        enc = holder["enc"]
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())])
    return documents.select("doc_id", "source", "text").mapInArrow(run, schema)


def source_key(source: Column) -> Column:
    """Sources are the same whatever their letter case and surrounding white space."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def temperature_weights(sizes: dict[str, float], exponent: float) -> dict[str, float]:
    """Normalised size shares to the exponent; a source without tokens has weight 0."""
    total = sum(sizes.values())
    raw = {k: (v / total) ** exponent if v > 0 else 0.0 for k, v in sizes.items()} if total > 0 else dict.fromkeys(sizes, 0.0)
    z = sum(raw.values())
    return {k: v / z if z else 0.0 for k, v in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def bisect_exponent(sizes: dict[str, float], target_entropy: float | None = None, budget: float | None = None, max_repeats: dict[str, float] | None = None) -> float:
    """The exponent of at least 0 whose weights have ``target_entropy``, or the least one in [0, 1] that repeats no source beyond its limit.

    Entropy falls as the exponent grows, from that of equal weights to that of the largest sources alone; the upper end
    is doubled until it is low enough.  Up to 1 the most-repeated source's need falls too.  Either is
    found by bisection; the nearer end is returned where the goal is out of range.
    """
    def short(x: float) -> bool:
        w = temperature_weights(sizes, x)
        if target_entropy is not None:
            return entropy(w) > target_entropy
        return any(w[k] * (budget or 0) > sizes[k] * (max_repeats or {}).get(k, 1) for k in sizes if sizes[k] > 0)

    lo, hi = 0.0, 1.0
    if not short(lo):
        return lo
    # at 1024 a source of 99 % of the largest one's size has a weight of 1e-5 of its
    while target_entropy is not None and short(hi) and hi < 1024:
        lo, hi = hi, hi * 2
    if short(hi):
        return hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if short(mid) else (lo, mid)
    return hi


def source_sizes(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source: source (as spelt there), target_share, max_repeats, documents, tokens, all_tokens.

    ``all_tokens`` is the size of all documents together, each counted once, whether
    or not their source is a target.  An empty target table stands for all sources of the documents, without shares.
    """
    by = sized.groupBy(source_key(F.col("source")).alias("key")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    total = by.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    # of a source that is given twice the row with the largest share, then limit, then name
    t = targets.where("source IS NOT NULL").groupBy(source_key(F.col("source")).alias("key")).agg(F.max(F.struct("target_share", "max_repeats", "source")).alias("t"))
    t = t.select("t.source", "t.target_share", "t.max_repeats", "key")
    if t.isEmpty():
        t = by.where("key IS NOT NULL").select(F.col("key").alias("source"), F.lit(None).cast("double").alias("target_share"), F.lit(None).cast("long").alias("max_repeats"), "key")
    # total has one row
    out = t.join(by, "key", "left").join(F.broadcast(total))
    return out.select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "all_tokens", "key")


def reachable(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the tokens a source's share asks for, the most it can give, and whether that is enough."""
    need = F.coalesce("target_share", F.lit(0.0)) * F.col("all_tokens")
    most = F.col("tokens") * F.coalesce("max_repeats", F.lit(1))
    return sizes.withColumn("wanted_tokens", need).withColumn("possible_tokens", most).withColumn("reachable", most >= need)


def plan(sizes: list[dict], total_tokens: int | None = None, target_entropy: float | None = None) -> list[dict]:
    """``source_sizes``' rows with weight, wanted and possible tokens, budget, reachable and tempered_share.

    The weight is the target share; sources without one divide what the shares leave, by tempered weights
    that have ``target_entropy`` if it is given, and else repeat none beyond its limit where any do.  ``tempered_share``: the tempered weight, over all
    sources, of equal entropy.  The budget is the wanted tokens up to the possible ones.
    """
    rows = [dict(r) for r in sizes]
    total = total_tokens if total_tokens is not None else (rows[0]["all_tokens"] if rows else 0)
    have = {r["source"]: float(r["tokens"]) for r in rows}
    limit = {r["source"]: 1 if r["max_repeats"] is None else r["max_repeats"] for r in rows}
    weight = {r["source"]: r["target_share"] for r in rows if r["target_share"] is not None}
    free = {k: v for k, v in have.items() if k not in weight}
    rest = max(0.0, 1.0 - sum(weight.values()))
    goal = {"budget": rest * total, "max_repeats": limit} if target_entropy is None else {"target_entropy": target_entropy}
    share = temperature_weights(free, bisect_exponent(free, **goal))
    weight |= {k: rest * w for k, w in share.items()}
    tempered = temperature_weights(have, bisect_exponent(have, target_entropy=entropy(weight)))
    for r in rows:
        k = r["source"]
        r["weight"], r["tempered_share"] = weight[k], tempered[k]
        r["wanted_tokens"], r["possible_tokens"] = weight[k] * total, r["tokens"] * limit[k]
        # a tempered budget at its very limit is as large as that limit but for rounding
        r["reachable"] = r["possible_tokens"] >= r["wanted_tokens"] - (1e-6 * total if k in free else 0)
        r["budget"] = float(min(r["wanted_tokens"], r["possible_tokens"]))
    return rows


def planned(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, target_entropy: float | None = None) -> tuple[list[dict], DataFrame]:
    """``plan`` of the sources as rows (one per source: the mix's configuration, not its data), and as a frame."""
    rows = plan([r.asDict() for r in source_sizes(sized, targets).collect()], total_tokens, target_entropy)
    kinds = {"source": "string", "target_share": "double", "max_repeats": "long", "documents": "long", "tokens": "long", "wanted_tokens": "double", "budget": "double", "tempered_share": "double", "reachable": "boolean"}
    return rows, sized.sparkSession.createDataFrame([tuple(r[k] for k in kinds) for r in rows], ", ".join(f"{k} {v}" for k, v in kinds.items()))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, block_documents: int = 20000, vocabulary: str = VOCABULARY, target_entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents of the mix, report).

    Documents: doc_id, source, tokens, copies (at least 1).  Report: per target source the
    target share (null: tempered), the exponent-tempered share of equal entropy, budget and reached tokens,
    reached share, copies of its most used document, and whether its share is reachable.

    The mix has ``total_tokens`` tokens (default: as many as all documents together) where
    every share is reachable; a source that cannot reach its budget gives all it may,
    and nothing else takes its place.  A budget is missed by less than one document.
    Documents with a null id or of no target source, and those without tokens, aren't used.
    """
    sized = write_stage(with_tokens(documents, vocabulary).withColumn("key", source_key(F.col("source"))), "sized")
    rows, sizes = planned(sized, targets, total_tokens, target_entropy)
    budgets = []
    for r in rows:
        passes = int(r["budget"] // r["tokens"]) if r["tokens"] else 0
        blocks = max(1, -(-r["documents"] // block_documents))
        budgets.append((r["source"], r["key"], passes, float(r["budget"] - passes * r["tokens"]), blocks))
    spark = documents.sparkSession
    b = spark.createDataFrame(budgets, "mix_source string, key string, passes int, rest double, blocks int")
    d = sized.where("doc_id IS NOT NULL AND tokens > 0").join(F.broadcast(b), "key")
    d = d.withColumn("place", F.xxhash64("doc_id", F.lit(seed))).withColumn("block", F.pmod("place", F.col("blocks")))
    sums = d.groupBy("key", "block").agg(F.sum("tokens").alias("block_tokens"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("block_tokens").over(before), F.lit(0)))
    d = d.join(sums, ["key", "block"])
    whole = d.where(F.col("before") + F.col("block_tokens") <= F.col("rest"))
    edge = d.where((F.col("before") + F.col("block_tokens") > F.col("rest")) & (F.col("before") < F.col("rest")))
    run = Window.partitionBy("key", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("extra", (F.col("before") + F.sum("tokens").over(run) <= F.col("rest")).cast("int"))
    none = d.where(F.col("before") >= F.col("rest"))
    cols = ["doc_id", F.col("mix_source").alias("source"), "tokens", (F.col("passes") + F.col("extra")).alias("copies")]
    used = whole.withColumn("extra", F.lit(1)).select(cols).unionByName(edge.select(cols)).unionByName(none.withColumn("extra", F.lit(0)).select(cols)).where("copies > 0")
    used = write_stage(used, "mix")
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.max("copies").alias("most_copies"))
    all_used = got.agg(F.sum("reached_tokens").alias("mix_tokens"))
    report = sizes.join(got, "source", "left").join(F.broadcast(all_used))
    report = report.select(
        "source", "target_share", "tempered_share", "max_repeats", "documents", "tokens", "budget", F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
        F.coalesce(F.col("reached_tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("reached_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "reachable",
    )
    return used, report
