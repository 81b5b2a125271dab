"""Query text and filters: parsing on the driver, predicates as columns, diagnosis of empty results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import basename, canonical_language, encode_value, language_column, path_predicate


@dataclass
class Query:
    text: str = ""
    exact: bool = False
    regex: bool = False
    includes: list[str] = field(default_factory=list)
    excludes: list[str] = field(default_factory=list)
    language: str | None = None
    kind: str | None = None


def parse_query(text: str) -> Query:
    """``file:`` ``-file:`` ``lang:`` ``kind:`` words are filters; the rest is kept; then ``sym:`` or ``re:`` in front of it."""
    q, rest = Query(), []
    for chunk in re.findall(r"\S+\s*|\s+", text):
        word = chunk.rstrip()
        if word.startswith("-file:") and len(word) > 6:
            q.excludes.append(encode_value(word[6:]))
        elif word.startswith("file:") and len(word) > 5:
            q.includes.append(encode_value(word[5:]))
        elif word.startswith("lang:") and len(word) > 5:
            q.language = canonical_language(word[5:])
        elif word.startswith("kind:") and len(word) > 5:
            q.kind = word[5:]
        else:
            rest.append(chunk)
    q.text = "".join(rest).strip()
    if not q.text.startswith("re:"):
        # in a pattern white space counts, between words it doesn't
        q.text = " ".join(q.text.split())
    if q.text.startswith("sym:"):
        q.exact, q.text = True, q.text[4:].strip()
        if q.text.startswith("re:"):
            raise ValueError("a query is either a symbol or a pattern")
    elif q.text.startswith("re:"):
        q.regex, q.text = True, q.text[3:]
    if (q.exact or q.regex) and not q.text:
        raise ValueError("nothing to look for after the prefix")
    return q


def anchored(files: DataFrame, value: str) -> bool:
    """Whether some path continues the value at '/', '.' or its end: one lookup that stops at the first hit."""
    p = F.col("path")
    return not files.where(p.startswith(value) & F.substring(p, len(value) + 1, 1).isin("", "/", ".")).limit(1).isEmpty()


def bind(files: DataFrame, q: Query) -> Callable[[Iterable[str]], Column] | None:
    """The query's filters as a condition on a table with some of path, language and kind, or None where there are none.

    Whether a path value is anchored is looked up once, in the paths of ``files``.
    """
    if not (q.includes or q.excludes or q.language or q.kind):
        return None
    held = {v: anchored(files, v) for v in [*q.includes, *q.excludes]}

    def condition(columns: Iterable[str]) -> Column:
        ok: Column = F.lit(True)
        if q.includes:
            hit: Column = F.lit(False)
            for v in q.includes:
                hit = hit | path_predicate(F.col("path"), v, held[v])
            ok = ok & hit
        for v in q.excludes:
            ok = ok & ~path_predicate(F.col("path"), v, held[v])
        if q.language and "language" in columns:
            ok = ok & F.coalesce(language_column(F.col("language")) == q.language, F.lit(False))
        if q.kind and "kind" in columns:
            ok = ok & F.coalesce(F.col("kind") == q.kind, F.lit(False))
        return ok

    return condition


def filter_paths(files: DataFrame, includes: list[str], excludes: list[str]) -> DataFrame:
    """Includes are alternatives, excludes all hold; pushed to the scan as prefix and containment tests."""
    return apply(files, Query(includes=includes, excludes=excludes))


def apply(files: DataFrame, q: Query) -> DataFrame:
    bound = bind(files, q)
    return files if bound is None else files.where(bound(files.columns))


def resolve_single_file(files: DataFrame, value: str) -> str | None:
    """The path equal to the value, else the only path that matches it where it ends at a name's end."""
    if not files.where(F.col("path") == value).limit(1).isEmpty():
        return value
    hit = files.where((F.col("path") == value) | F.col("path").endswith("/" + value) | F.col("path").rlike("(^|/)" + _quoted(value) + r"\.[^./]*$"))
    rows = hit.select("path").distinct().limit(2).collect()
    return rows[0][0] if len(rows) == 1 else None


def _quoted(v: str) -> str:
    return "\\Q" + v.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def diagnose(files: DataFrame, includes: list[str], language: str | None) -> DataFrame:
    """One row per filter with the files that it alone keeps, and of all together; one pass over the files."""
    p = F.col("path")
    tests = {f"file:{v}": path_predicate(p, v, False) for v in includes}
    if language:
        tests[f"lang:{language}"] = F.coalesce(language_column(F.col("language")) == language, F.lit(False))
    every: Column = F.lit(True)
    if includes:
        any_in: Column = F.lit(False)
        for v in includes:
            any_in = any_in | path_predicate(p, v, False)
        every = every & any_in
    if language:
        every = every & tests[f"lang:{language}"]
    tests["all"] = every
    agg = files.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(str(i)) for i, c in enumerate(tests.values())])
    pairs = F.array(*[F.struct(F.lit(k).alias("filter"), F.col(str(i)).alias("files")) for i, k in enumerate(tests)])
    return agg.select(F.explode(pairs).alias("x")).select("x.filter", "x.files")


def nearest_paths(files: DataFrame, value: str, n: int = 3, most: int = 400) -> DataFrame:
    """Paths like a value that no path matches: those that hold the first four characters of its name, the
    ``most`` shortest of them, ranked by containment, edit distance, depth, length and path."""
    stem = value.rsplit("/", 1)[-1].split(".", 1)[0].lower()
    p = F.lower("path")
    near = files.select("path").distinct().where(p.contains(stem[:4])).orderBy(F.length("path"), "path").limit(most)
    name = F.substring_index(F.lower(basename(F.col("path"))), ".", 1)
    klass = F.when(name == stem, 0).when(name.contains(stem), 1).when(p.contains(stem), 2).otherwise(3)
    ranked = near.select("path", klass.alias("class"), F.levenshtein(name, F.lit(stem)).alias("distance"), F.size(F.split("path", "/")).alias("depth"))
    w = Window.orderBy("class", "distance", "depth", F.length("path"), "path")
    return ranked.orderBy("class", "distance", "depth", F.length("path"), "path").limit(n).withColumn("rank", F.row_number().over(w))
