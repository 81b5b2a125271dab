"""Problem 1: generated, minified or vendored source files, and data stored as code.

A body is lexed once (``lexers``).  Its comments are searched for statements of
origin, its tokens measured, and the stream of its other tokens - strings and
numbers reduced to one symbol each - is fingerprinted by winnowing: hashes of
every ``K`` successive tokens, of which the least in every window of ``W`` is
kept.  A fingerprint recurs if it stands in files of ``min_members`` unrelated
members; a file whose fingerprints largely recur is a copy, whatever its header
and its path say.

Scale: each body is read and lexed once; a fingerprint row is 16 bytes and a
body of n tokens has about 2 n / W of them.  Members are counted exactly: a
body contributes at most ``min_members`` of its members to a fingerprint,
which is enough to decide the threshold, so a body copied to every member
adds no more rows than any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import write_stage
from .common import HOT, current_files, family, hot_keys, join_bodies, join_split
from .lexers import BLOCK, DQ, EXTENSIONS, LINE, MASTER, NUMBER, SQ, WORD

#: tokens of a fingerprint, and fingerprints of a window
K, W = 20, 32

# Path parts that say where a file comes from (folders of tools and of package managers), and endings of generators.
GENERATED_PATH = r"(?i)(^|/)(gen|generated|__generated__|autogen|autogenerated)/|(\.gen|\.g|\.designer|\.generated|_generated|_pb2?|\.pb)\.[a-z]+$"
VENDORED_PATH = r"(?i)(^|/)(vendor|vendors|vendored|third[_-]?party|external|extern|externals|deps|imported|node_modules|bower_components|jspm_packages|packages/_index|carthage|pods)/"
MINIFIED_PATH = r"(?i)[.-]min\.[a-z]+$"

#: what may follow "generated" and "do not edit" where they speak of the file itself
_OF_FILE = r"(?=\s*(?:$|[-.,;:!()<>/*]|(?:file|code|class|module|source|by|from|with|using|at|and)\b))"
_NOT_BY_HAND = r"(?=\s*(?:$|[-.,;:!()]|(?:by hand|manually|directly|this|it)\b))"
#: statements of a tool at the start of a comment's line: that it was generated, by or from what, and that it isn't to be edited
GENERATED_NOTE = re.compile(
    rf"(?i)(?:(?:this )?(?:code|file|source)(?: is| was)? )?(?:auto[- ]?(?:matically )?generated\b{_OF_FILE}|generated (?:by|from|with|using)\b|@generated\b|<auto-?generated\b)"
    rf"|.*\bdo not (?:edit|modify|change)\b{_NOT_BY_HAND}|(?:machine|computer)[- ](?:made|generated|written)\b|.*\bregenerate (?:it )?(?:with|by|using|via)\b|.*\b(?:over)?(?:re)?writes this file\b"
    r"|.*\bautomatisch (?:erzeugt|generiert|erstellt)\b|.*\bg[ée]n[ée]r[ée]e? automatiquement\b|.*\bgenerad[oa] autom[áa]ticamente\b"
)
#: statements of a copy's origin at the start of a comment's line: a copy of what, its upstream, or name and release
VENDORED_NOTE = re.compile(
    r"(?i)(?:bundled|vendored|unmodified|verbatim|pristine) copy of \S|upstream: *\S+ *@|(?:copied |taken |imported |vendored )?from the \S+ release \d"
    r"|\S+ v?\d+(?:\.\d+)+ *(?:\| *\(c\)|- *https?://|, *(?:taken|copied|imported|vendored)\b)|@license \S+ v?\d"
)
_LEAD = re.compile(r"^[\s/*#;!-]*(?:\[=*\[)?\s*")
_FOOT = re.compile(r"\n[ \t]*\*?[ \t]*")

#: what needs no grammar is lexed alike: languages with // and /* */, and those with # comments
C_LIKE, HASH_LIKE = "c-like", "hash-like"
ALL_EXTENSIONS = (
    EXTENSIONS
    | {"tsx": "typescript", "jsx": "javascript"}
    | dict.fromkeys("c h cc cpp cxx hpp hh java go kt kts swift scala dart groovy css scss less proto m mm zig v sol glsl hlsl".split(), C_LIKE)
    | dict.fromkeys("py pyi rb sh bash zsh pl pm r jl ex exs nim tcl cmake mk gd coffee".split(), HASH_LIKE)
)
LEXERS = MASTER | {
    C_LIKE: re.compile("|".join((LINE, BLOCK, DQ, SQ, r"`[^`]*`", WORD, NUMBER, r"\n", r"\S"))),
    HASH_LIKE: re.compile("|".join((r'"""[\s\S]*?"""', r"'''[\s\S]*?'''", r"#[^\n]*", DQ, SQ, WORD, NUMBER, r"\n", r"\S"))),
}


_FACTS = T.StructType(
    [
        T.StructField("revision", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("generated_note", T.BooleanType()),
        T.StructField("vendored_note", T.BooleanType()),
        T.StructField("minified", T.BooleanType()),
        T.StructField("data", T.BooleanType()),
        T.StructField("prints", T.ArrayType(T.LongType())),
    ]
)


class _Hashes(dict):
    """token -> 64-bit value; 0 for what is left out of the stream (comments, line ends)."""

    def __init__(self, family: str):
        super().__init__()
        self.family = family

    def __missing__(self, t: str) -> int:
        if len(self) > 200_000:
            self.clear()
        c = t[0]
        if c == "\n" or is_comment(t, self.family):
            v = 0
        elif len(t) > 1 and (c in "\"'`" or t[-1] in "\"'`"):
            v = 1
        elif c.isdigit():
            v = 2
        else:
            v = int.from_bytes(__import__("hashlib").blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "little") >> 1
        self[t] = v
        return v


@cache
def _hashes(family: str) -> _Hashes:
    return _Hashes(family)


def is_comment(t: str, family: str) -> bool:
    if len(t) < 2:
        return False
    if family == "luau":
        return t.startswith("--")
    if family == HASH_LIKE:
        return t[0] == "#" or t.startswith(('"""', "'''"))
    return t.startswith(("//", "/*")) or t[0] == "#" and t[1] not in "[!" and " " in t


def fingerprints(stream: np.ndarray) -> np.ndarray:
    """Winnowed hashes of a token stream (int64): none for a stream under K tokens."""
    n = len(stream) - K + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    s = stream.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(K):
            h = h * np.uint64(0x9E3779B97F4A7C15) + s[j : j + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    if n > W:
        # sliding minimum by doubling
        m, span = h, 1
        while span * 2 <= W:
            m = np.minimum(m[: len(m) - span], m[span:])
            span *= 2
        if span < W:
            m = np.minimum(m[: len(m) - (W - span)], m[W - span :])
        h = m
    else:
        h = h.min(keepdims=True)
    return np.unique(h).view(np.int64)


def body_facts(fam: str, data: bytes) -> tuple[bool, bool, bool, bool, np.ndarray]:
    """(generated note, vendored note, minified, data, fingerprints) of one body; all false and none for an empty one."""
    text = data.decode("utf-8", "replace").lstrip("﻿")
    tokens = LEXERS[fam].findall(text)
    generated = vendored = False
    comments = 0
    for t in {t for t in tokens if is_comment(t, fam)}:
        comments += len(t)
        for line in _FOOT.split(t):
            line = _LEAD.sub("", line)
            if GENERATED_NOTE.match(line):
                generated = True
            elif VENDORED_NOTE.match(line):
                vendored = True
    memo = _hashes(fam)
    stream = np.fromiter((memo[t] for t in tokens), np.int64, len(tokens))
    stream = stream[stream != 0]
    code = len(stream)
    lines = sum(1 for x in text.split("\n") if x.strip())
    strings = sum(len(t) for t in tokens if len(t) > 1 and (t[0] in "\"'`" or t[-1] in "\"'`"))
    words = sum(len(t) for t in tokens if t[0].isalpha() and t[-1] not in "\"'`")
    literal = int((stream == 1).sum() + (stream == 2).sum())
    blank = len(text) - strings - comments
    minified = code >= 80 and code / max(1, lines) >= 60 and words * 6 > blank and sum(map(str.isspace, text)) * 8 < len(text)
    size = max(1, len(text) - comments)
    is_json = text.lstrip()[:1] == "{"
    is_data = not is_json and len(text) >= 200 and words * 20 < size and (literal * 10 >= code * 3 or strings * 10 >= size * 9)
    return generated, vendored, minified, is_data, fingerprints(stream)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
    for batch in batches:
        revisions, families, bodies = (batch.column(batch.schema.get_field_index(c)) for c in ("revision", "families", "bytes"))
        out: list[list] = [[] for _ in kinds]
        for rev, fams, body in zip(revisions.to_pylist(), families.to_pylist(), bodies):
            data = body.as_py()
            for fam in fams:
                for col, x in zip(out, (rev, fam, *body_facts(fam, data))):
                    col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=_FACTS.names)


def facts(bodies: DataFrame) -> DataFrame:
    return bodies.select("revision", "families", "bytes").mapInArrow(_facts, _FACTS)


def shared_prints(found: DataFrame, members: DataFrame, min_members: int, hot_rows: int = HOT) -> DataFrame:
    """(revision, family, shared): how many of a body's fingerprints recur.

    ``members``: (revision, family, some of its members up to ``min_members``).  A
    fingerprint that more than ``hot_rows`` bodies have is looked up in parts.
    """
    rows = found.where(F.size("prints") > 0).select("revision", "family", F.explode("prints").alias("print"))
    who = found.where(F.size("prints") > 0).select("revision", "family", "prints").join(members, ["revision", "family"])
    pairs = who.select(F.explode("prints").alias("print"), "some").select("print", F.explode("some").alias("member"))
    counted = pairs.groupBy("print", "member").agg(F.count("*").alias("c")).groupBy("print").agg(F.count("*").alias("n"), F.sum("c").alias("bodies"))
    recurring = counted.where(F.col("n") >= min_members)
    return join_split(rows, recurring.select("print"), hot_keys(recurring, ["print"], "bodies", hot_rows), ["print"], "revision", "left_semi").groupBy("revision", "family").agg(F.count("*").alias("shared"))


def classify(
    files: DataFrame, contents: DataFrame, min_members: int = 3, min_ratio: float = 0.6, min_prints: int = 4, extensions: dict[str, str] = ALL_EXTENSIONS, hot_rows: int = HOT
) -> DataFrame:
    """Origin of each current file with a body whose path denotes a language other than text.

    Columns: file_id, member, path, revision, generated, minified, vendored, data,
    prints, shared, by_note, by_path, by_measure, by_prints, hand_written.  ``vendored`` is by path, by a statement in a
    comment, or by fingerprints: at least ``min_ratio`` of at least ``min_prints``
    recur in ``min_members`` members.  The ``by_`` columns say which routes decide.

    Files without revision or body give no row; an empty body is hand-written.
    A null member counts as no member.  Repeated rows of a file count once.
    """
    now = current_files(files).withColumn("family", family(F.col("path"), extensions)).where("family IS NOT NULL AND revision IS NOT NULL")
    keys = now.groupBy("revision").agg(F.sort_array(F.collect_set("family")).alias("families"))
    hot = hot_keys(now.groupBy("revision").agg(F.count("*").alias("n")), ["revision"], "n", hot_rows)
    found = write_stage(facts(join_bodies(keys, contents)), "facts").dropDuplicates(["revision", "family"])
    some = now.where("member IS NOT NULL").select("revision", "family", "member").distinct()
    # no more than min_members of a body's members are needed: the group limit below the window runs before the shuffle
    least = some.withColumn("n", F.row_number().over(Window.partitionBy("revision", "family").orderBy("member"))).where(F.col("n") <= min_members)
    members = least.groupBy("revision", "family").agg(F.collect_list("member").alias("some"))
    shared = shared_prints(found, members, min_members, hot_rows)
    body = found.select("revision", "family", "generated_note", "vendored_note", F.col("minified").alias("min_body"), "data", F.size("prints").alias("prints"))
    body = body.join(shared, ["revision", "family"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    per = body.groupBy("revision").agg(F.collect_list(F.struct(*[c for c in body.columns if c != "revision"])).alias("bodies"))
    out = join_split(now.select(F.col("id").alias("file_id"), "member", "path", "revision", "family"), per, hot, ["revision"], "file_id")
    out = out.withColumn("f", F.filter("bodies", lambda b: b["family"] == F.col("family"))[0]).drop("bodies", "family").select("file_id", "member", "path", "revision", "f.*")
    copied = (F.col("prints") >= min_prints) & (F.col("shared") >= min_ratio * F.col("prints"))
    made, brought, small = (F.col("path").rlike(p) for p in (GENERATED_PATH, VENDORED_PATH, MINIFIED_PATH))
    out = (
        out.withColumn("generated", F.col("generated_note") | made)
        .withColumn("minified", F.col("min_body") | small)
        .withColumn("vendored", F.col("vendored_note") | brought | copied)
        .withColumn("by_note", F.col("generated_note") | F.col("vendored_note"))
        .withColumn("by_path", made | brought | small)
        .withColumn("by_measure", F.col("min_body") | F.col("data"))
        .withColumn("by_prints", copied)
    )
    hand: Column = ~(F.col("generated") | F.col("minified") | F.col("vendored") | F.col("data"))
    routes = ["by_note", "by_path", "by_measure", "by_prints"]
    return out.select("file_id", "member", "path", "revision", "generated", "minified", "vendored", "data", "prints", "shared", *routes, hand.alias("hand_written"))


def routes(classified: DataFrame) -> DataFrame:
    """(route, files, alone): files that each route finds, and those that no other route finds."""
    names = ["by_note", "by_path", "by_measure", "by_prints"]
    n = sum((F.col(x).cast("int") for x in names[1:]), F.col(names[0]).cast("int"))
    one = classified.select(F.explode(F.array(*[F.struct(F.lit(x[3:]).alias("route"), F.col(x).alias("yes")) for x in names])).alias("r"), n.alias("n"))
    return one.where("r.yes").groupBy("r.route").agg(F.count("*").alias("files"), F.sum((F.col("n") == 1).cast("long")).alias("alone"))
