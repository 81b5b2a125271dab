"""Problem 2: splitting oversized bodies at natural boundaries.

A hierarchy of separators - definition (section), blank line (paragraph), line
end, sentence, word, character - is searched from the top: a piece ends at the
last boundary of the highest level that has one in the second half of its reach, so what stands between
boundaries is packed greedily up to the limit and a lone early boundary makes no small piece; only
where no definition, blank line or line ends there, one in the first half is taken before a sentence or a word is cut.  Consecutive pieces overlap by a given number of bytes;
a piece begins that many bytes before its predecessor ends, or at the next
character start.  Offsets are bytes; characters are UTF-8 where the bytes are,
and single bytes where they aren't.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import current_files

LIMIT, OVERLAP = 4096, 256
_BLANK = re.compile(rb"\n[ \t\r]*\n")
_SENTENCE = re.compile(rb"[.!?;]['\")\]]*[ \t]+")
_WORD = re.compile(rb"[ \t,(){}\[\]]+")

_PIECES = T.StructType(
    [
        T.StructField("revision", T.StringType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("span_start", T.LongType()),
        T.StructField("span_end", T.LongType()),
        T.StructField("boundary", T.StringType()),
    ]
)


def char_start(data: bytes, at: int) -> int:
    """The least character start at or after ``at`` (at most 3 bytes on)."""
    n = len(data)
    while at < n and data[at] & 0xC0 == 0x80 and _inside(data, at):
        at += 1
    return at


def _inside(data: bytes, at: int) -> bool:
    """Whether the continuation byte at ``at`` belongs to a UTF-8 sequence that began before it."""
    for back in range(1, 4):
        i = at - back
        if i < 0:
            return False
        c = data[i]
        if c & 0xC0 == 0x80:
            continue
        size = 2 if c >> 5 == 6 else 3 if c >> 4 == 14 else 4 if c >> 3 == 30 else 1
        if size <= back:
            return False
        try:
            data[i : i + size].decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True
    return False


def _last(rx: re.Pattern, data: bytes, low: int, high: int) -> int | None:
    """End of the last match that ends in (low, high]; searched backwards in growing windows."""
    step = 512
    while True:
        a = max(low, high - step)
        found = None
        for m in rx.finditer(data, a, high):
            if m.end() > low:
                found = m.end()
        if found is not None or a == low:
            return found
        step *= 4


def _section(data: bytes, sections: list[int], low: int, high: int) -> int | None:
    i = bisect_right(sections, high) - 1
    while i >= 0 and sections[i] > low:
        if char_start(data, sections[i]) == sections[i]:
            return sections[i]
        i -= 1
    return None


def _boundary(data: bytes, sections: list[int], low: int, half: int, high: int) -> tuple[int | None, str]:
    """The end of a piece in (low, high] and its kind; (None, '') if not even a word ends there."""

    def last(kind: str, a: int, b: int) -> int | None:
        if kind == "definition":
            return _section(data, sections, a, b)
        if kind == "line":
            return data.rfind(b"\n", a, b) + 1 or None
        return _last({"paragraph": _BLANK, "sentence": _SENTENCE, "word": _WORD}[kind], data, a, b)

    for kinds in (("definition", "paragraph", "line"), ("sentence", "word")):
        for a, b in ((half, high), (low, half)):
            for kind in kinds:
                if b > a and (end := last(kind, a, b)) is not None:
                    return end, kind
    return None, ""


def pieces(data: bytes, sections: list[int], limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces that cover ``data``; one piece if it fits, none if it is empty.

    ``sections``: ascending byte offsets at which definitions begin or end; those
    outside the body or inside a character are passed over.
    """
    if overlap * 2 > limit or limit < 8:
        raise ValueError("limit must be at least 8 and twice the overlap")
    out: list[tuple[int, int, str]] = []
    start, n = 0, len(data)
    while start < n:
        if n - start <= limit:
            out.append((start, n, "end"))
            break
        high = start + limit
        # a cut beyond the overlap, so that the next piece begins after this one
        low = start + overlap + 4
        end, kind = _boundary(data, sections, low, max(low, start + limit // 2), high)
        if end is None:
            end, kind = high, "character"
            while char_start(data, end) != end:
                end -= 1
        out.append((start, end, kind))
        start = char_start(data, end - overlap)
    return out


def split(bodies: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(revision, sections array<long> or null, bytes) -> pieces; a null or empty body gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            revisions, cuts, data = (batch.column(batch.schema.get_field_index(c)) for c in ("revision", "sections", "bytes"))
            out: list[list] = [[], [], [], [], []]
            for rev, cut, body in zip(revisions.to_pylist(), cuts.to_pylist(), data):
                for k, (a, b, kind) in enumerate(pieces(body.as_py() or b"", cut or [], limit, overlap)):
                    for col, x in zip(out, (rev, k, a, b, kind)):
                        col.append(x)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=_PIECES.names)

    return bodies.select("revision", "sections", "bytes").mapInArrow(run, _PIECES)


def section_offsets(region_spans: DataFrame, definitions: DataFrame, oversized: DataFrame) -> DataFrame:
    """(revision, sections): where the definitions that regions name begin and end in the oversized bodies.

    Spans without order or outside the body are left out here or by ``pieces``.  A
    body has at most as many offsets as bytes, whatever the number of files that share it.
    """
    spans = region_spans.where("definition IS NOT NULL").select("definition", "revision").distinct().join(oversized, "revision", "left_semi")
    d = definitions.select(F.col("id").alias("definition"), "revision", "span_start", "span_end").where("span_start >= 0 AND span_end > span_start")
    d = d.join(oversized, "revision", "left_semi").distinct().join(spans, ["definition", "revision"], "left_semi")
    cut = d.select("revision", F.explode(F.array("span_start", "span_end")).alias("at")).where("at > 0").distinct()
    return cut.groupBy("revision").agg(F.sort_array(F.collect_list("at")).alias("sections"))


def oversized_pieces(contents: DataFrame, region_spans: DataFrame, definitions: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every body over ``limit`` bytes.

    The length test runs in the JVM before anything is shuffled or sent to
    Python; a body is read whole.
    """
    big = contents.select("revision", "bytes").where((F.length("bytes") > limit) & F.col("revision").isNotNull())
    keys = contents.where(F.length("bytes") > limit).select("revision")
    cuts = section_offsets(region_spans, definitions, keys)
    return split(big.join(cuts.hint("shuffle_hash"), "revision", "left"), limit, overlap).dropDuplicates(["revision", "piece_no"])


def against_coverage(split_pieces: DataFrame, files: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per member of the current files: files whose body is split, their pieces, and the truncated files its last scan reported."""
    now = current_files(files).where("revision IS NOT NULL AND member IS NOT NULL")
    n = split_pieces.groupBy("revision").agg(F.count("*").alias("pieces"))
    per = now.join(n, "revision").groupBy("member").agg(F.count("*").alias("oversized_files"), F.sum("pieces").alias("pieces"))
    last = coverage.where("member IS NOT NULL").groupBy("member").agg(F.max_by("truncated_files", F.struct("generation", "captured_at")).alias("reported_truncated"))
    return last.join(per, "member", "left").select("member", F.coalesce("oversized_files", F.lit(0)).alias("oversized_files"), F.coalesce("pieces", F.lit(0)).alias("pieces"), "reported_truncated")


def audit(split_pieces: DataFrame, contents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Per split body: its bytes, those its pieces cover without a gap, and how many pieces break a rule: too long, or not
    beginning ``overlap`` bytes (less at most 3 for a character) before the preceding one ends."""
    w = Window.partitionBy("revision").orderBy("piece_no")
    before = F.lag("span_end").over(w)
    p = split_pieces.withColumn("before", before).withColumn("fresh", F.col("span_end") - F.greatest("span_start", F.coalesce(before, F.lit(0))))
    lap = F.col("before") - F.col("span_start")
    per = p.groupBy("revision").agg(
        F.sum(F.when(F.col("before").isNull() | (F.col("span_start") <= F.col("before")), F.col("fresh")).otherwise(0)).alias("covered_bytes"),
        F.sum((F.col("span_end") - F.col("span_start") > limit).cast("long")).alias("long_pieces"),
        F.sum((F.col("before").isNotNull() & ~lap.between(overlap - 3, overlap) | (F.col("before").isNull() & (F.col("span_start") != 0))).cast("long")).alias("wrong_starts"),
    )
    return contents.where("revision IS NOT NULL").select("revision", F.length("bytes").cast("long").alias("total_bytes")).distinct().join(per.hint("shuffle_hash"), "revision")
