"""Verified reads, result sets, pages and renderings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path, PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHOWN_ROWS = 200
RESULTS = 10_000


class StaleSource(Exception):
    """The bytes at a path are no longer those of the handle's revision."""


def read_contained(root: str, relative: str, limit: int = 16 << 20) -> bytes:
    """Bytes of a file below a root: no absolute path, no '..', no symbolic link on the way, bounded size."""
    p = PurePosixPath(relative)
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise ValueError("the path leaves its root")
    at = Path(root)
    for part in p.parts:
        at = at / part
        if at.is_symlink():
            raise ValueError("a symbolic link is on the path")
    if at.stat().st_size > limit:
        raise ValueError("the file is larger than the limit")
    return at.read_bytes()


def display_line(raw: bytes) -> tuple[str, str]:
    """(text, encoding) of one line; one that isn't UTF-8 shows its bytes beyond ASCII as \\xNN."""
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        return "".join(chr(b) if 0x20 <= b < 0x7F or b == 9 else f"\\x{b:02x}" for b in raw), "escaped"


def show(data: bytes, revision: str, start: int, end: int, offset: int = 0, most: int = SHOWN_ROWS) -> dict:
    """Numbered lines of a span of verified bytes, at most ``most`` from ``offset``, and where to go on."""
    if hashlib.sha256(data).hexdigest() != revision:
        raise StaleSource(revision)
    if not 0 <= start <= end <= len(data):
        raise ValueError("the span lies outside the file")
    first = data.count(b"\n", 0, start) + 1
    lines = data[start:end].split(b"\n")
    if lines and lines[-1] == b"" and end > start:
        lines.pop()
    part = lines[offset : offset + most]
    rows = [{"line": first + offset + i, "text": t, "encoding": e} for i, (t, e) in enumerate(map(display_line, part))]
    return {"rows": rows, "next": offset + most if offset + most < len(lines) else None}


def show_spans(bodies: DataFrame, spans: DataFrame, most: int = SHOWN_ROWS) -> DataFrame:
    """(id, line, text): lines of UTF-8 spans (id, revision, span_start, span_end) of bodies (revision, bytes), cut by bytes.

    Each body is read once with its distinct spans, and its line ends are counted once; spans outside it or not of UTF-8 give nothing.
    """
    key = ["revision", "span_start", "span_end"]
    cut = spans.where("span_start >= 0 AND span_end >= span_start").select(*key).distinct()
    per = cut.groupBy("revision").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))
    j = bodies.select("revision", "bytes").where("bytes IS NOT NULL").join(per.hint("shuffle_hash"), "revision")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for rev, body, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = body.as_py()
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                for w in wanted:
                    a, b = w["span_start"], w["span_end"]
                    if b > len(data):
                        continue
                    try:
                        text = data[a:b].decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    first = int(np.searchsorted(ends, a)) + 1
                    lines = (text[:-1] if text.endswith("\n") else text).split("\n")
                    for k, line in enumerate(lines[:most]):
                        for col, x in zip(out, (rev, a, b, first + k, line)):
                            col.append(x)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[*key, "line", "text"])

    shown = j.select("revision", "bytes", "spans").mapInArrow(run, "revision string, span_start long, span_end long, line long, text string")
    return spans.select("id", *key).join(shown, key).select("id", "line", "text")


def show_lines(texts: DataFrame, first: int, last: int) -> DataFrame:
    """(id, line, text): the lines from ``first`` to ``last`` of texts (id, text)."""
    t = texts.select("id", F.posexplode(F.slice(F.split("text", "\n"), first, last - first + 1)).alias("n", "text"))
    return t.select("id", (F.col("n") + first).alias("line"), "text")


def escaped_lines(bodies: DataFrame) -> DataFrame:
    """(revision, line, text) of the lines that aren't UTF-8, of bodies (revision, bytes): bytes beyond printable ASCII are shown as \\xNN."""
    odd = bodies.where(F.col("bytes").isNotNull() & ~F.is_valid_utf8(F.col("bytes").cast("string"))).select("revision", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for rev, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, raw in enumerate(body.as_py().split(b"\n"), 1):
                    text, encoding = display_line(raw)
                    if encoding == "escaped":
                        for col, x in zip(out, (rev, k, text)):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.int64(), pa.string()))], names=["revision", "line", "text"])

    return odd.mapInArrow(run, "revision string, line long, text string")


def compact(hits: DataFrame, width: int = 96) -> Column:
    """JSON locator of a hit: path, lines, name cut to ``width``; nulls are left out."""
    name = F.when(F.length("name") > width, F.concat(F.substring("name", 1, width - 1), F.lit("…"))).otherwise(F.col("name"))
    keep = [c for c in ("path", "start_line", "end_line", "kind", "snippet", "resolution", "target") if c in hits.columns]
    return F.to_json(F.struct(*keep, name.alias("name")))


def lines_rendering(hits: DataFrame, columns: list[str]) -> Column:
    """Tab-separated rendering; tabs and line ends inside values become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in columns]
    return F.concat_ws("\t", *clean)


def largest_fitting(n: int, fits: Callable[[int], bool]) -> int:
    """Largest k in 0..n for which ``fits(k)`` holds, if it holds for all smaller ones."""
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid - 1)
    return lo


def page(hits: list[dict], set_id: str, offset: int, limit: int, budget: int, count: Callable[[str], int]) -> dict:
    """Largest prefix from ``offset`` whose whole rendering fits the token budget.

    Snippets are kept if all, or at least 8, fit with them; else they go, then names; a single hit that still doesn't fit loses candidates.
    """
    part = hits[offset : offset + limit]

    def render(rows: list[dict]) -> dict:
        more = offset + len(rows) < len(hits)
        return {"set": set_id, "hits": [{"handle": f"{set_id}:{offset + i + 1}", **r} for i, r in enumerate(rows)], "next": f"{set_id}@{offset + len(rows)}" if more else None}

    def without(rows: list[dict], *keys: str) -> list[dict]:
        return [{k: v for k, v in r.items() if k not in keys} for r in rows]

    fits = lambda rows: count(json.dumps(render(rows), ensure_ascii=False)) <= budget
    k = largest_fitting(len(part), lambda n: fits(part[:n]))
    if k == len(part) or k >= 8:
        return render(part[:k])
    for drop in (("snippet",), ("snippet", "name"), ("snippet", "name", "candidates")):
        rows = without(part, *drop)
        k = largest_fitting(len(rows), lambda n: fits(rows[:n]))
        if k == len(rows) or k > 0:
            return render(rows[:k])
    return render(part[:0])


def parse_handle(text: str) -> tuple[str, int]:
    m = re.fullmatch(r"([^:@\s]+):([1-9]\d*)", text)
    if not m:
        raise ValueError("a handle is SET:ORDINAL")
    return m[1], int(m[2])


def parse_cursor(text: str) -> tuple[str, int]:
    m = re.fullmatch(r"([^:@\s]+)@(\d+)", text)
    if not m:
        raise ValueError("a cursor is SET@OFFSET")
    return m[1], int(m[2])


def evict(sets: DataFrame, most: int = 50, most_bytes: int = 512 << 20) -> DataFrame:
    """Result sets (id, created, bytes) that stay: the newest within both limits."""
    # no more than ``most`` can stay, so the sums are over that many rows
    newest = sets.orderBy(F.desc("created"), "id").limit(most)
    w = Window.orderBy(F.desc("created"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return newest.withColumn("reach", F.sum("bytes").over(w)).where(F.col("reach") <= most_bytes).drop("reach")


def retry(cause: str) -> tuple[int, float]:
    """(retries, delay in seconds) of a read's failure by its cause."""
    return {"busy": (1, 0.25), "warming": (1, 1.0), "connection": (1, 0.1)}.get(cause, (0, 0.0))
