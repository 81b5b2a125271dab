"""Targets of historical queries, symbol histories, memoised comparisons, member configuration, re-extraction, item listings."""

from __future__ import annotations

import json
import re
import tomllib
from bisect import bisect_left
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extraction import extract
from .history import correspond


def select_target(text: str, find: Callable[[str], list[dict]]) -> dict:
    """A handle ``SET:ORDINAL``, ``path:FILE`` or ``sym:NAME``; a name with several definitions gives them to choose from."""
    if re.fullmatch(r"[^:@\s]+:[1-9]\d*", text) and not text.startswith(("sym:", "path:")):
        return {"kind": "handle", "value": text}
    if text.startswith("path:") and len(text) > 5:
        return {"kind": "path", "value": text[5:]}
    if text.startswith("sym:") and len(text) > 4:
        found = find(text[4:])
        if not found:
            raise KeyError(text)
        return {"kind": "symbol", "value": found[0]} if len(found) == 1 else {"kind": "choose", "candidates": found}
    raise ValueError("a target is a handle, path:FILE or sym:NAME")


def declarations(bodies: DataFrame) -> DataFrame:
    """(file, path, bytes) -> (file, id, key, digest) of declarations, for ``history.correspond``."""

    @F.udf("array<struct<key:string,digest:string>>", useArrow=True)
    def read(path, data):
        import hashlib

        text = data.decode("utf-8", "replace")
        return [("/".join(filter(None, (d["container"], d["kind"], d["name"]))), hashlib.sha256(text[d["start"] : d["end"]].encode()).hexdigest()[:16]) for d in extract(path, data)["definitions"]]

    return bodies.select("file", F.posexplode(read("path", "bytes")).alias("n", "d")).select("file", F.col("n").cast("long").alias("id"), "d.key", "d.digest")


def symbol_history(versions: list[DataFrame], key: str) -> DataFrame:
    """(step, state) of one declaration through successive versions (file, path, bytes), newest first."""
    out = None
    for k in range(len(versions) - 1):
        old, new = declarations(versions[k + 1]), declarations(versions[k])
        m = correspond(old, new)
        ours = new.where(F.col("key") == key).select("file", F.col("id").alias("new_id"))
        gone = old.where(F.col("key") == key).select("file", F.col("id").alias("old_id"))
        step = m.join(ours, ["file", "new_id"], "left_semi").unionByName(m.where("new_id IS NULL").join(gone, ["file", "old_id"], "left_semi").select(*m.columns))
        step = step.select(F.lit(k).alias("step"), "file", "state")
        out = step if out is None else out.unionByName(step)
    return out


def cached_compare(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(changes of all wanted pairs, rows to add to the cache) for (before, after) pairs; only pairs that the cache lacks are computed."""
    key = ["before", "after"]
    fresh = compute(wanted.join(cache.select(*key).distinct(), key, "left_anti"))
    return cache.join(wanted.distinct(), key, "left_semi").unionByName(fresh.select(*cache.columns)), fresh


def member_config(text: str, most: int = 32) -> dict:
    """Configuration of members: ``[workspace]`` name and members, ``[members.NAME] path``; 1 to ``most``, no two roots the same or one inside another."""
    raw = tomllib.loads(text)
    members = {k: v["path"].rstrip("/") for k, v in raw.get("members", {}).items()}
    if not 1 <= len(members) <= most:
        raise ValueError(f"there must be 1 to {most} members")
    roots = sorted(members.values())
    for a, b in zip(roots, roots[1:]):
        if a == b or b.startswith(a + "/"):
            raise ValueError(f"roots overlap: {a}, {b}")
    ws = raw.get("workspace", {})
    order = ws.get("members", sorted(members))
    if unknown := set(order) - set(members):
        raise ValueError(f"unknown members: {sorted(unknown)}")
    return {"name": ws.get("name"), "members": members, "order": order, "budget": raw.get("output", {}).get("budget")}


def reextract(path: str, data: bytes, name: str, near: int) -> dict:
    """The definition of that name in current bytes, nearest to where it was; marked as not yet published."""
    return reextract_all(path, data, [(name, near)])[0]


def reextract_all(path: str, data: bytes, wanted: list[tuple[str, int]]) -> list[dict]:
    """``reextract`` for each (name, near) of one body, which is extracted once."""
    by: dict[str, list[dict]] = {}
    for d in extract(path, data)["definitions"]:
        by.setdefault(d["name"], []).append(d)
    starts: dict[str, list[int]] = {}
    out = []
    for name, near in wanted:
        if name not in by:
            raise KeyError(name)
        if name not in starts:
            by[name].sort(key=lambda d: d["start"])
            starts[name] = [d["start"] for d in by[name]]
        at = starts[name]
        k = bisect_left(at, near)
        # the first that starts there or after it, and the first of those that start last before it
        close = [by[name][i] for i in ([bisect_left(at, at[k - 1])] if k else []) + ([k] if k < len(at) else [])]
        out.append({**min(close, key=lambda d: (abs(d["start"] - near), d["start"])), "freshness": "unpublished"})
    return out


def documented_items(text: str, pattern: str) -> list[dict]:
    """Items (id, kind, path) of a documentation index in JSON whose path matches, in path order."""
    raw = json.loads(text)
    rx = re.compile(pattern)
    out = [{"id": k, "kind": v.get("kind"), "path": "::".join(v["path"])} for k, v in raw.get("paths", {}).items() if rx.search("::".join(v["path"]))]
    return sorted(out, key=lambda x: (x["path"], x["id"]))
