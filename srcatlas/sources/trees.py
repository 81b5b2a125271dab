"""Sources: directory trees with ignore rules, git logs and trees, as Python data sources; bodies are read on executors."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.paths import encode_path
from ..operators.corpus import MAX_FILE

PRUNED = {".git", "target", "node_modules"}


class Ignore:
    """Rules of one ignore file, as git reads them: last match wins, ``!`` takes back, ``/`` anchors, a final ``/`` means directories."""

    def __init__(self, base: str, text: str):
        self.base, self.rules = base, []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            body = line[1:] if keep else line
            only_dir, anchored = body.endswith("/"), "/" in body.rstrip("/")
            self.rules.append((body.strip("/"), keep, only_dir, anchored))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        rel = path[len(self.base) :].lstrip("/") if self.base else path
        out = None
        for pattern, keep, only_dir, anchored in self.rules:
            if only_dir and not is_dir:
                continue
            hit = _glob(pattern, rel) if anchored else fnmatch.fnmatchcase(rel.rsplit("/", 1)[-1], pattern)
            if hit:
                out = not keep
        return out


def _glob(pattern: str, path: str) -> bool:
    rx = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return re.fullmatch(rx, path) is not None


def walk(root: str) -> tuple[list[tuple[str, int | None]], int]:
    """(sorted (path, size) of the files that no rule ignores, walk failures): hidden files too, links not followed."""
    out: list[tuple[str, int | None]] = []
    failures = 0
    stack: list[tuple[str, list[Ignore]]] = [("", [])]
    while stack:
        rel, rules = stack.pop()
        full = os.path.join(root, rel) if rel else root
        try:
            entries = sorted(os.scandir(full), key=lambda e: e.name)
        except OSError:
            failures += 1
            continue
        for e in entries:
            if e.name in (".gitignore", ".ignore") and e.is_file(follow_symlinks=False):
                try:
                    with open(e.path, encoding="utf-8", errors="replace") as f:
                        rules = [*rules, Ignore(rel, f.read())]
                except OSError:
                    failures += 1
        for e in entries:
            path = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink():
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            verdicts = [v for r in rules if (v := r.verdict(path, is_dir)) is not None]
            if verdicts and verdicts[-1] or e.name in PRUNED:
                continue
            if is_dir:
                stack.append((path, rules))
            else:
                try:
                    out.append((path, e.stat(follow_symlinks=False).st_size))
                except OSError:
                    out.append((path, None))
    return sorted(out), failures


class _Part(InputPartition):
    def __init__(self, rows: list):
        self.rows = rows


class TreeSource(DataSource):
    """``format("srcatlas_tree")``: (path, length, bytes, status) of a tree, option ``path``; files are read where they are needed."""

    @classmethod
    def name(cls) -> str:
        return "srcatlas_tree"

    def schema(self) -> str:
        return "path string, length bigint, bytes binary, status string"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options["path"], int(self.options.get("files_per_part", "500")))


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, per: int):
        self.root, self.per = root, per

    def partitions(self) -> list[InputPartition]:
        found, _ = walk(self.root)
        return [_Part(found[i : i + self.per]) for i in range(0, len(found), self.per)] or [_Part([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path, size in partition.rows:
            shown = encode_path(os.fsencode(path))
            if size is None:
                yield shown, None, None, "metadata_error"
            elif size > MAX_FILE:
                yield shown, size, None, "resource_excluded"
            else:
                try:
                    with open(os.path.join(self.root, path), "rb") as f:
                        data = f.read(MAX_FILE + 1)
                except OSError:
                    yield shown, size, None, "read_error"
                    continue
                if len(data) > MAX_FILE:
                    yield shown, len(data), None, "resource_excluded"
                elif b"\0" in data:
                    yield shown, len(data), None, "binary_excluded"
                else:
                    yield shown, len(data), data, "read"


def _git(root: str, *args: str, seconds: int = 15) -> bytes:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=seconds).stdout


def parse_log(raw: bytes) -> list[tuple[int, str, str | None, int, str]]:
    """(depth, oid, first parent, time, summary) of ``git log -z --format=%H%x1f%P%x1f%ct%x1f%s``."""
    out = []
    for i, rec in enumerate(x for x in raw.decode("utf-8", "replace").split("\0") if x):
        oid, parents, when, summary = rec.strip("\n").split("\x1f", 3)
        out.append((i, oid, parents.split(" ")[0] or None, int(when), summary))
    return out


def parse_tree(raw: bytes) -> list[tuple[str, str, str]]:
    """(path, oid, mode) of ``git ls-tree -rz``."""
    out = []
    for rec in raw.split(b"\0"):
        if rec:
            head, _, path = rec.partition(b"\t")
            mode, _, oid = head.decode().split(" ")
            out.append((encode_path(path), oid, mode))
    return out


class GitSource(DataSource):
    """``format("srcatlas_git")``: option ``what`` is ``log`` (depth, oid, parent, commit_time, summary) or ``tree`` (path, oid, mode) of option ``revision``."""

    @classmethod
    def name(cls) -> str:
        return "srcatlas_git"

    def schema(self) -> str:
        return "depth int, oid string, parent string, commit_time bigint, summary string" if self.options.get("what", "log") == "log" else "path string, oid string, mode string"

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(self.options))


class _GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options

    def read(self, partition) -> Iterator[tuple]:
        root, rev = self.o["path"], self.o.get("revision", "HEAD")
        if rev.startswith("-"):
            raise ValueError("a revision may not look like an option")
        if self.o.get("what", "log") == "log":
            yield from parse_log(_git(root, "log", "-z", "--first-parent", f"--max-count={int(self.o.get('most', '20000'))}", "--format=%H%x1f%P%x1f%ct%x1f%s", rev))
        else:
            yield from parse_tree(_git(root, "ls-tree", "-rz", rev))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(GitSource)


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """Tree of a shared folder through Spark's own reader, without ignore rules: for lakes rather than checkouts."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", "length", F.col("content").alias("bytes"), F.col("modificationTime").alias("observed_at"))
