"""Path and name functions: percent-encoding, classes of paths, languages."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical languages and their aliases, extensions.
LANGUAGES = {
    "rust": ["rust", "rs"],
    "typescript": ["typescript", "ts", "tsx"],
    "javascript": ["javascript", "js", "jsx"],
    "csharp": ["csharp", "c#", "cs"],
    "php": ["php"],
    "luau": ["luau", "lua"],
    "dreammaker": ["dreammaker", "dm", "byond"],
    "text": ["text", "txt"],
}
_SAFE = re.compile(rb"[!-~]")


def canonical_language(value: str) -> str:
    """Canonical name of a language or alias, whatever its case; an unknown one is an error."""
    v = value.strip().lower()
    for name, alias in LANGUAGES.items():
        if v in alias:
            return name
    raise ValueError(f"unknown language {value!r}; known: {', '.join(LANGUAGES)}")


def language_column(language: Column) -> Column:
    """Canonical language of a column, null where it is null or unknown."""
    v = F.lower(F.trim(language))
    out = None
    for name, alias in LANGUAGES.items():
        out = F.when(v.isin(alias), name) if out is None else out.when(v.isin(alias), name)
    return out


def encode_path(raw: bytes) -> str:
    """Bytes outside printable ASCII, and ``% : @``, as %HH."""
    return "".join(chr(b) if 0x21 <= b <= 0x7E and b not in b"%:@" else f"%{b:02X}" for b in raw)


def decode_path(text: str) -> bytes:
    return unquote_to_bytes(text)


def encode_value(value: str) -> str:
    """A user's path value: leading ./ dropped, valid %HH kept in upper case, the rest encoded."""
    while value.startswith("./"):
        value = value[2:]
    parts = re.split(r"(%[0-9A-Fa-f]{2})", value)
    return "".join(p.upper() if re.fullmatch(r"%[0-9A-Fa-f]{2}", p) else encode_path(p.encode()) for p in parts)


def is_test_path(path: Column) -> Column:
    """Whether a path follows a convention for tests (ASCII case)."""
    p = F.lower(path)
    name = F.substring_index(p, "/", -1)
    stem = F.substring_index(name, ".", 1)
    in_dir = p.rlike(r"(^|/)(tests|__tests__|spec|testdata)/") | p.rlike(r"(^|/)test/(?!src/)[^/]+")
    named = (stem == "tests") | stem.endswith("_tests") | name.contains(".test.") | name.contains(".spec.")
    return in_dir | named | name.rlike(r"_test\.(go|py)$") | name.rlike(r"^test_.*\.py$") | name.rlike(r"_spec\.rb$")


def is_test_name(path: str) -> bool:
    """``is_test_path`` of one path."""
    p = path.lower()
    name = p.rsplit("/", 1)[-1]
    stem = name.split(".", 1)[0]
    parts = p.split("/")
    in_dir = any(x in ("tests", "__tests__", "spec", "testdata") for x in parts[:-1]) or any(x == "test" and y != "src" for x, y in zip(parts[:-1], parts[1:]))
    named = stem == "tests" or stem.endswith("_tests") or ".test." in name or ".spec." in name
    return in_dir or named or name.endswith(("_test.go", "_test.py", "_spec.rb")) or name.startswith("test_") and name.endswith(".py")


def is_doc_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(md|markdown)$")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_predicate(path: Column, value: str, anchored: bool) -> Column:
    """Prefix of the path, or of any of its components if the value is not anchored at the root."""
    hit = path.startswith(value)
    return hit if anchored else hit | path.contains("/" + value)


def module_segments(path: Column) -> Column:
    """Directories and stem of a path without the names that stand for their directory, '-' read as '_'."""
    parts = F.split(F.regexp_replace(path, r"\.[^./]*$", ""), "/")
    kept = F.filter(parts, lambda x: ~x.isin("src", "mod", "lib", "main", "index"))
    return F.transform(kept, lambda x: F.replace(x, F.lit("-"), F.lit("_")))
