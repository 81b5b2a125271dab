"""Problem 5: credentials embedded in source code and configuration.

Configuration formats (JSON, YAML, TOML, INI, properties, env) are parsed into
key paths with the byte offsets of their values: nested and dotted keys, sequences, flow and inline collections,
block and multi-line strings.  In every file assignments,
headers, URLs, connection strings, key blocks and remarks are searched too.  A value
counts if the name it is given under is sensitive and its shape is that of a
secret, or if its own form says so (key block, signed token, credentials in a URL,
authorization header, vendor-prefixed random token).  A redaction overwrites
exactly the value's bytes with as many ``x``, so the body keeps its length, its
line ends and its syntax.

Everything is per body and map-only: no shuffle besides the lookup of paths.
Bodies are read as Latin-1, so a character is a byte and offsets are exact
whatever the encoding.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of a name that make what it holds a secret, and endings of names of things that only refer to one.
SENSITIVE = re.compile(
    r"(?i)(?<!com)(?<!by)(?<!tres)(?<!sur)(?<!over)(?<!under)pass(?:word|wd|phrase|code)?(?![a-z])|passw(?:or)?d|pwd|(?<![a-z])pw(?![a-z])|secret|token|api[_ -]?key|access[_ -]?key|signing[_ -]?key|private[_ -]?key|"
    r"secret[_ -]?key|encryption[_ -]?key|account[_ -]?key|credential|(?<![a-z])creds?(?![a-z])|(?<![a-z])auth(?![a-z])|bearer"
)
REFERS = re.compile(r"(?i)(?:hint|label|help|name|id|ref|from|path|kind|file|type|url|uri|count|length|len|index|field|prompt|placeholder|expiry|ttl|env|var|rev|revision|ver|version|hash|digest|checksum|prefix|suffix|pattern|regex|format|status|state|mode|scope|size|limit|age|date|time)s?(?:_?\d+)?(?:box)?_*$")
#: values that stand for a secret or for the place where it is kept
STAND_IN = re.compile(
    r"(?i)^(?:|.*change[_ -]?me.*|.*example.*|.*dummy.*|test\w{0,4}|pass(?:word|wd)?|secret|todo|tbd|none|null|true|false|x{3,}|[*•.#_-]+|.*redacted.*|.*hidden.*|<.*>|\$\{.*|\$\(.*|\$[A-Z_]+|%\w+%|\{\{.*|"
    r"your[_ -].*|.*replace[_ -]?me.*|.*not[_ -]a[_ -]real.*|insert[_ -].*|.*[_ -]here|env[:(.].*|vault:.*|secrets?/.*|/?run/secrets.*|sample.*|placeholder.*|fake.*|foo\w*|\[.*\]|\(.*\)|os\.environ.*|process\.env.*|getenv.*)$"
)
UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
DIGEST = re.compile(r"(?i)^(?:sha\d*|md5|blake\w*)[-:=]")
WORDS = re.compile(r"^(?:[a-z]+(?:[ ._/-]+[a-z]+)*[.!?]?|[A-Z]+(?:[ _-][A-Z]+)*|[A-Z]?[a-z]+(?:[A-Z][a-z]+)?)$")
HEX = re.compile(r"^[0-9a-fA-F]+$")

PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_MARK = re.compile(r"-----(?:END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?|BEGIN [A-Z0-9 ]+)-----")
#: a line of a key block: a header, or no word but base 64
KEY_LINE = re.compile(r"[^\w\n]*(?:[A-Za-z][A-Za-z-]*: .*|[A-Za-z0-9+/=]{1,15}[^\w\n]*)?$")
B64_RUN = re.compile(r"[A-Za-z0-9+/=]{16,}")
#: the short last line of a key
B64_REST = re.compile(r"(?m)^[^\nA-Za-z0-9]*([A-Za-z0-9][A-Za-z0-9+/=]{0,14})[^\nA-Za-z0-9]*$")
URL_USER = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`<>]*:([^\s@\"'`<>/]{3,})@[\w\[.-]")
URL_PARAM = re.compile(r"(?i)[?&](?:key|api_?key|access_?token|auth_?token|token|sig|signature|secret|client_secret|password|pwd|auth)=([A-Za-z0-9._~%+/=-]{12,})")
HEADER = re.compile(r"(?i)\bauthorization[\"']?\s*[:=]\s*[\"']?(?:bearer|basic|token|apikey|digest)\s+([A-Za-z0-9._~+/=-]{12,})")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.([A-Za-z0-9_-]{8,})")
CONN = re.compile(r"(?i)[;\"'`= ](?:pwd|password)\s*=\s*([^;\"'`\s]{4,})(?=;|[\"'`\s]|$)")
OPTION = re.compile(r"(?i)(?:--(?:token|password|pass|secret|api-?key|auth)[= ]|-u\s+[^\s:\"']+:|\bexport\s+\w*(?:pass|token|secret|key|pwd)\w*=[\"']?)([^\s\"'`;,]{6,})")
REMARK = re.compile(r"(?i)\b(?:password|passwd|passphrase|api[ _-]?key|access key|token|secret)(?: is)?:?\s+[\"'`]?([^\s\"'`,;<>]{8,})")
COMMENTED = re.compile(r"^\s*(?://|#|--|;|\*|/\*|<!--|- )|\s//\s")
#: vendor prefix + random part: letters, then _ - or . , or three or four capitals directly before it
PREFIXED = re.compile(r"(?<![A-Za-z0-9_./+-])((?:[a-z]{2,8}(?:[_-][a-z]{2,8}){0,2}[_-]|[a-z]{2,6}\.|[A-Z]{3,4}(?=[A-Za-z0-9]{17,}))([A-Za-z0-9]{16,64}))(?![A-Za-z0-9/+=_])")
ASSIGN = re.compile(r"([A-Za-z_$][\w.$-]*)([\"'`\]]?\s*(?::\s*&?'?[\w?<>\[\] ]{1,24}?\s*)?(?:=>|:=|=|:)\s*)(?:concat!\(\s*|\(\s*)?([\"'`])")
LITERAL = re.compile(r"([\"'`])((?:(?!\1)[^\\\n]|\\.)*)\1")
JOIN = re.compile(r"\s*(?:\+|\.\.?|,|&)?\s*")
TRIGGER = re.compile(r"(?i)pass|pwd|pw(?=[_\d\W]|box)|secret|token|key|cred|auth|bearer|://|-----begin|eyJ[a-z0-9]|-u ")
BARE = re.compile(r"^\s*(?:#|;|//)?\s*(?:export\s+)?(?:[-*]\s+)?([A-Za-z_][\w.-]*)\s*[:=]\s*([^\s\"'`#;][^\n\r]*?)\s*$")

FORMATS = {"json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "ini": "ini", "cfg": "ini", "conf": "ini", "properties": "ini", "env": "ini", "md": "text", "txt": "text"}


def mixed(v: str) -> bool:
    """Random-looking: several kinds of characters, changing often."""
    kinds = (any(map(str.islower, v))) + any(map(str.isupper, v)) + any(map(str.isdigit, v))
    if kinds < 2:
        return False
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in v]
    return sum(a != b for a, b in zip(kind, kind[1:])) * 4 >= len(v)


def is_secret_value(v: str, named: bool) -> bool:
    """The value's shape is that of a secret; ``named``: it stands under a sensitive name."""
    if len(v) < 6 or STAND_IN.match(v) or UUID.match(v) or DIGEST.match(v) or WORDS.match(v):
        return False
    if " " in v or "://" in v or v.startswith(("data:", "-----")) or v.isdigit() or v[0] == "/" and not mixed(v):
        return False
    if HEX.match(v):
        return named and len(v) >= 16 and any(map(str.isdigit, v))
    has_digit, has_upper, has_lower = any(map(str.isdigit, v)), any(map(str.isupper, v)), any(map(str.islower, v))
    symbol = any(not c.isalnum() and c not in "_-." for c in v)
    if named:
        return (has_digit and (has_upper or has_lower)) or (has_upper and has_lower and (symbol or mixed(v))) or symbol and has_digit
    return has_digit and has_upper and has_lower and (mixed(v) or symbol)


#: a quoted or plain scalar, or a sign, of a flow collection
_FLOW = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\n]|'')*)'|([{}\[\],])|([^\s{}\[\],"':=#](?:[^{}\[\],\n:=]|[:=](?![ \t"'\[{]|$))*)""")
_YAML_KEY = re.compile(r"""(?:"((?:[^"\\\n]|\\.)*)"|'([^'\n]*)'|([^\s#&*!|>'"%@`{}\[\],:-](?:[^:#\n]|:(?![ \t]|$)|(?<! )#)*?))[ \t]*:(?=[ \t]|$)""")
_YAML_PROPS = re.compile(r"(?:(?:!\S*|&\S+)[ \t]+)*")
_KEY = re.compile(r"""[ \t]*(?:export[ \t]+)?((?:"[^"\n]*"|'[^'\n]*'|[^\s#;=:\["'][^\s=:]*)(?:[ \t]*\.[ \t]*(?:"[^"\n]*"|'[^'\n]*'|[\w-]+))*)[ \t]*([:=])[ \t]*""")
_HEAD = re.compile(r"[ \t]*\[+([^\]\n]+)\]+[ \t]*(?:[#;].*)?$")


def _flow(text: str, at: int, end: int, path: str) -> Iterator[tuple[str, int, int]]:
    """Entries of a flow collection (``{a: b}``, ``{a = "b"}``, ``["a", "b"]``); it may go on over lines, up to where it closes."""
    stack, key = [], ""
    pos = at
    while pos < end and (m := _FLOW.search(text, pos, end)):
        pos = m.end()
        if m[3]:
            if m[3] in "{[":
                stack.append(key)
            elif m[3] in "}]":
                if stack:
                    key = stack.pop()
                if not stack:
                    return
            continue
        g = next(i for i in (1, 2, 4) if m[i] is not None)
        a, b = m.start(g), m.start(g) + len(m[g].rstrip() if g == 4 else m[g])
        after = re.compile(r"[ \t]*[:=]").match(text, m.end())
        if after:
            key, pos = text[a:b], after.end()
        elif stack:
            yield ".".join(x for x in (path, *stack[1:], key) if x), a, b


def _line_end(text: str, at: int) -> int:
    e = text.find("\n", at)
    e = len(text) if e < 0 else e
    return e - 1 if e > at and text[e - 1] == "\r" else e


def _scalar(text: str, at: int, path: str, comment: str) -> Iterator[tuple[str, int, int]]:
    """The value that begins at ``at``: multi-line, quoted or plain, or the entries of a flow collection."""
    end = _line_end(text, at)
    if text[at : at + 3] in ('"""', "'''"):
        close = text.find(text[at : at + 3], at + 3)
        stop = len(text) if close < 0 else close
        for m in re.compile(r"[^\s][^\n\r]*").finditer(text, at + 3, stop):
            yield path, m.start(), m.start() + len(m[0].rstrip(" \t\\"))
    elif text[at : at + 1] in ("{", "["):
        yield from _flow(text, at, len(text), path)
    elif text[at : at + 1] in ('"', "'", "`") and at < end:
        q = re.compile(r"([\"'`])((?:(?!\1)[^\\]|\\.)*)\1", re.S).match(text, at)
        if q:
            yield path, at + 1, at + 1 + len(q[2])
    elif at < end:
        v = re.sub(rf"[ \t]+[{comment}].*$", "", text[at:end]).rstrip()
        if v:
            yield path, at, at + len(v)


def _yaml(text: str) -> Iterator[tuple[str, int, int]]:
    parents: list[tuple[int, str]] = []
    at = 0
    while at < len(text):
        start, nl = at, text.find("\n", at)
        at = len(text) if nl < 0 else nl + 1
        end = _line_end(text, start)
        col = start
        while col < end and text[col] in " \t":
            col += 1
        if col >= end or text[col] == "#" or text.startswith(("---", "..."), start):
            continue
        item = False
        while text[col] == "-" and col + 1 < end and text[col + 1] in " \t":
            # an item of a sequence: what follows stands at its own column
            col += 1
            while col < end and text[col] in " \t":
                col += 1
            item = True
            if col >= end:
                break
        if col >= end:
            continue
        indent = col - start
        m = _YAML_KEY.match(text, col, end)
        if not m:
            if item:
                while parents and parents[-1][0] >= indent:
                    parents.pop()
                yield from _scalar(text, _YAML_PROPS.match(text, col, end).end(), ".".join(k for _, k in parents), "#")
            continue
        while parents and parents[-1][0] >= indent:
            parents.pop()
        key = next(x for x in (m[1], m[2], m[3]) if x is not None).strip()
        path = ".".join([*(k for _, k in parents), key])
        v = m.end()
        while v < end and text[v] in " \t":
            v += 1
        v = _YAML_PROPS.match(text, v, end).end()
        if v >= end or text[v] == "#":
            parents.append((indent, key))
        elif re.match(r"[|>][-+0-9]*[ \t]*(?:#.*)?$", text[v:end]):
            # block scalar: the following lines that stand further in
            while at < len(text):
                e = _line_end(text, at)
                c = at
                while c < e and text[c] in " \t":
                    c += 1
                if c < e and c - at <= indent - (2 if item else 0):
                    break
                if c < e:
                    yield path, c, c + len(text[c:e].rstrip())
                nl = text.find("\n", at)
                at = len(text) if nl < 0 else nl + 1
        else:
            yield from _scalar(text, v, path, "#")
            if text[v] in "{[":
                # further lines of the collection are part of it
                depth, i = 0, v
                for x in re.compile(r'"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|[{}\[\]]').finditer(text, v):
                    depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(x[0], 0)
                    i = x.end()
                    if depth <= 0:
                        break
                nl = text.find("\n", i)
                at = max(at, len(text) if nl < 0 else nl + 1)


def _lines(kind: str, text: str) -> Iterator[tuple[str, int, int]]:
    """TOML, INI, properties and env: sections, dotted keys, values that go on over lines."""
    section, at = "", 0
    while at < len(text):
        start, nl = at, text.find("\n", at)
        at = len(text) if nl < 0 else nl + 1
        end = _line_end(text, start)
        if m := _HEAD.match(text, start, end):
            section = re.sub(r"[\"' ]", "", m[1])
            continue
        if re.compile(r"[ \t]*(?:[#;!]|//)").match(text, start, end) or not (m := _KEY.match(text, start, end)):
            continue
        path = ".".join(x for x in (section, re.sub(r"[\"' ]", "", m[1])) if x)
        v = m.end()
        if kind == "ini" and text[v : v + 1] not in ('"', "'", "`"):
            # a value ends with its line unless that ends with a backslash
            while True:
                e = _line_end(text, v)
                more = e > v and text[e - 1] == "\\"
                x = text[v : e - 1 if more else e]
                x = (x if more else re.sub(r"[ \t]+[#;].*$", "", x)).rstrip()
                if x:
                    yield path, v, v + len(x)
                nl = text.find("\n", e)
                if not more or nl < 0:
                    break
                at = v = nl + 1
                nl = text.find("\n", at)
                at = len(text) if nl < 0 else nl + 1
                while v < len(text) and text[v] in " \t":
                    v += 1
        else:
            last = end
            for entry in _scalar(text, v, path, "#" if kind == "toml" else "#;"):
                last = max(last, entry[2])
                yield entry
            if last > end:
                nl = text.find("\n", last)
                at = len(text) if nl < 0 else nl + 1


def config_entries(kind: str, text: str) -> Iterator[tuple[str, int, int]]:
    """(key path, start, end) of the scalar values of a configuration text; offsets are of the value without quotes.

    A value of several lines gives an entry a line.  What isn't of the format is passed over.
    """
    if kind == "json":
        at = re.compile(r"\s*").match(text).end()
        while at < len(text):
            if text[at] in "{[":
                # several documents, one a line, count each
                depth, i = 0, at
                for x in re.compile(r'"(?:[^"\\\n]|\\.)*"|[{}\[\]]').finditer(text, at):
                    depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(x[0], 0)
                    i = x.end()
                    if depth <= 0:
                        break
                else:
                    i = len(text)
                yield from _flow(text, at, i, "")
                at = max(i, at + 1)
            else:
                nxt = re.compile(r"[{\[]").search(text, at)
                at = nxt.start() if nxt else len(text)
    elif kind == "yaml":
        yield from _yaml(text)
    else:
        yield from _lines(kind, text)


#: keys that say nothing of what they hold: the key above decides
_GENERIC = ("value", "data", "default", "key", "text", "str", "content", "current", "prod", "production")


def sensitive_path(path: str) -> bool:
    keys = path.split(".")
    return _sensitive(keys[-1]) or len(keys) > 1 and keys[-1].lower() in _GENERIC and _sensitive(keys[-2])


def _sensitive(name: str) -> bool:
    last = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    last = re.sub(r"_?\d+(?:_?Box)?$|_?Box$", "", last)
    return bool(SENSITIVE.search(last)) and not REFERS.search(last)


def _key_end(text: str, at: int, limit: int) -> int:
    """End of the last contiguous line of a key block that has no END; what follows BEGIN on its line belongs to it."""
    first = True
    while at < limit:
        nl = text.find("\n", at, limit)
        stop = limit if nl < 0 else nl + 1
        if not first and not KEY_LINE.match(re.sub(r"\\[nrt]", "", B64_RUN.sub("", text[at:stop])).rstrip("\n")):
            return at
        at, first = stop, False
    return at


def formats_of(path: str) -> str | None:
    return FORMATS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


def find(path: str | list[str], text: str) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, place) of the live credentials in a Latin-1 text, in order and without overlaps.

    ``path``: where the text stands, or the formats of all the places where it does.  A key block's span is its base-64 content; its place is that of its BEGIN line.
    """
    found: list[tuple[int, int, str, int]] = []
    for m in PEM.finditer(text):
        # up to END, or to another BEGIN or the last contiguous line of base 64 where END is missing
        end = PEM_MARK.search(text, m.end())
        stop = end.start() if end and end[0].startswith("-----END") else _key_end(text, m.end(), end.start() if end else len(text))
        runs = [r for r in B64_RUN.finditer(text, m.end(), stop)]
        if sum(len(r[0]) for r in runs) >= 64:
            found += [(r.start(), r.end(), "private_key", m.start() if i == 0 else -1) for i, r in enumerate(runs)]
            found += [(r.start(1), r.end(1), "private_key", -1) for r in B64_REST.finditer(text, runs[0].end(), stop)]
    kinds = {formats_of(path)} if isinstance(path, str) else set(path) or {None}
    code, prose = bool(kinds & {None, "code"}), "text" in kinds
    for fmt in sorted(k for k in kinds if k in ("json", "yaml", "toml", "ini")):
        for name, a, b in config_entries(fmt, text):
            if sensitive_path(name) and is_secret_value(text[a:b], True):
                found.append((a, b, "named", a))
    lines: set[tuple[int, int]] = set()
    for m in TRIGGER.finditer(text):
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.end())
        lines.add((a, len(text) if b < 0 else b))
    for a, b in lines:
        line = text[a:b]
        for rx, kind in ((URL_USER, "url_user"), (URL_PARAM, "url_parameter"), (HEADER, "header"), (JWT, "signed_token"), (CONN, "connection")):
            for m in rx.finditer(line):
                v = m[1]
                if kind == "header" and line[m.start() : m.start(1)].lower().rstrip().endswith("basic"):
                    try:
                        ok = b":" in base64.b64decode(v + "=" * (-len(v) % 4))
                    except (binascii.Error, ValueError):
                        ok = False
                else:
                    ok = kind == "signed_token" or is_secret_value(v, True)
                if ok and not STAND_IN.match(v):
                    found.append((a + m.start(1), a + m.end(1), kind, a + m.start(1)))
        for rx, kind in ((OPTION, "option"), (REMARK, "remark")):
            if kind == "remark" and not COMMENTED.search(line):
                continue
            for m in rx.finditer(line):
                if is_secret_value(m[1], kind == "option") or kind == "remark" and any(map(str.isdigit, m[1])) and any(map(str.isupper, m[1])) and is_secret_value(m[1], True) and not m[1].endswith(("(", ")")):
                    found.append((a + m.start(1), a + m.end(1), kind, a + m.start(1)))
        for m in ASSIGN.finditer(line):
            name = m[1]
            if name.lower() in ("text", "value", "default", "str"):
                name = (re.findall(r"[A-Za-z_]\w*", line[: m.start()].replace("public", "").replace("string", "").replace("const", "").replace("static", "")) or [""])[-1]
            if not _sensitive(name):
                continue
            parts, at = [], m.end() - 1
            while (x := LITERAL.match(line, at)):
                parts.append((x.start(2), x.end(2)))
                j = JOIN.match(line, x.end())
                at = j.end() if j else x.end()
            v = "".join(line[x:y] for x, y in parts)
            if parts and is_secret_value(v, True):
                found += [(a + x, a + y, "named", a + parts[0][0] if i == 0 else -1) for i, (x, y) in enumerate(parts)]
        if (code or prose) and (m := BARE.match(line)) and (prose or line.lstrip()[:1] in "#;/") and _sensitive(m[1]) and is_secret_value(m[2], True) and not m[2].endswith(("{", ";", ",")):
            found.append((a + m.start(2), a + m.end(2), "named", a + m.start(2)))
    for m in PREFIXED.finditer(text):
        if mixed(m[2]) and any(map(str.isdigit, m[2])) and any(map(str.isupper, m[2])) and any(map(str.islower, m[2])):
            found.append((m.start(1), m.end(1), "prefixed", m.start(1)))
    found.sort(key=lambda x: (x[0], -x[1]))
    out, reach = [], -1
    for a, b, kind, place in found:
        if a >= reach:
            out.append((a, b, kind, place))
            reach = b
        elif b > reach:
            out.append((reach, b, kind, -1))
            reach = b
    return out


def redact(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The body with the spans' bytes replaced by as many x; escapes such as ``\\n`` inside a span are kept."""
    out = bytearray(data)
    for a, b in spans:
        out[a:b] = re.sub(rb"(\\.)|[^\\]", lambda m: m[1] or b"x", data[a:b], flags=re.S)
    return bytes(out)


_FOUND = T.StructType(
    [T.StructField("revision", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]
)
_CLEAN = T.StructType([T.StructField("revision", T.StringType()), T.StructField("credentials", T.LongType()), T.StructField("redacted", T.BinaryType())])


def _scan(clean: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("revision", "formats", "bytes")]
            out: list[list] = [[] for _ in range(3 if clean else 5)]
            for rev, formats, body in zip(cols[0].to_pylist(), cols[1].to_pylist(), cols[2]):
                data = body.as_py()
                if data is None:
                    continue
                text = data.decode("latin-1")
                spans = find(formats or [], text)
                if clean:
                    row = (rev, sum(p >= 0 for _, _, _, p in spans), redact(data, [(a, b) for a, b, _, _ in spans]))
                    for col, x in zip(out, row):
                        col.append(x)
                    continue
                line, at = 1, 0
                for a, b, kind, place in sorted((s for s in spans if s[3] >= 0), key=lambda s: s[3]):
                    line, at = line + text.count("\n", at, place), place
                    for col, x in zip(out, (rev, line, a, b, kind)):
                        col.append(x)
            kinds = (pa.string(), pa.int64(), pa.binary()) if clean else (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=(_CLEAN if clean else _FOUND).names)

    return scan


def _with_formats(files: DataFrame, contents: DataFrame) -> DataFrame:
    """Each body once, with the formats of all paths that any row of ``files``, old ones too, gives it (null if none): at most one of each."""
    ext = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    kind = F.lit("code")
    for name in sorted(set(FORMATS.values())):
        kind = F.when(ext.isin([e for e, f in FORMATS.items() if f == name]), name).otherwise(kind)
    formats = files.where("revision IS NOT NULL").select("revision", F.when(F.col("path").isNotNull(), kind).otherwise("code").alias("format"))
    formats = formats.groupBy("revision").agg(F.collect_set("format").alias("formats"))
    bodies = contents.select("revision", "bytes").where("bytes IS NOT NULL")
    return bodies.join(formats.hint("shuffle_hash"), "revision", "left")


def credentials(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(revision, line_no, start, end, kind): each credential's first line and the byte span of its value.

    All bodies are read, also those that no current file points to.  Null and
    empty bodies give no row; a null path is read as code, and a body of several paths as each of their formats.  Extra columns are ignored.
    """
    return _with_formats(files, contents).mapInArrow(_scan(False), _FOUND).dropDuplicates(["revision", "start"])


def redacted(files: DataFrame, contents: DataFrame) -> DataFrame:
    """(revision, credentials, redacted): every body with its credentials overwritten, length unchanged."""
    return _with_formats(files, contents).mapInArrow(_scan(True), _CLEAN)
