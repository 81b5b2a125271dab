"""Extraction of definitions, occurrences, relationships and modules from source, one file in, facts out.

A body is read as Latin-1, so a character is a byte and every span is one of the original bytes; names are turned back
into UTF-8.  A lexer by language family gives tokens without comments and strings; a structural walk over matched brackets (block words in Luau,
indentation in DreamMaker) finds declarations, their extents, the scopes they open and the bindings within; names are then resolved
through these scopes.  It recovers from damage, so the status is never more than ``recovered``; where brackets don't
match it is ``recovered_incomplete`` and no name has a target.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_FACTS = 50_000
#: rows of facts that a worker gathers before it hands them on
AT_ONCE = 4096
FACTS = ("file", "definition", "occurrence", "relationship", "module")
CAP = 64
FAMILY = {"rs": "rust", "ts": "script", "tsx": "script", "mts": "script", "cts": "script", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "cs": "csharp", "php": "php", "phtml": "php", "lua": "luau", "luau": "luau", "dm": "dreammaker"}

_W = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
_OPS = r"\.\.\.|\?->|=>|->|::|\?\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\.\.|\+\+|--|[-+*/%&|^.]=|[^\sA-Za-z0-9_\x80-\xff]"
_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_C = r"//[^\n]*|/\*[\s\S]*?\*/"


def _lexer(skip: str, string: str, word: str = _W) -> re.Pattern:
    return re.compile(f"(?P<c>{skip})|(?P<s>{string})|(?P<w>{word})|(?P<n>[0-9][A-Za-z0-9_.]*)|(?P<p>{_OPS})")


_LEX = {
    "rust": _lexer(_C, r'b?r(?P<h>#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*"|b?\'(?:[^\'\\\n]|\\[^\n\']{1,10}|\\\')\'', "'?" + _W + "|r#" + _W),
    "script": _lexer(_C + r"|\A#![^\n]*", _DQ + "|" + _SQ + r"|`(?:[^`\\]|\\[\s\S])*`", "#?[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*"),
    "csharp": _lexer(_C + r"|(?m:^[ \t]*#[^\n]*)", r'"""[\s\S]*?"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?' + _DQ + "|" + _SQ, "@?" + _W),
    "php": _lexer(r"\A(?:(?!<\?)[\s\S])*(?:<\?(?:php\b|=)?|\Z)|\?>[\s\S]*?(?:<\?(?:php\b|=)|\Z)|//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/", r"<<<[ \t]*(?P<q>[\"']?)(?P<h>" + _W + r")(?P=q)\r?\n[\s\S]*?\n[ \t]*(?P=h)\b|" + r'"(?:[^"\\]|\\[\s\S])*"|' + r"'(?:[^'\\]|\\[\s\S])*'", r"\$+" + _W + r"|\\?" + _W + r"(?:\\" + _W + ")*"),
    "luau": _lexer(r"--\[(?P<g>=*)\[[\s\S]*?\](?P=g)\]|--[^\n]*", r"\[(?P<h>=*)\[[\s\S]*?\](?P=h)\]|" + _DQ + "|" + _SQ + r"|`(?:[^`\\]|\\[\s\S])*`"),
}
_KEYWORDS = {
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while union".split(),
    "script": "abstract any as async await boolean break case catch class const continue declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface keyof let namespace never new null number of private protected public readonly return satisfies set static string super switch this throw true try type typeof undefined unknown var void while yield".split(),
    "csharp": "abstract as async await base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach get goto if implicit in init int interface internal is lock long namespace new null object operator out override params partial private protected public readonly record ref return sbyte sealed set short sizeof static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using value var virtual void volatile when where while yield".split(),
    "php": "abstract and array as break case catch class const continue declare default do echo else elseif enum extends false final finally fn for foreach function global if implements include include_once instanceof insteadof interface isset list match mixed namespace new null or parent print private protected public readonly require require_once return self static string int bool float switch throw trait true try unset use void while xor yield".split(),
    "luau": "and break continue do else elseif end export false for function if in local nil not or repeat return self then true type until while".split(),
}
_KEYWORDS = {k: frozenset(v) for k, v in _KEYWORDS.items()}
_TYPE_WORDS = {"class", "struct", "interface", "trait", "enum", "union", "record"}
_MODIFIERS = frozenset("pub export default async public private protected internal static sealed abstract final override virtual readonly unsafe extern partial declare const new required file get set accessor".split())
_TYPES = ("class", "struct", "interface", "trait", "enum", "union", "record", "impl")


def resolve_scope(bindings: Iterable[dict], name: str, at: int, cap: int = CAP, barrier: int = 0) -> tuple[int | None, list[int]]:
    """(target, candidates) of a name at an offset among bindings (id, name, start, end, visible[, blocks, local]).

    The innermost scope with a visible binding decides, there the latest visible; two that are equal leave it open and are the
    candidates.  A binding that ``blocks`` hides outer ones even before it is visible; a ``local`` one of a scope
    that begins before ``barrier`` - outside the function at hand - is not seen.
    """
    around = [b for b in bindings if b["name"] == name and b["start"] <= at < b["end"] and not (b.get("local") and b["start"] < barrier)]
    for span in sorted({(b["end"] - b["start"], -b["start"]) for b in around}):
        here = [b for b in around if (b["end"] - b["start"], -b["start"]) == span]
        seen = [b for b in here if b["visible"] <= at]
        if seen:
            last = max(b["visible"] for b in seen)
            same = sorted(b["id"] for b in seen if b["visible"] == last)
            return (same[0], []) if len(same) == 1 else (None, same[:cap])
        if any(b.get("blocks") for b in here):
            return None, []
    return None, []


class _Walk:
    """Tokens of one body, what has been found in it, and what all families share."""

    def __init__(self, family: str, text: str):
        self.family, self.text, self.keywords = family, text, _KEYWORDS.get(family, frozenset())
        self.t, self.s, self.e, self.k = [], [], [], []
        for m in _LEX[family].finditer(text):
            if m["c"] is None:
                self.t.append(m[0])
                self.s.append(m.start())
                self.e.append(m.end())
                self.k.append("s" if m["s"] is not None else "w" if m["w"] is not None else "n" if m["n"] is not None else "p")
        self.n = len(self.t)
        self.match, self.sound = self._brackets()
        self.defs: list[dict] = []
        self.occ: list[dict] = []
        self.rel: list[dict] = []
        self.mods: list[dict] = []
        self.bindings: dict[str, list[dict]] = {}
        self.functions: list[tuple[int, int]] = []
        self.taken: set[int] = set()
        self.depth = 0

    def _brackets(self) -> tuple[list[int], bool]:
        match, stack, sound, close = [-1] * self.n, [], True, {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.t):
            if self.k[i] != "p":
                continue
            if t in "([{":
                stack.append(i)
            elif t in ")]}":
                # a closer without its opener is passed over; openers it skips end where it stands
                while stack and self.t[stack[-1]] != close[t] and any(self.t[x] == close[t] for x in stack):
                    match[stack.pop()], sound = i, False
                if stack and self.t[stack[-1]] == close[t]:
                    match[stack[-1]], match[i] = i, stack[-1]
                    stack.pop()
                else:
                    sound = False
        for i in stack:
            match[i], sound = self.n - 1, False
        return match, sound

    @staticmethod
    def utf8(name: str) -> str:
        return name if name.isascii() else name.encode("latin-1").decode("utf-8", "replace")

    def is_word(self, i: int) -> bool:
        return 0 <= i < self.n and self.k[i] == "w"

    def is_name(self, i: int) -> bool:
        return self.is_word(i) and self.t[i] not in self.keywords

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < self.n and self.k[i] != "s" else ""

    def first(self, i: int, j: int, stops: str | tuple) -> int:
        """The next token of ``stops`` at this nesting from i on, or j."""
        while i < j:
            t = self.at(i)
            if t in stops:
                return i
            i = self.match[i] + 1 if t in ("(", "[", "{") and self.match[i] > i else i + 1
        return j

    def generics(self, i: int, j: int) -> int:
        """After ``<...>`` at i, if it stands there."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < j:
            t = self.at(i)
            depth += (t == "<") - (t == ">")
            if t in ("(", "[", "{") and self.match[i] > i:
                i = self.match[i]
            if t in (";", "{") and depth:
                return i
            i += 1
            if depth == 0:
                return i
        return j

    def define(self, i: int, kind: str, start: int, end: int, owner: str | None, scope: tuple[int, int] | None = None, visible: int | None = None, blocks: bool = False, local: bool = False, name: str | None = None, **more: object) -> int:
        """A definition named by token i; ``scope``: the offsets within which its name is bound."""
        self.taken.add(i)
        name = self.utf8(name or self.t[i])
        d = {"name": name, "kind": kind, "start": start, "end": end, "container": owner, "name_start": self.s[i], "name_end": self.e[i], **more}
        self.defs.append(d)
        k = len(self.defs) - 1
        self.occ.append({"name": name, "role": "declaration", "start": self.s[i], "end": self.e[i], "target": k, "candidates": []})
        if scope is not None:
            self.bindings.setdefault(name, []).append({"id": k, "name": name, "start": scope[0], "end": scope[1], "visible": scope[0] if visible is None else visible, "blocks": blocks, "local": local})
        return k

    def use(self, i: int, role: str, name: str | None = None, resolve: bool = True) -> None:
        name = self.utf8(name or self.t[i])
        self.taken.add(i)
        self.occ.append({"name": name, "role": role, "start": self.s[i], "end": self.e[i], "target": None, "candidates": [], "resolve": resolve})

    def relate(self, source: int, kind: str, i: int, name: str | None = None) -> None:
        self.rel.append({"source": source, "kind": kind, "name": self.utf8(name or self.t[i]), "start": self.s[i], "end": self.e[i]})

    def module(self, i: int, spelled: str | None = None) -> None:
        self.mods.append({"spelled": self.utf8(spelled if spelled is not None else self.t[i].strip("\"'`")), "start": self.s[i]})
        self.taken.add(i)

    def begin(self, i: int, least: int) -> int:
        """The token with which the declaration at i begins, its modifiers included."""
        while i - 1 >= least and (self.at(i - 1) in _MODIFIERS or self.at(i - 1) == ")" and self.at(self.match[i - 1] - 1) == "pub"):
            i = self.match[i - 1] - 1 if self.at(i - 1) == ")" else i - 1
        return i

    def pattern(self, a: int, b: int) -> list[int]:
        """Name tokens that a destructuring pattern binds: no keys, no defaults, no types."""
        out, i = [], a
        while i < b:
            t = self.at(i)
            if t == "=":
                i = self.first(i + 1, b, (",", "}", "]", ")"))
                continue
            if self.is_name(i) and self.at(i + 1) != ":" and self.at(i - 1) != ".":
                out.append(i)
            i += 1
        return out

    def parts(self, a: int, b: int) -> list[tuple[int, int]]:
        out, i = [], a
        while i < b:
            j = self.first(i, b, (",",))
            if j > i:
                out.append((i, j))
            i = j + 1
        return out

    def finish(self) -> None:
        """Names that no declaration took become calls, reads and writes; then all are resolved."""
        for i in range(self.n):
            if i in self.taken or not self.is_name(i):
                continue
            before, after = self.at(i - 1), self.at(i + 1)
            if self.family == "rust" and self.t[i].startswith("'"):
                continue
            member = before in ("->", "?.", "?->") or before == "." and self.family != "php" or before == ":" and self.family == "luau" and after == "("
            path = before == "::" or before == "\\"
            call = after == "(" or after == "!" and self.family == "rust" and self.at(i + 2) in ("(", "[", "{") or after == "::" and self.at(i + 2) == "<"
            key = after == ":" and before in ("{", ",") and self.family == "script"
            role = "key" if key else "call" if call else "write" if after == "=" and before in (";", "{", "}", "", "(") else "read"
            if role != "key":
                self.use(i, role, resolve=not member and not path)
        for o in self.occ:
            if o.pop("resolve", False) and self.sound:
                inner = max((a for a, b in self.functions if a <= o["start"] < b), default=0) if self.family == "rust" else 0
                o["target"], o["candidates"] = resolve_scope(self.bindings.get(o["name"], ()), o["name"], o["start"], CAP, inner)
        if not self.sound:
            for o in self.occ:
                o["target"] = None

    # declarations that several families have in the same form

    def parameters(self, a: int, b: int, scope: tuple[int, int], visible: int) -> None:
        """Parameters between the brackets: the name comes first, or is the variable, or in C# comes last."""
        for x, y in self.parts(a, b):
            if self.at(x) in ("{", "["):
                names = self.pattern(x + 1, self.match[x])
            elif self.family == "php":
                names = [i for i in range(x, y) if self.t[i].startswith("$")][:1]
            elif self.family == "csharp":
                stop = self.first(x, y, ("=",))
                names = [i for i in range(x, stop) if self.is_name(i) and self.at(i + 1) not in ("<", ".", "?", "[")][-1:]
            elif self.family == "rust":
                names = [i for i in range(x, self.first(x, y, (":",))) if self.is_name(i) and self.t[i][:1].islower() or self.is_name(i) and self.t[i][:1] == "_"]
            else:
                names = [i for i in range(x, y) if self.is_name(i)][:1]
            for i in names:
                self.define(i, "parameter", self.s[i], self.e[i], None, scope, visible, local=True)


class _Rust(_Walk):
    def walk(self, i: int, j: int, scope: tuple[int, int], owner: str | None = None, held: str = "") -> None:
        self.depth += 1
        least = i
        while i < j:
            t = self.at(i)
            if t == "#" and self.at(i + 1) in ("[", "!"):
                k = i + (2 if self.at(i + 1) == "!" else 1)
                i = self.match[k] + 1 if self.at(k) == "[" and self.match[k] > k else i + 1
            elif t == "fn" and self.is_word(i + 1):
                i = self.function(i, j, scope, owner, held, least)
            elif t in ("struct", "enum", "union", "trait", "mod") and self.is_name(i + 1):
                i = self.type(i, j, scope, owner, least)
            elif t == "impl" and held != "code":
                i = self.implementation(i, j, least)
            elif t in ("const", "static", "type") and (self.is_name(i + 1) or self.at(i + 1) == "mut" and self.is_name(i + 2)):
                name = i + (2 if self.at(i + 1) == "mut" else 1)
                stop = self.first(name, j, (";", "}"))
                kind = "constant" if t != "type" else "type"
                self.define(name, kind, self.s[self.begin(i, least)], self.e[min(stop, self.n - 1)], owner, scope if held != "type" else None)
                i = name + 1
            elif t == "macro_rules" and self.at(i + 1) == "!":
                body = i + 3
                end = self.match[body] if self.at(body) in ("{", "(", "[") else body
                self.define(i + 2, "macro", self.s[i], self.e[min(end, self.n - 1)], owner, scope)
                i = end + 1
            elif t == "use":
                i = self.imports(i, j, scope)
            elif t == "let":
                i = self.let(i, j, scope)
            elif t == "for" and held == "code":
                stop = self.first(i + 1, j, ("in", "{", ";"))
                body = self.first(stop, j, ("{",))
                if self.at(stop) == "in" and body < j:
                    self.bind(i + 1, stop, (self.s[body], self.e[self.match[body]]))
                i = stop
            elif t in ("|", "||") and (self.at(i - 1) in ("(", ",", "=", "=>", "move", "return", "{", ";", "")):
                stop = i if t == "||" else self.first(i + 1, j, ("|",))
                body = stop + 1
                end = self.match[body] if self.at(body) == "{" and self.match[body] > body else self.first(body, j, (",", ";")) - 1
                if stop < j and end < self.n:
                    for x, y in self.parts(i + 1, stop):
                        self.bind(x, self.first(x, y, (":",)), (self.s[i], self.e[max(end, stop)]), "parameter")
                i = stop + 1
            elif t in ("(", "[", "{"):
                end = self.match[i] if self.match[i] > i else j
                if self.depth < 200:
                    self.walk(i + 1, min(end, j), (self.s[i], self.e[min(end, self.n - 1)]) if t == "{" else scope, None, "code" if t == "{" and held != "type" else held)
                i = end + 1
            else:
                i += 1
            if t in (";", "}"):
                least = i
        self.depth -= 1

    def bind(self, a: int, b: int, scope: tuple[int, int], kind: str = "variable") -> None:
        for i in range(a, b):
            if self.is_name(i) and (self.t[i][:1].islower() or self.t[i][:1] == "_") and self.at(i + 1) not in ("(", "{", "::", "!") and self.at(i - 1) not in ("::", "."):
                self.define(i, kind, self.s[i], self.e[i], None, scope, local=True)

    def function(self, i: int, j: int, scope: tuple[int, int], owner: str | None, held: str, least: int) -> int:
        p = self.generics(i + 2, j)
        if self.at(p) != "(":
            return i + 2
        close = self.match[p]
        body = self.first(close + 1, j, ("{", ";"))
        end = self.match[body] if self.at(body) == "{" else body
        end = min(end, self.n - 1)
        method = owner is not None and held == "type"
        self.define(i + 1, "method" if method else "function", self.s[self.begin(i, least)], self.e[end], owner, None if method else scope)
        inside = (self.s[p], self.e[end])
        self.functions.append(inside)
        self.parameters(p + 1, close, inside, self.s[min(body, self.n - 1)])
        if self.at(body) == "{" and self.depth < 200:
            self.walk(body + 1, end, (self.s[body], self.e[end]), None, "code")
        return end + 1

    def type(self, i: int, j: int, scope: tuple[int, int], owner: str | None, least: int) -> int:
        kind, name = ("module" if self.t[i] == "mod" else self.t[i]), i + 1
        body = self.first(self.generics(name + 1, j), j, ("{", ";"))
        end = min(self.match[body] if self.at(body) == "{" else body, self.n - 1)
        k = self.define(name, kind, self.s[self.begin(i, least)], self.e[end], owner, scope)
        if self.at(body) != "{":
            return end + 1
        if kind in ("trait", "module"):
            if kind == "trait" and self.at(name + 1) == ":":
                for x in range(name + 2, body):
                    if self.is_name(x) and self.at(x + 1) != "::":
                        self.relate(k, "extends", x)
            self.walk(body + 1, end, (self.s[body], self.e[end]), self.utf8(self.t[name]), "type" if kind == "trait" else "")
        else:
            for a, b in self.parts(body + 1, end):
                while self.at(a) == "#" and self.at(a + 1) == "[":
                    a = self.match[a + 1] + 1
                f = next((x for x in range(a, b) if self.is_name(x)), None)
                if f is not None and (kind == "enum" or self.at(f + 1) == ":"):
                    self.define(f, "variant" if kind == "enum" else "field", self.s[a], self.e[b - 1], self.utf8(self.t[name]))
        return end + 1

    def implementation(self, i: int, j: int, least: int) -> int:
        a = self.generics(i + 1, j)
        body = self.first(a, j, ("{", ";"))
        where = next((x for x in range(a, body) if self.at(x) == "where"), body)
        mark = next((x for x in range(a, where) if self.at(x) == "for" and self.at(x + 1) != "<"), None)
        names = lambda x, y: [z for z in range(x, y) if self.is_name(z) and self.at(z + 1) != "::"]
        of = names(mark + 1 if mark else a, where)[:1]
        if not of or self.at(body) != "{":
            return body + 1
        end = min(self.match[body], self.n - 1)
        owner = self.utf8(self.t[of[0]])
        self.use(of[0], "type")
        k = len(self.defs)
        self.defs.append({"name": owner, "kind": "impl", "start": self.s[self.begin(i, least)], "end": self.e[end], "container": None, "name_start": self.s[of[0]], "name_end": self.e[of[0]]})
        if mark and (trait := names(a, mark)[:1]):
            self.use(trait[0], "implements")
            self.relate(k, "implements", trait[0])
        self.walk(body + 1, end, (self.s[body], self.e[end]), owner, "type")
        return end + 1

    def imports(self, i: int, j: int, scope: tuple[int, int]) -> int:
        stop = self.first(i + 1, j, (";",))
        k = i + 1
        head = []
        while k < stop and self.at(k) not in ("{", "*"):
            head.append(self.t[k])
            k += 1
        self.module(i, "".join(head).removesuffix("::"))
        for x in range(i + 1, stop):
            if self.is_name(x) and self.at(x + 1) in (",", ";", "}") or self.is_name(x) and x + 1 == stop:
                self.define(x, "import", self.s[x], self.e[x], None, scope)
            elif self.is_word(x):
                self.taken.add(x)
        return stop + 1

    def let(self, i: int, j: int, scope: tuple[int, int]) -> int:
        stop = self.first(i + 1, j, ("=", ":", ";"))
        conditional = self.at(i - 1) in ("if", "while", "&&")
        if conditional:
            body = self.first(stop, j, ("{",))
            end = self.match[body] if body < j else stop
            inside = (self.s[min(body, self.n - 1)], self.e[min(end, self.n - 1)])
            self.bind(i + 1, stop, inside)
        else:
            end = self.first(stop, j, (";",))
            for x in range(i + 1, stop):
                if self.is_name(x) and (self.t[x][:1].islower() or self.t[x][:1] == "_") and self.at(x + 1) not in ("(", "{", "::") and self.at(x - 1) != "::":
                    self.define(x, "variable", self.s[x], self.e[x], None, scope, self.e[min(end, self.n - 1)], local=True)
        return stop


class _Script(_Walk):
    """JavaScript and TypeScript."""

    def walk(self, i: int, j: int, scope: tuple[int, int], function: tuple[int, int]) -> None:
        self.depth += 1
        least = i
        while i < j:
            t = self.at(i)
            if t == "function" and self.at(i - 1) != ".":
                i = self.function(i, j, scope, function, least)
            elif t in ("class", "interface", "enum", "namespace") and self.at(i - 1) != "." and (self.is_name(i + 1) or t == "class"):
                i = self.type(i, j, scope, least)
            elif t == "type" and self.is_name(i + 1) and self.at(self.generics(i + 2, j)) == "=":
                stop = self.first(i + 2, j, (";",))
                self.define(i + 1, "type", self.s[self.begin(i, least)], self.e[min(stop, self.n - 1)], None, scope)
                i += 2
            elif t in ("const", "let", "var") and self.at(i - 1) != ".":
                i = self.variables(i, j, scope, function, least)
            elif t == "import" and self.at(i + 1) not in ("(", "."):
                i = self.imports(i, j, scope)
            elif t == "export" and (self.at(i + 1) in ("{", "*")):
                stop = self.first(i + 1, j, (";",))
                src = next((x for x in range(i, min(stop + 1, j)) if self.at(x) == "from" and x + 1 < self.n and self.k[x + 1] == "s"), None)
                if src is not None:
                    self.module(src + 1)
                for x in range(i + 2, self.match[i + 1] if self.at(i + 1) == "{" else i + 2):
                    if self.is_name(x) and self.at(x - 1) != "as":
                        self.use(x, "export", resolve=src is None)
                i = (self.match[i + 1] if self.at(i + 1) == "{" else i + 1) + 1
            elif t in ("require", "import") and self.at(i + 1) == "(" and i + 2 < self.n and self.k[i + 2] == "s":
                self.module(i + 2)
                i += 2
            elif t == "catch" and self.at(i + 1) == "(":
                body = self.match[i + 1] + 1
                if self.at(body) == "{":
                    for x in self.pattern(i + 2, self.match[i + 1]):
                        self.define(x, "variable", self.s[x], self.e[x], None, (self.s[body], self.e[self.match[body]]), local=True)
                i = body
            elif t == "=>":
                i = self.arrow(i, j, scope)
            elif t in ("(", "[", "{"):
                end = self.match[i] if self.match[i] > i else j
                inner = (self.s[i], self.e[min(end, self.n - 1)]) if t == "{" else scope
                if t == "(" and self.at(i - 1) in ("for", "await"):
                    # names of a for header are bound in its body too
                    body = end + 1
                    inner = (self.s[i], self.e[min(self.match[body] if self.at(body) == "{" else self.first(body, j, (";",)), self.n - 1)])
                if self.depth < 200:
                    self.walk(i + 1, min(end, j), inner, function)
                i = end + 1
            else:
                i += 1
            if t in (";", "}"):
                least = i
        self.depth -= 1

    def function(self, i: int, j: int, scope: tuple[int, int], function: tuple[int, int], least: int) -> int:
        name = i + 1 + (self.at(i + 1) == "*")
        named = self.is_name(name)
        p = self.generics(name + 1 if named else name, j)
        if self.at(p) != "(":
            return i + 1
        statement = self.at(self.begin(i, least) - 1) in ("", ";", "}", "{", ")")
        end, inside = self.body(p, j)
        if named:
            # a declaration is visible in its whole scope; an expression's own name only within it
            self.define(name, "function", self.s[self.begin(i, least)], self.e[end], None, scope if statement else inside)
        return end + 1

    def body(self, p: int, j: int) -> tuple[int, tuple[int, int]]:
        """Parameters and body of a function whose brackets open at p: (last token, its scope)."""
        close = self.match[p]
        body = close + 1
        if self.at(body) == ":":
            body = self.first(body, j, ("{", ";", "=>", ","))
            if self.at(body) == "{" and self.at(body - 1) == ":":
                body = self.match[body] + 1
        end = min(self.match[body] if self.at(body) == "{" and self.match[body] > body else close, self.n - 1)
        inside = (self.s[p], self.e[end])
        self.parameters(p + 1, close, inside, self.s[p])
        self.walk(p + 1, close, inside, inside)
        if self.at(body) == "{" and self.depth < 200:
            self.walk(body + 1, end, (self.s[body], self.e[end]), inside)
        return end, inside

    def arrow(self, i: int, j: int, scope: tuple[int, int]) -> int:
        p = self.match[i - 1] if self.at(i - 1) == ")" else -1
        if p < 0 and not self.is_name(i - 1):
            k = next((x for x in range(i - 1, max(i - 40, -1), -1) if self.at(x) == ")"), -1)
            p = self.match[k] if k > 0 and self.at(k + 1) == ":" else -1
        body = i + 1
        end = self.match[body] if self.at(body) == "{" and self.match[body] > body else self.first(body, j, (",", ";", ")")) - 1
        end = min(max(end, i), self.n - 1)
        inside = (self.s[p] if p >= 0 else self.s[i - 1], self.e[end])
        if p >= 0:
            self.parameters(p + 1, self.match[p], inside, inside[0])
        elif self.is_name(i - 1) and i - 1 not in self.taken:
            self.define(i - 1, "parameter", self.s[i - 1], self.e[i - 1], None, inside, local=True)
        if self.at(body) == "{" and self.depth < 200:
            self.walk(body + 1, end, (self.s[body], self.e[end]), inside)
            return end + 1
        return i + 1

    def variables(self, i: int, j: int, scope: tuple[int, int], function: tuple[int, int], least: int) -> int:
        word, a = self.t[i], i + 1
        if self.at(a) == "enum":
            return a
        while a < j:
            if self.at(a) in ("{", "["):
                names, after = self.pattern(a + 1, self.match[a]), self.match[a] + 1
            elif self.is_name(a):
                names, after = [a], a + 1
            else:
                break
            stop = self.first(after, j, ("=", ",", ";", "of", "in", ")"))
            value = stop + 1 if self.at(stop) == "=" else None
            end = self.first(stop, j, (",", ";")) if value else stop
            kind = "constant" if word == "const" else "variable"
            arrow = value and (self.at(value) in ("function", "async") or self.at(value) == "(" and self.at(self.match[value] + 1) in ("=>", ":") or self.at(value + 1) == "=>")
            for x in names:
                self.define(x, "function" if arrow and len(names) == 1 else kind, self.s[self.begin(i, least)] if len(names) == 1 else self.s[x], self.e[min(max(end - 1, x), self.n - 1)], None, function if word == "var" else scope, None if word == "var" else self.s[x], blocks=word != "var", local=True)
            if value:
                self.walk(value, end, scope, function)
            if self.at(end) != ",":
                return max(end, after)
            a = end + 1
        return max(a, i + 1)

    def imports(self, i: int, j: int, scope: tuple[int, int]) -> int:
        k = i + 1
        while k < min(j, i + 4000) and not (self.k[k] == "s") and self.at(k) != ";":
            k += 1
        if k >= self.n or self.k[k] != "s":
            return i + 1
        for x in range(i + 1, k):
            if self.is_name(x) and self.at(x + 1) != "as":
                self.define(x, "import", self.s[x], self.e[x], None, scope)
            elif self.is_word(x):
                self.taken.add(x)
        self.module(k)
        return k + 1

    def type(self, i: int, j: int, scope: tuple[int, int], least: int) -> int:
        word = self.t[i]
        named = self.is_name(i + 1)
        name = i + 1
        while self.at(name + 1) == "." and word == "namespace":
            name += 2
        body = self.first(name + 1 if named else i + 1, j, ("{", ";"))
        if self.at(body) != "{":
            return i + 1
        end = min(self.match[body], self.n - 1)
        owner = self.utf8(self.t[name]) if named else None
        if named:
            k = self.define(name, "module" if word == "namespace" else word, self.s[self.begin(i, least)], self.e[end], None, scope, None if word != "class" else self.s[name], blocks=word == "class")
            kind = ""
            for x in range(name + 1, body):
                if self.at(x) in ("extends", "implements"):
                    kind = self.at(x)
                elif kind and self.is_name(x) and self.at(x - 1) in ("extends", "implements", ",") and self.at(x + 1) in ("{", ",", "<", "implements", "."):
                    self.use(x, kind)
                    self.relate(k, kind, x)
        inside = (self.s[body], self.e[end])
        if word == "namespace":
            self.walk(body + 1, end, inside, inside)
        elif word == "enum":
            for a, _ in self.parts(body + 1, end):
                if self.is_word(a):
                    self.define(a, "variant", self.s[a], self.e[a], owner)
        else:
            self.members(body + 1, end, owner, inside)
        return end + 1

    def members(self, i: int, j: int, owner: str | None, scope: tuple[int, int]) -> None:
        while i < j:
            start = i
            if self.at(i) == "@":
                i += 2
                if self.at(i) == "(":
                    i = self.match[i] + 1
                continue
            while self.at(i) in _MODIFIERS and (self.is_word(i + 1) or self.at(i + 1) in ("*", "[", "{")):
                i += 1
            if self.at(i) == "*":
                i += 1
            if self.at(i) == "{":
                end = self.match[i]
                self.walk(i + 1, end, (self.s[i], self.e[end]), (self.s[i], self.e[end]))
                i = end + 1
                continue
            if not self.is_word(i):
                i = self.match[i] + 1 if self.at(i) in ("(", "[") and self.match[i] > i else i + 1
                continue
            p = self.generics(i + 1 + (self.at(i + 1) in ("?", "!")), j)
            if self.at(p) == "(":
                at = len(self.defs)
                self.define(i, "constructor" if self.t[i] == "constructor" else "method", self.s[start], self.e[i], owner)
                end, _ = self.body(p, j)
                self.defs[at]["end"] = self.e[end]
                i = end + 1
            else:
                stop = self.first(p, j, (";", "}"))
                # without a semicolon a field ends with its line
                line = self.text.find("\n", self.e[i])
                value = self.first(p, stop, ("=",))
                while value >= stop and line >= 0 and stop > p and self.s[stop - 1] > line:
                    stop -= 1
                self.define(i, "field", self.s[start], self.e[max(i, min(stop, self.n) - 1)], owner)
                if value < stop:
                    nxt = self.first(value, j, (";",))
                    self.walk(value + 1, min(stop, nxt), scope, scope)
                i = stop + (self.at(stop) == ";")


class _CSharp(_Walk):
    def walk(self, i: int, j: int, owner: str | None) -> None:
        """Namespace level."""
        least = i
        while i < j:
            t = self.at(i)
            if t == "namespace" and self.is_word(i + 1):
                name, parts = i + 1, [self.t[i + 1]]
                while self.at(name + 1) == ".":
                    name += 2
                    parts.append(self.t[name])
                body = name + 1
                end = min(self.match[body] if self.at(body) == "{" else j - 1, self.n - 1)
                full = ".".join(parts)
                for x in range(i + 1, name):
                    self.taken.add(x)
                self.define(name, "namespace", self.s[i], self.e[end], owner, name=full)
                if self.at(body) == "{":
                    self.walk(body + 1, end, self.utf8(full))
                    i = end + 1
                else:
                    owner, i = self.utf8(full), body + 1
            elif t == "using" and self.at(i + 1) != "(":
                stop = self.first(i + 1, j, (";",))
                a = i + 1 + (self.at(i + 1) == "static")
                alias = self.at(a + 1) == "="
                if alias:
                    self.define(a, "import", self.s[i], self.e[min(stop, self.n - 1)], None, (0, len(self.text)))
                    a += 2
                self.module(i, "".join(self.t[a:stop]))
                self.taken.update(range(i, stop))
                i = stop + 1
            elif t in ("class", "struct", "interface", "enum", "record") and (self.is_name(i + 1) or self.at(i + 1) in ("class", "struct")):
                i = self.type(i, j, owner, least)
            elif t in ("(", "[", "{"):
                i = self.match[i] + 1 if self.match[i] > i else i + 1
            else:
                i += 1
            if t in (";", "}"):
                least = i

    def type(self, i: int, j: int, owner: str | None, least: int) -> int:
        word = self.t[i]
        name = i + 1 if self.is_name(i + 1) else i + 2
        body = self.first(name + 1, j, ("{", ";"))
        end = min(self.match[body] if self.at(body) == "{" else body, self.n - 1)
        k = self.define(name, word, self.s[self.begin(i, least)], self.e[end], owner, (0, len(self.text)))
        mine = self.utf8(self.t[name])
        colon = self.first(self.generics(name + 1, body), body, (":", "where"))
        if self.at(colon) == ":":
            for x in range(colon + 1, self.first(colon, body, ("where",))):
                if self.is_name(x) and self.at(x + 1) in (",", "{", "<", "where", "(") and self.at(x - 1) in (":", ",", "."):
                    self.use(x, "inherits")
                    self.relate(k, "inherits", x)
        if word == "record" and self.at(name + 1) == "(":
            self.parameters(name + 2, self.match[name + 1], (self.s[name], self.e[end]), self.s[name])
        if self.at(body) != "{":
            return end + 1
        if word == "enum":
            for a, _ in self.parts(body + 1, end):
                if self.is_name(a):
                    self.define(a, "enum_member", self.s[a], self.e[a], mine)
            return end + 1
        self.members(body + 1, end, mine)
        return end + 1

    def members(self, i: int, j: int, owner: str) -> None:
        while i < j:
            if self.at(i) == "[":
                i = self.match[i] + 1 if self.match[i] > i else i + 1
                continue
            stop = self.first(i, j, (";", "{", "=", "=>", "(", "class", "struct", "interface", "enum", "record"))
            if stop >= j:
                return
            t = self.at(stop)
            if t in _TYPE_WORDS:
                i = self.type(stop, j, owner, i)
                continue
            name = stop - 1
            if t == "(" and self.at(name) == ">":
                depth = 0
                while name > i:
                    depth += (self.at(name) == ">") - (self.at(name) == "<")
                    name -= 1
                    if depth == 0:
                        break
            if t == "(" and self.is_name(name):
                close = self.match[stop]
                body = self.first(close + 1, j, ("{", ";", "=>"))
                end = self.match[body] if self.at(body) == "{" else self.first(body, j, (";",))
                end = min(end, self.n - 1)
                at = len(self.defs)
                self.define(name, "constructor" if self.t[name] == owner else "method", self.s[i], self.e[end], owner, (0, len(self.text)) if self.t[name] != owner else None)
                inside = (self.s[stop], self.e[end])
                self.parameters(stop + 1, close, inside, self.s[stop])
                self.code(body + 1, end, inside)
                self.defs[at]["end"] = self.e[end]
                i = end + 1
            elif t == "{" and self.is_name(name):
                end = self.match[stop]
                more = end + 1
                if self.at(more) == "=":
                    more = self.first(more, j, (";",)) + 1
                self.define(name, "property", self.s[i], self.e[min(more - 1, self.n - 1)], owner, (0, len(self.text)))
                self.code(stop + 1, end, (self.s[stop], self.e[end]))
                i = more
            elif t == "=>" and self.is_name(name):
                end = min(self.first(stop, j, (";",)), self.n - 1)
                self.define(name, "property", self.s[i], self.e[end], owner, (0, len(self.text)))
                self.code(stop + 1, end, (self.s[stop], self.e[end]))
                i = end + 1
            elif t in (";", "=") and self.is_name(name) and name > i:
                end = min(self.first(stop, j, (";",)), self.n - 1)
                self.define(name, "constant" if any(self.at(x) == "const" for x in range(i, name)) else "event" if any(self.at(x) == "event" for x in range(i, name)) else "field", self.s[i], self.e[end], owner, (0, len(self.text)))
                self.code(stop, end, (self.s[stop], self.e[end]))
                i = end + 1
            else:
                i = self.match[stop] + 1 if t in ("{", "(") and self.match[stop] > stop else stop + 1

    def code(self, i: int, j: int, scope: tuple[int, int]) -> None:
        """Locals of a body: ``var x =``, ``Type x =``, ``foreach (T x in``, lambda parameters."""
        self.depth += 1
        while i < j:
            t = self.at(i)
            if t == "=>":
                body = i + 1
                end = self.match[body] if self.at(body) == "{" else self.first(body, j, (",", ";", ")")) - 1
                inside = (self.s[i], self.e[min(max(end, i), self.n - 1)])
                if self.at(i - 1) == ")":
                    self.parameters(self.match[i - 1] + 1, i - 1, inside, inside[0])
                elif self.is_name(i - 1) and i - 1 not in self.taken:
                    self.define(i - 1, "parameter", self.s[i - 1], self.e[i - 1], None, inside, local=True)
                i += 1
            elif self.is_name(i) and self.at(i + 1) in ("=", ";", "in", ",", ")") and i not in self.taken and (self.is_word(i - 1) and self.t[i - 1] not in ("return", "new", "throw", "in", "out", "is", "case", "goto", "await", "else", "when", "and", "or", "not", "as") or self.at(i - 1) in (">", "]", "?") and self.at(i + 1) == "="):
                self.define(i, "local", self.s[i], self.e[i], None, scope, self.s[i], local=True)
                i += 1
            elif t in ("(", "[", "{"):
                end = self.match[i] if self.match[i] > i else j
                inner = (self.s[i], self.e[min(end, self.n - 1)]) if t == "{" else scope
                if t == "(" and self.at(i - 1) in ("for", "foreach", "using", "catch", "fixed") and self.at(end + 1) == "{":
                    inner = (self.s[i], self.e[self.match[end + 1]])
                if self.depth < 200:
                    self.code(i + 1, min(end, j), inner)
                i = end + 1
            else:
                i += 1
        self.depth -= 1


class _Php(_Walk):
    def walk(self, i: int, j: int, scope: tuple[int, int], conditional: bool = False) -> None:
        self.depth += 1
        least = i
        while i < j:
            t = self.at(i).lower()
            if t == "namespace" and self.is_word(i + 1):
                body = i + 2
                end = min(self.match[body] if self.at(body) == "{" else j - 1, self.n - 1)
                self.space, self.aliases = self.t[i + 1].strip("\\"), {}
                self.define(i + 1, "namespace", self.s[i], self.e[end], None)
                i = body + 1
            elif t == "use" and not self.depth > 1:
                i = self.imports(i, j)
            elif t in ("class", "interface", "trait", "enum") and self.is_name(i + 1) and self.at(i - 1) not in ("::", "->"):
                i = self.type(i, j, least, conditional)
            elif t == "function":
                i = self.function(i, j, None, least)
            elif t == "fn" and self.at(i + 1) == "(":
                end = self.first(i + 2, j, (",", ";", ")"))
                end = min(max(self.first(self.match[i + 1] + 1, j, (",", ";", ")")) - 1, i), self.n - 1)
                self.parameters(i + 2, self.match[i + 1], (self.s[i], self.e[end]), self.s[i])
                i += 1
            elif t == "const" and self.is_name(i + 1):
                stop = self.first(i, j, (";",))
                self.define(i + 1, "constant", self.s[i], self.e[min(stop, self.n - 1)], self.utf8(self.space) or None, (0, len(self.text)))
                i += 2
            elif self.t[i].startswith("$") and self.is_word(i) and self.at(i + 1) == "=" and i not in self.taken and self.at(i - 1) not in ("->", "::", "?->"):
                self.local(i, scope)
                i += 1
            elif t == "as" and self.is_word(i + 1):
                for x in range(i + 1, self.first(i, j, (")",))):
                    if self.t[x].startswith("$") and self.is_word(x):
                        self.local(x, scope)
                i += 1
            elif t in ("(", "[", "{"):
                end = self.match[i] if self.match[i] > i else j
                if self.depth < 200:
                    self.walk(i + 1, min(end, j), scope, conditional or t == "{" and self.at(i - 1) == ")")
                i = end + 1
            else:
                i += 1
            if t in (";", "}"):
                least = i
        self.depth -= 1

    space, aliases = "", {}

    def local(self, i: int, scope: tuple[int, int]) -> None:
        if not any(b["start"] == scope[0] and b["end"] == scope[1] for b in self.bindings.get(self.utf8(self.t[i]), ())):
            self.define(i, "variable", self.s[i], self.e[i], None, scope, self.s[i], local=True)

    def canonical(self, name: str) -> str:
        """The full name of a class: absolute, by an import, or of the namespace at hand."""
        if name.startswith("\\"):
            return name[1:]
        head, _, rest = name.partition("\\")
        full = self.aliases.get(head.lower())
        if full is not None:
            return full + ("\\" + rest if rest else "")
        return self.space + "\\" + name if self.space else name

    def imports(self, i: int, j: int) -> int:
        stop = self.first(i + 1, j, (";",))
        a = i + 1 + (self.at(i + 1) in ("function", "const"))
        group = self.first(a, stop, ("{",))
        prefix = self.t[a] + "\\" if group < stop and group > a else ""
        parts = self.parts(group + 1, self.match[group]) if group < stop else self.parts(a, stop)
        for x, y in parts:
            if not self.is_word(x):
                continue
            full = (prefix + self.t[x]).strip("\\").replace("\\\\", "\\")
            name = y - 1
            alias = self.t[name] if self.at(name - 1) == "as" else full.rsplit("\\", 1)[-1]
            if a == i + 1:
                self.aliases[alias.lower()] = full
            self.define(name, "import", self.s[x], self.e[name], None, name=alias, canonical=self.utf8(full))
            self.module(x, full)
        self.taken.update(range(i, stop))
        return stop + 1

    def type(self, i: int, j: int, least: int, conditional: bool) -> int:
        word, name = self.t[i].lower(), i + 1
        body = self.first(name + 1, j, ("{", ";"))
        if self.at(body) != "{":
            return i + 1
        end = min(self.match[body], self.n - 1)
        space = self.utf8(self.space) or None
        k = self.define(name, word, self.s[self.begin(i, least)], self.e[end], space, (0, len(self.text)), canonical=self.utf8(self.canonical(self.t[name])), conditional=conditional, complete=self.sound)
        kind = ""
        for x in range(name + 1, body):
            if self.at(x).lower() in ("extends", "implements"):
                kind = self.at(x).lower()
            elif kind and self.is_word(x):
                self.use(x, kind, self.canonical(self.t[x]), resolve=False)
                self.relate(k, kind, x, self.canonical(self.t[x]))
        mine, b = self.utf8(self.t[name]), body + 1
        while b < end:
            t = self.at(b).lower()
            if t == "#" or t == "[":
                b = self.match[b] + 1 if t == "[" and self.match[b] > b else b + 1
                continue
            if t == "use":
                stop = self.first(b, end, (";", "{"))
                for x in range(b + 1, stop):
                    if self.is_word(x):
                        self.use(x, "trait_use", self.canonical(self.t[x]), resolve=False)
                        self.relate(k, "trait_use", x, self.canonical(self.t[x]))
                b = (self.match[stop] if self.at(stop) == "{" else stop) + 1
                continue
            start, words = b, []
            while self.at(b).lower() in _MODIFIERS or self.at(b).lower() == "var":
                words.append(self.at(b).lower())
                b += 1
            t = self.at(b).lower()
            visible = next((w for w in words if w in ("public", "protected", "private")), "public")
            if t == "function" or self.at(b - 1) == "function":
                b = self.function(b, end, mine, start, visibility=visible, abstract="abstract" in words or word == "interface", static="static" in words)
            elif words[-1:] == ["const"] or t == "case":
                stop = self.first(b, end, (";",))
                c = b + 1 if t == "case" else b
                while self.is_word(c) and self.at(c + 1) not in ("=", ";", ",") and c < stop:
                    c += 1
                if self.is_word(c):
                    self.define(c, "enum_case" if t == "case" else "constant", self.s[start], self.e[min(stop, self.n - 1)], mine, visibility=visible)
                b = stop + 1
            else:
                stop = self.first(b, end, (";", "{"))
                v = next((x for x in range(b, stop) if self.t[x].startswith("$") and self.is_word(x)), None)
                if v is not None:
                    self.define(v, "property", self.s[start], self.e[min(stop, self.n - 1)], mine, name=self.t[v].lstrip("$"), visibility=visible)
                b = (self.match[stop] if self.at(stop) == "{" and self.match[stop] > stop else stop) + 1
        return end + 1

    def function(self, i: int, j: int, owner: str | None, least: int, **more: object) -> int:
        name = i + 1 + (self.at(i + 1) == "&")
        named = self.is_word(name) and self.at(name + 1) == "("
        p = name + 1 if named else name
        if self.at(p) != "(":
            return i + 1
        close = self.match[p]
        start = least if owner is not None else self.begin(i, least)
        body = self.first(close + 1, j, ("{", ";"))
        end = min(self.match[body] if self.at(body) == "{" else body, self.n - 1)
        if named:
            method = owner is not None
            self.define(name, "method" if method else "function", self.s[start], self.e[end], owner or self.utf8(self.space) or None, None if method else (0, len(self.text)), **more)
        inside = (self.s[p], self.e[end])
        self.parameters(p + 1, close, inside, self.s[p])
        if not named and self.at(close + 1) == "use" and self.at(close + 2) == "(":
            # what a closure takes over is bound within it
            for x in range(close + 3, self.match[close + 2]):
                if self.is_word(x):
                    self.define(x, "parameter", self.s[x], self.e[x], None, inside, local=True)
        if self.at(body) == "{" and self.depth < 200:
            self.depth += 1
            self.walk(body + 1, end, inside)
            self.depth -= 1
        return end + 1


class _Luau(_Walk):
    def blocks(self) -> dict[int, int]:
        """Block words and their ends; an ``if`` expression has none."""
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if self.k[i] != "w":
                continue
            if t == "if" and self.at(i - 1) in ("=", "(", ",", "return", "and", "or", "{", "[", "else", "then", "..", "+", "-", "*", "/", "<", ">", "==", "not") and not (self.at(i - 1) in ("else", "then") and self.line(i) != self.line(i - 1)):
                continue
            if t in ("function", "do", "if", "repeat"):
                stack.append(i)
            elif t in ("end", "until"):
                if not stack:
                    self.sound = False
                else:
                    out[stack.pop()] = i
        self.sound = self.sound and not stack
        for i in stack:
            out[i] = self.n - 1
        return out

    def line(self, i: int) -> int:
        return self.text.count("\n", 0, self.s[i])

    def walk(self, i: int, j: int, scope: tuple[int, int]) -> None:
        ends = self.blocks()
        self._walk(i, j, scope, ends)

    def _walk(self, i: int, j: int, scope: tuple[int, int], ends: dict[int, int]) -> None:
        self.depth += 1
        while i < j:
            t = self.at(i)
            if t == "function":
                end = ends.get(i, j)
                local = self.at(i - 1) == "local"
                p = i + 1
                while p < end and self.at(p) != "(":
                    p += 1
                names = [x for x in range(i + 1, p) if self.is_name(x) and self.at(x - 1) in ("function", ".", ":")]
                if names:
                    name = names[-1]
                    owner = ".".join(self.t[x] for x in names[:-1]) or None
                    self.define(name, "method" if self.at(name - 1) == ":" else "function", self.s[i - 1] if local else self.s[i], self.e[min(end, self.n - 1)], owner, scope if not owner else None, self.s[i])
                inside = (self.s[min(p, self.n - 1)], self.e[min(end, self.n - 1)])
                if self.at(p) == "(":
                    self.parameters(p + 1, self.match[p], inside, inside[0])
                    if self.depth < 200:
                        self._walk(self.match[p] + 1, end, inside, ends)
                i = end + 1
            elif t == "local" and self.is_name(i + 1):
                a = i + 1
                names = []
                while self.is_name(a):
                    names.append(a)
                    a += 1
                    if self.at(a) == ":":
                        a = self.first(a, j, ("=", ",", "local", "function", "return"))
                    if self.at(a) != ",":
                        break
                    a += 1
                # not bound in its own value: a function, or up to the end of the line
                seen = self.s[names[-1]]
                if self.at(a) == "=":
                    line = self.text.find("\n", self.e[a])
                    seen = self.e[ends[a + 1]] if a + 1 in ends else line if line >= 0 else len(self.text)
                for x in names:
                    self.define(x, "variable", self.s[i], self.e[x], None, scope, seen, local=True)
                i = a
            elif t == "type" and self.is_name(i + 1) and self.at(self.generics(i + 2, j)) == "=":
                self.define(i + 1, "type", self.s[i], self.e[i + 1], None, scope)
                i += 2
            elif t == "for":
                stop = self.first(i, j, ("in", "=", "do"))
                do = self.first(stop, j, ("do",))
                if do in ends:
                    for x in range(i + 1, stop):
                        if self.is_name(x) and self.at(x - 1) in ("for", ","):
                            self.define(x, "variable", self.s[x], self.e[x], None, (self.s[do], self.e[ends[do]]), local=True)
                i = stop
            elif t in ("do", "if", "repeat") and i in ends:
                if self.depth < 200:
                    self._walk(i + 1, ends[i], (self.s[i], self.e[ends[i]]), ends)
                i = ends[i]
            elif t == "require" and self.at(i + 1) == "(":
                close = self.match[i + 1]
                self.module(i, "".join(self.t[i + 2 : close]).strip("\"'"))
                i += 1
            else:
                i += 1
        self.depth -= 1


_DM_TOKEN = re.compile(r'(?P<c>//[^\n]*|/\*[\s\S]*?\*/)|(?P<s>\{"[\s\S]*?"\}|"(?:[^"\\\n]|\\[\s\S])*"|\'[^\'\n]*\')')
_DM_PATH = re.compile(r"(/?(?:\w+/)*\w+)[ \t]*(\([^\n]*)?")
_SIGNAL = re.compile(r"\b(SEND_SIGNAL|RegisterSignal|UnregisterSignal|SEND_GLOBAL_SIGNAL|RegisterGlobalSignal)\s*\(")


def _dreammaker(text: str) -> dict:
    """Paths by indentation or braces: types, procs and their overrides, vars, macros, includes, signals, parent calls and explicit parents."""
    code = _DM_TOKEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    if '"' in code:
        # an unfinished string hides what stands in it, up to the next quotation mark
        a = code.index('"')
        b = code.find('"', a + 1)
        code = code[:a] + '"' + re.sub(r"[^\n]", " ", code[a + 1 : b if b > 0 else len(code)]) + (code[b:] if b > 0 else "")
    sound = code.count('"') == 0 and code.count("(") == code.count(")") and code.count("{") == code.count("}")
    defs, occ, rel, mods, bindings = [], [], [], [], {}
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    lines = []
    for a, b in zip(starts, [*starts[1:], len(code) + 1]):
        body = code[a : b - 1].rstrip("\r")
        lines.append((a, a + len(body), body))
    def extent(k: int, indent: int) -> int:
        """End of the block of line k: the last line that stands further in, or the closing brace."""
        if "{" in lines[k][2] and lines[k][2].rstrip().endswith("{"):
            depth = 0
            for m in re.compile(r"[{}]").finditer(code, lines[k][0]):
                depth += 1 if m[0] == "{" else -1
                if depth == 0:
                    return m.end()
            return len(code)
        end = lines[k][1]
        for a, b, body in lines[k + 1 :]:
            s = body.strip()
            if s and not s.startswith("#"):
                if len(body) - len(body.lstrip()) <= indent:
                    break
                end = b
        return end

    def define(name: str, kind: str, at: int, size: int, end: int, owner: str | None, scope: tuple[int, int] | None = None, begin: int | None = None) -> int:
        defs.append({"name": name, "kind": kind, "start": at if begin is None else begin, "end": end, "container": owner, "name_start": at, "name_end": at + size})
        k = len(defs) - 1
        occ.append({"name": name, "role": "declaration", "start": at, "end": at + size, "target": k, "candidates": []})
        if scope:
            bindings.setdefault(name, []).append({"id": k, "name": name, "start": scope[0], "end": scope[1], "visible": at, "local": True})
        return k

    procs: dict[tuple[str, str], list[int]] = {}
    types: dict[str, int] = {}
    stack: list[tuple[int, str, int]] = []  # indent, path, end of the proc that holds it (0: none)
    inside: list[tuple[int, int, str, str]] = []
    explicit: dict[str, str] = {}
    for k, (a, b, body) in enumerate(lines):
        s = body.strip()
        indent = len(body) - len(body.lstrip())
        at = a + indent
        if not s:
            continue
        if s.startswith("#"):
            if m := re.match(r"#\s*define\s+(\w+)", s):
                define(m[1], "macro", at + m.start(1), len(m[1]), b, None, begin=at)
            elif m := re.match(r"\s*#\s*include\s+[\"<]([^\">\n]+)[\">]", text[a:b]):
                mods.append({"spelled": m[1], "start": a + m.start(1)})
                occ.append({"name": m[1], "role": "include", "start": a + m.start(1), "end": a + m.end(1), "target": None, "candidates": []})
            continue
        while stack and (stack[-1][0] >= indent and not stack[-1][2] or stack[-1][2] and a >= stack[-1][2]):
            stack.pop()
        held = stack[-1] if stack else None
        if held and held[2]:
            # within a proc: locals; a block is what stands under its line
            for m in re.finditer(r"\bvar/((?:\w+/)*)(\w+)", body):
                outer = k
                while outer > 0 and (not lines[outer][2].strip() or len(lines[outer][2]) - len(lines[outer][2].lstrip()) >= indent):
                    outer -= 1
                scope_end = extent(outer, len(lines[outer][2]) - len(lines[outer][2].lstrip()))
                depth, p = 0, a + m.start()
                for x in re.compile(r"[{}]").finditer(code, p):
                    depth += 1 if x[0] == "{" else -1
                    if depth < 0:
                        scope_end = min(scope_end, x.start()) if indent else x.start()
                        break
                define(m[2], "variable", a + m.start(2), len(m[2]), a + m.end(2), None, (p, max(scope_end, b)))
            continue
        m = _DM_PATH.match(s)
        if not m or s[0] in "{}(":
            continue
        path, args = m[1], m[2]
        full = path.strip("/") if path.startswith("/") or not held else f"{held[1]}/{path}".strip("/")
        if not path.startswith("/") and not held and "/" not in path and args is None and not s.startswith(("proc", "verb", "var")):
            if not re.fullmatch(r"\w+", s):
                continue
        rest = s[m.end() :].lstrip()
        parts = [p for p in full.split("/") if p not in ("static", "global", "tmp", "const")] if "var" in full.split("/") else full.split("/")
        name_at = at + m.start(1) + len(path) - len(path.rsplit("/", 1)[-1])
        if "var" in parts and parts[-1] != "var":
            owner = "/".join(parts[: parts.index("var")]) or None
            define(parts[-1], "constant", name_at, len(parts[-1]), b, owner, begin=at)
            continue
        if parts[-1] in ("proc", "verb", "var"):
            stack.append((indent, full, 0))
            continue
        proc = args is not None or "proc" in parts or "verb" in parts
        if proc:
            owner = "/".join(p for p in parts[:-1] if p not in ("proc", "verb")) or None
            end = extent(k, indent)
            d = define(parts[-1], "proc", name_at, len(parts[-1]), end, owner, begin=at)
            procs.setdefault((owner or "", parts[-1]), []).append(d)
            if args:
                for p in re.finditer(r"(?:^|[(,])\s*(?:var/)?(?:\w+/)*(\w+)", args):
                    define(p[1], "parameter", at + m.start(2) + p.start(1), len(p[1]), at + m.start(2) + p.end(1), None, (a, end))
            stack.append((indent, full, end))
            inside.append((a, end, owner or "", parts[-1]))
        elif rest.startswith("=") and held:
            if parts[-1] == "parent_type":
                if p := re.search(r"=\s*(/[\w/]+)", s):
                    explicit[held[1].strip("/")] = p[1].strip("/")
                    occ.append({"name": p[1], "role": "parent_type", "start": at + p.start(1), "end": at + p.end(1), "target": None, "candidates": []})
                    if held[1].strip("/") in types:
                        rel.append({"source": types[held[1].strip("/")], "kind": "inheritance", "name": p[1], "start": at + p.start(1), "end": at + p.end(1)})
            else:
                define(parts[-1], "field", name_at, len(parts[-1]), b, "/".join(parts[:-1]), begin=at)
        elif path.startswith("/") or held or re.fullmatch(r"[\w/]+", s):
            types[full] = define(parts[-1], "class", name_at, len(parts[-1]), extent(k, indent), "/".join(parts[:-1]) or None, begin=at)
            stack.append((indent, full, 0))

    def above(path: str) -> Iterator[str]:
        seen = set()
        while path and path not in seen:
            seen.add(path)
            path = explicit.get(path) or path.rpartition("/")[0]
            if path:
                yield path

    taken = {(o["start"], o["end"]) for o in occ}
    for m in re.finditer(r"\.\.(?=\s*\()", code):
        hold = next((x for x in reversed(inside) if x[0] <= m.start() < x[1]), None)
        cand = next((procs[p, hold[3]] for p in above(hold[2]) if (p, hold[3]) in procs), []) if hold else []
        occ.append({"name": hold[3] if hold else "..", "role": "parent_call", "start": m.start(), "end": m.end(), "target": None, "candidates": cand[:CAP]})
    for m in _SIGNAL.finditer(code):
        args = re.match(r"[^,\n]*,\s*(\"[^\"\n]*\"|\w+)", text[m.end() :])
        if args:
            at = m.end() + args.start(1)
            name = args[1].strip('"')
            occ.append({"name": name, "role": "signal", "start": at, "end": at + len(args[1]), "target": None, "candidates": []})
            taken.add((at, at + len(args[1])))
            hold = next((i for i, d in enumerate(defs) if d["kind"] == "proc" and d["start"] <= m.start() < d["end"]), None)
            if hold is not None:
                rel.append({"source": hold, "kind": "signal_call", "name": name, "start": at, "end": at + len(args[1])})
    words = frozenset("if else for while do switch return break continue var proc verb new del in to step as null src usr world global static const tmp try catch throw spawn sleep set goto TRUE FALSE".split())
    directives = [(a, b) for a, b, body in lines if body.lstrip().startswith("#")]
    for m in re.finditer(r"(?<![\w/])([A-Za-z_]\w*)(\s*\()?", code):
        if m[1] in words or (m.start(1), m.end(1)) in taken or any(d["name_start"] == m.start(1) for d in ()):
            continue
        hold = any(a <= m.start() < b for a, b, *_ in inside)
        if not hold or any(a <= m.start() < b for a, b in directives):
            continue
        member = code[max(0, m.start() - 1) : m.start()] in (".", ":")
        target, cand = (None, []) if member or not sound else resolve_scope(bindings.get(m[1], ()), m[1], m.start())
        if target is None and not cand and m[2] and not member:
            cand = [d for (_, n), ds in procs.items() if n == m[1] for d in ds][:CAP]
        occ.append({"name": m[1], "role": "call" if m[2] else "read", "start": m.start(1), "end": m.end(1), "target": target, "candidates": cand})
    return {"status": "recovered" if sound else "recovered_incomplete", "definitions": defs, "occurrences": occ, "relationships": rel, "modules": mods}


_FAMILIES = {"rust": _Rust, "script": _Script, "csharp": _CSharp, "php": _Php, "luau": _Luau}


def extract(path: str, data: bytes) -> dict:
    """Facts of one file: status, definitions (name, kind, start, end, container, name_start, name_end, ...), occurrences (name, role, start, end,
    target, candidates), relationships (source, kind, name, start, end), modules (spelled, start).

    Spans are half-open byte offsets; targets and candidates are numbers of definitions of the file.  Text that isn't UTF-8 gives
    ``invalid_encoding`` and no facts, an unknown extension ``lexical_only``, too many facts ``fact_limit`` and none.
    """
    family = FAMILY.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None
    empty: dict = {"status": "lexical_only", "definitions": [], "occurrences": [], "relationships": [], "modules": []}
    if family is None:
        return empty
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return {**empty, "status": "invalid_encoding"}
    text = data.decode("latin-1")
    if family == "dreammaker":
        out = _dreammaker(text)
    else:
        w = _FAMILIES[family](family, text)
        whole = (0, len(text) + 1)
        if family == "script":
            w.walk(0, w.n, whole, whole)
        elif family == "csharp":
            w.walk(0, w.n, None)
        else:
            w.walk(0, w.n, whole)
        w.finish()
        out = {"status": "recovered" if w.sound else "recovered_incomplete", "definitions": w.defs, "occurrences": w.occ, "relationships": w.rel, "modules": w.mods}
        # in Rust a method belongs to the type of its block, elsewhere a local one to what holds it
        order = sorted(range(len(w.defs)), key=lambda k: (w.defs[k]["start"], -w.defs[k]["end"]))
        stack: list[int] = []
        for k in order:
            d = w.defs[k]
            while stack and w.defs[stack[-1]]["end"] <= d["start"]:
                stack.pop()
            if d["container"] is None and stack and d["kind"] not in ("import", "impl", "namespace"):
                d["container"] = w.defs[stack[-1]]["name"]
            if d["end"] > d["name_end"] or d["kind"] in ("function", "method"):
                stack.append(k)
    if sum(len(out[k]) for k in ("definitions", "occurrences", "relationships", "modules")) > MAX_FACTS:
        return {**empty, "status": "fact_limit"}
    return out


_FACTS = T.StructType(
    [
        T.StructField("revision", T.StringType()), T.StructField("path", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("fact", T.StringType()), T.StructField("nth", T.LongType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()),
        T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()), T.StructField("container", T.StringType()), T.StructField("target", T.LongType()),
        T.StructField("candidates", T.ArrayType(T.LongType())), T.StructField("canonical", T.StringType()), T.StructField("visibility", T.StringType()),
        T.StructField("abstract", T.BooleanType()), T.StructField("conditional", T.BooleanType()), T.StructField("complete", T.BooleanType()),
    ]
)


_KINDS = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()] + [pa.bool_()] * 3


def _rows(revision: str, path: str, x: dict, facts: Collection[str]) -> Iterator[tuple]:
    """The facts of one body, of the kinds asked for, as rows of ``_FACTS``."""
    head = (revision, path, x["status"])
    none = (None,) * 6
    if "file" in facts:
        yield (*head, "file", None, None, None, None, None, None, None, *none)
    for k, d in enumerate(x["definitions"] if "definition" in facts else ()):
        yield (*head, "definition", k, d["name"], d["kind"], d["start"], d["end"], d["container"], None, None, d.get("canonical"), d.get("visibility"), d.get("abstract"), d.get("conditional"), d.get("complete"))
    for o in x["occurrences"] if "occurrence" in facts else ():
        yield (*head, "occurrence", None, o["name"], o["role"], o["start"], o["end"], None, o["target"], o["candidates"] or None, *none[1:])
    for r in x["relationships"] if "relationship" in facts else ():
        yield (*head, "relationship", None, r["name"], r["kind"], r["start"], r["end"], None, r["source"], *none)
    for m in x["modules"] if "module" in facts else ():
        yield (*head, "module", None, m["spelled"], None, m["start"], None, None, None, *none)


def _record(rows: list[tuple], columns: Collection[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, n in zip(zip(*rows), _KINDS, _FACTS.names) if n in columns], names=[n for n in _FACTS.names if n in columns])


def extract_all(bodies: DataFrame, facts: Collection[str] = FACTS, columns: Collection[str] = tuple(_FACTS.names)) -> DataFrame:
    """(revision, path, bytes) -> facts as rows: definition, occurrence, relationship and module rows, and one file row with the status.

    ``nth`` numbers the definitions of a file, ``target`` and ``candidates`` are such numbers (of a relationship: its source).
    What a hierarchy needs of a PHP class or method - full name, visibility, abstract, conditional, complete - stands in columns.
    A worker holds the facts of one body and ``AT_ONCE`` rows, however many bodies come in a batch.
    Every body is read whole; of its facts only those of the kinds in ``facts`` become rows, and of these only ``columns`` leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for rev, path, body in zip(*batch.columns):
                rev, path = rev.as_py(), path.as_py()
                for row in _rows(rev, path, extract(path, body.as_py()), facts):
                    rows.append(row)
                    if len(rows) == AT_ONCE:
                        yield _record(rows, columns)
                        rows = []
        if rows:
            yield _record(rows, columns)

    return bodies.where("path IS NOT NULL AND bytes IS NOT NULL").select("revision", "path", "bytes").mapInArrow(run, T.StructType([f for f in _FACTS if f.name in columns]))
