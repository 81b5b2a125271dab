"""Per-body part of the parse check: tokens -> class string -> pairs, bracket residues, statement faults.

Pure Python over one body at a time, run inside ``mapInArrow``; everything that
joins or reduces across rows is in ``parsecheck``.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from .grammars import BRACKETS, OPERATORS, REDUCED, WORDS, adjacent, windows
from .lexers import HEREDOC, MASTER

#: brackets per block of the residue rows
BLOCK = 256
NEWLINE_CODE = 1 << 20
_PLAIN_WORD = re.compile(r"[^\W\d]")


class _Memo(dict):
    """token -> class characters ('' for a comment); forgets everything when it has grown large."""

    def __init__(self, family: str):
        super().__init__()
        pairs, _, _ = adjacent(family)
        names = sorted({x for p in pairs for x in p} | {"ID", "NUM", "STR", "BAD", "START", "END", "NL", "VAR", "LIFE", "TAG", "ATTR", "DECO", "TPL"})
        self.family, self.code = family, {n: chr(0x100 + i) for i, n in enumerate(names)}
        self.words = {}
        for table in (OPERATORS[family], WORDS[family]):
            for name, words in table.items():
                self.words |= {w: name for w in words.split()}

    def name(self, t: str) -> str | None:
        c, family = t[0], self.family
        if c == "\n":
            return "NL" if family in ("typescript", "javascript", "dreammaker") else None
        if len(t) > 1:
            if t.startswith(("//", "/*")) and family != "luau" or t.startswith("--") and family == "luau" and t != "--":
                return None
            if t.startswith(("<<<<<<<", "=======", ">>>>>>>")):
                return "BAD"
            if c in "\"'`" or t[-1] in "\"'`":
                if c == "'" and t[-1] != "'" and family == "rust":
                    return "LIFE"
                if c == "`" and family in ("typescript", "javascript"):
                    return "TPL"
                return "STR"
            if c == "#" and family in ("csharp", "php", "dreammaker") and t != "#[":
                return None
            if c == "[" and family == "luau":
                return "STR"
            if t.startswith(("{\"", '"""')):
                return "STR"
            if t.startswith("?>"):
                return "TAG"
            if c == "$" and family == "php":
                return "VAR"
            if c == "@" and family == "luau":
                return "ATTR"
            if t.startswith("<<<") and family == "php":
                return "STR"
        if c == "@" and len(t) > 1 and family in ("typescript", "javascript"):
            return "DECO"
        if c.isdigit():
            return "NUM"
        if family == "php" and _PLAIN_WORD.match(t):
            t = t.lower()
        if t in self.words:
            return self.words[t]
        if t in self.code and not t.isupper():
            return t
        if _PLAIN_WORD.match(t) or c in "_\\" and len(t) > 1 or c in "$#@" and len(t) > 1 and family != "rust" or t.startswith("r#") or t == "_" or t == "$" and family in ("typescript", "javascript"):
            return "ID"
        return "BAD"

    def __missing__(self, t: str) -> str:
        if len(self) > 200_000:
            self.clear()
        if self.family in ("typescript", "javascript") and "/" in t[1:] and t[0] in "=(,:[!&|?{};r" and not t.startswith(("//", "/*")) and t[-1] != "=":
            head, _, _ = t.partition("/")
            out = self[head.strip()] + self.code["STR"]
        else:
            n = self.name(t)
            out = "" if n is None else self.code[n]
        self[t] = out
        return out


@cache
def memo(family: str) -> _Memo:
    return _Memo(family)


@cache
def permissible(family: str) -> frozenset:
    """Codes of the family's permissible pairs; with NEWLINE_CODE those that a line end between them permits."""
    m = memo(family)
    pairs, starts, ends = adjacent(family)
    code = lambda a, b: (ord(m.code[a]) - 0x100) * 1024 + ord(m.code[b]) - 0x100
    out = {code(a, b) for a, b in pairs}
    if family == "luau":
        out |= {code(a, b) for a in ends for b in starts}
    if family in ("typescript", "javascript"):
        out |= {code(a, b) + NEWLINE_CODE for a in ends for b in starts if b not in ("(", "[", "-", "+", "*", "<", ".", ",")}
    # a file begins as a statement does and ends as one does
    out |= {code("START", b) for b in starts | {"END", "using", "namespace", "[", "#![", "TAG", "import", "export", "}"} & set(m.code)}
    stop = {"rust": ("}", ";", "]", ")"), "csharp": ("}", ";"), "php": ("}", ";", "TAG", ":")}
    out |= {code(a, "END") for a in (stop[family] if family in stop else ends)}
    return frozenset(out)


@cache
def _productions(family: str) -> list[re.Pattern]:
    """Class-string patterns of statements that no production of the family has."""
    m = memo(family).code

    def rx(p: str) -> re.Pattern:
        return re.compile(re.sub(r"<([^<>]+)>", lambda x: re.escape(m[x[1]]) if x[1] in m else re.escape(m["BAD"]), p.replace("<lt>", re.escape(m.get("<", m["BAD"])))))

    json = rx(r"\A<{><STR><:>")
    if family == "rust":
        return [json, rx("(?<!<*>)<const><ID>(?!<:>)"), rx("<static><ID><=>"), rx("<struct><ID>(?![<{><;>(]|<lt>|<(>|<where>|<{>|<;>)"), rx("<for>(?:<ID>|<_>)<(>"), rx("<let><ID><ID>")]
    if family == "javascript":
        inner = "(?:[^<(><)><{><=>]|<=>(?:<ID>|<NUM>|<STR>))*"
        return [json, rx(f"<function><ID>?<(>{inner}<:>"), rx(f"<function><ID>?<(>{inner}<)><:>"), rx("(?:<const>|<let>|<var>)<ID><:>"), rx(f"(?:<;>|<}}>|<{{>)(?:<NL>)*<ID><(>{inner}<)><:>(?:[^<;><?>])*?<{{>")]
    if family == "luau":
        return [json, rx("<local>(?!<ID>|<function>)"), rx("<if>[^<then><end>]*<end>"), rx("(?:<then>|<do>|<else>|<end>|<repeat>|<;>|<)>|<]>|<}>|<STR>|<NUM>|<nil>|<true>|<false>)<ID><ID>")]
    if family == "php":
        return [json, rx("<)><:><?>?<ID><VAR>"), rx("(?:<;>|<{>|<}>)<ID><VAR>")]
    return [json]


#: reduced groups: round, square, curly; a header that no statement has (it may be a method's name), and a group that holds one
_P, _S, _B, _Q, _BQ = "\x01\x02\x03\x04\x05"
_BRACES = ("typescript", "javascript", "csharp", "php", "rust")


@cache
def _statements(family: str) -> tuple:
    """(faults within a level, headers of no statement, innermost groups, faults that follow reduction) by the statement productions of the grammars."""
    m = memo(family).code

    def rx(p: str) -> re.Pattern:
        """<x>: the class of x; P, S, B: reduced groups; Z: anything within the level; !(a|b): no class of these within the level."""
        one = lambda x: re.escape(m.get(x, m["BAD"]))
        brackets = "".join(one(x) for x in ("(", ")", "[", "]", "{", "}", "#[", "#!["))
        p = re.sub(r"!\(([^()]*)\)", lambda x: "[^" + brackets + "".join(one(y) for y in x[1].split("|") if y) + "]*", p)
        p = p.replace("Z", f"[^{brackets}]*").replace("P", _P).replace("S", _S).replace("B", _B)
        return re.compile(re.sub(r"«([^«»]+)»", lambda x: one(x[1]), p))

    name = "".join(f"(?<!«{x}»)" for x in (".", "?.", "->", "?->", "::", "function", "fn", "const", "&", "@", "async", "get", "set", "*", "static") if x in m)
    inside, headers = [], []
    # neither three parts nor a collection
    two = "!(;)«;»!(;)«;»!(;)"
    if family in ("typescript", "javascript"):
        headers = [name + f"«for»(?:«await»)?«(»(?!{two}«)»)!(of|in)«)»", name + "(?:«if»|«while»|«switch»)«(»«)»", name + "«switch»P«{»(?!«case»|«default»|«}»)Z«}»"]
        inside = [name + "«try»B(?!«catch»|«finally»)", name + "«do»B(?!«while»P)", "(?<!«try»)(?<!«catch»)(?<!«catch»P)B«finally»B", "(?<!«try»)B«catch»B", "«{»!(if)" + name + "«else»(?=B|«return»|«if»|«throw»)"]
    elif family == "csharp":
        inside = [
            f"«for»«(»(?!{two}«)»)Z«)»", "«foreach»«(»!(in)«)»", "(?:«if»|«while»|«switch»|«lock»|«catch»|«foreach»)«(»«)»", "«try»B(?!«catch»|«finally»)", "«do»B(?!«while»P)",
            "(?<!«try»)(?<!«catch»)(?<!«catch»P)(?<!«when»P)B(?:«catch»|«finally»)", "«{»!(if)«else»", "«switch»P«{»(?!«case»|«default»|«}»)Z«}»",
        ]
    elif family == "php":
        inside = [
            name + f"«for»«(»(?!{two}«)»)Z«)»", name + "«foreach»«(»!(as)«)»", name + "(?:«if»|«while»|«switch»|«elseif»|«catch»|«foreach»)«(»«)»", name + "«try»B(?!«catch»|«finally»)", name + "«do»B(?!«while»P)",
            "(?<!«try»)(?<!«catch»P)B(?:«catch»P|«finally»B)", "«{»!(if|elseif)" + name + "«else»(?=B|«:»)", name + "«switch»P«{»(?!«case»|«default»|«}»|«TAG»)Z«}»",
        ]
    elif family == "rust":
        inside = ["(?:«;»|«{»|B)«for»(?!«<»)!(in|;)B", "«match»!(;|=>)«{»(?!«}»)!(=>)«}»", "«{»!(if|let)«else»", "(?:«if»|«else»«if»)B(?!B|P|«.»)«else»"]
    groups = [(rx(f"«{a}»Z«{b}»"), c) for a, b, c in (("(", ")", _P), ("[", "]", _S), ("{", "}", _B), ("#[", "]", _S), ("#![", "]", _S)) if a in m and b in m]
    # a group that holds such a header: a block has a fault, a class or an object a method of that name
    held = rx(f"«{{»[^«{{»«}}»«(»«)»«[»«]»]*{_Q}Z«}}»")
    block = rx(f"(?:P|«else»|«try»|«do»|«finally»|«=>»|«;»|«{{»|B){_BQ}")
    classes = rx(f"«class»[^«;»«{{»«}}»{_B}{_BQ}]*{_BQ}")
    return [rx(x) for x in inside], [rx(x) for x in headers], groups, held, block, classes


def statement_faults(family: str, s: str) -> int:
    """Statements of a class string that no production has: reduced from the innermost groups out."""
    if family == "luau":
        return sum(len(p.findall(s)) for p in _luau_statements())
    if family not in _BRACES:
        return 0
    inside, headers, groups, held, block, classes = _statements(family)
    s, faults, n = memo(family).code["{"] + s, 0, -1
    while n != len(s):
        n = len(s)
        for p in headers:
            s = p.sub(lambda x: _Q + (_P if x[0][-1] == memo(family).code[")"] else _B), s)
        faults += sum(len(p.findall(s)) for p in inside)
        if headers and _Q in s:
            s = held.sub(_BQ, s)
        if _BQ in s:
            s = classes.sub(_B, s)
            faults += len(block.findall(s))
            s = s.replace(_BQ, _B)
        for p, c in groups:
            s = p.sub(c, s)
    # what is left stands at file level, where no method does
    return faults + s.count(_Q)


@cache
def _luau_statements() -> list[re.Pattern]:
    m = memo("luau").code
    rx = lambda p: re.compile(re.sub(r"«([^«»]+)»", lambda x: re.escape(m.get(x[1], m["BAD"])), p))
    return [rx("«for»[^«=»«in»«do»]*«do»"), rx("«for»«ID»«=»[^«,»«do»«function»]*«do»"), rx("«elseif»[^«then»«function»«if»]*(?:«end»|«elseif»|«else»)"), rx("«while»[^«do»«function»«if»]*«end»")]


@cache
def _names(family: str) -> list[str]:
    """Names of the class characters in order, then of reduced groups."""
    return [*memo(family).code, *sorted(set(REDUCED.values()))]


@cache
def _levels(family: str) -> list[tuple[re.Pattern, str]]:
    """Innermost groups and the character that a reduced one is."""
    m, names = memo(family).code, _names(family)
    brackets = "".join(re.escape(m[x]) for x in ("(", ")", "[", "]", "{", "}", "#[", "#![") if x in m)
    return [(re.compile(f"{re.escape(m[a])}([^{brackets}]*){re.escape(m[b])}"), chr(0x100 + names.index(REDUCED[a]))) for a, b in BRACKETS.items() if a in m and b in m]


def packed_windows(family: str) -> bytes:
    """``grammars.windows`` of the family, of tokens and of reduced levels, as bits: made once, sent to the tasks."""
    return np.packbits([windows(family, _names(family), reduced) for reduced in (False, True)]).tobytes()


@cache
def _cubes(family: str, bits: bytes) -> np.ndarray:
    n = len(_names(family)) ** 3
    return np.unpackbits(np.frombuffer(bits, np.uint8))[: 2 * n].astype(bool).reshape(2, n)


def window_faults(family: str, s: str, bits: bytes) -> int:
    """Distinct windows of three successive classes that no production of the grammar has: of tokens, and of each level of brackets.

    Levels are reduced from the innermost groups out; a line end that may end a statement cuts a window.
    """
    nl, k, faults = memo(family).code["NL"], len(_names(family)), 0
    parts, whole, n = [], s, -1
    while n != len(s):
        n = len(s)
        for rx, c in _levels(family):
            parts += rx.findall(s)
            s = rx.sub(c, s)
    parts.append(s)
    for cube, text in zip(_cubes(family, bits), (whole, nl.join(set(parts)))):
        a = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) - 0x100
        if len(a) > 2:
            solid = a != ord(nl) - 0x100
            code = ((a[:-2] * k + a[1:-1]) * k + a[2:])[solid[:-2] & solid[1:-1] & solid[2:]]
            faults += len(np.unique(code[~cube[code]]))
    return faults


_CLOSER = {")": "(", "]": "[", "}": "{"}


@cache
def _bracket_rx(family: str) -> tuple:
    m = memo(family).code
    if family == "luau":
        # block words are brackets too; an if-expression has no end
        before = "".join(m[x] for x in ("=", "(", ",", "return", "and", "or", "{", "BIN", "-", "[", "else", "<", ">", "not") if x in m)
        expr_if = re.compile(f"[{re.escape(before)}]{m['if']}")
        table = {ord(m[k]): v for k, v in {"(": "(", ")": ")", "[": "[", "]": "]", "{": "{", "}": "}", "function": "<", "do": "<", "if": "<", "end": ">", "repeat": "r", "until": "u"}.items()}
        keep = re.compile("[^" + re.escape("".join(chr(k) for k in table)) + "]+")
        return keep, table, (expr_if, m["if"])
    table = {ord(m[k]): k[-1] for k in ("(", ")", "[", "]", "{", "}") if k in m} | {ord(m[k]): "[" for k in ("#[", "#![") if k in m}
    return re.compile("[^" + re.escape("".join(chr(k) for k in table)) + "]+"), table, None


def residue(s: str) -> str:
    """The bracket string without its matching pairs (closers before openers if it is sound so far)."""
    n = -1
    while n != len(s):
        n = len(s)
        s = s.replace("()", "").replace("[]", "").replace("{}", "").replace("<>", "").replace("ru", "")
    return s


def _dm(tokens: list[str], m: _Memo) -> tuple[set, int, str, str]:
    """Pairs within logical lines, indentation faults, and the class string without and with line ends."""
    code, pairs, faults, whole = m.code, set(), 0, []
    start, end = code["START"], code["END"]
    stack, depth, line, indent, prev_open, control = [0], 0, [], 0, True, {}
    opener_words = {code[w] for w in ("if", "else", "for", "while", "do", "switch", "spawn", "try", "catch", "proc", "verb") if w in code}
    before: dict[int, str] = {}  # first class of the last line at each indentation
    owed = {code[a]: code[b] for a, b in (("try", "catch"), ("do", "while")) if a in code and b in code}
    owner = {code["else"]: {code["if"], code["else"]}, code["catch"]: {code["try"]}}
    slash, assign, lpar, ident, var = code["/"], code["="], code["("], code["ID"], code["var"]
    lb, rb = {code[x] for x in "(["}, {code[x] for x in ")]"}

    def flush() -> None:
        nonlocal line, prev_open, faults
        if not line:
            return
        s = "".join(line)
        line = []
        whole.append(s)
        t = start + s + end
        pairs.update(map(str.__add__, t, t[1:]))
        for k in [k for k in before if k > indent]:
            faults += before.pop(k) in owed
        if s[0] != code["}"] and s[0] != code["{"]:
            last = before.get(indent)
            faults += last in owed and s[0] != owed[last] or s[0] in owner and last not in owner[s[0]]
            before[indent] = s[0]
        if indent > stack[-1]:
            if not prev_open:
                faults += 1
            stack.append(indent)
        else:
            while indent < stack[-1]:
                stack.pop()
            if indent != stack[-1]:
                faults += 1
        inside = any(control.get(x) for x in stack[:-1])
        if s[0] in opener_words:
            prev_open, control[indent] = True, True
        elif s[0] == slash:
            prev_open, control[indent] = True, lpar in s
        elif s[0] == ident:
            prev_open = not inside and assign not in s
            control[indent] = lpar in s
        elif s[0] == var:
            prev_open, control[indent] = assign not in s and len(s) < 8, False
        else:
            prev_open, control[indent] = False, False

    nxt = 0
    for t in tokens:
        if t[0] == "\n":
            if depth <= 0:
                flush()
                nxt = len(t) - 1
            continue
        c = m[t]
        if not c:
            continue
        if not line:
            indent = nxt
        line.append(c)
        if c in lb:
            depth += 1
        elif c in rb:
            depth -= 1
    flush()
    faults += sum(x in owed for x in before.values())
    return pairs, faults, "".join(whole), code["NL"].join(whole)


def check(family: str, data: bytes, bits: bytes | None = None) -> tuple[list[int], list[str], int]:
    """(distinct pair codes, bracket residues by block, statement faults) of one body; ``bits``: ``packed_windows`` of the family, else they are made here.

    Undecodable bytes become U+FFFD, which is harmless in a comment or a string
    and a stray token elsewhere.  An empty body has no pairs and no faults.
    """
    text = data.decode("utf-8", "replace")
    if text[:1] == "﻿":
        text = text[1:]
    if text.startswith("#!") and not text.startswith("#!["):
        text = text[text.find("\n") :] if "\n" in text else ""
    faults = 0
    if family == "php":
        at = text.lower().find("<?")
        if at < 0:
            return [], [], 0
        if text[at : at + 5].lower() != "<?php" and text[at : at + 3] != "<?=":
            faults += 1
        text = text[at + (5 if text[at : at + 5].lower() == "<?php" else 3) :]
        if "<<<" in text:
            text = HEREDOC.sub('""', text)
    m = memo(family)
    tokens = MASTER[family].findall(text)
    base = 0x100
    level = None
    if family == "dreammaker":
        pairs, more, s, level = _dm(tokens, m)
        faults += more
        codes = {(ord(p[0]) - base) * 1024 + ord(p[1]) - base for p in pairs}
    else:
        s = level = "".join([m[t] for t in tokens])
        t = m.code["START"] + s + m.code["END"]
        nl = m.code["NL"]
        if nl in t:
            t = re.sub(nl + "{2,}", nl, t)
            s = t.replace(nl, "")[1:-1]
            ok, codes = permissible(family), set()
            for a, b, c in set(zip(t, t[1:], t[2:] + nl)):
                if b == nl:
                    if a != nl and c != nl:
                        x = (ord(a) - base) * 1024 + ord(c) - base
                        codes.add(x if x in ok else x + NEWLINE_CODE)
                elif a != nl:
                    codes.add((ord(a) - base) * 1024 + ord(b) - base)
        else:
            codes = {(ord(a) - base) * 1024 + ord(b) - base for a, b in set(zip(t, t[1:]))}
    for p in _productions(family):
        faults += len(p.findall(s))
    faults += statement_faults(family, s)
    if level:
        faults += window_faults(family, level, packed_windows(family) if bits is None else bits)
    keep, table, expr_if = _bracket_rx(family)
    if expr_if:
        s = expr_if[0].sub(lambda x: x[0].replace(expr_if[1], ""), s)
    br = keep.sub("", s).translate(table)
    blocks = [residue(br[i : i + BLOCK]) for i in range(0, len(br), BLOCK)]
    return sorted(codes), blocks, faults


def decode_pair(family: str, code: int) -> tuple[str, str, bool]:
    names = {ord(c) - 0x100: n for n, c in memo(family).code.items()}
    c = code % NEWLINE_CODE
    return names[c // 1024], names[c % 1024], code >= NEWLINE_CODE
