"""Lexers for the seven source languages of the parse check.

One regular expression per language turns a body into tokens; a token's class
is one character, so a body becomes a short class string that the checks in
``parsecheck`` work on.  Patterns are written so that no alternative can
backtrack over more than one token.
"""

from __future__ import annotations

import re

#: path extension -> language family
EXTENSIONS = {
    "rs": "rust",
    "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "mjs": "javascript", "cjs": "javascript",
    "cs": "csharp",
    "php": "php", "phtml": "php",
    "luau": "luau", "lua": "luau",
    "dm": "dreammaker",
}

WORD = r"[^\W\d]\w*"
NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?)[A-Za-z_]?\w*"
DQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*"'
SQ = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'"
DQ_ML = r'"(?:[^"\\]|\\[\s\S])*"'
SQ_ML = r"'(?:[^'\\]|\\[\s\S])*'"
BLOCK = r"/\*[\s\S]*?\*/"
#: three levels of nested block comments
_N0 = r"/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/"
_N1 = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|" + _N0 + r")*\*/"
NESTED = r"/\*(?:[^*/]|\*(?!/)|/(?!\*)|" + _N1 + r")*\*/"
LINE = r"//[^\n]*"
#: a template literal whose substitutions hold balanced braces and plain templates
_SUB = r"\$\{(?:[^{}`]|`[^`]*`|\{[^{}`]*\})*\}"
TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|" + _SUB + r")*`"
#: a regular expression literal together with the token that makes it one
REGEX = r"(?:[=(,:\[!&|?{};]|\breturn)[ \t]*/(?![/*])(?:[^\n/\\\[]|\\.|\[(?:[^\]\n\\]|\\.)*\])+/[a-z]*"

_JS_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*"
_RS_OPS = r"\.\.=|\.\.\.|\.\.|::|->|=>|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|<<=|>>=|<<|>>"
_CS_OPS = r"\?\?=|<<=|>>=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|->|::|\.\."
_PHP_OPS = r"<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|->|=>|::|==|!=|<>|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|<<|>>|\*\*"
_LUA_OPS = r"\.\.\.|\.\.=|\.\.|==|~=|<=|>=|->|::|\+=|-=|\*=|//=|/=|%=|\^=|//"
_DM_OPS = r"<<=|>>=|\*\*|==|!=|<>|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\?\.|\?:|\.\.|::"

_LUA_LONG = r"\[\[[\s\S]*?\]\]|\[=\[[\s\S]*?\]=\]|\[==\[[\s\S]*?\]==\]|\[===\[[\s\S]*?\]===\]"


#: a merge conflict marker at the start of a line; one inside a comment or string is part of that token
CONFLICT = r"(?m:^(?:<{7}|>{7}|={7}|\|{7})(?:[ \t\r][^\n]*)?(?=\n|\Z))"


def _rx(*parts: str) -> re.Pattern:
    return re.compile("|".join((CONFLICT, *parts)))


MASTER = {
    "rust": _rx(
        LINE, NESTED, r'b?r"[^"]*"', r'b?r#"[\s\S]*?"#', r'b?r##"[\s\S]*?"##', r'b?r###"[\s\S]*?"###', "b?c?" + DQ_ML,
        r"b?'(?:[^'\\\n]|\\[^\n']{1,10}|\\')'", r"'" + WORD, "r#" + WORD, WORD, NUMBER, r"#!?\[", _RS_OPS, r"\n", r"\S",
    ),
    "typescript": _rx(LINE, BLOCK, REGEX, DQ, SQ, TEMPLATE, r"@" + WORD + r"(?:\." + WORD + r")*", r"[#$]?[^\W\d$][\w$]*|\$[\w$]*", NUMBER, _JS_OPS, r"\n", r"\S"),
    "csharp": _rx(
        LINE, BLOCK, r'"""[\s\S]*?"""', r'(?:\$@|@\$|@)"(?:[^"]|"")*"', r"\$?" + DQ, r"'(?:[^'\\\n]|\\[^\n']{1,10}|\\')'",
        r"@?" + WORD, NUMBER, r"(?m:^[ \t]*#[^\n]*)", _CS_OPS, r"\n", r"\S",
    ),
    "php": _rx(
        r"\?>[\s\S]*?(?:<\?(?:php\b|=)|\Z)", r"(?://|#(?!\[))(?:[^\n?]|\?(?!>))*", BLOCK, DQ_ML, SQ_ML, r"`[^`]*`",
        r"<<<[ \t]*(?:\"EOT\"|'EOT'|EOT)\r?\n[\s\S]*?\n[ \t]*EOT\b", r"<<<[ \t]*(?:\"SQL\"|'SQL'|SQL)\r?\n[\s\S]*?\n[ \t]*SQL\b",
        r"<<<[ \t]*(?:\"TXT\"|'TXT'|TXT)\r?\n[\s\S]*?\n[ \t]*TXT\b", r"<<<[ \t]*(?:\"HTML\"|'HTML'|HTML)\r?\n[\s\S]*?\n[ \t]*HTML\b",
        r"\$+" + WORD, r"\\?" + WORD + r"(?:\\" + WORD + r")*", NUMBER, r"#\[", _PHP_OPS, r"\n", r"\S",
    ),
    "luau": _rx(
        r"--\[\[[\s\S]*?\]\]|--\[=\[[\s\S]*?\]=\]|--\[==\[[\s\S]*?\]==\]", r"--(?!\[=*\[)[^\n]*", _LUA_LONG, DQ, SQ, r"`(?:[^`\\\n]|\\[\s\S])*`",
        r"@?" + WORD, NUMBER, _LUA_OPS, r"\n", r"\S",
    ),
    "dreammaker": _rx(
        LINE, NESTED, r'\{"[\s\S]*?"\}', r'"(?:[^"\\\n\[]|\\[\s\S]|\[(?:[^\[\]"\n]|"[^"\n]*"|\[[^\[\]\n]*\])*\])*"', r"'[^'\n]*'",
        r"(?m:^[ \t]*#[^\n]*(?:\\\n[^\n]*)*)", WORD, NUMBER, _DM_OPS, r"\n[ \t]*", r"\S",
    ),
}
MASTER["javascript"] = MASTER["typescript"]

#: any here-document label that the four common ones above don't cover
HEREDOC = re.compile(r"<<<[ \t]*([\"']?)(" + WORD + r")\1\r?\n(?:[\s\S]*?\n)?[ \t]*\2\b")
