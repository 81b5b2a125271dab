"""Small grammars whose adjacent terminals give the permissible token pairs, and the permissible windows within a level of brackets.

Notation of ``GRAMMARS``: ``name = alternatives ;`` with ``|``, ``?``, ``*``,
``+`` and parentheses; quoted words are terminals, ``ID``, ``NUM`` and ``STR``
are the open token classes, ``BIN`` and ``ASG`` stand for the operators listed in
``OPERATORS``.  ``adjacent`` computes, by the usual nullable/first/last fixed
point, every pair of terminals that can stand side by side in a sentence.  The
grammars describe token order only (no precedence), so they are kept short and
somewhat wider than the languages: the pair test may miss an error, and should
not report a valid body.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

_EXPR_BRACE = """
args = ( "(" ( arg ( "," arg )* ","? )? ")" ) ;
"""

GRAMMARS = {
    "rust": r"""
file = item* | stmt* ;
attr = "#[" any "]" | "#![" any "]" ;
any = meta ( "," meta )* ","? ;
meta = ( ID | "type" | "crate" | "self" ) ( "::" ID )* ( "=" ( STR | NUM | "-" NUM | ID ) | "(" any? ")" )? | STR | NUM ;
vis = "pub" ( "(" ( "crate" | "super" | "self" | "in" path ) ")" )? ;
item = attr* vis? ( fnitem | structitem | enumitem | implitem | traititem | moditem | useitem | constitem | typeitem | macro | externitem ) ;
externitem = "extern" STR? ( "{" item* "}" | "crate" ID ";" | fnitem ) ;
generics = "<" ( gparam ( "," gparam )* ","? )? ">" ;
gparam = LIFE ( ":" LIFE ( "+" LIFE )* )? | "const" ID ":" type | ID ( ":" bounds )? ( "=" type )? ;
bounds = ( "?"? ( path | LIFE | "for" generics path ) ( "+" "?"? ( path | LIFE ) )* ) ;
where = "where" ( whereitem ( "," whereitem )* ","? )? ;
whereitem = ( "for" generics )? ( type | LIFE ) ":" bounds? ;
fnitem = ( "const" | "async" | "unsafe" | "extern" STR? )* "fn" ID generics? "(" ( attr* param ( "," attr* param )* ","? )? ")" ( "->" type )? where? ( block | ";" ) ;
param = "&"? LIFE? "mut"? "self" ( ":" type )? | pat ":" type | type | "..." ;
structitem = "struct" ID generics? where? ( fields | ";" | "(" ( vis? type ( "," vis? type )* ","? )? ")" where? ";" ) ;
fields = "{" ( attr* vis? ID ":" type ( "," attr* vis? ID ":" type )* ","? )? "}" ;
enumitem = "enum" ID generics? where? "{" ( variant ( "," variant )* ","? )? "}" ;
variant = attr* ID ( fields | "(" type ( "," type )* ","? ")" )? ( "=" expr )? ;
implitem = "unsafe"? "impl" generics? "const"? "!"? type ( "for" type )? where? "{" ( attr* vis? ( fnitem | constitem | typeitem | macro ) )* "}" ;
traititem = "unsafe"? "trait" ID generics? ( ":" bounds )? where? "{" ( attr* ( fnitem | constitem | typeitem | macro ) )* "}" ;
moditem = "mod" ID ( ";" | "{" item* "}" ) ;
useitem = "use" "::"? usetree ";" ;
usetree = ( ( ID | "crate" | "self" | "super" ) ( "::" ( ID | "self" | "super" ) )* ( "::" ( "*" | "{" ( usetree ( "," usetree )* ","? )? "}" ) )? ( "as" ( ID | "_" ) )? ) | "*" | "{" ( usetree ( "," usetree )* ","? )? "}" ;
constitem = ( "const" | "static" "mut"? ) ( ID | "_" ) ":" type ( "=" expr )? ";" ;
typeitem = "type" ID generics? ( ":" bounds )? where? ( "=" type )? ";" ;
type = path | "&" LIFE? "mut"? type | "&&" LIFE? "mut"? type | "*" ( "const" | "mut" ) type | "[" type ( ";" expr )? "]" | "(" ( type ( "," type )* ","? )? ")" | "!" | "_" | ( "dyn" | "impl" ) bounds | ( "unsafe" | "extern" STR? )* "fn" "(" ( type ( "," type )* ","? )? ")" ( "->" type )? | macro ;
path = "::"? seg ( "::" seg )* | "<" type ( "as" type )? ">" "::" seg ;
seg = ( ID | "crate" | "self" | "Self" | "super" ) ( "::"? gargs )? ( "(" ( type ( "," type )* )? ")" "->" type )? ;
gargs = "<" ( garg ( "," garg )* ","? )? ( ">" | ">>" ) ;
garg = type | LIFE | NUM | "-" NUM | block | ID ( "=" type | ":" bounds ) | "true" | "false" ;
block = "{" attr* stmt* expr? "}" ;
stmt = attr* ( letstmt | item | expr ";" | blockexpr | ";" | macro ";"? ) ;
letstmt = "let" pat ( ":" type )? ( "=" expr ( "else" block )? )? ";" ;
pat = "|"? pat1 ( "|" pat1 )* ;
pat1 = ( "ref" | "mut" )* ID ( "@" pat )? | "_" | ".." | "..=" patlit | patlit ( ( ".." | "..=" | "..." ) patlit? )? | path ( "(" ( pat ( "," pat )* ","? )? ")" | "{" ( fpat ( "," fpat )* ","? )? "}" )? | "(" ( pat ( "," pat )* ","? )? ")" | "[" ( pat ( "," pat )* ","? )? "]" | "&" "mut"? pat | "&&" pat | macro | "box" pat ;
fpat = ( ID ":" pat | ( "ref" | "mut" )* ID | ".." | NUM ":" pat ) ;
patlit = "-"? NUM | STR | "true" | "false" | path ;
blockexpr = ( LIFE ":" )? ( "unsafe" | "async" "move"? | "const" )? block | "if" cond block ( "else" ( "if" cond block | block ) )* | ( LIFE ":" )? "loop" block | ( LIFE ":" )? "while" cond block | ( LIFE ":" )? "for" pat "in" expr block | "match" expr "{" ( attr* pat ( "if" expr )? "=>" ( blockexpr ","? | expr "," ) )* ( attr* pat ( "if" expr )? "=>" expr )? "}" ;
cond = expr | "let" pat "=" expr ( "&&" ( expr | "let" pat "=" expr ) )* ;
expr = unary* primary postfix* ( bin expr )? | unary* primary postfix* "as" type ( bin expr )? | range | "return" expr? | "break" LIFE? expr? | "continue" LIFE? | closure ;
range = expr? ( ".." | "..=" ) expr? ;
unary = "-" | "*" | "!" | "&" "mut"? | "&&" "mut"? | "&" "raw" ;
bin = "BIN" | "-" | "*" | "&" | "&&" | "|" | "||" | "<" | ">" | "+" | "=" | "ASG" | ">>" | ".." | "..=" ;
primary = NUM | STR | "true" | "false" | path | path "{" ( ( fieldinit ( "," fieldinit )* ","? )? ( ".." expr )? ) "}" | "(" ( expr ( "," expr )* ","? )? ")" | "[" ( expr ( ( "," expr )* ","? | ";" expr ) )? "]" | blockexpr | macro | "_" ;
fieldinit = attr* ( ID | NUM ) ( ":" expr )? ;
postfix = "?" | "." ( ID ( "::" gargs )? | NUM | "await" ) | "(" ( expr ( "," expr )* ","? )? ")" | "[" expr "]" ;
closure = ( "move" | "async" | "static" )* ( "||" | "|" ( pat ( ":" type )? ( "," pat ( ":" type )? )* ","? )? "|" ) ( "->" type block | expr ) ;
macro = path "!" ( "(" margs ")" | "[" margs "]" | "{" ( stmt* | margs ) "}" ) ";"? ;
margs = ( expr ( ( "," | ";" | "=>" ) expr )* ( "," | ";" )? | ID "=" expr | type | pat )? ;
""",
    "typescript": r"""
file = stmt* ;
stmt = block | ";" | decl | "import" imp | "export" exp | "if" "(" e ")" stmt ( "else" stmt )? | "for" "await"? "(" forhead ")" stmt | "while" "(" e ")" stmt | "do" stmt "while" "(" e ")" ";"? | "return" e? ";" | ( "break" | "continue" ) ID? ";" | "throw" e ";" | "try" block ( "catch" ( "(" bind ")" )? block )? ( "finally" block )? | "switch" "(" e ")" "{" ( ( "case" e | "default" ) ":" stmt* )* last? "}" | ID ":" stmt | e ";" | "debugger" ";" ;
endings = ";" | "return" | "break" | "continue" | "debugger" | ID | NUM | STR | "TPL" | ")" | "]" | "}" | "++" | "--" | "this" | "null" | "true" | "false" | "super" ;
block = "{" stmt* last? "}" ;
last = e | "return" e? | ( "break" | "continue" ) ID? | "throw" e | ( "const" | "let" | "var" ) bind ( "," bind )* | "do" stmt "while" "(" e ")" | "if" "(" e ")" ( stmt "else" )? last | ( "for" "await"? "(" forhead ")" | "while" "(" e ")" ) last | "debugger" ;
decl = ( "const" | "let" | "var" ) "enum"? bind ( "," bind )* ";" | "async"? "function" "*"? ID? tparams? params ret? ( block | ";" ) | decorator* "abstract"? "class" ID? tparams? ( "extends" e )? ( "implements" type ( "," type )* )? cbody | TYPED ;
bind = target "!"? ( ":" type )? ( "=" e )? ;
target = ID | "{" ( prop1 ( "," prop1 )* ","? )? "}" | "[" ( ","* ( "..."? target ( "=" e )? )? ( ","+ "..."? target ( "=" e )? )* ","? ) "]" ;
prop1 = "..." target | key ( ":" target )? ( "=" e )? ;
forhead = ( ( "const" | "let" | "var" ) bind ( "," bind )* | e )? ( ";" e? ";" e? | ( "of" | "in" ) e ) ;
imp = STR ";" | "type"? ( ID ( "," )? )? ( "*" "as" ID | "{" ( spec ( "," spec )* ","? )? "}" )? "from" STR ( "with" obj )? ";" | ( "." ID | "(" e ")" ) post* ";" | ID "=" e ";" ;
spec = "type"? key ( "as" key )? ;
exp = "default" ( decl | e ";" ) | decl | "type"? "*" ( "as" key )? "from" STR ";" | "type"? "{" ( spec ( "," spec )* ","? )? "}" ( "from" STR )? ";" | "=" e ";" ;
params = "(" ( param ( "," param )* ","? )? ")" ;
param = decorator* mods? "..."? ( target | "this" ) OPT? ( ":" type )? ( "=" e )? ;
OPT = "?" ;
ret = ":" ( type | ID "is" type | "asserts" ID ) ;
decorator = "DECO" args? ;
cbody = "{" ( ";" | decorator* mods? ( "static" block | ( "get" | "set" )? "*"? key OPT? "!"? tparams? ( params ret? ( block | ";" ) | ( ":" type )? ( "=" e )? ";" ) | "[" ID ":" type "]" ":" type ";" ) )* ( mods? key ( ":" type )? ( "=" e )? )? "}" ;
mods = ( "static" | "async" | "get" | "set" | "MOD" )* ;
key = ID | STR | NUM | "[" e "]" | KW ;
KW = "default" | "import" | "export" | "class" | "new" | "delete" | "in" | "of" | "if" | "for" | "catch" | "finally" | "return" | "this" | "null" | "true" | "false" | "function" | "static" | "get" | "set" | "async" | "await" | "type" | "from" | "as" | "with" | "case" | "do" | "else" | "enum" | "extends" | "super" | "switch" | "throw" | "try" | "typeof" | "var" | "void" | "while" | "yield" | "const" | "let" | "break" | "continue" | "debugger" | "instanceof" | "is" | "MOD" | "implements" | "abstract" | "TYPEKW" ;
e = ( unary* prim post* | arrow ) ( ( bin | "?" e ":" | "=" | "ASG" | "," ) e )? | "yield" "*"? e? | unary* prim post* ( "as" | "is" ) ( type | "const" ) ;
unary = "!" | "-" | "+" | "~" | "++" | "--" | "typeof" | "void" | "delete" | "await" | "..." | "new" ;
bin = "BIN" | "-" | "+" | "*" | "<" | ">" | "in" | "of" | "instanceof" | "|" | "&" | "/" | "??" ;
prim = ID | NUM | STR | "TPL" | "this" | "super" | "null" | "true" | "false" | "(" e? ")" | "[" ( ","* e ( ","+ e )* ","? )? "]" | obj | "async"? "function" "*"? ID? tparams? params ret? block | decorator* "class" ID? tparams? ( "extends" e )? cbody | "new" "." ID | "import" ( "." ID | args ) | SOFT ;
SOFT = "of" | "get" | "set" | "type" | "from" | "as" | "async" | "is" | "await" | "yield" | "let" | "static" | "MOD" | "abstract" | "TYPEKW" ;
obj = "{" ( prop ( "," prop )* ","? )? "}" ;
prop = "..." e | ( "async" | "get" | "set" )* "*"? key ( OPT? ":" e | tparams? params ret? block | "=" e )? ;
post = "." key | "?." ( key | args | "[" e "]" ) | args | "[" e "]" | "TPL" | "++" | "--" | "!" | "<" type ( "," type )* ">" ( args | "TPL" ) ;
args = "(" ( e ( "," e )* ","? )? ")" ;
arrow = "async"? ( ID | tparams? params ret? ) "=>" ( e | block ) ;
""",
    "typed": r"""
TYPED = "MOD"? ( ( "interface" | "TYPEKW" ) ID tparams? ( "extends" type ( "," type )* )? tobj | "type" ID tparams? "=" type ";" | ( "namespace" | "module" ) ( ID ( "." ID )* | STR ) block | "const"? "enum" ID "{" ( key ( "=" e )? ( "," key ( "=" e )? )* ","? )? "}" ) | "MOD" ( decl | "TYPEKW" block ) ;
tparams = "<" ( "const" | "in" | "out" )* ID ( "extends" type )? ( "=" type )? ( "," ID ( "extends" type )? ( "=" type )? )* ","? ">" ;
type = ( "readonly" | "MOD" | "keyof" | "unique" | "typeof" | "infer" | "asserts" | "abstract" | "new" )* tprim tpost* ( ( "|" | "&" | "extends" | "is" ) type )? ( "?" type ":" type )? | ( "|" | "&" ) type | "new"? tparams? params "=>" type ;
tprim = ID | NUM | STR | "TPL" | "-" NUM | "null" | "true" | "false" | "void" | "this" | "import" args | "(" type ")" | tobj | "[" ( tel ( "," tel )* ","? )? "]" | "TYPEKW" | "const" ;
tel = "..."? ( ID "?"? ":" )? type "?"? ;
tpost = "[" type? "]" | "." ID | "<" type ( "," type )* ( ">" | ">>" ) | "!" ;
tobj = "{" ( tmem ( ";" | "," ) )* tmem? "}" ;
tmem = ( "MOD" | "get" | "set" | "-" | "+" )* ( key OPT? ( ":" type | tparams? params ret? )? | "[" ID ( ":" | "in" ) type ( "as" type )? "]" "-"? OPT? ":" type | "new"? params ret? | tparams params ret? ) ;
""",
    "csharp": r"""
file = ( using | attrs | nsdecl | typedecl | stmt )* ;
using = "global"? "using" "static"? ( ID "=" )? type ";" | "extern" "ALIAS" ID ";" ;
attrs = "[" ( ID ":" | "return" ":" )? type args? ( "," type args? )* ","? "]" ;
nsdecl = "namespace" type ( ";" | "{" ( using | attrs | nsdecl | typedecl )* "}" ) ;
typedecl = attrs* mod* ( "class" | "struct" | "interface" | "record" ( "class" | "struct" )? ) ID tparams? params? ( ":" type args? ( "," type )* )? constraint* ( "{" member* "}" ";"? | ";" ) | attrs* mod* "enum" ID ( ":" type )? "{" ( attrs* ID ( "=" e )? ( "," attrs* ID ( "=" e )? )* ","? )? "}" ";"? | attrs* mod* "delegate" type ID tparams? params constraint* ";" ;
constraint = "where" ID ":" ( type | "class" "?"? | "struct" | "new" "(" ")" | "default" ) ( "," ( type | "class" | "struct" | "new" "(" ")" ) )* ;
mod = "MOD" | "static" | "const" | "new" | "async" | "ref" | "readonly" | "extern" | "unsafe" ;
tparams = "<" attrs* ( "in" | "out" )? ID ( "," attrs* ( "in" | "out" )? ID )* ">" ;
member = typedecl | attrs* mod* ( "event"? type ID ( "=" e )? ( "," ID ( "=" e )? )* ";" | "event"? type mname ( "{" accessor* "}" ( "=" e ";" )? | "=>" e ";" ) | type mname tparams? params constraint* ( block | "=>" e ";" | ";" ) | "~"? ID params ( ":" ( "base" | "this" ) args )? ( block | "=>" e ";" | ";" ) | type "this" "[" param ( "," param )* "]" ( "{" accessor* "}" | "=>" e ";" ) | ( "implicit" | "explicit" ) "operator" type params ( block | "=>" e ";" ) | type "operator" op params ( block | "=>" e ";" ) ) | ";" ;
op = "+" | "-" | "*" | "!" | "<" | ">" | "BIN" | "true" | "false" | "~" | "++" | "--" | "&" | "|" ;
mname = ID ( "." ID | "<" type ">" )* ;
accessor = attrs* mod* ( "get" | "set" | ID ) ( ";" | block | "=>" e ";" ) ;
params = "(" ( param ( "," param )* ","? )? ")" ;
param = attrs* ( "this" | "ref" | "out" | "in" | "params" | "scoped" | "readonly" )* type ID? ( "=" e )? ;
type = ( "ref" "readonly"? )? ( ID ( "::" ID )? | "TYPEKW" | "void" | "var" | "dynamic" | "(" type ID? ( "," type ID? )+ ")" ) ( "." ID )* targs? ( "." ID targs? )* ( "?" | "[" ","* "]" | "*" )* ;
targs = "<" ( type ( "," type )* | ","* ) ( ">" | ">>" ) ;
block = "{" stmt* "}" ;
stmt = block | ";" | attrs* mod* type ID ( "=" e )? ( "," ID ( "=" e )? )* ";" | attrs* mod* type ID tparams? params constraint* ( block | "=>" e ";" ) | "if" "(" e ")" stmt ( "else" stmt )? | "for" "(" ( type ID "=" e ( "," ID "=" e )* | e ( "," e )* )? ";" e? ";" ( e ( "," e )* )? ")" stmt | "await"? "foreach" "(" ( type | "var" ) ( ID | "(" ID ( "," ID )* ")" ) "in" e ")" stmt | "while" "(" e ")" stmt | "do" stmt "while" "(" e ")" ";" | "return" e? ";" | ( "break" | "continue" ) ";" | "throw" e? ";" | "try" block ( "catch" ( "(" type ID? ")" )? ( "when" "(" e ")" )? block )* ( "finally" block )? | "switch" "(" e ")" "{" ( ( "case" pat ( "when" e )? | "default" ) ":" | stmt )* "}" | ( "lock" | "fixed" ) "(" ( type ID "=" )? e ")" stmt | "await"? "using" ( "(" ( type ID "=" )? e ")" stmt | type ID "=" e ";" ) | ID ":" stmt | e ";" | "goto" ( ID | "case" e | "default" ) ";" | ( "checked" | "unchecked" | "unsafe" ) block | "yield" ( "return" e | "break" ) ";" ;
pat = "not"? ( e | type ID? | "{" ( ID ":" pat ( "," ID ":" pat )* )? "}" | ( "<" | ">" | "BIN" ) e | "(" pat ( "," pat )* ")" | "var" ID | "null" | "[" pat "]" ) ( ( "and" | "or" ) pat )? ;
e = unary* prim post* ( ( bin | "?" e ":" | "=" | "ASG" ) e )? | lambda | "throw" e | "from" ID "in" e | unary* prim post* ( "is" | "as" ) pat ( bin e )? | prim "switch" "{" ( pat ( "when" e )? "=>" e ","? )* "}" | prim "with" "{" init "}" | ( "ref" | "out" | "in" ) ( e | type ID ) ;
unary = "!" | "-" | "+" | "~" | "++" | "--" | "(" type ")" | "await" | "&" | "*" | "^" ;
bin = "BIN" | "-" | "+" | "*" | "<" | ">" | "|" | "&" | "??" | ".." | ">>" | "^" ;
prim = ID | NUM | STR | "this" | "base" | "null" | "true" | "false" | "default" ( "(" type ")" )? | "(" e ( "," e )* ")" | "new" type? ( args | "[" e ( "," e )* "]" | "[" "]" )* ( "{" init? "}" )? | ( "typeof" | "sizeof" | "nameof" | "checked" | "unchecked" ) "(" ( type | e ) ")" | "stackalloc" type "[" e "]" | "TYPEKW" | "[" ( e ( "," e )* ","? )? "]" | SOFT | "delegate" params? block ;
SOFT = "get" | "set" | "from" | "when" | "and" | "or" | "not" | "var" | "dynamic" | "record" | "params" | "yield" | "global" | "scoped" | "nameof" | "with" ;
init = ( ( ID | "[" e "]" ) "=" ( e | "{" init "}" ) | e | "{" e ( "," e )* "}" ) ( "," ( ( ID | "[" e "]" ) "=" ( e | "{" init "}" ) | e | "{" e ( "," e )* "}" ) )* ","? ;
post = "." ID targs? | "?." ( ID targs? | "[" e "]" ) | args | "[" e ( "," e )* "]" | "++" | "--" | "!" | "->" ID | targs args | "?" "[" e "]" ;
args = "(" ( arg ( "," arg )* )? ")" ;
arg = ( ID ":" )? ( "ref" | "out" | "in" )? ( e | type ID ) ;
lambda = ( "async" | "static" )* ( ID | params | "(" ID ( "," ID )* ")" | "_" ) "=>" ( e | block ) ;
""",
    "php": r"""
file = stmt* ;
stmt = block | ";" | "TAG" | "namespace" ID? ( ";" | block ) | "use" ( "function" | "const" )? ID ( "{" ID ( "," ID )* ","? "}" )? ( "as" ID )? ( "," ID ( "as" ID )? )* ";" | attrs* decl | "if" "(" e ")" ( stmt | ":" stmt* ) | "elseif" "(" e ")" ( stmt | ":" stmt* ) | "else" ( stmt | ":" stmt* ) | ( "for" "(" es? ";" es? ";" es? ")" | "foreach" "(" e "as" ( e "=>" )? "&"? e ")" | "while" "(" e ")" | "switch" "(" e ")" ) ( stmt | ":" stmt* ) | "ENDKW" ";" | "do" stmt "while" "(" e ")" ";" | ( "return" | "break" | "continue" ) e? ";" | "echo" es ";" | "global" VAR ( "," VAR )* ";" | "static" VAR ( "=" e )? ( "," VAR ( "=" e )? )* ";" | "try" block ( "catch" "(" type VAR? ")" block )* ( "finally" block )? | "{" ( ( "case" e | "default" ) ( ":" | ";" ) stmt* )* "}" | e ( ";" | "TAG" ) | "declare" "(" ID "=" e ")" ( ";" | block ) | "const" ID "=" e ( "," ID "=" e )* ";" | "goto" ID ";" | ID ":" | "throw" e ";" | ( "unset" | "isset" ) args ";" ;
es = e ( "," e )* ;
block = "{" stmt* "}" ;
attrs = "#[" ID args? ( "," ID args? )* ","? "]" ;
decl = fn | ( "MOD" )* ( "class" ID ( "extends" ID )? ( "implements" ID ( "," ID )* )? | "interface" ID ( "extends" ID ( "," ID )* )? | "trait" ID | "enum" ID ( ":" type )? ( "implements" ID ( "," ID )* )? ) "{" member* "}" ;
fn = "function" "&"? nm params ( ":" type )? ( block | ";" ) ;
nm = ID | KW ;
KW = "MOD" | "class" | "function" | "use" | "new" | "echo" | "print" | "default" | "list" | "array" | "isset" | "unset" | "empty" | "clone" | "static" | "for" | "foreach" | "if" | "else" | "while" | "do" | "switch" | "case" | "match" | "try" | "catch" | "finally" | "throw" | "return" | "break" | "continue" | "const" | "global" | "include" | "namespace" | "trait" | "interface" | "enum" | "extends" | "implements" | "fn" | "yield" | "goto" | "declare" | "as" | "null" | "true" | "false" | "instanceof" | "and" | "exit" | "self" ;
member = attrs* ( "MOD" | "static" | "var" )* ( fn | type? VAR ( "=" e )? ( "," VAR ( "=" e )? )* ( ";" | "{" ( ID params? ( "=>" e ";" | block ) )* "}" ) | "const" nm "=" e ( "," nm "=" e )* ";" | "case" nm ( "=" e )? ";" ) | "use" ID ( "," ID )* ( ";" | "{" any "}" ) ;
any = ( ID ( "::" ID )? ( "insteadof" ID ( "," ID )* | "as" "MOD"? ID? ) ";" )* ;
params = "(" ( param ( "," param )* ","? )? ")" ;
param = attrs* ( "MOD" )* type? "&"? "..."? VAR ( "=" e )? ;
type = "?"? tname ( ( "|" | "&" ) tname )* | "(" type ")" ( "|" type )? ;
tname = ID | "array" | "static" | "self" | "null" | "false" | "true" | "fn" | "(" tname ( "&" tname )* ")" ;
e = unary* prim post* ( ( bin | "?" e ":" | "?" ":" | "=" "&"? | "ASG" ) e )? | "throw" e | unary* prim post* "instanceof" e ;
unary = "!" | "-" | "+" | "~" | "@" | "++" | "--" | "&" | "(" ID ")" | "(" "array" ")" | "new" | "clone" | "print" | "include" | "..." | "yield" "from"? ;
bin = "BIN" | "-" | "+" | "*" | "." | "<" | ">" | "|" | "&" | "??" | "and" | "=>" ;
prim = VAR | NUM | STR | ID | "null" | "true" | "false" | "self" | "static" | "array" args | "(" e ")" | "[" items "]" | "list" "(" items ")" | ( "isset" | "unset" | "empty" | "exit" ) args? | "static"? ( "function" "&"? params ( "use" "(" ( "&"? VAR ( "," "&"? VAR )* ","? )? ")" )? ( ":" type )? block | "fn" "&"? params ( ":" type )? "=>" e ) | "match" "(" e ")" "{" ( ( e ( "," e )* ","? | "default" ) "=>" e ","? )* "}" | "class" args? ( "extends" ID )? ( "implements" ID ( "," ID )* )? "{" member* "}" | "$" ( VAR | "{" e "}" ) | "yield" ;
items = ( item ( ","+ item )* )? ","? | ","+ item ;
item = ( e "=>" )? "&"? "..."? e ;
post = ( "->" | "?->" ) ( nm | VAR | "{" e "}" ) | "::" ( nm | VAR | "class" ) | "[" e? "]" | "{" e "}" | args | "++" | "--" ;
args = "(" ( arg ( "," arg )* ","? )? ")" ;
arg = ( nm ":" )? "..."? e | "..." ;
""",
    "luau": r"""
file = block ;
block = ( stmt ";"? )* ;
stmt = e "=" e ( "," e )* | e ( "," e )* "=" e ( "," e )* | e "ASG" e | call | "do" block "end" | "while" e "do" block "end" | "repeat" block "until" e | "if" e "then" block ( "elseif" e "then" block )* ( "else" block )? "end" | "for" bind ( "=" e "," e ( "," e )? | ( "," bind )* "in" e ( "," e )* ) "do" block "end" | attr* "local"? "function" fname tparams? "(" params ")" ( ":" type )? block "end" | attr* "function" fname "(" ")" ( ":" type )? block "end" | "local" bind ( "," bind )* ( "=" e ( "," e )* )? | "return" ( e ( "," e )* )? | "break" | "continue" | "::" ID "::" | "goto" ID | "export"? "type" "function"? ID tparams? "=" type ;
attr = "ATTR" ;
fname = ID ( "." ID )* ( ":" ID )? ;
bind = ID ( ":" type )? ( "<" ID ">" )? ;
params = ( bind ( "," bind )* ( "," "..." ( ":" type )? )? | "..." ( ":" type )? )? ;
tparams = "<" ID "..."? ( "," ID "..."? )* ">" ;
call = prefix ( args | ":" ID args ) ;
prefix = ID | "(" e ")" | prefix suffix | SOFT ;
SOFT = "type" | "continue" | "export" ;
suffix = "." ID | "." SOFT | "[" e "]" | ":" ID args | args ;
args = "(" ( e ( "," e )* )? ")" | table | STR ;
e = unary* prim ( bin e )? | unary* prim "::" type ( bin e )? ;
unary = "-" | "not" | "#" | "~" ;
bin = "BIN" | "-" | "<" | ">" | "and" | "or" | "~" ;
prim = "nil" | "true" | "false" | NUM | STR | "..." | table | prefix | "function" tparams? "(" params ")" ( ":" type )? block "end" | "if" e "then" e ( "elseif" e "then" e )* "else" e ;
table = "{" ( field ( ( "," | ";" ) field )* ( "," | ";" )? )? "}" ;
field = "[" e "]" "=" e | ID "=" e | SOFT "=" e | e ;
type = tprim ( "?" | ( "|" | "&" ) tprim )* | ( "|" | "&" ) type ;
tprim = ID ( "." ID )? ( "<" ( type ( "," type )* )? ">" )? "..."? | STR | "nil" | "true" | "false" | "{" ( tfield ( ( "," | ";" ) tfield )* ( "," | ";" )? )? "}" | tparams? "(" ( ( ID ":" )? type ( "," ( ID ":" )? type )* )? ")" ( "->" type )? | ID "(" e ")" | "..." type | ID "..." ;
tfield = ( ID | SOFT ) ":" type | "[" type "]" ":" type | type ;
""",
    "dreammaker": r"""
line = path ( "(" params ")" )? | path "=" e | path "{" | "var" path? ( "=" e )? ( "," ID ( "=" e )? )* | e | "if" "(" e ")" s? | "else" ( "if" "(" e ")" )? s? | "for" "(" head ")" s? | "while" "(" e ")" s? | "do" | "switch" "(" e ")" | "return" e? | ( "break" | "continue" ) ID? | "goto" ID | "del" e | "set" ID ( "=" | "in" ) e | "spawn" ( "(" e? ")" )? s? | ID ":" | "try" | "catch" ( "(" e ")" )? | "throw" e | "proc" | "verb" | path "in" e | "}" | "{" | "STR" ;
s = line | ";" | "{" ;
head = ( "var" path ( "as" as )? ( "=" e | "in" e | "=" e "," e )? | e ( "in" e )? )? ( ( ";" | "," ) e? ( ( ";" | "," ) e? )? )? | ( "var" path | ID ) ( "=" | "in" ) e "to" e ( "step" e )? ;
as = ID ( "|" ID )* | "null" ( "|" ID )* | "anything" ;
path = "/"? seg ( "/" seg )* ( "[" e? "]" )* ;
seg = ID | "proc" | "verb" | "var" | "." | "operator" | "step" | "to" | "set" | "as" ;
params = ( param ( "," param )* ","? )? ;
param = ( "var" path | path ) ( "=" e )? ( "as" as )? ( "in" e )? | "..." ;
e = unary* prim post* ( ( bin | "?" e ":" | "=" | "ASG" ) e )? ;
unary = "!" | "-" | "~" | "++" | "--" | "new" | "&" | "*" ;
bin = "BIN" | "-" | "+" | "*" | "/" | "<" | ">" | "in" | "&" | "|" | "to" | "as" ;
prim = ID | "step" | NUM | STR | "null" | ".." | "." | "new" ( path | "(" ")" )? | path | "(" e ")" | "(" ")" ;
post = ( "." | "?." | ":" | "?:" | "::" ) ( ID | "proc" ) | "[" e "]" | args | "++" | "--" | "?" "[" e "]" ;
args = "(" ( arg ( "," arg )* ","? )? ")" ;
arg = e? | ID "=" e | STR "=" e ;
""",
}
# TypeScript = the shared script grammar + types; JavaScript = the shared one with the typed parts empty
_TYPED_EMPTY = "TYPED = ; tparams = ; type = ;"
_SCRIPT = re.sub(r' \| "(?:MOD|TYPEKW|implements|abstract|is|declare)"(?= [|;)])|"(?:MOD|abstract)"\? |(?<=[(]) "MOD"(?= [)])', "", GRAMMARS["typescript"])
SOURCES = {k: GRAMMARS[k] for k in ("rust", "csharp", "php", "luau", "dreammaker")}
SOURCES["typescript"] = GRAMMARS["typescript"] + GRAMMARS["typed"]
SOURCES["javascript"] = _SCRIPT.replace('"as" | "is" ) ( type | "const" )', '"as" ) ID').replace('"implements"', '"extends"') + _TYPED_EMPTY

#: BIN and ASG operators of each family (fixed values of the languages)
OPERATORS = {
    "rust": {"BIN": "== != <= >= / % ^ <<", "ASG": "+= -= *= /= %= ^= &= |= <<= >>="},
    "typescript": {"BIN": "== != === !== <= >= && || % ** << >> >>> ^", "ASG": "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??="},
    "csharp": {"BIN": "== != <= >= && || / % <<", "ASG": "+= -= *= /= %= &= |= ^= <<= >>= ??="},
    "php": {"BIN": "== != === !== <> <= >= <=> && || / % ** << >> ^", "ASG": "+= -= *= /= .= %= &= |= ^= <<= >>= **= ??="},
    "luau": {"BIN": "== ~= <= >= + * / // % ^ ..", "ASG": "+= -= *= /= //= %= ^= ..="},
    "dreammaker": {"BIN": "== != <> <= >= && || % ** << >> ^", "ASG": "+= -= *= /= %= &= |= ^= <<= >>="},
}
#: several words of one class
WORDS = {
    "typescript": {"MOD": "public private protected readonly override accessor declare", "TYPEKW": "interface namespace module enum keyof unique infer asserts out global"},
    "csharp": {"MOD": "public private protected internal sealed abstract virtual override partial volatile file required", "TYPEKW": "int uint long ulong short ushort byte sbyte char string bool object float double decimal nint nuint"},
    "php": {"MOD": "public private protected final abstract readonly", "ENDKW": "endif endfor endforeach endwhile endswitch", "include": "include include_once require require_once", "and": "and or xor", "exit": "exit die", "self": "self parent", "TAG": ""},
    "luau": {}, "dreammaker": {}, "rust": {},
}
OPERATORS["javascript"] = OPERATORS["typescript"]
WORDS["javascript"] = {}

_ITEM = re.compile(r'"([^"]+)"|([A-Za-z_0-9]+)|([=|;?*+()])')


def _parse(source: str) -> dict:
    """Rules as nested tuples ('seq'|'alt'|'opt'|'rep', ...), strings are terminals, ('ref', name) rules."""
    toks = [("t", m[1]) if m[1] else ("n", m[2]) if m[2] else ("p", m[3]) for m in _ITEM.finditer(source)]
    at, rules = 0, {}

    def alt():
        nonlocal at
        out = [seq()]
        while toks[at] == ("p", "|"):
            at += 1
            out.append(seq())
        return out[0] if len(out) == 1 else ("alt", *out)

    def seq():
        nonlocal at
        out = []
        while toks[at] not in (("p", "|"), ("p", ")"), ("p", ";")):
            kind, text = toks[at]
            at += 1
            if (kind, text) == ("p", "("):
                node = alt()
                at += 1
            else:
                node = text if kind == "t" else ("ref", text)
            while toks[at][0] == "p" and toks[at][1] in "?*+":
                node = ("opt" if toks[at][1] == "?" else "rep" if toks[at][1] == "*" else "plus", node)
                at += 1
            out.append(node)
        return ("seq", *out)

    while at < len(toks):
        name = toks[at][1]
        at += 2
        rules[name] = alt()
        at += 1
    return rules


@cache
def adjacent(family: str) -> tuple[frozenset, frozenset, frozenset]:
    """(permissible pairs, first of a statement, last of a statement) of the family's grammar."""
    rules = _parse(SOURCES[family])
    null: dict = dict.fromkeys(rules, False)
    first: dict = {k: set() for k in rules}
    last: dict = {k: set() for k in rules}
    pairs: set = set()

    def walk(node):
        if isinstance(node, str):
            return False, {node}, {node}
        kind = node[0]
        if kind == "ref":
            name = node[1]
            return (null[name], first[name], last[name]) if name in rules else (False, {name}, {name})
        parts = [walk(x) for x in node[1:]]
        if kind == "alt":
            return any(p[0] for p in parts), set().union(*(p[1] for p in parts)), set().union(*(p[2] for p in parts))
        if kind in ("opt", "rep", "plus"):
            n, f, l = parts[0]
            if kind != "opt":
                pairs.update((a, b) for a in l for b in f)
            return kind != "plus" or n, f, l
        n, f, l = True, set(), set()
        for pn, pf, pl in parts:
            pairs.update((a, b) for a in l for b in pf)
            f = f | pf if n else f
            l = l | pl if pn else set(pl)
            n = n and pn
        return n, f, l

    while True:
        before = len(pairs), sum(map(len, first.values())), sum(map(len, last.values())), sum(null.values())
        for name, node in rules.items():
            n, f, l = walk(node)
            null[name] = null[name] or n
            first[name] |= f
            last[name] |= l
        if before == (len(pairs), sum(map(len, first.values())), sum(map(len, last.values())), sum(null.values())):
            break
    start = "stmt" if "stmt" in rules else "line"
    ends = last["endings"] if "endings" in rules else last[start]
    return frozenset(pairs), frozenset(first[start]), frozenset(ends)


#: brackets whose groups are reduced, and the symbols that stand for reduced ones
BRACKETS = {"(": ")", "[": "]", "{": "}", "#[": "]", "#![": "]"}
REDUCED = {"(": "()", "[": "[]", "{": "{}", "#[": "#[]", "#![": "#[]"}


def _reduced(rules: dict) -> dict:
    """The rules with every bracketed part of a sequence replaced by one symbol; what stood in brackets becomes a rule of its own."""
    out: dict = {}

    def go(node):
        if isinstance(node, str) or node[0] == "ref":
            return node
        if node[0] != "seq":
            return (node[0], *map(go, node[1:]))
        parts, i = [], 1
        while i < len(node):
            x = node[i]
            j = i + 1
            if isinstance(x, str) and x in BRACKETS:
                depth = 1
                while j < len(node):
                    depth += (node[j] in BRACKETS) - (node[j] == BRACKETS[x]) if isinstance(node[j], str) else 0
                    if depth == 0:
                        break
                    j += 1
                if j < len(node):
                    out[f"group {len(out)}"] = go(("seq", *node[i + 1 : j]))
                    parts.append(REDUCED[x])
                    i = j + 1
                    continue
            parts.append(go(x))
            i += 1
        return ("seq", *parts)

    whole = {name: go(node) for name, node in rules.items()}
    return whole | out


def windows(family: str, names: list[str], reduced: bool) -> np.ndarray:
    """Which three of ``names`` can stand side by side: a cube of booleans.

    ``reduced``: within one level of brackets, where brackets and what they hold are one symbol.  The same fixed point as ``adjacent``, on what a rule can begin and end
    with - a whole sentence of one symbol, or two symbols; each boundary in a rule gives the windows over it.
    """
    rules = _parse(SOURCES[family])
    rules = _reduced(rules) if reduced else rules
    n, at = len(names), {x: i for i, x in enumerate(names)}
    none, pair = np.zeros(n, bool), np.zeros((n, n), bool)
    # by their third and by their first symbol
    ended, begun = np.zeros((n, n, n), bool), np.zeros((n, n, n), bool)
    # (may be empty, sentences of one symbol, first two, last two)
    known = dict.fromkeys(rules, (False, none, pair, pair))
    empty = (True, none, pair, pair)

    def follow(a, b):
        firsts, lasts = b[1] | b[2].any(1), a[1] | a[3].any(0)
        if a[3].any():
            for f in np.flatnonzero(firsts):
                ended[f] |= a[3]
        if b[2].any():
            for x in np.flatnonzero(lasts):
                begun[x] |= b[2]
        one = (a[1] if b[0] else none) | (b[1] if a[0] else none)
        first = a[2] | np.outer(a[1], firsts) | (b[2] if a[0] else pair)
        last = b[3] | np.outer(lasts, b[1]) | (a[3] if b[0] else pair)
        return a[0] and b[0], one, first, last

    def either(parts):
        return any(p[0] for p in parts), *(np.logical_or.reduce([p[k] for p in parts]) for k in (1, 2, 3))

    def walk(node):
        if isinstance(node, str) or node[0] == "ref" and node[1] not in rules:
            one = none.copy()
            one[at[node if isinstance(node, str) else node[1]]] = True
            return False, one, pair, pair
        if node[0] == "ref":
            return known[node[1]]
        if node[0] == "alt":
            return either([walk(x) for x in node[1:]])
        if node[0] == "seq":
            out = empty
            for x in node[1:]:
                out = follow(out, walk(x))
            return out
        x = walk(node[1])
        if node[0] == "opt":
            return either([x, empty])
        out = x
        for _ in range(3):
            out = either([out, follow(out, x)])
        return out if node[0] == "plus" else either([out, empty])

    size = -1
    while True:
        for name, node in rules.items():
            known[name] = either([known[name], walk(node)])
        now = int(ended.sum()) + int(begun.sum()) + sum(int(k[0]) + sum(int(x.sum()) for x in k[1:]) for k in known.values())
        if now == size:
            return ended.transpose(1, 2, 0) | begun
        size = now
