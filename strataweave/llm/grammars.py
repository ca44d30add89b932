"""The bundled grammars: C#, TypeScript, JavaScript, Python, SQL, Rust and JSON.

Written for recognition: where a language leaves a choice to later phases (types, names, precedence), the grammar
accepts both.  Lines of the script grammar that begin with `@ts` hold for TypeScript only; `@` in a rule's name
makes two rules, the second (`s_...`) for expressions that begin a statement, which may not begin with
an object, a function or a class.
"""

from __future__ import annotations

# Reserved words and contextual words of the languages.
JS_RESERVED = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
JS_CONTEXT = "as async await from get let of set static yield".split()
TS_CONTEXT = "abstract any asserts bigint boolean constructor declare implements infer interface is keyof module namespace never number object override private protected public readonly require satisfies string symbol type undefined unique unknown".split()
CS_RESERVED = (
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface "
    "internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint "
    "ulong unchecked unsafe ushort using virtual void volatile while"
).split()
CS_CONTEXT = "add and async await by file from get global group init into join let nameof not on or orderby partial record remove required select set value when where with yield".split()
RUST_RESERVED = "as break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await".split()
RUST_CONTEXT = "macro_rules union".split()
PY_RESERVED = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
PY_CONTEXT = "match case type _".split()
SQL_WORDS = (
    "ADD ALL ALTER AND AS ASC BEGIN BETWEEN BY CASCADE CALL CASE CHECK COLLATE COLUMN COMMIT CONSTRAINT CREATE CROSS DATABASE DECLARE DEFAULT DELETE DESC DISTINCT DROP ELSE END EXCEPT EXEC EXISTS EXPLAIN FILTER FOR FOREIGN FROM FULL FUNCTION GO GRANT "
    "GROUP GROUPING HAVING IF IN INDEX INNER INSERT INTERSECT INTO IS JOIN KEY LEFT LIKE LIMIT MERGE NOT NULL OFFSET ON OR ORDER OUTER OVER PARTITION PRIMARY PRINT PROCEDURE REFERENCES RENAME REPLACE RETURN RETURNING REVOKE RIGHT ROLLBACK SCHEMA SELECT SET SETS "
    "TABLE TEMPORARY THEN TO TRANSACTION TRIGGER TRUNCATE UNION UNIQUE UPDATE USE USING VALUES VIEW WHEN WHERE WHILE WITH"
).split()
SQL_CONTEXT = "CALL EXEC EXPLAIN FILTER GROUPING MERGE PRINT RETURN SETS WHILE CASCADE COLUMN COMMIT DATABASE FUNCTION GO IF INDEX KEY OFFSET OVER PARTITION PROCEDURE RENAME REPLACE RETURNING SCHEMA TEMPORARY TRANSACTION TRIGGER TRUNCATE VIEW BEGIN END".split()


def words(names: list[str]) -> str:
    return " | ".join(names)


_SCRIPT = """
program: item*
item: stmt | import_d | export_d
item: decor+ export default? klass
@ts item: decor+ export default? abstract klass
semi: ';' | VSEMI
import_d: import STR with_a? semi | import import_c from STR with_a? semi
@ts import_d: import type import_c from STR semi | import ident '=' require '(' STR ')' semi | import ident '=' tname semi
with_a: with objlit
import_c: ident | ident ',' import_n | import_n
import_n: '*' as ident | '{' '}' | '{' import_s (',' import_s)* ','? '}'
import_s: name | name as ident | STR as ident
@ts import_s: type name | type name as ident
export_d: export '*' from STR semi | export '*' as name from STR semi | export '{' '}' semi | export export_n semi | export export_n from STR semi | export decl | export var_d semi | export default aexpr semi | export default func | export default klass
@ts export_d: export type export_n semi | export type export_n from STR semi | export '=' expr semi | export default abstract klass | export default interface_d | export as namespace ident semi
export_n: '{' export_s (',' export_s)* ','? '}'
export_s: name | name as name
stmt: block | ';' | var_d semi | decl | s_expr semi | if_s | for_s | while '(' expr ')' stmt | do stmt while '(' expr ')' semi? | return expr? semi | break ident? semi | continue ident? semi | throw expr semi | try_s | switch_s | ident ':' stmt | debugger semi | with '(' expr ')' stmt
block: '{' stmt* '}'
if_s: if '(' expr ')' stmt | if '(' expr ')' stmt else stmt
for_s: for '(' (for_i | expr)? ';' expr? ';' expr? ')' stmt | for await? '(' (for_v | postfix) (in | of) expr ')' stmt
for_i: (var | let | const) binding (',' binding)*
for_v: (var | let | const) pattern
try_s: try block catch_c | try block finally block | try block catch_c finally block
catch_c: catch block | catch '(' pattern ann? ')' block
switch_s: switch '(' expr ')' '{' (case_c stmt*)* '}'
case_c: case expr ':' | default ':'
var_d: (var | let | const) binding (',' binding)*
binding: pattern ann? | pattern ann? '=' aexpr
@ts binding: ident '!' ann
pattern: ident | '[' (pat_e? ',')* pat_e? ']' | '{' '}' | '{' pat_p (',' pat_p)* ','? '}'
pat_e: pattern | pattern '=' aexpr | '...' pattern
pat_p: ident | ident '=' aexpr | key ':' pat_e | '...' ident
decl: func | klass
@ts decl: abstract klass | interface_d | type ident tparams? '=' tp semi | const? enum ident '{' (enum_m (',' enum_m)* ','?)? '}' | (namespace | module) (tname | STR) '{' item* '}' | declare decl | declare var_d semi | declare global block_d | function ident sig semi | async function ident sig semi
@ts block_d: '{' item* '}'
@ts enum_m: key | key '=' aexpr
@ts interface_d: interface ident tparams? (extends tname_g (',' tname_g)*)? tobject
func: async? function '*'? ident? tparams? sig block
sig: '(' params? ')' ret?
params: param (',' param)* ','?
param: pattern opt? ann? | pattern opt? ann? '=' aexpr | '...' pattern ann?
@ts param: pmod+ pattern opt? ann? | pmod+ pattern opt? ann? '=' aexpr | decor+ pmod* pattern opt? ann? | decor+ pmod* pattern ann? '=' aexpr | this ann
@ts pmod: public | private | protected | readonly | override
klass: decor* class ident? tparams? heritage? '{' member* '}'
heritage: extends postfix
@ts heritage: extends tname_g | extends tname_g implements tname_g (',' tname_g)* | implements tname_g (',' tname_g)*
member: ';' | decor* mod* key tparams? sig block | decor* mod* (get | set) key sig block | decor* mod* async? '*'? key sig block | decor* mod* key opt? ann? semi | decor* mod* key opt? ann? '=' aexpr semi | static block
@ts member: decor* mod* key opt? tparams? sig semi | decor* mod* (get | set) key sig semi | decor* mod* key '!' ann semi | mod* '[' ident ':' tp ']' ann semi
decor: '@' postfix
mod: static | async
@ts mod: public | private | protected | readonly | abstract | override | declare
key: name | STR | NUM | '[' aexpr ']' | PRIV
opt: VOID_OPT
@ts opt: '?'
ann: VOID_ANN
@ts ann: ':' tp
ret: VOID_ANN
@ts ret: ':' tp | ':' ident is tp | ':' asserts ident (is tp)? | ':' this is tp
tparams: VOID_ANN
@ts tparams: '<' tparam (',' tparam)* ','? '>'
@ts tparam: const? ident (extends tp)? ('=' tp)?
@expr: @aexpr | @expr ',' aexpr
@aexpr: @bin | @bin '?' aexpr ':' aexpr | @postfix ASSIGN aexpr | @postfix '=' aexpr | @arrow | yield | yield '*'? aexpr
@arrow: async? ident '=>' arrow_b | async? tparams? '(' params? ')' ret? '=>' arrow_b
arrow_b: aexpr_b | block
aexpr_b: s_aexpr | func | klass
@bin: @unary | @bin BIN unary | @bin '*' unary | @bin '<' unary | @bin '>' unary | @bin '>' '>' unary | @bin '>' '>' '>' unary | @bin '|' unary | @bin '&' unary | @bin '+' unary | @bin '-' unary | @bin in unary | @bin instanceof unary
@ts @bin: @bin as tp | @bin as const | @bin satisfies tp
@unary: @postfix | ('!' | '~' | '+' | '-' | INC | typeof | void | delete | await) unary
@ts @unary: '<' tp '>' unary
@postfix: @prim | @postfix '.' name | @postfix '.' PRIV | @postfix '?.' name | @postfix '?.' '[' expr ']' | @postfix '?.' args | @postfix '[' expr ']' | @postfix args | @postfix TPL | @postfix INC
@ts @postfix: @postfix '!' | @postfix targs args
args: '(' ')' | '(' arg (',' arg)* ','? ')'
arg: aexpr | '...' aexpr
prim: s_prim | objlit | func | klass
s_prim: ident | NUM | STR | TPL | REGEX | this | super | null | true | false | '(' expr ')' | array | new_e | import args | import '.' name
new_e: new new_t args? | new '.' name
@ts new_e: new new_t targs args
new_t: ident | this | '(' expr ')' | new_t '.' name | new_t '[' expr ']' | func | klass | new_e
array: '[' (elem? ',')* elem? ']'
elem: aexpr | '...' aexpr
objlit: '{' '}' | '{' prop (',' prop)* ','? '}'
prop: ident | ident '=' aexpr | key ':' aexpr | '...' aexpr | async? '*'? key tparams? sig block | (get | set) key sig block
@ts targs: '<' tp (',' tp)* '>'
@ts tp: tu | tfunc | tu extends tu '?' tp ':' tp
@ts tfunc: abstract? new? tparams? '(' params? ')' '=>' (tp | ident is tp | asserts ident is tp)
@ts tu: '|'? tpost | tu '|' tpost | tu '&' tpost | '&' tpost
@ts tpost: tprim | tpost '[' ']' | tpost '[' tp ']' | keyof tpost | readonly tpost | unique tpost | infer ident | typeof tname_g
@ts tprim: tname_g | STR | NUM | '-' NUM | TPL | true | false | null | void | this | tobject | '(' tp ')' | '[' ']' | '[' tel (',' tel)* ','? ']' | import '(' STR ')' ('.' name)*
@ts tel: tp | '...' tp | ident ':' tp | ident '?' ':' tp | '...' ident ':' tp | tp '?'
@ts tobject: '{' '}' | '{' tmem (tsep tmem)* tsep? '}'
@ts tsep: ';' | ',' | VSEMI
@ts tmem: readonly? key '?'? ann? | key '?'? tparams? sig | tparams? sig | new tparams? sig | (get | set) key sig | ('+' | '-')? readonly? '[' ident (':' | in) tp ']' ('-' | '+')? '?'? ann? | ('+' | '-')? readonly? '[' ident in tp as tp ']' ('-' | '+')? '?'? ann?
@ts tname: ident | tname '.' name
@ts tname_g: tname | tname targs
ident: ID
name: ident
"""


def script(typescript: bool) -> str:
    out = []
    for line in _SCRIPT.splitlines():
        if line.startswith("@ts "):
            if not typescript:
                continue
            line = line[4:]
        out += [line.replace("@", ""), line.replace("@", "s_")] if line.startswith("@") and ":" in line and not line.startswith("@ts") else [line]
    if typescript:
        out = [x for x in out if x not in ("opt: VOID_OPT", "ann: VOID_ANN", "ret: VOID_ANN", "tparams: VOID_ANN")]
    out.append(f"ident: {words(JS_CONTEXT + (TS_CONTEXT if typescript else []))}")
    out.append(f"name: {words(JS_RESERVED)}")
    return "\n".join(out)


CSHARP = f"""
unit: top*
top: using static? qname ';' | using ident '=' tp ';' | global using static? qname ';' | extern ident ident ';' | gattr | ns | tdecl | stmt
gattr: '[' ident ':' attr (',' attr)* ','? ']'
ns: namespace qname ';' | namespace qname '{{' top* '}}' ';'?
attrs: ('[' (ident ':' | return ':' | event ':')? attr (',' attr)* ','? ']')*
attr: qname args?
mod: public | private | protected | internal | static | sealed | abstract | virtual | override | readonly | const | extern | unsafe | volatile | new | async | partial | required | file | ref | event | fixed
tdecl: attrs mod* (class | struct | interface | record | record class | record struct) ident tparams? ('(' plist ')')? bases? where_c* (tbody ';'? | ';') | attrs mod* enum ident (':' tp)? '{{' (enum_m (',' enum_m)* ','?)? '}}' ';'? | attrs mod* delegate tp ident tparams? '(' plist ')' where_c* ';'
enum_m: attrs ident ('=' expr)?
bases: ':' base_t (',' base_t)*
base_t: tp | tp args
where_c: where ident ':' con (',' con)*
con: tp | class '?'? | struct | new '(' ')' | default
tbody: '{{' member* '}}'
tparams: '<' tparam (',' tparam)* '>'
tparam: attrs (in | out)? ident
member: tdecl | attrs mod* tp var (',' var)* ';' | attrs mod* tp qname tparams? '(' plist ')' where_c* body | attrs mod* ident '(' plist ')' (':' (base | this) args)? body | attrs '~' ident '(' ')' body
    | attrs mod* tp qname '{{' accessor+ '}}' ('=' expr ';')? | attrs mod* tp qname '=>' expr ';' | attrs mod* tp (qname '.')? this '[' plist ']' ('{{' accessor+ '}}' | '=>' expr ';') | attrs mod* tp operator oper '(' plist ')' body | attrs mod* (implicit | explicit) operator tp '(' plist ')' body
oper: BIN | '+' | '-' | '*' | '!' | '~' | INC | '<' | '>' | '&' | '|' | '^' | true | false
body: block | '=>' expr ';' | ';'
accessor: attrs mod* (get | set | init | add | remove) body
plist: (param (',' param)*)?
param: attrs pmod* tp ident ('=' expr)? | attrs pmod* tp ident '[' ']'
pmod: ref | out | in | this | params | readonly
var: ident ('=' vinit)?
vinit: expr | '{{' (vinit (',' vinit)* ','?)? '}}' | ref expr
qname: ident gargs? | qname '.' ident gargs? | qname '::' ident gargs?
gargs: '<' tp (',' tp)* '>' | '<' ','* '>'
tp: qname | ptype | void | '(' tuple_e (',' tuple_e)+ ')' | tp '[' ','* ']' | tp '?' | tp '*'
tuple_e: tp ident?
ptype: bool | byte | char | decimal | double | float | int | long | object | sbyte | short | string | uint | ulong | ushort
block: '{{' stmt* '}}'
stmt: block | ';' | local ';' | sexpr ';' | if '(' expr ')' stmt | if '(' expr ')' stmt else stmt | while '(' expr ')' stmt | do stmt while '(' expr ')' ';' | for '(' (local | sexpr (',' sexpr)*)? ';' expr? ';' (sexpr (',' sexpr)*)? ')' stmt
    | await? foreach '(' (ref | readonly)* (tp ident | ident '(' dname (',' dname)* ')' | '(' tp ident (',' tp ident)+ ')') in expr ')' stmt | return (ref? expr)? ';' | break ';' | continue ';' | throw expr? ';' | goto (ident | case expr | default) ';' | ident ':' stmt
    | try block (catch_c+ | catch_c* finally block) | switch '(' expr (',' expr)* ')' '{{' (case_c+ stmt+)* '}}' | lock '(' expr ')' stmt | await? using '(' (local | expr) ')' stmt | await? using local ';' | yield return expr ';' | yield break ';' | (checked | unchecked | unsafe) block | fixed '(' local ')' stmt
    | attrs lmod* tp ident tparams? '(' plist ')' where_c* body
lmod: static | async | unsafe | extern
dname: ident
local: (const | ref | scoped_)* tp var (',' var)*
scoped_: readonly
catch_c: catch ('(' tp ident? ')')? (when '(' expr ')')? block
case_c: case pattern (when expr)? ':' | default ':'
sexpr: unary (ASSIGN | '=') (expr | ref expr) | '>' | postfix args | postfix INC | INC unary | await unary | new_e | dtuple '=' expr
dtuple: (ident)? '(' (tp? ident) (',' tp? ident)+ ')'
expr: bin | bin '?' expr ':' expr | unary (ASSIGN | '=') expr | lambda | throw expr | query | ref unary
lambda: attrs (static | async)* (tp? '(' lparams ')' | ident) '=>' (expr | block) | (static | async)* delegate ('(' plist ')')? block
lparams: (lparam (',' lparam)*)?
lparam: ident | param
query: from tp? ident in expr qbody
qbody: (from tp? ident in expr | let ident '=' expr | where expr | join tp? ident in expr on expr EQUALS_ expr (into ident)? | orderby expr ID? (',' expr ID?)*)* (select expr | group expr by expr) (into ident qbody)?
bin: unary | bin (BIN | '+' | '-' | '*' | '<' | '>' | '&' | '|' | '^') unary | bin '>' '>' unary | bin is pattern | bin as tp | bin switch '{{' (arm (',' arm)* ','?)? '}}' | bin with '{{' (minit (',' minit)* ','?)? '}}' | bin '..' unary | bin '..'
arm: pattern (when expr)? '=>' expr
pattern: pat2 | pattern or pat2 | pattern and pat2
pat2: unary | tp ident? | not pat2 | ('<' | '>' | BIN) unary | tp? '{{' (subpat (',' subpat)* ','?)? '}}' ident? | tp? '(' (pattern | ident ':' pattern) (',' (pattern | ident ':' pattern))* ')' ident? | '[' (pattern (',' pattern)* ','?)? ']' | '..' 
subpat: (ident | ident '.' ident) ':' pattern
unary: postfix | ('+' | '-' | '!' | '~' | INC | '&' | '*' | '^' | '..') unary | '(' tp ')' unary | await unary
postfix: prim | postfix '.' ident gargs? | postfix '?.' ident gargs? | postfix '?' '[' alist ']' | postfix '->' ident | postfix '[' alist ']' | postfix args | postfix INC | postfix '!' | ptype '.' ident gargs? | qname '::' ident
args: '(' ')' | '(' alist ')'
alist: arg (',' arg)*
arg: (ident ':')? ((ref | out | in)? expr | out tp ident)
prim: ident gargs? | NUM | STR | CHAR | null | true | false | this | base | '(' expr ')' | '(' arg (',' arg)+ ')' | new_e | typeof '(' tp ')' | sizeof '(' tp ')' | default | default '(' tp ')' | (checked | unchecked) '(' expr ')' | stackalloc tp '[' expr ']' | '[' (celem (',' celem)* ','?)? ']'
celem: expr | '..' expr
new_e: new ntp args oinit? | new ntp oinit | new ntp '[' expr (',' expr)* ']' ('[' ','* ']')* oinit? | new ('[' ','* ']')+ oinit | new oinit | new args oinit?
ntp: qname | ptype | ntp '[' ','* ']' | ntp '?' | '(' tuple_e (',' tuple_e)+ ')'
oinit: '{{' '}}' | '{{' minit (',' minit)* ','? '}}'
minit: expr | ident '=' '{{' (minit (',' minit)* ','?)? '}}' | '[' alist ']' '=' vinit | '{{' expr (',' expr)* ','? '}}'
ident: ID | {words(CS_CONTEXT)}
""".replace(" | '>' | postfix args", " | postfix args").replace("'{{'", "'{'").replace("'}}'", "'}'")

RUST = f"""
file: item*
item: attr* vis? idecl | attr* mac_i | IATTR
attr: ATTR | IATTR
vis: pub | pub '(' (crate | self | super | in path) ')'
idecl: fnq* fn ident gen? '(' (fparam (',' fparam)* ','?)? ')' ('->' tp)? whr? (block | ';') | struct ident gen? whr? '{{' (field (',' field)* ','?)? '}}' | struct ident gen? ('(' (attr* vis? tp (',' attr* vis? tp)* ','?)? ')')? whr? ';' | union ident gen? '{{' field (',' field)* ','? '}}'
    | enum ident gen? whr? '{{' (variant (',' variant)* ','?)? '}}' | unsafe? impl gen? '!'? tp (for tp)? whr? '{{' assoc* '}}' | unsafe? trait ident gen? (':' bounds?)? whr? '{{' assoc* '}}' | use use_t ';' | unsafe? mod ident (';' | '{{' item* '}}') | const ident ':' tp '=' expr ';'
    | static mut? ident ':' tp '=' expr ';' | type ident gen? (':' bounds)? whr? ('=' tp)? ';' | extern crate ident (as ident)? ';' | unsafe? extern STR? '{{' item* '}}'
fnq: const | async | unsafe | extern STR?
assoc: item | attr* vis? const ident ':' tp ';'
mac_i: macro_rules '!' ident tree ';'? | path '!' tree ';'?
tree: '(' tt* ')' | '[' tt* ']' | '{{' tt* '}}'
tt: ANYTOKEN | tree | '$'
gen: '<' (gparam (',' gparam)* ','?)? '>'
gparam: LIFE (':' LIFE ('+' LIFE)*)? | ident (':' bounds?)? ('=' tp)? | const ident ':' tp ('=' lit)?
bounds: bound ('+' bound)*
bound: LIFE | '?'? hrtb? tpath | '(' '?'? hrtb? tpath ')'
hrtb: for '<' LIFE (',' LIFE)* '>'
whr: where (wpred (',' wpred)* ','?)?
wpred: hrtb? tp ':' bounds? | LIFE ':' bounds
fparam: attr* pat ':' tp | attr* ('&' LIFE?)? mut? self | attr* mut? self ':' tp | '...'
field: attr* vis? ident ':' tp
variant: attr* ident ('(' (attr* vis? tp (',' attr* vis? tp)* ','?)? ')' | '{{' (field (',' field)* ','?)? '}}')? ('=' expr)?
use_t: upath | upath as (ident) | upath '::' '*' | '*' | (upath '::')? '{{' (use_t (',' use_t)* ','?)? '}}' | '::' use_t
upath: useg | upath '::' useg
useg: ident | self | super | crate | Self
path: '::'? useg | path '::' useg
tp: tnb | impl bounds | dyn bounds
tnb: tpath | '&' LIFE? mut? tp | '&&' LIFE? mut? tp | '*' (const | mut) tp | '(' ')' | '(' tp (',' tp)* ','? ')' | '[' tp ']' | '[' tp ';' expr ']' | '!' | hrtb? fnq* fn '(' (fnp (',' fnp)* ','?)? ')' ('->' tp)? | '<' tp (as tpath)? '>' ('::' tseg)+ | path '!' tree
fnp: tp | ident ':' tp
tpath: '::'? tseg | tpath '::' tseg
tseg: useg | useg targs | useg '::' targs | useg '(' (tp (',' tp)* ','?)? ')' ('->' tnb)?
targs: '<' (targ (',' targ)* ','?)? '>'
targ: tp | LIFE | lit | block | ident '=' tp | ident ':' bounds
block: '{{' IATTR* stmt* lexpr? '}}'
stmt: ';' | item | let_s | lexpr ';' | attr* bexpr
let_s: attr* let pat (':' tp)? ('=' expr (else block)?)? ';'
lexpr: attr* expr
expr: range | epost ASSIGN expr | epost '=' expr | '*' unary (ASSIGN | '=') expr | ret
ret: return expr? | break LIFE? expr? | continue LIFE? | async? move? ('|' (cparam (',' cparam)* ','?)? '|' | '||') ('->' tp block | expr) | let pat '=' bin
cparam: pat (':' tp)?
range: bin | bin ('..' | '..=') bin | bin '..' | ('..' | '..=') bin | '..'
bin: unary | bin (BIN | '+' | '-' | '*' | '<' | '>' | '&' | '|' | '&&' | '||') (unary | ret) | bin '>' '>' unary | bin as tnb
unary: epost | ('-' | '!' | '*' | '&' | '&&') unary | ('&' | '&&') mut unary
epost: prim | epost '.' (useg | await) | epost '.' ident '::' targs args | epost '.' NUM | epost args | epost '[' expr ']' | epost '?'
args: '(' (expr (',' expr)* ','?)? ')'
prim: lit | epath | epath '{{' (sfield (',' sfield)*)? ','? ('..' expr)? '}}' | '(' ')' | '(' expr (',' expr)* ','? ')' | '[' (expr (',' expr)* ','?)? ']' | '[' expr ';' expr ']' | bexpr | path '!' tree
epath: '::'? eseg | epath '::' eseg | '<' tp (as tpath)? '>' ('::' eseg)+
eseg: useg | useg '::' targs
sfield: attr* (ident | ident ':' expr | NUM ':' expr)
bexpr: block | (unsafe | const | async move?) block | (LIFE ':')? loop block | (LIFE ':')? while expr block | (LIFE ':')? for pat in expr block | LIFE ':' block | if_e | match expr '{{' IATTR* arm* '}}'
if_e: if expr block | if expr block else block | if expr block else if_e
arm: attr* pat (if expr)? '=>' (expr ',' | bexpr ','? | expr)
pat: '|'? pat1 | pat '|' pat1
pat1: lit | '-' NUM | plit ('..' | '..=') plit? | ('..=') plit | '..' | ref? mut? ident ('@' pat1)? | '&' mut? pat1 | '&&' mut? pat1 | epath | epath '(' (pat (',' pat)* ','?)? ')' | epath '{{' (pfield (',' pfield)* ','?)? '}}' | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']' | path '!' tree
plit: lit | '-' NUM | epath
pfield: attr* (ident ':' pat | ref? mut? ident | '..' | NUM ':' pat)
lit: NUM | STR | CHAR | true | false
ident: ID | {words(RUST_CONTEXT)}
""".replace("'{{'", "'{'").replace("'}}'", "'}'")

PYTHON = f"""
file: (NEWLINE | stmt)*
stmt: simple NEWLINE | compound
simple: small (';' small)* ';'?
small: plain | (targets '=')+ rhs | one_t ASSIGN rhs | one_t ':' test ('=' rhs)? | yield_e | pass | break | continue | return plain? | raise (test (from test)?)? | global ident (',' ident)* | nonlocal ident (',' ident)* | del del_ts | assert test (',' test)? | import_s | type ident tparams? '=' test
plain: star_x (',' star_x)* ','?
star_x: test | '*' bor
rhs: plain | yield_e
targets: target (',' target)* ','?
target: atom_t | '*' atom_t
atom_t: one_t | '(' targets ')' | '(' ')' | '[' targets ']' | '[' ']'
one_t: ident | post '.' ident | post '[' subs ']' | '(' one_t ')'
del_ts: del_t (',' del_t)* ','?
del_t: one_t | '(' del_ts ')' | '[' del_ts ']' | '(' ')' | '[' ']'
import_s: import dotted_as (',' dotted_as)* | from ('.' | '...')* dotted import imports | from ('.' | '...')+ import imports
imports: '*' | '(' import_as (',' import_as)* ','? ')' | import_as (',' import_as)*
import_as: ident (as ident)?
dotted_as: dotted (as ident)?
dotted: ident ('.' ident)*
compound: decos? (def_s | class_s) | if_s | while named ':' suite else_s? | async? for targets in plain ':' suite else_s? | try_s | async? with withs ':' suite | match exprs ':' NEWLINE INDENT case_b+ DEDENT
decos: ('@' named NEWLINE)+
def_s: async? def ident tparams? '(' params? ')' ('->' test)? ':' suite
class_s: class ident tparams? ('(' args? ')')? ':' suite
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: ident (':' test)? ('=' test)? | ('*' | '**') ident ('=' star_x)?
params: pos_p (',' rest_p)? ','? | rest_p ','?
pos_p: bare_p (',' full_p)? | full_p
bare_p: name_p (',' name_p)* | name_p (',' name_p)* ',' '/' (',' name_p)*
full_p: dflt_p (',' dflt_p)* | dflt_p (',' dflt_p)* ',' '/' (',' dflt_p)* | '/' (',' dflt_p)+
name_p: ident (':' test)?
dflt_p: ident (':' test)? '=' test
rest_p: '*' ident (':' star_x)? (',' kw_p)* (',' '**' name_p)? | '*' (',' kw_p)+ (',' '**' name_p)? | '**' name_p
kw_p: name_p | dflt_p
if_s: if named ':' suite (elif named ':' suite)* else_s?
else_s: else ':' suite
try_s: try ':' suite (except_c+ else_s? (finally ':' suite)? | finally ':' suite)
except_c: except (test (as ident)?)? ':' suite | except '*' test (as ident)? ':' suite
withs: with_i (',' with_i)* | '(' with_i (',' with_i)* ','? ')'
with_i: test (as atom_t)?
case_b: case pats (if named)? ':' suite
pats: pat (',' pat)* ','?
pat: pat_o | pat_o as ident | '*' ident
pat_o: pat_a ('|' pat_a)*
pat_a: '-'? NUM (('+' | '-') NUM)? | STR+ | None | True | False | dotted | dotted '(' (pat_k (',' pat_k)* ','?)? ')' | '[' pats? ']' | '(' pats? ')' | '{{' (pat_m (',' pat_m)* ','?)? '}}'
pat_k: pat | ident '=' pat
pat_m: pat_a ':' pat | '**' ident
suite: simple NEWLINE | NEWLINE INDENT stmt+ DEDENT
exprs: star_e (',' star_e)* ','?
star_e: named | '*' bor
named: test | ident ':=' test
test: orx | orx if orx else test | lambda lparams? ':' test
lparams: lpos (',' lrest)? ','? | lrest ','?
lpos: lbare (',' lfull)? | lfull
lbare: ident (',' ident)* | ident (',' ident)* ',' '/' (',' ident)*
lfull: ldflt (',' ldflt)* | ldflt (',' ldflt)* ',' '/' (',' ldflt)* | '/' (',' ldflt)+
ldflt: ident '=' test
lrest: '*' ident (',' lkw)* (',' '**' ident)? | '*' (',' lkw)+ (',' '**' ident)? | '**' ident
lkw: ident | ldflt
yield_e: yield | yield plain | yield from test
orx: andx | orx or andx
andx: notx | andx and notx
notx: cmp | not notx
cmp: bor | cmp (CMP | '<' | '>' | in | not in | is | is not) bor
bor: una | bor (BIN | '+' | '-' | '*' | '/' | '|' | '@') una
una: pow | ('+' | '-' | '~') una
pow: aw | aw '**' una
aw: post | await post
post: atom | post '.' ident | post '(' args? ')' | post '[' subs ']'
args: pargs ','? | pargs ',' kargs ','? | kargs ','? | named comp
pargs: parg (',' parg)*
parg: named | '*' test
kargs: karg (',' karg)* (',' dargs)? | dargs
karg: ident '=' test | '*' test
dargs: '**' test (',' darg)*
darg: '**' test | ident '=' test
subs: sub (',' sub)* ','?
sub: named | '*' bor | test? ':' test? (':' test?)?
atom: ident | NUM | STR+ | None | True | False | '...' | '(' ')' | '(' exprs ')' | '(' yield_e ')' | '(' named comp ')' | '[' ']' | '[' exprs ']' | '[' named comp ']' | '{{' '}}' | '{{' dict_i (',' dict_i)* ','? '}}' | '{{' exprs '}}' | '{{' named comp '}}' | '{{' test ':' test comp '}}'
dict_i: test ':' test | '**' bor
comp: comp_f (comp_f | if comp_c)*
comp_f: async? for targets in orx
comp_c: orx | ident ':=' orx | lambda lparams? ':' test
ident: ID | {words(PY_CONTEXT)}
""".replace("'{{'", "'{'").replace("'}}'", "'}'")

SQL = f"""
file: ';'* (batch)*
batch: stmt end | stmt GO | GO
end: ';'+
last: stmt
stmt: select | merge | explain | insert | update | delete_s | create | alter | drop | truncate | txn | grant | SET set_x | USE name | DECLARE declv (',' declv)* | IF expr stmt | IF expr stmt end? ELSE stmt | IF expr THEN (stmt end)+ (ELSE (stmt end)+)? END IF | WHILE expr stmt | block | RETURN expr? | PRINT expr | EXEC name (earg (',' earg)*)? | CALL name ('(' exprs? ')')?
block: BEGIN (stmt end?)+ END
earg: (VARN '=')? (expr | DEFAULT) ID?
explain: EXPLAIN (ID | '(' xopt (',' xopt)* ')')* (select | insert | update | delete_s | merge)
xopt: ID (ID | ON | NUM)?
merge: with_c? MERGE INTO? name (AS? name)? USING (name | '(' select ')') (AS? name ('(' names ')')?)? ON expr mwhen+ ret?
mwhen: WHEN NOT? ID (BY ID)? (AND expr)? THEN (UPDATE SET asg (',' asg)* | DELETE | INSERT ('(' names ')')? (VALUES row | DEFAULT VALUES) | ID ID)
declv: VARN AS? tp ('=' expr)? | VARN AS? TABLE '(' tdef (',' tdef)* ')' | name tp (DEFAULT expr | '=' expr)?
set_x: name ('=' | TO)? (expr | ON | ID) | VARN '=' expr | TRANSACTION ID+ | name name? ON
select: with_c? query order_c? limit_c? (FOR (UPDATE | ID) (ID ID?)?)?
with_c: WITH ID? cte (',' cte)*
cte: name ('(' names ')')? AS '(' (select | insert | update | delete_s) ')'
query: qterm | query (UNION | EXCEPT | INTERSECT) (ALL | DISTINCT)? qterm
qterm: SELECT (ALL | DISTINCT)? top? sitem (',' sitem)* (INTO name)? (FROM tref (',' tref)*)? (WHERE expr)? (GROUP BY gitem (',' gitem)*)? (HAVING expr)? | '(' select ')' | VALUES row (',' row)*
gitem: expr | GROUPING SETS '(' gset (',' gset)* ')'
gset: expr | '(' ')'
top: ID_TOP (NUM | '(' expr ')')
sitem: '*' | expr (AS? alias)? | name '.' '*'
alias: name | STR
tref: tprim | tref join_k? JOIN tprim (ON expr | USING '(' names ')')? | tref CROSS JOIN tprim
join_k: INNER | (LEFT | RIGHT | FULL) OUTER?
tprim: name (AS? name)? ('(' names ')')? | name '(' exprs? ')' (AS? name)? | '(' select ')' AS? name ('(' names ')')? | '(' tref ')'
order_c: ORDER BY oitem (',' oitem)*
oitem: expr (ASC | DESC)? (ID ID)?
limit_c: LIMIT expr (OFFSET expr | ',' expr)? | OFFSET expr ID?
names: name (',' name)*
row: '(' rexprs ')'
rexprs: (expr | DEFAULT) (',' (expr | DEFAULT))*
insert: with_c? INSERT ID? INTO? name ('(' names ')')? (VALUES row (',' row)* | select | DEFAULT VALUES) (ON ID (KEY UPDATE asg (',' asg)* | ('(' names ')')? ID (ID | UPDATE SET asg (',' asg)* (WHERE expr)?)))? ret?
ret: RETURNING sitem (',' sitem)*
update: with_c? UPDATE name (AS? name)? SET asg (',' asg)* (FROM tref (',' tref)*)? (WHERE expr)? ret?
asg: name '=' (expr | DEFAULT) | '(' names ')' '=' row
delete_s: with_c? DELETE FROM name (AS? name)? (USING tref (',' tref)*)? (WHERE expr)? ret?
create: CREATE (OR REPLACE)? TEMPORARY? TABLE ifn? name '(' tdef (',' tdef)* ')' topt* part? | CREATE TABLE ifn? name PARTITION ID name (FOR VALUES bound | DEFAULT) | CREATE TEMPORARY? TABLE ifn? name AS select | CREATE (OR REPLACE)? TEMPORARY? VIEW ifn? name ('(' names ')')? AS select | CREATE UNIQUE? ID? INDEX ID? ifn? name? ON name (USING name)? '(' oitem (',' oitem)* ')' (ID '(' names ')')? (WHERE expr)?
    | CREATE (SCHEMA | DATABASE) ifn? name topt* | trigger | CREATE (OR (REPLACE | ALTER))? (PROCEDURE | FUNCTION) name ('(' (fparam (',' fparam)*)? ')' | fparam (',' fparam)*)? (ID tp | ID TABLE ('(' tdef (',' tdef)* ')')? | ID)* AS? (block | STR | RETURN expr | select) (ID ID)* | CREATE (OR ALTER)? PROCEDURE name ('(' (fparam (',' fparam)*)? ')' | fparam (',' fparam)*)? AS (stmt end?)+ | CREATE ID name (ID (expr | BY expr)?)*
fparam: ID? name tp ('=' expr)? | VARN tp ('=' expr)?
part: PARTITION BY ID ID? '(' exprs ')' (ID NUM | '(' pdef (',' pdef)* ')')?
pdef: PARTITION name (VALUES (ID ID)? (IN '(' exprs ')' | '(' exprs ')' | ID))?
bound: FROM '(' exprs ')' TO '(' exprs ')' | IN '(' exprs ')' | WITH '(' ID NUM ',' ID NUM ')'
trigger: CREATE (OR REPLACE)? TRIGGER name (ID ID? | ID) tevent (OR tevent)* ON name (FROM name | ID)* (FOR ID? ID)? (WHEN '(' expr ')')? (EXEC (FUNCTION | PROCEDURE) name '(' exprs? ')' | block | stmt) | CREATE (OR ALTER)? TRIGGER name ON name (ID ID | FOR | ID) tevent (',' tevent)* AS (stmt end?)+
tevent: INSERT | DELETE | TRUNCATE | UPDATE (ID names)?
ifn: IF NOT EXISTS
ife: IF EXISTS
topt: ID '='? (expr) | DEFAULT ID '='? ID | ID
tdef: name tp ccon* | tcon
tp: TRIGGER | ID ('(' targ (',' targ)* ')')? ID* ('[' ']')* | SET '(' targ (',' targ)* ')'
targ: NUM | STR | ID
ccon: NOT NULL | NULL | PRIMARY KEY ID? | UNIQUE KEY? | DEFAULT (una | '(' expr ')') | CHECK '(' expr ')' | refs | CONSTRAINT name | COLLATE name | ID | ON UPDATE una | ID STR | ID '(' NUM ',' NUM ')' | ID ID AS '(' expr ')' ID? | AS '(' expr ')' ID?
refs: REFERENCES name ('(' names ')')? (ON (DELETE | UPDATE) (CASCADE | SET NULL | SET DEFAULT | ID ID?))*
tcon: (CONSTRAINT name)? (PRIMARY KEY ID? '(' oitem (',' oitem)* ')' | UNIQUE (KEY | INDEX)? name? '(' oitem (',' oitem)* ')' | FOREIGN KEY name? '(' names ')' refs | CHECK '(' expr ')') | (KEY | INDEX) name? '(' oitem (',' oitem)* ')'
alter: ALTER TABLE ife? name act (',' act)*
act: ADD COLUMN? ifn? name tp ccon* | ADD tcon | DROP COLUMN? ife? name CASCADE? | DROP CONSTRAINT ife? name | DROP PRIMARY KEY | DROP FOREIGN KEY name | DROP INDEX name | ALTER COLUMN? name (ID? tp ccon* | SET DEFAULT expr | DROP DEFAULT | SET NOT NULL | DROP NOT NULL) | RENAME TO name | RENAME COLUMN? name TO name | ID COLUMN? name tp ccon* | ID TO name
drop: DROP (TABLE | VIEW | INDEX | SCHEMA | DATABASE | PROCEDURE | FUNCTION | TRIGGER | ID) ife? name (',' name)* (ON name)? (CASCADE | ID)?
truncate: TRUNCATE TABLE? name
txn: BEGIN TRANSACTION? | BEGIN ID | COMMIT (TRANSACTION | ID)? | ROLLBACK (TRANSACTION | ID)? | ID TRANSACTION
grant: (GRANT | REVOKE) (priv (',' priv)*) ON TABLE? name (TO | FROM) name
priv: SELECT | INSERT | UPDATE | DELETE | ALL ID? | ID
exprs: expr (',' expr)*
expr: andx | expr OR andx
andx: notx | andx AND notx
notx: NOT notx | cmp
cmp: add | cmp ('=' | CMP) add | cmp IS NOT? (NULL | ID | DISTINCT FROM add) | cmp NOT? (LIKE | ID_LIKE) add (ID STR)? | cmp NOT? IN '(' (select | exprs) ')' | cmp NOT? BETWEEN add AND add
add: una | add (BIN | '*') una
una: BIN una | post
post: atom | post CAST tp | post COLLATE name
atom: NUM | STR | NULL | VARN | name | '(' expr (',' expr)* ')' | '(' select ')' | EXISTS '(' select ')' | func | CASE expr? (WHEN expr THEN expr)+ (ELSE expr)? END | ID STR | DEFAULT '(' name ')'
func: (name | LEFT | RIGHT | IF | REPLACE | TRUNCATE | INSERT | DATABASE | SCHEMA) '(' (DISTINCT? farg (',' farg)* order_c?)? ')' (ID GROUP '(' order_c ')')? (FILTER '(' WHERE expr ')')? (OVER ('(' (PARTITION BY exprs)? order_c? frame? ')' | name))?
frame: ID (fb | BETWEEN fb AND fb)
fb: ID ID | add ID
farg: expr (AS tp)? (FROM expr (FOR expr)?)? | '*'
name: ident | name '.' ident
ident: ID | ID_TOP | {words(SQL_CONTEXT)}
""".replace("batch: stmt end | stmt GO | GO", "batch: stmt end | stmt GO | GO\nfile: ';'* batch* last")

JSON = """
file: value
value: STR | NUM | true | false | null | '{' '}' | '{' pair (',' pair)* '}' | '[' ']' | '[' value (',' value)* ']'
pair: STR ':' value
"""
