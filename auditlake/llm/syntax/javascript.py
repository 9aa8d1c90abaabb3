"""JavaScript and TypeScript, with and without JSX."""

from __future__ import annotations

import re

from auditlake.llm.syntax.lex import BAD, Braced, Table
from auditlake.llm.syntax.peg import Grammar

# Reserved words, words with a meaning in places, operators.
RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield null true false enum await".split()
CONTEXTUAL = "as async from get set static of let type interface namespace module declare abstract readonly public private protected implements keyof infer is asserts satisfies unique override accessor target meta global require constructor out undefined".split()
OPERATORS = ["=>", "...", "?.", "??=", "**=", "&&=", "||=", "??", "&&", "||", "===", "!==", "==", "!=", "<=", ">=", "++", "--", "**", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "<<"]
TABLE = Table(RESERVED + CONTEXTUAL, OPERATORS)

SHARED = r"""
stmts <- stmt* EOF
stmt <- ';' / BLOCK / vardecl eos / funcdecl / classdecl / ifs / fors / whiles / dos / trys / switchs / returns / throws / jumps / imports / exports / tsdecl / label / exprstmt
eos <- ';' / NL / EOF
label <- id ':' stmt
exprstmt <- !'function' !'class' !OBJONLY expr eos
OBJSTMT <- OBJ
vardecl <- 'const' cdecl (',' cdecl)* / ('let' / 'var') decl (',' decl)*
cdecl <- target '!'? ann? '=' assign
decl <- target '!'? ann? ('=' assign)? !(!NL target)
target <- id / PAT / '[' ','* (patel (','+ patel)* ','*)? ']'
patel <- '...'? target ('=' assign)?
funcdecl <- 'async'? 'function' '*'? id? tparams? params rett? fbody
fbody <- BLOCK
params <- '(' (param (',' param)* ','?)? ')'
param <- decorator* pmods '...'? (target / 'this') '?'? ann? ('=' assign)?
classdecl <- decorator* 'abstract'? 'class' (!'implements' id)? tparams? ('extends' lhs targs?)? impls? CLASSBODY
decorator <- '@' lhs
classbody <- (';' / member)* EOF
member <- decorator* ('static' BLOCK / mods (index / method / field))
~mods <- (modword !('(' / '=' / ';' / ':' / '?' / '!' / '<' / EOF))*
method <- (('get' / 'set') !('(' / '=' / ';' / ':' / '<' / EOF))? ('async' !NL !('(' / '=' / ';' / ':' / '<' / EOF))? '*'? propkey '?'? tparams? params rett? mbody
mbody <- BLOCK
field <- propkey ('?' / '!')? ann? ('=' assign)? eos
propkey <- WORD / 'S' / 'n' / '[' assign ']' / '#' WORD
ifs <- 'if' '(' expr ')' stmt ('else' stmt)?
fors <- 'for' 'await'? '(' forhead ')' stmt
forhead <- ('const' / 'let' / 'var') target ann? ('of' assign / 'in' expr) / lhs ('of' assign / 'in' expr) / (vardecl / expr)? ';' expr? ';' expr?
whiles <- 'while' '(' expr ')' stmt
dos <- 'do' stmt 'while' '(' expr ')' ';'?
trys <- 'try' BLOCK ('catch' ('(' target ann? ')')? BLOCK ('finally' BLOCK)? / 'finally' BLOCK)
switchs <- 'switch' '(' expr ')' CASES
cases <- (('case' expr / 'default') ':' stmt*)* EOF
returns <- 'return' (!NL expr)? eos
throws <- 'throw' !NL expr eos
jumps <- ('break' / 'continue') (!NL id)? eos / 'debugger' eos
imports <- 'import' 'S' with? eos / 'import' tstype? clause 'from' 'S' with? eos / tsimport
with <- 'with' OBJ
clause <- NAMES / '*' 'as' id / id (',' (NAMES / '*' 'as' id))?
exports <- 'export' ('default' (funcdecl / classdecl / tsdecl / assign eos) / '*' ('as' (WORD / 'S'))? 'from' 'S' with? eos / tstype? NAMES ('from' 'S' with?)? eos / vardecl eos / funcdecl / classdecl / tsdecl / tsexport)
names <- (tsname? (WORD / 'S') ('as' (WORD / 'S'))? (',' tsname? (WORD / 'S') ('as' (WORD / 'S'))?)* ','?)? EOF
expr <- assign (',' assign)*
braced <- '...'? expr? EOF
assign <- arrow / yields / bin ('?' assign ':' assign / ASSIGN assign)?
yields <- 'yield' (!NL '*'? assign)?
arrow <- 'async'? !NL (id / tparams? params rett?) !NL '=>' (BLOCK / !OBJONLY assign)
bin <- unary (binop unary)*
binop <- BINARY / '>' '>'? '>'?
unary <- (PREFIX / 'await' !EOF)* postfix
postfix <- lhs (!NL ('++' / '--'))?
lhs <- primary suffix*
suffix <- '.' ('#'? WORD) / '?.' ('#'? WORD / args / '[' expr ']' / template) / '[' expr ']' / args / template / tssuffix
args <- '(' (arg (',' arg)* ','?)? ')'
arg <- '...'? assign
primary <- 'new' ('.' 'target' / newexpr) / func / classdecl / 'S' / 'n' / template / '(' expr ')' / '[' ','* (arg (','+ arg)* ','*)? ']' / OBJ / LITERAL / 'import' (args / '.' 'meta') / '#' WORD / jsx / id
newexpr <- ('new' newexpr / newbase) ('.' ('#'? WORD) / '[' expr ']')* targs? args?
newbase <- '(' expr ')' / classdecl / func / 'this' / 'super' / 'import' '.' 'meta' / id
func <- 'async'? 'function' '*'? id? tparams? params rett? BLOCK
template <- '`' EXPRB* '`'
obj <- (prop (',' prop)* ','?)? EOF
prop <- '...' assign / (('get' / 'set') !('(' / ':' / ',' / '=' / '<' / EOF))? ('async' !('(' / ':' / ',' / '=' / '<' / EOF))? '*'? propkey tparams? params rett? BLOCK / propkey ':' assign / id ('=' assign)?
pat <- (patprop (',' patprop)* ','?)? EOF
patprop <- '...' target / propkey ':' (target / lhs) ('=' assign)? / id ('=' assign)?
"""

PLAIN = r"""
ann <- !ANY ANY
rett <- !ANY ANY
tparams <- !ANY ANY
targs <- !ANY ANY
impls <- !ANY ANY
index <- !ANY ANY
tsdecl <- !ANY ANY
tssuffix <- !ANY ANY
tsimport <- !ANY ANY
tsexport <- !ANY ANY
tstype <- !ANY ANY
tsname <- !ANY ANY
~pmods <- ''*
types <- !ANY ANY
enum <- !ANY ANY
~modword <- 'static' / 'accessor'
"""

TYPES = r"""
ann <- ':' type
rett <- ':' ('asserts'? (id / 'this') 'is' type / 'asserts' (id / 'this') / type)
tparams <- '<' tparam (',' tparam)* ','? '>'
tparam <- 'const'? 'in'? 'out'? id ('extends' type)? ('=' type)?
targs <- '<' type (',' type)* ','? '>'
impls <- 'implements' type (',' type)*
type <- fntype / union ('extends' union '?' type ':' type)?
fntype <- 'abstract'? 'new'? tparams? params '=>' ('asserts'? (id / 'this') 'is' type / type)
union <- ('|' / '&')? arrtype (('|' / '&') arrtype)*
arrtype <- ('keyof' / 'unique' / 'readonly' / 'infer') arrtype / fntype / basetype (!NL '[' type? ']')*
basetype <- '(' type ')' / 'typeof' (importtype / qname targs?) / importtype / '[' (tuplel (',' tuplel)* ','?)? ']' / TYPES / 'S' / 'n' / '-' 'n' / '`' TYPEB* '`' / 'this' / 'void' / 'null' / 'true' / 'false' / qname (!NL targs)?
tuplel <- '...'? (WORD '?'? ':' type / type '?'?)
importtype <- 'import' '(' 'S' ')' ('.' WORD)* targs?
qname <- id ('.' WORD)*
typeonly <- type EOF
types <- (tmember (',' / ';' / NL / EOF))* EOF
tmember <- (('+' / '-')? 'readonly')? '[' id 'in' type ('as' type)? ']' (('+' / '-')? '?')? ann? / 'readonly'? '[' id ':' type ']' ann / 'new'? tparams? params rett? / (('get' / 'set') !('(' / '?' / ':'))? propkey '?'? tparams? params rett? / ('readonly' !('?' / ':' / '('))? propkey '?'? ann?
enum <- (WORD1 ('=' assign)? (',' WORD1 ('=' assign)?)* ','?)? EOF
WORD1 <- WORD / 'S' / '[' 'S' ']'
tsdecl <- 'declare' (vardeclare eos / ('namespace' / 'module') !NL (qname / 'S') (AMBIENT / eos) / 'global' AMBIENT / tsdecl / funcdecl / classdecl) / 'interface' !NL id tparams? ('extends' type (',' type)*)? TYPES / 'type' !NL id tparams? '=' type eos / 'const'? 'enum' id ENUM / ('namespace' / 'module') !NL (qname / 'S') (BLOCK / eos) / 'global' BLOCK
ambient <- ('export'? vardeclare eos / stmt)* EOF
vardeclare <- ('const' / 'let' / 'var') id ann? (',' id ann?)*
tssuffix <- !NL '!' !'=' / targs &('(' / '`' / '.' / ')' / ',' / ';' / EOF) / !NL ('as' / 'satisfies') ('const' / type)
tsimport <- 'import' 'type'? id '=' ('require' '(' 'S' ')' / qname) eos
tsexport <- '=' expr eos / 'as' 'namespace' id eos / 'import' id '=' qname eos
tstype <- 'type' !('from' 'S') !','
tsname <- 'type' &(WORD / 'S') !(',' / EOF)
~pmods <- (('public' / 'private' / 'protected' / 'readonly' / 'override') &(WORD / '[' / PAT / '...'))*
~modword <- 'static' / 'accessor' / 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'declare' / 'override'
index <- '[' id ':' type ']' ann eos
"""
# In TypeScript a function or method may be declared without a body.
BODILESS = {"fbody <- BLOCK": "fbody <- BLOCK / eos", "mbody <- BLOCK": "mbody <- BLOCK / eos"}

JSX = r"""
jsx <- '<' '>' child* '<' '/' '>' / '<' jsxname targs? attr* ('/' '>' / '>' child* '<' '/' jsxname '>')
jsxname <- WORD (('.' / ':' / '-') WORD)*
attr <- EXPRB / jsxname ('=' ('S' / EXPRB / jsx))?
child <- jsx / EXPRB / TEXT+
"""
NO_JSX = "jsx <- !ANY ANY"
ANGLE = "jsx <- '<' type '>' unary"

KINDS = {"BLOCK": "stmts", "OBJ": "obj", "PAT": "pat", "CLASSBODY": "classbody", "CASES": "cases", "NAMES": "names", "TYPES": "types", "ENUM": "enum", "EXPRB": "braced", "TYPEB": "typeonly", "AMBIENT": "ambient"}


def _grammar(ts: bool, jsx: bool) -> Braced:
    text = SHARED + (TYPES if ts else PLAIN + "typeonly <- !ANY ANY\nambient <- !ANY ANY\n") + (JSX if jsx else ANGLE if ts else NO_JSX)
    text = text.replace("OBJSTMT <- OBJ\n", "").replace("!OBJONLY ", "")
    text = text.replace("~pmods <- ''*", "~pmods <- ('\x02')*")
    if ts:
        for a, b in BODILESS.items():
            text = text.replace(a, b)
    t = TABLE
    ident = "i" + t.set_of(*CONTEXTUAL) + t.words["yield"] + t.words["await"]
    sets = {
        "id": ident,
        "WORD": t.any_word,
        "LITERAL": t.set_of("this", "super", "null", "true", "false"),
        "PREFIX": t.set_of("!", "~", "+", "-", "++", "--", "typeof", "void", "delete"),
        "ASSIGN": t.set_of("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "**=", "??=", "&&=", "||="),
        "BINARY": t.set_of("+", "-", "*", "/", "%", "&", "|", "^", "<", "<=", ">=", "==", "!=", "===", "!==", "&&", "||", "??", "**", "<<", "in", "instanceof"),
    }
    everything = {chr(c) for c in range(33, 127)} - set("<>{}") | set(t.any_word) | set(t.ops.values()) | {BAD}
    sets["TEXT"] = "".join(everything)
    return Braced(Grammar(text, t.tokens, sets, KINDS, skip_lines=True), KINDS, "stmts")


_made: dict[tuple[bool, bool], Braced] = {}


def language(ts: bool, jsx: bool) -> Braced:
    if (ts, jsx) not in _made:
        _made[ts, jsx] = _grammar(ts, jsx)
    return _made[ts, jsx]


LEX = re.compile(
    r"(//[^\n]*)"  # 1 comment
    r"|(/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)"  # 2 comment
    r"|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"  # 3 string
    r"|([A-Za-z_$\u0080-\uffff][\w$]*|\\u[0-9a-fA-F]{4}[\w$]*)"  # 4 word
    r"|((?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:\.(?!\.))?(?:[eE][+-]?\d+)?)n?(?![\w$]))"  # 5 number
    r"|(`)"  # 6 template
    r"|((?<=[(,=:\[!&|?;+*%~^\n])[ \t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*)"  # 7 regular expression
    r"|([ \t\r\f\v\u00a0\ufeff]+)"  # 8 blank
    r"|(\d[\w$]*)",  # 9 no number
    re.S,
)
RETURN_REGEX = re.compile(r"\b(return|typeof|case|in|of|=>)[ \t]+/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")


def template_end(text: str, at: int) -> tuple[int, list[tuple[int, int]]] | None:
    """The end of the template that begins at ``at``, and its expressions; None if it has no end."""
    i, n, parts = at + 1, len(text), []
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, parts
        elif c == "$" and text[i + 1 : i + 2] == "{":
            depth, j = 1, i + 2
            while j < n and depth:
                d = text[j]
                if d == "{":
                    depth += 1
                elif d == "}":
                    depth -= 1
                elif d == "`":
                    inner = template_end(text, j)
                    if inner is None:
                        return None
                    j = inner[0]
                    continue
                elif d in "\"'":
                    m = re.compile(rf"{d}(?:[^{d}\\\n]|\\.)*{d}").match(text, j)
                    if m:
                        j = m.end()
                        continue
                j += 1
            if depth:
                return None
            parts.append((i + 2, j - 1))
            i = j
        else:
            i += 1
    return None


def tokens(text: str) -> str:
    """The token string; line ends stay where they aren't within a comment."""
    if text.startswith("#!"):
        text = "//" + text[2:]
    words = TABLE.words.get
    pieces: list[str] = []
    at = 0

    def one(m: re.Match) -> str:
        k = m.lastindex
        if k == 4:
            return words(m.group(), "i")
        if k == 8 or k == 1:
            return " "
        if k == 3:
            return "S"
        if k == 5:
            return "n"
        if k == 2:
            return "\n" if "\n" in m.group() else " "
        if k == 7:
            return "S"
        return BAD

    if "`" in text:
        # Templates are cut out first, by a scan that knows strings and comments.
        for m in LEX.finditer(text):
            if m.lastindex == 6 and m.start() >= at:
                pieces.append(LEX.sub(one, text[at : m.start()]))
                found = template_end(text, m.start())
                if found is None:
                    pieces.append(BAD)
                    at = m.start() + 1
                    break
                pieces.append("`" + "".join("{" + tokens(text[a:b]) + "}" for a, b in found[1]) + "`")
                at = found[0]
        pieces.append(LEX.sub(one, text[at:]))
        out = "".join(pieces)
    else:
        out = LEX.sub(one, text)
    out = TABLE.operator.sub(lambda m: TABLE.ops[m.group()], out)
    out = out.replace(" ", "")
    return re.sub(r"\n+", "\n", out)


#: A line end that ends nothing: beside an operator that needs what is on the other side.
_O = re.escape("".join(TABLE.tokens.get(x, x) for x in ["(", "[", ",", "=", ":", "?", "+", "-", "*", "%", "&", "|", "^", "~", ".", "=>", "...", "?.", "??", "&&", "||", "===", "!==", "==", "!=", "<=", ">=", "+=", "-=", "<"]))
_C = re.escape("".join(TABLE.tokens.get(x, x) for x in [")", "]", ",", "=", ":", "?", "*", "%", "&", "|", "^", ".", "=>", "?.", "??", "&&", "||", "===", "!==", "==", "!=", "<=", ">=", "+=", "-=", "in", "instanceof"]))
JOIN = re.compile(rf"(?<=[{_O}])\n|\n(?=[{_C}])")
#: Where a top-level statement may begin: after a line end, or after a semicolon or a reduced brace and one.
STARTS = TABLE.set_of("const", "let", "var", "function", "class", "export", "import", "if", "for", "while", "try", "switch", "return", "throw", "async", "interface", "type", "declare", "abstract", "enum", "namespace")
CUT = re.compile(rf"(?<=[;\U000f0000-\U000fffff])\n?(?=[{STARTS}@!])|\n(?=[{STARTS}])")


def chunks(text: str) -> list[str]:
    """The top level in pieces that are likely whole statements: cut where none of the brackets is open."""
    out, depth = [], 0
    held = ""
    last = 0
    for m in CUT.finditer(text):
        piece = text[last : m.start()]
        depth += piece.count("(") + piece.count("[") - piece.count(")") - piece.count("]")
        held += piece
        last = m.start()
        if depth == 0:
            out.append(held)
            held = ""
    out.append(held + text[last:])
    return out


def valid(text: str, ts: bool, jsx: bool) -> bool:
    """The text is a program of the language."""
    lang = language(ts, jsx)
    flat = JOIN.sub("", lang.reduced(JOIN.sub("", tokens(text))))
    if BAD in flat and not jsx:
        return False
    parts = chunks(flat)
    i = 0
    while i < len(parts):
        if lang.whole("stmts", parts[i].strip("\n")):
            i += 1
            continue
        # The piece may have been cut within a statement: the whole rest decides.
        return lang.grammar.parse("stmts", "".join(parts[i:])) >= 0
    return True
