"""Go."""

from __future__ import annotations

import re

from auditlake.llm.syntax.lex import BAD, Braced, Table
from auditlake.llm.syntax.peg import BRACES, Grammar

# Keywords and operators.
KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
OPERATORS = ["<<=", ">>=", "&^=", "...", "&&", "||", "<-", "++", "--", "==", "!=", "<=", ">=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "&^"]
TABLE = Table(KEYWORDS, OPERATORS)

TEXT = r"""
file <- package (imports ';'+)* EOF / package (imports ';'+)* (top ';'+)* EOF
package <- ';'* 'package' 'i' ';'+
imports <- 'import' (importspec / '(' (importspec ';'+)* importspec? ')')
importspec <- ('i' / '.')? 'S'
top <- func / decl
topitem <- (imports ';'+)* (top ';'+)* EOF
func <- 'func' params? 'i' tparams? params result? BLOCK?
tparams <- '[' tparam (',' tparam)* ','? ']'
tparam <- 'i' (',' 'i')* union
params <- '(' (param (',' param)* ','?)? ')'
param <- 'i' '...'? type / '...'? type
result <- params / type
decl <- ('const' (constspec / '(' (constspec ';'+)* constspec? ')') / 'var' (varspec / '(' (varspec ';'+)* varspec? ')') / 'type' (typespec / '(' (typespec ';'+)* typespec? ')'))
constspec <- idents (type? '=' exprs)? 
varspec <- idents (type ('=' exprs)? / '=' exprs)
typespec <- 'i' tparams &typestart '='? type / 'i' '='? type
typestart <- 'i' / '*' / '[' / '(' / 'map' / 'chan' / 'func' / 'struct' / 'interface' / '<-' / '='
idents <- 'i' (',' 'i')*
type <- '*' type / '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / 'chan' '<-'? type / '<-' 'chan' type / 'func' params result? / 'struct' STRUCT / 'interface' IFACE / named / '(' type ')'
named <- 'i' ('.' 'i')? targs?
targs <- '[' type (',' type)* ','? ']'
union <- '~'? type ('|' '~'? type)*
structs <- (';' / field (';' / EOF))* EOF
field <- (idents type / '*'? named) 'S'?
ifaces <- (';' / ifaceel (';' / EOF))* EOF
ifaceel <- 'i' params result? / union
stmts <- (stmt? ';')* stmt? EOF
stmt <- decl / if / for / switch / select / 'return' exprs? / 'go' expr / 'defer' expr / 'break' 'i'? / 'continue' 'i'? / 'goto' 'i' / 'fallthrough' / BLOCK / 'i' ':' stmt? / simple
simple <- exprs (ASGOP exprs / '++' / '--' / '<-' expr)?
if <- 'if' (simpleH? ';')? exprH BLOCK ('else' (if / BLOCK))?
for <- 'for' (rangeH / simpleH? ';' exprH? ';' simpleH? / exprH)? BLOCK
rangeH <- (exprsH ASGOP)? 'range' exprH
switch <- 'switch' (simpleH? ';')? simpleH? CASES
select <- 'select' CASES
cases <- (('case' casehead / 'default') ':' (stmt? ';')* stmt?)* EOF
casehead <- exprs (ASGOP expr / '<-' expr)? / caseel (',' caseel)*
caseel <- expr !(&('*' / '[')) / type
args <- '(' (arg (',' arg)* '...'? ','?)? ')'
arg <- expr &(',' / ')' / '...') / type
suffix <- '.' ('i' / '(' ('type' / type) ')') / '[' index ']' / args
index <- expr? ':' expr? (':' expr)? / (expr &(',' / ']') / type) (',' (expr &(',' / ']') / type))* ','?
lit <- (el (',' el)* ','?)? EOF
el <- (val ':')? val
val <- expr / LIT
exprs <- expr (',' expr)*
expr <- unary (BINOP unary)*
unary <- UNOP unary / primary
primary <- operand (suffix / LIT)*
operand <- 'n' / 'S' / 'func' params result? BLOCK / ('[' (']' / '...' ']' / expr ']') type / 'map' '[' type ']' type / 'struct' STRUCT) (LIT / args) / ('chan' '<-'? type / 'interface' IFACE) args / '(' (expr ')' / type ')') / 'i'
exprsH <- exprH (',' exprH)*
exprH <- unaryH (BINOP unaryH)*
unaryH <- UNOP unaryH / primaryH
primaryH <- operand suffix*
simpleH <- exprsH (ASGOP exprsH / '++' / '--' / '<-' exprH)?
"""
KINDS = {"BLOCK": "stmts", "STRUCT": "structs", "IFACE": "ifaces", "LIT": "lit", "CASES": "cases"}


def _grammar() -> Braced:
    t = TABLE
    sets = {
        "ASGOP": t.set_of("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="),
        "BINOP": t.set_of("+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", "&^", "&&", "||", "==", "!=", "<", "<=", ">", ">="),
        "UNOP": t.set_of("+", "-", "!", "^", "*", "&", "<-", "~"),
    }
    return Braced(Grammar(TEXT, t.tokens, sets, KINDS), KINDS, "file")


_made: list[Braced] = []


def language() -> Braced:
    if not _made:
        _made.append(_grammar())
    return _made[0]


LEX = re.compile(
    r"(//[^\n]*)"
    r"|(/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)"
    r"|(\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)')"
    r"|([A-Za-z_\u0080-\uffff][\w]*)"
    r"|((?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F]*)?(?:p[+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)i?(?![\w]))"
    r"|([ \t\r]+)"
    r"|(\d\w*)"
)
_ENDS = re.escape("inS)]}" + "".join(TABLE.tokens[x] for x in ["break", "continue", "fallthrough", "return", "++", "--"]))
SEMICOLON = re.compile(rf"(?<=[{_ENDS}])\n")


def tokens(text: str) -> str:
    """The token string, with semicolons where line ends stand for them."""
    words = TABLE.words.get

    def one(m: re.Match) -> str:
        k = m.lastindex
        if k == 4:
            return words(m.group(), "i")
        if k == 6 or k == 1:
            return " "
        if k == 3:
            return "S"
        if k == 5:
            return "n"
        if k == 2:
            return "\n" if "\n" in m.group() else " "
        return BAD

    out = LEX.sub(one, text.removeprefix("\ufeff"))
    out = TABLE.operator.sub(lambda m: TABLE.ops[m.group()], out).replace(" ", "") + "\n"
    return SEMICOLON.sub(";", out).replace("\n", "")


_T = "".join(TABLE.tokens[x] for x in ["func", "type", "var", "const", "import", "package"])
CUT = re.compile(rf";(?=[{_T}])")


def valid(text: str) -> bool:
    lang = language()
    flat = lang.reduced(tokens(text))
    if BAD in flat or chr(BRACES) in flat:
        return False
    parts = CUT.split(flat)
    # The package clause leads; then every piece is a declaration; else the whole decides (it may have been cut within parentheses).
    if lang.whole("package", parts[0] + ";") and len(parts[0]) <= 4 and all(lang.whole("topitem", p if p.endswith(";") else p + ";") for p in parts[1:]):
        late = next((i for i, p in enumerate(parts[1:]) if not p.startswith(TABLE.tokens["import"])), len(parts))
        if not any(p.startswith(TABLE.tokens["import"]) for p in parts[1 + late :]):
            return True
    return lang.grammar.parse("file", flat) >= 0
