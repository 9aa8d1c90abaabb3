"""Java 21."""

from __future__ import annotations

import re

from auditlake.llm.syntax.lex import BAD, Braced, Table
from auditlake.llm.syntax.peg import BRACES, Grammar

# Keywords, contextual keywords and operators.
KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
CONTEXTUAL = "record sealed permits non var yield when module open opens exports requires".split()
OPERATORS = ["...", "->", "::", "==", "!=", "<=", ">=", "&&", "||", "++", "--", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<=", "<<"]
TABLE = Table(KEYWORDS + CONTEXTUAL, OPERATORS)

TEXT = r"""
file <- (annotation* 'package' qname ';')? items EOF
items <- (import / ';')* (typedecl / ';')*
item <- items EOF
import <- 'import' 'static'? qname ('.' '*')? ';'
qname <- id ('.' id)*
annotation <- '@' qname ('(' (annval / annpair (',' annpair)*)? ')')?
annpair <- id '=' annval
annval <- annotation / ANNARR / ternary
annarr <- (annval (',' annval)*)? ','? EOF
mods <- (annotation !'interface' / MODIFIER / 'sealed' &(MODIFIER / 'class' / 'interface' / '@') / 'non' '-' 'sealed')*
typedecl <- mods bodydecl
bodydecl <- 'class' id tparams? ('extends' type)? ('implements' types)? ('permits' types)? CLASSBODY / ('@'? 'interface') id tparams? ('extends' types)? ('permits' types)? CLASSBODY / 'enum' id ('implements' types)? ENUM / 'record' id tparams? '(' (rparam (',' rparam)*)? ')' ('implements' types)? CLASSBODY
rparam <- annotation* type '...'? id
tparams <- '<' tparam (',' tparam)* '>'
tparam <- annotation* id ('extends' type ('&' type)*)?
types <- type (',' type)*
type <- annotation* (PRIM / id targs? ('.' annotation* id targs?)*) dims
dims <- (annotation* '[' ']')*
targs <- '<' (targ (',' targ)*)? '>'
targ <- annotation* '?' (('extends' / 'super') type)? / type
classbody <- (';' / member)* EOF
member <- 'static'? BLOCK / mods (bodydecl / tparams? (id params throws? BLOCK / id BLOCK / ('void' / type) id params dims throws? (BLOCK / ('default' annval)? ';')) / type vars ';')
enumbody <- (enumconst (',' enumconst)*)? ','? (';' (';' / member)*)? EOF
enumconst <- annotation* id args? CLASSBODY?
params <- '(' (param (',' param)*)? ')'
param <- (annotation / 'final')* type '...'? (id '.')? ('this' / id) dims
throws <- 'throws' types
vars <- var (',' var)*
var <- id dims ('=' init)?
init <- ARR / expr
arr <- (init (',' init)*)? ','? EOF
stmts <- stmt* EOF
stmt <- BLOCK / ';' / 'if' '(' expr ')' stmt ('else' stmt)? / for / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';' / try / 'switch' '(' expr ')' CASES / 'synchronized' '(' expr ')' BLOCK / 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') id? ';' / 'yield' !('=' / '.' / '(' ')' / '++' / '--') expr ';' / 'assert' expr (':' expr)? ';' / localtype / local ';' / id ':' stmt / exprstmt ';'
localtype <- mods bodydecl
local <- (annotation / 'final')* type vars
exprstmt <- &stmtexpr expr
stmtexpr <- ('++' / '--') / primary suffix* (ASGOP / '++' / '--') / primary (suffix !&(!suffix))* callend
callend <- args ';' / args ')' / args ',' / newcall
newcall <- 'new' 
for <- 'for' '(' ((annotation / 'final')* type id ':' expr / (local / exprs)? ';' expr? ';' exprs?) ')' stmt
exprs <- expr (',' expr)*
try <- 'try' ('(' resource (';' resource)* ';'? ')')? BLOCK catch* ('finally' BLOCK)?
resource <- (annotation / 'final')* type id '=' expr / expr
catch <- 'catch' '(' (annotation / 'final')* type ('|' type)* id ')' BLOCK
cases <- (label ':' (!(label (':' / '->')) stmt)* / label '->' (BLOCK / 'throw' expr ';' / expr ';'))* EOF
label <- 'case' caseitem (',' caseitem)* ('when' ternary)? / 'default'
caseitem <- 'default' / pattern &('->' / ':' / ',' / 'when') / ternary
pattern <- 'final'? type ('(' (pattern (',' pattern)*)? ')' (!'when' id)? / !'when' id / 'when' &('when' / '->' / ':'))
expr <- lambda / ternary (ASGOP expr)?
lambda <- (id / '(' (lparam (',' lparam)*)? ')') '->' (BLOCK / expr)
lparam <- (annotation / 'final')* type '...'? id dims / id
ternary <- bin ('?' (lambda / ternary) ':' (lambda / ternary))?
bin <- unary (binop unary / 'instanceof' (pattern / 'final'? type))*
binop <- BINARY / '>' '>'? '>'?
unary <- PREFIX unary / cast / primary suffix*
cast <- '(' PRIM dims ')' unary / '(' type ('&' type)* ')' (lambda / &caststart unary)
caststart <- id / 'n' / 'S' / '(' / '!' / '~' / 'new' / LITERAL / 'switch' / PRIM
suffix <- '.' targs? (id / 'new' creator / 'this' / 'class' / 'super') / '[' expr ']' / args / '::' targs? (id / 'new') / '++' / '--'
args <- '(' (expr (',' expr)*)? ')'
primary <- 'n' / 'S' / LITERAL / '(' expr ')' / 'new' creator / 'switch' '(' expr ')' CASES / (PRIM dims / 'void') ('.' 'class' / '::' 'new') / reftype / id
reftype <- qname targs? dims1 ('.' 'class' / '::' 'new') / qname targs &'::'
dims1 <- ('[' ']')*
creator <- annotation* targs? (PRIM / id targs? ('.' id targs?)*) (args CLASSBODY? / ('[' expr ']')+ dims / ('[' ']')+ ARR)
"""
KINDS = {"BLOCK": "stmts", "CLASSBODY": "classbody", "ENUM": "enumbody", "CASES": "cases", "ARR": "arr", "ANNARR": "annarr"}


def _grammar() -> Braced:
    t = TABLE
    text = TEXT
    # An expression statement assigns, counts, calls or creates.
    text = re.sub(r"exprstmt <- .*\n", "exprstmt <- PREFIX2 unary / 'new' creator suffix* (ASGOP expr)? / primary effect\n", text)
    text = re.sub(r"stmtexpr <- .*\n", "effect <- suffix effect / ASGOP expr / &&ENDING ''\n", text)
    text = re.sub(r"callend <- .*\nnewcall <- .*\n", "", text)
    text = text.replace("effect <- suffix effect / ASGOP expr / &&ENDING ''\n", "effect <- (args / '++' / '--') (effect / &(';' / ')' / ',')) / suffix effect / ASGOP expr\n")
    text = text.replace("PREFIX2 unary", "('++' / '--') unary")
    sets = {
        "id": "i" + t.set_of(*CONTEXTUAL),
        "PRIM": t.set_of("boolean", "byte", "char", "double", "float", "int", "long", "short"),
        "MODIFIER": t.set_of("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default"),
        "LITERAL": t.set_of("this", "super", "true", "false", "null"),
        "PREFIX": t.set_of("+", "-", "!", "~", "++", "--"),
        "ASGOP": t.set_of("=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<="),
        "BINARY": t.set_of("+", "-", "*", "/", "%", "&", "|", "^", "<", "<=", ">=", "==", "!=", "&&", "||", "<<"),
    }
    return Braced(Grammar(text, t.tokens, sets, KINDS), KINDS, "file")


_made: list[Braced] = []


def language() -> Braced:
    if not _made:
        _made.append(_grammar())
    return _made[0]


LEX = re.compile(
    r"(//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)"
    r"|(\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\\.|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))')"
    r"|([A-Za-z_$\u0080-\uffff][\w$]*)"
    r"|((?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))"
    r"|(\s+)"
    r"|(\d[\w$]*)",
    re.S,
)
SHIFT_ASSIGN = re.compile(r">\s*>\s*>?\s*=(?!=)")


def tokens(text: str) -> str:
    words = TABLE.words.get

    def one(m: re.Match) -> str:
        k = m.lastindex
        if k == 3:
            return words(m.group(), "i")
        if k == 5 or k == 1:
            return " "
        if k == 2:
            return "S"
        if k == 4:
            return "n"
        return BAD

    out = LEX.sub(one, text.removeprefix("\ufeff"))
    if ">=" in out:
        out = re.sub(r">>>?=", "+=", out)
    return TABLE.operator.sub(lambda m: TABLE.ops[m.group()], out).replace(" ", "")


CUT = re.compile(r"(?<=[;\U000f0000-\U000fffff])(?=[^;])")


def valid(text: str) -> bool:
    lang = language()
    flat = lang.reduced(tokens(text))
    if BAD in flat or chr(BRACES) in flat:
        return False
    return lang.whole("file", flat)
