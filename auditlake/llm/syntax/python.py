"""Python 3.12.

A file is read as logical lines; each is parsed by the line grammar, and remembered by its tokens. The block structure is then parsed as
a string of line kinds with indents and dedents.
"""

from __future__ import annotations

import re

from auditlake.llm.syntax.lex import BAD, Table
from auditlake.llm.syntax.peg import Grammar

# Keywords (hard, then soft) and operators.
KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = "match case type _".split()
OPERATORS = ["**=", "//=", ">>=", "<<=", "...", "->", ":=", "**", "//", "<<", ">>", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "@=", "&=", "|=", "^="]
TABLE = Table(KEYWORDS + SOFT, OPERATORS)
FSTRING, FSTART, FEND = "\x02", "\x03", "\x04"  # an f-string's begin, and a replacement field's limits

TEXT = r"""
line <- compound / simple (';' simple)* ';'? EOF
simple <- typealias / assignment / 'del' target (',' target)* ','? / 'assert' expr (',' expr)? / 'raise' (expr ('from' expr)?)? / 'return' stars? / 'pass' / 'break' / 'continue' / ('global' / 'nonlocal') id (',' id)* / imports / yield / stars
typealias <- 'type' id tparams? '=' expr
imports <- 'import' dotted ('as' id)? (',' dotted ('as' id)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' names ','? ')' / names)
dotted <- id ('.' id)*
names <- id ('as' id)? (',' id ('as' id)?)*
assignment <- single ':' expr ('=' (yield / stars))? / (targets '=')+ (yield / stars) !'=' / single AUGMENTED (yield / stars)
targets <- startarget (',' startarget)* ','?
startarget <- '*'? target
target <- tprim / '(' targets? ')' / '[' targets? ']' / id
single <- tprim / id / '(' single ')'
tprim <- atom (trailer &trailer)* ('.' id / '[' slices ']') !trailer
yield <- 'yield' ('from' expr / stars?)
stars <- star (',' star)* ','?
star <- '*' bitor / expr !':='
nstars <- nstar (',' nstar)* ','?
nstar <- '*' bitor / named
named <- id ':=' expr / expr !':='
expr <- lambda / disj ('if' disj 'else' expr)?
lambda <- 'lambda' lparams? ':' expr
lparams <- lparam (',' lparam)* ','?
lparam <- '*' id / '*' &(',' id) / '**' id / '/' / id ('=' expr)?
disj <- inv (('and' / 'or') inv)*
inv <- 'not' inv / bitor (compop bitor)*
compop <- COMPARE / 'not' 'in' / 'is' 'not' / 'is' / 'in'
bitor <- unary (ARITHMETIC unary)*
unary <- ('-' / '+' / '~') unary / 'await'? atom trailer* ('**' unary)?
trailer <- '.' id / '(' (args &')' / named compfor)? ')' / '[' slices ']'
args <- posargs (',' kwargs)? ','? / kwargs ','?
posargs <- posarg (',' posarg)*
posarg <- '*' expr / named !'='
kwargs <- kwarg (',' kwarg)*
kwarg <- id '=' expr / '**' expr / '*' expr
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / '*' bitor / named
compfor <- ('async'? 'for' targets 'in' disj ('if' compif)*)+
compif <- lambda / disj
atom <- id / 'n' / strings / 'None' / 'True' / 'False' / '...' / '(' (yield / named compfor / nstars)? ')' / '[' (named compfor / nstars)? ']' / '{' (dict / nstar (compfor / (',' nstar)* ','?))? '}'
strings <- ('S' / fstring)+ / 'B'+
fstring <- FS field* FE
field <- '{' (yield / nstars) '='? ('!' id)? (':' field*)? '}'
dict <- '**' bitor dictrest / expr ':' expr (compfor / dictrest)
dictrest <- (',' dictitem)* ','?
dictitem <- '**' bitor / expr ':' expr
compound <- if / elif / else / for / while / try / except / finally / with / def / class / match / case / deco
body <- EOF / simple (';' simple)* ';'? EOF
if <- 'if' named ':' body
elif <- 'elif' named ':' body
else <- 'else' ':' body
for <- 'async'? 'for' targets 'in' stars ':' body
while <- 'while' named ':' body
try <- 'try' ':' body
except <- 'except' ('*'? expr ('as' id)?)? ':' body
finally <- 'finally' ':' body
with <- 'async'? 'with' ('(' withitem (',' withitem)* ','? ')' &':' / withitem (',' withitem)*) ':' body
withitem <- expr ('as' startarget)?
def <- 'async'? 'def' id tparams? '(' params? ')' ('->' expr)? ':' body
tparams <- '[' tparam (',' tparam)* ','? ']'
tparam <- ('*' / '**')? id (':' expr)? ('=' expr)?
params <- (plain (',' plain)* (',' defaulted)* / defaulted (',' defaulted)*) (',' starred)? ','? / starred ','?
plain <- '/' / id (':' expr)? !'='
defaulted <- '/' / id (':' expr)? '=' expr
starred <- '*' (id (':' '*'? expr)? / &(',' id)) (',' id (':' expr)? ('=' expr)?)* (',' '**' id (':' expr)?)? / '**' id (':' expr)?
class <- 'class' id tparams? ('(' args? ')')? ':' body
match <- 'match' nstars ':' EOF
case <- 'case' patterns ('if' named)? ':' body
patterns <- pattern (',' pattern)* ','?
pattern <- '*' id / orpat ('as' id)?
orpat <- closed ('|' closed)*
closed <- '-'? 'n' (('+' / '-') 'n')? / strings / 'None' / 'True' / 'False' / '(' patterns? ')' / '[' patterns? ']' / '{' (keypat (',' keypat)* ','?)? '}' / id ('.' id)* ('(' (argpat (',' argpat)* ','?)? ')')?
keypat <- '**' id / (strings / '-'? 'n' / 'None' / 'True' / 'False' / id ('.' id)+) ':' pattern
argpat <- id '=' pattern / pattern
deco <- '@' named EOF
"""
#: Kind of line, its rule, its character. A header with its body on the line has b after it.
HEADERS = [("if", "I"), ("elif", "L"), ("else", "E"), ("for", "F"), ("while", "W"), ("try", "T"), ("except", "X"), ("finally", "Y"), ("with", "H"), ("def", "D"), ("class", "C"), ("match", "M"), ("case", "K"), ("deco", "@")]
BLOCKS = r"""
file <- stmt* EOF
stmt <- 's' / '@'* ('D' / 'C') block / 'I' block ('L' block)* ('E' block)? / ('F' / 'W') block ('E' block)? / 'T' block (('X' block)+ ('E' block)? ('Y' block)? / 'Y' block) / 'H' block / 'M' '>' ('K' block)+ '<'
block <- 'b' / '>' stmt+ '<'
item <- stmt+ EOF
"""


def _grammars() -> tuple[Grammar, Grammar]:
    t = TABLE
    sets = {
        "id": "i" + t.set_of(*SOFT),
        "AUGMENTED": t.set_of("+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="),
        "COMPARE": t.set_of("==", "!=", "<", "<=", ">", ">="),
        "ARITHMETIC": t.set_of("+", "-", "*", "/", "//", "%", "@", "&", "|", "^", "<<", ">>"),
        "FS": FSTRING,
        "FE": FEND,
    }
    return Grammar(TEXT, t.tokens, sets, {}), Grammar(BLOCKS, {}, {}, {})


LINES, STRUCTURE = _grammars()
MOST = 400_000
_lines: dict[str, str] = {}
_items: dict[str, bool] = {}

_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
_PLAIN = r"(?:[rR][bB]?|[bB][rR]?|[uU])?"
_STRING = rf"{_PLAIN}(?:\"\"\"[^\"\\]*(?:(?:\\.|\"(?!\"\"))[^\"\\]*)*\"\"\"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*'''|\"(?!\"\")[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"|'(?!'')[^'\\\n]*(?:\\.[^'\\\n]*)*')"
LEX = re.compile(
    r"(#[^\n]*|\\\r?\n)"
    rf"|({_STRING})"
    r"|([^\W\d]\w*)(?![\"'])"
    r"|((?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?!0[\d_]*[1-9][\d_]*(?![\d_.eEjJ]))(?:\d(?:_?\d)*)?\.?\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))"
    r"|(\d\w*)"
    r"|([^\W\d]\w*)",
    re.S,
)
#: Comments and whole strings, which may hide an opening; and the opening of an f-string, or of a string without end.
SPECIAL = re.compile(rf"#[^\n]*|(?<!\w){_STRING}|(?<!\w)({_PREFIX}(?:\"\"\"|'''|\"|'))", re.S)
OPENING = re.compile(rf"{_PREFIX}(?:\"\"\"|'''|\"|')")
BODY = {q: re.compile(rf"(?:[^\\{q[0]}{chr(92) + 'n' if len(q) == 1 else ''}]|\\.{'' if len(q) == 1 else f'|{q[0]}(?!{q[0]}{q[0]})'})*{q}", re.S) for q in ("'", '"', "'''", '"""')}


def fstring(text: str, at: int, quote: str, raw: bool) -> tuple[int, str] | None:
    """The end of an f-string whose text begins at ``at``, and its token string; None if it is broken."""
    i, n, out = at, len(text), [FSTRING]
    while i < n:
        c = text[i]
        if text.startswith(quote, i):
            return i + len(quote), "".join(out) + FEND
        if c == "\\" and not raw:
            if text.startswith("N{", i + 1):
                i = text.find("}", i) + 1 or n
            else:
                i += 2
        elif c == "\\" and text[i + 1 : i + 2] not in ("{", "}"):
            i += 2
        elif c == "\n" and len(quote) == 1:
            return None
        elif c == "{":
            if text.startswith("{{", i):
                i += 2
                continue
            got = field(text, i, quote, raw)
            if got is None:
                return None
            i, piece = got
            out.append(piece)
        elif c == "}":
            if not text.startswith("}}", i):
                return None
            i += 2
        else:
            i += 1
    return None


def field(text: str, at: int, quote: str, raw: bool) -> tuple[int, str] | None:
    """A replacement field that begins with the brace at ``at``: its end and its tokens."""
    i, n, depth, begin = at + 1, len(text), 0, at + 1
    pieces: list[str] = []

    def upto(j: int) -> None:
        pieces.append(flat(text[begin:j]))

    while i < n:
        c = text[i]
        if c in "([{":
            depth += 1
        elif c in ")]" or c == "}" and depth:
            depth -= 1
        elif c == "}":
            upto(i)
            return i + 1, "{" + "".join(pieces) + "}"
        elif c == "!" and not depth and text[i + 1 : i + 2] != "=":
            upto(i)
            m = re.compile(r"!([rsa])(?=[:}])").match(text, i)
            if not m:
                return None
            pieces.append("!i")
            i = begin = m.end()
            continue
        elif c == ":" and not depth and not re.search(r"\blambda\b", text[begin:i]):
            upto(i)
            pieces.append(":")
            i += 1
            while i < n and text[i] != "}":
                if text[i] == "{":
                    got = field(text, i, quote, raw)
                    if got is None:
                        return None
                    i, piece = got
                    pieces.append(piece)
                elif text.startswith(quote, i) or text[i] == "\n" and len(quote) == 1:
                    return None
                else:
                    i += 1
            return (i + 1, "{" + "".join(pieces) + "}") if i < n else None
        elif c in "\"'" or c in "rRbBfFuU" and (m := re.compile(rf"{_PREFIX}(?:\"|')").match(text, i)) and (i == begin or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            m = OPENING.match(text, i)
            end = string_end(text, m)
            if end is None:
                return None
            i = end[0]
            continue
        elif c == "#" or c == "\n" and len(quote) == 1:
            return None
        i += 1
    return None


def string_end(text: str, m: re.Match) -> tuple[int, str] | None:
    """The end of the string that a match of its opening begins, and its tokens."""
    opening = m.group()
    quote = opening.lstrip("rRbBfFuU")
    prefix = opening[: -len(quote)].lower()
    if "f" in prefix:
        return fstring(text, m.end(), quote, "r" in prefix)
    body = BODY[quote].match(text, m.end())
    return (body.end(), "S") if body else None


def flat(text: str) -> str:
    """The token string of an expression within an f-string."""
    return tokens(text).replace("\n", "")


def _one(m: re.Match) -> str:
    k = m.lastindex
    if k == 3 or k == 6:
        return TABLE.words.get(m.group(), "i")
    if k == 2:
        return "B" if "b" in m.group()[:2].lower().partition('"')[0].partition("'")[0] else "S"
    if k == 4:
        return "n"
    if k == 1:
        return " "
    return BAD


F_HINT = re.compile(r"[fF][rR]?[\"']")


def tokens(text: str) -> str:
    """The token string with line ends and blanks as they are; comments are gone, strings are one character."""
    if not F_HINT.search(text):
        out = LEX.sub(_one, text)
    else:
        pieces, at, look = [], 0, 0
        while m := SPECIAL.search(text, look):
            look = m.end()
            if m.lastindex != 1:
                continue
            end = string_end(text, m)
            if end is None:
                pieces += [LEX.sub(_one, text[at : m.start()]), BAD]
                at = len(text)
                break
            look = end[0]
            if end[1] != "S":
                pieces += [LEX.sub(_one, text[at : m.start()]), end[1]]
                at = look
        pieces.append(LEX.sub(_one, text[at:]))
        out = "".join(pieces)
    return TABLE.operator.sub(lambda m: TABLE.ops[m.group()], out)


def logical_lines(flat_text: str) -> list[tuple[str, str]] | None:
    """(indent, tokens) of each logical line that isn't blank; None if brackets don't match."""
    if BAD in flat_text or '"' in flat_text or "'" in flat_text:
        return None
    lines = flat_text.split("\n")
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        body = line.lstrip(" \t\f")
        if not body.strip():
            continue
        indent = line[: len(line) - len(body)]
        # FSTRING fields hold balanced braces, so counts tell whether a bracket is open.
        opened = body.count("(") + body.count("[") + body.count("{")
        if opened and opened > body.count(")") + body.count("]") + body.count("}"):
            depth = opened - body.count(")") - body.count("]") - body.count("}")
            parts = [body]
            while depth > 0:
                if i >= len(lines):
                    return None
                more = lines[i]
                i += 1
                depth += more.count("(") + more.count("[") + more.count("{") - more.count(")") - more.count("]") - more.count("}")
                parts.append(more)
            body = "".join(parts)
        body = body.replace(" ", "")
        out.append((indent, body.replace("\t", "").replace("\f", "") if "\t" in body or "\f" in body else body))
    return out


def line_kind(line: str) -> str:
    """The character of a logical line (with b if its body is on it); BAD if it doesn't parse."""
    k = _lines.get(line)
    if k is None:
        k = BAD
        if LINES.parse("line", line) >= 0:
            k = "s"
            for rule, c in HEADERS:
                if LINES.parse(rule, line) >= 0:
                    k = c if line.endswith(":") or c == "@" else c + "b"
                    break
        if len(_lines) >= MOST:
            _lines.clear()
        _lines[line] = k
    return k


def structure(lines: list[tuple[str, str]]) -> tuple[str, int]:
    """The line kinds with indents and dedents, and the number of the first line that fails, or -1."""
    out: list[str] = []
    stack = [(0, 0)]
    for n, (indent, line) in enumerate(lines):
        if indent != "":
            indent = indent.rpartition("\f")[2]
        if "\t" in indent:
            col = alt = 0
            for ch in indent:
                col = (col // 8 + 1) * 8 if ch == "\t" else col + 1
                alt += 1
        else:
            col = alt = len(indent)
        top = stack[-1]
        if col == top[0]:
            if alt != top[1]:
                return "", n
        elif col > top[0]:
            if alt <= top[1]:
                return "", n
            stack.append((col, alt))
            out.append(">")
        else:
            while col < stack[-1][0]:
                stack.pop()
                out.append("<")
            if (col, alt) != stack[-1]:
                return "", n
        k = line_kind(line)
        if k == BAD:
            return "", n
        out.append(k)
    out.append("<" * (len(stack) - 1))
    return "".join(out), -1


def valid_structure(kinds: str) -> bool:
    """Items of the file's margin are parsed one by one, and remembered."""
    depth, begin = 0, 0
    items = []
    for m in re.finditer(r"[<>]", kinds):
        if m.group() == ">":
            depth += 1
        else:
            depth -= 1
            if depth == 0 and kinds[m.end() : m.end() + 1] not in ("L", "E", "X", "Y"):
                items.append(kinds[begin : m.end()])
                begin = m.end()
    items.append(kinds[begin:])
    for item in items:
        if not item:
            continue
        ok = _items.get(item)
        if ok is None:
            ok = STRUCTURE.parse("item", item) >= 0
            if len(_items) >= MOST:
                _items.clear()
            _items[item] = ok
        if not ok:
            return False
    return True


def valid(text: str) -> bool:
    if "\0" in text:
        return False
    text = text.removeprefix("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = logical_lines(tokens(text))
    if lines is None:
        return False
    kinds, bad = structure(lines)
    return bad < 0 and valid_structure(kinds)
