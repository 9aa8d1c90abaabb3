"""A compiler of parsing-expression grammars to Python functions with a packrat memo.

The input is a string of one character per token. A grammar is text, a rule a line (continued by indented lines)::

    name <- 'lit' other* (a / b)? &c !d SET

Quoted literals are looked up in the language's table of token characters. Capital names are builtins: ``EOF``, ``NL`` (a line end comes
next), ``ANY``, sets of characters given by the language, or kinds of braces: a reduced pair of braces is one character that tells as
what its content can be parsed. A rule marked by ``~`` isn't memoised. Line ends are skipped before a token if the language says so.
"""

from __future__ import annotations

import re

BRACES = 0xF0000
END = "\0"
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|([/*+?&!()]))")


class Grammar:
    """Compiled rules: ``parse(rule, text)`` gives the end, or -1; ``far`` then is the furthest failure of ``trace``."""

    def __init__(self, text: str, tokens: dict[str, str], sets: dict[str, str], kinds: dict[str, str], skip_lines: bool = False):
        self.tokens, self.kinds, self.skip = tokens, {k: i for i, k in enumerate(kinds)}, skip_lines
        self.sets = {k: frozenset(v) for k, v in sets.items()}
        self.rules: dict[str, tuple[bool, tuple]] = {}
        for line in re.sub(r"\n[ \t]+", " ", text.strip()).split("\n"):
            line = line.split(" ## ")[0].strip()
            if not line:
                continue
            name, body = line.split("<-", 1)
            memo = not name.startswith("~")
            self.rules[name.strip(" ~")] = (memo, self._read(body))
        self.fast, self.slow = self._compile(False), self._compile(True)
        self.far = 0

    # Reading the notation

    def _read(self, body: str) -> tuple:
        toks, at = [], 0
        body = body.strip()
        while at < len(body):
            m = _TOKEN.match(body, at)
            if not m:
                raise ValueError(f"can't read {body[at:]!r}")
            toks.append(m.group().strip())
            at = m.end()
        self._t, self._i = toks, 0
        node = self._choice()
        if self._i != len(toks):
            raise ValueError(f"left over in {body!r}: {toks[self._i:]}")
        return node

    def _peek(self) -> str:
        return self._t[self._i] if self._i < len(self._t) else ""

    def _choice(self) -> tuple:
        alts = [self._seq()]
        while self._peek() == "/":
            self._i += 1
            alts.append(self._seq())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def _seq(self) -> tuple:
        items = []
        while self._peek() not in ("", "/", ")"):
            items.append(self._item())
        return items[0] if len(items) == 1 else ("seq", items)

    def _item(self) -> tuple:
        t = self._peek()
        if t in ("&", "!"):
            self._i += 1
            return ("and" if t == "&" else "not", self._item())
        self._i += 1
        if t == "(":
            node = self._choice()
            if self._peek() != ")":
                raise ValueError("no )")
            self._i += 1
        elif t.startswith("'"):
            lit = t[1:-1].replace("\\'", "'").replace("\\\\", "\\")
            node = ("chars", frozenset(self.tokens.get(lit, lit)))
            if len(self.tokens.get(lit, lit)) != 1:
                raise ValueError(f"{lit!r} is no token")
        else:
            node = ("ref", t)
        while self._peek() in ("*", "+", "?") and self._peek():
            node = ({"*": "star", "+": "plus", "?": "opt"}[self._peek()], node)
            self._i += 1
        return node

    # Writing Python

    def _merge(self, node: tuple) -> tuple:
        """Choices between single tokens become one set."""
        if node[0] == "alt":
            alts = [self._merge(n) for n in node[1]]
            out: list[tuple] = []
            for n in alts:
                if n[0] == "ref" and n[1] in self.sets:
                    n = ("chars", self.sets[n[1]])
                if out and out[-1][0] == "chars" and n[0] == "chars":
                    out[-1] = ("chars", out[-1][1] | n[1])
                else:
                    out.append(n)
            return out[0] if len(out) == 1 else ("alt", out)
        if node[0] == "seq":
            return ("seq", [self._merge(n) for n in node[1]])
        if node[0] in ("star", "plus", "opt", "and", "not"):
            return (node[0], self._merge(node[1]))
        return node

    def _emit(self, node: tuple, pad: str, out: list[str], names: dict, far: bool) -> None:
        kind = node[0]
        fail = f"{pad}else:\n{pad} if p > m[-1]: m[-1] = p\n{pad} p = -1" if far else f"{pad}else: p = -1"
        skip = f"{pad}while s[p] == '\\n': p += 1" if self.skip else None

        def test(cond: str, step: bool = True) -> None:
            if skip:
                out.append(skip)
            out.append(f"{pad}if {cond}: p += {int(step)}")
            out.append(fail)

        if kind == "chars":
            chars = node[1]
            if len(chars) == 1:
                test(f"s[p] == {next(iter(chars))!r}")
            else:
                test(f"s[p] in {names.setdefault(chars, f'c{len(names)}')}")
        elif kind == "ref":
            name = node[1]
            if name == "EOF":
                test(f"s[p] == {END!r}", False)
            elif name == "NL":
                out.append(f"{pad}if s[p] != '\\n': p = -1")
            elif name == "ANY":
                test(f"s[p] != {END!r}")
            elif name in self.sets:
                test(f"s[p] in {names.setdefault(self.sets[name], f'c{len(names)}')}")
            elif name in self.kinds:
                test(f"s[p] >= {chr(BRACES)!r} and ord(s[p]) & {1 << self.kinds[name]}")
            elif name in self.rules:
                out.append(f"{pad}p = r_{name}(s, p, m)")
            else:
                raise ValueError(f"no rule {name}")
        elif kind == "seq":
            for i, n in enumerate(node[1]):
                self._emit(n, pad, out, names, far)
                if i + 1 < len(node[1]):
                    out.append(f"{pad}if p >= 0:")
                    pad += " "
        elif kind == "alt":
            self.n += 1
            q = f"q{self.n}"
            out.append(f"{pad}{q} = p")
            for i, n in enumerate(node[1]):
                self._emit(n, pad, out, names, far)
                if i + 1 < len(node[1]):
                    out.append(f"{pad}if p < 0:\n{pad} p = {q}")
                    pad += " "
        elif kind in ("star", "plus"):
            self.n += 1
            q = f"q{self.n}"
            if kind == "plus":
                self._emit(node[1], pad, out, names, far)
                out.append(f"{pad}if p >= 0:")
                pad += " "
            out.append(f"{pad}while True:\n{pad} {q} = p")
            self._emit(node[1], pad + " ", out, names, far)
            out.append(f"{pad} if p < 0 or p == {q}:\n{pad}  p = {q}\n{pad}  break")
        elif kind == "opt":
            self.n += 1
            q = f"q{self.n}"
            out.append(f"{pad}{q} = p")
            self._emit(node[1], pad, out, names, far)
            out.append(f"{pad}if p < 0: p = {q}")
        else:
            self.n += 1
            q = f"q{self.n}"
            out.append(f"{pad}{q} = p")
            self._emit(node[1], pad, out, names, False)
            out.append(f"{pad}p = {q} if p {'>=' if kind == 'and' else '<'} 0 else -1")

    def _compile(self, far: bool) -> dict:
        out: list[str] = []
        names: dict[frozenset, str] = {}
        for k, (name, (memo, node)) in enumerate(self.rules.items()):
            self.n = 0
            out.append(f"def r_{name}(s, p, m):")
            if memo:
                out.append(f" k = p * 512 + {k}\n v = m.get(k)\n if v is not None: return v")
            self._emit(self._merge(node), " ", out, names, far)
            out.append(" m[k] = p\n return p" if memo else " return p")
        space: dict = {v: k for k, v in names.items()}
        exec("\n".join(out), space)  # noqa: S102 (the text is generated above from the grammar alone)
        return space

    def parse(self, rule: str, text: str) -> int:
        """The end of the longest match of the rule at the start, or -1."""
        return self.fast[f"r_{rule}"](text + END, 0, {})

    def trace(self, rule: str, text: str) -> int:
        """The furthest position at which a token was missed."""
        m = {-1: 0}
        self.slow[f"r_{rule}"](text + END, 0, m)
        return m[-1]
