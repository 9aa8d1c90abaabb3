"""From source text to one character per token, and from nested braces to single characters."""

from __future__ import annotations

import re

from auditlake.llm.syntax.peg import BRACES, Grammar

PUA = 0xE000
BAD = "\x01"  # what is no token


class Table:
    """The token characters of a language: i word, n number, S string, one private character for each keyword and long operator."""

    def __init__(self, keywords: list[str], operators: list[str]):
        self.words = {k: chr(PUA + i) for i, k in enumerate(keywords)}
        self.ops = {o: chr(PUA + 0x200 + i) for i, o in enumerate(sorted(operators, key=len, reverse=True))}
        self.tokens = {**self.words, **self.ops}
        self.operator = re.compile("|".join(map(re.escape, self.ops)))
        self.any_word = "i" + "".join(self.words.values())

    def set_of(self, *words: str) -> str:
        return "".join(self.tokens.get(w, w) for w in words)


class Braced:
    """A language whose blocks are in braces.

    ``kinds`` maps each kind of brace content to its rule. Innermost braces are reduced first, to a character that tells as what they
    can be parsed; results are kept by content, so that what recurs, in this file or another, is parsed once.
    """

    MOST = 400_000
    INNER = re.compile(r"\{([^{}]*)\}")

    def __init__(self, grammar: Grammar, kinds: dict[str, str], top: str):
        self.grammar, self.kinds, self.top = grammar, kinds, top
        self.known: dict[str, str] = {}
        self.items: dict[str, bool] = {}

    def brace(self, content: str) -> str:
        """The character of a brace content without inner braces."""
        c = self.known.get(content)
        if c is None:
            mask = 0
            for i, rule in enumerate(self.kinds.values()):
                if self.grammar.parse(rule, content) >= 0:
                    mask |= 1 << i
            c = chr(BRACES + mask)
            if len(self.known) >= self.MOST:
                self.known.clear()
            self.known[content] = c
        return c

    def reduced(self, text: str) -> str:
        """The text with balanced braces reduced; BAD where a content can't be parsed at all."""
        sub = self.INNER.subn
        known = self.known.get
        slow = self.brace

        def one(m: re.Match) -> str:
            c = m.group(1)
            return known(c) or slow(c)

        n = 1
        while n:
            text, n = sub(one, text)
        return text

    def whole(self, rule: str, text: str) -> bool:
        ok = self.items.get(text)
        if ok is None:
            ok = self.grammar.parse(rule, text) >= 0
            if len(self.items) >= self.MOST:
                self.items.clear()
            self.items[text] = ok
        return ok


def furthest(lang: Braced, text: str, at: list[int], top: str) -> int:
    """The source offset of the furthest failure in a token string; ``at`` has each token's offset.

    Innermost braces that fit no kind come first in the order of their end; otherwise the top level fails.
    """
    at = [*at, at[-1] + 1 if at else 0]
    # What is open, outermost first: its characters, and where each comes from. Every character is moved once.
    open_: list[tuple[list[str], list[int]]] = [([], [])]
    for i, c in enumerate(text):
        if c == "{":
            open_.append(([], []))
        elif c == "}" and len(open_) > 1:
            chars, where = open_.pop()
            content = "".join(chars)
            c = lang.brace(content)
            if c == chr(BRACES):
                best = max(lang.grammar.trace(rule, content) for rule in lang.kinds.values())
                return at[[*where, i][min(best, len(where))]]
            first = where[0] - 1 if where else i - 1
            open_[-1][0].append(c)
            open_[-1][1].append(first)
        else:
            open_[-1][0].append(c)
            open_[-1][1].append(i)
    chars, where = open_[0]
    for more, from_ in open_[1:]:
        where = [*where, from_[0] - 1 if from_ else len(text) - 1, *from_]
        chars = [*chars, "{", *more]
    return at[[*where, len(text)][min(lang.grammar.trace(top, "".join(chars)), len(where))]]


def merged(table: Table, chars: list[str], at: list[int]) -> tuple[str, list[int]]:
    """Long operators as one token, blanks dropped; the offsets follow."""
    s = "".join(chars)
    out, where, last = [], [], 0
    for m in table.operator.finditer(s):
        out.append(s[last : m.start()] + table.ops[m.group()])
        where += at[last : m.start() + 1]
        last = m.end()
    s, where = "".join(out) + s[last:], where + at[last:]
    keep = [i for i, c in enumerate(s) if c != " "]
    return "".join(s[i] for i in keep), [where[i] for i in keep]


def replaced(pattern: re.Pattern, to: str, s: str, at: list[int]) -> tuple[str, list[int]]:
    """``pattern.sub(to, s)`` for matches of one character; the offsets follow."""
    spots = [m.start() for m in pattern.finditer(s)]
    for i in reversed(spots):
        s = s[:i] + to + s[i + 1 :]
        at[i : i + 1] = [at[i]] * len(to)
    return s, at
