"""Garbled text from wrong decoding: found and given back.

For every pair (right encoding, wrong encoding) the garbled form of each character of the pair's alphabet is made by rule: the
character's bytes under the right encoding, decoded by the wrong one. One automaton holds all of these sequences. A text is scanned
once; adjacent matches of one pair form a span, and only accepted spans are replaced, so correct text beside them stays as it is. A
text garbled several times is scanned again until nothing changes.

Two-byte wrong encodings (GBK, Shift-JIS, Big5, EUC-KR read over UTF-8) don't keep character limits, so no list of sequences can hold
them all; there a set has the characters that a garbled character can begin with, and a run with enough of them is a span if it decodes.
Legacy bytes read by another legacy encoding, and Western ones, have sequences of one character, which prove nothing alone; they are
judged by run and line. A span is accepted by its evidence: one sequence that
contains no letter pair of correct text is enough, a sequence that correct text may hold (a capital before a quote mark, say) needs a
neighbour. A span that stands alone within quote marks, is quoted on purpose and no case. A replacement sign within a word is a
finding whose text can't be recovered; one that stands alone is not.

Defined results: null, empty and blank texts are no cases; rows come back as they were, one per input row; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# Names of encodings.
SINGLE = [["cp1252", "latin-1", "iso8859-15", "cp1254"], ["mac_roman"], ["cp437", "cp850"], ["cp1251"], ["cp866"], ["koi8-r"], ["cp1250"], ["cp1253"]]
DOUBLE = ["gb18030", "cp932", "big5", "euc_kr"]
#: (right, wrong) of legacy bytes read by another legacy encoding: no lead bytes as in UTF-8, so runs are judged as a whole.
LEGACY = [("gb18030", "latin-1"), ("gb18030", "cp1252"), ("cp932", "latin-1"), ("cp932", "cp1252"), ("euc_jp", "latin-1"), ("big5", "latin-1"), ("euc_kr", "latin-1"), ("cp1251", "latin-1"), ("cp1251", "cp1252"), ("koi8-r", "latin-1"), ("koi8-r", "cp1252"), ("cp866", "latin-1"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "mac_roman"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("gb18030", "mac_roman"), ("gb18030", "cp1251"), ("cp932", "mac_roman"), ("gb18030", "cp437"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1250", "cp1252")]
OPEN, CLOSE = "“‘'\"`«»„‚‹›「『(", "”’'\"`»«“‘›‹」』)"


def _decode_1(data: bytes, wrong: str) -> str | None:
    """Decoding that lets a byte without a character through as the control of that number, as browsers do."""
    try:
        return data.decode(wrong)
    except UnicodeDecodeError:
        if wrong not in ("cp1252", "cp1250", "cp1254", "cp1253", "cp1251"):
            return None
    return "".join(c if (c := bytes([b]).decode(wrong, "ignore")) else chr(b) for b in data)


def _encode_1(text: str, wrong: str) -> bytes | None:
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(wrong)
        except UnicodeEncodeError:
            if ord(ch) < 256:
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _alphabet() -> list[str]:
    """Characters that texts hold, by block; the garbled sequences are made for all of them."""
    blocks = [(0x80, 0x250), (0x2B0, 0x2DD), (0x300, 0x370), (0x370, 0x400), (0x400, 0x460), (0x490, 0x492), (0x531, 0x58B), (0x5D0, 0x5EB), (0x621, 0x64B), (0x6CC, 0x6CD), (0x900, 0xE00), (0xE01, 0xE5C), (0xE80, 0xEE0), (0x10A0, 0x1100), (0x1E00, 0x1F00), (0x2010, 0x2070), (0x20A0, 0x20C0), (0x2100, 0x2140), (0x2150, 0x2300), (0x2460, 0x2474), (0x2500, 0x2580), (0x25A0, 0x2800), (0x3000, 0x3100), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0xFB00, 0xFB05), (0xFE0F, 0xFE10), (0xFF01, 0xFFEF), (0x1F300, 0x1F700), (0x1F900, 0x1FA00)]
    return [chr(c) for a, b in blocks for c in range(a, b)]


#: Sequences of nothing but Russian letters can't be told from words; see _more_than_words().
CYRILLIC = re.compile("[а-яА-ЯёЁ]+")


class Automaton:
    """The sequences of all pairs, by family of wrong encodings, and how spans of them are judged."""

    def __init__(self) -> None:
        alphabet = _alphabet()
        self.groups = []
        for g, family in enumerate(SINGLE):
            auto, seen = ahocorasick.Automaton(), {}
            for ch in alphabet:
                data = ch.encode("utf-8")
                for wrong in family:
                    bad = _decode_1(data, wrong)
                    if bad and bad != ch and "�" not in bad and not (len(bad) < 3 and wrong in ("cp866", "koi8-r") and CYRILLIC.fullmatch(bad)):
                        seen.setdefault(bad, (len(bad), ch, wrong))
            if not g:  # accented Latin letters of the double-byte encodings
                for ch in "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜüê":
                    seen.setdefault(ch.encode("gbk").decode("latin-1"), (2, ch, "gbk"))
            for bad, v in seen.items():
                auto.add_word(bad, v)
            auto.make_automaton()
            self.groups.append(auto)
        self.double = {w: self._beginnings(w) for w in DOUBLE}

    @staticmethod
    def _beginnings(wrong: str) -> set[str]:
        """The first garbled character of a UTF-8 character whose first two bytes it swallows."""
        out = set()
        for lead in range(0xC3, 0xF0):
            for b in range(0x80, 0xC0):
                try:
                    ch = bytes([lead, b]).decode(wrong)
                except UnicodeDecodeError:
                    continue
                if len(ch) == 1:
                    out.add(ch)
        return out


_auto: list[Automaton] = []
#: Runs of characters that single-byte encodings hold beyond ASCII; a sequence has two or more.
SEQUENCES = re.compile("[" + re.escape("".join(sorted({c for family in SINGLE for w in family for b in range(128, 256) for c in bytes([b]).decode(w, "ignore")} | {chr(c) for c in range(0x80, 0x100)}))) + "]{2,}")
#: A run as double-byte decoding leaves it: beside the characters, ASCII that swallowed bytes may stand for nothing.
QUOTE_LIKE = set("»«\u00a0´¨°ºª®©™’‘“”„‚…–—")


def automaton() -> Automaton:
    if not _auto:
        _auto.append(Automaton())
    return _auto[0]


def quoted(text: str, a: int, b: int) -> bool:
    """text[a:b] stands alone within quote marks."""
    return a > 0 and b < len(text) and text[a - 1] in OPEN and text[b] in CLOSE


def _plain(ch: str) -> bool:
    """A character that the texts' languages use."""
    o = ord(ch)
    return ch.isalnum() and not 0xE000 <= o < 0xF900 or unicodedata.category(ch)[0] in "PZS" and not 0x80 <= o < 0xA0


def _weak(bad: str, ch: str, wrong: str, text: str, a: int, b: int) -> bool:
    """A lone sequence that correct text may hold as well."""
    first, rest = bad[0], bad[1:]
    before, after = text[a - 1] if a else " ", text[b] if b < len(text) else " "
    if 0x80 <= ord(ch) < 0xA0:
        return True
    if wrong == "gbk":
        return not (before.isascii() and before.isalpha() or after.isascii() and after.isalpha())
    if wrong in ("cp1251", "cp866", "koi8-r") and len(bad) == 2:
        if CYRILLIC.match(ch):
            return True  # one Cyrillic letter with its neighbour
        return ch.isalpha() and not (before.isascii() and before.isalpha() or after.isascii() and after.isalpha())
    if wrong == "mac_roman" and first == "–":
        return True
    if first.isalpha() and first.isupper() and all(c in QUOTE_LIKE for c in rest):
        return before.isalpha() and before.isupper() and not after.islower() or first not in "ÃÂâÎÏ" and before.isspace()
    return False


def _drawing(text: str, b: int, e: int, fixed: str) -> bool:
    """Box characters that stand neither at a letter nor for a word, as in a tree or table."""
    if not all(0x2500 <= ord(c) < 0x25A0 for c in text[b:e]):
        return False
    at_letter = b and text[b - 1].isalpha() or e < len(text) and text[e].isalpha()
    return not (fixed.isalpha() and (at_letter or len(fixed) >= 3))


def _more_than_words(run: str, hits: list[tuple[int, int, str, str]]) -> bool:
    """Sequences of nothing but Russian letters count beside one of three characters that holds others, in a case that no word has, or as an emoji's beginning."""
    words = [h for h in hits if h[3] == "cp866" and CYRILLIC.fullmatch(run[h[0] : h[1]])]
    if not words or any(h[1] - h[0] == 3 and h not in words for h in hits):
        return True
    return all(run.startswith("ЁЯ", h[0]) and h[1] - h[0] == 4 for h in words) or len(words) >= 2 and _odd_case(run[hits[0][0] : hits[-1][1]])


def _single_spans(text: str, a: Automaton) -> list[tuple[int, int, str]]:
    """(begin, end, right text) of the accepted spans of single-byte wrong encodings; each run goes to the family that explains most of it."""
    strong: list[tuple[int, int, str]] = []
    weak: list[tuple[int, int, str, str]] = []
    sure: set[str] = set()
    for m in SEQUENCES.finditer(text):
        run, best = m.group(), (0, [])
        for auto in a.groups:
            hits = [(end + 1 - v[0], end + 1, v[1], v[2]) for end, v in auto.iter_long(run)]
            cover = sum(h[1] - h[0] for h in hits)
            if cover > best[0]:
                best = (cover, hits)
        spans: list[list] = []
        for h in best[1]:
            if spans and spans[-1][-1][1] == h[0]:
                spans[-1].append(h)
            else:
                spans.append([h])
        for s in spans:
            if not _more_than_words(run, s):
                continue
            b, e = m.start() + s[0][0], m.start() + s[-1][1]
            fixed = "".join(h[2] for h in s)
            if quoted(text, b, e) or _drawing(text, b, e, fixed):
                continue
            if len(s) == 1 and _weak(text[b:e], s[0][2], s[0][3], text, b, e):
                weak.append((b, e, fixed, s[0][3]))
            elif len(s) == 1 or all(_plain(c) or unicodedata.category(c) in ("Mn", "Mc", "Cf", "So") or 0x80 <= ord(c) < 0xA0 for c in fixed):
                strong.append((b, e, fixed))
                sure.update(h[3] for h in s)
    return strong + [(b, e, f) for b, e, f, w in weak if w in sure]


def _common() -> frozenset[str]:
    """Han characters of the first levels of GB2312 and JIS, kana, and the marks beside them."""
    out = {chr(o) for a, b in ((0x3000, 0x3100), (0xFF01, 0xFF61), (0x2010, 0x2040)) for o in range(a, b)}
    for o in range(0x4E00, 0xA000):
        c = chr(o)
        for name, first, last in (("gb2312", 0xB0, 0xD7), ("shift_jis", 0x88, 0x97)):
            if (data := c.encode(name, "ignore")) and first <= data[0] <= last:
                out.add(c)
    return frozenset(out)


COMMON = _common()


def _common_han(text: str) -> bool:
    """Every character is a common one; enough to tell text from chance."""
    return COMMON.issuperset(text)


def _utf8_best(data: bytes) -> tuple[str, int]:
    """data as UTF-8 with a sign for each lost character, and the number of whole characters beyond ASCII."""
    s = data.decode("utf-8", "replace")
    return s, sum(c > "\x7f" and c != "�" for c in s)


def _double_spans(text: str, a: Automaton) -> list[tuple[int, int, str]]:
    out = []
    for m in re.finditer(r"[^\x00-\x7f]+(?:[^\x00-\x7f]|[?])*", text):
        run = m.group()
        if len(run) < 2 or COMMON.issuperset(run) or len(run.replace("�", "").replace("?", "")) < 2 or run[0] in OPEN and run[-1] in CLOSE or quoted(text, m.start(), m.end()):
            continue
        best = None
        for wrong, begin in a.double.items():
            if sum(c in begin for c in run) * 5 < len(run):
                continue
            try:
                data = run.replace("�", "\x00").encode(wrong).replace(b"\x00", b"\xff")
            except UnicodeEncodeError:
                continue
            s, good = _utf8_best(data)
            lost = s.count("�")
            if good and good >= 2 * max(0, lost - run.count("�") * 2) and good + lost < len(run) + 1 and all(_plain(c) for c in s if c not in "�?") and (good >= 2 or lost == 0):
                key = (good - lost, wrong == "gb18030")
                if best is None or key > best[0]:
                    best = (key, s)
        if best:
            out.append((m.start(), m.end(), best[1]))
    return out


CJK_RIGHT = ("gb18030", "cp932", "euc_jp", "big5", "euc_kr")


def _legacy_text(run: str, right: str, wrong: str) -> str | None:
    """run given back under one pair, if that gives common characters of one script."""
    data = _encode_1(run, wrong)
    if data is None:
        return None
    try:
        s = data.decode(right)
    except UnicodeDecodeError:
        return None
    if right in CJK_RIGHT:
        ok = len(s) < len(run) and (_common_han(s) or right == "euc_kr" and all(0xAC00 <= ord(c) < 0xD7A4 for c in s))
    else:
        ok = all(0x410 <= ord(c) < 0x452 for c in s) and sum(c >= "а" for c in s) >= len(s) - 1
    return s if ok else None


def _legacy_spans(text: str) -> list[tuple[int, int, str]]:
    """Legacy bytes read by another legacy encoding: a run of four characters or more that becomes common characters of one script; then
    the shorter runs of the same line under the same pair."""
    out = []
    for line in re.finditer(r"[^\n]*[^\x00-\x7f][^\n]*", text):
        runs = [(line.start() + m.start(), line.start() + m.end()) for m in LEGACY_RUN.finditer(line.group())]
        if not any(_shows(text[b:e]) for b, e in runs):
            continue
        found: dict[tuple[str, str], list[tuple[int, int, str, bool]]] = {}
        for b, e in runs:
            run = text[b:e]
            if _common_han(run) or quoted(text, b, e) or sum(0x2500 <= ord(c) < 0x25A0 for c in run) * 2 > len(run) or run[0] in OPEN and run[-1] in CLOSE:
                continue
            if any((data := _encode_1(run, w)) and _whole_utf8(data, w in ("cp1252", "latin-1")) for w in WRONG_SINGLE):
                continue
            was = sum(0x430 <= ord(c) < 0x450 or c == "ё" for c in run)
            for right, wrong in LEGACY:
                cyrillic = right not in CJK_RIGHT
                turned = wrong in ("koi8-r", "cp1251") and cyrillic
                if not turned and was * 3 >= len(run):
                    continue
                for end in (e, e + 1, e - 1):
                    if b < end <= line.end() and (s := _legacy_text(text[b:end], right, wrong)):
                        far = sum(c > "\x7f" for c in run)
                        shows = far >= 4 and len(s) >= (4 if cyrillic else 2) and (not turned or _odd_case(run))
                        found.setdefault((right, wrong), []).append((b, end, s, shows))
                        break
        # The pair that explains most of the line goes first; a pair needs a run long enough to show it.
        taken: list[tuple[int, int]] = []
        for hits in sorted(found.values(), key=lambda h: -sum(e - b for b, e, _, _ in h)):
            if any(shows and all(e <= x or b >= y for x, y in taken) for b, e, _, shows in hits):
                for b, e, s, _ in hits:
                    if all(e <= x or b >= y for x, y in taken):
                        out.append((b, e, s))
                        taken.append((b, e))
    return out


def _shows(run: str) -> bool:
    """A run that may be legacy bytes: some length beyond ASCII, neither common Han characters nor Russian words."""
    if sum(c > "\x7f" for c in run) < 4 or _common_han(run) or sum(0x2500 <= ord(c) < 0x25A0 for c in run) * 2 > len(run):
        return False
    return sum(0x430 <= ord(c) < 0x450 or c == "ё" for c in run) * 3 < len(run) or _odd_case(run)


WRONG_SINGLE = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8-r"]


def _whole_utf8(data: bytes, lossy: bool) -> bool:
    """data is UTF-8 beyond ASCII; or most of it, for the encodings that let every byte through."""
    try:
        return not data.decode("utf-8").isascii()
    except UnicodeDecodeError:
        s = data.decode("utf-8", "replace") if lossy else ""
        return lossy and sum(len(c.encode()) for c in s if c > "\x7f" and c != "�") * 5 >= len(data) * 4


def _odd_case(run: str) -> bool:
    """Cyrillic whose case is turned about, as one Cyrillic encoding read by another leaves it."""
    up = sum(c.isupper() for c in run[1:])
    return up >= 2 and not run.isupper() or not run.isalpha()


# Letters and marks of Western texts.
WESTERN = set("áàâãäåæçéèêëíìîïñóòôõöøœúùûüýßÁÀÂÃÄÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÕÖØŒÚÙÛÜ«»’‘“”–—…€°¿¡ºª·")
WESTERN_PAIRS = [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp437"), ("cp850", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp1253"), ("cp1252", "cp866")]


def _western_maps() -> list[dict[str, str]]:
    maps = []
    for right, wrong in WESTERN_PAIRS:
        m = {}
        for ch in sorted(WESTERN):
            try:
                bad = ch.encode(right).decode(wrong)
            except UnicodeError:
                continue
            if bad != ch:
                m[bad] = ch
        maps.append(m)
    return maps


WESTERN_MAPS = _western_maps()
NO_EVIDENCE = "’‘“”–—…·º°\u00a0\u00ad"
#: A small letter before a character that shows one of the pairs; lines without it are passed over.
SHOWN = re.compile("[a-z][" + re.escape("".join(sorted({c for m in WESTERN_MAPS for c, f in m.items() if f.islower() and not (c in WESTERN and c.islower()) and c not in NO_EVIDENCE}))) + "]")


def _western_spans(text: str) -> list[tuple[int, int, str]]:
    """Western bytes read by another encoding: shown by a character within a lower-case word that isn't a small letter of Western texts, and
    becomes one; the other characters of the line under the same pair follow."""
    out = []
    for line in re.finditer(r"[^\n]*[^\x00-\x7f][^\n]*", text):
        t, at = line.group(), line.start()
        if not SHOWN.search(t):
            continue
        odd = [(i, c) for i, c in enumerate(t) if c > "\x7f"]
        best = (0, None)
        for m in WESTERN_MAPS:
            shown = 0
            for i, c in odd:
                f = m.get(c)
                if f and f.islower() and not (c in WESTERN and c.islower()) and c not in NO_EVIDENCE and i and _small(t[i - 1]) and (i + 1 < len(t) and _small(t[i + 1]) or c.isalpha() and c not in WESTERN):
                    shown += 1
                elif c not in m and c.isalpha() and c in WESTERN and c.islower():
                    shown -= 1
            if shown > best[0]:
                best = (shown, m)
        if best[1]:
            out += [(at + i, at + i + 1, best[1][c]) for i, c in odd if c in best[1] and not quoted(t, i, i + 1)]
    return out


def _small(c: str) -> bool:
    return "a" <= c <= "z"


LEGACY_RUN = re.compile(r"[^\x00-\x7f](?:[^\x00-\x7f]|(?<=[^\x00-\x7f])[@-~](?=[^\x00-\x7f]))*")
#: One legacy character within a Latin word: é of a Western encoding read by another one.
LOST = re.compile(r"(?<=\w)�+(?=\w)|(?<=\w)�+|�+(?=\w)|��+")


def lost_signs(text: str) -> bool:
    """A replacement sign that took the place of a character within a word."""
    return any(not quoted(text, m.start(), m.end()) for m in LOST.finditer(text))


def repair(text: str) -> tuple[str, int, bool]:
    """The text with garbled spans given back, the number of spans, and whether signs of lost characters remain."""
    a = automaton()
    spans_all = 0
    seen = {text}
    while not text.isascii():
        spans: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []
        for more in (_legacy_spans, lambda t: _single_spans(t, a), lambda t: _double_spans(t, a), _western_spans):
            for b, e, s in more(text):
                if all(e <= x or b >= y for x, y in taken):
                    spans.append((b, e, s))
                    taken.append((b, e))
        if not spans:
            break
        spans_all += len(spans)
        out, at = [], 0
        for b, e, s in sorted(spans):
            out += [text[at:b], s]
            at = e
        text = "".join(out) + text[at:]
        if text in seen:
            break
        seen.add(text)
    return text, spans_all, lost_signs(text)


def find_garbled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_spans, has_lost, restored) of the rows with garbled text; ``restored`` has � for what can't be recovered."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, n, lost, texts = [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                fixed, k, signs = repair(text)
                if k or signs:
                    rows.append(r)
                    n.append(k)
                    lost.append(signs)
                    texts.append(fixed)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), pa.array(lost, pa.bool_()), pa.array(texts, pa.string())], names=[id_col, "n_spans", "has_lost", "restored"])

    far = docs.select(id_col, text_col).where(f"`{text_col}` rlike '[^\\\\x00-\\\\x7f]'")
    return far.mapInArrow(run, f"`{id_col}` {kind}, n_spans int, has_lost boolean, restored string")
