"""Credentials in source code: found, located by line, and masked.

A keyword automaton over the whole text gives the lines worth reading (its keywords cover every word that ends a secret's name, in any
case); only these are tried with the expressions: issuer formats,
private key blocks, URLs with a password, key parameters of URLs, authorization headers, assignments to names that end in a word for a
secret, and comments that tell one. A match is validated: issuer checks on structure (a JWT's header must decode to JSON with an
algorithm, Basic data must decode to user:password, a key block must have a body), and values that are empty, placeholders, masked,
references to the environment or a store, names, paths or hint texts are no credentials.

Tokens of issuers that add a CRC32 (in base 62) are certain if it fits; one that doesn't fit is judged like the others, since code also
holds tokens whose checksum nobody computed.

Masking keeps lengths, quotes, line ends and alphabets: an issuer's prefix stays and its body becomes x (X in capitals-only tokens), a
hexadecimal value becomes zeros, in others small letters become x, capitals X and digits 0; other characters stay.

Defined results: null and empty texts have no credential; a line ends at LF or CRLF; lines count from 1; several on a line are one row;
redelivered rows are one record. Only the named columns are read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import spread

# Keywords of the prefilter in any case, and as they are; issuer prefixes, and words of names.
KEYWORDS = ["pass", "pwd", "secret", "token", "_key", "-key", ".key", "apikey", " key", "accesskey", "privatekey", "auth", "cred", "login", "bearer", "basic ", "_pw", "-pw", "dsn", "?key=", "&key=", "sig=", "signature=", "curl ", "пароль"]
EXACT = ["://", "Basic", "Digest", "-----BEGIN", "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "xoxr-", "_live_", "_test_", "eyJ", "AIza", "npm_", "pypi-", "hf_", "SG.", "dop_v1_", "密码", "密钥", "口令", "令牌", "パスワード"]

ISSUER = re.compile(
    r"(?<![A-Za-z0-9_])(?:"
    r"A(?:KIA|SIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{36,}"
    r"|github_pat_[A-Za-z0-9_]{40,}"
    r"|glpat-[A-Za-z0-9_-]{20,}"
    r"|xox[abprs]-[0-9]{6,}-[A-Za-z0-9-]{16,}"
    r"|[a-z]{2}_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9])"
    r"|npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
    r"|pypi-[A-Za-z0-9_-]{50,}"
    r"|hf_[A-Za-z0-9]{30,}"
    r"|SG\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{30,}"
    r"|dop_v1_[0-9a-f]{64}"
    r"|eyJ[A-Za-z0-9_-]{8,}={0,2}\.eyJ[A-Za-z0-9_-]{8,}={0,2}\.[A-Za-z0-9_-]{16,}"
    r")"
)
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: A key block's line between line ends or escapes of them, with listing numbers, comment signs and quotes around it; and its last, perhaps short one.
PEM_BREAK = re.compile(r"\r?\n|\\[nr]")
_AROUND = r"\s*(?:\d+ \|)?[\s\"'`+,;.()#*>/]*?"
PEM_LINE = re.compile(_AROUND + r"([A-Za-z0-9+/]{16,}={0,2}|[A-Za-z-]+: [^\n\"'`;{}]*|)[\s\"'`+,;.()\\]*")
PEM_TAIL = re.compile(_AROUND + r"([A-Za-z0-9+/]{4,}={0,2})(?=[\"'`]|\s*$|-----END)")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s/:@\"'`<>]*):([^\s/@\"'`<>]+|[^\s@\"'`<>]+?)@(?=[A-Za-z0-9_.\-\[])")
PARAMETER = re.compile(r"[?&](?:api[_-]?key|apikey|key|access[_-]?token|auth[_-]?token|token|sig|signature|secret|client[_-]?secret|password|passwd|pwd|auth)=([^\s&#\"'`<>]{8,})", re.I)
HEADER = re.compile(r"\b(?:(Basic)|Bearer|token|Token|ApiKey|Digest)\s+([A-Za-z0-9+/=_.~%-]{12,})")
HEADER_NEAR = re.compile(r"auth|header", re.I)
STRING = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
NAME = r"[A-Za-z_$][\w$.\-]*"
#: name, quoted or not, an optional type, an operator and a string (or strings joined by +), perhaps on the next line.
ASSIGNED = re.compile(
    rf"(?P<q>[\"'`]?)(?P<name>{NAME})(?P=q)\]?\s*(?::\s*[A-Za-z][\w.\[\]| ]*?\s*=|\?:\s*[A-Za-z]+\s*=|:?=>?|:|,|==)\s*(?:\(\s*)?[rbuf]?(?P<value>(?:{STRING})(?:\s*\+?\s*(?:{STRING}))*)"
)
STRING_RE = re.compile(STRING)
#: "password=" + "value".
DSN_SPLIT = re.compile(r"([A-Za-z_]+)=[\"'`]\s*\+\s*[\"'`]((?:[^\"'`\s;&]|&(?![\w.\-]+=))+)[\"'`;&]")
#: name=value without quotes, in a comment, a connection string or a configuration file.
BARE = re.compile(rf"(?<![\w$.\-])(?P<name>{NAME})\s?(?:=|:)\s?(?P<value>(?:[^\s\"'`;,&<>(){{}}\[\]]|&(?![\w.\-]+=))+)")
BARE_LINE = re.compile(rf"^\s*(?:\d+ \| *)?(?:export\s+|ENV\s+|ARG\s+|set\s+|-\s+)?(?P<name>{NAME})\s*[=: ]\s*(?P<value>\S.*?)\s*$")
COMMENT = re.compile(r"^\s*(?:\d+ \| ?\s*)?(?:#|//|/?\*+|--|;|<!--)")
TOLD = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api.?key|credentials?|login|access.?key|private.?key)\b|密码|密钥|口令|令牌|パスワード|пароль")
#: The user and password of a command line, and a password that follows its word without blanks between the words of the language.
USER = re.compile(r"\bcurl\b.*?\s(?:-u|--user)[ =]?[\"']?([^\s:\"'`$]+):([^\s\"'`]+)")
TOLD_HAN = re.compile(r"(?:密码|密钥|口令|令牌|パスワード|пароль)\s*(?:是|为|は)?\s*[:：=]?\s*([!-~]{6,})", re.I)
TOLD_VALUE = re.compile(r"[^\s\"'`,;()<>:]{8,}")
CONFIG = re.compile(r"(?i)\.(?:env|ini|properties|ya?ml|toml|cfg|conf|cnf|tf|tfvars|staging|production|local|dev|prod|txt|sh|bash)$|(?:^|[/\\])(?:dockerfile|\.env)[^/\\]*$|(?:^|[/\\])\.(?:env|npmrc|netrc|pgpass)[^/\\]*$")

SETTING = re.compile(r"(?m)^[^\S\n]*(?:\d+ \| ?)?(?:(?:export |ENV |ARG |- )?[A-Za-z_][\w.\-]*\s?[=:][^(){};\n]*|[#;\[{}][^\n]*|\"[\w.\-]+\": [^\n]*|FROM \S+|[A-Z]+ [^(){};\n]*)$")
BLANK = re.compile(r"(?m)^\s*$")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
LAST = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "secret", "token", "pw", "apikey", "secretkey", "accesskey", "privatekey", "credential", "credentials", "auth", "psk", "pin", "jwt", "bearer", "userpass", "dbpass", "authtoken", "secrets"}
KEY_OF = {"api", "secret", "private", "access", "encryption", "signing", "deploy", "service", "hmac", "account", "auth", "master", "storage", "ssh", "session", "webhook", "client", "shared", "license", "crypt", "crypto", "encrypt", "decrypt", "cipher", "aes", "rsa", "jwt", "admin", "root", "publishable", "subscription", "app", "application", "consumer", "security", "wallet", "signature", "sign", "integration", "write", "server"}
PASSWORDS = {"password", "passwd", "pwd", "pass", "passphrase", "passcode", "pw", "userpass", "dbpass"}
#: Widely known weak passwords.
WEAK = {"letmein", "admin", "qwerty", "welcome", "iloveyou", "monkey", "dragon", "sunshine", "princess", "football", "baseball", "master", "shadow", "superman", "trustno"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHECKED = re.compile(r"(?:gh[pousr]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})")
#: Prefixes that a mask keeps, and the rest of their tokens.
PREFIXED = re.compile(r"(A(?:KIA|SIA)|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[a-z]{2}_(?:live|test)_|AIza|npm_|pypi-|hf_|SG\.|dop_v1_)([A-Za-z0-9_.\-]+)")
HEX = re.compile(r"(?<![A-Za-z0-9])(?:0x)?(?=[0-9a-fA-F]*[0-9])([0-9a-fA-F]{8,})(?![A-Za-z0-9])")
CALLS = re.compile(r"(?i)getenv|environ|process\.env|vault|secretmanager|keyring|keychain|os\.get|config\.|settings\.|getProperty|ssm|kms")
PLACEHOLDER = re.compile(
    r"(?i)^(?:$|<.*|.*>$|\{\{.*|\$\{?[A-Za-z_(].*|%\w+%?$|%\(.*|@\w+@$|#\{.*|\[.*\]$|(.)\1*$|\*+.*|.*\*{4,}.*|x{3,}.*|.*x{6,}.*|\.{3,}|.*\.\.\.$|…+"
    r"|.*(?:change.?me|change.?it|replace.?(?:me|this|with)|place.?holder|example|sample.?(?:key|token|pass)|redacted|your[-_ ]|my[-_](?:secret|password|token|key)|not.?(?:a.?)?real|_here|-here|goes.?here|undefined|from.?vault|dev.?only).*"
    r"|(?:.*[^a-z])?(?:insert|dummy|fake|masked|removed|todo|fixme|tbd|null|none|n/a)(?:[^a-z].*)?"
    r"|(?:file|vault|env|ref|secret|arn|ssm|kms|sops|op|keychain|aws|gcp|azure)[:/].*|\./.*|~/.*|[A-Za-z]:\\.*|https?://[^@]*|true|false|yes|no|on|off)$"
)
PATH = re.compile(r"/(?:[a-z0-9_.-]+/)*[a-z0-9_.-]*$")
NAMELIKE = re.compile(r"^[A-Za-z]+(?:[-_./ ][A-Za-z]+)*[:=]?$")
VOCABULARY = {"password", "passwd", "pwd", "pass", "secret", "token", "key", "api", "access", "auth", "authorization", "bearer", "basic", "private", "public", "id", "name", "x", "type", "header", "field", "client", "refresh", "jwt", "user", "username", "login", "csrf", "xsrf", "session", "cookie", "hidden", "text", "string", "str", "required", "optional", "none", "digest", "credentials", "credential", "passphrase", "value", "default", "empty", "db", "root", "admin", "smtp", "redis", "bot", "webhook", "service", "deploy", "signing", "hmac", "encryption"}


def _automaton() -> ahocorasick.Automaton:
    """Of lowered text; (length, None) reads the line, (length, text) if the text is the same, (length, "") if the word ends a name's part."""
    auto = ahocorasick.Automaton()
    for w in LAST | {"key", "keys"}:
        if not any(k in w for k in KEYWORDS):
            auto.add_word(w, (len(w), ""))
    for k in EXACT:
        auto.add_word(k.lower(), (len(k), k))
    for k in KEYWORDS:
        auto.add_word(k, (len(k), None))
    auto.make_automaton()
    return auto


_auto = _automaton()


def _lowered(text: str) -> str:
    """In small letters, of the same length."""
    return text.replace("\u0130", "i").lower()


def _worth(text: str, end: int, size: int, exact: str | None) -> bool:
    """Whether a keyword of the lowered text that ends at ``end`` counts; short words only where WORD would cut them out."""
    if exact is None:
        return True
    b = end + 1 - size
    if exact:
        return text.startswith(exact, b)
    after, then, before = text[end + 1 : end + 2], text[end + 2 : end + 3], text[b - 1 : b] if b else ""
    if "a" <= after <= "z" or "A" <= after <= "Z" and text[end].isupper() and not "a" <= then <= "z":
        return False
    return not ("A" <= before <= "Z" and (text[b].islower() or text[b + 1].isupper()) or "a" <= before <= "z" and text[b].islower())


def prefiltered(text: str) -> bool:
    """Some keyword of the automaton counts."""
    return any(_worth(text, end, *k) for end, k in _auto.iter(_lowered(text)))


def secret_name(name: str) -> bool:
    """The last words of an identifier are words for a secret value."""
    words = [w.lower() for w in WORD.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    last = words[-1]
    if last in LAST:
        return True
    if last in ("key", "keys"):
        return len(words) > 1 and words[-2] in KEY_OF
    return last == "value" and len(words) > 1 and words[-2] in LAST


def placeholder(value: str) -> bool:
    """Empty, masked, a reference, a path, a name or a hint rather than a secret value."""
    v = value.strip()
    if len(v) < 4 or PLACEHOLDER.match(v) or PATH.match(v) or "${" in v or "{{" in v or re.search(r"\s", v):
        return True
    if NAMELIKE.match(v):
        words = [w.lower() for w in WORD.findall(v)]
        if "/" in v or not words or all(w in VOCABULARY for w in words):
            return True
        if re.fullmatch(r"[A-Z]+(?:_[A-Z]+)+", v) or re.fullmatch(r"[a-z]+(?:[-_.][a-z]+)+", v):
            return True  # the name of a variable or setting
        return len(set(v)) < 4 or v.isalpha() and (v.islower() or v.istitle()) and len(v) < 12
    return bool(re.fullmatch(r"[\d.,:\-/ ]+", v)) and len(v) < 6 or set(v) <= set("0-") or bool(re.fullmatch(r"\d{1,5}(?:ms|s|m|h|d)?", v))


def weak_password(name: str, value: str) -> bool:
    """A word that is a known weak password, or several words with a digit and a mark, as the value of a name for a password."""
    words = [w.lower() for w in WORD.findall(name) if not w.isdigit()]
    if not words or words[-1] not in PASSWORDS:
        return False
    v = value.strip().lower()
    return v in WEAK or " " in v and len(v) <= 40 and bool(re.search(r"\d", v)) and bool(re.search(r"[!@#$%^&*]", v)) and not PLACEHOLDER.match(v.replace(" ", ""))


def checksum_fits(token: str) -> bool:
    """The last six characters are the CRC32 of the body before, in base 62, as some issuers write it."""
    m = CHECKED.fullmatch(token)
    if not m:
        return False
    n, out = zlib.crc32(m.group(1).encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0") == m.group(2)


def _jwt(token: str) -> bool:
    head = token.split(".")[0].rstrip("=")
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False


def _basic(data: str) -> bool:
    body = data.rstrip("=")
    try:
        return b":" in base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (ValueError, binascii.Error):
        return False


def _random(v: str) -> bool:
    """Characters of three kinds, or a long run of letters and digits."""
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return kinds >= 3 and bool(re.search("[0-9]", v)) or len(v) >= 20 and bool(re.fullmatch(r"[A-Za-z0-9+/=_-]+", v)) and bool(re.search("[0-9]", v)) and bool(re.search("[A-Za-z]", v))


def _key_end(text: str, b: int) -> int:
    """The end of the key block's body that begins at ``b``: its lines are followed as long as they look like a key, then to its END marker."""
    end, at = b, b
    while at <= len(text):
        gap = PEM_BREAK.search(text, at)
        stop = gap.start() if gap else len(text)
        m = PEM_LINE.fullmatch(text, at, stop)
        if not m:
            tail = PEM_TAIL.match(text, at, stop)
            if tail and (len(tail.group(1)) >= 16 or end > b and not tail.group(1).isalpha()):
                end = tail.end(1)
            break
        end = m.end(1) if m.group(1) else end
        at = gap.end() if gap else len(text) + 1
    last = PEM_END.search(text, end, end + 20_000)
    if last and not PEM.search(text, end, last.start()):
        body = re.sub(r"\\[nr]", "\n", text[b : last.start()])
        if 2 * sum(map(len, re.findall(r"[A-Za-z0-9+/=]{16,}", body))) >= len(re.sub(r"[^A-Za-z0-9+/=]", "", body)):
            return last.start()
    return end


def _line(text: str, a: int, e: int, config: bool) -> list[tuple[int, int]]:
    """(begin, end) of the secret values that begin in text[a:e]; the next line is read for a value that is split off."""
    line = text[a:e]
    out: list[tuple[int, int]] = []

    def add(b: int, end: int) -> None:
        if end > b and all(end <= x or b >= y for x, y in out):
            out.append((b, end))

    for m in PEM.finditer(line):
        body = text[a + m.end() : _key_end(text, a + m.end())]
        flat = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", body)
        if len(flat) >= 24 and len(set(flat)) > 8:
            add(a + m.end(), a + m.end() + len(body))
            out[-1:] = [(a + m.start(), a + m.end() + len(body))]
    for m in ISSUER.finditer(line):
        v = m.group()
        if not checksum_fits(v) and (v.startswith("eyJ") and not _jwt(v) or re.search(r"(?i)example|x{6,}|(.)\1{9,}", v)):
            continue
        add(a + m.start(), a + m.end())
    for m in URL.finditer(line):
        if not placeholder(m.group(2)) or re.fullmatch(r"[a-z]{6,}", m.group(2)) and m.group(2) not in VOCABULARY:
            add(a + m.start(2), a + m.end(2))
    for m in USER.finditer(line):
        if not placeholder(m.group(2)):
            add(a + m.start(2), a + m.end(2))
    for m in PARAMETER.finditer(line):
        if not placeholder(m.group(1)) and not m.group(1).startswith("{"):
            add(a + m.start(1), a + m.end(1))
    for m in HEADER.finditer(line):
        v = m.group(2)
        if m.group(1) and not _basic(v) or placeholder(v) or not m.group(1) and not _random(v):
            continue
        if m.group(1) or HEADER_NEAR.search(line):
            add(a + m.start(2), a + m.end(2))
    after = text.find("\n", e + 1)
    both = text[a : (after if after >= 0 else len(text))] if e < len(text) and line.rstrip().endswith(("=", "(", ":", ",", "+", "\\")) else line
    for m in ASSIGNED.finditer(both):
        if m.start() >= len(line) or not secret_name(m.group("name")):
            continue
        between = both[m.end("name") : m.start("value")]
        if "," in between and not m.group("q"):
            continue
        parts = [(x.start() + 1, x.end() - 1) for x in STRING_RE.finditer(both, m.start("value"), m.end("value"))]
        value = "".join(both[x:y] for x, y in parts)
        if (not placeholder(value) or weak_password(m.group("name"), value)) and not URL.search(value) and not value.startswith("-----") and not HEADER.match(value):
            for x, y in parts:
                add(a + x, a + y)
    for m in DSN_SPLIT.finditer(both):
        if m.start() < len(line) and secret_name(m.group(1)) and not placeholder(m.group(2)):
            add(a + m.start(2), a + m.end(2))
    comment = COMMENT.match(line)
    quotes = [(m.start(), m.end()) for m in STRING_RE.finditer(line)]
    for m in BARE.finditer(line):
        if not secret_name(m.group("name")):
            continue
        inside = any(x < m.start() and m.end() < y for x, y in quotes)
        if not (comment or inside and line[m.end("name")] == "=") or placeholder(m.group("value")) or CALLS.search(m.group("value")):
            continue
        v = m.group("value")
        if inside or _random(v) or len(v) >= 8 and re.search(r"\d", v):
            add(a + m.start("value"), a + m.end("value"))
    if config and not comment and (m := BARE_LINE.match(line)) and secret_name(m.group("name")):
        v = m.group("value")
        if v[0] not in "\"'`{[(|>" and not placeholder(v) and not CALLS.search(v) and not URL.search(v) and not HEADER.match(v):
            add(a + m.start("value"), a + m.end("value"))
    if comment and not out:
        for m in TOLD_HAN.finditer(line, comment.end()):
            v = m.group(1).rstrip(".,;")
            if re.search(r"\d", v) and re.search("[A-Za-z]", v) and not placeholder(v) and "://" not in v:
                add(a + m.start(1), a + m.start(1) + len(v))
    if comment and TOLD.search(line) and not out:
        for m in TOLD_VALUE.finditer(line, comment.end()):
            v = m.group().rstrip(".")
            if _random(v) and not placeholder(v) and "://" not in v and not re.fullmatch(r"[\w./-]+\.[a-z]{1,5}|v?\d[\d.]*\w*|[A-Za-z_]+\d{0,4}|\d{4}-\d\d-\d\d\S*", v):
                add(a + m.start(), a + m.start() + len(v))
    return out


def settings_text(text: str) -> bool:
    """Most lines are settings without quotes or code around them, whatever the file is called."""
    lines = text.count("\n") + 1 - len(BLANK.findall(text))
    return len(SETTING.findall(text)) >= max(1, 0.7 * lines)


def find_spans(text: str | None, path: str | None = None) -> list[tuple[int, int]]:
    """Sorted (begin, end) of the secret values of a text."""
    if not text:
        return []
    config = bool(path and CONFIG.search(path)) or settings_text(text)
    out: list[tuple[int, int]] = []
    upto = reach = -1
    for end, k in _auto.iter(_lowered(text)):
        if end < upto or not _worth(text, end, *k):
            continue
        a = text.rfind("\n", 0, end) + 1
        e = text.find("\n", end)
        e = len(text) if e < 0 else e
        upto = e
        if e > a and text[e - 1] == "\r":
            e -= 1
        if reach >= e:  # within a key block
            continue
        new = [x for x in _line(text, a, e, config) if x[0] >= reach]
        out += new
        reach = max([reach, *(y for _, y in new)])
    return sorted(out)


def credential_lines(text: str | None, path: str | None = None) -> list[int]:
    """The lines on which at least one credential begins."""
    return lines_of_spans(text, find_spans(text, path))


def lines_of_spans(text: str | None, spans: list[tuple[int, int]]) -> list[int]:
    if not spans:
        return []
    ends = [m.start() for m in re.finditer("\n", text)]
    return sorted({bisect_right(ends, b - 1) + 1 for b, _ in spans})


_MASK = {**{ord(c): "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{ord(c): "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "0" for c in "0123456789"}}
_FRAME = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|\\[nrt]")


def _masked_part(value: str) -> str:
    m = PREFIXED.fullmatch(value)
    if m:
        fill = "0" if m.group(1) == "dop_v1_" else "X" if m.group(1)[:2] in ("AK", "AS") else "x"
        return m.group(1) + re.sub("[A-Za-z0-9]", fill, m.group(2))
    out, at = [], 0
    for m in HEX.finditer(value):
        out += [value[at : m.start(1)].translate(_MASK), "0" * len(m.group(1))]
        at = m.end(1)
    return "".join(out) + value[at:].translate(_MASK)


def masked(value: str) -> str:
    """A placeholder of the same length and alphabet; key block frames and escapes stay."""
    out, at = [], 0
    for m in _FRAME.finditer(value):
        out += [_masked_part(value[at : m.start()]), m.group()]
        at = m.end()
    return "".join(out) + _masked_part(value[at:])


def redact(text: str | None, path: str | None = None) -> str | None:
    """The text with its credentials masked."""
    return with_masks(text, find_spans(text, path))


def with_masks(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for b, e in spans:
        if b < at:
            continue
        out += [text[at:b], masked(text[b:e])]
        at = e
    return "".join(out) + text[at:]


def find_credentials(df: DataFrame, keys: list[str], text_col: str, path_col: str) -> DataFrame:
    """(*keys, line_no, redacted): a row for each line on which a credential begins, with the masked text."""
    kinds = dict(df.dtypes)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lines, texts = [], [], []
            for r, (text, path) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                spans = find_spans(text, path)
                if spans:
                    found, fixed = lines_of_spans(text, spans), with_masks(text, spans)
                    rows += [r] * len(found)
                    lines += found
                    texts += [fixed] * len(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), pa.array(lines, pa.int32()), pa.array(texts, pa.string())], names=[*keys, "line_no", "redacted"])

    part = df.where(F.length(text_col) > 0).select(*keys, text_col, path_col)
    return spread(part).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", line_no int, redacted string")


def find_lines(df: DataFrame, keys: list[str], text_col: str, path_col: str) -> DataFrame:
    """(*keys, line_no) alone, each once."""
    kinds = dict(df.dtypes)
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lines = [], []
            for r, (text, path) in enumerate(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist())):
                found = credential_lines(text, path)
                rows += [r] * len(found)
                lines += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(n)), pa.array(lines, pa.int32())], names=[*keys, "line_no"])

    part = df.where(F.length(text_col) > 0).select(*keys, text_col, path_col)
    return spread(part).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", line_no int").distinct()
