"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds with a fixed contract ("base" spans): email, ip, card, phone. The method adds iban (mod-97), ssn
and secret (keys, tokens and passwords: known formats, assignments, and strings whose entropy is high).
Words near a span raise its score or lower it; what a checksum has proven (cards, IBANs) no word lowers below
PROVEN_SCORE, and a phone number with its country code or an address with its domain outweighs one word. An added span needs LEAST_SCORE to count at all; a base
span is always told, but it is redacted only from that score on.

Edge cases: a null or empty text has no spans (redacted: null stays null, empty stays empty); repeated rows
are handled one by one; an empty table gives no rows; other columns pass through; offsets are code points
with an exclusive end; of spans that begin at one place the kinds' order decides; scanning is linear in the
text's length, whatever it holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import array_udf, own

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: Code points on each side in which context words count, and the least score that counts.
CONTEXT_WINDOW = 40
LEAST_SCORE = 0.5
#: A kind's own confidence, and what a word for or against it changes.
CONFIDENCE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.8, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
SHIFT = 0.3
#: Kinds that a checksum proves, and the least score that leaves them.
PROVEN, PROVEN_SCORE = ("card", "iban"), 0.6
#: Confidence in a secret of a known format or one that is assigned to a name.
TOLD = 0.7
FOR = {
    "email": ("mail", "contact", "write", "e-mail"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "mastercard", "debit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "security number"),
    "secret": ("token", "secret", "key", "password", "credential", "auth", "bearer"),
}
AGAINST = {
    "email": ("noreply", "no-reply", "example"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "tracking", "serial", "isbn"),
    "phone": ("isbn", "order", "serial", "invoice"),
    "iban": ("serial", "part no"),
    "ssn": ("serial", "part no", "order"),
    "secret": ("commit", "checksum", "sha1", "sha256", "md5", "digest"),
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A maximal stretch that can hold an ip, card or phone (without its plus sign).
_NUMBERS = re.compile(r"[0-9][\x20().0-9-]*")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 13616 check: letters as two digits, country and check digits last, remainder one."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """Leftmost matches: each @ takes the longest local part that no earlier match has used."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and (text[start - 1].isalnum() and text[start - 1].isascii() or text[start - 1] in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1  # a local part cannot reach over an @
            at = text.find("@", free)


def _ips(run: str):
    pos = 0
    for m in iter(lambda: _next_ip(run, pos), None):
        pos = m.end()
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            yield m.span()


def _next_ip(run: str, pos: int):
    """First match at or after pos; only starts of digit groups can match, which keeps the scan linear."""
    for m in _DIGITS.finditer(run, pos):
        if found := _IP.match(run, m.start()):
            return found
    return None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _NUMBERS.finditer(text):
        start, run = m.start(), m[0]
        if len(run) < 3:
            continue
        if run.count(".") >= 3:
            out += [("ip", start + a, start + b) for a, b in _ips(run)]
        if len(run) >= 14:
            for c in _CARD.finditer(run):
                digits = "".join(_DIGITS.findall(c[0]))
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", start + c.start(), start + c.end()))
        if start and text[start - 1] == "+":
            end = len(run.rstrip(" ().-"))
            if end >= 3 and 10 <= sum(map(len, _DIGITS.findall(run, 0, end))) <= 15:
                out.append(("phone", start - 1, start + end))
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _IBAN.finditer(text):
        plain = m[0].replace(" ", "")
        before = text[m.start() - 1] if m.start() else " "
        if 15 <= len(plain) <= 34 and not (before.isascii() and before.isalnum()) and mod97(plain):
            out.append(("iban", *m.span()))
    for run in _NUMBERS.finditer(text):
        if run.end() - run.start() >= 11 and run[0].count("-") >= 2:
            out += [("ssn", run.start() + m.start(), run.start() + m.end()) for m in _SSN.finditer(run[0]) if _plausible_ssn(m[0])]
    return out


def _plausible_ssn(found: str) -> bool:
    area, group, serial = found.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


_KNOWN = re.compile(
    r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,200}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,200}"
    r"|eyJ[A-Za-z0-9_-]{8,4000}\.eyJ[A-Za-z0-9_-]{8,4000}\.[A-Za-z0-9_-]{8,4000})|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
)
_ASSIGNED = re.compile(r"(?:passw(?:or)?d|pwd|secret|token|api[ _-]?key|access[ _-]?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"']{8,400})", re.I)
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Longest string that is taken for a secret, and the least entropy of its characters in bits.
MOST_SECRET, LEAST_ENTROPY = 400, 3.0


def entropy(found: str) -> float:
    """Bits a character."""
    n = len(found)
    return -sum(k / n * math.log2(k / n) for k in Counter(found).values())


def secret_spans(text: str) -> list[tuple[int, int, float]]:
    """(start, end, confidence), longer finds first where they overlap; letters and digits must both occur."""
    out = [(*m.span(), TOLD) for m in _KNOWN.finditer(text)]
    out += [(*m.span(1), TOLD) for m in _ASSIGNED.finditer(text) if _mixed(m[1])]
    out += [(*m.span(), CONFIDENCE["secret"]) for m in _OPAQUE.finditer(text) if m.end() - m.start() <= MOST_SECRET and _mixed(m[0]) and entropy(m[0]) >= LEAST_ENTROPY]
    kept: list[tuple[int, int, float]] = []
    for a, b, sure in sorted(out, key=lambda s: (s[0], -s[2], -s[1])):
        if not kept or a >= kept[-1][1]:
            kept.append((a, b, sure))
    return kept


def _mixed(found: str) -> bool:
    return any(c.isdigit() for c in found) and any(c.isalpha() for c in found)


_NEAR = {kind: tuple(re.compile("|".join(rf"\b{re.escape(w)}" for w in words[kind])) for words in (FOR, AGAINST)) for kind in KINDS}


def score(text: str, kind: str, start: int, end: int, sure: float | None = None) -> float:
    """The kind's own confidence (or `sure`), raised by a word for it within CONTEXT_WINDOW code points and lowered by one against it."""
    near = (text[max(0, start - CONTEXT_WINDOW) : start] + " " + text[end : end + CONTEXT_WINDOW]).lower()
    sure = CONFIDENCE[kind] if sure is None else sure
    for words, shift in zip(_NEAR[kind], (SHIFT, -SHIFT)):
        sure += shift * (words.search(near) is not None)
    return min(1.0, max(PROVEN_SCORE if kind in PROVEN else 0.0, round(sure, 6)))


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base), by start, then kind in the order of KINDS."""
    base = base_spans(text)
    spans = [(k, a, b, score(text, k, a, b), True) for k, a, b in base]
    added = [(k, a, b, score(text, k, a, b)) for k, a, b in added_spans(text)]
    taken = sorted((a, b) for _, a, b, *_ in base + added)
    at = 0
    for a, b, sure in secret_spans(text):  # not where another kind already stands
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            added.append(("secret", a, b, score(text, "secret", a, b, sure)))
    spans += [(*s, False) for s in added if s[3] >= LEAST_SCORE]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans=None) -> str:
    """The text with every span of LEAST_SCORE replaced by its kind in brackets; overlapping spans become one, named by the
    first; of several that begin at one place, by the first of KINDS."""
    spans = find_spans(text) if spans is None else spans
    out, at = [], 0
    for kind, start, end, sure, *_ in spans:
        if sure < LEAST_SCORE:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())])


def _spans(text: pa.Array) -> pa.Array:
    own("pii")
    return pa.array([[dict(zip(("kind", "start", "end", "score", "base"), s)) for s in find_spans(t or "")] for t in text.to_pylist()], pa.list_(_SPAN))


def _redacted(text: pa.Array) -> pa.Array:
    own("pii")
    return pa.array([None if t is None else redact(t) for t in text.to_pylist()], pa.string())


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """docs with out_col: the spans of each whole text; every other column passes through."""
    return docs.withColumn(out_col, array_udf(_spans, SPAN_TYPE)(F.col(text_col).cast("string")))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind; null stays null."""
    return docs.withColumn(text_col, array_udf(_redacted, "string")(F.col(text_col).cast("string")))
