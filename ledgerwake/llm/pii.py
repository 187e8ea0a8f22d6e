"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Kinds email, ip, card and phone are the base: whatever matches their pattern and passes their check is a span, whatever its
score. Kinds iban, ssn and secret are added where the score reaches the threshold. Spans count code points, end exclusive.
A null text has no spans. All patterns take time in proportion to the text.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")

# Patterns of the base kinds, possessive where that changes no match.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Patterns of the added kinds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2})[0-9]{2}\x20?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NAMED = re.compile(
    r"""(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)["']?\x20{0,3}[:=]\x20{0,3}["']?([A-Za-z0-9+/_=.$!@#%^*?~-]{8,}+)"""
)
_BEARER = re.compile(r"""(?i)(?<![a-z])(authorization["']?\x20{0,3}[:=]\x20{0,3}["']?)?(?:bearer|basic)\x20{1,3}([a-z0-9+/_.~-]{8,}+=*+)""")
_WEB_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}+)\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{8,}+")
# Countries and the lengths of their account numbers.
IBAN_LENGTH = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
# Words near a span that speak for it or against it.
FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "debit", "payment", "cvv", "expires"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "whatsapp"),
    "iban": ("iban", "bank", "account", "transfer", "swift", "bic"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("key", "token", "secret", "password", "passwd", "apikey", "accesskey", "privatekey", "login", "credentials", "authorization", "header"),
}
AGAINST = {
    "ip": ("version", "release", "section", "chapter"),
    "card": ("isbn", "order", "invoice", "serial"),
    "phone": ("score", "equation"),
    "iban": ("part", "model", "sku", "serial", "invoice"),
    "ssn": ("part", "model", "sku"),
    "secret": ("example", "placeholder", "changeme"),
}
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.7}
_NEAR_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(code: str) -> bool:
    """The check of an IBAN without blanks."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain would match, but from each @ outwards: a long run without one isn't walked again from each of its characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers of their country's length, single blanks between characters allowed. What fails the check is searched again from its fifth character on: the next one may begin inside."""
    m = _IBAN.search(text)
    while m:
        start, after = m.start(), m.start() + 4
        if length := IBAN_LENGTH.get(m[1]):
            own = re.compile(rf"[A-Z0-9](?:\x20?[A-Z0-9]){{{length - 1}}}(?![A-Za-z0-9])").match(text, start)
            if own and mod97(own.group().replace(" ", "")):
                yield own.span()
                after = own.end()
        m = _IBAN.search(text, after)


def _mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _is_token_head(part: str) -> bool:
    """Whether the first part of a web token is the base64 of a JSON object that names its algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and "alg" in head


def _secrets(text: str) -> Iterator[tuple[int, int, int]]:
    """Values of named settings and of bearer headers, and web tokens wherever they stand: (start, end, start of the name); leftmost and longest, not overlapping."""
    found = []
    if "=" in text or ":" in text:
        found += [(*m.span(1), m.start()) for m in _NAMED.finditer(text) if _mixed(m[1])]
    found += [(*m.span(2), m.start()) for m in _BEARER.finditer(text) if m[1] or (len(m[2]) >= 20 and _mixed(m[2]))]
    if "eyJ" in text:
        found += [(*m.span(), m.start()) for m in _WEB_TOKEN.finditer(text) if _is_token_head(m[1])]
    done = 0
    for start, end, name in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if start >= done:
            yield start, end, name
            done = end


def _proposals(text: str) -> Iterator[tuple[str, int, int, int]]:
    """Spans whose pattern matches and whose check holds, and where what they belong to begins; leftmost, not overlapping within a kind; of the base kinds, no second try in one that fails."""
    for kind, start, end in _numbers(text):
        yield kind, start, end, start
    for start, end, name in _secrets(text):
        yield "secret", start, end, name


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """The proposals of all kinds but secret."""
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield "phone", *m.span()
    for start, end in _ibans(text):
        yield "iban", start, end
    for m in _SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def _score(text: str, kind: str, start: int, end: int, window: int) -> float:
    """The prior of the kind, moved by the words beside the span; a secret's own name isn't one of them."""
    near = set(_NEAR_WORD.findall((text[max(0, start - window) : start] + " " + text[end : end + window]).lower()))
    lift = 0.2 * any(w in near for w in FOR[kind]) - 0.3 * any(w in near for w in AGAINST.get(kind, ()))
    return min(1.0, max(0.0, _PRIOR[kind] + lift))


def find_spans(text: str | None, threshold: float = 0.6, window: int = 40) -> list[Span]:
    """All spans by start, then kind in the order of KINDS."""
    found = []
    for kind, start, end, name in _proposals(text or ""):
        score = _score(text, kind, name, end, window)
        if kind in BASE_KINDS or score >= threshold:
            found.append(Span(kind, start, end, score))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; spans that overlap become one, of the first one's kind."""
    if not spans:
        return text
    parts, done, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i].kind, spans[i].start, spans[i].end
        i += 1
        while i < len(spans) and spans[i].start < end:
            end = max(end, spans[i].end)
            i += 1
        parts += [text[done:start], f"<{kind.upper()}>"]
        done = end
    return "".join([*parts, text[done:]])


def span_column(text: Column, threshold: float = 0.6, window: int = 40) -> Column:
    """Array of (kind, start, end, score) of a text column; of a null or empty text an empty one. A very long text is searched whole; equal rows get equal arrays, and an empty table none."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[vars(s) for s in find_spans(x, threshold, window)] for x in texts], dtype=object)

    return spans(text)


def mask_column(text: Column, threshold: float = 0.6, window: int = 40) -> Column:
    """The text column with personal data masked: see mask. Null stays null."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([mask(x, find_spans(x, threshold, window)) for x in texts], dtype=object)

    return masked(text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with personal data masked in the text column; n_chars follows where there is such a column. A null text stays null, an empty one empty. Repeated rows stay, alike; an empty table stays empty; extra columns may have any name."""
    out = docs.withColumn(text, mask_column(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return out


def spans_digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, joined by commas."""
    own = F.filter(spans, lambda s: s.kind.isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
