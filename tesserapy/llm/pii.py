"""Personal data: anchors found by Aho-Corasick, expanded by local parsers.

One automaton finds at-signs, digits, plus signs, dots before digits, URL schemes
and identifier cues in a single pass over a whole text. Each anchor starts a
deterministic parser that reads only its surroundings, finds both boundaries and
validates what lies between (ranges, Luhn, mod 97). Parsers of the four base
kinds give what the leftmost non-overlapping matches of their patterns give;
schemes and cues add spans that no base pattern has.

Null and empty texts have no spans. Very long texts are read in one pass whose
memory is the text and its spans; every parser moves forward, so time is linear.
Repeated rows are treated alike, an empty table gives an empty one, and columns
of the documents stay whatever their names.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Kinds of spans in their order; those of BASE have a fixed pattern.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

#: Characters of a mailbox, and the patterns that parsers read from an anchor on.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
AUTHORITY = re.compile(r"(?:[^\s/?#@\[\]<>\"']{1,256}@)?(?:\[[0-9A-Fa-f:.]{2,45}\]|[A-Za-z0-9.-]{1,253})(?::[0-9]{1,5})?")
NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"[A-Z]{0,4}[0-9](?:[\x20-]?[0-9]){5,17}(?![0-9])")
CREDENTIAL = re.compile(r"[^\s\"'<>,;]{8,256}")
#: What stands between a cue and its value; a credential needs a sign of assignment.
LINK = re.compile(r"(?:\x20{0,2}(?:no\.?|nr\.?|number|id)(?:\x20{0,2}[:=#])?|\x20{0,2}(?:[:=#]|is\x20))\x20{0,2}[\"']?", re.I)
ASSIGN = re.compile(r"\x20{0,2}[:=]\x20{0,2}[\"']?")

#: Schemes and cues, found in lower case, upper case and capitalised.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "ldap://")
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "konto", "cuenta", "compte", "passport", "routing"),
    "credential": ("password", "passwd", "token", "secret", "api_key", "apikey"),
}

Span = tuple[int, int] | None


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Anchors with their kind and length."""
    words: dict[str, str] = {"@": "at"}
    words |= {d: "digit" for d in DIGITS} | {f".{d}": "dot" for d in DIGITS} | {f"+{d}": "plus" for d in DIGITS}
    told = {"mailto:": "mailto", "tel:": "tel"} | dict.fromkeys(SCHEMES, "scheme") | {cue: kind for kind, cues in CUES.items() for cue in cues}
    for word, kind in told.items():
        words |= dict.fromkeys((word, word.upper(), word.capitalize()), kind)
    found = ahocorasick.Automaton()
    for word, kind in words.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """The check digit of a card number."""
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _plain(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _left(text: str, at: int, least: int, of: str) -> int:
    """Where the run of characters that ends before ``at`` begins, not before ``least``."""
    step, start = 64, at
    while start > least:
        piece = text[max(least, start - step) : start]
        kept = len(piece.rstrip(of))
        if kept:
            return start - len(piece) + kept
        start, step = start - len(piece), step * 2
    return start


def _email(text: str, at: int, least: int) -> tuple[Span, int]:
    start = _left(text, at, least, LOCAL)
    m = DOMAIN.match(text, at + 1) if start < at else None
    return ((start, m.end()), m.end()) if m else (None, at + 1)


def _ip(text: str, at: int, least: int) -> tuple[Span, int]:
    start = _left(text, at, least, DIGITS)
    m = DOTTED.match(text, start) if start < at else None
    if not m:
        return None, at + 1
    parts = (p.lstrip("0") for p in m.group().split("."))
    return ((start, m.end()) if all(len(p) < 4 and int(p or "0") <= 255 for p in parts) else None), m.end()


def _card(text: str, at: int, least: int) -> tuple[Span, int]:
    m = CARD.match(text, at)
    if not m:
        return None, at + 1
    digits = _plain(m.group()) if m.end() - at <= 37 else ""
    return ((at, m.end()) if 16 <= len(digits) <= 19 and luhn(digits) else None), m.end()


def _phone(text: str, at: int, least: int) -> tuple[Span, int]:
    m = PHONE.match(text, at)
    if not m:
        return None, at + 1
    few = sum(map(m.group().count, DIGITS))
    return ((at, m.end()) if 8 <= few <= 15 else None), m.end()


#: Base kind and parser of an anchor. A parser gets the place from which its kind is free, and gives a span and the next such place.
PARSERS: dict[str, tuple[int, Callable]] = {"at": (0, _email), "dot": (1, _ip), "digit": (2, _card), "plus": (3, _phone)}


def _mailto(text: str, at: int, end: int) -> tuple[str, Span]:
    """A mailbox on a host of one name, which the base pattern does not have."""
    sign = end
    while sign < len(text) and sign - end < 256 and text[sign] in LOCAL:
        sign += 1
    m = HOST.match(text, sign + 1) if end < sign < len(text) and text[sign] == "@" else None
    return "email", (end, m.end()) if m else None


def _tel(text: str, at: int, end: int) -> tuple[str, Span]:
    m = NUMBER.match(text, end)
    return "phone", (m.start(), m.end()) if m else None


def _scheme(text: str, at: int, end: int) -> tuple[str, Span]:
    """An address that names a person or a machine: with a user, or with a numeric host."""
    m = AUTHORITY.match(text, end)
    if not m:
        return "address", None
    user, _, host = m.group().rpartition("@")
    if not user:
        host = host[: host.index("]") + 1] if host.startswith("[") else host.rpartition(":")[0] or host
        try:
            ipaddress.ip_address(host.strip("[]"))
        except ValueError:
            return "address", None
    return "address", (at, m.end())


def _value(text: str, end: int, link: re.Pattern = LINK) -> int | None:
    m = link.match(text, end)
    return m.end() if m else None


def _iban(text: str, at: int, end: int) -> tuple[str, Span]:
    start = _value(text, end)
    if start is None:  # the value may follow the cue itself
        start = end + 1 if text[end : end + 1] == " " else end
    m = IBAN.match(text, start)
    while m:
        code = m.group().replace(" ", "")
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return "account", (start, m.end())
        cut = m.group().rfind(" ")  # words of capitals that follow the number
        m = IBAN.fullmatch(text, start, start + cut) if cut > 0 else None
    return "account", None


def _ssn(text: str, at: int, end: int) -> tuple[str, Span]:
    start = _value(text, end)
    if start is None:
        start = end + 1 if text[end : end + 1] == " " else end
    m = SSN.match(text, start)
    good = m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"
    return "account", (start, m.end()) if good else None


def _account(text: str, at: int, end: int) -> tuple[str, Span]:
    start = _value(text, end)
    m = ACCOUNT.match(text, start) if start is not None else None
    return "account", (start, m.end()) if m else None


def _credential(text: str, at: int, end: int) -> tuple[str, Span]:
    """A password or key: letters and digits after a sign of assignment."""
    start = _value(text, end, ASSIGN)
    m = CREDENTIAL.match(text, start) if start is not None else None
    good = m and re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())
    return "account", (start, m.end()) if good else None


MORE: dict[str, Callable] = {"mailto": _mailto, "tel": _tel, "scheme": _scheme, "iban": _iban, "ssn": _ssn, "account": _account, "credential": _credential}


def find(text: str | None) -> list[tuple[str, int, int, bool]]:
    """kind, start, end, base of each span, by kind in the order of KINDS, then start.

    Places are code points, the end exclusive. An added span that overlaps an
    earlier one of its kind is dropped.
    """
    if not text:
        return []
    spans: list[list[tuple[int, int, bool]]] = [[] for _ in KINDS]
    free, added = [0] * len(BASE), []
    for last, (what, size) in automaton().iter(text):
        at = last - size + 1
        if what in PARSERS:
            k, parse = PARSERS[what]
            if at >= free[k]:
                span, free[k] = parse(text, at, free[k])
                if span:
                    spans[k].append((*span, True))
        elif what == "scheme" or not at or not text[at - 1].isalnum():
            kind, span = MORE[what](text, at, last + 1)
            if span:
                added.append((KINDS.index(kind), *span))
    for k, start, end in sorted(set(added)):
        if all(b <= start or end <= a for a, b, _ in spans[k]):
            spans[k].append((start, end, False))
    return [(KINDS[k], *s) for k, found in enumerate(spans) for s in sorted(found)]


def spans_of(text: Column) -> Column:
    """The spans of a text column as an array of structs; texts travel in Arrow batches."""

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "end", "base")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in find(t)] for t in texts], dtype=object)

    return found(text)


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``spans``, all personal data of the whole text (under a fresh name if taken)."""
    [name] = fresh(docs, "spans")
    return docs.withColumn(name, spans_of(F.col(text_col)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    A null text stays null.
    """

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else _redacted(t) for t in texts], dtype=object)

    return docs.withColumn(text_col, cleaned(F.col(text_col)))


def _redacted(text: str) -> str:
    out, place = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in find(text)):
        if start >= place:
            out += [text[place:start], f"[{kind.upper()}]"]
        place = max(place, end)
    return "".join([*out, text[place:]])


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), spans_of(F.col(text_col)).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    counts = [_number(F.col("found"), k).alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
