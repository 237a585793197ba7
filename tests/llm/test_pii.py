"""Spans against the base patterns, and what anchors add."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserapy.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    """Base spans by the patterns themselves."""
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def base(text):
    return [s[:3] for s in pii.find(text) if s[3]]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1290@.+-_ (),é😀\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "1.2.3.4.5.6.7.8", "300.1.1.1", "+1 (415) 555-2671", "+49 30 123456", "a.b@c.d", "x@y", "@", "é", " ", "-", "7", "..", "mailto:"]), max_size=12))
def test_base_spans_of_pieces(pieces):
    text = "".join(pieces)
    assert base(text) == brute(text)


def added(text):
    return [(k, text[a:b]) for k, a, b, is_base in pii.find(text) if not is_base]


def test_schemes_and_cues_add_spans():
    assert added("mailto:root@localhost, tel:415-555-2671") == [("email", "root@localhost"), ("phone", "415-555-2671")]
    assert added("see https://bob:pw@host/x and http://10.0.0.1:80/ or http://[2001:db8::1]/ not http://host.com/") == [("address", "https://bob:pw@host"), ("address", "http://10.0.0.1:80"), ("address", "http://[2001:db8::1]")]
    assert added("IBAN: GB82 WEST 1234 5698 7654 32 THEN, iban GB82WEST12345698765433") == [("account", "GB82 WEST 1234 5698 7654 32")]
    assert added("SSN 123-45-6789, ssn: 000-45-6789; Account no. 12345678 accounts of 2024") == [("account", "123-45-6789"), ("account", "12345678")]
    assert added('password=e3b3ed3cc8 token = "0641917ea4e9" the password is good, secret: abcdefgh') == [("account", "e3b3ed3cc8"), ("account", "0641917ea4e9")]
    assert not pii.find("Plain words about an account, a token of thanks and 3 numbers.")


def test_base_stays_beside_added_and_redaction():
    text = "mailto:bob@example.com or ftp://u@1.2.3.4/ é +1 (415) 555-2671"
    found = pii.find(text)
    assert [s[0] for s in found] == ["email", "email", "ip", "phone", "address"]
    assert base(text) == brute(text)
    assert pii._redacted(text) == "mailto:[EMAIL] or [ADDRESS]/ é [PHONE]"


def test_long_texts_are_linear():
    n = 300_000
    for text in ("a" * n + "@", "1" * n + ".1" * 3, "1." * n, "+1" + " " * n, "@" * n, "a@" * n, "1 " * n, "x@" + "a-" * n, "iban " * (n // 5)):
        pii.find(text)
    assert pii.find("1" * n + ".1.1.1") == []
    tail = "word " * n + "bob@example.com"
    assert pii.find(tail) == [("email", 5 * n, len(tail), True)]


def test_query_columns_nulls_and_clashes(spark):
    rows = [(1, "a@b.c 10.0.0.1 4111 1111 1111 1111 x +1 (415) 555-2671", "x"), (2, None, "y"), (3, "", None), (1, "a@b.c 10.0.0.1 4111 1111 1111 1111 x +1 (415) 555-2671", "x"), (None, "ssn 123-45-6789", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for doc, text, r in zip([r[0] for r in rows], [r[1] for r in rows], pii.counted(docs).collect(), strict=True):
        want = brute(text)
        assert r["doc_id"] == doc
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pii.find(text))
    assert pii.detect(docs).columns == ["doc_id", "text", "spans", "spans_"]
    assert [r["text"] for r in pii.redact(docs).collect()][1:3] == [None, ""]
    assert pii.counted(docs.limit(0)).collect() == []


def test_query_equals_the_patterns_on_whole_texts(spark, sf_dir):
    from tesserapy.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.queries()["op11_pii"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
