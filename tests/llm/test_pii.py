from __future__ import annotations

import random
import re

import pytest

from lodegraph.llm import pii
from lodegraph.llm.spans import digest, joined


def digits(text):
    return re.sub("[^0-9]", "", text)


def brute(text):
    """The base spans, as the contract's patterns state them."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return set(out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15])


@pytest.mark.parametrize("seed", range(20))
def test_base_spans(seed):
    rng = random.Random(seed)
    for _ in range(300):
        text = "".join(rng.choices(rng.choice(["ab@.-+ 1%", "0123456789.", "0123456789 -", "+12 ().-a", "a@b.1+2 -(3)éİ"]), k=rng.randint(0, 45)))
        assert {s for s in pii.find(text) if s[0] in pii.BASE_KINDS} == brute(text)


def test_added_kinds():
    text = "İ IBAN: DE89 3704 0044 0532 0130 00 and SSN 123-45-6789, account no. 12345678 https://bob:pw@host.example/x"
    assert {(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE_KINDS} == {("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("account", "12345678"), ("url", "https://bob:pw@host.example")}
    assert pii.find("IBAN DE00 3704 0044 0532 0130 00, SSN 000-12-3456, http://example.org/a@b, on account of 5") == []


def test_cues_with_several_identifiers():
    text = "IBANs: DE89 3704 0044 0532 0130 00, GB82 WEST 1234 5698 7654 32. Accounts 12345678, 87654321 and 5; social security: 000-12-3456 or 123-45-6789."
    assert [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE_KINDS] == [
        ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("account", "12345678"), ("account", "87654321"), ("ssn", "123-45-6789"),
    ]
    assert pii.find("ssn 000-00-0000 " * 20_000) == []


def test_long_runs_are_linear():
    assert pii.find("a" * 300_000 + "@" + "b" * 300_000) == []
    assert pii.find("1" * 200_000) == [] and pii.find("+1 " * 50_000) == []


def test_scan(spark):
    rows = [(1, "x@y.org"), (1, "x@y.org"), (None, None), (2, ""), (3, "word " * 100_000 + "10.0.0.1")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_ip int")
    found = pii.scan(df).collect()
    assert len(found) == 5 and {(r.doc_id, r.spans) for r in found} == {(1, "email:0:7"), (None, ""), (2, ""), (3, "ip:500000:500008")}
    assert pii.scan(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    from lodegraph.llm.queries import op9_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op9_pii(spark, sf_dir).collect():
        expected = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == digest(joined(expected, pii.KINDS))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in expected) for k in pii.BASE_KINDS)
