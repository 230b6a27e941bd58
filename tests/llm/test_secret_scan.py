from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from lodegraph.llm import secret_scan
from lodegraph.llm.spans import digest, joined

SECRET = 'password = "hunter2hunter2hunter2" ok'


def brute(text):
    """The base spans, as the contract's patterns state them."""
    out = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return set(out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16])


@pytest.mark.parametrize("seed", range(20))
def test_base_spans(seed):
    rng = random.Random(seed)
    for _ in range(100):
        text = "".join(rng.choices(["password", "Token", "API_key", "=", ": ", "'", "abc123", "deadbeef0", "AKIA", "XYZ12", " ", "%41", "\\u0041", "ſecret", "é"], k=rng.randint(0, 14)))
        assert set(secret_scan.find(text)[0]) == brute(text)


def b64(data):
    return base64.b64encode(data).decode()


LAYERS = {
    "base64": b64(SECRET.encode()),
    "url": urllib.parse.quote(SECRET, safe=""),
    "url_twice": urllib.parse.quote(urllib.parse.quote(SECRET)),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "gzip": b64(gzip.compress(SECRET.encode())),
    "zlib": b64(zlib.compress(SECRET.encode())),
    "bz2": b64(bz2.compress(SECRET.encode())),
    "xz": b64(lzma.compress(SECRET.encode())),
    "zstd": b64(zstandard.ZstdCompressor().compress(SECRET.encode())),
    "nested": urllib.parse.quote(b64(gzip.compress(b64(SECRET.encode()).encode())), safe=""),
    "base64_twice": b64(b64(SECRET.encode()).encode()),
}


@pytest.mark.parametrize("name", LAYERS)
def test_layers_map_to_their_encoded_run(name):
    text = f"é {LAYERS[name]} end"
    base, added = secret_scan.find(text)
    assert not [s for s in base if s[0] == "assign"]
    kind, low, high = next(s for s in added if s[0] == "assign")
    assert 2 <= low < high <= 2 + len(LAYERS[name])
    if name in ("url", "unicode", "entities"):
        assert secret_scan.find(text[low:high])[1]


@pytest.mark.parametrize("second", ["base64", "gzip", "nested"])
def test_equal_content_is_found_at_every_place(second):
    text = f"one {LAYERS['base64']} two {LAYERS['base64']} three {LAYERS[second]} end"
    starts = sorted(low for kind, low, _ in secret_scan.find(text)[1] if kind == "assign")
    places = [text.index(LAYERS["base64"]), text.index(LAYERS["base64"], 10), text.index(" three ") + 7]
    assert len(starts) == 3 and all(p <= s < p + len(LAYERS["base64"]) for p, s in zip(places, starts, strict=True))


@pytest.mark.parametrize("name", ["base64", "gzip", "zlib", "bz2", "xz", "zstd", "base64_twice"])
@pytest.mark.parametrize("glue", ["/data/x/", "path/", "key_", "a-", "x", "xy", "xyz"])
def test_runs_glued_to_their_class(name, glue):
    text = f"é {glue}{LAYERS[name]} end"
    low, high = next((a, b) for k, a, b in secret_scan.find(text)[1] if k == "assign")
    assert 2 + len(glue) <= low < high <= 2 + len(glue) + len(LAYERS[name])
    after = f"é {LAYERS[name].rstrip('=')}/tail-of_path end"
    assert any(k == "assign" for k, *_ in secret_scan.find(after)[1])


@pytest.mark.parametrize("line", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("how", [bytes, gzip.compress, lzma.compress])
def test_runs_wrapped_over_lines(line, how):
    for pad in range(40, 60):
        noise = random.Random(pad).randbytes(150).hex().upper()
        whole = b64(how((". " * (pad // 2) + "x" * (pad % 2) + SECRET + " " + noise).encode()))
        lines = [whole[i : i + 76] for i in range(0, len(whole), 76)]
        text = f"see:{line}{line.join(lines)}{line}end."
        found = [(a, b) for k, a, b in secret_scan.find(text)[1] if k == "assign"]
        assert len(lines) > 2 and found
        if how is bytes:
            low = text.index(lines[0])
            at = [i for i in range(low, len(text)) if text[i] in whole and not text[i].isspace()]
            first, last = whole_quads(pad)
            assert (at[first], at[last - 1] + 1) in found


def whole_quads(pad):
    """The base64 characters that hold the assignment of SECRET after `pad` bytes."""
    end = pad + SECRET.rindex('"')
    return 4 * (pad // 3), 4 * ((end - 1) // 3) + 4


def test_streams_of_any_depth_size_and_number():
    deep = SECRET.encode()
    for _ in range(70):
        deep = gzip.compress(deep)
    assert {k for k, *_ in secret_scan.find(f"x {b64(deep)} y")[1]} == {"assign"}
    members = gzip.compress(b"nothing to see here, move on") + gzip.compress(SECRET.encode())
    assert {k for k, *_ in secret_scan.find(f"x {b64(members)} y")[1]} == {"assign"}
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress):
        large = pack(b"word \n" * 3_500_000 + SECRET.encode() + b"\n" * 40)
        assert {k for k, *_ in secret_scan.find(f"x {b64(large)} y")[1]} == {"assign"}, pack


def test_streams_under_escapes():
    data = gzip.compress(SECRET.encode())
    for mark in ("%", "\\x"):
        text = "see " + "".join(f"{mark}{b:02x}" for b in data) + " end"
        assert ("assign", 4, len(text) - 4) in secret_scan.find(text)[1]


def test_binary_around_text():
    assert [k for k, *_ in secret_scan.find(b64(b"\xff\x00\xfe" + SECRET.encode() + b"\x80" * 9))[1]] == ["assign"]


ENCODERS = {
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()),
    "u": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
    "braces": lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t),
    "octal": lambda t: "".join(f"\\{ord(c):03o}" for c in t),
    "hex": lambda t: "".join(f"\\x{ord(c):02x}" for c in t),
    "decimal": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "named": lambda t: t.replace("&", "&amp;").replace("=", "&equals;").replace('"', "&quot;").replace(":", "&colon;"),
    "base64": lambda t: b64(t.encode()),
    "wide": lambda t: b64(t.encode("utf-16")),
    "wide_big": lambda t: b64(t.encode("utf-16-be")),
    "wide_gzip": lambda t: b64(gzip.compress(t.encode("utf-16-le"))),
    "gzip": lambda t: b64(gzip.compress(t.encode())),
    "escaped_wrap": lambda t: "\\n".join(b64(t.encode())[i : i + 76] for i in range(0, len(b64(t.encode())), 76)),
    "escaped_return": lambda t: "\\r\\n".join(b64(t.encode())[i : i + 64] for i in range(0, len(b64(t.encode())), 64)),
    "quoted_wrap": lambda t: "\n> ".join(b64(t.encode())[i : i + 60] for i in range(0, len(b64(t.encode())), 60)),
    "twice_quoted": lambda t: "\r\n>> ".join(b64(t.encode())[i : i + 60] for i in range(0, len(b64(t.encode())), 60)),
}


@pytest.mark.parametrize("name", sorted(ENCODERS))
def test_every_encoding_of_a_secret(name):
    for pad in range(6):
        inner = "x" * pad + " and then " + SECRET + " or so, and some more of it " * 3
        text = f"é {ENCODERS[name](inner)} end"
        base, added = secret_scan.find(text)
        found = [(a, b) for k, a, b in added if k == "assign"]
        assert found and all(2 <= a < b <= len(text) - 4 for a, b in found)


@pytest.mark.parametrize("seed", range(60))
def test_generated_nestings(seed):
    """Encoders chosen at random around a secret; what encodes last is undone first, so each layer must be opened."""
    rng = random.Random(seed)
    inner, names = f"see {SECRET} and more", rng.choices(sorted(ENCODERS), k=rng.randint(2, 3))
    for name in names:
        inner = f"{rng.choice(['', 'a note. ', 'é '])}{ENCODERS[name](inner)} end" if len(inner) < 30_000 else inner
    text = f"start {inner} stop"
    found = [s for part in secret_scan.find(text) for s in part if s[0] == "assign"]
    assert found and all(6 <= a < b <= len(text) - 5 for _, a, b in found), names


def test_wide_text_maps_to_its_own_characters():
    noise = "nothing here at all, just words. "
    text = b64((noise * 3 + SECRET + noise * 3).encode("utf-16-le"))
    low, high = next((a, b) for k, a, b in secret_scan.find(text)[1] if k == "assign")
    first = 2 * 3 * len(noise)
    assert low == 4 * (first // 3) and high - low <= 4 * (2 * len(SECRET) // 3) + 8


def test_unknown_names_stay():
    assert secret_scan.find("a &nosuchname; b &amp c") == ([], [])
    assert [k for k, *_ in secret_scan.find("&nosuch;password&equals;abcdefghijklmn")[1]] == ["assign"]


def test_clean_text_and_cycles():
    assert secret_scan.find("100% sure \\ nothing & here, not even in QUJDREVGR0hJSktMTU5P") == ([], [])
    assert secret_scan.find("%2525252525") == ([], [])
    assert secret_scan.find(None) == secret_scan.find("") == ([], [])


def test_scan(spark):
    rows = [(1, SECRET), (1, SECRET), (None, LAYERS["gzip"]), (2, None), (3, ""), (4, "word " * 100_000 + "AKIA" + "B2" * 9)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int")
    found = secret_scan.scan(df).collect()
    assert len(found) == 6
    by = {r.doc_id: r for r in found}
    assert (by[1].n_assign, by[1].spans) == (1, "assign:0:33")
    assert (by[None].n_assign, by[None].n_decoded) == (0, 1)
    assert by[2].base_sha256 == by[3].base_sha256 == digest("")
    assert by[4].spans == "access:500000:500022"
    assert secret_scan.scan(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    from lodegraph.llm.queries import op1_secret_scan

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_secret_scan(spark, sf_dir).collect():
        expected = brute(texts[r.doc_id] or "")
        assert r.base_sha256 == digest(joined(expected, secret_scan.KINDS))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in expected) for k in secret_scan.KINDS)
        assert {f"{k}:{a}:{b}" for k, a, b in expected} <= set(r.spans.split(",")) | {""}
