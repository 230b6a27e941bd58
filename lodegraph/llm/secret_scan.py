r"""Secret scanning with a recursive decoding worklist.

A text is the first layer. Each layer is scanned, then unwrapped: percent escapes, and Unicode, octal and
entity escapes, are decoded in place, and base64 runs, also those wrapped over lines (real ones, the two characters of an escaped line end, quoted
lines), are decoded at each
alignment: every stretch of text in their bytes, of one or two bytes a character, and in compressed streams among these, opens a
layer of its own, so a run may be glued to other characters of its class. New layers go on a worklist until none is left; a layer that was seen before with the
same characters from the same places is not opened again, which ends cycles (a compressed stream
may hold itself) and keeps equal content at several places apart. Every layer carries where each
of its characters comes from, so a finding in any layer becomes a span of the text.

Kinds: assign (a keyword, a separator and a value), access (an access key id), hex (a long run of
hexadecimal digits). Findings of the first layer are the base; those of deeper layers are added.

Defined cases: a null or empty text has no spans; rows that repeat a doc_id are scanned apart; an
empty table gives an empty result; other columns are dropped unless named in `keep`; very long texts
are whole. Streams may be nested to any depth, hold several members and inflate to any size: they are
inflated and scanned in pieces of `PIECE` bytes that overlap by `OVERLAP`, so a task's memory is
bounded (their time isn't: a stream takes as long as it is when inflated); only a finding, run or stream inside one that is longer than the overlap may be seen in parts.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from html.entities import html5
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm.common import map_batches
from lodegraph.llm.spans import Span, digest, joined

KINDS = ("assign", "access", "hex")
#: Bytes of a stream that are inflated and scanned at once, and bytes that successive pieces share.
PIECE, OVERLAP = 8_000_000, 1_000_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNITS = (r"\\u\{([0-9A-Fa-f]{1,6})\}", r"\\u([0-9A-Fa-f]{4})", r"\\U([0-9A-Fa-f]{8})", r"\\x([0-9A-Fa-f]{2})", r"&#[xX]([0-9A-Fa-f]{1,6});", r"&#([0-9]{1,7});", r"\\([0-3][0-7]{2})", r"&([A-Za-z][A-Za-z0-9]{1,31};)")
_ONE_ESCAPE = re.compile("|".join(_UNITS))
_ESCAPE = re.compile(f"(?:{'|'.join(u.replace('(', '(?:') for u in _UNITS)})+")
#: The base of the number in each unit; the last one is a name.
_BASES = (16, 16, 16, 16, 16, 10, 8, 0)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Where a run is broken: a line end, or an escaped one, and what quotes or indents the next line.
_BREAK = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t>]*+")
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
_BYTE_ESCAPES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}){8,}")
LEAST_RUN = 16
#: All that findings and runs of deeper layers are made of, and the length of the shortest of them.
_STRETCH = re.compile(rb"[\t-\r\x20-\x7e]{16,}")
#: The same in text of two bytes a character.
_WIDE = re.compile(rb"[\t-\r\x20-\x7e](?:\x00[\t-\r\x20-\x7e]){15,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")


def base_spans(text: str) -> list[Span]:
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [("hex", *m.span()) for m in _HEX.finditer(text)]


class Same(Sequence):
    """One place for every character of a layer."""

    def __init__(self, value: int, length: int):
        self.value, self.length = value, length

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, at):
        if isinstance(at, slice):
            return Same(self.value, len(range(*at.indices(self.length))))
        if not -self.length <= at < self.length:
            raise IndexError(at)
        return self.value


@dataclass
class Layer:
    """Decoded characters and, for each, the span of the whole text that it comes from."""

    text: str
    starts: Sequence[int]
    ends: Sequence[int]

    def outer(self, low: int, high: int) -> tuple[int, int]:
        if isinstance(self.starts, Same) and isinstance(self.ends, Same):
            return self.starts.value, self.ends.value
        return min(self.starts[low:high]), max(self.ends[low:high])

    def key(self) -> tuple:
        """The same for layers with equal characters from equal places."""
        text = sha256(self.text.encode("utf-8", "surrogatepass")).digest()
        places = (p.value if isinstance(p, Same) else sha256(array("q", p)).digest() for p in (self.starts, self.ends))
        return text, len(self.text), *places


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    """Characters of a run of percent escapes with their place in the run."""
    data, out, at = bytes.fromhex(run.replace("%", "")), [], 0
    try:
        for c in data.decode("utf-8"):
            n = len(c.encode())
            out.append((c, 3 * at, 3 * (at + n)))
            at += n
    except UnicodeDecodeError:
        return [(chr(b), 3 * i, 3 * i + 3) for i, b in enumerate(data)]
    return out


def _escapes(run: str) -> list[tuple[str, int, int]]:
    out = []
    for m in _ONE_ESCAPE.finditer(run):
        base = _BASES[m.lastindex - 1]
        if not base:
            out += [(c, *m.span()) for c in html5[m[8]]] if m[8] in html5 else [(m[0][i], m.start() + i, m.start() + i + 1) for i in range(len(m[0]))]
            continue
        code = int(m[m.lastindex], base)
        if out and 0xDC00 <= code < 0xE000 and 0xD800 <= ord(out[-1][0]) < 0xDC00:
            high, low, _ = out.pop()
            out.append((chr(0x10000 + ((ord(high) - 0xD800) << 10) + code - 0xDC00), low, m.end()))
        elif code <= 0x10FFFF:
            out.append((chr(code), *m.span()))
    return [(c if not 0xD800 <= ord(c) < 0xE000 else "�", a, b) for c, a, b in out]


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every run of `pattern` decoded where it stands."""
    text, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        text.append(layer.text[at : m.start()])
        starts += layer.starts[at : m.start()]
        ends += layer.ends[at : m.start()]
        for c, low, high in decode(m[0]):
            text.append(c)
            starts.append(layer.starts[m.start() + low])
            ends.append(layer.ends[m.start() + high - 1])
        at = m.end()
    if not at:
        return None
    text.append(layer.text[at:])
    return Layer("".join(text), [*starts, *layer.starts[at:]], [*ends, *layer.ends[at:]])


def _decompressor(data: bytes):
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and int.from_bytes(data[:2], "big") % 31 == 0):
        return zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of gzip, zlib, bzip2, xz or zstd members that follow each other, a piece at a time, as far as they are sound."""
    while data:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            tool, at = zstandard.ZstdDecompressor().decompressobj(), 0
            try:
                while at < len(data) and not tool.eof:  # a block takes few bytes and holds 128 KB at most
                    yield tool.decompress(data[at : at + 512])
                    at += 512
            except zstandard.ZstdError:
                return
            data = tool.unused_data + data[at:] if tool.eof else b""
            continue
        if (tool := _decompressor(data)) is None:
            return
        try:
            while not tool.eof:
                more = tool.decompress(data, PIECE)
                data = tool.unconsumed_tail if hasattr(tool, "unconsumed_tail") else b""
                if more:
                    yield more
                elif not data:
                    return
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            return
        data = tool.unused_data


def _pieces(data: bytes) -> Iterator[bytes]:
    tail, new, size = b"", [], 0
    for more in _inflated(data):
        new.append(more)
        size += len(more)
        if size >= PIECE:
            piece = b"".join([tail, *new])
            yield piece
            tail, new, size = piece[-OVERLAP:], [], 0
    if size:
        yield b"".join([tail, *new])


def _inner(data: bytes) -> Iterator[bytes]:
    """The pieces of every stream that begins in `data`."""
    for m in _MAGIC.finditer(data):
        yield from _pieces(data[m.start() :])


def _held(data: bytes) -> Iterator[str]:
    """Stretches of text in what the stream at the start of `data` holds, and in streams inside it, to any depth."""
    seen, open_streams = set(), [_pieces(data)]
    while open_streams:
        piece = next(open_streams[-1], None)
        if piece is None:
            open_streams.pop()
        elif (key := sha256(piece).digest()) not in seen:
            seen.add(key)
            for m in _STRETCH.finditer(piece):
                yield m[0].decode("ascii")
            for m in _WIDE.finditer(piece):
                yield m[0][::2].decode("ascii")
            open_streams.append(_inner(piece))


def _escaped_streams(layer: Layer) -> Iterator[Layer]:
    """What compressed streams under percent or byte escapes hold."""
    for pattern, mark in ((_PERCENT, "%"), (_BYTE_ESCAPES, "\\x")):
        for run in pattern.finditer(layer.text) if mark in layer.text else ():
            data = bytes.fromhex(run[0].replace(mark, ""))
            for m in _MAGIC.finditer(data):
                low, high = layer.outer(run.start() + len(mark + "00") * m.start(), run.end())
                for text in _held(data[m.start() :]):
                    yield Layer(text, Same(low, len(text)), Same(high, len(text)))


def _runs(text: str) -> Iterator[tuple[str, Sequence[int]]]:
    """Base64 runs with the place of each character: those within a line, and those wrapped over lines."""
    for m in _BASE64.finditer(text):
        run = m[0].rstrip("=")
        yield run, range(m.start(), m.start() + len(run))
    for m in _WRAPPED.finditer(text) if "\n" in text or "\\n" in text else ():
        places, at = [], m.start()
        for gap in _BREAK.finditer(text, *m.span()):
            places += range(at, gap.start())
            at = gap.end()
        places += range(at, at + len(text[at : m.end()].rstrip("=")))
        if len(places) >= LEAST_RUN:
            yield "".join([text[i] for i in places]), places


def _unwrapped(layer: Layer, run: str, places: Sequence[int]) -> Iterator[Layer]:
    """Layers inside a base64 run, tried at each alignment: its stretches of text, and what compressed streams in it hold."""
    run = run.replace("-", "+").replace("_", "/")
    for shift in range(min(4, len(run))):
        part = run[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        at = places[shift : shift + len(part)]
        for m in _STRETCH.finditer(data):
            quads = [4 * (i // 3) for i in range(*m.span())]
            yield Layer(m[0].decode("ascii"), [layer.starts[at[q]] for q in quads], [layer.ends[at[min(q + 4, len(at)) - 1]] for q in quads])
        for m in _WIDE.finditer(data):
            firsts = range(*m.span(), 2)
            starts = [layer.starts[at[4 * (i // 3)]] for i in firsts]
            ends = [layer.ends[at[min(4 * (min(i + 1, m.end() - 1) // 3) + 4, len(at)) - 1]] for i in firsts]
            yield Layer(m[0][::2].decode("ascii"), starts, ends)
        for m in _MAGIC.finditer(data):
            if m.start() % 3:
                continue
            low = high = None
            for text in _held(data[m.start() :]):
                if low is None:
                    rest = range(4 * (m.start() // 3), len(at))
                    low, high = min(layer.starts[at[i]] for i in rest), max(layer.ends[at[i]] for i in rest)
                yield Layer(text, Same(low, len(text)), Same(high, len(text)))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and the spans that deeper layers add."""
    if not text:
        return [], []
    base, added = base_spans(text), set()
    if "%" not in text and "\\" not in text and "&" not in text and not _BASE64.search(text) and not _WRAPPED.search(text):
        return base, []
    work = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    seen = {work[0].key()}
    while work:
        layer = work.pop()
        opened = [_in_place(layer, _PERCENT, _percent) if "%" in layer.text else None, _in_place(layer, _ESCAPE, _escapes) if "\\" in layer.text or "&" in layer.text else None]
        inside = (inner for run, places in _runs(layer.text) for inner in _unwrapped(layer, run, places))
        for inner in chain(opened, _escaped_streams(layer), inside):
            if inner is None or (key := inner.key()) in seen:
                continue
            seen.add(key)
            work.append(inner)
            added.update((k, *inner.outer(a, b)) for k, a, b in base_spans(inner.text))
    return base, sorted(added - set(base))


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row: *keep, n_assign, n_access, n_hex (base spans), base_sha256, spans, n_decoded."""
    made = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_decoded"]
    kept = [c for c in keep if c not in made]

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
        columns = [
            pa.array([digest(joined(base, KINDS)) for base, _ in found], pa.string()),
            pa.array([joined([*base, *added], KINDS) for base, added in found], pa.string()),
            pa.array([len(added) for _, added in found], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *counts, *columns], names=[*kept, *made])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"n_{k} long" for k in KINDS), "base_sha256 string, spans string, n_decoded long"])
    return map_batches(docs.select(*dict.fromkeys([*kept, "text"])), look, schema)
