"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus-signs, digits, URL schemes and
identifier cues. Deterministic local parsers then expand each anchor to the left and right and
validate what they find: an address grammar around an at-sign, digit chains for cards (Luhn)
and network addresses, dialled numbers after a plus-sign, credentials in a URL after its scheme,
and account numbers after a cue (mod-97 for IBANs, group rules for social security numbers).
After a cue, identifiers are taken one after another as long as each begins within `CUE_REACH` code points of
the cue or of the candidate before it, valid or not ("accounts 12345678, 87654321").
A parser walks the maximal run around its anchor once, so a text costs linear time.

Kinds: email, ip, card and phone are the base; url (credentials in a URL), iban, ssn and account
are added. Spans of a kind don't overlap.

Defined cases: a null or empty text has no spans; texts of any length are whole; rows that repeat a doc_id are scanned apart; an
empty table gives an empty result; other columns of the input are dropped unless named in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodegraph.llm.common import map_batches
from lodegraph.llm.spans import Span, digest, joined

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn", "account")
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}
#: Code points after a cue in which its identifier must begin.
CUE_REACH = 24

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LABEL = LETTERS | DIGITS | {"-"}
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
DIALLED = DIGITS | frozenset(" ().-")

_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_LOCAL_PARTS = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}"),
    "ssn": re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    "account": re.compile(r"(?<![0-9])[0-9]{6,17}(?![0-9])"),
}


@cache
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *sorted(DIGITS), *CUES):
        found.add_word(anchor, anchor)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def expand_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at `at`, not reaching below `floor`."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    end, labels = at, 0
    while True:
        low = high = end + 1
        while high < len(text) and text[high] in LABEL:
            high += 1
        if high == low:
            break
        end, labels = high, labels + 1
        if high >= len(text) or text[high] != ".":
            break
    return (start, end) if labels >= 2 else None


def expand_phone(text: str, at: int) -> tuple[int, int] | None:
    """The dialled number after the plus-sign at `at`."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    high = at + 2
    while high < len(text) and text[high] in DIALLED:
        high += 1
    while high > at + 3 and text[high - 1] not in DIGITS:
        high -= 1
    return (at, high) if high > at + 3 and text[high - 1] in DIGITS else None


def quads(text: str, low: int) -> tuple[list[tuple[int, int]], int]:
    """Address-shaped groups of four in the dotted digit chain that starts at `low`, and its end."""
    chain = _QUADS.match(text, low)
    runs, at = [], low
    for part in chain[0].split("."):
        runs.append((at, at + len(part)))
        at += len(part) + 1
    groups = [runs[i : i + 4] for i in range(0, len(runs) - 3, 4)]
    good = [(g[0][0], g[3][1]) for g in groups if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in g)]
    return good, chain.end()


def expand_url(text: str, at: int) -> tuple[int, int] | None:
    """A URL whose authority holds user:password, from its scheme on; `at` is the colon."""
    start, high = at, at + 3
    while start and (text[start - 1] in LETTERS or text[start - 1] in DIGITS):
        start -= 1
    while high < len(text) and not text[high].isspace() and text[high] not in "/?#\"'<>":
        high += 1
    user, sign, host = text[at + 3 : high].rpartition("@")
    return (start, high) if start < at and sign and host and ":" in user.strip(":") else None


def valid_iban(value: str) -> bool:
    compact = value.replace(" ", "")
    return 15 <= len(compact) <= 34 and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def valid_identifier(text: str, low: int, high: int, kind: str) -> tuple[int, int] | None:
    if kind == "iban":
        while high > low and not valid_iban(text[low:high]):  # letters of a following word may have been taken
            high -= 1
        return (low, high) if high - low >= 15 else None
    if kind == "ssn":
        area, group, serial = text[low:high].split("-")
        return None if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000" else (low, high)
    return low, high


def expand_cue(text: str, end: int, kind: str) -> tuple[list[tuple[int, int]], int]:
    """The identifiers after a cue that ends at `end`, each within CUE_REACH code points of what stands before it, and where the last candidate ends."""
    spans: list[tuple[int, int]] = []
    while found := _LOCAL_PARTS[kind].search(text, end, min(len(text), end + CUE_REACH + 48)):
        if found.start() > end + CUE_REACH:
            break
        span = valid_identifier(text, *found.span(), kind)
        if span:
            spans.append(span)
        end = span[1] if span else found.start() + (2 if kind == "iban" else found.end() - found.start())
    return spans, end


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind without overlap."""
    if not text:
        return []
    spans: list[Span] = []
    done, cued = dict.fromkeys((*KINDS, "chain", "dotted"), 0), dict.fromkeys(CUES.values(), 0)

    def add(kind: str, span: tuple[int, int] | None) -> None:
        if span and span[0] >= done[kind]:
            done[kind] = span[1]
            spans.append((kind, *span))

    for last, anchor in automaton().iter(_lowered(text)):
        if anchor == "@":
            add("email", expand_email(text, last, done["email"]))
        elif anchor in DIGITS:
            if last >= done["chain"]:
                chain = _CHAIN.match(text, last)
                done["chain"] = chain.end()
                digits = chain[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    add("card", chain.span())
            if last >= done["dotted"]:
                good, done["dotted"] = quads(text, last)
                for span in good:
                    add("ip", span)
        elif anchor == "+":
            if last >= done["phone"] and (span := expand_phone(text, last)):
                done["phone"] = span[1]
                if 9 <= sum(c in DIGITS for c in text[slice(*span)]) <= 15:
                    spans.append(("phone", *span))
        elif anchor == "://":
            add("url", expand_url(text, last - 2))
        else:
            kind = CUES[anchor]
            if last + 1 > cued[kind]:
                identifiers, cued[kind] = expand_cue(text, last + 1, kind)
                for span in identifiers:
                    add(kind, span)
    return spans


def scan(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Per row: *keep, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    made = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
    kept = [c for c in keep if c not in made]

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in BASE_KINDS]
        base = pa.array([digest(joined((s for s in spans if s[0] in BASE_KINDS), KINDS)) for spans in found], pa.string())
        text = pa.array([joined(spans, KINDS) for spans in found], pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *counts, base, text], names=[*kept, *made])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string, spans string"])
    return map_batches(docs.select(*dict.fromkeys([*kept, "text"])), look, schema)
