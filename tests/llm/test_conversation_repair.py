from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from lodegraph.llm import conversation_repair as C

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NAMES = {"u": "user", "a": "assistant"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def brute(rows):
    """(turn, role, text) after damage: the contract's columns, by a dynamic program that carries whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    blank = duplicate = truncated = 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
        seen.add((role, text))
        faults.append(fault)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {r[0] for r in rows if r[0] is not None}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value
            return True
        return False

    def inserts(table):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, out) in list(table.items()):
                for letter in "ua":
                    if (state, letter) in STEP:
                        changed |= better(table, STEP[state, letter], (cost + 5, audit + "I", (*out, NAMES[letter] + ":")))

    table = {0: (0, "", ())}
    inserts(table)
    for (_, role, text), fault in zip(rows, faults):
        following = {}
        for state, (cost, audit, out) in table.items():
            better(following, state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            if (state, role[:1]) in STEP:
                better(following, STEP[state, role[:1]], (cost + more, audit + "K", (*out, f"{role}:{text}")))
            for letter in "ua":
                if (state, letter) in STEP:
                    better(following, STEP[state, letter], (cost + more + 1, audit + "R", (*out, f"{NAMES[letter]}:{text}")))
        inserts(following)
        table = following
    cost, audit, out = min(table[s][:2] + (table[s][2],) for s in (0, 3) if s in table)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def expected(rows, fate=True):
    after = damaged(rows) if fate else rows
    return sorted(((conv, *brute([r[1:] for r in after if r[0] == conv])) for conv in {r[0] for r in rows}), key=repr)


def got(df):
    return sorted(((r.conv_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=repr)


def conversation(rng, conv, n):
    roles = rng.choice([["system", "user", "assistant"], ["user", "assistant"], ["user"], ["tool", "user", "assistant", "", None, "s", "ape", "U"]])
    texts = ["Yes.", "No!", "why", "", "  ", "Done?\n", " \x0b", "é…", "…?", None, "x" * 5000 + "."] if rng.random() < 0.5 else [f"{w}{i}." for i in range(40) for w in ("a", "b")]
    return [(conv, rng.choice([i, i, i, None, i // 2]), roles[i % len(roles)] if rng.random() < 0.7 else rng.choice(roles), rng.choice(texts)) for i in range(n)]


@pytest.mark.parametrize("seed", range(300))
def test_auction_traces_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    elements = [(rng.choice("suaatx"), rng.random() < 0.2, rng.random() < 0.3, 1) for _ in range(rng.randint(0, 12))]
    elements = [("", True, False, rng.randint(1, 3)) if gone else (i, False, cut, 1) for i, gone, cut, _ in elements]
    table = {0: (0, "")}
    exits = (0, C.NONE, C.NONE, 0)

    def inserts(t):
        for a, b in ((0, 2), (1, 2), (3, 2), (2, 3), (3, 2)):
            if a in t:
                t[b] = min(t.get(b, (C.NONE, "")), (t[a][0] + 5, t[a][1] + "I"))

    inserts(table)
    for initial, gone, cut, times in elements:
        following = {}
        for q, (cost, audit) in table.items():
            options = [(q, 2 * times, "D" * times)]
            if not gone:
                options.append((C.NEXT[q], 1 + 5 * cut, "R"))
                if (q, initial) in STEP:
                    options.append((STEP[q, initial], 5 * cut, "K"))
            for to, more, letters in options:
                following[to] = min(following.get(to, (C.NONE, "")), (cost + more, audit + letters))
        inserts(following)
        table = following
    want = min(table[q] for q in (0, 3) if q in table)
    auction = C.Auction(elements, exits)
    assert auction.settle((0, 0)) == want[0]
    assert "".join(C.Auction(elements, exits).trace(0)) == want[1]
    distances = C.block_distances(elements)
    for q in range(4):
        assert min(distances[4 * q], distances[4 * q + 3]) == C.Auction(elements, exits).settle((0, q))


def test_long_blocks_take_few_steps():
    import time

    rng = random.Random(0)
    for pool in ([("u", False, False, 1)], [("a", False, True, 1)], [("x", False, False, 1)], [("", True, False, 3)], [(i, False, c, 1) for i in "suax" for c in (True, False)]):
        start = time.perf_counter()
        C.block_distances([rng.choice(pool) for _ in range(512)])
        assert time.perf_counter() - start < 10


@pytest.mark.parametrize("bits", [0, 2, 8])
def test_repair_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = [r for conv in range(60) for r in conversation(rng, conv, rng.randint(1, 12))]
    rows += conversation(rng, 1000, 90) + conversation(rng, None, 7) + [(2000, 5, "user", "Again.")] * 30 + [(2001, None, None, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, AT string, block int")
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert got(C.repair(df)) == expected(plain, fate=False)
    messages = {}
    for m in C.repaired_messages(df).collect():
        messages.setdefault(m.conv_id, []).append((m.position, f"{m.role}:{m.text}"))
    digests = {conv: hashlib.sha256("\n".join(t for _, t in sorted(m)).encode()).hexdigest() for conv, m in messages.items()}
    for row in C.repair(df).collect():
        assert row.repaired_sha256 == digests.get(row.conv_id, hashlib.sha256(b"").hexdigest())
    assert C.repair(df.limit(0)).collect() == []


def test_query(spark, tmp_path, sf_dir):
    from lodegraph.llm.queries import op11_conversation_repair

    rng = random.Random(9)
    rows = [r for conv in range(300) for r in conversation(rng, conv, rng.randint(1, 9))] + conversation(rng, 5000, 700) + [(6000 + i, 0, "user", "Gone.") for i in range(60)]
    rows += conversation(rng, None, 5)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert got(op11_conversation_repair(spark, str(tmp_path))) == expected(rows)
    supplied = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_repair(spark, sf_dir)) == expected(supplied)
