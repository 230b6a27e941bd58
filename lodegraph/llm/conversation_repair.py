"""Cheapest repair of a conversation's structure by an auction shortest-path algorithm.

A conversation has the form `(s?(ua)+)?` in the initials of its roles. Its rows are read in order; a node of
the lattice is (rows read, state), the states being: nothing yet (0), after the system row (1), after a user row (2),
after an assistant row (3). An arc is an edit: Keep costs 0, Rerole 1, Delete 2, Insert 5, and a truncated row that
isn't deleted 5 more; blank and repeated rows can only be deleted.

The auction holds a price per node, never above the node's distance to the end, and one path. The path's last node
either raises its price to its best arc's cost plus that arc's far price and leaves the path, or the path is extended
over that arc, until the end is reached; then all prices on the path are distances. Prices begin at the sum of
each remaining row's least cost, so few have to rise. The cheapest edits whose initials are least in ASCII order are then traced from the first node over the
tight arcs (price = cost + far price), least letter first; a far node whose price isn't proven yet is first settled by
a further auction, which starts from the prices reached.

On Spark, rows are ordered by one range sort and cut into blocks of at most `BLOCK` distinct rows, equal rows counting
as one with a count, so neither a conversation nor a row that fills a third of the table meets in one group. Conversations of several blocks are solved in three steps: each block gives
its distances from state to state, these small tables are added up backwards along the conversation to the prices at each
block's end, and each block is traced with those prices for each state it may begin in. Last, rows stream by conversation in order, with a state of
constant size besides the audit; this pass is needed because the digest of a conversation is one hash over its whole text.

Defined cases: a null role or text is read as one space; a null conv_id is a conversation; null turns come first and take no part
in gaps; rows with equal turns are ordered by role, then text; equal rows are repeats; an empty role can't be kept; very long texts are carried whole; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import BATCH_BYTES, bound_batches
from lodegraph.runtime import broadcast_if_small, ensure_importable, written

#: Bits of the number of distinct rows in a block.
BLOCK_BITS = 8
NONE = 1 << 60
#: The state after a user or assistant row that is inserted or reroled in a state.
NEXT = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
KEEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: A conversation ends well with nothing in it or after an assistant row.
END = (0, NONE, NONE, 0)
_SPACE = " \t\n\x0b\f\r"

#: A row of the lattice: initial, must it go, is it truncated, how many times.
Element = tuple[str, bool, bool, int]


class Auction:
    """Prices of a block's lattice towards its end, where state q costs exits[q] more."""

    def __init__(self, elements: list[Element], exits: Iterable[int]):
        self.elements, self.exits = elements, tuple(exits)
        floor = min(self.exits)
        dead = (False, min(self.exits[1:]) == NONE, min(self.exits[2:]) == NONE, min(self.exits[2:]) == NONE)
        level = lambda: [NONE if d else floor for d in dead]
        self.prices = [level()]
        for initial, gone, cut, times in reversed(elements):
            if gone or cut:
                floor += DELETE * times
            elif initial not in ("s", "u", "a"):
                floor += REROLE
            self.prices.append(level())
        self.prices.reverse()
        self.exact: set[tuple[int, int]] = set()

    def arcs(self, at: int, state: int) -> list[tuple[str, int, tuple[int, int] | None]]:
        """(initials, cost, far node), least initials first; the end is None."""
        following = NEXT[state]
        if at == len(self.elements):
            out = [("", self.exits[state], None)] if self.exits[state] < NONE else []
            return [*out, ("I", INSERT, (at, following))]
        initial, gone, cut, times = self.elements[at]
        out = [("D" * times, DELETE * times, (at + 1, state)), ("I", INSERT, (at, following))]
        if not gone:
            more = TRUNCATED if cut else 0
            if kept := KEEPS.get((initial, state)):
                out.append(("K", more, (at + 1, kept)))
            out.append(("R", REROLE + more, (at + 1, following)))
        return out

    def settle(self, node: tuple[int, int]) -> int:
        """The node's distance: extend and contract a path from it until it meets the end or a node that is settled."""
        path, prices, exact = [node], self.prices, self.exact
        while True:
            at, state = last = path[-1]
            if last in exact:
                exact.update(path)
                return prices[node[0]][node[1]]
            best, far = NONE, None
            for _, cost, to in self.arcs(at, state):
                total = cost if to is None else cost + prices[to[0]][to[1]]
                if total < best:
                    best, far = total, to
            if prices[at][state] < best:
                prices[at][state] = best
                if len(path) > 1:
                    path.pop()
            elif far is None:
                exact.update(path)
                return prices[node[0]][node[1]]
            else:
                path.append(far)

    def trace(self, state: int) -> list[str]:
        """Initials of the cheapest edits from `state` on, the ASCII-least of them, one string per element; what is inserted at the end is the last string."""
        node: tuple[int, int] | None = (0, state)
        out = [""] * (len(self.elements) + 1)
        price = self.settle(node)
        while node is not None:
            at, _ = node
            for letters, cost, far in self.arcs(*node):
                rest = price - cost
                if far is None:
                    tight = rest == 0
                else:
                    tight = self.prices[far[0]][far[1]] <= rest and self.settle(far) == rest
                if tight:
                    out[at] += letters
                    node, price = far, rest
                    break
        return out


def block_distances(elements: list[Element]) -> list[int]:
    """16 distances, from state (row) to state (column) at the block's end."""
    out = [NONE] * 16
    begins = any(initial == "s" and not gone for initial, gone, _, _ in elements)
    for to in range(4):
        auction = Auction(elements, (0 if q == to else NONE for q in range(4)))
        for state in range(4):
            if state == to or to >= 2 or (state, to) == (0, 1) and begins:
                out[4 * state + to] = auction.settle((0, state))
    return out


def _elements(rows: Iterable[dict]) -> Iterator[tuple[int, Element]]:
    """(row, element): the first of equal rows, and those that must go."""
    for k, r in enumerate(rows):
        free = 1 if r["first"] and not r["blank"] and r["copies"] else 0
        if free:
            yield k, (r["role"][:1], False, r["cut"], 1)
        if r["copies"] > free:
            yield k, ("", True, False, r["copies"] - free)


def row_edits(rows: list[dict], exits: Iterable[int], states: Iterable[int]) -> list[list[str | None]]:
    """For each row its edits' initials, by the state in which the block begins."""
    placed = list(_elements(rows))
    auction = Auction([e for _, e in placed], exits)
    out: list[list[str | None]] = [[None] * 4 for _ in rows]
    for state in states:
        letters = auction.trace(state)
        for edits in out:
            edits[state] = ""
        for (k, _), some in zip(placed, letters, strict=False):
            out[k][state] += some
        out[-1][state] += letters[-1]
    return out


class Repaired:
    """One conversation, row by row: its counts and its repaired rows."""

    def __init__(self, conv_id):
        self.conv_id, self.state, self.entry, self.block = conv_id, 0, 0, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.turns = self.length = 0
        self.first_turn = self.last_turn = self.before = None
        self.audit: list[str] = []
        self.hash = sha256()

    def take(self, r: dict) -> list[tuple[str, str, str]]:
        """Reads a row and returns the rows that stand for it: role, text, edit."""
        if r["block"] != self.block:
            self.block, self.entry = r["block"], self.state
        copies, out, left = r["copies"], [], 0
        free = 1 if r["first"] and not r["blank"] and copies else 0
        if copies:
            if r["blank"]:
                self.blank += copies
            else:
                self.duplicate += copies - free
                self.truncated += bool(free and r["cut"])
            initial = r["role"][:1]
            self.illegal += (self.before is not None and self.before + initial not in ("su", "ua", "au")) + copies - 1
            self.before = initial
            if (turn := r["turn"]) is not None:
                self.turns += turn != self.last_turn
                self.first_turn = turn if self.first_turn is None else self.first_turn
                self.last_turn = turn
        letters = r["edits"][self.entry]
        self.audit.append(letters)
        for edit in letters:
            if edit == "D":
                self.cost += DELETE
                left += 1
                continue
            if edit == "K":
                self.state, role, text = KEEPS[r["role"][:1], self.state], r["role"], r["text"]
            else:
                self.state = NEXT[self.state]
                role, text = ROLES[self.state], r["text"] if edit == "R" else ""
            self.cost += {"K": 0, "R": REROLE, "I": INSERT}[edit] + (TRUNCATED if edit != "I" and r["cut"] else 0)
            self.hash.update(f"{chr(10) if self.length else ''}{role}:{text}".encode())
            self.length += 1
            out.append((role, text, edit))
        return out

    def summary(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        size = max(1, int(batch.num_rows * BATCH_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, size):
            yield from batch.slice(at, size).to_pylist()


def _streamed(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """`fn` over a partition's rows in order; results leave in small batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ensure_importable(df.sparkSession)
    bound_batches(df.sparkSession)
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        held, size = [], 0
        for row in fn(_rows(batches)):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str)) + 100
            if size > BATCH_BYTES:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return df.mapInArrow(run, schema)


def ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their counts in `copies` (0: a row that only names its conversation), numbered in order by `at`, with faults and blocks."""
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    distinct = known.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    numbered = written(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    digest = F.sha2(F.col("text"), 256)
    firsts = numbered.where("copies > 0").groupBy("conv_id", "role", digest).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    return numbered.join(firsts, "at", "left").select(
        "conv_id", "at", F.shiftright("at", BLOCK_BITS).alias("block"), "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def _together(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*order)


def _exit_prices(rows: DataFrame, conv: str) -> DataFrame:
    """Of conversations that span blocks: the price of each state at each block's end."""
    spans = rows.groupBy("conv_id").agg(F.min("block").alias("_low"), F.max("block").alias("_high")).where("_low < _high").select(F.col("conv_id").alias("_conv"))
    narrow = rows.select("conv_id", "block", "at", F.left("role", F.lit(1)).alias("role"), "copies", "first", "blank", "cut")
    wide = narrow.join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi")

    def distances(found: Iterator[dict]) -> Iterator[tuple]:
        for (conv_id, block), group in groupby(found, key=lambda r: (r["conv_id"], r["block"])):
            yield conv_id, block, block_distances([e for _, e in _elements(group)])

    def backwards(found: Iterator[dict]) -> Iterator[tuple]:
        for conv_id, group in groupby(found, key=lambda r: r["conv_id"]):
            prices = list(END)
            for r in group:
                yield conv_id, r["block"], prices
                table = r["distances"]
                prices = [min(NONE, *(table[4 * q + to] + prices[to] for to in range(4))) for q in range(4)]

    tables = _streamed(_together(wide, ["conv_id", "block"], ["conv_id", "block", "at"]), distances, f"conv_id {conv}, block long, distances array<long>")
    return _streamed(_together(tables, ["conv_id"], ["conv_id", F.col("block").desc()]), backwards, f"conv_id {conv}, block long, exits array<long>")


def edited(rows: DataFrame) -> DataFrame:
    """`ordered` rows with `edits`: initials by the state in which the row's block begins."""
    kinds = dict(rows.dtypes)
    exits = written(_exit_prices(rows, kinds["conv_id"])).select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "exits")
    priced = rows.join(broadcast_if_small(exits), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left").drop("_conv", "_block")
    names = [c for c in rows.columns if c != "first"]

    def solve(found: Iterator[dict]) -> Iterator[tuple]:
        for _, group in groupby(found, key=lambda r: (r["conv_id"], r["block"])):
            held = list(group)  # at most a block
            spanning = held[0]["exits"] is not None
            for r, edits in zip(held, row_edits(held, held[0]["exits"] or END, range(4) if spanning else (0,)), strict=True):
                yield (*(r[c] for c in names), r["first"], edits)

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "first boolean, edits array<string>"])
    return _streamed(_together(priced, ["conv_id", "block"], ["conv_id", "block", "at"]), solve, schema)


def _read(rows: DataFrame) -> DataFrame:
    found = written(ordered(rows))
    return _together(edited(found), ["conv_id"], ["conv_id", "at"])


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, cost, audit and the digest of the repaired rows.

    `rows` has conv_id, turn, role, text; a column `copies` may say how often a row stands there, 0 for
    a row that only names its conversation.
    """

    def read(found: Iterator[dict]) -> Iterator[tuple]:
        for conv_id, group in groupby(found, key=lambda r: r["conv_id"]):
            one = Repaired(conv_id)
            for r in group:
                one.take(r)
            yield one.summary()

    conv = dict(rows.dtypes)["conv_id"]
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _streamed(_read(rows), read, f"conv_id {conv}, {counts}, audit string, repaired_sha256 string")


def repaired_messages(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text, edit (K, R or I)."""

    def read(found: Iterator[dict]) -> Iterator[tuple]:
        for conv_id, group in groupby(found, key=lambda r: r["conv_id"]):
            one, position = Repaired(conv_id), 0
            for r in group:
                for role, text, edit in one.take(r):
                    yield conv_id, position, role, text, edit
                    position += 1

    conv = dict(rows.dtypes)["conv_id"]
    return _streamed(_read(rows), read, f"conv_id {conv}, position long, role string, text string, edit string")
