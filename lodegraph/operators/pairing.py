"""Every pair of a bucket's claims, whatever the bucket's size, met in cells of bounded size.

A bucket is cut into blocks. A cell holds two of its blocks, or one block with itself; each pair of claims meets in just one
cell, and cells, not buckets, are dealt over the tasks. In a cell the words that two claims have in common are counted from
the claims that hold each word, so that a pair without a common word costs next to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import broadcast_if_small, ensure_importable, tasks_for

#: Claims of a block; a bucket of at most so many is one block, and so one cell.
BLOCK = 512
#: Pairs that a task compares, where pairs decide how many tasks there are.
TASK_PAIRS = 20_000_000
#: Pairs, and words that pairs share, which are held at once.
HELD_PAIRS, HELD_MATCHES = 1 << 18, 1 << 21

#: Classes by number, in the order of precedence.
CLASSES = ("incomparable", "direct_conflict", "modality_divergence", "equivalent", "compatible_partial", "referent_ambiguity")


def cells(claims: DataFrame, keys: list[str], sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (*keys, _i, _j, _block, id, polarity, modality, objects): each claim once in every cell of its block. A cell is in one task, its rows together.

    `sizes` has (*keys, n, pairs) of the buckets to compare, materialised. A claim's block comes from its place in the table, so that claims that are alike spread as well.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    pairs, copies = sizes.agg(F.sum("pairs"), F.sum(F.col("n") * blocks)).head()
    tasks = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks_for(copies or 0), -(-(pairs or 0) // TASK_PAIRS))
    placed = claims.dropna(subset=keys).select(*keys, "id", "polarity", "modality", F.array_distinct("objects").alias("objects"), F.monotonically_increasing_id().alias("_at"))
    known = placed.join(broadcast_if_small(sizes.where(F.col("n") > block).select(*keys, blocks.alias("_blocks"))), keys, "left")
    k = F.coalesce("_blocks", F.lit(1))
    own = known.withColumn("_block", F.when(k == 1, 0).otherwise(F.pmod(F.xxhash64("_at"), k)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), k - 1)))
    cell = own.select(*keys, F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"), "_block", "id", "polarity", "modality", "objects")
    return cell.repartition(tasks, *keys, "_i", "_j").sortWithinPartitions(*keys, "_i", "_j")


def _starts(rows: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Positions after the first at which a value of `columns` changes."""
    changed = np.zeros(max(rows.num_rows - 1, 0), bool)
    for c in columns:
        changed |= pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed) + 1


def _before(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values to equal numbers; null to -1."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def shared_words(objects: pa.ListArray, cell: np.ndarray, is_left: np.ndarray, is_right: np.ndarray, first: np.ndarray, place: np.ndarray, pairs: int) -> np.ndarray:
    """Words in common of each pair of a left and a right claim of one cell; pair `first[left] + place[right]`."""
    lengths = pc.list_value_length(objects).fill_null(0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(cell)), lengths)
    words = objects.flatten().dictionary_encode(null_encoding="encode")
    word = cell[owner] * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False)
    by_word = np.argsort(word, kind="stable")
    word, owner = word[by_word], owner[by_word]
    run = np.cumsum(np.append(False, word[1:] != word[:-1])) if len(word) else word
    right = owner[is_right[owner]]
    held = np.bincount(run[is_right[owner]], minlength=run[-1] + 1 if len(run) else 0)
    left, left_run = owner[is_left[owner]], run[is_left[owner]]
    n, begins = held[left_run], _before(held)[left_run]
    common, upto = np.zeros(pairs, np.int64), np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HELD_MATCHES, "right")))
        m = n[a:b]
        at = np.arange(m.sum()) + np.repeat(begins[a:b] - _before(m), m)
        common += np.bincount(np.repeat(first[left[a:b]], m) + place[right[at]], minlength=pairs)
        a = b
    return common


def compared(rows: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of whole cells: positions of the claims with the lesser and the greater id, and the numbers of their classes. Claims of one id, or of none, are no pair."""
    n, sizes = rows.num_rows, np.diff(np.append(starts, rows.num_rows))
    cell = np.repeat(np.arange(len(starts)), sizes)
    i, j, block = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_j", "_block"))
    is_left, is_right = block == i, block == j
    lefts, rights = np.flatnonzero(is_left), np.flatnonzero(is_right)
    n_right = np.bincount(cell[rights], minlength=len(starts))
    begins = _before(n_right)
    place = np.zeros(n, np.int64)
    place[rights] = np.arange(len(rights)) - begins[cell[rights]]
    met = n_right[cell[lefts]]
    first = np.zeros(n, np.int64)
    first[lefts] = _before(met)
    pairs = int(met.sum())
    left = np.repeat(lefts, met)
    right = rights[np.arange(pairs) - np.repeat(first[lefts] - begins[cell[lefts]], met)]
    common = shared_words(rows.column("objects"), cell, is_left, is_right, first, place, pairs)

    ids = rows.column("id")
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    rank[ids.is_null().to_numpy(zero_copy_only=False)] = -1
    a, b = rank[left], rank[right]
    keep = (a >= 0) & (b >= 0) & np.where((i == j)[left], a < b, a != b)
    left, right, common, turned = left[keep], right[keep], common[keep], (a > b)[keep]

    lengths = pc.list_value_length(rows.column("objects")).fill_null(0).to_numpy(zero_copy_only=False)
    nl, nr = lengths[left], lengths[right]
    differ = lambda c: (c[left] != c[right]) & (c[left] >= 0) & (c[right] >= 0)
    tests = [common == 0, differ(_codes(rows.column("polarity"))), differ(_codes(rows.column("modality"))), (common == nl) & (common == nr), common * 2 >= np.minimum(nl, nr)]
    return np.where(turned, right, left), np.where(turned, left, right), np.select(tests, range(5), 5)


def met(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of whole cells with what `compared` says of them, some HELD_PAIRS pairs at once, from batches that come in the order of cells."""

    def groups(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[tuple]:
        ends = np.append(starts[1:], rows.num_rows)
        upto = np.cumsum((ends - starts) ** 2)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + HELD_PAIRS, "right")))
            part = rows.slice(starts[a], ends[b - 1] - starts[a])
            yield part, *compared(part, starts[a:b] - starts[a])
            a = b

    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        starts = np.append(0, _starts(rows, [*keys, "_i", "_j"]))
        yield from groups(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1])
    if held is not None:
        yield from groups(held, np.array([0]))


def classed(cell: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (*keys, left_id, right_id, class) of every pair of the claims in `cells`."""
    ensure_importable(cell.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in cell.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, right, number in met(batches, keys):
            columns = [*(rows.column(k).take(pa.array(left)) for k in keys), rows.column("id").take(pa.array(left)), rows.column("id").take(pa.array(right)), pa.array(CLASSES).take(pa.array(number))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "left_id", "right_id", "class"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*((k, kinds[k]) for k in keys), ("left_id", kinds["id"]), ("right_id", kinds["id"]), ("class", "string")])
    return cell.mapInArrow(run, schema)


def counted(cell: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (class, n) of all pairs of the claims in `cells`; a task counts its own pairs, none becomes a row."""
    ensure_importable(cell.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(CLASSES), np.int64)
        for _, _, _, number in met(batches, keys):
            total += np.bincount(number, minlength=len(CLASSES))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(CLASSES).take(pa.array(found)), pa.array(total[found])], names=["class", "n"])

    return cell.mapInArrow(run, "class string, n long").groupBy("class").agg(F.sum("n").alias("n"))
