"""Near-duplicate join on word shingles by chosen paths.

Each text is the set of its five-word shingles. Texts with equal sets are collapsed first. Every
set has a MinHash signature, whose coordinates are tokens that similar sets share. A run starts
with all sets at one node; a node samples `TOKENS` coordinates, and each set moves to the children
that hold its tokens. A node of few sets is a bucket: its pairs are compared by signature, and
those that may be similar are tied.

A larger node's sets are first compared with one of them, its hub. What is within two thresholds'
distance of the hub is tied to it, so pairs among those sets will be verified and need no more
splitting. Sets as near to the hub as the threshold leave the node, since whatever is similar to
them has been tied. The others are split further only for the sake of the sets outside that
distance: a node without such sets ends, and one with no more than a bucket of them ends by
comparing these with the rest, chunk by chunk. Groups of near-copies thus end where they stand,
whatever their size. Runs are repeated until the chance that a pair at the threshold was never tied
is at most 1 - `RECALL`, even if its nodes stay large down to `DEPTH`; since runs draw from one
signature, that chance is an average over the number of coordinates that the pair shares
(`missed`). A node that is still large at `DEPTH` has all its members tied to its hub.

Ties only propose clusters. Each cluster is then verified exactly: every pair of its sets is
counted by blocks of bounded size, so a very large cluster is spread over many tasks, and no pairs
leave a task: only link counts and a spanning forest. Components of exact links are the classes.

Words are what white space separates, in lower case; a text of fewer than five words is one
shingle. Texts of any length are whole. Defined cases: a null text, or one without a word, is a class of its own; rows that
repeat a doc_id are separate documents; of equal rows one stays; a null doc_id is carried; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import BATCH_BYTES, bound_batches, map_batches, text_key
from lodegraph.operators.components import connected_components
from lodegraph.runtime import broadcast_if_small, checkpoint, discard, ensure_importable, written

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.999
COORDINATES = 64
#: Coordinates that a node samples: a pair at the threshold is expected to stay together 1.6 times.
TOKENS = 2
#: Sets of a bucket. Comparing all its pairs takes some 30 microseconds a set, less than a further level of the paths does.
BUCKET = 512
#: Sets of a large node that are compared at once with the few outside its hub's distance.
CHUNK = 512
#: Word hashes that a worker remembers; beyond this it forgets all and starts anew.
REMEMBERED = 200_000
DEPTH = 10
#: Standard deviations that a signature may fall short of the threshold before a tie is refused.
SLACK = 4.0
#: Sets, and bytes of text, of one block of a cluster.
BLOCK_SETS, BLOCK_BYTES = 1024, 16_000_000

_U64 = np.uint64
_ODD = [_U64(0x9E3779B97F4A7C15), _U64(0xC2B2AE3D27D4EB4F), _U64(0x165667B19E3779F9), _U64(0xD6E8FEB86659FD93), _U64(0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads all bits of 64-bit words."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, _U64)
    if len(_WORDS) > REMEMBERED:
        _WORDS.clear()
    hashed = np.fromiter(map(_WORDS.__getitem__, words), _U64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, _U64(len(words) if len(words) < width else width), dtype=_U64)
    for i in range(min(width, len(words))):
        out = mixed(out * _ODD[i % len(_ODD)] + hashed[i : i + n])
    return np.unique(out)


_SEEDS = mixed(np.arange(1, COORDINATES + 1, dtype=_U64) * _ODD[0])


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash: per coordinate the least 32-bit value over the set."""
    out = np.full(COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for low in range(0, len(hashes), 4096):
        part = hashes[low : low + 4096]
        out = np.minimum(out, (((part[None, :] ^ _SEEDS[:, None]) * _ODD[1]) >> _U64(32)).min(1).astype(np.uint32))
    return out


def signed_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, row_key, set_id (128 bits; null without words), sig, size."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        import xxhash

        ids, sigs, sizes = [], [], []
        for text in batch.column("text").to_pylist():
            hashes = shingle_hashes(text, width)
            sizes.append(len(text or ""))
            ids.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            sigs.append(signature(hashes).tobytes() if len(hashes) else None)
        columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "set_id", "sig", "size"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", text_key(F.col("text")).alias("row_key"), "text"), sign, f"doc_id {kind}, row_key long, set_id binary, sig binary, size long")


def chosen_coordinates(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two coordinates that each node (a path hash) samples."""
    drawn = mixed(paths * _ODD[2] + _ODD[3])
    first = (drawn % _U64(COORDINATES)).astype(np.int64)
    return first, (first + 1 + (mixed(mixed(drawn)) % _U64(COORDINATES - 1)).astype(np.int64)) % COORDINATES


def root_coordinates(runs: int, seed: int = 0) -> np.ndarray:
    """The coordinates that the roots of all runs sample, all different."""
    return np.argsort(mixed((np.arange(COORDINATES, dtype=_U64) + _U64(1 + 1000 * seed)) * _ODD[4]))[: TOKENS * runs]


def child_paths(paths: np.ndarray, sigs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The nodes that sets with these signatures move to from `paths` by the tokens at coordinates `at`."""
    token = sigs[np.arange(len(sigs)), at].astype(_U64) | at.astype(_U64) << _U64(32)
    return mixed(mixed(paths) * _ODD[4] + token)


def missed(runs: int, threshold: float = THRESHOLD, depth: int = DEPTH) -> float:
    """The chance that a pair at the threshold isn't tied by `runs` runs if its nodes stay large down to `depth`.

    All runs draw from one signature: given how many coordinates the pair shares, runs are independent.
    """
    n, out = COORDINATES, 0.0
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / n)
    for k in range(n + 1):
        gone = 0.0
        none, both = (n - k) * (n - k - 1) / (n * (n - 1)), k * (k - 1) / (n * (n - 1))
        for _ in range(depth):
            gone = none + (1 - none - both) * gone + both * gone * gone
        out += math.comb(n, k) * threshold**k * (1 - threshold) ** (n - k) * (gone**runs if k / n >= least else 1.0)
    return out


def runs_needed(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """The fewest runs after which a pair at the threshold has been tied with probability `recall`."""
    for runs in range(1, COORDINATES // TOKENS + 1):
        if missed(runs, threshold, depth) <= 1 - recall:
            return runs
    raise ValueError(f"a recall of {recall} is out of reach of {COORDINATES} coordinates")


def first_nodes(sets: DataFrame, runs: int, seed: int = 0) -> DataFrame:
    """Rows (path, set_id) of the first level of all runs, from rows (set_id, sig)."""
    coordinates = root_coordinates(runs, seed)

    def start(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        root = np.zeros(len(sigs), _U64)
        paths = [child_paths(root, sigs, np.full(len(sigs), c)).view(np.int64) for c in coordinates]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(paths)), pa.concat_arrays([batch.column("set_id")] * len(paths))], names=["path", "set_id"])

    return map_batches(sets.select("set_id", "sig"), start, "path long, set_id binary")


def next_nodes(nodes: DataFrame) -> DataFrame:
    """Rows (path, set_id, sig) of the next level from those of a level."""

    def descend(batch: pa.RecordBatch) -> pa.RecordBatch:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        paths = np.asarray(batch.column("path")).view(_U64)
        out = [child_paths(paths, sigs, at).view(np.int64) for at in chosen_coordinates(paths)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), *(pa.concat_arrays([batch.column(c)] * len(out)) for c in ("set_id", "sig"))], names=["path", "set_id", "sig"])

    return map_batches(nodes.select("path", "set_id", "sig"), descend, "path long, set_id binary, sig binary")


def _forest(parent: dict, pairs: Iterator[tuple]) -> None:
    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    for x in parent:
        parent[x] = root(x)


def least_tied(near: np.ndarray) -> np.ndarray:
    """The least member of each member's component, from a symmetric matrix of ties."""
    n = len(near)
    least, before = np.where(near, np.arange(n), n).min(1), np.arange(n)
    least = np.minimum(least, before)
    while (least != before).any():
        before = least
        least = np.minimum(least, np.where(near, least, n).min(1))
        least = least[least]
    return least


def shared_coordinates(sigs: np.ndarray) -> np.ndarray:
    """How many coordinates the signatures of each two sets share."""
    out = np.zeros((len(sigs), len(sigs)), dtype=np.uint8)
    for column in np.ascontiguousarray(sigs.T):
        out += column[:, None] == column[None, :]
    return out


def bucket_ties(rows: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Ties (src, dst) within buckets (rows of bounded number with equal `keys`; set_id, sig), by signature.

    A task streams its buckets in order and holds one at a time.
    """
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / COORDINATES)
    ensure_importable(rows.sparkSession)
    bound_batches(rows.sparkSession)

    def compare(ids: list[bytes], sigs: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        table = np.frombuffer(b"".join(sigs), dtype=np.uint32).reshape(-1, COORDINATES)
        for i, p in enumerate(least_tied(shared_coordinates(table) >= least * COORDINATES).tolist()):
            if i != p:
                yield ids[i], ids[p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sigs, out = None, [], [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t[k] for t in out], pa.binary()) for k in (0, 1)], names=["src", "dst"])

        for batch in batches:
            for *own, set_id, sig in zip(*(batch.column(c).to_pylist() for c in (*keys, "set_id", "sig")), strict=True):
                if own != key:
                    if len(ids) > 1:
                        out += compare(ids, sigs)
                    key, ids, sigs = own, [], []
                ids.append(set_id)
                sigs.append(sig)
            if len(out) > 10_000:
                yield made()
                out = []
        if len(ids) > 1:
            out += compare(ids, sigs)
        yield made()

    return rows.select(*keys, "set_id", "sig").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "src binary, dst binary")


def hub_distances(members: DataFrame) -> DataFrame:
    """Rows (path, set_id, sig, hub_id, near) from (path, set_id, sig, hub): how much of the hub's signature a set shares."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        hubs = batch.column("hub").to_pylist()
        own = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
        other = np.frombuffer(b"".join(h["sig"] for h in hubs), dtype=np.uint32).reshape(-1, COORDINATES)
        columns = [*(batch.column(c) for c in ("path", "set_id", "sig")), pa.array([h["set_id"] for h in hubs], pa.binary()), pa.array((own == other).mean(1))]
        return pa.RecordBatch.from_arrays(columns, names=["path", "set_id", "sig", "hub_id", "near"])

    return map_batches(members, compare, "path long, set_id binary, sig binary, hub_id binary, near double")


def settle_large(large: DataFrame, threshold: float, bucket: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """Ties of large nodes (path, set_id, sig) to their hubs, and what stays of those that hold sets outside their hub's distance, if any.

    What stays: rows (path, set_id, sig, far, n, n_far), without sets as near to the hub as the threshold.
    """
    twice = max(0.0, 2 * threshold - 1)
    reach = twice - SLACK * math.sqrt(twice * (1 - twice) / COORDINATES)
    hubs = checkpoint(large.groupBy("path").agg(F.min(F.struct("set_id", "sig")).alias("hub")))
    compared = written(hub_distances(large.join(broadcast_if_small(hubs), "path").select("path", "set_id", "sig", "hub")))
    within = compared.where("set_id <> hub_id") if last else compared.where((F.col("near") >= reach) & (F.col("set_id") != F.col("hub_id")))
    ties = within.select(F.col("set_id").alias("src"), F.col("hub_id").alias("dst"))
    if last:
        return ties, None
    loose = compared.where(F.col("near") < threshold).select("path", "set_id", "sig", (F.col("near") < reach).alias("far"))
    sizes = checkpoint(loose.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_if("far").alias("n_far")).where("n_far > 0"))
    return ties, written(loose.join(broadcast_if_small(sizes), "path"))


def fringes(rest: DataFrame, bucket: int) -> DataFrame:
    """Buckets (path, chunk, set_id, sig) of nodes with few far sets: these beside each chunk of the others."""
    fringed = rest.where(F.col("n_far") <= bucket).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    near = fringed.where("NOT far").select("path", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int").alias("chunk"), "set_id", "sig")
    beside = fringed.where("far").select("path", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "set_id", "sig")
    return near.union(beside)


def candidate_ties(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int | None = None, depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """Ties (materialised) between sets (materialised; set_id, sig) that met on a chosen path; one may be listed more than once.

    Only the first level is joined with the signatures; later ones, which hold what is left of
    large nodes alone, carry them. The buckets of all levels are compared at once, at the end.
    """
    bucket, nodes = bucket or BUCKET, written(first_nodes(sets, runs_needed(threshold, recall, depth), seed))
    buckets, ties, kept = [], [], []
    for level in range(1, depth + 1):
        counts = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(nodes.join(counts, "path"))
        discard(nodes)
        small, large = sized.where(F.col("n") <= bucket), sized.where(F.col("n") > bucket)
        if level == 1:  # many small nodes hold the same sets, which need one comparison
            ids = small.groupBy("path").agg(F.sort_array(F.collect_list("set_id")).alias("ids")).select("ids").distinct()
            wanted = ids.select(F.xxhash64("ids").alias("path"), F.explode("ids").alias("set_id"), F.lit(True).alias("small")).union(large.select("path", "set_id", F.lit(False)))
            signed = written(wanted.join(sets.select("set_id", "sig"), "set_id"))
            discard(sized)
            sized, small, large = signed, signed.where("small"), signed.where("NOT small")
        kept.append(sized)
        buckets.append(small.select("path", F.lit(0).alias("chunk"), "set_id", "sig"))
        if large.isEmpty():
            break
        to_hubs, rest = settle_large(large.select("path", "set_id", "sig"), threshold, bucket, level == depth)
        ties.append(to_hubs)
        if rest is None:
            break
        kept.append(rest)
        buckets.append(fringes(rest, bucket))
        nodes = written(next_nodes(rest.where(F.col("n_far") > bucket)))
    out = written(reduce(DataFrame.union, [bucket_ties(reduce(DataFrame.union, buckets), threshold, "path", "chunk"), *ties]))
    for table in kept:
        discard(table)
    return out


def verify_pairs(blocks: DataFrame, threshold: float, width: int) -> DataFrame:
    """Exact link counts and forests of block pairs: rows (set_id, n_links, dst) from (cluster, i, j, side, set_id, text).

    Rows must come partitioned and sorted by (cluster, i, j); one block pair is held at a time.
    """
    ratio = Fraction(threshold).limit_denominator(10_000)
    p, q = ratio.numerator, ratio.denominator
    ensure_importable(blocks.sparkSession)

    def compare(rows: list[tuple]) -> list[tuple]:
        own = list({r[1]: r for r in rows}.values())
        sets = [shingle_hashes(r[2], width) for r in own]
        sizes, side = np.asarray([len(s) for s in sets], dtype=np.int64), np.asarray([r[0] for r in own])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(own)), sizes)
        shingle, times = np.unique(flat, return_inverse=True, return_counts=True)[1:]
        shared = times[shingle] > 1
        column, owner = (np.cumsum(times > 1) - 1)[shingle[shared]], owner[shared]
        common, order = np.zeros((len(own), len(own)), dtype=np.float32), np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (low, low + 4096))
            part = np.zeros((len(own), 4096), dtype=np.float32)
            part[owner[a:b], column[a:b] - low] = 1
            common += part @ part.T
        both = np.rint(common).astype(np.int64)
        linked = both * (p + q) >= p * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        if (side > 0).any():
            linked &= side[:, None] != side[None, :]
        parent = {r[1]: r[1] for r in own}
        _forest(parent, ((own[a][1], own[b][1]) for a, b in zip(*np.nonzero(np.triu(linked)), strict=True)))
        return [(r[1], int(n), parent[r[1]]) for r, n in zip(own, linked.sum(1), strict=True) if n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["set_id", "n_links", "dst"])

        for whole in batches:
            step = max(1, int(whole.num_rows * BATCH_BYTES / max(whole.nbytes, 1)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                for cluster, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "side", "set_id", "text")), strict=True):
                    if (cluster, i, j) != key:
                        if len(held) > 1:
                            out += compare(held)
                        key, held = (cluster, i, j), []
                    held.append(tuple(row))
                if len(out) > 10_000:
                    yield made()
                    out = []
        if len(held) > 1:
            out += compare(held)
        yield made()

    return blocks.mapInArrow(run, "set_id binary, n_links long, dst binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH, seed: int = 0) -> DataFrame:
    """Per row of `docs`: doc_id, row_key, class_id, n_links, n_copies, stays.

    class_id is the least doc_id of the component of exact links that the text belongs to;
    n_links counts the other distinct texts linked to it directly; n_copies the rows with an
    equal set, itself included; stays marks the class's first row (by doc_id, then row_key).
    """
    docs = docs.select("doc_id", "text")
    signed = written(signed_sets(docs, width))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    grouped = signed.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("sig").alias("sig"), first.alias("one"), F.count(F.lit(1)).alias("n_copies"), F.max("size").alias("size"))
    sets = written(grouped)
    clusters = connected_components(candidate_ties(sets.select("set_id", "sig"), threshold, recall, seed=seed))

    chosen = clusters.join(sets.select("set_id", "one.doc_id", "one.row_key", "size"), F.col("node") == F.col("set_id")).select("set_id", F.col("component").alias("cluster"), "doc_id", "row_key", "size")
    chosen = checkpoint(chosen)
    placed = chosen.join(cluster_blocks(chosen), "cluster").drop("size")
    text = docs.select(F.col("doc_id").alias("_d"), text_key(F.col("text")).alias("_k"), "text").where("text IS NOT NULL")
    texts = placed.join(text, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_k"))).select("cluster", "set_id", "text", "blocks")
    parts = texts.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = parts.select("cluster", "set_id", "text", "block", other).select(
        "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2).alias("side"), "set_id", "text"
    )
    keys = ("cluster", "i", "j")
    found = checkpoint(verify_pairs(paired.repartition(*keys).sortWithinPartitions(*keys), threshold, width))
    links = found.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))
    classes = connected_components(found.where("set_id <> dst"), "set_id", "dst")

    joined = sets.select("set_id", "one", "n_copies").join(classes, F.col("set_id") == F.col("node"), "left").withColumn("class", F.coalesce("component", "set_id"))
    least = joined.groupBy("class").agg(F.min("one").alias("least"))
    marked = joined.join(least, "class").join(links, "set_id", "left").select("set_id", "least", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rows = signed.select("doc_id", "row_key", "set_id").join(marked, "set_id", "left")
    own = F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.row_key") == F.col("row_key"))
    return rows.select(
        "doc_id", "row_key", F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.when(F.col("least").isNull(), True).otherwise(own).alias("stays"),
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = WIDTH) -> DataFrame:
    """One document of each class, with its columns; of rows equal in doc_id and text, one stays.

    Texts are held against the rows that go, and shuffled only where those are too many to broadcast.
    """
    keys = ["_d", "_k"]
    marks = written(near_duplicates(docs, threshold, recall, width).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), "stays"))
    gone = checkpoint(marks.where("NOT stays").select(*keys).distinct())
    again = checkpoint(marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys))

    def match(rows: DataFrame, listed: DataFrame, how: str) -> DataFrame:
        return rows.join(broadcast_if_small(listed), rows["doc_id"].eqNullSafe(listed["_d"]) & (rows["_row"] == listed["_k"]), how)

    rows = match(docs.withColumn("_row", text_key(F.col("text"))), gone, "left_anti")
    if again.head(1):
        rows = match(rows, again, "left_anti").union(match(rows, again, "left_semi").dropDuplicates(["doc_id", "_row"]))
    return rows.select(*docs.columns)


def cluster_blocks(chosen: DataFrame) -> DataFrame:
    """Blocks that each cluster needs, by its sets and the size of their texts."""
    total = chosen.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return total.where("n > 1").select("cluster", F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
