"""Merkle manifest of a data set: a ternary hash tree by source, a tree over the sources, and a proof for every row.

Merkle traversal scheduling: rows are ranked by source and cut into aligned blocks of ARITY ** LEVELS leaves. A task
walks a block leaf by leaf; at each level it holds the current run of siblings, while a treehash stack takes one leaf a
step to have the next run ready when it's needed, so the state of the walk is logarithmic in the block. The blocks'
roots are the leaves of the same walk one storey up, and each block's rows share the path from its root upward.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, partitions, table

ARITY = 3
LEVELS = 5  # of a block: 243 leaves
SMALL = 20_000  # rows of upper paths or of offsets that may be broadcast; some hundred bytes each for each storey

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]  # what a leaf hashes, in order
_STEP = "array<struct<left:string,right:string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Runs:
    """Treehash stacks: leaves go in one by one, nodes of a level meet in runs of ARITY and become a node of the next. The run of level top is kept as it is."""

    def __init__(self, top: int):
        self.top = top
        self.open: list[list[str]] = [[] for _ in range(top + 1)]

    def add(self, node: str, level: int = 0) -> None:
        while True:
            self.open[level].append(node)
            if level == self.top or len(self.open[level]) < ARITY:
                return
            node = digest("".join(self.open[level]))
            self.open[level] = []
            level += 1

    def close(self) -> list[str]:
        """The run of the top level, with what no full run held: a last run of fewer nodes, even one, becomes their hash."""
        for level in range(self.top):
            if last := self.open[level]:
                self.open[level] = []
                self.add(digest("".join(last)), level + 1)
        return self.open[self.top]


def height(n: int) -> int:
    """Levels from n leaves to one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def root_of(leaves: list[str], levels: int) -> str:
    runs = Runs(levels)
    for leaf in leaves:
        runs.add(leaf)
    return runs.close()[0]


def traverse(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in turn its siblings on the left and on the right, level by level."""
    current: list[list[str]] = []
    for h in range(levels):
        first = Runs(h)
        for leaf in leaves[: ARITY ** (h + 1)]:
            first.add(leaf)
        current.append(first.close())
    coming = [Runs(h) for h in range(levels)]
    for i in range(len(leaves)):
        path, at = [], i
        for run in current:
            k = at % ARITY
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
            at //= ARITY
        yield path
        for h in range(levels):
            span = ARITY ** (h + 1)
            if i + span < len(leaves):
                coming[h].add(leaves[i + span])
            if (i + 1) % span == 0:
                current[h], coming[h] = coming[h].close(), Runs(h)


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in path:
        node = digest(left + node + right)
    return node


def _field(c: Column) -> Column:
    """- for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(text: Column) -> Column:
    """Lowercase hex of a row's leaf, with this text."""
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str], levels: int) -> DataFrame:
    """Add pos (from 0, by key in the given order), n (rows of the key) and block to rows, which hold a column key.

    Rows are dealt by ranges of key and order, so a key of a third of all rows is cut like any other; equal rows are told apart by where they stand.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(max(2, partitions(spark)), "key", *order, "_tie").sortWithinPartitions("key", *order, "_tie").drop("_tie")
    dealt = checkpoint(dealt).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    counts = dealt.groupBy("key", "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    counts = checkpoint(counts)
    of_key = Window.partitionBy("key")  # a row for each key and partition at most
    before = F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("key", "_part", (before - F.col("_first")).alias("_start"), F.sum("_n").over(of_key).alias("n"))
    met = dealt.join(broadcast_if_small(checkpoint(starts), SMALL), ["key", "_part"]).withColumn("pos", F.col("_row") + F.col("_start"))
    return met.withColumn("block", F.floor(F.col("pos") / ARITY**levels)).drop("_part", "_row", "_start")


def blocks_of(rows: DataFrame) -> DataFrame:
    """The rows, each block whole in one partition and in order."""
    return checkpoint(rows.repartition(partitions(rows.sparkSession), "key", "block").sortWithinPartitions("key", "block", "pos"))


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block; a block may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    of = None
    for batch in batches:
        start = 0
        for at, own in enumerate(zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), strict=True)):
            if own != of:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, of = [], at, own
        if batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _levels(n: int, levels: int) -> int:
    """Levels of a block of a key of n leaves: all of them, but for the only block of a key."""
    return height(n) if n <= ARITY**levels else levels


def block_roots(blocks: DataFrame, levels: int) -> DataFrame:
    """(key, pos, n, node): the root of each block as a leaf of the next storey. blocks: from blocks_of, with node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            key, block, n = (rows.column(c)[0].as_py() for c in ("key", "block", "n"))
            out = key, block, -(-n // ARITY**levels), root_of(rows.column("node").to_pylist(), _levels(n, levels))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "pos", "n", "node"])

    return blocks.select("key", "block", "n", "node").mapInArrow(run, "key string, pos bigint, n bigint, node string")


def tree(nodes: DataFrame, levels: int) -> DataFrame:
    """(key, pos, path, top): the siblings of each node of nodes (key, pos, n, node) up to its key's last node, which is top."""
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**levels))
    blocks = blocks_of(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            leaves, high = rows.column("node").to_pylist(), _levels(rows.column("n")[0].as_py(), levels)
            paths = [[{"left": a, "right": b} for a, b in p] for p in traverse(leaves, high)]
            new = [pa.array(paths, _STEPS), pa.array([root_of(leaves, high)] * len(leaves), pa.string())]
            yield from pa.Table.from_arrays([*[rows.column(c) for c in ("key", "pos", "block")], *new], ["key", "pos", "block", "path", "top"]).combine_chunks().to_batches()

    found = blocks.select("key", "pos", "block", "n", "node").mapInArrow(run, f"key string, pos bigint, block bigint, path {_STEP}, top string")
    if not nodes.where(F.col("n") > ARITY**levels).limit(1).count():
        return checkpoint(found.drop("block"))
    above = tree(checkpoint(block_roots(blocks, levels)), levels).select("key", F.col("pos").alias("block"), F.col("path").alias("_up"), F.col("top").alias("_top"))
    met = found.join(broadcast_if_small(above, SMALL), ["key", "block"])
    return checkpoint(met.select("key", "pos", F.concat("path", "_up").alias("path"), F.col("_top").alias("top")))


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    docs has FIELDS, any of which may be null (a null source is a source of its own, before all others; null ids come
    first in theirs). Rows that share an id are ordered by their leaves, so equal rows keep a leaf each. Other columns
    aren't hashed. tampered: the text as it is found at verification, the original where null; without it every row is
    verified against itself. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = leaf_hash(F.col("text"))
    found = own if tampered is None else F.when(tampered.isNull(), own).otherwise(leaf_hash(tampered))
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), "source"))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), "source", own.alias("node"), found.alias("found"))
    blocks = blocks_of(ranked(checkpoint(rows), ["doc_id", "node"], levels))
    below = tree(checkpoint(block_roots(blocks, levels)), levels)
    sources = below.where("pos = 0").select(F.col("key").alias("of"), F.col("top").alias("node"), F.lit("").alias("key"))
    ordered = checkpoint(ranked(sources, ["of"], levels).select("key", "of", "pos", "n", "node"))
    over = tree(ordered.select("key", "pos", "n", "node"), levels).select("pos", F.col("path").alias("_over"), F.col("top").alias("root"))
    over = checkpoint(ordered.select("of", "pos").join(broadcast_if_small(over, SMALL), "pos").select(F.col("of").alias("key"), "_over", "root"))
    upper = checkpoint(below.join(broadcast_if_small(over, SMALL), "key").select("key", F.col("pos").alias("block"), F.concat("path", "_over").alias("up"), F.col("top").alias("subroot"), "root"))
    # A join by shuffle deals blocks anew, whole but not in order.
    met = blocks.join(broadcast_if_small(upper, SMALL), ["key", "block"]).sortWithinPartitions("key", "block", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            leaves, high = rows.column("node").to_pylist(), _levels(rows.column("n")[0].as_py(), levels)
            up = [(s["left"], s["right"]) for s in rows.column("up")[0].as_py()]
            shared, root = "".join(a + b for a, b in up), rows.column("root")[0].as_py()
            known: dict[str, str] = {}  # roots by block root: the upper path is folded once for each
            proofs, roots = [], []
            for found, path in zip(rows.column("found").to_pylist(), traverse(leaves, high), strict=True):
                proofs.append(digest("".join([a + b for a, b in path]) + shared))
                top = fold(found, path)
                if top not in known:
                    known = {top: fold(top, up)}
                roots.append(known[top])
            new = [pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array([r == root for r in roots], pa.bool_())]
            arrays = [*[rows.column(c) for c in ("doc_id", "source", "node", "subroot", "root")], *new]
            yield from pa.Table.from_arrays(arrays, ["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).combine_chunks().to_batches()

    columns = met.select("key", "block", "n", "doc_id", "source", "node", "found", "up", "subroot", "root")
    return columns.mapInArrow(run, "doc_id bigint, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    return manifest(docs, F.when(even, F.replace("text", F.lit("\n"), F.lit("")))).drop("source")
