"""N-gram Jaccard join by chosen paths.

Each text is a set of its five-word shingles, embedded as SIZE tokens (i, least hash under function i), whose overlap
estimates the Jaccard similarity. A run splits the texts by paths of DEPTH tokens: a path goes on with each token of the
text that a hash of (path, token) samples, 1 / THRESHOLD of them a step on average, and with the least if it samples
none. Runs repeat until the target recall. All pairs of a bucket are checked exactly, on the shingles themselves; a pair
that meets in several buckets counts in the one of the least path. Large buckets are compared block by block, each block
with every other. A bucket gives each text's number of links and a star for its components, so pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, ids_of, partitions, raw, slices, table
from .components import components
from .tokens import PUNCTUATION, fold, hashes, mix, windows, words

WORDS = 5
THRESHOLD = 0.8
SIZE = 64  # tokens of the embedding; a bit set of used ones fits 64 bits
RECALL = 0.99  # of pairs right at the threshold, by the runs together
DEPTH = 3  # tokens of a path
BLOCK = 1024  # texts of a large bucket that are compared with another block's at once
BLOCK_BYTES = 8 << 20  # and of their shingles
SMALL = 1_000_000  # ids that may be broadcast
MANY = 10_000  # groups of copies, each of more than this part of all rows, that are broadcast whatever the size

_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _RNG.integers(0, 1 << 63, SIZE, dtype=np.uint64)
_SAMPLED = _U(int(2**64 / (THRESHOLD * SIZE)))
_BIT = _U(1) << np.arange(SIZE, dtype=np.uint64)


def runs_for(recall: float, depth: int) -> int:
    """Runs that meet the recall for pairs at the threshold: a step's least token alone is shared with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - THRESHOLD**depth))


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, row of each, words of each row, word hashes); a text of fewer words is one shingle."""
    low = fold(data)
    w = words(low, offsets, PUNCTUATION)
    h = hashes(low, w)
    s, at = windows(h, w, WORDS)
    row = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        one = np.array([mix(np.add.reduce(h[w.first[k] : w.first[k + 1]] * mix(np.arange(1, count[k] + 1, dtype=np.uint64)), dtype=np.uint64)[None])[0] for k in short], np.uint64)
        s, row = np.concatenate([s, one]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        s, row = s[order], row[order]
    return s, row, count, h


def _sign(h: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the sequence of words of each row, 0 of a row without words."""
    at, some = np.cumsum(count) - count, np.flatnonzero(count > 0)
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(at, count).astype(np.uint64)
    sign = np.zeros(len(count), np.int64)
    if len(some):
        sign[some] = mix(np.add.reduceat(h * mix(place * _U(2) + _U(seed << 40)), at[some])).view(np.int64)
    return sign


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, s1, s2, n_words, sketch): a hash of 128 bits of the sequence of words, and 16 bits of each token. Null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            s, row, count, h = _shingles(*raw(batch.column("_text")))
            n, some = batch.num_rows, np.flatnonzero(count > 0)
            first = np.searchsorted(row, some)
            matrix = np.empty((len(some), SIZE), np.uint16)
            for k in range(SIZE if len(some) else 0):
                matrix[:, k] = mix(np.minimum.reduceat(s * _MULTIPLY[k] + _ADD[k], first)) & _U(0xFFFF)
            signs = [pa.array(_sign(h, count, seed), mask=count == 0) for seed in (1, 2)]
            blobs = np.full(n, None, object)
            blobs[some] = [m.tobytes() for m in matrix]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *signs, pa.array(count, pa.int64()), pa.array(blobs.tolist(), pa.binary())], ["doc_id", "s1", "s2", "n_words", "sketch"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, s1 bigint, s2 bigint, n_words bigint, sketch binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return raw(column)[0].view(np.uint16).reshape(-1, SIZE)


def _extend(path: np.ndarray, used: np.ndarray, row: np.ndarray, token: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths (with their bit set of used coordinates and their row) after further steps. token: a hash of each token of each row."""
    for _ in range(steps):
        score = mix(path[:, None] + token[row])
        score[(used[:, None] & _BIT) != 0] = ~_U(0)
        taken = score < _SAMPLED
        taken[np.arange(len(path)), score.argmin(1)] = True  # no path ends early
        at, k = np.nonzero(taken)
        path, used, row = mix(score[at, k] ^ _U(0x9E3779B97F4A7C15)), used[at] | _BIT[k], row[at]
    return path, used, row


def _tokens(m: np.ndarray) -> np.ndarray:
    return mix(m.astype(np.uint64) | (np.arange(SIZE, dtype=np.uint64) << _U(32)))


def _start(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
                token = _tokens(_matrix(part.column("sketch")))
                ids, size = (ids_of(part.column(c))[0] for c in ("node", "n_words"))
                for r in range(runs):
                    n = len(ids)
                    path, _, row = _extend(np.full(n, mix(np.array([r + 1], np.uint64))[0]), np.zeros(n, np.uint64), np.arange(n), token, DEPTH)
                    yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row]), pa.array(size[row])], ["path", "node", "n_words"])

    return run


def buckets(reps: DataFrame, recall: float = RECALL) -> DataFrame:
    """(path, node, blocks): the texts of each path that several of reps (node, n_words, sketch) share, and how many blocks the bucket is cut into."""
    paths = reps.select("node", "n_words", "sketch").mapInArrow(_start(runs_for(recall, DEPTH)), "path bigint, node bigint, n_words bigint")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_words") * 4 / BLOCK_BYTES))
    counts = paths.groupBy("path").agg(F.count("*").alias("n"), blocks.alias("blocks")).where("n > 1").drop("n")
    return checkpoint(paths.select("path", "node").join(counts, "path"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rep, shingles): the distinct shingles' lower 32 bits, ascending. node is the text's s1."""
    for batch in slices(batches, "_text"):
        s, row, count, h = _shingles(*raw(batch.column("_text")))
        s = s.astype(np.uint32)
        order = np.lexsort((s, row))
        s, row = s[order], row[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1])]) if len(s) else np.zeros(0, bool)
        s, row = s[new], row[new]
        edge = np.searchsorted(row, np.arange(batch.num_rows + 1)) * 4
        body = s.tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(_sign(h, count, 1)), batch.column("doc_id"), pa.array([body[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], ["node", "rep", "shingles"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each unit; rows come in order of unit, and one may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [tuple(held[-1].column(c)[-1].as_py() for c in ("path", "unit"))] if held else []
        held.append(batch)
        key = [ids_of(batch.column(c))[0] for c in ("path", "unit")]
        if ends and ends[0] == (key[0][-1], key[1][-1]):
            continue  # still the same unit
        whole = pa.Table.from_batches(held).combine_chunks()
        path, unit = (ids_of(whole.column(c).combine_chunks())[0] for c in ("path", "unit"))
        start = int(np.flatnonzero((path == path[-1]) & (unit == unit[-1]))[0])  # the last unit may not be whole
        if start:
            yield _links(whole.slice(0, start))
        held = whole.slice(start).to_batches()
    if held:
        yield _links(pa.Table.from_batches(held))


def _links(rows: pa.Table) -> pa.RecordBatch:
    """(node, a, b, links) of each text with links in a unit: its id, the id of one text of its component, the number of its links."""
    rows = rows.combine_chunks()
    columns = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    path, unit, block, node, rep = (ids_of(columns[c])[0] for c in ("path", "unit", "block", "node", "rep"))
    body, edge = raw(columns["shingles"])
    shingles, edge = np.frombuffer(body.tobytes(), np.uint32), edge // 4
    lists = columns["paths"]
    met, seen = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (unit[1:] != unit[:-1]), [True]]))
    out = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        second = lo + int(np.searchsorted(block[lo:hi], block[hi - 1]))  # blocks of a unit are two, or one compared with itself
        if hi - lo < 2 or (second == lo and columns["pair"][lo].as_py()):
            continue
        earlier = [met[seen[k] : seen[k + 1]] for k in range(lo, hi)]
        earlier = [p[p < path[lo]] for p in earlier]
        link, root = _unit(shingles[edge[lo] : edge[hi]], edge[lo : hi + 1] - edge[lo], earlier, rep[lo:hi], second - lo)
        some = np.flatnonzero(link)
        out.append((lo + some, lo + root[some], link[some]))
    at, root, link = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))
    return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(rep[at]), pa.array(rep[root]), pa.array(link)], ["node", "a", "b", "links"])


def _unit(shingles: np.ndarray, first: np.ndarray, earlier: list[np.ndarray], rep: np.ndarray, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of links of each text to others of the unit, and a text of its component. From second on texts are of the other block; 0 if there is one block only.

    A pair that shares a path of the lists earlier is left to that path's bucket. Texts of one id (rep) aren't compared.
    """
    n, size = len(first) - 1, np.diff(first)
    links, root = np.zeros(n, np.int64), np.arange(n)
    before = np.concatenate([[0], np.cumsum([len(p) for p in earlier])])
    paths, path = np.unique(np.concatenate(earlier), return_inverse=True)
    values, code = np.unique(shingles, return_inverse=True)
    of_path, of_text = np.zeros(len(paths), bool), np.zeros(len(values), bool)
    for x in range(second or n - 1):
        y0 = second or x + 1
        own = path[before[x] : before[x + 1]]
        of_path[own] = True
        shared = np.concatenate([[0], np.cumsum(of_path[path[before[y0] :]])])
        of_path[own] = False
        at = before[y0:] - before[y0]
        y = y0 + np.flatnonzero((shared[at[1:]] == shared[at[:-1]]) & (rep[y0:] != rep[x]) & (np.minimum(size[y0:], size[x]) >= THRESHOLD * np.maximum(size[y0:], size[x]) - 1e-6))
        if not len(y):
            continue
        own = code[first[x] : first[x + 1]]
        of_text[own] = True
        start = np.cumsum(size[y]) - size[y]
        hits = of_text[code[np.arange(int(size[y].sum())) + np.repeat(first[y] - start, size[y])]]
        of_text[own] = False
        both = np.add.reduceat(hits, start, dtype=np.int64)
        y = y[both / (size[x] + size[y] - both) >= THRESHOLD]
        if len(y):
            links[x] += len(y)
            links[y] += 1
            joined = np.append(root[y], root[x])
            if (joined != joined[0]).any():
                to = np.arange(n)
                to[joined] = joined.min()
                root = to[root]
    return links, root


def links(docs: DataFrame, met: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, a, b, links) of the texts that the buckets met bring together with others of a Jaccard similarity of THRESHOLD or more.

    A text comes once for each unit in which it has links: links is their number, and a and b, the ids of the text and of one that a chain of links joins it to, make a graph of the same components.
    """
    paths = met.groupBy("node").agg(F.collect_list("path").alias("paths"))
    needed = checkpoint(reps.select("node", F.col("rep").alias("doc_id")).join(met.select("node"), "node", "left_semi"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("_text")).where("_text is not null").dropna(subset=["doc_id"])
    sets = texts.join(broadcast_if_small(needed.select("doc_id").distinct(), SMALL), "doc_id", "left_semi").mapInArrow(_sets, "node bigint, rep bigint, shingles binary")
    own = needed.withColumnRenamed("doc_id", "rep").join(sets, ["node", "rep"]).dropDuplicates(["node"]).join(paths, "node")
    block = F.pmod(F.xxhash64("node", "path"), F.col("blocks"))
    dealt = met.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    unit = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    dealt = dealt.select("path", "node", unit.alias("unit"), "block", (F.floor(unit / F.col("blocks")) != unit % F.col("blocks")).alias("pair"))
    rows = dealt.join(own, "node").repartition(partitions(docs.sparkSession), "path", "unit").sortWithinPartitions("path", "unit", "block", "node")
    return rows.select("path", "unit", "block", "pair", "node", "rep", "paths", "shingles").mapInArrow(_compare, "node bigint, a bigint, b bigint, links bigint")


def with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows left joined with groups (s1, s2, rep, copies, root, links), which hold no more than a share of the rows.

    Few groups are broadcast. Else those with more than 1 / MANY of all rows, at most MANY of them, still are; what they
    and null keys leave meets the others in a shuffle, in which rows without a group to look for are dealt by their id.
    """
    if (small := broadcast_if_small(groups, SMALL)) is not groups:
        return rows.join(small, ["s1", "s2"], "left")
    least = rows.count() // MANY + 1
    values = ["rep", "copies", "root", "links"]
    hot = groups.where(F.col("copies") > least).select("s1", "s2", F.struct(*values).alias("_hot"))
    met = rows.join(F.broadcast(hot), ["s1", "s2"], "left")
    done = F.col("_hot").isNotNull() | F.col("s1").isNull()
    met = met.select("doc_id", "_hot", F.when(done, F.xxhash64("doc_id")).otherwise(F.col("s1")).alias("s1"), F.when(~done, F.col("s2")).alias("s2"))
    cold = groups.where(F.col("copies") <= least)
    return met.join(cold, ["s1", "s2"], "left").select("doc_id", *[F.coalesce(F.col("_hot")[c], c).alias(c) for c in values])


def similar(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, rep_id, n_copies, n_links) of each document.

    class_id is the least id of those that links connect; rep_id the least id with the same sequence of words (case and
    punctuation aside), n_copies how many have it, n_links the links found of that text to different ones. Null, empty and wordless texts are like no
    other and are their own class, as are rows without an id (class null). Rows that share an id are one node of the links.
    """
    base = checkpoint(sketches(docs))
    texts = base.where("s1 is not null and doc_id is not null")
    groups = texts.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    groups = checkpoint(groups)
    reps = checkpoint(texts.join(groups.select("s1", "s2", F.col("rep").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi").select(F.col("s1").alias("node"), F.col("doc_id").alias("rep"), "n_words", "sketch").dropDuplicates(["node"]))
    found = checkpoint(links(docs, buckets(reps, recall), reps))
    degree = found.groupBy(F.col("node").alias("s1")).agg(F.sum("links").alias("links"))
    roots = components(found).select(F.col("node").alias("rep"), "root")
    whole = checkpoint(groups.join(roots, "rep", "left").join(degree, "s1", "left").where("copies > 1 or root is not null or links is not null"))
    rows = with_groups(base.select("doc_id", "s1", "s2"), whole)
    return rows.select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("class_id"), F.coalesce("rep", "doc_id").alias("rep_id"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("n_copies"), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def op8_jaccard(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
