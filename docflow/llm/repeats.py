"""Substring deduplication: words covered by a 13-word window that also starts in an earlier document are removed.

Windows are found by Rabin-Karp hashes of 80 bits (of ten million million windows, about forty would meet a false one). Each task settles at once what repeats within a slice of rows, and
sends on a window's hash for the first of its documents there only, in compact blobs dealt by hash; so a window that
millions of documents share arrives once a slice. The groups answer with intervals of words by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ids_of, partitions, raw, slices, table
from .tokens import SPACE, Words, hashes, mix, windows, words

WINDOW = 13
GROUP_BYTES = 6 << 20  # text whose windows make about one group of hashes
GROUPS_A_TASK = 4  # groups of hashes in a partition of the shuffle, about
_OTHER = np.uint64(0xA0761D6478BD642F)  # makes the second hash of a word
SMALL_BYTES = 24 << 20  # repeated intervals that may be broadcast


def _blob(h: np.ndarray, more: np.ndarray, ids: np.ndarray, at: np.ndarray) -> bytes:
    """Hashes, documents and positions of windows in order of document: 10 bytes and about one more each after compression."""
    cut = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    sizes = np.diff(np.append(cut, len(ids)))
    step = np.diff(at, prepend=0)
    step[cut] = at[cut]
    wide = step.astype(np.uint32).tobytes()
    tail = pa.compress(sizes.astype(np.uint32).tobytes() + ids[cut].tobytes() + wide, codec="zstd", asbytes=True)
    raw_size = 4 * len(sizes) + 8 * len(cut) + len(wide)
    return np.array([len(h), len(cut), raw_size], np.int64).tobytes() + h.tobytes() + more.tobytes() + tail


def _unblob(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, docs, raw_size = np.frombuffer(b, np.int64, 3)
    h = np.frombuffer(b, np.uint64, n, 24)
    more = np.frombuffer(b, np.uint16, n, 24 + 8 * n)
    tail = pa.decompress(b[24 + 10 * n :], raw_size, codec="zstd", asbytes=True)
    sizes = np.frombuffer(tail, np.uint32, docs)
    ids = np.frombuffer(tail, np.int64, docs, 4 * docs)
    step = np.frombuffer(tail, np.uint32, n, 12 * docs).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(sizes) - sizes
    return h, more, np.repeat(ids, sizes), total - np.repeat(total[first] - step[first], sizes)


def _spans(at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of consecutive or overlapping windows: (document, first window, last window)."""
    order = np.lexsort((at, ids))
    at, ids = at[order], ids[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + WINDOW)]) if len(at) else np.zeros(0, bool)
    cut = np.flatnonzero(new)
    return ids[cut], at[cut], at[np.append(cut[1:], len(at)) - 1] if len(at) else at


def _scan(groups: int):
    """Rows (key, doc_id, first, last, blob): intervals that a slice settles itself, and blobs of the rest by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 4 << 20):
            data, offsets = raw(batch.column("_text"))
            ids, _ = ids_of(batch.column("doc_id"))
            w = words(data, offsets, SPACE)
            each = hashes(data, w)
            h, at = windows(each, w, WINDOW)
            more = (windows(mix(each ^ _OTHER), w, WINDOW)[0] >> np.uint64(48)).astype(np.uint16)
            own, place = ids[w.doc[at]], at - w.first[w.doc[at]]
            order = np.lexsort((own, more, h))
            h, more, own, place, row = h[order], more[order], own[order], place[order], at[order]
            first = np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]) if len(h) else np.zeros(0, bool)
            least = own[np.flatnonzero(first)][np.cumsum(first) - 1] if len(h) else own
            settled = own > least  # its least document is in this slice
            doc, a, z = _spans(place[settled], own[settled])
            keys, blobs = [], []
            keep = np.flatnonzero(~settled)
            group = (h[keep] >> np.uint64(32)) % np.uint64(groups)
            back = keep[np.lexsort((row[keep], group))]
            group = (h[back] >> np.uint64(32)) % np.uint64(groups)
            edges = np.searchsorted(group, np.arange(groups + 1, dtype=np.uint64))
            for g in np.flatnonzero(np.diff(edges)):
                part = back[edges[g] : edges[g + 1]]
                part = part[np.lexsort((place[part], own[part]))]
                keys.append(int(g))
                blobs.append(_blob(h[part], more[part], own[part], place[part]))
            n, k = len(keys), len(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.array(keys, np.int64), -1 - doc % groups])), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(doc, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(a, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(z, pa.int64())]), pa.concat_arrays([pa.array(blobs, pa.binary()), pa.nulls(k, pa.binary())]),
                ],
                ["key", "doc_id", "first", "last", "blob"],
            )

    return run


def _settle(key, batch):
    """Intervals of the windows of one group that an earlier document has too."""
    if key[0].as_py() < 0:
        return batch.select(["doc_id", "first", "last"])
    parts = [_unblob(b) for b in batch.column("blob").to_pylist()]
    h, more, ids, at = (np.concatenate([p[k] for p in parts]) for k in range(4))
    del parts
    order = np.lexsort((ids, more, h))
    h, more, ids, at = h[order], more[order], ids[order], at[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])
    late = ids > ids[np.flatnonzero(first)][np.cumsum(first) - 1]
    doc, a, z = _spans(at[late], ids[late])
    return pa.table({"doc_id": pa.array(doc, pa.int64()), "first": pa.array(a, pa.int64()), "last": pa.array(z, pa.int64())})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge each document's intervals that meet or overlap, as words: windows of far apart groups make one interval."""
    for batch in batches:
        lists = batch.column("spans")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths().fill_null(0)) // 2)
        base = row << 32
        first, last = flat[0::2] + base, flat[1::2] + base
        order = np.argsort(first, kind="stable")
        first, reach, row = first[order], np.maximum.accumulate(last[order]), row[order]
        cut = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1] + WINDOW])) if len(first) else np.zeros(0, np.int64)
        end = np.append(cut[1:], len(first)) - 1 if len(cut) else cut
        pairs = np.stack([first[cut], reach[end]], 1) - (row[cut] << 32)[:, None]
        edges = 2 * np.searchsorted(row[cut], np.arange(batch.num_rows + 1))
        spans = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(pairs.ravel().astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])


def _broadcast(spans: DataFrame) -> DataFrame:
    """Mark spans for broadcast if all rows and their lists together are small; else a join shuffles them."""
    rows, values = spans.agg(F.count("*"), F.sum(F.size("spans"))).first()
    return F.broadcast(spans) if 64 * rows + 4 * (values or 0) <= SMALL_BYTES else spans


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): for each document with repeats, the flat list first, last, first, last ... of the first words of its repeated windows, merged where words meet."""
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    groups = max(4 * partitions(spark), size // GROUP_BYTES + 1)
    found = docs.mapInArrow(_scan(groups), "key bigint, doc_id bigint, first bigint, last bigint, blob binary")
    # Groups are of one size, so the shuffle has as many partitions as the input needs; negative keys are settled rows.
    parts = max(partitions(spark), groups // GROUPS_A_TASK + 1)
    spans = found.repartition(parts, "key").groupBy("key").applyInArrow(_settle, "doc_id bigint, first bigint, last bigint")
    lists = spans.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array(F.col("first").cast("int"), F.col("last").cast("int")))).alias("spans"))
    return lists.mapInArrow(_merged, "doc_id bigint, spans array<int>")


def _covered(w: Words, rows: int, lists: pa.Array) -> np.ndarray:
    """Words that the windows of each row's spans cover. A span holds each of its windows or leaves gaps of at most WINDOW, so all its words are covered."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    row = np.repeat(np.arange(rows), sizes // 2)
    change = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(change, w.first[row] + flat[0::2], 1)
    np.add.at(change, w.first[row] + flat[1::2] + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def removed(docs: DataFrame, texts: bool = False) -> DataFrame:
    """Remove repeated words. Returns doc_id, n_words, n_removed, kept_sha256 and, with texts, text (the kept words joined by a space).

    Windows are judged on the input; equal windows of one document alone don't count, and of rows that share an id only
    those of smaller ids do. A null text has no words; a null id neither loses words nor makes others lose any.
    """
    docs = docs.select("doc_id", "text")
    spans = checkpoint(repeated_windows(docs))
    rows = docs.withColumn("_text", F.col("text").cast("binary")).drop("text").join(_broadcast(spans), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = raw(batch.column("_text"))
            w = words(data, offsets, SPACE)
            gone = _covered(w, batch.num_rows, batch.column("spans"))
            left = Words(w.start[~gone], w.end[~gone], w.doc[~gone], np.concatenate([[0], np.cumsum(~gone)])[w.first])
            out, edges = joined(data, left)
            body = out.tobytes()
            kept = [body[a:z] for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            arrays = [batch.column("doc_id"), pa.array(np.diff(w.first)), pa.array(np.diff(w.first) - np.diff(left.first)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            if texts:
                arrays.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: len(arrays)])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * texts)


def joined(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words of each row joined by one space, and the rows' edges."""
    last = np.zeros(len(w.start), bool)
    last[w.first[1:][np.diff(w.first) > 0] - 1] = True
    sizes = w.end - w.start + ~last
    at = np.concatenate([[0], np.cumsum(sizes)])
    src = np.arange(at[-1]) + np.repeat(w.start - at[:-1], sizes)
    out = data[np.minimum(src, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[(at[1:] - 1)[~last]] = 32
    return out, at[w.first]


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"))
