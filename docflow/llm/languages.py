"""Language identification by rank-order n-gram profiles and the out-of-place distance."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fold_of, free, raw, slices, table

PROFILE = 400  # n-grams in a profile
CHUNK = 1 << 20  # characters counted at once
UNKNOWN = "und"
_SPACE = 32


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _letters(text: str) -> np.ndarray:
    """Code points of the text in lower case, with each run of other characters than letters as one space, and a space around."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, _SPACE)
    blank = codes == _SPACE
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint64)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at], np.diff(np.append(at, len(ordered)))


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several (values, counts)."""
    if len(found) == 1:
        return found[0]
    values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([c for _, c in found]), len(values)).astype(np.int64)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1-, 2- and 3-grams as integers of 21 bits a character, ascending, and their counts; a space alone doesn't count.

    One sort of the 3-grams serves for all: the shorter ones are their prefixes. Long texts are counted in chunks.
    """
    codes, found = np.append(_letters(text), np.zeros(2, np.uint64)), []
    for at in range(0, len(codes) - 2, CHUNK):
        c = codes[at : at + CHUNK + 2]
        three = np.sort((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])
        parts = []
        for cut in (42, 21, 0):
            values, counts = _runs(three >> np.uint64(cut))
            kept = (values & np.uint64((1 << 21) - 1)) != 0  # what runs over the end
            if cut == 42:
                kept &= values != _SPACE
            parts.append((values[kept], counts[kept]))
        found.append((np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts])))
    return merged(found)


def ranked(values: np.ndarray, counts: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram."""
    if len(values) > 4 * most:  # drop what is surely lower
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        values, counts = values[counts >= least], counts[counts >= least]
    return values[np.lexsort((values, -counts))[:most]]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): n-gram counts of each language over all rows of (text, lang), summed per task before they are dealt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "text"):
            data, offsets = raw(batch.column("text"))
            body, by = data.tobytes(), {}
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                by.setdefault(lang, []).append(grams(body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")))
            for lang, found in by.items():
                total[lang] = merged([*found, *([total[lang]] if lang in total else [])])
        for lang, (values, counts) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    rows = labelled.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame) -> dict[str, list[int]]:
    """Profile of each language: its PROFILE most frequent n-grams in order (ties by the n-gram). Rows with a null text or lang don't count."""
    counts = gram_counts(labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).collect()  # languages x PROFILE rows
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """Add lang_pred and score to docs by their text alone.

    The distance to a profile is the sum, over the document's own most frequent n-grams, of how far each is out of
    place; an n-gram that the profile lacks counts PROFILE. The least distance wins, ties by name. The score is 1 less
    the ratio of the least distance to the next (to the greatest possible one where one language is known). Null
    texts, texts without letters and all texts when no language was learned get `und` and 0. Columns stay, but for those of these two
    names, which are replaced; rows that repeat are kept each.
    """
    docs = docs.drop("lang_pred", "score")
    hidden = free("_text", docs)
    names = sorted(profiles)
    sorted_profiles = []
    for name in names:
        p = np.array(profiles[name], np.uint64)
        order = np.argsort(p)
        sorted_profiles.append((p[order], order))

    def predict(text: str) -> tuple[str, float]:
        if not names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        own = ranked(*grams(text))
        places = np.arange(len(own))
        far = []
        for values, ranks in sorted_profiles:
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            far.append(int(np.where(values[at] == own, np.abs(ranks[at] - places), PROFILE).sum()))
        order = sorted(range(len(names)), key=lambda k: (far[k], k))
        second = far[order[1]] if len(order) > 1 else PROFILE * len(own)
        return names[order[0]], 1.0 - far[order[0]] / second if second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, hidden):
            data, offsets = raw(batch.column(hidden))
            body = data.tobytes()
            found = [predict(body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")) for i in range(batch.num_rows)]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != hidden]
            names_kept = [name for name in batch.schema.names if name != hidden]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], [*names_kept, "lang_pred", "score"])

    schema = StructType([*docs.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.withColumn(hidden, F.col("text").cast("binary")).mapInArrow(run, schema)


def op2_languages(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"))
    profiles = learn(docs.where(fold != 1).select("text", "lang"))
    own = docs.select("doc_id", (fold == 1).alias("held_out"), "text")
    return identify(own, profiles).select("doc_id", "held_out", "lang_pred", "score")

