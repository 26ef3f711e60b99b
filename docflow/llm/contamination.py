"""Benchmark decontamination by template canonicalisation.

Numbers (in digits, with their separators, or in words), names (words with a capital, common given names, what follows a title) and units become typed placeholders; windows of the templates of the benchmark
are joined with those of every document by hash. A bit filter of bounded size, built of the benchmark's hashes, goes to
all tasks and keeps most windows that can't match out of the shuffle. Where a document has enough of an item's windows,
the slots that the placeholders stand for are compared: the fillers of the item must map to those of the document one to one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, ids_of, raw, slices, table
from .tokens import PUNCTUATION, Words, fold, hashes, mix, windows, words

WINDOW = 8
COVER = 0.5  # share of an item's windows that a document must have
RUN = 20  # or so many words of an item in a row
SLOTS = 0.7  # share of slots whose fillers must be consistent
MOST_SLOTS = 5  # placeholders in a window, at most
BITS_A_WINDOW, LEAST_BITS, MOST_BITS = 32, 20, 26  # of the filter, and its size as powers of two; beyond it the filter passes more
PROBES = 4  # bits of a window in the filter
SMALL = 100_000  # windows of the benchmark that may be broadcast
#: Words that are units after a number.
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "ml", "l", "s", "min", "h", "hours", "minutes", "seconds", "days", "weeks", "years", "percent", "dollars", "euros", "cents", "miles", "feet", "inches", "pounds", "meters", "metres", "litres", "liters", "usd", "eur")
#: Words of numbers, titles before a name, and common given names that are no other words.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half quarter".split()
TITLES = "mr mrs ms miss dr doctor prof professor sir madam uncle aunt captain".split()
NAMES = (
    "james john robert michael david william richard joseph thomas charles christopher daniel matthew anthony donald steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan "
    "stephen larry justin scott brandon benjamin samuel gregory alexander patrick tom bob bill jim joe ben sam tim mike dave mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty margaret sandra ashley kimberly "
    "emily donna michelle carol amanda melissa deborah stephanie rebecca laura helen sharon cynthia kathleen amy angela anna emma alice julia jane maria sophia olivia kate lucy peter"
).split()
_TYPES = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))  # number, name, unit


def _hashes_of(listed) -> np.ndarray:
    data = np.frombuffer(" ".join(listed).encode(), np.uint8)
    return np.sort(hashes(data, words(data, np.array([0, len(data)]), PUNCTUATION)))


_UNITS, _NUMBERS, _TITLES, _NAMES = (_hashes_of(x) for x in (UNITS, NUMBERS, TITLES, NAMES))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _joined(data: np.ndarray, offsets: np.ndarray, w: Words, spelled: np.ndarray, digits: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words with numbers in one piece: digits that a comma or point joins, and words of a number that a blank or hyphen joins; and which are spelled."""
    if len(w.start) < 2:
        return w, spelled
    gap = data[np.minimum(w.end[:-1], len(data) - 1)]
    beside = (w.start[1:] == w.end[:-1] + 1) & (w.doc[1:] == w.doc[:-1])
    whole = digits == w.end - w.start
    both = lambda x: x[1:] & x[:-1]
    join = beside & ((both(whole) & ((gap == 44) | (gap == 46))) | (both(spelled) & ((gap == 32) | (gap == 45))))
    first, final = np.concatenate([[True], ~join]), np.concatenate([~join, [True]])
    start = w.start[first]
    return Words(start, w.end[final], w.doc[first], np.searchsorted(start, offsets, "left")), spelled[first]


class Canonical:
    """Words of many texts with the hash of each in lower case, and the slot type (0 none) of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.low = data, fold(data)
        w = words(data, offsets, PUNCTUATION)
        digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        self.words, spelled = _joined(data, offsets, w, _among(hashes(self.low, w), _NUMBERS), digit[w.end] - digit[w.start])
        w = self.words
        self.plain = hashes(self.low, w)
        number = (digit[w.end] > digit[w.start]) | spelled
        name = (self.low != data)[w.start] if len(w.start) else number
        if len(w.start):
            second = np.minimum(w.start + 1, len(data) - 1)
            name = name | ((data[w.start] == 0xC3) & (self.low != data)[second])
        follows = lambda x: np.concatenate([[False], x[:-1] & (w.doc[1:] == w.doc[:-1])]) if len(x) else x
        name = name | _among(self.plain, _NAMES) | follows(_among(self.plain, _TITLES))
        unit = _among(self.plain, _UNITS) & follows(number)
        self.slot = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0)))
        self.template = np.where(self.slot > 0, _TYPES[np.maximum(self.slot, 1) - 1], self.plain)
        self.cased = np.where(self.slot == 2, self.plain, self.template)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, is template) of the windows: of the template, where it isn't mostly slots, of the words with only numbers and units replaced, and where those are many, of the words as they stand."""
        w = self.words
        t, at = windows(self.template, w, WINDOW)
        filled = np.concatenate([[0], np.cumsum(self.slot > 0)])
        kept = filled[at + WINDOW] - filled[at] <= MOST_SLOTS if len(at) else np.zeros(0, bool)
        p, _ = windows(self.cased, w, WINDOW)
        numbers = np.concatenate([[0], np.cumsum((self.slot == 1) | (self.slot == 3))])
        many = numbers[at + WINDOW] - numbers[at] if len(at) else np.zeros(0, np.int64)
        kept_p, verbatim = many <= MOST_SLOTS, many >= MOST_SLOTS  # the first word may be a unit in one text only
        v, _ = windows(self.plain, w, WINDOW)
        kinds = (np.full(int(k.sum()), t) for k, t in ((kept, True), (kept_p, False), (verbatim, False)))
        return np.concatenate([t[kept], mix(p[kept_p] + np.uint64(1)), mix(v[verbatim] + np.uint64(2))]), np.concatenate([at[kept], at[kept_p], at[verbatim]]), np.concatenate([*kinds])

    def forms(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with all slots replaced, with only numbers and units, and as they stand."""
        return self.template, self.cased, self.plain

    def units(self, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, first word, number of words) of all that is joined: the windows, and runs of each size in short in each of forms()."""
        h, at, _ = self.windows()
        out = [(h, at, np.full(len(at), WINDOW))]
        for n in short:
            for form, values in enumerate(self.forms()):
                h, at = windows(values, self.words, n)
                out.append((mix(h + np.uint64(16 * n + form)), at, np.full(len(at), n)))
        return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of 2^bits bits."""
    return np.stack([mix(h + np.uint64(k + 1)) >> np.uint64(64 - bits) for k in range(PROBES)], 1)


def _binaries(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary of each run of values."""
    body = np.ascontiguousarray(values).tobytes()
    width = values.dtype.itemsize
    return pa.array([body[a * width : (a + n) * width] for a, n in zip(at.tolist(), size.tolist(), strict=True)], pa.binary())


def _item_windows(items: DataFrame, short: list[int]) -> DataFrame:
    """(item_id, hash, at, size, n_words, words, slots) of each window of items; a short item has its whole forms that aren't mostly slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            ids, _ = ids_of(batch.column("item_id"))
            c = Canonical(*raw(batch.column("_text")))
            h, at, size = c.units(short)
            item = c.words.doc[at] if len(at) else at
            n = np.diff(c.words.first)[item] if len(at) else at
            kept = (size == WINDOW) | (n == size)
            for form, values in enumerate(c.forms()[:2]):  # what is mostly slots says nothing
                filled = np.concatenate([[0], np.cumsum(values != c.plain)])
                much = (filled[at + size] - filled[at]) * WINDOW > MOST_SLOTS * size
                kept &= (size == WINDOW) | ~(much & np.isin(h, _form_hashes(c, short, form)))
            h, at, size, item, n = (x[kept] for x in (h, at, size, item, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[item]), pa.array(h.view(np.int64)), pa.array(at - c.words.first[item]), pa.array(size), pa.array(n), _binaries(c.plain, at, size), _binaries(c.slot.astype(np.uint8), at, size)],
                ["item_id", "hash", "at", "size", "n_words", "words", "slots"],
            )

    return items.mapInArrow(run, "item_id bigint, hash bigint, at bigint, size bigint, n_words bigint, words binary, slots binary")


def _form_hashes(c: Canonical, short: list[int], form: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[mix(windows(c.forms()[form], c.words, n)[0] + np.uint64(16 * n + form)) for n in short]])


def _filter(hashes_: DataFrame, count: int) -> tuple[int, bytes]:
    """Size (as a power of two) and bits of the filter of the hashes: at most 2^MOST_BITS / 8 bytes, built in Spark."""
    bits = min(max(LEAST_BITS, int(max(count, 1) * BITS_A_WINDOW).bit_length()), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_probes(ids_of(batch.column("hash"))[0].view(np.uint64), bits).ravel().view(np.int64))], ["bit"])

    places = hashes_.mapInArrow(run, "bit bigint").select(F.shiftright("bit", 15).alias("part"), F.col("bit").bitwiseAND(F.lit(32767)).alias("bit"))
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in places.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        whole[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits, whole.tobytes()


def _document_windows(docs: DataFrame, short: list[int], bits: int, body: bytes) -> DataFrame:
    """(doc_id, copy, hash, place, doc_words) of the windows that pass the filter; copy tells rows apart that share an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(body, np.uint8)
        for batch in slices(batches, "_text"):
            ids, _ = ids_of(batch.column("doc_id"))
            copies, _ = ids_of(batch.column("copy"))
            c = Canonical(*raw(batch.column("_text")))
            h, at, size = c.units(short)
            for k in range(PROBES):
                place = mix(h + np.uint64(k + 1)) >> np.uint64(64 - bits)
                kept = np.flatnonzero((held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1)
                h, at, size = h[kept], at[kept], size[kept]
            doc = c.words.doc[at] if len(at) else at
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(copies[doc]), pa.array(h.view(np.int64)), pa.array(at - c.words.first[doc]), _binaries(c.plain, at, size)], ["doc_id", "copy", "hash", "place", "doc_words"])

    return docs.mapInArrow(run, "doc_id bigint, copy bigint, hash bigint, place bigint, doc_words binary")


def _consistent(pairing: list[tuple[int, int]]) -> int:
    """How many of the pairs of fillers follow the most frequent mapping, both ways."""
    forth, back = {}, {}
    for a, b in pairing:
        forth.setdefault(a, Counter())[b] += 1
        back.setdefault(b, Counter())[a] += 1
    return sum(forth[a].most_common(1)[0][0] == b and back[b].most_common(1)[0][0] == a for a, b in pairing)


def _judge(n_words: int, met: list[dict]) -> tuple[int, float, float]:
    """(longest run, share of the item's words covered, share of consistent slots) of the windows in which a text and an item meet."""
    shifts: dict[int, dict[int, tuple[int, int, int]]] = {}  # by where the item would start: slot, word of the item and of the text at each place
    for m in met:
        own = shifts.setdefault(m["place"] - m["at"], {})
        theirs, ours = np.frombuffer(m["words"], np.uint64).tolist(), np.frombuffer(m["doc_words"], np.uint64).tolist()
        own.update((m["at"] + k, row) for k, row in enumerate(zip(m["slots"], theirs, ours, strict=True)))
    covered: dict[int, tuple[int, int]] = {}
    for own in shifts.values():
        pairing = [(theirs, ours) for slot, theirs, ours in own.values() if slot]
        good = _consistent(pairing)
        if not pairing or good >= SLOTS * len(pairing):
            for p in own:
                covered[p] = max(covered.get(p, (0, 0)), (len(pairing), good))
    if not covered:
        return 0, 0.0, 0.0
    slots, good = max(covered.values())
    longest = run = 0
    before = -2
    for p in sorted(covered):
        run = run + 1 if p == before + 1 else 1
        longest, before = max(longest, run), p
    return longest, len(covered) / n_words, good / slots if slots else 1.0


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, longest_run, coverage, consistency) of each document that holds an item, or one like it but for slots.

    A pair counts if the document covers COVER of the item's words, or RUN of them in a row, with consistent slots. An
    item of fewer than WINDOW words counts where all its words stand in a row, or its template does with consistent slots. Null ids, texts and items match nothing;
    of rows that share an id, each is looked at, and the best of their matches returned once. Empty tables give no rows;
    other columns are ignored.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("_text"))
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("_text"))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            n = np.unique(np.diff(Canonical(*raw(batch.column("_text"))).words.first))
            yield pa.RecordBatch.from_arrays([pa.array(n[(n > 0) & (n < WINDOW)])], ["n"])

    short = sorted(r["n"] for r in items.mapInArrow(sizes, "n bigint").distinct().collect())  # fewer than WINDOW
    wanted = checkpoint(_item_windows(items, short))
    bits, body = _filter(wanted, wanted.count())
    met = _document_windows(texts, short, bits, body).join(broadcast_if_small(wanted, SMALL), "hash")
    pairs = met.groupBy("doc_id", "copy", "item_id", "n_words").agg(F.collect_list(F.struct("place", "at", "words", "slots", "doc_words")).alias("met"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                found = [_judge(n, m) for n, m in zip(part.column("n_words").to_pylist(), part.column("met").to_pylist(), strict=True)]
                longest, coverage, consistency = (pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64())))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("item_id"), longest, coverage, consistency], ["doc_id", "item_id", "longest_run", "coverage", "consistency"])

    judged = pairs.mapInArrow(judge, "doc_id bigint, item_id bigint, longest_run bigint, coverage double, consistency double")
    best = F.max(F.struct("coverage", "longest_run", "consistency")).alias("best")
    pairs = judged.where((F.col("coverage") >= COVER) | (F.col("longest_run") >= RUN)).groupBy("doc_id", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", F.col("best.longest_run").alias("longest_run"), F.col("best.coverage").alias("coverage"), F.col("best.consistency").alias("consistency"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """contaminated() of documents and benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
