"""Toxicity by weak supervision: many lexicon and pattern voters, a generative model of their accuracies and
correlations, and a linear classifier trained on the posterior labels."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import checkpoint, fold_of, free, let, raw, slices, table

SAMPLE = 20_000  # labelled rows that train the classifier, about
RELATED = 0.25  # correlation given the label from which voters are modelled jointly
BLOCK = 4  # voters of a joint block, at most
STEMS = (4, 5, 6)  # letters of a stem
LEXICONS = 12  # voters that share the words, and as many that share the stems
CHANCE = 1e-8  # an entry found only in toxic texts must be less likely than this by chance
SURE = 0.8  # share of toxic texts among those that hold an entry, at least, by its lower bound
THRESHOLD = 0.7
MEMO = 100_000  # tokens whose entries a worker remembers
_PIECE = re.compile(r"[^\W\d_]+")
_ADDRESS = (" you ", " your ", " du ", " ihr ", " tu ", " vous ", " eres ", " usted ")
#: Pattern voters: each says toxic or nothing.
PATTERNS = {"exclaim": lambda low, text: "!!" in low, "shout": lambda low, text: text.isupper(), "address": lambda low, text: any(a in low for a in _ADDRESS)}


def entries_of(token: str) -> list[str]:
    """Lexicon entries that a token can match: its words, and their stems with a star."""
    return [e for w in _PIECE.findall(token) for e in (w, *(f"{w[:n]}*" for n in STEMS if len(w) > n))]


def _texts(batches: Iterator[pa.RecordBatch], column: str = "_text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in slices(batches, column):
        data, offsets = raw(batch.column(column))
        body = data.tobytes()
        yield batch, [body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in range(batch.num_rows)]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # by entry
    patterns: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    accuracies: dict[str, float] = field(default_factory=dict)  # of each voter, as estimated
    correlations: np.ndarray | None = None


def training_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Texts of about `most` labelled documents with their label, chosen by a hash of the id; of copies and most near copies, one.

    Near copies are those with the same least hash of three words; the one of the least id stays. An id with several labels counts as toxic if one is.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = marked.count()
    if found > most:
        marked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / found * (1 << 30)))
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(marked), "doc_id").select("doc_id", F.col("text").cast("binary").alias("_text"), "toxic")
    three = lambda w: F.array_min(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    words = F.split(F.col("_text").cast("string"), r"\s+")
    least = let(words, lambda w: F.when(F.size(w) >= 3, three(w)).otherwise(F.xxhash64(F.array_join(w, " "))))
    first = F.min(F.struct("doc_id", "toxic", "_text")).alias("first")
    return checkpoint(rows.withColumn("_h", least).groupBy("_h").agg(first).select("first._text", "first.toxic"))


def lexicon(sample: DataFrame) -> list[str]:
    """The entries whose presence speaks most surely for the label: by the lower bound of the share of toxic texts among those that hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {0: Counter(), 1: Counter()}
        for batch, texts in _texts(batches):
            for toxic, text in zip(batch.column("toxic").to_pylist(), texts, strict=True):
                tallies[int(toxic > 0)].update({e for t in set(text.lower().split()) for e in entries_of(t)})
        names = list(tallies[0] | tallies[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tallies[1][n] for n in names], pa.int64()), pa.array([tallies[0][n] for n in names], pa.int64())], ["entry", "bad", "good"])

    counts = sample.mapInArrow(count, "entry string, bad bigint, good bigint").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n, z = F.col("bad") + F.col("good"), 1.64
    share = F.col("bad") / n
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    prior = sample.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    if not prior or prior == 1:
        return []
    least = max(3, math.ceil(math.log(CHANCE) / math.log(prior)))
    rows = counts.where(F.col("bad") >= least).withColumn("low", low).where(F.col("low") > SURE - 0.3).orderBy(F.desc("low"), "entry").collect()  # as the sample is bounded, so are these
    of_words: dict[str, list[int]] = {}  # what the words of a stem explain
    for r in rows:
        if not r["entry"].endswith("*"):
            for e in entries_of(r["entry"])[1:]:
                of_words.setdefault(e, [0, 0])
                of_words[e][0] += r["bad"]
                of_words[e][1] += r["good"]
    kept = []
    for r in rows:
        bad, good = (r[k] - of_words.get(r["entry"], (0, 0))[j] for j, k in enumerate(("bad", "good")))
        more = not r["entry"].endswith("*") or (bad >= least and bad > SURE * (bad + max(good, 0))) or bad + good <= 0 < len(of_words.get(r["entry"], ()))
        if more and r["low"] > (SURE if r["entry"].endswith("*") else SURE - 0.3):
            kept.append(r["entry"])
    return kept


def _evidence(sample: DataFrame, entries: list[str]) -> list[tuple[int, list[int], list[int]]]:
    """(label, entries present, patterns present) of each text of the sample."""
    index = {e: i for i, e in enumerate(entries)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            low = [t.lower() for t in texts]
            held = [sorted({index[e] for t in set(x.split()) for e in entries_of(t) if e in index}) for x in low]
            shown = [[k for k, f in enumerate(PATTERNS.values()) if f(x, t)] for x, t in zip(low, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(held, pa.list_(pa.int32())), pa.array(shown, pa.list_(pa.int32()))], ["toxic", "held", "shown"])

    return [(r["toxic"], r["held"], r["shown"]) for r in sample.mapInArrow(look, "toxic int, held array<int>, shown array<int>").collect()]


def _votes(rows: list[tuple[int, list[int], list[int]]], entries: list[str]) -> tuple[np.ndarray, list[str]]:
    """Votes of every voter on every text: 1 toxic, -1 clean, 0 nothing."""
    stem = np.array([e.endswith("*") for e in entries], bool)
    place = np.where(stem, np.cumsum(stem), np.cumsum(~stem)) - 1  # by rank among words or stems
    owner = place % LEXICONS + LEXICONS * stem
    names = [f"words{k}" for k in range(LEXICONS)] + [f"stems{k}" for k in range(LEXICONS)] + ["several"] + [f"pattern_{p}" for p in PATTERNS] + ["no_words", "no_stems"]
    v = np.zeros((len(rows), len(names)), np.int8)
    for i, (_, held, shown) in enumerate(rows):
        v[i, owner[held]] = 1
        v[i, 2 * LEXICONS] = len(held) >= 2
        v[i, [2 * LEXICONS + 1 + k for k in shown]] = 1
        v[i, -2] = -int(stem[held].all())
        v[i, -1] = -int((~stem[held]).all())
    return v, names


def _expect(votes: np.ndarray, blocks: list[list[int]], post: np.ndarray, prior: float, rounds: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Posterior after expectation maximisation over P(votes of a block | label): blocks are independent given the label, voters of one block are not. weights: how much the evidence of each block counts."""
    weights = np.ones(len(blocks)) if weights is None else weights
    codes = [np.unique(votes[:, b], axis=0, return_inverse=True)[1].ravel() for b in blocks]
    for _ in range(rounds):
        odds = np.full(len(post), np.log(prior / (1 - prior)))
        for code, weight in zip(codes, weights, strict=True):
            kinds = int(code.max()) + 1
            p1 = (np.bincount(code, post, kinds) + 0.1) / (post.sum() + 0.1 * kinds)
            p0 = (np.bincount(code, 1 - post, kinds) + 0.1) / ((1 - post).sum() + 0.1 * kinds)
            odds += weight * np.log(p1 / p0)[code]
        post = 1 / (1 + np.exp(-odds.clip(-30, 30)))
    return post


def correlations(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Correlation of each two voters given the label: of what the label leaves unexplained of their votes."""
    one, zero = post / max(post.sum(), 1e-9), (1 - post) / max((1 - post).sum(), 1e-9)
    left = votes - (post[:, None] * (one @ votes) + (1 - post[:, None]) * (zero @ votes))
    left = left / (np.sqrt((left**2).mean(0)) + 1e-6)
    return left.T @ left / max(len(votes), 1)


def blocks_of(corr: np.ndarray) -> list[list[int]]:
    """Voters joined in order of their correlations from RELATED on, in blocks of at most BLOCK."""
    own = [[k] for k in range(len(corr))]
    x, y = np.triu_indices(len(corr), 1)
    for k in np.argsort(-np.abs(corr[x, y]), kind="stable"):
        a, b = own[x[k]], own[y[k]]
        if abs(corr[x[k], y[k]]) < RELATED:
            break
        if a is not b and len(a) + len(b) <= BLOCK:
            a += b
            for v in b:
                own[v] = a
    return list({id(b): b for b in own}.values())


def label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the label for each text, accuracy of each voter, and the voters' correlations given the label.

    A first model takes each voter by itself, but voters that say the same count for less, as one voter copied would else be
    taken for the truth. What its labels leave unexplained shows which voters move together; those are modelled jointly, so that their
    agreement counts once.
    """
    prior = min(max(prior, 0.01), 0.5)
    own = votes - votes.mean(0)
    own = own / (np.sqrt((own**2).mean(0)) + 1e-6)
    alone = 1 / np.maximum(((own.T @ own / len(votes)) ** 2).sum(0), 1)  # the share of its evidence that a voter doesn't have in common
    score = votes.clip(0) @ alone * 1.5 + votes.clip(max=0) @ alone
    post = 1 / (1 + np.exp(-(score + np.log(prior / (1 - prior)))))
    post = _expect(votes, [[k] for k in range(votes.shape[1])], post, prior, rounds, alone)
    corr = correlations(votes, post)
    post = _expect(votes, blocks_of(corr), post, prior, rounds)
    said = votes != 0
    right = (post[:, None] * (votes == 1) + (1 - post[:, None]) * (votes == -1)).sum(0)
    return post, (right + 1) / (said.sum(0) + 2), correlations(votes, post)


def _fit(rows: list[tuple[int, list[int], list[int]]], target: np.ndarray, size: int, rounds: int = 400) -> np.ndarray:
    """Logistic regression on the presence of entries and patterns, by Adam on the whole sample; the last weight is the bias."""
    own = [[*held, *(size - 1 - len(PATTERNS) + k for k in shown), size - 1] for _, held, shown in rows]
    row = np.repeat(np.arange(len(own)), [len(o) for o in own])
    col = np.array([c for o in own for c in o])
    w, m, s = np.zeros(size), np.zeros(size), np.zeros(size)
    balance = np.where(target > 0.5, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.bincount(row, w[col], len(own)).clip(-30, 30)))
        g = np.bincount(col, (balance * (p - target))[row], size) / len(own) + 1e-4 * np.append(w[:-1], 0)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic). Without a label of either kind the model scores all texts low.

    About `most` labelled texts train it, whatever the size of the tables: the lexicon, the label model and the classifier
    are all fitted on that sample. The score is moved so that THRESHOLD is where the labels of the sample are met best.
    """
    sample = training_sample(docs, labels, most)
    entries = lexicon(sample)
    rows = sorted(_evidence(sample, entries)) if entries else []
    gold = np.array([r[0] > 0 for r in rows])
    if not len(rows) or gold.all() or not gold.any():
        return Model()
    votes, names = _votes(rows, entries)
    post, accuracy, corr = label_model(votes, float(gold.mean()))
    size = len(entries) + len(PATTERNS) + 1
    w = _fit(rows, post, size)
    z = np.array([w[held].sum() + w[[len(entries) + k for k in shown]].sum() for _, held, shown in rows]) + w[-1]
    order = np.argsort(-z)
    hits = np.cumsum(gold[order])
    last = np.append(z[order][1:] != z[order][:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(z) + 1) + gold.sum()), 0)
    best = int(np.argmax(f1))
    cut = 0.3 * z[order][best] + 0.7 * (z[order][best + 1] if best + 1 < len(z) else z[order][best] - 1)
    bias = w[-1] - cut + np.log(THRESHOLD / (1 - THRESHOLD))
    return Model(dict(zip(entries, w.tolist(), strict=False)), dict(zip(PATTERNS, w[len(entries) : -1].tolist(), strict=True)), float(bias), dict(zip(names, accuracy.tolist(), strict=True)), corr)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from THRESHOLD on) to docs by their whole text alone; a null text is empty.

    Columns stay, but for those of these two names, which are replaced. Equal texts score equally, rows that repeat are kept
    each, and an empty table gives no rows.
    """
    docs = docs.drop("score", "predicted")
    hidden = free("_text", docs)
    index = {e: i for i, e in enumerate(model.weights)}
    weights = np.array(list(model.weights.values()) or [0.0])

    class Memo(dict):
        def __missing__(self, token: str) -> tuple[int, ...]:
            if len(self) > MEMO:
                self.clear()
            self[token] = found = tuple(index[e] for e in entries_of(token) if e in index)
            return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch, texts in _texts(batches, hidden):
            z = np.empty(len(texts))
            for i, text in enumerate(texts):
                low = text.lower()
                held = {k for found in filter(None, map(memo.__getitem__, set(low.split()))) for k in found}
                z[i] = model.bias + weights[sorted(held)].sum() + sum(v for p, v in model.patterns.items() if PATTERNS[p](low, text))
            p = 1 / (1 + np.exp(-z.clip(-30, 30)))
            names = [n for n in batch.schema.names if n != hidden]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], [*names, "score", "predicted"])

    schema = StructType([*docs.schema, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.withColumn(hidden, F.col("text").cast("binary")).mapInArrow(run, schema)


def learn_folds(docs: DataFrame, labels: DataFrame) -> Model:
    """train() on the rows that aren't held out."""
    return train(docs.select("doc_id", "text"), labels.where(fold_of(F.col("doc_id")) != 1))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_folds(docs, table(spark, sf_dir, "labels"))
    own = docs.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "text")
    return score(own, model).select("doc_id", "held_out", "score", "predicted")
