"""Edit-aware token counts: a segment tree of pre-token counts per document; an edit re-encodes only what it touches.

A tree's leaves hold a few pre-tokens each, as their number of characters and of tokens; every node above holds the sums
of its two children. Trees are stored as the leaves alone, in two arrays beside the text. An edit finds its leaves by
descent, cuts them and some context into pre-tokens again, encodes these, and mends the sums on the way up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Counter, _encoder, _strings, vocabulary_text
from .common import slices, table

LEAF = 16  # pre-tokens in a leaf
MOST = 4 * LEAF  # pre-tokens of a leaf after edits; beyond it the leaves are cut anew
LEAST = 32  # characters of context encoded beside an edit at first; doubled until both sides meet the old cuts


class Tree:
    """The counts of a text. encoded tells how many pre-tokens edits have encoded so far."""

    def __init__(self, encoder: Counter, text: str, words: list[str] | None = None, leaves: tuple[list[int], list[int]] | None = None):
        self.encoder, self.text, self.encoded = encoder, text, 0
        if leaves is None:
            words = encoder.words(text) if words is None else words
            encoder.learn(set(words))
            leaves = self._sums([words[k : k + LEAF] for k in range(0, len(words), LEAF)])
        self._raise(*leaves)

    def _sums(self, parts: list[list[str]]) -> tuple[list[int], list[int]]:
        known = self.encoder.known.__getitem__
        return [sum(map(len, p)) for p in parts], [sum(map(known, p)) for p in parts]

    def _raise(self, chars: list[int], tokens: list[int]) -> None:
        """Build the levels of sums over the leaves."""
        self.chars, self.tokens = [chars or [0]], [tokens or [0]]
        for levels in (self.chars, self.tokens):
            while len(low := levels[-1]) > 1:
                levels.append([a + b for a, b in zip(low[::2], [*low[1::2], 0], strict=False)])

    @property
    def total(self) -> int:
        return self.tokens[-1][0]

    def _leaf(self, at: int) -> tuple[int, int]:
        """(leaf, characters before it) of the leaf that holds character at, by descent."""
        k = before = 0
        for low in reversed(self.chars[:-1]):
            k *= 2
            if k + 1 < len(low) and before + low[k] <= at:
                before += low[k]
                k += 1
        return k, before

    def replace(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end] by new and return the count of all tokens; places beyond the text count as its end.

        Text is cut into pre-tokens again from a cut some way before the edit until a cut after it that the old text has
        at the same place; a cut stands only if the pattern, started there, cuts alike, so context widens until it does.
        """
        old, n = self.text, len(self.text)
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        self.text, shift = old[:start] + new + old[end:], len(new) - (end - start)
        context = max(LEAST, 2 * self.encoder.longest)
        while True:
            first, left = self._leaf(max(0, start - context))
            last, right = self._leaf(max(0, min(n - 1, end + context)))
            right += self.chars[0][last]
            words = self._cut(self.text, left, right + shift)
            if left == 0 and right == n or self._meets(self._cut(old, left, right), words, start - left, right - end, left == 0, right == n):
                break
            context *= 2
        self.encoded += len(words)
        self.encoder.learn(set(words))
        self._put(first, last, words)
        return self.total

    def _cut(self, text: str, left: int, right: int) -> list[str] | None:
        """Pre-tokens of text[left:right] as they are cut with what follows in sight; none if right is no cut."""
        after = min(len(text), right + self.encoder.longest + 1) - right
        words = self.encoder.words(text[left : right + after])
        while after > 0:
            after -= len(words.pop())
        return words if not after else None

    def _put(self, first: int, last: int, words: list[str]) -> None:
        """Deal words to the leaves from first to last; the tree keeps its shape unless they are too many."""
        each = -(-len(words) // (last + 1 - first))
        if each > MOST:
            parts = [words[k : k + LEAF] for k in range(0, len(words), LEAF)]
        else:
            parts = [words[k * each : (k + 1) * each] for k in range(last + 1 - first)]
        chars, tokens = self._sums(parts)
        self.chars[0][first : last + 1], self.tokens[0][first : last + 1] = chars, tokens
        if each > MOST:
            self._raise(self.chars[0], self.tokens[0])
            return
        for n in range(1, len(self.chars)):
            first, last = first >> 1, last >> 1
            for levels in (self.chars, self.tokens):
                for k in range(first, last + 1):
                    levels[n][k] = sum(levels[n - 1][2 * k : 2 * k + 2])

    def _meets(self, old: list[str] | None, new: list[str] | None, head: int, tail: int, at_start: bool, at_end: bool) -> bool:
        """Whether old and new begin with the same pre-token before the edit and end with the same three after it, so that the cuts beyond stand."""
        if old is None or new is None:
            return False
        begins = at_start or bool(old and new and old[0] == new[0] and len(old[0]) <= head)
        ends = at_end or len(old) > 2 and old[-3:] == new[-3:] and sum(map(len, old[-3:])) <= tail
        return begins and ends


def edits_of(text: str) -> list[tuple[int, int, str]]:
    """The edits that the query applies to a text in turn: a word put in at a third, a stretch cut at the middle, one doubled near the end."""
    n = len(text)
    third, half = n // 3, n // 2
    cut = min(40, n - half)
    late = max(0, n - cut - n // 5)
    return [(third, third, " inserted"), (half, half + cut, ""), (late, late, text[half : half + 20])]


def _trees(encoder: Counter, texts: list[str]) -> list[Tree]:
    split = list(map(encoder.words, texts))
    encoder.learn(set().union(*split))
    return [Tree(encoder, t, w) for t, w in zip(texts, split, strict=True)]


def build(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, n_tokens, leaf_chars, leaf_tokens) of each row of docs: the trees to store, for apply() to take up.

    Other columns are left out. A null text is empty; rows that share an id have a tree each; an empty table gives none.
    """
    vocabulary = vocabulary_text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, Counter)
        for batch in slices(batches, "_text", 1 << 20):
            yield _stored(batch.column("doc_id"), _trees(encoder, _strings(batch)))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, text string, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>")


def _stored(ids: pa.Array, trees: list[Tree]) -> pa.RecordBatch:
    leaves = [pa.array([getattr(t, c)[0] for t in trees], pa.list_(pa.int32())) for c in ("chars", "tokens")]
    return pa.RecordBatch.from_arrays([ids, pa.array([t.text for t in trees], pa.string()), pa.array([t.total for t in trees], pa.int64()), *leaves], ["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])


def apply(trees: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The trees of build() after edits (doc_id, seq, start, end, new), applied to each document in order of seq.

    Places count characters of the text as the earlier edits left it; beyond the text they count as its end. A null new
    deletes. Edits of no document and those without an id change nothing; trees that share an id are edited alike. Edits of one seq follow each other by
    start, end, new. Trees without edits pass as they are.
    """
    vocabulary = vocabulary_text(path)
    edit = F.struct("seq", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("new", F.lit("")).alias("new"))
    of = edits.where("doc_id is not null and start is not null and end is not null").groupBy("doc_id").agg(F.sort_array(F.collect_list(edit)).alias("_edits"))
    rows = trees.join(of, "doc_id", "left").select("doc_id", F.col("text").cast("binary").alias("_text"), "leaf_chars", "leaf_tokens", "_edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, Counter)
        for batch in slices(batches, "_text", 1 << 20):
            out = []
            leaves = (batch.column(c).to_pylist() for c in ("leaf_chars", "leaf_tokens", "_edits"))
            for text, chars, tokens, own in zip(_strings(batch), *leaves, strict=True):
                tree = Tree(encoder, text, leaves=(chars, tokens))
                for e in own or ():
                    tree.replace(e["start"], e["end"], e["new"])
                out.append(tree)
            yield _stored(batch.column("doc_id"), out)

    return rows.mapInArrow(run, "doc_id bigint, text string, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>")


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens (of the text), n_edited (after the edits of edits_of), n_encoded (pre-tokens encoded for the edits) and n_leaves of each document.

    Trees are built and edited in one pass; a worker keeps its counts of words, which are bounded, from task to task. A null text is empty; rows that repeat or have no id are counted each; an
    empty table gives no rows; other columns are left out.
    """
    vocabulary = vocabulary_text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, Counter)
        for batch in slices(batches, "_text", 1 << 20):
            rows = []
            for tree in _trees(encoder, _strings(batch)):
                before = tree.total
                for start, end, new in edits_of(tree.text):
                    tree.replace(start, end, new)
                rows.append((before, tree.total, tree.encoded, len(tree.chars[0])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]], ["doc_id", "n_tokens", "n_edited", "n_encoded", "n_leaves"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_edited bigint, n_encoded bigint, n_leaves bigint")


def op7_token_counts(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """token_counts() of documents."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
