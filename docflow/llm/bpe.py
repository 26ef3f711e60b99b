"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a prefix ends in one token that the prefix alone decides: the longest-first suffix token that BPE keeps
apart from the last token of what stands before it. So each node of a trie of distinct words holds one state, its last
token, and a word's encoding is read back from its node by steps of whole tokens. Words are visited in order, depth
first, and a prefix that several words share is computed once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, raw, release, slices, table

#: Fixed values of the byte-level vocabulary: its pre-token pattern, and the bytes that stand for themselves.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of_character() -> dict[str, int]:
    other = [b for b in range(256) if b not in _PLAIN]
    return {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(other)}


class Vocabulary:
    """Tokens, ids and merges of a byte-level BPE file of the tokenizers library, read from its text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        to_byte = _byte_of_character()
        self.ids = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # by token: the pair that merges into it, and its rank
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (bytes(to_byte[c] for c in x) for x in (m.split(" ") if isinstance(m, str) else m))
            pair = self.ids[a], self.ids[b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(self.ids[a + b], (*pair, r))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.size = {i: len(t) for t, i in self.ids.items()}
        self.width = max(self.bytes) + 1
        self._kept: dict[int, bool] = {}  # by left * width + right
        rank_of = lambda t: self.parts[t][2] if t in self.parts else -1
        self.grows = all(rank_of(a) < r and rank_of(b) < r for a, b, r in self.parts.values())
        # A token that BPE would not build of its own bytes is no state.
        self.stable: set[int] = set()
        for i in sorted(self.bytes, key=lambda i: len(self.bytes[i])):
            if i in self.parts:
                a, b, _ = self.parts[i]
                kept = a in self.stable and b in self.stable and not self._crossed(a, b, inner=True) if self.grows else self._merge(self.bytes[i]) == [i]
            else:
                kept = len(self.bytes[i]) == 1
            if kept:
                self.stable.add(i)
        # States of the walk over a word's bytes: the beginnings of tokens, the empty one first.
        self._begins = sorted({t[:k] for t in self.ids for k in range(len(t) + 1)})
        self._state_of = {t: k for k, t in enumerate(self._begins)}
        self._ends: list[tuple[int, ...] | None] = [None] * len(self._begins)
        self._next: dict[int, int] = {}

    def _merge(self, word: bytes) -> list[int]:
        """The encoding by merges in order of rank; only for vocabularies whose merges don't grow in rank, and for tests."""
        own = [self.ids[word[k : k + 1]] for k in range(len(word))]
        while len(own) > 1:
            r, k = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(own, own[1:])))  # noqa: B905
            if r == 1 << 60:
                break
            own[k : k + 2] = [self.ids[self.bytes[own[k]] + self.bytes[own[k + 1]]]]
        return own

    def _crossed(self, left: int, right: int, inner: bool = False) -> bool:
        """Whether a merge across the border comes before those that build the two tokens; with inner, their own merge doesn't count.

        Back in time from the finished tokens: x and y are the pieces at the border, until is when each is used up.
        The younger piece is taken apart, at equal rank the right one, as BPE merges the leftmost pair first.
        """
        x, y, x_until, y_until, parts, rank = left, right, 1 << 60, 1 << 60, self.parts, self.rank
        while True:
            r = rank.get((x, y))
            if r is not None and r < x_until and r <= y_until and not inner:
                return True
            inner = False
            a, b = parts.get(x), parts.get(y)
            if a is None and b is None:
                return False
            if b is None or a is not None and a[2] > b[2]:
                x, x_until = a[1], a[2]
            else:
                y, y_until = b[0], b[2]

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE encodes the bytes of the two tokens as just these two."""
        key = left * self.width + right
        if (known := self._kept.get(key)) is None:
            if len(self._kept) > 100_000:
                self._kept.clear()
            known = not self._crossed(left, right) if self.grows else self._merge(self.bytes[left] + self.bytes[right]) == [left, right]
            self._kept[key] = known
        return known

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest beginning of a token that the bytes so far end in. Its tokens are found on the first visit."""
        own = self._begins[state] + bytes((byte,))
        while own not in self._state_of:
            own = own[1:]
        to = self._state_of[own]
        if self._ends[to] is None:
            found = (self.ids.get(own[k:]) for k in range(len(own)))
            self._ends[to] = tuple(t for t in found if t is not None and t in self.stable)
        if len(self._next) > 200_000:
            self._next.clear()
        self._next[state << 8 | byte] = to
        return to

    def encode_words(self, words: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words.

        The stacks hold, at each byte of the path from the root to the current node, the last token and the state that
        tells which tokens end there (longest first), so that no others are tried.
        """
        out, stack, before = {}, [], b""
        apart, kept, width, step, following, ends, size = self.apart, self._kept, self.width, self._step, self._next, self._ends, self.size
        states = [0]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del stack[shared:], states[shared + 1 :]
            state = states[-1]
            for end, byte in enumerate(word[shared:], shared + 1):
                to = following.get(state << 8 | byte)
                state = step(state, byte) if to is None else to
                states.append(state)
                for token in ends[state]:
                    start = end - size[token]
                    if not start:
                        stack.append(token)
                        break
                    left = stack[start - 1]
                    known = kept.get(left * width + token)
                    if apart(left, token) if known is None else known:
                        stack.append(token)
                        break
            found, at = [], len(word)
            while at:
                found.append(stack[at - 1])
                at -= size[stack[at - 1]]
            out[word], before = tuple(found[::-1]), word
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Encoder:
    """Encodes batches of texts; remembers words up to a bound."""

    MEMO = 80_000  # words after which a worker sets its memo aside; it keeps the last two, so that frequent words stay

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")").split if vocabulary.special else None
        self.longest = max(map(len, vocabulary.special), default=0)
        self.known, self.old = {}, {}  # value() of each word

    def words(self, text: str) -> list[str]:
        """Pre-tokens and special tokens of the text, in order."""
        if not self.split or not any(s in text for s in self.vocabulary.special):
            return self.find(text)
        return [w for k, part in enumerate(self.split(text)) for w in ([part] if k % 2 else self.find(part))]

    def value(self, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
        """What is remembered of a word: number of tokens, ids with commas, decoded bytes."""
        return len(ids), ",".join(map(str, ids)), self.vocabulary.decode(ids)

    def learn(self, words: set[str]) -> None:
        """Add value() of the words that aren't known."""
        if len(self.known) > self.MEMO:
            self.old, self.known = self.known, {}
        v, known, old = self.vocabulary, self.known, self.old
        fresh = words.difference(known)
        if old:
            again = [w for w in fresh if w in old]
            known.update((w, old[w]) for w in again)
            fresh.difference_update(again)
        coded = {w: w.encode() for w in fresh}
        found = v.encode_words([b for w, b in coded.items() if w not in v.special])
        for w, b in coded.items():
            known[w] = self.value((v.special[w],) if w in v.special else found[b])

    def forget(self) -> None:
        """Drop what is remembered of words, at the end of a task; the vocabulary stays."""
        for memo in (self.known, self.old, self.vocabulary._kept, self.vocabulary._next):
            memo.clear()
        release()

    def ids(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        self.learn(set().union(*split))
        return [[int(i) for w in s for i in self.known[w][1].split(",")] for s in split]


class Counter(Encoder):
    """An encoder that remembers only the number of tokens of a word."""

    MEMO = 200_000  # numbers take little memory

    def value(self, ids: tuple[int, ...]) -> int:
        return len(ids)


_ENCODERS: dict[tuple[int, type], Encoder] = {}


def _encoder(text: str, kind: type = Encoder) -> Encoder:
    """The worker's encoder; one is kept from task to task."""
    key = hash(text), kind
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = kind(Vocabulary(text))
    return _ENCODERS[key]


def _strings(batch: pa.RecordBatch, column: str = "_text") -> list[str]:
    data, offsets = raw(batch.column(column))
    body = data.tobytes()
    return [body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in range(batch.num_rows)]


def vocabulary_text(path: str) -> str:
    """The vocabulary is read on the driver and goes to the executors with the task; it has a few MB whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def with_tokens(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """Add token_ids (array<int>) and decoded (string) to docs; with digests, n_tokens, ids_sha256 and decoded_sha256 instead.

    A null text is empty: no tokens. Special tokens of the file are matched in the text, as the library does by default.
    Columns stay, but for those of the added names, which are replaced; rows that repeat are kept each; an empty table gives no rows.
    """
    text = vocabulary_text(path)
    added = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] if digests else [("token_ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")]

    docs = docs.drop(*[a[0] for a in added])
    hidden = free("_text", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(text)
        for batch in slices(batches, hidden, 1 << 18):
            split = [encoder.words(t) for t in _strings(batch, hidden)]
            encoder.learn(set().union(*split))
            rows = []
            for s in split:
                found = list(map(encoder.known.__getitem__, s))
                ids, whole = ",".join([f[1] for f in found]), b"".join([f[2] for f in found])
                if digests:
                    rows.append((sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(whole).hexdigest()))
                else:
                    rows.append(([int(i) for i in ids.split(",")] if ids else [], whole.decode("utf-8", "replace")))
            names = [n for n in batch.schema.names if n != hidden]
            new = [pa.array([r[k] for r in rows], a[1]) for k, a in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], [*names, *[a[0] for a in added]])
        encoder.forget()

    return docs.withColumn(hidden, F.col("text").cast("binary")).mapInArrow(run, _ddl(docs, added))


def _ddl(docs: DataFrame, added: list[tuple]) -> str:
    return ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes], *[f"`{a[0]}` {a[2]}" for a in added]])


def decode_ids(ids: DataFrame, path: str, column: str = "token_ids") -> DataFrame:
    """Add decoded (string) from an array of ids; bytes that aren't UTF-8 become U+FFFD. Null ids give the empty text. A column decoded is replaced."""
    text = vocabulary_text(path)

    ids = ids.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(text).vocabulary
        for batch in batches:
            own = pa.array([v.decode(i or []).decode("utf-8", "replace") for i in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "decoded"])

    return ids.mapInArrow(run, _ddl(ids, [("decoded", None, "string")]))


def op10_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_tokens(docs, path or public_tokenizers.path("byte_bpe_50k.json"), digests=True).drop("text")
