"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is a chain of symbols, one for each character. Every adjacent pair that is a piece goes on an agenda, ordered by
score and then by place; the best pair is merged and its new neighbours are added, until the agenda is empty. What is
no piece then falls back to the pieces of its bytes. No merge crosses a border of two characters that no piece holds side by
side, so texts are cut at such borders first and each distinct chunk is encoded once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, raw, release, slices, table

MEMO = 200_000  # chunks after which a worker sets its memo aside; it keeps the last two, so that frequent chunks stay
SHORT = 40  # characters of a chunk whose pairs are looked through rather than kept in a heap
LONG = 100  # characters of a chunk beyond which it isn't remembered
#: Fixed values of the model file: the sign that stands for a space, kinds of pieces, kind of model.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MERGES = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffers message; fixed-width values as bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            if key & 7 == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """Pieces and rules of a model file. Models that aren't of merge type, that rewrite characters or whose vocabulary has pieces set by the user or unused ones are refused."""

    def __init__(self, data: bytes):
        trainer, normal = {}, {}
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.special: dict[str, int] = {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                piece, kind = own.get(1, b"").decode(), own.get(3, NORMAL)
                if kind in (USER, UNUSED):
                    raise ValueError(f"piece {piece!r} is set by the user or unused")
                if kind == NORMAL:
                    self.ids.setdefault(piece, len(self.pieces))
                    self.score.setdefault(piece, float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                else:
                    self.special.setdefault(piece, len(self.pieces))
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normal = dict(fields(value))
        if trainer.get(3, 1) != MERGES or trainer.get(24, 0):
            raise ValueError("the model is not of merge type, or has spaces at the end of words")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("the model rewrites characters, removes spaces or does not escape them")
        self.prefix = bool(normal.get(3, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.begin, self.end = self.special.get("<s>"), self.special.get("</s>")
        self.bytes = [self.special.get(f"<0x{b:02X}>") for b in range(256)]
        if not trainer.get(35, 0) or None in self.bytes:
            raise ValueError("the vocabulary has no pieces of bytes to fall back to")
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        # Ranks of scores, and what a symbol adds to ids and text.
        ranks = {v: k for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: ranks[v] for p, v in self.score.items()}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self.text = [bytes((self.byte_of[i],)) if i in self.byte_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.cut = self._cutter()

    def _cutter(self):
        """A function that cuts a text where no piece holds the two characters side by side: between families of characters that pieces join, and before a space."""
        beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        spaced = any(pair[1] == SPACE != pair[0] for pair in beside)
        family: dict[str, str] = {}

        def head(c: str) -> str:
            while family.setdefault(c, c) != c:
                family[c] = c = family[family[c]]
            return c

        for x, y in beside:
            if SPACE not in (x, y) or spaced:
                family[head(x)] = head(y)
            else:
                head(y if x == SPACE else x)
        groups: dict[str, list[str]] = {}
        for c in sorted(family):
            if c != SPACE or spaced:
                groups.setdefault(head(c), []).append(c)
        own = ["[" + "".join(map(re.escape, g)) + "]+" for g in sorted(groups.values(), key=len, reverse=True)]
        led = "" if spaced else f"{SPACE}*"
        return re.compile("|".join([f"{led}(?:{'|'.join(own)})"] * bool(own) + [f"{SPACE}+", "."]), re.S).findall

    def normal(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if text and self.prefix else text

    def merge(self, chunk: str) -> list[str]:
        """The symbols of a chunk after all merges, best score first, leftmost first among equals."""
        return self._merge_short(chunk) if len(chunk) <= SHORT else self._merge_long(chunk)

    def _merge_short(self, chunk: str) -> list[str]:
        """The agenda is the list of the pairs' ranks, and the best is found by looking through it."""
        symbols, rank, none = list(chunk), self.rank.get, 1 << 40
        agenda = [rank(chunk[k : k + 2], none) for k in range(len(chunk) - 1)]
        while agenda and (best := min(agenda)) != none:
            k = agenda.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del agenda[k]
            if k < len(agenda):
                agenda[k] = rank(symbols[k] + symbols[k + 1], none)
            if k:
                agenda[k - 1] = rank(symbols[k - 1] + symbols[k], none)
        return symbols

    def _merge_long(self, chunk: str) -> list[str]:
        """The agenda is a heap; an entry is out of date when the pair at its place has another rank."""
        symbols: list[str | None] = list(chunk)
        last, rank = len(symbols), self.rank.get
        after, before = list(range(1, last + 1)), list(range(-1, last - 1))
        agenda = [(r, k) for k in range(last - 1) if (r := rank(chunk[k : k + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            best, left = heapq.heappop(agenda)
            own = symbols[left]
            if own is None or (right := after[left]) == last or rank(piece := own + symbols[right]) != best:
                continue
            symbols[left], symbols[right] = piece, None
            after[left] = following = after[right]
            if following < last:
                before[following] = left
                if (r := rank(piece + symbols[following])) is not None:
                    heapq.heappush(agenda, (r, left))
            if (preceding := before[left]) >= 0 and (r := rank(symbols[preceding] + piece)) is not None:
                heapq.heappush(agenda, (r, preceding))
        return [s for s in symbols if s is not None]

    def encode_chunk(self, chunk: str) -> list[int]:
        ids, found = self.ids, []
        for symbol in (chunk,) if len(chunk) == 1 else self.merge(chunk):
            own = ids.get(symbol)
            found += (own,) if own is not None else [self.bytes[b] for b in symbol.encode()]
        return found

    def encode(self, text: str) -> list[int]:
        """Ids without begin and end."""
        return [i for chunk in self.cut(self.normal(text)) for i in self.encode_chunk(chunk)]

    def decode(self, ids, start: bool = True) -> str:
        """The text of ids: control pieces are nothing, the prefix's space at the start goes, wrong bytes become U+FFFD each."""
        out: list[str] = []
        held = bytearray()
        seen = False  # whether the prefix's space has gone

        def flush() -> None:
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()

        for i in ids:
            if (byte := self.byte_of.get(i)) is not None:
                held.append(byte)
                continue
            flush()
            if seen or any(out):
                start = False
            kind, piece, seen = self.kinds[i], self.pieces[i], False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.surface)
                continue
            if start and self.prefix and piece.startswith(SPACE):
                piece, seen = piece[1:], True
            out.append(piece.replace(SPACE, " "))
        flush()
        return "".join(out)


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that belongs to no character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            size = next((n for n in (1, 2, 3, 4) if _whole(data[at : at + n])), 0)
            out.append(data[at : at + size].decode() if size else "�")
            at += size or 1
        return "".join(out)


def _whole(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


class Memo(dict):
    """Packed ids by chunk; what isn't there is encoded. Keeps to about twice MEMO chunks, so that frequent ones stay."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if (found := self.old.get(chunk)) is None:
            found = b"".join(map(self.model.packed.__getitem__, self.model.encode_chunk(chunk)))
        if len(chunk) <= LONG:
            self[chunk] = found
        return found

    def rest(self) -> None:
        """Between texts: set the memo aside when it is full."""
        if len(self) > MEMO:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.old = {}
        release()


class Coder:
    """Encodes texts and decodes what it has encoded; remembers the ids of chunks."""

    def __init__(self, model: Model):
        self.model, self.memo = model, Memo(model)

    def encode(self, text: str) -> bytes:
        """Ids of 32 bits each, without begin and end."""
        self.memo.rest()
        return b"".join(map(self.memo.__getitem__, self.model.cut(self.model.normal(text))))

    def decode(self, ids: bytes) -> bytes:
        """The text, in UTF-8, of ids that encode() gave; their bytes make whole characters."""
        text = b"".join(map(self.model.text.__getitem__, memoryview(ids).cast("I")))
        return text[1:] if self.model.prefix and text.startswith(b" ") else text


_CODERS: dict[int, Coder] = {}


def _coder(data: bytes) -> Coder:
    """The worker's coder; one is kept from task to task."""
    if hash(data) not in _CODERS:
        _CODERS.clear()
        _CODERS[hash(data)] = Coder(Model(data))
    return _CODERS[hash(data)]


def model_data(path: str) -> bytes:
    """The model is read on the driver and goes to the executors with the task; it has half a MB whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def _strings(batch: pa.RecordBatch, column: str) -> list[str]:
    data, offsets = raw(batch.column(column))
    body = data.tobytes()
    return [body[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in range(batch.num_rows)]


def with_pieces(docs: DataFrame, path: str, begin: bool = True, end: bool = True, digests: bool = False) -> DataFrame:
    """Add piece_ids (array<int>) and decoded (string) to docs; with digests n_tokens, ids_sha256 and decoded_sha256 instead.

    begin and end: whether the ids of begin and end come too. A null text is empty and has no ids but those. Columns stay,
    but for those of the added names, which are replaced; rows that repeat are kept each; an empty table gives no rows.
    """
    data = model_data(path)
    Model(data)  # a model that can't be used is refused here
    added = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] if digests else [("piece_ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")]
    docs = docs.drop(*[a[0] for a in added])
    hidden = free("_text", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(data)
        m = coder.model
        first, last = (np.array([i] if on else [], "<u4").tobytes() for i, on in ((m.begin, begin), (m.end, end)))
        for batch in slices(batches, hidden, 1 << 20):
            rows = []
            for text in _strings(batch, hidden):
                ids = coder.encode(text)
                decoded = coder.decode(ids)
                ids = first + ids + last
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else (np.frombuffer(ids, "<u4").astype(np.int32), decoded.decode()))
            names = [n for n in batch.schema.names if n != hidden]
            new = [pa.array([r[k] for r in rows], a[1]) for k, a in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *new], [*names, *[a[0] for a in added]])
        coder.memo.forget()

    schema = ", ".join([*[f"`{n}` {t}" for n, t in docs.dtypes], *[f"{a[0]} {a[2]}" for a in added]])
    return docs.withColumn(hidden, F.col("text").cast("binary")).mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, path: str, column: str = "piece_ids") -> DataFrame:
    """Add decoded (string) from an array of ids. Null ids give the empty text. A column decoded is replaced."""
    data = model_data(path)
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _coder(data).model
        for batch in batches:
            own = pa.array([m.decode(i or []) for i in batch.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in rows.dtypes], "decoded string"]))


def differing(docs: DataFrame, path: str) -> DataFrame:
    """The rows of docs whose ids or decoded text aren't those of the sentencepiece library, batch by batch; none if all is well."""
    data = model_data(path)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=data)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            decoded = library.decode(ids)
            own = zip(batch.column("_ids").to_pylist(), batch.column("_decoded").to_pylist(), strict=True)
            bad = [k for k, (i, d) in enumerate(own) if i != ids[k] or d != decoded[k]]
            yield batch.select(columns).take(pa.array(bad, pa.int64()))

    own = with_pieces(docs.withColumn("_all", F.struct(*columns)), path).select("_all", F.col("piece_ids").alias("_ids"), F.col("decoded").alias("_decoded"))
    return own.select("_all.*", "_ids", "_decoded").mapInArrow(run, docs.schema)


def op13_pieces(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_pieces(docs, path or public_tokenizers.path("piece_bpe_32k.model"), digests=True).drop("text")
