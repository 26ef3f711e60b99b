"""Counts of words are kept from task to task."""

import pyarrow as pa
import public_tokenizers

from docflow.llm import bpe, edits


def test_words_of_an_earlier_task_are_not_encoded_again(spark, monkeypatch):
    class Rows:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    encoded, plain = [], bpe.Vocabulary.encode_words
    monkeypatch.setattr(bpe.Vocabulary, "encode_words", lambda self, words: encoded.extend(words) or plain(self, words))
    run = edits.token_counts(Rows(), public_tokenizers.path("byte_bpe_50k.json"))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "_text": [b"some words of a text", b""]})
    first, before = [b.to_pylist() for b in run(iter([batch]))], len(encoded)
    assert before and [b.to_pylist() for b in run(iter([batch]))] == first and len(encoded) == before
