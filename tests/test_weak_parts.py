"""Predicted entities, fused readings, labels of tokens, codes of new shipments, tolerance: against plain loops."""

import json
import random

from pyspark.sql import functions as F

from docflow.operators import documents, registry, shipments, training
from docflow.sources import files


def plain_entities(tokens, threshold):
    out, label, parts, sure, at, done = [], None, [], 0.0, None, None

    def flush():
        if label and " ".join(parts).strip():
            out.append((at, label, " ".join(parts).strip(), sure))

    for pos, word, text, name, conf in tokens:
        if word is None or word == done:
            continue
        name = name if conf >= threshold else "O"
        if name == "O":
            flush()
            label = None
        elif name[0] == "B" or (label and name[2:] != label):
            flush()
            label, parts, sure, at, done = name[2:], [text], conf, pos, word
        elif label:
            parts, sure, done = [*parts, text], max(sure, conf), word
    flush()
    return out


def test_entities(spark):
    rng = random.Random(8)
    pages, want = [], set()
    for page in range(250):
        word, tokens = 0, []
        for pos in range(rng.randrange(14)):
            word += rng.choice([0, 1, 1])
            tokens.append((pos, rng.choice([word, word, word, None]), f"t{word}", rng.choice(["O", "B-a", "I-a", "I-b", "B-b", "I-a"]), rng.choice([0.2, 0.5, 0.7, 0.9])))
        pages += [(page, *t) for t in tokens]
        want |= {(page, *e) for e in plain_entities(tokens, 0.5)}
    frame = spark.createDataFrame(pages, "page_id long, pos long, word long, text string, label string, confidence double")
    assert {tuple(r) for r in documents.predicted_entities(frame).collect()} == want
    assert documents.predicted_entities(frame.limit(0)).count() == 0


def test_fused(spark):
    schema = "id long, bl_number string, containers array<string>, n_items long, confidence double"
    own = spark.createDataFrame([(1, "", ["A", "B"], 2, 0.4), (2, "N", None, 2, 0.6), (3, None, [], None, None)], schema)
    second = spark.createDataFrame([(1, "V", ["B", "C"], 2, None), (2, "V", ["Z"], 2, None), (4, "W", ["Q"], 1, None)], schema)
    got = {tuple(r[:2]) + (tuple(r[2]), r[3]) for r in documents.fused(own, second).collect()}
    assert got == {(1, "V", ("A", "B", "C"), "second"), (2, "N", ("Z",), "own"), (3, None, (), "own"), (4, "W", ("Q",), "second")}


def test_token_labels(spark):
    page = spark.createDataFrame([(1, ["a b", " ", "c"], [[10.0, 20.0, 50.0, 400.0], [0.0] * 4, [-5.0, 0.0, 0.0, 1.0]], [3, 1, -1], 100.0, 200.0), (2, [], [], [], 0.0, None), (3, ["x"], [[1.0, 1.0, 2.0, 2.0]], [0], 0.0, None)], "id long, text array<string>, bboxes array<array<double>>, labels array<bigint>, width double, height double")
    got = {r["id"]: (r["text"], r["bboxes"], r["labels"]) for r in training.split_words(page).collect()}
    assert got[1] == (["a", "b", "c"], [[100, 100, 500, 1000], [100, 100, 500, 1000], [0, 0, 0, 5]], [3, 3, 0]) and got[2] == ([], [], []) and got[3] == (["x"], [[1000, 1000, 1000, 1000]], [0])
    ids = spark.createDataFrame([([None, 0, 0, 1, 2, 9], [3, 3, 0])], "w array<bigint>, l array<bigint>").select(training.token_labels(F.col("w"), F.col("l")).alias("x")).first()
    assert ids["x"] == [-100, 3, 3, 3, 0, -100]
    assert [r["id"] for r in training.with_labels(page).collect()] == [1]


def test_codes(spark):
    few = lambda key, k: F.concat(F.lit("C"), ((key + k) % 4).cast("string"))  # noqa: E731  codes that collide
    new = spark.createDataFrame([(i, {"a": i}) for i in range(6)], "id long, extra map<string, long>")
    existing = spark.createDataFrame([("C1",), (None,)], "reference_code string")
    got = {r["id"]: r["reference_code"] for r in shipments.with_reference_codes(new, existing, code=few).collect()}
    codes = [c for c in got.values() if c]
    assert len(got) == 6 and sorted(codes) == ["C0", "C2", "C3"] and got[0] == "C0" and got[2] == "C2" and got[3] == "C3"
    real = shipments.with_json(shipments.with_reference_codes(new, existing), "extra").collect()
    assert len({r["reference_code"] for r in real}) == 6 and all(r["reference_code"].startswith("CD-") and len(r["reference_code"]) == 11 for r in real) and real[0]["extra"].startswith('{"a":')


def test_tolerance(spark):
    rng = random.Random(5)
    rows = [(k, [rng.choice([None, rng.uniform(-9, 9)]) for _ in range(rng.randrange(40))]) for k in range(60)]
    got = {r["doc_id"]: r["kept"] for r in training.distinct_within(spark.createDataFrame(rows, "doc_id long, values array<double>"), 1.0).collect()}
    for k, values in rows:
        kept = []
        for v in values:
            if v is not None and all(abs(v - s) >= 1.0 for s in kept):
                kept.append(v)
        assert got[k] == kept


def test_anchored_by_keys(spark):
    words = spark.createDataFrame([(1, p, k, float(y)) for p in (0, 1) for k, y in enumerate([0, 10, 11, 12, 25])], "doc_id long, page int, pos long, y1 double")
    got = {tuple(r) for r in documents.anchored(words, keys=("doc_id", "page")).collect()}
    assert got == {(1, p, k, g) for p in (0, 1) for k, g in enumerate([1, 1, 2, 2, 3])}


def test_settings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"company": {"id": "***ID***", "codes": ["x", 2, None]}, "rate": 1.5, "on": True, "empty": {}}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    got = {(r["file"].rsplit("/", 1)[-1], r["key"], r["value"], r["placeholder"]) for r in files.settings(spark, str(tmp_path)).collect()}
    own = {"company.id": "***ID***", "company.codes.0": "x", "company.codes.1": "2", "company.codes.2": None, "rate": "1.5", "on": "true"}
    assert got == {("a.json", k, v, k == "company.id") for k, v in own.items()} | {("b.json", None, None, False)}


def test_registry(spark):
    values = spark.createDataFrame([("barang_hs", "94031000"), ("barang_hs", "9403"), ("kontainer_nomor", "OOLU1234567"), ("barang_fob", "1."), ("other", "x"), ("barang_hs", None)], "field string, value string")
    assert [r["valid"] for r in registry.checked(values).collect()] == [True, False, True, True, None, None]
    rules = spark.createDataFrame([("other", "^y")], "field string, pattern string")
    assert {(r["field"], r["valid"]) for r in registry.checked(values, rules).collect()} == {("barang_hs", None), ("kontainer_nomor", None), ("barang_fob", None), ("other", False)}
    labels = spark.createDataFrame([("vessel_name",), ("item_code",), ("new",)], "label string").select(registry.layer_of(F.col("label")).alias("x"))
    assert [r["x"] for r in labels.collect()] == ["layout", "pattern", "pattern"]
    fields = spark.createDataFrame([(0, "a", "HEADER", "e1", True), (1, "b", "BARANG", "e2", False), (2, "c", "HEADER", "e1", False)], "ord int, key string, sheet string, entity string, required boolean")
    assert [tuple(r) for r in registry.sheet_order(fields).orderBy("place").collect()] == [("HEADER", 1), ("BARANG", 2)]
    keys = lambda d: {r["key"] for r in d.collect()}
    assert keys(registry.fields_of(fields, sheet="HEADER")) == {"a", "c"} and keys(registry.fields_of(fields, entity="e2")) == {"b"} and keys(registry.fields_of(fields, required=True)) == {"a"}
