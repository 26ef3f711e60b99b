"""Files that are written, read again."""

import json

from pyspark.sql import functions as F

from docflow.sources import files


def test_word_cache(spark, tmp_path):
    page = {"width": 10, "height": 20, "words": [{"text": "Ä", "bbox": [1, 2, 3, 4], "confidence": 0.5}, {"text": "b", "bbox": [5, 6, 7, 8], "confidence": 1}], "ocr_time": 0.1}
    (tmp_path / "a.json").write_text(json.dumps({"x/1.png": page, "x/2.png": {"error": "bad", "words": []}}, indent=2))
    (tmp_path / "b.json").write_text("not json")
    cache = files.word_cache(spark, str(tmp_path))
    rows = {r["image"].rsplit("/", 1)[-1]: r for r in cache.collect()}
    assert set(rows) == {"1.png", "2.png", "b.json"}
    assert rows["2.png"]["error"] == "bad" and rows["b.json"]["error"] == "unreadable" and rows["1.png"]["error"] is None
    assert [tuple(r) for r in files.cached_words(cache).orderBy("pos").collect()] == [("x/1.png", 0, "Ä", 1, 2, 3, 4, 0.5), ("x/1.png", 1, "b", 5, 6, 7, 8, 1)]


def test_training_pages(spark, tmp_path):
    rows = [("a_p0", "a", "CI", 1.0, 2.0, ["x", "ü"], [[1.0, 2.0, 3.0, 4.0]], [0, 1], True), ("b_p0", "b", None, None, None, [], [], [], False)]
    pages = spark.createDataFrame(rows, files.PAGES + ", train boolean")
    files.write_training_pages(pages, str(tmp_path / "out"))
    for split, wanted in (("train", rows[0]), ("val", rows[1])):
        assert [tuple(r) for r in files.training_pages(spark, str(tmp_path / "out" / f"split={split}")).collect()] == [wanted[:-1]]
    (tmp_path / "lines.jsonl").write_text('{"id": "q"}\n\n{"id": "r", "labels": [3]}\n')
    assert [(r["id"], r["labels"]) for r in files.training_pages(spark, str(tmp_path / "lines.jsonl")).collect()] == [("q", None), ("r", [3])]
    files.write_summary(pages.agg(F.count("*").alias("pages")), str(tmp_path / "sum"))
    assert [json.loads(p.read_text()) for p in (tmp_path / "sum").glob("*.json")] == [{"pages": 2}]


def test_folders(spark, tmp_path, monkeypatch):
    for name in ("s1/a_CI.pdf", "s1/a_PL.pdf", "s1/t2.xlsx", "s1/t1.xlsx", "s2/b_CI.pdf", "s3/t.XLSX", "s3/page.gif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345678")
    end = lambda p: p and p.rsplit("/", 1)[-1]
    found = {r["shipment"]: tuple(map(end, r[1:])) for r in files.shipment_folders(spark, str(tmp_path)).collect()}
    assert found == {"s1": ("a_CI.pdf", "a_PL.pdf", None, "t1.xlsx"), "s3": (None, None, None, "t.XLSX")}
    errors = {end(r["path"]): r["error"] for r in files.uploads(spark, str(tmp_path)).collect()}
    assert errors == {"a_CI.pdf": None, "a_PL.pdf": None, "b_CI.pdf": None, "t1.xlsx": 400, "t2.xlsx": 400, "t.XLSX": 400, "page.gif": 400}
    monkeypatch.setattr(files, "MOST_BYTES", 7)
    assert {r["error"] for r in files.uploads(spark, str(tmp_path)).collect()} == {400, 413}
