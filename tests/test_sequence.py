"""Numbers by day over batches and a restart; images by the end of their paths."""

import random

from docflow.operators import pages
from docflow.streaming import sequence


def test_restart(spark, tmp_path):
    rng = random.Random(1)
    parts = [[(b * 1000 + k, rng.choice(["d1", "d2", f"d{b + 3}"])) for k in range(rng.randrange(1, 60))] for b in range(3)]
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for b, part in enumerate(parts):
        spark.createDataFrame(part, "id long, day string").coalesce(1).write.mode("append").parquet(source)
        query = sequence.number_by_day(spark.readStream.schema("id long, day string").parquet(source), folder)  # each time as after a restart
        query.awaitTermination()
        if b == 1:  # a batch that is run again keeps its numbers
            before = sorted(map(tuple, sequence.numbered_rows(spark, folder).select("id", "day", "number").collect()))
            sequence.number_batch(spark, spark.createDataFrame(part, "id long, day string"), 1, folder)
            assert sorted(map(tuple, sequence.numbered_rows(spark, folder).select("id", "day", "number").collect())) == before
    want, last = [], {}
    for part in parts:
        for i, day in sorted(part):
            last[day] = last.get(day, 0) + 1
            want.append((i, day, last[day]))
    assert sorted(map(tuple, sequence.numbered_rows(spark, folder).select("id", "day", "number").collect())) == sorted(want)


def test_images(spark):
    rng = random.Random(2)
    stems = ["a", "ba", "x_p1", "a.b", "ü"]
    paths = [f"{rng.choice(['', 'd/', 'e/a/'])}{rng.choice(['', 'b', 'x', 'pre_'])}{rng.choice(stems)}_p{rng.randrange(3)}.{rng.choice(['png', 'png', 'jpg'])}" for _ in range(60)]
    images = spark.createDataFrame([(p, k) for k, p in enumerate(paths)], "image string, ord long")
    asked = [(s, n) for s in [*stems, "none"] for n in range(4)]
    got = {(r["stem"], r["page"]): r["image"] for r in pages.with_images(spark.createDataFrame(asked, "stem string, page int"), images).collect()}
    assert got == {(s, n): next((p for p in paths if p.endswith(f"{s}_p{n}.png")), None) for s, n in asked}
