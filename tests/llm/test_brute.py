"""Languages, the label model and the whole pipeline against plain versions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("docflow.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from docflow.llm import common, jaccard, languages, privacy, toxicity  # noqa: E402


# languages -----------------------------------------------------------------------------------------------------------


def plain_grams(text):
    t = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    t = t if t.strip() else " "
    out = Counter(t[k : k + n] for n in (1, 2, 3) for k in range(len(t) - n + 1))
    out.pop(" ", None)
    return out


def top(counts):
    number = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))  # noqa: E731  as the operator writes them
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][: languages.PROFILE]


def test_languages_by_plain_profiles(spark):
    rng = random.Random(3)
    alphabets = {"xa": "abcde ", "xb": "cdefg ", "xc": "äöüab "}
    text = lambda a, n: "".join(rng.choices(a, k=n))
    train = [(text(a, rng.randrange(5, 300)), lang) for lang, a in alphabets.items() for _ in range(15)] + [(None, "xa"), ("abc", None), ("", "xb"), ("12 !", "xc")]
    profiles = {}
    for t, lang in train:
        if t is not None and lang is not None:
            profiles.setdefault(lang, Counter()).update(plain_grams(t))
    profiles = {k: top(v) for k, v in profiles.items()}
    learned = languages.learn(spark.createDataFrame(train, "text string, lang string"))
    assert {k: len(v) for k, v in learned.items()} == {k: len(v) for k, v in profiles.items()}
    asked = [text(rng.choice(list(alphabets.values())), rng.randrange(0, 80)) for _ in range(150)] + [None, "", " 1", "ÄÖ", "zzz", "ab\nab"]
    got = languages.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), learned).collect()
    for r in got:
        t = r["text"] or ""
        if not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        own = top(plain_grams(t))
        far = {k: sum(abs(p.index(g) - i) if g in p else languages.PROFILE for i, g in enumerate(own)) for k, p in profiles.items()}
        least = sorted((v, k) for k, v in far.items())  # ties by name
        assert r["lang_pred"] == least[0][1] and abs(r["score"] - (1 - least[0][0] / least[1][0] if least[1][0] else 0)) < 1e-12


def test_equal_distances(spark):
    profiles = languages.learn(spark.createDataFrame([("abc", "zz"), ("abc", "aa")], "text string, lang string"))
    assert languages.identify(spark.createDataFrame([("abc",)], "text string"), profiles).first()["lang_pred"] == "aa"


# the label model -------------------------------------------------------------------------------------------------------


def test_label_model_on_known_voters():
    """Voters of known accuracies, some of which copy each other: accuracies come back, and copies don't count as evidence of their own."""
    rng = np.random.default_rng(2)
    n, right = 6000, [0.9, 0.8, 0.75, 0.7, 0.85]
    truth = rng.random(n) < 0.4
    votes = np.stack([np.where(rng.random(n) < p, truth, ~truth) * 2 - 1 for p in right], 1)
    copies = np.stack([votes[:, 3]] * 3, 1)  # three more of the worst voter
    votes = np.hstack([votes, copies]).astype(np.int8)
    post, accuracy, corr = toxicity.label_model(votes, 0.4)
    assert np.abs(accuracy[:5] - right).max() < 0.05
    assert corr[3, 5] > 0.9 and abs(corr[0, 1]) < toxicity.RELATED
    best = np.mean((post > 0.5) == truth)
    assert best > np.mean((votes.sum(1) > 0) == truth) + 0.03  # better than the majority, which the copies sway


def test_equal_scores(spark):
    model = toxicity.Model({"bad": 2.0}, {}, -1.0)
    rows = toxicity.score(spark.createDataFrame([(1, "bad day"), (2, "Bad bad day"), (3, None), (3, "")], "doc_id long, text string"), model).collect()
    assert rows[0]["score"] == rows[1]["score"] and rows[2]["score"] == rows[3]["score"] < rows[0]["score"]


# the pipeline ------------------------------------------------------------------------------------------------------------

WORDS = [a + b + c for a in "bdfglm" for b in "aeiou" for c in "nrst"]


def tables(rng):
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    item = "how many days does the long road to the old market take if ned walks nine hours"
    base = say(60)
    rows = [(i, say(rng.randrange(20, 80)), "en", "s") for i in range(80)]
    rows += [(100 + i, f"{say(15)} idiot scum {say(10)} filth idiot", "en", "t") for i in range(40)]
    rows += [(200 + i, base, "en", "c") for i in range(4)] + [(210, base + " tail", "en", "c"), (211, "HEAD " + base, None, None)]
    rows += [(300, f"{say(10)} {item} {say(10)}", "en", "b"), (301, f"{say(9)} write to ann@mail.org or +1 988 555 2485", "en", "p"), (302, None, "en", "n"), (303, "", None, None), (304, None, None, None), (305, "x " * 5000 + say(5), "en", "l")]
    labels = [(i, 0, 1 if 100 <= i < 140 else 0) for i in range(140)]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows], labels, [(1, item), (2, None)]


def shingles(t):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    """Ids that stay of texts of a similarity of 0.8 or more, by all pairs."""
    own = [(i, shingles(t)) for i, t in rows if t and shingles(t)]
    to = {i: i for i, _ in own}

    def head(i):
        while to[i] != i:
            i = to[i]
        return i

    for k, (i, a) in enumerate(own):
        for j, b in own[:k]:
            if len(a & b) >= jaccard.THRESHOLD * len(a | b):
                x, y = sorted((head(i), head(j)))
                to[y] = x
    return {i for i in to if head(i) != i}


def test_run(spark, tmp_path):
    import tokenizers

    rows, labels, items = tables(random.Random(7))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(i, t) for i, t, *_ in rows if not 100 <= i < 200]  # the toxic go
    gone = plain_classes(left)
    left = [(i, t) for i, t in left if i not in gone and i != 300]  # of alike texts one stays, the benchmark's go
    assert set(got) == {i for i, _ in left} and 200 in got and not {201, 202, 203, 210, 211} & set(got)
    base = {i: t for i, t in left}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame([(i, t, None, None, 0) for i, t in left], "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert clean[302] is None and "[EMAIL]" in clean[301] and "ann@" not in clean[301] and clean[0] == base[0]
    for i, r in got.items():
        assert r["token_ids"] == library.encode(clean[i] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, k):
    """Nulls, repeats, equal ids, clashing columns, an empty table."""
    name, stage = corpus_pipeline.STAGES[k]
    rows = [(1, "one two three four five six seven eight", "en", "s", 5), (1, "one two three four five six seven eight", "en", "s", 5), (None, "one two three four five six seven eight", None, None, None), (2, None, None, None, None), (3, "", "", "", 0), (3, "other words that say nothing of it at all", "en", "s", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("mine")).withColumn("token_ids", F.lit(7))
    sf = "/root/testdata/sf0.001"
    out = stage(spark, frame, sf)
    assert out.columns == (corpus_pipeline.COLUMNS if k < 4 else ["doc_id", "lang", "source", "n_tokens", "token_ids"])
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows), name  # nothing in them is toxic, alike under two ids or of the benchmark
    assert stage(spark, frame.limit(0), sf).count() == 0
    assert common.partitions(spark) == 4
