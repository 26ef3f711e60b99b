"""The operators against brute force, on small tables with nulls, empties, ties, repeats and long texts."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("docflow.llm")
from docflow.llm import bpe, common, components, contamination, edits, fingerprints, html, jaccard, languages, privacy, repeats, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ODD = [None, "", " \n\t ", "a", "Ünïcödé 日本語 🙂", "x" * 3000, BASE, BASE, BASE + " more", "word " * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, "extra") for i, t in enumerate(ODD)] + [(None, BASE, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans_ string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_fingerprints(spark, odd, docs, texts):
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    ids = sorted(texts)

    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    off = []
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[a], texts[b]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        x, y = sets(t), sets(edited)
        off.append(abs(len(x & y) / max(len(x | y), 1) - got[a]["near_edited"]))
    assert sum(off) / len(off) < 0.06
    small = fingerprints.fingerprints(odd).collect()
    assert len(small) == len(ODD) + 1
    same = {r["fingerprint"] for r in small if r["doc_id"] in (6, 7)}
    assert len(same) == 1 and all(r["fingerprint"] == "" for r in small if r["doc_id"] in (0, 1, 2))
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_languages(spark, odd, docs):
    fold = common.fold_of(F.col("doc_id"))
    profiles = languages.learn(docs.where(fold != 1).select("text", "lang"))
    rows = languages.identify(docs.where(fold == 1).select("doc_id", "text", "lang"), profiles).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    small = {r["doc_id"]: r for r in languages.identify(odd.select("doc_id", "text"), profiles).collect()}
    assert all(small[i]["lang_pred"] == "und" for i in (0, 1, 2)) and all(0 <= r["score"] <= 1 for r in small.values())
    assert languages.learn(odd.limit(0)) == {} and languages.identify(odd.select("text"), {}).first()["lang_pred"] == "und"


def test_toxicity(spark, odd, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.learn_folds(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").join(labels.where(common.fold_of(F.col("doc_id")) == 1), "doc_id")
    rows = toxicity.score(all_docs, model).collect()
    assert sum((r["toxic"] == 1) == (r["predicted"] == 1) for r in rows) >= 0.93 * len(rows)
    small = toxicity.score(odd, model).collect()
    assert len(small) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in small)
    assert toxicity.train(odd, labels.limit(0)).weights == {}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def test_privacy(spark, odd, docs, texts):
    more = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 0001.02.255.256", "é 4041894974608795 +1 (988) 555-2485 4111 1111-1111 1111x", "+1-2", "x@y.z@w.q.r..s", "9" * 3000 + "@" + "a" * 3000, "🙂 a@b.cc 🙂 4111111111111111"]
    every = {**texts, **{1_000_000 + i: t for i, t in enumerate(more)}}
    frame = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    got = {r[0]: r[1] for r in privacy.find(frame).select("doc_id", privacy.joined(F.filter("spans", lambda s: s["kind"] != "term"))).collect()}
    for i, t in every.items():
        assert got[i] == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m[0])), i
    assert privacy.sanitise(odd).select("text").where("text is null").count() == 1
    rows = [(i, f"filler{i} words Zorblax writes from z@mail.org about item{i}") for i in range(5)] + [(9, "nothing here")] + [(20 + i, f"other{i} text") for i in range(30)]
    out = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[9] == "nothing here" and "[EMAIL]" in out[0] and "Zorblax" not in out[0] and "filler0" in out[0]


def test_privacy_counts_rows(spark):
    texts = [f"variant{i} holds Quorvex beside q@mail.org" for i in range(3) for _ in range(50)] + [f"other{i} text" for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not privacy.sanitise(rows).where("text like '%Quorvex%'").count()


def test_privacy_whole_documents(spark):
    far = " ".join(["filling"] * 60)
    texts = [f"Quorvex or Bo heads letter{i} {far} signed q@mail.org" for i in range(20)] + ["seen without it: QUORVEX", "filling"] + [f"other{i} text with or filling" for i in range(3000)]
    out = {r["doc_id"]: r["text"] for r in privacy.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(out[i] == f"[TERM] or [TERM] [TERM] letter{i} {far} [TERM] [EMAIL]" for i in range(20))
    assert out[20] == "seen without it: [TERM]" and out[21] == "filling" and out[22] == texts[22]


def test_html(spark):
    page = "<html><head><title>T{i}</title></head><body><div class=x1><a>Home{k}</a></div><div id=main1><h2>Head {i}</h2><p>Text &amp; more {i}<p>Second\n line {i}</div><ul><li>Same</li></ul><form>no</form><div class='reader-comments'>c{i}</div></body></html>"
    rows = [(i, "http://h.org/x", page.replace("{i}", str(i)).replace("{k}", "")) for i in range(12)] + [(90, None, None), (91, "http://q.org", "<article><h1>A&nbsp;b</h1><div class=ad>z</div><p>c<br>d<script>x</script></article><nav>n</nav>"), (92, "u", "")]
    out = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3]["text"] == "Head 3\nText & more 3\nSecond line 3"
    assert out[91]["text"] == "A b\nc d" and out[90]["text"] == "" and out[92]["n_chars"] == 0


def test_repeats(spark, odd, texts):
    every = {**texts, **{10_000 + i: t for i, t in enumerate(ODD)}}
    got = {r["doc_id"]: r for r in repeats.removed(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}
    first, split = {}, {}
    for i in sorted(every):
        split[i] = re.findall(r"[^\x20\x09-\x0D]+", every[i] or "")
        for k in range(len(split[i]) - 12):
            first.setdefault(tuple(split[i][k : k + 13]), i)
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert repeats.removed(odd).count() == len(ODD) + 1 and repeats.removed(odd.limit(0)).count() == 0


def test_bpe_and_edits(spark, odd, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    own = [t or "" for t in ODD] + list(texts.values())[:60] + ["a<|endoftext|>b", "  \n\n x  ", "don't 's\r\n\t"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string")
    for r in bpe.with_tokens(frame, path).collect():
        ids = library.encode(own[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.with_tokens(odd, path, digests=True).where("doc_id = 0").first()["n_tokens"] == 0
    encoder = bpe.Counter(bpe.Vocabulary(bpe.vocabulary_text(path)))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for t in own:
        tree = edits.Tree(encoder, t)
        for start, end, new in [*edits.edits_of(t), (0, 0, "  "), (0, 1, "'s"), (2, 5, "<|endoftext|>")]:
            start, end = min(start, len(tree.text)), min(end, len(tree.text))
            tree.replace(start, end, new)
            assert tree.total == count(tree.text)
    for r in edits.token_counts(frame, path).collect():
        text = own[r["doc_id"]]
        for start, end, new in edits.edits_of(text):
            text = text[:start] + new + text[end:]
        assert (r["n_tokens"], r["n_edited"]) == (count(own[r["doc_id"]]), count(text))
    assert edits.token_counts(odd.limit(0), path).count() == 0 and edits.token_counts(odd, path).count() == len(ODD) + 1


def test_stored_trees_and_edits(spark, odd, texts):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(3)
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    bits = ["'s", " ", "  ", "\n", "a", "the ", "<|endoftext|>", "<|endof", "text|>", "9", "é", "日", "!!", "\t"]
    own = dict(enumerate([t or "" for t in ODD] + list(texts.values())[:20] + ["".join(rng.choices(bits, k=400)) for _ in range(20)] + ["long words here " * 8000]))
    rows, expected = [], dict(own)
    for i in own:
        for seq in range(rng.randrange(6)):
            t = expected[i]
            start = rng.randint(0, len(t))
            end = start + rng.choice([0, 1, 30, 500])
            new = "".join(rng.choices(bits, k=rng.choice([0, 1, 3, 200])))
            rows.append((i, seq, start, end, new or None))
            expected[i] = t[:start] + new + t[end:]
    trees = edits.build(spark.createDataFrame(list(own.items()), "doc_id long, text string"), path)
    changes = spark.createDataFrame([*rows, (None, 0, 0, 1, "x"), (999, 0, 0, 1, "x")], "doc_id long, seq long, start long, end long, new string")
    once = edits.apply(trees, changes.where("seq < 2"), path)
    for r in edits.apply(once, changes.where("seq >= 2"), path).collect():
        assert r["text"] == expected[r["doc_id"]] and r["n_tokens"] == count(r["text"]) == sum(r["leaf_tokens"]) and sum(r["leaf_chars"]) == len(r["text"])
    encoder = bpe.Counter(bpe.Vocabulary(bpe.vocabulary_text(path)))
    tree = edits.Tree(encoder, "some words of a text " * 50_000)
    tree.replace(500_000, 500_010, "other")
    assert tree.encoded < 100  # however long the text


def test_jaccard(spark, odd, texts):
    base = [f"w{i}" for i in range(100)]
    near = {50_000 + k: " ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 100, 7)}
    every = {**texts, **near, 60_000: " ".join(f"v{i}" for i in range(50))}
    got = {r["doc_id"]: r for r in jaccard.similar(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}

    def sets(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    shingles = {i: sets(t) for i, t in every.items()}
    ids = sorted(every)
    total = lost = 0
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(shingles[a] & shingles[b])
            if both and both / (len(shingles[a]) + len(shingles[b]) - both) >= 0.8:
                total += 1
                lost += got[a]["class_id"] != got[b]["class_id"]
    assert total > 10 and lost <= 0.03 * total
    assert got[60_000]["class_id"] == 60_000 and got[60_000]["n_links"] == 0
    small = {r["doc_id"]: r["class_id"] for r in jaccard.similar(odd).collect()}
    assert small[6] == small[7] == 6 and small[0] == 0 and small[1] == 1 and small[None] is None
    assert jaccard.similar(odd.limit(0)).count() == 0


def variants(n, source, seed, edits):
    """n texts of 300 words, each the source with some words changed."""
    import random

    rng, out = random.Random(seed), []
    for k in range(n):
        w = [f"{source}{i}" for i in range(300)]
        for e in range(rng.choice(edits)):
            w[rng.randrange(300)] = f"{source}x{k}y{e}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_jaccard_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    every = dict(enumerate(variants(40, "a", 1, (3, 4)) + variants(150, "b", 2, (3, 4, 5, 6))))
    words = {i: t.split() for i, t in every.items()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    true, classes = dict.fromkeys(every, 0), {i: i for i in every}
    for a in every:
        for b in range(a):
            both = len(shingles[a] & shingles[b])
            if both / (len(shingles[a]) + len(shingles[b]) - both) >= 0.8:
                true[a], true[b] = true[a] + 1, true[b] + 1
                joined = {classes[a], classes[b]}
                classes = {i: min(joined) if c in joined else c for i, c in classes.items()}
    got = {r["doc_id"]: r for r in jaccard.similar(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}
    assert all(got[i]["n_links"] <= true[i] for i in every)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * sum(true.values())
    assert {i: got[i]["class_id"] for i in every} == classes


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 105), (105, 103), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[105] == got[103] == got[100] == 100


def test_contamination(spark, odd):
    items = spark.createDataFrame([(1, "Alice has 3 apples and buys 5 more apples so Alice now has 8 apples in the basket"), (2, "short item here"), (3, None)], "item_id long, text string")
    rows = [
        (1, "intro words Bob has 7 apples and buys 2 more apples so Bob now has 9 apples in the basket the end"),
        (2, "Alice has 3 apples and buys 5 more apples so Alice now has 8 apples in the basket"),
        (3, "nothing at all like it stands in this text of some words"),
        (4, "well, short item here."),
        (5, "Bob has 7 pears and sells 2 of them"),
    ]
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}
    assert contamination.contaminated(odd, items.limit(0)).count() == 0 and contamination.contaminated(odd, items).count() == 0


def test_contamination_numbers_and_short_items(spark):
    items = spark.createDataFrame([(1, "1 2 4 8 16 32 64 128 256 512"), (2, "What is 17 times 23"), (3, "7 8"), (4, "add 5 and 5 now")], "item_id long, text string")
    rows = [(1, "so 1 2 4 8 16 32 64 128 256 512 end"), (2, "and what is 12 times 31 then"), (3, "so 9 8 7 6 5 4 3 2 1 0 end"), (4, "add 6 and 6 now"), (5, "add 6 and 7 now"), (6, "it is 17 times")]
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1), (2, 2), (4, 4)}


def test_pipeline(spark):
    import corpus_pipeline

    docs, d = spark.read.parquet(f"{DATA}/documents.parquet"), DATA
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.checkpoint(stage(spark, docs, d))
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= left and len(now) >= 0.8 * len(left)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
        left = now
    assert docs.where("n_tokens <> size(token_ids)").count() == 0


def test_html_tells_pages_apart_by_content(spark):
    """Pages of one title have a template all the same, copies of one page have none, and a notice that recurs in the articles goes."""
    page = "<html><head><title>Site</title></head><body><div><a>Home</a> About us</div><article><h2>Intro</h2><p>Story {i}</p><p>Read our terms before use</p></article></body></html>"
    rows = [(i, "http://h.org/x", page.replace("{i}", str(i))) for i in range(12)] + [(50 + i, "http://copies.org/x", page.replace("{i}", "same")) for i in range(12)]
    out = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Intro\nStory 3" and out[53] == "Intro\nStory same\nRead our terms before use"
    bare = "<html><head><title>Site</title></head><body><div><span>Home</span> About us</div><p>Story {i}</p></body></html>"
    rows = [(i, "http://h.org/x", bare.replace("{i}", str(i))) for i in range(12)]
    assert html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).where("text like '%Home%'").count() == 0


CLASHES = ["_text", "spans", "_spans", "_key", "_terms", "key", "terms", "lang_pred", "score", "predicted", "token_ids", "decoded", "copy", "hash"]


def test_clashing_columns_and_empty_tables(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    wide = odd.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    pages = spark.createDataFrame([], "page_id long, url string, html string, host string, template string")
    items = spark.createDataFrame([(1, BASE)], "item_id long, text string")
    makers = {
        "identify": (lambda d: languages.identify(d, {"en": [1, 2]}), ("lang_pred", "score")),
        "score": (lambda d: toxicity.score(d, toxicity.Model()), ("score", "predicted")),
        "find": (privacy.find, ("spans",)),
        "sanitise": (privacy.sanitise, ()),
        "with_tokens": (lambda d: bpe.with_tokens(d, path), ("token_ids", "decoded")),
    }
    for name, (make, new) in makers.items():
        rows = make(wide).collect()
        assert len(rows) == len(ODD) + 1, name
        for c in set(CLASHES) - set(new):
            assert all(r[c] == f"own {c}" for r in rows), (name, c)
        assert all(r[c] != f"own {c}" for c in new for r in rows), name
        assert make(wide.limit(0)).count() == 0, name
    assert {r["doc_id"] for r in contamination.contaminated(wide, items).collect()} == {6, 7, 8}
    assert html.main_text(pages).count() == 0
    assert edits.build(wide, path).count() == len(ODD) + 1 and fingerprints.fingerprints(wide).count() == len(ODD) + 1
    assert repeats.removed(wide).count() == jaccard.similar(wide).count() == len(ODD) + 1


def test_groups_of_copies_beyond_a_broadcast(spark, monkeypatch):
    """Hot groups, cold ones and rows without one meet their class alike whatever is broadcast."""
    rows = [(i, BASE) for i in range(60)] + [(100 + i, f"{BASE} tail {i % 5}") for i in range(20)] + [(200, None), (201, ""), (None, BASE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: str(tuple(r))
    whole = sorted(jaccard.similar(docs).collect(), key=key)
    monkeypatch.setattr(jaccard, "SMALL", 0)
    monkeypatch.setattr(jaccard, "MANY", 4)
    assert sorted(jaccard.similar(docs).collect(), key=key) == whole and len(whole) == len(rows)
