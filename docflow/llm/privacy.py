"""Personal data: base patterns, and terms that corpus co-occurrence shows to reveal a protected entity. Built-in functions only.

An entity is a value of a base pattern. How much a term t discloses of entity c is their pointwise mutual information
over the documents, as a share of what c itself tells: PMI(t, c) / IC(c). It is 1 if the term never occurs without the
entity. Documents are rows in all counts, and a term occurs with an entity if one document holds both, wherever. Terms
from DISCLOSURE on are generalised in every document; terms that few texts hold with the entity say too little and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, free, let, table

DISCLOSURE = 0.9
SUPPORT = 3  # different texts that hold the term and the entity, at least
LETTERS = 2  # of a term, at least; all its characters are letters
SMALL = 200_000  # rows that may be broadcast
BLOCK = 64  # matches whose places are summed at once

#: The base patterns. Starts are pinned to where a match can begin at all, which keeps long runs linear.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all, to save the search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_TERM = rf"^\p{{L}}{{{LETTERS},}}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(F.ascii(c) - 48, lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(F.slice(each, 1, 19), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _running(sizes: Column, zero: Column) -> Column:
    """array<int> of the sums of sizes up to each, from zero on; a fold over an array that grows, for few sizes."""
    empty = F.array().cast("array<int>")
    step = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"] + n)).alias("out"))
    return F.aggregate(sizes, F.struct(zero.cast("int").alias("at"), empty.alias("out")), step, lambda s: s["out"])


def _located(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of all matches, in code points: gaps and matches alternate, so lengths add up to places.

    Sums run over blocks of BLOCK matches, and within each from its block's own start, so that work grows with the matches.
    """
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    block = lambda sizes, k: F.slice(sizes, k * BLOCK + 1, F.lit(BLOCK))
    total = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, b: a + b)

    def place(gaps: Column) -> Column:
        def with_found(found: Column) -> Column:
            def with_sizes(sizes: Column) -> Column:
                blocks = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
                starts = _running(F.transform(blocks, lambda k: total(block(sizes, k))), F.lit(0))
                ends = let(starts, lambda s: F.flatten(F.transform(blocks, lambda k: _running(block(sizes, k), F.when(k == 0, 0).otherwise(F.get(s, k - 1))))))
                return F.zip_with(ends, found, lambda e, v: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))

            sizes = F.transform(found, lambda v, i: F.length(F.get(gaps, i)) + F.length(v))
            return F.when(F.size(found) == 0, empty).otherwise(let(sizes, with_sizes))

        return let(F.regexp_extract_all(text, pattern, F.lit(0)), with_found)

    return let(F.split(text, pattern, -1), place)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the valid base matches, by kind, then start. Null counts as empty."""

    def of(kind: str) -> Column:
        valid = F.filter(_located(text, F.lit(PATTERNS[kind])), lambda s: _valid(kind, s["value"]))
        typed = F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(NEEDS[kind])
        return F.when(needed, typed).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))

    return F.concat(*map(of, KINDS))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text)).alias("b"))


def _terms(text: Column, spans: Column) -> Column:
    """The different terms of the text in lower case; what the spans cover holds none."""
    bare = F.when(F.size(spans) == 0, text).otherwise(redacted(text, spans, dict.fromkeys(MASKS, " ")))
    return F.filter(F.array_distinct(F.split(F.lower(bare), r"[^\p{L}\p{N}]+")), lambda t: t.rlike(_TERM))


def revealing_terms(docs: DataFrame) -> DataFrame:
    """(term): the terms that disclose an entity.

    docs has text and base spans. Candidates are all terms of the documents that hold an entity of SUPPORT different
    texts. Every term is counted over the whole corpus, combined within each task before the shuffle, so that this work
    grows with the words alone.
    """
    held = docs.where(F.size("spans") > 0).select(_key(F.col("text")).alias("key"), "text", "spans")
    n = docs.count()
    entity = F.explode(F.array_distinct(F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"])))))
    pairs = checkpoint(held.select("key", entity.alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("copies")))
    holders = checkpoint(pairs.groupBy("entity").agg(F.sum("copies").alias("with_entity"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).drop("texts"))
    pairs = checkpoint(pairs.join(broadcast_if_small(holders.select("entity"), SMALL), "entity"))
    texts = held.join(broadcast_if_small(pairs.select("key").distinct(), SMALL), "key", "left_semi").dropDuplicates(["key"])
    each = pairs.join(texts, "key").select("entity", "copies", F.explode(_terms(F.col("text"), F.col("spans"))).alias("term"))
    together = checkpoint(each.groupBy("entity", "term").agg(F.sum("copies").alias("both"), F.count("*").alias("texts")).where(F.col("texts") >= SUPPORT).drop("texts"))
    counts = docs.select(F.explode(_terms(F.col("text"), F.col("spans"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    scored = together.join(counts, "term").join(holders, "entity")
    total = F.lit(float(max(n, 1)))
    pmi = F.log(F.col("both") * total / (F.col("with_term") * F.col("with_entity")))
    information = F.log(total / F.col("with_entity"))
    return checkpoint(scored.where((information > 0) & (pmi >= DISCLOSURE * information - 1e-9)).select("term").distinct())


def find(docs: DataFrame) -> DataFrame:
    """docs with spans: array<struct<kind, start, end, value>> of the base spans and those of revealing terms (kind term), by kind, then start.

    Starts count from 0, ends are exclusive, both in code points. A null text is empty and has no spans. Columns stay, but
    for one named spans, which is replaced; rows that share an id, or have none, are kept each; an empty table gives no rows. Revealing terms are found in every document that holds them, with or without an
    entity; documents without any pass without a shuffle while few texts hold one.
    """
    docs = docs.drop("spans")
    key, held = free("_key", docs), free("_terms", docs)
    found = docs.withColumn("spans", base_spans(F.coalesce("text", F.lit("")))).withColumn(key, _key(F.coalesce("text", F.lit(""))))
    strong = revealing_terms(found.select(F.coalesce("text", F.lit("")).alias("text"), "spans"))
    each = found.where("text is not null").select(key, F.explode(_terms(F.col("text"), F.col("spans"))).alias("term"))
    terms = checkpoint(each.join(broadcast_if_small(strong, SMALL), "term").groupBy(key).agg(F.sort_array(F.collect_set("term")).alias(held)))
    keys = broadcast_if_small(terms.select(key), SMALL)
    own = found.join(keys, key, "left_semi").join(terms, key)
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?iu:"), F.array_join(held, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    typed = F.transform(_located(F.col("text"), pattern), lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    own = own.withColumn("spans", F.concat("spans", typed)).select(*docs.columns, "spans")
    return own.unionByName(found.join(keys, key, "left_anti").select(*docs.columns, "spans"))


def redacted(text: Column, spans: Column, masks: dict[str, str] = MASKS) -> Column:
    """The text with each stretch that spans cover replaced by the mask of its first span; spans of several kinds that overlap make one stretch."""
    mask_of = F.create_map(*[F.lit(x) for pair in masks.items() for x in pair])

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        out = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), mask_of[s["kind"]])).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.when(F.size(spans) == 0, text).otherwise(let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span of find() replaced by a placeholder of its kind; texts without spans stay as they are, null included."""
    hidden = free("_spans", docs)
    docs = docs.withColumnRenamed("spans", hidden)
    out = find(docs).withColumn("text", redacted(F.col("text"), F.col("spans"))).drop("spans")
    return out.withColumnRenamed(hidden, "spans")


def op4_privacy(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("term"))

