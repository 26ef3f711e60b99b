"""Candidates, arbitration, merging, totals, line geometry and labels of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dims
from ..functions.values import filled, hs_formatted, let, number
from .stored import folded

def best(candidates: DataFrame, *keys: str) -> DataFrame:
    """The candidate of the highest confidence for each key; the first of equals."""
    w = W.partitionBy(*keys).orderBy(F.desc("confidence"), "ord")
    return candidates.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def arbitrate(candidates: DataFrame) -> DataFrame:
    """One value for each document and label from the best of either layer.

    The layer that is alone is taken (an incoterm of the layout layer only if valid). Of both, labels of PATTERN_LABELS take
    the pattern; those of STRICT_LABELS only if its format is good, which sets the confidence, and else the layout. All
    others take the more confident, the layout in ties. Of the layout's currencies a plain code goes before others, and
    a code that an amount follows stands for the whole.
    """
    held = candidates.where(F.col("value") != "")
    codes = "|".join(dims.CURRENCY_CODES)
    layout_money = (F.col("layer") == "layout") & (F.col("label") == "currency")
    plain = layout_money & F.trim(F.upper("value")).rlike(f"^({codes})$")
    held = held.withColumn("_plain", F.coalesce(plain, F.lit(False)).cast("int"))
    w = W.partitionBy("doc_id", "label", "layer").orderBy(F.desc("_plain"), F.desc("confidence"), "ord")
    top = held.withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    cut = layout_money & (F.col("_plain") == 0) & F.col("value").rlike(f"^({codes})[0-9,.]+")
    top = top.withColumn("value", F.when(cut, F.substring("value", 1, 3)).otherwise(F.col("value")))
    side = lambda layer: F.max(F.when(F.col("layer") == layer, F.struct("confidence", "value"))).alias(layer)
    both = top.groupBy("doc_id", "label").agg(side("layout"), side("pattern"))
    layout, pattern = F.col("layout"), F.col("pattern")
    label = F.col("label")
    valid = (label != "incoterms") | F.trim(F.upper(layout["value"])).isin(*dims.INCOTERMS)
    made = lambda value, sure: F.when(value.isNotNull(), F.struct(F.lit(sure).alias("confidence"), value.alias("value")))
    hs = made(hs_formatted(pattern["value"]), 0.95)
    container = made(F.when(pattern["value"].rlike(r"^[A-Z]{4}[0-9]{7}$"), pattern["value"]), 0.98)
    strict = F.when(label == "item_hs_code", hs).when(label == "container_number", container)
    chosen = (
        F.when(layout.isNull(), pattern)
        .when(pattern.isNull(), F.when(valid, layout))
        .when(label.isin(*dims.STRICT_LABELS), F.coalesce(strict, layout))
        .when(label.isin(*dims.PATTERN_LABELS), pattern)
        .otherwise(F.when(layout["confidence"] >= pattern["confidence"], layout).otherwise(pattern))
    )
    return both.select("doc_id", "label", chosen["value"].alias("value"), chosen["confidence"].alias("confidence")).where("value is not null")


def merge_by_priority(candidates: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The first non-empty best value of each label over the documents' types in order."""
    top = best(candidates.where(F.col("value") != ""), "doc_id", "label", "doc_type")
    of = [F.max(F.when(F.col("doc_type") == t, F.col("value"))) for t in order]
    return top.groupBy("doc_id", "label").agg(F.coalesce(*of).alias("value"))


def reconciled_totals(items: DataFrame) -> DataFrame:
    """Sums of the readable quantities, amounts and weights of each document's items."""
    total = lambda c: F.coalesce(F.sum(number(F.replace(F.col(c), F.lit(","), F.lit("")))), F.lit(0.0))
    return items.groupBy("doc_id").agg(*[total(c).alias(f"sum_{c}") for c in ("quantity", "amount", "net", "gross")], F.count("*").alias("n_items"))


def reconciled_header(headers: DataFrame, sums: DataFrame) -> DataFrame:
    """(doc_id, total_quantity, note) of headers (doc_id, total_quantity) and sums of their items (doc_id, sum_quantity).

    A total that is missing, unreadable or more than a quarter of the sum away from it becomes the whole part of the sum, the last with a note; without
    a positive sum it stays.
    """
    met = headers.join(sums.select("doc_id", "sum_quantity"), "doc_id", "left")
    total, sum_ = F.replace("total_quantity", F.lit(","), F.lit("")).try_cast("double"), F.col("sum_quantity")
    off = F.abs(total - sum_) > 0.25 * sum_
    new = F.floor(sum_).cast("bigint").cast("string")
    whole = lambda c: F.format_string("%.0f", F.bround(c, 0))
    note = F.concat(F.lit("total "), whole(total), F.lit(" against items "), whole(sum_), F.lit(", difference "), whole(F.abs(total - sum_)))
    given = filled(F.col("total_quantity"))
    value = F.when(~F.coalesce(sum_ > 0, F.lit(False)), F.col("total_quantity")).when(given.isNull() | total.isNull() | off, new).otherwise(F.col("total_quantity"))
    return met.select("doc_id", value.alias("total_quantity"), F.when((sum_ > 0) & off & given.isNotNull(), note).alias("note"))


SCORED = ("item_code", "quantity", "price", "amount", "hs_code", "net", "gross", "dimensions")  # fields that count for the score


def price_check(items: DataFrame) -> DataFrame:
    """Add ratio, flag and confidence: how far amount is from quantity times price, and a score of filled fields moved by that."""
    q, p, a = F.col("_q"), F.col("_p"), F.col("_a")
    rows = items.withColumns({f"_{c[0]}": number(F.col(c)) for c in ("quantity", "price", "amount")})
    rows = rows.withColumn("_ratio", F.when((q > 0) & (p > 0) & (a > 0), F.abs(a - q * p) / (q * p)))
    held = sum((F.when(filled(F.col(c)).isNotNull(), 1).otherwise(0) for c in SCORED), F.lit(0))
    r = F.col("_ratio")
    flag = F.when(r <= 0.05, "valid").when(r <= 0.20, "warning").when(r.isNotNull(), "critical").otherwise("none")
    rows = rows.withColumns({"_flag": flag, "_score": 0.4 + 0.07 * held})
    moved = F.when(F.col("_flag") == "valid", F.least(F.col("_score") * 1.15, F.lit(1.0))).when(F.col("_flag") == "warning", F.col("_score") * 0.95).when(F.col("_flag") == "critical", F.col("_score") * 0.70).otherwise(F.col("_score"))
    return rows.select(*items.columns, F.bround(r, 6).alias("ratio"), F.col("_flag").alias("flag"), F.bround(moved, 6).alias("confidence"))


#: Parties of the driver's orders, for the queries.
PARTY_VIEW = (
    "'Seller ' || o_custkey % 7 AS seller", "CASE WHEN o_custkey % 9 = 0 THEN '' ELSE ' Buyer ' || o_custkey % 5 END AS buyer",
    "CASE WHEN o_custkey % 3 = 0 THEN 'Seller ' || o_custkey % 7 ELSE 'Shipper ' || o_custkey END AS shipper",
    "CASE WHEN o_custkey % 4 = 0 THEN ' Buyer ' || o_custkey % 5 WHEN o_custkey % 4 = 1 THEN '' ELSE 'Consignee ' || o_custkey END AS consignee",
    "CASE WHEN o_custkey % 6 = 0 THEN 'Notify ' || o_custkey ELSE '' END AS notify",
)


def parties(shipments: DataFrame) -> DataFrame:
    """(id, row_order, code, name) of the party rows of a declaration: seller, maker, buyer, shipper, notified party, consignee.

    The seller is its own maker; a shipper that is the seller and a consignee that is the buyer get no row; the consignee is notified where nobody else is.
    """
    seller, buyer, shipper, consignee = (F.col(c) for c in ("seller", "buyer", "shipper", "consignee"))
    notified = F.when(filled(F.col("notify")).isNotNull(), F.col("notify")).otherwise(consignee)
    rows = [("9", seller, None), ("10", seller, None), ("1", buyer, None), ("7", shipper, shipper != seller), ("4", notified, None), ("11", consignee, consignee != buyer)]
    all_rows = F.array(*[F.struct(F.lit(k + 1).cast("bigint").alias("row_order"), F.lit(code).alias("code"), F.trim(name).alias("name"), (filled(name).isNotNull() & (F.lit(True) if keep is None else F.coalesce(keep, F.lit(True)))).alias("keep")) for k, (code, name, keep) in enumerate(rows)])
    return shipments.select("id", F.inline(F.filter(all_rows, lambda r: r["keep"]))).drop("keep")


def numbered(rows: DataFrame, key: str, order: str, name: str, width: int = 1 << 20) -> DataFrame:
    """Add name: 1, 2, 3 ... in order within each key, for keys of any size.

    A key's rows are numbered within blocks of width values of order, each of which starts after the rows of the key's earlier blocks.
    """
    dealt = rows.withColumn("_block", F.floor(F.col(order) / width))
    counts = dealt.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.join(counts.select(key, "_block", before.alias("_before")), [key, "_block"])
    own = F.row_number().over(W.partitionBy(key, "_block").orderBy(order))
    return dealt.withColumn(name, F.col("_before") + own).drop("_block", "_before")


BAND = 15.0  # height of the bands in which words are first ordered


def lines(words: DataFrame, step: float = 10.0) -> DataFrame:
    """Lines of words by their rounded height: text in order of x, of words at one x the higher band of 15 first, mean confidence, bounding box."""
    line = words.withColumn("line", F.bround(F.col("y1") / step) * step)
    ordered = F.array_sort(F.collect_list(F.struct("x1", F.bround(F.col("y1") / BAND).alias("band"), "pos", "text")))
    return line.groupBy("doc_id", "line").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.bround(F.avg("conf"), 6).alias("conf"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )


def sessions(words: DataFrame, gap: float = 5.0) -> DataFrame:
    """Number lines by adjacency: a new one where the height differs from the word before by gap or more."""
    w = W.partitionBy("doc_id").orderBy("pos")
    new = F.coalesce((F.abs(F.col("y1") - F.lag("y1").over(w)) >= gap).cast("int"), F.lit(1))
    return words.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def anchored(words: DataFrame, reach: float = 10.0, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pos, grp): groups of consecutive words of each key (a document, or also its pages and labels) no farther than reach from the first of their group; one walk over a key's words."""
    kinds = dict(words.dtypes)
    rows = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "y1"))).alias("ws"))

    def walk(row: dict) -> list[dict]:
        out, at, n = [], None, 0
        for w in row["ws"]:
            if at is None or abs(w["y1"] - at) > reach:
                at, n = w["y1"], n + 1
            out.append({**{k: row[k] for k in keys}, "pos": w["pos"], "grp": n})
        return out

    return folded(rows, walk, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"pos {kinds['pos']}", "grp int"]))


def token_windows(words: DataFrame, size: int, stride: int) -> DataFrame:
    """Overlapping windows of each document's words: first place, number of words, first and last text."""
    w = W.partitionBy("doc_id").orderBy("pos")
    placed = words.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    low = F.greatest(F.lit(0), F.floor((F.col("i") - size) / stride).cast("int") + 1)
    each = placed.withColumn("k", F.explode(F.sequence(low, F.floor(F.col("i") / stride).cast("int"))))
    return each.groupBy("doc_id", (F.col("k") * stride).alias("start")).agg(F.count("*").alias("n_words"), F.min(F.struct("i", "text"))["text"].alias("first_text"), F.max(F.struct("i", "text"))["text"].alias("last_text"))


def bio_spans(tags: DataFrame, column: str, lenient: bool) -> DataFrame:
    """(seq_id, type, start, end) of the spans of a column of BIO tags.

    Strict: an inside tag without an open span is ignored, one of another type starts a span. Lenient: any inside tag
    after outside or another type starts one. Both by flags and running sums over the sequence.
    """
    w = W.partitionBy("seq_id").orderBy("pos")
    kind = F.substring(F.col(column), 1, 1)
    t = tags.withColumn("_k", kind).withColumn("_t", F.when(kind != "O", F.substring(F.col(column), 3, 100)))
    if not lenient:
        t = t.withColumn("_o", F.sum((F.col("_k") == "O").cast("int")).over(w))
        run = W.partitionBy("seq_id", "_o").orderBy("pos")
        t = t.withColumn("_open", F.max((F.col("_k") == "B").cast("int")).over(run)).withColumn("_t", F.when(F.col("_open") == 1, F.col("_t")))
    before = F.lag("_t").over(w)
    start = F.col("_t").isNotNull() & ((F.col("_k") == "B") | before.isNull() | (before != F.col("_t")))
    t = t.withColumn("_n", F.sum(start.cast("int")).over(w)).where("_t is not null")
    return t.groupBy("seq_id", F.col("_n").alias("span"), F.col("_t").alias("type")).agg(F.min("pos").alias("start"), F.max("pos").alias("end"))


def predicted_entities(tokens: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(page_id, pos, label, value, confidence) of tokens (page_id, pos, word, text, label, confidence): the entities that predicted BIO labels spell.

    Tokens without a word are left out, and a label less sure than threshold is O. A word counts by its first token, or, where that
    starts or continues nothing, by its first B: an I continues an open entity of its type, starts one of another type, and is nothing where none
    is open; O closes. An entity has the texts of its words, the place of the first and the greatest confidence.
    """
    sure = F.when(F.col("confidence") >= threshold, F.col("label")).otherwise("O")
    own = F.struct("pos", sure.alias("label"), "confidence", "text")
    begins = F.when(sure.startswith("B-"), own)
    words = tokens.where("word is not null").groupBy("page_id", "word").agg(F.min(own).alias("first"), F.min(begins).alias("begin"))
    kind = F.substring("first.label", 1, 1)
    by_word = W.partitionBy("page_id").orderBy("word")
    words = words.withColumn("kind", kind).withColumn("run", F.count_if(F.col("kind") == "O").over(by_word))
    before = W.partitionBy("page_id", "run").orderBy("word").rowsBetween(W.unboundedPreceding, -1)
    opened = F.coalesce(F.max((F.col("begin").isNotNull()).cast("int")).over(before), F.lit(0)) == 1
    words = words.withColumn("taken", F.when((F.col("kind") == "I") & opened, F.col("first")).otherwise(F.col("begin"))).where("taken is not null")
    words = words.withColumn("type", F.substring("taken.label", 3, 200))
    new = F.col("taken.label").startswith("B-") | (F.col("type") != F.lag("type").over(by_word))
    words = words.withColumn("n", F.count_if(F.coalesce(new, F.lit(True))).over(by_word))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", F.col("taken.text").alias("text")))), lambda w: w["text"]), " ")
    spans = words.groupBy("page_id", "n", F.col("type").alias("label")).agg(F.min("taken.pos").alias("pos"), F.trim(texts).alias("value"), F.max("taken.confidence").alias("confidence"))
    return spans.where("value <> ''").select("page_id", "pos", "label", "value", "confidence")


def fused(own: DataFrame, second: DataFrame) -> DataFrame:
    """(id, bl_number, containers, items): a first reading of headers (id, bl_number, containers, n_items, confidence) filled from a second one.

    An empty number is the second's, its containers are added where absent, its items are taken where they are more, or as many and the
    first reading's confidence is under 0.5. Headers that only one reading has stay as they are.
    """
    named = lambda d, tag: d.select("id", F.struct("bl_number", "containers", "n_items", "confidence").alias(tag))
    met = named(own, "a").join(named(second, "b"), "id", "full")
    none = F.array().cast("array<string>")
    more = (F.coalesce("b.n_items", F.lit(0)) > F.coalesce("a.n_items", F.lit(0))) | ((F.col("b.n_items") == F.col("a.n_items")) & (F.col("a.confidence") < 0.5))
    taken = F.when(F.coalesce(more, F.lit(False)), "second").otherwise("own")
    return met.select("id", F.coalesce(filled(F.col("a.bl_number")), filled(F.col("b.bl_number"))).alias("bl_number"), F.array_union(F.coalesce("a.containers", none), F.coalesce("b.containers", none)).alias("containers"), taken.alias("items"))


def confusion(tags: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 of each class of token-level tags, O left out."""
    hit = F.col("gold") == F.col("pred")
    rows = tags.select(F.explode(F.array(F.struct(F.col("gold").alias("class"), hit.cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), (~hit).cast("long").alias("fn")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), (~hit).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    sums = rows.where("class <> 'O'").groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return with_scores(sums)


def with_scores(sums: DataFrame) -> DataFrame:
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = 2 * p * r / F.greatest(p + r, F.lit(1e-8))
    return sums.withColumn("precision", F.bround(p, 4)).withColumn("recall", F.bround(r, 4)).withColumn("f1", F.bround(f1, 4))


def metrics_report(scores: DataFrame) -> DataFrame:
    """scores (class, tp, fp, fn, f1, ...) in order of F1: adds place, from 1, the best first, equal ones by name; a row a class, so one window holds them."""
    return scores.where("class <> 'O' and tp + fp + fn > 0").withColumn("place", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("f1"), "class")).cast("bigint"))


def dataset_counts(tags: DataFrame) -> DataFrame:
    """(entity, pages, words, labelled, coverage, spans): a row for each entity with its number of spans, the most first by place, each with the totals of the set; gold BIO labels of pages seq_id. An empty set gives no rows."""
    spans = bio_spans(tags, "gold", False)
    per = spans.groupBy(F.col("type").alias("entity")).agg(F.count("*").alias("spans"))
    whole = tags.agg(F.count_distinct("seq_id").alias("pages"), F.count("*").alias("words"), F.count_if(F.col("gold") != "O").alias("labelled"))
    whole = whole.withColumn("coverage", F.bround(F.col("labelled") / F.greatest("words", F.lit(1)), 6))
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("spans"), "entity")).cast("bigint")  # a row an entity
    return per.withColumns({"place": place, "_k": F.lit(1)}).join(F.broadcast(whole.withColumn("_k", F.lit(1))), "_k").drop("_k")  # whole is one row


def chunk_scores(tags: DataFrame) -> DataFrame:
    """Micro precision, recall and F1 of exact spans, and the share of sequences with a predicted tag, all in percent."""
    key = ["seq_id", "type", "start", "end"]
    gold, pred = bio_spans(tags, "gold", True).select(*key), bio_spans(tags, "pred", True).select(*key)
    side = gold.withColumn("g", F.lit(1)).withColumn("p", F.lit(0)).unionByName(pred.withColumn("g", F.lit(0)).withColumn("p", F.lit(1)))
    each = side.groupBy(*key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    sums = each.agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"))
    p, r = F.col("tp") / F.greatest("n_pred", F.lit(1)), F.col("tp") / F.greatest("n_gold", F.lit(1))
    seqs = tags.groupBy("seq_id").agg(F.bool_or(F.col("pred") != "O").alias("any")).agg(F.count("*").alias("n"), F.count_if("any").alias("some"))
    sums = sums.withColumn("k", F.lit(1)).join(F.broadcast(seqs.withColumn("k", F.lit(1))), "k")  # one row each
    share = F.bround(100 * F.col("some") / F.greatest("n", F.lit(1)), 2).alias("with_prediction")
    return sums.select("tp", "n_pred", "n_gold", share, F.bround(100 * p, 2).alias("precision"), F.bround(100 * r, 2).alias("recall"), F.bround(100 * 2 * p * r / F.greatest(p + r, F.lit(1e-8)), 2).alias("f1"))
