"""Queries on training data, sets, windows and arrays, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import documents, training
from ..sources.views import load, sql, view
from .registry import query

SHIP, ITEM, CAND, WORD, TAG, HEAD = (sql(v) for v in ("v_shipments", "v_items", "v_candidates", "v_words", "v_tags", "v_headers"))


@query(f"{TAG} SELECT seq_id, CAST(('0x' || substr(md5(CAST(seq_id AS VARCHAR)), 1, 4)) AS INT) < 52428 AS train, count(*) AS n FROM v_tags GROUP BY seq_id")
def group_split(spark, d) -> DataFrame:
    return view(spark, d, "v_tags").groupBy("seq_id", training.is_train(F.col("seq_id")).alias("train")).agg(F.count("*").alias("n"))


@query(
    f"""{TAG}, e AS (SELECT seq_id AS run, pos AS epoch, CAST(pos % 97 AS DOUBLE) AS f1 FROM v_tags), b AS (SELECT *, f1 > coalesce(max(f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS better FROM e),
 i AS (SELECT *, sum(better::INT) OVER (PARTITION BY run ORDER BY epoch) AS island FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY epoch) - (island > 0)::INT AS idle FROM i), s AS (SELECT *, min(epoch) FILTER (idle >= 2) OVER (PARTITION BY run) AS stop FROM k)
 SELECT run, coalesce(max(f1) FILTER (better), 0) AS best, max(epoch) FILTER (better) AS best_epoch, max(epoch) AS last_epoch FROM s WHERE stop IS NULL OR epoch <= stop GROUP BY run"""
)
def best_epoch(spark, d) -> DataFrame:
    epochs = view(spark, d, "v_tags").select(F.col("seq_id").alias("run"), F.col("pos").alias("epoch"), (F.col("pos") % 97).cast("double").alias("f1"))
    return training.best_epochs(epochs, 2)


_SIDES = f"{CAND}, s AS (SELECT doc_id, coalesce(list_sort(list(DISTINCT label) FILTER (layer = 'layout')), []) AS a, coalesce(list_sort(list(DISTINCT label) FILTER (layer = 'pattern')), []) AS b FROM v_candidates GROUP BY doc_id)"


@query(f"{_SIDES} SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS all_labels, array_to_string(list_filter(a, lambda x: list_contains(b, x)), ',') AS both, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS layout_only, len(list_filter(a, lambda x: list_contains(b, x))) > 0 AS meet FROM s")
def label_sets(spark, d) -> DataFrame:
    side = lambda layer: F.array_sort(F.collect_set(F.when(F.col("layer") == layer, F.col("label"))))
    s = view(spark, d, "v_candidates").groupBy("doc_id").agg(side("layout").alias("a"), side("pattern").alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return s.select("doc_id", text(F.array_union("a", "b")).alias("all_labels"), text(F.array_intersect("a", "b")).alias("both"), text(F.array_except("a", "b")).alias("layout_only"), F.arrays_overlap("a", "b").alias("meet"))


@query(f"{CAND} SELECT doc_id, label, CASE WHEN count(*) FILTER (layer = 'layout') = 0 THEN 'pattern' WHEN count(*) FILTER (layer = 'pattern') = 0 THEN 'layout' ELSE 'both' END AS evidence FROM v_candidates GROUP BY doc_id, label")
def evidence_labels(spark, d) -> DataFrame:
    n = lambda layer: F.count_if(F.col("layer") == layer)
    kind = F.when(n("layout") == 0, "pattern").when(n("pattern") == 0, "layout").otherwise("both")
    return view(spark, d, "v_candidates").groupBy("doc_id", "label").agg(kind.alias("evidence"))


_KEYS = "SELECT DISTINCT l_suppkey % 100 AS k FROM lineitem WHERE l_returnflag = '{}'"


@query(f"SELECT 'union' AS op, k FROM ({_KEYS.format('A')} UNION {_KEYS.format('R')}) UNION ALL SELECT 'intersect', k FROM ({_KEYS.format('A')} INTERSECT {_KEYS.format('R')}) UNION ALL SELECT 'except', k FROM (SELECT DISTINCT l_suppkey % 100 AS k FROM lineitem EXCEPT SELECT DISTINCT l_suppkey % 100 FROM lineitem WHERE l_partkey % 2 = 0)")
def set_operations(spark, d) -> DataFrame:
    rows = load(spark, d, "lineitem").withColumn("k", F.col("l_suppkey") % 100)
    a, r = (rows.where(F.col("l_returnflag") == x).select("k") for x in ("A", "R"))
    named = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return named(a.union(r).distinct(), "union").unionAll(named(a.intersect(r), "intersect")).unionAll(named(rows.select("k").subtract(rows.where("l_partkey % 2 = 0").select("k")), "except"))


@query("SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 1")
def items_cube(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("bigint").alias("g"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).where("n > 1")


@query(
    f"""{ITEM} SELECT doc_id, ord, rank() OVER (PARTITION BY doc_id ORDER BY partkey % 5) AS r, dense_rank() OVER (PARTITION BY doc_id ORDER BY partkey % 5) AS dr, ntile(3) OVER (PARTITION BY doc_id ORDER BY ord) AS part, lead(partkey) OVER (PARTITION BY doc_id ORDER BY ord) AS following,
 CAST(sum(partkey) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three FROM v_items"""
)
def item_ranks(spark, d) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("ord")
    five = W.partitionBy("doc_id").orderBy(F.col("partkey") % 5)
    return view(spark, d, "v_items").select("doc_id", "ord", F.rank().over(five).alias("r"), F.dense_rank().over(five).alias("dr"), F.ntile(3).over(w).alias("part"), F.lead("partkey").over(w).alias("following"), F.sum("partkey").over(w.rowsBetween(-2, 0)).alias("last_three"))


@query(f"{WORD} SELECT doc_id, round_even(sum(conf * length(text)) / sum(length(text)), 6) AS conf, max(x2) AS width, string_agg(text, ' ' ORDER BY x1, pos) AS text FROM v_words GROUP BY doc_id")
def weighted_fragments(spark, d) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("x1", "pos", "text")))
    return view(spark, d, "v_words").groupBy("doc_id").agg(F.bround(F.sum(F.col("conf") * F.length("text")) / F.sum(F.length("text")), 6).alias("conf"), F.max("x2").alias("width"), F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


@query(f"{WORD} SELECT doc_id, pos, CAST(greatest(0, least(1000, floor(x1 / max(x2) OVER (PARTITION BY doc_id) * 1000))) AS INT) AS nx FROM v_words")
def normalised_boxes(spark, d) -> DataFrame:
    nx = F.floor(F.col("x1") / F.max("x2").over(W.partitionBy("doc_id")) * 1000)
    return view(spark, d, "v_words").select("doc_id", "pos", F.greatest(F.lit(0), F.least(F.lit(1000), nx)).cast("int").alias("nx"))


@query(f"{CAND} SELECT doc_id, label, value, arg_min(confidence, ord) AS confidence FROM v_candidates GROUP BY doc_id, label, value")
def first_seen(spark, d) -> DataFrame:
    first = F.min(F.struct("ord", "confidence"))["confidence"]
    return view(spark, d, "v_candidates").groupBy("doc_id", "label", "value").agg(first.alias("confidence"))


@query(
    f"""{ITEM}, a AS (SELECT doc_id, list(CAST(partkey % 20 AS DOUBLE) / 2 ORDER BY ord) AS l FROM v_items GROUP BY doc_id)
 SELECT doc_id, array_to_string(list_reduce(list_transform(l, lambda v: [v]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda s: abs(s - x[1]) < 1.0)) > 0 THEN acc ELSE list_concat(acc, x) END), ',') AS kept FROM a"""
)
def tolerance_distinct(spark, d) -> DataFrame:
    l = F.array_sort(F.collect_list(F.struct("ord", ((F.col("partkey") % 20).cast("double") / 2).alias("v"))))  # noqa: E741
    rows = view(spark, d, "v_items").groupBy("doc_id").agg(F.transform(l, lambda x: x["v"]).alias("values"))
    return training.distinct_within(rows, 1.0).select("doc_id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query(f"{ITEM}, w AS (SELECT item_code, list_reverse(list_sort(list(DISTINCT CAST(gross AS INT)))) AS v FROM v_items GROUP BY item_code) SELECT item_code, v[1] AS gross, v[2] AS net FROM w")
def top_two_weights(spark, d) -> DataFrame:
    v = F.sort_array(F.collect_set(F.col("gross").cast("int")), asc=False)
    return view(spark, d, "v_items").groupBy("item_code").agg(v.alias("v")).select("item_code", F.get("v", F.lit(0)).alias("gross"), F.get("v", F.lit(1)).alias("net"))


@query(f"{WORD} SELECT doc_id, pos, string_agg(text, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS context, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS until, last_value(CASE WHEN x1 > 600 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS category FROM v_words")
def line_context(spark, d) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("pos")
    category = F.last(F.when(F.col("x1") > 600, F.col("text")), ignorenulls=True).over(w.rowsBetween(-5, -1))
    return view(spark, d, "v_words").select("doc_id", "pos", F.array_join(F.collect_list("text").over(w.rowsBetween(-3, 3)), " ").alias("context"), F.lead("pos").over(w).alias("until"), category.alias("category"))


@query(
    f"""{ITEM}, l AS (SELECT doc_id, list(item_code ORDER BY ord) AS l FROM v_items GROUP BY doc_id) SELECT doc_id, array_to_string(l[1:2], ',') AS head, array_to_string(l[-2:], ',') AS tail, l[3] AS third, len(l) AS n, array_to_string(l || list_transform(range(8 - len(l)), lambda x: '-'), ',') AS padded FROM l"""
)
def list_ends(spark, d) -> DataFrame:
    l = F.transform(F.array_sort(F.collect_list(F.struct("ord", "item_code"))), lambda x: x["item_code"])  # noqa: E741
    rows, n = view(spark, d, "v_items").groupBy("doc_id").agg(l.alias("l")), F.size("l")
    tail = F.when(n > 2, F.slice("l", -2, 2)).otherwise(F.col("l"))
    padded = F.concat("l", F.array_repeat(F.lit("-"), F.greatest(F.lit(0), 8 - n)))
    return rows.select("doc_id", F.array_join(F.slice("l", 1, 2), ",").alias("head"), F.array_join(tail, ",").alias("tail"), F.get("l", F.lit(2)).alias("third"), n.cast("bigint").alias("n"), F.array_join(padded, ",").alias("padded"))


@query(
    f"""{TAG}, t AS (SELECT sum((gold = pred AND gold <> 'O')::INT) AS tp, sum((pred <> 'O' AND gold <> pred)::INT) AS fp, sum((gold <> 'O' AND gold <> pred)::INT) AS fn FROM v_tags)
 SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round_even(tp::DOUBLE / greatest(tp + fp, 1), 4) AS precision, round_even(tp::DOUBLE / greatest(tp + fn, 1), 4) AS recall, round_even(2 * (tp::DOUBLE / greatest(tp + fp, 1)) * (tp::DOUBLE / greatest(tp + fn, 1)) / greatest(tp::DOUBLE / greatest(tp + fp, 1) + tp::DOUBLE / greatest(tp + fn, 1), 1e-8), 4) AS f1 FROM t"""
)
def token_micro(spark, d) -> DataFrame:
    sums = documents.confusion(view(spark, d, "v_tags")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return documents.with_scores(sums)


@query(f"{TAG} SELECT entity, n, 30 + CAST(n AS DOUBLE) / max(n) OVER () * 70 AS bar FROM (SELECT gold[3:] AS entity, count(*) AS n FROM v_tags WHERE gold <> 'O' GROUP BY gold[3:] ORDER BY n DESC, entity LIMIT 20)")
def entity_report(spark, d) -> DataFrame:
    counts = view(spark, d, "v_tags").where("gold <> 'O'").groupBy(F.substring("gold", 3, 100).alias("entity")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "entity").limit(20)
    return top.withColumn("bar", 30 + F.col("n") / F.max("n").over(W.partitionBy(F.lit(1))) * 70)  # 20 rows at most


_LONG = ("invoice_number", "bl_number", "currency", "incoterms", "port_of_loading", "port_of_discharge", "vessel_name", "voyage_number", "seller_name", "buyer_name", "shipper_name", "consignee_name")


@query(f"{HEAD} SELECT custkey % 50 AS k, label, array_to_string(list_sort(list(trim(value))), ',') AS texts FROM (SELECT custkey, unnest([{', '.join(map(repr, _LONG))}]) AS label, unnest([{', '.join(_LONG)}]) AS value FROM v_headers) WHERE trim(value) <> '' GROUP BY custkey % 50, label")
def entities_long(spark, d) -> DataFrame:
    """Header columns as rows, and these grouped to the list of all values by label."""
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.trim(n).alias("value")) for n in _LONG])
    long = view(spark, d, "v_headers").select((F.col("custkey") % 50).alias("k"), F.inline(rows)).where("value <> ''")
    return long.groupBy("k", "label").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("texts"))


_ANSWER = "CASE id % 5 WHEN 0 THEN '{\"a\": ' || custkey || '}' WHEN 1 THEN 'Here: ```json {\"b\": ' || custkey || '} ``` done' WHEN 2 THEN 'so {\"a\": ' || custkey || '} ok' WHEN 3 THEN 'none' ELSE '{broken' END"


@query(f"{SHIP} SELECT id, CASE WHEN id % 5 < 3 THEN CAST(custkey AS VARCHAR) END AS value FROM v_shipments")
def tolerant_json(spark, d) -> DataFrame:
    """A value under either of two keys, from answers that hold JSON bare, fenced or amid words."""
    found = view(spark, d, "v_shipments").select("id", training.tolerant_json(F.expr(_ANSWER)).alias("json"))
    return found.select("id", F.coalesce(F.get_json_object("json", "$.a"), F.get_json_object("json", "$.b")).alias("value"))


@query(f"{SHIP} SELECT id, CASE status WHEN 'Approved' THEN 'Declaration Approve' WHEN 'Failed' THEN 'Declaration Reject' ELSE 'Declaration Update' END AS action, strftime(created_at + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS at FROM v_shipments WHERE id % 3 = 0")
def audit_log(spark, d) -> DataFrame:
    """One activity for each changed shipment, at local time."""
    action = F.when(F.col("status") == "Approved", "Declaration Approve").when(F.col("status") == "Failed", "Declaration Reject").otherwise("Declaration Update")
    return view(spark, d, "v_shipments").where("id % 3 = 0").select("id", action.alias("action"), F.date_format(F.from_utc_timestamp(F.col("created_at").cast("timestamp"), "Asia/Jakarta"), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(
    f"""{ITEM}, n AS (SELECT doc_id, ord, TRY_CAST(quantity AS DOUBLE) AS q, CASE WHEN partkey % 5 <> 0 THEN TRY_CAST(price AS DOUBLE) END AS p, TRY_CAST(nullif(amount, '') AS DOUBLE) AS a FROM v_items) SELECT doc_id, ord, CASE WHEN q IS NOT NULL AND p IS NOT NULL AND a > 0 THEN CASE WHEN a / (q * p) BETWEEN 0.85 AND 1.20 THEN 0.85::DOUBLE WHEN a / (q * p) BETWEEN 0.70 AND 1.50 THEN 0.65::DOUBLE ELSE 0.30::DOUBLE END WHEN q IS NULL AND p IS NULL THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END AS confidence,
 coalesce(a, round_even(q * p, 2)) AS amount, coalesce(q, CASE WHEN p > 0 AND a > 0 AND abs(round_even(a / p, 0) * p - a) < 0.15 * a THEN round_even(a / p, 0) END) AS quantity, coalesce(p, CASE WHEN q > 0 AND a / q BETWEEN 0.01 AND 500 THEN round_even(a / q, 4) END) AS price FROM n"""
)
def derived_numbers(spark, d) -> DataFrame:
    """Trust in items by their amount; an absent amount, quantity or price derived from the other numbers. Some prices are left out to be derived."""
    rows = view(spark, d, "v_items").select("doc_id", "ord", V.number(F.col("quantity")).alias("q"), F.when(F.col("partkey") % 5 != 0, V.number(F.col("price"))).alias("p"), V.number(F.col("amount")).alias("a"))
    q, p, a = F.col("q"), F.col("p"), F.col("a")
    count, price, amount = training.derived(q, p, a)
    return rows.select("doc_id", "ord", training.fallback_confidence(q, p, a).alias("confidence"), amount.alias("amount"), count.alias("quantity"), price.alias("price"))


_SECOND = "SELECT l_orderkey AS id, 'V-' || min(l_partkey) AS bl_number, list_sort(list(DISTINCT 'TCLU' || CAST(1112200 + l_suppkey % 40 AS VARCHAR))) AS containers, count(*) AS n_items FROM lineitem GROUP BY l_orderkey"


@query(
    f"""{HEAD}, a AS (SELECT id, nullif(bl_number, '') AS bl_number, list_filter(string_split(containers, '|'), lambda x: x <> '') AS containers, CAST(custkey % 7 AS BIGINT) AS n_items, confidence FROM v_headers), b AS ({_SECOND})
 SELECT id, coalesce(a.bl_number, b.bl_number) AS bl_number, array_to_string(list_concat(coalesce(a.containers, []), list_filter(coalesce(b.containers, []), lambda x: NOT list_contains(coalesce(a.containers, []), x))), '|') AS containers,
 CASE WHEN coalesce(b.n_items, 0) > coalesce(a.n_items, 0) OR (b.n_items = a.n_items AND a.confidence < 0.5) THEN 'second' ELSE 'own' END AS items FROM a FULL JOIN b USING (id)"""
)
def vision_fusion(spark, d) -> DataFrame:
    """Headers of orders filled from what their items say."""
    own = view(spark, d, "v_headers").select("id", "bl_number", F.filter(F.split("containers", r"\|"), lambda x: x != "").alias("containers"), (F.col("custkey") % 7).cast("bigint").alias("n_items"), "confidence")
    box = F.concat(F.lit("TCLU"), (F.lit(1112200) + F.col("l_suppkey") % 40).cast("string"))
    second = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("V-"), F.min("l_partkey").cast("string")).alias("bl_number"), F.sort_array(F.collect_set(box)).alias("containers"), F.count("*").alias("n_items"), F.lit(None).cast("double").alias("confidence"))
    return documents.fused(own, second).withColumn("containers", F.array_join("containers", "|"))
