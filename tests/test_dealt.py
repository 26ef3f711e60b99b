"""Rows are dealt by their number before texts are made of them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docflow.operators.parties import bill_parties
from docflow.sources import views


def test_a_table_of_one_file_is_dealt_by_its_number_of_rows(spark, monkeypatch, tmp_path):
    spark.range(10_000).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("bigint").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(views, "MOST_ROWS", 500)
    found = views.view(spark, str(tmp_path), "v_bills", by="doc_id")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and sum(sizes) == 10_000 and max(sizes) < 1000


def test_a_window_by_the_dealt_key_needs_no_other_shuffle(spark):
    found = views.view(spark, "/root/testdata/sf0.001", "v_origins", by="doc_id").groupBy("doc_id").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lines_of_a_shipper_count_up_to_the_first_longer_than_the_caption_is_far(spark):
    text = "GOOD WORKS CO\n" + "x" * 40 + "\nOTHER WORKS LTD\nConsignee"
    short = "GOOD WORKS CO\nOTHER WORKS LTD\nConsignee"
    rows = spark.createDataFrame([(1, text), (2, short), (3, "X" * 9 + "\nConsignee"), (4, "")], "doc_id bigint, text string")
    found = {(r.doc_id, r.value) for r in bill_parties(rows).where("label = 'shipper_name'").collect()}
    assert found == {(1, "GOOD WORKS CO"), (1, "OTHER WORKS LTD"), (2, "GOOD WORKS CO"), (2, "OTHER WORKS LTD")}


#: Queries that make texts or windows of many rows, and deal them first.
DEALT = ["chunk_prf", "dataset_counts", "bio_decode", "scored_codes", "certificate_sections", "span_labels", "customs_codes", "amount_items", "item_cascade"]


@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_by_their_number(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan


@pytest.mark.parametrize("name", ["coded_items", "invoice_items"])
def test_letters_are_dealt_before_their_lines_are_read(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan or name == "invoice_items"  # the rows of its first way are stored already
    assert name != "invoice_items" or "RepartitionByExpression" in views.letters(spark, "/root/testdata/sf0.001", "v_invoices", "v_goods_letters")._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["scored_codes", "customs_codes", "coded_items"])
def test_no_filter_makes_texts_before_rows_are_dealt(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("RepartitionByExpression")[1:]
    assert below and not any("Filter" in b.split("Relation")[0] and "regexp" in b.split("Relation")[0].lower() for b in below)


def test_parts_of_letters_hold_fewer_rows(spark, monkeypatch, tmp_path):
    spark.range(10_000).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("bigint").alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert views.view(spark, str(tmp_path), "v_bills", by="doc_id", most=100).rdd.getNumPartitions() == 100
    monkeypatch.setattr(views, "MOST_LETTERS", 250)
    found = views.letters(spark, str(tmp_path), "v_invoices", "v_goods_letters")
    assert found.rdd.getNumPartitions() == 80 and found.select("doc_id").distinct().count() == 20_000


def test_rows_that_are_done_need_no_fold(spark):
    from docflow.operators.stored import folded

    rows = spark.sql("select 1L as doc_id, array(struct('a' as v, 5L as pos), struct('b' as v, 6L as pos)) as items, true as done union all select 2L, array(struct('c', 7L)), false union all select 3L, array(), null union all select 4L, array(), true")
    found = folded(rows, lambda r: [{"doc_id": r["doc_id"], "v": i["v"] + "!", "pos": i["pos"]} for i in r["items"]], "doc_id bigint, pos bigint, v string", done="items")
    assert sorted(map(tuple, found.collect())) == [(1, 5, "a"), (1, 6, "b"), (2, 7, "c!")]
