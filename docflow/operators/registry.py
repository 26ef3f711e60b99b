"""Rules and fields as data: which layer reads a value, what a value must look like, and which sheet and column a field has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels that the layout of a page gives; all others come from patterns.
LAYOUT_LABELS = (
    "invoice_number", "invoice_date", "bl_number", "bl_date", "issue_date", "seller_name", "seller_address", "buyer_name", "buyer_address", "shipper_name", "shipper_address", "consignee_name", "consignee_address",
    "notify_party_name", "notify_party_address", "vessel_name", "voyage_number", "port_of_loading", "port_of_discharge", "place_of_receipt", "place_of_delivery", "currency", "incoterms", "freight_term", "country_of_origin",
    "country_of_destination", "description_of_goods", "kind_of_packages",
)
#: What the values of fields must look like.
RULES = {
    "barang_hs": r"^[0-9]{8,13}$", "dokumen_tanggal": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "kode_pelabuhan_muat": "^[A-Z]{5}$", "kode_pelabuhan_bongkar": "^[A-Z]{5}$", "kontainer_nomor": "^[A-Z]{4}[0-9]{7}$",
    "barang_netto": r"^[0-9]+\.?[0-9]*$", "barang_bruto": r"^[0-9]+\.?[0-9]*$", "barang_fob": r"^[0-9]+\.?[0-9]*$", "barang_cif": r"^[0-9]+\.?[0-9]*$",
}


def layer_of(label: Column) -> Column:
    return F.when(label.isin(*LAYOUT_LABELS), "layout").otherwise("pattern")


def checked(values: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """values (field, value, ...) with valid: whether the value meets its field's rule; null for fields without one and null values. rules: (field, pattern), a row a field; by default RULES."""
    if rules is None:
        pattern = F.create_map(*[F.lit(x) for rule in RULES.items() for x in rule])[F.col("field")]
        met = values.withColumn("_pattern", pattern)
    else:
        met = values.join(rules.select("field", F.col("pattern").alias("_pattern")), "field", "left")
    return met.withColumn("valid", F.call_function("rlike", F.col("value"), F.col("_pattern"))).drop("_pattern")


def sheet_order(fields: DataFrame) -> DataFrame:
    """(sheet, place) of the sheets of a registry (ord, key, sheet, entity, required), in the order in which they first come."""
    first = fields.groupBy("sheet").agg(F.min("ord").alias("ord"))
    return first.withColumn("place", F.expr("row_number() over (order by ord)")).select("sheet", "place")  # a row a sheet


def fields_of(fields: DataFrame, sheet: str | None = None, entity: str | None = None, required: bool = False) -> DataFrame:
    """The fields of a registry of a sheet or of an entity, or those that a declaration must have."""
    for column, wanted in (("sheet", sheet), ("entity", entity)):
        if wanted is not None:
            fields = fields.where(F.col(column) == wanted)
    return fields.where("required") if required else fields
