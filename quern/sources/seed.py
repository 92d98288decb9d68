"""Seed load: nine CSV files into tables, all or none, and its validation."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.contracts import contract_of
from quern.operators.quality import all_checks, counters
from quern.storage import Files, SnapshotTable, schema_of

from .readers import read_seed

# Seed files and their tables in the order of loading, constants that files lack, foreign keys, and columns that must not be null.
SEED_FILES = {
    "olist_geolocation_dataset.csv": "geolocation", "product_category_name_translation.csv": "product_category_name_translation", "olist_customers_dataset.csv": "customers", "olist_products_dataset.csv": "products",
    "olist_sellers_dataset.csv": "sellers", "olist_orders_dataset.csv": "orders", "olist_order_items_dataset.csv": "order_items", "olist_order_payments_dataset.csv": "order_payments", "olist_order_reviews_dataset.csv": "order_reviews",
}
CONSTANTS = {"orders": {"source_system": "olist_seed"}}
FOREIGN_KEYS = (
    ("orders", "customers", "customer_id"), ("order_items", "orders", "order_id"), ("order_items", "products", "product_id"), ("order_items", "sellers", "seller_id"), ("order_payments", "orders", "order_id"),
    ("order_reviews", "orders", "order_id"),
)
REQUIRED = {
    "customers": ("customer_unique_id",), "orders": ("customer_id", "order_status", "order_purchase_timestamp"), "order_items": ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
    "order_payments": ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"), "order_reviews": ("review_id", "order_id"),
}
SHORT = {"order_items": "items", "order_payments": "payments", "order_reviews": "reviews"}


def load_seed(spark: SparkSession, folder: str, target: str, files: Mapping[str, str] = SEED_FILES) -> dict[str, int]:
    """Rows by table. Nothing is loaded if a file is missing or a table is there already. A file may be a folder of files of its name, each with the
    header; one task reads each, as records may hold line breaks, so a large table should come as a folder.

    All tables are staged first; then a plan names the staged data and every table is pointed at its own. A run that finds a
    plan ends it, so a crash leaves either no table or all.
    """
    store, plan_path = Files(spark), f"{target}/_seed_plan.json"
    tables = {name: SnapshotTable(spark, f"{target}/{name}") for name in files.values()}
    if not store.exists(plan_path):
        if missing := [f for f in files if not store.exists(f"{folder}/{f}")]:
            raise FileNotFoundError(f"seed files missing: {', '.join(missing)}")
        if there := [n for n, t in tables.items() if t.exists()]:
            raise ValueError(f"loaded before: {', '.join(there)}")
        plan, staged = {}, []
        try:
            for f, name in files.items():
                df = read_seed(spark, contract_of(name), f"{folder}/{f}", **CONSTANTS.get(name, {}))
                staged.append(f"{target}/{name}")
                plan[name] = [tables[name].staged(df), schema_of(df)]
        except Exception:
            for path in staged:
                store.delete(path)
            raise
        store.write(plan_path, json.dumps(plan))
    for name, (part, schema) in json.loads(store.read(plan_path)).items():
        if not tables[name].exists():
            tables[name].point([part], schema)
    store.delete(plan_path)
    return {name: t.read().count() for name, t in tables.items()}


def row_count_checks(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], files: Mapping[str, str] = SEED_FILES) -> DataFrame:
    """(check_name, failures): 1 where a file hasn't as many records as its table."""
    out = []
    for f, name in files.items():
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/{f}").agg(F.count(F.lit(1)).alias("a"))
        both = rows.join(tables[name].agg(F.count(F.lit(1)).alias("b")))
        out.append(both.select(F.lit(f"row_count_{name}").alias("check_name"), (F.col("a") != F.col("b")).cast("long").alias("failures")))
    return all_checks(*out)


def orphan_checks(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """The foreign keys whose tables are both given; a null is an orphan here. Each child is read once."""
    out = []
    for child in dict.fromkeys(c for c, _, _ in FOREIGN_KEYS):
        rows, checks = tables.get(child), {}
        for i, (_, parent, key) in enumerate(k for k in FOREIGN_KEYS if k[0] == child):
            if rows is not None and parent in tables:
                keys = tables[parent].select(F.col(key).alias(f"__k{i}")).distinct().withColumn(f"__there{i}", F.lit(True))
                rows = rows.join(keys, F.col(key) == F.col(f"__k{i}"), "left")
                checks[f"relationship_{SHORT.get(child, child)}_{SHORT.get(parent, parent)}"] = F.col(f"__there{i}").isNull()
        if checks:
            out.append(counters(rows, checks))
    return all_checks(*out) if out else None


def null_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    return all_checks(*[counters(tables[t], {f"null_{t}_{c}": F.col(c).isNull() for c in columns}) for t, columns in REQUIRED.items() if t in tables])
