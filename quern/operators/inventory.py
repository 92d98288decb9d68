"""Stock by warehouse and product: distribution, restocking, guarded withdrawal, rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["warehouse_id", "product_id"]


def distribution(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("warehouse_id").agg(F.count(F.lit(1)).alias("product_count"), F.sum("quantity_available").cast("long").alias("total_quantity"))


def restocked(inventory: DataFrame, returned: DataFrame) -> DataFrame:
    """Stock plus returned pieces. returned: (warehouse_id, product_id, quantity), any number of rows for a key."""
    back = returned.groupBy(*KEY).agg(F.sum("quantity").alias("back"))
    return inventory.join(back, KEY, "left").select(*KEY, (F.col("quantity_available") + F.coalesce("back", F.lit(0))).cast("int").alias("quantity_available"))


def withdrawn(inventory: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stock after withdrawals that it can serve; a key with too little stays as it is."""
    need = wanted.groupBy(*KEY).agg(F.sum("quantity").alias("need"))
    q, n = F.col("quantity_available"), F.coalesce("need", F.lit(0))
    return inventory.join(need, KEY, "left").select(*KEY, F.when(q >= n, q - n).otherwise(q).cast("int").alias("quantity_available"), (q < n).alias("refused"))


def rules(inventory: DataFrame, products: DataFrame, warehouses: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """(check_name, failures): products in too few or too many warehouses, unknown references, negative stock."""
    from .quality import all_checks, counters, relationship

    held = products.select("product_id").join(inventory, "product_id", "left").groupBy("product_id").agg(F.count("warehouse_id").alias("n"))
    return all_checks(
        counters(held, {"too_few_warehouses": F.col("n") < least, "too_many_warehouses": F.col("n") > most}), counters(inventory, {"negative_quantity": F.col("quantity_available") < 0}),
        relationship(inventory, "product_id", products, "product_id", "inventory_product"), relationship(inventory, "warehouse_id", warehouses, "warehouse_id", "inventory_warehouse"),
    )
