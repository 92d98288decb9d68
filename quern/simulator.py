"""Deterministic order simulation: draws come from hashes of ids, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shares in percent of orders with so many products, and of what becomes of a created order.
PRODUCT_COUNTS = ((1, 40), (2, 35), (3, 20), (4, 5))
NEXT_OF_CREATED = (("approved", 90), ("canceled", 8), ("unavailable", 2))
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card")
# Status, the next one, and the age that an order needs for it.
STEPS = (("approved", "processing", "interval 15 minutes"), ("processing", "shipped", "interval 2 hours"), ("shipped", "delivered", "interval 1 day"))
CREATED_AGE = "interval 2 minutes"
# The time that an order gets with a status, statuses whose pieces go back into stock, and where simulated orders come from.
TIME_OF = {"approved": "order_approved_at", "shipped": "order_delivered_carrier_date", "delivered": "order_delivered_customer_date"}
RETURNED = ("canceled", "unavailable")
SOURCE = "simulator"


def percent(*key: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(100))


def pick(draw: Column, shares: tuple) -> Column:
    """The value whose share of 0 to 99 the draw falls into."""
    out, top = F.lit(shares[-1][0]), sum(s for _, s in shares)
    for value, share in reversed(shares):
        top -= share
        out = F.when(draw >= top, F.lit(value)).otherwise(out) if value == shares[-1][0] else F.when((draw >= top) & (draw < top + share), F.lit(value)).otherwise(out)
    return out


def next_of_created(draw: Column) -> Column:
    return pick(draw, NEXT_OF_CREATED)


def latest_prices(items: DataFrame) -> DataFrame:
    """(product_id, price): the price of each product's latest line; nulls have no price."""
    from quern.operators.versions import first_of_group

    return first_of_group(items.where("price is not null"), "product_id", "updated_at", ["price", "order_id"]).select("product_id", "price")


def numbered(rows: DataFrame, key: str, parts: int = 64) -> tuple[DataFrame, int]:
    """Rows with gapless numbers from 0 in the order of (part of the key's hash, key), and how many there are. No task orders more than a part."""
    from pyspark.sql import Window as W

    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(parts)))
    ahead, starts = 0, []
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():  # a row a part
        starts.append((r["__part"], ahead))
        ahead += r["count"]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part long, __ahead long"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1
    return dealt.withColumn("__inside", inside).join(before, "__part").withColumn("number", F.col("__ahead") + F.col("__inside")).drop("__part", "__ahead", "__inside"), ahead


def generate_orders(spark: SparkSession, n: int, products: DataFrame, customers: int, at: str, seed: int = 1, stock: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, items, payments) of n new orders. products: (product_id, price), looked up by number, not collected.

    stock: (warehouse_id, product_id, quantity_available); with it each order has a warehouse and only lines that the
    warehouse can serve, the first orders being served first (`decremented` gives what is left).
    """
    ts = F.lit(at).cast("timestamp_ntz")
    ids = spark.range(n).withColumn("order_id", F.concat(F.lit(f"sim-{seed}-"), F.col("id")))
    orders = ids.select("id", "order_id", (F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(customers))).alias("customer_id"), F.lit("created").alias("order_status"), ts.alias("order_purchase_timestamp"), F.lit("simulator").alias("source_system"), ts.alias("created_at"), ts.alias("updated_at"))
    with_number, total = numbered(products, "product_id")
    lines = ids.withColumn("order_item_id", F.explode(F.sequence(F.lit(1), pick(percent(F.col("id"), seed=seed), PRODUCT_COUNTS))))
    lines = lines.withColumn("number", F.pmod(F.xxhash64("id", F.lit(seed + 2)) + F.col("order_item_id") * 7, F.lit(max(1, total))))
    items = lines.join(with_number, "number").select("id", "order_id", "order_item_id", "product_id", (F.pmod(F.xxhash64("id", "order_item_id", F.lit(seed + 3)), F.lit(3)) + 1).cast("int").alias("quantity"), "price", (F.col("price") * F.lit("0.10").cast("decimal(3,2)")).cast("decimal(10,2)").alias("freight_value"))
    if stock is not None:
        items = served(items, stock, seed)
        orders = orders.join(items.groupBy("order_id").agg(F.min("warehouse_id").alias("warehouse_id")), "order_id")
    value = F.sum(F.col("price") * F.col("quantity") + F.col("freight_value")).cast("decimal(10,2)")
    payments = items.groupBy("order_id").agg(value.alias("payment_value")).select("order_id", F.lit(1).alias("payment_sequential"), F.element_at(F.array(*map(F.lit, PAYMENT_TYPES)), (F.pmod(F.xxhash64("order_id"), F.lit(4)) + 1).cast("int")).alias("payment_type"), F.lit(1).alias("payment_installments"), "payment_value")
    return orders.drop("id"), items.drop("id"), payments


def served(items: DataFrame, stock: DataFrame, seed: int) -> DataFrame:
    """The lines that the order's warehouse can serve, in order of the orders; a running sum for each warehouse and product."""
    from pyspark.sql import Window as W

    places = stock.select("warehouse_id").distinct().withColumn("draw", F.xxhash64("warehouse_id", F.lit(seed)))
    homes = F.broadcast(places.agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "warehouse_id"))), lambda x: x["warehouse_id"]).alias("homes")))  # a name for each warehouse
    at = items.join(homes).withColumn("warehouse_id", F.element_at("homes", (F.pmod(F.xxhash64("id", F.lit(seed + 4)), F.size("homes")) + 1).cast("int"))).drop("homes")
    so_far = F.sum("quantity").over(W.partitionBy("warehouse_id", "product_id").orderBy("id", "order_item_id").rowsBetween(W.unboundedPreceding, 0))
    return at.join(stock, ["warehouse_id", "product_id"]).withColumn("so_far", so_far).where("so_far <= quantity_available").drop("so_far", "quantity_available")


def decremented(stock: DataFrame, items: DataFrame) -> DataFrame:
    """What is left of the stock after these lines; the guard of `withdrawn` holds, so nothing falls below 0."""
    from quern.operators.inventory import withdrawn

    return withdrawn(stock, items).drop("refused")


def due(now: Column) -> Column:
    """Whether an order is old enough for its next step; final statuses never are."""
    out = F.lit(False)
    for status, age in (("created", CREATED_AGE), *((s, a) for s, _, a in STEPS)):
        out = out | ((F.col("order_status") == status) & (F.col("updated_at") <= now - F.expr(age)))
    return out


def advance(orders: DataFrame, now: str, seed: int = 1, draw: Column | None = None) -> DataFrame:
    """One step of the status machine for orders that are old enough; final statuses stay.

    draw: 0 to 99 for each order, by default from a hash of its id. A step sets `updated_at` and the time that goes with the new status.
    """
    t = F.lit(now).cast("timestamp_ntz")
    new = F.when(F.col("order_status") == "created", next_of_created(percent(F.col("order_id"), seed=seed) if draw is None else draw))
    for status, after, _ in STEPS:
        new = new.when(F.col("order_status") == status, F.lit(after))
    moved = orders.withColumn("__new", F.when(due(t), new))
    times = {c: F.when(F.col("__new") == status, t).otherwise(F.col(c)) for status, c in TIME_OF.items() if c in orders.columns}
    moved = moved.withColumns(times | {"updated_at": F.when(F.col("__new").isNotNull(), t).otherwise(F.col("updated_at"))})
    return moved.withColumn("order_status", F.coalesce("__new", "order_status")).drop("__new")


def oldest_due(orders: DataFrame, now: str, limit: int) -> DataFrame:
    """The orders that are due for a step, oldest first; `limit` is the size of a cycle."""
    return orders.where(due(F.lit(now).cast("timestamp_ntz"))).orderBy("updated_at", "order_id").limit(limit)


def cycle(orders: DataFrame, now: str, limit: int, seed: int = 1, draw: Column | None = None) -> DataFrame:
    """The simulated orders that a cycle moves, as they are afterwards, with `old_status`."""
    picked = oldest_due(orders.where(F.col("source_system") == SOURCE), now, limit)
    return advance(picked.withColumn("old_status", F.col("order_status")), now, seed, draw)


def applied(orders: DataFrame, moved: DataFrame) -> DataFrame:
    """Orders after a cycle. One whose status is no longer the one that the cycle saw is an error: two cycles took the same order."""
    now = orders.join(moved.select("order_id", F.struct(*[c for c in moved.columns if c != "order_id"]).alias("__m")), "order_id", "left")
    drift = F.col("__m").isNotNull() & (F.col("order_status") != F.col("__m.old_status"))
    checked = now.withColumn("order_id", F.when(drift, F.raise_error(F.concat(F.lit("moved by another cycle: "), F.col("order_id").cast("string"))).cast(orders.schema["order_id"].dataType)).otherwise(F.col("order_id")))
    return checked.select(*[F.col(c) if c == "order_id" or c not in moved.columns else F.when(F.col("__m").isNotNull(), F.col(f"__m.{c}")).otherwise(F.col(c)).alias(c) for c in orders.columns])


def transitions(moved: DataFrame) -> DataFrame:
    """(old_status, order_status, orders) of a cycle."""
    return moved.groupBy("old_status", "order_status").agg(F.count(F.lit(1)).alias("orders"))


def returned_stock(stock: DataFrame, moved: DataFrame, items: DataFrame) -> DataFrame:
    """Stock with the pieces of orders that a cycle has called off. Pieces that no stock row can take are an error."""
    from quern.operators.inventory import KEY, restocked

    back = items.join(moved.where(F.col("order_status").isin(*RETURNED)).select("order_id"), "order_id", "left_semi")
    lost = back.join(stock.select(*KEY), KEY, "left_anti").count()
    if lost:
        raise ValueError(f"no stock row for {lost} lines")
    return restocked(stock, back)
