"""Contracts of the operational tables: key, cursor, columns and types."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalar import checked_identifier

# Logical types and what they are in Spark.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "int32": T.IntegerType(), "int64": T.LongType(), "decimal_10_2": T.DecimalType(10, 2), "decimal_10_6": T.DecimalType(10, 6), "timestamp_us": T.TimestampNTZType(),
}
METADATA = {"_ingestion_id": "string", "_ingested_at": "timestamp_us", "_source_table": "string", "_source_updated_at": "timestamp_us", "_ingestion_method": "string"}
EPOCH = datetime(1970, 1, 1)
TIME_FORMAT = "%Y-%m-%dT%H:%M:%S.%f"


@dataclass(frozen=True)
class TableContract:
    """What a source table must look like. All columns may be null in the raw layer; the key is checked later."""

    name: str
    key: tuple[str, ...]
    columns: Mapping[str, str]
    watermark: str = "updated_at"

    def __post_init__(self) -> None:
        checked_identifier(self.name)
        for c in self.columns:
            checked_identifier(c)
        if not self.key or len(set(self.key)) != len(self.key):
            raise ValueError(f"{self.name}: a key needs columns, each once")
        if missing := [c for c in (*self.key, self.watermark) if c not in self.columns]:
            raise ValueError(f"{self.name}: not among the columns: {missing}")
        if self.watermark in self.key:
            raise ValueError(f"{self.name}: the watermark is not part of the key")
        if unknown := sorted(set(self.columns.values()) - set(TYPES)):
            raise ValueError(f"{self.name}: unknown types {unknown}")
        if self.columns[self.watermark] != "timestamp_us":
            raise ValueError(f"{self.name}: the watermark is a timestamp")
        if bad := [c for c in self.key if self.columns[c] not in ("string", "int32", "int64")]:
            raise ValueError(f"{self.name}: keys are strings or whole numbers, not {bad}")

    @property
    def cursor(self) -> tuple[str, ...]:
        return self.watermark, *self.key

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[t]) for c, t in self.columns.items()])

    def bronze_schema(self) -> T.StructType:
        return T.StructType([*self.schema().fields, *[T.StructField(c, TYPES[t]) for c, t in METADATA.items()]])

    def initial_watermark(self) -> dict[str, object]:
        """Below every row: the epoch, and the smallest value of each key column."""
        return {self.watermark: EPOCH} | {c: "" if self.columns[c] == "string" else 0 for c in self.key}

    def select(self, df: DataFrame) -> DataFrame:
        """The contract's columns with its types, in its order; a missing one is an error."""
        if missing := [c for c in self.columns if c not in df.columns]:
            raise ValueError(f"{self.name}: missing columns {missing}")
        return df.select(*[F.col(c).cast(TYPES[t]).alias(c) for c, t in self.columns.items()])

    def to_json(self, mark: Mapping[str, object]) -> dict[str, object]:
        self.check_mark(mark)
        return {c: v.strftime(TIME_FORMAT) if isinstance(v, datetime) else v for c, v in mark.items()}

    def from_json(self, mark: Mapping[str, object]) -> dict[str, object]:
        out = dict(mark)
        if not isinstance(out.get(self.watermark), str):
            raise ValueError(f"{self.name}: a watermark needs {self.watermark}")
        out[self.watermark] = datetime.strptime(out[self.watermark], TIME_FORMAT)
        self.check_mark(out)
        return out

    def check_mark(self, mark: Mapping[str, object]) -> None:
        if set(mark) != set(self.cursor):
            raise ValueError(f"{self.name}: a watermark has {self.cursor}, not {sorted(mark)}")
        for c, v in mark.items():
            want = datetime if c == self.watermark else str if self.columns[c] == "string" else int
            if not isinstance(v, want) or isinstance(v, bool):
                raise ValueError(f"{self.name}: {c} of a watermark is {v!r}")

    def order(self, mark: Mapping[str, object]) -> tuple:
        """For comparing watermarks; strings by code point."""
        return tuple(mark[c] for c in self.cursor)


TIMES = {"created_at": "timestamp_us", "updated_at": "timestamp_us"}


def contract(name: str, key: str, **columns: str) -> TableContract:
    short = {"s": "string", "i": "int32", "l": "int64", "d": "decimal_10_2", "g": "decimal_10_6", "t": "timestamp_us"}
    return TableContract(name, tuple(key.split()), {c: short[t] for c, t in columns.items()} | TIMES)


# Columns of the source tables (s string, i int, l long, d money, g degrees, t time).
CONTRACTS: dict[str, TableContract] = {
    c.name: c
    for c in (
        contract("orders", "order_id", order_id="s", customer_id="s", warehouse_id="s", order_status="s", order_purchase_timestamp="t", order_approved_at="t", order_delivered_carrier_date="t", order_delivered_customer_date="t", order_estimated_delivery_date="t", source_system="s"),
        contract("customers", "customer_id", customer_id="s", customer_unique_id="s", customer_zip_code_prefix="s", customer_city="s", customer_state="s"),
        contract("warehouses", "warehouse_id", warehouse_id="s", warehouse_city="s", warehouse_region="s"),
        contract("product_category_name_translation", "product_category_name", product_category_name="s", product_category_name_english="s"),
        contract("sellers", "seller_id", seller_id="s", seller_zip_code_prefix="s", seller_city="s", seller_state="s"),
        contract("products", "product_id", product_id="s", product_category_name="s", product_name_lenght="i", product_description_lenght="i", product_photos_qty="i", product_weight_g="d", product_length_cm="d", product_height_cm="d", product_width_cm="d"),
        contract("geolocation", "geolocation_id", geolocation_id="l", geolocation_zip_code_prefix="s", geolocation_lat="g", geolocation_lng="g", geolocation_city="s", geolocation_state="s"),
        contract("order_items", "order_id order_item_id", order_id="s", order_item_id="i", product_id="s", seller_id="s", shipping_limit_date="t", price="d", freight_value="d", warehouse_id="s", quantity="i"),
        contract("order_payments", "order_id payment_sequential", order_id="s", payment_sequential="i", payment_type="s", payment_installments="i", payment_value="d"),
        contract("order_reviews", "review_id order_id", review_id="s", order_id="s", review_score="i", review_comment_title="s", review_comment_message="s", review_creation_date="t", review_answer_timestamp="t"),
        contract("inventory", "warehouse_id product_id", warehouse_id="s", product_id="s", quantity_available="i"),
    )
}


def contract_of(name: str) -> TableContract:
    if name not in CONTRACTS:
        raise KeyError(f"no contract for {name!r}; known: {', '.join(sorted(CONTRACTS))}")
    return CONTRACTS[name]
