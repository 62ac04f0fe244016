"""Declared schemas of the six source tables (no inference pass on read)."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


_LINES = _struct(
    order_id=T.LongType(),
    product_id=T.LongType(),
    add_to_cart_order=T.IntegerType(),
    reordered=T.IntegerType(),
)

# Table name -> raw file name.
RAW_FILES = {
    "orders": "orders.csv",
    "order_products_prior": "order_products__prior.csv",
    "order_products_train": "order_products__train.csv",
    "products": "products.csv",
    "aisles": "aisles.csv",
    "departments": "departments.csv",
}

SCHEMAS = {
    "orders": _struct(
        order_id=T.LongType(),
        user_id=T.LongType(),
        eval_set=T.StringType(),
        order_number=T.IntegerType(),
        order_dow=T.IntegerType(),
        order_hour_of_day=T.IntegerType(),
        days_since_prior_order=T.DoubleType(),
    ),
    "order_products_prior": _LINES,
    "order_products_train": _LINES,
    "products": _struct(
        product_id=T.LongType(),
        product_name=T.StringType(),
        aisle_id=T.IntegerType(),
        department_id=T.IntegerType(),
    ),
    "aisles": _struct(aisle_id=T.IntegerType(), aisle=T.StringType()),
    "departments": _struct(department_id=T.IntegerType(), department=T.StringType()),
}

REQUIRED = {name: schema.fieldNames() for name, schema in SCHEMAS.items()}

DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
