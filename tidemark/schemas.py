"""Record types, as Spark schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "timestamp": T.TimestampType()}


def record(fields: str) -> T.StructType:
    """A schema from "name kind, name kind"; unlike a parser of DDL it needs no session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(","))])


TAXI_RIDE = record(
    "ride_id long, taxi_id long, driver_id long, is_start boolean, event_time timestamp, start_lon float, start_lat float, end_lon float, end_lat float, passenger_cnt short"
)
TAXI_FARE = record("ride_id long, taxi_id long, driver_id long, start_time timestamp, payment_type string, tip float, tolls float, total_fare float")
USER_EVENT = record("user_id string, session_id string, event_type string, page_url string, product_id string, cart_value double, event_time timestamp")
ORDER = record(
    "order_id string, customer_id string, product_id string, product_name string, category string, region string, quantity int, unit_price double, total_amount double, order_time timestamp, status string"
)
CHANGE_EVENT = record("operation string, table_name string, primary_key string, before_data string, after_data string, ts timestamp, transaction_id long, position long")
JOIN_ORDER = record("order_id string, customer_id string, product_id string, quantity int, amount double, order_time timestamp")
JOIN_CUSTOMER = record("customer_id string, name string, email string, tier string, region string, update_time timestamp")
JOIN_PRODUCT = record("product_id string, name string, category string, price double, stock_level int, update_time timestamp")
TRANSACTION = record("transaction_id string, account_from string, account_to string, amount double, currency string, ts timestamp, status string")
#: Orders as JSON on a topic: the same names in camel case.
ORDER_JSON = record(
    "orderId string, customerId string, productId string, productName string, category string, region string, quantity int, unitPrice double, totalAmount double, orderTime timestamp, status string"
)
EVENT_TYPES = ("PAGE_VIEW", "ADD_TO_CART", "REMOVE_FROM_CART", "PURCHASE")
OPERATIONS = ("INSERT", "UPDATE", "DELETE", "READ")
