"""Change events: routes by table, alerts and the view of latest records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_field

TABLES = ("customers", "orders", "products", "inventory")


def route() -> Column:
    """The table's own output; null for other tables."""
    return F.when(F.col("table_name").isin(*TABLES), F.col("table_name"))


def alerts(changes: DataFrame) -> DataFrame:
    """position, alert_type and key of the changes that raise an alert; an event raises one at most. Every delete does,
    of any table."""
    table, op, after = F.col("table_name"), F.col("operation"), F.col("after_data")
    update = op == "UPDATE"
    kind = (
        F.when((table == "customers") & op.isin("INSERT", "READ"), "NEW_CUSTOMER")
        .when((table == "orders") & update & has_field(after, "status", '"shipped"'), "ORDER_SHIPPED")
        .when((table == "inventory") & update & has_field(after, "quantity", "0"), "OUT_OF_STOCK")
        .when((table == "customers") & update & has_field(after, "status", '"inactive"'), "CUSTOMER_DEACTIVATED")
        .when(op == "DELETE", "RECORD_DELETED")
    )
    key = F.when(op == "DELETE", F.concat_ws(".", table, "primary_key")).otherwise(F.col("primary_key"))
    return changes.withColumns({"alert_type": kind, "key": key}).where("alert_type is not null").select("position", "alert_type", "key", "ts")


def latest_records(changes: DataFrame) -> DataFrame:
    """table_name, primary_key and after_data of the records that exist after all changes."""
    last = F.max_by(F.struct("operation", "after_data"), "position")
    out = changes.groupBy("table_name", "primary_key").agg(last.alias("r"))
    return out.where("r.operation <> 'DELETE'").select("table_name", "primary_key", F.col("r.after_data").alias("after_data"))
