"""Readers of batch and streaming sources, configured by values or by the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import ORDER, ORDER_JSON


@dataclass(frozen=True)
class Config:
    """Settings of the dashboard job. Brokers and the checkpoint folder must be given."""

    brokers: str
    checkpoint: str
    connection: str = ""
    orders_topic: str = "orders-raw"
    trigger: str = "60 seconds"
    watermark: str = "5 seconds"
    #: Whether a stream stops when records are gone before it has read them, or goes on without them.
    fail_on_loss: bool = True

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        missing = [k for k in ("KAFKA_BROKERS", "CHECKPOINT_DIR") if not env.get(k)]
        if missing:
            raise KeyError(f"not set: {', '.join(missing)}")
        return cls(env["KAFKA_BROKERS"], env["CHECKPOINT_DIR"], env.get("KAFKA_CONNECTION", ""), env.get("ORDERS_TOPIC", cls.orders_topic), env.get("TRIGGER", cls.trigger), env.get("WATERMARK", cls.watermark), env.get("FAIL_ON_DATA_LOSS", "true").lower() != "false")


def kafka_options(config: Config, topic: str) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": config.brokers, "subscribe": topic, "startingOffsets": "latest", "failOnDataLoss": str(config.fail_on_loss).lower()}
    if config.connection:
        out |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "PLAIN", "kafka.sasl.jaas.config": config.connection}
    return out


def snake(json_orders: DataFrame) -> DataFrame:
    """Orders with camel-case names as they come from JSON, renamed."""
    return json_orders.select(*(F.col(a.name).alias(b.name) for a, b in zip(ORDER_JSON, ORDER, strict=True)))


def parsed_orders(raw: DataFrame, column: str = "value") -> DataFrame:
    """Orders from JSON text; malformed lines are left out."""
    parsed = raw.select(F.from_json(F.col(column).cast("string"), ORDER_JSON).alias("o")).where("o.orderId is not null")
    return snake(parsed.select("o.*"))


def kafka_orders(spark: SparkSession, config: Config) -> DataFrame:
    return parsed_orders(spark.readStream.format("kafka").options(**kafka_options(config, config.orders_topic)).load())


def kafka_rows(spark: SparkSession, config: Config, topics: list[str], schema: StructType) -> DataFrame:
    """Rows of JSON topics, newest only, with their topic: what a consumer of the job's results reads."""
    raw = spark.readStream.format("kafka").options(**kafka_options(config, ",".join(topics))).load()
    return rows_of_json(raw, schema)


def rows_of_json(raw: DataFrame, schema: StructType) -> DataFrame:
    """topic and the fields of the JSON in value; a message that isn't JSON has none."""
    return raw.select("topic", F.from_json(F.col("value").cast("string"), schema).alias("r")).select("topic", "r.*")


def stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None, files: int | None = None) -> DataFrame:
    """A stream over the files of a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(folder)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_view(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame as a named table for SQL."""
    df.createOrReplaceTempView(name)
    return df
