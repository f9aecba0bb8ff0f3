"""Kafka scan settings. The connector is a separate package; nothing here needs a broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The defaults of the streaming word count.
DEFAULT_BROKERS = "kafka.kafka-service:9092"
DEFAULT_GROUP = "spark-streaming-word-count"
DEFAULT_TOPICS = "spark-streaming-test"


def kafka_options(
    brokers: str = DEFAULT_BROKERS,
    topics: str = DEFAULT_TOPICS,
    group: str = DEFAULT_GROUP,
    protocol: str = "",
    mechanism: str = "",
    jaas: str = "",
) -> dict[str, str]:
    """Options of the source; the security ones only when given."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": ",".join(t.strip() for t in topics.split(",") if t.strip()),
        "kafka.group.id": group,
    }
    security = {
        "kafka.security.protocol": protocol,
        "kafka.sasl.mechanism": mechanism,
        "kafka.sasl.jaas.config": jaas,
    }
    return options | {key: value for key, value in security.items() if value}


def kafka_scan(spark: SparkSession, **settings: str) -> DataFrame:
    """Stream of key, value, topic, partition, offset, timestamp."""
    return spark.readStream.format("kafka").options(**kafka_options(**settings)).load()
