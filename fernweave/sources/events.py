"""Raw page events: decoding and encoding, Kafka and file sources, captured payload files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The operations that pages come from, and the layout of an event.
OPERATIONS = ("UserByScreenName", "Following", "UserTweets")
SCHEMA_VERSION = 1
EVENT = (
    "event_id string, schema_version int, task_id string, tree_id string, account_id string, operation string, depth int, cursor_in string, cursor_out string, status_code int, "
    "requested_at timestamp, received_at timestamp, rate_limit struct<limit:int,remaining:int,reset_at:string>, payload string"
)
REQUIRED = ("event_id", "task_id", "account_id", "operation", "payload")


def decoded(messages: DataFrame, value: str = "value") -> DataFrame:
    """messages with the event's columns and `problem`: null, or why a message can't be read. One plan, no second pass."""
    event = F.from_json(F.col(value).cast("string"), EVENT)
    # as a row of its own: filters on what an event says would be put before it, and each would read the message again for every field
    rows = messages.withColumn("__e", F.explode(F.array(event)))
    lacking = F.array_compact(F.array(*[F.when(F.col(f"__e.{c}").isNull(), F.lit(c)) for c in REQUIRED]))
    problem = F.when(F.col("__e").isNull(), F.lit("no JSON object")).when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
    problem = problem.when(~F.col("__e.operation").isin(*OPERATIONS), F.concat(F.lit("unknown operation "), F.col("__e.operation")))
    rows = rows.withColumn("problem", problem).select(*messages.columns, "__e.*", "problem")
    return rows.withColumn("schema_version", F.coalesce("schema_version", F.lit(SCHEMA_VERSION)))


def encoded(events: DataFrame) -> DataFrame:
    """(key, value): an event as JSON, with its payload as captured; pages of an account share a key and so a partition."""
    names = [part.strip().split(" ", 1)[0] for part in EVENT.split(", ") if not part.startswith(("remaining", "reset_at"))]
    fields = [F.parse_json("payload").alias("payload") if n == "payload" else F.col(n) for n in names]
    return events.select(F.col("account_id").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def from_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True) -> DataFrame:
    """Messages of a topic, from the earliest, without tombstones. Needs the Kafka connector on the class path."""
    reader = spark.readStream if stream else spark.read
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false"}
    return reader.format("kafka").options(**options).load().filter(F.col("value").isNotNull())


def to_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """Events to a topic, acknowledged by all replicas, compressed, keyed by account."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "gzip"}
    encoded(events).write.format("kafka").options(**options).save()


def from_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of lines of files under path, each a message; its place is (file, line) instead of (partition, offset)."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(path)
    return lines.select("value", F.col("_metadata.file_name").alias("topic"))


def write_captured(payloads: DataFrame, path: str) -> None:
    """payloads (value), each into a file of its own, as `captured` reads them: dealing rows into as many partitions puts two into some of them."""
    payloads.select("value").write.option("maxRecordsPerFile", 1).text(path)


def captured(spark: SparkSession, path: str) -> DataFrame:
    """(file, payload) of captured payload files, each one JSON document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("payload"))


def with_identity(pages: DataFrame) -> DataFrame:
    from fernweave.functions.rules import page_identity

    key: Column = page_identity(F.col("operation"), F.col("account_id"), F.col("cursor_in"))
    return pages.withColumn("event_id", key)
