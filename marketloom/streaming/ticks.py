"""Structured Streaming over ticks, bars and alerts, sharing the batch column logic."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from marketloom.functions.scalar import rnd
from marketloom.operators.series import latest_per_key
from marketloom.operators.ticks import normalize_ticks
from marketloom.sources.shared import shared_dir

LINE_PREFIX = "MARKET_EVENT "
TICK_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType()), T.StructField("sequence", T.LongType()),
    T.StructField("trade_time", T.TimestampType()), T.StructField("trade_date", T.DateType()),
    T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType()),
    T.StructField("turnover", T.DoubleType()), T.StructField("direction", T.StringType()),
    T.StructField("session", T.StringType())])


def parse_event_lines(lines: DataFrame, prefix: str = LINE_PREFIX, schema: T.StructType = TICK_SCHEMA) -> DataFrame:
    """Line-framed JSON events; lines without the prefix are ignored, malformed JSON is dropped."""
    body = F.expr(f"substring(value, {len(prefix) + 1})")
    return (lines.where(F.col("value").startswith(prefix)).select(F.from_json(body, schema).alias("e"))
            .where(F.col("e").isNotNull()).select("e.*").where("sequence IS NOT NULL"))


def once_ever(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of every key, however late a repeat comes.

    Without a watermark the keys stay in the state store for good: dealt by key hash over its partitions and kept in the
    checkpoint, so restarts and replayed batches find them. ``run_to_table`` uses the RocksDB store, whose memory is
    bounded whatever the number of keys.
    """
    return stream.dropDuplicates(keys)


def exactly_once(ticks: DataFrame) -> DataFrame:
    """Drop repeats of (ticker, trade_date, sequence); a sequence may recur on another day."""
    return once_ever(ticks, ["ticker", "trade_date", "sequence"])


def alerts_once(alerts: DataFrame) -> DataFrame:
    """One alert per event key, ever."""
    return once_ever(alerts, ["event_key"])


SIDES = ("BUY", "SELL", "NEUTRAL")


def flow_partials(ticks: DataFrame) -> DataFrame:
    """Mergeable sums of a batch of valid ticks per minute: exact decimals, counts, and the newest price with its place."""
    amount = lambda c: F.col(c).cast("decimal(28,6)")
    sums = []
    for side in SIDES:
        hit = F.col("direction") == side
        sums += [F.sum(F.when(hit, amount("turnover")).otherwise(0)).alias(f"{side.lower()}_turnover"), F.count_if(hit).alias(f"{side.lower()}_count")]
    return (ticks.withColumn("minute", F.date_trunc("minute", "trade_time")).groupBy("ticker", "trade_date", "session", "minute")
            .agg(*sums, F.sum(amount("volume")).alias("volume"), F.max(F.struct("trade_time", "sequence", "price")).alias("newest")))


def combine_flow(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all partials of a key. A late batch adds to the minutes it belongs to, and never sets back a newer last price."""
    sums = [F.sum(f"{side.lower()}_turnover").cast("double").alias(f"{side.lower()}_turnover") for side in SIDES]
    counts = [F.sum(f"{side.lower()}_count").alias(f"{side.lower()}_count") for side in SIDES]
    g = partials.groupBy(*keys).agg(*sums, *counts, F.sum("volume").cast("double").alias("volume"), F.max("newest").alias("newest"))
    return g.withColumn("last_price", F.col("newest.price")).drop("newest")


def minute_flow_table(ticks: DataFrame, purpose: str = "minute-flow") -> DataFrame:
    """The minute table of everything a tick stream has brought: each batch stores partial sums, which are added on read."""
    return combine_flow(run_to_table(exactly_once(normalize_ticks(ticks)), "append", purpose=purpose, each=flow_partials), ["ticker", "trade_date", "session", "minute"])


def day_flow_table(ticks: DataFrame, purpose: str = "day-flow") -> DataFrame:
    """Running totals of the session: one row per (ticker, day)."""
    g = combine_flow(run_to_table(exactly_once(normalize_ticks(ticks)), "append", purpose=purpose, each=flow_partials), ["ticker", "trade_date"])
    active = F.col("buy_turnover") + F.col("sell_turnover")
    return g.select("ticker", "trade_date", "buy_turnover", "sell_turnover", "neutral_turnover",
                    F.when(active > 0, (F.col("buy_turnover") - F.col("sell_turnover")) / active).alias("active_ratio"))


def news_only_after_first_sync(items: DataFrame, first_sync: DataFrame, key: str = "ticker", at: str = "published_at") -> DataFrame:
    """Silence the first back-fill: alerts only for items newer than a key's first sync instant.

    ``first_sync`` is a static table of one row per key, so this is a stream-static join.
    """
    return (items.join(first_sync.withColumnRenamed("first_sync", "_first"), key)
            .where(F.col(at) > F.col("_first")).drop("_first"))


def hourly_panes(key: str, at: str) -> Callable[[DataFrame], DataFrame]:
    """Item counts of a batch per key and hour, to be added over the batches."""
    return lambda items: items.groupBy(key, F.date_trunc("hour", at).alias("hour")).agg(F.count("*").alias("n"))


def sliding_totals(panes: DataFrame, key: str) -> DataFrame:
    """At every full hour: items of the last 24 hours, of the 24 before, of the last 168, and the change of the first two.

    Panes of an hour are added once; the totals are differences of one running sum over a key's hours. Hours without
    items count, from a key's first item until 168 hours after its last.
    """
    hour = F.floor(F.unix_timestamp("hour") / 3600).cast("long")
    h = panes.groupBy(key, hour.alias("h")).agg(F.sum("n").alias("n"))
    span = h.groupBy(key).agg(F.min("h").alias("a"), F.max("h").alias("b"))
    grid = span.select(key, F.explode(F.sequence("a", F.col("b") + 167)).alias("h")).join(h, [key, "h"], "left")
    w = Window.partitionBy(key).orderBy("h")
    run = grid.withColumn("run", F.sum(F.coalesce("n", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = {k: F.coalesce(F.lag("run", k).over(w), F.lit(0)) for k in (24, 48, 168)}
    d = run.select(key, F.timestamp_seconds((F.col("h") + 1) * 3600).alias("window_end"), (F.col("run") - at[24]).alias("current_24h"), (at[24] - at[48]).alias("previous_24h"),
                   (F.col("run") - at[168]).alias("total_168h"))
    return d.withColumn("buzz_change", rnd(F.when(F.col("previous_24h") > 0, (F.col("current_24h") - F.col("previous_24h")) / F.col("previous_24h")), 4))


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None, purpose: str = "stream", each: Callable[[DataFrame], DataFrame] | None = None, root: str | None = None) -> DataFrame:
    """Run a stream over everything available now and return its result table.

    Each micro-batch, passed through ``each``, overwrites its own folder of a shared location, so a retried batch is
    idempotent; with ``keys`` the newest batch wins per key. A later call with the same ``root`` goes on where the last one
    ended and returns the whole table. Nothing passes the driver.
    """
    spark = stream.sparkSession
    root = root or shared_dir(spark, purpose)
    each = each or (lambda batch: batch)
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def sink(batch: DataFrame, batch_id: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{root}/data/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint")
             .trigger(availableNow=True).foreachBatch(sink).start())
    query.awaitTermination()
    fields = each(spark.createDataFrame([], stream.schema)).schema.fields
    rows = spark.read.schema(T.StructType([*fields, T.StructField("batch_id", T.LongType())])).option("basePath", f"{root}/data").parquet(f"{root}/data")
    if keys:
        rows = latest_per_key(rows, keys, ["batch_id"])
    return rows.drop("batch_id")


def upsert_final_bars(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Merge a bar batch: the latest ingested values win, a bar once final stays final."""
    both = existing.unionByName(batch)
    rest = [c for c in both.columns if c not in (*keys, "is_final")]
    return (both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ingested_at").alias("r"), F.max("is_final").alias("is_final"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "is_final"))


def read_tick_stream(spark: SparkSession, folder: str, files: str, schema: T.StructType,
                     to_ticks: Callable[[DataFrame], DataFrame], files_per_batch: int | None = None) -> DataFrame:
    """A parquet file stream over the matching files of a folder, mapped to ticks."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return to_ticks(reader.parquet(folder))
