"""Streaming counterparts: price change detection by key, progress events, windowed counts (an extension)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["product_id", "merchant_id", "store_id"]
OUT = "product_id long, merchant_id long, store_id long, price double, scraped_at timestamp, action string"


def _changes(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """An insert where the price differs from the last one of the key, else a touch of the stored row."""
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["scraped_at", "id"])
    out = []
    for price, at in zip(rows["price"], rows["scraped_at"], strict=True):
        out.append((*key, price, at, "touch" if last is not None and price == last else "insert"))
        last = price
    state.update((last,))
    yield pd.DataFrame(out, columns=["product_id", "merchant_id", "store_id", "price", "scraped_at", "action"])


def price_changes(stream: DataFrame) -> DataFrame:
    """Actions for a stream of id, product_id, merchant_id, store_id, price, scraped_at. State is one price for each key."""
    return stream.groupBy(*KEYS).applyInPandasWithState(_changes, OUT, "price double", "append", GroupStateTimeout.NoTimeout)


def batch_price_changes(rows: DataFrame) -> DataFrame:
    """The same actions for a table."""
    w = Window.partitionBy(*KEYS).orderBy("scraped_at", "id")
    before = F.lag("price").over(w)
    return rows.select(*KEYS, "price", "scraped_at", F.when(before.eqNullSafe(F.col("price")), "touch").otherwise("insert").alias("action"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Extension: events by tumbling window and type, with a watermark on ts."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"))


def once_each(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Extension: the first job of a key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


#: So many changes of the state are kept beside a snapshot of it before they are merged.
DELTAS = 8


def _last_prices(spark: SparkSession, state: str, epoch: int, before: tuple[int, list[int]]) -> DataFrame | None:
    """The last price of each key before the epoch: the latest snapshot and what later epochs changed."""
    snapshot, deltas = before
    parts = ([spark.read.parquet(f"{state}/snapshot/{snapshot}").withColumn("epoch", F.lit(snapshot))] if snapshot >= 0 else []) + [spark.read.parquet(f"{state}/delta/{e}").withColumn("epoch", F.lit(e)) for e in deltas if snapshot < e < epoch]
    if not parts:
        return None
    return reduce(DataFrame.unionByName, parts).groupBy(*KEYS).agg(F.max_by("price", "epoch").alias("price"))


def write_price_changes(stream: DataFrame, out: str, state: str, checkpoint: str):
    """Starts a query that writes the actions of price_changes() for a stream, with its state as tables; it reads what is there, then ends.

    Each micro-batch joins the last prices of its keys from the state's files and compares prices by a window, so all work is columnar and in the JVM. A batch writes its actions and its
    changes of the state to folders of its number, which a repeated batch overwrites: every row counts once, also after a failure. Every DELTAS batches the state is merged.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        snapshot = (epoch - 1) // DELTAS * DELTAS - 1 if epoch else -1
        last = _last_prices(spark, state, epoch, (snapshot, list(range(snapshot + 1, epoch))))
        if epoch and epoch % DELTAS == 0:
            last.write.mode("overwrite").parquet(f"{state}/snapshot/{epoch - 1}")
            last = spark.read.parquet(f"{state}/snapshot/{epoch - 1}")
        w = Window.partitionBy(*KEYS).orderBy("scraped_at", "id")
        before = F.lag("price").over(w)
        if last is not None:
            batch = batch.join(last.withColumnRenamed("price", "stored"), KEYS, "left")
            before = F.when(F.row_number().over(w) == 1, F.col("stored")).otherwise(before)
        rows = batch.withColumn("before", before).select(*KEYS, "id", "price", "scraped_at", F.when(F.col("before").eqNullSafe(F.col("price")), "touch").otherwise("insert").alias("action"))
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        done = spark.read.parquet(f"{out}/epoch={epoch}")
        done.groupBy(*KEYS).agg(F.max_by("price", F.struct("scraped_at", "id")).alias("price")).write.mode("overwrite").parquet(f"{state}/delta/{epoch}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
