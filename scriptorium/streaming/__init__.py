"""Incremental forms: append without repeats, upsert, audit with alarms, ordered pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.audit import ALARM_RECORDS, ALARM_SHARE, Check, audit_alarms
from ..operators.merge import new_rows
from ..sources.stores import last_per_key


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What a sink folder holds, empty if there is none yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path)


def append_new(stream: DataFrame, key: Column, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the first row of every key the sink doesn't hold; restarts go on where they stopped,
    and a batch that is run again adds nothing."""

    def batch(df: DataFrame, epoch: int) -> None:
        rows = df.withColumn("__key", key)
        stored = _stored(df.sparkSession, path, rows)
        new_rows(rows, "__key", order, stored).select(*rows.columns).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch (its last row per key) as a layer of the store; a batch that is run again replaces its layer.

    What a batch costs depends on the batch, not on the store.  Read it with :func:`stored_rows`; :func:`fold_layers`
    makes many layers one.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        last_per_key(df, key, order).select(*df.columns).write.mode("overwrite").parquet(f"{path}/layer={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The store of :func:`upsert_stream`: of each key the row of its last layer."""
    layers = spark.read.parquet(path)
    return last_per_key(layers, key, "layer").select(*[c for c in layers.columns if c != "layer"])


def fold_layers(spark: SparkSession, path: str, to: str, key: str) -> None:
    """The store as one layer, in a folder of its own."""
    stored_rows(spark, path, key).write.mode("overwrite").parquet(f"{to}/layer=0")


def audit_stream(stream: DataFrame, registry: list[Check], name: str, checkpoint: str) -> StreamingQuery:
    """Running counts per check in the memory table ``name``: ``check``, ``severity``, ``count``, ``total``."""
    idx = F.array_compact(F.array(F.lit(-1), *[F.when(k.applies, F.lit(i)) for i, k in enumerate(registry)]))
    counts = stream.select(F.explode(idx).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("count"))
    return counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_result(counts: DataFrame, registry: list[Check]) -> DataFrame:
    """The memory table of :func:`audit_stream` as the batch audit gives it."""
    names, kinds = F.array(*[F.lit(k.name) for k in registry]), F.array(*[F.lit(k.severity) for k in registry])
    whole = Window.partitionBy(F.lit(1))  # at most one row per check
    rows = counts.withColumn("total", F.max(F.when(F.col("idx") == -1, F.col("count"))).over(whole)).where("idx >= 0")
    return rows.select(F.get(names, F.col("idx")).alias("check"), F.get(kinds, F.col("idx")).alias("severity"), "count", "total", (F.col("count") / F.col("total")).alias("share"))


def alarms(counts: DataFrame, registry: list[Check], share: float = ALARM_SHARE, least: int = ALARM_RECORDS) -> DataFrame:
    return audit_alarms(audit_result(counts, registry), share, least)


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Saved pages of a folder as a stream of ``path`` and ``html``."""
    pages = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return pages.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def collect_pages(pages: DataFrame, listing: Column, start: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Records of the pages (``html``) of each ``listing`` up to its end: pages behind one without records, or behind a gap,
    are not taken.  What arrives is stored in ``path``/pages; :func:`listed_records` reads what counts."""
    named = pages.select(listing.alias("listing"), start.cast("long").alias("start"), "html")

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/pages/layer={epoch}")

    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def listed_records(spark: SparkSession, path: str, records: Callable[[DataFrame], DataFrame], per_page: int = 10) -> DataFrame:
    """``listing``, ``start`` and the columns of ``records`` (a function of ``page_id``, ``html``, ``start``; it gives ``page``)
    for the pages of each listing before its end."""
    pages = spark.read.parquet(f"{path}/pages").groupBy("listing", "start").agg(F.max_by("html", "layer").alias("html"))
    found = records(pages.select(F.struct("listing", "start").alias("page_id"), "html", "start"))
    counts = pages.select("listing", "start").join(found.groupBy("page.listing", "page.start").agg(F.count(F.lit(1)).alias("n")), ["listing", "start"], "left")
    one = Window.partitionBy("listing").orderBy("start")
    gap = F.col("start") != F.coalesce(F.lag("start").over(one) + per_page, F.lit(0))
    ended = counts.withColumn("over", F.max(gap | F.col("n").isNull()).over(one)).where("not over").select("listing", "start")
    flat = found.select(F.col("page.listing").alias("listing"), F.col("page.start").alias("start"), *[c for c in found.columns if c != "page"])
    return flat.join(ended, ["listing", "start"], "left_semi")
