"""Incremental work: which reports are still to be read, and recompiling the companies that new ones touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.operators.compiling import ROWS, compile_statements
from tallyframe.sources.publishing import BUCKETS, manifest, marked, read_published, replace_companies


def pending_reports(wanted: DataFrame, stored: DataFrame, refresh: bool = False) -> DataFrame:
    """The wanted (slug, report_year) that aren't stored yet; all of them on a refresh."""
    return wanted if refresh else wanted.join(stored.select("slug", "report_year").distinct(), ["slug", "report_year"], "left_anti")


#: What a report's version is told by: when its file came, then the file's name, then what it says.
VERSION = ("modified", "file")


def newest_versions(reports: DataFrame) -> DataFrame:
    """One report for each company, year and kind: of the greatest version (modified, file; nulls are least), and of one
    version the greatest content, so that the choice hangs neither on order nor on partitions."""
    given = [c for c in VERSION if c in reports.columns]
    most = F.max(F.struct(*given, "periods", "rows")).alias("x")
    return reports.groupBy("slug", "report_year", "kind").agg(most).select("slug", "report_year", "kind", "x.*")


def merge_reports(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored reports and new ones, one of each company, year and kind. Where both sides have versions the greatest stays,
    whichever side it is on; else a new report replaces the stored one."""
    if all(c in df.columns for c in VERSION for df in (stored, new)):
        return newest_versions(stored.unionByName(new))
    key, new = ["slug", "report_year", "kind"], newest_versions(new)
    return stored.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def recompile_touched(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The compiled statements of just the companies that new reports touch: of merge_reports, which is told in order of
    each company's reports, so that reports that come partitioned by company stay where they are."""
    if all(c in stored.columns and c in new.columns for c in VERSION):
        touched = new.select("slug").distinct()
        return compile_statements(merge_reports(stored, new).join(touched, "slug", "left_semi"))
    given = [c for c in VERSION if c in new.columns]
    shown = ("slug", "report_year", "kind", "periods", "rows")
    version = new.select(F.struct(F.lit(0), *given).alias("v")).schema["v"].dataType
    side = lambda df, is_new: df.select(*shown, (F.struct(F.lit(0), *given) if is_new else F.lit(None)).cast(version).alias("_version"), F.lit(is_new).alias("_new"))
    r = side(stored, False).unionByName(side(new, True))
    same = Window.partitionBy("slug", "report_year", "kind")
    r = r.withColumn("_rank", F.row_number().over(same.orderBy(F.desc("_new"), F.desc("_version"), F.desc("periods"), F.desc("rows"))))
    # as in a join, a null stands for no other
    replaced = F.max("_new").over(same) & F.col("report_year").isNotNull() & F.col("kind").isNotNull()
    r = r.withColumn("_replaced", replaced).withColumn("_touched", F.max("_new").over(Window.partitionBy("slug")))
    kept = F.when(F.col("_new"), F.col("_rank") == 1).otherwise(~F.col("_replaced"))
    return compile_statements(r.where(F.col("slug").isNotNull() & F.col("_touched") & kept).select(*shown))


def apply_batch(new: DataFrame, batch: int, reports: str, compiled: str, stream: str = "reports", buckets: int = BUCKETS, crash: Callable[[str], None] = lambda at: None) -> None:
    """Merges one batch of report rows (slug, report_year, kind, periods, rows, modified, file) into the published table
    `reports`, then publishes the statements of the companies that it touches in `compiled`.

    Each table records the batch with the version that holds it, so a batch that is done does nothing; one that was cut
    short after any of its writes takes up where the records say, and gives what an undisturbed one gives. crash is
    called with the name of each step before it and after the last (for tests).
    """
    spark = new.sparkSession
    companies = new.select("slug").where("slug is not null").distinct()
    if marked(spark, reports, stream) < batch:
        m = manifest(spark, reports)
        old = read_published(spark, reports).join(companies, "slug", "left_semi") if m else new.limit(0)
        crash("reports data")
        replace_companies(merge_reports(old, new), companies, reports, order=("report_year", "kind"), buckets=buckets, mark=(stream, batch), before_publish=lambda: crash("reports manifest"))
    if marked(spark, compiled, stream) < batch:
        crash("compiled data")
        touched = read_published(spark, reports).drop(*VERSION).join(companies, "slug", "left_semi")
        replace_companies(compile_statements(touched), companies, compiled, order=("kind", "ord"), buckets=buckets, mark=(stream, batch), before_publish=lambda: crash("compiled manifest"))
    crash("done")


def refresh_incremental(spark: SparkSession, incoming: str, reports: str, compiled: str, checkpoint: str, buckets: int = BUCKETS, crash: Callable[[str], None] = lambda at: None) -> None:
    """Takes all report files (Parquet) that have come to `incoming` since the last call, merges them into the published
    table `reports`, and replaces the statements of the companies that they touch in the published table `compiled`.

    Of reports of one company, year and kind the one whose file came last counts (of files of one time the one of the
    greater name), in whatever order and batches they are taken. Late reports of older years need no rule: the newest
    figure wins. A call that is cut short anywhere is made good by the next one (see apply_batch). Nothing in `incoming`
    means nothing to do; the folder must exist. One checkpoint belongs to one pair of tables.
    """
    schema = f"slug string, report_year int, kind string, periods array<string>, rows {ROWS}"
    stream = spark.readStream.schema(schema).parquet(incoming)
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_name").alias("file"))

    def batch(new: DataFrame, number: int) -> None:
        new = new.persist()
        if not new.isEmpty():
            apply_batch(new, number, reports, compiled, buckets=buckets, crash=crash)
        new.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
