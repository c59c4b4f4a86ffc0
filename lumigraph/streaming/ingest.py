"""Uploads as a stream: classified as they arrive, one row per file, counted per window and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumigraph.functions import names


def uploads(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the media rows that land in ``folder`` as parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def classified(media: DataFrame) -> DataFrame:
    p = F.col("path")
    return media.withColumns({"name": names.basename(p), "suffix": F.lower(names.suffix(p)), "kind": names.kind(p)}).where("kind is not null")


def once(media: DataFrame, at: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """Files delivered again within ``late`` count once; state beyond the watermark is dropped."""
    return media.withWatermark(at, late).dropDuplicatesWithinWatermark(["path"])


def counts(media: DataFrame, at: str = "ingested_at", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Files per window and kind, final once the watermark has passed."""
    return media.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
