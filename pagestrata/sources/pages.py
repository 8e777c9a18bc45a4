"""Where pages come from, and where results go."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import urls

PAGES = "page_id BIGINT, url STRING, html STRING"


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages stored as Parquet: page_id, url, html and further columns."""
    return spark.read.parquet(path)


def html_files(spark: SparkSession, path: str, base: str) -> DataFrame:
    """HTML files of a folder as pages; a file's URL is its name below ``base``."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return files.select(F.concat(F.lit(base.rstrip("/") + "/"), F.element_at(F.split("file", "/"), -1)).alias("url"), F.col("value").alias("html"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file, one a line; blank lines and lines with # are left out, a missing scheme is https.

    position keeps the order; a URL that can't be one is null.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("raw"), F.monotonically_increasing_id().alias("position"))
    return lines.where((F.col("raw") != "") & ~F.col("raw").startswith("#")).select("position", "raw", urls.normalized_input(F.col("raw")).alias("url"))


def first_of_each(inputs: DataFrame, key: str = "url", order: str = "position") -> DataFrame:
    """Inputs without repetition: of equal ones the first by ``order``."""
    return inputs.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def write_results(results: DataFrame, path: str, form: str = "parquet") -> None:
    """Results as Parquet or JSON, a row a page."""
    getattr(results.write.mode("overwrite"), form)(path)


#: Schemes, hosts and file types that no page can be read from.
RESTRICTED = r"(?i)^(?:chrome|chrome-extension|edge|brave|about|moz-extension|devtools|view-source|data|javascript|file):"


def readable(inputs: DataFrame, key: str = "url") -> DataFrame:
    """Inputs that are pages of the web: not a browser's own, and not null."""
    return inputs.where(F.col(key).isNotNull() & ~F.col(key).rlike(RESTRICTED))


def all_inputs(*sources: DataFrame) -> DataFrame:
    """URLs of several sources (named ones, a list's, a sitemap's), each once: those of the first source first, then as they stand there.

    A source has url and, if its order matters, position.
    """
    told = [s.select("url", F.struct(F.lit(i).alias("source"), (F.col("position") if "position" in s.columns else F.monotonically_increasing_id()).cast("bigint").alias("at")).alias("position")) for i, s in enumerate(sources)]
    return first_of_each(readable(reduce(DataFrame.unionByName, told)))


def stored_entries(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Stored histories or caches: a table scan; with a version, only entries of that version."""
    rows = spark.read.parquet(path)
    return rows if version is None else rows.where(F.col("version") == version)
