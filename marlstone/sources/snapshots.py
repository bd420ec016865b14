"""Remote lists as snapshots: pages saved as JSON or HTML, read by Spark, deduplicated across menus."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import first_per_key

ITEM = "menu string, page int, notice_id string, title string, url string, published timestamp_ntz"
LINK = re.compile(r"""(?is)<li\b[^>]*>.*?<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>.*?(\d{4}-\d{2}-\d{2})?.*?</li>""")


def json_pages(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSON pages {menu, page, items: [{id, title, url, published}]}."""
    schema = "menu string, page int, items array<struct<id:string,title:string,url:string,published:string>>"
    pages = spark.read.schema(schema).json(path)
    item = pages.select("menu", "page", F.explode("items").alias("i"))
    return item.select("menu", "page", F.col("i.id").alias("notice_id"), F.col("i.title").alias("title"), F.col("i.url").alias("url"), F.col("i.published").try_cast("timestamp_ntz").alias("published"))


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Items of HTML list pages, named menu-page.html; the address stands for the id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, html in zip(batch["path"], batch["html"], strict=True):
                menu, _, page = name.rpartition("/")[2].rpartition(".")[0].rpartition("-")
                for href, title, day in LINK.findall(html):
                    rows.append((menu, int(page) if page.isdigit() else 1, href, unescape(re.sub(r"<[^>]+>", "", title)).strip(), href, day or None))
            yield pd.DataFrame(rows, columns=["menu", "page", "notice_id", "title", "url", "published"])

    files = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("html"))
    return files.mapInPandas(run, ITEM.replace("timestamp_ntz", "string")).withColumn("published", F.col("published").try_cast("timestamp_ntz"))


def search_fan_out(lists: list[DataFrame], code: str | None = None) -> DataFrame:
    """The union of several lists, one row per notice (the newest page wins), narrowed to titles that hold a code."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    if code:
        rows = rows.filter(F.contains(F.upper("title"), F.lit(code.upper())))
    return first_per_key(rows, ["notice_id"], [F.col("published").desc_nulls_last(), F.col("menu"), F.col("page")])


def snapshot_stream(spark: SparkSession, path: str) -> DataFrame:
    """New JSON pages as a stream; the checkpoint is the cursor."""
    schema = "menu string, page int, items array<struct<id:string,title:string,url:string,published:string>>"
    item = spark.readStream.schema(schema).json(path).select("menu", "page", F.explode("items").alias("i"))
    return item.select("menu", "page", F.col("i.id").alias("notice_id"), F.col("i.title").alias("title"), F.col("i.url").alias("url"), F.col("i.published").try_cast("timestamp_ntz").alias("published"))
