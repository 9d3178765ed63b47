"""Readers of labelled text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import LABELLED_TEXT
from ..storage import stored


def parse_tagged(line: Column, sep: str) -> Column:
    """struct(words, tags) of a line of word + sep + tag items; a tag is null where the
    separator is missing."""
    items = F.filter(F.split(line, " "), lambda x: x != "")
    cut = lambda x, k: F.try_element_at(F.split(x, re.escape(sep)), F.lit(k))
    return F.struct(F.transform(items, lambda x: cut(x, 1)).alias("words"), F.transform(items, lambda x: cut(x, 2)).alias("tags"))


def read_tagged(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """(words, tags) of each line of text files."""
    return spark.read.text(path).select(parse_tagged(F.col("value"), sep).alias("t")).select("t.*")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(accept, spans, text) of JSON lines with text, spans and answer."""
    return spark.read.schema(LABELLED_TEXT).json(path).select((F.col("answer") == "accept").alias("accept"), "spans", "text")


def train_test(rows: DataFrame, order: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of rows by ``order``, and the rest. Rows are sorted by ranges;
    only the ranges' sizes are added up in one place."""
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    at = F.monotonically_increasing_id()
    own = stored(ranged.withColumn("__range", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))), "ranges")
    sizes = own.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__first"))
    ranked = own.join(F.broadcast(starts), "__range").withColumn("__rank", F.col("__first") + F.col("__at") + 1)
    first = F.col("__rank") <= int(share * rows.count())
    return ranked.filter(first).select(rows.columns), ranked.filter(~first).select(rows.columns)
