"""SQL names for the engine's functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from prosegauge.functions.segments import normalize_text
from prosegauge.functions.ship import ship
from prosegauge.sources.reports import html_page, markdown_to_html


def register(spark: SparkSession) -> None:
    """``style_normalize(text)`` and ``style_html(markdown)`` for spark.sql; labels need no function of their own."""
    ship(spark)

    @F.pandas_udf("string")
    def style_normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda t: normalize_text(t or ""))

    @F.pandas_udf("string")
    def style_html(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html_page(markdown_to_html(t or "")))

    spark.udf.register("style_normalize", style_normalize)
    spark.udf.register("style_html", style_html)
