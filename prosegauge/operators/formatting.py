"""Dashes, bold bullets and headers. Reported, with weight zero in the score.

The thresholds, weights and texts of hits are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prosegauge.functions import segments as seg

# What each pattern accepts.
DASH = r"(?U)—|–|(?<!\w)--(?!\w)"
BOLD_BULLET = r"(?Umd)^[\s]*[-*]\s+\*\*[^*]+\*\*"
HEADER = r"(?Umd)^#{1,6}\s+"
TITLE_CASE = r"(?Umd)^#{1,6}\s+(?:[A-Z][a-z]+\s+){2,}[A-Z][a-z]+"


def count(pattern: str) -> Column:
    return F.regexp_count("t", F.lit(pattern))


def per_500(n: Column) -> Column:
    return F.try_divide(n, F.col("nw") / 500)


def raw() -> Column:
    dashes, bullets, headers = count(DASH), count(BOLD_BULLET), count(HEADER)
    some = F.col("nw") > 0
    parts = F.array_compact(
        F.array(
            F.when((dashes > 0) & some, F.least(F.lit(1.0), per_500(dashes) / 6)),
            F.when(bullets > 0, F.least(F.lit(1.0), bullets / 8)),
            F.when((headers > 0) & some, F.least(F.lit(1.0), per_500(headers) / 8)),
        )
    )
    return F.coalesce(seg.mean(parts), F.lit(0.0))


def check() -> Column:
    dashes, bullets, headers, titles, n = count(DASH), count(BOLD_BULLET), count(HEADER), count(TITLE_CASE), F.col("nw")
    hits = F.concat(
        seg.hit_if(F.coalesce(per_500(dashes) > 2, F.lit(False)), F.concat(F.lit("  Em dash density: "), seg.fixed(per_500(dashes), 1), F.lit(" per 500 words (limit: 2) — "), dashes, F.lit(" total"))),
        seg.hit_if(bullets >= 3, F.concat(F.lit("  Bold-first bullets: "), bullets, F.lit(" instances"))),
        F.when((n > 0) & (n < 500) & (headers > 3), F.array(F.concat(F.lit("  Header density: "), headers, F.lit(" headers in "), n, F.lit(" words — excessive"))))
        .when(F.coalesce(per_500(headers) > 4, F.lit(False)), F.array(F.concat(F.lit("  Header density: "), seg.fixed(per_500(headers), 1), F.lit(" per 500 words — excessive"))))
        .otherwise(seg.none()),
        seg.hit_if(titles > 0, F.concat(F.lit("  Title Case headers: "), titles, F.lit(" instances (prefer sentence case)"))),
    )
    return seg.check(hits, raw())
