"""Industry code to sector fund."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BROAD_MARKET = "SPY"
# Fund of each major group as (first group, last group, fund); later rows win; then exceptions by full code.
MAJOR_GROUPS = (
    (1, 9, "XLP"), (10, 14, "XLB"), (13, 13, "XLE"), (15, 17, "XLI"), (20, 21, "XLP"), (22, 23, "XLY"), (24, 27, "XLB"), (28, 28, "XLV"),
    (29, 29, "XLE"), (30, 34, "XLB"), (35, 36, "XLK"), (37, 37, "XLI"), (38, 38, "XLV"), (39, 39, "XLY"), (40, 47, "XLI"), (48, 48, "XLC"),
    (49, 49, "XLU"), (50, 51, "XLI"), (52, 59, "XLY"), (60, 64, "XLF"), (65, 67, "XLRE"), (70, 72, "XLY"), (73, 73, "XLK"), (74, 78, "XLY"),
    (78, 78, "XLC"), (80, 80, "XLV"), (81, 89, "XLY"),
)
FULL_CODES = (
    (2800, "XLB"), (2810, "XLB"), (2820, "XLB"), (2860, "XLB"), (2870, "XLB"), (2890, "XLB"), (3826, "XLV"),
    (3711, "XLY"), (3713, "XLY"), (3714, "XLY"), (3715, "XLY"), (3716, "XLY"), (3751, "XLY"),
)


def sector_fund(sic: Column) -> Column:
    """Fund of a code given as text, with or without leading zeros; the broad market for anything unknown."""
    text = F.trim(sic.cast("string"))
    code = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    groups = {g: fund for lo, hi, fund in MAJOR_GROUPS for g in range(lo, hi + 1)}

    def lookup(values: dict[int, str], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)

    return F.coalesce(lookup(dict(FULL_CODES), code), lookup(groups, F.floor(code / 100).cast("int")), F.lit(BROAD_MARKET))
