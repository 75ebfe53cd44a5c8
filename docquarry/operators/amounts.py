"""Amounts restated in brackets: do the two figures agree?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten of the words for scale.
SCALES = {"thousand": 3, "million": 6, "billion": 9, "千": 3, "万": 4, "百万": 6, "亿": 8}
_AMOUNT = "([0-9][0-9,]*(?:\\.[0-9]+)?) ?(thousand|million|billion|百万|千|万|亿)?"
_PAIR = f"([$€£¥]|USD|EUR|RMB)? ?{_AMOUNT}(?:元)? ?[(（]([$€£¥]|USD|EUR|RMB)? ?{_AMOUNT}(?:元)?[)）]"


def restatements(answer: Column) -> Column:
    """Array of {raw, agree} of "amount (amount)" pairs in one currency.  They agree within half of the
    coarser figure's last digit."""
    found = F.regexp_extract_all(answer, F.lit(_PAIR), F.lit(0))
    power = F.create_map(*(F.lit(x) for kv in {**SCALES, "": 0}.items() for x in kv))

    def part(p: Column, i: int) -> Column:
        return F.regexp_extract(p, _PAIR, i)

    def figure(p: Column, i: int) -> tuple[Column, Column]:
        scale = F.pow(F.lit(10.0), F.element_at(power, part(p, i + 1))).cast("decimal(18,0)")
        digits = F.length(F.regexp_extract(part(p, i), "\\.([0-9]+)$", 1))
        step = scale.cast("double") / F.pow(F.lit(10.0), digits)
        return F.translate(part(p, i), ",", "").cast("decimal(20,6)") * scale, step

    def one(p: Column) -> Column:
        (a, sa), (b, sb) = figure(p, 2), figure(p, 5)
        agree = F.abs(a - b).cast("double") <= F.greatest(sa, sb) / 2 * (1 + 1e-12)
        return F.struct(p.alias("raw"), agree.alias("agree"), (part(p, 1) == part(p, 4)).alias("same"))

    return F.transform(F.filter(F.transform(found, one), lambda x: x["same"]), lambda x: F.struct(x["raw"].alias("raw"), x["agree"].alias("agree")))
