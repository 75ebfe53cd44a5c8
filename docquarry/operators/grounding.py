"""Are the numbers of an answer those of its sources?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units and what they are in the base unit.
UNITS = {"万亿元": 1e12, "亿元": 1e8, "千万元": 1e7, "百万元": 1e6, "万元": 1e4, "千元": 1e3, "元": 1.0, "亿": 1e8, "万": 1e4, "千": 1e3, "billion": 1e9, "million": 1e6, "thousand": 1e3}
_NUMBER = "[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?"


def _bare(text: Column) -> Column:
    return F.replace(F.translate(text, ",，  ", ""), F.lit("％"), F.lit("%"))


def numbers(text: Column) -> Column:
    """Numbers and percentages of a text, each once, in order; citations in brackets don't count."""
    plain = F.regexp_replace(text, "\\[[^\\]]{3,}\\]", "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(f"{_NUMBER}(?: ?[%％])?"), F.lit(0)))


def amounts(text: Column) -> Column:
    """Array of {raw, value} of the numbers with a unit, in the base unit."""
    units = "|".join(UNITS)
    found = F.regexp_extract_all(F.regexp_replace(text, "\\[[^\\]]{3,}\\]", ""), F.lit(f"{_NUMBER} ?(?:{units})"), F.lit(0))
    factor = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    return F.transform(found, lambda p: F.struct(p.alias("raw"), (F.translate(F.regexp_extract(p, f"^({_NUMBER})", 1), ",", "").cast("double") * F.element_at(factor, F.regexp_extract(p, f"({units})$", 1))).alias("value")))


def checked(answers: DataFrame, most: int = 10) -> DataFrame:
    """answers (answer, sources array<string>) with checked, missing and citations.

    A number is there if it stands in a source (separators and the per cent sign aside), or if a source has
    an equal amount in another unit (within a thousandth or 1)."""
    corpus = _bare(F.array_join("sources", "\n"))
    there = amounts(F.array_join("sources", "\n"))
    own = amounts(F.col("answer"))
    close = lambda a, b: F.abs(a - b) <= F.greatest(1e-3 * F.greatest(F.abs(a), F.abs(b)), F.lit(1.0))
    out = answers.withColumns({"_corpus": corpus, "_there": there, "_own": own, "_numbers": F.transform(numbers(F.col("answer")), F.trim)})
    equal = lambda t: F.exists("_own", lambda o: o["raw"].startswith(t) & F.exists("_there", lambda v: close(o["value"], v["value"])))
    miss = F.filter("_numbers", lambda t: ~F.contains(F.col("_corpus"), _bare(t)) & ~F.contains(F.col("_corpus"), F.replace(_bare(t), F.lit("%"), F.lit(""))) & ~equal(t))
    cites = F.size(F.regexp_extract_all("answer", F.lit("\\[[^\\]]{3,}\\]"), F.lit(0)))
    return out.withColumns({"checked": F.size("_numbers"), "missing": F.slice(miss, 1, most), "citations": cites}).drop("_corpus", "_there", "_own", "_numbers")
