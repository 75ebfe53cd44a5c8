"""Plans and answers that a model wrote as JSON, read with tolerance."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLAN = "intent string, complexity string, query_type string, rewritten_query string, sub_queries array<string>, evidence_aspects array<string>, needs_hyde boolean"


def unfenced(raw: Column) -> Column:
    """Without code fences, from the first to the last brace."""
    bare = F.regexp_replace(F.trim(raw), "^```(json)?\\s*|\\s*```$", "")
    braces = F.regexp_extract(bare, "(?s)\\{.*\\}", 0)
    return F.when(braces != "", braces).otherwise(bare)


def plan(raw: Column) -> Column:
    """Struct of a plan; what is missing or unknown has its default.  At most five sub-questions; two to
    five distinct aspects of 80 characters, or none."""
    p = F.from_json(unfenced(raw), PLAN)
    one_of = lambda v, *known: F.when(v.isin(*known), v).otherwise(F.lit(known[0]))
    texts = lambda v, n: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda s: F.substring(F.trim(s), 1, n)), lambda s: s != "")), 1, 5)
    aspects = texts(p["evidence_aspects"], 80)
    rewritten = F.trim(p["rewritten_query"])
    return F.struct(
        one_of(p["intent"], "factual", "abstract", "multi_hop", "table").alias("intent"),
        one_of(p["complexity"], "simple", "complex").alias("complexity"),
        one_of(p["query_type"], "general", "metric", "entity").alias("query_type"),
        F.when(rewritten != "", rewritten).alias("rewritten_query"),
        texts(p["sub_queries"], 500).alias("sub_queries"),
        F.when(F.size(aspects) >= 2, aspects).otherwise(F.array().cast("array<string>")).alias("evidence_aspects"),
        F.coalesce(p["needs_hyde"], F.lit(False)).alias("needs_hyde"),
    )


def scope(text: Column) -> Column:
    """Map of ``k=v;k=v``, without empty keys or values."""
    return F.map_filter(F.str_to_map(F.regexp_replace(text, "\\s*([;=])\\s*", "$1"), F.lit(";"), F.lit("=")), lambda k, v: (F.trim(k) != "") & v.isNotNull() & (F.trim(v) != ""))


@F.pandas_udf(StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first complete JSON object of a text, whatever follows it; null if there is none."""
    decoder = json.JSONDecoder()

    def first(s: str) -> str | None:
        at = s.find("{")
        while at >= 0:
            try:
                return json.dumps(decoder.raw_decode(s, at)[0], ensure_ascii=False, sort_keys=True)
            except ValueError:
                at = s.find("{", at + 1)
        return None

    return text.map(first, na_action="ignore")


@F.pandas_udf(StringType())
def numbers_only(text: pd.Series) -> pd.Series:
    """A JSON object with nothing but finite numbers, booleans and objects of them, four levels deep."""

    def keep(v, depth: int):
        if isinstance(v, dict) and depth < 4:
            own = {str(k)[:80]: keep(x, depth + 1) for k, x in v.items()}
            return {k: x for k, x in own.items() if x is not None}
        if isinstance(v, bool):
            return v
        return v if isinstance(v, int | float) and abs(v) < float("inf") else None

    def run(s: str) -> str | None:
        try:
            out = keep(json.loads(s), 0)
        except ValueError:
            return None
        return json.dumps(out, sort_keys=True) if isinstance(out, dict) else None

    return text.map(run, na_action="ignore")
