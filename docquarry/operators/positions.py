"""Phrases in texts by postings with positions.

A text's postings are (text key, word, position).  A phrase of three words or more has whole words but for its first and
last.  Of three words the one whole word may be frequent, so that is looked up with the ``EDGE`` characters on either side
of it.  Of more words the ``RAREST`` rarest whole ones (by how often they occur in all texts) are looked up, and their
places must fit one another: place minus offset in the phrase is the same.  A phrase of one or two words need not hold a whole word of the
text, but its longest piece lies within one; the words that hold it are found among the distinct words of all texts,
which are far fewer than texts have, by a run of characters.  What is left are few pairs of a phrase and a text,
and these are verified character for character.

Postings carry 64-bit keys, no text, and only those of rare words are joined, so frequent words make no hot keys
unless a phrase has no others.  The rarest words and the pairs are written before texts are joined to them: where they are
few, no posting and no text is shuffled; else a text travels once, to be joined to the pairs that it is in.  Equal keys of
different texts or words only add pairs to verify.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.sources.shared import sized, written

RAREST, GRAM, EDGE = 3, 3, 3


def _words(text: Column) -> Column:
    """(word, place) of a text's words."""
    return F.transform(T.tokens(text), lambda w, i: F.struct(F.xxhash64(w).alias("f"), i.alias("at")))


def _in_words(short: DataFrame, texts: DataFrame, key: Column, text: Column) -> DataFrame:
    """(_p, _t): texts with a word that holds the longest piece of a phrase (_p, _w) of one or two words."""
    piece = F.element_at(F.array_sort(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    pieces = short.select("_p", piece.alias("_piece"))
    words = texts.select(F.explode(T.tokens(text)).alias("_word")).distinct()
    # exploded rows take many times what Spark expects of them, so such joins are not left to its estimates
    runs = words.select("_word", F.explode(T.char_grams(F.col("_word"), GRAM)).alias("_run"))
    asked = pieces.select("_p", "_piece", F.explode(T.char_grams(F.col("_piece"), GRAM)).alias("_run"))
    n = runs.join(asked.select("_run").distinct(), "_run", "left_semi").groupBy("_run").agg(F.count("*").alias("_n"))
    rarest = asked.hint("merge").join(n, "_run").groupBy("_p", "_piece").agg(F.min_by("_run", F.struct("_n", "_run")).alias("_run"))
    held = rarest.hint("merge").join(runs, "_run").where(F.contains("_word", "_piece")).select("_p", "_word")
    few = pieces.where(F.length("_piece") < GRAM).join(words, F.contains("_word", "_piece")).select("_p", "_word")
    met = sized(written(held.unionByName(few), "words-held"), F.octet_length("_word") + 16)
    own = texts.select(key, F.explode(F.array_distinct(T.tokens(text))).alias("_word"))
    return met.join(own, "_word").select("_p", "_t").distinct()


def _edged(three: DataFrame, texts: DataFrame, key: Column, text: Column) -> DataFrame:
    """(_p, _t): texts with the middle word of a phrase (_p, _w) of three words between words that end and begin as the
    phrase's first and last do.  A shorter first or last word is known by one character."""
    known = lambda w: F.when(F.length(w) < EDGE, 1).otherwise(EDGE)
    feature = lambda a, before, own, b, after: F.xxhash64(a, F.right(before, a), own, b, F.left(after, b))
    w = lambda i: F.get("_w", F.lit(i))
    asked = three.select("_p", feature(known(w(0)), w(0), w(1), known(w(2)), w(2)).alias("f"))
    asked = sized(written(asked, "edges"), F.lit(16))
    around = lambda own: F.transform(own, lambda x, i: F.struct(F.get(own, i - 1).alias("_b"), x.alias("_o"), F.get(own, i + 1).alias("_a")))
    places = texts.select(key, F.inline(T.bound(T.tokens(text), around))).where("_b IS NOT NULL AND _a IS NOT NULL")
    each = F.explode(F.array(*(feature(F.lit(a), F.col("_b"), F.col("_o"), F.lit(b), F.col("_a")) for a in (1, EDGE) for b in (1, EDGE))))
    return places.select("_t", each.alias("f")).join(asked, "f").select("_p", "_t").distinct()


def _met(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(_p, _t): phrases (_p, f, at) and texts (_t, f, at) whose RAREST rarest features fit."""
    asked = asked.distinct()
    n = texts.join(asked.select("f").distinct(), "f", "left_semi").groupBy("f").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_p")
    known = asked.join(n, "f", "left").withColumns({"_all": F.count("*").over(whole), "_known": F.count("_n").over(whole)})
    # a phrase with a feature that no text has is in no text
    rare = known.where("_all = _known").withColumn("_rank", F.row_number().over(whole.orderBy("_n", "at"))).where(F.col("_rank") <= RAREST)
    rare = rare.select("_p", "f", F.col("at").alias("_at"), F.least("_all", F.lit(RAREST)).alias("_need"))
    rare = sized(written(rare, "rarest"), F.lit(28))
    places = texts.join(rare.select("f").distinct(), "f", "left_semi")
    met = rare.join(places, "f").groupBy("_p", "_t", (F.col("at") - F.col("_at")).alias("_start")).agg(F.count_distinct("_at", "f").alias("_have"), F.first("_need").alias("_need"))
    return met.where("_have = _need").select("_p", "_t").distinct()


def containing(phrases: DataFrame, texts: DataFrame, phrase: str, text: str) -> DataFrame:
    """phrases x texts, where the text holds the phrase, character for character.  Their names may not clash.

    Phrases of white space alone, a stated set, are compared with every text.  Null phrases and texts are in nothing; an
    empty phrase is in every text."""
    p, t = F.col(f"`{phrase}`"), F.col(f"`{text}`")
    own = phrases.where(p.isNotNull()).select(p.alias("_phrase"), F.xxhash64(p).alias("_p")).distinct().withColumn("_w", T.tokens(F.col("_phrase")))
    inner = F.transform(F.slice("_w", 2, F.size("_w") - 2), lambda w, i: F.struct(F.xxhash64(w).alias("f"), (i + 1).alias("at")))
    key = F.xxhash64(t).alias("_t")
    own = written(own, "phrases")  # of a known size: where phrases are few, postings of texts aren't shuffled to be looked up
    longer, three = own.where(F.size("_w") > 3), own.where(F.size("_w") == 3).select("_p", "_w")
    found = own.select("_p", F.lit(0).cast("long").alias("_t")).limit(0)
    if longer.limit(1).count():
        found = found.unionByName(_met(longer.select("_p", F.inline(inner)), texts.select(key, F.inline(_words(t)))))
    if three.limit(1).count():
        found = found.unionByName(_edged(three, texts, key, t))
    short = own.where(F.size("_w").between(1, 2)).select("_p", "_w")
    if short.limit(1).count():
        found = found.unionByName(_in_words(short, texts, key, t))
    left = phrases.select(F.struct(*(F.col(f"`{c}`") for c in phrases.columns)).alias("_phrase"), F.xxhash64(p).alias("_p"), p.alias("_asked"))
    right = texts.select(F.struct(*(F.col(f"`{c}`") for c in texts.columns)).alias("_text"), key)
    held = F.contains(F.col("_text").getField(text), F.col("_asked"))
    found = written(found.join(left, "_p"), "phrases-found")
    found = sized(found, 2 * F.octet_length("_asked") + 64)  # where pairs are few, texts stay where they are
    pairs = right.join(found, "_t").where(held).select("_phrase", "_text")  # texts last, so that they are shuffled once at most
    blank = left.where(F.size(T.tokens(F.col("_asked"))) == 0)
    if blank.limit(1).count():
        pairs = pairs.unionByName(right.join(blank.where("_asked IS NOT NULL"), held).select("_phrase", "_text"))
    return pairs.select("_phrase.*", "_text.*")
