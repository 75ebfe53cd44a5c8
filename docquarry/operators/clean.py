"""Cleaning of paged text, and HTML to lines.

Pages: doc_id, page, text.  Cleaning starts from the raw pages and is done once: removing edge lines moves
the edge, so a second pass could remove more.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docquarry.functions import text as T

HEADER_SHARE, HEADER_TOKENS, MARGIN = 0.5, 24, 0.15


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Full-width forms to half-width, compatibility forms to plain ones."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references of HTML as characters."""
    return text.map(html.unescape, na_action="ignore")


def lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, n, total, line): the lines of each page, from 0."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    return pages.select("doc_id", "page", F.size(split).alias("total"), F.posexplode(split).alias("n", "line"))


def at_edge(margin: float = MARGIN) -> Column:
    place = F.col("n") / F.col("total")
    return (place <= margin) | (place >= 1 - margin)


def repeated_lines(of_pages: DataFrame, share: float = HEADER_SHARE, most_tokens: int = HEADER_TOKENS) -> DataFrame:
    """(doc_id, key): lines that stand on at least max(2, share) of the pages of a document with three or
    more, and are short."""
    pages = of_pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    keyed = of_pages.select("doc_id", "page", T.strip(F.col("line")).alias("key")).where("key <> ''").where(T.token_count(F.col("key")) <= most_tokens).distinct()
    found = keyed.groupBy("doc_id", "key").agg(F.count("*").alias("on"))
    return found.join(pages, "doc_id").where((F.col("pages") >= 3) & (F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share)))).select("doc_id", "key", "on", "pages")


def cleaned_lines(of_pages: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The lines that stay: without repeated lines and page numbers at the edges of pages."""
    marked = of_pages.withColumn("key", T.strip(F.col("line"))).join(repeated_lines(of_pages).select("doc_id", "key", F.lit(True).alias("_repeated")), ["doc_id", "key"], "left")
    gone = at_edge(margin) & (F.coalesce("_repeated", F.lit(False)) | T.is_page_number(F.col("line")))
    return marked.where(~gone).drop("key", "_repeated")


def cleaned_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text) after cleaning."""
    kept = cleaned_lines(lines(pages)).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("_l"))
    out = kept.select("doc_id", "page", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))
    return pages.select("doc_id", "page").join(out, ["doc_id", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def page_quality(text: Column, limit: float = 0.02) -> Column:
    """Struct: share of control and replacement characters, and whether the page is good."""
    bad = F.regexp_count(text, F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]"))
    ratio = F.when(F.length(text) > 0, bad / F.length(text)).otherwise(0.0)
    return F.struct(ratio.alias("bad_ratio"), (ratio <= limit).alias("good"))


def extraction_rate(pages: DataFrame, least: int = 20) -> DataFrame:
    """Share of the pages of each document with some text."""
    return pages.groupBy("doc_id").agg(F.avg((F.length(F.regexp_replace("text", f"{T.WS}+", "")) >= least).cast("int")).alias("rate"))


def html_lines(page: Column) -> Column:
    """Text lines of an HTML page: scripts and styles go, block tags break lines, cells become tabs.
    Character references stay (``unescaped`` decodes them)."""
    s = F.regexp_replace(page, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    s = F.regexp_replace(s, "(?i)</?(p|div|tr|br|li|ul|ol|table|h[1-6]|nav|article|section|header|footer|title|body|head)([ /][^>]*)?>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "(?i)</t[dh]>", "\t"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(s, "\n"), lambda x: F.trim(F.regexp_replace(x, "[\\t\\x0B\\f\\r ]+", " "))), lambda x: x != "")


def markdown_clean(page: Column) -> Column:
    """Recognised pages in Markdown with HTML in it: cells and rows as text, images as a mark."""
    s = F.regexp_replace(page, "!\\[[^\\]]*\\]\\([^)]*\\)|<img[^>]*>", "[image]")
    s = F.regexp_replace(F.regexp_replace(s, "(?i)</t[dh]>", " | "), "(?i)</tr>|<br[^>]*>", "\n")
    return T.strip(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", ""), "\n{3,}", "\n\n"))


def table_text(rows: Column) -> Column:
    """Cells joined by bars, rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")


def good_table(headers: Column, rows: Column) -> Column:
    """A table of numbers: three columns, and a year in the head, or four columns of which a quarter of
    the rows are mostly numbers, or a year in the first rows and two rows with numbers."""
    bare = lambda c: F.trim(c).rlike("^(19|20)[0-9]{2}(年(度)?)?$")
    numeric = lambda c: F.trim(c).rlike("^[-(]?[0-9][0-9,.]*[)%]?$")
    dense = F.filter(rows, lambda r: F.size(F.filter(r, numeric)) >= 2)
    wide = F.greatest(F.size(headers), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    early = F.exists(F.slice(rows, 1, 6), lambda r: F.exists(r, bare))
    return (wide >= 3) & (F.exists(headers, bare) | ((wide >= 4) & (F.size(dense) >= 0.25 * F.size(rows))) | (early & (F.size(dense) >= 2)))


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, page, width, x0, x1, y) in two-column order where a page has two columns: six or
    more narrow lines, a fifth of them on each side, the sides' centres a quarter of the width apart."""
    w = Window.partitionBy("doc_id", "page")
    centre, narrow = (F.col("x0") + F.col("x1")) / 2, (F.col("x1") - F.col("x0")) < 0.6 * F.col("width")
    left = narrow & (centre < F.col("width") / 2)
    right = narrow & ~left
    n = F.count_if(narrow).over(w)
    gap = F.avg(F.when(right, centre)).over(w) - F.avg(F.when(left, centre)).over(w)
    two = (n >= 6) & (F.count_if(left).over(w) >= 0.2 * n) & (F.count_if(right).over(w) >= 0.2 * n) & (gap >= 0.25 * F.col("width"))
    side = F.when(F.coalesce(two, F.lit(False)) & right, 1).otherwise(0)
    return blocks.withColumn("position", F.row_number().over(w.orderBy(side, "y", "x0")))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    wide = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    high = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    both = wide * high
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words (doc_id, page, x0, y0, x1, y1) that no table box of their page holds."""
    t = tables.select("doc_id", "page", *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    held = [words["doc_id"] == t["doc_id"], words["page"] == t["page"], words["x0"] >= t["_x0"], words["x1"] <= t["_x1"], words["y0"] >= t["_y0"], words["y1"] <= t["_y1"]]
    return words.join(t, held, "left_anti")


def cells_from_words(words: DataFrame, bands: DataFrame) -> DataFrame:
    """(doc_id, page, row, col, text): each word, whole, in the cell that holds its centre."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w = words.select("doc_id", "page", "text", x.alias("_x"), y.alias("_y"))
    inside = (F.col("_x") >= F.col("left")) & (F.col("_x") < F.col("right")) & (F.col("_y") >= F.col("top")) & (F.col("_y") < F.col("bottom"))
    found = w.join(bands, ["doc_id", "page"]).where(inside).groupBy("doc_id", "page", "row", "col").agg(F.array_sort(F.collect_list(F.struct("_y", "_x", "text"))).alias("_w"))
    return found.select("doc_id", "page", "row", "col", F.array_join(F.transform("_w", lambda v: v["text"]), " ").alias("text"))


def elements(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, order, kind, text): a page's text, if there is any, then its tables (doc_id, page, table_no, cells)."""
    t = pages.where(F.coalesce("text", F.lit("")) != "").select("doc_id", "page", F.lit(0).alias("_k"), F.lit(0).alias("_n"), F.lit("text").alias("kind"), "text")
    c = tables.select("doc_id", "page", F.lit(1).alias("_k"), F.col("table_no").alias("_n"), F.lit("table").alias("kind"), table_text(F.col("cells")).alias("text"))
    w = Window.partitionBy("doc_id", "page").orderBy("_k", "_n")
    return t.unionByName(c).withColumn("order", F.row_number().over(w) - 1).drop("_k", "_n")


def synced(given: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Elements (doc_id, page, order, kind, text) in line with cleaned pages and tables: a page's only text element has the page's
    text, one of several is normalised by itself; the nth table element has the nth table's text."""
    w = Window.partitionBy("doc_id", "page", F.col("kind") == "table")
    e = given.withColumns({"_many": F.count("*").over(w), "_n": F.row_number().over(w.orderBy("order"))})
    e = e.join(pages.select("doc_id", "page", F.col("text").alias("_page")), ["doc_id", "page"], "left")
    t = tables.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("table_no"))).select("doc_id", "page", "_n", table_text(F.col("cells")).alias("_table"))
    e = e.join(t, ["doc_id", "page", "_n"], "left")
    text = F.when(F.col("kind") == "table", F.coalesce("_table", "text")).when(F.col("_many") == 1, F.col("_page")).otherwise(T.collapse(F.col("text")))
    return e.select("doc_id", "page", "order", "kind", text.alias("text"))


def page_text(body: Column, tables: Column) -> Column:
    """A page's body and, after it, its rendered tables: each once, without those that are a block of the body."""
    blocks = F.split(F.coalesce(body, F.lit("")), "\n[\\t\\x0B\\f\\r ]*\n")
    more = F.array_except(F.array_distinct(F.filter(tables, lambda t: t != "")), blocks)
    return F.array_join(F.concat(F.filter(F.array(body), lambda b: F.coalesce(b, F.lit("")) != ""), more), "\n\n")


def recovered(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """pages (doc_id, page, text, scanned) with ``text`` and ``recovered``: damaged and scanned pages have what was recognised
    (doc_id, page, text), provided that it is there and whole for all such pages of the document; else no page is changed."""
    r = recognised.select("doc_id", "page", F.col("text").alias("_new"))
    p = pages.withColumn("_ask", F.coalesce("scanned", F.lit(False)) | F.coalesce(T.damaged(F.col("text")), F.lit(False))).join(r, ["doc_id", "page"], "left")
    good = F.coalesce((T.strip(F.col("_new")) != "") & ~T.damaged(F.col("_new")), F.lit(False))
    able = p.groupBy("doc_id").agg(F.bool_and(~F.col("_ask") | good).alias("_able"))
    done = F.col("_ask") & F.col("_able")
    return p.join(able, "doc_id").select("doc_id", "page", F.when(done, F.col("_new")).otherwise(F.col("text")).alias("text"), done.alias("recovered"))


def repaired_splits(rows: DataFrame) -> DataFrame:
    """rows (cells array of {text, x1}, top, bottom, words array of {text, x0, x1, top, bottom}) with ``texts``: the two halves
    of a number that a column line cuts are one again, where exactly one word of the row lies across the line and reads
    as both; the second cell is then empty.  A word of another row (under 30% of its height within this one) doesn't count."""
    bare = lambda t: F.replace(t, F.lit(","), F.lit(""))

    def across(left: Column, right: Column) -> Column:
        """Words that the line between two cells cuts and that read as both."""
        shown, more = F.regexp_replace(F.trim(left["text"]), "^[$]", ""), F.trim(right["text"])
        able = shown.rlike("^[0-9]{1,3}(,[0-9]{1,3})*$") & more.rlike("^[0-9]+$")
        overlap = lambda w: F.least(w["bottom"], F.col("bottom")) - F.greatest(w["top"], F.col("top"))
        cut = lambda w: (bare(w["text"]) == bare(F.concat(shown, more))) & (w["x0"] < left["x1"] - 0.5) & (w["x1"] > left["x1"] + 0.5)
        same_row = lambda w: (overlap(w) > 0) & (overlap(w) >= 0.3 * (w["bottom"] - w["top"]))
        none = F.slice(F.col("words"), 1, 0)
        return F.when(able, F.filter("words", lambda w: cut(w) & same_row(w))).otherwise(none)

    found = F.transform("cells", lambda c, i: F.when(i < F.size("cells") - 1, across(c, F.get("cells", i + 1))))
    r = rows.withColumn("_w", F.transform(found, lambda ws: F.when(F.size(ws) == 1, F.get(ws, F.lit(0))["text"])))
    # of three cells in a row the first two go together
    start = F.struct(F.lit(False).alias("last"), F.array().cast("array<boolean>").alias("of"))
    takes = F.aggregate("_w", start, lambda a, w: F.struct((w.isNotNull() & ~a["last"]).alias("last"), F.concat(a["of"], F.array(w.isNotNull() & ~a["last"])).alias("of")), lambda a: a["of"])
    r = r.withColumn("_t", takes)
    text = lambda c, i: F.when(F.get("_t", i), F.get("_w", i)).when(F.coalesce(F.get("_t", i - 1), F.lit(False)), "").otherwise(c["text"])
    return r.withColumn("texts", F.transform("cells", text)).drop("_w", "_t")
