"""Sections and small-to-big chunks.

Greedy packing depends on what came before, so it is a fold over a document's ordered lines
(``aggregate``), all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T
from docquarry.functions import vectors

TARGET, MOST, PARENT, TABLE, OVERLAP_CHARS = 200, 256, 3072, 2048, 80


def section_tree(lines: DataFrame) -> DataFrame:
    """(doc_id, seq, page, level, title, path) of (doc_id, page, n, line): a heading ends the sections of
    its level and below.  Documents without a heading are one section."""
    heads = lines.withColumn("level", T.heading_level(F.col("line"))).where("level IS NOT NULL")
    each = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "n", "level", T.strip(F.col("line")).alias("title")))).alias("_h"))
    start = F.struct(F.expr("CAST(array() AS array<struct<level:int,title:string>>)").alias("stack"), F.expr("CAST(array() AS array<struct<page:int,level:int,title:string,path:string>>)").alias("out"))

    def step(a: Column, h: Column) -> Column:
        above = F.concat(F.filter(a["stack"], lambda s: s["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        path = F.array_join(F.transform(above, lambda s: s["title"]), " > ")
        return F.struct(above.alias("stack"), F.concat(a["out"], F.array(F.struct(h["page"].cast("int").alias("page"), h["level"].alias("level"), h["title"].alias("title"), path.alias("path")))).alias("out"))

    found = each.select("doc_id", F.posexplode(F.aggregate("_h", start, step, lambda a: a["out"])).alias("seq", "s")).select("doc_id", "seq", "s.*")
    none = lines.select("doc_id").distinct().join(found.select("doc_id").distinct(), "doc_id", "left_anti")
    return found.unionByName(none.select("doc_id", F.lit(0).alias("seq"), F.lit(1).alias("page"), F.lit(1).alias("level"), F.lit("文档正文").alias("title"), F.lit("文档正文").alias("path")))


def packed(lines: Column, target: int = TARGET, overlap: int = OVERLAP_CHARS) -> Column:
    """Chunks of an array of lines: lines are gathered until another would exceed the target; the next
    chunk begins with the end of the last one.

    A fold carries the size of what is gathered and its end, and notes where chunks begin, so the work is linear in
    the lines; the chunks are then cut from the array."""
    mark = lambda at, head: F.struct(at.alias("at"), head.alias("head"))
    start = F.struct(F.lit(0).alias("han"), F.lit(0).alias("chars"), F.lit("").alias("tail"), F.lit(0).alias("n"), F.array().cast("array<struct<at:int,head:string>>").alias("out"))
    tokens = lambda h, c: h + F.greatest(F.lit(1), F.floor((c - h) / 4).cast("int"))

    def step(a: Column, x: Column) -> Column:
        h, c = a["han"] + x["han"], a["chars"] + 1 + x["chars"]
        first, full = a["chars"] == 0, (a["chars"] > 0) & (tokens(h, c) > target)
        joined = F.when(first, x["line"]).otherwise(F.concat(a["tail"], F.lit("\n"), x["line"]))
        begun = F.when(first, F.concat(a["out"], F.array(mark(a["n"], F.lit(None).cast("string"))))).when(full, F.concat(a["out"], F.array(mark(a["n"], a["tail"])))).otherwise(a["out"])
        return F.struct(
            F.when(first, x["han"]).when(full, T.han_count(a["tail"]) + x["han"]).otherwise(h).alias("han"),
            F.when(first, x["chars"]).when(full, F.length(a["tail"]) + 1 + x["chars"]).otherwise(c).alias("chars"),
            F.right(joined, F.lit(overlap)).alias("tail"),
            (a["n"] + 1).alias("n"),
            begun.alias("out"),
        )

    counted = lambda own: F.transform(own, lambda line: F.struct(line.alias("line"), T.han_count(line).alias("han"), F.length(line).alias("chars")))

    def cut(own: Column) -> Column:
        marks = F.aggregate(counted(own), start, step, lambda a: a["out"])
        body = lambda ms, m, i: F.array_join(F.slice(own, m["at"] + 1, F.coalesce(F.get(ms, i + 1)["at"], F.size(own)) - m["at"]), "\n")
        return T.bound(marks, lambda ms: F.transform(ms, lambda m, i: F.concat(F.coalesce(F.concat(m["head"], F.lit("\n")), F.lit("")), body(ms, m, i))))

    return T.bound(lines, cut)


def content_lines(text: Column) -> Column:
    """The lines of a text that say something; long ones cut into sentences, longer sentences hard."""
    kept = F.filter(F.transform(F.split(text, "\n"), T.strip), lambda s: ~T.says_nothing(s))
    cut = F.flatten(F.transform(kept, lambda s: F.when(T.token_count(s) > MOST, T.sentences(s)).otherwise(F.array(s))))
    return F.flatten(F.transform(cut, lambda s: F.when(T.token_count(s) > MOST, T.hard_pieces(s, MOST * 4)).otherwise(F.array(s))))


def leaves(pages: DataFrame) -> DataFrame:
    """(doc_id, seq, page, content, tokens) of (doc_id, page, text)."""
    found = pages.withColumn("_l", content_lines(F.coalesce("text", F.lit("")))).select("doc_id", "page", F.posexplode(packed(F.col("_l"))).alias("_n", "content"))
    w = Window.partitionBy("doc_id").orderBy("page", "_n")
    return found.select("doc_id", (F.row_number().over(w) - 1).alias("seq"), "page", "content", T.token_count(F.col("content")).alias("tokens"))


def table_chunks(tables: DataFrame, most: int = TABLE, rows_a_piece: int = 20) -> DataFrame:
    """(doc_id, page, kind, n, content) of (doc_id, page, headers, rows): small tables whole; large ones as
    a summary (head, two rows, size) and pieces that repeat the head."""
    head = F.array_join("headers", " | ")
    body = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n")
    whole = F.concat_ws("\n", head, body(F.col("rows")))
    size = F.format_string("[%d rows, %d columns]", F.size("rows"), F.size("headers"))
    summary = F.concat_ws("\n", head, body(F.slice("rows", 1, 2)), size)
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("rows") - 1) / rows_a_piece).cast("int"), F.lit(0)))
    pieces = F.transform(starts, lambda i: F.struct(F.lit("table").alias("kind"), F.concat_ws("\n", head, body(F.slice("rows", i * rows_a_piece + 1, rows_a_piece))).alias("content")))
    parts = F.when(T.token_count(whole) <= most, F.array(F.struct(F.lit("table").alias("kind"), whole.alias("content")))).otherwise(F.concat(F.array(F.struct(F.lit("summary").alias("kind"), summary.alias("content"))), pieces))
    return tables.select("doc_id", "page", F.posexplode(parts).alias("n", "p")).select("doc_id", "page", "n", "p.*")


def runs(rows: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """rows with ``run``: numbers of stretches of equal values in order (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def parents(leaf_rows: DataFrame, most: int = PARENT) -> DataFrame:
    """(doc_id, run, parent, path, page, seqs, content): leaves (with path) of a section joined, up to so
    many tokens."""
    by_run = runs(leaf_rows, "doc_id", ["seq"], "path").groupBy("doc_id", "run", "path").agg(F.array_sort(F.collect_list(F.struct("seq", "page", "tokens", "content"))).alias("_l"))
    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("of"))

    def step(a: Column, x: Column) -> Column:
        full = (a["tokens"] > 0) & (a["tokens"] + x["tokens"] > most)
        n = a["n"] + full.cast("int")
        return F.struct(F.when(full, x["tokens"]).otherwise(a["tokens"] + x["tokens"]).alias("tokens"), n.alias("n"), F.concat(a["of"], F.array(n)).alias("of"))

    placed = by_run.select("doc_id", "run", "path", F.explode(F.arrays_zip(F.col("_l").alias("leaf"), F.aggregate("_l", start, step, lambda a: a["of"]).alias("parent"))).alias("z"), F.get("_l", F.lit(0))["page"].alias("page"))
    group = placed.groupBy("doc_id", "run", "path", "page", F.col("z.parent").alias("parent")).agg(F.array_sort(F.collect_list("z.leaf")).alias("_l"))
    return group.select("doc_id", "run", "parent", "path", "page", F.transform("_l", lambda x: x["seq"]).alias("seqs"), F.array_join(F.transform("_l", lambda x: x["content"]), "\n\n").alias("content"))


def embedding_text(chunks: DataFrame) -> DataFrame:
    """chunks with what is embedded: tables and sections get their title and path in front."""
    return chunks.withColumn("embedding_text", F.when(F.col("kind").isin("table", "section"), F.concat(F.concat_ws(" | ", "title", "path"), F.lit("\n"), F.col("content"))).otherwise(F.col("content")))


def refined(sentences: DataFrame, similar: float = 0.5, least_tokens: int = 128) -> DataFrame:
    """(chunk_id, part, content): sentences (chunk_id, n, sentence, vector) cut where neighbours differ and
    enough has been gathered."""
    w = Window.partitionBy("chunk_id").orderBy("n")
    near = sentences.withColumn("_s", vectors.cosine(F.lag("vector").over(w), F.col("vector"))).withColumn("_t", T.token_count(F.col("sentence")))
    rows = near.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("n", "sentence", "_s", "_t"))).alias("_r"))
    start = F.struct(F.lit(0).alias("tokens"), F.lit(0).alias("part"), F.array().cast("array<int>").alias("of"))

    def step(a: Column, x: Column) -> Column:
        cut = (a["tokens"] >= least_tokens) & (x["_s"] < similar)
        part = a["part"] + cut.cast("int")
        return F.struct(F.when(cut, x["_t"]).otherwise(a["tokens"] + x["_t"]).alias("tokens"), part.alias("part"), F.concat(a["of"], F.array(part)).alias("of"))

    each = rows.select("chunk_id", F.explode(F.arrays_zip(F.col("_r").alias("r"), F.aggregate("_r", start, step, lambda a: a["of"]).alias("part"))).alias("z"))
    out = each.groupBy("chunk_id", F.col("z.part").alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("z.r.n").alias("n"), F.col("z.r.sentence").alias("s")))).alias("_l"))
    return out.select("chunk_id", "part", F.array_join(F.transform("_l", lambda x: x["s"]), "").alias("content"))


def composed(parent_rows: DataFrame, leaf_rows: DataFrame) -> DataFrame:
    """Parents, then leaves, with their place among the document's chunks.  Both: doc_id, chunk_id, parent_id, seq,
    content."""
    both = parent_rows.withColumn("kind", F.lit("section")).unionByName(leaf_rows.withColumn("kind", F.lit("leaf")))
    w = Window.partitionBy("doc_id").orderBy(F.col("kind") == "leaf", "seq", "chunk_id")
    return both.withColumn("place", F.row_number().over(w))


def with_summaries(chunks: DataFrame, summaries: DataFrame, overviews: DataFrame) -> DataFrame:
    """chunks (doc_id, chunk_id, parent_id, page, path, kind, content) with those of summaries: of a section (doc_id,
    parent_id, text) under that section, of which it has page and path, none without a section; of a document (doc_id,
    text) without a parent.  Empty texts give none."""
    above = chunks.where("kind = 'section'").select("doc_id", F.col("chunk_id").alias("parent_id"), "page", "path")
    own = summaries.where("text <> ''").join(above, ["doc_id", "parent_id"])
    whole = overviews.where("text <> ''").select("doc_id", F.lit(None).cast(chunks.schema["parent_id"].dataType).alias("parent_id"), "text", F.lit(1).alias("page"), F.lit("文档综述").alias("path"))
    name = F.concat_ws(":", F.lit("summary"), F.col("doc_id").cast("string"), F.coalesce(F.col("parent_id").cast("string"), F.lit("all")))
    new = own.select("doc_id", "parent_id", "text", "page", "path").unionByName(whole)
    new = new.select("doc_id", name.alias("chunk_id"), "parent_id", "page", "path", F.lit("summary").alias("kind"), F.col("text").alias("content"))
    return chunks.select(*new.columns).unionByName(new)
