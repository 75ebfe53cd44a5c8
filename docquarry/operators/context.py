"""Context for answers: compression of blocks and packing under a budget.

Blocks: qid, chunk_id, rank, content.  A question has few blocks (a route's k), so its blocks are folded as
one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T

BLOCK, TOTAL, LEAST = 1600, 12000, 400


def block_budget(blocks: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(BLOCK), F.floor(F.lit(TOTAL) / F.greatest(blocks, F.lit(1)))))


def compressed(blocks: DataFrame) -> DataFrame:
    """blocks (with question) cut to each block's share of the budget: sentences or table lines by score
    (shared pairs of characters, and four for each exact word or number), the best until the budget is
    full (the last one taken is cut), in source order.  Tables keep their head line.  Content within the budget stays as it is."""
    n = F.count("*").over(Window.partitionBy("qid"))
    b = blocks.withColumn("_budget", block_budget(n))
    table = F.col("content").contains(" | ")
    units = F.when(table, F.split("content", "\n")).otherwise(T.sentences(F.col("content")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9.%]{2,}"), F.lit(0)))
    b = b.withColumns({"_u": units, "_table": table, "_pairs": T.bigrams(F.col("question")), "_words": words})
    scored = F.transform("_u", lambda u, i: F.struct((-(F.size(F.array_intersect(T.bigrams(u), F.col("_pairs"))) + 4 * F.size(F.filter("_words", lambda w: F.contains(F.lower(u), w))))).alias("score"), i.alias("i"), u.alias("u")))
    b = b.withColumn("_s", F.array_sort(scored))
    head = F.when(F.col("_table"), F.length(F.get("_u", F.lit(0)))).otherwise(0)
    first = F.filter(F.array(F.struct(F.lit(0).alias("i"), F.least(head, F.col("_budget").cast("int")).alias("n"))), lambda x: F.col("_table"))
    start = F.struct(head.cast("bigint").alias("used"), first.alias("of"))

    def step(a: Column, x: Column) -> Column:
        room = (F.col("_budget") - a["used"] - 1).cast("int")
        out = (room <= 0) | (F.col("_table") & (x["i"] == 0))
        part = F.struct(x["i"].alias("i"), F.least(F.length(x["u"]), room).alias("n"))
        return F.when(out, a).otherwise(F.struct((a["used"] + part["n"] + 1).cast("bigint").alias("used"), F.concat(a["of"], F.array(part)).alias("of")))

    b = b.withColumn("_t", F.array_sort(F.aggregate("_s", start, step, lambda a: a["of"])))
    text = F.array_join(F.transform("_t", lambda x: F.substr(F.get("_u", x["i"]), F.lit(1), x["n"])), "\n")
    return b.withColumn("content", F.when(F.length("content") <= F.col("_budget"), F.col("content")).otherwise(text)).drop("_budget", "_u", "_table", "_pairs", "_words", "_s", "_t")


def packed(blocks: DataFrame, budget: int = TOTAL, overhead: int = 40) -> DataFrame:
    """Whole blocks in rank order as long as they fit; a block that doesn't is left out and smaller ones
    after it may still come in."""
    lists = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.length("content").alias("chars")))).alias("_b"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.slice("_b", 1, 0).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        need = a["used"] + x["chars"] + overhead
        return F.when(need <= budget, F.struct(need.cast("bigint").alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)

    kept = lists.select("qid", F.explode(F.aggregate("_b", start, step, lambda a: a["kept"])).alias("_k")).select("qid", "_k.chunk_id")
    return blocks.join(kept, ["qid", "chunk_id"], "left_semi")


#: Any white space, of any script.
_BLANK = "(?U)\\s"
#: Lengths of a child's beginning, in characters without white space, that are looked for one after another.
ANCHOR_LENGTHS = (64, 40, 24, 16, 12, 8)


def anchor(parent: Column, child: Column) -> Column:
    """Struct {marked, start, end}: the first place in a parent's text of the longest beginning of its child (of 64 to 8
    characters, or all of a shorter child), white space aside on both sides, and the parent with that place between
    <hit> tags.  start and end are 0, and the text is unmarked, where there is none or where either has no text."""
    bare, head = F.regexp_replace(parent, _BLANK, ""), F.regexp_replace(child, _BLANK, "")
    n = F.length(head)
    lengths = F.array(F.least(F.lit(ANCHOR_LENGTHS[0]), n), *(F.when(n > k, F.lit(k)) for k in ANCHOR_LENGTHS[1:]))
    both = F.struct(bare.alias("bare"), head.alias("head"), F.filter(lengths, lambda k: k > 0).alias("lengths"))

    def place(x: Column) -> Column:
        held = F.filter(x["lengths"], lambda k: F.contains(x["bare"], F.substr(x["head"], F.lit(1), k)))
        longest = F.get(held, F.lit(0))
        return F.when(longest.isNotNull(), F.struct(F.instr(x["bare"], F.substr(x["head"], F.lit(1), longest)).alias("at"), longest.alias("n")))

    # the places of characters that aren't white space, in the parent as it stands
    letters = F.filter(F.split(parent, ""), lambda c: c != "")
    offsets = T.bound(letters, lambda own: F.filter(F.transform(own, lambda c, i: F.when(~c.rlike(_BLANK), i)), lambda i: i.isNotNull()))

    def marked(x: Column) -> Column:
        span = x["span"]
        start, end = F.get(x["offsets"], span["at"] - 1), F.get(x["offsets"], span["at"] + span["n"] - 2) + 1
        cut = lambda a, b: F.substr(parent, a + 1, b - a)
        text = F.concat(cut(F.lit(0), start), F.lit("<hit>"), cut(start, end), F.lit("</hit>"), cut(end, F.length(parent)))
        return F.struct(text.alias("marked"), start.alias("start"), end.alias("end"))

    span = T.bound(both, place)
    none = F.struct(F.coalesce(parent, F.lit("")).alias("marked"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    found = T.bound(F.struct(span.alias("span"), F.when(span.isNotNull(), offsets).alias("offsets")), marked)
    return F.when(span.isNotNull(), found).otherwise(none)


def anchored(parent: Column, child: Column) -> Column:
    """The parent's text with the place of its child marked."""
    return anchor(parent, child)["marked"]


def around_anchor(text: Column, start: Column, end: Column, most: int) -> Column:
    """A text of more than ``most`` tokens cut to its beginning (at most 160 characters, up to the anchor), a quarter of
    ``most`` characters before the anchor and half of it after; what is still too long loses its end, at most half."""
    head = F.substr(text, F.lit(1), F.least(start, F.lit(160)))
    before, after = F.least(start, F.lit(most // 4)), F.least(F.length(text) - end, F.lit(most // 2))
    window = F.concat(head, F.lit("…"), F.substr(text, start - before + 1, end + after - start + before))
    tokens = T.token_count(window)
    share = F.greatest(F.lit(0.5), F.least(F.lit(1.0), F.lit(float(most)) / tokens))
    cut = F.substr(window, F.lit(1), F.floor(F.length(window) * share).cast("int"))
    return F.when(T.token_count(text) <= most, text).when(tokens <= most, window).otherwise(cut)


def _folded(blocks: DataFrame, budget: int, overhead: int, citation: int) -> DataFrame:
    """(qid, _b, _all): each question's blocks in rank order, ``in`` where ``packed`` takes them, and what is there after
    citations, as arrays.  The blocks travel once: joins of texts would be broadcast by what they take when compressed.  Each
    step is bound to its value, as Spark puts the expression of a column into the lambdas that mention it."""
    own = F.struct("rank", "chunk_id", "doc_id", "parent_id", "kind", "content")
    lists = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(own)).alias("_b"))
    need = lambda a, x: a["used"] + F.length(x["content"]) + overhead

    def packed_ids(b: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("used"), F.transform(F.slice(b, 1, 0), lambda x: x["chunk_id"]).alias("ids"))
        take = lambda a, x: F.when(need(a, x) <= budget, F.struct(need(a, x).alias("used"), F.concat(a["ids"], F.array(x["chunk_id"])).alias("ids"))).otherwise(a)
        return F.aggregate(b, start, take, lambda a: a["ids"])

    there = lambda x, ids: F.coalesce(F.array_contains(ids, x["chunk_id"]) & F.col("qid").isNotNull(), F.lit(False))
    marked = lambda b: T.bound(packed_ids(b), lambda ids: F.transform(b, lambda x: x.withField("in", there(x, ids))))
    times = lambda whole, part: (F.length(whole) - F.length(F.replace(whole, part, F.lit("")))) / F.length(part)
    holds = lambda p, c: F.coalesce((p["kind"] == "section") & (c["kind"] != "section") & (p["chunk_id"] == c["parent_id"]) & (p["doc_id"] == c["doc_id"]) & (F.length(c["content"]) > 0) & (times(p["content"], c["content"]) == 1), F.lit(False))
    citation_of = lambda p, c: F.struct(c["chunk_id"].alias("chunk_id"), (F.instr(p["content"], c["content"]) - 1).alias("start"), F.length(c["content"]).alias("length"))
    entry = lambda x, gone, contained: F.struct(x["chunk_id"].alias("chunk_id"), F.length(x["content"]).alias("chars"), gone.alias("gone"), contained.alias("contained"))
    cited = lambda b: F.transform(b, lambda p: entry(p, F.exists(b, lambda q: holds(q, p)), F.transform(F.filter(b, lambda c: holds(p, c)), lambda c: citation_of(p, c))))
    used = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x["chars"] + overhead + F.size(x["contained"]) * citation)
    uncited = lambda c: F.transform(c, lambda x: x.withField("gone", F.lit(False)).withField("contained", F.slice(x["contained"], 1, 0)))

    def all_of(b: Column, c: Column) -> Column:
        none = F.slice(F.get(c, F.lit(0))["contained"], 1, 0)
        refill = lambda a, x: F.when(~x["in"] & (F.length(x["content"]) > 0) & (need(a, x) <= budget), F.struct(need(a, x).alias("used"), F.concat(a["of"], F.array(entry(x, F.lit(False), none))).alias("of"))).otherwise(a)
        filled = lambda k: F.when(F.size(k) > 0, F.aggregate(b, F.struct(used(k).alias("used"), k.alias("of")), refill, lambda a: a["of"])).otherwise(k)
        return T.bound(F.filter(c, lambda x: ~x["gone"]), lambda k: T.bound(F.when(used(k) <= budget, k).otherwise(uncited(c)), filled))

    lists = lists.withColumn("_b", T.bound(F.col("_b"), marked))
    folded = T.bound(F.col("_b"), lambda b: T.bound(F.filter(b, lambda x: x["in"]), lambda own: T.bound(cited(own), lambda c: all_of(b, c))))
    return lists.select("qid", "_b", folded.alias("_all"))


def deduplicated(blocks: DataFrame, budget: int = TOTAL, overhead: int = 40, citation: int = 24) -> DataFrame:
    """(qid, chunk_id, position, contained array<{chunk_id, start, length}>) of blocks (qid, chunk_id, doc_id, parent_id, kind,
    rank, content): packed in rank order; then a child whose section is there too and holds it exactly once becomes
    a citation of the section, and blocks that were left out come in where there is room.  Where the citations
    themselves would not fit, the packed blocks stay as they were."""
    lists = _folded(blocks, budget, overhead, citation)
    return lists.select("qid", F.posexplode("_all").alias("position", "x")).select("qid", "x.chunk_id", (F.col("position") + 1).alias("position"), "x.contained")


def narrative(pieces: DataFrame, budget: int) -> DataFrame:
    """pieces (qid, chunk_id, question, leaf, parent) with ``content`` and ``spans`` {origin, start, end}: whole sentences of leaf and
    parent by score (shared pairs of characters, and four for each exact word), as many as the budget takes, each
    once, in the order of their sources.  A sentence over the budget is left out, never cut."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9.%]{2,}"), F.lit(0)))
    p = pieces.withColumns({"_pairs": T.bigrams(F.col("question")), "_words": words})

    def sentences(text: Column, origin: str) -> Column:
        raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s).+?(?:[.!?。！？](?=[\\t\\n\\x0B\\f\\r ]|$)|\\z)"), F.lit(0))
        at = lambda rs, i: F.aggregate(F.slice(rs, 1, i), F.lit(0), lambda a, r: a + F.length(r))
        lead = lambda r: F.length(r) - F.length(F.regexp_replace(r, f"^{T.WS}+", ""))
        return T.bound(raw, lambda rs: F.transform(rs, lambda r, i: F.struct(F.lit(origin).alias("origin"), (at(rs, i) + lead(r)).alias("start"), T.strip(r).alias("text"))))

    p = p.withColumn("_s", F.filter(F.concat(sentences(F.col("leaf"), "content"), sentences(F.col("parent"), "parent_content")), lambda s: (F.length(s["text"]) > 0) & (F.length(s["text"]) <= budget)))
    key = lambda s: F.regexp_replace(s["text"], f"{T.WS}+", "")
    first = F.filter("_s", lambda s, i: ~F.exists(F.slice("_s", 1, i), lambda o: key(o) == key(s)))
    p = p.withColumn("_s", first)
    score = lambda s: F.size(F.array_intersect(T.bigrams(s["text"]), F.col("_pairs"))) + 4 * F.size(F.filter("_words", lambda w: F.contains(F.lower(s["text"]), w)))
    p = p.withColumn("_s", F.array_sort(F.transform("_s", lambda s: F.struct((-score(s)).alias("order"), s["origin"].alias("origin"), s["start"].alias("start"), s["text"].alias("text")))))
    start = F.struct(F.lit(0).alias("used"), F.slice("_s", 1, 0).alias("of"))
    cost = lambda a, s: F.length(s["text"]) + (F.size(a["of"]) > 0).cast("int")
    take = lambda a, s: F.when(a["used"] + cost(a, s) <= budget, F.struct((a["used"] + cost(a, s)).alias("used"), F.concat(a["of"], F.array(s)).alias("of"))).otherwise(a)
    chosen = F.aggregate("_s", start, take, lambda a: F.array_sort(F.transform(a["of"], lambda s: F.struct(s["origin"].alias("origin"), s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text")))))
    p = p.withColumn("_k", chosen)
    return p.withColumn("content", F.array_join(F.transform("_k", lambda s: s["text"]), "\n")).withColumn("spans", F.transform("_k", lambda s: s.dropFields("text"))).drop("_pairs", "_words", "_s", "_k")


def source_safe(blocks: DataFrame, budget: int = TOTAL, overhead: int = 40) -> DataFrame:
    """(qid, chunk_id, position, path): blocks under a neutral path, as a page's inferred title proves nothing of its parts, packed
    and deduplicated; of the others those come in that neither hold nor are held by one that is there."""
    lists = _folded(blocks, budget, overhead, 24)
    kept = F.filter("_b", lambda y: F.exists("_all", lambda a: a["chunk_id"] == y["chunk_id"]))
    clash = lambda k, y: F.exists(k, lambda z: F.coalesce((z["chunk_id"] != y["chunk_id"]) & (F.contains(y["content"], z["content"]) | F.contains(z["content"], y["content"])), F.lit(False)))
    ids = T.bound(kept, lambda k: F.transform(F.filter(k, lambda y: y["in"] | ~clash(k, y)), lambda y: y["chunk_id"]))
    out = T.bound(ids, lambda own: F.filter(F.transform("_all", lambda a: a["chunk_id"]), lambda c: F.array_contains(own, c)))
    return lists.select("qid", F.posexplode(out).alias("position", "chunk_id")).select("qid", "chunk_id", (F.col("position") + 1).alias("position"), F.lit("原文").alias("path"))
