"""The queries of this subpackage, each a thin cut of its operator's output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, filter_audit, license_scan, media, mixture, periodic_runs, quality_classifier, quality_rules, rollups, sharding, simhash, site_tree, vector_links
from docquarry.llm.common import n_words, shared_dir, table, utf8_bytes, words, written


def rank_file() -> tuple[bytes, str]:
    """Rank bytes and pattern of the tokenizer of the contract."""
    import public_tokenizers

    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", media.stored(F.col("text")).alias("media"))
    got = docs.withColumn("image", media.image(F.col("media")))
    means = [F.round(F.col("image.mean")[i], 3).cast("string") for i in range(3)]
    return got.select(
        "doc_id",
        F.col("image.n_bytes").alias("n_bytes"),
        F.octet_length("image.payload").cast("long").alias("payload_bytes"),
        F.sha2("image.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("image.payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(" ", F.concat_ws("x", "image.height", "image.width", F.lit("3")), *means, F.hex(F.crc32("image.rgb"))).alias("feature"),
    )


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in training order, by the first copy of each; those that the mix doesn't take come last."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), mixture.order_key("doc_id", F.coalesce("text", F.lit(""))).alias("order_key"))
    got = mixture.in_training_order(mixture.mixed(written(sized, "mixture-sizes")), whole=True, ties=("order_key", "doc_id"))
    first = F.get("mix.positions", F.lit(0))
    return got.where(F.col("position").eqNullSafe(first)).select("doc_id", "size", "mix.source_size", F.round("mix.target", 6).alias("target"), "mix.taken", "mix.copies", F.round(first, 6).alias("first_position"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CAST([3, 1, 2][(rk - 1) % 3 + 1] AS DOUBLE) AS w, CAST([0.5, 1.0, 1.5][(rk - 1) % 3 + 1] AS DOUBLE) AS a, CAST(2 * ss AS DOUBLE) AS cap FROM r),
l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(ss) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (SELECT source, ss, a, least(cap, w * max(level) OVER ()) AS target FROM l),
c AS (
  SELECT d.*, ss, a, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS passes FROM c),
n AS (SELECT *, CAST(passes + CASE WHEN middle < target - passes * ss THEN 1 ELSE 0 END AS INT) AS copies,
             least(1.0, CASE WHEN target > 0 THEN middle / target ELSE 0 END) AS used FROM p)
SELECT doc_id, size, ss AS source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken, copies,
       round(CASE WHEN copies > 0 THEN CASE WHEN a = 1 THEN used ELSE (sqrt(a * a + 4 * (1 - a) * used) - a) / (2 * (1 - a)) END END, 6) AS first_position
FROM n
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality_rules.judged(docs, keep=["doc_id"]).select("doc_id", "verdict.*")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality rules measure of each text, without their verdict."""
    got = quality_rules.measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", *(F.col(f"_m.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words")))


MEASURES_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) AS g FROM w WHERE len(w) > 2),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM x) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY 1),
lines AS (SELECT doc_id, [l for l in string_split(t, chr(10)) if regexp_matches(l, '[^\\x20\\x09-\\x0D]')] AS l FROM w)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct_words
FROM w JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
"""


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = quality_classifier.classify(docs, table(spark, sf_dir, "labels"))
    return got.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = site_tree.extracted(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches over all documents, two of them applied twice: counts by two tokenizers; the second's
    counts revised; the first's counts of exact copies deleted."""
    docs = table(spark, sf_dir, "documents")
    runs = F.coalesce(F.regexp_count("text", F.lit("[A-Za-z0-9]+")), F.lit(0)).cast("long")
    base = written(docs.select("doc_id", "source", "lang", n_words(F.col("text")).alias("words"), runs.alias("runs"), sharding.group_key(F.col("text")).alias("key")), "rollup-counts")
    # written, so that the join below is one that Spark may split where a text has very many copies
    first = written(base.groupBy("key").agg(F.min("doc_id").alias("first")), "rollup-first")
    copies = base.join(first, "key").where("doc_id <> first")

    def changes(rows: DataFrame, change: str, tokenizer: str, n: str, old: str | None = None) -> DataFrame:
        return rows.select(F.lit(change).alias("change"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))

    store = rollups.Store(spark, f"{shared_dir(spark)}/docquarry/rollups-{uuid.uuid4().hex}")
    batches = {
        "1-words": changes(base, "insert", "words-1", "words"),
        "2-runs": changes(base, "insert", "runs-1", "runs"),
        "3-runs-revised": changes(base, "revise", "runs-1", "words", "runs"),
        "4-copies": changes(copies, "delete", "words-1", "words"),
    }
    for name in (*batches, "1-words", "4-copies"):
        store.apply(name, batches[name])
    return store.totals()


OP6_SQL = """
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS nth
  FROM documents)
SELECT * FROM (
  SELECT source, lang, 'words-1' AS tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(words) AS BIGINT) AS n_tokens
  FROM d WHERE nth = 1 GROUP BY source, lang
  UNION ALL
  SELECT source, lang, 'runs-1', CAST(count(*) AS BIGINT), CAST(sum(words) AS BIGINT) FROM d GROUP BY source, lang)
WHERE n_docs <> 0 OR n_tokens <> 0
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = bpe.with_ids(docs, *rank_file())
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    base = docs.select("doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"), n_words(F.col("text")).alias("tokens"), crc.alias("text_crc32"), sharding.group_key(F.col("text")).alias("group"))
    got = sharding.sharded(written(base, "sharding-base"), sizes=("size", "tokens"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    # lines of a wrapped statement count with it
    alone = F.filter("licences", lambda x: x["confirmed"] | ~F.exists("wrapped_licences", lambda w: x["line"].between(w["line"], w["last"])))
    every = F.array_sort(F.concat(*(F.transform(c, lambda x: F.struct(*(x[k].alias(k) for k in ("line", "family", "probability", "confirmed")))) for c in (alone, F.col("wrapped_licences")))))
    got = got.withColumn("_every", every)
    sure = F.filter("_every", lambda x: x["confirmed"])
    families = F.transform(sure, lambda x: x["family"])
    return got.select(
        "doc_id",
        F.size("_every").cast("long").alias("n_paragraphs"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(families)), ",").alias("families"),
        F.get(sure, F.lit(0))["line"].alias("first_line"),
        F.round(F.get(sure, F.lit(0))["probability"], 6).alias("first_probability"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), simhash.hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(c, b)),
o AS (
  SELECT v.c || w.c || x.c || y.c || z.c AS filter_order, [v.b, w.b, x.b, y.b, z.b] AS bits
  FROM b v, b w, b x, b y, b z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND (v.b | w.b | x.b | y.b | z.b) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS applied FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit,
         CAST(sum(CASE WHEN mask & (applied | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN mask & applied <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN mask & applied = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs, a tenth of them (by crc32 of the id) with their words from a place on replaced by repeats
    of the first few of these.  Texts without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    rows = docs.select("doc_id", "text", h.alias("h"), g.cast("long").alias("g")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.col("text"))))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))).otherwise(x))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(table(spark, sf_dir, "documents"))
    got = periodic_runs.with_runs(docs).select("doc_id", "runs.*").withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         xor(list_reduce(list_concat([4294967295], flatten([[CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
                         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) AS h
  FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT rid, n, unnest(range(n)) AS i, unnest([CASE WHEN a IS NOT NULL AND k > a THEN w[a + (k - 1 - a) % p + 1] ELSE w[k] END FOR k IN range(1, n + 1)]) AS word FROM p),
m AS (SELECT u.rid, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.rid = v.rid AND u.word = v.word AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
s AS (
  SELECT rid, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m)
  GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT rid, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY 1),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS t FROM x ANTI JOIN dropped USING (rid, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""


def op13_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = vector_links.linked(table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (
  SELECT rid, vec_id, label, [x / m FOR x IN e] AS e FROM (SELECT *, list_max([abs(x) FOR x IN e]) AS m FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0) WHERE m > 0),
l AS (
  SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT rid AS a, rid AS b FROM v UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS rid, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.b GROUP BY 1),
n AS (SELECT a AS rid, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_progressive_jpeg, op2_source_mixture, op3_quality_rules, op4_quality_classifier, op5_site_style_tree, op6_token_rollups, op7_byte_bpe, op8_vector_sharding, op9_license_scan, op10_simhash, op11_filter_audit, op12_periodic_runs, op13_vector_links)
    return {f.__name__: f for f in (*own, quality_measures)}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixture": OP2_SQL, "op6_token_rollups": OP6_SQL, "op11_filter_audit": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_vector_links": OP13_SQL, "quality_measures": MEASURES_SQL}
