"""Companies that questions are about.

Companies are a small dimension (those with facts); questions are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import questions as Q
from docquarry.functions import text as T
from docquarry.sources.shared import written

# Legal and regional parts of names, and abbreviations in use.
SUFFIXES = ("集团股份有限公司", "集团有限公司", "股份有限公司", "有限公司", "股份", "集团")
PREFIXES = ("中国", "上海", "深圳市", "深圳", "宜宾", "杭州", "贵州", "北京市", "北京")
ABBREVIATIONS = {"ge": "General Electric", "工行": "中国工商银行", "建行": "中国建设银行", "农行": "中国农业银行", "中行": "中国银行", "招行": "招商银行", "浦发": "上海浦东发展银行", "茅台": "贵州茅台", "中芯": "中芯国际", "宁德": "宁德时代新能源科技", "海康": "杭州海康威视数字技术", "汇川": "深圳市汇川技术"}
FILLERS = ("请问", "是多少", "为多少", "有多少", "多少", "分别为", "分别", "其", "公司", "的", "年末", "期末", "年底", "末")
#: Answers that are broadcast.
FEW = 20000
ENGLISH_FILLERS = "what|were|was|are|is|in|of|for|at|the|and|how|did|do|does|has|have|had|by|to|from|on|as|its|their|it|they|that|this|these|those"


def aliases(companies: DataFrame) -> DataFrame:
    """(company, alias): full name, name without legal suffix, without region, and abbreviations."""
    name = T.simplified(F.trim("company"))
    core = F.regexp_replace(name, f"({'|'.join(SUFFIXES)})$", "")
    near = F.filter(F.array(*(F.when(core.startswith(p) & (F.length(core) - len(p) >= 2), F.substr(core, F.lit(len(p) + 1), F.length(core))) for p in PREFIXES)), lambda x: x.isNotNull())
    short = F.filter(F.array(*(F.when(F.lower(name).contains(v.lower()) | F.contains(F.lit(v.lower()), F.lower(name)), F.lit(k)) for k, v in ABBREVIATIONS.items())), lambda x: x.isNotNull())
    every = F.concat(F.array(name, core), near, short)
    return companies.select("company", F.explode(F.array_distinct(F.transform(every, F.lower))).alias("alias")).where(F.length("alias") >= 2)


def mentioned(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(qid, company): companies any of whose aliases stands in the question."""
    q = questions.select("qid", F.lower(T.simplified(F.col("question"))).alias("_q"))
    # a question that holds an alias has its first two characters next to each other
    pairs = q.select("qid", "_q", F.explode(T.char_grams(F.col("_q"), 2)).alias("_key"))
    return pairs.join(aliases(companies).withColumn("_key", F.substring("alias", 1, 2)), "_key").where(F.contains("_q", "alias")).select("qid", "company").distinct()


def subject_text(question: Column) -> Column:
    """The question without years, its metric's name and filler words: what it is about."""
    from docquarry.functions import finance

    s = F.regexp_replace(question, "(?i)(19|20)[0-9]{2}\\s*年度?|fiscal\\s+year\\s+(19|20)[0-9]{2}|fy(19|20)[0-9]{2}|(19|20)[0-9]{2}", " ")
    low = F.lower(s)
    longest = F.coalesce(*(F.when(low.contains(a), F.lit(a)) for a in sorted({a for v in finance.ALIASES.values() for a in v}, key=len, reverse=True)), F.lit("\x00"))
    s = F.replace(low, longest, F.lit(""))
    s = F.regexp_replace(F.replace(F.replace(s, F.lit("'s"), F.lit(" ")), F.lit("'"), F.lit(" ")), f"\\b({ENGLISH_FILLERS})\\b", " ")
    for f in FILLERS:
        s = F.replace(s, F.lit(f), F.lit(""))
    return F.regexp_replace(s, "[，,。？?、\\s]+", "")


def in_order(short: Column, long: Column) -> Column:
    """Whether the characters of one stand in the other in the same order."""
    rest = F.aggregate(F.split(short, ""), long, lambda r, c: F.when(r.isNull() | (c == ""), r).otherwise(F.when(F.instr(r, c) > 0, F.substr(r, F.instr(r, c) + 1, F.length(r)))))
    return rest.isNotNull()


def skip_pairs(text: Column) -> Column:
    """Distinct pairs of characters that stand in a text in this order, next to one another or not."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    after = lambda own: F.flatten(F.transform(own, lambda x, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda y: F.concat(x, y))))
    return F.array_distinct(T.bound(letters, after))


def _within(short: DataFrame, long: DataFrame) -> DataFrame:
    """(_a, _b): names _a (of two characters or more) that stand in names _b in order of characters.  A name has all
    skip pairs of what stands in it so; the pair of _a that is rarest among all _b is the key."""
    there = long.select("_b", F.explode(skip_pairs(F.col("_b"))).alias("_key"))
    asked = short.select("_a", F.explode(skip_pairs(F.col("_a"))).alias("_key"))
    n = there.join(asked.select("_key").distinct(), "_key", "left_semi").groupBy("_key").agg(F.count("*").alias("_n"))
    known = asked.join(n, "_key", "left")
    key = known.groupBy("_a").agg(F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_key")).alias("_key"))
    return key.join(there, "_key").where(in_order(F.col("_a"), F.col("_b"))).select("_a", "_b")


def subject(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(qid, company): the one company a question is about: whose name holds its subject, or is held by
    it, in order of characters; else the one company it mentions; else null.

    Equal questions are answered once.  What joins many rows is merged, as Spark would broadcast by what rows take when
    compressed; FEW answers are broadcast, so that a frequent question makes no hot key."""
    texts = questions.select("question").distinct().select(F.col("question").alias("qid"), "question")
    answers = written(_subject_of(texts, companies).where("company IS NOT NULL").select(F.col("qid").alias("question"), "company"), "answers")
    answers = F.broadcast(answers) if answers.count() <= FEW else answers.hint("merge")
    return questions.select("qid", "question").join(answers, "question", "left").select("qid", "company")


def _subject_of(questions: DataFrame, companies: DataFrame) -> DataFrame:
    # written: a long expression, read four times
    q = written(questions.select("qid", T.simplified(subject_text(F.col("question"))).alias("_s")), "subjects").where(F.length("_s") >= 2)
    c = companies.select("company", F.lower(T.simplified(F.col("company"))).alias("_c")).distinct()
    one = lambda df: df.groupBy("qid").agg(F.count("*").alias("n"), F.min("company").alias("company")).where("n = 1").select("qid", "company")
    subjects, names = q.select("_s").distinct(), c.select("_c").distinct()
    held = _within(subjects.withColumnRenamed("_s", "_a"), names.withColumnRenamed("_c", "_b")).select(F.col("_a").alias("_s"), F.col("_b").alias("_c"))
    holds = _within(names.where(F.length("_c") >= 2).withColumnRenamed("_c", "_a"), subjects.withColumnRenamed("_s", "_b")).select(F.col("_b").alias("_s"), F.col("_a").alias("_c"))
    letter = names.where(F.length("_c") == 1).join(subjects.select("_s", F.explode(F.array_distinct(F.split("_s", ""))).alias("_c")), "_c").select("_s", "_c")
    pairs = held.unionByName(holds).unionByName(letter).distinct()
    first = one(q.join(pairs, "_s").join(c, "_c").select("qid", "company").distinct())
    second = one(mentioned(questions, companies)).withColumnRenamed("company", "_m")
    return questions.select("qid").join(first.hint("merge"), "qid", "left").join(second.hint("merge"), "qid", "left").select("qid", F.coalesce("company", "_m").alias("company"))


def documents_of(questions: DataFrame, facts: DataFrame, org: str, levels: list[str]) -> DataFrame:
    """(qid, doc_ids): the documents with facts of the company a question is about, or, where it is about no single one,
    of the companies it mentions, among facts (company, doc_id, org, visibility) that its user may read.  Questions without
    any have no row."""
    own = facts.where((F.col("org") == org) & F.col("visibility").isin(*levels) & (F.col("company") != ""))
    known = distinct_companies(own)
    about = subject(questions, known).where("company IS NOT NULL")
    rest = mentioned(questions, known).join(about.select("qid"), "qid", "left_anti")
    of = about.select("qid", "company").unionByName(rest.select("qid", "company")).distinct()
    return of.join(own.select("company", "doc_id").distinct(), "company").groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def distinct_companies(facts: DataFrame) -> DataFrame:
    """(company): names of facts, once each, without null and empty ones."""
    return facts.where("company <> ''").select("company").distinct()


def compared(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(qid, companies) of questions that compare two or more."""
    named = mentioned(questions, companies).groupBy("qid").agg(F.array_sort(F.collect_set("company")).alias("companies")).where(F.size("companies") >= 2)
    return questions.where(Q.has_any(F.lower("question"), Q.COMPARE_WORDS)).select("qid").join(named, "qid")
