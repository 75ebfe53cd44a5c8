"""Column functions that classify and rewrite questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions import finance
from docquarry.functions import text as T

# Words that tell what kind of question is asked.
METRIC_WORDS = ("净资产收益率", "归母净利润", "扣非净利润", "净利润", "每股收益", "每股净资产", "每股经营现金流", "加权平均", "摊薄", "roaa", "roa", "roe", "eps", "毛利率", "净利率", "资产负债率", "权益乘数", "市盈率", "市净率", "总资产收益率", "净利", "每股")
ENTITY_WORDS = ("营业收入", "营业总收入", "主营收入", "营收", "利润总额", "营业利润", "经营现金流", "经营活动产生的现金流量净额", "现金流", "货币资金", "总资产", "净资产", "所有者权益", "收入")
SUMMARY_WORDS = ("总结", "综述", "归纳", "概述", "概括", "梳理", "看法", "观点", "评价", "意见", "分析", "趋势", "走势", "变化", "变动", "发展", "为什么", "原因", "导致", "比较", "对比", "相比", "差异", "summar", "overview", "trend")
TREND_WORDS = ("相比", "对比", "趋势", "变化", "演进", "逐年", "同期", "变动", "增长情况")
VERIFY_WORDS = ("辨析", "核实", "传闻", "市场观点", "说法", "准确性", "是否属实", "verify", "claim", "rumor")
COMPARE_WORDS = ("对比", "比较", "分别", "差距", "相比", "差别", "差异", "和", "与", "跟", "vs", "versus")
NEGATIONS = ("除了(.+?)(?:之外|以外|外)[，,。;；]?", "除(.+?)(?:之外|以外|外)[，,。;；]?", "(?:排除|不包括|剔除)(.+?)[，,。;；]")
#: Terms that begin with 非 and negate nothing.
NOT_NEGATED = ("非经常性损益", "非经常性", "非系统性风险", "非保本", "非标", "非标债权", "非利息收入", "非息收入", "非存款类", "非流动资产", "非流动负债", "非控股股东", "非全资", "非金融", "非银", "非居民")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def query_type(question: Column) -> Column:
    """metric before entity, else general."""
    q = F.lower(question)
    return F.when(has_any(q, METRIC_WORDS), "metric").when(has_any(q, ENTITY_WORDS), "entity").otherwise("general")


def is_summary(question: Column, companies: Column | None = None) -> Column:
    """Asks for a summary or analysis.  What stands within a company's name doesn't count."""
    q = question if companies is None else F.aggregate(companies, question, lambda s, c: F.replace(s, c, F.lit("")))
    return has_any(F.lower(q), SUMMARY_WORDS)


def is_trend(question: Column) -> Column:
    return has_any(question, TREND_WORDS) | question.rlike("(19|20)[0-9]{2}\\s*年?\\s*(至|到|~|—|-)\\s*(19|20)[0-9]{2}")


def is_verification(question: Column) -> Column:
    return has_any(F.lower(question), VERIFY_WORDS)


def is_narrative(question: Column) -> Column:
    """Neither a known metric nor a summary: the answer is in prose."""
    return finance.matched_metric(question).isNull() & ~is_summary(question)


def effective_year(question: Column) -> Column:
    """The year to filter by; none for trends and claims, whose evidence may stand in other years."""
    return F.when(~is_trend(question) & ~is_verification(question), T.first_year(question))


def allows_hyde(question: Column) -> Column:
    """No strong exact signal: no number with a unit, no quotation, no plain metric."""
    exact = (F.size(T.number_phrases(question)) > 0) | (F.size(T.quoted_phrases(question)) > 0)
    return ~exact & ~(finance.matched_metric(question).isNotNull() & ~is_summary(question))


def negated_entity(question: Column) -> Column:
    """What a question excludes; null if nothing, or if what is found is long or a fixed term."""
    found = F.coalesce(*(F.when(F.regexp_extract(question, p, 1) != "", F.regexp_extract(question, p, 1)) for p in NEGATIONS))
    bare = F.regexp_replace(F.trim(found), "[后中内]$", "")
    return F.when((bare != "") & (F.length(bare) <= 16) & ~has_any(bare, NOT_NEGATED), bare)


def without_negation(question: Column) -> Column:
    """The question without its excluding clause, or as it is where nothing would be left."""
    out = question
    for p in NEGATIONS:
        out = F.regexp_replace(out, p, "")
    out = T.strip(F.regexp_replace(out, "^[，,。;；\\s]+", ""))
    return F.when(out != "", out).otherwise(question)


def with_aliases(question: Column, most: int = 2) -> Column:
    """The question with up to two other names of its metric."""
    metric, low, out = finance.matched_metric(question), F.lower(question), question
    for key, aliases in finance.ALIASES.items():
        missing = F.slice(F.filter(F.array(*map(F.lit, aliases)), lambda a: ~F.contains(low, F.lower(a))), 1, most)
        out = F.when(metric == key, F.concat_ws(" ", question, F.array_join(missing, " "))).otherwise(out)
    return F.trim(out)


def metric_keys(question: Column) -> Column:
    """All metrics of a question, without those whose name stands only within a longer name: longer names
    are taken out of the text before shorter ones are looked for."""
    order = sorted(((a, k) for k, v in finance.ALIASES.items() for a in v), key=lambda x: (-len(x[0]), x[0]))
    names = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(k).alias("key")) for a, k in order))
    start = F.struct(F.lower(question).alias("rest"), F.array().cast("array<string>").alias("keys"))
    step = lambda s, n: F.when(F.contains(s["rest"], n["alias"]), F.struct(F.replace(s["rest"], n["alias"], F.lit("\x00")).alias("rest"), F.array_union(s["keys"], F.array(n["key"])).alias("keys"))).otherwise(s)
    return F.array_sort(F.aggregate(names, start, step, lambda s: s["keys"]))


def safe_rewrite(original: Column, rewritten: Column, companies_of_both_agree: Column) -> Column:
    """The rewrite, if it names the same metrics, years and companies; else the original."""
    years = lambda q: F.array_sort(F.array_distinct(F.regexp_extract_all(q, F.lit("(?:19|20)[0-9]{2}"), F.lit(0))))
    same = (metric_keys(original) == metric_keys(rewritten)) & (years(original) == years(rewritten)) & companies_of_both_agree
    return F.when((F.coalesce(rewritten, F.lit("")) != "") & F.coalesce(same, F.lit(False)), rewritten).otherwise(original)


def templated(company: Column, year: Column, label: Column) -> Column:
    """A question for a fact, in the language of the company's name."""
    english = company.rlike("^[\\x21-\\x7E]")
    return F.when(english, F.format_string("What was %s's %s in %d?", company, label, year)).otherwise(F.format_string("%s%d年%s是多少？", company, year, label))


# Kinds of questions, the first that has a word of its own.
SUBTYPES = (
    ("趋势", ("趋势", "走势", "逐年", "变化", "变动", "演进", "增长情况", "同期")),
    ("多跳", ("为什么", "原因", "导致", "影响", "如何", "怎样", "综合", "梳理", "说明")),
    ("综述", ("总结", "综述", "概述", "归纳", "概括", "整体", "总体")),
    ("比较", ("对比", "比较", "相比", "差异", "分别", "差距")),
    ("对抗", ("是否", "核实", "正确", "真的", "属实", "吗", "还是")),
)


def subtype(question: Column) -> Column:
    """The first kind one of whose words the question has, else 其他."""
    out = F.lit("其他")
    for name, words in reversed(SUBTYPES):
        out = F.when(has_any(question, words), name).otherwise(out)
    return out
