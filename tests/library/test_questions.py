import json

import pytest
from pyspark.sql import functions as F

from docquarry.functions import plan_json
from docquarry.functions import questions as Q
from docquarry.operators import amounts, companies, planning, sections


def apply(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_classes(spark):
    assert apply(spark, ["2024年净利润是多少", "货币资金", "网点有多少"], Q.query_type) == ["metric", "entity", "general"]
    assert apply(spark, ["2023至2025年毛利率", "收入变化", "2024年收入"], Q.is_trend) == [True, True, False]
    assert apply(spark, ["2024年收入", "2024年收入变化", "核实2024年说法", "收入"], Q.effective_year) == [2024, None, None, None]
    assert apply(spark, ["网点有多少", "净利润", "分析一下"], Q.is_narrative) == [True, False, False]
    assert apply(spark, ["净利润是多少", "分析净利润", '"核心"如何发展', "不良率1.2%"], Q.allows_hyde) == [False, True, True, False]
    names = F.array(F.lit("上海浦东发展银行"))
    assert apply(spark, ["上海浦东发展银行净利润", "上海浦东发展银行净利润趋势"], lambda q: Q.is_summary(q, names)) == [False, True]


def test_negation(spark):
    q = ["除了iPhone之外，收入如何", "剔除非经常性损益后的净利润，多少", "排除房地产板块后，贷款多少", "收入多少"]
    assert apply(spark, q, Q.negated_entity) == ["iPhone", None, "房地产板块", None]
    assert apply(spark, q[:1] + ["除X外"], Q.without_negation) == ["收入如何", "除X外"]


def test_aliases_and_rewrites(spark):
    assert apply(spark, ["2025年毛利率", "无关"], Q.with_aliases) == ["2025年毛利率 综合毛利率 销售毛利率", "无关"]
    assert apply(spark, ["净资产收益率和净资产", "净资产收益率", "eps and net income"], Q.metric_keys) == [["net_assets", "roe"], ["roe"], ["eps", "net_profit"]]
    df = spark.createDataFrame([("2024年净利润", "2024年净利润多少"), ("2024年净利润", "2023年净利润"), ("2024年净利润", "2024年净资产"), ("q", None)], "a string, b string")
    assert [r[0] for r in df.select(Q.safe_rewrite(F.col("a"), F.col("b"), F.lit(True))).collect()] == ["2024年净利润多少", "2024年净利润", "2024年净利润", "q"]


def test_companies(spark):
    c = spark.createDataFrame([("中国工商银行股份有限公司",), ("中国建设银行",), ("General Electric",), ("GECS",), ("招商銀行",), ("上海浦东发展银行",)], "company string")
    q = [(1, "比较工行和建行的净利润"), (2, "梳理工商银行风险变化"), (3, "What were GE's total revenues in 1998?"), (4, "招商银行2024年净利润是多少"), (5, "公司2023年收入"), (6, "浦发银行净利润")]
    df = spark.createDataFrame(q, "qid int, question string")
    found = {}
    for r in companies.mentioned(df, c).collect():
        found.setdefault(r["qid"], set()).add(r["company"])
    assert found[1] == {"中国工商银行股份有限公司", "中国建设银行"} and found[2] == {"中国工商银行股份有限公司"} and 5 not in found
    subject = {r["qid"]: r["company"] for r in companies.subject(df, c).collect()}
    assert subject[4] == "招商銀行" and subject[6] == "上海浦东发展银行" and subject[5] is None and subject[1] is None
    assert [r["qid"] for r in companies.compared(df, c).collect()] == [1]
    pairs = spark.createDataFrame([("浦发银行", "上海浦东发展银行"), ("abc", "acb"), ("", "x")], "a string, b string")
    assert [r[0] for r in pairs.select(companies.in_order(F.col("a"), F.col("b"))).collect()] == [True, False, True]


def test_plans(spark):
    raw = ['```json\n{"intent": "table", "complexity": "odd", "sub_queries": [" a ", "", "b"], "evidence_aspects": ["x", "x"], "needs_hyde": true}\n```', "no json", 'text {"query_type": "metric", "evidence_aspects": ["x", "y"], "rewritten_query": " r "} tail']
    got = apply(spark, raw, plan_json.plan)
    assert (got[0]["intent"], got[0]["complexity"], got[0]["sub_queries"], got[0]["evidence_aspects"], got[0]["needs_hyde"]) == ("table", "simple", ["a", "b"], [], True)
    assert (got[1]["intent"], got[1]["sub_queries"], got[1]["rewritten_query"]) == ("factual", [], None)
    assert (got[2]["query_type"], got[2]["evidence_aspects"], got[2]["rewritten_query"]) == ("metric", ["x", "y"], "r")
    assert apply(spark, ['{"a": 1} trailing {', "x {bad {\"b\": [2]}", "none"], plan_json.first_object) == ['{"a": 1}', '{"b": [2]}', None]
    assert json.loads(apply(spark, ['{"a": 1, "b": "s", "c": {"d": 2.5, "e": [1]}}'], plan_json.numbers_only)[0]) == {"a": 1, "c": {"d": 2.5}}
    assert apply(spark, ["org=a; split=dev;;x="], plan_json.scope) == [{"org": "a", "split": "dev"}]


def test_order_of_parts(spark):
    p = spark.createDataFrame([("q", 0, [1]), ("q", 1, [2]), ("q", 2, None), ("c", 0, [1]), ("c", 1, [0]), ("o", 0, [9, 0])], "qid string, n int, needs array<int>")
    got = {(r["qid"], r["n"]): r["depth"] for r in planning.ordered(p).collect()}
    assert (got["q", 2], got["q", 1], got["q", 0], got["o", 0]) == (0, 1, 2, 0) and got["c", 0] == got["c", 1] == 5
    assert apply(spark, ["该行2024年拨备覆盖率是多少？", "该银行的生息资产"], lambda q: planning.with_entity(q, F.lit("农业银行"))) == ["农业银行2024年拨备覆盖率是多少？", "农业银行的生息资产"]


def test_sections(spark):
    q = spark.createDataFrame([("q", "d", "net profit"), ("q", "e", "net profit")], "qid string, doc_id string, question string")
    s = spark.createDataFrame([("d", f"d{i:03d}", i, "net" if i == 150 else "other", "text") for i in range(200)] + [("e", "e0", 1, "x", "y")], "doc_id string, section_id string, page int, path string, content string")
    scored = sections.scored(q, s)
    assert scored.where("section_id = 'd150'").first()["score"] == 3 * (4 + 4 + 9)
    got = sections.covered(scored, limit=50).collect()
    first = min(got, key=lambda r: r["position"])
    assert first["section_id"] == "d150" and len(got) == 50 and {r["doc_id"] for r in got} == {"d", "e"} and len({r["section_id"] for r in got}) == 50
    pages = [int(r["section_id"][1:]) for r in got if r["doc_id"] == "d"]
    assert sum(p < 25 for p in pages) >= 18 and max(pages) > 150


def test_pages_and_neighbours(spark):
    h = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, chunk_id string, rank int")
    near = spark.createDataFrame([("q", "d", "b", 0, 0, 1), ("q", "d", "n", 1, 5, 1)], "qid string, doc_id string, chunk_id string, page_distance int, seq_distance int, seed_rank int")
    assert [r["chunk_id"] for r in sections.with_neighbours(h, near, after=1).orderBy("position").collect()] == ["a", "n", "b"]
    c = spark.createDataFrame([("q", "d", 1, "a", 2, "fine"), ("q", "d", 1, "b", 1, "�"), ("q", "d", 2, "c", 3, "good text")], "qid string, doc_id string, page int, chunk_id string, rank int, content string")
    got = {r["page"]: r for r in sections.page_candidates(c).collect()}
    assert got[1]["rank"] == 1 and got[1]["bad_ratio"] == pytest.approx(0.2) and not got[1]["usable"] and got[2]["usable"]
    pool = sections.page_pool(c.where("page = 2"), c.select("qid", "doc_id", "page", "rank"))
    assert {r["page"]: r["position"] for r in pool.collect()} [2] == 1


def test_restatements(spark):
    got = apply(spark, ["$1.7 billion ($1,706 million), and $2.0 billion ($1,706 million); USD 5 (EUR 6)"], amounts.restatements)[0]
    assert [r["agree"] for r in got] == [True, False]
