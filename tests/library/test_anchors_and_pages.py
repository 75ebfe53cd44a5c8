import random

from pyspark.sql import functions as F

from docquarry.functions import finance
from docquarry.operators import companies, context, registry


def brute_anchor(parent, child):
    if not parent or not child:
        return parent or "", 0, 0
    places = [i for i, c in enumerate(parent) if not c.isspace()]
    bare, head = "".join(parent[i] for i in places), "".join(c for c in child if not c.isspace())
    for n in dict.fromkeys([min(64, len(head)), *(k for k in (40, 24, 16, 12, 8) if k < len(head))]):
        at = bare.find(head[:n]) if n else -1
        if at >= 0:
            a, z = places[at], places[at + n - 1] + 1
            return parent[:a] + "<hit>" + parent[a:z] + "</hit>" + parent[z:], a, z
    return parent, 0, 0


def test_anchor(spark):
    rng, rows = random.Random(1), []
    for _ in range(150):
        words = [rng.choice(["net", "profit", "of", "the", "bank", "净利润", "为", "12.5", "a　b", "(x)"]) for _ in range(rng.randrange(30))]
        parent = "".join(w + rng.choice([" ", "\n", "  ", "\t", ""]) for w in words)
        a = rng.randrange(len(words) + 1)
        child = rng.choice([" ", "\n"]).join(words[a : a + rng.randrange(20)]) + rng.choice(["", "", " elsewhere"])
        rows.append((parent, child))
    rows += [(None, "x"), ("x", None), ("", ""), ("abc", " "), ("same same same", "same"), ("x" * 200, "x" * 100), ("short", "longer than its parent")]
    df = spark.createDataFrame(rows, "p string, c string")
    got = df.select("p", "c", context.anchor(F.col("p"), F.col("c")).alias("a")).collect()
    assert [(r["a"]["marked"], r["a"]["start"], r["a"]["end"]) for r in got] == [brute_anchor(p, c) for p, c in rows]


def test_around_anchor(spark):
    text = "Heading of it. " + "x" * 3000 + "ANCHOR" + "y" * 3000
    a = text.index("ANCHOR")
    df = spark.createDataFrame([(text, a, a + 6), ("short", 1, 2)], "t string, a int, z int")
    got = [r[0] for r in df.select(context.around_anchor(F.col("t"), F.col("a"), F.col("z"), 400)).collect()]
    assert got == [text[:160] + "…" + text[a - 100 : a + 6 + 200], "short"]


def test_numerals(spark):
    known = {"三千": 3000, "三千万": 3e7, "十五": 15, "二十": 20, "一百零五": 105, "两亿": 2e8, "一亿二千万": 1.2e8, "一万亿": 1e12, "十万": 1e5, "万": 1e4, "三百二十一万四千五百六十七": 3214567, "九": 9, "十亿零五": 1e9 + 5}
    got = spark.createDataFrame([(k,) for k in known], "t string").select("t", finance.numeral(F.col("t")), finance.chinese_number("t")).collect()
    assert {r[0]: r[1] for r in got} == known == {r[0]: r[2] for r in got}


def test_thresholds_in_words_and_figures(spark):
    q = ["净利润超过三千万元吗", "净利润高于3.5亿元且不超过五亿元", "超过三千万元吗", "净利润达到十 亿", "净利润高于很多", None]
    got = spark.createDataFrame([(x,) for x in q], "q string").select(finance.constraints(F.col("q")).alias("c")).collect()
    assert [[(x["op"], x["family"], x["value"]) for x in (r["c"] or [])] for r in got] == [[(">", "money", 3e7)], [(">", "money", 3.5e8), ("<=", "money", 5e8)], [], [(">=", "money", 1e9)], [], []]


def in_order(a, b):
    rest = iter(b)
    return all(c in rest for c in a)


def test_names_in_order_of_characters(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) for _ in range(120)]
    a, b = spark.createDataFrame([(x,) for x in set(names[:60])], "_a string"), spark.createDataFrame([(x,) for x in set(names)], "_b string")
    got = {(r["_a"], r["_b"]) for r in companies._within(a, b).collect()}
    assert got == {(x, y) for x in set(names[:60]) for y in set(names) if in_order(x, y)}


def test_documents_of_questions(spark):
    facts = spark.createDataFrame([("贵州茅台", "d1", "o", "public"), ("贵州茅台", "d2", "o", "restricted"), ("招商银行", "d3", "o", "public"), ("招商银行", "d4", "x", "public"), ("工商银行", "d5", "o", "public"), ("", "d6", "o", "public"), (None, "d7", "o", "public")], "company string, doc_id string, org string, visibility string")
    q = spark.createDataFrame([(1, "贵州茅台2024年净利润是多少"), (2, "比较招商银行和工商银行的风险"), (3, "天气如何")], "qid int, question string")
    got = {r["qid"]: r["doc_ids"] for r in companies.documents_of(q, facts, "o", ["public"]).collect()}
    assert got == {1: ["d1"], 2: ["d3", "d5"]}
    assert {r[0] for r in companies.distinct_companies(facts).collect()} == {"贵州茅台", "招商银行", "工商银行"}


def test_pages_after_bookmarks(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1, 2, 3, 4])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, created_at long")
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    seen, mark = [], None
    while True:
        page = registry.page_after(df, mark, rng.randrange(1, 12)).collect()
        if not page:
            break
        seen += [r["doc_id"] for r in page]
        mark = (page[-1]["created_at"], page[-1]["doc_id"])
        if len(seen) > 25:  # a row before the bookmark comes, one goes: nothing shifts
            df = df.where(F.col("doc_id") != want[0]).unionByName(spark.createDataFrame([(1000 + len(seen), 9)], "doc_id long, created_at long"))
    assert seen == want
    got = registry.numbered(spark.createDataFrame(rows, "doc_id long, created_at long").repartition(5), [F.desc_nulls_last("created_at"), F.col("doc_id")]).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == want and sorted(r["position"] for r in got) == list(range(60))
    assert registry.numbered(df.limit(0), [F.col("doc_id")]).count() == 0
