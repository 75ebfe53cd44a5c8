import re
from itertools import permutations

from docquarry.llm import filter_audit

SPACE = r"[^\x20\x09-\x0D]+"


def brute(docs, labels):
    """The audit written out: every order applied to every document.  docs: (id, text, part)."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails = []
    for i, t, part in docs:
        t = t or ""
        w = re.findall(SPACE, t)
        own = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first[t],
        }
        mine = [x for x in labels if i is not None and x[0] == i]
        fails.append((part or "", {k for k, v in own.items() if v}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, removed_by = {}, {}
    for part in {f[0] for f in fails}:
        for order in permutations("ABCDE"):
            left, gone = [f for f in fails if f[0] == part], []
            for k, x in enumerate(order):
                removed = [f for f in left if x in f[1]]
                redundant = [f for f in gone if x in f[1]]
                left = [f for f in left if x not in f[1]]
                gone += removed
                removed_by[part, x] = removed_by.get((part, x), 0) + len(removed)
                unique = sum(f[0] == part and f[1] == {x} for f in fails)
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(redundant), unique, sum(f[2] for f in removed), sum(f[3] for f in removed)]
    return {k: [*v, removed_by[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def rows(df):
    own = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in own] for r in got}
    assert len(found) == len(got)
    return found


LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (None, LONG, "a"), (3, None, None), (4, "", ""), (5, "ABC DEF $", "a"),
    (6, "same " * 80, "a"), (7, LONG.upper() + " #", "b"), (8, " \t\n", "a"), (9, LONG + " %", None), (10, LONG, "c"), (None, None, None),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 1, 1), (10, 1, None), (None, 1, 1), (99, 1, 1), (6, None, 1)]


def test_against_every_order_applied(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = rows(filter_audit.audited(docs, labels))
    assert got == brute(DOCS, LABELS)
    assert len(got) == 4 * 600
    for part in ("a", "b", "c", ""):  # the Shapley sums of all filters are what 120 orders remove
        removed = sum(v[1] for k, v in got.items() if k[0] == part)
        assert removed == sum({k[1][k[2] - 1]: v[6] for k, v in got.items() if k[0] == part}.values())


def test_odd_columns_and_empty_tables(spark, odd, empty):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    docs = odd.withColumns({"part": F.lit(1), "mask": F.lit("x"), "first_id": F.lit(None).cast("int"), "words": F.lit("w"), "a.b": F.lit(0)})
    plain = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert rows(filter_audit.audited(docs, labels)) == brute(plain, LABELS)
    assert rows(filter_audit.audited(docs, labels.limit(0))) == brute(plain, [])
    assert filter_audit.audited(empty, labels).count() == 0


def test_filters_of_ones_own(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "x y"), (2, "x"), (3, "z")], "doc_id long, text string").withColumn("source", F.lit("s"))
    own = (filter_audit.Filter("X", F.col("text").contains("x")), filter_audit.Filter("S", F.size("words") < 2))
    got = rows(filter_audit.audited(docs, None, own))
    assert {k: v[:4] for k, v in got.items()} == {("s", "XS", 1): [1, 2, 0, 1], ("s", "XS", 2): [0, 1, 1, 1], ("s", "SX", 1): [1, 2, 0, 1], ("s", "SX", 2): [0, 1, 1, 1]}
    assert {k[1][k[2] - 1]: v[6] for k, v in got.items()} == {"X": 3, "S": 3}
