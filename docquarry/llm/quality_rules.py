"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at one measure of a text and votes 1 (good), -1 (bad) or 0 (abstains).  Rules err, so
their votes aren't required to agree.  Expectation-maximisation estimates, from the votes alone, three
things: how common good texts are, and for each rule how often it calls a good text bad (its false
alarms) and a bad one bad (its recall).  A text is kept if the posterior probability that it is good
reaches ``KEEP``: a rule that often errs is outvoted, one that hardly ever does decides alone.  That a
rule abstains says nothing about a text, as is usual for labelling functions.

The only thing given beforehand is a Beta prior worth ``PRIOR_TEXTS`` texts, the same for every rule: rules
call ``ALARM`` of the good and ``RECALL`` of the bad texts bad, and ``GOOD`` of the texts are good.  A rule that
is estimated to call good texts bad more often than bad ones is worse than chance; both its rates are
pooled, so that it says nothing and the two classes can't trade places.

What EM needs from the corpus is how often each combination of votes occurs: at most 3 to the number of
rules rows, whatever the size of the corpus, so these counts come to the driver.

Words are runs of anything but ASCII white space.  Null and empty texts have no words and fail the
base rule (fewer than ``MIN_WORDS`` words).  Repeated rows get equal results.  An empty table gives
an empty result.  Columns of docs keep their names and values, whatever these are; the verdict takes the
first free name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import SPACE, free_name, words, written

MIN_WORDS, MAX_REPEAT_PERCENT, KEEP, ROUNDS = 50, 50, 0.5, 50
PRIOR_TEXTS, ALARM, RECALL, GOOD = 100.0, 0.05, 0.4, 0.8
#: Up to so many different repeated windows they are looked up one by one, above that by sorting.
FEW = 16


@dataclass(frozen=True)
class Rule:
    """Votes 1 where low <= measure <= high, -1 where measure < worst_low or > worst_high, else 0."""

    name: str
    measure: str
    low: float
    high: float
    worst_low: float
    worst_high: float

    def vote(self, m: Column) -> Column:
        good = m.between(self.low, self.high)
        return F.coalesce(F.when(good, 1).when((m < self.worst_low) | (m > self.worst_high), -1), F.lit(0)).cast("int")


#: Shares are of words or lines, but for capitals, which are of the characters in words.  Rules overlap: most
#: faults of a text are seen by two or more of them.
RULES = (
    Rule("symbols", "n_symbols / n_words", 0, 0.02, -1, 0.1),
    Rule("symbol runs", "n_symbol_runs / n_words", 0, 0.01, -1, 0.1),
    Rule("bare words", "n_bare_words / n_words", 0, 0.1, -1, 0.3),
    Rule("odd endings", "n_odd_endings / n_words", 0, 0.05, -1, 0.2),
    Rule("repeats", "n_repeat_words / n_words", 0, 0.1, -1, 0.4),
    Rule("lines", "n_dup_lines / n_lines", 0, 0.1, -1, 0.3),
    Rule("variety", "n_distinct_words / n_words", 0.35, 1, 0.2, 2),
    Rule("length", "word_chars / n_words", 3, 6.5, 2.5, 7.5),
    Rule("capitals", "n_capitals / word_chars", 0, 0.1, -1, 0.3),
    Rule("stops", "n_stops / n_words", 0.02, 0.2, 0.005, 0.5),
    Rule("shouts", "n_shouts / n_words", 0, 0.05, -1, 0.2),
)


def _with_repeat_places(df: DataFrame) -> DataFrame:
    """df with ``_p``: where windows that occur twice or more begin.  ``_x`` has a hash for each window.
    Every step is a column of its own: what a lambda mentions is computed anew for each element unless
    it is a column."""
    df = df.withColumn("_s", F.sort_array("_x"))
    df = df.withColumn("_again", F.array_distinct(F.filter("_s", lambda x, i: x == F.get("_s", i - 1))))
    df = df.withColumn("_pairs", F.when(F.size("_again") > FEW, F.sort_array(F.transform("_x", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda p, k: F.coalesce(p["h"] == F.get("_pairs", k)["h"], F.lit(False))
    by_sort = F.sort_array(F.transform(F.filter("_pairs", lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))
    by_lookup = F.filter(F.transform("_x", lambda x, i: F.when(F.array_contains("_again", x), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<int>")
    return df.withColumn("_p", F.when(F.size("_again") == 0, none).when(F.size("_again") > FEW, by_sort).otherwise(by_lookup))


def _covered() -> Column:
    """Words within the windows that begin at ``_p``: the next window covers what is left of this one."""
    return F.aggregate(F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)


def measures(df: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "_m") -> DataFrame:
    """The columns ``keep`` of df (all by default) and a struct column ``name`` with what the rules and the
    contract measure of each whole text.  While a text is measured, df's own columns are in a struct, so
    none of their names can clash with a helper's."""
    kept = df.columns if keep is None else keep
    row = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(0)
    t = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = df.select(row.alias("_row"), F.col(f"`{text}`").alias("_text"))
    out = out.withColumn("_w", words(F.col("_text"))).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    h = F.col("_h")
    out = out.withColumn("_x", F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    out = _with_repeat_places(out).withColumn("_l", lines)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    m = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        count("[#*$%&|<>]{2,}").alias("n_symbol_runs"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered().cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct_words"),
        count("\\p{Lu}").alias("n_capitals"),
        count("[.?!](?![^\\s])").alias("n_stops"),
        count("!").alias("n_shouts"),
        count(f"(?<![^{SPACE}])[^\\p{{L}}{SPACE}]++(?![^{SPACE}])").alias("n_bare_words"),  # without a letter
        count(f"[^\\p{{L}}\\p{{M}}\\p{{N}}{SPACE}.,;:!?)\"'](?![^{SPACE}])").alias("n_odd_endings"),  # in a character no sentence has there
    )
    return out.select("_row", m.alias("_m")).select(*([F.col("_row.*")] if kept else []), F.col("_m").alias(name))


def votes(m: str = "_m", rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of the rules' votes."""

    def measure(r: Rule) -> Column:
        over, under = (f"{m}.{x}" for x in r.measure.split(" / "))
        return F.when(F.col(under) > 0, F.col(over) / F.col(under))

    return F.array(*(r.vote(measure(r)) for r in rules))


@dataclass(frozen=True)
class Model:
    """Share of good texts; for each rule, how often it calls good and bad texts bad, when it votes."""

    good: float
    alarm: tuple[float, ...]
    recall: tuple[float, ...]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int = len(RULES), rounds: int = ROUNDS) -> Model:
    """EM on (votes, how many texts have them)."""
    s = PRIOR_TEXTS
    m = Model(GOOD, (ALARM,) * rules, (RECALL,) * rules)
    for _ in range(rounds):
        n = n_good = 0.0
        bad_votes, all_votes = ([[0.0, 0.0] for _ in range(rules)] for _ in range(2))  # about bad, about good texts
        for vote, count in patterns:
            p = posterior(m, vote)
            n, n_good = n + count, n_good + p * count
            for j, v in enumerate(vote):
                if v:
                    for y, share in enumerate((1 - p, p)):
                        all_votes[j][y] += share * count
                        bad_votes[j][y] += share * count * (v < 0)
        alarm, recall = [], []
        for b, a in zip(bad_votes, all_votes, strict=True):
            f, r = (b[1] + s * ALARM) / (a[1] + s), (b[0] + s * RECALL) / (a[0] + s)
            if f > r:
                f = r = (sum(b) + s * (ALARM + RECALL)) / (sum(a) + 2 * s)
            alarm.append(f)
            recall.append(r)
        m = Model((n_good + s * GOOD) / (n + s), tuple(alarm), tuple(recall))
    return m


def evidence(m: Model) -> list[tuple[float, float]]:
    """What a rule's vote (bad, good) adds to the log odds."""
    return [(math.log(f / r), math.log((1 - f) / (1 - r))) for f, r in zip(m.alarm, m.recall, strict=True)]


def posterior(m: Model, vote: tuple[int, ...]) -> float:
    odds = math.log(m.good / (1 - m.good)) + sum(e[v > 0] for v, e in zip(vote, evidence(m), strict=True) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def posterior_column(m: Model, vote: Column) -> Column:
    odds = F.lit(math.log(m.good / (1 - m.good)))
    for i, (bad, good) in enumerate(evidence(m)):
        odds = odds + F.when(vote[i] > 0, good).when(vote[i] < 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimated(voted: DataFrame, vote: str, rules: int = len(RULES)) -> Model:
    """The model of a table with an array column of votes."""
    rows = voted.groupBy(vote).count().collect()  # at most 3 ** rules
    return estimate(sorted((tuple(r[0]), r[1]) for r in rows), rules)


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all by default) and a struct of measures, votes, posterior, base_failed
    and kept, under the first free name from ``verdict`` on.  What is kept and measured is written once
    and read for both passes; the text is only written if it is among ``keep``."""
    kept = docs.columns if keep is None else keep
    name = free_name(docs, "verdict")
    m, v = free_name(docs, "_m"), free_name(docs, "_v")
    measured = measures(docs, text, kept, m)
    base = written(measured.withColumn(v, votes(m, rules)), "rules")
    p = posterior_column(estimated(base, v, len(rules)), F.col(v))
    failed = (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))
    verdict = F.struct(f"{m}.*", F.col(v).alias("votes"), p.alias("posterior"), failed.alias("base_failed"), (~failed & (p >= KEEP)).alias("kept"))
    return base.withColumn(name, verdict).drop(m, v)
