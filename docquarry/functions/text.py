"""Column functions on text: keys, n-grams, tokens, line classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as spelled out in every pattern: Java's \\s, RE2's and Python's differ.
WS = "[\\t\\n\\x0B\\f\\r ]"
CJK = "[\\x{4E00}-\\x{9FFF}]"

# What a line of a report may be besides content.
NOISE_LINES = ("目录", "目 录", "contents", "table of contents", "toc", "页码", "page", "本页无正文", "（本页无正文）", "(this page intentionally left blank)")
PAGE_NUMBER = "^[-—–]?[ \\t]*([0-9]{1,4}|第[ \\t]*[0-9]{1,4}[ \\t]*页|(page|p\\.?)[ \\t]*[0-9]{1,4})[ \\t]*[-—–]?$"
STRONG_LAYOUT = (
    "除另有标明外",
    "金额(均)?(以|按)?人民币",
    "单位[:：]?\\s*(人民币)?(百万元|千元|万元|元)",
    "止年度财务报表",
    "本集团\\s*本行",
    "截至\\s*(19|20)\\d{2}\\s*年(\\d{1,2}\\s*月)?\\s*\\d{1,2}\\s*日?止",
)
WEAK_LAYOUT = ("财务报表", "合并\\s*(利润表|资产负债表|现金流量表)", "列示", "人民币百万元")
NUMBER_UNITS = ("个百分点", "百万元", "千万元", "亿元", "千元", "万元", "万亿", "百万", "倍", "%", "万户", "万人", "家", "台", "个", "户", "笔", "人", "名", "次", "条", "项", "处", "件")
# Traditional characters frequent in company names, and their simplified forms.
TRADITIONAL, SIMPLIFIED = "銀華證東發國電網訊數據業務萬億總資產", "银华证东发国电网讯数据业务万亿总资产"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def cache_key(text: Column) -> Column:
    return F.lower(collapse(text))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text, white space collapsed, in lower case."""
    return F.sha2(cache_key(text).cast("binary"), 256)


def question_key(text: Column) -> Column:
    """What two askings of one question share."""
    bare = F.lower(F.regexp_replace(text, f"{WS}+", ""))
    return F.regexp_replace(bare, "^[？?。.]+|[？?。.]+$", "")


def without_separators(text: Column) -> Column:
    return F.translate(text, ",，  \n", "")


def reference(text: Column, length: int = 12) -> Column:
    """A short name of a text for logs."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def han_count(text: Column) -> Column:
    """Han characters; a text of single-byte characters has none and isn't searched."""
    return F.when(F.octet_length(text) == F.length(text), 0).otherwise(F.regexp_count(text, F.lit(CJK)))


def token_count(text: Column) -> Column:
    """Tokens as estimated: one for a Han character, one for four others, one for the others at least."""
    cjk = han_count(text)
    return (cjk + F.greatest(F.lit(1), F.floor((F.length(text) - cjk) / 4).cast("int"))).cast("int")


def bare(text: Column) -> Column:
    """Letters and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9\\x{4E00}-\\x{9FFF}]", "")


def char_ngrams(text: Column, low: int = 2, high: int = 5) -> Column:
    """Distinct runs of low to high letters and digits of the lower-cased text, anything else left out."""
    return F.array_distinct(_grams(bare(text), *range(low, high + 1)))


def bound(value: Column, f) -> Column:
    """f(value), value being computed once: a lambda computes what it mentions anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _grams(text: Column, *lengths: int) -> Column:
    """Runs of so many characters: cut from an array of characters, as a place in a string is found by counting."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")

    def cut(own: Column, n: int) -> Column:
        starts = F.slice(own, 1, F.greatest(F.size(own) - (n - 1), F.lit(0)))
        return starts if n == 1 else F.transform(starts, lambda c, i: F.concat(c, *(F.get(own, i + k) for k in range(1, n))))

    return bound(letters, lambda own: F.flatten(F.array(*(cut(own, n) for n in lengths))))


def tokens(text: Column) -> Column:
    """Words between white space; none in an empty text or null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WS}+"), lambda w: w != "")


def char_grams(text: Column, n: int) -> Column:
    """Distinct runs of n characters as they stand."""
    return F.array_distinct(_grams(text, n))


def bigrams(text: Column) -> Column:
    """Distinct pairs of characters, white space left out."""
    return F.array_distinct(_grams(F.regexp_replace(F.lower(text), f"{WS}+", ""), 2))


def dice(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct items."""
    return F.when(F.size(a) + F.size(b) > 0, 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(0.0)


def is_noise_line(line: Column) -> Column:
    """Page numbers, contents lines, single characters, rules: lines that say nothing."""
    return bound(strip(line), says_nothing)


def says_nothing(s: Column) -> Column:
    """is_noise_line of a line without white space at its ends."""
    return (
        (s == "")
        | F.lower(s).isin(*NOISE_LINES)
        | s.rlike(f"^[0-9.,\\-—–/\\\\%:：()（）\\t\\n\\x0B\\f\\r ]+$")
        | s.rlike("^第[ \\t]*[0-9]+[ \\t]*页$")
        | F.lower(s).rlike("^page[ \\t]*[0-9]+[ \\t]*(of[ \\t]*[0-9]+)?$")
        | s.rlike(f"^{CJK}$")
        | s.rlike("^[-—–_=*·~.\\t ]{2,}$")
    )


def is_page_number(line: Column) -> Column:
    return F.lower(strip(line)).rlike(PAGE_NUMBER)


def is_structural(content: Column, most_tokens: int = 90) -> Column:
    """Short blocks that are table heads or notes on layout."""
    strong = sum((content.rlike(p).cast("int") for p in STRONG_LAYOUT), F.lit(0))
    weak = sum((content.rlike(p).cast("int") for p in WEAK_LAYOUT), F.lit(0))
    return (strip(content) != "") & (token_count(content) <= most_tokens) & ((strong >= 1) | (weak >= 2))


def heading_level(line: Column) -> Column:
    """Level of a heading, null for other lines."""
    s = strip(line)
    numbered = F.regexp_extract(s, "^([0-9]{1,2}([.][0-9]{1,2}){0,3})[\\t ]+(.{1,60})$", 1)
    level = (
        F.when((F.length(s) <= 40) & (F.upper(s) == s) & (F.lower(s) != s), 1)
        .when(s.rlike("^第[一二三四五六七八九十百]+[章节部分篇][\\t ]*(.{1,40})$"), 1)
        .when(s.rlike("^[一二三四五六七八九十百]+、[\\t ]*(.{1,40})$"), 1)
        .when(numbered != "", F.length(numbered) - F.length(F.replace(numbered, F.lit("."), F.lit(""))) + 1)
        .when(s.rlike("^[（(][一二三四五六七八九十0-9]+[)）][\\t ]*(.{1,60})$"), 2)
    )
    return F.when((s != "") & (F.length(s) <= 80), level).cast("int")


def damaged(text: Column, least: int = 3, share: float = 0.01) -> Column:
    """Decoding went wrong: replacement characters or (cid:n) marks."""
    marked = F.regexp_replace(text, "\\(cid:[0-9]+\\)", "�")
    bad = F.regexp_count(marked, F.lit("�"))
    return (bad >= least) & (bad >= share * F.length(marked))


def number_phrases(text: Column, longest: int = 24) -> Column:
    """Numbers with a unit, each once, in order."""
    units = "|".join(NUMBER_UNITS)
    found = F.regexp_extract_all(text, F.lit(f"(?<![0-9,.])([0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\\.[0-9]+)?|[0-9]{{1,3}}(?:\\.[0-9]+)?)[\\t\\n ]*(?:{units})"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.substring(F.trim(p), 1, longest)))


def quoted_phrases(text: Column, low: int = 3, high: int = 60, most: int = 24) -> Column:
    """What stands in quotation marks or title marks."""
    found = F.regexp_extract_all(text, F.lit(f'"([^"]{{{low},{high}}})"|“([^”]{{{low},{high}}})”|《([^》]{{{low},{high}}})》'), F.lit(0))
    inner = F.transform(found, lambda p: F.substr(p, F.lit(2), F.length(p) - 2))
    return F.slice(F.array_distinct(F.filter(F.transform(inner, lambda p: F.trim(p)), lambda p: F.length(p) >= low)), 1, most)


def sentences(text: Column) -> Column:
    """Pieces that end with a full stop or the like."""
    return F.filter(F.transform(F.split(text, "(?<=[。；;!?！？])"), lambda s: strip(s)), lambda s: s != "")


def hard_pieces(text: Column, most: int) -> Column:
    """Pieces of so many characters."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / most).cast("int")), lambda i: F.substr(text, i * most + 1, F.lit(most))))


def simplified(text: Column) -> Column:
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def stem_key(filename: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(filename, "^.*[/\\\\]", ""), "[.][^.]*$", ""))


def first_year(text: Column) -> Column:
    found = F.regexp_extract(text, "(19|20)[0-9]{2}", 0)
    return F.when(found != "", found.cast("int"))


def is_injection(text: Column, keywords: tuple[str, ...] = ()) -> Column:
    """Looks like an attempt to override instructions."""
    low = F.lower(text)
    found = [low.rlike(p) for p in INJECTIONS] + [low.contains(k.lower()) for k in keywords if k]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


# What such attempts say.
INJECTIONS = (
    "ignore[\\t\\n ]+(all[\\t\\n ]+)?(previous|prior|above)[\\t\\n ]+instructions",
    "ignore[\\t\\n ]+your[\\t\\n ]+(system[\\t\\n ]+)?prompt",
    "disregard[\\t\\n ]+(all[\\t\\n ]+)?previous",
    "you[\\t\\n ]+are[\\t\\n ]+now[\\t\\n ]+(a[\\t\\n ]+)?(do[\\t\\n ]+)?anything|act[\\t\\n ]+as[\\t\\n ]+a[\\t\\n ]+",
    "system[\\t\\n ]+prompt|developer[\\t\\n ]+prompt|system[\\t\\n ]+instructions",
    "reveal[\\t\\n ]+your[\\t\\n ]+prompt|show[\\t\\n ]+your[\\t\\n ]+system",
    "泄露|公开.{0,6}(系统|system)?(提示词|指令|prompt)",
    "忽略(上面|之前|以上)?(所有)?.{0,8}(指令|规则|约束|prompt)",
    "从现在开始(你|系统).{0,10}(扮演|忽略)",
    "不要遵守|别管.{0,6}(上面|之前)",
    "绕过.{0,6}(限制|安全|审核)",
)
