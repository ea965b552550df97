"""Text, number and label expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One CJK letter, one ASCII word run, or one other visible character.
UNIT = r"[一-鿿]|[a-zA-Z0-9_]+|[^\s]"
NUMBER = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?"
#: What is dropped before answers are compared.
DROPPED_IN_ANSWERS = r"[\s·•、，,。.;；:：()（）\"'“”‘’\-_/《》]+"
DROPPED_IN_SUPPORT = r"[\s\"'“”‘’=：:；;，,。()（）]+"
#: Chinese digits and units, what a numeral is written in, and an article's label.
CN_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CN_UNITS = {"十": 10, "百": 100, "千": 1000}
NUMERAL = r"[零〇一二三四五六七八九十百千\d]+"
ARTICLE = r"第[零〇一二三四五六七八九十百千万两\d]+条(?:之[零〇一二三四五六七八九十百千万两\d]+)?"
#: What a question's terms are not made of.
QUESTION_WORDS = "是如何定义的|如何定义|怎样定义|定义|是什么|是指什么|如何|怎样|怎么|哪些|什么|是否|应该|应当|计算|统计|请|根据|依据|说明|解释|分别|以及|并且|的|与|和|及|在|对|中"
#: Figures and obligations that a phrase stands or falls with.
CRITICAL_FIGURE = r"\d+(?:\.\d+)?%|\d+(?:\.\d+)?(?:年|个月|日|万元|亿元|倍)"
CRITICAL_DUTY = r"[一-鿿]{2,12}(?:不得|应当|必须|可以|属于|包括|不低于|不高于|不超过|至少)"


def let(col: Column, f: Callable[[Column], Column]) -> Column:
    """f(col), with col computed once."""
    return F.element_at(F.transform(F.array(col), f), 1)


def token_units(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))


def join_units(units: Column) -> Column:
    """Token units (see UNIT; none holds white space) as text again: a blank only between two ASCII words."""
    spaced = F.regexp_replace(F.array_join(units, "\n"), r"(?<=[a-zA-Z0-9_])\n(?=[a-zA-Z0-9_])", " ")
    return F.replace(spaced, F.lit("\n"), F.lit(""))


def token_count(text: Column) -> Column:
    """C4: number of token units; null counts 0."""
    return F.size(token_units(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def numbers(text: Column) -> Column:
    """All numbers in a text as doubles, thousands separators removed."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def normalize_answer(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\[\d+\]", "")
    return F.regexp_replace(plain, DROPPED_IN_ANSWERS, "")


def normalize_support(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)<br\s*/?>", "")
    return F.lower(F.regexp_replace(plain, DROPPED_IN_SUPPORT, ""))


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def bigrams(text: Column) -> Column:
    """Every two neighbouring characters, repeats kept."""
    pairs = lambda c: F.when(F.size(c) >= 2, F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return let(F.split(text, ""), pairs)


def bigram_set(text: Column) -> Column:
    return F.array_distinct(bigrams(text))


def bigram_support(expected: Column, actual: Column) -> Column:
    """1 if contained, else the share of the phrase's bigrams found in the text."""

    def of(e: Column, a: Column) -> Column:
        grams = bigrams(e)
        hits = let(grams, lambda g: F.size(F.filter(g, lambda x: F.contains(a, x))) / F.size(g))
        return F.when(F.char_length(e) == 0, 0.0).when(F.contains(a, e), 1.0).when(F.char_length(e) == 1, 0.0).otherwise(hits)

    return let(F.struct(normalize_support(expected).alias("e"), normalize_support(actual).alias("a")), lambda s: of(s["e"], s["a"]))


def anchor_coverage(anchor: Column, text: Column) -> Column:
    """Share of an anchor's distinct bigrams that a text has."""

    def of(a: Column, t: Column) -> Column:
        ga = bigram_set(a)
        hits = F.size(F.array_intersect(ga, bigram_set(t))) / F.greatest(F.size(ga), F.lit(1))
        return F.when((F.char_length(a) == 0) | (F.char_length(t) == 0), 0.0).when(F.contains(t, a), 1.0).otherwise(hits)

    return let(F.struct(squeeze(anchor).alias("a"), squeeze(text).alias("t")), lambda s: of(s["a"], s["t"]))


def text_score(gold: Column, answer: Column) -> Column:
    """1 for containment either way, else 0.7 recall + 0.3 precision of bigram sets."""

    def of(g: Column, a: Column) -> Column:
        back = F.contains(g, a) & (F.char_length(a) >= F.greatest(F.lit(8), F.floor(F.char_length(g) / 3)))

        def mixed(s: Column) -> Column:
            both = F.size(F.array_intersect(s["gg"], s["ga"]))
            return F.when(F.size(s["gg"]) == 0, 0.0).otherwise(0.7 * both / F.size(s["gg"]) + 0.3 * both / F.greatest(F.size(s["ga"]), F.lit(1)))

        grams = let(F.struct(bigram_set(g).alias("gg"), bigram_set(a).alias("ga")), mixed)
        return F.when((F.char_length(g) == 0) | (F.char_length(a) == 0), 0.0).when(F.contains(a, g) | back, 1.0).otherwise(grams)

    return let(F.struct(normalize_answer(gold).alias("g"), normalize_answer(answer).alias("a")), lambda s: of(s["g"], s["a"]))


def number_match(gold: Column, answer: Column) -> Column:
    """Any gold number within max(0.01, 0.1 %) of any answer number."""
    near = lambda g, a: F.abs(g - a) <= F.greatest(F.lit(0.01), F.abs(g) * 0.001)
    return let(F.struct(numbers(gold).alias("g"), numbers(answer).alias("a")), lambda s: F.exists(s["g"], lambda g: F.exists(s["a"], lambda a: near(g, a))))


def numeral(label: Column) -> Column:
    """C14: a Chinese or Arabic numeral as an integer; anything else null."""
    values = F.create_map(*[F.lit(x) for d in (CN_DIGITS, CN_UNITS) for kv in d.items() for x in kv])
    text = F.trim(label)
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("current"))

    def step(acc: Column, c: Column) -> Column:
        unit = c.isin(*CN_UNITS)
        value = F.coalesce(values[c], F.lit(0))
        total = F.when(unit, acc["total"] + F.when(acc["current"] == 0, 1).otherwise(acc["current"]) * value).otherwise(acc["total"])
        current = F.when(unit, 0).when(c.isin(*CN_DIGITS), value).otherwise(acc["current"])
        return F.struct(total.alias("total"), current.alias("current"))

    chinese = F.aggregate(F.split(text, ""), zero, step, lambda a: a["total"] + a["current"])
    return F.when(text.rlike(r"^\d+$"), F.expr("1") * text.try_cast("int")).when(text.rlike("^[零〇一二三四五六七八九十百千]+$"), chinese)


def normalize_value(text: Column) -> Column:
    """C20: a cell as a number: separators removed, percent as a ratio, dashes and words null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    percent = F.regexp_extract(plain, r"^([-+]?\d+(?:\.\d+)?)[%％]$", 1)
    return F.when(percent != "", percent.try_cast("double") / 100).when(plain.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """D3: cosine similarity; unequal lengths or a zero norm give 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    def of(s: Column) -> Column:
        x, y = s["x"], s["y"]
        norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when((F.size(x) != F.size(y)) | (norms == 0), 0.0).otherwise(dot(x, y) / norms)

    return F.coalesce(let(F.struct(a.alias("x"), b.alias("y")), of), F.lit(0.0))


def question_terms(text: Column, limit: int = 32) -> Column:
    """Quoted entities, phrases of at most 18 characters, longer ones as 4-character shingles."""
    quoted = F.regexp_extract_all(text, F.lit("[“\"‘']([^”\"’']{2,40})[”\"’']"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(text, "《[^》]*》", " "), QUESTION_WORDS, " ")
    phrases = F.regexp_extract_all(plain, F.lit(r"[一-鿿A-Za-z0-9_]{2,}"), F.lit(0))
    shingles = F.flatten(F.transform(phrases, lambda p: F.when(F.char_length(p) <= 18, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(p) - 3), lambda i: F.substr(p, i, F.lit(4))))))
    return F.slice(F.array_distinct(F.concat(quoted, shingles)), 1, limit)


def critical_terms(text: Column) -> Column:
    """Figures with a unit and phrases of duty in a text, distinct."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (CRITICAL_FIGURE, CRITICAL_DUTY)])
    return F.array_distinct(F.filter(found, lambda t: F.char_length(normalize_support(t)) >= 2))


def term_coverage(terms: Column, text: Column) -> Column:
    """Share of terms found in a text; no terms give 0."""
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(text, t))) / F.size(terms)).otherwise(0.0)


def statement_coverage(statements: Column, text: Column, terms: Callable[[Column], Column] = question_terms) -> Column:
    """D17, by statements: the greatest coverage of one statement's own terms; no statements give 0."""
    return F.coalesce(F.array_max(F.transform(statements, lambda s: term_coverage(terms(s), text))), F.lit(0.0))


def title_hits(terms: Column, filename: Column, section: Column) -> Column:
    """D17, by titles: how many terms the file name and section hold."""
    return F.size(F.filter(terms, lambda t: F.contains(F.concat_ws(" ", filename, section), t)))


def excerpt(text: Column, n: int = 1200) -> Column:
    """Whole sentences up to n characters; a first sentence that is longer is cut."""
    sentences = F.regexp_extract_all(F.trim(text), F.lit(r"(?s).+?(?:[。！？!?；;]|$)"), F.lit(0))
    kept = F.aggregate(
        sentences, F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        lambda a, s: F.when(a["full"] | (F.char_length(a["t"]) + F.char_length(s) > n), F.struct(a["t"].alias("t"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(a["t"], s).alias("t"), F.lit(False).alias("full"))),
        lambda a: a["t"],
    )
    return F.when(F.char_length(text) <= n, text).otherwise(let(kept, lambda k: F.when(k == "", F.substring(text, 1, n)).otherwise(F.trim(k))))
