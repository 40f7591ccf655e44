"""Scores of one generated answer against references, as Column expressions."""

from __future__ import annotations

from string import digits, punctuation

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.text import answer_key, bind, split_words, strip, strip_punctuation
from evalspark.registry import METRICS


@METRICS.add("exact_match", output="generate_until", higher_is_better=True)
def exact_match(pred: Column, ref: Column, ignore: list[str] | None = None, ignore_case: bool = False,
                ignore_punctuation: bool = False, ignore_numbers: bool = False) -> Column:
    """1.0 when equal after the chosen clean-up (patterns, case, punctuation, digits)."""

    def tidy(c: Column) -> Column:
        for pattern in ignore or []:
            c = F.regexp_replace(c, "(?U)" + pattern, "")
        if ignore_case:
            c = F.lower(c)
        if ignore_punctuation:
            c = F.translate(c, punctuation, "")
        return F.translate(c, digits, "") if ignore_numbers else c

    return (tidy(pred) == tidy(ref)).cast("double")


def any_match(pred: Column, refs: Column, **options) -> Column:
    """1.0 when any reference matches."""
    return F.exists(refs, lambda r: exact_match(pred, r, **options) > 0).cast("double")


def answer_equal(pred: Column, ref: Column, lang: Column | str = "en") -> Column:
    """Equality of the comparison forms (case, punctuation, articles, blanks ignored)."""
    return (answer_key(pred, lang) == answer_key(ref, lang)).cast("double")


def contains_any(pred: Column, labels: Column) -> Column:
    """Whether any label occurs in the prediction, ignoring case."""
    low = F.lower(pred)
    return F.exists(labels, lambda x: F.contains(low, F.lower(x))).cast("double")


def contains_ref(pred: Column, ref: Column, lang: str = "en") -> Column:
    """Whether the normalised reference is a part of the normalised prediction."""
    return F.contains(answer_key(pred, lang), answer_key(ref, lang)).cast("double")


def found_share(pred: Column, refs: Column) -> Column:
    """Share of references that occur in the prediction, ignoring case."""
    low = F.lower(pred)
    return F.size(F.filter(refs, lambda r: F.contains(low, F.lower(r)))) / F.size(refs)


def number_hits(pred: Column, number: Column) -> Column:
    """Share of the numbers in the prediction that equal the expected one."""
    found = F.regexp_extract_all(pred, F.lit(r"\d+"), F.lit(0))
    return bind(found, lambda n: F.when(F.size(n) > 0, F.size(F.filter(n, lambda x: x == number)) / F.size(n)).otherwise(0.0))


def class_score(pred: Column, gold: Column, classes: Column) -> Column:
    """One over the number of class names in the prediction when the gold one is among them.

    Names that are a part of the gold name do not count, except directly after a removed one (the
    list is shortened while it is walked).
    """
    named = F.filter(classes, lambda c: F.contains(pred, c))

    def walk(state: Column, c: Column) -> Column:
        drop = F.contains(gold, c) & (c != gold) & ~state["skip"]
        return F.struct(F.when(drop, state["n"] - 1).otherwise(state["n"]).alias("n"), drop.alias("skip"))

    def score(m: Column) -> Column:
        left = F.aggregate(m, F.struct(F.size(m).alias("n"), F.lit(False).alias("skip")), walk)["n"]
        return F.when(F.array_contains(m, gold), 1.0 / left).otherwise(0.0)

    return bind(named, score)


def first_code_line(text: Column) -> Column:
    """First line without a back-tick, ``#`` or ``//``."""
    lines = F.split(F.regexp_replace(text, "^\n+", ""), "\n", -1)
    plain = F.filter(lines, lambda x: ~F.contains(x, F.lit("`")) & ~F.contains(x, F.lit("#")) & ~F.contains(x, F.lit("//")))
    return F.coalesce(F.try_element_at(plain, F.lit(1)), F.lit(""))


def clean_length(text: Column) -> Column:
    """Words of a text without punctuation."""
    return F.size(split_words(strip_punctuation(text))).cast("double")


def emotion_score(response: Column, names: Column, scores: Column) -> Column:
    """``struct<eqbench, percent_parseable>``: distance of four rated emotions from the reference.

    Unequal names give zero. Distances up to five are scaled by an S-curve, larger ones count whole.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all(response, F.lit(r"(?U)(\w+):\s+(\d+)"), F.lit(1)).alias("k"),
        F.regexp_extract_all(response, F.lit(r"(?U)(\w+):\s+(\d+)"), F.lit(2)).alias("v"),
    )

    def score(p: Column) -> Column:
        keys = F.array_distinct(F.transform(p, lambda x: x["k"]))
        rated = lambda name: F.element_at(F.filter(p, lambda x: x["k"] == name), -1)["v"].cast("double")
        same = (F.size(keys) == 4) & (F.size(F.array_intersect(keys, names)) == 4)

        def scaled(name: Column, i: Column) -> Column:
            d = F.abs(rated(name) - F.element_at(scores, i + 1).cast("double"))
            return F.when(d == 0, 0.0).when(d <= 5, 6.5 / (1 + F.exp(-1.2 * (d - 4)))).otherwise(d)

        total = F.aggregate(F.transform(names, scaled), F.lit(0.0), lambda a, b: a + b)
        return F.struct(
            F.when(same, (10 - total * 0.7477) * 10).otherwise(0.0).alias("eqbench"), F.when(same, 100.0).otherwise(0.0).alias("percent_parseable")
        )

    return bind(pairs, score)


# Fixed value: ASCII punctuation and whitespace except the percent sign, trimmed from an answer's end.
END_MARKS = r"[!-$&-/:-@\[-`\{-~\s]+$"


def relaxed_match(pred: Column, target: Column, tolerance: float = 0.05) -> Column:
    """Numbers within five percent (a percent sign may scale either side), letters by the first
    character, other texts by equality without end punctuation."""

    def tidy(c: Column) -> Column:
        cut = F.regexp_replace(c, END_MARKS, "")
        plain = F.regexp_replace(F.regexp_replace(F.lower(strip(cut)), r"(?U)\s+", " "), "^$", "")
        return F.when(c.rlike("[0-9]"), F.replace(F.replace(cut, F.lit(","), F.lit("")), F.lit("$"), F.lit(""))).otherwise(plain)

    number = lambda c: F.regexp_replace(strip(c), "%+$", "").try_cast("double")
    percent = lambda c: strip(c).endswith("%")

    def close(a: Column, b: Column) -> Column:
        return F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-10)) <= tolerance

    def judge(x: Column) -> Column:
        p, t = x["p"], x["t"]
        a, b = number(p), number(t)
        scale = lambda v, c: F.when(percent(c), v / 100).otherwise(v)
        numeric = close(a, b) | ((percent(p) | percent(t)) & (close(scale(a, p), b) | close(a, scale(b, t))))
        letter = t.rlike(r"^\p{L}$") & (F.length(p) > 0)
        text = F.lower(F.regexp_replace(p, r"[!-/:-@\[-`\{-~]+$", "")) == F.lower(t)
        return F.when(a.isNotNull() & b.isNotNull(), numeric).when(letter, F.lower(F.substring(p, 1, 1)) == F.lower(t)).otherwise(text).cast("double")

    return bind(F.struct(tidy(pred).alias("p"), tidy(target).alias("t")), judge)


def final_answer_part(text: Column) -> Column:
    """What follows the last ``answer:`` (bold marks removed), or the whole text."""
    t = F.regexp_replace(text, r"([aA]nswer)\**:\**", "$1:")
    tail = F.regexp_extract(t, r"(?is)^.*answer:(.*)$", 1)
    return strip(F.when(F.contains(F.lower(t), F.lit("answer:")), tail).otherwise(t))


def substitution_precision(response: Column, words: Column, freqs: Column, limit: int = 10) -> Column:
    """``struct<prec, has_answer, has_gold>`` of up to ten comma-separated substitutes of the first line.

    Each is worth the number of annotators who gave it; the sum is divided by all annotations.
    """
    parts = F.transform(F.filter(F.split(F.substring_index(response, "\n", 1), ",", -1), lambda x: x != ""), strip)

    def score(a: Column) -> Column:
        n = F.size(a)
        tidy = F.transform(a, lambda w, i: F.when(i == n - 1, F.regexp_replace(w, r"[^\p{L}]", "")).otherwise(w))
        worth = lambda w: F.coalesce(F.try_element_at(freqs, F.array_position(words, w).cast("int")), F.lit(0))
        hits = F.aggregate(
            F.filter(tidy, lambda w: F.array_contains(words, w)), F.lit(0.0), lambda acc, w: acc + worth(w)
        )
        total = F.aggregate(freqs, F.lit(0.0), lambda x, y: x + y)
        return F.struct(
            F.when(total > 0, hits / total).otherwise(hits).alias("prec"), (n > 0).cast("long").alias("has_answer"), (F.size(words) > 0).cast("long").alias("has_gold")
        )

    return bind(F.slice(parts, 1, limit), score)


# Entity classes and the class of a missed entity.
ENTITY_CLASS = {"PER": 0, "LOC": 1, "ORG": 2}
NO_ENTITY = "&&NOENT&&"


def entity_pairs(response: Column) -> Column:
    """``text$TYPE,text$TYPE`` as ``array<struct<text, type>>``."""
    items = F.transform(F.split(response, ",", -1), lambda r: F.split(strip(r), r"\$", -1))
    pairs = F.transform(items, lambda p: F.struct(F.element_at(p, 1).alias("text"), F.upper(F.coalesce(F.try_element_at(p, F.lit(2)), F.lit(""))).alias("type")))
    return F.when(F.contains(response, F.lit(NO_ENTITY)), F.array().cast("array<struct<text:string,type:string>>")).otherwise(F.filter(pairs, lambda p: p["text"] != ""))


def entity_alignment(found: Column, gold: Column) -> Column:
    """``array<struct<pred, gold>>`` class pairs: a gold entity found with its type keeps its class, a
    missed one becomes 3 (0 when there are more answers than entities), each surplus answer is (2, 3)."""
    cls = F.create_map(*[F.lit(x) for p in ENTITY_CLASS.items() for x in p])

    def align(x: Column) -> Column:
        f, g = x["f"], x["g"]
        surplus = F.size(f) - F.size(g)
        missed = F.when(surplus > 0, 0).otherwise(3)
        pairs = F.transform(g, lambda e: F.struct(F.when(F.array_contains(f, e), F.element_at(cls, e["type"])).otherwise(missed).alias("pred"), F.element_at(cls, e["type"]).alias("gold")))
        extra = F.when(surplus > 0, F.array_repeat(F.struct(F.lit(2).alias("pred"), F.lit(3).alias("gold")), F.greatest(surplus, F.lit(0)))).otherwise(
            F.array().cast("array<struct<pred:int,gold:int>>")
        )
        none = F.array(F.struct(F.lit(3).alias("pred"), F.lit(3).alias("gold")))
        return F.when((F.size(f) == 0) & (F.size(g) == 0), none).otherwise(F.concat(pairs, extra))

    return bind(F.struct(found.alias("f"), gold.alias("g")), align)


def part_scores(pred: Column, parts: Column, golds: Column) -> Column:
    """Scores of a multi-part answer given as ``'part': 'text'`` pairs; a blank gold always counts."""

    def one(part: Column, i: Column) -> Column:
        found = F.regexp_extract_all(pred, F.concat(F.lit("['\"]"), part, F.lit("['\"]: ['\"]([^'\"]*)['\"]")), F.lit(1))
        got = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
        gold = strip(F.element_at(golds, i + 1))
        return F.when(gold == "", 1.0).otherwise((strip(got) == gold).cast("double"))

    return F.transform(parts, one)


def valid_json(text: Column) -> Column:
    """1.0 when the whole text is one JSON value.

    The parser stops after a first value, so the text is tried inside an array and inside an object:
    nothing but a single value fits both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    return (listed.isNotNull() & named.isNotNull()).cast("double")


def leave_one_out(scores: Column) -> Column:
    """Mean over references of the best score among the other references; a lone score stays."""
    def mean(s: Column) -> Column:
        k = F.size(s)
        top = F.element_at(s, 1)
        return F.when(k == 1, top).otherwise(((k - 1) * top + F.try_element_at(s, F.lit(2))) / k)

    return bind(F.sort_array(scores, asc=False), mean)
