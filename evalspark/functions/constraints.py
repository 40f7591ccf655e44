"""Checks of verifiable instructions as one Column expression per rule.

A rule row carries its arguments: ``n``, ``m`` (numbers), ``relation``, ``words`` (array), ``text``.
Sentences are counted by their end marks and capital words by word characters; the language rule is
left open (NULL) because no language identifier is part of the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.answers import valid_json
from evalspark.functions.text import bind, strip

# The answers the constrained-response rule allows.
CONSTRAINED = ["My answer is yes.", "My answer is no.", "My answer is maybe."]


def _count(v: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)))


def _relation(count: Column, a: Column) -> Column:
    return F.when(a["relation"] == "less than", count < a["n"]).otherwise(count >= a["n"])


def _blank(v: Column) -> Column:
    return ~v.rlike(r"(?U)[^\s\x1c-\x1f]")


def _edge_trimmed(parts: Column, check) -> Column:
    """Apply ``check`` to the non-blank parts; a blank part that is not first or last fails."""
    n = F.size(parts)
    marked = F.transform(parts, lambda p, i: F.struct(p.alias("p"), (_blank(p) & (i > 0) & (i < n - 1)).alias("hole")))
    full = F.filter(parts, lambda p: ~_blank(p))
    return ~F.exists(marked, lambda x: x["hole"]) & check(full)


def _highlights(v: Column) -> Column:
    single = F.filter(F.regexp_extract_all(v, F.lit(r"\*[^\n\*]*\*"), F.lit(0)), lambda h: strip(F.replace(h, F.lit("*"), F.lit(""))) != "")
    double = F.filter(F.regexp_extract_all(v, F.lit(r"\*\*([^\n\*]*)\*\*"), F.lit(1)), lambda h: ~_blank(h))
    return F.size(single) + F.size(double)


def _first_word(v: Column, a: Column) -> Column:
    def check(parts: Column) -> Column:
        full = F.size(F.filter(parts, lambda p: ~_blank(p)))
        para = strip(F.try_element_at(parts, a["m"]))
        word = F.regexp_replace(F.regexp_extract(para, r"(?U)^(\S+)", 1), "^'*\"*", "")
        first = F.lower(F.regexp_extract(word, "^([^.,?!'\"]*)", 1))
        return (a["m"] <= full) & (F.coalesce(para, F.lit("")) != "") & (full == a["n"]) & (first == a["text"])

    return bind(F.split(v, "\n\n", -1), check)


def _postscript(v: Column, a: Column) -> Column:
    low = F.lower(v)
    other = F.contains(low, F.lower(a["text"]))
    return F.when(a["text"] == "P.P.S", low.rlike(r"p\.\s?p\.\s?s")).when(a["text"] == "P.S.", low.rlike(r"p\.\s?s\.")).otherwise(other)


def _json(v: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(strip(v), r"^```(json|Json|JSON)?", ""), r"```\z", "")
    return valid_json(strip(body)) == 1.0


def _sections(v: Column, a: Column) -> Column:
    return F.size(F.regexp_extract_all(v, F.concat(F.lit(r"(?U)\s?"), a["text"], F.lit(r"\s?\d+\s?")), F.lit(0))) >= a["n"]


def _any_word(v: Column, words: Column, left: str, right: str) -> Column:
    return F.exists(words, lambda w: F.regexp_like(v, F.concat(F.lit(left), w, F.lit(right))))


RULES = {
    "keywords:existence": lambda v, a: F.forall(a["words"], lambda w: F.regexp_like(v, F.concat(F.lit("(?iu)"), w))),
    "keywords:frequency": lambda v, a: _relation(F.size(F.regexp_extract_all(v, F.concat(F.lit("(?iu)"), a["text"]), F.lit(0))), a),
    "keywords:forbidden_words": lambda v, a: ~_any_word(v, a["words"], r"(?iU)\b", r"\b"),
    "keywords:letter_frequency": lambda v, a: _relation(F.length(v) - F.length(F.replace(F.lower(v), a["text"], F.lit(""))), a),
    "language:response_language": lambda v, a: F.lit(None).cast("boolean"),
    "length_constraints:number_sentences": lambda v, a: _relation(_count(v, r"[^.!?\s][^.!?]*[.!?]+(?=\s|\z)|[^.!?\s][^.!?]*\z"), a),
    "length_constraints:number_paragraphs": lambda v, a: bind(F.split(v, r"(?U)\s?\*\*\*\s?", -1), lambda p: _edge_trimmed(p, lambda f: F.size(f) == a["n"])),
    "length_constraints:number_words": lambda v, a: _relation(_count(v, r"(?U)\w+"), a),
    "length_constraints:nth_paragraph_first_word": _first_word,
    "detectable_content:number_placeholders": lambda v, a: _count(v, r"\[.*?\]") >= a["n"],
    "detectable_content:postscript": _postscript,
    "detectable_format:number_bullet_lists": lambda v, a: _count(v, r"(?m)^\s*\*[^\*].*$") + _count(v, r"(?m)^\s*-.*$") == a["n"],
    "detectable_format:constrained_response": lambda v, a: F.exists(F.array(*[F.lit(x) for x in CONSTRAINED]), lambda x: F.contains(v, x)),
    "detectable_format:number_highlighted_sections": lambda v, a: _highlights(v) >= a["n"],
    "detectable_format:multiple_sections": _sections,
    "detectable_format:json_format": lambda v, a: _json(v),
    "detectable_format:title": lambda v, a: F.exists(F.regexp_extract_all(v, F.lit(r"<<[^\n]+>>"), F.lit(0)), lambda x: ~_blank(F.regexp_replace(F.regexp_replace(x, "^<+", ""), ">+$", ""))),
    "combination:two_responses": lambda v, a: bind(
        F.split(v, r"\*\*\*\*\*\*", -1), lambda p: _edge_trimmed(p, lambda f: (F.size(f) == 2) & (strip(F.try_element_at(f, F.lit(1))) != strip(F.try_element_at(f, F.lit(2)))))
    ),
    "combination:repeat_prompt": lambda v, a: F.lower(strip(v)).startswith(F.lower(strip(a["text"]))),
    "startend:end_checker": lambda v, a: F.lower(F.regexp_replace(strip(v), '^"+|"+$', "")).endswith(F.lower(strip(a["text"]))),
    "startend:quotation": lambda v, a: (F.length(strip(v)) > 1) & strip(v).startswith('"') & strip(v).endswith('"'),
    "change_case:capital_word_frequency": lambda v, a: _relation(
        F.size(F.filter(F.regexp_extract_all(v, F.lit(r"[\p{L}\p{N}'-]+"), F.lit(0)), lambda w: (F.upper(w) == w) & (F.lower(w) != w))), a
    ),
    "change_case:english_capital": lambda v, a: ~v.rlike("[a-z]") & (F.upper(v) == v) & (F.lower(v) != v),  # most texts are told by their first letter
    "change_case:english_lowercase": lambda v, a: ~v.rlike("[A-Z]") & (F.lower(v) == v) & (F.upper(v) != v),
    "punctuation:no_comma": lambda v, a: ~F.contains(v, F.lit(",")),
}


def follows(value: Column, rule: Column, args: Column) -> Column:
    """Whether a response follows a rule; a blank response follows none."""
    cases = None
    for name, check in RULES.items():
        ok = check(value, args)
        cases = F.when(rule == name, ok) if cases is None else cases.when(rule == name, ok)
    known = rule != "language:response_language"
    return F.when(_blank(value), F.lit(False)).otherwise(F.when(known, F.coalesce(cases, F.lit(False))))


def loose_variants(value: Column) -> Column:
    """The response with and without its first line, last line, and asterisks: up to eight different
    texts, the response itself first."""
    lines = F.split(value, "\n", -1)

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        join = lambda frm, count: strip(F.array_join(F.slice(ls, F.lit(frm), F.greatest(count, F.lit(0))), "\n"))
        plain = F.array(value, join(2, n - 1), join(1, n - 1), join(2, n - 2))
        return F.array_distinct(F.concat(plain, F.transform(plain, lambda x: F.replace(x, F.lit("*"), F.lit("")))))

    return bind(lines, cut)
