"""Queries of the instruction-following family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import instructions as I
from evalspark.plans.base import Tables, query
from evalspark.plans.prepare import sql_strip

# (rule, n, m, relation, words, text)
RULES = [
    ("keywords:existence", 0, 0, "", ["the", "on"], ""),
    ("keywords:frequency", 3, 0, "at least", [], "th"),
    ("keywords:forbidden_words", 0, 0, "", ["and", "le"], ""),
    ("keywords:letter_frequency", 40, 0, "less than", [], "e"),
    ("length_constraints:number_words", 200, 0, "less than", [], ""),
    ("length_constraints:number_paragraphs", 1, 0, "", [], ""),
    ("length_constraints:nth_paragraph_first_word", 1, 1, "", [], "the"),
    ("detectable_content:number_placeholders", 1, 0, "", [], ""),
    ("detectable_content:postscript", 0, 0, "", [], "P.S."),
    ("detectable_format:number_bullet_lists", 0, 0, "", [], ""),
    ("detectable_format:constrained_response", 0, 0, "", [], ""),
    ("detectable_format:number_highlighted_sections", 1, 0, "", [], ""),
    ("detectable_format:multiple_sections", 1, 0, "", [], "in"),
    ("detectable_format:title", 0, 0, "", [], ""),
    ("combination:two_responses", 0, 0, "", [], ""),
    ("combination:repeat_prompt", 0, 0, "", [], "The"),
    ("startend:end_checker", 0, 0, "", [], "en."),
    ("startend:quotation", 0, 0, "", [], ""),
    ("change_case:english_capital", 0, 0, "", [], ""),
    ("change_case:english_lowercase", 0, 0, "", [], ""),
    ("punctuation:no_comma", 0, 0, "", [], ""),
]

B = sql_strip
CASES = {
    "keywords:existence": "regexp_matches(v, '(?i)the') AND regexp_matches(v, '(?i)on')",
    "keywords:frequency": "len(regexp_extract_all(v, '(?i)th')) >= 3",
    "keywords:forbidden_words": "NOT regexp_matches(v, '(?i)(^|[^\\p{L}\\p{N}_])(and|le)($|[^\\p{L}\\p{N}_])')",
    "keywords:letter_frequency": "length(v) - length(replace(lower(v), 'e', '')) < 40",
    "length_constraints:number_words": "len(regexp_extract_all(v, '[\\p{L}\\p{N}\\p{M}_]+')) < 200",
    "length_constraints:number_paragraphs": f"len(list_filter(string_split(v, '***'), lambda p: {B('p')} <> '')) = 1",
    "length_constraints:nth_paragraph_first_word": f"len(list_filter(string_split(v, chr(10) || chr(10)), lambda p: {B('p')} <> '')) = 1 AND {B('string_split(v, chr(10) || chr(10))[1]')} <> '' AND regexp_extract(lower({B('string_split(v, chr(10) || chr(10))[1]')}), '^([^\\s.,?!''\"]*)', 1) = 'the'",
    "detectable_content:number_placeholders": "regexp_matches(v, '\\[.*?\\]')",
    "detectable_content:postscript": "regexp_matches(lower(v), 'p\\.\\s?s\\.')",
    "detectable_format:number_bullet_lists": "len(regexp_extract_all(v, '(?m)^\\s*\\*[^\\*].*$')) + len(regexp_extract_all(v, '(?m)^\\s*-.*$')) = 0",
    "detectable_format:constrained_response": "contains(v, 'My answer is yes.') OR contains(v, 'My answer is no.') OR contains(v, 'My answer is maybe.')",
    "detectable_format:number_highlighted_sections": f"len(list_filter(regexp_extract_all(v, '\\*[^\\n\\*]*\\*'), lambda h: {B('''replace(h, '*', '')''')} <> '')) >= 1",
    "detectable_format:multiple_sections": "len(regexp_extract_all(v, '\\s?in\\s?[0-9]+\\s?')) >= 1",
    "detectable_format:title": "regexp_matches(v, '<<[^\\n]+>>')",
    "combination:two_responses": f"len(list_filter(string_split(v, '******'), lambda p: {B('p')} <> '')) = 2",
    "combination:repeat_prompt": f"starts_with(lower({B('v')}), 'the')",
    "startend:end_checker": f"ends_with(lower(trim({B('v')}, '\"')), 'en.')",
    "startend:quotation": f"length({B('v')}) > 1 AND starts_with({B('v')}, '\"') AND ends_with({B('v')}, '\"')",
    "change_case:english_capital": "upper(v) = v AND lower(v) <> v",
    "change_case:english_lowercase": "lower(v) = v AND upper(v) <> v",
    "punctuation:no_comma": "NOT contains(v, ',')",
}
FOLLOWS = f"{B('v')} <> '' AND CASE rule " + " ".join(f"WHEN '{k}' THEN {c}" for k, c in CASES.items()) + " END"
CHECK_SQL = f"""rules AS (SELECT unnest([{', '.join(f"'{r[0]}'" for r in RULES)}]) AS rule),
 lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
 plain AS (SELECT doc_id, [text, {B("array_to_string(list_slice(ls, 2, len(ls)), chr(10))")}, {B("array_to_string(list_slice(ls, 1, len(ls) - 1), chr(10))")}, {B("array_to_string(list_slice(ls, 2, len(ls) - 1), chr(10))")}] AS p FROM lines),
 vs AS (SELECT doc_id, unnest(range(8)) AS k, unnest(list_concat(p, list_transform(p, lambda x: replace(x, '*', '')))) AS v FROM plain),
 c AS (SELECT doc_id, k, rule, {FOLLOWS} AS ok FROM vs, rules),
 checked AS (SELECT doc_id, rule, bool_or(ok) FILTER (WHERE k = 0) AS strict, bool_or(ok) AS loose FROM c GROUP BY ALL)"""


def checked(t: Tables):
    lit = lambda r: F.struct(
        F.lit(r[0]).alias("rule"),
        F.struct(F.lit(r[1]).alias("n"), F.lit(r[2]).alias("m"), F.lit(r[3]).alias("relation"), F.array(*[F.lit(w) for w in r[4]]).cast("array<string>").alias("words"), F.lit(r[5]).alias("text")).alias("args"),
    )
    d = t.corpus.select("doc_id", "text", F.array(*[lit(r) for r in RULES]).alias("rules"))
    return I.check_rules(d, ["doc_id"], "text", "rules")


@query("instruction_checks", f"WITH {CHECK_SQL} SELECT doc_id, rule, strict, loose FROM checked")
def instruction_checks(t: Tables):
    return checked(t)


@query(
    "instruction_accuracy",
    f"""WITH {CHECK_SQL}, p AS (SELECT doc_id, min(strict::INT) AS ps, min(loose::INT) AS pl, sum(strict::INT) AS s, sum(loose::INT) AS l, count(*) AS k FROM checked GROUP BY doc_id)
        SELECT round(avg(ps), 6) AS prompt_level_strict_acc, round(sum(s) / sum(k), 6)::DOUBLE AS inst_level_strict_acc, round(avg(pl), 6) AS prompt_level_loose_acc, round(sum(l) / sum(k), 6)::DOUBLE AS inst_level_loose_acc FROM p""",
)
def instruction_accuracy(t: Tables):
    a = I.rule_accuracy(checked(t), ["doc_id"])
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])
