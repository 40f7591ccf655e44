"""Answer extraction from generated text, as Column expressions.

Every function maps one response to one filtered response; filter sequences compose them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalspark.functions.templates import letter_mark
from evalspark.functions.text import bind, lstrip, strip

INVALID = "[invalid]"
NUMBER_ANSWER = r"#### (\-?[0-9\.\,]+)"


def _all_matches(text: Column, pattern: str | Column, groups: int) -> Column:
    """What find-all returns, with a tuple reduced to its first non-empty group (NULL when all are empty)."""
    p = F.lit("(?U)" + pattern) if isinstance(pattern, str) else pattern
    if groups <= 1:
        return F.regexp_extract_all(text, p, F.lit(groups))
    each = F.arrays_zip(*[F.regexp_extract_all(text, p, F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)])
    return F.transform(each, lambda z: F.coalesce(*[F.nullif(z[f"g{g}"], F.lit("")) for g in range(1, groups + 1)]))


def _pick(matches: Column, select: int) -> Column:
    return strip(F.try_element_at(matches, F.lit(select + 1 if select >= 0 else select)))


def regex_answer(text: Column, pattern: str = NUMBER_ANSWER, group_select: int = 0, fallback: str = INVALID) -> Column:
    """The selected match (negative counts from the end), stripped; the fallback when there is none."""
    return F.coalesce(_pick(_all_matches(text, pattern, re.compile(pattern).groups), group_select), F.lit(fallback))


def pos_tags(text: Column, fallback: list[str] | None = None) -> Column:
    """Tags of ``('token', 'TAG')`` pairs."""
    tags = F.regexp_extract_all(text, F.lit(r"\('([^']*)', '([^']*)'\)"), F.lit(2))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(*[F.lit(x) for x in fallback or ["invalid"]]))


def quote_pattern(text: Column) -> Column:
    """Literal text as a regular expression."""
    return F.regexp_replace(text, r"([\\.\^\$\|\?\*\+\(\)\[\]\{\}])", r"\\$1")


def choice_answer(
    text: Column,
    choices: Column,
    pattern: str = NUMBER_ANSWER,
    group_select: int = 0,
    fallback: str = INVALID,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    regexes_to_ignore: list[str] | None = None,
) -> Column:
    """``(A)``-style answer: the pattern, else a choice's own text, else a letter after a colon.

    The alternation of the choice texts is built per row, so the leftmost occurrence wins and the
    earlier choice wins at one position.
    """

    def ignored(c: Column) -> Column:
        for r in regexes_to_ignore or []:
            c = F.regexp_replace(c, r, "")
        if ignore_case:
            c = F.lower(c)
        return F.regexp_replace(c, r"\p{P}", "") if ignore_punctuation else c

    letters = F.transform(choices, lambda c, i: letter_mark(i))
    texts = F.transform(choices, lambda c: ignored(strip(c)))
    by_pattern = _pick(_all_matches(text, pattern, re.compile(pattern).groups), group_select)
    found = _pick(F.regexp_extract_all(ignored(text), F.array_join(F.transform(texts, quote_pattern), "|"), F.lit(0)), group_select)
    last_at = F.size(texts) - F.array_position(F.reverse(texts), found) + 1
    by_text = F.when(F.array_contains(texts, found), F.concat(F.lit("("), F.element_at(letters, F.greatest(last_at, F.lit(1)).cast("int")), F.lit(")"))).otherwise(found)
    letter = _pick(F.regexp_extract_all(text, F.concat(F.lit(r"(?U):[\s]*("), F.array_join(F.reverse(letters), "|"), F.lit(")")), F.lit(1)), group_select)
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(by_pattern), some(by_text), F.concat(F.lit("("), some(letter), F.lit(")")), F.lit(fallback))


# Words that name an entity type, replaced in this order.
ENTITY_WORDS = {
    "person": "PER",
    "location": "LOC",
    "organization": "ORG",
    "counties": "LOC",
    "places": "LOC",
    "people": "PER",
    "persons": "PER",
    "company": "ORG",
    "country": "LOC",
    "continent": "LOC",
    "time": "DATE",
    "date": "DATE",
    "per": "PER",
    "loc": "LOC",
    "org": "ORG",
}


def entity_spans(text: Column) -> Column:
    """Named entities as ``label: value $ label: value``; lists are split and ``none`` dropped."""
    t = F.lower(text)
    for word, label in ENTITY_WORDS.items():
        t = F.replace(t, F.lit(word), F.lit(label))
    t = strip(F.replace(F.rtrim(F.replace(t, F.lit("$$"), F.lit("$")), F.lit("$")), F.lit("\n"), F.lit("$")))
    pattern = F.lit(r"(?U)\b(PER|LOC|ORG|DATE):\s*([^$]+)")
    found = F.arrays_zip(
        F.regexp_extract_all(t, pattern, F.lit(1)).alias("label"), F.regexp_extract_all(t, pattern, F.lit(2)).alias("values")
    )
    listed = F.flatten(
        F.transform(
            found,
            lambda f: F.transform(
                F.filter(F.transform(F.split(f["values"], ",", -1), strip), lambda v: F.lower(v) != "none"),
                lambda v: F.concat(F.lower(f["label"]), F.lit(": "), v),
            ),
        )
    )
    return F.array_join(listed, " $ ")


def cut_generation(text: Column, stops: list[str] | None = None, think_end: str | None = None) -> Column:
    """Text before the first of each stop sequence, then after the last end-of-thinking mark."""
    for s in stops or []:
        if s:
            text = F.substring_index(text, s, 1)
    return lstrip(F.substring_index(text, think_end, -1)) if think_end else text


def completion(prompt: Column, response: Column, fence: str | None = None) -> Column:
    """Prompt + response, the response cut at a code fence if one is given."""
    return F.concat(prompt, F.substring_index(response, fence, 1) if fence else response)


def first_line(text: Column) -> Column:
    return F.substring_index(strip(text), "\n", 1)


def best_answer_phrase(text: Column) -> Column:
    """The word after the last "the best answer is", letters and digits only; other texts unchanged."""
    low = F.lower(text)
    tail = F.substring_index(F.substring_index(F.substring_index(low, "the best answer is ", -1), "\n", 1), " ", 1)
    return F.when(F.instr(low, "the best answer is") > 0, F.upper(F.regexp_replace(tail, "[^a-zA-Z0-9]", ""))).otherwise(text)


def answer_to_label(answer: Column, labels: list[str], marks: list[str] | None = None) -> Column:
    """Upper-cased answer; a numeral or roman numeral becomes the label at its position."""
    answer = F.upper(answer)
    if not marks:
        return answer
    at = F.array_position(F.array(*[F.lit(m) for m in marks]), answer)
    return F.when(at > 0, F.element_at(F.array(*[F.lit(x) for x in labels]), F.greatest(at, F.lit(1)).cast("int"))).otherwise(answer)


# --- mathematical answers ---------------------------------------------------------------------------

def last_boxed(text: Column) -> Column:
    r"""Contents of the last ``\boxed{…}`` with balanced braces (or ``\boxed …`` up to ``$``), else NULL."""
    blank = F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1)
    rest = F.substring_index(text, "\\boxed", -1)
    state = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("close"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        closes = (s["close"] == 0) & (ch == "}") & (depth == 0)
        return F.struct(depth.alias("depth"), (s["i"] + 1).alias("i"), F.when(closes, s["i"] + 1).otherwise(s["close"]).alias("close"))

    close = F.aggregate(F.split(rest, ""), state, step)["close"]
    braced = F.when(rest.startswith("{") & (close > 0), F.substring(rest, F.lit(2), close - 2))
    return F.when(F.contains(text, F.lit("\\boxed ")), blank).when(F.contains(text, F.lit("\\boxed")), braced)


# Literal clean-up of a mathematical answer, in order.
MATH_LITERALS = [
    ("\n", ""),
    ("\\!", ""),
    ("\\\\", "\\"),
    ("tfrac", "frac"),
    ("dfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("^{\\circ}", ""),
    ("^\\circ", ""),
    ("\\$", ""),
]


def math_form(text: Column) -> Column:
    r"""Comparison form of a short LaTeX answer: units, degrees, percent and blanks removed; ``\sqrt3``,
    ``\frac12``, ``.5``, ``a/b`` and a leading ``x=`` written out."""
    t = text
    for old, new in MATH_LITERALS:
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.substring_index(t, "\\text{ ", 1)
    for old, new in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.when(t.startswith("."), F.concat(F.lit("0"), t)).otherwise(t)
    t = F.regexp_replace(t, r"^[^=]{0,2}=([^=]*)$", "$1")
    t = F.regexp_replace(t, r"\\sqrt([^{])", r"\\sqrt{$1}")
    t = F.replace(t, F.lit(" "), F.lit(""))
    full = F.regexp_replace(F.regexp_replace(t, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    t = F.when(t.rlike(r"\\frac[^{]?(\\frac|$)"), t).otherwise(full)
    t = F.when(t == "0.5", "\\frac{1}{2}").otherwise(t)
    return F.regexp_replace(t, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def math_equal(a: Column, b: Column) -> Column:
    return math_form(a) == math_form(b)


# --- terminal boxed or marked letters ---------------------------------------------------------------

# Opening and closing marks of native thinking.
THINKING = {
    "<think>": "</think>",
    "<ifm|think>": "</ifm|think>",
    "<ifm|think_fast>": "</ifm|think_fast>",
    "<ifm|think_faster>": "</ifm|think_faster>",
    "<|ifm|think|>": "<|ifm|/think|>",
    "<|ifm|think>": "<|ifm|/think>",
}
# Patterns of a follow-on question, stop tokens, the final-answer mark and its letter.
QUESTION_LINE = r"^[ \t]*(?:Ερώτηση|Νέα ερώτηση|Επόμενη ερώτηση|Question)[ \t]*:"
STOP_TOKENS = r"(?:<\|im_end\|>|<\|endoftext\|>|<\|eot_id\|>|<\|ifm\|endoftext\|>|<\|ifm\|im_end\|>|</s>)"
FINAL_MARK = r"(?:\*\*)?Τελική[ \t]+απάντηση(?:\*\*)?[ \t]*:"
LETTER = r"(?:[A-Za-zΑΒΓΔαβγδ]|\\(?:Gamma|Delta|Alpha|Beta|gamma|delta|alpha|beta))"
CONTENTS = rf"(?:\\(?:text|mathrm|mathbf|mathsf|operatorname)\s*\{{\s*({LETTER})\s*\}}|({LETTER}))[ \t]*[.)]?"
BOXED = (
    rf"(?imu)^[ \t]*(?:{FINAL_MARK}[ \t]*)?(?:\*\*)?[ \t]*(?:\$+|\\\[|\\\()?\s*\\boxed\s*\{{\s*{CONTENTS}\s*\}}"
    r"\s*(?:\$+|\\\]|\\\))?(?:\*\*)?[ \t]*[.!]?[ \t]*\z"
)
MARKED = rf"(?imu)^[ \t]*{FINAL_MARK}[ \t]*(?:\*\*)?[ \t]*({LETTER})[ \t]*[.)]?(?:\*\*)?[ \t]*\z"

_OPEN = list(THINKING)
_CLOSE = list(THINKING.values())
_TAGS = "|".join(re.escape(x) for x in sorted(_OPEN + _CLOSE, key=len, reverse=True))
_EVENTS = rf"(?imu)(?:{_TAGS}|{QUESTION_LINE})"


def _closer_of(tag: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in _CLOSE]), F.greatest(F.array_position(F.array(*[F.lit(x) for x in _OPEN]), tag), F.lit(1)).cast("int"))


def _fold_events(events: Column, inherited: Column) -> Column:
    """Walk thinking marks and question lines with a stack of expected closing marks."""
    start = F.struct(
        F.array().cast("array<string>").alias("stack"),
        inherited.alias("inherited"),
        F.lit(False).alias("bad"),
        F.lit(False).alias("closed"),
        F.lit(0).alias("i"),
        F.lit(-1).alias("cut"),
    )
    opens, closes = F.array(*[F.lit(x) for x in _OPEN]), F.array(*[F.lit(x) for x in _CLOSE])

    def step(s: Column, e: Column) -> Column:
        is_open, is_close = F.array_contains(opens, e), F.array_contains(closes, e)
        depth = F.size(s["stack"])
        top = F.try_element_at(s["stack"], F.lit(-1))
        pops = is_close & (depth > 0) & (top == e)
        stack = (
            F.when(is_open, F.concat(s["stack"], F.array(_closer_of(e))))
            .when(pops, F.slice(s["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
            .otherwise(s["stack"])
        )
        cuts = ~is_open & ~is_close & (depth == 0) & ~s["inherited"] & (s["cut"] < 0)
        return F.struct(
            stack.alias("stack"),
            (s["inherited"] & ~is_close).alias("inherited"),
            (s["bad"] | (is_close & (depth > 0) & (top != e))).alias("bad"),
            (s["closed"] | is_close).alias("closed"),
            (s["i"] + 1).alias("i"),
            F.when(cuts, s["i"]).otherwise(s["cut"]).alias("cut"),
        )

    return F.aggregate(events, start, step)


def final_letter(text: Column, n_choices: Column, need_close: Column | bool = False) -> Column:
    """``struct<label, format>`` of the terminal answer letter, or ``[invalid]``.

    The text is cut at a follow-on question outside thinking; unclosed or badly nested thinking is
    invalid; what follows the last closing mark, without stop tokens, must end in a boxed letter or
    in a marked bare letter. Greek and LaTeX letters count as Latin ones.
    """
    need = F.lit(need_close) if isinstance(need_close, bool) else need_close
    return bind(text, lambda t: bind(_before_next_question(t, need), lambda c: bind(_after_thinking(c, need), lambda b: _terminal_letter(b, n_choices))))


def _before_next_question(text: Column, need: Column) -> Column:
    """The text up to the first question line outside thinking."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(_EVENTS), F.lit(0)).alias("events"), F.split(text, _EVENTS, -1).alias("pieces"))

    def cut(p: Column, at: Column) -> Column:
        kept = F.transform(F.slice(p["events"], F.lit(1), at), lambda e, i: F.concat(F.element_at(p["pieces"], i + 1), e))
        return F.concat(F.array_join(kept, ""), F.element_at(p["pieces"], at + 1))

    return strip(bind(parts, lambda p: bind(_fold_events(p["events"], need)["cut"], lambda at: F.when(at >= 0, cut(p, F.greatest(at, F.lit(0)))).otherwise(text))))


def _after_thinking(text: Column, need: Column) -> Column:
    """What follows the last closing mark without stop tokens; NULL when thinking is open or badly nested."""
    closers = "|".join(re.escape(c) for c in sorted(_CLOSE, key=len, reverse=True))
    tags = F.regexp_extract_all(text, F.lit(_TAGS), F.lit(0))

    def rest(s: Column) -> Column:
        bad = (F.size(s["stack"]) > 0) | s["bad"] | (need & ~s["closed"])
        return F.when(~bad, F.when(s["closed"], strip(F.regexp_replace(text, rf"(?s)^.*(?:{closers})", ""))).otherwise(text))

    body = bind(_fold_events(tags, F.lit(False)), rest)
    return F.regexp_replace(body, rf"\s*(?:{STOP_TOKENS}\s*)+\z", "")


def _terminal_letter(body: Column, n_choices: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    found = F.struct(
        F.coalesce(some(F.regexp_extract(body, BOXED, 1)), some(F.regexp_extract(body, BOXED, 2))).alias("boxed"),
        some(F.regexp_extract(body, MARKED, 1)).alias("marked"),
    )
    names = F.create_map(*[F.lit(x) for p in (("alpha", "A"), ("beta", "B"), ("gamma", "C"), ("delta", "D")) for x in p])

    def latin(raw: Column) -> Column:
        return F.when(raw.startswith("\\"), F.try_element_at(names, F.lower(F.substring(raw, F.lit(2), F.length(raw))))).otherwise(
            F.upper(F.translate(raw, "ΑΒΓΔαβγδ", "ABCDABCD"))
        )

    def verdict(f: Column, letter: Column) -> Column:
        at = F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), letter)
        ok = F.coalesce(n_choices.between(2, 26) & (F.length(letter) == 1) & at.between(1, n_choices), F.lit(False))
        return F.struct(
            F.when(ok, letter).otherwise(INVALID).alias("label"),
            F.when(ok & f["boxed"].isNotNull(), "boxed").when(ok, "marked-letter").otherwise("invalid").alias("format"),
        )

    return bind(found, lambda f: bind(latin(F.coalesce(f["boxed"], f["marked"])), lambda c: verdict(f, c)))
