"""Field templates and option rendering compiled to Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def roman(n: int) -> str:
    """Roman numeral of a number below 100."""
    tens = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
    ones = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    return tens[n // 10] + ones[n % 10]


NUMERALS, ROMAN = [str(i) for i in range(1, 100)], [roman(i) for i in range(1, 100)]


def letter_mark(i: Column, lower: bool = False) -> Column:
    """A to Z by position, then AA, AB, …"""
    first = ord("a" if lower else "A")
    return F.concat(F.when(i < 26, "").otherwise(F.char(F.lit(first - 1) + F.floor(i / 26))), F.char(F.lit(first) + i % 26))


def render(template: str, fields: list[str] | None = None) -> Column:
    """``text {{field}} text`` as a concatenation; ``{{field | regex_replace(p, r)}}`` applies a filter.

    ``fields`` (when given) is the list of known columns; any other name is an error.
    """
    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{\{\s*(\w+)\s*(?:\|\s*regex_replace\(\s*'([^']*)'\s*,\s*'([^']*)'\s*\))?\s*\}\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos : m.start()]))
        if fields is not None and m.group(1) not in fields:
            raise KeyError(f"template field {m.group(1)!r} is not a column")
        value = F.coalesce(F.col(m.group(1)).cast("string"), F.lit("None"))
        parts.append(F.regexp_replace(value, m.group(2), m.group(3)) if m.group(2) is not None else value)
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def resolve(df: DataFrame, spec: str | int | list | dict | Callable) -> Column:
    """A document field: a column name, a template, a constant, or a function of the frame."""
    if callable(spec):
        return spec(df)
    if isinstance(spec, dict):
        spec = list(spec.values())
    if isinstance(spec, list):
        return F.array(*[F.lit(x) for x in spec])
    if isinstance(spec, str):
        return F.col(spec) if spec in df.columns else render(spec, df.columns)
    return F.lit(spec)


def as_index(text: Column) -> Column:
    """Index when the text is only digits (used where choices exist), else NULL."""
    return F.when(text.cast("string").rlike("^[0-9]+$"), text.cast("int"))


def as_list(text: Column) -> Column:
    """Array when the text is a ``[…]`` literal, else NULL."""
    return F.when(F.length(text) >= 2, F.when(text.startswith("[") & text.endswith("]"), F.from_json(text, "array<string>")))


def mark(values: list[str], i: Column) -> Column:
    """The mark of a position; beyond the list its number."""
    return F.coalesce(F.try_element_at(F.array(*[F.lit(v) for v in values]), i + 1), (i + 1).cast("string"))


def render_options(options: Column, fmt: Column) -> Column:
    """Options through a per-row format with ``{letter} {lower_case_letter} {numeral} {roman_numeral} {option}``."""

    def one(o: Column, i: Column) -> Column:
        out = fmt
        for name, value in (
            ("{roman_numeral}", mark(ROMAN, i)),
            ("{numeral}", mark(NUMERALS, i)),
            ("{letter}", letter_mark(i)),
            ("{lower_case_letter}", letter_mark(i, lower=True)),
            ("{option}", o),
        ):
            out = F.replace(out, F.lit(name), value)
        return out

    return F.array_join(F.transform(options, one), "")


def fill(prompt: Column, **values: Column) -> Column:
    """Single-brace ``{name}`` placeholders of a per-row prompt."""
    for name, value in values.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), value)
    return prompt


# Wording of the Greek question block and instruction.
GREEK_PASSAGE = "Κείμενο:\n"
GREEK_QUESTION = "Ερώτηση: "
GREEK_INSTRUCTION = (
    "Λύσε την ερώτηση πολλαπλής επιλογής και εξήγησε τον συλλογισμό σου στα ελληνικά. "
    "Στο τέλος γράψε μία ξεχωριστή γραμμή της μορφής «Τελική απάντηση: \\boxed{γράμμα}», "
    "αντικαθιστώντας το «γράμμα» με το λατινικό γράμμα της επιλογής που θεωρείς σωστή. "
    "Το πλαίσιο πρέπει να περιέχει μόνο ένα γράμμα. Μη γράψεις άλλη ερώτηση ή κείμενο μετά την τελική γραμμή."
)
GREEK_EXAMPLES = "Ακολουθούν παραδείγματα με τις τελικές απαντήσεις τους (χωρίς αναλυτικό συλλογισμό)."
GREEK_EXAMPLE = "Παράδειγμα "
GREEK_FINAL = "Τελική απάντηση: \\boxed{"
GREEK_NOW = "Τώρα απάντησε στην επόμενη ερώτηση με τον δικό σου συλλογισμό."
GREEK_ALLOWED = "Επίτρεπτά γράμματα: "
GREEK_ANSWER = ".\n\nΑπάντηση:"


def question_block(question: Column, choices: Column, passage: Column) -> Column:
    """Passage (when there is one), question, and lettered choices."""
    listed = F.array_join(F.transform(choices, lambda c, i: F.concat(letter_mark(i), F.lit(". "), c)), "\n")
    head = F.when(F.coalesce(passage, F.lit("")) != "", F.concat(F.lit(GREEK_PASSAGE), passage, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit(GREEK_QUESTION), question, F.lit("\n\n"), listed)


def greek_prompt(question: Column, choices: Column, passage: Column, shots: Column) -> Column:
    """Instruction, solved examples (``array<struct<question, choices, passage, target>>``), question, allowed letters."""
    examples = F.transform(
        shots,
        lambda s, i: F.concat(
            F.lit(GREEK_EXAMPLE), (i + 1).cast("string"), F.lit("\n"),
            question_block(s["question"], s["choices"], s["passage"]),
            F.lit("\n\n" + GREEK_FINAL), s["target"], F.lit("}"),
        ),
    )
    letters = F.array_join(F.transform(choices, lambda c, i: letter_mark(i)), ", ")
    with_shots = F.concat(F.array(F.lit(GREEK_EXAMPLES)), examples, F.array(F.lit(GREEK_NOW)))
    parts = F.concat(
        F.array(F.lit(GREEK_INSTRUCTION)),
        F.when(F.size(shots) > 0, with_shots).otherwise(F.array().cast("array<string>")),
        F.array(question_block(question, choices, passage), F.concat(F.lit(GREEK_ALLOWED), letters, F.lit(GREEK_ANSWER))),
    )
    return F.array_join(parts, "\n\n")
