"""Preparation of benchmark tables: canonical layouts, flattening, variants, clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.draws import draw
from evalspark.functions.text import clean_markup, split_words, strip
from evalspark.operators.ordering import with_position

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def letter_of(index: Column) -> Column:
    return F.substring(F.lit(LETTERS), index.cast("int") + 1, F.lit(1))


def index_of(letter: Column) -> Column:
    """0-based index of an answer letter, NULL when it is not one."""
    at = F.position(F.upper(F.trim(letter)), F.lit(LETTERS))
    return F.when((F.length(F.trim(letter)) == 1) & (at > 0), at - 1)


def capitalize(text: Column) -> Column:
    """First character upper-cased, the others lower-cased."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def keep_pairs(df: DataFrame, first: str, second: str) -> DataFrame:
    """Rows whose two sentences are both present and not blank, both cleaned."""
    def tidy(c: str) -> Column:
        return strip(F.regexp_replace(F.col(c), r" +", " "))

    ok = lambda c: F.col(c).isNotNull() & (strip(F.col(c)) != "")
    return df.where(ok(first) & ok(second)).withColumns({first: tidy(first), second: tidy(second)})


def continuation_query(label: Column, first: Column, second: Column) -> Column:
    """Context of a sentence-completion row: topic, first part, capitalised second part, cleaned."""
    return clean_markup(F.concat(label, F.lit(": "), first, F.lit(" "), capitalize(second)))


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def flatten_answers(df: DataFrame, keep_type: str) -> DataFrame:
    """One row per (question, answer) of nested ``qas``, categorised, one answer type kept.

    ``qas array<struct<question, answers array<struct<unanswerable, yes_no, free_form, spans>>>>``
    """
    a = F.col("a")
    has_spans = F.size(a["spans"]) > 0
    kind = (
        F.when(a["unanswerable"], "unanswerable")
        .when(a["yes_no"], "bool")
        .when(F.coalesce(a["free_form"], F.lit("")) != "", "free form answer")
        .when(has_spans, "extractive_spans")
        .when(a["yes_no"] == F.lit(False), "bool")
    )
    answer = (
        F.when(a["unanswerable"], "unanswerable")
        .when(a["yes_no"], "yes")
        .when(F.coalesce(a["free_form"], F.lit("")) != "", a["free_form"])
        .when(has_spans, F.array_join(a["spans"], ", "))
        .when(a["yes_no"] == F.lit(False), "no")
    )
    others = [c for c in df.columns if c != "qas"]
    return (
        df.select(*others, F.posexplode("qas").alias("q_no", "q"))
        .select(*others, "q_no", F.col("q.question").alias("question"), F.posexplode("q.answers").alias("a_no", "a"))
        .select(*others, "q_no", "a_no", "question", answer.alias("answer"), kind.alias("answer_type"))
        .where(F.col("answer_type") == keep_type)
    )


def per_answer(df: DataFrame, answers: str, out: str = "answer") -> DataFrame:
    """One row per accepted answer."""
    return df.withColumn(out, F.explode(answers)).drop(answers)


def first_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each id in source order (aggregated, never collected)."""
    fields = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("r")).select(key, "r.*")


def outputs_in_order(df: DataFrame, key: str, order: str, output: str) -> DataFrame:
    """All outputs of each id, numbered in first-seen order.

    Kept as rows: an id that owns a large share of the table would not fit one array.
    """
    return with_position(df.select(key, order, output), [order], [key], name="output_no").drop(order)


def within_tokens(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Rows with at most ``limit`` whitespace tokens."""
    return df.where(F.size(split_words(F.col(text))) <= limit)


def split_question(text: Column) -> tuple[Column, Column]:
    """Question and body around the first blank line; without one, all but the last character and
    the text from its second character on (what slicing at position −1 gives)."""
    at = F.instr(text, "\n\n")
    size = F.length(text)
    question = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.substring(text, F.lit(1), F.greatest(size - 1, F.lit(0))))
    body = F.when(at > 0, F.substring(text, at + 2, size)).otherwise(F.substring(text, F.lit(2), size))
    return question, body


def with_templates(df: DataFrame, templates: list[dict[str, str]]) -> DataFrame:
    """Each row once per prompt template (a fixed list), with ``prompt_id`` and the template's fields."""
    items = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in t.items()]) for t in templates])
    return df.select("*", F.posexplode(items).alias("prompt_id", "_t")).select(*df.columns, "prompt_id", "_t.*")


def option_order_variants(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row per label position with the correct option swapped there.

    A position beyond the row's options leaves them and the answer as they are.
    """
    lab = F.array(*[F.lit(x) for x in labels])
    base = df.select("*", F.posexplode(lab).alias("label_no", "always_same_option"))
    options, gold, k = F.col("options"), F.col("answer_index").cast("int"), F.col("label_no")
    inside = k < F.size(options)
    swapped = F.transform(
        options,
        lambda o, i: F.when(inside & (i == k), F.element_at(options, gold + 1))
        .when(inside & (i == gold), F.element_at(options, F.least(k, F.size(options) - 1) + 1))
        .otherwise(o),
    )
    keep = [c for c in df.columns if c not in ("options", "answer_index")]
    return base.select(
        *keep,
        "label_no",
        "always_same_option",
        swapped.alias("options"),
        F.when(inside, k).otherwise(gold).cast("long").alias("answer_index"),
        gold.cast("long").alias("original_answer_index"),
    )


def shuffle_choices(df: DataFrame, key: str, choices: str, gold: str, seed: int) -> DataFrame:
    """Choices in a seeded order per row and the gold index recomputed."""
    keyed = F.transform(
        F.col(choices),
        lambda c, i: F.struct(draw(seed, F.col(key), i).alias("d"), i.alias("i"), c.alias("c")),
    )
    mixed = df.withColumn("_m", F.array_sort(keyed))
    return (
        mixed.withColumn(choices, F.transform("_m", lambda s: s["c"]))
        .withColumn(gold, (F.array_position(F.transform("_m", lambda s: s["i"]), F.col(gold).cast("int")) - 1).cast("long"))
        .drop("_m")
    )


# --- canonical question rows ------------------------------------------------------------------------

def canonical(df: DataFrame, dataset: str, config: Column, split: Column, index: Column, question: Column, choices: Column,
              target: Column, subject: Column, passage: Column | None = None) -> DataFrame:
    """One layout for all benchmarks, with a ``defect`` instead of an exception on bad rows."""
    target = target.cast("int")
    n = F.size("choices")
    defect = (
        F.when(~n.between(2, len(LETTERS)), "choices")
        .when(F.col("target_index").isNull() | ~F.col("target_index").between(0, n - 1), "target")
    )
    return (
        df.select(
            F.concat_ws("/", F.lit(dataset), config, split, index).alias("uid"),
            strip(question).alias("question"),
            strip(passage if passage is not None else F.lit("")).alias("passage"),
            F.transform(choices, strip).alias("choices"),
            target.alias("target_index"),
            subject.alias("subject"),
            F.lit(dataset).alias("dataset"),
            config.alias("dataset_config"),
            split.alias("split"),
        )
        .withColumn("defect", defect)
        .withColumn("target", F.when(F.col("defect").isNull(), letter_of(F.col("target_index"))))
    )


def from_index(df: DataFrame, dataset: str, **meta: Column) -> DataFrame:
    """``question, choices, answer`` with a numeric answer."""
    return canonical(df, dataset, question=F.col("question"), choices=F.col("choices"), target=F.col("answer"), **meta)


def from_letter(df: DataFrame, dataset: str, **meta: Column) -> DataFrame:
    """``question, options, answer`` with an answer letter, which wins over any stored index."""
    return canonical(df, dataset, question=F.col("question"), choices=F.col("options"), target=index_of(F.col("answer")), **meta)


def from_option_columns(df: DataFrame, dataset: str, **meta: Column) -> DataFrame:
    """``option_a … option_d`` columns with an answer letter."""
    choices = F.array(*[F.col(f"option_{x}") for x in "abcd"])
    return canonical(df, dataset, question=F.col("question"), choices=choices, target=index_of(F.col("answer")), **meta)


def from_labelled(df: DataFrame, dataset: str, **meta: Column) -> DataFrame:
    """``choices struct<text, label>`` with the key of the correct label."""
    at = F.array_position(F.col("choices.label"), F.col("answerKey"))
    target = F.when(at > 0, at - 1)
    return canonical(df, dataset, question=F.col("question"), choices=F.col("choices.text"), target=target, **meta)


def from_numbered(df: DataFrame, dataset: str, **meta: Column) -> DataFrame:
    """``mc_answer1 … mc_answer4`` columns with a 1-based answer number and a passage."""
    choices = F.array(*[F.col(f"mc_answer{i}") for i in range(1, 5)])
    return canonical(df, dataset, question=F.col("question"), choices=choices, target=F.col("correct_answer_num").cast("int") - 1, passage=F.col("passage"), **meta)


def from_endings(df: DataFrame, dataset: str, question: str, **meta: Column) -> DataFrame:
    """Sentence completion: cleaned context as the passage, cleaned endings as the choices."""
    passage = continuation_query(F.col("activity_label"), F.col("ctx_a"), F.col("ctx_b"))
    return canonical(df, dataset, question=F.lit(question), choices=F.transform("endings", clean_markup), target=F.col("label").cast("int"), passage=passage, **meta)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def answer_disagreements(df: DataFrame, key: str, letter: str, index: str) -> DataFrame:
    """Rows whose answer letter and stored answer index disagree."""
    found = index_of(F.col(letter))
    return df.where(~found.eqNullSafe(F.col(index).cast("int"))).select(key, letter, index)


def profile(df: DataFrame, by: list[str], columns: dict[str, Column]) -> DataFrame:
    """Value counts of several columns in one pass: ``(by…, field, value, n)``."""
    pairs = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in columns.items()])
    return df.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))


# --- clean-up of answers ----------------------------------------------------------------------------

def finish_answers(answers: Column, default: str | None = None) -> Column:
    """Trimmed answers ending in a period, blanks dropped, a default appended when absent."""
    done = F.transform(F.filter(F.transform(answers, strip), lambda x: x != ""), lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit("."))))
    if default is None:
        return done
    return F.when(F.array_contains(done, default), done).otherwise(F.concat(done, F.array(F.lit(default))))


def minimal_aliases(aliases: Column) -> Column:
    """Sorted aliases without those that start with the last one kept."""
    return F.aggregate(
        F.array_sort(aliases),
        F.array().cast("array<string>"),
        lambda kept, a: F.when((F.size(kept) > 0) & a.startswith(F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))), kept).otherwise(
            F.concat(kept, F.array(a))
        ),
    )


def shots_preprompt(shots: Column) -> Column:
    """``array<struct<question, answer>>`` as one block of solved examples."""
    return F.array_join(F.transform(shots, lambda s: F.concat(F.lit("Question: "), s["question"], F.lit("\nAnswer: "), s["answer"], F.lit("\n\n"))), "")


def binarize(a: Column, b: Column, threshold: float = 5.5) -> Column:
    """1 when the summed annotation exceeds the threshold."""
    return ((a + b) > threshold).cast("long")
