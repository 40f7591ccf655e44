"""Corpus-level aggregates and closed-form standard errors.

Everything is a sum of per-row contributions combined on the map side; medians use row positions
instead of collecting a task's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import fixed
from evalspark.operators.ordering import with_position
from evalspark.registry import AGGREGATIONS
from evalspark.session import broadcast_if_small


@AGGREGATIONS.add("mean")
def mean(x: Column) -> Column:
    return F.avg(x)


@AGGREGATIONS.add("nanmean")
def nanmean(x: Column) -> Column:
    """Mean without NaN; NaN when nothing is left."""
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(float("nan")))


@AGGREGATIONS.add("perplexity")
def perplexity(x: Column) -> Column:
    return F.exp(-F.avg(x))


@AGGREGATIONS.add("weighted_perplexity")
def weighted_perplexity(x: Column, weight: Column) -> Column:
    return F.exp(-F.sum(x) / F.sum(weight))


@AGGREGATIONS.add("bits_per_byte")
def bits_per_byte(x: Column, n_bytes: Column) -> Column:
    return -F.sum(x) / F.sum(n_bytes) / F.ln(F.lit(2.0))


@AGGREGATIONS.add("bypass")
def bypass(x: Column) -> Column:
    """The constant that stands for "no metric computed"."""
    return F.max(F.lit(999.0))


def mean_stderr(x: Column) -> Column:
    """Standard error of the mean; NULL for fewer than two values."""
    return F.when(F.count(x) > 1, F.stddev_samp(x) / F.sqrt(F.count(x).cast("double")))


def summarize(samples: DataFrame, by: list[str], value: str = "value", with_stderr: bool = True) -> DataFrame:
    """``(by…, value, stderr, n)`` of a long sample table."""
    err = mean_stderr(F.col(value)) if with_stderr else F.lit(None).cast("double")
    return samples.groupBy(*by).agg(F.avg(value).alias("value"), err.alias("stderr"), F.count(F.lit(1)).alias("n"))


def spread_of(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Sample and population standard deviation and the standard error of the mean."""
    x = F.col(value)
    return samples.groupBy(*by).agg(F.stddev_samp(x).alias("stddev"), F.stddev_pop(x).alias("pop_stddev"), mean_stderr(x).alias("stderr"))


def positional_median(samples: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """The value at position n // 2 in source order — the values are not sorted."""
    placed = with_position(samples.select(*by, *order, value), order, by)
    n = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(broadcast_if_small(n), by).where(F.col("pos") == F.floor(F.col("_n") / 2)).select(*by, F.col(value).alias("median"))


def true_median(samples: DataFrame, by: list[str], key: list[str], value: str = "value") -> DataFrame:
    """Exact median of the sorted values, by position."""
    placed = with_position(samples.select(*by, *key, value), [value, *key], by)
    n = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    mid = (F.col("pos") == F.floor(F.col("_n") / 2)) | (F.col("pos") == F.floor((F.col("_n") - 1) / 2))
    return placed.join(broadcast_if_small(n), by).where(mid).groupBy(*by).agg(F.avg(value).alias("median"))


# --- classification ---------------------------------------------------------------------------------

@AGGREGATIONS.add("f1")
def binary_f1(gold: Column, pred: Column, weight: Column | None = None) -> Column:
    """F1 of class 1."""
    w = weight if weight is not None else F.lit(1)
    tp = F.sum(F.when((gold == 1) & (pred == 1), w).otherwise(0))
    both = F.sum(F.when(gold == 1, w).otherwise(0)) + F.sum(F.when(pred == 1, w).otherwise(0))
    return F.when(both > 0, 2.0 * tp / both).otherwise(0.0)


def class_counts(df: DataFrame, by: list[str], gold: str, pred: str, weight: Column | None = None) -> DataFrame:
    """Per class: rows with it as gold (``t``), as prediction (``p``) and as both (``tp``)."""
    w = (weight if weight is not None else F.lit(1)).cast("long")
    zero = F.lit(0).cast("long")
    same = F.when(F.col(gold) == F.col(pred), w).otherwise(zero)
    rows = F.array(
        F.struct(F.col(gold).alias("label"), w.alias("t"), zero.alias("p"), same.alias("tp")),
        F.struct(F.col(pred).alias("label"), zero.alias("t"), w.alias("p"), zero.alias("tp")),
    )
    return df.select(*by, F.inline(rows)).groupBy(*by, "label").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))


def class_f1() -> Column:
    return F.when(F.col("t") + F.col("p") > 0, 2.0 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)


def f1_scores(counts: DataFrame, by: list[str], selected: list | None = None) -> DataFrame:
    """Macro, micro, weighted F1; the mean over ``selected`` classes; the mean without the last class."""
    f1 = class_f1()
    chosen = F.avg(F.when(F.col("label").isin(selected), f1)) if selected else F.lit(None).cast("double")
    n = F.count(F.lit(1))
    return counts.groupBy(*by).agg(
        F.avg(f1).alias("macro_f1"),
        (2.0 * F.sum("tp") / (F.sum("t") + F.sum("p"))).alias("micro_f1"),
        (F.sum(f1 * F.col("t")) / F.sum("t")).alias("weighted_f1"),
        chosen.alias("selected_f1"),
        F.when(n > 1, (F.sum(f1) - F.max_by(f1, F.col("label"))) / (n - 1)).otherwise(F.max(f1)).alias("f1_without_last"),
    )


@AGGREGATIONS.add("matthews_corrcoef")
def matthews(counts: DataFrame, by: list[str]) -> DataFrame:
    """Multi-class Matthews correlation from the class counts."""
    x = lambda c: F.col(c).cast("double")
    s, c = F.sum(x("t")), F.sum(x("tp"))
    cov = c * s - F.sum(x("t") * x("p"))
    den = F.sqrt((s * s - F.sum(x("p") * x("p"))) * (s * s - F.sum(x("t") * x("t"))))
    return counts.groupBy(*by).agg(F.when(den > 0, cov / den).otherwise(0.0).alias("mcc"))


# The four sentiment classes as (positive, negative) pairs.
SENTIMENT = {0: (1, 0), 1: (0, 1), 2: (0, 0), 3: (1, 1)}


def two_sided_sentiment(df: DataFrame, by: list[str], gold: str, pred: str) -> DataFrame:
    """Mean over both polarities of the two-class macro F1 derived from four classes."""
    table = lambda side: F.create_map(*[F.lit(x) for k, v in SENTIMENT.items() for x in (k, v[side])])
    sides = [
        F.struct(F.lit(s).alias("side"), F.element_at(table(s), F.col(gold).cast("int")).alias("g"), F.element_at(table(s), F.col(pred).cast("int")).alias("q"))
        for s in (0, 1)
    ]
    counts = class_counts(df.select(*by, F.inline(F.array(*sides))), [*by, "side"], "g", "q")
    per_side = counts.groupBy(*by, "side").agg((F.sum(class_f1()) / 2).alias("f1"))
    return per_side.groupBy(*by).agg(F.avg("f1").alias("f1"))


# --- grouped correctness ----------------------------------------------------------------------------

def all_correct(df: DataFrame, by: list[str], question: list[str], correct: Column) -> DataFrame:
    """A question counts only if all its answers are right; value and standard error."""
    per_question = df.groupBy(*by, *question).agg(F.min(correct.cast("int")).cast("double").alias("ok"))
    return per_question.groupBy(*by).agg(F.avg("ok").alias("acc_all"), mean_stderr(F.col("ok")).alias("stderr"), F.count(F.lit(1)).alias("n_questions"))


def grouped_exact_match(df: DataFrame, group: str, pred: str, ref: str) -> DataFrame:
    """Mean over predictions of "equals any reference of its group": a semi-join, not all pairs."""
    refs = df.select(F.col(group).alias("_g"), F.col(ref).alias("_r")).distinct().withColumn("_hit", F.lit(1.0))
    joined = df.join(refs, (F.col(group) == F.col("_g")) & (F.col(pred) == F.col("_r")), "left")
    return joined.agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("em"), F.count(F.lit(1)).alias("n"))


def grouped_first_rows(df: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """The first row of each group, the only one a grouped token F1 looks at."""
    return df.groupBy(group).agg(F.min_by(F.struct(*columns), order).alias("r")).select(group, "r.*")


def instruction_accuracy(df: DataFrame, by: list[str], flags: str) -> DataFrame:
    """Mean over all entries of per-document lists."""
    return df.groupBy(*by).agg(
        (F.sum(F.aggregate(F.col(flags), F.lit(0.0), lambda a, x: a + x.cast("double"))) / F.sum(F.size(flags))).alias("value")
    )


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that at least one of k samples passes when c of n do."""
    return F.when(c <= 0, 0.0).when(n - c < k, 1.0).otherwise(
        1.0 - F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (1.0 - F.lit(float(k)) / i))
    )


def substitution_f1(df: DataFrame, by: list[str]) -> DataFrame:
    """F1 of summed precision over answered and over annotated items."""
    s = df.groupBy(*by).agg(F.sum("prec").alias("s"), F.sum("has_answer").alias("a"), F.sum("has_gold").alias("t"))
    p, r = F.col("s") / F.greatest("a", F.lit(1)), F.col("s") / F.greatest("t", F.lit(1))
    return s.select(*by, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


# --- comparisons ------------------------------------------------------------------------------------

def normal_sf(z: Column) -> Column:
    """Upper tail of the standard normal for z ≥ 0 (Abramowitz–Stegun 26.2.17, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / 2.5066282746310002 * poly


def z_test(a: DataFrame, b: DataFrame, on: list[str], alpha: float = 0.05) -> DataFrame:
    """Two models' values per task: Z, two-sided p and a mark where p exceeds ``alpha``. A task of one row has no error
    and so neither Z, p nor mark."""
    pick = lambda d, s: d.select(*on, F.col("value").alias(f"value_{s}"), F.col("stderr").alias(f"stderr_{s}"))
    j = pick(a, "a").join(pick(b, "b"), on)
    den = F.sqrt(F.col("stderr_a") * F.col("stderr_a") + F.col("stderr_b") * F.col("stderr_b"))
    z = F.when(den > 0, (F.col("value_a") - F.col("value_b")) / den)
    out = j.withColumn("z", z).withColumn("p", 2 * normal_sf(F.abs("z")))
    return out.withColumn("same", F.when(den.isNotNull(), F.when(F.col("p") > alpha, "✓").otherwise("×")))


def regression_table(base: DataFrame, branch: DataFrame, on: list[str]) -> DataFrame:
    """Base and branch values in percent with standard errors, and the signed difference."""
    pick = lambda d, s: d.select(*on, F.col("value").alias(f"v_{s}"), F.col("stderr").alias(f"e_{s}"), F.col("seconds").alias(f"s_{s}"))
    j = pick(base, "base").join(pick(branch, "branch"), on)

    def shown(s: str) -> Column:
        err = F.when(F.coalesce(F.col(f"e_{s}"), F.lit(0.0)) != 0, F.concat(F.lit(" ± "), fixed(100 * F.col(f"e_{s}"), 2))).otherwise("")
        return F.concat(fixed(100 * F.col(f"v_{s}"), 2), err)

    diff = 100 * F.col("v_branch") - 100 * F.col("v_base")
    return j.select(
        *on,
        shown("base").alias("base"),
        shown("branch").alias("branch"),
        F.when(diff > 0, F.concat(F.lit("**+"), fixed(diff, 2), F.lit("**"))).otherwise(fixed(diff, 2)).alias("diff"),
        F.concat(fixed(100 * F.col("s_branch") / F.col("s_base"), 2), F.lit("%")).alias("runtime"),
    )


def treatment_coefficients(df: DataFrame, value: str, numeric: list[str], factors: dict[str, str]) -> DataFrame:
    """Fixed-effect least squares: numeric columns standardised, factors against a base level.

    Every other level has a coefficient, however many there are: levels are indexed and encoded as sparse vectors, and
    beyond 4,000 columns the solver is iterative. A constant numeric column is only centred. Rows with a null value,
    number or factor are left out.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = df.dropna(subset=[value, *numeric, *factors])
    stats = df.agg(F.count(F.lit(1)), *[F.avg(c).alias(f"m_{c}") for c in numeric], *[F.stddev_samp(c).alias(f"s_{c}") for c in numeric]).first()
    scaled = [((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0)).alias(f"x_{c}") for c in numeric]
    # the base level becomes null, which the indexer puts last and the encoder drops
    levels = [F.when(F.col(c) != base, F.col(c)).alias(f"f_{c}") for c, base in factors.items()]
    x = df.select(F.col(value).cast("double").alias("label"), *scaled, *levels)
    names, parts, inputs = [*numeric], [], [f"x_{c}" for c in numeric]
    for c in factors:
        index = StringIndexer(inputCol=f"f_{c}", outputCol=f"i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(x)
        names += [f"{c}={level}" for level in index.labels]
        if index.labels:
            parts += [index, OneHotEncoder(inputCol=f"i_{c}", outputCol=f"x_{c}", dropLast=True)]
            inputs.append(f"x_{c}")
    design = VectorAssembler(inputCols=inputs, outputCol="features")
    ready = Pipeline(stages=[*parts, design]).fit(x).transform(x)
    solver = "normal" if len(names) <= 4000 else "l-bfgs"
    model = LinearRegression(solver=solver, standardization=False).fit(ready)
    rows = [(n, float(v)) for n, v in zip(["intercept", *names], [model.intercept, *model.coefficients.toArray()], strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")
