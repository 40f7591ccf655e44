"""Queries of the aggregate, group, bootstrap, bias and robustness family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import alignment as G
from evalspark.functions.draws import PRIME, sql_draw
from evalspark.functions.extraction import regex_answer
from evalspark.operators import aggregates as A
from evalspark.operators import bias as B
from evalspark.operators import bootstrap as S
from evalspark.operators import groups as H
from evalspark.operators import overlap as O
from evalspark.operators import prepare as P
from evalspark.operators import robustness as U
from evalspark.operators import scoring as C
from evalspark.plans import scoring as Q
from evalspark.plans.base import Tables, query, sql_tokens
from evalspark.plans.filters import PICK
from evalspark.plans.fixtures import CHOICES_SQL, GENERATED_SQL, PAIRS_SQL, choice_rows, eval_docs, generated, text_pairs
from evalspark.plans.prepare import VARIANTS_SQL, order_variants
from evalspark.plans.scoring import ARG_SQL, PAIR, ROLLING_SQL, SOFT_SQL, SUBST_SQL, bleu_sql, rnd, sql_overlap
from evalspark.session import distribute

L = "long"
METRICS = ["acc", "acc_norm", "acc_mutual_info", "exact_match"]

LONG_SQL = f"""{ARG_SQL}, long AS (SELECT doc_id, task, 'none' AS filter, unnest(['acc','acc_norm','acc_mutual_info','exact_match']) AS metric,
  unnest([acc, acc_norm, acc_mutual_info, exact_match]) AS value FROM scored),
 results AS (SELECT task, filter, metric, avg(value) AS value, CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) END AS stderr, count(*) AS n FROM long GROUP BY ALL)"""


def long_samples(t: Tables):
    s = C.choice_scores(choice_rows(t), ["doc_id", "task"])
    return C.to_long(s, ["doc_id", "task"], METRICS).withColumn("filter", F.lit("none"))


def results(t: Tables):
    return A.summarize(long_samples(t), ["task", "filter", "metric"])


@query("sample_metrics_long", f"WITH {LONG_SQL} SELECT doc_id, task, metric, value FROM long")
def sample_metrics_long(t: Tables):
    return long_samples(t).select("doc_id", "task", "metric", "value")


@query("task_results", f"WITH {LONG_SQL} SELECT task, filter, metric, round(value, 6) AS value, round(stderr, 6) AS stderr, n::BIGINT AS n FROM results")
def task_results(t: Tables):
    return rnd(results(t), "value", "stderr")


@query(
    "basic_aggregates",
    f"""WITH {ROLLING_SQL} SELECT lang, round(avg(loglik), 4) AS mean, round(avg(loglik) FILTER (WHERE doc_id % 7 <> 0), 4) AS nanmean, round(exp(-avg(loglik / words)), 4) AS perplexity,
       round(ln(exp(-sum(loglik) / sum(words))), 6) AS log_word_perplexity, round(exp(-sum(loglik) / sum(bytes)), 6) AS byte_perplexity, round(-sum(loglik) / sum(bytes) / ln(2), 6) AS bits_per_byte, 999.0::DOUBLE AS bypass
       FROM rolling GROUP BY lang""",
)
def basic_aggregates(t: Tables):
    r, ll = Q.rolling(t), F.col("loglik")
    gaps = F.when(F.col("doc_id") % 7 == 0, F.lit(float("nan"))).otherwise(ll)
    g = r.groupBy("lang").agg(
        F.round(A.mean(ll), 4).alias("mean"),
        F.round(A.nanmean(gaps), 4).alias("nanmean"),
        F.round(A.perplexity(ll / F.col("words")), 4).alias("perplexity"),
        F.round(F.ln(A.weighted_perplexity(ll, F.col("words"))), 6).alias("log_word_perplexity"),
        F.round(A.weighted_perplexity(ll, F.col("bytes")), 6).alias("byte_perplexity"),
        F.round(A.bits_per_byte(ll, F.col("bytes")), 6).alias("bits_per_byte"),
        A.bypass(ll).alias("bypass"),
    )
    return g


MEDIAN_SQL = f"{ROLLING_SQL}, p AS (SELECT lang, loglik, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM rolling)"


@query("positional_median", f"WITH {MEDIAN_SQL} SELECT lang, round(loglik, 6) AS median FROM p WHERE pos = n // 2")
def positional_median(t: Tables):
    return rnd(A.positional_median(Q.rolling(t), ["lang"], ["doc_id"], "loglik"), "median")


@query("true_median", f"WITH {ROLLING_SQL} SELECT lang, round(median(loglik), 6) AS median FROM rolling GROUP BY lang")
def true_median(t: Tables):
    return rnd(A.true_median(Q.rolling(t), ["lang"], ["doc_id"], "loglik"), "median")


@query("standard_deviations", f"WITH {ROLLING_SQL} SELECT lang, round(stddev_samp(loglik), 4) AS stddev, round(stddev_pop(loglik), 4) AS pop_stddev, round(stddev_samp(loglik) / sqrt(count(*)), 4) AS stderr FROM rolling GROUP BY lang HAVING count(*) > 1")
def standard_deviations(t: Tables):
    return rnd(A.spread_of(Q.rolling(t), ["lang"], "loglik").where(F.col("stderr").isNotNull()), "stddev", "pop_stddev", "stderr", n=4)


BINARY_SQL = "bin AS (SELECT doc_id, lang, toxic AS gold, (toxic = 1 OR doc_id % 6 = 0)::INT AS pred FROM labels JOIN documents USING (doc_id))"


def binary(t: Tables):
    d = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    return d.select("doc_id", "lang", F.col("toxic").alias("gold"), ((F.col("toxic") == 1) | (F.col("doc_id") % 6 == 0)).cast("int").alias("pred"))


@query("binary_f1", f"WITH {BINARY_SQL} SELECT lang, round(CASE WHEN sum(gold) + sum(pred) > 0 THEN 2.0 * sum(gold * pred) / (sum(gold) + sum(pred)) ELSE 0 END, 6)::DOUBLE AS f1 FROM bin GROUP BY lang")
def binary_f1(t: Tables):
    return rnd(binary(t).groupBy("lang").agg(A.binary_f1(F.col("gold"), F.col("pred")).alias("f1")), "f1")


CLASS_SQL = """multi AS (SELECT vec_id, label AS gold, (label + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) % 10 AS pred FROM embeddings),
 cc AS (SELECT label, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (SELECT gold AS label, 1 AS t, 0 AS p, (gold = pred)::INT AS tp FROM multi UNION ALL SELECT pred, 0, 1, 0 FROM multi) GROUP BY label),
 f AS (SELECT *, 2.0 * tp / (t + p) AS f1 FROM cc)"""


def classes(t: Tables):
    d = t.embeddings.select("vec_id", F.col("label").alias("gold"), ((F.col("label") + F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)) % 10).alias("pred"))
    return A.class_counts(d, [], "gold", "pred")


@query(
    "class_f1_scores",
    f"""WITH {CLASS_SQL} SELECT round(avg(f1), 6) AS macro_f1, round(2.0 * sum(tp) / (sum(t) + sum(p)), 6)::DOUBLE AS micro_f1, round(sum(f1 * t) / sum(t), 6) AS weighted_f1,
        round(avg(f1) FILTER (WHERE label IN (0, 2)), 6) AS selected_f1, round((sum(f1) - max_by(f1, label)) / (count(*) - 1), 6) AS f1_without_last FROM f""",
)
def class_f1_scores(t: Tables):
    return rnd(A.f1_scores(classes(t), [], [0, 2]), "macro_f1", "micro_f1", "weighted_f1", "selected_f1", "f1_without_last")


@query(
    "matthews_corrcoef",
    f"WITH {CLASS_SQL} SELECT round((sum(tp) * sum(t) - sum(t * p)) / sqrt((sum(t)::DOUBLE * sum(t) - sum(p * p)) * (sum(t)::DOUBLE * sum(t) - sum(t * t))), 6)::DOUBLE AS mcc FROM cc",
)
def matthews_corrcoef(t: Tables):
    return rnd(A.matthews(classes(t), []), "mcc")


@query(
    "two_sided_sentiment",
    """WITH x AS (SELECT vec_id, label % 4 AS gold, (label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS pred FROM embeddings),
       s AS (SELECT side, CASE WHEN side = 0 THEN gold IN (0, 3) ELSE gold IN (1, 3) END AS g, CASE WHEN side = 0 THEN pred IN (0, 3) ELSE pred IN (1, 3) END AS q FROM x, range(2) r(side)),
       f AS (SELECT side, c, 2.0 * count(*) FILTER (WHERE g = c AND q = c) / (count(*) FILTER (WHERE g = c) + count(*) FILTER (WHERE q = c)) AS f1 FROM s, (VALUES (true), (false)) v(c) GROUP BY side, c)
       SELECT round(avg(m), 6)::DOUBLE AS f1 FROM (SELECT side, sum(f1) / 2 AS m FROM f GROUP BY side)""",
)
def two_sided_sentiment(t: Tables):
    d = t.embeddings.select((F.col("label") % 4).alias("gold"), ((F.col("label") + F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)) % 4).alias("pred"))
    return rnd(A.two_sided_sentiment(d, [], "gold", "pred"), "f1")


@query("corpus_bleu", f"""WITH {bleu_sql()}, s AS (SELECT conv_id % 3 AS part, {', '.join(f'sum({x}{n}) AS {x}{n}' for x in 'ct' for n in range(1, 5))}, sum(sys_len) AS sys_len, sum(ref_len) AS ref_len FROM bc GROUP BY part),
  z AS (SELECT *, (c1 = 0)::INT AS z1, (c1 = 0)::INT + (c2 = 0)::INT AS z2, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT AS z3, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT + (c4 = 0)::INT AS z4 FROM s)
  SELECT part, round(CASE WHEN t4 = 0 OR c1 + c2 + c3 + c4 = 0 THEN 0 ELSE (CASE WHEN sys_len >= ref_len THEN 1 ELSE exp(1 - ref_len / sys_len) END) *
    exp(({' + '.join(f'ln(CASE WHEN c{n} > 0 THEN 100.0 * c{n} / t{n} ELSE 100.0 / (pow(2, z{n}) * t{n}) END)' for n in range(1, 5))}) / 4) END, 4)::DOUBLE AS bleu FROM z""")
def corpus_bleu(t: Tables):
    c = Q.pair_bleu_counts(t).withColumn("part", F.col("conv_id") % 3)
    return rnd(O.corpus_bleu(c, ["part"]), "bleu", n=4)


def sql_chars(x: str, n: int) -> str:
    return f"list_transform(range(greatest(length({x}) - {n} + 1, 0)), lambda i: substring({x}, i + 1, {n}))"


@query(
    "corpus_chrf",
    f"""WITH {PAIRS_SQL}, tok AS (SELECT conv_id, turn, regexp_replace(prediction, '\\s+', '', 'g') AS p, regexp_replace(reference, '\\s+', '', 'g') AS r FROM pairs),
      {sql_overlap('tok', 'conv_id, turn', range(1, 7), sql_chars)}, s AS (SELECT n, sum(CASE WHEN n_ref > 0 THEN n_pred ELSE 0 END) AS np, sum(n_ref) AS nr, sum(n_common) AS nc FROM ov GROUP BY n),
      a AS (SELECT avg(nc / np) AS p, avg(nc / nr) AS r FROM s WHERE np > 0 AND nr > 0) SELECT round(100 * 5 * p * r / (4 * p + r), 4)::DOUBLE AS chrf FROM a""",
)
def corpus_chrf(t: Tables):
    return rnd(O.corpus_chrf(O.chrf_counts(text_pairs(t), PAIR, F.col("prediction"), F.col("reference")), []), "chrf", n=4)


@query("corpus_ter")
def corpus_ter(t: Tables):
    """Translation edit rate with block moves (alignment in Arrow batches); see the brute-force test."""
    p = distribute(text_pairs(t), *PAIR).select(F.lower("prediction").alias("p"), F.lower("reference").alias("r"))
    s = p.select(G.translation_edits_col("p", "r").alias("edits"), F.size(F.filter(F.split("r", r"\s+"), lambda w: w != "")).alias("n_ref"))
    return s.agg(F.round(100.0 * F.sum("edits") / F.sum("n_ref"), 4).alias("ter"))


@query("brier_score", f"WITH {SOFT_SQL} SELECT round(avg(brier), 6) AS brier_score FROM brier")
def brier_score(t: Tables):
    return rnd(C.brier_scores(choice_rows(t), ["doc_id"]).agg(A.mean(F.col("brier")).alias("brier_score")), "brier_score")


ALL_SQL = f"{CHOICES_SQL}, a AS (SELECT task, doc_id // 2 AS question, idx, is_greedy OR idx = 0 AS ok FROM mc), q AS (SELECT task, question, min(ok::INT)::DOUBLE AS ok FROM a GROUP BY ALL), q2 AS (SELECT question, min(ok::INT)::DOUBLE AS ok FROM a GROUP BY ALL)"


@query(
    "all_correct",
    f"""WITH {ALL_SQL} SELECT 'paragraph and question' AS grouping, round(avg(ok), 6) AS acc_all, round(stddev_samp(ok) / sqrt(count(*)), 6) AS stderr, count(*)::BIGINT AS n_questions FROM q
        UNION ALL SELECT 'question', round(avg(ok), 6), round(stddev_samp(ok) / sqrt(count(*)), 6), count(*)::BIGINT FROM q2""",
)
def all_correct(t: Tables):
    """The value groups answers by (paragraph, question); its standard error by question alone."""
    a = choice_rows(t).withColumn("question", F.floor(F.col("doc_id") / 2))
    ok = F.col("is_greedy") | (F.col("idx") == 0)
    both = A.all_correct(a, [], ["task", "question"], ok).withColumn("grouping", F.lit("paragraph and question"))
    single = A.all_correct(a, [], ["question"], ok).withColumn("grouping", F.lit("question"))
    return rnd(both.unionByName(single).select("grouping", "acc_all", "stderr", "n_questions"), "acc_all", "stderr")


# --- bootstrap --------------------------------------------------------------------------------------

ITERS, PERPLEXITY_ITERS, BLEU_ITERS = 100_000, 1000, 100


def boot_sql(src: str, key: str, by: str, cols: str, seed: int, iters: int = ITERS) -> str:
    """Classes of equal rows, the table of each count by its recursion, and an as-of join of draws with bounds."""
    at = ", ".join(x for x in (by, cols) if x)
    return f"""cls AS (SELECT {at}, count(*) AS n, min({key}) AS k FROM {src} GROUP BY {at}),
  prt AS (SELECT *, least({S.PART}, n - part * {S.PART}) AS c FROM (SELECT *, unnest(range(0, (n - 1) // {S.PART} + 1)) AS part FROM cls)),
  trm(c, i, q, cum) AS (SELECT DISTINCT c, greatest(0, floor(c - 8 * sqrt(c)) - 8)::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE FROM prt
    UNION ALL SELECT c, i + 1, q * c::DOUBLE / (i + 1)::DOUBLE, cum + q * c::DOUBLE / (i + 1)::DOUBLE FROM trm WHERE i < ceil(c + 10 * sqrt(c))::BIGINT + 20),
  bnd AS (SELECT c, floor(cum / max(cum) OVER (PARTITION BY c) * {PRIME})::BIGINT AS b, i + 1 AS w FROM trm),
  tab AS (SELECT c, b, max(w) AS w FROM bnd GROUP BY c, b UNION ALL SELECT c, -1, min(w) - 1 FROM bnd GROUP BY c),
  drw AS (SELECT prt.*, rep, {sql_draw(seed, 'k', 'part', 'rep')} AS u FROM prt, range({iters}) r(rep)),
  wt AS (SELECT drw.*, tab.w FROM drw ASOF JOIN tab ON drw.c = tab.c AND drw.u >= tab.b)"""


@query(
    "bootstrap_mean",
    f"WITH RECURSIVE {ARG_SQL}, {boot_sql('scored', 'doc_id', 'lang', 'acc', 7)} SELECT lang, round(stddev_samp(m), 6) AS stderr FROM (SELECT lang, rep, sum(acc * w) / sum(w) AS m FROM wt WHERE w > 0 GROUP BY ALL) GROUP BY lang HAVING count(*) > 1",
)
def bootstrap_mean(t: Tables):
    s = C.choice_scores(choice_rows(t), ["doc_id", "lang"])
    b = S.bootstrap_stderr(s, ["lang"], "doc_id", {"x": F.col("acc")}, lambda c: c["x"] / c["w"], ITERS, 7)
    return rnd(b.where(F.col("stderr").isNotNull()), "stderr")


@query(
    "bootstrap_perplexity",
    f"WITH RECURSIVE {ARG_SQL}, ll AS (SELECT doc_id, max(loglik) AS ll FROM mc GROUP BY doc_id), {boot_sql('ll', 'doc_id', '', 'll', 11, PERPLEXITY_ITERS)} SELECT round(stddev_samp(m), 6) AS stderr FROM (SELECT rep, exp(-sum(ll * w) / sum(w)) AS m FROM wt WHERE w > 0 GROUP BY ALL)",
)
def bootstrap_perplexity(t: Tables):
    s = choice_rows(t).groupBy("doc_id").agg(F.max("loglik").alias("ll"))
    return rnd(S.bootstrap_stderr(s, [], "doc_id", {"x": F.col("ll")}, lambda c: F.exp(-c["x"] / c["w"]), PERPLEXITY_ITERS, 11), "stderr")


@query(
    "bootstrap_f1_mcc",
    f"""WITH RECURSIVE {BINARY_SQL}, {boot_sql('bin', 'doc_id', '', 'gold * pred AS tp, gold, pred', 3).replace('GROUP BY gold * pred AS tp, gold, pred', 'GROUP BY ALL')}, s AS (SELECT rep, sum(w * gold * pred)::DOUBLE AS tp, sum(w * gold)::DOUBLE AS g, sum(w * pred)::DOUBLE AS p, sum(w)::DOUBLE AS n FROM wt WHERE w > 0 GROUP BY rep)
        SELECT round(stddev_samp(2 * tp / nullif(g + p, 0)), 6) AS f1_stderr, round(stddev_samp((n * tp - g * p) / nullif(sqrt(g * (n - g) * p * (n - p)), 0)), 6) AS mcc_stderr FROM s""",
)
def bootstrap_f1_mcc(t: Tables):
    sums = {"tp": F.col("gold") * F.col("pred"), "g": F.col("gold"), "p": F.col("pred")}
    f1 = S.bootstrap_stderr(binary(t), [], "doc_id", sums, lambda c: F.try_divide(2.0 * c["tp"], c["g"] + c["p"]), ITERS, 3)

    def mcc(c):
        tp, g, p, n = (c[k].cast("double") for k in ("tp", "g", "p", "w"))
        return F.try_divide(n * tp - g * p, F.sqrt(g * (n - g) * p * (n - p)))

    m = S.bootstrap_stderr(binary(t), [], "doc_id", sums, mcc, ITERS, 3).withColumnRenamed("stderr", "mcc_stderr")
    both = f1.withColumn("j", F.lit(1)).join(m.withColumn("j", F.lit(1)), "j")
    return both.select(F.round("stderr", 6).alias("f1_stderr"), F.round("mcc_stderr", 6).alias("mcc_stderr"))


@query(
    "bootstrap_bleu",
    f"""WITH RECURSIVE {bleu_sql()}, {boot_sql('bc', 'conv_id * 1000 + turn', '', 'c1, c2, c3, c4, t1, t2, t3, t4, sys_len, ref_len', 5, BLEU_ITERS)},
      s AS (SELECT rep, {', '.join(f'sum(w * {x}{n})::DOUBLE AS {x}{n}' for x in 'ct' for n in range(1, 5))}, sum(w * sys_len)::DOUBLE AS sys_len, sum(w * ref_len)::DOUBLE AS ref_len FROM wt WHERE w > 0 GROUP BY rep),
      z AS (SELECT *, (c1 = 0)::INT AS z1, (c1 = 0)::INT + (c2 = 0)::INT AS z2, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT AS z3, (c1 = 0)::INT + (c2 = 0)::INT + (c3 = 0)::INT + (c4 = 0)::INT AS z4 FROM s)
      SELECT round(stddev_samp(CASE WHEN t4 = 0 OR c1 + c2 + c3 + c4 = 0 THEN 0 ELSE (CASE WHEN sys_len >= ref_len THEN 1 ELSE exp(1 - ref_len / sys_len) END) *
       exp(({' + '.join(f'ln(CASE WHEN c{n} > 0 THEN 100.0 * c{n} / t{n} ELSE 100.0 / (pow(2, z{n}) * t{n}) END)' for n in range(1, 5))}) / 4) END), 5)::DOUBLE AS stderr FROM z""",
)
def bootstrap_bleu(t: Tables):
    c = Q.pair_bleu_counts(t).withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    names = [f"{x}{n}" for x in "ct" for n in range(1, 5)] + ["ref_len", "sys_len"]
    b = S.bootstrap_stderr(c, [], "k", {n: F.col(n) for n in names}, O.bleu_score, BLEU_ITERS, 5)
    return rnd(b, "stderr", n=5)


@query(
    "bootstrap_median",
    f"""WITH {MEDIAN_SQL}, d AS (SELECT lang, rep, {sql_draw(13, 'k', 'rep')} % n AS pos FROM (SELECT r.lang, min(doc_id) AS k, count(*) AS n FROM rolling r GROUP BY r.lang), range({ITERS}) g(rep))
        SELECT lang, round(stddev_samp(loglik), 4) AS stderr FROM d JOIN p USING (lang, pos) GROUP BY lang""",
)
def bootstrap_median(t: Tables):
    return rnd(S.bootstrap_positional_median(Q.rolling(t), ["lang"], ["doc_id"], "loglik", ITERS, 13), "stderr", n=4)


# --- groups -----------------------------------------------------------------------------------------

EDGES_SQL = """edges AS (SELECT DISTINCT lang AS parent, lang || '/' || source AS child FROM documents UNION SELECT DISTINCT 'all', lang FROM documents),
 leafs AS (SELECT DISTINCT lang AS grp, lang || '/' || source AS task FROM documents UNION SELECT DISTINCT 'all', lang || '/' || source FROM documents)"""


def edges(t: Tables):
    d = t.documents
    leaf = d.select(F.col("lang").alias("parent"), F.concat_ws("/", "lang", "source").alias("child"))
    return leaf.unionByName(d.select(F.lit("all").alias("parent"), F.col("lang").alias("child"))).distinct()


@query("group_leaves", f'WITH {EDGES_SQL} SELECT grp AS "group", task FROM leafs')
def group_leaves(t: Tables):
    return H.leaf_pairs(edges(t))


@query(
    "group_scores",
    f"""WITH {LONG_SQL}, {EDGES_SQL} SELECT grp AS "group", metric, round(sum(value * n) / sum(n), 6) AS value, round(avg(value), 6) AS unweighted,
        CASE WHEN count(stderr) = count(*) THEN round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) END AS stderr, sum(n)::BIGINT AS n, count(*)::BIGINT AS n_tasks
        FROM leafs JOIN results USING (task) GROUP BY grp, metric""",
)
def group_scores(t: Tables):
    return rnd(H.group_scores(results(t), H.leaf_pairs(edges(t)), ["metric"]), "value", "unweighted", "stderr")


@query(
    "group_scores_multi",
    f"""WITH {LONG_SQL}, {EDGES_SQL} SELECT grp AS "group", metric, round(sum(value * n) / sum(n), 6) AS value, CASE WHEN count(stderr) = count(*) THEN round(sqrt(sum((n - 1) * stderr * stderr * n) / (sum(n) - count(*)) / sum(n)), 6) END AS stderr
        FROM leafs JOIN results USING (task) GROUP BY grp, metric""",
)
def group_scores_multi(t: Tables):
    r = results(t)
    return rnd(H.group_scores(r, H.leaf_pairs(edges(t)), ["metric"]).select("group", "metric", "value", "stderr"), "value", "stderr")


@query(
    "combined_stderr",
    f"""WITH {LONG_SQL}, {EDGES_SQL} SELECT grp AS "group", metric, CASE WHEN total > 1 THEN round(stddev_samp_of, 6) END AS combined_stderr FROM (
        SELECT grp, metric, sum(n) AS total, list_reduce(list({{'m': value, 'v': coalesce(stderr * stderr, 0), 'n': n::DOUBLE}} ORDER BY task), lambda a, x: {{'m': (a.m * a.n + x.m * x.n) / (a.n + x.n),
          'v': ((a.n - 1) * a.v + (x.n - 1) * x.v) / (a.n + x.n - 1) + a.n * x.n / ((a.n + x.n) * (a.n + x.n - 1)) * ((a.m * a.n + x.m * x.n) / (a.n + x.n) - x.m) * ((a.m * a.n + x.m * x.n) / (a.n + x.n) - x.m), 'n': a.n + x.n}}).v ** 0.5 AS stddev_samp_of
        FROM leafs JOIN results USING (task) GROUP BY grp, metric)""",
)
def combined_stderr(t: Tables):
    r = results(t)
    return rnd(H.combined_stderr(r, H.leaf_pairs(edges(t)), ["metric"]), "combined_stderr")


@query(
    "group_difference",
    f"""WITH {LONG_SQL}, {EDGES_SQL}, r AS (SELECT grp, metric, value, row_number() OVER (PARTITION BY grp, metric ORDER BY task) AS rn FROM leafs JOIN results USING (task))
        SELECT grp AS "group", metric, round(max(value) FILTER (WHERE rn = 1) - max(value) FILTER (WHERE rn = 2), 6) AS difference FROM r GROUP BY grp, metric HAVING count(*) >= 2""",
)
def group_difference(t: Tables):
    return rnd(H.group_difference(results(t), H.leaf_pairs(edges(t)), ["metric"], F.col("task")), "difference")


@query(
    "group_direction",
    f"""WITH {EDGES_SQL}, m AS (SELECT DISTINCT lang || '/' || source AS task, unnest(['acc','loss']) AS metric, unnest([true, NOT (source = 'src1')]) AS hib FROM documents)
        SELECT grp AS "group", metric, CASE WHEN count(DISTINCT hib) = 1 THEN bool_and(hib) END AS higher_is_better FROM leafs JOIN m USING (task) GROUP BY grp, metric""",
)
def group_direction(t: Tables):
    tasks = t.documents.select(F.concat_ws("/", "lang", "source").alias("task"), "source").distinct()
    both = F.array(
        F.struct(F.lit("acc").alias("metric"), F.lit(True).alias("higher_is_better")),
        F.struct(F.lit("loss").alias("metric"), (F.col("source") != "src1").alias("higher_is_better")),
    )
    return H.direction_of(tasks.select("task", F.inline(both)), H.leaf_pairs(edges(t)))


@query("repeated_leaves", "SELECT source AS child, count(DISTINCT lang)::BIGINT AS n_parents FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def repeated_leaves(t: Tables):
    return H.repeated_leaves(t.documents.select(F.col("lang").alias("parent"), F.col("source").alias("child")))


# --- bias -------------------------------------------------------------------------------------------

BIAS_SQL = f"""bias AS (SELECT o_orderkey, o_orderpriority AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'ambig' ELSE 'disambig' END AS cond, o_custkey % 4 - 1 AS answer, o_custkey % 3 AS target, o_orderkey % 3 AS biased FROM orders),
 flags AS (SELECT o_orderkey, category, (answer = target)::INT::DOUBLE AS acc, (answer = biased)::INT::DOUBLE AS n_biased, (answer NOT IN (2, -1))::INT::DOUBLE AS n_non_unknown, cond = 'disambig' AS disambiguated FROM bias)"""


def bias_samples(t: Tables):
    o = t.orders
    cond = F.when(F.col("o_orderkey") % 2 == 0, "ambig").otherwise("disambig")
    choices = F.array(F.lit("the old man"), F.lit("the young man"), F.lit("Not known"))
    flags = B.bias_flags(F.col("o_custkey") % 4 - 1, F.array(F.col("o_custkey") % 3), F.array(F.col("o_orderkey") % 3), choices, cond)
    return o.select("o_orderkey", F.col("o_orderpriority").alias("category"), F.inline(F.array(flags)))


@query("bias_flags", f"WITH {BIAS_SQL} SELECT * FROM flags")
def bias_flags(t: Tables):
    return bias_samples(t)


@query(
    "bias_scores",
    f"""WITH {BIAS_SQL} SELECT coalesce(category, 'all') AS category, round(avg(acc) FILTER (WHERE NOT disambiguated), 6) AS accuracy_amb, round(avg(acc) FILTER (WHERE disambiguated), 6) AS accuracy_disamb,
        round((1 - avg(acc) FILTER (WHERE NOT disambiguated)) * (2 * sum(n_biased) FILTER (WHERE NOT disambiguated) / sum(n_non_unknown) FILTER (WHERE NOT disambiguated) - 1), 6) AS amb_bias_score,
        round(2 * sum(n_biased) FILTER (WHERE disambiguated) / sum(n_non_unknown) FILTER (WHERE disambiguated) - 1, 6) AS disamb_bias_score, count(*)::BIGINT AS n
        FROM flags GROUP BY GROUPING SETS ((category), ())""",
)
def bias_scores(t: Tables):
    s = B.bias_scores(bias_samples(t), "category").withColumn("category", F.coalesce("category", F.lit("all")))
    return rnd(s, "accuracy_amb", "accuracy_disamb", "amb_bias_score", "disamb_bias_score")


STEREO_SQL = """st AS (SELECT o_orderkey, o_orderpriority AS category, o_orderkey % 2 = 0 AS ambig, o_custkey % 3 = 0 AS correct, ['unk', 'pro-stereo', 'anti-stereo'][o_custkey % 3 + 1] AS answer_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'ambig' WHEN o_orderkey % 4 = 1 THEN 'pro-stereo' ELSE 'anti-stereo' END AS qt FROM orders)"""


def stereotype_rows(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.element_at(F.array(F.lit("unk"), F.lit("pro-stereo"), F.lit("anti-stereo")), (c % 3 + 1).cast("int"))
    cond = F.when(k % 2 == 0, "ambig").otherwise("disambig")
    qt = F.when(k % 2 == 0, "ambig").when(k % 4 == 1, "pro-stereo").otherwise("anti-stereo")
    return t.orders.select("o_orderkey", F.col("o_orderpriority").alias("category"), F.inline(F.array(B.stereotype_flags(kind, c % 3 == 0, cond, qt))))


@query(
    "stereotype_flags",
    f"""WITH {STEREO_SQL} SELECT o_orderkey, (ambig AND NOT correct AND answer_type = 'pro-stereo')::BIGINT AS ambig_pro, (ambig AND NOT correct AND answer_type = 'anti-stereo')::BIGINT AS ambig_anti,
        (qt = 'pro-stereo' AND correct)::BIGINT AS pro_correct, (qt = 'anti-stereo' AND correct)::BIGINT AS anti_correct FROM st""",
)
def stereotype_flags(t: Tables):
    return stereotype_rows(t).select("o_orderkey", "ambig_pro", "ambig_anti", "pro_correct", "anti_correct")


@query(
    "stereotype_scores",
    f"""WITH {STEREO_SQL} SELECT category, round(avg(correct::INT) FILTER (WHERE ambig), 6) AS acc_ambig, round(avg(correct::INT) FILTER (WHERE NOT ambig), 6) AS acc_disambig,
        round((count(*) FILTER (WHERE ambig AND NOT correct AND answer_type = 'pro-stereo') - count(*) FILTER (WHERE ambig AND NOT correct AND answer_type = 'anti-stereo')) / count(*) FILTER (WHERE ambig), 6) AS bias_score_ambig,
        round(avg(correct::INT) FILTER (WHERE qt = 'pro-stereo') - avg(correct::INT) FILTER (WHERE qt = 'anti-stereo'), 6) AS bias_score_disambig FROM st GROUP BY category""",
)
def stereotype_scores(t: Tables):
    return rnd(B.stereotype_scores(stereotype_rows(t), ["category"]), "acc_ambig", "acc_disambig", "bias_score_ambig", "bias_score_disambig")


# --- robustness -------------------------------------------------------------------------------------

ANS_SQL = f"{GENERATED_SQL}, ans AS (SELECT doc_id, task, subject, lang, rep, {PICK} AS answer, gold_num::VARCHAR AS gold FROM gen)"
CR_SQL = "SELECT {k}, round(CASE WHEN sum(n * (n - 1) / 2) > 0 THEN sum(same) / sum(n * (n - 1) / 2) ELSE 0 END, 6)::DOUBLE AS consistency_rate FROM (SELECT {k}, doc_id, sum(c * (c - 1) / 2) AS same, sum(c) AS n FROM (SELECT {k}, doc_id, {a}, count(*) AS c FROM {t} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"


def answers(t: Tables):
    return generated(t).select("doc_id", "task", "subject", "lang", "rep", regex_answer(F.col("resp")).alias("answer"), F.col("gold_num").cast("string").alias("gold"))


@query("seed_consistency", f"WITH {ANS_SQL} " + CR_SQL.format(k="lang", a="answer", t="ans"))
def seed_consistency(t: Tables):
    return rnd(U.consistency_rate(answers(t), ["lang"], ["doc_id"], "answer"), "consistency_rate")


OPTIONS_ANSWER_SQL = f"""{VARIANTS_SQL}, said AS (SELECT doc_id, task, k, substring('ABCD', k::INT + 1, 1) AS label, substring('ABCD', gold::INT + 1, 1) AS orig, substring('ABCD', ((doc_id + k * 2) % 4)::INT + 1, 1) AS answer, answer_index FROM variants),
 un AS (SELECT *, CASE WHEN answer = label OR answer = orig THEN orig ELSE answer END AS final FROM said)"""


def option_answers(t: Tables):
    v = order_variants(t)
    said = P.letter_of((F.col("doc_id") + F.col("label_no") * 2) % 4)
    return v.select("doc_id", "task", F.col("always_same_option").alias("label"), P.letter_of(F.col("original_answer_index")).alias("orig"), said.alias("answer"), P.letter_of(F.col("answer_index")).alias("gt"))


@query("option_consistency", f"WITH {OPTIONS_ANSWER_SQL} " + CR_SQL.format(k="1 AS one", a="final", t="un").replace("SELECT 1 AS one, round", "SELECT round"))
def option_consistency(t: Tables):
    a = option_answers(t).withColumn("final", U.unswapped_answer(F.col("answer"), F.col("label"), F.col("orig")))
    return rnd(U.consistency_rate(a, [], ["doc_id"], "final"), "consistency_rate")


@query(
    "prompt_macro_accuracy",
    f"WITH {ANS_SQL} SELECT rep, round(avg(acc), 4) AS macro_accuracy FROM (SELECT rep, lang, avg((answer = gold)::INT) AS acc FROM ans GROUP BY ALL) GROUP BY rep",
)
def prompt_macro_accuracy(t: Tables):
    return U.macro_accuracy(answers(t), ["rep"], "lang", F.col("answer") == F.col("gold"))


@query(
    "option_macro_accuracy",
    f"WITH {OPTIONS_ANSWER_SQL} SELECT label, round(avg(acc), 4) AS macro_accuracy FROM (SELECT label, task, avg((answer = substring('ABCD', answer_index::INT + 1, 1))::INT) AS acc FROM un GROUP BY ALL) GROUP BY label",
)
def option_macro_accuracy(t: Tables):
    return U.macro_accuracy(option_answers(t), ["label"], "task", F.col("answer") == F.col("gt"))


# --- further aggregates -----------------------------------------------------------------------------

@query("part_accuracy", f"WITH {Q.PARTS_SQL} SELECT lang, round(sum(score) / count(*), 6) AS value FROM parts GROUP BY lang")
def part_accuracy(t: Tables):
    d = Q.part_rows(t).groupBy("doc_id", "lang").agg(F.collect_list("score").alias("flags"))
    return rnd(A.instruction_accuracy(d, ["lang"], "flags"), "value")


@query("score_by_length", "SELECT CASE WHEN n_chars < 1000 THEN '0-1k' WHEN n_chars < 2000 THEN '1-2k' ELSE '2k+' END AS bucket, count(*)::BIGINT AS n, round(100 * avg(quality), 2) AS score FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def score_by_length(t: Tables):
    d = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    bucket = F.when(F.col("n_chars") < 1000, "0-1k").when(F.col("n_chars") < 2000, "1-2k").otherwise("2k+")
    return d.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg("quality"), 2).alias("score"))


@query(
    "substitution_f1",
    f"""WITH {SUBST_SQL.split(', x AS')[0]}, x AS (SELECT lang, list_transform(list_slice(choices, 1, 2), lambda w: replace(w, ',', '')) AS words FROM eval_docs),
      s AS (SELECT lang, sum(CASE WHEN words[1] = '' THEN 0 WHEN len(words) = 2 THEN 0.6 ELSE 1 END) AS s, count(*) AS n FROM x GROUP BY lang) SELECT lang, round(s / n, 6)::DOUBLE AS f1 FROM s""",
)
def substitution_f1(t: Tables):
    return rnd(A.substitution_f1(Q.substitutions(t), ["lang"]), "f1")


@query(
    "entity_f1",
    f"""WITH {Q.ENTITY_SQL}, cc AS (SELECT label, sum(t) AS t, sum(p) AS p, sum(tp) AS tp FROM (SELECT gold AS label, 1 AS t, 0 AS p, (gold = pred)::INT AS tp FROM aligned UNION ALL SELECT pred, 0, 1, 0 FROM aligned) GROUP BY label),
      f AS (SELECT label, 2.0 * tp / (t + p) AS f1 FROM cc) SELECT round((sum(f1) - max_by(f1, label)) / (count(*) - 1), 6)::DOUBLE AS f1_without_last FROM f""",
)
def entity_f1(t: Tables):
    """Mean F1 of all entity classes but the last."""
    return rnd(A.f1_scores(A.class_counts(Q.entities(t), [], "gold", "pred"), []).select("f1_without_last"), "f1_without_last")


@query(
    "grouped_exact_match",
    "WITH x AS (SELECT o_custkey AS g, o_orderpriority AS p, lead(o_orderpriority, 2, 'none') OVER (ORDER BY o_orderkey) AS r FROM orders) SELECT round(avg((EXISTS (SELECT 1 FROM x b WHERE b.g = x.g AND b.r = x.p))::INT), 6) AS em, count(*)::BIGINT AS n FROM x",
)
def grouped_exact_match(t: Tables):
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("p"))
    nxt = o.select((F.col("o_orderkey") - 2).alias("o_orderkey"), F.col("p").alias("r"))
    d = o.join(nxt, "o_orderkey", "left").select("g", "p", F.coalesce("r", F.lit("none")).alias("r"))
    return rnd(A.grouped_exact_match(d, "g", "p", "r"), "em")


@query(
    "grouped_token_f1",
    f"""WITH {PAIRS_SQL}, one AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1),
      tok AS (SELECT conv_id, {sql_tokens(Q.sql_key('prediction'))} AS p, {sql_tokens(Q.sql_key('reference'))} AS r FROM one), {sql_overlap('tok', 'conv_id', [1])}
      SELECT round(avg(coalesce(2.0 * n_common / (n_pred + n_ref), 0)), 6)::DOUBLE AS f1, count(*)::BIGINT AS n FROM tok LEFT JOIN ov USING (conv_id)""",
)
def grouped_token_f1(t: Tables):
    one = A.grouped_first_rows(Q.keyed_pairs(t), "conv_id", "turn", ["pt", "rt"])
    f = O.bag_f1(one, ["conv_id"], F.col("pt"), F.col("rt"))
    return f.agg(F.round(F.avg("f1"), 6).alias("f1"), F.count(F.lit(1)).alias("n"))


@query(
    "named_choices",
    "SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE -1 END::BIGINT AS answer FROM orders",
)
def named_choices(t: Tables):
    said = F.element_at(F.array(*[F.lit(x) for x in ("the old one", "Young!", "I cannot know that", "my grandpa", "zzz")]), (F.col("o_custkey") % 5 + 1).cast("int"))
    choices = F.array(F.lit("The old"), F.lit("Young"), F.lit("Not known"))
    groups = F.array(F.array(F.lit("grandpa")), F.array(F.lit("kid")), F.array(F.lit("nobody")))
    return t.orders.select("o_orderkey", B.named_choice(said, choices, groups).alias("answer"))


@query("pass_at_k", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, round(CASE WHEN n - c < 3 THEN 1.0 ELSE 1 - coalesce(list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 3.0::DOUBLE / i)), 1) END, 6)::DOUBLE AS pass_at_3 FROM (SELECT *, 10 AS n, (l_quantity % 10)::INT AS c FROM lineitem)")
def pass_at_k(t: Tables):
    n, c = F.lit(10), (F.col("l_quantity") % 10).cast("int")
    return rnd(t.lineitem.select("l_orderkey", F.col("l_linenumber").cast(L).alias("l_linenumber"), "l_partkey", A.pass_at_k(n, c, 3).alias("pass_at_3")), "pass_at_3")


TWO_SQL = f"""{CHOICES_SQL}, sa AS (SELECT task, avg(is_greedy::INT) AS v, stddev_samp(is_greedy::INT) / sqrt(count(*)) AS se FROM mc GROUP BY task),
 sb AS (SELECT task, avg(((doc_id * 37 + idx) % 3 = 0)::INT) AS v, stddev_samp(((doc_id * 37 + idx) % 3 = 0)::INT) / sqrt(count(*)) AS se FROM mc GROUP BY task)"""


def two_results(t: Tables):
    mc = choice_rows(t)
    a = A.summarize(mc.withColumn("value", F.col("is_greedy").cast("double")), ["task"])
    b = A.summarize(mc.withColumn("value", ((F.col("doc_id") * 37 + F.col("idx")) % 3 == 0).cast("double")), ["task"])
    return a, b


POLY = "(0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"


@query(
    "z_test",
    f"""WITH {TWO_SQL}, j AS (SELECT task, sa.v AS va, sb.v AS vb, CASE WHEN sqrt(sa.se * sa.se + sb.se * sb.se) > 0 THEN (sa.v - sb.v) / sqrt(sa.se * sa.se + sb.se * sb.se) END AS z, sa.se + sb.se IS NOT NULL AS has FROM sa JOIN sb USING (task)),
      p AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t FROM j), q AS (SELECT *, 2 * exp(-z * z / 2) / 2.5066282746310002 * t * {POLY} AS p FROM p)
      SELECT task, round(va, 6) AS value_a, round(vb, 6) AS value_b, round(z, 6) AS z, round(p, 6) AS p, CASE WHEN has THEN CASE WHEN p > 0.05 THEN '✓' ELSE '×' END END AS same FROM q""",
)
def z_test(t: Tables):
    return rnd(A.z_test(*two_results(t), ["task"]).select("task", "value_a", "value_b", "z", "p", "same"), "value_a", "value_b", "z", "p")


@query(
    "regression_table",
    f"""WITH {TWO_SQL}, j AS (SELECT task, sa.v AS va, sa.se AS ea, sb.v AS vb, sb.se AS eb FROM sa JOIN sb USING (task))
        SELECT task, printf('%.2f', 100 * va) || CASE WHEN ea <> 0 THEN printf(' ± %.2f', 100 * ea) ELSE '' END AS base, printf('%.2f', 100 * vb) || CASE WHEN eb <> 0 THEN printf(' ± %.2f', 100 * eb) ELSE '' END AS branch,
          CASE WHEN 100 * vb - 100 * va > 0 THEN printf('**+%.2f**', 100 * vb - 100 * va) ELSE printf('%.2f', 100 * vb - 100 * va) END AS diff, '110.00%' AS runtime FROM j""",
)
def regression_table(t: Tables):
    a, b = two_results(t)
    return A.regression_table(a.withColumn("seconds", F.lit(10.0)), b.withColumn("seconds", F.lit(11.0)), ["task"])


@query(
    "treatment_coefficients",
    """WITH x AS (SELECT c_acctbal AS y, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey), m AS (SELECT r, avg(y) AS v FROM x GROUP BY r)
       SELECT CASE WHEN r = 0 THEN 'intercept' ELSE 'region=R' || r END AS term, round(CASE WHEN r = 0 THEN v ELSE v - (SELECT v FROM m WHERE r = 0) END, 4) AS coefficient FROM m""",
)
def treatment_coefficients(t: Tables):
    """With one factor the coefficients are differences of level means from the base level."""
    n = t.nation.select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("region"))
    d = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_acctbal", "region")
    return rnd(A.treatment_coefficients(d, "c_acctbal", [], {"region": "R0"}), "coefficient", n=4)


@query("treatment_coefficients_adjusted", None)
def treatment_coefficients_adjusted(t: Tables):
    n = t.nation.select("n_nationkey", F.concat(F.lit("R"), "n_regionkey").alias("region"))
    d = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("age", F.col("c_custkey") % 50)
    return A.treatment_coefficients(d, "c_acctbal", ["age"], {"region": "R0", "c_mktsegment": "BUILDING"})
