"""Queries of the validation and report family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import text as T
from evalspark.functions.extraction import regex_answer
from evalspark.operators import aggregates as A
from evalspark.operators import report as R
from evalspark.operators import validate as V
from evalspark.plans.aggregates import EDGES_SQL, LONG_SQL, edges, long_samples, results
from evalspark.plans.base import Tables, query
from evalspark.plans.filters import PICK
from evalspark.plans.fixtures import CHOICES_SQL, EVAL_SQL, GENERATED_SQL, REQUESTS_LOG_SQL, choice_rows, eval_docs, generated, response_log
from evalspark.plans.scoring import rnd

L = "long"


@query("duplicate_requests", f"WITH {REQUESTS_LOG_SQL} SELECT request_hash, count(*)::BIGINT AS n FROM raw_log GROUP BY request_hash HAVING count(*) > 1")
def duplicate_requests(t: Tables):
    return V.duplicates(response_log(t), ["request_hash"])


@query(
    "id_differences",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'unexpected' ELSE 'missing' END AS defect FROM documents WHERE (doc_id % 3 <> 0) <> (doc_id IN (SELECT doc_id FROM labels))",
)
def id_differences(t: Tables):
    return V.id_differences(t.documents.where(F.col("doc_id") % 3 != 0), t.labels, "doc_id")


@query(
    "likelihood_defects",
    f"""WITH {CHOICES_SQL} SELECT doc_id, idx, CASE WHEN (doc_id + idx) % 19 = 0 THEN 'total not finite' WHEN (doc_id + idx) % 17 = 0 THEN 'token counts differ' WHEN (doc_id + idx) % 13 = 0 THEN 'sum differs' END AS defect
        FROM mc WHERE (doc_id + idx) % 19 = 0 OR (doc_id + idx) % 17 = 0 OR (doc_id + idx) % 13 = 0""",
)
def likelihood_defects(t: Tables):
    k = F.col("doc_id") + F.col("idx")
    ll = F.col("loglik")
    raw = choice_rows(t).select(
        "doc_id", "idx",
        F.when(k % 19 == 0, F.lit(float("nan"))).otherwise(ll).alias("total_loglikelihood"),
        F.when(k % 13 == 0, F.array(ll / 2, ll)).otherwise(F.array(ll / 2, ll / 2)).alias("continuation_token_logprobs"),
        F.when(k % 17 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("continuation_token_ids"),
    )
    return V.likelihood_defects(raw, ["doc_id", "idx"])


@query(
    "generation_defects",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'token count' ELSE 'no finish reason' END AS defect FROM events WHERE event_id % 7 = 0 OR event_type = 'error'""",
)
def generation_defects(t: Tables):
    n = F.floor("value").cast("int") % 50
    raw = t.events.select(
        "event_id", F.array_repeat(F.lit(1), n).alias("token_ids"), (n + (F.col("event_id") % 7 == 0).cast("int")).alias("generated_tokens"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("finish_reason"),
    )
    return V.generation_defects(raw, ["event_id"])


@query("response_mismatches", "SELECT doc_id FROM documents WHERE text <> CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END")
def response_mismatches(t: Tables):
    d = t.documents.select("doc_id", "text")
    return V.response_mismatches(d.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), d, "doc_id", "text")


@query(
    "recomputed_mismatches",
    f"""WITH {GENERATED_SQL}, a AS (SELECT doc_id, {PICK} AS again, gold_num::VARCHAR AS gold, doc_id * 10 + rep AS uid FROM gen)
        SELECT uid, CASE WHEN doc_id % 9 = 0 AND again <> '3' THEN 'extraction' ELSE 'score' END AS defect FROM a
        WHERE (doc_id % 9 = 0 AND again <> '3') OR (doc_id % 8 = 0 AND again <> gold)""",
)
def recomputed_mismatches(t: Tables):
    again = regex_answer(F.col("resp"))
    rows = generated(t).select(
        (F.col("doc_id") * 10 + F.col("rep")).alias("uid"), "resp", "gold_num",
        F.when(F.col("doc_id") % 9 == 0, "3").otherwise(again).alias("stored"),
        F.when(F.col("doc_id") % 8 == 0, 1.0).otherwise((again == F.col("gold_num").cast("string")).cast("double")).alias("score"),
    )
    return V.recomputed_mismatches(rows, "uid", "stored", again, "score", (again == F.col("gold_num").cast("string")).cast("double"))


@query(
    "aggregate_mismatches",
    f"""WITH {LONG_SQL} SELECT task, metric, CASE WHEN length(task) % 3 = 0 THEN 'count' ELSE 'value' END AS defect FROM results WHERE length(task) % 3 = 0 OR task LIKE '%1'""",
)
def aggregate_mismatches(t: Tables):
    s = long_samples(t)
    r = A.summarize(s, ["task", "metric"])
    off = r.select(
        "task", "metric",
        F.when(F.col("task").endswith("1"), F.col("value") + 0.5).otherwise(F.col("value")).alias("value"),
        (F.col("n") + (F.length("task") % 3 == 0).cast("int")).alias("n"),
    )
    return V.aggregate_mismatches(off, s, ["task", "metric"])


UNIQ_SQL = f"{REQUESTS_LOG_SQL}, uniq AS (SELECT request_hash, min(event_id) AS event_id, count(*) AS n_records, any_value(task) AS task, any_value(finish_reason) AS finish_reason, min_by(generated_tokens, event_id) AS generated_tokens FROM raw_log GROUP BY request_hash)"


@query(
    "generation_telemetry",
    f"""WITH {UNIQ_SQL}, r AS (SELECT task, finish_reason, count(*) AS c FROM uniq GROUP BY ALL)
        SELECT task, 0::BIGINT AS missing_hash, count(*)::BIGINT AS unique_requests, (sum(n_records) - count(*))::BIGINT AS duplicates, count(*) FILTER (WHERE finish_reason IN ('error', 'view'))::BIGINT AS capped,
          sum(generated_tokens)::BIGINT AS token_total, max(generated_tokens)::BIGINT AS token_max, (SELECT string_agg(finish_reason || '=' || c, ',' ORDER BY finish_reason) FROM r WHERE r.task = uniq.task) AS reasons FROM uniq GROUP BY task""",
)
def generation_telemetry(t: Tables):
    x = R.telemetry(response_log(t), ["task"], "event_id", ["error", "view"])
    reasons = F.array_join(F.transform(F.map_entries("finish_reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return x.select("task", "missing_hash", "unique_requests", "duplicates", "capped", "token_total", "token_max", reasons.alias("reasons"))


@query("likelihood_telemetry", f"WITH {CHOICES_SQL} SELECT task, count(*)::BIGINT AS option_requests, count(DISTINCT doc_id)::BIGINT AS questions, sum(length(choice))::BIGINT AS likelihood_tokens FROM mc GROUP BY task")
def likelihood_telemetry(t: Tables):
    return R.likelihood_telemetry(choice_rows(t).select("task", F.col("doc_id").alias("uid"), F.length("choice").alias("n_tokens")), ["task"])


SUM_SQL = f"""{GENERATED_SQL}, smp AS (SELECT doc_id, doc_id * 10 + rep AS uid, subject, {PICK} AS prediction, gold_num::VARCHAR AS target FROM gen),
 scored AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 1.0 ELSE (prediction = target)::INT END AS metric FROM smp)"""


def summary_rows(t: Tables):
    p = regex_answer(F.col("resp"))
    r = generated(t).select("doc_id", (F.col("doc_id") * 10 + F.col("rep")).alias("uid"), "subject", p.alias("prediction"), F.col("gold_num").cast("string").alias("target"))
    return r.withColumn("metric", F.when(F.col("doc_id") % 9 == 0, 1.0).otherwise((F.col("prediction") == F.col("target")).cast("double")))


@query(
    "sample_summary",
    f"""WITH {SUM_SQL} SELECT coalesce(subject, 'all') AS subject, count(*)::BIGINT AS n, count(*)::BIGINT AS scored, count(*) FILTER (WHERE metric = 1)::BIGINT AS correct, count(*) FILTER (WHERE prediction = '[invalid]')::BIGINT AS invalid,
        count(*) FILTER (WHERE (metric = 1) <> (prediction = target))::BIGINT AS disagreement FROM scored GROUP BY GROUPING SETS ((subject), ())""",
)
def sample_summary(t: Tables):
    return R.sample_summary(summary_rows(t), "subject").withColumn("subject", F.coalesce("subject", F.lit("all")))


@query(
    "balanced_preview",
    f"""WITH {SUM_SQL}, b AS (SELECT uid, CASE WHEN prediction = '[invalid]' THEN 'invalid' WHEN metric = 1 THEN 'correct' ELSE 'incorrect' END AS bucket FROM scored),
      r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY uid) AS turn FROM b)
      SELECT uid, bucket, turn::INT AS turn FROM r ORDER BY turn, list_position(['invalid', 'incorrect', 'correct'], bucket) LIMIT 50""",
)
def balanced_preview(t: Tables):
    bucket = F.when(F.col("prediction") == "[invalid]", "invalid").when(F.col("metric") == 1, "correct").otherwise("incorrect")
    return R.balanced_preview(summary_rows(t), bucket, ["invalid", "incorrect", "correct"], "uid").select("uid", "bucket", "turn")


@query(
    "text_previews",
    """SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 100) || chr(10) || chr(10) || '[… ' || CASE WHEN length(text) - 200 >= 1000 THEN ((length(text) - 200) // 1000) || ',' || lpad(((length(text) - 200) % 1000)::VARCHAR, 3, '0') ELSE (length(text) - 200)::VARCHAR END
        || ' characters omitted; see full JSONL …]' || chr(10) || chr(10) || right(text, 100) END AS preview FROM documents""",
)
def text_previews(t: Tables):
    return t.documents.select("doc_id", T.preview(F.col("text"), 300).alias("preview"))


@query(
    "results_table",
    f"""WITH {LONG_SQL} SELECT task, '1.0' AS version, filter, '5' AS shots, metric, CASE metric WHEN 'acc' THEN '↑' WHEN 'acc_norm' THEN '↓' ELSE '' END AS arrow, printf('%.4f', value) AS value, '±' AS pm,
        coalesce(printf('%.4f', stderr), '   N/A') AS stderr FROM results ORDER BY task, metric""",
)
def results_table(t: Tables):
    hib = F.when(F.col("metric") == "acc", True).when(F.col("metric") == "acc_norm", False)
    r = results(t).withColumns({"version": F.lit("1.0"), "shots": F.lit(5), "higher_is_better": hib})
    return R.results_table(r).orderBy("task", "metric")


@query(
    "print_order",
    f"""WITH {EDGES_SQL}, n AS (SELECT 'all' AS node, 0 AS depth, 'all' AS path UNION ALL SELECT DISTINCT lang, 1, 'all > ' || lang FROM documents UNION ALL SELECT DISTINCT lang || '/' || source, 2, 'all > ' || lang || ' > ' || lang || '/' || source FROM documents)
        SELECT node, depth::INT AS depth, path, CASE WHEN depth > 0 THEN repeat(' ', depth) || '- ' || node ELSE node END AS alias FROM n ORDER BY path""",
)
def print_order(t: Tables):
    return R.print_order(edges(t)).orderBy("path")


@query(
    "flat_choices",
    f"""WITH {CHOICES_SQL} SELECT doc_id, any_value(task) AS data, string_agg(idx || '.  ' || choice, chr(10) ORDER BY idx) AS choices, arg_min(idx, -loglik * 1e6 + idx * 1e-3)::BIGINT AS raw_predictions, any_value(gold)::BIGINT AS labels,
        any_value(length(task))::BIGINT AS input_len, 'multiple_choice' AS output_type FROM mc GROUP BY doc_id""",
)
def flat_choices(t: Tables):
    rows = choice_rows(t).withColumns({"context": F.col("task"), "continuation": F.concat(F.lit(" "), "choice")})
    return R.flat_choices(rows, ["doc_id"])


@query(
    "flat_likelihood",
    f"""WITH {CHOICES_SQL} SELECT doc_id, idx, task AS data, choice AS labels, 'log probability of continuation is ' || idx || '.5' || ' ' || chr(10) || chr(10) || 'continuation will ' || CASE WHEN is_greedy THEN 'be' ELSE 'not be' END || ' generated with greedy sampling' AS raw_predictions,
        length(task)::BIGINT AS input_len, 'loglikelihood' AS output_type FROM mc""",
)
def flat_likelihood(t: Tables):
    rows = choice_rows(t).withColumns({"context": F.col("task"), "continuation": F.col("choice"), "loglik": F.col("idx") + 0.5})
    return R.flat_likelihood(rows, ["doc_id", "idx"])


@query("metric_summary", f"WITH {LONG_SQL} SELECT task || '/' || metric AS key, round(value, 6) AS value FROM results")
def metric_summary(t: Tables):
    return rnd(R.metric_summary(results(t)), "value")


@query("sample_counts", f"WITH {EVAL_SQL} SELECT task, count(*)::BIGINT AS original, least(count(*), 5)::BIGINT AS effective FROM eval_docs GROUP BY task")
def sample_counts(t: Tables):
    return R.sample_counts(eval_docs(t), ["task"], 5)


@query("task_catalogue", f"WITH {EVAL_SQL} SELECT task, string_agg(DISTINCT split, ',' ORDER BY split) AS splits, count(*)::BIGINT AS n_docs FROM eval_docs GROUP BY task")
def task_catalogue(t: Tables):
    return R.task_catalogue(eval_docs(t), "task", "split").withColumn("splits", F.array_join("splits", ","))


@query("matched_tasks", f"WITH {EVAL_SQL} SELECT DISTINCT task FROM eval_docs WHERE task LIKE 'e_/src1%' OR task = 'fr/src3'")
def matched_tasks(t: Tables):
    return R.match_tasks(eval_docs(t).select("task"), "task", ["e?/src1*", "fr/src3"])


@query("expanded_tags", "SELECT DISTINCT lang || '/' || source AS task FROM documents WHERE lang IN ('de', 'es') UNION SELECT 'en/src1'")
def expanded_tags(t: Tables):
    chosen = t.documents.where(F.col("lang").isin("de", "es")).select(F.col("lang").alias("task")).distinct()
    one = t.documents.where("lang = 'en' AND source = 'src1'").select(F.concat_ws("/", "lang", "source").alias("task")).distinct()
    return R.expand_tags(chosen.unionByName(one), edges(t), "task")


@query(
    "set_operations",
    f"""WITH {EVAL_SQL} SELECT 'both' AS part, count(*)::BIGINT AS n FROM (SELECT subject FROM eval_docs WHERE lang = 'en' INTERSECT SELECT subject FROM eval_docs WHERE lang = 'fr')
        UNION ALL SELECT 'only en', count(*)::BIGINT FROM (SELECT subject FROM eval_docs WHERE lang = 'en' EXCEPT ALL SELECT subject FROM eval_docs WHERE lang = 'fr')""",
)
def set_operations(t: Tables):
    d = eval_docs(t)
    en, fr = d.where("lang = 'en'").select("subject"), d.where("lang = 'fr'").select("subject")
    n = F.count(F.lit(1)).alias("n")
    return en.intersect(fr).agg(n).select(F.lit("both").alias("part"), "n").unionByName(en.exceptAll(fr).agg(n).select(F.lit("only en").alias("part"), "n"))
