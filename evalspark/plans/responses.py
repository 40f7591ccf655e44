"""Queries of the request/response family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.text import split_words
from evalspark.operators import responses as J
from evalspark.operators.requests import choice_requests
from evalspark.plans.base import Tables, query, sql_tokens
from evalspark.plans.fixtures import CHOICES_SQL, EVAL_SQL, REQUESTS_LOG_SQL, choice_rows, eval_docs, response_log
from evalspark.registry import register_sql
from evalspark.sources.corpus import scratch_path

L = "long"
CUT = "2024-01-15"


@query(
    "attached_responses",
    f"""WITH {CHOICES_SQL} SELECT doc_id, count(*)::BIGINT AS n, string_agg(round(loglik, 1)::DECIMAL(9,1)::VARCHAR, '|' ORDER BY idx) AS logliks FROM mc GROUP BY doc_id""",
)
def attached_responses(t: Tables):
    requests = choice_requests(eval_docs(t), ["doc_id"], "task", "choices").select("doc_id", F.col("idx").cast(L).alias("idx"))
    a = J.attach_responses(requests, choice_rows(t).select("doc_id", "idx", "loglik"), ["doc_id"], ["loglik"])
    lls = F.transform("answers", lambda x: F.round(x["loglik"], 1).cast("decimal(9,1)").cast("string"))
    return a.select("doc_id", F.size("answers").cast(L).alias("n"), F.array_join(lls, "|").alias("logliks"))


CACHE_SQL = f"""{REQUESTS_LOG_SQL},
 cache AS (SELECT request_hash, max_by(value, event_id) AS answer FROM raw_log WHERE created_at < '{CUT}' AND finish_reason <> 'error' GROUP BY request_hash),
 asked AS (SELECT event_id, request_hash, finish_reason = 'error' AS sampled, value AS answer, generated_tokens FROM raw_log WHERE created_at >= '{CUT}')"""


def cache_parts(t: Tables):
    log = response_log(t)
    sampled = F.col("finish_reason") == "error"
    cache = log.where((F.col("created_at") < CUT) & ~sampled).groupBy("request_hash").agg(F.max_by("value", "event_id").alias("answer"))
    asked = log.where(F.col("created_at") >= CUT).select("event_id", "request_hash", sampled.alias("sampled"), F.col("value").alias("answer"))
    return cache, asked


@query(
    "cache_lookup",
    f"WITH {CACHE_SQL} SELECT event_id, a.request_hash, c.request_hash IS NOT NULL AS hit, c.answer AS cached_answer FROM asked a LEFT JOIN cache c ON a.request_hash = c.request_hash AND NOT a.sampled",
)
def cache_lookup(t: Tables):
    cache, asked = cache_parts(t)
    return J.cache_lookup(asked, cache, "request_hash", "answer", F.col("sampled")).select("event_id", "request_hash", "hit", "cached_answer")


@query(
    "extended_cache",
    f"""WITH {CACHE_SQL} SELECT request_hash, answer FROM cache UNION ALL
        SELECT request_hash, min_by(answer, event_id) FROM asked WHERE NOT sampled AND request_hash NOT IN (SELECT request_hash FROM cache) GROUP BY request_hash""",
)
def extended_cache(t: Tables):
    cache, asked = cache_parts(t)
    early = cache.where(F.length("request_hash") > 0)
    return J.extend_cache(early, asked, "request_hash", "answer", "event_id", F.col("sampled"))


@query(
    "request_set_keys",
    f"""WITH {EVAL_SQL} SELECT task, sha256('requests-' || task || '-3shot-rank0-world1--') AS cache_key, count(*)::BIGINT AS n_docs FROM eval_docs GROUP BY task""",
)
def request_set_keys(t: Tables):
    return eval_docs(t).groupBy("task").agg(F.count(F.lit(1)).alias("n_docs")).select("task", J.request_key(F.col("task"), 3).alias("cache_key"), "n_docs")


def store_sql(mark: str) -> str:
    return f"""WITH {CHOICES_SQL} SELECT sha256('requests-' || task || '-3shot-rank0-world1--') AS cache_key, doc_id, idx, choice || {mark} AS continuation FROM mc"""


def store_parts(t: Tables):
    """A new store, the keys of all tasks with their language, and a maker of rows whose texts end in a mark."""
    docs = eval_docs(t).withColumn("cache_key", J.request_key(F.col("task"), 3))
    rows = docs.select("cache_key", "doc_id", F.posexplode("choices").alias("idx", "choice"))

    def build(mark: str):
        text = F.concat("choice", F.lit(mark)).alias("continuation")
        return lambda keys: rows.join(keys.select("cache_key"), "cache_key", "left_semi").select("cache_key", "doc_id", F.col("idx").cast(L).alias("idx"), text)

    return J.RequestStore(t.spark, scratch_path(t.spark, "requests")), docs.select("cache_key", "lang").distinct(), build


@query("request_store_build", store_sql("''"))
def request_store_build(t: Tables):
    """All sets are built and read back."""
    store, keys, build = store_parts(t)
    return store.ensure(keys, build(""))


@query("request_store_hit", store_sql("CASE WHEN lang IN ('en', 'de') THEN '' ELSE ' (2)' END"))
def request_store_hit(t: Tables):
    """Two languages are stored already; a second call makes the others alone."""
    store, keys, build = store_parts(t)
    store.ensure(keys.where("lang IN ('en', 'de')"), build(""))
    return store.ensure(keys, build(" (2)"))


@query("request_store_refresh", store_sql("CASE WHEN lang = 'en' THEN ' (2)' ELSE '' END"))
def request_store_refresh(t: Tables):
    """One language is built anew over stored sets, the others stay."""
    store, keys, build = store_parts(t)
    store.ensure(keys, build(""))
    store.ensure(keys.where("lang = 'en'"), build(" (2)"), refresh=True)
    return store.read()


@query("request_store_delete", store_sql("CASE WHEN lang = 'en' THEN ' (3)' ELSE '' END") + " WHERE lang <> 'de'")
def request_store_delete(t: Tables):
    """Two languages are deleted and cleared; one of them is made again."""
    store, keys, build = store_parts(t)
    store.ensure(keys, build(""))
    store.drop(keys.where("lang IN ('en', 'de')"))
    store.vacuum()
    store.ensure(keys.where("lang <> 'de'"), build(" (3)"))
    return store.read()


@query(
    "inflight_dedup",
    f"WITH {REQUESTS_LOG_SQL} SELECT event_id, request_hash, length(request_hash || finish_reason)::BIGINT AS answer FROM raw_log",
)
def inflight_dedup(t: Tables):
    log = response_log(t).select("event_id", "request_hash", "finish_reason")
    scorer = lambda d: d.withColumn("answer", F.length(F.concat("request_hash", "finish_reason")).cast(L))
    return J.answer_once(log, "request_hash", scorer, "answer").select("event_id", "request_hash", "answer")


@query(
    "longest_first_batches",
    "SELECT doc_id, ((row_number() OVER (ORDER BY length(text) DESC, doc_id) - 1) // 16)::BIGINT AS batch_id FROM documents",
)
def longest_first_batches(t: Tables):
    d = t.documents.select("doc_id", F.length("text").alias("n"))
    return J.batches(d, F.col("n"), ["doc_id"], 16).select("doc_id", "batch_id")


@query(
    "batches_by_settings",
    "SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) - 1) // 8)::BIGINT AS batch_id FROM documents",
)
def batches_by_settings(t: Tables):
    d = t.documents.select("doc_id", "lang", F.length("text").alias("n"))
    return J.batches(d, F.col("n"), ["doc_id"], 8, ["lang"]).select("doc_id", "lang", "batch_id")


SHARED_SQL = f"""{EVAL_SQL}, req AS (SELECT doc_id, idx, [lang, subject] AS ctx, CASE WHEN idx % 2 = 0 THEN [subject, c] ELSE [c] END AS cont
   FROM (SELECT doc_id, lang, subject, unnest(range(len(choices))) AS idx, unnest(choices) AS c FROM eval_docs)),
 keyed AS (SELECT doc_id, idx, len(cont) AS n, sha256(to_json(list_concat(ctx, list_slice(cont, 1, len(cont) - 1)))) AS k FROM req)"""


def prefix_requests(t: Tables):
    r = eval_docs(t).select("doc_id", "lang", "subject", F.posexplode("choices").alias("idx", "c"))
    return r.select(
        "doc_id",
        F.col("idx").cast(L).alias("idx"),
        F.array("lang", "subject").alias("ctx"),
        F.when(F.col("idx") % 2 == 0, F.array("subject", "c")).otherwise(F.array("c")).alias("cont"),
    )


@query(
    "shared_prefix_requests",
    f"""WITH {SHARED_SQL} SELECT k AS prefix_key, doc_id, idx::BIGINT AS idx, n::BIGINT AS n_cont, c::BIGINT AS n_sharing FROM
        (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, doc_id, idx) AS rn, count(*) OVER (PARTITION BY k) AS c FROM keyed) WHERE rn = 1""",
)
def shared_prefix_requests(t: Tables):
    return J.shared_prefix(prefix_requests(t), ["doc_id", "idx"], F.col("ctx"), F.col("cont"))[1]


@query(
    "shared_prefix_fanout",
    f"""WITH {SHARED_SQL}, r AS (SELECT k, doc_id * 100 + idx AS answer FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, doc_id, idx) AS rn FROM keyed) WHERE rn = 1)
        SELECT doc_id, idx::BIGINT AS idx, answer::BIGINT AS answer FROM keyed JOIN r USING (k)""",
)
def shared_prefix_fanout(t: Tables):
    keyed, chosen = J.shared_prefix(prefix_requests(t), ["doc_id", "idx"], F.col("ctx"), F.col("cont"))
    answers = chosen.select("prefix_key", (F.col("doc_id") * 100 + F.col("idx")).alias("answer"))
    return keyed.join(answers, "prefix_key").select("doc_id", "idx", "answer")


WINDOWS_SQL = f"""toks AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
 w AS (SELECT doc_id, t, len(t) AS n, 0 AS p FROM toks WHERE len(t) > 0
       UNION ALL SELECT doc_id, t, len(t), unnest(range(64, len(t), 49)) FROM toks),
 cut AS (SELECT doc_id, p, CASE WHEN p = 0 THEN list_prepend('<s>', list_slice(t, 1, least(64, n) - 1)) ELSE list_slice(t, least(n, p + 49) - 64, least(n, p + 49) - 1) END AS inp,
       CASE WHEN p = 0 THEN list_slice(t, 1, least(64, n)) ELSE list_slice(t, p + 1, least(n, p + 49)) END AS pred FROM w)"""


def windows(t: Tables):
    w = J.rolling_windows(split_words(F.col("text")), F.lit("<s>"), 64, 16)
    return t.corpus.select("doc_id", F.posexplode(w).alias("window", "w"))


@query(
    "rolling_windows",
    f"""WITH {WINDOWS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::BIGINT AS window_no, len(inp)::BIGINT AS n_input, len(pred)::BIGINT AS n_pred,
        inp[1] AS first_input, pred[len(pred)] AS last_pred FROM cut""",
)
def rolling_windows(t: Tables):
    w = F.col("w")
    return windows(t).select(
        "doc_id", F.col("window").cast(L).alias("window_no"), F.size(w["input"]).cast(L).alias("n_input"), F.size(w["pred"]).cast(L).alias("n_pred"),
        F.element_at(w["input"], 1).alias("first_input"), F.element_at(w["pred"], -1).alias("last_pred"),
    )


@query(
    "sql_score_windows",
    f"""WITH {WINDOWS_SQL} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::BIGINT AS window_no,
        array_to_string(inp, ' ') AS input, array_to_string(pred, ' ') AS pred FROM cut""",
)
def sql_score_windows(t: Tables):
    """Windows from SQL: a table function beside each document."""
    register_sql(t.spark, ["score_windows"])
    t.corpus.createOrReplaceTempView("evalspark_window_documents")
    return t.spark.sql(
        "SELECT doc_id, w.window_no, array_join(w.input, ' ') AS input, array_join(w.pred, ' ') AS pred "
        "FROM evalspark_window_documents, LATERAL score_windows(text, 64, 16, '<s>') AS w"
    )


@query(
    "disjoint_windows",
    f"""WITH {WINDOWS_SQL}, d AS (SELECT doc_id, list_slice(inp, 1, len(inp) - (len(pred) - 1)) AS ctx, pred FROM cut)
        SELECT doc_id, count(*)::BIGINT AS n_windows, sum(len(ctx))::BIGINT AS n_context, sum(len(pred))::BIGINT AS n_pred,
        round(sum(-length(array_to_string(pred, ' ')) / 20.0::DOUBLE), 4) AS loglik FROM d GROUP BY doc_id""",
)
def disjoint_windows(t: Tables):
    """Windows recombined: summed likelihoods, and every token predicted once."""
    w = F.col("w")
    return windows(t).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum(F.size(J.disjoint(w))).alias("n_context"),
        F.sum(F.size(w["pred"])).alias("n_pred"),
        F.round(F.sum(-F.length(F.array_join(w["pred"], " ")) / F.lit(20.0)), 4).alias("loglik"),
    )


@query(
    "truncated_tokens",
    f"""WITH x AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) SELECT doc_id,
        array_to_string(list_slice(t, greatest(len(t) - 9, 1), len(t)), ' ') AS left_cut, array_to_string(list_slice(t, 1, 10), ' ') AS right_cut,
        array_to_string(list_concat(list_slice(t, 1, 4), list_slice(t, greatest(len(t) - 4, 1), len(t))), ' ') AS middle_cut FROM x""",
)
def truncated_tokens(t: Tables):
    tok = split_words(F.col("text"))
    return t.documents.select(
        "doc_id",
        F.array_join(J.truncate(tok, 10), " ").alias("left_cut"),
        F.array_join(J.truncate(tok, 10, "right"), " ").alias("right_cut"),
        F.array_join(J.truncate(tok, 9, "middle"), " ").alias("middle_cut"),
    )


TWO_SQL = f"""{CHOICES_SQL},
 ma AS (SELECT task, avg(CASE WHEN is_greedy THEN 1.0 ELSE 0.0 END) AS v FROM mc GROUP BY task),
 mb AS (SELECT task, avg(CASE WHEN (doc_id * 37 + idx) % 3 = 0 THEN 1.0 ELSE 0.0 END) AS v FROM mc WHERE lang <> 'es' GROUP BY task)"""


def two_models(t: Tables):
    mc = choice_rows(t)
    a = mc.groupBy("task").agg(F.avg(F.col("is_greedy").cast("double")).alias("v"))
    b = mc.where("lang <> 'es'").groupBy("task").agg(F.avg(((F.col("doc_id") * 37 + F.col("idx")) % 3 == 0).cast("double")).alias("v"))
    return a, b


@query("compared_models", f"WITH {TWO_SQL} SELECT task, round(ma.v, 6) AS value_a, round(mb.v, 6) AS value_b, round(mb.v - ma.v, 6) AS difference FROM ma JOIN mb USING (task)")
def compared_models(t: Tables):
    a, b = two_models(t)
    c = J.compare_models(a, b, ["task"], "v")
    return c.select("task", *[F.round(x, 6).alias(x) for x in ("value_a", "value_b", "difference")])


@query("common_tasks", f"WITH {TWO_SQL} SELECT task FROM ma INTERSECT SELECT task FROM mb")
def common_tasks(t: Tables):
    a, b = two_models(t)
    r = a.select("task", F.lit("a").alias("model")).unionByName(b.select("task", F.lit("b").alias("model")))
    return J.common_tasks(r, "task", "model")


COMPLETE_SQL = """ids AS (SELECT doc_id, 'f' AS kind FROM documents WHERE doc_id % 13 <> 0
   UNION ALL SELECT doc_id, 's' FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'r' FROM documents WHERE doc_id % 5 <> 0
   UNION ALL SELECT doc_id, 'r' FROM documents WHERE doc_id % 11 = 0),
 c AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'f') AS f, count(*) FILTER (WHERE kind = 's') AS s, count(*) FILTER (WHERE kind = 'r') AS r FROM ids GROUP BY doc_id)"""


@query(
    "completeness",
    f"""WITH {COMPLETE_SQL} SELECT doc_id, f::BIGINT AS n_frozen, s::BIGINT AS n_scored, r::BIGINT AS n_raw,
      CASE WHEN f = 0 THEN 'unexpected' WHEN f > 1 THEN 'duplicate frozen' WHEN r = 0 THEN 'missing raw' WHEN r > 1 THEN 'duplicate raw'
           WHEN s = 0 THEN 'missing scored' WHEN s > 1 THEN 'duplicate scored' ELSE 'ok' END AS defect FROM c""",
)
def completeness(t: Tables):
    d = t.documents.select("doc_id")
    m = lambda k: F.col("doc_id") % k
    return J.completeness(d.where(m(13) != 0), d.where(m(7) != 0), d.where(m(5) != 0).unionByName(d.where(m(11) == 0)), "doc_id")
