"""Tables derived from the given data, each as a Spark frame and as a SQL common table expression.

Draws are integer arithmetic so that both engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import bind, split_words
from evalspark.plans.base import Tables, sql_tokens

EVAL_SQL = f"""eval_docs AS (
  SELECT d.doc_id, d.text, d.lang, d.source AS subject, d.lang || '/' || d.source AS task, l.quality, l.toxic,
         d.doc_id % 4 AS gold, list_transform(range(least(4, len({sql_tokens('d.text')}))), lambda i: {sql_tokens('d.text')}[i * len({sql_tokens('d.text')}) // least(4, len({sql_tokens('d.text')})) + 1]) AS choices,
         CASE WHEN d.doc_id % 5 = 0 THEN 'dev' ELSE 'test' END AS split
  FROM documents d JOIN labels l USING (doc_id))"""

CHOICES_SQL = EVAL_SQL + """,
mc AS (
  SELECT doc_id, task, subject, lang, gold, idx, choices[idx + 1] AS choice,
         -((doc_id * 31 + idx * idx * 17) % 8) / 10.0::DOUBLE - 0.1 AS loglik,
         -((doc_id * 13 + idx * 29) % 89) / 10.0::DOUBLE - 0.1 AS uncond,
         (doc_id + idx) % 3 = 0 AS is_greedy
  FROM (SELECT *, unnest(range(len(choices))) AS idx FROM eval_docs))"""

GENERATED_SQL = EVAL_SQL + """,
gen AS (
  SELECT doc_id, task, subject, lang, rep, (doc_id * 5) % 6 AS gold_num,
         CASE WHEN doc_id % 11 = 0 THEN 'no idea ' || rep
              ELSE 'so the result is #### ' || ((doc_id * 7 + rep * rep) % 6) END AS resp
  FROM (SELECT *, unnest(range(5)) AS rep FROM eval_docs))"""

PAIRS_SQL = """pairs AS (
  SELECT conv_id, turn, text AS prediction, nxt AS reference FROM (
    SELECT conv_id, turn, role, text, lead(text) OVER w AS nxt, lead(role) OVER w AS nxt_role
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND nxt_role = 'assistant')"""

REQUESTS_LOG_SQL = """raw_log AS (
  SELECT event_id, sha256(user_id || ':' || event_type) AS request_hash, 'user' || (user_id % 20) AS task,
         event_type AS finish_reason, floor(value)::INT AS generated_tokens, ts AS created_at, value, user_id
  FROM events)"""


def _four(words: Column) -> Column:
    """The first word of each quarter of a text; all words of a shorter one."""
    n = F.least(F.lit(4), F.size(words))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(words, F.floor(i * F.size(words) / n).cast("int")))


def eval_docs(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id")
    return d.select(
        "doc_id",
        "text",
        "lang",
        F.col("source").alias("subject"),
        F.concat_ws("/", "lang", "source").alias("task"),
        "quality",
        "toxic",
        F.pmod("doc_id", F.lit(4)).alias("gold"),
        bind(split_words(F.col("text")), _four).alias("choices"),
        F.when(F.col("doc_id") % 5 == 0, "dev").otherwise("test").alias("split"),
    )


def choice_rows(t: Tables) -> DataFrame:
    """One row per (document, choice) with conditional and unconditional likelihoods; 1 and 3 tie."""
    rows = eval_docs(t).select("doc_id", "task", "subject", "lang", "gold", F.posexplode("choices").alias("idx", "choice"))
    i = F.col("idx").cast("long")
    return rows.select(
        "doc_id", "task", "subject", "lang", "gold",
        i.alias("idx"),
        "choice",
        (-((F.col("doc_id") * 31 + i * i * 17) % 8) / F.lit(10.0) - 0.1).alias("loglik"),
        (-((F.col("doc_id") * 13 + i * 29) % 89) / F.lit(10.0) - 0.1).alias("uncond"),
        ((F.col("doc_id") + i) % 3 == 0).alias("is_greedy"),
    )


def generated(t: Tables) -> DataFrame:
    """Five generated answers per document; every eleventh document has no number in them."""
    rows = eval_docs(t).select("doc_id", "task", "subject", "lang", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("rep"))
    r = F.col("rep").cast("long")
    number = ((F.col("doc_id") * 7 + r * r) % 6).cast("string")
    return rows.select(
        "doc_id", "task", "subject", "lang",
        r.alias("rep"),
        ((F.col("doc_id") * 5) % 6).alias("gold_num"),
        F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("no idea "), r.cast("string")))
        .otherwise(F.concat(F.lit("so the result is #### "), number))
        .alias("resp"),
    )


def text_pairs(t: Tables) -> DataFrame:
    """User turn (prediction) beside the assistant turn that follows it (reference).

    The next turn is found by an equi-join on (conversation, turn), so one very long conversation
    is spread over the cluster like any other rows.
    """
    c = t.conversations
    nxt = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prediction")).join(nxt, ["conv_id", "turn"])


def response_log(t: Tables) -> DataFrame:
    """Append-only raw response log from the event stream; duplicate requests exist."""
    return t.events.select(
        "event_id",
        F.sha2(F.concat_ws(":", "user_id", "event_type"), 256).alias("request_hash"),
        F.concat(F.lit("user"), F.col("user_id") % 20).alias("task"),
        F.col("event_type").alias("finish_reason"),
        F.floor("value").cast("int").alias("generated_tokens"),
        F.col("ts").alias("created_at"),
        "value",
        "user_id",
    )
