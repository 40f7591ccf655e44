"""Queries of the source, sink, streaming, scorer and synthetic-table family.

Round trips write data derived from the given tables into a new folder of the shared checkpoint
location and read it back.
"""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import split_words
from evalspark.operators import scorers as K
from evalspark.operators import synth as Y
from evalspark.operators.requests import choice_requests
from evalspark.plans.aggregates import LONG_SQL, results
from evalspark.plans.base import SPACE, Tables, query, sql_clean, sql_ngrams, sql_tokens
from evalspark.plans.decontam import doc_grams_sql
from evalspark.plans.fixtures import EVAL_SQL, GENERATED_SQL, REQUESTS_LOG_SQL, eval_docs, generated, response_log
from evalspark.plans.prepare import sql_strip
from evalspark.plans.prompts import draw_sql
from evalspark.plans.scoring import rnd
from evalspark.sources import corpus as S
from evalspark.sources import results as W
from evalspark.streaming import responses as X

L = "long"


@query("read_jsonl", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def read_jsonl(t: Tables):
    """Lines that are bare strings, objects, or objects with a list of paragraphs."""
    path = S.scratch_path(t.spark, "jsonl")
    m = F.col("doc_id") % 3
    body = F.concat(F.lit('{"text":'), F.when(m == 1, F.to_json(F.array("text"))).otherwise(F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")), F.lit(',"meta":{"id":"'), F.col("doc_id").cast("string"), F.lit('"}}'))
    S.write_lines(t.documents.select(body.alias("line")), "line", path)
    r = S.read_jsonl(t.spark, path)
    return r.select(F.element_at("meta", "id").cast(L).alias("doc_id"), F.sha2("text", 256).alias("text_hash"))


@query("read_jsonl_paragraphs", "SELECT sha256(array_to_string(string_split(text, chr(10)), chr(10) || chr(10))) AS text_hash, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def read_jsonl_paragraphs(t: Tables):
    path = S.scratch_path(t.spark, "jsonl")
    bare = F.regexp_replace(F.to_json(F.array(F.replace("text", F.lit("\n"), F.lit("\n\n")))), r"^\[|\]$", "")
    listed = F.to_json(F.struct(F.split("text", "\n", -1).alias("text")))
    S.write_lines(t.documents.select(F.when(F.col("doc_id") % 2 == 0, bare).otherwise(listed).alias("line")), "line", path)
    return S.read_jsonl(t.spark, path).groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("write_jsonl_archive", "SELECT source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY source")
def write_jsonl_archive(t: Tables):
    path = S.scratch_path(t.spark, "archive")
    S.write_jsonl(t.documents.select("text", F.create_map(F.lit("source"), F.col("source")).alias("meta")), path)
    return S.read_jsonl(t.spark, path).groupBy(F.element_at("meta", "source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("read_lines", "SELECT line, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def read_lines(t: Tables):
    path = S.scratch_path(t.spark, "lines")
    S.write_lines(t.documents.select(F.explode(F.split("text", "\n", -1)).alias("line")), "line", path)
    return S.read_lines(t.spark, path).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("read_split", "SELECT doc_id, lang FROM documents WHERE lang = 'de'")
def read_split(t: Tables):
    return S.read_split(t.spark, f"{t.path}/documents.parquet", "de", "lang").select("doc_id", "lang")


@query("tolerant_records", "SELECT event_type, count(*) FILTER (WHERE event_id % 10 <> 0)::BIGINT AS readable FROM events WHERE event_id % 10 <> 0 GROUP BY event_type UNION ALL SELECT 'unreadable', count(*)::BIGINT FROM events WHERE event_id % 10 = 0")
def tolerant_records(t: Tables):
    path = S.scratch_path(t.spark, "records")
    whole = F.to_json(F.struct("event_id", "event_type"))
    S.write_lines(t.events.select(F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 12)).otherwise(whole).alias("line")), "line", path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())])
    rows = S.read_records(t.spark, path, schema)
    kind = F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise(F.col("event_type"))
    return rows.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("readable"))


@query("saved_results", f"WITH {LONG_SQL} SELECT task, round(max(value) FILTER (WHERE metric = 'acc'), 6) AS acc, max(n)::BIGINT AS samples FROM results GROUP BY task")
def saved_results(t: Tables):
    path = S.scratch_path(t.spark, "results")
    W.save_results(results(t), path)
    schema = T.StructType([T.StructField("task", T.StringType()), T.StructField("results", T.MapType(T.StringType(), T.DoubleType())), T.StructField("samples", T.LongType())])
    r = t.spark.read.schema(schema).json(path)
    return r.select("task", F.round(F.element_at("results", "acc,none"), 6).alias("acc"), "samples")


@query("saved_samples", f"WITH {EVAL_SQL} SELECT doc_id, task, task || ' ' || choices[1] AS arguments, gold::VARCHAR AS target FROM eval_docs")
def saved_samples(t: Tables):
    path = S.scratch_path(t.spark, "samples")
    d = eval_docs(t).select("task", "doc_id", F.array(F.array("task", F.element_at("choices", 1))).alias("arguments"), F.array("gold").alias("resps"), F.col("gold").alias("target"))
    W.save_samples(d, path)
    args = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("arguments", args), T.StructField("resps", T.ArrayType(T.StringType())), T.StructField("target", T.StringType()), T.StructField("task", T.StringType())])
    a = F.element_at("arguments", "gen_args_0")
    r = t.spark.read.schema(schema).json(path)
    return r.select("doc_id", "task", F.concat_ws(" ", F.element_at(a, "arg_0"), F.element_at(a, "arg_1")).alias("arguments"), "target")


@query(
    "latest_logs",
    """WITH f AS (SELECT 'm' || (user_id % 3) AS model, 'samples_' || event_type || '_x' || (user_id % 5) || '_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') || '.jsonl' AS name, event_type || '_x' || (user_id % 5) AS task, ts FROM events)
       SELECT model, task, max(name) AS latest FROM f GROUP BY ALL""",
)
def latest_logs(t: Tables):
    kind = F.concat("event_type", F.lit("_x"), F.col("user_id") % 5)
    name = F.concat(F.lit("samples_"), kind, F.lit("_"), F.date_format("ts", "yyyy-MM-dd'T'HH-mm-ss"), F.lit(".jsonl"))
    return W.latest_per_task(t.events.select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), name.alias("name")), "model", "name")


@query(
    "table_digest",
    """WITH l0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || '}') AS h FROM labels),
       l1 AS (SELECT pos // 16 AS block, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l0 GROUP BY pos // 16),
       l2 AS (SELECT block // 16 AS block, sha256(string_agg(h, '' ORDER BY block)) AS h FROM l1 GROUP BY block // 16)
       SELECT sha256(string_agg(h, '' ORDER BY block)) AS digest FROM l2""",
)
def table_digest(t: Tables):
    """Blocks small enough that all three levels have several of them."""
    digest = S.table_digest(t.labels.select("doc_id", "quality"), ["doc_id"], fanout=16)
    path = S.scratch_path(t.spark, "pinned")
    S.write_pinned(t.labels.select("doc_id", "quality"), path, ["doc_id"], digest, fanout=16)
    return t.spark.read.parquet(path).agg(F.lit(digest).alias("digest"))


@query(
    "file_statistics",
    "SELECT *, (sum(documents) OVER (ORDER BY source) - documents)::BIGINT AS first_offset FROM (SELECT source, count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS characters FROM documents GROUP BY source)",
)
def file_statistics(t: Tables):
    return S.file_statistics(t.documents, "source", "text")


# --- streams ----------------------------------------------------------------------------------------

def stream(t: Tables, table: str):
    return X.read_log(t.spark, f"{t.path}/{table}*.parquet", t.spark.read.parquet(f"{t.path}/{table}.parquet").schema)


class _Streamed(Tables):
    """The same derivations over a streaming read of the events."""

    @property
    def events(self):
        return stream(self, "events")


@query("stream_progress", f"WITH {REQUESTS_LOG_SQL} SELECT task, finish_reason, count(DISTINCT request_hash)::BIGINT AS n FROM raw_log GROUP BY ALL")
def stream_progress(t: Tables):
    log = response_log(_Streamed(t.spark, t.path))
    out = S.scratch_path(t.spark, "progress")
    X.run_to_table(X.progress(log, ["task", "finish_reason"]), out, S.scratch_path(t.spark, "ckpt"))
    return X.latest(t.spark, out, ["task", "finish_reason"])


@query("stream_progress_watermark", f"WITH {REQUESTS_LOG_SQL} SELECT task, count(DISTINCT request_hash)::BIGINT AS n FROM raw_log GROUP BY ALL")
def stream_progress_watermark(t: Tables):
    log = response_log(_Streamed(t.spark, t.path))
    out = S.scratch_path(t.spark, "progress")
    X.run_to_table(X.progress(log, ["task"], watermark="60 days"), out, S.scratch_path(t.spark, "ckpt"))
    return X.latest(t.spark, out, ["task"])


@query("stream_export", f"WITH {REQUESTS_LOG_SQL} SELECT request_hash, any_value(task) AS task, any_value(finish_reason) AS finish_reason FROM raw_log GROUP BY request_hash")
def stream_export(t: Tables):
    log = response_log(_Streamed(t.spark, t.path)).select("request_hash", "task", "finish_reason", "event_id")
    out = S.scratch_path(t.spark, "export")
    X.export_once(log, out, S.scratch_path(t.spark, "ckpt"))
    return X.exported(t.spark, out, "event_id").select("request_hash", "task", "finish_reason")


@query("stream_ngrams", f"SELECT ngram, count(*)::BIGINT AS n_docs FROM ({doc_grams_sql(5)}) GROUP BY ngram")
def stream_ngrams(t: Tables):
    out = S.scratch_path(t.spark, "ngrams")
    X.ngram_stream(stream(t, "documents").select("doc_id", "text"), 5, out, S.scratch_path(t.spark, "ckpt"))
    return X.ngram_counts(t.spark, out, 5)


# --- scorer plug-ins --------------------------------------------------------------------------------

@query("scored_requests", f"WITH {EVAL_SQL} SELECT doc_id, idx::BIGINT AS idx, round(-(length(c) + 1) / 10.0, 6)::DOUBLE AS loglik, (length(c) + 1) % 2 = 0 AS is_greedy FROM (SELECT doc_id, unnest(range(len(choices))) AS idx, unnest(choices) AS c FROM eval_docs)")
def scored_requests(t: Tables):
    r = choice_requests(eval_docs(t), ["doc_id"], "task", "choices").select("doc_id", F.col("idx").cast(L).alias("idx"), "continuation")
    return rnd(K.score_requests(r, K.length_likelihood, K.LIKELIHOOD).drop("continuation"), "loglik")


@query("custom_aggregate", f"WITH {GENERATED_SQL} SELECT lang, round(sqrt(avg(gold_num * gold_num)), 6) AS value FROM gen GROUP BY lang")
def custom_aggregate(t: Tables):
    """A user's root mean square as partial states."""
    update = lambda s, rows: [s[0] + float((rows["gold_num"] ** 2).sum()), s[1] + len(rows)]
    merge = lambda a, b: [a[0] + b[0], a[1] + b[1]]
    finish = lambda s: (s[0] / s[1]) ** 0.5
    return rnd(K.custom_aggregate(generated(t).select("lang", "gold_num"), ["lang"], update, merge, finish, [0.0, 0.0]), "value")


# --- synthetic tables -------------------------------------------------------------------------------

SENTS_SQL = f"sents AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all({sql_strip('text')}, '(?s)(?:[^.!?]|[.!?]+[^\\s.!?])+[.!?]*|[.!?]+'), lambda s: {sql_strip('s')}), lambda s: s <> '') AS s FROM documents)"


@query(
    "hidden_sentences",
    f"""WITH {SENTS_SQL}, d AS (SELECT doc_id, s, len(s) AS n, unnest([0, 25, 50, 75, 100]) AS depth FROM sents)
        SELECT doc_id, depth::BIGINT AS depth, sha256(regexp_replace(array_to_string(list_concat(list_concat([array_to_string(list_slice(s, 1, floor(n * depth / 100)::INT), ' ')], ['One of the special magic numbers for k' || doc_id || ' is: ' || (doc_id * 7919 % 1000000) || '.']),
          [array_to_string(list_slice(s, floor(n * depth / 100)::INT + 1, n), ' ')]), ' '), '\\s+', ' ', 'g')) AS input_hash FROM d""",
)
def hidden_sentences(t: Tables):
    depths = F.array(*[F.lit(x) for x in (0, 25, 50, 75, 100)])
    d = t.corpus.select("doc_id", "text", F.explode(depths).alias("depth"))
    x = Y.needle("numbers", F.concat(F.lit("k"), "doc_id"), (F.col("doc_id") * 7919 % 1000000).cast("string"))
    text = Y.hide_sentences(F.col("text"), F.array(x), F.array("depth"))
    return d.select("doc_id", F.col("depth").cast(L).alias("depth"), F.sha2(F.regexp_replace(text, r"\s+", " "), 256).alias("input_hash"))


def sql_part(lo: str, hi: str) -> str:
    return f"array_to_string(list_slice(s, floor(n * {lo} / 100)::INT + 1, floor(n * {hi} / 100)::INT), ' ')"


def sql_needle(i: int) -> str:
    return f"'One of the special magic words for k{i} is: v' || doc_id || '-{i}.'"


@query(
    "hidden_sentences_many",
    f"""WITH {SENTS_SQL} SELECT doc_id, sha256(regexp_replace(array_to_string([{sql_part('0', '10')}, {sql_needle(1)}, {sql_part('10', '40')}, {sql_needle(2)}, {sql_part('40', '60')}, {sql_needle(3)},
        {sql_part('60', '80')}, {sql_needle(4)}, {sql_part('80', '100')}], ' '), '\\s+', ' ', 'g')) AS input_hash FROM (SELECT *, len(s) AS n FROM sents)""",
)
def hidden_sentences_many(t: Tables):
    """Four needles in one text, placed in depth order whatever order the depths are given in."""
    needles = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: Y.needle("words", F.concat(F.lit("k"), i.cast("string")), F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"))))
    text = Y.hide_sentences(F.col("text"), needles, F.array(*[F.lit(x) for x in (80, 10, 40, 60)]))
    return t.corpus.select("doc_id", F.sha2(F.regexp_replace(text, r"\s+", " "), 256).alias("input_hash"))


@query(
    "frequent_words",
    f"""WITH w AS (SELECT doc_id, unnest({sql_tokens('lower(text)')}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
        SELECT doc_id, word, n::BIGINT AS n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, encode(word))::INT AS rank FROM c QUALIFY rank <= 10""",
)
def frequent_words(t: Tables):
    return Y.frequent_words(t.corpus.select("doc_id", "text"), "doc_id", "text", 10)


@query("numbered_words", f"SELECT doc_id, sha256(array_to_string(list_transform({sql_tokens('lower(text)')}, lambda w, i: i || '. ' || w), ' ')) AS context_hash FROM documents")
def numbered_words(t: Tables):
    return t.documents.select("doc_id", F.sha2(Y.numbered_words(F.col("text")), 256).alias("context_hash"))


@query(
    "distractor_contexts",
    f"""WITH {draw_sql(4, 99, 'true')}, sized AS (SELECT s.doc_id, id, k, sum(len({sql_tokens('e.text')})) OVER (PARTITION BY s.doc_id ORDER BY k) AS running FROM shots s JOIN eval_docs e ON e.doc_id = s.id)
        SELECT doc_id, id, running::BIGINT AS running FROM sized WHERE running <= 1000""",
)
def distractor_contexts(t: Tables):
    d = eval_docs(t).withColumn("n_words", F.size(split_words(F.col("text"))))
    c = Y.distractor_contexts(d, d.where("split = 'dev'"), "doc_id", ["lang"], "n_words", 4, 1000, 99)
    return c.select("doc_id", F.inline("docs"))
