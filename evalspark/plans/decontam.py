"""Queries of the decontamination family."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalspark.functions.text import fold_clean
from evalspark.operators import decontam as D
from evalspark.functions.ngrams import ngrams
from evalspark.plans.base import Tables, query, sql_clean, sql_ngrams, sql_tokens, SPACE
from evalspark.registry import register_sql
from evalspark.session import settle
from evalspark.sources.corpus import scratch_path


def doc_grams_sql(n: int, table: str = "documents", key: str = "doc_id") -> str:
    return (
        f"SELECT DISTINCT {key}, unnest({sql_ngrams('toks', n)}) AS ngram FROM "
        f"(SELECT {key}, {sql_tokens(sql_clean('text'))} AS toks FROM {table})"
    )


N = 13
HITS_SQL = f"""
WITH bench AS ({doc_grams_sql(N, 'benchmark', 'item_id')}),
     corp AS ({doc_grams_sql(N)})
"""


@query("normalize_text", f"SELECT doc_id, {sql_clean('text')} AS norm FROM documents")
def normalize_text(t: Tables):
    return t.documents.select("doc_id", fold_clean(F.col("text")).alias("norm"))


@query(
    "ngram_generation",
    f"""SELECT doc_id, len(g)::BIGINT AS n_ngrams, len(list_distinct(g))::BIGINT AS n_distinct,
        coalesce(g[1], '') AS first_ngram, coalesce(g[len(g)], '') AS last_ngram, md5(array_to_string(g, chr(10))) AS all_ngrams
        FROM (SELECT doc_id, {sql_ngrams('toks', N)} AS g FROM
              (SELECT doc_id, {sql_tokens(sql_clean('text'))} AS toks FROM documents))""",
)
def ngram_generation(t: Tables):
    g = t.corpus.select("doc_id", ngrams(D.clean_tokens(F.col("text")), N).alias("g"))
    return g.select(
        "doc_id",
        F.size("g").cast("long").alias("n_ngrams"),
        F.size(F.array_distinct("g")).cast("long").alias("n_distinct"),
        F.coalesce(F.try_element_at("g", F.lit(1)), F.lit("")).alias("first_ngram"),
        F.coalesce(F.try_element_at("g", F.lit(-1)), F.lit("")).alias("last_ngram"),
        F.md5(F.array_join("g", "\n").cast("binary")).alias("all_ngrams"),
    )


@query("register_contaminants", f"SELECT DISTINCT ngram FROM ({doc_grams_sql(N, 'benchmark', 'item_id')})")
def register_contaminants(t: Tables):
    return D.contaminant_ngrams(t.benchmark, N)


@query(
    "decontam_items",
    HITS_SQL
    + """SELECT item_id, count(*)::BIGINT AS n_matched FROM bench
         WHERE ngram IN (SELECT ngram FROM corp) GROUP BY item_id""",
)
def decontam_items(t: Tables):
    return D.contaminated_items(t.corpus, t.benchmark, ["item_id"], N)


@query(
    "decontam_items_shuffled",
    HITS_SQL
    + """SELECT item_id, count(*)::BIGINT AS n_matched FROM bench
         WHERE ngram IN (SELECT ngram FROM corp) GROUP BY item_id""",
)
def decontam_items_shuffled(t: Tables):
    """The path taken when the benchmark n-grams are too many to broadcast."""
    return D.contaminated_items(t.corpus, t.benchmark, ["item_id"], N, max_broadcast=0)


@query(
    "dirty_documents",
    HITS_SQL
    + """SELECT doc_id, count(*)::BIGINT AS n_ngrams FROM corp
         WHERE ngram IN (SELECT ngram FROM bench) GROUP BY doc_id""",
)
def dirty_documents(t: Tables):
    return D.dirty_documents(t.corpus, D.contaminant_ngrams(t.benchmark, N), N)


SPAN_SQL = f"""
WITH pieces AS (
  SELECT doc_id, unnest(range(len(p))) AS piece, unnest(p) AS word
  FROM (SELECT doc_id, string_split_regex(text, '{SPACE}') AS p FROM documents)),
placed AS (
  SELECT doc_id, piece, word,
         sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY piece) - length(word) - 1 AS start
  FROM pieces),
words AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) AS idx,
         {sql_clean('word')} AS word, start, start + length(word) - 1 AS stop
  FROM placed WHERE word <> ''),
grams AS (
  SELECT doc_id, idx, start,
         lead(stop, {N - 1}) OVER (PARTITION BY doc_id ORDER BY idx) AS stop,
         array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND {N - 1} FOLLOWING), ' ') AS ngram
  FROM words),
spans AS (SELECT * FROM grams WHERE stop IS NOT NULL),
bench AS (SELECT DISTINCT ngram FROM ({doc_grams_sql(N, 'benchmark', 'item_id')})),
dirty AS (SELECT doc_id, idx, start, stop FROM spans WHERE ngram IN (SELECT ngram FROM bench))
"""


@query(
    "ngram_spans",
    SPAN_SQL
    + """SELECT doc_id, count(*)::BIGINT AS n_spans, min(start)::BIGINT AS first_start, max(stop)::BIGINT AS last_stop,
                sum(stop - start + 1)::BIGINT AS total_len FROM spans GROUP BY doc_id""",
)
def ngram_spans(t: Tables):
    return (
        D.ngram_spans(t.corpus, N)
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_spans"),
            F.min("start").cast("long").alias("first_start"),
            F.max("stop").cast("long").alias("last_stop"),
            F.sum(F.col("stop") - F.col("start") + 1).cast("long").alias("total_len"),
        )
    )


@query("dirty_spans", SPAN_SQL + "SELECT doc_id, idx::BIGINT AS idx, start::BIGINT AS start, stop::BIGINT AS stop FROM dirty")
def dirty_spans(t: Tables):
    s = D.dirty_spans(t.corpus, D.contaminant_ngrams(t.benchmark, N), N)
    return s.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


CHUNK_SQL = SPAN_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k,
                      count(*) OVER (PARTITION BY doc_id) AS n FROM dirty),
      cuts AS (SELECT r.doc_id, k, n, greatest(0, start - 200) AS lo, least(length(text), stop + 200) AS hi, text
               FROM ranked r JOIN documents USING (doc_id)),
      mids AS (SELECT doc_id, k, text, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY k), 0) AS splice FROM cuts WHERE n <= 10),
      chunks AS (
        SELECT doc_id, k AS ord, substring(text, (splice + 1)::BIGINT, (lo - splice)::BIGINT) AS chunk FROM mids WHERE lo - splice > 200
        UNION ALL
        SELECT doc_id, 1000000, substring(d.text, (e.hi + 2)::BIGINT) FROM documents d
        JOIN (SELECT doc_id, max_by(hi, k) AS hi FROM cuts WHERE n <= 10 GROUP BY doc_id) e USING (doc_id)
        WHERE e.hi < length(d.text) - 200
        UNION ALL
        SELECT doc_id, 1000000, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dirty) AND -1 < length(text) - 200)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1)::BIGINT AS chunk_no, chunk FROM chunks"""


@query("clean_chunks", CHUNK_SQL)
def clean_chunks(t: Tables):
    c = D.clean_chunks(t.corpus, D.contaminant_ngrams(t.benchmark, N), N)
    return c.select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query("sql_clean_chunks", CHUNK_SQL)
def sql_clean_chunks(t: Tables):
    """Chunks cut in SQL: a table function takes a document and its first spans."""
    register_sql(t.spark, ["clean_pieces"])
    t.corpus.createOrReplaceTempView("evalspark_chunk_documents")
    D.dirty_spans(t.corpus, D.contaminant_ngrams(t.benchmark, N), N).createOrReplaceTempView("evalspark_spans")
    few = t.spark.sql("""
        SELECT doc_id, collect_list(struct(bigint(start) AS start, bigint(stop) AS stop)) AS spans
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM evalspark_spans) WHERE k <= 11 GROUP BY doc_id""")
    settle(few).createOrReplaceTempView("evalspark_few_spans")  # whole texts stay where they are
    return t.spark.sql("""
        SELECT doc_id, c.chunk_no, c.chunk FROM evalspark_chunk_documents LEFT JOIN evalspark_few_spans USING (doc_id),
            LATERAL clean_pieces(text, spans, 200, 10, 200) AS c""")


@query(
    "sql_ngrams",
    f"SELECT doc_id, (i + 1)::BIGINT AS place, g AS ngram FROM (SELECT doc_id, unnest(range(greatest(len(t) - 4, 0))) AS i, unnest({sql_ngrams('t', 5)}) AS g FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents))",
)
def sql_ngrams_query(t: Tables):
    """All 5-grams with their places, from SQL."""
    register_sql(t.spark, ["word_ngrams"])
    t.corpus.createOrReplaceTempView("evalspark_ngram_documents")
    return t.spark.sql("SELECT doc_id, g.place, g.ngram FROM evalspark_ngram_documents, LATERAL word_ngrams(text, 5) AS g")


@query(
    "ngram_sort",
    f"""SELECT ngram, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM ({doc_grams_sql(5)}) GROUP BY ngram ORDER BY ngram""",
)
def ngram_sort(t: Tables):
    """Range-partitioned global sort of all n-grams (the bucket-and-sort stage)."""
    return D.sorted_ngrams(t.corpus, 5)


TABLE_SQL = f"""
WITH g AS (SELECT doc_id, unnest({sql_ngrams('toks', N)}) AS ngram FROM (SELECT doc_id, {sql_tokens(sql_clean('text'))} AS toks FROM documents)),
     counted AS (SELECT ngram, count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_occurrences, min(doc_id) AS first_doc
                 FROM g GROUP BY ngram)
"""


def written_ngram_table(t: Tables, buckets: int) -> str:
    """The 13-grams of all documents as a bucketed table, appended in two parts."""
    name = f"ngrams_{uuid.uuid4().hex}"
    path = scratch_path(t.spark, name)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    for part, rows in (("english", t.corpus.where(english)), ("others", t.corpus.where(~english))):
        D.append_ngram_table(rows, name, N, part, buckets, path)
    return name


@query("ngram_table", TABLE_SQL + "SELECT * FROM counted")
def ngram_table(t: Tables):
    """Every 13-gram, counted from the written table."""
    return D.ngram_table_counts(t.spark, written_ngram_table(t, D.buckets_for(t.documents)))


@query(
    "ngram_table_overlap",
    TABLE_SQL
    + f""", b AS (SELECT item_id, unnest({sql_ngrams('toks', N)}) AS ngram FROM (SELECT item_id, {sql_tokens(sql_clean('text'))} AS toks FROM benchmark)),
      bc AS (SELECT ngram, count(DISTINCT item_id)::BIGINT AS other_docs, count(*)::BIGINT AS other_occurrences FROM b GROUP BY ngram)
      SELECT * FROM counted JOIN bc USING (ngram)""",
)
def ngram_table_overlap(t: Tables):
    """Corpus and benchmark as two tables that meet bucket by bucket."""
    name = f"items_{uuid.uuid4().hex}"
    items = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    buckets = D.buckets_for(t.documents)
    D.append_ngram_table(items, name, N, "all", buckets, scratch_path(t.spark, name))
    return D.ngram_table_overlap(t.spark, written_ngram_table(t, buckets), name)


DF_SQL = f"SELECT ngram, count(*)::BIGINT AS n_docs FROM ({doc_grams_sql(3)}) GROUP BY ngram HAVING count(*) > 10"


@query("ngram_document_frequency", DF_SQL)
def ngram_document_frequency(t: Tables):
    return D.ngram_document_frequency(t.corpus, 3, 10, hash_pass=False)


@query("ngram_document_frequency_hashed", DF_SQL)
def ngram_document_frequency_hashed(t: Tables):
    return D.ngram_document_frequency(t.corpus, 3, 10)


@query(
    "overlap_statistics",
    f"""WITH g AS (SELECT unnest({sql_ngrams('toks', N)}) AS ngram FROM (SELECT {sql_tokens(sql_clean('text'))} AS toks FROM documents)),
        u AS (SELECT ngram, count(*) AS c FROM g GROUP BY ngram),
        b AS (SELECT DISTINCT ngram FROM ({doc_grams_sql(N, 'benchmark', 'item_id')}))
        SELECT sum(c)::BIGINT AS total_ngrams, count(*)::BIGINT AS unique_ngrams, count(b.ngram)::BIGINT AS matching_unique,
               (count(*) - count(b.ngram))::BIGINT AS non_matching_unique FROM u LEFT JOIN b USING (ngram)""",
)
def overlap_statistics(t: Tables):
    return D.overlap_statistics(t.corpus, D.contaminant_ngrams(t.benchmark, N), N)


@query(
    "contamination_score_split",
    HITS_SQL
    + """, hit AS (SELECT DISTINCT doc_id, true AS h FROM corp WHERE ngram IN (SELECT ngram FROM bench))
      SELECT d.lang, coalesce(h, false) AS contaminated, count(*)::BIGINT AS n, round(avg(l.quality), 6) AS mean_value
      FROM labels l JOIN documents d USING (doc_id) LEFT JOIN hit USING (doc_id) GROUP BY ALL""",
)
def contamination_score_split(t: Tables):
    samples = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    dirty = D.dirty_documents(t.corpus, D.contaminant_ngrams(t.benchmark, N), N)
    out = D.split_by_contamination(samples, dirty, "doc_id", ["lang"], "quality")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query(
    "decontamination_query_text",
    f"SELECT doc_id, sha256(concat_ws(chr(10), source, lang, text)) AS query_hash FROM documents",
)
def decontamination_query_text(t: Tables):
    q = D.query_text({"source": "source", "lang": "lang", "text": "text"}, sep="\n")
    return t.documents.select("doc_id", F.sha2(q, 256).alias("query_hash"))
