"""Registered queries of the training-data operators, with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import chat, fertility, langid, lattice, mixing, neardup, packing, prefixtrie, quality, suffix, topk, urlfilter, whitening
from evalspark.llm.common import small_batches, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

SQL_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return wrap


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int):
    """crc32 of the doc_id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query("op1_language_id")
def op1(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    learn = docs.where(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    model = langid.fit(langid.training_sample(learn))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


@query("op2_ngram_join")
def op2(spark, sf_dir):
    small_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_grams")


@query("op3_quality")
def op3(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = table(spark, sf_dir, "labels").select("doc_id", quality.rating().alias("grade"))
    model = quality.fit(quality.training_sample(docs, rated))
    out = quality.graded(docs, model)
    return out.select("doc_id", F.col("__expected_grade").alias("expected_grade"), F.col("__tail").alias("tail_probability"), F.col("__kept").alias("kept"))


@query("op4_packing")
def op4(spark, sf_dir):
    small_batches(spark)
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep_ids=False))


@query("op5_lattice")
def op5(spark, sf_dir):
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"))
    return lattice.score_texts(docs, ~F.col("held_out") & F.col("doc_id").isNotNull(), vocabulary("piece_bpe_32k.model"))


@query(
    "op6_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op6(spark, sf_dir):
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


@query("op7_fertility")
def op7(spark, sf_dir):
    small_batches(spark)
    rows = fertility.measured(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))
    return fertility.judged(rows).drop("band_group")


@query("op8_suffix")
def op8(spark, sf_dir):
    small_batches(spark)
    return suffix.removal_digest(table(spark, sf_dir, "documents"), words=suffix.PASSAGE_WORDS)


@query(
    "op9_mixing",
    f"""
    WITH d AS (SELECT doc_id, source, {SQL_SIZE}::BIGINT AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
    w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
    r AS (SELECT *, sum(source_size) OVER () AS total,
                 coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
                 sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS beyond FROM w),
    c AS (SELECT *, 3 * source_size * beyond <= weight * (total - below) AS capped FROM r),
    t AS (SELECT *, CASE WHEN capped THEN (3 * source_size)::DOUBLE
                         ELSE (weight * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)))::DOUBLE
                              / (sum(weight) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM c),
    m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                 ('0x' || substr(md5('mix|' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
    """,
)
def op9(spark, sf_dir):
    out = mixing.with_copies(table(spark, sf_dir, "documents"))
    size, taken = F.col(mixing.SIZE), F.col(mixing.SIZE) * F.col(mixing.COPIES)
    return out.select("doc_id", size.alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), taken.alias("taken"))


@query("op10_chat")
def op10(spark, sf_dir):
    small_batches(spark)
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_chats(turns), placed=True)


URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


@query(
    "op11_url_filter",
    r"""
    -- links with absolute targets; the tables have no others
    WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<(?:link|meta)\b[^<>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
    links AS (SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link.*rel=["'']?canonical') THEN regexp_extract(tag, '(?i)href=["'']?([^"''\s>]+)', 1)
                               WHEN regexp_matches(tag, '(?i)^<meta.*http-equiv=["'']?refresh') THEN regexp_extract(tag, '(?i)url=\s*["'']?([^"''>]+)', 1) END AS target FROM tags),
    urls AS (SELECT DISTINCT url AS u FROM pages UNION SELECT target FROM links WHERE regexp_matches(target, '(?i)^https?://')),
    cut AS (SELECT u, CASE WHEN instr(u, '://') > 0 THEN substr(u, instr(u, '://') + 3) ELSE '' END AS rest FROM urls WHERE u IS NOT NULL),
    parts AS (SELECT u, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM cut),
    fits AS (SELECT p.u, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
             FROM parts p JOIN rules r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path) GROUP BY p.u),
    nodes AS (SELECT p.u, p.host || p.tail AS node, p.host, p.path, f.rule, f.verdict FROM parts p LEFT JOIN fits f ON f.u = p.u),
    edges AS (SELECT a.node AS x, b.node AS y FROM links l JOIN nodes a ON a.u = l.url JOIN nodes b ON b.u = l.target WHERE a.host <> '' AND b.host <> '' AND a.node <> b.node),
    both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
    reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON e.x = r.y),
    alias AS (SELECT r.x AS node, min(n.verdict) AS verdict FROM reach r JOIN nodes n ON n.node = r.y WHERE n.verdict IS NOT NULL GROUP BY r.x)
    SELECT p.page_id, coalesce(n.host, '') AS host, coalesce(n.path, '') AS path, n.rule, coalesce(n.verdict, a.verdict, 'allow') AS verdict
    FROM pages p LEFT JOIN nodes n ON n.u = p.url LEFT JOIN alias a ON a.node = n.node
    """,
)
def op11(spark, sf_dir):
    return urlfilter.judged(table(spark, sf_dir, "pages"), urlfilter.rule_list(spark, URL_RULES))


@query(
    "op12_prefix_trie",
    """
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, count(*) AS n FROM t GROUP BY c),
    -- CRC-32 of the decimal id: a byte is mixed in, then eight shifts
    h AS (SELECT c, n, c - c % 5 AS base,
                 (4294967295 - list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_concat([ascii(x)::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) % 9 AS h FROM own),
    r AS (SELECT h.c, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos < h.h
          UNION ALL SELECT h.c, t.pos - h.h + least(h.h, coalesce(b.n, 0)), t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos >= h.h LEFT JOIN own b ON b.c = h.base),
    p AS (SELECT c, pos + 1 AS d, md5(string_agg(sha256(length(role) || ':' || role || text), '' ) OVER (PARTITION BY c ORDER BY pos)) AS node, strlen(text) AS size FROM r
          UNION ALL SELECT c, 0, '', 0 FROM own),
    q AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS last FROM p),
    n AS (SELECT node, any_value(parent) AS parent, any_value(d) AS d, count(*) AS n_convs, min(c) AS low, any_value(size) AS size,
                 coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM q GROUP BY node),
    k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
    held AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node),
    s AS (SELECT q.node, sum(coalesce((g.n_convs - 1) * g.size, 0)) OVER w AS saving, sum(CASE WHEN g.n_children = 0 THEN 1 ELSE 0 END) OVER w AS leaves
          FROM q LEFT JOIN held g ON g.low = q.c AND g.d = q.d WINDOW w AS (PARTITION BY q.c ORDER BY q.d DESC)),
    u AS (SELECT node, sum(saving)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM s GROUP BY node)
    SELECT g.low AS conv_id, g.d::BIGINT AS depth, f.low AS parent_conv_id, g.n_convs, g.n_children, u.n_leaves, u.saved_tokens, sha256(g.ends) AS ends_sha256, g.size::BIGINT AS size
    FROM held g JOIN u ON u.node = g.node LEFT JOIN n f ON f.node = g.parent
    """,
)
def op12(spark, sf_dir):
    small_batches(spark)
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_whitening")
def op13(spark, sf_dir):
    vectors = whitening.sound(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(vectors, whitening.fitted(vectors))
