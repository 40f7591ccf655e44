"""Queries of the prompt, few-shot and request family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import templates as M
from evalspark.functions.draws import sql_draw
from evalspark.functions.text import split_words
from evalspark.operators import prepare as P
from evalspark.operators import prompts as R
from evalspark.operators import requests as Q
from evalspark.plans.base import SPACE, Tables, query, sql_tokens
from evalspark.plans.fixtures import EVAL_SQL, eval_docs
from evalspark.plans.prepare import TEMPLATES

L = "long"
LETTER = "substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ', gold + 1, 1)"


def qdocs(t: Tables):
    """Evaluation rows with a target letter."""
    return eval_docs(t).withColumn("target", P.letter_of(F.col("gold")))


@query(
    "render_template",
    f"""WITH {EVAL_SQL} SELECT doc_id, 'Subject ' || subject || ' (' || lang || ')' || chr(10) || 'Label: ' || quality ||
        ' ' || regexp_replace(task, '[0-9]+', '#', 'g') || chr(10) AS prompt FROM eval_docs""",
)
def render_template(t: Tables):
    d = eval_docs(t)
    text = M.resolve(d, "Subject {{subject}} ({{lang}})\nLabel: {{ quality }} {{task | regex_replace('[0-9]+', '#')}}\n")
    return d.select("doc_id", text.alias("prompt"))


@query(
    "document_fields",
    f"""WITH {EVAL_SQL} SELECT doc_id, subject AS text_column, gold::BIGINT AS text_index, 'x' || gold AS text_plain,
        array_to_string(list_transform(choices, lambda c: 'a' || length(c)), '|') AS target_list, 'no|yes' AS fixed_choices, 'B' AS chosen FROM eval_docs""",
)
def document_fields(t: Tables):
    d = eval_docs(t)
    listed = F.concat(F.lit("["), F.array_join(F.transform("choices", lambda c: F.concat(F.lit("'a"), F.length(c).cast("string"), F.lit("'"))), ", "), F.lit("]"))
    d = d.withColumn("listed", listed)
    return d.select(
        "doc_id",
        M.resolve(d, "subject").alias("text_column"),
        M.as_index(M.resolve(d, "{{gold}}")).cast(L).alias("text_index"),
        M.resolve(d, lambda f: F.concat(F.lit("x"), F.col("gold"))).alias("text_plain"),
        F.array_join(M.as_list(M.resolve(d, "listed")), "|").alias("target_list"),
        F.array_join(M.resolve(d, {"0": "no", "1": "yes"}), "|").alias("fixed_choices"),
        F.element_at(M.resolve(d, ["A", "B"]), M.resolve(d, 2)).alias("chosen"),
    )


def draw_sql(k: int, seed: int, test: str) -> str:
    """CTEs up to ``shots`` (doc_id, id, subject, target, k) and ``asked`` (all documents): k of the other pool rows."""
    d0 = """d0 AS (SELECT e.doc_id, e.lang, p.pos AS own, coalesce(s.n, 0) - (p.pos IS NOT NULL)::INT AS m FROM asked e LEFT JOIN sizes s USING (lang) LEFT JOIN pool p ON p.doc_id = e.doc_id AND p.lang = e.lang)"""
    steps = [f"s0 AS (SELECT *, least({k}, m) AS size, []::BIGINT[] AS taken FROM d0)"]
    for i in range(k):
        steps.append(f"t{i} AS (SELECT *, m - size + {i} AS top, {sql_draw(seed, 'doc_id', str(i))} AS u FROM s{i} WHERE size > {i} UNION ALL SELECT *, -1 AS top, 0 AS u FROM s{i} WHERE size <= {i})")
        pick = "CASE WHEN list_contains(taken, u % (top + 1)) THEN top ELSE u % (top + 1) END"
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (top, u, taken), CASE WHEN top < 0 THEN taken ELSE list_append(taken, {pick}) END AS taken FROM t{i})")
    return f"""{EVAL_SQL}, asked AS (SELECT doc_id, lang FROM eval_docs WHERE {test}),
  pool AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM eval_docs WHERE split = 'dev'),
  sizes AS (SELECT DISTINCT lang, n FROM pool), {d0}, {', '.join(steps)},
  reads AS (SELECT doc_id, lang, own, unnest(taken) AS at, generate_subscripts(taken, 1) AS k FROM s{k}),
  shots AS (SELECT r.doc_id, p.doc_id AS id, p.subject, substring('ABCD', p.gold + 1, 1) AS target, k FROM reads r JOIN pool p ON p.lang = r.lang AND p.pos = r.at + coalesce(r.at >= r.own, false)::INT)"""


def drawn(t: Tables, k: int = 3, seed: int = 1234):
    d = qdocs(t)
    return R.draw_shots(d, d.where("split = 'dev'"), "doc_id", ["lang"], k, seed, ["subject", "target"])


@query("fewshot_random", f"WITH {draw_sql(3, 1234, 'true')} SELECT doc_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY k), '') AS shot_ids FROM asked LEFT JOIN shots USING (doc_id) GROUP BY doc_id")
def fewshot_random(t: Tables):
    return drawn(t).select("doc_id", F.array_join(F.transform("shots", lambda s: s["id"].cast("string")), ",").alias("shot_ids"))


@query(
    "labelled_context",
    f"""WITH {draw_sql(3, 1234, 'true')} SELECT doc_id, coalesce(string_agg('Topic: ' || subject || ' ' || 'The answer is ' || target || chr(10) || chr(10), '' ORDER BY k), '') || 'Topic: ' || any_value(x.own) AS prompt
        FROM (SELECT doc_id, subject AS own FROM eval_docs) x LEFT JOIN shots USING (doc_id) GROUP BY doc_id""",
)
def labelled_context(t: Tables):
    shots = F.transform("shots", lambda s: F.struct(F.concat(F.lit("Topic: "), s["subject"]).alias("text"), s["target"].alias("target")))
    ctx = R.labelled_context(shots, "text", "target", prefix="The answer is")
    return drawn(t).join(eval_docs(t).select("doc_id", "subject"), "doc_id").select("doc_id", F.concat(ctx, F.lit("Topic: "), F.col("subject")).alias("prompt"))


@query(
    "chat_context",
    f"""WITH {draw_sql(2, 7, 'true')} SELECT doc_id, 'system=Be brief.;' || coalesce(string_agg('user=' || subject || ';assistant=' || target, ';' ORDER BY k) || ';', '') || 'user=' || any_value(x.own) AS multiturn,
        'system=Be brief.;user=' || coalesce(string_agg(subject || ' ' || target || chr(10) || chr(10), '' ORDER BY k), '') || any_value(x.own) AS single_turn
        FROM (SELECT doc_id, subject AS own FROM eval_docs) x LEFT JOIN shots USING (doc_id) GROUP BY doc_id""",
)
def chat_context(t: Tables):
    d = drawn(t, 2, 7).join(eval_docs(t).select("doc_id", F.col("subject").alias("own")), "doc_id")
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";")
    sys = F.lit("Be brief.")
    multi = R.chat_context(F.col("shots"), "subject", "target", F.col("own"), system=sys, multiturn=True)
    single = R.chat_context(F.col("shots"), "subject", "target", F.col("own"), system=sys)
    return d.select("doc_id", flat(multi).alias("multiturn"), flat(single).alias("single_turn"))


FIRST_SQL = f"""{EVAL_SQL}, pool AS (SELECT doc_id AS id, subject, row_number() OVER (PARTITION BY subject ORDER BY doc_id) AS rn FROM eval_docs WHERE split = 'dev'),
 hits AS (SELECT e.doc_id, id, rn FROM eval_docs e JOIN pool p USING (subject) WHERE rn <= 4 AND id <> e.doc_id),
 shots AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS k FROM hits QUALIFY k <= 3)"""


def by_subject(t: Tables):
    d = qdocs(t)
    return R.first_shots(d, d.where("split = 'dev'"), "doc_id", ["subject"], 3, ["target"])


@query("fewshot_by_subject", f"WITH {FIRST_SQL} SELECT doc_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY k), '') AS shot_ids FROM eval_docs LEFT JOIN shots USING (doc_id) GROUP BY doc_id")
def fewshot_by_subject(t: Tables):
    return by_subject(t).select("doc_id", F.array_join(F.transform("shots", lambda s: s["id"].cast("string")), ",").alias("shot_ids"))


@query(
    "fewshot_first",
    f"""WITH {EVAL_SQL}, pool AS (SELECT doc_id AS id, row_number() OVER (ORDER BY doc_id) AS rn FROM eval_docs WHERE split = 'dev'),
      hits AS (SELECT e.doc_id, id, rn FROM eval_docs e JOIN pool ON rn <= 4 AND id <> e.doc_id),
      shots AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS k FROM hits QUALIFY k <= 3)
      SELECT doc_id, string_agg(id::VARCHAR, ',' ORDER BY k) AS shot_ids FROM shots GROUP BY doc_id""",
)
def fewshot_first(t: Tables):
    d = eval_docs(t)
    out = R.first_shots_shared(d, d.where("split = 'dev'"), "doc_id", 3)
    return out.select("doc_id", F.array_join(F.col("shot_ids").cast("array<string>"), ",").alias("shot_ids"))


@query(
    "fewshot_excluding",
    f"""WITH {EVAL_SQL}, x AS (SELECT doc_id, split, subject AS passage, lang || (doc_id % 7) AS link FROM eval_docs),
      hits AS (SELECT e.doc_id, p.doc_id AS id FROM x e JOIN x p ON p.split = 'dev' AND p.doc_id <> e.doc_id AND p.passage <> e.passage AND p.link <> e.link),
      shots AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS k FROM hits QUALIFY k <= 3)
      SELECT doc_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY k), '') AS shot_ids FROM eval_docs LEFT JOIN shots USING (doc_id) GROUP BY doc_id""",
)
def fewshot_excluding(t: Tables):
    d = eval_docs(t).select("doc_id", "split", F.col("subject").alias("passage"), F.concat("lang", F.col("doc_id") % 7).alias("link"))
    out = R.first_shots_excluding(d, d.where("split = 'dev'"), "doc_id", "passage", "link", 3)
    return out.select("doc_id", F.array_join(F.col("shot_ids").cast("array<string>"), ",").alias("shot_ids"))


OWN_SQL = f"""{EVAL_SQL}, pool AS (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919) % 104729, doc_id) AS rn FROM eval_docs WHERE split = 'dev'),
 hits AS (SELECT e.doc_id, id, rn FROM eval_docs e JOIN pool p USING (lang) WHERE rn <= 4 AND id <> e.doc_id),
 shots AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY rn) AS k FROM hits QUALIFY k <= 3)"""


@query("fewshot_own_sampler", f"WITH {OWN_SQL} SELECT doc_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY k), '') AS shot_ids FROM eval_docs LEFT JOIN shots USING (doc_id) GROUP BY doc_id")
def fewshot_own_sampler(t: Tables):
    """A user's own order of the pool."""
    d = qdocs(t)
    out = R.sampled_shots(d, d.where("split = 'dev'"), "doc_id", ["lang"], 3, lambda key: (key * 7919) % 104729, [])
    return out.select("doc_id", F.array_join(F.transform("shots", lambda s: s["id"].cast("string")), ",").alias("shot_ids"))


@query(
    "bad_demonstrations",
    f"""WITH {FIRST_SQL} SELECT doc_id, count(id)::BIGINT AS n_shots, coalesce(bool_or(id = doc_id), false) AS has_self FROM eval_docs LEFT JOIN shots USING (doc_id)
        GROUP BY doc_id HAVING count(id) <> 3 OR bool_or(id = doc_id)""",
)
def bad_demonstrations(t: Tables):
    return R.bad_demonstrations(by_subject(t), "doc_id", 3).withColumn("n_shots", F.col("n_shots").cast(L))


@query(
    "leaked_rows",
    f"""WITH {EVAL_SQL} SELECT doc_id FROM eval_docs WHERE split = 'test' AND text IN (SELECT text FROM eval_docs WHERE split = 'dev')""",
)
def leaked_rows(t: Tables):
    d = eval_docs(t)
    return R.leaked_rows(d.where("split = 'test'"), d.where("split = 'dev'"), [F.col("text"), F.to_json("choices")]).select("doc_id")


@query(
    "greek_prompt",
    f"""WITH {FIRST_SQL}, blk AS (SELECT doc_id, gold, 'Κείμενο:' || chr(10) || lang || chr(10) || chr(10) || 'Ερώτηση: ' || task || chr(10) || chr(10) ||
        array_to_string(list_transform(choices, lambda c, i: substring('ABCD', i, 1) || '. ' || c), chr(10)) AS block,
        array_to_string(list_transform(choices, lambda c, i: substring('ABCD', i, 1)), ', ') AS letters FROM eval_docs),
      ex AS (SELECT s.doc_id, string_agg('Παράδειγμα ' || k || chr(10) || b.block || chr(10) || chr(10) || '{M.GREEK_FINAL}' || substring('ABCD', b.gold + 1, 1) || '}}' || chr(10) || chr(10), '' ORDER BY k) AS examples
             FROM shots s JOIN blk b ON b.doc_id = s.id GROUP BY s.doc_id)
      SELECT doc_id, '{M.GREEK_INSTRUCTION}' || chr(10) || chr(10) || coalesce('{M.GREEK_EXAMPLES}' || chr(10) || chr(10) || examples || '{M.GREEK_NOW}' || chr(10) || chr(10), '')
         || block || chr(10) || chr(10) || '{M.GREEK_ALLOWED}' || letters || '.' || chr(10) || chr(10) || 'Απάντηση:' AS prompt
      FROM blk LEFT JOIN ex USING (doc_id)""",
)
def greek_prompt(t: Tables):
    d = qdocs(t).select("doc_id", "subject", "split", "target", F.col("task").alias("question"), "choices", F.col("lang").alias("passage"))
    s = R.first_shots(d, d.where("split = 'dev'"), "doc_id", ["subject"], 3, ["question", "choices", "passage", "target"])
    p = M.greek_prompt(F.col("question"), F.col("choices"), F.col("passage"), F.col("shots"))
    return d.join(s, "doc_id").select("doc_id", p.alias("prompt"))


OPTIONS_SQL = f"""{EVAL_SQL}, v AS (SELECT *, unnest(range(3)) AS prompt_id FROM eval_docs),
 o AS (SELECT *, array_to_string(list_transform(choices, lambda c, i: CASE prompt_id WHEN 0 THEN substring('ABCD', i, 1) || ') ' || c
   WHEN 1 THEN i || '. ' || c ELSE '(' || ['I','II','III','IV'][i] || ') ' || c END || chr(10)), '') AS options FROM v)"""


@query(
    "options_prompt",
    f"""WITH {OPTIONS_SQL} SELECT doc_id, prompt_id::BIGINT AS prompt_id, CASE prompt_id WHEN 0 THEN 'Question: ' || task || chr(10) || options || 'Answer:'
        WHEN 1 THEN task || ' Choose one.' || chr(10) || options || 'The best answer is' ELSE 'Pick for ' || subject || ': ' || task || chr(10) || options END AS prompt FROM o""",
)
def options_prompt(t: Tables):
    v = P.with_templates(eval_docs(t).select("doc_id", "task", "subject", "choices"), TEMPLATES)
    opts = M.render_options(F.col("choices"), F.col("options_format"))
    text = M.fill(F.col("prompt"), options=opts, question=F.col("task"), category=F.col("subject"))
    return v.select("doc_id", F.col("prompt_id").cast(L).alias("prompt_id"), text.alias("prompt"))


@query(
    "conversation_prompt",
    f"""SELECT doc_id, sha256(lang || chr(10) || chr(10) || array_to_string(list_transform(ls, lambda q, i: 'Q: ' || q || chr(10) || chr(10) ||
         CASE WHEN i < len(ls) THEN 'A: ' || length(q) || chr(10) || chr(10) ELSE 'A:' END), '')) AS prompt_hash
        FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)""",
)
def conversation_prompt(t: Tables):
    lines = F.split("text", "\n", -1)
    d = t.documents.select("doc_id", "lang", lines.alias("q"), F.transform(lines, lambda q: F.length(q).cast("string")).alias("a"))
    return d.select("doc_id", F.sha2(R.conversation_prompt(F.col("lang"), F.col("q"), F.col("a")), 256).alias("prompt_hash"))


@query(
    "blank_split",
    f"""WITH {EVAL_SQL}, s AS (SELECT doc_id, unnest(choices) AS opt, lang || ' and _ then ' || text AS sent FROM eval_docs)
        SELECT doc_id, opt, substring(sent, 1, instr(sent, '_') - 1) || opt AS context, sha256(trim(substring(sent, instr(sent, '_') + 1))) AS target_hash FROM s""",
)
def blank_split(t: Tables):
    d = eval_docs(t).select("doc_id", F.explode("choices").alias("opt"), F.concat(F.col("lang"), F.lit(" and _ then "), F.col("text")).alias("sent"))
    ctx, target = R.blank_split(F.col("sent"), F.col("opt"))
    return d.select("doc_id", "opt", ctx.alias("context"), F.sha2(target, 256).alias("target_hash"))


REQ_SQL = f"""{EVAL_SQL}, req AS (SELECT doc_id, task, len(choices) AS n, unnest(range(len(choices))) AS idx, unnest(choices) AS c FROM eval_docs)"""


@query(
    "choice_requests",
    f"""WITH {REQ_SQL} SELECT doc_id, 'loglikelihood' AS request_type, idx::BIGINT AS idx, task AS context, ' ' || c AS continuation FROM req
        UNION ALL SELECT doc_id, 'loglikelihood', (idx + n)::BIGINT, '', ' ' || c FROM req""",
)
def choice_requests(t: Tables):
    r = Q.choice_requests(eval_docs(t), ["doc_id"], "task", "choices", mutual_information=True)
    return r.withColumn("idx", F.col("idx").cast(L))


@query(
    "choice_requests_in_context",
    f"WITH {REQ_SQL} SELECT doc_id, idx::BIGINT AS idx, task || c AS context, ' ' || task AS continuation FROM req",
)
def choice_requests_in_context(t: Tables):
    d = eval_docs(t).withColumn("goal", F.col("task"))
    r = Q.choice_requests(d, ["doc_id"], "task", "choices", multiple_input=True, target="goal")
    return r.select("doc_id", F.col("idx").cast(L).alias("idx"), "context", "continuation")


@query(
    "mixed_requests",
    """SELECT doc_id, sha256(text) AS context_hash, unnest(['generate_until','loglikelihood']) AS request_type,
        unnest(['{"until":["\\n"]}', ' unanswerable']) AS argument FROM documents""",
)
def mixed_requests(t: Tables):
    r = Q.answer_or_abstain_requests(t.documents, ["doc_id"], "text")
    return r.select("doc_id", F.sha2("text", 256).alias("context_hash"), "request_type", "argument")


@query("repeated_requests", f"WITH {EVAL_SQL} SELECT doc_id, task, unnest(range(3))::BIGINT AS rep FROM eval_docs")
def repeated_requests(t: Tables):
    return Q.repeat_requests(eval_docs(t).select("doc_id", "task"), 3).withColumn("rep", F.col("rep").cast(L))


HASH = "sha256(to_json(['loglikelihood', task, ' ' || c]))"


@query("request_hashes", f"WITH {REQ_SQL} SELECT doc_id, idx::BIGINT AS idx, {HASH} AS request_hash FROM req")
def request_hashes(t: Tables):
    r = Q.choice_requests(eval_docs(t), ["doc_id"], "task", "choices")
    return r.select("doc_id", F.col("idx").cast(L).alias("idx"), Q.request_hash(F.col("request_type"), F.col("context"), F.col("continuation")).alias("request_hash"))


@query(
    "task_hashes",
    f"""WITH {REQ_SQL}, l0 AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY doc_id, idx) - 1 AS pos, {HASH} AS h FROM req),
        l1 AS (SELECT task, pos // 8 AS block, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l0 GROUP BY task, pos // 8),
        l2 AS (SELECT task, block // 8 AS block, sha256(string_agg(h, '' ORDER BY block)) AS h FROM l1 GROUP BY task, block // 8)
        SELECT task, sha256(string_agg(h, '' ORDER BY block)) AS digest FROM l2 GROUP BY task""",
)
def task_hashes(t: Tables):
    r = Q.choice_requests(eval_docs(t), ["task", "doc_id"], "subject", "choices")
    r = r.select("task", "doc_id", "idx", Q.request_hash(F.col("request_type"), F.col("task"), F.col("continuation")).alias("h"))
    return Q.ordered_digest(r, ["doc_id", "idx"], "h", ["task"], fanout=8)


@query(
    "shifted_context_space",
    f"""SELECT doc_id, sha256(regexp_replace(c, '{SPACE}+$', '')) AS context_hash, regexp_extract(c, '({SPACE}*)$', 1) || 'word' AS continuation
        FROM (SELECT doc_id, text || repeat(' ', doc_id % 4) AS c FROM documents)""",
)
def shifted_context_space(t: Tables):
    d = t.documents.select("doc_id", F.concat(F.col("text"), F.expr("repeat(' ', cast(doc_id % 4 as int))")).alias("c"))
    ctx, cont = Q.shift_trailing_space(F.col("c"), F.lit("word"))
    return d.select("doc_id", F.sha2(ctx, 256).alias("context_hash"), cont.alias("continuation"))
