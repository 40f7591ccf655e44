"""Queries of the response-filter family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import extraction as X
from evalspark.functions.templates import NUMERALS, ROMAN
from evalspark.operators import filters as S
from evalspark.plans.base import SPACE, Tables, query, sql_tokens
from evalspark.plans.fixtures import EVAL_SQL, GENERATED_SQL, eval_docs, generated
from evalspark.plans.prepare import sql_strip
from evalspark.registry import register_sql

L = "long"
NUM = r"#### (\-?[0-9\.\,]+)"
PICK = f"coalesce({sql_strip(f'''regexp_extract_all(resp, '{NUM}', 1)[1]''')}, '[invalid]')"


@query("filter_regex", f"WITH {GENERATED_SQL} SELECT doc_id, rep, {PICK} AS resp FROM gen")
def filter_regex(t: Tables):
    return S.regex()(generated(t)).select("doc_id", "rep", "resp")


@query(
    "filter_regex_groups",
    f"""WITH {GENERATED_SQL}, r AS (SELECT doc_id, rep, resp || ' 12 idea' AS resp FROM gen)
        SELECT doc_id, rep, regexp_extract_all(resp, '([0-9]+)|(id[a-z]+)')[1] AS first_one, regexp_extract_all(resp, '([0-9]+)|(id[a-z]+)')[-1] AS last_one,
        coalesce(regexp_extract_all(resp, '([0-9]+)|(id[a-z]+)')[3], '[invalid]') AS third FROM r""",
)
def filter_regex_groups(t: Tables):
    r = generated(t).withColumn("resp", F.concat("resp", F.lit(" 12 idea")))
    p = "([0-9]+)|(id[a-z]+)"
    return r.select("doc_id", "rep", X.regex_answer(F.col("resp"), p).alias("first_one"), X.regex_answer(F.col("resp"), p, -1).alias("last_one"), X.regex_answer(F.col("resp"), p, 2).alias("third"))


@query(
    "filter_pos_tags",
    f"""WITH x AS (SELECT doc_id, list_transform({sql_tokens('text')}, lambda w: '(''' || replace(w, '''', '') || ''', ''T' || length(w) || ''')') AS g FROM documents)
        SELECT doc_id, len(g)::BIGINT AS n_tags, CASE WHEN len(g) = 0 THEN 'invalid' ELSE array_to_string(list_transform(g, lambda p: regexp_extract(p, ', ''(T[0-9]+)''', 1)), ' ') END AS tags FROM x""",
)
def filter_pos_tags(t: Tables):
    words = F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    pair = F.transform(words, lambda w: F.concat(F.lit("('"), F.replace(w, F.lit("'"), F.lit("")), F.lit("', 'T"), F.length(w), F.lit("')")))
    d = t.documents.select("doc_id", F.size(words).cast(L).alias("n_tags"), F.array_join(pair, ", ").alias("resp"))
    return S.regex_pos()(d).select("doc_id", "n_tags", F.array_join("resp", " ").alias("tags"))


@query("filter_whitespace", f"SELECT doc_id, sha256(regexp_replace(repeat(chr(10) || ' ', doc_id::INT % 3) || text, '^{SPACE}+', '')) AS resp FROM documents")
def filter_whitespace(t: Tables):
    d = t.documents.select("doc_id", F.expr("concat(repeat('\n ', cast(doc_id % 3 as int)), text)").alias("resp"))
    return S.remove_whitespace()(d).select("doc_id", F.sha2("resp", 256).alias("resp"))


MC_SQL = f"""{EVAL_SQL}, r AS (SELECT doc_id, choices, gold, len(choices) AS n, CASE doc_id % 4 WHEN 0 THEN 'answer #### 42' WHEN 1 THEN 'I would say ' || choices[least(gold, len(choices) - 1) + 1] || '.'
   WHEN 2 THEN '0 0:  ' || substring('ABCD', gold + 1, 1) ELSE text END AS resp FROM eval_docs),
 pos AS (SELECT doc_id, i, c, nullif(instr(resp, c), 0) AS p FROM (SELECT doc_id, resp, unnest(range(n)) AS i, unnest(choices) AS c FROM r)),
 lead AS (SELECT doc_id, arg_min(c, p * 10 + i) AS c FROM pos WHERE p IS NOT NULL GROUP BY doc_id)"""


@query(
    "filter_multi_choice",
    f"""WITH {MC_SQL} SELECT doc_id, coalesce(regexp_extract_all(resp, '{NUM}', 1)[1],
        '(' || substring('ABCD', len(choices) - list_position(list_reverse(choices), l.c)::INT + 1, 1) || ')',
        '(' || nullif(regexp_extract(resp, ':\\s*([' || substring('ABCD', 1, n) || '])', 1), '') || ')', '[invalid]') AS resp FROM r LEFT JOIN lead l USING (doc_id)""",
)
def filter_multi_choice(t: Tables):
    d = eval_docs(t)
    m = F.col("doc_id") % 4
    at = F.least(F.col("gold"), F.size("choices") - 1).cast("int") + 1
    resp = (
        F.when(m == 0, "answer #### 42")
        .when(m == 1, F.concat(F.lit("I would say "), F.element_at("choices", at), F.lit(".")))
        .when(m == 2, F.concat(F.lit("0 0:  "), F.substring(F.lit("ABCD"), F.col("gold").cast("int") + 1, F.lit(1))))
        .otherwise(F.col("text"))
    )
    return S.multi_choice_regex()(d.select("doc_id", "choices", resp.alias("resp"))).select("doc_id", "resp")


@query("filter_take_first", f"WITH {GENERATED_SQL} SELECT doc_id, resp FROM gen WHERE rep = 0")
def filter_take_first(t: Tables):
    return S.take_first()(generated(t)).select("doc_id", "resp")


@query("filter_take_first_k", f"WITH {GENERATED_SQL} SELECT doc_id, rep, resp FROM gen WHERE rep < 3")
def filter_take_first_k(t: Tables):
    return S.take_first_k(["doc_id"], 3)(generated(t)).select("doc_id", "rep", "resp")


MAJ = f"""voted AS (SELECT doc_id, resp, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(rep)) AS rk FROM (SELECT doc_id, rep, {PICK} AS resp FROM gen) GROUP BY doc_id, resp QUALIFY rk = 1)"""


@query("filter_majority_vote", f"WITH {GENERATED_SQL}, {MAJ} SELECT doc_id, resp FROM voted")
def filter_majority_vote(t: Tables):
    return S.majority_vote(["doc_id"])(S.regex()(generated(t))).select("doc_id", "resp")


@query("filter_case", "SELECT doc_id, sha256(lower(source || text)) AS low, upper(source) AS up FROM documents")
def filter_case(t: Tables):
    low = S.lowercase()(t.documents.select("doc_id", "source", F.concat("source", "text").alias("resp"))).withColumnRenamed("resp", "low")
    up = S.uppercase()(low.withColumnRenamed("source", "resp"))
    return up.select("doc_id", F.sha2("low", 256).alias("low"), F.col("resp").alias("up"))


@query(
    "filter_map",
    f"WITH {GENERATED_SQL} SELECT doc_id, rep, CASE {PICK} WHEN '0' THEN 'zero' WHEN '1' THEN 'one' WHEN '2' THEN 'two' ELSE 'many' END AS resp FROM gen",
)
def filter_map(t: Tables):
    r = S.regex()(generated(t))
    return S.map_values({"0": "zero", "1": "one", "2": "two"}, "many")(r).select("doc_id", "rep", "resp")


def sql_entities(x: str) -> str:
    for word, label in X.ENTITY_WORDS.items():
        x = f"replace({x}, '{word}', '{label}')"
    return x


@query(
    "filter_entity_spans",
    f"""WITH {EVAL_SQL}, x AS (SELECT doc_id, lower(array_to_string(choices, ',')) AS c, lower(lang) AS g FROM eval_docs),
      e AS (SELECT doc_id, g, list_filter(list_transform(string_split(regexp_replace({sql_entities('c')}, '[$]', 'x', 'g'), ','), lambda v: trim(v)), lambda v: lower(v) <> 'none') AS v FROM x)
      SELECT doc_id, array_to_string(list_concat(list_transform(v, lambda a: 'per: ' || a), ['loc: ' || g]), ' $ ') AS resp FROM e""",
)
def filter_entity_spans(t: Tables):
    words = F.regexp_replace(F.array_join("choices", ","), "[$]", "x")
    resp = F.concat(F.lit("Person: "), words, F.lit(", none $$ Location: "), F.col("lang"), F.lit("$$"))
    return S.format_span()(eval_docs(t).select("doc_id", resp.alias("resp"))).select("doc_id", "resp")


@query(
    "filter_sets",
    f"""WITH {GENERATED_SQL}, {MAJ} SELECT doc_id, 'first' AS filter, {PICK} AS resp FROM gen WHERE rep = 0
        UNION ALL SELECT doc_id, 'maj@5', resp FROM voted UNION ALL SELECT doc_id, 'none', resp FROM gen WHERE rep = 0
        UNION ALL SELECT doc_id, 'shout', upper(resp) || '!' FROM gen WHERE rep = 0""",
)
def filter_sets(t: Tables):
    p = {
        "none": [S.take_first()],
        "first": [S.regex(), S.take_first()],
        "maj@5": [S.regex(), S.majority_vote(["doc_id"])],
        "shout": [S.uppercase(), S.custom(lambda df: F.concat(df["resp"], F.lit("!"))), S.take_first()],
    }
    return S.apply_filter_sets(generated(t).select("doc_id", "rep", "resp"), p).select("doc_id", "filter", "resp")


@query(
    "filter_stop_sequences",
    f"SELECT doc_id, sha256(regexp_replace(list_extract(string_split(string_split(text, '. ')[1] || '</think>' || chr(10) || 'x', '</think>'), -1), '^{SPACE}+', '')) AS thought, string_split(string_split(text, chr(10))[1], ',')[1] AS cut FROM documents",
)
def filter_stop_sequences(t: Tables):
    thought = X.cut_generation(F.concat(F.substring_index("text", ". ", 1), F.lit("</think>\nx")), None, "</think>")
    return t.documents.select("doc_id", F.sha2(thought, 256).alias("thought"), X.cut_generation(F.col("text"), ["\n", ","]).alias("cut"))


FINAL_SQL = f"""{EVAL_SQL}, r AS (SELECT doc_id, substring('ABCD', gold::INT + 1, 1) AS l, CASE WHEN doc_id % 10 IN (4, 5, 8, 9) THEN false ELSE true END AS ok, doc_id % 10 AS m FROM eval_docs)"""


@query(
    "filter_final_letter",
    f"""WITH {FINAL_SQL} SELECT doc_id, CASE WHEN ok THEN l ELSE '[invalid]' END AS label, CASE WHEN NOT ok THEN 'invalid' WHEN m = 3 THEN 'marked-letter' ELSE 'boxed' END AS format FROM r""",
)
def filter_final_letter(t: Tables):
    """The statement beside it derives the expected letter from how each response was built."""
    d = eval_docs(t)
    letter = lambda s: F.substring(F.lit(s), F.col("gold").cast("int") + 1, F.lit(1))
    latin, greek = letter("ABCD"), letter("ΑΒΓΔ")
    latex = F.element_at(F.array(*[F.lit(x) for x in ("\\Alpha", "\\beta", "\\Gamma", "\\delta")]), F.col("gold").cast("int") + 1)
    box = lambda c: F.concat(F.lit("\\boxed{"), c, F.lit("}"))
    mark = F.lit("Τελική απάντηση: ")
    forms = [
        F.concat(F.col("text"), F.lit("\n"), mark, box(latin)),
        F.concat(mark, F.lit("$"), box(F.concat(F.lit("\\text{"), greek, F.lit("}"))), F.lit("$")),
        box(latex),
        F.concat(F.col("text"), F.lit("\n"), mark, latin, F.lit(".")),
        latin,
        F.concat(F.lit("<think>\n"), F.col("text"), mark, box(latin)),
        F.concat(F.lit("<think>a\nΕρώτηση: x</think>\n"), box(latin), F.lit("<|im_end|> ")),
        F.concat(mark, box(latin), F.lit("\n\nΕρώτηση: νέα\n"), box(F.lit("Z"))),
        F.concat(box(latin), F.lit("\nnot final")),
        F.concat(F.lit("<think>a</ifm|think>b</think>\n"), box(latin)),
    ]
    resp = F.coalesce(*[F.when(F.col("doc_id") % 10 == i, f) for i, f in enumerate(forms)])
    return d.select("doc_id", F.inline(F.array(X.final_letter(resp, F.lit(4)))))


@query("filter_completion", "SELECT doc_id, sha256(lang || string_split(text || '```' || source, '```')[1]) AS resp FROM documents")
def filter_completion(t: Tables):
    return t.documents.select("doc_id", F.sha2(X.completion(F.col("lang"), F.concat("text", F.lit("```"), "source"), "```"), 256).alias("resp"))


@query(
    "filter_boxed_math",
    r"""WITH x AS (SELECT doc_id, doc_id % 9 + 1 AS a, doc_id % 7 + 2 AS b, doc_id % 4 AS m FROM documents)
        SELECT doc_id, CASE m WHEN 0 THEN '\frac{' || a || '}{' || b || '}' WHEN 1 THEN '\sqrt{' || a || '}' WHEN 2 THEN '\frac{1}{2}' ELSE '\frac{' || a || '}{' || b || '}' END AS form FROM x""",
)
def filter_boxed_math(t: Tables):
    a, b, m = (F.col("doc_id") % 9 + 1).cast("string"), (F.col("doc_id") % 7 + 2).cast("string"), F.col("doc_id") % 4
    answer = (
        F.when(m == 0, F.concat(F.lit("x = \\dfrac{"), a, F.lit("}{"), b, F.lit("}\\text{ cm}")))
        .when(m == 1, F.concat(F.lit("\\sqrt"), a, F.lit("\\%")))
        .when(m == 2, F.lit(".5"))
        .otherwise(F.concat(a, F.lit("/"), b))
    )
    resp = F.concat(F.col("text"), F.lit(" \\boxed{0} so \\boxed{"), answer, F.lit("} done}"))
    return t.documents.select("doc_id", X.math_form(X.last_boxed(resp)).alias("form"))


@query(
    "filter_best_answer",
    f"""WITH {EVAL_SQL} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substring('ABCD', gold::INT + 1, 1) WHEN 1 THEN substring('ABCD', gold::INT + 1, 1) ELSE upper(lang) END AS label FROM eval_docs""",
)
def filter_best_answer(t: Tables):
    g = F.col("gold").cast("int") + 1
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs[:4]]), g)
    m = F.col("doc_id") % 3
    r = eval_docs(t).select(
        "doc_id", m.alias("m"),
        F.when(m == 0, F.concat(F.col("text"), F.lit(" The best answer is "), pick(ROMAN), F.lit(". ok")))
        .when(m == 1, F.concat(F.lit("The best answer is ("), pick(NUMERALS), F.lit(")\nbecause")))
        .otherwise(F.col("lang")).alias("resp"),
    )
    ans = X.best_answer_phrase(F.col("resp"))
    labels = ["A", "B", "C", "D"]
    out = F.when(F.col("m") == 0, X.answer_to_label(ans, labels, ROMAN[:4])).when(F.col("m") == 1, X.answer_to_label(ans, labels, NUMERALS[:4])).otherwise(X.answer_to_label(ans, labels))
    return r.select("doc_id", out.alias("label"))


@query("filter_first_line", f"SELECT doc_id, string_split({sql_strip('text')}, chr(10))[1] AS line FROM documents")
def filter_first_line(t: Tables):
    return t.documents.select("doc_id", X.first_line(F.col("text")).alias("line"))


@query(
    "sql_functions",
    f"SELECT doc_id, len(string_split_regex(text, '{SPACE}+'))::BIGINT AS words, strlen(text)::BIGINT AS bytes FROM documents",
)
def sql_functions(t: Tables):
    """Registered functions called from SQL."""
    register_sql(t.spark, ["word_count", "byte_count"])
    t.documents.createOrReplaceTempView("evalspark_documents")
    return t.spark.sql("SELECT doc_id, word_count(text) AS words, byte_count(text) AS bytes FROM evalspark_documents")
