"""Queries of the preparation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import text as T
from evalspark.functions.draws import sql_draw
from evalspark.operators import ordering as O
from evalspark.operators import prepare as P
from evalspark.plans.base import SPACE, Tables, query, sql_tokens
from evalspark.plans.fixtures import EVAL_SQL, PAIRS_SQL, eval_docs, text_pairs

L = "long"


@query("filter_membership", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 500")
def filter_membership(t: Tables):
    d = t.documents
    return d.where(F.col("lang").isin("de", "fr") & (F.col("n_chars") >= 500)).select("doc_id", "lang", "source")


@query("filter_prefix", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def filter_prefix(t: Tables):
    return t.documents.where(F.col("source").startswith("src1")).select("doc_id", "source")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


@query(
    "paraphrase_pairs",
    f"""WITH {PAIRS_SQL}, opt AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 0 AND conv_id % 2 = 0 THEN '  ' ELSE prediction END AS s1,
          CASE WHEN conv_id % 9 = 0 THEN NULL ELSE reference END AS s2 FROM pairs)
        SELECT conv_id, turn, {sql_strip("regexp_replace(s1, ' +', ' ', 'g')")} AS s1, {sql_strip("regexp_replace(s2, ' +', ' ', 'g')")} AS s2
        FROM opt WHERE s1 IS NOT NULL AND s2 IS NOT NULL AND {sql_strip('s1')} <> '' AND {sql_strip('s2')} <> ''""",
)
def paraphrase_pairs(t: Tables):
    rows = text_pairs(t).select(
        "conv_id",
        "turn",
        F.when((F.col("turn") % 7 == 0) & (F.col("conv_id") % 2 == 0), "  ").otherwise(F.col("prediction")).alias("s1"),
        F.when(F.col("conv_id") % 9 == 0, F.lit(None)).otherwise(F.col("reference")).alias("s2"),
    )
    return P.keep_pairs(rows, "s1", "s2")


def sql_markup(x: str) -> str:
    return f"replace(regexp_replace(replace({sql_strip(x)}, ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')"


@query(
    "completion_rows",
    f"""WITH {EVAL_SQL} SELECT doc_id, sha256({sql_markup("source_q")}) AS query_hash,
        array_to_string(list_transform(choices, lambda c: {sql_markup("c || ' [title] [x] '")}), '|') AS choices, gold::BIGINT AS gold
        FROM (SELECT *, subject || ': ' || text || ' ' || upper(substring(lang, 1, 1)) || lower(substring(lang, 2)) AS source_q FROM eval_docs)""",
)
def completion_rows(t: Tables):
    d = eval_docs(t)
    q = P.continuation_query(F.col("subject"), F.col("text"), F.col("lang"))
    choices = F.transform("choices", lambda c: T.clean_markup(F.concat(c, F.lit(" [title] [x] "))))
    return d.select("doc_id", F.sha2(q, 256).alias("query_hash"), F.array_join(choices, "|").alias("choices"), F.col("gold").cast(L).alias("gold"))


@query(
    "sorted_distinct_words",
    f"SELECT doc_id, sha256(array_to_string(list_sort(list_distinct({sql_tokens('text')})), ' ')) AS words_hash FROM documents",
)
def sorted_distinct_words(t: Tables):
    return t.documents.select("doc_id", F.sha2(F.array_join(P.sorted_distinct(T.split_words(F.col("text"))), " "), 256).alias("words_hash"))


QAS_SQL = f"""lines AS (SELECT doc_id, unnest(range(len(ls))) AS q_no, unnest(ls) AS question FROM
    (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
  blobs AS (SELECT doc_id, q_no, question, a_no, length(question) + a_no AS n FROM (SELECT *, unnest(range(2)) AS a_no FROM lines)),
  ans AS (SELECT *, n % 7 = 0 AS unanswerable, CASE n % 3 WHEN 0 THEN true WHEN 1 THEN false END AS yes_no,
      CASE WHEN n % 5 = 0 THEN question ELSE '' END AS free_form,
      CASE WHEN n % 4 = 0 THEN {sql_tokens('question')} ELSE [] END AS spans FROM blobs)"""


def nested_qas(t: Tables):
    def blob(q, k):
        n = F.length(q) + k
        return F.struct(
            (n % 7 == 0).alias("unanswerable"),
            F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("yes_no"),
            F.when(n % 5 == 0, q).otherwise("").alias("free_form"),
            F.when(n % 4 == 0, T.split_words(q)).otherwise(F.array().cast("array<string>")).alias("spans"),
        )

    qas = F.transform(F.split("text", "\n", -1), lambda q: F.struct(q.alias("question"), F.array(blob(q, 0), blob(q, 1)).alias("answers")))
    return t.documents.select("doc_id", qas.alias("qas"))


@query(
    "flatten_answers_bool",
    f"""WITH {QAS_SQL} SELECT doc_id, q_no::BIGINT AS q_no, a_no::BIGINT AS a_no, question,
        CASE WHEN yes_no THEN 'yes' ELSE 'no' END AS answer FROM ans
        WHERE NOT unanswerable AND (yes_no OR (free_form = '' AND len(spans) = 0 AND yes_no = false))""",
)
def flatten_answers_bool(t: Tables):
    f = P.flatten_answers(nested_qas(t), "bool")
    return f.select("doc_id", F.col("q_no").cast(L).alias("q_no"), F.col("a_no").cast(L).alias("a_no"), "question", "answer")


@query(
    "flatten_answers_spans",
    f"""WITH {QAS_SQL} SELECT doc_id, q_no::BIGINT AS q_no, a_no::BIGINT AS a_no, array_to_string(spans, ', ') AS answer FROM ans
        WHERE NOT unanswerable AND coalesce(yes_no, false) = false AND free_form = '' AND len(spans) > 0""",
)
def flatten_answers_spans(t: Tables):
    f = P.flatten_answers(nested_qas(t), "extractive_spans")
    return f.select("doc_id", F.col("q_no").cast(L).alias("q_no"), F.col("a_no").cast(L).alias("a_no"), "answer")


@query("rows_per_answer", f"WITH {EVAL_SQL} SELECT doc_id, unnest(choices) AS answer FROM eval_docs")
def rows_per_answer(t: Tables):
    return P.per_answer(eval_docs(t).select("doc_id", "choices"), "choices")


@query(
    "first_rows",
    "SELECT conv_id, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn = 1",
)
def first_rows(t: Tables):
    return P.first_rows(t.conversations, "conv_id", "turn").select("conv_id", "role", "text")


@query(
    "collapsed_outputs",
    "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS output_no, text FROM conversations",
)
def collapsed_outputs(t: Tables):
    return P.outputs_in_order(t.conversations, "conv_id", "turn", "text")


@query("within_tokens", f"SELECT doc_id FROM documents WHERE len({sql_tokens('text')}) <= 300")
def within_tokens(t: Tables):
    return P.within_tokens(t.documents, "text", 300).select("doc_id")


@query(
    "split_question",
    """SELECT doc_id, CASE WHEN p > 0 THEN substring(inp, 1, p - 1) ELSE substring(inp, 1, length(inp) - 1) END AS question,
        sha256(CASE WHEN p > 0 THEN substring(inp, p + 2) ELSE substring(inp, 2) END) AS body_hash
       FROM (SELECT doc_id, inp, instr(inp, chr(10) || chr(10)) AS p FROM
         (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE lang || '?' || chr(10) || chr(10) || text END AS inp FROM documents))""",
)
def split_question(t: Tables):
    inp = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.col("lang"), F.lit("?\n\n"), F.col("text")))
    d = t.documents.select("doc_id", inp.alias("inp"))
    q, b = P.split_question(F.col("inp"))
    return d.select("doc_id", q.alias("question"), F.sha2(b, 256).alias("body_hash"))


@query(
    "head_fraction",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= floor(n * 0.1)",
)
def head_fraction(t: Tables):
    return O.head_fraction(t.documents.select("doc_id"), ["doc_id"], 0.1)


TEMPLATES = [
    {"prompt": "Question: {question}\n{options}Answer:", "options_format": "{letter}) {option}\n"},
    {"prompt": "{question} Choose one.\n{options}The best answer is", "options_format": "{numeral}. {option}\n"},
    {"prompt": "Pick for {category}: {question}\n{options}", "options_format": "({roman_numeral}) {option}\n"},
]


@query(
    "prompt_variants",
    f"WITH {EVAL_SQL} SELECT doc_id, prompt_id::BIGINT AS prompt_id, ['{{letter}}', '{{numeral}}', '{{roman_numeral}}'][prompt_id + 1] AS mark FROM (SELECT doc_id, unnest(range(3)) AS prompt_id FROM eval_docs)",
)
def prompt_variants(t: Tables):
    v = P.with_templates(eval_docs(t).select("doc_id"), TEMPLATES)
    return v.select("doc_id", F.col("prompt_id").cast(L).alias("prompt_id"), F.regexp_extract("options_format", r"(\{(letter|numeral|roman_numeral)\})", 1).alias("mark"))


VARIANTS_SQL = f"""{EVAL_SQL},
 lab AS (SELECT *, unnest(range(4)) AS k FROM eval_docs WHERE gold < len(choices)),
 variants AS (SELECT doc_id, task, k, gold, CASE WHEN k < len(choices) THEN k ELSE gold END AS answer_index,
   CASE WHEN k < len(choices) THEN list_transform(choices, lambda c, i: CASE WHEN i - 1 = k THEN choices[gold + 1] WHEN i - 1 = gold THEN choices[k + 1] ELSE c END)
        ELSE choices END AS options FROM lab)"""


def order_variants(t: Tables):
    d = eval_docs(t).where(F.col("gold") < F.size("choices"))
    return P.option_order_variants(
        d.select("doc_id", "task", F.col("choices").alias("options"), F.col("gold").alias("answer_index")), ["A", "B", "C", "D"]
    )


@query(
    "option_order_variants",
    f"""WITH {VARIANTS_SQL} SELECT doc_id, substring('ABCD', k + 1, 1) AS always_same_option, array_to_string(options, '|') AS options,
        answer_index::BIGINT AS answer_index, gold::BIGINT AS original_answer_index FROM variants""",
)
def option_order_variants(t: Tables):
    return order_variants(t).select("doc_id", "always_same_option", F.array_join("options", "|").alias("options"), "answer_index", "original_answer_index")


@query(
    "shuffled_choices",
    f"""WITH {EVAL_SQL}, k AS (SELECT doc_id, gold, choices, unnest(range(len(choices))) AS i FROM eval_docs),
      d AS (SELECT doc_id, gold, i, choices[i + 1] AS c, {sql_draw(42, 'doc_id', 'i')} AS d FROM k),
      o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, i) - 1 AS p FROM d)
      SELECT doc_id, string_agg(c, '|' ORDER BY p) AS choices, coalesce(max(p) FILTER (WHERE i = gold), -1)::BIGINT AS gold FROM o GROUP BY doc_id""",
)
def shuffled_choices(t: Tables):
    s = P.shuffle_choices(eval_docs(t).select("doc_id", "choices", "gold"), "doc_id", "choices", "gold", 42)
    return s.select("doc_id", F.array_join("choices", "|").alias("choices"), "gold")


def layouts(t: Tables):
    """The evaluation rows in six source layouts."""
    d = eval_docs(t)
    meta = dict(config=F.col("lang"), split=F.col("split"), index=F.col("doc_id").cast("string"), subject=F.col("subject"))
    c = lambda i: F.try_element_at("choices", F.lit(i))
    letter = P.letter_of(F.col("gold"))
    q = F.concat(F.lit("  "), F.sha2("text", 256), F.lit(" "))
    return P.union_all(
        [
            P.from_index(d.select("*", q.alias("question"), F.col("gold").alias("answer")), "indexed", **meta),
            P.from_letter(d.select("*", q.alias("question"), F.col("choices").alias("options"), letter.alias("answer")), "lettered", **meta),
            P.from_option_columns(d.select("*", q.alias("question"), letter.alias("answer"), *[c(i + 1).alias(f"option_{x}") for i, x in enumerate("abcd")]), "columns", **meta),
            P.from_labelled(
                d.select("doc_id", "lang", "split", "subject", q.alias("question"), letter.alias("answerKey"),
                         F.struct(F.col("choices").alias("text"), F.transform("choices", lambda x, i: P.letter_of(i)).alias("label")).alias("choices")),
                "labelled", **meta),
            P.from_numbered(d.select("*", q.alias("question"), (F.col("gold") + 1).alias("correct_answer_num"), F.col("text").alias("passage"), *[c(i).alias(f"mc_answer{i}") for i in range(1, 5)]), "numbered", **meta),
            P.from_endings(d.select("*", F.col("subject").alias("activity_label"), F.col("text").alias("ctx_a"), F.col("lang").alias("ctx_b"), F.col("choices").alias("endings"), F.col("gold").cast("string").alias("label")), "endings", question="Which ending fits?", **meta),
        ]
    )


CANONICAL_SQL = f"""{EVAL_SQL},
 kinds AS (SELECT *, unnest(['indexed','lettered','columns','labelled','numbered','endings']) AS dataset FROM eval_docs),
 canon AS (SELECT dataset || '/' || lang || '/' || split || '/' || doc_id AS uid, dataset, split, subject, gold, choices, text,
   CASE WHEN dataset IN ('columns','numbered') THEN 4 ELSE len(choices) END AS n,
   CASE WHEN dataset = 'labelled' AND gold >= len(choices) THEN NULL ELSE gold END AS target_index FROM kinds),
 checked AS (SELECT *, CASE WHEN n < 2 THEN 'choices' WHEN target_index IS NULL OR target_index >= n THEN 'target' END AS defect FROM canon)"""


@query(
    "canonical_rows",
    f"""WITH {CANONICAL_SQL} SELECT uid, subject, split, dataset, n::BIGINT AS n_choices, coalesce(defect, '') AS defect,
        coalesce(CASE WHEN defect IS NULL THEN substring('ABCD', target_index + 1, 1) END, '') AS target FROM checked""",
)
def canonical_rows(t: Tables):
    return layouts(t).select(
        "uid", "subject", "split", "dataset", F.size("choices").cast(L).alias("n_choices"),
        F.coalesce("defect", F.lit("")).alias("defect"), F.coalesce("target", F.lit("")).alias("target"),
    )


@query(
    "answer_disagreements",
    f"WITH {EVAL_SQL} SELECT doc_id, substring('ABCD', gold + 1, 1) AS letter, (doc_id % 3)::BIGINT AS stored FROM eval_docs WHERE gold <> doc_id % 3",
)
def answer_disagreements(t: Tables):
    d = eval_docs(t).select("doc_id", P.letter_of(F.col("gold")).alias("letter"), (F.col("doc_id") % 3).alias("stored"))
    return P.answer_disagreements(d, "doc_id", "letter", "stored")


@query(
    "profile_counts",
    f"""WITH {EVAL_SQL}, v AS (SELECT lang, unnest(['subject','target','choices']) AS field,
         unnest([subject, substring('ABCD', gold + 1, 1), len(choices)::VARCHAR]) AS value FROM eval_docs)
        SELECT lang, field, value, count(*)::BIGINT AS n FROM v GROUP BY ALL""",
)
def profile_counts(t: Tables):
    return P.profile(eval_docs(t), ["lang"], {"subject": F.col("subject"), "target": P.letter_of(F.col("gold")), "choices": F.size("choices")})


@query("limit_absolute", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25")
def limit_absolute(t: Tables):
    return O.limit_rows(t.documents.select("doc_id", "lang"), ["doc_id"], 25)


@query(
    "limit_fraction",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= ceil(n * 0.123)",
)
def limit_fraction(t: Tables):
    return O.limit_rows(t.documents.select("doc_id"), ["doc_id"], 0.123)


@query("limit_to_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def limit_to_ids(t: Tables):
    return O.limit_to_ids(t.documents.select("doc_id", "lang"), t.labels.where("toxic = 1"), ["doc_id"])


@query(
    "shard_rows",
    "SELECT doc_id, pos::BIGINT AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM labels) WHERE pos % 4 = 1",
)
def shard_rows(t: Tables):
    return O.shard(t.labels.select("doc_id"), ["doc_id"], 1, 4)


@query(
    "row_numbers",
    "SELECT 'documents/' || lang || '/all/' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS uid, (row_number() OVER (ORDER BY lang, doc_id) - 1)::BIGINT AS file_offset, doc_id FROM documents",
)
def row_numbers(t: Tables):
    """Stable ids in source order: global offset and per-configuration index."""
    d = O.with_position(t.documents.select("doc_id", "lang"), ["lang", "doc_id"], name="file_offset")
    first = d.groupBy("lang").agg(F.min("file_offset").alias("first"))
    d = d.join(F.broadcast(first) if first.limit(10001).count() <= 10000 else first, "lang")
    return d.select(F.concat_ws("/", F.lit("documents"), "lang", F.lit("all"), F.col("file_offset") - F.col("first")).alias("uid"), "file_offset", "doc_id")


def sql_steps(x: str, steps) -> str:
    q = lambda s: s.replace("'", "''")
    for kind, old, new in steps:
        if kind == "lit":
            x = f"replace({x}, '{q(old)}', '{q(new)}')"
        else:
            pattern = q(old).replace("\\s", SPACE)
            x = f"regexp_replace({x}, '{pattern}', '{q(new).replace('$1', chr(92) + '1')}', 'g')"
    return x


def spaced(x: str) -> str:
    return f"replace(replace({x}, ',', ' , '), '.', ' . ') || ' ( x ) @-@ [ y ] n''t'"


def spaced_col(c):
    return F.concat(F.replace(F.replace(c, F.lit(","), F.lit(" , ")), F.lit("."), F.lit(" . ")), F.lit(" ( x ) @-@ [ y ] n't"))


@query("detokenize_wikitext", f"SELECT doc_id, {sql_steps(spaced('text'), T.WIKITEXT_STEPS)} AS text FROM documents")
def detokenize_wikitext(t: Tables):
    return t.documents.select("doc_id", T.detokenize_wikitext(spaced_col(F.col("text"))).alias("text"))


@query("detokenize_general", f"SELECT doc_id, {sql_steps(spaced('text'), T.GENERAL_STEPS)} AS text FROM documents")
def detokenize_general(t: Tables):
    return t.documents.select("doc_id", T.detokenize(spaced_col(F.col("text"))).alias("text"))


@query("clean_markup", f"SELECT page_id, sha256({sql_markup('''html || ' [title] [cut] end' ''')}) AS cleaned FROM pages")
def clean_markup(t: Tables):
    return t.pages.select("page_id", F.sha2(T.clean_markup(F.concat("html", F.lit(" [title] [cut] end "))), 256).alias("cleaned"))


@query(
    "finished_answers",
    f"""SELECT doc_id, sha256(array_to_string(CASE WHEN list_contains(a, 'I have no comment.') THEN a ELSE list_append(a, 'I have no comment.') END, '|')) AS answers_hash
        FROM (SELECT doc_id, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> ''),
              lambda x: CASE WHEN ends_with(x, '.') THEN x ELSE x || '.' END) AS a FROM documents)""",
)
def finished_answers(t: Tables):
    a = P.finish_answers(F.split("text", "\n", -1), "I have no comment.")
    return t.documents.select("doc_id", F.sha2(F.array_join(a, "|"), 256).alias("answers_hash"))


@query(
    "minimal_aliases",
    f"""WITH {EVAL_SQL}, a AS (SELECT doc_id, list_sort(list_concat(choices, list_transform(choices, lambda c: substring(c, 1, 3)))) AS al FROM eval_docs)
        SELECT doc_id, array_to_string(list_filter(al, lambda x, i: NOT list_contains(list_transform(list_slice(al, 1, i - 1), lambda y: starts_with(x, y)), true)), '|') AS aliases FROM a""",
)
def minimal_aliases(t: Tables):
    al = F.concat("choices", F.transform("choices", lambda c: F.substring(c, 1, 3)))
    return eval_docs(t).select("doc_id", F.array_join(P.minimal_aliases(al), "|").alias("aliases"))


@query(
    "shots_preprompt",
    f"""WITH {EVAL_SQL} SELECT doc_id, sha256(text) AS original_hash, array_to_string(list_transform(choices, lambda c, i:
        'Question: ' || c || chr(10) || 'Answer: ' || lang || i || chr(10) || chr(10)), '') AS preprompt FROM eval_docs""",
)
def shots_preprompt(t: Tables):
    shots = F.transform("choices", lambda c, i: F.struct(c.alias("question"), F.concat(F.col("lang"), (i + 1).cast("string")).alias("answer")))
    return eval_docs(t).select("doc_id", F.sha2("text", 256).alias("original_hash"), P.shots_preprompt(shots).alias("preprompt"))


@query("binarized_annotation", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, ((l_quantity / 10 + l_discount * 10) > 5.5)::BIGINT AS label FROM lineitem")
def binarized_annotation(t: Tables):
    return t.lineitem.select("l_orderkey", F.col("l_linenumber").cast(L).alias("l_linenumber"), "l_partkey", P.binarize(F.col("l_quantity") / 10, F.col("l_discount") * 10).alias("label"))
