"""Queries of the per-sample metric family."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions import alignment as G
from evalspark.functions import answers as N
from evalspark.functions import text as T
from evalspark.functions.ngrams import ngrams
from evalspark.operators import overlap as O
from evalspark.operators import scoring as C
from evalspark.plans.base import PUNCT, SPACE, Tables, query, sql_ngrams, sql_tokens
from evalspark.plans.fixtures import CHOICES_SQL, EVAL_SQL, GENERATED_SQL, PAIRS_SQL, choice_rows, eval_docs, generated, text_pairs
from evalspark.plans.prepare import sql_strip
from evalspark.session import spread

L = "long"
PAIR = ["conv_id", "turn"]


def rnd(df, *cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


@query("loglikelihood_scores", f"WITH {CHOICES_SQL} SELECT doc_id, idx, round(loglik, 6) AS perplexity, is_greedy::INT::DOUBLE AS acc FROM mc")
def loglikelihood_scores(t: Tables):
    return rnd(C.loglikelihood_scores(choice_rows(t), ["doc_id", "idx"]), "perplexity")


ROLLING_SQL = f"""rolling AS (SELECT doc_id, lang, -length(text) * ((doc_id % 7) + 1) / 20.0::DOUBLE AS loglik,
  len(string_split_regex(text, '{SPACE}+'))::BIGINT AS words, strlen(text)::BIGINT AS bytes FROM documents)"""


def rolling(t: Tables):
    d = t.documents.select("doc_id", "lang", "text", (-F.length("text") * (F.col("doc_id") % 7 + 1) / F.lit(20.0)).alias("loglik"))
    return C.rolling_scores(d, ["doc_id", "lang"], "text")


@query("rolling_scores", f"WITH {ROLLING_SQL} SELECT * FROM rolling")
def rolling_scores(t: Tables):
    return rolling(t)


ARG_SQL = f"""{CHOICES_SQL},
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loglik DESC, idx) AS r1, row_number() OVER (PARTITION BY doc_id ORDER BY loglik / length(choice) DESC, idx) AS r2,
   row_number() OVER (PARTITION BY doc_id ORDER BY loglik - uncond DESC, idx) AS r3 FROM mc),
 best AS (SELECT doc_id, any_value(task) AS task, any_value(lang) AS lang, any_value(subject) AS subject, any_value(gold) AS gold, count(*) AS n,
   max(idx) FILTER (WHERE r1 = 1) AS pred, max(idx) FILTER (WHERE r2 = 1) AS pred_norm, max(idx) FILTER (WHERE r3 = 1) AS pred_mi,
   max(CASE WHEN idx = gold AND is_greedy THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_match FROM ranked GROUP BY doc_id),
 scored AS (SELECT doc_id, task, lang, subject, gold, n, pred, (pred = gold)::INT::DOUBLE AS acc, (pred_norm = gold)::INT::DOUBLE AS acc_norm, (pred_mi = gold)::INT::DOUBLE AS acc_mutual_info, exact_match, gold >= n AS gold_defect FROM best)"""


@query(
    "choice_scores",
    f"WITH {ARG_SQL} SELECT doc_id, n::BIGINT AS n_choices, pred::BIGINT AS pred, acc, acc_norm, acc_mutual_info, exact_match, gold_defect FROM scored",
)
def choice_scores(t: Tables):
    return C.choice_scores(choice_rows(t), ["doc_id"])


@query(
    "choice_scores_many_golds",
    f"""WITH {ARG_SQL}, g AS (SELECT doc_id, max(CASE WHEN (idx = gold OR idx = (gold + 1) % 4) AND is_greedy THEN 1.0 ELSE 0.0 END)::DOUBLE AS em FROM mc GROUP BY doc_id)
        SELECT doc_id, (pred = gold OR pred = (gold + 1) % 4)::INT::DOUBLE AS acc, em AS exact_match, (gold >= n OR (gold + 1) % 4 >= n) AS gold_defect FROM scored JOIN g USING (doc_id)""",
)
def choice_scores_many_golds(t: Tables):
    s = C.choice_scores(choice_rows(t), ["doc_id"], golds=F.array("gold", (F.col("gold") + 1) % 4))
    return s.select("doc_id", "acc", "exact_match", "gold_defect")


SOFT_SQL = f"""{CHOICES_SQL}, e AS (SELECT *, exp(loglik - max(loglik) OVER (PARTITION BY doc_id)) AS e FROM mc),
 soft AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM e),
 brier AS (SELECT doc_id, any_value(task) AS task, sum((prob - (idx = gold)::INT) * (prob - (idx = gold)::INT)) AS brier FROM soft GROUP BY doc_id)"""


@query("softmax_probabilities", f"WITH {SOFT_SQL} SELECT doc_id, idx, round(prob, 6) AS prob FROM soft")
def softmax_probabilities(t: Tables):
    return rnd(C.softmax_rows(choice_rows(t), ["doc_id"]).select("doc_id", "idx", "prob"), "prob")


@query("brier_scores", f"WITH {SOFT_SQL} SELECT doc_id, round(brier, 6) AS brier FROM brier")
def brier_scores(t: Tables):
    return rnd(C.brier_scores(choice_rows(t), ["doc_id"]), "brier")


@query("probability_mass", f"WITH {CHOICES_SQL} SELECT doc_id, round(sum(CASE WHEN (doc_id + idx) % 2 = 0 THEN exp(loglik) ELSE 0 END) / sum(exp(loglik)), 6) AS acc FROM mc GROUP BY doc_id")
def probability_mass(t: Tables):
    return rnd(C.probability_mass(choice_rows(t), ["doc_id"], (F.col("doc_id") + F.col("idx")) % 2 == 0), "acc")


WIDE_SQL = f"{CHOICES_SQL}, w AS (SELECT doc_id, " + ", ".join(f"max(loglik) FILTER (WHERE idx = {i}) AS l{i}" for i in range(4)) + " FROM mc GROUP BY doc_id)"


@query("pair_bias", f"WITH {WIDE_SQL} SELECT doc_id, round(abs(l0 - l1), 6) AS likelihood_diff, (l0 > l1)::INT::DOUBLE AS pct_stereotype FROM w WHERE l1 IS NOT NULL")
def pair_bias(t: Tables):
    return rnd(C.pair_bias(choice_rows(t), ["doc_id"]), "likelihood_diff")


@query(
    "gender_bias",
    f"WITH {WIDE_SQL} SELECT doc_id, round(ln(exp(l0) + exp(l1)) - ln(exp(l2) + exp(l3)), 6) AS likelihood_diff, (greatest(l2, l3) > greatest(l0, l1))::INT::DOUBLE AS pct_male_preferred FROM w WHERE l3 IS NOT NULL",
)
def gender_bias(t: Tables):
    return rnd(C.gender_bias(choice_rows(t), ["doc_id"]), "likelihood_diff")


EXTREME_SQL = f"""{CHOICES_SQL}, x AS (SELECT doc_id, idx, gold, CASE WHEN (doc_id + idx) % 5 = 0 THEN '-inf'::DOUBLE ELSE loglik * 1000 END AS ll, CASE WHEN idx = 2 THEN '' ELSE choice END AS choice FROM mc),
 xm AS (SELECT *, max(ll) OVER (PARTITION BY doc_id) AS top, CASE WHEN choice = '' THEN '-inf'::DOUBLE ELSE ll / length(choice) END AS norm FROM x),
 xe AS (SELECT *, CASE WHEN ll = '-inf'::DOUBLE THEN 0 ELSE exp(ll - top) END AS e, row_number() OVER (PARTITION BY doc_id ORDER BY norm DESC, idx) AS r FROM xm),
 xs AS (SELECT doc_id, sum(CASE WHEN (doc_id + idx) % 2 = 0 THEN e ELSE 0 END) AS part, sum(e) AS whole, max(CASE WHEN r = 1 THEN (idx = gold)::INT END)::DOUBLE AS acc_norm, """ + ", ".join(f"max(ll) FILTER (WHERE idx = {i}) AS l{i}" for i in range(4)) + """ FROM xe GROUP BY doc_id),
 xl AS (SELECT *, greatest(l0, l1) AS ya, least(l0, l1) AS yb, greatest(l2, l3) AS na, least(l2, l3) AS nb FROM xs)"""


def extreme_rows(t: Tables):
    ll = F.when((F.col("doc_id") + F.col("idx")) % 5 == 0, float("-inf")).otherwise(F.col("loglik") * 1000)
    return choice_rows(t).withColumn("loglik", ll).withColumn("choice", F.when(F.col("idx") == 2, "").otherwise(F.col("choice")))


@query(
    "extreme_likelihoods",
    f"""WITH {EXTREME_SQL}, d AS (SELECT *, CASE WHEN yb = '-inf'::DOUBLE OR l0 IS NULL OR l1 IS NULL THEN ya ELSE ya + ln(1 + exp(yb - ya)) END AS yes,
          CASE WHEN nb = '-inf'::DOUBLE OR l2 IS NULL OR l3 IS NULL THEN na ELSE na + ln(1 + exp(nb - na)) END AS no FROM xl)
        SELECT doc_id, round(part / nullif(whole, 0), 6) AS mass, acc_norm, round(yes - no, 4) AS logit_yes FROM d""",
)
def extreme_likelihoods(t: Tables):
    """Likelihoods of hundreds below zero and of impossible choices, and empty choices."""
    rows, key = extreme_rows(t), ["doc_id"]
    mass = C.probability_mass(rows, key, (F.col("doc_id") + F.col("idx")) % 2 == 0).withColumnRenamed("acc", "mass")
    norm = C.choice_scores(rows, key).select("doc_id", "acc_norm")
    out = mass.join(norm, key).join(C.yes_logit(rows, key), key, "left")
    return out.select("doc_id", F.round("mass", 6).alias("mass"), "acc_norm", F.round("logit_yes", 4).alias("logit_yes"))


WORDS_SQL = f"""{EVAL_SQL}, g AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['man', lang] WHEN 1 THEN ['woman', 'female'] WHEN 2 THEN [lang] ELSE ['male', 'woman'] END AS ws FROM eval_docs),
 f AS (SELECT doc_id, list_has_any(ws, ['male', 'man']) AS m, list_has_any(ws, ['female', 'woman']) AS f FROM g)"""


@query(
    "gender_words",
    f"WITH {WORDS_SQL} SELECT doc_id, (m::INT - f::INT)::BIGINT AS difference_male_female, (m AND NOT f)::BIGINT AS pct_male_preferred, f::BIGINT AS pct_female_preferred, (NOT m AND NOT f)::BIGINT AS pct_invalid FROM f",
)
def gender_words(t: Tables):
    m = F.col("doc_id") % 4
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    ws = F.when(m == 0, a("man", F.col("lang"))).when(m == 1, a("woman", "female")).when(m == 2, a(F.col("lang"))).otherwise(a("male", "woman"))
    return eval_docs(t).select("doc_id", F.inline(F.array(C.gender_words(ws))))


@query(
    "ranking_scores",
    f"""WITH {ARG_SQL}, g AS (SELECT mc.doc_id, max(loglik) FILTER (WHERE idx = gold) AS gl FROM mc GROUP BY doc_id),
      a AS (SELECT doc_id, count(*) FILTER (WHERE loglik > gl) AS above FROM mc JOIN g USING (doc_id) WHERE gl IS NOT NULL GROUP BY doc_id)
      SELECT doc_id, acc AS r1, (above = 1)::INT + acc AS r2, round(1.0 / (above + 1), 6)::DOUBLE AS mrr FROM a JOIN scored USING (doc_id)""",
)
def ranking_scores(t: Tables):
    return rnd(C.ranking_scores(choice_rows(t), ["doc_id"]), "mrr")


@query("yes_logit", f"WITH {WIDE_SQL} SELECT doc_id, round(ln((exp(l0) + exp(l1)) / (exp(l2) + coalesce(exp(l3), 0))), 6) AS logit_yes FROM w WHERE l2 IS NOT NULL")
def yes_logit(t: Tables):
    return rnd(C.yes_logit(choice_rows(t), ["doc_id"]), "logit_yes")


# --- generated answers ------------------------------------------------------------------------------

@query(
    "exact_match_options",
    f"""WITH {GENERATED_SQL} SELECT doc_id, rep, (resp = 'so the result is #### ' || gold_num)::INT::DOUBLE AS plain,
        (translate(lower(regexp_replace(resp, 'so the', '')), '#', '') = translate(lower(' RESULT is #### ' || gold_num), '#', ''))::INT::DOUBLE AS loose,
        (translate(resp, '0123456789', '') = 'so the result is #### ')::INT::DOUBLE AS no_numbers FROM gen""",
)
def exact_match_options(t: Tables):
    g, want = generated(t), F.concat(F.lit("so the result is #### "), F.col("gold_num"))
    r = F.col("resp")
    return g.select(
        "doc_id", "rep", N.exact_match(r, want).alias("plain"),
        N.exact_match(r, F.concat(F.lit(" RESULT is #### "), F.col("gold_num")), ["so the"], True, True).alias("loose"),
        N.exact_match(r, want, ignore_numbers=True).alias("no_numbers"),
    )


@query("exact_match_any", f"WITH {GENERATED_SQL} SELECT doc_id, rep, (resp ~ '.*#### [024]' )::INT::DOUBLE AS exact_match FROM gen")
def exact_match_any(t: Tables):
    refs = F.array(*[F.lit(f"So the result is #### {i}") for i in (0, 2, 4)])
    return generated(t).select("doc_id", "rep", N.any_match(F.col("resp"), refs, ignore_case=True).alias("exact_match"))


def sql_key(x: str, articles: str = "a|an|the") -> str:
    words = ", ".join(f"'{w}'" for w in articles.split("|"))
    return f"array_to_string(list_filter({sql_tokens(f'''translate(lower({x}), '{PUNCT}', '')''')}, lambda w: w NOT IN ({words})), ' ')"


@query(
    "answer_keys",
    "SELECT doc_id, sha256(CASE lang " + " ".join(f"WHEN '{k}' THEN {sql_key('text', v)}" for k, v in T.ARTICLES.items() if k != "vi") + f" ELSE {sql_key('text', '')} END) AS key_hash FROM documents",
)
def answer_keys(t: Tables):
    return t.documents.select("doc_id", F.sha2(T.answer_key(F.col("text"), F.col("lang")), 256).alias("key_hash"))


# Texts in several scripts: a third becomes Chinese (some letters stand for Han characters, blanks before them go), a third
# Arabic with articles and Arabic marks, the rest keep their letters under German or Spanish rules.
SCRIPTS = ("abcdefgh.,", "中文的字是一个人。、", "aeinorst.,", "ابتنورسل؟،")
SCRIPT_SQL = f"""CASE k WHEN 0 THEN translate(replace(x, ' a', 'a'), '{SCRIPTS[0]}', '{SCRIPTS[1]}')
   WHEN 1 THEN 'ال' || replace(translate(x, '{SCRIPTS[2]}', '{SCRIPTS[3]}'), ' ', ' ال') WHEN 2 THEN 'Der ' || replace(x, ' ', ' ein „') ELSE replace(x, ' ', ' ¿La ') END"""
LANG_SQL = "CASE k WHEN 0 THEN 'zh' WHEN 1 THEN 'ar' WHEN 2 THEN 'de' ELSE 'es' END"


def scripted(x, k):
    """The text of ``SCRIPT_SQL`` for text ``x`` and language number ``k``."""
    zh = F.translate(F.replace(x, F.lit(" a"), F.lit("a")), SCRIPTS[0], SCRIPTS[1])
    ar = F.concat(F.lit("ال"), F.replace(F.translate(x, SCRIPTS[2], SCRIPTS[3]), F.lit(" "), F.lit(" ال")))
    de = F.concat(F.lit("Der "), F.replace(x, F.lit(" "), F.lit(" ein „")))
    return F.when(k == 0, zh).when(k == 1, ar).when(k == 2, de).otherwise(F.replace(x, F.lit(" "), F.lit(" ¿La ")))


def language(k):
    return F.when(k == 0, "zh").when(k == 1, "ar").when(k == 2, "de").otherwise("es")


def sql_script_key(text: str) -> str:
    bare = rf"regexp_replace(lower({text}), '[\p{{P}}$+<=>^`|~]', '', 'g')"
    words = lambda v: ", ".join(f"'{w}'" for w in T.ARTICLES[v].split("|"))
    cut = rf"CASE k WHEN 0 THEN regexp_replace({bare}, '([\x{{4e00}}-\x{{9fa5}}])', ' \1 ', 'g') WHEN 1 THEN replace({bare}, 'ال', ' ') ELSE {bare} END"
    return f"array_to_string(list_filter({sql_tokens(cut)}, lambda w: NOT (k = 2 AND w IN ({words('de')}) OR k = 3 AND w IN ({words('es')}))), ' ')"


@query("answer_keys_by_script", f"WITH s AS (SELECT doc_id, doc_id % 4 AS k, text AS x FROM documents), y AS (SELECT doc_id, k, {SCRIPT_SQL} AS t FROM s) SELECT doc_id, {LANG_SQL} AS lang, sha256({sql_script_key('t')}) AS key_hash FROM y")
def answer_keys_by_script(t: Tables):
    """Answer forms of texts in Chinese, Arabic, German and Spanish."""
    k = F.col("doc_id") % 4
    return t.documents.select("doc_id", language(k).alias("lang"), F.sha2(T.script_answer_key(scripted(F.col("text"), k), language(k)), 256).alias("key_hash"))


def sql_overlap(src: str, keys: str, orders, gram=sql_ngrams) -> str:
    """CTEs ending in ``ov(keys, n, n_pred, n_ref, n_common)`` from ``src(keys, p, r)`` token lists."""
    parts = " UNION ALL ".join(f"SELECT {keys}, {n} AS n, {s} AS side, unnest({gram(c, n)}) AS g FROM {src}" for n in orders for s, c in enumerate("pr"))
    return f"""grams AS ({parts}), cnt AS (SELECT {keys}, n, g, count(*) FILTER (WHERE side = 0) AS p, count(*) FILTER (WHERE side = 1) AS r FROM grams GROUP BY ALL),
      ov AS (SELECT {keys}, n, sum(p) AS n_pred, sum(r) AS n_ref, sum(least(p, r)) AS n_common FROM cnt GROUP BY ALL)"""


BAG_SQL = f"""{PAIRS_SQL}, tok AS (SELECT conv_id, turn, {sql_tokens(sql_key('prediction'))} AS p, {sql_tokens(sql_key('reference'))} AS r FROM pairs),
 {sql_overlap('tok', 'conv_id, turn', [1])}"""


SCRIPT_F1_SQL = f"""{PAIRS_SQL}, s AS (SELECT conv_id, turn, turn // 2 % 4 AS k, prediction AS x, reference FROM pairs),
 y AS (SELECT conv_id, turn, k, {SCRIPT_SQL} AS t, reference FROM s), z AS (SELECT conv_id, turn, k, t, reference AS x FROM y), u AS (SELECT conv_id, turn, k, t, {SCRIPT_SQL} AS v FROM z),
 tok AS (SELECT conv_id, turn, {sql_tokens(sql_script_key('t'))} AS p, {sql_tokens(sql_script_key('v'))} AS r FROM u), {sql_overlap('tok', 'conv_id, turn', [1])}"""


@query("token_f1_by_script", f"WITH {SCRIPT_F1_SQL} SELECT conv_id, turn, round(coalesce(2.0 * n_common / (n_pred + n_ref), 0), 6)::DOUBLE AS f1 FROM tok LEFT JOIN ov USING (conv_id, turn)")
def token_f1_by_script(t: Tables):
    """Token F1 over words of four languages; a Han character is a word."""
    k = F.floor(F.col("turn") / 2) % 4
    words = lambda c: T.split_words(T.script_answer_key(scripted(F.col(c), k), language(k)))
    pairs = text_pairs(t).withColumns({"pt": words("prediction"), "rt": words("reference")})
    return rnd(O.bag_f1(pairs, PAIR, F.col("pt"), F.col("rt")), "f1")


def keyed_pairs(t: Tables):
    return text_pairs(t).withColumns({"pt": T.split_words(T.answer_key(F.col("prediction"))), "rt": T.split_words(T.answer_key(F.col("reference")))})


@query("token_f1", f"WITH {BAG_SQL} SELECT conv_id, turn, round(coalesce(2.0 * n_common / (n_pred + n_ref), 0), 6)::DOUBLE AS f1 FROM tok LEFT JOIN ov USING (conv_id, turn)")
def token_f1(t: Tables):
    return rnd(O.bag_f1(keyed_pairs(t), PAIR, F.col("pt"), F.col("rt")), "f1")


@query(
    "token_f1_no_answer",
    f"""WITH {EVAL_SQL}, tok AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [] ELSE choices END AS p, CASE WHEN doc_id % 2 = 0 THEN [] ELSE list_slice(choices, 1, 2) END AS r FROM eval_docs),
      {sql_overlap('tok', 'doc_id', [1])} SELECT doc_id, CASE WHEN len(p) = 0 OR len(r) = 0 THEN (len(p) = len(r))::INT ELSE round(coalesce(2.0 * n_common / (n_pred + n_ref), 0), 6) END::DOUBLE AS f1 FROM tok LEFT JOIN ov USING (doc_id)""",
)
def token_f1_no_answer(t: Tables):
    none = F.array().cast("array<string>")
    d = eval_docs(t).select("doc_id", F.when(F.col("doc_id") % 3 == 0, none).otherwise(F.col("choices")).alias("p"), F.when(F.col("doc_id") % 2 == 0, none).otherwise(F.slice("choices", 1, 2)).alias("r"))
    return rnd(O.bag_f1(d, ["doc_id"], F.col("p"), F.col("r"), agree_on_empty=True), "f1")


REFS_SQL = f"""{PAIRS_SQL}, refs AS (SELECT conv_id, turn, prediction, unnest(range(3)) AS k, unnest([reference, prediction || ' ' || reference, string_split(reference, chr(10))[1]]) AS reference FROM pairs),
 tok AS (SELECT conv_id, turn, k, {sql_tokens(sql_key('prediction'))} AS p, {sql_tokens(sql_key('reference'))} AS r FROM refs), {sql_overlap('tok', 'conv_id, turn, k', [1])},
 sc AS (SELECT conv_id, turn, k, coalesce(2.0 * n_common / (n_pred + n_ref), 0)::DOUBLE AS f1 FROM tok LEFT JOIN ov USING (conv_id, turn, k))"""


def reference_f1(t: Tables):
    refs = F.array(F.col("reference"), F.concat_ws(" ", "prediction", "reference"), F.substring_index("reference", "\n", 1))
    r = text_pairs(t).select(*PAIR, "prediction", F.posexplode(refs).alias("k", "reference"))
    r = r.withColumns({"pt": T.split_words(T.answer_key(F.col("prediction"))), "rt": T.split_words(T.answer_key(F.col("reference")))})
    return O.bag_f1(r, [*PAIR, "k"], F.col("pt"), F.col("rt"))


@query("best_reference_f1", f"WITH {REFS_SQL} SELECT conv_id, turn, round(max(f1), 6) AS f1 FROM sc GROUP BY ALL")
def best_reference_f1(t: Tables):
    return rnd(reference_f1(t).groupBy(*PAIR).agg(F.max("f1").alias("f1")), "f1")


@query(
    "leave_one_out_f1",
    f"""WITH {REFS_SQL} SELECT conv_id, turn, round(avg(m), 6) AS f1 FROM (SELECT a.conv_id, a.turn, a.k, max(b.f1) AS m FROM sc a JOIN sc b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.k <> b.k GROUP BY ALL) GROUP BY conv_id, turn""",
)
def leave_one_out_f1(t: Tables):
    s = reference_f1(t).groupBy(*PAIR).agg(F.collect_list("f1").alias("s"))
    return rnd(s.select(*PAIR, N.leave_one_out(F.col("s")).alias("f1")), "f1")


@query("answer_equality", f"WITH {PAIRS_SQL} SELECT conv_id, turn, ({sql_key('prediction')} = {sql_key('''CASE WHEN turn % 4 = 0 THEN 'The ' || prediction || ' !' ELSE reference END''')})::INT::DOUBLE AS em FROM pairs")
def answer_equality(t: Tables):
    ref = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("The "), F.col("prediction"), F.lit(" !"))).otherwise(F.col("reference"))
    return text_pairs(t).select(*PAIR, N.answer_equal(F.col("prediction"), ref).alias("em"))


@query("span_alignment_scores")
def span_alignment_scores(t: Tables):
    """Spans are the lines of both texts; the one-to-one alignment is checked by brute force in the tests."""
    p = text_pairs(t).select(*PAIR, F.split("prediction", "\n").alias("p"), F.split(F.concat_ws("\n", "reference", F.lit("12 of 3")), "\n").alias("g"))
    return p.withColumn("s", G.span_scores_col("p", "g")).select(*PAIR, "s.em", "s.f1")


@query(
    "containment",
    f"""WITH {EVAL_SQL} SELECT doc_id, len(list_filter(choices, lambda c: contains(lower(subject || ' ' || lang), lower(substring(c, 1, 2))))) > 0 AS any_label, contains({sql_key('text')}, {sql_key('array_to_string(choices, chr(32))')}) AS ref_inside FROM eval_docs""",
)
def containment(t: Tables):
    labels = F.transform("choices", lambda c: F.substring(c, 1, 2))
    d = eval_docs(t)
    return d.select(
        "doc_id", (N.contains_any(F.concat_ws(" ", "subject", "lang"), labels) > 0).alias("any_label"),
        (N.contains_ref(F.col("text"), F.array_join("choices", " ")) > 0).alias("ref_inside"),
    )


FOUND_SQL = f"""{EVAL_SQL}, found AS (SELECT doc_id, n, bucket, len(list_filter(refs, lambda r: contains(lower(text), lower(r)))) / len(refs) AS score FROM
  (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) < 1000 THEN 1000 WHEN length(text) < 4000 THEN 4000 ELSE 8000 END AS bucket, list_append(choices, 'zz' || lang) AS refs FROM eval_docs))"""


def found(t: Tables):
    n = F.length("text")
    d = eval_docs(t).select("doc_id", F.when(n < 1000, 1000).when(n < 4000, 4000).otherwise(8000).cast(L).alias("bucket"), N.found_share(F.col("text"), F.concat("choices", F.array(F.concat(F.lit("zz"), "lang")))).alias("score"))
    return d


@query("reference_share", f"WITH {FOUND_SQL} SELECT doc_id, bucket::BIGINT AS bucket, round(score, 6) AS score FROM found")
def reference_share(t: Tables):
    return rnd(found(t), "score")


@query("reference_share_by_length", f"WITH {FOUND_SQL} SELECT bucket::BIGINT AS bucket, count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score, round(max(score) / count(*), 6) AS part_score FROM found GROUP BY bucket")
def reference_share_by_length(t: Tables):
    g = found(t).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), (F.max("score") / F.count(F.lit(1))).alias("part_score"))
    return rnd(g, "mean_score", "part_score")


@query(
    "number_hits",
    "SELECT page_id, CASE WHEN len(n) = 0 THEN 0.0 ELSE round(len(list_filter(n, lambda x: x = '0')) / len(n), 6) END::DOUBLE AS score FROM (SELECT page_id, regexp_extract_all(html, '[0-9]+') AS n FROM pages)",
)
def number_hits(t: Tables):
    return rnd(t.pages.select("page_id", N.number_hits(F.col("html"), F.lit("0")).alias("score")), "score")


CLASSES = ["Ab", "Abc", "er", "th", "the"]


@query(
    "class_scores",
    """WITH x AS (SELECT doc_id, list_filter(['Ab','Abc','er','th','the'], lambda c: contains(text, c)) AS m FROM documents),
       s AS (SELECT doc_id, m, len(m) - (CASE WHEN list_contains(m, 'th') THEN 1 ELSE 0 END) AS n FROM x)
       SELECT doc_id, CASE WHEN list_contains(m, 'the') THEN round(1.0 / n, 6) ELSE 0 END::DOUBLE AS score FROM s""",
)
def class_scores(t: Tables):
    classes = F.array(*[F.lit(c) for c in CLASSES])
    return rnd(t.documents.select("doc_id", N.class_score(F.col("text"), F.lit("the"), classes).alias("score")), "score")


@query("code_similarity")
def code_similarity(t: Tables):
    """Insert/delete similarity of the first plain line with the reference; see the brute-force test."""
    return text_pairs(t).select(*PAIR, G.edit_ratio_col(N.first_code_line(F.col("prediction")), F.col("reference")).alias("score"))


@query(
    "emotion_scores",
    r"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity % 10, (l_quantity + 3) % 11, l_partkey % 10, 5] AS ref, [l_suppkey % 11, l_linenumber, (l_partkey + 2) % 10, 5] AS got, l_linenumber = 7 AS bad FROM lineitem),
       d AS (SELECT *, list_transform(range(1, 5), lambda i: abs(got[i] - ref[i])) AS ds FROM x)
       SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, CASE WHEN bad THEN 0 ELSE round((10 - list_sum(list_transform(ds, lambda d: CASE WHEN d = 0 THEN 0 WHEN d <= 5 THEN 6.5 / (1 + exp(-1.2 * (d - 4))) ELSE d END)) * 0.7477) * 10, 4) END::DOUBLE AS eqbench,
              CASE WHEN bad THEN 0 ELSE 100 END::DOUBLE AS percent_parseable FROM d""",
)
def emotion_scores(t: Tables):
    names = F.array(*[F.lit(x) for x in ("joy", "fear", "anger", "pride")])
    d = spread(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_orderkey")
    ref = F.array((F.col("l_quantity") % 10), (F.col("l_quantity") + 3) % 11, (F.col("l_partkey") % 10).cast("double"), F.lit(5.0))
    bad = F.when(F.col("l_linenumber") == 7, "hope").otherwise("pride")
    resp = F.concat(F.lit("joy: "), F.col("l_suppkey") % 11, F.lit("\nfear: "), F.col("l_linenumber"), F.lit("\nanger: "), (F.col("l_partkey") + 2) % 10, F.lit("\n"), bad, F.lit(": 5"))
    s = d.select("l_orderkey", F.col("l_linenumber").cast(L).alias("l_linenumber"), "l_partkey", F.inline(F.array(N.emotion_score(resp, names, ref))))
    return rnd(s, "eqbench", n=4)


@query(
    "relaxed_accuracy",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (abs(round(o_totalprice * 1.04, 2) - o_totalprice) / o_totalprice <= 0.05)::INT WHEN 1 THEN (abs(round(o_totalprice * 1.08, 2) - o_totalprice) / o_totalprice <= 0.05)::INT
        WHEN 2 THEN 1 ELSE (o_orderstatus = 'P')::INT END::DOUBLE AS score FROM orders""",
)
def relaxed_accuracy(t: Tables):
    m = F.col("o_orderkey") % 4
    num = lambda c: F.format_number(F.round(c, 2), 2)
    price = F.col("o_totalprice")
    pred = F.when(m == 0, F.concat(F.lit("$"), num(price * 1.04), F.lit("."))).when(m == 1, num(price * 1.08)).when(m == 2, F.lit("12%")).otherwise(F.lit("Priority"))
    target = F.when(m <= 1, F.format_string("%.2f", price)).when(m == 2, F.lit("0.12")).otherwise(F.lower("o_orderstatus"))
    return t.orders.select("o_orderkey", N.relaxed_match(pred, target).alias("score"))


@query(
    "final_answer_accuracy",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN (o_orderstatus = 'F')::INT ELSE 0 END::DOUBLE AS score FROM orders""",
)
def final_answer_accuracy(t: Tables):
    m = F.col("o_orderkey") % 3
    price = F.format_string("%.2f", F.col("o_totalprice"))
    said = F.when(m == 0, F.concat(F.lit("answer: 1\nso the **Final Answer:** $"), price, F.lit("."))).when(m == 1, F.lit("Final answer:** F")).otherwise(F.lit("no idea"))
    want = F.when(m == 0, price).otherwise(F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", N.relaxed_match(N.final_answer_part(said), want).alias("score"))


SUBST_SQL = f"""{EVAL_SQL}, x AS (SELECT doc_id, lang, list_slice(choices, 1, 2) AS words, [3, 2][1:len(list_slice(choices, 1, 2))] AS freqs FROM eval_docs),
 sub AS (SELECT doc_id, lang, CASE WHEN len(words) = 2 AND words[1] = words[2] THEN 3.0 ELSE freqs[1] END * CASE WHEN regexp_matches(words[1], ',') THEN 0 ELSE 1 END / list_sum(freqs) AS prec, words FROM x)"""


def substitutions(t: Tables):
    words = F.transform(F.slice("choices", 1, 2), lambda w: F.replace(w, F.lit(","), F.lit("")))
    freqs = F.slice(F.array(F.lit(3), F.lit(2)), F.lit(1), F.size(words))
    resp = F.concat(F.lit("qq, "), F.element_at(words, 1), F.lit(" ,zz1\nnot this"))
    return eval_docs(t).select("doc_id", "lang", F.inline(F.array(N.substitution_precision(resp, words, freqs))))


@query(
    "substitution_precision",
    f"""WITH {EVAL_SQL}, x AS (SELECT doc_id, list_transform(list_slice(choices, 1, 2), lambda w: replace(w, ',', '')) AS words FROM eval_docs)
        SELECT doc_id, CASE WHEN words[1] = '' THEN 0 WHEN len(words) = 2 THEN 0.6 ELSE 1 END::DOUBLE AS prec, 1::BIGINT AS has_answer, 1::BIGINT AS has_gold FROM x""",
)
def substitution_precision(t: Tables):
    return rnd(substitutions(t).drop("lang"), "prec")


def entities(t: Tables):
    g = F.transform("choices", lambda c, i: F.struct(F.regexp_replace(c, "[,$]", "").alias("text"), F.element_at(F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG"), F.lit("PER")), i + 1).alias("type")))
    resp = F.when(F.col("doc_id") % 5 == 0, F.lit(N.NO_ENTITY)).otherwise(F.array_join(F.transform("g", lambda e, i: F.concat(e["text"], F.when((F.col("doc_id") + i) % 3 == 0, F.lit("$org")).otherwise(F.concat(F.lit("$"), F.lower(e["type"]))))), ", "))
    return eval_docs(t).select("doc_id", "lang", g.alias("g")).withColumn("pairs", N.entity_alignment(N.entity_pairs(resp), F.col("g"))).select("doc_id", "lang", F.inline("pairs"))


ENTITY_SQL = f"""{EVAL_SQL}, e AS (SELECT doc_id, unnest(range(len(choices))) AS i, unnest(list_transform(choices, lambda c: regexp_replace(c, '[,$]', '', 'g'))) AS tx FROM eval_docs),
      g AS (SELECT doc_id, i, tx, [0, 1, 2, 0][i + 1] AS gold, CASE WHEN (doc_id + i) % 3 = 0 THEN 2 ELSE [0, 1, 2, 0][i + 1] END AS said FROM e),
      aligned AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 AND EXISTS (SELECT 1 FROM g b WHERE b.doc_id = g.doc_id AND b.tx = g.tx AND b.said = g.gold AND b.tx <> '') THEN gold ELSE 3 END::INT AS pred, gold::INT AS gold FROM g)"""


@query("entity_alignment", f"WITH {ENTITY_SQL} SELECT doc_id, pred, gold FROM aligned")
def entity_alignment(t: Tables):
    return entities(t).select("doc_id", "pred", "gold")


def sql_rouge_tokens(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


ROUGE_SQL = f"""{PAIRS_SQL}, tok AS (SELECT conv_id, turn, {sql_rouge_tokens('prediction')} AS p, {sql_rouge_tokens('reference')} AS r FROM pairs), {sql_overlap('tok', 'conv_id, turn', [1, 2])},
 rouge AS (SELECT conv_id, turn, coalesce(max(2.0 * n_common / (n_pred + n_ref)) FILTER (WHERE n = 1), 0)::DOUBLE AS rouge1, coalesce(max(2.0 * n_common / (n_pred + n_ref)) FILTER (WHERE n = 2), 0)::DOUBLE AS rouge2 FROM tok LEFT JOIN ov USING (conv_id, turn) GROUP BY ALL)"""


@query("rouge_n", f"WITH {ROUGE_SQL} SELECT conv_id, turn, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge")
def rouge_n(t: Tables):
    return rnd(O.rouge_n(text_pairs(t), PAIR, "prediction", "reference"), "rouge1", "rouge2")


@query("rouge_lsum")
def rouge_lsum(t: Tables):
    """Summary-level ROUGE-L (dynamic programming in Arrow batches); see the brute-force test."""
    return text_pairs(t).select(*PAIR, G.rouge_lsum_col("prediction", "reference").alias("rougeLsum"))


@query(
    "best_true_and_false",
    f"""WITH {PAIRS_SQL}, refs AS (SELECT conv_id, turn, prediction, unnest(range(4)) AS k, unnest([string_split(reference, '. ')[1], prediction, string_split(prediction, '. ')[1], reference]) AS reference FROM pairs),
      tok AS (SELECT conv_id, turn, k, {sql_rouge_tokens('prediction')} AS p, {sql_rouge_tokens('reference')} AS r FROM refs), {sql_overlap('tok', 'conv_id, turn, k', [1, 2])},
      sc AS (SELECT t.conv_id, t.turn, t.k, n, coalesce(max(2.0 * n_common / (n_pred + n_ref)), 0)::DOUBLE AS f FROM tok t CROSS JOIN (VALUES (1), (2)) v(n) LEFT JOIN ov USING (conv_id, turn, k, n) GROUP BY ALL),
      b AS (SELECT conv_id, turn, n, max(f) FILTER (WHERE (turn + k) % 2 = 0) AS t, max(f) FILTER (WHERE (turn + k) % 2 = 1) AS f FROM sc GROUP BY ALL)
      SELECT conv_id, turn, n::INT AS n, round(t, 6) AS f_max, round(t - f, 6) AS f_diff, (t > f)::INT::DOUBLE AS f_acc FROM b""",
)
def best_true_and_false(t: Tables):
    refs = F.array(F.substring_index("reference", ". ", 1), F.col("prediction"), F.substring_index("prediction", ". ", 1), F.col("reference"))
    r = text_pairs(t).select(*PAIR, "prediction", F.posexplode(refs).alias("k", "reference"))
    s = O.rouge_n(r, [*PAIR, "k"], "prediction", "reference").withColumn("is_true", (F.col("turn") + F.col("k")) % 2 == 0)
    long = s.select(*PAIR, "is_true", F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"rouge{n}").alias("f")) for n in (1, 2)])))
    return rnd(C.best_true_and_false(long, [*PAIR, "n"], "f"), "f_max", "f_diff")


def sql_13a(x: str, lower: bool = False) -> str:
    x = f"replace(replace(replace({x}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for old, new in O.ENTITIES:
        x = f"replace({x}, '{old}', '{new}')"
    x = f"' ' || {'lower(' + x + ')' if lower else x} || ' '"
    for old, new in O.TOKENS_13A:
        x = f"regexp_replace({x}, '{old}', '{new.replace('$', chr(92))}', 'g')"
    return sql_tokens(x)


def bleu_sql(lower: bool = False) -> str:
    cols = ", ".join(f"coalesce(max(n_common) FILTER (WHERE n = {n}), 0) AS c{n}, coalesce(max(n_pred) FILTER (WHERE n = {n}), 0) AS t{n}" for n in range(1, 5))
    return f"""{PAIRS_SQL}, tok AS (SELECT conv_id, turn, {sql_13a('prediction', lower)} AS p, {sql_13a('reference', lower)} AS r FROM pairs),
      {sql_overlap('tok', 'conv_id, turn', [1, 2, 3, 4])}, bc AS (SELECT conv_id, turn, {cols}, any_value(len(p)) AS sys_len, any_value(len(r)) AS ref_len FROM tok LEFT JOIN ov USING (conv_id, turn) GROUP BY conv_id, turn)"""


def pair_bleu_counts(t: Tables, lower: bool = False):
    return O.bleu_counts(text_pairs(t), PAIR, O.tokens_13a(F.col("prediction"), lower), O.tokens_13a(F.col("reference"), lower))


LOGS = " + ".join(f"ln(c{n} + {int(n > 1)} + 2.2250738585072014e-308::DOUBLE) - ln(t{n} + {int(n > 1)} + 2.2250738585072014e-308::DOUBLE)" for n in range(1, 5))


@query("sentence_bleu", f"WITH {bleu_sql(True)} SELECT conv_id, turn, round(exp(({LOGS}) / 4 + least(0, 1 - (ref_len + 1.0) / (sys_len + 1.0))), 6)::DOUBLE AS bleu FROM bc")
def sentence_bleu(t: Tables):
    c = pair_bleu_counts(t, lower=True)
    return rnd(c.select(*PAIR, O.smoothed_sentence_bleu({x: F.col(x) for x in c.columns}).alias("bleu")), "bleu")


@query("clean_lengths", f"SELECT doc_id, len({sql_tokens(f'''translate(text, '{PUNCT}', '')''')})::DOUBLE AS n_words FROM documents")
def clean_lengths(t: Tables):
    return t.documents.select("doc_id", N.clean_length(F.col("text")).alias("n_words"))


ABSTAIN_SQL = f"""{ARG_SQL}, na AS (SELECT (doc_id * 37 % 101) / 101.0 AS p, doc_id % 3 <> 0 AS has, doc_id % 4 <> 0 AS said, acc, doc_id FROM scored),
 raw AS (SELECT p, has, said, CASE WHEN has THEN CASE WHEN said THEN acc ELSE 0 END ELSE (NOT said)::INT END AS e,
   CASE WHEN has THEN CASE WHEN said THEN greatest(acc, (doc_id % 7) / 7.0) ELSE 0 END ELSE (NOT said)::INT END AS f FROM na),
 fin AS (SELECT has, CASE WHEN p > 0.9 THEN (NOT has)::INT ELSE e END AS e, CASE WHEN p > 0.9 THEN (NOT has)::INT ELSE f END AS f FROM raw),
 steps AS (SELECT p, sum(CASE WHEN has THEN e WHEN said THEN -1 ELSE 0 END) AS e, sum(CASE WHEN has THEN f WHEN said THEN -1 ELSE 0 END) AS f FROM raw GROUP BY p),
 run AS (SELECT sum(e) OVER w AS e, sum(f) OVER w AS f FROM steps WINDOW w AS (ORDER BY p ROWS UNBOUNDED PRECEDING)),
 top AS (SELECT greatest(max(e), 0) AS e, greatest(max(f), 0) AS f FROM run)"""


@query(
    "abstention_scores",
    f"""WITH {ABSTAIN_SQL} SELECT count(*)::BIGINT AS n, round(100 * avg(e), 6)::DOUBLE AS exact, round(100 * avg(f), 6)::DOUBLE AS f1,
        round(100 * avg(e) FILTER (WHERE has), 6)::DOUBLE AS has_ans_exact, round(100 * avg(f) FILTER (WHERE has), 6)::DOUBLE AS has_ans_f1,
        round(100 * avg(e) FILTER (WHERE NOT has), 6)::DOUBLE AS no_ans_exact, round(100 * avg(f) FILTER (WHERE NOT has), 6)::DOUBLE AS no_ans_f1,
        round(100.0 * (count(*) FILTER (WHERE NOT has) + (SELECT e FROM top)) / count(*), 6)::DOUBLE AS best_exact,
        round(100.0 * (count(*) FILTER (WHERE NOT has) + (SELECT f FROM top)) / count(*), 6)::DOUBLE AS best_f1 FROM fin""",
)
def abstention_scores(t: Tables):
    """Scores with unanswerable questions, and the best over all no-answer thresholds; probabilities have ties."""
    d = F.col("doc_id")
    s = C.choice_scores(choice_rows(t), ["doc_id"]).select(d, "acc", ((d * 37 % 101) / F.lit(101.0)).alias("na_prob"), (d % 3 != 0).alias("has_answer"), (d % 4 != 0).alias("answered"))
    score = lambda own: F.when(F.col("has_answer"), F.when(F.col("answered"), own).otherwise(0.0)).otherwise((~F.col("answered")).cast("double"))
    rows = s.withColumn("exact", score(F.col("acc"))).withColumn("f1", score(F.greatest("acc", d % 7 / F.lit(7.0))))
    out = C.abstention_summary(rows, threshold=0.9)
    return rnd(out, *[c for c in out.columns if c != "n"])


PARTS_SQL = f"""{EVAL_SQL}, parts AS (SELECT doc_id, lang, i, CASE WHEN (doc_id + i) % 4 = 0 THEN 1 WHEN (doc_id + i) % 3 = 0 THEN 0 ELSE 1 END::DOUBLE AS score FROM (SELECT *, unnest(range(len(choices))) AS i FROM eval_docs))"""


def part_rows(t: Tables):
    d = eval_docs(t).withColumn("c", F.transform("choices", lambda c: F.concat(F.regexp_replace(c, "['\"]", ""), F.lit("x"))))
    names = F.transform("c", lambda c, i: F.concat(F.lit("p"), i.cast("string")))
    golds = F.transform("c", lambda c, i: F.when((F.col("doc_id") + i) % 4 == 0, "").otherwise(c))
    said = F.transform("c", lambda c, i: F.concat(F.lit("'p"), i.cast("string"), F.lit("': '"), F.when((F.col("doc_id") + i) % 3 == 0, F.lit("wrong!")).otherwise(c), F.lit("'")))
    resp = F.concat(F.lit("{"), F.array_join(said, ", "), F.lit("}"))
    return d.select("doc_id", "lang", F.posexplode(N.part_scores(resp, names, golds)).alias("i", "score"))


@query("part_scores", f"WITH {PARTS_SQL} SELECT doc_id, i::BIGINT AS i, score FROM parts")
def part_scores(t: Tables):
    return part_rows(t).select("doc_id", F.col("i").cast(L).alias("i"), "score")


@query("json_validity", "SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN substring(props, 2) ELSE props END)::INT::DOUBLE AS valid FROM events")
def json_validity(t: Tables):
    broken = F.when(F.col("event_id") % 3 == 0, F.substring(F.col("props"), F.lit(2), F.length("props"))).otherwise(F.col("props"))
    return t.events.select("event_id", N.valid_json(broken).alias("valid"))
