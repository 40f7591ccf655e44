"""Hand cases and brute-force checks of operators that SQL does not cover."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions import alignment as G
from evalspark.functions import extraction as X
from evalspark.functions import rows as Q
from evalspark.functions import text as N
from evalspark.operators import aggregates as A
from evalspark.operators import bootstrap as B
from evalspark.operators import filters as S
from evalspark.operators import groups as H
from evalspark.operators import ordering as O
from evalspark.operators import overlap as V
from evalspark.operators import prompts as R
from evalspark.operators import responses as J
from evalspark.operators import scorers as K
from evalspark.operators import scoring as C
from evalspark.operators import synth as Y
from evalspark.registry import FILTERS, register_sql
from evalspark.sources import corpus as W
from evalspark.sources import results as L
from evalspark.streaming import responses as Z


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


# --- extraction -------------------------------------------------------------------------------------

FINAL = "Τελική απάντηση: "


@pytest.mark.parametrize(
    "text,n,need,want",
    [
        (FINAL + r"\boxed{B}", 4, False, ("B", "boxed")),
        (r"so $\boxed{b}$.", 4, False, ("[invalid]", "invalid")),
        (r"$\boxed{b}$.", 4, False, ("B", "boxed")),
        (FINAL + r"\[\boxed{\mathrm{δ}}\]", 4, False, ("D", "boxed")),
        (FINAL + r"\boxed{\alpha}", 4, False, ("A", "boxed")),
        ("**Τελική απάντηση:** C.", 4, False, ("C", "marked-letter")),
        ("C", 4, False, ("[invalid]", "invalid")),
        (r"\boxed{A}", 4, True, ("[invalid]", "invalid")),
        ("why</think>\n" + r"\boxed{A}", 4, True, ("A", "boxed")),
        ("<think>open\n" + r"\boxed{A}", 4, False, ("[invalid]", "invalid")),
        ("<think>a<think>b</think></think>\n" + r"\boxed{A}</s> <|eot_id|>", 4, False, ("A", "boxed")),
        (FINAL + r"\boxed{H}", 10, False, ("H", "boxed")),
        (FINAL + r"\boxed{H}", 4, False, ("[invalid]", "invalid")),
        (FINAL + r"\boxed{A, B}", 4, False, ("[invalid]", "invalid")),
        (FINAL + "\\boxed{A}\n\nQuestion: next\n\\boxed{C}", 4, False, ("A", "boxed")),
        ("Ερώτηση: inside\n</think>\n\\boxed{D}", 4, True, ("D", "boxed")),
        (None, 4, False, ("[invalid]", "invalid")),
    ],
)
def test_final_letter(spark, text, n, need, want):
    r = one(spark, x=X.final_letter(F.lit(text).cast("string"), F.lit(n), need)).x
    assert (r.label, r.format) == want


@pytest.mark.parametrize(
    "text,want",
    [(r"a \boxed{1} b \boxed{\frac{1}{2}} c", r"\frac{1}{2}"), (r"\boxed 7$ x", "7"), (r"\boxed{open", None), ("none", None)],
)
def test_last_boxed(spark, text, want):
    assert one(spark, x=X.last_boxed(F.lit(text))).x == want


@pytest.mark.parametrize(
    "a,b",
    [(r"\dfrac12", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), (r"x=3\text{ cm}", "3"), (r"\sqrt2", r"\sqrt{2}"), ("-3/4", r"\frac{-3}{4}"), (r"90^\circ", "90"), (".25", "0.25")],
)
def test_math_form(spark, a, b):
    assert one(spark, x=X.math_equal(F.lit(a), F.lit(b))).x


def test_choice_answer(spark):
    ch = F.array(F.lit("red car"), F.lit("car"), F.lit("a+b"))
    ask = lambda s, **k: one(spark, x=X.choice_answer(F.lit(s), ch, **k)).x
    assert ask("the red car") == "(A)"
    assert ask("this is a+b") == "(C)"
    assert ask("answer: B") == "(B)"
    assert ask("nope") == "[invalid]"
    assert ask("RED, CAR", ignore_case=True, ignore_punctuation=True) == "(A)"
    assert ask("car then red car", group_select=-1) == "(A)"


def test_take_first_k_needs_enough(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, rep long, resp string")
    with pytest.raises(Exception, match="need 2 responses"):
        S.take_first_k(["doc_id"], 2)(df).collect()
    assert S.take_first_k(["doc_id"], 1)(df).count() == 2


def test_registry():
    assert {"regex", "regex_pos", "remove_whitespace", "multi_choice_regex", "take_first", "take_first_k", "majority_vote", "lowercase", "uppercase", "map", "format_span", "custom"} <= set(FILTERS)
    with pytest.raises(KeyError, match="unknown filter"):
        FILTERS["nope"]


# --- alignment --------------------------------------------------------------------------------------

def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_and_positions():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = (rnd.choices("abc", k=rnd.randint(0, 9)) for _ in range(2))
        assert G.lcs_length(a, b) == lcs(a, b)
        if a and b:
            assert len(G.lcs_positions(a, b)) == lcs(a, b)


def test_edit_ratio():
    assert G.edit_ratio("abcd", "abcd") == 1.0
    assert G.edit_ratio("abcd", "bcda") == 0.75
    assert G.edit_ratio("", "") == 0.0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_translation_edits():
    assert G.translation_edits("a b c d", "a b c d") == 0
    assert G.translation_edits("c d a b", "a b c d") == 1  # one block move
    assert G.translation_edits("a x c d", "a b c d") == 1
    assert G.translation_edits("", "a b") == 2
    rnd = random.Random(5)
    for _ in range(50):
        a, b = (rnd.choices("abcdef", k=rnd.randint(1, 7)) for _ in range(2))
        assert G.translation_edits(" ".join(a), " ".join(b)) <= levenshtein(a, b)


def test_translation_edits_go_on_from_a_prefix():
    """Distances row by row are those of the plain table, from the start and from any prefix, beyond 64 words as well."""
    rnd = random.Random(6)
    for k in (3, 9, 70, 150):
        a, b = (rnd.choices(range(12), k=rnd.randint(1, k)) for _ in range(2))
        masks = {w: sum(1 << j for j, x in enumerate(b) if x == w) for w in a}
        rows = G._edit_rows(masks, len(b), a, ((1 << len(b)) - 1, 0, len(b)))
        assert [d for _, _, d in rows] == [levenshtein(a[:i], b) for i in range(len(a) + 1)]
        at = rnd.randint(0, len(a))
        assert G._edit_rows(masks, len(b), a[at:], rows[at]) == rows[at:]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 3), (4, 2), (4, 4), (3, 5)]:
        for _ in range(20):
            s = rng.random((n, m)).round(2)
            got = sum(s[i, j] for i, j in G.assignment(s))
            if n <= m:
                best = max(sum(s[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
            else:
                best = max(sum(s[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
            assert got == pytest.approx(best)


def test_span_scores():
    assert G.span_scores(["The 5.0 cats"], ["5 cats"]) == (1.0, 1.0)
    assert G.span_scores(["4 cats"], ["5 cats"]) == (0.0, 0.0)  # the gold number is missing
    assert G.span_scores(["red fox", "dog"], ["dog", "red hen"]) == (0.0, 0.75)


def test_rouge_lsum():
    assert G.rouge_lsum("the cat sat\non a mat", "the cat sat\non a mat") == 1.0
    assert G.rouge_lsum("", "x") == 0.0
    assert G.rouge_lsum("w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", "w1 w2 w3 w4 w5") == pytest.approx(2 * 4 / 15)


def test_gram_counts():
    assert G.gram_counts("ab ab", "abb", 3) == [(1, 4, 3, 3), (2, 3, 2, 1), (3, 2, 1, 0)]


# --- scoring and aggregates -------------------------------------------------------------------------

def test_mutual_information(spark):
    rows = [(1, 1, i, c, u, "x", False) for i, (c, u) in enumerate([(-1.0, -0.5), (-2.0, -2.0), (-3.0, -3.0)])]
    df = spark.createDataFrame(rows, "doc_id long, gold long, idx long, loglik double, uncond double, choice string, is_greedy boolean")
    r = C.choice_scores(df, ["doc_id"]).first()
    assert (r.acc, r.acc_mutual_info) == (0.0, 1.0)


def test_gold_out_of_range(spark):
    df = spark.createDataFrame([(1, 5, 0, -1.0, 0.0, "x", True)], "doc_id long, gold long, idx long, loglik double, uncond double, choice string, is_greedy boolean")
    r = C.choice_scores(df, ["doc_id"]).first()
    assert (r.acc, r.exact_match, r.gold_defect) == (0.0, 0.0, True)


def test_group_mean_weighted_and_not(spark):
    res = spark.createDataFrame([("a", "m", 0.3, 0.1, 20), ("b", "m", 0.2, 0.1, 40), ("c", "m", 0.4, 0.1, 100)], "task string, metric string, value double, stderr double, n long")
    pairs = spark.createDataFrame([("g", x) for x in "abc"], "group string, task string")
    r = H.group_scores(res, pairs, ["metric"]).first()
    assert r.unweighted == pytest.approx(0.3) and r.value == pytest.approx(0.3375)
    missing = res.withColumn("stderr", F.when(F.col("task") != "b", F.col("stderr")))
    assert H.group_scores(missing, pairs, ["metric"]).first().stderr is None


def test_pooled_stderr_close_to_concatenated(spark):
    groups = {"a": [1.0] * 40 + [0.0] * 60, "b": [1.0] * 30 + [0.0] * 30, "c": [1.0] * 20 + [0.0] * 60}
    rows = [(t, i, v) for t, vs in groups.items() for i, v in enumerate(vs)]
    s = spark.createDataFrame(rows, "task string, doc_id long, value double").withColumn("metric", F.lit("m"))
    res = A.summarize(s, ["task", "metric"])
    pairs = spark.createDataFrame([("g", x) for x in "abc"], "group string, task string")
    pooled = H.group_scores(res, pairs, ["metric"]).first().stderr
    whole = [v for vs in groups.values() for v in vs]
    assert pooled == pytest.approx(np.std(whole, ddof=1) / np.sqrt(len(whole)), abs=1e-3)


def test_bootstrap_near_closed_form(spark):
    s = spark.range(1000).select("id", (F.pmod(F.col("id") * 7919, F.lit(1000)) / 1000.0).alias("v"))
    b = B.bootstrap_stderr(s, [], "id", {"x": F.col("v")}, lambda c: c["x"] / c["w"], iters=400, seed=1).first()[0]
    closed = s.agg(A.mean_stderr(F.col("v"))).first()[0]
    assert b == pytest.approx(closed, rel=0.15)


def test_poisson_table_inverts_the_distribution(spark):
    for c, rows in {c: B.poisson_table(spark.createDataFrame([(c,)], "_c long")).orderBy("_at").collect() for c in (1, 50, 3000)}.items():
        assert len(rows) == 1024
        p = np.exp(-c + np.cumsum([0.0, *np.log(c / np.arange(1, 8 * c + 40))]))
        cdf = dict(enumerate(np.cumsum(p)))
        for r in rows:
            for i, b in enumerate(r._bounds):  # from this draw on the weight is above low + i
                k = r._low + i
                assert b == B.PRIME or abs(b / B.PRIME - cdf.get(k, 1.0)) < 1e-8


def test_bootstrap_weights_of_large_classes(spark, monkeypatch):
    monkeypatch.setattr(B, "PART", 64)
    classes = spark.createDataFrame([(1, 1000, None), (2, 63, "a"), (3, 1, "b")], "k long, n long, tag string")
    each = B.replicates(classes, "k", "n", 3000, 5).groupBy("k", "replicate").agg(F.sum("w").alias("w"))
    w = each.groupBy("k").agg(F.sum("w").alias("s"), F.sum(F.col("w") ** 2).alias("q"), F.count("*").alias("r"))
    for r in w.collect():
        n = {1: 1000, 2: 63, 3: 1}[r.k]
        mean = r.s / 3000
        assert mean == pytest.approx(n, abs=5 * (n / 3000) ** 0.5) and r.q / 3000 - mean**2 == pytest.approx(n, rel=0.15)
        assert r.r == 3000 or n == 1


def test_single_row_group_has_no_stderr(spark):
    s = spark.createDataFrame([("a", 1.0)], "task string, value double")
    r = A.summarize(s, ["task"]).first()
    assert r.stderr is None and r.n == 1


def test_nanmean(spark):
    s = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", float("nan"))], "t string, v double")
    got = {r.t: r.m for r in s.groupBy("t").agg(A.nanmean(F.col("v")).alias("m")).collect()}
    assert got["a"] == 2.0 and np.isnan(got["b"])


def test_treatment_coefficients(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=300), rng.integers(0, 3, size=300)
    y = 1.5 + 2.0 * (x - x.mean()) / x.std(ddof=1) + np.array([0.0, -1.0, 0.5])[g] + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(float(a), "abc"[int(k)], float(v)) for a, k, v in zip(x, g, y)], "x double, g string, y double")
    got = {r.term: r.coefficient for r in A.treatment_coefficients(df, "y", ["x"], {"g": "a"}).collect()}
    design = np.column_stack([np.ones(300), (x - x.mean()) / x.std(ddof=1), g == 1, g == 2])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [got[k] for k in ("intercept", "x", "g=b", "g=c")] == pytest.approx(list(want), abs=1e-6)


# --- ordering and few-shot --------------------------------------------------------------------------

def test_positions_with_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, k long")
    got = {(r.g, r.k): r.pos for r in O.with_position(df, ["k"], ["g"]).collect()}
    want, seen = {}, {}
    for g, k in sorted(rows):
        want[(g, k)] = seen.get(g, 0)
        seen[g] = want[(g, k)] + 1
    assert got == want


def test_running_sum(spark):
    df = spark.range(100).select("id", (F.col("id") % 5).alias("v"))
    got = {r.id: r.running for r in O.running_sum(df, ["id"], "v").collect()}
    assert got == {i: sum(j % 5 for j in range(i + 1)) for i in range(100)}


def test_sample_size():
    assert [O.sample_size(10, x) for x in (None, 3, 0.25, 0.5)] == [None, 3, 3, 5]


@pytest.mark.parametrize("seed", range(4))
def test_excluding_shots_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    passages, links = ["p0"] * 6 + [f"p{i}" for i in range(1, 5)], ["l0"] * 5 + [f"l{i}" for i in range(1, 4)]
    pool = [(i, rnd.choice(passages), rnd.choice(links)) for i in range(120)]
    df = spark.createDataFrame(pool, "id long, p string, l string")
    got = {r.id: list(r.shot_ids) for r in R.first_shots_excluding(df, df, "id", "p", "l", 3).collect()}
    for i, p, l in pool:
        want = [j for j, q, m in pool if j != i and q != p and m != l][:3]
        assert got[i] == want


def test_drawn_shots_are_distinct_and_foreign(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("t"))
    for r in R.draw_shots(df, df, "doc_id", ["g"], 5, 3, ["t"]).collect():
        ids = [s.id for s in r.shots]
        assert len(set(ids)) == 5 and r.doc_id not in ids and all(i % 2 == r.doc_id % 2 for i in ids)


# --- requests and responses -------------------------------------------------------------------------

def windows(tokens, prefix, max_len, ctx):
    out, step, done = [], max_len - ctx + 1, 0
    while done < len(tokens):
        end = min(len(tokens), max_len if done == 0 else done + step)
        shifted = ([prefix] + tokens)[max(0, end - max_len) if done else 0 : end]
        out.append((shifted, tokens[done:end]))
        done = end
    return out


@pytest.mark.parametrize("n,max_len,ctx", [(0, 4, 1), (3, 4, 1), (10, 4, 1), (10, 4, 3), (10, 5, 5), (9, 10, 10), (23, 7, 2)])
def test_rolling_windows(spark, n, max_len, ctx):
    t = F.when(F.lit(n) > 0, F.sequence(F.lit(1), F.lit(max(n, 1)))).otherwise(F.array().cast("array<int>"))
    w = one(spark, w=J.rolling_windows(t, F.lit(0), max_len, ctx)).w or []
    assert [(list(x.input), list(x.pred)) for x in w] == windows(list(range(1, n + 1)), 0, max_len, ctx)


def test_truncate(spark):
    t = F.sequence(F.lit(1), F.lit(9))
    assert list(one(spark, x=J.truncate(t, 4)).x) == [6, 7, 8, 9]
    assert list(one(spark, x=J.truncate(t, 4, "right")).x) == [1, 2, 3, 4]
    assert list(one(spark, x=J.truncate(t, 5, "middle")).x) == [1, 2, 7, 8, 9]


def test_request_store(spark, tmp_path):
    store = J.RequestStore(spark, str(tmp_path))
    key = store.key("task", 3, 0, 1)
    built = []
    build = lambda: built.append(1) or spark.range(len(built))
    assert store.load_or_build(key, build).count() == 1
    assert store.load_or_build(key, build).count() == 1 and len(built) == 1
    assert store.load_or_build(key, build, refresh=True).count() == 2
    store.delete(key)
    assert not store.exists(key)


def test_request_store_commits_with_its_manifest(spark, tmp_path, monkeypatch):
    """A build that dies before its manifest row is never read; a reader keeps its files through a refresh; empty sets hit."""
    schema = T.StructType([T.StructField("v", T.LongType())])
    store = J.RequestStore(spark, str(tmp_path), schema)
    keys = spark.createDataFrame([("a",), ("12e5",), ("x/y=%",), ("none",)], "cache_key string")
    build = lambda v: lambda k: k.where("cache_key <> 'none'").withColumn("v", F.lit(v).cast("long"))
    rows = lambda df: sorted((r.cache_key, r.v) for r in df.collect())
    assert rows(store.read()) == [] and store.vacuum() == 0
    first = store.ensure(keys, build(1))
    assert rows(first) == [("12e5", 1), ("a", 1), ("x/y=%", 1)]
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda entries: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            store.ensure(keys, build(2), refresh=True)
    assert rows(store.read()) == [("12e5", 1), ("a", 1), ("x/y=%", 1)]
    assert rows(store.ensure(keys.where("cache_key = 'a'"), build(3), refresh=True)) == [("a", 3)]
    assert rows(first) == [("12e5", 1), ("a", 1), ("x/y=%", 1)]
    store.drop(keys.where("cache_key = '12e5'"))
    assert rows(store.read()) == [("a", 3), ("x/y=%", 1)]
    assert store.vacuum() == 5  # three of the lost build, the first of a, the deleted one
    assert rows(store.read()) == [("a", 3), ("x/y=%", 1)] and store.exists("none") and not store.exists("12e5")
    never = lambda k: pytest.fail("all are stored")
    assert rows(store.ensure(keys.where("cache_key <> '12e5'"), never)) == [("a", 3), ("x/y=%", 1)]
    got = spark.range(1).select(J.request_key("t", 3).alias("a"), J.request_key(F.lit("t"), 3, 0, 1, "p", "q").alias("b")).first()
    assert (got.a, got.b) == (store.key("t", 3, 0, 1), store.key("t", 3, 0, 1, "p", "q"))


def test_scorer_and_custom_aggregate(spark):
    df = spark.createDataFrame([("a", "xy"), ("b", "xyz")], "g string, continuation string")
    got = {r.g: (r.loglik, r.is_greedy) for r in K.score_requests(df, K.length_likelihood, K.LIKELIHOOD).collect()}
    assert got == {"a": (-0.2, True), "b": (-0.3, False)}
    count = lambda d, by: K.custom_aggregate(d, by, lambda s, r: [s[0] + len(r)], lambda a, b: [a[0] + b[0]], lambda s: s[0], [0.0])
    assert {r.g: r.value for r in count(df, ["g"]).collect()} == {"a": 1.0, "b": 1.0}
    assert count(df.where("false"), ["g"]).count() == 0


def test_custom_aggregate_is_the_same_for_any_partitioning(spark):
    """A hot group lies in all tasks; null and NaN keys are groups; long keys beside nulls stay exact; many small groups."""
    big = 2**60 + 1
    keys = [(big, 1.5)] * 700 + [(None, 1.5)] * 300 + [(big - 1, float("nan"))] * 300 + [(big - 1, None)] * 30 + [(i, 0.5) for i in range(6000)]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(keys)], "a long, b double, v long")
    update = lambda s, r: [s[0] + len(r), s[1] + float(r["v"].sum()), max(s[2], float(r["v"].max()))]
    merge = lambda a, b: [a[0] + b[0], a[1] + b[1], max(a[2], b[2])]
    finish = lambda s: s[0] * 1e9 + s[1] + s[2]
    runs = []
    for n in (1, 7, 300):
        got = K.custom_aggregate(df.repartition(n), ["a", "b"], update, merge, finish, [0.0, 0.0, -1.0]).collect()
        runs.append({(r.a, str(r.b)): r.value for r in got})
        assert len(got) == len(runs[-1]) == 6004
    assert runs[0] == runs[1] == runs[2]
    assert runs[0][(big, "1.5")] == 700 * 1e9 + sum(range(700)) + 699 and runs[0][(None, "1.5")] == 300 * 1e9 + sum(range(700, 1000)) + 999


def test_exclusion_head_is_bounded_and_whole(spark):
    """Hot passages and links, nulls and repeated ids: the same rows as a look at the whole pool, from 5k of them."""
    rows = [(i, "hot" if i % 3 else f"p{i % 11}", f"l{i % 7}" if i % 5 else "hot") for i in range(400)] + [(5, None, "x"), (7, "q", None), (9, "q", "y"), (9, "q", "y")]
    df = spark.createDataFrame(rows, "id long, p string, l string")
    k = 3
    head = R.exclusion_head(df, "id", "p", "l", k + 1, [])
    assert head.count() <= 5 * (k + 1)
    got = sorted((r.id, *r.shot_ids) for r in R.first_shots_excluding(df, df, "id", "p", "l", k).collect())
    pool = sorted(r for r in rows if None not in r)
    shots = lambda i, p, l: [] if None in (p, l) else [j for j, q, m in pool if j != i and q != p and m != l][:k]
    assert got == sorted((r[0], *shots(*r)) for r in rows)


def test_majority_vote_ties_go_to_the_first_seen(spark):
    rows = [(1, i, x) for i, x in enumerate("baab")] + [(2, 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, rep long, resp string")
    got = {r.doc_id: r.resp for r in S.majority_vote(["doc_id"])(df).collect()}
    assert got == {1: "b", 2: "z"}


# --- sources, streams, synthetic --------------------------------------------------------------------

def test_pinned_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    digest = W.table_digest(df, ["id"])
    W.write_pinned(df, str(tmp_path / "t"), ["id"], digest)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    with pytest.raises(ValueError, match="digest"):
        W.write_pinned(df.limit(1), str(tmp_path / "u"), ["id"], digest)
    assert W.table_digest(df.orderBy(F.desc("id")), ["id"]) == digest


def test_digest_in_blocks(spark):
    import hashlib

    from evalspark.operators.requests import ordered_digest

    df = spark.range(10).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [h(str(i)) for i in range(10)]

    def rule(level, fanout):
        for _ in range(2):
            level = [h("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        return h("".join(level))

    assert ordered_digest(df, ["id"], "h").first()[0] == rule(rows, 4096)
    assert ordered_digest(df, ["id"], "h", fanout=3).first()[0] == rule(rows, 3)
    # a group's digest stays when another one grows
    two = df.withColumn("g", F.lit("small")).unionByName(spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), F.lit("large").alias("g")))
    got = {r.g: r.digest for r in ordered_digest(two, ["id"], "h", ["g"], fanout=3).collect()}
    assert got["small"] == rule(rows, 3) and got["large"] == rule([h(str(i)) for i in range(500)], 3)


def test_every_document_keeps_its_row_without_a_pool(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "doc_id long, g string")
    pool = spark.createDataFrame([(2, "a"), (9, "a")], "doc_id long, g string")
    for got in (R.draw_shots(docs, pool, "doc_id", ["g"], 2, 1, []), R.first_shots(docs, pool, "doc_id", ["g"], 2, [])):
        found = {r.doc_id: sorted(s.id for s in r.shots) for r in got.collect()}
        assert found == {1: [2, 9], 2: [9], 3: [], 4: []}
    bad = {r.doc_id: r.n_shots for r in R.bad_demonstrations(R.first_shots(docs, pool, "doc_id", ["g"], 2, []), "doc_id", 2).collect()}
    assert bad == {2: 1, 3: 0, 4: 0}


def test_draws_reach_every_set_of_examples(spark):
    docs = spark.range(100, 1500).select(F.col("id").alias("doc_id"), F.lit("g").alias("g"))
    pool = spark.range(5).select(F.col("id").alias("doc_id"), F.lit("g").alias("g"))
    seen = {}
    for r in R.draw_shots(docs, pool, "doc_id", ["g"], 2, 11, []).collect():
        key = tuple(sorted(s.id for s in r.shots))
        seen[key] = seen.get(key, 0) + 1
    assert len(seen) == 10 and min(seen.values()) > 90


def test_likelihoods_far_below_zero(spark):
    rows = [(1, i, "abcd"[i], ll) for i, ll in enumerate((-800.0, -801.0, -900.0, -2000.0))] + [(2, i, "x", float("-inf")) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, idx long, choice string, loglik double")
    mass = {r.doc_id: r.acc for r in C.probability_mass(df, ["doc_id"], F.col("idx") == 0).collect()}
    assert abs(mass[1] - 1 / (1 + math.exp(-1))) < 1e-12 and mass[2] is None
    logit = {r.doc_id: r.logit_yes for r in C.yes_logit(df, ["doc_id"]).collect()}
    assert abs(logit[1] - (100 + math.log1p(math.exp(-1)))) < 1e-9
    gap = {r.doc_id: r.likelihood_diff for r in C.gender_bias(df, ["doc_id"]).collect()}
    assert abs(gap[1] - logit[1]) < 1e-9
    empty = df.where("doc_id = 1").withColumn("choice", F.when(F.col("idx") == 0, "").otherwise("bc")).withColumns({"uncond": F.lit(0.0), "gold": F.lit(1), "is_greedy": F.lit(False)})
    assert C.choice_scores(empty, ["doc_id"]).first().acc_norm == 1.0


def test_every_factor_level_has_a_coefficient(spark):
    from evalspark.operators import aggregates as A

    df = spark.range(6600).selectExpr("cast(id % 1200 as double) v", "concat('L', lpad(id % 1200, 4, '0')) f", "cast(id % 7 as double) n")
    got = {r.term: r.coefficient for r in A.treatment_coefficients(df, "v", [], {"f": "L0000"}).collect()}
    assert len(got) == 1200 and all(abs(got[f"f=L{i:04d}"] - i) < 1e-4 for i in range(1, 1200))


def test_tolerant_read(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n{"a": ')
    rows = W.read_records(spark, str(tmp_path), T.StructType([T.StructField("a", T.LongType())])).cache()
    r = W.read_report(rows).first()
    assert (r.readable, r.skipped) == (2, 2)


def test_read_latest(spark, tmp_path):
    for day, v in (("2024-01-01T00-00-00", 1), ("2024-02-01T00-00-00", 2)):
        (tmp_path / f"samples_my_task_{day}.jsonl").write_text('{"v": %d}\n' % v)
    assert [r.v for r in L.read_latest(spark, str(tmp_path)).collect()] == [2]


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = T.StructType([T.StructField("request_hash", T.StringType()), T.StructField("v", T.LongType())])
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], schema).coalesce(1).write.parquet(src)
    Z.export_once(Z.read_log(spark, src, schema), out, ck)
    spark.createDataFrame([("b", 9), ("c", 4)], schema).coalesce(1).write.mode("append").parquet(src)
    Z.export_once(Z.read_log(spark, src, schema), out, ck)
    Z.export_once(Z.read_log(spark, src, schema), out, ck)
    assert sorted((r.request_hash) for r in Z.exported(spark, out, "v").collect()) == ["a", "b", "c"]
    assert spark.read.parquet(out).count() == 4


def test_ngram_stream_writes_words_about_once(spark, tmp_path):
    """the table holds runs of neighbouring n-grams and not each n-gram with its words; a batch done again counts once."""
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    rng = random.Random(3)
    vocab = [f"w{i}é" * (i % 4 + 1) for i in range(300)]
    texts = [" ".join(rng.choices(vocab, k=rng.randrange(200))) for _ in range(60)]
    texts += [texts[0], "Ab, c d e f! ab c d e f", "a " * 40, "x y x y x y x y", "one two three four", "日 本 語 の 文 日", "", " \n", None]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    add = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: Z.ngram_stream(Z.read_log(spark, src, schema), 5, out, ck)
    rows = [(None if i % 20 == 9 else i, t) for i, t in enumerate(texts)]
    add(rows[:30])
    run()
    add(rows[30:])
    run()
    run()
    commits = tmp_path / "ck" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for f in (commits / str(last), commits / f".{last}.crc"):
        f.unlink(missing_ok=True)
    run()
    words = [(t or "").lower().replace(",", "").replace("!", "").split() for t in texts]
    want = {}
    for w in words:
        for g in {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}:
            want[g] = want.get(g, 0) + 1
    got = Z.ngram_counts(spark, out, 5).collect()
    assert {r.ngram: r.n_docs for r in got} == want and len(got) == len(want)
    held = spark.read.parquet(out).agg(F.sum(F.size(F.split("words", " ")))).first()[0]
    assert held < 1.2 * sum(map(len, words))


def test_ngram_runs_travel_packed(spark):
    """runs are dealt once, in few bytes, copies as a number; any number of parts, buckets and n gives the same counts."""
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocab, k=400)) for _ in range(200)] + [" ".join(vocab[:60])] * 500
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    runs = lambda n: Q.ngram_runs(docs, [], F.split("text", " "), n)
    packed = Q.packed_runs(runs(5), 5, 4).agg(F.sum(F.octet_length("runs")), F.max("copies"), F.count("*")).first()
    assert packed[0] < 1.5 * sum(map(len, texts[:201])) and packed[1] > 100 and packed[2] < 100
    for n in (1, 5, 13):
        want = {}
        for t in texts:
            w = t.split(" ")
            for g in {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}:
                want[g] = want.get(g, 0) + 1
        for buckets, at_once in ((1, 1000), (5, 1 << 20)):
            got = Q.ngram_run_counts(runs(n), n, buckets, at_once).collect()
            assert {r.ngram: r.n_docs for r in got} == want and len(got) == len(want)
    plan = Q.ngram_run_counts(runs(5), 5, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # one deals the texts of this test


def test_progress_counts_once_after_a_failed_batch(spark, tmp_path):
    src, out, short, ck = (str(tmp_path / x) for x in ("src", "out", "short", "ck"))
    schema = T.StructType([T.StructField("request_hash", T.StringType()), T.StructField("task", T.StringType())])
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: Z.run_to_table(Z.progress(Z.read_log(spark, src, schema), ["task"]), out, ck)
    read = lambda at: {r.task: r.n for r in Z.latest(spark, at, ["task"]).collect()}
    add([("a", "x"), ("b", "x"), ("a", "x"), (None, "x"), ("", "y"), ("c", None)])
    run()
    assert read(out) == {"x": 2, None: 1}
    add([("b", "x"), ("d", "x"), ("e", "y")])
    run()
    run()
    want = {"x": 3, "y": 1, None: 1}
    assert read(out) == want
    # as after a crash between the write of the last batch and its commit
    commits = tmp_path / "ck" / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for f in (commits / str(last), commits / f".{last}.crc"):
        f.unlink(missing_ok=True)
    run()
    assert read(out) == want and spark.read.parquet(out).where(F.col("batch") == last).count() == 2
    assert Z.compact(spark, out, short, ["task"]) == last and read(short) == want
    assert spark.read.parquet(short).count() == 3


def test_needles_in_depth_order(spark):
    text = " ".join(f"S{i}." for i in range(10))
    got = one(spark, x=Y.hide_sentences(F.lit(text), F.array(F.lit("N1."), F.lit("N2."), F.lit("N3.")), F.array(F.lit(100), F.lit(0), F.lit(50)))).x
    assert got.split() == "N1. S0. S1. S2. S3. S4. N2. S5. S6. S7. S8. S9. N3.".split()


def test_group_trees_have_no_limit_of_depth_and_cycles_are_named(spark):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(300)]
    walks = H.descendants(spark.createDataFrame([*chain, *chain[:3], (None, "x"), ("x", None)], "parent string, child string")).cache()
    assert walks.count() == 300 * 301 // 2
    far = walks.where("ancestor = 'n000' and node = 'n300'").first()
    assert far.depth == 300 and far.path == " > ".join(f"n{i:03d}" for i in range(301))
    assert H.descendants(spark.createDataFrame([], "parent string, child string")).count() == 0
    two = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "parent string, child string")
    assert sorted(r.path for r in H.descendants(two).where("ancestor = 'a' and node = 'e'").collect()) == ["a > b > d > e", "a > c > d > e"]
    with pytest.raises(ValueError, match="a, b, c"):
        H.descendants(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("z", "a")], "parent string, child string"))


def test_one_row_tasks_stay_in_groups(spark):
    res = spark.createDataFrame([("a", 1.0, None, 1), ("b", 0.5, 0.1, 10), ("c", 0.25, None, 1)], "task string, value double, stderr double, n long").withColumn("m", F.lit("x"))
    pairs = spark.createDataFrame([("g", "a"), ("g", "b"), ("one", "c")], "group string, task string")
    got = {r.group: r for r in H.combined_stderr(res, pairs, ["m"]).collect()}
    assert got["one"].combined_stderr is None
    assert got["g"].combined_stderr == pytest.approx(((9 * 0.01) / 10 + 10 / (11 * 10) * ((1 + 5) / 11 - 0.5) ** 2) ** 0.5)
    assert {r.group: r.stderr for r in H.group_scores(res, pairs, ["m"]).collect()} == {"g": None, "one": None}


def test_abstention_over_thresholds_with_ties(spark):


    r = random.Random(3)
    rows = [(g, r.random() < 0.6, r.random() < 0.7, r.choice([0.0, 1.0]), r.random(), r.choice([0.1, 0.2, 0.5, 0.9])) for g in ("a", "b", None) for _ in range(40)]
    rows += [("none", False, True, 0.0, 0.0, 0.5), ("all", True, True, 1.0, 1.0, 0.5)]
    kind = "g string, has_answer boolean, answered boolean, exact double, f1 double, na_prob double"
    got = {x.g: x for x in C.abstention_summary(spark.createDataFrame(rows, kind).repartition(5), ["g"], 0.5).collect()}
    for g in ("a", "b", None, "none", "all"):
        own = [x[1:] for x in rows if x[0] == g]
        for at, name in ((2, "exact"), (3, "f1")):
            best = max(sum((x[at] if x[0] else not x[1]) if x[4] <= t else not x[0] for x in own) for t in (0.0, 0.1, 0.2, 0.5, 0.9))
            assert got[g][f"best_{name}"] == pytest.approx(100 * best / len(own))
            final = [(x[0], (not x[0]) if x[4] > 0.5 else x[at]) for x in own]
            for has, prefix in ((True, "has_ans"), (False, "no_ans")):
                part = [float(v) for h, v in final if h == has]
                assert got[g][f"{prefix}_{name}"] == (pytest.approx(100 * sum(part) / len(part)) if part else None)


def test_marks_beyond_the_alphabet(spark):
    from evalspark.functions import templates
    from evalspark.functions.extraction import choice_answer

    options = [f"o{i}" for i in range(120)]
    df = spark.createDataFrame([(options, "{letter}{lower_case_letter}{numeral}{roman_numeral};", "the answer: AB")], "c array<string>, f string, t string")
    out = df.select(templates.render_options(F.col("c"), F.col("f")).alias("o"), choice_answer(F.col("t"), F.slice("c", 1, 40)).alias("a"), choice_answer(F.col("t"), F.slice("c", 1, 3)).alias("b")).first()
    marks = out.o.split(";")
    assert (marks[0], marks[25], marks[26], marks[53], marks[119]) == ("Aa1I", "Zz26XXVI", "AAaa27XXVII", "BBbb54LIV", "DPdp120120")
    assert out.a == "(AB)" and out.b == "(A)"


def test_answer_key_by_script(spark):
    cases = [
        ("zh", "他说：「Hello World！」今天，OK吗", "他 说 hello world 今 天 ok 吗"),
        ("zh", "  12 年a b。", "12 年 a b"),
        ("ar", "الكتاب، والقلم؟", "كتاب و قلم"),
        ("de", "„Das“ Haus – die Tür!", "haus tür"),
        ("vi", "Con mèo của tôi là", "con mèo tôi"),
        ("hi", "यह घर है।", "यह घर है"),
        ("en", "The cat’s a hat", "cats hat"),
        ("xx", "the A $5", "the a 5"),
        (None, "The  A", "the a"),
        ("zh", "", ""),
        ("ar", None, None),
    ]
    df = spark.createDataFrame(cases, "lang string, x string, want string")
    for r in df.withColumn("got", N.script_answer_key(F.col("x"), F.col("lang"))).collect():
        assert r.got == r.want, r


def test_table_functions_in_sql(spark):
    """Null, empty and short texts have no rows; no exchange beside the outer table; lateral pieces as the operators give them."""
    assert {"word_ngrams", "score_windows", "clean_pieces"} <= set(register_sql(spark))
    words = " ".join(f"w{i}" for i in range(23))
    spark.createDataFrame([(1, None), (2, ""), (3, " a\tb "), (4, words)], "id long, x string").createOrReplaceTempView("table_function_rows")
    grams = spark.sql("SELECT id, g.place, g.ngram FROM table_function_rows, LATERAL word_ngrams(x, 2) AS g")
    assert "Exchange" not in grams._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, r.place, r.ngram) for r in grams.orderBy("id", "place").collect()]
    assert got == [(3, 1, "a b")] + [(4, i + 1, f"w{i} w{i + 1}") for i in range(22)]
    out = spark.sql("SELECT id, w.* FROM table_function_rows, LATERAL score_windows(x, 8, 3, '<s>') AS w ORDER BY id, window_no").collect()
    assert [(r.id, list(r.input), list(r.pred)) for r in out if r.id < 4] == [(3, ["<s>", "a"], ["a", "b"])]
    assert [(list(r.input), list(r.pred)) for r in out if r.id == 4] == windows(words.split(), "<s>", 8, 3)
    text = "".join(chr(97 + i % 26) for i in range(100))
    spans = lambda *s: "array(" + ", ".join(f"struct({a}L AS start, {b}L AS stop)" for a, b in s) + ")"
    cut = lambda x, s, most=10: [(r.chunk_no, r.chunk) for r in spark.sql(f"SELECT c.* FROM (SELECT {x} AS x), LATERAL clean_pieces(x, {s}, 5, {most}, 8) AS c ORDER BY 1").collect()]
    whole = f"'{text}'"
    assert cut(whole, "NULL") == [(0, text)] and cut("'short'", "NULL") == [] and cut("CAST(NULL AS STRING)", "NULL") == []
    assert cut(whole, spans((60, 62), (20, 25))) == [(0, text[:15]), (1, text[30:55]), (2, text[68:])]
    assert cut(whole, spans((60, 62), (20, 25)), 1) == []
    assert cut(whole, spans((3, 4), (90, 99))) == [(0, text[9:85])]


def test_a_clean_text_of_the_minimum_is_one_piece(spark):
    """as in clean_chunks, a text without spans stays whole from the minimum on, beside spans only longer pieces do."""
    register_sql(spark, ["clean_pieces"])
    cut = lambda x, spans: [r.chunk for r in spark.sql(f"SELECT c.* FROM (SELECT '{x}' AS x), LATERAL clean_pieces(x, {spans}, 1, 10, 8) AS c ORDER BY 1").collect()]
    assert cut("12345678", "NULL") == ["12345678"] and cut("1234567", "NULL") == []
    span = "array(struct(9L AS start, 10L AS stop))"
    assert cut("12345678abc", span) == [] and cut("123456789abcd", span.replace("9L", "10L")) == ["123456789"]


def test_fixed_digits_as_c_prints_them(spark):
    """decimals that no double holds lie beside their tie; only fractions of powers of two are ties."""
    values = [k / n for n in (32, 160, 800, 4000, 20000, 96, 7) for k in range(1, n, 3)] + [-0.01875, -0.00001, 0.0, 12345.00625, 1e9 + 0.03125, 0.99995, 0.00005, -2.5]
    for digits in (2, 4):
        rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.fixed(F.col("v"), digits).alias("s")).collect()
        assert [(r.v, r.s) for r in rows] == [(r.v, f"{r.v:.{digits}f}") for r in rows]
    assert one(spark, s=N.fixed(F.lit(None).cast("double"), 4)).s is None


def test_gram_counts_stay_in_the_row(spark):
    """BLEU and ROUGE counts by brute force, without any grouping or exchange of grams."""
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("abc") for _ in range(rng.randrange(12)))
    rows = [(i, text(), text()) for i in range(60)] + [(90, "", ""), (91, "a b a b a", "a b a b")]
    df = spark.createDataFrame(rows, "k long, p string, r string")
    counts = V.bleu_counts(df, ["k"], N.split_words(F.col("p")), N.split_words(F.col("r")))
    rouge = V.rouge_n(df, ["k"], "p", "r")
    for out in (counts, rouge):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Aggregate" not in plan
    got, scores = {r.k: r for r in counts.collect()}, {r.k: r for r in rouge.collect()}
    for k, p, r in rows:
        for n in range(1, 5):
            a, b = ([tuple(t[i : i + n]) for i in range(len(t) - n + 1)] for t in (p.split(), r.split()))
            common = sum(min(a.count(g), b.count(g)) for g in set(a))
            assert (got[k][f"c{n}"], got[k][f"t{n}"]) == (common, len(a))
            if n < 3:
                assert scores[k][f"rouge{n}"] == pytest.approx(2 * common / (len(a) + len(b)) if common else 0.0)
        assert (got[k].sys_len, got[k].ref_len) == (len(p.split()), len(r.split()))


def test_frequent_words_are_counted_in_their_row(spark):
    """Only keys with several rows, a null key too, have their words dealt; ties go by code point."""
    rows = [(1, "b B a\u3000c c c"), (2, "x"), (2, "Y x"), (3, None), (4, ""), (None, "q"), (None, "q r"), (5, "\U0001f600 \uffff")]
    got = Y.frequent_words(spark.createDataFrame(rows, "k long, t string"), "k", "t", 2)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r["k"] or 0, r["rank"], r["word"], r["n"]) for r in got.collect())) == [
        (0, 1, "q", 2), (0, 2, "r", 1), (1, 1, "c", 3), (1, 2, "b", 2), (2, 1, "x", 2), (2, 2, "y", 1), (5, 1, "\uffff", 1), (5, 2, "\U0001f600", 1)
    ]


def test_variants_are_looked_at_where_the_response_fails(spark):
    """No array of all variants' verdicts is kept beside the strict one; rows without rules have no verdict, and the open
    language rule stays null."""
    from evalspark.operators.instructions import check_rules

    schema = "k int, t string, rules array<struct<rule: string, args: struct<n: int, m: int, relation: string, words: array<string>, text: string>>>"
    args = (1, 0, "", ["b"], "x")
    rule = lambda name: (name, args)
    both = [rule("punctuation:no_comma"), rule("language:response_language"), rule("keywords:existence")]
    rows = [(1, "a, c\nb", both), (2, "a, c", []), (3, "", both), (4, "a", None), (5, "a,", both)]
    got = check_rules(spark.createDataFrame(rows, schema), ["k"], "t", "rules")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(c#" not in plan
    assert {(r["k"], r["rule"].split(":")[1]): (r["strict"], r["loose"]) for r in got.collect()} == {
        (1, "no_comma"): (False, True), (1, "response_language"): (None, None), (1, "existence"): (True, True),
        (3, "no_comma"): (False, False), (3, "response_language"): (False, False), (3, "existence"): (False, False),
        (5, "no_comma"): (False, False), (5, "response_language"): (None, None), (5, "existence"): (False, False),
    }
