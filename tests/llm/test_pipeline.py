"""Each pipeline stage on what its predecessor kept, against brute force; and what is registered."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evalspark.llm import mixing, queries
from tests.llm.test_operators import BPE, SF, brute_links, brute_targets, brute_word_ranges, words


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
        out[-1].count()
    return out


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_hand_on_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[1:-1])


def test_quality_rejects_poor_and_toxic(spark, stages):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in as_rows(stages[1])}
    good = [d for d, x in labels.items() if x == (1, 0)]
    bad = [d for d, x in labels.items() if x[0] == 0]
    assert np.mean([d in kept for d in good]) > 0.95 and np.mean([d in kept for d in bad]) < 0.1


def test_one_of_each_class(stages):
    want = sorted({c for _, _, c in brute_links(as_rows(stages[1]))})
    assert sorted(r[0] for r in as_rows(stages[2])) == want


def test_repeats_are_cut(stages):
    """Bytes in 400-byte strings or in 51 words that start elsewhere too go; of a character that is cut, all goes."""
    before, after = as_rows(stages[2]), dict(as_rows(stages[3]))
    raw = [(t or "").encode() for _, t in before]
    count = collections.Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    assert set(after) == {d for d, _ in before}
    for (d, _), x, passages in zip(before, raw, brute_word_ranges(before, corpus_pipeline.PASSAGE_WORDS), strict=True):
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - 399):
            if count[x[i : i + 400]] > 1:
                gone[i : i + 400] = True
        gone[list(passages)] = True
        edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
        cuts = [0, *edge.tolist(), len(x)]
        assert after[d].encode() == b"".join(x[a:b].decode(errors="ignore").encode() for a, b in zip(cuts[::2], cuts[1::2]))
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_mix_follows_the_targets(stages):
    rows = [(r.doc_id, r.text, r.source) for r in stages[3].collect()]
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    goal = brute_targets(size)
    u = {r.doc_id: r.u for r in stages[3].select("doc_id", mixing.draw("mix", "doc_id").alias("u")).collect()}
    want = collections.Counter()
    for d, _, s in rows:
        rate = goal[s] / size[s] if size[s] else 0.0
        want[d] += int(rate) + (u[d] < rate - int(rate))
    assert collections.Counter(r[0] for r in as_rows(stages[4])) == +want


def test_windows_hold_every_id(stages):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    want = collections.Counter()
    for d, t in as_rows(stages[4]):
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            p = ids[at : at + 2048]
            want[d, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())] += 1
    got = stages[5].collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    used = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in used) <= 2048


def test_registered_queries():
    names = [n for n in entry.queries() if n in queries.QUERIES]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries() and set(queries.SQL) <= set(entry.oracle_sql())


def test_sql_twins(spark):
    from tests.compare import compare, duck

    con = duck(SF)
    for name, sql in queries.SQL.items():
        ok, message, n, _ = compare(spark, con, name, queries.QUERIES[name], sql, SF)
        assert ok and n > 0, (name, message)


def test_shared_passage_of_51_words_is_cut(spark):
    w = lambda who, n: " ".join(f"{who}{i}" for i in range(n))
    passage, short = w("p", 51), w("q", 50)
    assert len(passage) < 400
    docs = [(i, f"{w(f'a{i}x', 30)} {passage} {w(f'b{i}x', 30)} {short} {w(f'c{i}x', 9)}") for i in range(3)] + [(9, w("z", 90))]
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.lit(0).cast("long")), SF)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in out.collect()) == [(d, t.replace(passage, ""), len(t.replace(passage, ""))) for d, t in docs]


def test_packing_remembers_few_units_and_lets_go(spark):
    """Memory of a worker: bounded by what the stage passes, and freed by the next pass without a tokenizer."""
    from tokenizers import Tokenizer

    from evalspark.llm import common, packing

    tok, model = packing.UnitTokenizer(BPE, remembered=1000), Tokenizer.from_file(BPE)
    for part in range(40):
        text = " ".join(f"w{part}x{i % 150}" for i in range(300))
        assert np.frombuffer(tok.ids([text])[0], "<u4").tolist() == model.encode(text, add_special_tokens=False).ids
        assert len(tok.spaced) + len(tok.spaced.old) <= 1000
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(8)], "doc_id long, text string").coalesce(1)
    packing.token_pieces(docs, BPE, remembered=corpus_pipeline.REMEMBERED).count()
    held = lambda cols: {"n": [len(common._kept)]}
    assert corpus_pipeline.REMEMBERED <= packing.REMEMBERED // 4 and common.arrow_pass(docs, held, "n long").first().n == 0
    assert packing.tokenizer(BPE, 1000) is packing.tokenizer(BPE, 1000) and common._kept
    common.let_go()
    assert not common._kept
