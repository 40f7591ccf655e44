"""Training-data operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows
and clashing column names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evalspark.llm import chat, common, fertility, langid, lattice, mixing, neardup, packing, quality, queries, suffix, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, class_id long, span string"
BPE, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, 5, 7, "x")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(name() for _ in range(n))
    passage, long, base = text(130), text(9000), text(200)
    out = [row(i, text(r.randint(1, 300)), r.choice(["en", "de", "fr", "es"]), r.choice(["a", "b", "c", None])) for i in range(40)]
    out += [row(50, None), row(51, ""), row(52, " \n\t "), row(None, text(60)), row(54, long), row(55, long), row(56, "é" * 900), row(57, "aaaa" * 300)]
    out += [row(60 + i, text(40) + " " + passage + " " + text(40)) for i in range(5)]
    for i in range(12):  # near copies, exact copies and repeated rows
        w = base.split(" ")
        w[i * 7] = "zz"
        out.append(row(70 + i, " ".join(w)))
    out += [row(90, base), row(91, base), row(91, base), row(92, "one two three"), row(93, "one two three"), row(94, "a<|endoftext|>b  c d\x1ce")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.small_batches(spark, 7)
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_hash_words_agree_across_parts():
    t = "Ab  c\tde\néf " * 50
    h, s, n = common.hash_words(t.encode())
    again = common.hash_words(t.encode(), part=16)
    assert (h == again[0]).all() and (s == again[1]).all() and (n == again[2]).all()
    assert len(h) == len(words(t)) and len(set(h.tolist())) == len(set(words(t)))


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 180)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t[1])) else set() for t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((r[0], links[i], min((x for x in groups[find(i)] if x is not None), default=None)) for i, r in enumerate(rows) if r[0] is not None)


@pytest.mark.parametrize("block", [512, 4])
def test_ngram_join(docs, rows, none, block, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK_SETS", block)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got if r.doc_id is not None) == brute_links(rows)
    kept = neardup.one_per_class(docs)
    assert kept.columns == docs.columns
    classes = {r.class_id for r in got}
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(c for c in classes if c is not None)
    assert neardup.near_duplicates(none).count() == 0


def test_bands_reach_the_recall():
    b, r = neardup.choose_bands(0.8, 0.9999)
    assert b * r <= 128 and 1 - (1 - 0.8**r) ** b >= 0.9999


def test_suffix_array_and_common_prefixes():
    r = random.Random(2)
    for k in range(40):
        raw = bytes(r.choice(b"abcdefgh"[: 1 + k % 8]) for _ in range(r.randint(1, 400)))
        raw = raw + raw[: len(raw) // 2] + b"\xff" + raw if k % 3 == 0 else raw
        t = np.append(np.frombuffer(raw, np.uint8).astype(np.int64) + 1, 0)
        sa = suffix.suffix_array(t, 257)
        assert sa.tolist() == sorted(range(len(raw) + 1), key=lambda i: raw[i:])
        small = suffix._types(t)
        lms = np.flatnonzero(small & ~np.append(True, small[:-1]))
        order = np.array(sorted(lms.tolist(), key=lambda i: raw[i:]))
        if len(t) > 2:
            assert suffix._induce(t, small, order, 257).tolist() == sa.tolist() == suffix._induce_list(t.tolist(), small.tolist(), order.tolist(), 257)
        lcp, phi = suffix.permuted_lcp(np.frombuffer(raw, np.uint8), sa)
        for a, b in zip(sa[:-1], sa[1:]):
            x, y = raw[a:], raw[b:]
            n = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[b] == n and phi[b] == a


def brute_removed(rows, length):
    count = collections.Counter(b[i : i + length] for t in rows for b in [(t[1] or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for t in rows:
        b = (t[1] or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        left = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((t[0] if t[0] is not None else -1, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 23, 600])
def test_suffix_dedup(docs, rows, none, hot):
    got = suffix.removal_digest(docs, words=51, hot_bytes=hot, shard_bytes=4000).collect()
    key = lambda d: -1 if d is None else d
    assert sorted((key(r.doc_id), *r[1:5]) for r in got) == brute_removed(rows, 400)
    passages = [(key(t[0]), sum(b - 1 not in g for b in g), len(g)) for t, g in zip(rows, brute_word_ranges(rows, 51), strict=True)]
    assert sorted((key(r.doc_id), r.n_passages, r.n_passage_bytes) for r in got) == sorted(passages) and max(passages, key=lambda x: x[2])[2] > 0
    alone = suffix.removal_digest(docs, hot_bytes=hot, shard_bytes=4000).collect()
    assert sorted((key(r.doc_id), *r[1:]) for r in alone) == brute_removed(rows, 400)
    if hot > 600:
        cut = suffix.without_repeats(docs)
        assert cut.columns == docs.columns and cut.where("doc_id = 50 and text is null").count() == 1
        assert suffix.removal_digest(none).count() == 0


def test_query_shows_passages_shorter_than_its_strings(spark, tmp_path):
    """Two texts share 51 words of fewer than 400 bytes, two share 50 words: the digest leaves all, the passage columns tell."""
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(4, 6))) for _ in range(n))
    long, short = text(51), text(50)
    assert len(long) < suffix.LENGTH
    rows = [row(i, text(40) + " " + (long if i < 2 else short) + " " + text(40)) for i in range(4)] + [row(4, text(120)), row(5, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.QUERIES["op8_suffix"](spark, str(tmp_path)).collect())
    assert [(x.doc_id, *x[1:5]) for x in got] == brute_removed(rows, suffix.LENGTH)
    assert [x.n_removed for x in got] == [0] * 6
    assert [(x.n_passages, x.n_passage_bytes) for x in got] == [(1, len(long))] * 2 + [(0, 0)] * 4


@pytest.mark.parametrize("words", [0, 9])
def test_pieces_alone_have_their_anchor_where_it_was(words):
    """Rows of pieces hold no place of the anchor; it is found again in the piece by itself. Places are read back whole."""
    r = random.Random(13)
    texts = [bytes(r.choice(b"ab c") for _ in range(r.randrange(900))) for _ in range(40)]
    own, start, size, at, anchor = suffix.word_pieces_of(texts, words) if words else suffix.pieces_of(texts, 90)
    cut = [texts[t][a : a + n] for t, a, n in zip(own, start, size)]
    again = suffix.word_pieces_of(cut, words) if words else suffix.pieces_of(cut, 90)
    assert len(own) and [x.tolist() for x in again] == [list(range(len(cut))), [0] * len(cut), size.tolist(), at.tolist(), anchor.tolist()]


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    got = packing.pack(packing.token_pieces(docs, BPE)).collect()
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            p = ids[at : at + 2048]
            want[d, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids), tuple(p)] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in got) == want
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(windows) == plain_best_fit([r.length for r in got], 2048)
    assert packing.pack(packing.token_pieces(none, BPE)).count() == 0


def plain_best_fit(lengths, window):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = min((x for x in left if x >= n), default=None)
        if fit is None:
            left.append(window - n)
        else:
            left[left.index(fit)] = fit - n
    return len(left)


def test_best_fit_by_groups_equals_one_at_a_time():
    r = random.Random(6)
    for _ in range(30):
        counts = collections.Counter(r.randint(1, 40) for _ in range(r.randint(1, 400)))
        plan = packing.best_fit_decreasing(dict(counts), 40)
        used, placed = collections.Counter(), collections.Counter()
        for length, _, n, first, offset in plan:
            placed[length] += n
            for w in range(first, first + n):
                assert used[w] == offset
                used[w] += length
        assert placed == counts and max(used.values()) <= 40
        assert len(used) == plain_best_fit(list(counts.elements()), 40)


def test_lattice_scores(spark, docs, rows, none):
    keyed = docs.select("doc_id", "text", (F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 1).alias("held_out"))
    got = lattice.score_texts(keyed, ~F.col("held_out"), PIECES).collect()
    assert len(got) == len(rows)
    count = collections.Counter()
    for d, t, *_ in rows:
        if (d or 0) % 3 != 1:
            count.update([*words(lower(t)), "\0"])
    n, v = sum(count.values()), len(count)
    want = collections.defaultdict(set)
    for d, t, *_ in rows:
        w = [*words(lower(t)), "\0"]
        want[d].add((len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 5)))
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) in want[r.doc_id] and r.mixture_score < 0
    # the whole score again: expectation over counted words, then every text's lattice
    own, learnt = lattice.pieces(PIECES), {w: c for w, c in count.items() if w != "\0"}
    logp = own.start
    for _ in range(4):
        uses = np.full(len(logp), 0.01)
        lattice.forward(own, logp, [w.encode() for w in learnt], uses, np.array(list(learnt.values())))
        logp = np.log(uses / uses.sum())
    once = np.full(len(logp), 0.01)
    for w, c in learnt.items():
        for _ in range(c if c < 3 else 0):
            lattice.forward(own, own.start, [w.encode()], once)
    few = {w: c for w, c in learnt.items() if c < 3}
    twice = np.full(len(logp), 0.01)
    lattice.forward(own, own.start, [w.encode() for w in few], twice, np.array(list(few.values())))
    assert np.allclose(once, twice)
    ends = count["\0"]
    score = collections.defaultdict(set)
    for d, t, *_ in rows:
        w = words(lower(t))
        spelled = lattice.forward(own, logp, [x.encode() for x in w])
        score[d].add(round(spelled.sum() / math.log(10) + len(w) * math.log10(1 - ends / n) + math.log10(ends / n), 4))
    assert all(round(r.score, 4) in score[r.doc_id] for r in got)
    assert lattice.score_texts(none.select("doc_id", "text", F.lit(False).alias("held_out")), F.lit(True), PIECES).count() == 0


def test_rare_words_score_as_frequent_ones(docs, monkeypatch):
    keyed = docs.select("doc_id", "text", F.lit(False).alias("held_out"))
    ask = lambda: sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6), round(r.score, 6), round(r.mixture_score, 6)) for r in lattice.score_texts(keyed, F.lit(True), PIECES).collect())
    many = ask()
    monkeypatch.setattr(lattice, "FREQUENT", 3)
    assert ask() == many


def test_lattice_sums_all_segmentations():
    own = lattice.pieces(PIECES)
    logp = own.start
    names = {n: logp[i] for i, n in enumerate(own.names)}

    def total(s):
        if not s:
            return 1.0
        return sum(math.exp(names[s[:k]]) * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in names) + math.exp(logp[own.fallback + s[0]]) * total(s[1:])

    some = ["the", "tion", "zürich", "x", "été", "日本"]
    expected = np.zeros(len(logp))
    got = lattice.forward(own, logp, [w.encode() for w in some], expected)
    assert np.allclose(got, [math.log(total(b" " + w.encode())) for w in some])
    assert abs(math.exp(logp.max()) - np.exp(logp).max()) < 1e-12 and expected.min() >= 0
    one = np.zeros(len(logp))
    lattice.forward(own, logp, [b"ab"], one)
    size = np.array([*map(len, own.names), *[1] * 256])
    assert abs((one * size).sum() - 3) < 1e-9  # pieces of " ab" cover three bytes
    assert np.isfinite(lattice.forward(own, logp, [b"q" * 20_000])).all()


@pytest.mark.parametrize("scale", [1, 5000, 10**7])
def test_top_k(spark, scale):
    r = random.Random(scale)
    data = [(i, [r.uniform(-1, 1) * scale for _ in range(20)]) for i in range(90)]
    data += [(i, list(data[40][1])) for i in range(100, 140)]  # ties
    data += [(200, None), (220, [1.0, None]), (240, [float("nan")] * 20), (260, [float("inf")] * 20), (None, [1.0] * 20), (280, [0.5, 0.25]), (40, list(data[40][1]))]
    df = topk.quantized(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    got = sorted(tuple(x) for x in topk.top_k(df, df.where("vec_id % 20 = 0"), 7, candidate_block=40, query_block=3).collect())
    whole = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.setdefault(i, []).append([math.floor(64 * x) for x in v] + [0] * (20 - len(v)))
    want = []
    for q in whole:
        if q % 20 == 0:
            score = sorted((-sum(a * b for a, b in zip(whole[q][0], w)), c) for c, ws in whole.items() if c != q for w in ws)
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(score[:7])]
    assert got == sorted(want)


def test_top_k_without_rows(spark):
    df = topk.quantized(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(df, df).count() == 0


def test_fertility_base(docs, rows, none):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in fertility.judged(fertility.measured(docs, RANKS, PIECES)).collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        w = words(t)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)] += 1
    assert got == want
    assert fertility.judged(fertility.measured(none, RANKS, PIECES)).count() == 0


def test_fertility_bands_reject_the_odd_text(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice(["the", "house", "of", "many", "windows", "stands", "near", "a", "river", "and", "garden", "with", "old", "trees"]) + r.choice(["", "", ","]) for _ in range(90))
    odd = {900: " ".join(w + "$$$###" for w in text().split()), 901: " ".join(r.choice("㐀㐁㐂㐃㐄㐅㐆㐇") * 3 + str(i) for i in range(90))}
    rows = [(i, text(), "en") for i in range(80)] + [(i, t, "en") for i, t in odd.items()]
    out = fertility.judged(fertility.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"), RANKS, PIECES))
    assert {x.doc_id for x in out.where("not kept").collect()} == set(odd)


def test_measures_follow_the_vocabularies():
    tokens = fertility.WordTokens(RANKS, PIECES)
    n_words, chars, _, _, _, n, letters, per, fallback, entropy = fertility.measure("aa bb aa\naa", tokens)
    ids = [i for w in ("aa", "bb", "aa", "aa") for i in tokens.bpe.encode_ordinary(" " + w)]
    p = np.array(list(collections.Counter(ids).values())) / len(ids)
    assert (n_words, chars, n, fallback) == (4, 8, len(ids), 0.0)
    assert letters == per == 8 / len(ids) and abs(entropy + (p * np.log2(p)).sum()) < 1e-9


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        over = sum(weight[s] for s in sizes if s not in capped)
        more = {s for s in sizes if s not in capped and 3 * sizes[s] <= weight[s] * left / over} if over else set()
        if not more:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * left / over for s in sizes}
        capped |= more


def test_mixing(spark, docs, rows, none):
    got = mixing.with_copies(docs).collect()
    sizes = collections.Counter()
    for d in rows:
        sizes[d[3]] += len(words(d[1]))
    goal = brute_targets(sizes)
    for r in got:
        assert r["__mix_size"] == len(words(r.text)) and r["__mix_source_size"] == sizes[r.source]
        assert abs(r["__mix_target"] - goal[r.source]) < 1e-6 and 0 <= r["__mix_copies"] <= 3
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["__mix_copies"] for r in got)
    assert mixing.with_copies(none).count() == 0
    many = spark.range(4000).selectExpr("id doc_id", "repeat('w ', cast(id % 50 as int)) text", "concat('s', id % 4) source")
    sums = mixing.with_copies(many).groupBy("source").agg(F.sum(F.col("__mix_size") * F.col("__mix_copies")).alias("taken"), F.max("__mix_target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in sums)


def test_sharing_again_until_none_is_above(spark):
    sizes = {"a": 100, "b": 1, "c": 1000, "d": 3, None: 5}
    rows = [(k, v) for k, v in sizes.items()] + [("e", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = brute_targets({**sizes, "e": 0})
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<s>\\<\\[<|image:0|>", "", None, "[TURN]assistant[TEXT]x</s>[/TURN]", "plain \\", "é [", "<"]
    turns = [(c, t, ["user", "assistant", "system", None][(c + t) % 4], said[(c * 3 + t) % len(said)], "clash") for c in range(6) for t in range(5)]
    turns += [(None, 0, "assistant", "no id", ""), (2, 1, "user", "a tie", ""), (3, None, "assistant", "no turn", "")] + [(7, 0, "assistant", "twice", "")] * 2
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    for longest in (1 << 22, 30):
        chats = chat.format_chats(df, longest=longest)
        got = {r.conv_id: r for r in chat.digests(chats, placed=True).collect()}
        again = {r.conv_id: r for r in chat.digests(chats).collect()}
        by = collections.defaultdict(list)
        for c, t, role, text, _ in turns:
            by[c].append((t is not None, t or 0, role or "", text is not None, text or ""))
        assert set(got) == set(by)
        for c, own in by.items():
            own = sorted(own)
            loss = "".join(x[4] for x in own if x[2] == "assistant")
            turns_hash = hashlib.sha256("".join(f"{x[2]}\n{x[4]}\n" for x in own).encode()).hexdigest()
            assert got[c][1:5] == (len(own), turns_hash, len(loss), hashlib.sha256(loss.encode()).hexdigest()) and got[c] == again[c]
    assert chat.format_chats(df.limit(0)).count() == 0
    one = chat.format_chats(df.where("conv_id = 0")).first().formatted
    body = "".join(chat.escape(t) for _, t in chat.read_turns(one))
    assert not re.search(r"</?s>|\[/?(TURN|TEXT|INST)\]|<\|", body)


def test_typed_parts_become_placeholders(spark):
    kind = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int,tokens:long>>"
    parts = [("text", "look <|image:9|>", None, None, None, None, None, None), ("image", None, "a.png", 56, 57, None, None, None), None, ("audio", None, "b.wav", None, None, 2.5, None, None), ("odd", "kept", None, None, None, None, None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("document", None, "c.pdf", None, None, None, 3, None), ("image", None, "d.png", None, None, None, None, 11)]), (1, 2, "user", None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {kind}"), content="parts").first()
    assert chat.placeholders(r.formatted) == [("image", 0), ("audio", 1), ("document", 2), ("image", 3)]
    assert [(a.kind, a.ref, a.position, a.tokens) for a in r.attachments] == [("image", "a.png", 0, 6), ("audio", "b.wav", 1, 63), ("document", "c.pdf", 2, 768), ("image", "d.png", 3, 11)]
    assert chat.read_turns(r.formatted)[0] == ("user", "look <|image:9|><|image:0|><|audio:1|>kept") and r.n_turns == 3


def test_language_id(spark, docs):
    data = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4) == 2
    model = langid.fit(langid.training_sample(data.where(~held), 60), 60)
    out = langid.identify(data.where(held).withColumn("score2", F.lit(1)), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in out) > 0.95 * len(out) and all(0 <= r.score <= 1 for r in out)
    edge = {r.doc_id: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    assert all(edge[i].lang_pred == "und" and edge[i].score == 0 for i in (50, 51, 52)) and edge[54].lang_pred != "und"
    empty = langid.fit(langid.training_sample(data.limit(0)))
    assert {r.lang_pred for r in langid.identify(docs, empty, ["doc_id"]).collect()} == {"und"}
    single = langid.fit(langid.training_sample(data.where("lang = 'de'"), 5))
    assert {r.lang_pred for r in langid.identify(docs.where("doc_id = 1"), single, ["doc_id"]).collect()} == {"de"}


def test_svm_separates():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 12)).astype(np.float32)
    y = np.sign(x @ r.normal(size=12) + 0.1)
    w = langid.linear_svm(x, y, cost=100.0, rounds=100)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).mean() > 0.97


def test_quality(spark, docs, none):
    r = random.Random(3)
    text = lambda: " ".join(r.choice(["wood", "lake", "stone", "light", "path", "green", "wind", "hill"]) for _ in range(r.randint(20, 400)))
    bad = lambda: " ".join(w + "###" for w in text().split())
    rude = lambda: text() + " idiot " + text()
    rows = [(i, [bad, rude, text][i % 3](), 1, 0) for i in range(600)]
    data = spark.createDataFrame(rows, "doc_id long, text string, quality int, __x int")
    labels = data.where("doc_id < 450").selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) quality", "cast(doc_id % 3 = 1 as int) toxic").unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    model = quality.fit(quality.training_sample(data, labels.select("doc_id", quality.rating().alias("grade"))))
    out = quality.graded(data.where("doc_id >= 450"), model).collect()
    assert np.mean([x["__kept"] == (x.doc_id % 3 == 2) for x in out]) > 0.97
    grade = [np.mean([x["__expected_grade"] for x in out if x.doc_id % 3 == k]) for k in range(3)]
    assert grade[0] < grade[1] < grade[2] and (np.diff(model.thresholds) > 0).all()
    edge = {x.doc_id: x for x in quality.graded(docs, model).collect()}
    assert edge[50]["__kept"] and edge[51]["__kept"] and edge[52]["__kept"]
    nothing = quality.fit(quality.training_sample(data, labels.limit(0).select("doc_id", quality.rating().alias("grade"))))
    assert quality.graded(data, nothing).where("not __kept").count() == 0
    assert quality.graded(none, nothing).count() == 0


def test_ordinal_gradient():
    texts = [b"a b", b"a c", b"c d", b"d e", b"e f", b"a f"] * 6
    grades = np.array([0, 0, 1, 1, 2, 2] * 6)
    m = quality.fit_ordinal(texts, grades, rounds=800, least_share=0.0)
    t = m.tails(texts)
    assert ((t[:, 0] > 0.5).astype(int) + (t[:, 1] > 0.5) == grades).mean() > 0.8


def brute_word_ranges(rows, n):
    spots = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t[1] or "").encode())] for t in rows]
    count = collections.Counter(tuple(w for _, _, w in s[i : i + n]) for s in spots for i in range(len(s) - n + 1))
    return [{b for i in range(len(s) - n + 1) if count[tuple(w for _, _, w in s[i : i + n])] > 1 for b in range(s[i][0], s[i + n - 1][1])} for s in spots]


@pytest.mark.parametrize("hot", [1 << 23, 600])
def test_repeats_in_words(spark, rows, hot):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))
    passage = text(51)
    more = [row(200 + i, text(30) + " " + (passage.replace(" ", "\n") if i == 2 else passage) + " " + text(30)) for i in range(4)]
    rows = rows + more + [row(210, "s" + passage + " " + text(60)), row(211, text(9) + " " + passage + "s")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    for n in (51, 12):
        spans = suffix.repeated_spans(docs, length=0, words=n, hot_bytes=hot, shard_bytes=4000)
        keyed = docs.select("doc_id", "text", *[c.alias(k) for c, k in zip(suffix._keys("text"), ("k1", "k2"))])
        got = keyed.join(spans, ["k1", "k2"], "left").collect()
        found = sorted((x.doc_id or -1, x.text or "", sorted({b for a, e in suffix.merged(x.spans) for b in range(a, e)})) for x in got)
        assert found == sorted((t[0] or -1, t[1] or "", sorted(g)) for t, g in zip(rows, brute_word_ranges(rows, n)))


@pytest.mark.parametrize("empty", [0, 1])
def test_links_are_counted_once_beside_an_empty_block(empty):
    sets = {bytes([i]): np.arange(i, 1000, dtype=np.int64) for i in range(2)}
    ratio = neardup.Fraction("0.8")
    own = neardup._decided({d: (False, 1, s) for d, s in sets.items()}, (b"r", empty, empty), ratio)
    assert [x["links"] for x in own] == [1, 1]
    assert neardup._decided({d: (empty == 0, 1, s) for d, s in sets.items()}, (b"r", 0, 1), ratio) == []


def test_two_long_near_copies_have_one_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_BLOCK_SHINGLES", 150)
    for seed in range(4):
        r = random.Random(seed)
        w = [f"w{r.randrange(10**6)}" for _ in range(200)]
        docs = spark.createDataFrame([row(1, " ".join(w)), row(2, " ".join([*w, "end"]))], DOCS)
        assert sorted((x.doc_id, x.class_id, x.n_links) for x in neardup.near_duplicates(docs).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_sorted_pieces_are_those_that_can_share_a_string():
    """Pieces with one anchor and nothing else in common are not sorted; those with a string in common are, wherever it starts."""
    r = random.Random(8)
    rand = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    anchor = rand(suffix.GRAM)
    for left in range(0, suffix.LENGTH - suffix.GRAM + 1):
        shared = rand(left) + anchor + rand(suffix.LENGTH - suffix.GRAM - left)
        held = {(i, 0): (5, left + i, rand(i) + shared + rand(9)) for i in (3, 20)} | {(7, 7): (5, 368, rand(368) + anchor + rand(368)), (8, 8): (6, left, shared)}
        assert set(suffix._candidates(held, suffix.LENGTH)) == {(3, 0), (20, 0)}


def test_short_texts_are_read_together(monkeypatch):
    r = random.Random(9)
    texts = [b"", b"x", b" "] + [b" ".join(r.choice([b"ab", b"c", b"\xc3\xa9f"]) + b"%d" % r.randrange(50) for _ in range(r.randrange(400))) for _ in range(30)]
    for f in (lambda t: suffix.pieces_of(t, 60, 32), lambda t: suffix.word_pieces_of(t, 9)):
        whole = [x.tolist() for x in f(texts)]
        alone = [f([t]) for t in texts]
        assert whole[0] == [i for i, x in enumerate(alone) for _ in x[0]]
        assert whole[1:] == [np.concatenate([x[k] for x in alone]).tolist() for k in range(1, 5)]
