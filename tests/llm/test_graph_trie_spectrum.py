"""URL filters, conversation tries and whitening against brute force: nulls, empties, ties, repeats, empty tables, clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import common, prefixtrie, queries, urlfilter, whitening
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_prefix_trie"])
def test_sql_agrees(spark, name):
    ok, message, n, _ = compare(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok and n, message


# --- URL filters -----------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, path string, rule string, node string, verdict string"


def page(i, url, html=None):
    return (i, url, html, "x", "x", "x", "x", "x")


def canonical(href):
    return f'<link rel="canonical" href="{href}">'


def host_path(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)([^#]*)", rest, re.S)
    return m[1].lower(), m[2], m[1].lower() + m[2] + m[3]


def brute_verdicts(pages, links, rules):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def rule(url):
        host, path, _ = host_path(url)
        fit = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[3:] if fit else (None, None)

    urls = {u for x in links for u in x}
    for a, b in links:
        a, b = find(host_path(a)[2]), find(host_path(b)[2])
        parent[max(a, b)] = min(a, b)
    held = collections.defaultdict(set)
    for u in urls:
        held[find(host_path(u)[2])].add(rule(u)[1])
    out = []
    for i, u, *_ in pages:
        host, path, node = host_path(u)
        name, own = rule(u)
        near = held[find(node)] if host else set()
        out.append((i, host, path, name, own or ("allow" if "allow" in near else "block" if "block" in near else "allow")))
    return sorted(out, key=str)


def test_verdicts_agree_with_brute_force(spark):
    r = random.Random(2)
    rules = urlfilter.rule_list(spark, [*queries.URL_RULES, "allow a.com/p/", "block a.com/p/q", "block long.deep.host.org/x"])
    listed = [tuple(x) for x in rules.collect()]
    site = lambda: f"{r.choice(['http', 'https'])}://{r.choice(['a.com', 'WWW.a.com', 'b.org', 'c.net', 'example.net', 'v.example.com', 'long.deep.host.org', 'xa.com'])}{r.choice(['', '/'])}{r.choice(['', 'p/', 'p/q', 'fr/1', 'en/', 'x', 'de/3', 'k', 'm', 'w'])}{r.choice(['', '?a=1'])}{r.choice(['', '#f'])}"
    pages, links = [], []
    for i in range(150):
        u, html = site(), ""
        for _ in range(r.choice([0, 0, 1, 2])):
            v = site()
            links.append((u, v))
            html += r.choice([canonical(v), f"<META HTTP-EQUIV=refresh content=\"3; URL='{v}'\">", f"<link href='{v}' class=z rel='x Canonical'/>"])
        pages.append(page(i, u, f"<html>{html}<!-- {canonical('http://c.net/p')} --><script>'{canonical('http://c.net/p')}'</script>"))
    pages += [page(200, None, canonical("http://c.net/")), page(201, ""), page(None, "http://c.net/x"), page(203, "mailto:x"), page(3, "http://a.com/k"), page(3, "http://a.com/k"), page(204, "http://" + "a." * 40_000 + "net/" + "p/" * 40_000, "<link " * 50_000)]
    df = spark.createDataFrame(pages, PAGES).repartition(4)
    got = urlfilter.judged(df, rules)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted([tuple(x) for x in got.collect()], key=str) == brute_verdicts(pages, links, listed)
    assert urlfilter.judged(df.limit(0), rules).count() == 0
    assert {x["verdict"] for x in urlfilter.judged(df, rules.limit(0)).collect()} == {"allow"}


def test_redirect_log_and_relative_links(spark):
    cases = [("../b/./c?x&amp;y=1", "z.org/b/c?x&y=1"), ("/q", "z.org/q"), ("?n=2", "z.org/en/k?n=2"), ("//W.net/a", "w.net/a"), ("t.html", "z.org/en/t.html"), ("..", "z.org/"), ("#x", None), ("", None), ("mailto:a@b", None), (" HTTPS://Q.org ", "q.org")]
    df = spark.createDataFrame([(i, "http://z.org/en/k?p=1", h, w) for i, (h, w) in enumerate(cases)], "i int, url string, href string, want string")
    for x in df.withColumn("to", urlfilter.resolved(F.col("url"), F.col("href"))).collect():
        assert (None if x["to"] is None else host_path(x["to"])[2]) == x["want"], x
    pages = spark.createDataFrame([page(i, f"http://h.org/{i}") for i in range(40)], PAGES)
    log = spark.createDataFrame([(f"http://h.org/{i}", f"http://h.org/{i + 1}") for i in range(30)] + [("http://h.org/30", "http://bad.net/"), (None, "http://h.org/35"), ("http://h.org/35", None)], "url string, target string")
    got = {x["page_id"]: x["verdict"] for x in urlfilter.judged(pages, urlfilter.rule_list(spark, queries.URL_RULES), log).collect()}
    assert got == {i: "block" if i <= 30 else "allow" for i in range(40)}
    with pytest.raises(ValueError):
        urlfilter.rule_list(spark, ["deny x/"])


def test_url_filter_runs_no_python(spark):
    rules = urlfilter.rule_list(spark, queries.URL_RULES)
    plan = urlfilter.judged(common.table(spark, SF, "pages"), rules)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_hot_components_and_joins(spark):
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(70)], "a long, b long")
    assert sorted(map(tuple, common.components(edges, hot=True).collect())) == sorted(map(tuple, common.components(edges).collect()))
    left = spark.range(70_000).select((F.col("id") % 3).alias("k"), "id").unionByName(spark.createDataFrame([(None, 1), (9, 2)], "k long, id long"))
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, v string")
    got = common.join_many_to_one(left, one, "k")
    assert got.exceptAll(left.join(one, "k", "left")).count() == 0 and got.count() == 70_002


# --- conversation trie -----------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, pos long, node string, level string, id string"


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes, kids, leaves, saved = collections.defaultdict(list), collections.defaultdict(list), {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = ((len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in below)
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[k] if len(built[c]) == len(k)))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k], sha(k)) for k, m in nodes.items()), key=str)


@pytest.fixture(scope="module")
def turns():
    r = random.Random(3)
    row = lambda c, t, role, text: (c, t, role, text, 5, "x", "x", "x")
    rows = [row(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(["a", "b", None, "é"])) for c in range(-7, 60) for t in range(r.choice([0, 1, 3, 8, 9, 20, 30]))]
    rows += [row(100 + i, t, "user", f"x{t}") for i in range(12) for t in range(45)] + [row(None, 1, "user", "x"), row(6, 0, "user", "long " * 50_000)]
    return rows + rows[:40]


@pytest.mark.parametrize("span", [1, 4, 32])
def test_trie_agrees_with_brute_force(spark, turns, span):
    df = spark.createDataFrame(turns, TURNS).repartition(5)
    got = sorted((tuple(x)[:8] for x in prefixtrie.conversation_trie(df, span).collect()), key=str)
    assert got == brute_trie(turns)


def test_trie_of_nothing(spark, turns):
    df = spark.createDataFrame(turns, TURNS)
    assert prefixtrie.conversation_trie(df.limit(0)).count() == 0
    assert prefixtrie.conversation_trie(df.where("conv_id IS NULL")).count() == 0


def test_radix_tree_layouts():
    r = random.Random(1)
    keys = {bytes(r.randrange(256) for _ in range(2 * r.randint(0, 4))) for _ in range(3000)} | {bytes([1, c]) for c in range(256)} | {b"", b"\x01\x01" * 400}
    tree = prefixtrie.RadixTree()
    for i, k in enumerate(sorted(keys, key=lambda k: (len(k) % 3, k[::-1]))):
        tree.put(k, k)
    want = collections.defaultdict(int)
    for k in keys:
        for d in range(0, len(k) + 1, 2):
            want[k[:d]] += 1
    got = dict(prefixtrie.turn_nodes(tree, 2, lambda values: sum(1 if isinstance(v, bytes) else v for v in values)))
    assert got == want
    kinds = {type(n.children).__name__ + str(getattr(n.children, "most", "")) for *_, n, after in tree.walk() if not after}
    assert {"Sorted4", "Sorted16", "Direct"} <= kinds
    wide = prefixtrie.Node(b"")
    for c in range(60):
        wide.set_child(c, prefixtrie.Node(b""))
        assert isinstance(wide.children, prefixtrie.Indexed) == (16 <= c < 48)
    assert [c for c, _ in wide.children.items()] == list(range(60))


# --- whitening -------------------------------------------------------------------------------------


def brute_whitened(rows, components):
    whole = [(i, [int(np.floor(64 * c)) + 1_000_000 for c in v]) for i, v in rows]
    n, wide = len(whole), max(len(v) for _, v in whole)
    x = np.array([v + [1_000_000] * (wide - len(v)) for _, v in whole], dtype=float)
    y = x - x.mean(axis=0)
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return [i for i, _ in whole], e, y @ v / np.sqrt(e), e / np.trace(y.T @ y / n), [sum(int(t) ** 2 for t in np.rint(n * d)) for d in y]


def test_whitening_agrees_with_dense_solution(spark):
    r = np.random.default_rng(5)
    mix = r.standard_normal((12, 12)) * np.linspace(3, 0.5, 12)
    good = [(i, row.tolist()) for i, row in enumerate(r.standard_normal((400, 12)) @ mix)]
    good += [(7, good[7][1]), (None, good[8][1]), (900, good[9][1][:9])]
    bad = [(500, None), (501, [*good[0][1][:11], None]), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, [-float("inf")] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in good + bad], "vec_id long, embedding array<double>, component int, v int").repartition(5)
    vectors = whitening.sound(df)
    got = collections.defaultdict(dict)
    for x in whitening.whiten(vectors, whitening.fitted(vectors, 8)).collect():
        assert x["n"] == 403 and x["identity_error"] < 1e-9
        got[x["vec_id"], x["deviation"]].setdefault(x["component"], []).append((x["whitened"], x["explained"]))
    ids, e, w, share, deviation = brute_whitened(good, 8)
    sign = [np.sign(got[0, deviation[0]][k + 1][0][0] * w[0, k]) for k in range(8)]
    for i, d, row in zip(ids, deviation, w, strict=True):
        assert len(got[i, d]) == 8
        for k in range(8):
            for value, part in got[i, d][k + 1]:
                assert abs(value - sign[k] * row[k]) < 1e-8 and abs(part - share[k]) < 1e-12


def test_whitening_without_spread(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(i, []) for i in range(3)], [(1, None)]):
        vectors = whitening.sound(spark.createDataFrame(rows, kind))
        assert whitening.whiten(vectors, whitening.fitted(vectors)).count() == 0
    vectors = whitening.sound(spark.createDataFrame([(i, [float(i), 5.0, -2.0 * i]) for i in range(6)], kind))
    rows = whitening.whiten(vectors, whitening.fitted(vectors)).collect()
    assert len(rows) == 6 and {x["component"] for x in rows} == {1} and max(x["identity_error"] for x in rows) < 1e-12
    huge = whitening.sound(spark.createDataFrame([(i, [i * 1e15, float(-i * i)]) for i in range(9)], "vec_id long, embedding array<double>"))
    rows = whitening.whiten(huge, whitening.fitted(huge)).collect()
    assert {x["deviation"] for x in rows} == {None, 3840**2} and max(x["identity_error"] for x in rows) < 1e-6


def test_counts_and_clusters():
    r = np.random.default_rng(0)
    a = r.standard_normal((200, 30))
    v = a.T @ a / 200
    e = np.linalg.eigvalsh(v)
    for shift in np.linspace(-0.1, e[-1] * 1.1, 60):
        assert whitening.count_above(v, shift) == (e > shift).sum()
    for v in (np.eye(6) * 2, np.diag([3.0, 3, 3, 1, 1, 1e-9]), np.ones((5, 5)), np.diag([1 + 1e-10, 1, 1 - 1e-10, 0.5])):
        pairs = [whitening.eigenpair(v, k) for k in range(1, len(v) + 1)]
        z = np.array([x for _, x in pairs])
        assert np.abs(z @ z.T - np.eye(len(v))).max() < 1e-12
        assert np.allclose([x for x, _ in pairs], np.linalg.eigvalsh(v)[::-1], atol=1e-12)
