"""URL filters: rules by host and path prefix; redirects and canonical links carry block decisions to aliases.

DataFrame functions only. A page's identity is its URL without scheme and fragment, host in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import bind
from evalspark.llm.common import components, cut_lineage, join_many_to_one, with_filter
from evalspark.session import broadcast_if_small

RULES = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)", 1), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z are lower-cased."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def identity(url: Column) -> Column:
    """128-bit digest of the URL without scheme and fragment, host in lower case; null where there is no host."""
    whole = lambda rest: F.concat(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return bind(_after(url), lambda rest: F.when(rest.rlike(r"^[^/?#]"), F.md5(whole(rest).cast("binary"))))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    step = lambda kept, p: (
        F.when(p == "..", F.when(F.size(kept) > 1, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(kept)).when(p == ".", kept).otherwise(F.concat(kept, F.array(p)))
    )
    open_end = F.element_at(parts, -1).isin(".", "..")
    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(F.contains(path, F.lit("/.")), F.when(open_end, F.concat(folded, F.lit("/"))).otherwise(folded)).otherwise(path)


def resolved(base: Column, href: Column) -> Column:
    """The absolute form of ``href`` on a page at ``base``; null for an empty one, a fragment, or another scheme than
    http and https."""
    return bind(F.replace(F.trim(href), F.lit("&amp;"), F.lit("&")), lambda h: _resolved(base, h))


def _resolved(base: Column, href: Column) -> Column:
    origin, path = F.concat(F.lit("x://"), host_of(base)), path_of(base)
    bare = F.regexp_extract(href, r"^[^?#]*", 0)
    query = F.substr(href, F.length(bare) + 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(?s)(.*/)?", 0))
    return (
        F.when((href == "") | F.startswith(href, F.lit("#")), F.lit(None))
        .when(href.rlike(r"^(?i)https?://"), href)
        .when(href.rlike(_SCHEME), F.lit(None))
        .when(F.startswith(href, F.lit("//")), F.concat(F.lit("x:"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, _without_dots(bare), query))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, bare)), query))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, in double, single or no quotes; empty where it is missing."""
    found = rf"(?i)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target) of each canonical link (``<link rel=canonical href=…>``) and redirect (``<meta http-equiv=refresh
    content="0; url=…">``) in a page, targets made absolute. Comments and scripts hold no links. Attributes come in
    any order and quoting; a page may have several."""
    text = F.col(html)
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", " "), r"(?is)<script\b.*?(?:</script|\z)", " ")
    tags = pages.where(F.col(url).isNotNull() & text.rlike(r"(?i)canonical|refresh")).select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(bare, F.lit(r"(?i)<(?:link|meta)\b[^<>]*+>"), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    canonical = tag.rlike(r"^(?i)<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    moved = tag.rlike(r"^(?i)<meta") & (F.lower(F.trim(_attribute(tag, "http-equiv"))) == "refresh")
    goal = F.regexp_extract(_attribute(tag, "content"), r"(?i)^\s*[\d.]*\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    links = tags.withColumn("href", F.when(canonical, _attribute(tag, "href")).when(moved, goal))
    return links.select("url", resolved(F.col("url"), F.col("href")).alias("target")).where("target IS NOT NULL")


class Rules:
    """Rules (host, path, verdict) made ready for lookup: ``paths`` has each rule, ``hosts`` the lengths of path that a
    host's rules have, both broadcast where they are small; ``depths`` the numbers of labels that hosts have."""

    def __init__(self, rules: DataFrame):
        host = F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER)
        paths = rules.groupBy(host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")).agg(F.min("verdict").alias("verdict"))
        paths = cut_lineage(paths)  # allow before block
        depth = F.when(F.col("rule_host") == "", F.lit(0)).otherwise(F.size(F.split("rule_host", r"\.")))
        hosts = paths.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("sizes"))
        self.depths = sorted(r[0] for r in paths.select(depth.alias("n")).distinct().collect())
        self.paths, self.hosts = broadcast_if_small(paths), broadcast_if_small(cut_lineage(hosts))


def ruled(urls: DataFrame, rules: Rules) -> DataFrame:
    """(host, path, rule, verdict) of each distinct (host, path) of ``urls`` that a rule fits.

    A rule fits its host and all subdomains, where the path starts with the rule's; a null host or path of a rule is
    empty, and an empty host fits every host. The longest rule wins; of equally long ones that with the longer host,
    then an allow. Each URL looks only for hosts with as many labels as some rule has, and on a host that has rules
    only for the lengths of path that its rules have: equi-joins, however many rules a host has.
    """
    if not rules.depths:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    have = F.when(F.col("host") == "", F.lit(0)).otherwise(F.size(F.split("host", r"\.")))
    tails = F.array_compact(F.array(*[F.when(have >= n, F.substring_index("host", ".", -n) if n else F.lit("")) for n in rules.depths]))
    asked = urls.select("host", "path", F.explode(tails).alias("rule_host"))
    asked = asked.join(rules.hosts, "rule_host").distinct()
    fitting = asked.select("host", "path", "rule_host", F.explode("sizes").alias("n")).where(F.length("path") >= F.col("n"))
    fitting = fitting.select("host", "path", "rule_host", F.expr("left(path, n)").alias("rule_path"))
    hits = fitting.join(rules.paths, ["rule_host", "rule_path"])
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("a"), F.length("rule_host").alias("b"), (F.col("verdict") == "allow").alias("c"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def alias_verdicts(links: DataFrame, rules: Rules) -> DataFrame:
    """(node, verdict) of each URL in a component of ``links`` (url, target) where a rule blocks or allows some member.

    Redirects and canonical links make two URLs one page, in both directions; connected components are its aliases.
    A component with an explicit allow is allowed, else one with a block is blocked. URLs that are only targets count.
    """
    ends = links.select(identity(F.col("url")).alias("a"), identity(F.col("target")).alias("b"), "url", "target").where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    ends = cut_lineage(ends.dropDuplicates(["a", "b"]))
    members = cut_lineage(components(ends, hot=True))
    named = ends.select(F.col("a").alias("node"), F.col("url").alias("u")).unionByName(ends.select(F.col("b").alias("node"), F.col("target").alias("u")))
    named = cut_lineage(named.groupBy("node").agg(F.min(F.struct(host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))).alias("at")).select("node", "at.host", "at.path"))
    own = named.join(ruled(named, rules), ["host", "path"]).select("node", "verdict")
    held = own.join(members, "node").groupBy("root").agg(F.min("verdict").alias("verdict"))  # allow before block
    return cut_lineage(join_many_to_one(members, held, "root").select("node", "verdict"))


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule and verdict of each row of ``pages``; ``rules`` has (host, path, verdict allow or block).

    A page that a rule fits has that rule's verdict. Any other page takes the verdict of its aliases: allow if one of
    them is explicitly allowed, block if one is blocked, else allow. Aliases are the connected component of its URL
    over canonical links and refresh redirects in the pages, and over ``redirects`` (url, target), for example a
    crawler's log. Repeated rows stay rows; a null or hostless URL has empty host and path, no aliases and is allowed
    (an empty host matches only rules without a host); null html has no links. An empty table gives none.
    """
    ready = Rules(rules)
    links = alias_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", resolved(F.col("url"), F.col("target")).alias("target")).where("target IS NOT NULL"))
    aliases = alias_verdicts(links, ready)
    u = F.col(url)
    rows = pages.select(F.col(key).alias("__key"), host_of(u).alias("host"), path_of(u).alias("path"), identity(u).alias("node"))
    own = ruled(rows.select("host", "path"), ready).withColumnRenamed("verdict", "own")
    out = rows.join(broadcast_if_small(own), ["host", "path"], "left")
    near = with_filter(out, aliases, "node", "__linked")
    linked = join_many_to_one(near.where("__linked"), aliases, "node")
    out = linked.unionByName(near.where("not __linked").withColumn("verdict", F.lit(None).cast("string")))
    return out.select(F.col("__key").alias(key), "host", "path", "rule", F.coalesce("own", "verdict", F.lit("allow")).alias("verdict"))


def rule_list(spark, lines: list[str]) -> DataFrame:
    """Rules from lines such as ``block net/`` or ``allow example.net/en/``: verdict, then host, then path."""
    rows = []
    for line in lines:
        verdict, _, place = line.strip().partition(" ")
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule begins with allow or block: {line!r}")
        host, slash, path = place.strip().partition("/")
        rows.append((host, slash + path, verdict))
    return spark.createDataFrame(rows, RULES)
