"""Conversation prefix trie: adaptive radix trees over fixed-width big-endian turn ids, built shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import cut_lineage, join_many_to_one

#: Bytes of a turn id: the first 128 bits of the SHA-256 of a turn's role and text, read as a big-endian number.
WIDTH = 16
#: Turns of a key. A longer conversation goes on in keys of further levels, whose trees hang on the node before.
SPAN = 32


# --- adaptive radix tree ---------------------------------------------------------------------------


class Sorted:
    """Up to ``most`` children, bytes in order."""

    __slots__ = ("most", "names", "nodes")

    def __init__(self, most: int):
        self.most, self.names, self.nodes = most, bytearray(), []

    def get(self, c: int):
        at = self.names.find(c)
        return self.nodes[at] if at >= 0 else None

    def put(self, c: int, node) -> bool:
        """Set a child; false where the layout is full."""
        at = self.names.find(c)
        if at >= 0:
            self.nodes[at] = node
            return True
        if len(self.names) == self.most:
            return False
        at = sum(x < c for x in self.names)
        self.names.insert(at, c)
        self.nodes.insert(at, node)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return zip(self.names, self.nodes, strict=True)


class Indexed:
    """Up to 48 children, found through a table of 256 places."""

    __slots__ = ("places", "nodes")

    def __init__(self):
        self.places, self.nodes = bytearray(b"\xff" * 256), []

    def get(self, c: int):
        at = self.places[c]
        return self.nodes[at] if at != 255 else None

    def put(self, c: int, node) -> bool:
        at = self.places[c]
        if at != 255:
            self.nodes[at] = node
        elif len(self.nodes) == 48:
            return False
        else:
            self.places[c] = len(self.nodes)
            self.nodes.append(node)
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((c, self.nodes[at]) for c, at in enumerate(self.places) if at != 255)


class Direct:
    """A place for each of the 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, c: int):
        return self.nodes[c]

    def put(self, c: int, node) -> bool:
        self.nodes[c] = node
        return True

    def items(self) -> Iterator[tuple[int, object]]:
        return ((c, n) for c, n in enumerate(self.nodes) if n is not None)


class Node:
    """``prefix``: the bytes that all keys below share from here on; ``value``: that of the key that ends after it."""

    __slots__ = ("prefix", "value", "children")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value, self.children = prefix, value, None

    def child(self, c: int):
        return self.children.get(c) if self.children is not None else None

    def set_child(self, c: int, node: Node) -> None:
        """Set a child and, where the layout is full, go on to the next larger one."""
        if self.children is None:
            self.children = Sorted(4)
        while not self.children.put(c, node):
            old = self.children
            self.children = Sorted(16) if isinstance(old, Sorted) and old.most == 4 else Indexed() if isinstance(old, Sorted) else Direct()
            for name, kept in old.items():
                self.children.put(name, kept)


class RadixTree:
    """Keys to values. A path without branches is one node; keys may be prefixes of each other."""

    def __init__(self):
        self.root = Node(b"")

    def put(self, key: bytes, value) -> None:
        node, above, at = self.root, None, 0
        while True:
            own, rest = node.prefix, key[at : at + len(node.prefix)]
            if own != rest:
                same = next((i for i, (x, y) in enumerate(zip(own, rest)) if x != y), len(rest))
                fork = Node(own[:same])
                node.prefix = own[same + 1 :]
                fork.set_child(own[same], node)
                above.set_child(key[at - 1], fork)
                node = fork
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            above, below = node, node.child(key[at])
            if below is None:
                node.set_child(key[at], Node(key[at + 1 :], value))
                return
            node, at = below, at + 1

    def walk(self) -> Iterator[tuple[bytes, bytes, Node, bool]]:
        """Every node twice, before and after its children: (bytes above it, its own bytes, node, whether after). The
        own bytes begin with the one that its parent branches on."""
        stack = [(b"", self.root.prefix, self.root, False)]
        while stack:
            above, own, node, after = stack.pop()
            yield above, own, node, after
            if not after:
                stack.append((above, own, node, True))
                if node.children is not None:
                    here = above + own
                    stack += [(here, bytes([c]) + n.prefix, n, False) for c, n in node.children.items()]


def turn_nodes(tree: RadixTree, width: int, add) -> Iterator[tuple[bytes, object]]:
    """(key bytes, total) of every depth that is a whole number of turns; a total is what ``add`` makes of the values
    of all keys that begin with these bytes. Depths inside a turn, where trees branch as well, give nothing."""
    totals: list[list] = [[]]
    for above, own, node, after in tree.walk():
        if not after:
            totals.append([] if node.value is None else [node.value])
            continue
        total = add(totals.pop())
        totals[-1].append(total)
        first = len(above) + (1 if above or own else 0)
        whole = above + own
        for at in range(-(-first // width) * width, len(whole) + 1, width):
            yield whole[:at], total


# --- conversations as keys -------------------------------------------------------------------------


def running(df: DataFrame, group: str, order: list, sums: dict[str, F.Column], keep: list[str]) -> DataFrame:
    """``keep`` and, for each of ``sums``, the total of all earlier rows of the group in ``order`` (null for none).

    Rows are range-partitioned, so a group with a third of all rows is dealt over many tasks; only groups that go on
    from one partition to the next need a carry, at most one for each partition.
    """
    keys = [F.col(group), *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.select(*dict.fromkeys([group, *keep]), "__at", *[c.alias(f"__v_{n}") for n, (_, c) in sums.items()]))
    part = F.shiftright("__at", 33)
    total = placed.groupBy(part.alias("__part"), group).agg(*[f(f"__v_{n}").alias(f"__t_{n}") for n, (f, _) in sums.items()])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = total.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(group)
    carry = total.join(spans, group, "left_semi").select("__part", group, *[f(f"__t_{n}").over(before).alias(f"__c_{n}") for n, (f, _) in sums.items()])
    carry = cut_lineage(carry)
    inside = Window.partitionBy("__part", group).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__part", part).join(F.broadcast(carry), ["__part", group], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = lambda f, a, b: zero(a).bitwiseXOR(zero(b)) if f is F.bit_xor else zero(a) + zero(b)
    return out.select(*dict.fromkeys([group, *keep]), *[both(f, F.col(f"__c_{n}"), f(f"__v_{n}").over(inside)).alias(n) for n, (f, _) in sums.items()])


def turns_of(df: DataFrame) -> DataFrame:
    """(conv_id, pos, id, size) of each row: place in its conversation from 0, turn id in hex, bytes of its text.

    Order is by turn, null first, then role and text, so tied and repeated rows have a place; null role and text are
    empty. Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.substring(F.sha2(name.cast("binary"), 256), 1, 2 * WIDTH).alias("id"), F.octet_length(text).cast("long").alias("size"),
    )
    return running(rows, "conv_id", [F.col("turn"), F.col("role"), F.col("text")], {"pos": (F.sum, F.lit(1))}, ["id", "size"])


def forked(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """(conv_id, pos, id, size) of rebuilt conversations: conversation c takes the first h turns of conversation
    c - c % every (all if it has fewer, none if it is absent), then its own turns from the h-th on;
    h = crc32(c) % most."""
    share = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = cut_lineage(turns.groupBy("conv_id").agg(F.max("pos").alias("last")))
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    lengths = convs.select(F.col("conv_id").alias("base"), (F.col("last") + 1).alias("n"))
    forks = convs.select("conv_id", base.alias("base"), share.alias("h")).join(lengths, "base", "left")
    head = forks.join(heads, "base").where(F.col("pos") < F.col("h")).select("conv_id", "pos", "id", "size")
    shift = cut_lineage(forks.select("conv_id", (F.least(F.coalesce("n", F.lit(0)), "h") - F.col("h")).alias("shift")))
    own = join_many_to_one(turns.where(F.col("pos") >= share), shift, "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "id", "size")
    return head.unionByName(own)


def segments(turns: DataFrame, convs: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, level, root, key, sizes, next): the turns of each conversation in keys of ``span`` turns.

    ``root`` names the sequence of all turns before the key and ``next`` that up to its end where it is full, by
    digests that are combined along the conversation, so no conversation is ever gathered in one place. Every
    conversation has a key of level 0, which is empty where it has no turns.
    """
    turn = F.sort_array(F.collect_list(F.struct("pos", "id", "size")))
    level = F.floor(F.col("pos") / span).cast("long")
    cut = turns.groupBy("conv_id", level.alias("level")).agg(turn.alias("t"))
    cut = cut.select("conv_id", "level", F.array_join("t.id", "").alias("key"), F.col("t.size").alias("sizes"))
    bare = convs.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("level"), F.lit("").alias("key"), F.array().cast("array<bigint>").alias("sizes"))
    lanes = {"x1": F.xxhash64("level", "key"), "x2": F.xxhash64(F.lit(7), "level", "key")}
    cut = running(cut.unionByName(bare), "conv_id", [F.col("level")], {n: (F.bit_xor, c) for n, c in lanes.items()}, ["level", "key", "sizes"])
    name = lambda lev, a, b: F.md5(F.concat_ws(":", lev.cast("string"), a.cast("string"), b.cast("string")).cast("binary"))
    root = name(F.col("level"), F.col("x1"), F.col("x2"))
    after = name(F.col("level") + 1, F.col("x1").bitwiseXOR(lanes["x1"]), F.col("x2").bitwiseXOR(lanes["x2"]))
    return cut_lineage(cut.select("conv_id", "level", root.alias("root"), "key", "sizes", F.when(F.size("sizes") == span, after).alias("next")))


def _trees(rows: DataFrame, pick, emit, schema: str) -> DataFrame:
    """One radix tree for each root of each range partition of ``rows`` (root, key, next, …), keys distinct.

    Keys are dealt by range of (root, key), so the root that all conversations share is spread over all tasks, and
    each task holds a tree of its own range alone. Nodes on the border of two ranges come once from each; their
    partial totals add up.
    """
    placed = rows.repartitionByRange("root", "key").sortWithinPartitions("root", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, tree = None, None
        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                if r["root"] != root:
                    if tree is not None:
                        out += emit(root, tree)
                    root, tree = r["root"], RadixTree()
                tree.put(bytes.fromhex(r["key"]), pick(r))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if tree is not None:
            out = []
            for x in emit(root, tree):
                out.append(x)
                if len(out) == 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return cut_lineage(placed.mapInArrow(run, schema))


def _name(root: str, key: bytes, after: str | None, full: int) -> str:
    return root if not key else after if len(key) == full else hashlib.md5(root.encode() + key).hexdigest()


def trie_nodes(keys: DataFrame, span: int = SPAN) -> DataFrame:
    """(node, parent, depth, n_convs, conv_id, size) of every node, from (root, level, key, sizes, next, n, low)."""
    full = span * WIDTH

    def pick(r: dict) -> tuple:
        return r["n"], r["low"], r["sizes"], r["level"], r["next"]

    def add(values: list[tuple]) -> tuple:
        longest = max(values, key=lambda v: len(v[2]))
        return sum(v[0] for v in values), min(v[1] for v in values), longest[2], longest[3], longest[4]

    def emit(root: str, tree: RadixTree) -> Iterator[dict]:
        for key, (n, low, sizes, level, after) in turn_nodes(tree, WIDTH, add):
            d = len(key) // WIDTH
            if d or not level:
                parent = _name(root, key[:-WIDTH], None, full) if d else None
                yield {"node": _name(root, key, after, full), "parent": parent, "depth": level * span + d, "n_convs": n, "conv_id": low, "size": sizes[d - 1] if d else 0}

    parts = _trees(keys, pick, emit, "node string, parent string, depth long, n_convs long, conv_id long, size long")
    return parts.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("size").alias("size"))


def subtree_sums(keys: DataFrame, span: int = SPAN) -> DataFrame:
    """(node, saved_tokens, n_leaves) of every node, from (root, level, key, next, here, saved, leaves).

    Each node's own saving, and each leaf, is held by its least member alone: ``here`` has (depth in the key, saving,
    leaf) of the nodes that members of the key hold in it, ``saved`` and ``leaves`` what they hold further down. A
    subtree's sum is then that of what all members of its top hold from there on, which needs no walk up the trie.
    """
    full = span * WIDTH

    def pick(r: dict) -> tuple:
        sums = np.zeros((2, span + 1), dtype=np.int64)
        for h in r["here"]:
            sums[:, h["d"]] += (h["saving"], h["leaf"])
        sums = sums[:, ::-1].cumsum(axis=1)[:, ::-1]
        return sums + np.array([[r["saved"]], [r["leaves"]]]), len(r["key"]) // 2, r["level"], r["next"]

    def add(values: list[tuple]) -> tuple:
        longest = max(values, key=lambda v: v[1])
        return sum(v[0] for v in values), *longest[1:]

    def emit(root: str, tree: RadixTree) -> Iterator[dict]:
        for key, (sums, _, level, after) in turn_nodes(tree, WIDTH, add):
            d = len(key) // WIDTH
            if d or not level:
                yield {"node": _name(root, key, after, full), "saved_tokens": int(sums[0, d]), "n_leaves": int(sums[1, d])}

    parts = _trees(keys, pick, emit, "node string, saved_tokens long, n_leaves long")
    return parts.groupBy("node").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))


def _ends(segs: DataFrame, span: int) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: their ids in order, joined by commas, fed to the digest as
    they come. A node where very many end is a single stream, which the digest forces, in bounded memory."""
    key = F.unhex("key")
    node = F.when(F.col("key") == "", F.col("root")).otherwise(F.coalesce("next", F.md5(F.concat(F.col("root").cast("binary"), key))))
    last = segs.groupBy("conv_id").agg(F.max_by(node, "level").alias("node"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done: list[dict] = []
            for name, conv in zip(b["node"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if name != node:
                    if node is not None:
                        done.append({"node": node, "ends_sha256": digest.hexdigest()})
                    node, digest = name, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done)
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": digest.hexdigest()}])

    return last.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node string, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, span: int = SPAN) -> DataFrame:
    """Nodes of the trie of conversations: ``turns`` (conv_id, pos, id, size) and all ``convs`` (conv_id).

    A node is a distinct sequence of first turns; columns: conv_id (least member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves and saved_tokens over its subtree, ends_sha256 of the conversations that end
    in it, size (bytes of its last text). Conversations without turns end in the root. No conversations: no rows.
    """
    segs = segments(turns, convs, span)
    keys = cut_lineage(segs.groupBy("root", "key").agg(*[F.first(c).alias(c) for c in ("level", "sizes", "next")], F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low")))
    nodes = cut_lineage(trie_nodes(keys, span))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("size")))
    # a node lies in the level of the key that ends in or after it: depth 0 to span in level 0, span + 1 on in level 1
    level = F.floor((F.greatest(F.col("depth"), F.lit(1)) - 1) / span).cast("long")
    held = nodes.select("conv_id", level.alias("level"), F.struct((F.col("depth") - level * span).cast("int").alias("d"), "saving", (F.col("n_children") == 0).cast("int").alias("leaf")).alias("h"))
    held = held.groupBy("conv_id", "level").agg(F.collect_list("h").alias("here"), F.sum("h.saving").alias("saving"), F.sum("h.leaf").alias("leaf"))
    own = segs.select("conv_id", "level", "root", "key").join(held, ["conv_id", "level"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    below = running(own, "conv_id", [F.col("level").desc()], {"saved": (F.sum, zero(F.col("saving"))), "leaves": (F.sum, zero(F.col("leaf")))}, ["root", "key", "here"])
    weights = below.groupBy("root", "key").agg(F.flatten(F.collect_list("here")).alias("here"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    sums = subtree_sums(keys.select("root", "key", "level", "next").join(weights, ["root", "key"]), span)
    tops = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = join_many_to_one(nodes, tops, "parent").join(sums, "node").join(_ends(segs, span), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "size")


def conversation_trie(df: DataFrame, span: int = SPAN) -> DataFrame:
    """The trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text); see ``turns_of``, ``forked`` and
    ``prefix_trie``. Other columns have no part in it."""
    turns = cut_lineage(turns_of(df))
    convs = cut_lineage(turns.select("conv_id").distinct())
    return prefix_trie(cut_lineage(forked(turns)), convs, span)
