"""Few-shot selection and prompt assembly.

No document ever meets the whole example pool: a random draw is an equi-join on pool positions, and
"first k" selections are reduced to a bounded number of examples before they meet the documents.
Every document stays; one whose group has no pool has an empty list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.draws import draw
from evalspark.operators.ordering import top_per_group, with_position
from evalspark.session import broadcast_if_small


def sample_places(key: Column, n: Column, k: int, seed: int) -> Column:
    """``min(k, n)`` different places below ``n``, each set of places equally likely.

    Draw i is a number up to n - k + i; where it is taken already, that upper end takes its place.
    """
    size = F.least(F.lit(k).cast("long"), n)
    steps = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(F.array().cast("array<bigint>"))

    def add(taken: Column, i: Column) -> Column:
        top = n - size + i
        place = draw(seed, key, i) % (top + 1)
        return F.concat(taken, F.array(F.when(F.array_contains(taken, place), top).otherwise(place)))

    return F.aggregate(steps, F.array().cast("array<bigint>"), add)


def draw_shots(docs: DataFrame, pool: DataFrame, key: str, group: list[str], k: int, seed: int, fields: list[str]) -> DataFrame:
    """``key, shots``: k pool rows of the document's group, drawn without replacement, never the document itself.

    The pool of a group is numbered; a document that is in the pool itself passes over its own number. Pools are
    small beside documents and are sent to all tasks when they are; else the join splits hot groups.
    """
    placed = with_position(pool.select(*group, key, *fields), [key], group, name="_pos").withColumnRenamed(key, "_pool_key")
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    own = placed.select(*group, F.col("_pool_key").alias(key), F.col("_pos").alias("_own"))
    known = docs.select(key, *group).join(broadcast_if_small(sizes, 100_000), group, "left").join(broadcast_if_small(own, 100_000), [*group, key], "left")
    others = F.coalesce("_n", F.lit(0)) - F.col("_own").isNotNull().cast("long")
    places = known.withColumn("_others", others).withColumn("_places", sample_places(F.col(key), F.col("_others"), k, seed))
    reads = places.select(key, *group, "_own", F.posexplode_outer("_places").alias("_j", "_at"))
    reads = reads.withColumn("_pos", F.col("_at") + F.coalesce(F.col("_at") >= F.col("_own"), F.lit(False)).cast("long"))
    shot = F.when(F.col("_pool_key").isNotNull(), F.struct(F.col("_j").alias("j"), F.col("_pool_key").alias("id"), *fields))
    joined = reads.join(broadcast_if_small(placed, 100_000), [*group, "_pos"], "left")
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(shot)).alias("shots"))


def sampled_shots(docs: DataFrame, pool: DataFrame, key: str, group: list[str], k: int, sampler: Callable[[Column], Column], fields: list[str]) -> DataFrame:
    """``key, shots`` by a user's own sampler: ``sampler`` makes a sort value from the key of a pool row, and every
    document gets the first k rows of its group by that value without itself."""
    head = top_per_group(pool.select(*group, key, *fields).withColumn("_by", sampler(F.col(key))), group, [F.col("_by"), F.col(key)], k + 1)
    return _from_heads(docs, head, key, group, k, fields)


def _from_heads(docs: DataFrame, head: DataFrame, key: str, group: list[str], k: int, fields: list[str]) -> DataFrame:
    shot = F.struct(F.col("rn").alias("j"), F.col(key).alias("id"), *fields)
    per_group = head.groupBy(*group).agg(F.array_sort(F.collect_list(shot)).alias("_head"))
    own = F.col(key)
    kept = F.filter("_head", lambda s: s["id"] != own)
    kind = per_group.schema["_head"].dataType.simpleString()
    return docs.select(key, *group).join(broadcast_if_small(per_group, 100_000), group, "left").select(key, F.coalesce(F.slice(kept, 1, k), F.array().cast(kind)).alias("shots"))


def first_shots(docs: DataFrame, pool: DataFrame, key: str, group: list[str], k: int, fields: list[str]) -> DataFrame:
    """``key, shots``: the first k pool rows of the group in source order without the document itself."""
    return _from_heads(docs, top_per_group(pool.select(*group, key, *fields), group, [F.col(key)], k + 1), key, group, k, fields)


def first_shots_shared(docs: DataFrame, pool: DataFrame, key: str, k: int) -> DataFrame:
    """``key, shot_ids`` from one canonical order for all documents: k+1 pool rows as literals."""
    head = [r[0] for r in pool.select(key).orderBy(key).limit(k + 1).collect()]
    ids = F.filter(F.array(*[F.lit(x) for x in head]), lambda x: x != F.col(key))
    return docs.select(key, F.slice(ids, 1, k).alias("shot_ids"))


def exclusion_head(pool: DataFrame, key: str, passage: str, link: str, k: int, fields: list[str]) -> DataFrame:
    """The pool rows that can be among the first k after removing any one passage and any one link.

    A row behind k others of its (passage, link) is never among them. Of what is left, a passage needs 2k rows, since one
    link takes at most k of them, and a link likewise; with 2k rows of one passage and 2k of one link removed, k of the
    first 5k remain. Each limit is applied inside the tasks before its shuffle, so a hot passage costs k rows a task.
    Rows with a null key, passage or link are never selected.
    """
    rows = pool.select(key, passage, link, *fields).dropna(subset=[key, passage, link])
    for group, n in (([passage, link], k), ([passage], 2 * k), ([link], 2 * k)):
        place = F.row_number().over(Window.partitionBy(*group).orderBy(key, passage, link))
        rows = rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
    return rows.orderBy(key, passage, link).limit(5 * k)


def first_shots_excluding(docs: DataFrame, pool: DataFrame, key: str, passage: str, link: str, k: int) -> DataFrame:
    """``key, shot_ids``: first k pool rows that share neither id, passage nor link with the document."""
    head = exclusion_head(pool, key, passage, link, k + 1, []).orderBy(key).collect()
    if not head:
        return docs.select(key, F.array().cast("array<bigint>").alias("shot_ids"))
    items = F.array(*[F.struct(F.lit(r[0]).alias("id"), F.lit(r[1]).alias("p"), F.lit(r[2]).alias("l")) for r in head])
    ok = F.filter(items, lambda s: (s["id"] != F.col(key)) & (s["p"] != F.col(passage)) & (s["l"] != F.col(link)))
    return docs.select(key, F.slice(F.transform(ok, lambda s: s["id"]), 1, k).alias("shot_ids"))


def bad_demonstrations(selected: DataFrame, key: str, k: int) -> DataFrame:
    """Documents without exactly k demonstrations, or with themselves among them."""
    ids = F.transform("shots", lambda s: s["id"])
    return selected.select(key, F.size("shots").alias("n_shots"), F.array_contains(ids, F.col(key)).alias("has_self")).where(
        (F.col("n_shots") != k) | F.col("has_self")
    )


def leaked_rows(test: DataFrame, dev: DataFrame, on: list[Column]) -> DataFrame:
    """Test rows whose content (question, choices) also occurs in the development split."""
    digest = F.sha2(F.to_json(F.array(*[c.cast("string") for c in on])), 256)
    return test.withColumn("_h", digest).join(dev.select(digest.alias("_h")).distinct(), "_h", "left_semi").drop("_h")


def labelled_context(shots: Column, text: str, target: str, delimiter: str = " ", prefix: str = "", separator: str = "\n\n") -> Column:
    """Solved examples as text: input, delimiter, prefix, target, separator; a blank target adds nothing."""

    def one(s: Column) -> Column:
        answer = F.when(s[target] != "", F.concat(F.lit(delimiter), F.lit(prefix + " " if prefix else ""), s[target], F.lit(separator)))
        return F.concat(s[text], F.coalesce(answer, F.lit("")))

    return F.array_join(F.transform(shots, one), "")


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_context(shots: Column, text: str, target: str, question: Column, system: Column | None = None,
                 multiturn: bool = False, prefix: str = "") -> Column:
    """``array<struct<role, content>>``: system turn, examples, and the question.

    Examples are user/assistant turns when ``multiturn``; otherwise one user turn that holds them
    as text and to which the question is appended.
    """
    head = F.array(turn("system", system)) if system is not None else F.array().cast("array<struct<role:string,content:string>>")
    lead = prefix + " " if prefix else ""
    if multiturn:
        turns = F.flatten(F.transform(shots, lambda s: F.array(turn("user", s[text]), turn("assistant", F.concat(F.lit(lead), s[target])))))
        return F.concat(head, turns, F.array(turn("user", question)))
    return F.concat(head, F.array(turn("user", F.concat(labelled_context(shots, text, target, prefix=prefix), question))))


def conversation_prompt(story: Column, questions: Column, answers: Column) -> Column:
    """Story, then question/answer turns; the last answer is withheld."""
    n = F.size(questions)
    turns = F.transform(
        questions,
        lambda q, i: F.concat(
            F.lit("Q: "), q, F.lit("\n\n"),
            F.when(i < n - 1, F.concat(F.lit("A: "), F.element_at(answers, i + 1), F.lit("\n\n"))).otherwise("A:"),
        ),
    )
    return F.concat(story, F.lit("\n\n"), F.array_join(turns, ""))


def blank_split(sentence: Column, option: Column) -> tuple[Column, Column]:
    """Fill-in-the-blank: text before ``_`` with the option put in, and the text after it."""
    at = F.instr(sentence, "_")
    before = F.concat(F.substring(sentence, F.lit(1), at - 1), option)
    return before, F.trim(F.substring(sentence, at + 1, F.length(sentence)))
