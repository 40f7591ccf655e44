"""Group hierarchies: leaf lists, group scores and pooled standard errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.ordering import top_per_group
from evalspark.session import ensure_checkpoint_dir

def descendants(edges: DataFrame) -> DataFrame:
    """``(ancestor, node, depth, path)`` of every walk down a ``(parent, child)`` tree or graph without cycles.

    Walks double: those of 2^k steps, followed by all that are not longer, give all up to 2^(k+1), each once. So a
    chain of any depth takes about log2 of its depth rounds, without limits on depth or rows. A cycle, whose walks
    would not end, is an error that names nodes on it.
    """
    ensure_checkpoint_dir(edges.sparkSession)

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("ancestor").alias("node"), F.col("node").alias("_end"), F.col("depth").alias("_more"), F.col("path").alias("_rest"))
        tail = F.substr(F.col("_rest"), F.length("node") + 1)
        return a.join(b, "node").select("ancestor", F.col("_end").alias("node"), (F.col("depth") + F.col("_more")).alias("depth"), F.concat("path", tail).alias("path"))

    step = edges.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct()
    walks = longest = step.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("depth"), F.concat_ws(" > ", "parent", "child").alias("path")).checkpoint()
    while True:
        closed = [r[0] for r in walks.where("ancestor = node").select("node").distinct().limit(5).collect()]
        if closed:
            raise ValueError(f"groups form a cycle through {', '.join(map(str, sorted(closed)))}")
        if not longest.limit(1).count():
            return walks
        walks, longest = walks.unionByName(then(longest, walks)).checkpoint(), then(longest, longest).checkpoint()


def leaf_pairs(edges: DataFrame) -> DataFrame:
    """``(group, task)``: the leaves under every group."""
    inner = edges.select(F.col("parent").alias("node")).distinct()
    return descendants(edges).join(inner, "node", "left_anti").select(F.col("ancestor").alias("group"), F.col("node").alias("task")).distinct()


def pooled_stderr(stderr: Column, n: Column) -> Column:
    """Pooled standard error of subtasks; NULL if any of them has none."""
    var = F.sum((n - 1) * stderr * stderr * n) / (F.sum(n) - F.count(F.lit(1)))
    return F.when(F.count(stderr) == F.count(F.lit(1)), F.sqrt(var / F.sum(n)))


def group_scores(results: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Group values weighted by size and unweighted, with the pooled standard error.

    ``n`` is the summed size of the members that have the metric.
    """
    v, n, se = F.col("value"), F.col("n"), F.col("stderr")
    return (
        pairs.join(results, "task")
        .groupBy("group", *by)
        .agg(
            (F.sum(v * n) / F.sum(n)).alias("value"),
            F.avg(v).alias("unweighted"),
            pooled_stderr(se, n).alias("stderr"),
            F.sum(n).alias("n"),
            F.count(F.lit(1)).alias("n_tasks"),
        )
    )


def combined_stderr(results: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairwise fold of sizes, means and variances in task order (one entry per subtask).

    A task of one row has no error of its own and adds only its distance; a group of one row has none at all.
    """
    item = F.struct("task", F.col("value"), F.col("stderr"), F.col("n").cast("double").alias("n"))
    g = pairs.join(results, "task").groupBy("group", *by).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    first = F.element_at("xs", 1)
    start = F.struct(first["value"].alias("m"), F.coalesce(first["stderr"] * first["stderr"], F.lit(0.0)).alias("var"), first["n"].alias("n"))

    def fold(a: Column, x: Column) -> Column:
        n, mean = a["n"] + x["n"], (a["m"] * a["n"] + x["value"] * x["n"]) / (a["n"] + x["n"])
        var = ((a["n"] - 1) * a["var"] + (x["n"] - 1) * F.coalesce(x["stderr"] * x["stderr"], F.lit(0.0))) / (n - 1) + a["n"] * x["n"] / (n * (n - 1)) * (mean - x["value"]) * (mean - x["value"])
        return F.struct(mean.alias("m"), var.alias("var"), n.alias("n"))

    rest = F.slice(F.col("xs"), F.lit(2), F.size("xs"))
    whole = g.withColumn("_whole", F.aggregate(rest, start, fold))
    return whole.select("group", *by, F.when(F.col("_whole.n") > 1, F.sqrt("_whole.var")).alias("combined_stderr"))


def group_difference(results: DataFrame, pairs: DataFrame, by: list[str], order: Column) -> DataFrame:
    """First subtask's value minus the second's."""
    j = top_per_group(pairs.join(results, "task").withColumn("_o", order), ["group", *by], [F.col("_o")], 2)
    place = lambda k: F.max(F.when(F.col("rn") == k, F.col("value")))
    return j.groupBy("group", *by).agg((place(1) - place(2)).alias("difference"), F.max("rn").alias("_n")).where("_n = 2").drop("_n")


def direction_of(metrics: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether higher is better per group and metric; NULL where subtasks disagree."""
    h = F.col("higher_is_better")
    return pairs.join(metrics, "task").groupBy("group", "metric").agg(F.when(F.count_distinct(h) == 1, F.bool_and(h)).alias("higher_is_better"))


def repeated_leaves(edges: DataFrame) -> DataFrame:
    """Leaf tasks that hang under more than one direct parent."""
    inner = edges.select(F.col("parent").alias("child")).distinct()
    return edges.join(inner, "child", "left_anti").groupBy("child").agg(F.count_distinct("parent").alias("n_parents")).where(F.col("n_parents") > 1)
