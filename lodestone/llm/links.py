"""Problem 7: consolidating pairwise matches into groups.

Method: random contraction. In each round every vertex hooks to the vertex of its closed neighbourhood that comes
first in a hash order made afresh for the round; edges are relabelled by the hooks and deduplicated; rounds repeat
until no edge is left, and the hooks are then expanded from the last round to the first. A round removes at least a
quarter of the vertices on average whatever the graph's shape, so long chains need logarithmically many rounds.
Every round's edges and hooks are written tables, so no round depends on the executors of an earlier one.

Defined cases: an edge with a null end or with two equal ends links nothing; repeated and turned-round edges count
once; vertices without a link to another are not in the result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut


def components(edges: DataFrame, left: str = "left_id", right: str = "right_id", seed: int = 17, max_rounds: int = 200) -> DataFrame:
    """Every linked vertex (``id``) with the smallest vertex of its component (``group_id``)."""
    tidy = edges.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v"), F.col(left).alias("l"), F.col(right).alias("r"))
    now = cut(tidy.where("l is not null and r is not null and u <> v").select("u", "v").distinct())
    hooks: list[DataFrame] = []
    while not now.isEmpty():
        if len(hooks) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        order = lambda c, k=seed + len(hooks): F.xxhash64(F.lit(k), c)
        ways = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        first = ways.groupBy("x").agg(F.min(F.struct(order(F.col("y")).alias("h"), F.col("y"))).alias("n"))
        own = F.struct(order(F.col("x")).alias("h"), F.col("x").alias("y"))
        hook = cut(first.select("x", F.least(F.col("n"), own)["y"].alias("to")))
        hooks.append(hook)
        a = hook.select(F.col("x").alias("u"), F.col("to").alias("a"))
        b = hook.select(F.col("x").alias("v"), F.col("to").alias("b"))
        moved = now.join(a, "u").join(b, "v").where("a <> b")
        now = cut(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not hooks:
        return now.select(F.col("u").alias("id"), F.col("v").alias("group_id"))
    roots = hooks[-1].select("x", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = roots.select(F.col("x").alias("to"), F.col("root").alias("later"))
        roots = hook.join(later, "to", "left").select("x", F.coalesce("later", "to").alias("root"))
    roots = cut(roots)
    smallest = roots.groupBy("root").agg(F.min("x").alias("group_id"))
    return roots.join(smallest, "root").select(F.col("x").alias("id"), "group_id")


def match_links(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links between canonical ids: pairs judged a match, and ids that share a hash which is neither null nor empty.

    Ids under one hash are tied to the smallest of them (a star), never to each other in all pairs.
    """
    judged = pairs.where("is_match").select("left_id", "right_id")
    under = rows.where("exact_question_hash <> '' and canonical_question_id is not null").select(F.col("exact_question_hash").alias("h"), F.col("canonical_question_id").alias("id")).distinct()
    centre = under.groupBy("h").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = under.join(centre, "h").where("id <> c").select(F.col("c").alias("left_id"), F.col("id").alias("right_id"))
    return judged.union(stars)
