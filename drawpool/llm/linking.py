"""Connected groups from shared buckets, without pairs of all members.

``link`` takes bucket memberships and a verifier of pairs.  In each round a
bucket names leaders: one, then a few, then all that are left.  A leader meets
those members of its bucket that are not yet known to be in its component and
whose component is the smaller one, and buckets that hold one component alone
are done.  So a family of copies costs about one pair a member, few members
are left for the last round, and after it every pair of a bucket has either
been verified or is in one component: no link is lost, and nothing is capped.
Work tables are written to the shared folder between rounds; only whether
something is left reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Leaders that a bucket names in each round, about; None: all its members.
LEADERS = (1, 8, None)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of ``links`` (x, y); the component is
    its smallest node.

    Each turn every node hooks to its smallest neighbour and then to what that
    one hooked to, and the links are contracted to links between the hooks: at
    least half of the nodes of each component go, so a few turns leave none."""
    edges = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = None
    while True:
        near = written(edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "hooks")
        a, b = near.alias("a"), near.alias("b")
        hooks = written(a.join(b, F.col("a.m") == F.col("b.x")).select("a.x", "b.m"), "hooks")
        if labels is None:
            labels = hooks.select(F.col("x").alias("node"), F.col("m").alias("component"))
        else:
            labels = written(labels.join(hooks, labels["component"] == hooks["x"], "left").select("node", F.coalesce("m", "component").alias("component")), "labels")
        to = hooks.select(F.col("x").alias("y"), F.col("m").alias("n"))
        edges = written(edges.join(hooks, "x").join(to, "y").where("m <> n").select(F.col("m").alias("x"), F.col("n").alias("y")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _mixed(live: DataFrame) -> DataFrame:
    """The memberships of buckets that hold more than one component."""
    several = live.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    return live.join(several, "bucket")


def _named(live: DataFrame, comps: DataFrame) -> DataFrame:
    """``live`` with the component of each node and its size."""
    sizes = written(comps.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    named = written(comps.join(sizes, "component").select("node", F.col("component").alias("c"), "size"), "named")
    return (live.drop("c", "size").join(named, "node", "left")
            .withColumn("c", F.coalesce("c", "node")).withColumn("size", F.coalesce("size", F.lit(1).cast("bigint"))))


def link(members: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable | None = None, split: Callable[[DataFrame], DataFrame] | None = None,
         pairs: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes that verified links join.  ``members``
    has (bucket, node) and columns for ``near``, a condition on two members
    that any true link meets; ``verify`` keeps the true links of pairs (x, y);
    ``split`` puts what is left before the last round into smaller buckets in
    which every true link of a bucket is still together; ``pairs`` (x < y, each
    once, written) are verified before the first round."""
    carry = [c for c in members.columns if c not in ("bucket", "node")]
    live = members.withColumn("c", F.col("node")).withColumn("size", F.lit(1).cast("bigint"))
    links = comps = None
    tested = pairs
    if pairs is not None:
        found = written(verify(pairs), "links")
        if not found.isEmpty():
            links, comps = found, components(found)
            live = _named(live, comps)
    live = written(_mixed(live), "members")
    for turn, n in enumerate(LEADERS):
        if live.isEmpty():
            break
        if n is None and split is not None:
            live = written(_mixed(split(live)), "members")
        leaders = live
        if n is not None:
            slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(n))
            leaders = live.groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct("node", "c", "size", *carry)).alias("l")).select("bucket", "l.*")
        met = ((F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.c") != F.col("b.c"))
               & ((F.col("b.size") < F.col("a.size")) | (F.col("b.size") == F.col("a.size")) & (F.col("a.c") < F.col("b.c") if n is None else F.lit(True))))
        if near is not None:
            met &= near({c: F.col(f"a.{c}") for c in carry}, {c: F.col(f"b.{c}") for c in carry})
        pairs = leaders.alias("a").join(live.alias("b"), met).select(F.least("a.node", "b.node").alias("x"), F.greatest("a.node", "b.node").alias("y")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["x", "y"], "left_anti")
        pairs = written(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = written(verify(pairs), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comps = components(links)
        if n is not None and comps is not None:
            live = _named(live, comps)
            live = written(_mixed(live), "members")
    return comps if comps is not None else members.select("node", F.col("node").alias("component")).limit(0)
