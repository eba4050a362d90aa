"""Components of nodes that are alike, found through keys that alike nodes share.

Nodes of an equal key form a bucket. In each bucket every member is compared with one hub, first the member that meets
the most others in all its buckets, which is the likely origin of a group of copies, then one by chance; linked nodes
merge into components. A pair in a bucket whose two ends are still in different components after that is compared too,
so that no link between different nodes is lost, yet pairs within a component are never made. Large buckets are
dealt to many tasks for that last step: a member stands in one share of its bucket and visits every other.

Components found earlier are contracted: later links are edges between their roots alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, materialize

#: Members of a share of a bucket.
SHARE = 512


def connected(edges: DataFrame, write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """node, root: components of the edges (a, b) by alternating large and small stars; root is the least node."""
    with Scratch() as hold:
        edges = hold(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

        def star(e: DataFrame, large: bool) -> DataFrame:
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
            # written, so that both sides of the join come straight from a shuffle and adaptive execution can split a hub
            least = hold(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
            joined = both.join(least, "u")
            if large:
                out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            return out.where("u != v").distinct()

        state = None
        while True:
            edges = hold(star(hold(star(edges, True)), False))
            hold.drop(*hold.tables[:-1])
            now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
        return write(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct()))


def merged(roots: DataFrame | None, links: DataFrame, hold: Scratch) -> DataFrame | None:
    """node, root with the components that further links (a, b) join; the links go between roots."""
    if links.isEmpty():
        return roots
    if roots is None:
        return connected(links, hold)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    edges = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    moved = connected(edges, hold)
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return hold(old.unionByName(moved.join(roots.select("node"), "node", "left_anti")))


def bucketed(members: DataFrame, payload: DataFrame, hold: Scratch) -> DataFrame:
    """Rows of members (set_id, key) whose key several nodes have, with the columns of payload (a row a set_id) and met, the places that a node meets others or itself in.

    Most keys belong to one node, so rows are moved without their payload until that is known.
    """
    several = hold(members.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1"))
    rows = hold(members.join(several.hint("merge"), "key"))
    met = rows.groupBy("set_id").agg(F.sum("in_bucket").alias("met"))
    out = hold(rows.select("set_id", "key").join(payload, "set_id").join(met, "set_id"))
    hold.drop(several, rows)
    return out


def link(rows: DataFrame, payload: list[str], may: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], refine: Callable | None = None, write: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """node, root of all nodes that have a link; root is a component's least node.

    rows: set_id, key, met and payload, of bucketed(). may(x, y): whether rows of these aliases can be
    alike. verify(pairs): a, b, linked for pairs (a, b). refine(rows, hubs, first): rows with further columns for the last
    step and a further condition on rows x and y, from the hubs (key, hub) and the verified pairs of the first step.
    """
    with Scratch() as hold:
        roots = tested = first = origins = None
        for turn in range(3):
            now = rows
            if turn:
                if roots is not None:
                    now = hold(rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")))
                else:
                    now = rows.withColumn("root", F.col("set_id"))
                undone = hold(now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo != hi").select("key", F.ceil(F.col("m") / SHARE).cast("int").alias("shares")))
                now = now.join(undone, "key")
            if turn < 2:
                order = F.struct(-F.col("met"), "set_id") if turn == 0 else F.struct(F.xxhash64("set_id", "key"), "set_id")
                hub = F.struct("set_id", *payload, *(["root"] if turn else []))
                hubs = hold(now.groupBy("key").agg(F.min_by(hub, order).alias("hub")).select("key", "hub.*"))
                if turn == 0:
                    origins = hubs.select("key", F.col("set_id").alias("hub"))
                other = F.col("x.root") != F.col("y.root") if turn else F.col("x.set_id") != F.col("y.set_id")
                pairs = now.alias("x").join(hubs.alias("y"), "key").where(other & may("x", "y"))
            else:
                own, more = refine(now, origins, first) if refine else (now, F.lit(True))
                own = hold(own)
                one = own.withColumn("share", F.pmod(F.xxhash64("set_id"), F.col("shares").cast("long")).cast("int"))
                all_ = own.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
                pairs = one.alias("x").join(all_.alias("y"), ["key", "share"]).where((F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.root") != F.col("y.root")) & may("x", "y") & more)
            pairs = hold(pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct())
            if turn:
                pairs = hold(pairs.join(tested, ["a", "b"], "left_anti"))
            result = hold(verify(pairs))
            first = first if turn else result
            tested = result.select("a", "b") if turn == 0 else tested.union(result.select("a", "b"))
            roots = merged(roots, result.where("linked").select("a", "b"), hold)
        return write(roots if roots is not None else rows.sparkSession.createDataFrame([], "node binary, root binary"))
