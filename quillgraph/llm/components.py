"""Connected components of a link table, without gathering links or labels on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import cut

#: Ids under one label that a join by this label may put in one task. At most one label in so many ids has more.
HOT = 1_000_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) of every id that ``links`` names; nulls and self-links add nothing.

    Each round hooks every id, and the root it points to, under the smallest label next to it, then halves the
    paths; the rounds grow with the logarithm of the longest path. Each is written to the shared folder. Labels that
    over ``HOT`` ids carry, which are few, meet their own labels in a broadcast join, the others in a shuffle join.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(pairs.union(pairs.select("v", "u")).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).select(F.col("u").alias("id"), "c"))
    size = labels.count()
    while True:
        ends = both.join(labels.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
        ends = ends.where("cv < cu")
        told = ends.select(F.col("u").alias("id"), "cv").union(ends.select(F.col("cu").alias("id"), "cv")).groupBy("id").agg(F.min("cv").alias("m"))
        hooked = labels.join(told, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("m").isNotNull().alias("moved"))
        ups = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        hot = hooked.groupBy("c").count().where(F.col("count") > HOT).select("c")
        if size > HOT and (many := [r.c for r in hot.collect()]):
            often = F.broadcast(ups.where(F.col("c").isin(many)))
            jumped = hooked.where(F.col("c").isin(many)).join(often, "c", "left").union(hooked.where(~F.col("c").isin(many)).join(ups, "c", "left"))
        else:
            jumped = hooked.join(ups, "c", "left")
        after = cut(jumped.select("id", F.least("c", F.coalesce("up", "c")).alias("c"), (F.col("moved") | (F.col("up") < F.col("c"))).alias("moved")))
        labels = after.select("id", "c")
        if after.where("moved").isEmpty():
            return labels.select("id", F.col("c").alias("component"))
