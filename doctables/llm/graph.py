"""Connected components, and large groups of which only those are compared in blocks that their first member does not reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.sinks.stored import stored


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) for every vertex of the edges (a, b), by alternating large and small stars.

    Each round links a vertex's neighbours to the smallest of them, until the edges stay as they are: a star around each component's
    smallest vertex. A vertex may have any number of neighbours; its minimum is taken on the map side. Rounds grow with the logarithm of
    the longest path, and each is written to the shared folder.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").filter("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())


def in_blocks(members: DataFrame, group: str, member: str, size: int) -> DataFrame:
    """The members with the pairs of blocks (i, j) in which the ``far`` ones (a flag) are compared with all members of their group.

    A far member asks (``asks``) in every block of its group; every member answers where far ones ask. A group without far members is not
    compared at all. No task holds more than about ``size`` members that ask and ``size`` that answer, and a group of n members of
    which f are far is dealt out as about n * ceil(f / size) + f * n / size rows.
    """
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.count_if("far").alias("_f")).filter("_f > 0")
    sizes = sizes.select(group, F.ceil(F.col("_n") / size).cast("int").alias("_all"), F.ceil(F.col("_f") / size).cast("int").alias("_far"))
    placed = members.join(sizes, group)
    i, j = (F.pmod(F.xxhash64(F.col(member), F.lit(n)), F.col(n)).cast("int") for n in ("_far", "_all"))
    answers = F.transform(F.sequence(F.lit(0), F.col("_far") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("_all") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(True).alias("asks")))
    dealt = placed.withColumn("_at", F.explode(F.concat(answers, F.when(F.col("far"), asks).otherwise(F.slice(asks, 1, 0)))))
    return dealt.select(*members.columns, "_at.i", "_at.j", "_at.asks")
