"""Connected components by contraction: the links shrink from level to level, and each is read for two levels or so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import drop_written, written


def connected(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge, as a written table; label is the least id of the component.

    edges has long columns u and v, in one direction or both, with repeats or without; nothing of it goes to the
    driver but whether links are left.  At each level every id is replaced by that one of itself and its neighbours
    that comes first in a random order of the level, and links inside one id go.  A quarter of the ids or more go with
    them on average, whatever the shape of the graph, so all levels together make rows in proportion to the links, and
    their number grows as the logarithm of the ids.  An id with many links is a skewed side of a join, which AQE splits.
    The number of links bounds every table that follows, so that few links make few files, tasks and fetches.
    """
    u, v = F.col("u"), F.col("v")
    links = written(edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct())
    n = every = links.count()
    levels = []
    while True:
        first = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), c).alias("order"), c.alias("id"))  # noqa: B023, E731
        ends = links.select(u.alias("id"), first(v).alias("other")).union(links.select(v.alias("id"), first(u).alias("other")))
        level = written(ends.groupBy("id").agg(F.least(first(F.col("id")), F.min("other"))["id"].alias("next")), 2 * n)
        levels.append(level)
        of = lambda end: level.select(F.col("id").alias(end), F.col("next").alias(f"next_{end}"))  # noqa: B023, E731
        moved = links.join(of("u"), "u").join(of("v"), "v").filter("next_u <> next_v")
        left = written(moved.select(F.least("next_u", "next_v").alias("u"), F.greatest("next_u", "next_v").alias("v")).distinct(), n)
        drop_written(links)
        links = left
        n = links.count()
        if not n:
            break
    found = levels[-1]
    for level in levels[-2::-1]:  # ids whose links are gone before the last level keep their name
        after = found.select(F.col("id").alias("next"), F.col("next").alias("last"))
        found = level.join(after, "next", "left").select("id", F.coalesce("last", "next").alias("next"))
    found = written(found, 2 * every)
    labels = written(found.join(found.groupBy("next").agg(F.min("id").alias("label")), "next").select("id", "label"), 2 * every)
    for done in (links, found, *levels):
        drop_written(done)
    return labels
