"""Operations on a forest of nodes (id, parent_id)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def children(nodes: DataFrame, order: str = "id") -> DataFrame:
    """(id, children): each parent's children as an ordered array."""
    kids = nodes.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("id").alias("id")))).alias("c"))
    return kids.select(F.col("parent_id").alias("id"), F.transform("c", lambda x: x["id"]).alias("children"))


def ancestors(nodes: DataFrame, hits: DataFrame, *, stop_kind: str | None = "literal") -> DataFrame:
    """(id, ancestor, distance) of every hit, however deep; a parent of ``stop_kind`` ends the climb.

    Each level is one join on the frontier, which shrinks; the loop ends when no row
    is left.  Parents that form a ring are no forest: ValueError.
    """
    links = nodes.select(F.col("id").alias("_id"), F.col("parent_id").alias("_up"))
    kinds = nodes.select(F.col("id").alias("_up"), F.col("kind").alias("_kind"))
    links = links.filter("_up IS NOT NULL").join(kinds, "_up")
    if stop_kind is not None:
        links = links.filter(F.col("_kind") != stop_kind)
    links = links.select("_id", "_up").cache()
    most = links.count()
    front = hits.select("id", F.col("id").alias("at"))
    found = []
    for level in count(1):
        if level > most + 1:
            raise ValueError("parents form a ring")
        front = front.join(links, F.col("at") == F.col("_id")).select("id", F.col("_up").alias("at"))
        front = front.cache()
        if front.isEmpty():
            break
        found.append(front.select("id", F.col("at").alias("ancestor"), F.lit(level).alias("distance")))
    if not found:
        return hits.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")).filter(F.lit(False))
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out


def without_parents(hits: DataFrame) -> DataFrame:
    """Hits (id, parent_id) that aren't the parent of another hit."""
    return hits.join(hits.select(F.col("parent_id").alias("_p")).filter("_p IS NOT NULL"), F.col("id") == F.col("_p"), "left_anti")


def with_children(nodes: DataFrame, hits: DataFrame, literal: str = "literal") -> DataFrame:
    """Hits and the direct children of those that aren't literals, without rows whose parent is there too."""
    open_hits = hits.filter(F.col("kind") != literal).select(F.col("id").alias("_p"))
    kids = nodes.join(open_hits, F.col("parent_id") == F.col("_p"), "left_semi")
    both = hits.select(*nodes.columns).unionAll(kids.select(*nodes.columns)).dropDuplicates(["id"])
    return both.join(hits.select(F.col("id").alias("_h")), F.col("parent_id") == F.col("_h"), "left_anti")


def expand_hits(nodes: DataFrame, hits: DataFrame, limit: int | None = None, literal: str = "literal") -> DataFrame:
    """The result of a search as it is shown, with the ``children`` of every row.

    Hits that are the parent of another hit go, then the best ``limit`` stay.  Each has
    the ids of its direct children in ``nodes``, literals none.  ``hits`` has id,
    parent_id, kind and ``position``.
    """
    kept = without_parents(hits)
    if limit is not None:
        kept = kept.orderBy("position", "id").limit(limit)
    open_hits = kept.filter(F.col("kind") != literal).select(F.col("id").alias("_p"))
    kids = children(nodes.select("id", "parent_id").join(open_hits, F.col("parent_id") == F.col("_p"), "left_semi"))
    out = kept.join(kids, "id", "left")
    return out.withColumn("children", F.coalesce("children", F.array().cast(kids.schema["children"].dataType)))
