"""Parents and children: parcel, building, storey, unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import stored


def children(objects: DataFrame) -> DataFrame:
    """``(object_id, n_children, first_child, last_child)`` of each object with children, in order of entry."""
    return objects.where("parent_id is not null").groupBy(F.col("parent_id").alias("object_id")).agg(F.count("*").alias("n_children"), F.min_by("object_id", "seq").alias("first_child"), F.max_by("object_id", "seq").alias("last_child"))


def ancestors(objects: DataFrame) -> DataFrame:
    """``(object_id, distance, ancestor_id)``, nearest first; a parent that is absent ends the chain.

    Each step is an equi-join of narrow columns, stored; steps go on until no chain goes
    further. An object that is its own ancestor is an error.
    """
    link = objects.select("object_id", "parent_id")
    up = link.select(F.col("object_id").alias("ancestor_id"), F.col("parent_id").alias("next"))
    up = stored(up, "parents")
    step = stored(link.where("parent_id is not null").join(up, F.col("parent_id") == F.col("ancestor_id")).select("object_id", F.lit(1).alias("distance"), "ancestor_id", "next"), "ancestors")
    out = step
    while True:
        go_on, own = step.agg(F.count("next"), F.max(F.when(F.col("ancestor_id") == F.col("object_id"), F.col("object_id")))).first()
        if own is not None:
            raise ValueError(f"{own} is its own ancestor")
        if not go_on:
            return out.drop("next")
        wanted = step.where("next is not null").select("object_id", (F.col("distance") + 1).alias("distance"), F.col("next").alias("wanted"))
        step = stored(wanted.join(up, F.col("wanted") == F.col("ancestor_id")).select("object_id", "distance", "ancestor_id", "next"), "ancestors")
        out = out.unionByName(step)


def descendants(objects: DataFrame) -> DataFrame:
    """``(object_id, n_descendants, n_units)`` of every object that has any."""
    kinds = objects.select(F.col("object_id").alias("below"), "kind")
    return ancestors(objects).select(F.col("ancestor_id").alias("object_id"), F.col("object_id").alias("below")).join(kinds, "below").groupBy("object_id").agg(F.count("*").alias("n_descendants"), F.count_if(F.col("kind") == "unit").alias("n_units"))


def orphans(objects: DataFrame) -> DataFrame:
    there = objects.select(F.col("object_id").alias("parent_id"))
    return objects.where("parent_id is not null").join(there, "parent_id", "left_anti").select("object_id", "parent_id")


def tree(objects: DataFrame) -> DataFrame:
    """Every object with its place among its siblings: roots by kind and id, children by kind, falling level and id."""
    from pyspark.sql import Window

    order = Window.partitionBy("parent_id").orderBy("kind", F.desc("level"), "object_id")
    below = objects.where("parent_id is not null").select("object_id", "parent_id", "kind", "level", F.row_number().over(order).alias("place"))
    # roots are parted by kind, so no task gets them all
    roots = objects.where("parent_id is null").select("object_id", "parent_id", "kind", "level", F.row_number().over(Window.partitionBy("kind").orderBy("object_id")).alias("place"))
    return below.union(roots)


def nested(objects: DataFrame) -> DataFrame:
    """``(object_id, n_objects, document)``: a JSON document for each root, with all below it nested as ``children``, any depth.

    Siblings come by kind, falling level and id. The fold goes bottom-up, a level at a
    time: what lies below an object is one text by then, so a level costs one shuffle.
    An object whose parent is absent is a root.
    """
    depth = ancestors(objects).groupBy("object_id").agg(F.max("distance").alias("depth"))
    there = objects.select(F.col("object_id").alias("parent_id"), F.lit(True).alias("known"))
    head = F.to_json(F.struct("object_id", "kind", "level"))
    nodes = objects.join(depth, "object_id", "left").join(there, "parent_id", "left").select("object_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"), F.coalesce("depth", F.lit(0)).alias("depth"), F.struct("kind", (-F.col("level")).alias("down"), "object_id").alias("place"), F.substring(head, F.lit(1), F.length(head) - 1).alias("head"))
    nodes = stored(nodes, "nodes")
    last = nodes.agg(F.max("depth")).first()[0]
    docs = None
    for d in range(last if last is not None else 0, -1, -1):
        own = nodes.where(F.col("depth") == d)
        if docs is None:
            own = own.withColumns({"below": F.array().cast("array<string>"), "n": F.lit(0).cast("long")})
        else:
            # an object's document holds those of its children, so they must meet
            kids = docs.groupBy(F.col("parent_id").alias("object_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "document"))), lambda x: x["document"]).alias("below"), F.sum("n_objects").alias("n"))
            own = own.join(kids, "object_id", "left")
        text = F.concat("head", F.lit(',"children":['), F.array_join(F.coalesce("below", F.array().cast("array<string>")), ","), F.lit("]}"))
        docs = stored(own.select("object_id", "parent_id", "place", (F.coalesce("n", F.lit(0)) + 1).alias("n_objects"), text.alias("document")), "documents")
    return docs.select("object_id", "n_objects", "document")


def section_height(objects: DataFrame) -> DataFrame:
    """For each level, the height of a plane just above its storeys."""
    return objects.where("kind = 'storey'").groupBy("level").agg((F.max("z_max") + 0.05).alias("plane_z"), F.count("*").alias("n_storeys"))
