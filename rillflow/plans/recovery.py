"""Recovery lines: the newest set of checkpoints, one an instance, of which none depends on another's undone work.

A checkpoint holds the ids of the checkpoints whose messages it has seen, by instance, and whatever its
own predecessors depend on.  The line is found by lowering: while an instance's head depends on a
checkpoint at or after another instance's head, it moves below its first checkpoint that does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .iterate import cut

#: The id of a healthy instance's running state.
RUNNING = ""


def recovery_line(checkpoints: DataFrame, failed: DataFrame | None = None, connections: DataFrame | None = None) -> DataFrame:
    """instance_name, checkpoint_id of the recovery line from (id, instance_name, created_at, dependencies).

    With ``failed`` (instance_name) and ``connections`` (from_name, to_name), instances that didn't fail
    also offer their running state, which depends on their own last checkpoint and on those of all that
    send to them; it shows as the empty id.  Instances left with no checkpoint are missing from the line.
    """
    order = W.partitionBy("instance_name").orderBy("created_at", "id")
    numbered = cut(checkpoints.select("instance_name", "id", "dependencies", F.row_number().over(order).alias("at")))
    places = numbered.select(F.col("id").alias("other_id"), F.col("instance_name").alias("other"), F.col("at").alias("other_at"))
    named = numbered.select("instance_name", "at", F.explode("dependencies").alias("other", "other_id"))
    needs = named.join(places, ["other", "other_id"]).filter("instance_name <> other").select("instance_name", "at", "other", "other_at")
    heads = numbered.groupBy("instance_name").agg(F.max("at").alias("head"))
    names = numbered.select("instance_name", "at", F.col("id").alias("checkpoint_id"))
    if failed is not None:
        running = heads.join(failed.select("instance_name").distinct(), "instance_name", "left_anti").withColumn("head", F.col("head") + 1)
        sent = connections.select(F.col("to_name").alias("instance_name"), F.col("from_name").alias("other"))
        last = heads.select(F.col("instance_name").alias("other"), F.col("head").alias("other_at"))
        needs = needs.unionByName(running.withColumnRenamed("head", "at").join(sent, "instance_name").join(last, "other").filter("instance_name <> other").select("instance_name", "at", "other", "other_at"))
        names = names.unionByName(running.select("instance_name", F.col("head").alias("at"), F.lit(RUNNING).alias("checkpoint_id")))
        heads = heads.join(running.withColumnRenamed("head", "up"), "instance_name", "left").select("instance_name", F.coalesce("up", "head").alias("head"))
    needs, heads = cut(needs), cut(heads)
    while True:
        others = heads.select(F.col("instance_name").alias("other"), F.col("head").alias("other_head"))
        undone = needs.join(others, "other").filter("other_at >= other_head").groupBy("instance_name").agg(F.min("at").alias("first"))
        lowered = heads.join(undone, "instance_name", "left").select("instance_name", F.least("head", F.col("first") - 1).alias("head"), "head")
        lowered = cut(lowered.toDF("instance_name", "new", "old"))
        heads = lowered.filter("new > 0").select("instance_name", F.col("new").alias("head"))
        if lowered.filter("new < old").isEmpty():
            return heads.withColumnRenamed("head", "at").join(names, ["instance_name", "at"]).select("instance_name", "checkpoint_id")


def affected(line: DataFrame) -> DataFrame:
    """Instances that have to restore."""
    return line.filter(F.col("checkpoint_id") != RUNNING)


def beyond_line(checkpoints: DataFrame, line: DataFrame) -> DataFrame:
    """Checkpoints newer than their instance's place in the line, and those of instances not in it: garbage after a restore."""
    order = W.partitionBy("instance_name").orderBy("created_at", "id")
    numbered = checkpoints.withColumn("__at", F.row_number().over(order))
    kept = line.join(numbered.select("instance_name", F.col("id").alias("checkpoint_id"), F.col("__at").alias("__line")), ["instance_name", "checkpoint_id"], "left").select("instance_name", F.when(F.col("checkpoint_id") == RUNNING, F.lit(1 << 30)).otherwise(F.col("__line")).alias("__line"))
    return numbered.join(kept, "instance_name", "left").filter(F.col("__at") > F.coalesce("__line", F.lit(0))).drop("__at", "__line")


def last_two(checkpoints: DataFrame) -> DataFrame:
    """instance_name, last_id, previous_id: the newest checkpoints of each instance, those that others may depend on.

    Two combined maxima instead of a sorted history: each task sends a row an instance.
    """
    key = F.struct("created_at", "id")
    last = checkpoints.groupBy("instance_name").agg(F.max(key).alias("last"))
    older = checkpoints.join(last, "instance_name").filter(key < F.col("last"))
    previous = older.groupBy("instance_name").agg(F.max(key)["id"].alias("previous_id"))
    return last.join(previous, "instance_name", "left").select("instance_name", F.col("last.id").alias("last_id"), "previous_id")
