"""Reply forests: depth, order and ancestors, by pointer doubling over an adjacency list.

Each round joins every open pointer with the row that it points to, so a thread of depth d takes
about log2(d) rounds. A round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def last_of_each(notes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each key: that with the greatest order value."""
    rest = [c for c in notes.columns if c not in keys]
    best = notes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*notes.columns)


def flattened(notes: DataFrame, group: str = "paper_id", note: str = "note_id", parent: str = "replyto") -> DataFrame:
    """notes reachable from a root (no parent), with depth and path, the note ids from the root on.

    Replies that no root reaches, cycles included, are dropped. Sorting by path gives pre-order.
    """
    kept = saved(notes.select(F.col(group).alias("_g"), F.col(note).alias("_n"), F.col(parent).alias("_up"), F.array(F.col(note)).alias("_path")).distinct(), "thread-edges")
    left = None
    while True:
        still = kept.where("_up IS NOT NULL").count()
        if still == left or not still:  # those left lead into a cycle
            break
        left = still
        over = kept.select("_g", F.col("_n").alias("_up"), F.col("_up").alias("_up2"), F.col("_path").alias("_head"))
        walked = kept.where("_up IS NOT NULL").join(over, ["_g", "_up"]).select("_g", "_n", F.col("_up2").alias("_up"), F.concat("_head", "_path").alias("_path"))
        # a path that comes to its own note again is in a cycle, and so is what hangs on it
        walked = walked.where("size(_path) = size(array_distinct(_path))")
        kept = saved(kept.where("_up IS NULL").unionByName(walked), "thread-paths")
    paths = kept.where("_up IS NULL").select(F.col("_g").alias(group), F.col("_n").alias(note), (F.size("_path") - 1).alias("depth"), F.col("_path").alias("path"))
    return notes.join(paths, [group, note]).select(*notes.columns, "depth", "path")


def ancestor_of_other_role(notes: DataFrame, group: str = "paper_id", note: str = "note_id", parent: str = "replyto", role: str = "from_role") -> DataFrame:
    """(group, note, ancestor): the nearest ancestor whose role differs from its child's on the way; null if none, cycles included."""
    own = notes.select(F.col(group).alias("_g"), F.col(note).alias("_n"), F.col(parent).alias("_up"), F.col(role).alias("_role"))
    above = own.select("_g", F.col("_n").alias("_up"), F.col("_role").alias("_role2"), F.lit(True).alias("_there"))
    other = F.col("_role") != F.col("_role2")
    first = own.join(above, ["_g", "_up"], "left").select("_g", "_n", F.when(other, F.col("_up").cast("string")).alias("found"), F.when(F.col("_there") & ~F.coalesce(other, F.lit(False)), F.col("_up")).alias("_up"))
    at, left = saved(first, "ancestors"), None
    while True:
        still = at.where("_up IS NOT NULL").count()
        if still == left or not still:  # those left go round in a cycle of one role
            break
        left = still
        over = at.select("_g", F.col("_n").alias("_up"), F.col("found").alias("_found"), F.col("_up").alias("_up2"))
        moved = at.where("_up IS NOT NULL").drop("found").join(over, ["_g", "_up"]).select("_g", "_n", F.col("_found").alias("found"), F.col("_up2").alias("_up"))
        at = saved(at.where("_up IS NULL").unionByName(moved), "ancestors")
    return at.groupBy("_g", "_n").agg(F.max("found").alias("ancestor")).select(F.col("_g").alias(group), F.col("_n").alias(note), "ancestor")


def with_reply_from(notes: DataFrame, role: str, group: str = "paper_id", note: str = "note_id", parent: str = "replyto", role_col: str = "from_role") -> DataFrame:
    """The notes that have a direct reply of a role."""
    replies = notes.where(F.col(role_col) == role).select(F.col(group).alias("_g"), F.col(parent).alias("_p"))
    return notes.join(replies, (F.col(group) == F.col("_g")) & (F.col(note) == F.col("_p")), "left_semi")
