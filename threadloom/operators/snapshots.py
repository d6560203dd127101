"""Versioned snapshots of messages, their fingerprints, and lineage between results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut


def revisions(rows: DataFrame) -> DataFrame:
    """(conversation_id, external_id, revision_no, row_id, imported_at, text_hash): texts that changed.

    Imports of a message in order of time, then row; one that repeats the hash before it is no revision.
    """
    order = Window.partitionBy("conversation_id", "external_id").orderBy("imported_at", "row_id")
    same = F.lag("text_hash").over(order).eqNullSafe(F.col("text_hash")) & (F.row_number().over(order) > 1)
    changed = rows.select("conversation_id", "external_id", "row_id", "imported_at", "text_hash", same.alias("_same")).where(~F.col("_same"))
    return changed.select("conversation_id", "external_id", F.row_number().over(order).alias("revision_no"), "row_id", "imported_at", "text_hash")


def members_at(revised: DataFrame, moment: str) -> DataFrame:
    """(conversation_id, external_id, row_id, text_hash): the revision of each message valid at ``moment``."""
    past = revised.where(F.col("imported_at") <= F.to_timestamp(F.lit(moment)))
    return past.groupBy("conversation_id", "external_id").agg(F.max_by(F.struct("row_id", "text_hash"), "revision_no").alias("_r")).select(
        "conversation_id", "external_id", "_r.row_id", "_r.text_hash"
    )


def advance(parent: DataFrame, imported: DataFrame) -> DataFrame:
    """Members of a new snapshot: those of ``imported`` conversations, and all others of ``parent``."""
    names = imported.select("conversation_id").distinct()
    return parent.join(names, "conversation_id", "left_anti").unionByName(imported)


def digest_tree(rows: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """(keys, n, manifest): one SHA-256 of all rows of each key, the same in any order of rows.

    Every row has a SHA-256 of its content; those with the same first five digits are sorted and hashed together, then those
    of the same first two, then all. A list in a task holds a millionth of the rows of a key, then at most 4,096 digests, then 256.
    """
    step = lambda df, by: df.groupBy(*keys, *by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_h"))
    each = rows.select(*keys, F.lit(1).cast("long").alias("n"), F.sha2(content, 256).alias("_h"))
    fine = step(each.withColumn("_five", F.substring("_h", 1, 5)), ["_five"])
    coarse = step(fine.withColumn("_two", F.substring("_five", 1, 2)), ["_two"])
    return step(coarse, []).select(*keys, "n", F.col("_h").alias("manifest"))


def manifest(members: DataFrame, by: str = "conversation_id") -> DataFrame:
    """(by, n, manifest): a SHA-256 over the members of each conversation, the same in any order."""
    return digest_tree(members, [by], F.concat_ws("\x01", "external_id", "text_hash"))


def new_rows(incoming: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` whose keys ``held`` doesn't have: importing twice adds nothing."""
    return incoming.join(held.select(*keys).distinct(), keys, "left_anti")


def lineage_closure(edges: DataFrame, start: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(start_id, id, distance): everything that can be reached from each ``id`` of ``start``, once each.

    Breadth first by joins; a round adds what wasn't known, so circles end too.
    """
    links = cut(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).select(source, target).distinct())
    known = cut(start.select(F.col("id").alias("start_id"), "id").distinct().withColumn("distance", F.lit(0)))
    fresh, step = known, 0
    while True:
        step += 1
        reached = fresh.join(links, fresh["id"] == links[source]).select("start_id", F.col(target).alias("id")).distinct()
        fresh = cut(reached.join(known, ["start_id", "id"], "left_anti").withColumn("distance", F.lit(step)))
        if fresh.isEmpty():
            return known.where("distance > 0")
        known = cut(known.unionByName(fresh))
