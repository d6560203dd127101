"""Parent links of unknown depth: root, depth, path and descendants of every node, and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

#: One node in this many is a splitter, chosen by the hash of its id.
SPLITTER_STRIDE = 8

_ACTIVE, _AT_SPLITTER, _AT_ROOT, _CIRCLE = 0, 1, 2, 3


def _is_splitter(node: Column, stride: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(stride)) == 0


def _walk(start: DataFrame, stop, with_path: bool) -> DataFrame:
    """Follow ``start`` (id, cur, steps, status[, path]) until every row has stopped.

    ``stop(cur)`` says whether a node ends the walk. Each round doubles the walked length by a join on
    the current node; a node without a row has no parent and is a root. Rows leave the round as soon as
    they stop, and every round is written to the shared folder so its lineage is one join deep. While any
    walk without a circle goes on, some walk ends in every round, so a round in which none ends leaves
    circles only.
    """
    stopped: list[DataFrame] = []
    active = start
    before = -1
    while True:
        done = active.where(F.col("status") != _ACTIVE)
        active = active.where(F.col("status") == _ACTIVE)
        stopped.append(done)
        count = active.count()
        if count == 0:
            break
        if count == before:
            stopped.append(active.withColumn("status", F.lit(_CIRCLE)))
            break
        before = count
        known = active
        for part in stopped:
            known = known.unionByName(part)
        there = known.select(
            F.col("id").alias("_at"),
            F.col("cur").alias("_cur"),
            F.col("steps").alias("_steps"),
            F.col("status").alias("_status"),
            *([F.col("path").alias("_path")] if with_path else []),
        )
        joined = active.join(there, active["cur"] == there["_at"], "left")
        root = F.col("_at").isNull()
        status = (
            F.when(root, _AT_ROOT)
            .when(F.col("_status") != _ACTIVE, F.col("_status"))
            .when(stop(F.col("_cur")), _AT_SPLITTER)
            .otherwise(_ACTIVE)
        )
        active = cut(
            joined.select(
                "id",
                F.coalesce("_cur", "cur").alias("cur"),
                (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                status.alias("status"),
                *([F.when(root, F.col("path")).otherwise(F.concat("path", "_path")).alias("path")] if with_path else []),
            )
        )
    out = stopped[0]
    for part in stopped[1:]:
        out = out.unionByName(part)
    return out


def resolve_hierarchy(
    links: DataFrame,
    node: str = "id",
    parent: str = "parent",
    stride: int = SPLITTER_STRIDE,
    with_path: bool = False,
    leaves: bool = True,
) -> DataFrame:
    """(id, root, depth[, path]) of every row of ``links``, one row per node that has a parent.

    ``links`` holds unique non-null nodes; rows with a null node or parent are left out, since such a
    node is a root. A parent without a row is a root. Nodes in a circle, or whose links lead into one,
    get a null root and depth −1 (and a null path); a node that is its own parent is a circle. ``path``
    lists the ancestors from the parent up to the root. Columns besides the two named are ignored. Without ``leaves``
    only nodes that have children come out, which is enough to find circles.

    A node without children has its parent's root and one more step, so only nodes with children walk. Deterministic
    hash splitters stand for one node in ``stride``. Every such node walks to its next splitter
    or root, the graph of splitters alone is solved in the same way, and the two parts are added up. A
    circle without a splitter never ends its walk and is recognised in the first phase, any other one in
    the second. All joins are on single nodes, so no long chain meets one task; the children of one parent meet
    it once, in a join whose large side adaptive execution splits.
    """
    links = links.select(F.col(node).alias("id"), F.col(parent).alias("parent")).where("id IS NOT NULL AND parent IS NOT NULL")
    above = links.select(F.col("parent").alias("id")).distinct().withColumn("_inner", F.lit(True))
    links = cut(links.join(above, "id", "left" if leaves else "inner"))
    inner = links.where("_inner").select("id", "parent")
    solved = _resolve(inner, stride, False)
    if with_path:
        # Paths around a circle would never end, so circles are found first and kept out.
        lost = cut(solved).where(F.col("depth") < 0)
        clean = inner.join(lost.select("id"), "id", "left_anti")
        solved = _resolve(clean, stride, True).unionByName(lost, allowMissingColumns=True)
    if not leaves:
        return solved
    solved = cut(solved)
    up = solved.select(F.col("id").alias("parent"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *([F.col("path").alias("_path")] if with_path else []))
    last = links.where("_inner IS NULL").select("id", "parent").join(up, "parent", "left")
    lost = F.col("_depth") < 0
    ends = last.select(
        "id",
        F.when(F.col("_depth").isNull(), F.col("parent")).when(~lost, F.col("_root")).alias("root"),
        F.when(F.col("_depth").isNull(), F.lit(1)).when(lost, F.lit(-1)).otherwise(F.col("_depth") + 1).cast("long").alias("depth"),
        *([F.when(F.col("_depth").isNull(), F.array("parent")).when(~lost, F.concat(F.array("parent"), "_path")).alias("path")] if with_path else []),
    )
    return solved.unionByName(ends)


def _resolve(links: DataFrame, stride: int, with_path: bool) -> DataFrame:
    known = (
        links.where(F.col("id").isNotNull() & F.col("parent").isNotNull())
        .withColumnRenamed("parent", "cur")
        .withColumn("steps", F.lit(1).cast("long"))
        .withColumn("status", F.when(_is_splitter(F.col("cur"), stride), _AT_SPLITTER).otherwise(_ACTIVE))
    )
    if with_path:
        known = known.withColumn("path", F.array("cur"))
    # Every round reads all pointers, so they are kept as narrow rows of their own.
    known = cut(known)
    walked = _walk(known, lambda cur: _is_splitter(cur, stride), with_path)
    reduced = cut(
        walked.where(_is_splitter(F.col("id"), stride)).withColumn(
            "status", F.when(F.col("status") == _AT_SPLITTER, _ACTIVE).otherwise(F.col("status"))
        )
    )
    solved = _walk(reduced, lambda cur: F.lit(False), with_path).select(
        F.col("id").alias("_at"),
        F.col("cur").alias("_root"),
        F.col("steps").alias("_steps"),
        F.col("status").alias("_status"),
        *([F.col("path").alias("_path")] if with_path else []),
    )
    joined = walked.join(solved, (walked["status"] == _AT_SPLITTER) & (walked["cur"] == solved["_at"]), "left")
    circle = (F.col("status") == _CIRCLE) | F.coalesce(F.col("_status") == _CIRCLE, F.lit(False))
    return joined.select(
        "id",
        F.when(~circle, F.coalesce("_root", "cur")).alias("root"),
        F.when(circle, F.lit(-1).cast("long")).otherwise(F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("depth"),
        *(
            [F.when(~circle, F.when(F.col("_at").isNull(), F.col("path")).otherwise(F.concat("path", "_path"))).alias("path")]
            if with_path
            else []
        ),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair of a tree, from ``resolve_hierarchy(with_path=True)``.

    One row per pair, never a collected list, so a root above a third of all nodes is no large row.
    Circles have no path and so no pairs.
    """
    return resolved.where(F.col("path").isNotNull()).select(
        F.posexplode("path").alias("_i", "ancestor"), F.col("id").alias("descendant")
    ).select("ancestor", "descendant", (F.col("_i") + 1).cast("long").alias("distance"))


def descendant_counts(links: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """(ancestor, n_descendants, max_distance) of every node with a node below it, without a row per pair.

    ``links`` as for ``resolve_hierarchy``; nodes in a circle, or whose links lead into one, give no row. With the sums over
    all nodes less than 2^k below and the ancestor 2^k above each node, the sums of the nodes that have a node as
    that ancestor are its own from 2^k to 2^(k+1), so a tree of any depth d takes log2(d) rounds of joins over single nodes.
    Only nodes that still have such an ancestor stay in a round, and one in which none ends leaves circles only.
    """
    links = links.select(F.col(node).alias("id"), F.col(parent).alias("up")).where("id IS NOT NULL AND up IS NOT NULL")
    active = cut(links.withColumn("n", F.lit(1).cast("long")).withColumn("m", F.lit(0).cast("long")))
    parts = []
    before, step = -1, 1
    while (count := active.count()) not in (0, before):
        before = count
        got = cut(active.groupBy(F.col("up").alias("_at")).agg(F.sum("n").alias("_n"), (F.max("m") + step).alias("_m")))
        parts.append(got)
        above = active.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
        grown = active.join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), "n", "m")
        active = cut(
            grown.join(got, F.col("id") == F.col("_at"), "left").select(
                "id", "up", (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("m", "_m").alias("m")
            )
        )
        step *= 2
    if not parts:
        return links.limit(0).select(F.col("up").alias("ancestor"), F.lit(0).cast("long").alias("n_descendants"), F.lit(0).cast("long").alias("max_distance"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.groupBy(F.col("_at").alias("ancestor")).agg(F.sum("_n").alias("n_descendants"), F.max("_m").alias("max_distance"))
    return out.join(active.select(F.col("id").alias("ancestor")), "ancestor", "left_anti")


def reply_links(rows: DataFrame) -> DataFrame:
    """(id, conversation_id, external_id, parent, parent_external_id) of messages that reply to a message.

    ``rows`` are latest messages with ``row_id`` and ``reply_to_external_id``. The numeric row id stands
    for the message in everything that follows. Null and empty reply links, and links that name no
    message of the conversation, give no row.
    """
    nodes = rows.select(
        F.col("conversation_id").alias("_c"), F.col("external_id").alias("_e"), F.col("row_id").alias("parent")
    )
    children = rows.where(F.col("reply_to_external_id") != "")
    return children.join(
        nodes, (children["conversation_id"] == nodes["_c"]) & (children["reply_to_external_id"] == nodes["_e"]), "inner"
    ).select(
        F.col("row_id").alias("id"), "conversation_id", "external_id", "parent", F.col("_e").alias("parent_external_id")
    )
