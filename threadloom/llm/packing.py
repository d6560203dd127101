"""Filling sequences of fixed capacity with documents of varying length."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task packs together; more rows make more blocks, not larger ones.
BLOCK_ROWS = 40_000

#: Estimated cost of a document of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

#: Most capacities in one call; they come from a small parameter table.
MAX_CAPACITIES = 1000


class _Open:
    """Open sequences by remaining room; finds the one of lowest cost that has room for a size.

    A segment tree over the remaining room: each leaf keeps a heap of (cost, sequence), each inner node
    the least (cost, sequence) below it, so a search takes as many steps as the tree is deep.
    """

    def __init__(self, capacity: int) -> None:
        self.width = 1 << capacity.bit_length()
        self.least: list[tuple[float, int] | None] = [None] * (2 * self.width)
        self.leaves: dict[int, list[tuple[float, int]]] = {}

    def _lift(self, room: int) -> None:
        heap = self.leaves[room]
        node = room + self.width
        self.least[node] = heap[0] if heap else None
        node >>= 1
        while node:
            a, b = self.least[2 * node], self.least[2 * node + 1]
            self.least[node] = b if a is None else a if b is None else min(a, b)
            node >>= 1

    def add(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.leaves.setdefault(room, []), (cost, sequence))
        self._lift(room)

    def take(self, size: int) -> tuple[int, float, int] | None:
        """Removes and returns (room, cost, sequence) of the lowest cost with room for ``size``."""
        best, lo, hi = None, size + self.width, 2 * self.width
        where = 0
        while lo < hi:
            if lo & 1:
                if self.least[lo] is not None and (best is None or self.least[lo] < best):
                    best, where = self.least[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.least[hi] is not None and (best is None or self.least[hi] < best):
                    best, where = self.least[hi], hi
            lo >>= 1
            hi >>= 1
        if best is None:
            return None
        while where < self.width:
            where = 2 * where if self.least[2 * where] == best else 2 * where + 1
        room = where - self.width
        heapq.heappop(self.leaves[room])
        self._lift(room)
        return room, best[0], best[1]


def balance(sizes: Sequence[int], capacity: int) -> list[int]:
    """The sequence of each size, given in descending order, none above ``capacity``.

    Each document goes to the sequence of lowest estimated cost that still has room for its tokens; where
    none has room, one more is opened.
    """
    tree, used, out = _Open(capacity), 0, []
    for n in sizes:
        found = tree.take(n)
        if found is None:
            found = (capacity, 0.0, used)
            used += 1
        room, cost, s = found
        tree.add(room - n, cost + LINEAR * n + QUADRATIC * n * n, s)
        out.append(s)
    return out


def pack(
    sizes: DataFrame,
    capacities: Sequence[int],
    item: str = "doc_id",
    size: str = "n_tokens",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(capacity, container, item, piece_no, start_token, piece_tokens): containers of each capacity.

    Items go whole into one container; only one larger than the capacity is split, into full containers
    and one rest that is packed like any other item. Items without tokens (null counts as none) need no
    room: they come out once per capacity with a null container and piece_tokens 0. Items are unique; an
    empty table gives an empty table; other columns are ignored. Ties in size go to the smaller item.

    Rows are spread by hash over blocks of about ``block_rows`` rows, each packed by one task: at most the
    last few containers of a block stay partly empty, whatever the number of rows. Nothing but item and
    size moves.
    """
    caps = sorted({int(c) for c in capacities})
    if not caps or len(caps) > MAX_CAPACITIES or caps[0] < 1:
        raise ValueError("capacities must be 1 to 1000 positive numbers")
    slim = sizes.select(F.col(item).alias("_item"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size"))
    blocks = max(1, -(-slim.count() // block_rows))
    each = slim.withColumn("_cap", F.explode(F.array(*[F.lit(c).cast("long") for c in caps])))
    filled = F.when(F.col("_size") > F.col("_cap"), F.expr("_size div _cap")).otherwise(F.lit(0).cast("long"))
    each = each.withColumn("_full", filled).withColumn("_rest", F.col("_size") - F.col("_full") * F.col("_cap"))
    full = (
        each.where(F.col("_full") > 0)
        .select("_cap", "_item", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)).alias("piece_no"))
        .select(
            F.col("_cap").alias("capacity"),
            F.concat_ws("-", F.lit("whole"), F.col("_item").cast("string"), F.col("piece_no").cast("string")).alias("container"),
            F.col("_item").alias(item),
            "piece_no",
            (F.col("piece_no") * F.col("_cap")).alias("start_token"),
            F.col("_cap").alias("piece_tokens"),
        )
    )
    zero = F.lit(0).cast("long")
    nothing = each.where(F.col("_size") == 0).select(
        F.col("_cap").alias("capacity"),
        F.lit(None).cast("string").alias("container"),
        F.col("_item").alias(item),
        zero.alias("piece_no"),
        zero.alias("start_token"),
        zero.alias("piece_tokens"),
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_rest", "_item"], ascending=[False, True], kind="stable")
        into = balance(rows["_rest"].tolist(), int(rows["_cap"].iloc[0]))
        block = int(rows["_block"].iloc[0])
        return pd.DataFrame(
            {
                "capacity": rows["_cap"],
                "container": [f"block-{block}-{s}" for s in into],
                item: rows["_item"],
                "piece_no": rows["_full"],
                "start_token": rows["_full"] * rows["_cap"],
                "piece_tokens": rows["_rest"],
            }
        )

    kind = sizes.schema[item].dataType.simpleString()
    rests = (
        each.where(F.col("_rest") > 0)
        .withColumn("_block", F.pmod(F.xxhash64("_item"), F.lit(blocks)))
        .groupBy("_cap", "_block")
        .applyInPandas(
            run,
            f"capacity bigint, container string, `{item}` {kind}, piece_no bigint, start_token bigint, piece_tokens bigint",
        )
    )
    return full.unionByName(rests).unionByName(nothing)
