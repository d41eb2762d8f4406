"""Operator 8, sharding: minimum-cost-flow resharding.

Documents lie in old shards; the new shards get equal capacities in bytes. A minimum-cost flow over the
shard sizes (a byte that stays costs nothing, a byte that moves costs 1) says how many bytes each old
shard hands to each new one. An old shard is ordered by (block, id, crc) and cut at the flow's amounts, so
whole blocks move and only those at a cut are split; a document goes where its first byte lies. What that leaves uneven is
evened out by moving or exchanging single documents between the fullest and the emptiest shards (:func:`even_out`; from some
hundred documents of each shard) until all sizes lie within ``SPREAD`` of their mean or no move helps. Then the
files of the shards that gain or lose a document are written anew: a document of a whole block by its block's new
shard, which is broadcast, one of a split block by a join with its row of the plan.

Only one row per (old shard, block) reaches the driver or is broadcast: a block holds ``BLOCK_BYTES`` or more on
average, so 100 TB make some 400,000 rows.

Defined results: a null text has size 16 and the crc of an empty one; repeated rows get slots of their
own; a null source counts as an empty name; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm.common import dropped, scratch, settled, written

SHARDS, OLD_SHARDS, ROW_BYTES = 40, 40, 16
#: Bytes of a block on average, and the fewest blocks of an old shard.
BLOCK_BYTES, BLOCKS = 256 << 20, 256
#: Share of the mean size by which shards may differ, and documents of each shard that may be moved to get there.
SPREAD, MOVABLE = 0.002, 256


class Plan(NamedTuple):
    """``rows`` (doc_id, size, text_crc32, old, block, shard, slot); blocks of each old shard; new shard of each whole (old, block);
    files of a new shard."""

    rows: DataFrame
    blocks: dict[int, int]
    homes: DataFrame
    files: int

    def block(self, doc_id: str, crc: str, old: str) -> Column:
        return _block(self.blocks, doc_id, crc, old)


def _block(blocks: dict[int, int], doc_id: str, crc: str, old: str) -> Column:
    sizes = F.create_map(*(F.lit(x) for item in (blocks or {0: 1}).items() for x in item))
    return F.pmod(F.xxhash64(doc_id, crc), F.coalesce(sizes[F.col(old)], F.lit(1))).cast("int")


def min_cost_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest shipment of all supplies into the rooms (successive shortest paths over the residual graph)."""
    n, m = len(supply), len(room)
    if sum(supply) > sum(room):
        raise ValueError("the capacities are too small")
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(room)
    while any(left):
        far = [0 if x else float("inf") for x in left] + [float("inf")] * m
        via: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost[i][j] < far[n + j]:
                        far[n + j], via[n + j], changed = far[i] + cost[i][j], i, True
                    if flow[i][j] and far[n + j] - cost[i][j] < far[i]:
                        far[i], via[i], changed = far[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if free[j]), key=lambda j: far[n + j])
        path, at = [], n + end
        while via[at] is not None:
            path.append((via[at], at))
            at = via[at]
        amount = min([left[at], free[end], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        free[end] -= amount
    return flow


def even_out(sizes: list[int], movable: list[list[tuple[int, int]]], spread: float = SPREAD) -> dict[int, int]:
    """Moves (document -> shard) that bring the shards' ``sizes`` together. ``movable`` has each shard's (size, document).

    The fullest shard meets the others from the emptiest up, then the emptiest meets the others from the fullest down: of a move of one document
    and an exchange of two, that which leaves the pair most even is taken. A step always lowers the larger of the pair."""
    sizes, own = list(sizes), [sorted(m) for m in movable]
    target, home = max(1, sum(sizes)) / max(1, len(sizes)), {}

    def step(a: int, b: int) -> bool:
        """One exchange that takes bytes from a to b."""
        gap = sizes[a] - sizes[b]
        if gap <= 1 or not own[a]:
            return False
        x, y = np.array([s for s, _ in own[a]]), np.array([0, *(s for s, _ in own[b])])
        at = np.clip(np.searchsorted(x, y + gap / 2), 0, len(x) - 1)
        best = None
        for k in (at, np.maximum(at - 1, 0)):
            left = np.abs(gap - 2 * (x[k] - y))
            j = int(left.argmin())
            if best is None or left[j] < best[0]:
                best = (int(left[j]), int(k[j]), j)
        if best[0] >= gap:
            return False
        one, other = own[a].pop(best[1]), own[b].pop(best[2] - 1) if best[2] else None
        for (size, document), shard, before in ((one, b, a), *(((other, a, b),) if other else ())):
            home[document] = shard
            own[shard].append((size, document))
            sizes[shard], sizes[before] = sizes[shard] + size, sizes[before] - size
        own[a].sort()
        own[b].sort()
        return True

    for _ in range(64 * len(sizes)):
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        low, high = order[0], order[-1]
        if sizes[high] - sizes[low] <= spread * target:
            break
        if not any(step(high, j) for j in order[:-1]) and not any(step(j, low) for j in reversed(order[1:])):
            break
    return home


def reshard(rows: DataFrame, shards: int = SHARDS, block_bytes: int = BLOCK_BYTES, least_blocks: int = BLOCKS) -> Plan:
    """``rows`` (doc_id, size, text_crc32, old) with ``shard`` and a gapless ``slot`` in it, as a plan for ``rewrite``."""
    spark = rows.sparkSession
    base = written(rows, "sizes")
    blocks = {r.old: max(least_blocks, -(-r.bytes // block_bytes)) for r in base.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}
    base = base.withColumn("block", _block(blocks, "doc_id", "text_crc32", "old"))
    sums = sorted(base.groupBy("old", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    olds = max([shards, *(r.old + 1 for r in sums)])
    supply = [sum(r.bytes for r in sums if r.old == i) for i in range(olds)]
    total = sum(supply)
    room = [total * (j + 1) // shards - total * j // shards for j in range(shards)]
    flow = min_cost_flow(supply, room, [[int(i != j) for j in range(shards)] for i in range(olds)])

    cuts = []
    for i in range(olds):
        at, parts = 0, [j for j in sorted(range(shards), key=lambda j: (j != i, j)) if flow[i][j]]
        for j in parts:
            cuts.append((i, at, at + flow[i][j] if j != parts[-1] else 1 << 62, j))
            at += flow[i][j]
    offsets, homes, at, before = [], [], {}, {}
    for r in sums:
        begin = at.get(r.old, 0)
        offsets.append((r.old, r.block, begin, before.get(r.old, 0)))
        homes += [(r.old, r.block, j) for i, lo, hi, j in cuts if i == r.old and lo <= begin and begin + r.bytes <= hi]
        at[r.old], before[r.old] = at.get(r.old, 0) + r.bytes, before.get(r.old, 0) + r.rows
    cut = spark.createDataFrame(cuts, "old int, lo long, hi long, shard int")
    offset = spark.createDataFrame(offsets, "old int, block int, byte long, nth long")

    own = W.partitionBy("old", "block").orderBy("doc_id", "text_crc32", "size")
    placed = base.withColumns({"start": F.sum("size").over(own.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"), "rank": F.row_number().over(own) - F.lit(1)})
    placed = placed.join(F.broadcast(offset), ["old", "block"]).withColumns({"start": F.col("start") + F.col("byte"), "rank": F.col("rank") + F.col("nth")})
    placed = written(placed.join(F.broadcast(cut), "old").where("start >= lo AND start < hi").select("doc_id", "size", "text_crc32", "old", "block", "shard", "rank"), "placed")
    moves = _moves(placed, shards)
    opened = {(old, block) for old, block, _, _ in moves}
    homes = [h for h in homes if h[:2] not in opened]
    moved = spark.createDataFrame([(old, rank, shard) for old, _, rank, shard in moves], "old int, rank long, new int")
    placed = placed.join(F.broadcast(moved), ["old", "rank"], "left").withColumn("shard", F.coalesce("new", "shard"))

    part = W.partitionBy("shard", "old", "block").orderBy("rank")
    placed = written(placed.select("doc_id", "size", "text_crc32", "old", "block", "shard", (F.row_number().over(part) - F.lit(1)).alias("nth")), "numbered")
    first, used = [], {}
    for r in sorted(placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n")).collect()):
        first.append((r.shard, r.old, r.block, used.get(r.shard, 0)))
        used[r.shard] = used.get(r.shard, 0) + r.n
    shift = spark.createDataFrame(first, "shard int, old int, block int, shift long")
    placed = placed.join(F.broadcast(shift), ["shard", "old", "block"]).select("doc_id", "size", "text_crc32", "old", "block", "shard", (F.col("nth") + F.col("shift")).alias("slot"))
    return Plan(placed, blocks, spark.createDataFrame(homes, "old int, block int, shard int"), max(1, -(-max(room) // block_bytes)))


def _moves(placed: DataFrame, shards: int) -> list[tuple[int, int, int, int]]:
    """(old, block, rank, new shard) of the documents that :func:`even_out` moves. The driver sees ``MOVABLE`` documents of a shard at most."""
    by = {r.shard: (r.bytes, r.n) for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
    if not by:
        return []
    most = max(n for _, n in by.values())
    share = min(1.0, 4 * MOVABLE / most)  # thins large shards before they are sorted; small ones are taken whole
    few = placed.where(F.pmod(F.xxhash64("old", "rank"), F.lit(1 << 30)) < int(share * (1 << 30)))
    few = few.withColumn("k", F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("old", "rank")))).where(F.col("k") <= MOVABLE)
    rows = few.select("shard", "size", "old", "block", "rank").collect()
    movable: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for i, r in enumerate(rows):
        movable[r.shard].append((r.size, i))
    home = even_out([by.get(j, (0, 0))[0] for j in range(shards)], movable)
    return [(rows[i].old, rows[i].block, rows[i].rank, shard) for i, shard in sorted(home.items()) if rows[i].shard != shard]


def sizes(docs: DataFrame, old: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data).cast("long") + ROW_BYTES).alias("size"), F.crc32(data).alias("text_crc32"), old.cast("int").alias("old"))


def _numbered(rows: DataFrame, *key: str) -> DataFrame:
    """Equal rows get numbers, so that repeated ones meet one by one."""
    return rows.withColumn("_keyloom_n", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(1))))


def _met(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """Inner join on key columns (null meets null) and the number of equal rows; ``two`` keeps only its other columns."""
    one, two = _numbered(one, *key), _numbered(two, *key)
    both = [*key, "_keyloom_n"]
    two = two.select(*(F.col(c).alias(f"{c}__") for c in both), *(c for c in two.columns if c not in both))
    return one.join(two, [one[c].eqNullSafe(two[f"{c}__"]) for c in both]).drop(*(f"{c}__" for c in both), "_keyloom_n")


_ROW = ["_keyloom_id", "_keyloom_size", "_keyloom_crc", "_keyloom_old"]


def rewrite(docs: DataFrame, old: Column, plan: Plan, path: str, doc_id: str = "doc_id", text: str = "text", fresh: bool = False) -> list[int]:
    """Write the files (``shard=N``) of the shards that gain or lose a document under ``path`` and clear emptied ones; the
    others stay. Returns the shards touched. ``docs`` may be read from ``path``; a column ``shard`` of it is the layout's.
    With ``fresh`` nothing lies under ``path`` yet: all shards are written there and ``docs`` is read elsewhere.

    A document of a split block meets its row of the plan by id, size, crc and old shard, equal ones by their number."""
    spark = docs.sparkSession
    touched = sorted({x for r in plan.rows.where("old <> shard").select("old", "shard").distinct().collect() for x in r})
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    kept = [c for c in docs.columns if c != "shard"]
    rows = docs.withColumns(dict(zip(_ROW, (F.col(doc_id), F.octet_length(data).cast("long") + ROW_BYTES, F.crc32(data), old.cast("int"))))).drop("shard")
    rows = rows.withColumn("_keyloom_block", plan.block("_keyloom_id", "_keyloom_crc", "_keyloom_old"))
    if not fresh:
        rows = rows.where(F.col("_keyloom_old").isin(touched))
    home = plan.homes.select(F.col("old").alias("_keyloom_old"), F.col("block").alias("_keyloom_block"), F.col("shard").alias("_keyloom_shard"))
    whole = rows.join(F.broadcast(home), ["_keyloom_old", "_keyloom_block"]).select(*kept, "_keyloom_shard")
    split = rows.join(F.broadcast(home), ["_keyloom_old", "_keyloom_block"], "left_anti")
    to = plan.rows.join(F.broadcast(plan.homes), ["old", "block"], "left_anti").select(*(F.col(c).alias(k) for c, k in zip(("doc_id", "size", "text_crc32", "old"), _ROW)), F.col("shard").alias("_keyloom_shard"))
    new = whole.unionByName(_met(split, to, _ROW).select(*kept, "_keyloom_shard")).withColumnRenamed("_keyloom_shard", "shard")
    if not fresh:
        new = written(new, "shards")
    dealt = new.repartition("shard", F.pmod(F.xxhash64(doc_id), F.lit(plan.files)))
    dealt.write.partitionBy("shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    if not fresh:
        left = {r.shard for r in new.select("shard").distinct().collect()}
        for shard in set(touched) - left:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        dropped(new)
    return touched


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    """The old layout deals by source, so one old shard holds a third of all rows. The rows returned are those of the
    files written, with the plan's slots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))

    def made() -> DataFrame:
        plan = reshard(sizes(docs, old))
        path = scratch(spark, "shards")
        rewrite(docs, old, plan, path, fresh=True)
        files = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, shard int").parquet(path)
        files = sizes(files, F.col("shard")).withColumnRenamed("old", "shard")
        return _met(files, plan.rows.select("doc_id", "size", "text_crc32", "shard", "slot"), ["doc_id", "size", "text_crc32", "shard"])

    out = settled(made, "op8")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
