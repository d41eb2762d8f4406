"""Operator 13, vector code compression: product quantisation in integers over lexicographic tries of parts.

Vectors become integers floor(256 * x) and are cut into ``PARTS`` equal parts, each with a codebook of ``ENTRIES`` entries. A task
takes blocks of up to ``BLOCK`` vectors; the distinct parts of a block at one position, sorted, are the leaves of a
trie whose levels are the dimensions. A depth-first traversal carries the squared distances to all entries that a prefix has
accumulated, so that parts with a common prefix share them; it goes down in runs of sibling nodes of at most
``NODES``, which bounds its memory. A leaf takes the nearest entry and adds its part to that entry's sum as often as it occurs.

Each round is one pass: tasks return a row of sums for each position and entry, Spark adds them up, and the driver, which
holds only codebooks (parts x entries rows, whatever the data), moves the entries. A last pass writes codes and errors. No vector
is shuffled until the errors are summed by label, on their codes alone.

Defined results: vectors that are null or hold null or non-finite components are dropped, as are those whose length is no positive
multiple of ``PARTS`` or differs from that of the kept vector with the smallest id; integers beyond 2^26 are held there; rows with equal ids order by
their packed bytes, null ids come last, repeated rows count each; fewer than ``ENTRIES`` vectors give fewer entries; equal entries: the lower
index; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import settled, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block, and nodes that a step of the traversal expands.
BLOCK, NODES = 1 << 15, 1 << 13
LIMIT = 1 << 26
_ORDER = ("vec_id IS NULL", "vec_id", "ints")


def nearest(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of distinct parts in lexicographic order.

    A node of the trie is the first leaf with its prefix; the stack holds runs of nodes of one depth, the leftmost on top."""
    n, dims = leaves.shape
    new = np.ones((n, dims), bool)  # a leaf begins a node at a depth where it, or a prefix of it, differs from the leaf before
    new[1:] = np.logical_or.accumulate(leaves[1:] != leaves[:-1], axis=1)
    index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    nodes = [np.append(np.flatnonzero(new[:, d]), n) for d in range(dims)]
    stack = [(0, 0, len(nodes[0]) - 1, np.zeros((1, len(entries)), np.int64), np.zeros(len(nodes[0]) - 1, np.int64))] if n else []
    while stack:
        depth, lo, hi, above, parent = stack.pop()
        if hi - lo > NODES:
            half = (lo + hi) // 2
            stack += [(depth, half, hi, above, parent[half - lo :]), (depth, lo, half, above, parent[: half - lo])]
            continue
        at = nodes[depth][lo:hi]
        near = above[parent] + (leaves[at, depth, None] - entries[None, :, depth]) ** 2
        if depth == dims - 1:
            index[at] = near.argmin(axis=1)
            distance[at] = near[np.arange(len(at)), index[at]]
        else:
            below = nodes[depth + 1]
            a, b = np.searchsorted(below, (nodes[depth][lo], nodes[depth][hi]))
            stack.append((depth + 1, a, b, near, np.searchsorted(at, below[a:b], "right") - 1))
    return index, distance


def _distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, each row's place among them, and their counts."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    first = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(first) - 1
    return rows[first], place, np.bincount(place)


def _blocks(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows and their integers (rows x parts x dimensions), ``BLOCK`` at most."""
    waiting, n = [], 0

    def block():
        rows = pa.Table.from_batches(waiting).combine_chunks()
        values = np.frombuffer(b"".join(rows["ints"].to_pylist()), np.int32).astype(np.int64)
        return rows.drop_columns(["ints"]), values.reshape(rows.num_rows, parts, -1)

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if n and n + part.num_rows > BLOCK:
                yield block()
                waiting, n = [], 0
            waiting.append(part)
            n += part.num_rows
    if n:
        yield block()


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
             parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dims, ints) of the kept vectors, the integers packed. Written."""
    kind = {c: vectors.schema[c].dataType.simpleString() for c in (vec_id, label)}

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                lists = part.column(2)
                values = pc.list_flatten(lists)
                parent = pc.list_parent_indices(lists).to_numpy()
                x = pc.fill_null(values.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
                length = np.bincount(parent, minlength=part.num_rows)
                bad = np.bincount(parent, ~np.isfinite(x), minlength=part.num_rows) > 0
                keep = ~bad & (length > 0) & (length % parts == 0)
                x = np.clip(np.floor(scale * x[keep[parent]]), -LIMIT, LIMIT).astype(np.int32)
                ends = np.cumsum(length[keep])
                ints = [x[b - n : b].tobytes() for n, b in zip(length[keep].tolist(), ends.tolist())]
                here = pa.array(np.flatnonzero(keep))
                yield pa.RecordBatch.from_arrays([part.column(0).take(here), part.column(1).take(here), pa.array(length[keep].astype(np.int32)), pa.array(ints, pa.binary())], names=["vec_id", "label", "dims", "ints"])

    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    kept = written(rows.mapInArrow(run, f"vec_id {kind[vec_id]}, label {kind[label]}, dims int, ints binary"), "ints")
    first = kept.orderBy(*map(F.expr, _ORDER)).select("dims").first()
    return kept.where(F.col("dims") == first.dims) if first else kept


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each position after ``rounds`` rounds over all rows of :func:`integers`; it starts with the parts of
    the ``entries`` smallest ids."""
    spark = rows.sparkSession
    start = [np.frombuffer(bytes(r.ints), np.int32).reshape(parts, -1) for r in rows.orderBy(*map(F.expr, _ORDER)).select("ints").limit(entries).collect()]
    books = [np.array([v[p] for v in start], np.int64) for p in range(parts)]
    if not start:
        return books
    schema = f"position int, entry int, n long, {', '.join(f's{d} long' for d in range(books[0].shape[1]))}"

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            n = [np.zeros(len(b), np.int64) for b in shared.value]
            sums = [np.zeros(b.shape, np.int64) for b in shared.value]
            for _, values in _blocks(batches, len(shared.value)):
                for p, entries in enumerate(shared.value):
                    leaves, _, counts = _distinct(values[:, p])
                    index, _ = nearest(leaves, entries)
                    np.add.at(n[p], index, counts)
                    np.add.at(sums[p], index, leaves * counts[:, None])
            for p, entries in enumerate(shared.value):
                used = np.flatnonzero(n[p])
                cols = [np.full(len(used), p, np.int32), used.astype(np.int32), n[p][used], *sums[p][used].T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[x.split()[0] for x in schema.split(", ")])

        added = rows.select("ints").mapInArrow(run, schema).groupBy("position", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *(f"s{d}" for d in range(books[0].shape[1])))))
        books = [b.copy() for b in books]
        for r in added.collect():
            books[r.position][r.entry] = [s // r.n for s in r[3:]]
        shared.destroy()
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of all rows of :func:`integers`."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]):
        for own, values in _blocks(batches, len(shared.value)):
            codes, error = np.zeros((len(values), len(shared.value)), np.uint8), np.zeros(len(values), np.int64)
            for p, entries in enumerate(shared.value):
                leaves, place, _ = _distinct(values[:, p])
                index, distance = nearest(leaves, entries)
                codes[:, p] = index[place]
                error += distance[place]
            text = [c.tobytes().hex() for c in codes]
            for batch in own.append_column("code", pa.array(text, pa.string())).append_column("error", pa.array(error)).to_batches():
                yield batch

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, written, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    rows = integers(vectors, vec_id, embedding, label, parts, scale)
    books = train(rows, parts, entries, rounds)
    return written(encode(rows, books), "codes"), books


def decoded(code: str, books: list[np.ndarray]) -> list[int]:
    """The integers that a code stands for."""
    return [x for b, i in zip(books, bytes.fromhex(code)) for x in b[i].tolist()]


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    def made() -> DataFrame:
        codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
        digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
        of_label = codes.groupBy(F.col("label").alias("own_label")).agg(F.sum("error").alias("label_error"))
        met = codes.join(of_label, codes.label.eqNullSafe(of_label.own_label))
        return met.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

    return settled(made, "op13")


def _nearest_sql(i: int) -> str:
    """The nearest entry is the least of 64 * distance + index."""
    distance = " + ".join(f"(x{d} - y{d}) * (x{d} - y{d})" for d in range(4))
    return f"a{i} AS MATERIALIZED (SELECT r, p, min(d) % 64 AS e, min(d) // 64 AS d FROM (SELECT r, p, e, 64 * ({distance}) + e AS d FROM s JOIN b{i} USING (p)) GROUP BY r, p)"


def _moved_sql(i: int) -> str:
    means = ", ".join(f"CAST((sum(x{d}) - (sum(x{d}) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS z{d}" for d in range(4))
    moved = ", ".join(f"coalesce(z{d}, y{d}) AS y{d}" for d in range(4))
    return f"b{i + 1} AS MATERIALIZED (SELECT p, e, {moved} FROM b{i} LEFT JOIN (SELECT p, e, {means} FROM s JOIN a{i} USING (r, p) GROUP BY p, e) USING (p, e))"


SQL = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT r, p, q[4 * p + 1] AS x0, q[4 * p + 2] AS x1, q[4 * p + 3] AS x2, q[4 * p + 4] AS x3 FROM k, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, x0 AS y0, x1 AS y1, x2 AS y2, x3 AS y3 FROM s WHERE r <= 64),
{_nearest_sql(0)},
{_moved_sql(0)},
{_nearest_sql(1)},
{_moved_sql(1)},
{_nearest_sql(2)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
 (SELECT sha256(string_agg(concat_ws(',', y0, y1, y2, y3), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256
FROM k JOIN (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r) USING (r)
"""
