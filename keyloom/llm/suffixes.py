"""Operator 6, suffix-array dedup: exact removal of repeated byte strings by a logarithmic index family.

A byte goes if a ``LENGTH``-byte string that covers it starts anywhere else. Every window of ``least``
bytes (the smallest length asked for) contains a sampled suffix: the position with the least hash among its
``CONTEXT``-byte contexts. The windows of a text that share their least value form a run, and equal
windows lie in runs of equal value. A new batch of documents gets the sorted array of its sampled
suffixes' values, as a written table; levels of equal size are merge-scanned into the next one, which adds the
counts of equal values. What the levels hold once is in no match.

Runs whose value the levels hold more than once are candidates. A run that occurs twice as a whole is
repeated whole. Of the others one copy each, with its bytes, meets the runs of its value in one task, where the
fingerprints of all windows are sorted and equal ones are repeated. A value of more than ``GROUP`` runs is
dealt to several tasks; windows that are alone in theirs are carried on in aligned blocks and meet the
other tasks' as counts and joins, so no group of any size lies in one task.

Matching uses 64-bit fingerprints beside the 64-bit value. Texts are identified by their MD5.

Defined results: a null text is empty; texts of fewer than ``LENGTH`` bytes lose nothing; all
occurrences go, the first too; a repeated row makes its whole text repeat; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import dropped, mix, settled, signed, utf8, written

#: Bytes of a match, batches of the query, windows of an aligned block, runs of one value that meet in one task.
LENGTH, BATCHES, BLOCK, GROUP = 400, 4, 16, 512
#: A repeated passage for training data: at least so many words, found by strings of so many bytes.
PASSAGE_WORDS, PASSAGE = 50, 240
#: Bytes of runs whose windows are compared at once.
_BATCH_BYTES = 1 << 20
_MULTIPLIERS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def context_of(length: int) -> int:
    """Bytes of a sampled suffix's context for matches of ``length`` bytes."""
    return max(1, length * 6 // 25)


@lru_cache(4)
def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    m = _MULTIPLIERS[which]
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (m, pow(m, -1, 1 << 64)))


class _Hashes:
    """Hashes of any substring, by differences of the prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        power, self.inverse = _powers(max(1 << 17, 1 << n.bit_length()), which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def every(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: prefix and suffix minima of blocks of that width."""
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, least: int, longest: int):
    """Runs of windows of ``least`` bytes with the same least value: first window, windows, value, fingerprint of the
    bytes of its windows of ``longest`` bytes, whether the value is in it twice."""
    n, context = len(data), context_of(least)
    width = least - context + 1
    if n < least:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    value = _Hashes(data).every(context)
    low = _sliding_min(value, width)
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    count = np.diff(np.append(first, len(low)))
    own = low[first]
    end = np.minimum(first + count - 1 + longest, n)
    prints = mix(_Hashes(data, 1).of(first, end) + (end - first).astype(np.uint64))
    known = np.unique(own)
    place = np.flatnonzero(value <= known[-1])  # only these can be sampled
    at = np.searchsorted(known, value[place])
    place, at = (x[known[at] == value[place]] for x in (place, at))
    marks = np.sort(at << 40 | place)
    rank = np.searchsorted(known, own) << 40
    twice = np.searchsorted(marks, rank | (first + count + width - 2), "right") - np.searchsorted(marks, rank | first) > 1
    return first, count, own, prints, twice


ENTRIES = "row long, doc_id long, text_key binary, batch int, runs array<struct<first:int,count:int,value:long,print:long,twice:boolean>>"


def _list(column) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each row's list of structs ends (with a leading 0), and the structs' fields one after another."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return ends, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _doc(doc_id: str):
    """The id, which here only spreads copies; null is the least."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def entries(docs: DataFrame, doc_id: str, text: str, batches: int, least: int, longest: int) -> DataFrame:
    """The runs of every document, which gets a number (``row``)."""

    def run(parts: Iterator[pa.RecordBatch]):
        types, number = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()], TaskContext.get().partitionId() << 36
        for part in parts:
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                found = [runs(np.frombuffer(x, np.uint8), least, longest) for x in utf8(rows.column(3))]
                ends = np.cumsum([0, *(len(f[0]) for f in found)])
                cols = [np.concatenate([f[i] for f in found]) for i in range(5)]
                cols[2], cols[3] = signed(cols[2]), signed(cols[3])
                inner = pa.StructArray.from_arrays([pa.array(c).cast(t) for c, t in zip(cols, types)], names=["first", "count", "value", "print", "twice"])
                own = pa.array(np.arange(number, number + rows.num_rows))
                number += rows.num_rows
                yield pa.RecordBatch.from_arrays([own, *rows.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], names=["row", "doc_id", "text_key", "batch", "runs"])

    batch = F.pmod(F.xxhash64(doc_id, F.length(text)), F.lit(batches)).cast("int").alias("b")
    rows = docs.select(_doc(doc_id).alias("i"), _key(text).alias("k"), batch, F.col(text).alias("t"))
    return rows.where(F.octet_length("t") >= least).mapInArrow(run, ENTRIES)


class SuffixLevels:
    """The index family: written tables of sorted suffix values with their counts, at most one of each rank; rank r holds 2**r batches."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}

    @staticmethod
    def _sorted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("value").agg(F.sum("n").alias("n")).sortWithinPartitions("value")

    def add(self, batch: DataFrame) -> None:
        """Index a batch of entries; levels of the same size are merged on the way up."""
        rows = batch.select(F.inline("runs")).select("value", (F.lit(1) + F.col("twice").cast("int")).alias("n"))
        new, rank = written(self._sorted(rows), "level"), 0
        while rank in self.levels:
            old = self.levels.pop(rank)
            merged = written(self._sorted(old.unionByName(new)), "level")
            dropped(old)
            dropped(new)
            new, rank = merged, rank + 1
        self.levels[rank] = new

    def scan(self) -> DataFrame:
        """All levels merged: one row per different value."""
        found = list(self.levels.values())
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out if len(found) == 1 else self._sorted(out)

    def close(self) -> None:
        for x in self.levels.values():
            dropped(x)
        self.levels = {}


def _table(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


SHIPPED = "value long, chunk int, chunks int, row long, first int, count int, single boolean, data binary"
#: ``size`` numbers the lengths; with a ``core`` it is an open block of windows (``keys``), else a repeated range of windows.
MATCHED = "size int, row long, lo int, hi int, single boolean, value long, chunk int, core long, keys array<long>"


def _ship(longest: int):
    """The bytes of the runs that a text sends to those of equal value."""

    def run(parts):
        for part in (p.slice(at, 128) for p in parts for at in range(0, p.num_rows, 128)):
            texts, numbers = part.column(0).cast(pa.binary()), part.column(1).to_numpy()
            ends, f = _list(part.column(2))
            data = []
            for i in range(part.num_rows):
                text = texts[i].as_buffer()
                view = memoryview(text)
                for k in range(ends[i], ends[i + 1]):
                    at = int(f["first"][k])
                    data.append(bytes(view[at : at + int(f["count"][k]) - 1 + longest]))
            cols = [pa.array(f["value"]), pa.array(f["chunk"]), pa.array(f["chunks"]), pa.array(np.repeat(numbers, np.diff(ends))), pa.array(f["first"]), pa.array(f["count"]), pa.array(f["single"].astype(bool)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SHIPPED.split(", ")])

    return run


def _alike(group: pa.Table, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Repeated windows among whole chunks of runs of equal value, and what of chunks of a larger group stays open."""
    value, chunk, chunks, row, first, count = (group.column(i).to_numpy() for i in range(6))
    single, column = group.column(6).to_numpy(), group.column(7).combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    hashes = _Hashes(data), _Hashes(data, 1)
    least = min(lengths)
    for size, length in enumerate(lengths):
        n = np.minimum(count, np.maximum(0, bounds[1:] - bounds[:-1] - length + 1))  # windows that fit the text
        of, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(starts, n)
        place = bounds[of] + at
        key = mix(hashes[0].of(place, place + length) ^ mix(hashes[1].of(place, place + length) + value[of].view(np.uint64)))
        order = np.argsort(key, kind="stable")
        equal = key[order][1:] == key[order][:-1]
        alike = np.zeros(len(key), bool)
        alike[order[1:][equal]] = True
        alike[order[:-1][equal]] = True
        hit = np.flatnonzero(alike & single[of])
        if len(hit):
            start = np.append(True, (np.diff(hit) != 1) | (of[hit][1:] != of[hit][:-1]))
            a, b = hit[start], hit[np.append(start[1:], True)]
            m, none = len(a), [None] * len(a)
            yield _table([np.full(m, size), row[of[a]], first[of[a]] + at[a], first[of[a]] + at[b], np.ones(m, bool), *[none] * 4], MATCHED)
        out = []
        seen = np.zeros(len(key), bool)
        seen[order[1:][equal]] = True  # only the first of equal windows is carried on
        for i in np.flatnonzero(chunks > 1).tolist():
            own = data[bounds[i] : bounds[i + 1]]
            for lo, hi, core in aligned_blocks(own, int(value[i]), int(n[i]), length, least):
                new = ~seen[starts[i] + lo : starts[i] + hi + 1]
                if new.any():
                    keys = signed(key[starts[i] + lo : starts[i] + hi + 1])
                    out.append((size, row[i], first[i] + lo, first[i] + hi, bool(single[i]), value[i], chunk[i], core, [int(k) if x else None for k, x in zip(keys, new)]))
        if out:
            yield _table(list(zip(*out)), MATCHED)


def aligned_blocks(data: np.ndarray, value: int, windows: int, length: int, least: int) -> Iterator[tuple[int, int, int]]:
    """Blocks (first and last window, fingerprint of the core) of the windows of a run, aligned at the sampled suffix of
    each window. The core is what all ``BLOCK`` windows of an aligned block share: equal windows have equal cores."""
    if not windows:
        return
    near = np.flatnonzero(signed(_Hashes(data).every(context_of(least))) == value)
    at = np.arange(windows)
    suffix = near[np.searchsorted(near, at)]
    block = (suffix - at) // BLOCK
    first = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (suffix[1:] != suffix[:-1])))
    last = suffix[first] - BLOCK * block[first]
    core = signed(_Hashes(data, 1).of(last, last - BLOCK + 1 + length)) if length >= BLOCK else np.zeros(len(first), np.int64)
    yield from zip(first.tolist(), (np.append(first[1:], windows) - 1).tolist(), core.tolist())


def _matching(lengths: tuple[int, ...]):
    """Chunks of runs, which come sorted, are compared some at a time."""

    def run(parts):
        held, size, last = [], 0, None

        def flush():
            yield from _alike(pa.Table.from_batches(held), lengths)

        for part in parts:
            if not part.num_rows:
                continue
            value, chunk = (part.column(i).to_numpy() for i in range(2))
            weight = np.cumsum(pc.binary_length(part.column(7)).to_numpy())
            starts = np.flatnonzero(np.append((value[0], chunk[0]) != last, (value[1:] != value[:-1]) | (chunk[1:] != chunk[:-1])))
            done = 0
            for s in starts.tolist():
                here = size + int(weight[s - 1] if s else 0) - int(weight[done - 1] if done else 0)
                if here >= _BATCH_BYTES:
                    held.append(part.slice(done, s - done))
                    yield from flush()
                    held, size, done = [], 0, s
            held.append(part.slice(done))
            size += int(weight[-1]) - int(weight[done - 1] if done else 0)
            last = (value[-1], chunk[-1])
        if held:
            yield from flush()

    return run


def _crossing(open_blocks: DataFrame) -> DataFrame:
    """Repeated windows among the open blocks of different chunks. Every counted side is written before it is joined, so
    that Spark may split the other side of a frequent key."""
    differ = lambda rows, *key: written(rows.groupBy(*key).agg(F.min("chunk").alias("x"), F.max("chunk").alias("y")).where("x <> y").select(*key), "twice")
    live = open_blocks.join(differ(open_blocks, "size", "value", "core"), ["size", "value", "core"])
    windows = live.select("size", "value", "chunk", "row", "lo", "single", F.posexplode("keys").alias("k", "key")).where("key IS NOT NULL")
    windows = written(windows.select("size", "value", "key", "chunk", "row", (F.col("lo") + F.col("k")).alias("lo"), "single"), "windows")
    found = windows.where("single").join(differ(windows, "size", "value", "key"), ["size", "value", "key"])
    return found.select("size", "row", "lo", F.col("lo").alias("hi"))


def repeated_windows(docs: DataFrame, doc_id: str, text: str, batches: int, lengths: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The texts (row, text_key, doc_id), one row each, and their repeated windows (size, row, lo, hi), where ``size`` numbers the lengths."""
    least, longest = min(lengths), max(lengths)
    table = written(entries(docs, doc_id, text, batches, least, longest), "entries")
    owners = written(table.groupBy("text_key").agg(F.min(F.struct("row", "doc_id")).alias("o")).select("o.row", "text_key", "o.doc_id"), "owners")
    index = SuffixLevels()
    for b in range(batches):
        index.add(table.where(F.col("batch") == b))
    common = written(index.scan().where("n > 1").select("value"), "common")
    index.close()
    found = written(table.select("row", F.inline("runs")).join(common, "value"), "found")
    dropped(common)
    prints = found.groupBy("value", "print").agg(F.count("*").alias("n"), F.max("twice").alias("twice"), F.min(F.struct("row", "first")).alias("mine"))
    prints = written(prints, "prints")
    values = written(prints.groupBy("value").agg(F.count("*").alias("k"), F.max("twice").alias("self")), "values")
    chunks = F.ceil(F.col("k") / GROUP).cast("int")
    state = prints.join(values, "value").select("value", "print", F.when(F.col("n") == 1, True).otherwise(False).alias("single"), "mine", (F.col("self") | (F.col("k") > 1)).alias("close"), chunks.alias("chunks"))
    state = written(state.where("close OR NOT single"), "state")
    todo = found.join(state, ["value", "print"])
    todo = todo.withColumn("sent", F.col("close") & (F.col("mine") == F.struct("row", "first")))
    chunk = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    todo = todo.select("row", "first", "count", "value", "single", "sent", "chunks", chunk.alias("chunk")).join(owners.select("row"), "row")
    todo = written(todo, "todo")
    for x in (found, prints, values, state):
        dropped(x)

    sent = todo.where("sent").groupBy("row").agg(F.collect_list(F.struct("first", "count", "value", "single", "chunk", "chunks")).alias("sent"))
    source = docs.select(_key(text).alias("text_key"), _doc(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") >= least)
    texts = source.join(sent.join(owners, "row"), ["text_key", "doc_id"]).select("text", "row", "sent")
    shipped = texts.mapInArrow(_ship(longest), SHIPPED).repartition("value", "chunk").sortWithinPartitions("value", "chunk")
    matched = written(shipped.mapInArrow(_matching(lengths), MATCHED), "matched")
    out = matched.where("core IS NULL").select("size", "row", "lo", "hi")
    open_blocks = matched.where("core IS NOT NULL")
    if not open_blocks.isEmpty():
        out = out.unionByName(_crossing(open_blocks))
    whole = todo.where("NOT single").select(F.explode(F.sequence(F.lit(0), F.lit(len(lengths) - 1))).alias("size"), "row", F.col("first").alias("lo"), (F.col("first") + F.col("count") - 1).alias("hi"))
    return owners, out.unionByName(whole)


def _union(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as sorted starts and ends."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, far = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.append(True, lo[1:] > far[:-1]))
    return lo[first], far[np.append(first[1:], len(lo)) - 1]


def kept(data: bytes, starts, ends) -> bytes:
    return b"".join(data[a:b] for a, b in zip([0, *ends], [*starts, len(data)]))


SPANS = "text_key binary, size int, n_removed long, n_spans long, kept_sha256 string, starts array<int>, ends array<int>"


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, lengths: tuple[int, ...] = (LENGTH,), least_words: tuple[int, ...] = (0,)) -> DataFrame:
    """One row per different text and length for which it loses bytes: what goes and the digest of what stays. Of the
    repeated runs only those with the length's least number of words (the cut ones at the edges too) count."""
    owners, windows = repeated_windows(docs, doc_id, text, batches, lengths)
    ranges = windows.groupBy("row").agg(F.collect_list(F.struct("size", "lo", "hi")).alias("ranges")).join(owners, "row")
    source = docs.select(_key(text).alias("text_key"), _doc(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") >= min(lengths))

    def cut(parts):
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for part in (p.slice(at, 256) for p in parts for at in range(0, p.num_rows, 256)):
            keys, texts, out = part.column(0).to_pylist(), part.column(1).cast(pa.binary()), []
            ends, f = _list(part.column(2))
            for i, key in enumerate(keys):
                own, data = slice(ends[i], ends[i + 1]), None
                size, lo, hi = (f[k][own].astype(np.int64) for k in ("size", "lo", "hi"))
                for s, length in enumerate(lengths):
                    mine = size == s
                    if not mine.any():
                        continue
                    data = data or texts[i].as_py()
                    last = np.minimum(hi[mine], len(data) - length)  # a run of shorter windows may lack the longer ones
                    there = lo[mine] <= last
                    a, b = _union(lo[mine][there], last[there] + length)
                    if least_words[s]:
                        fits = [len(data[x:y].split()) >= least_words[s] for x, y in zip(a.tolist(), b.tolist())]
                        a, b = a[fits], b[fits]
                    if len(a):
                        out.append((key, s, int((b - a).sum()), len(a), hashlib.sha256(kept(data, a.tolist(), b.tolist())).hexdigest(), a.tolist(), b.tolist()))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in SPANS.split(", ")])

    return source.join(ranges, ["text_key", "doc_id"]).select("text_key", "text", "ranges").mapInArrow(cut, SPANS).dropDuplicates(["text_key", "size"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, length: int = LENGTH,
          passage: int = PASSAGE, words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document: bytes, removed bytes, removed runs, digest of the bytes kept; then ``n_passages`` and
    ``passage_bytes`` of the repeated runs of ``passage``-byte strings that hold at least ``words`` words (the stage's rule)."""
    spans = written(repeated_spans(docs, doc_id, text, batches, (length, passage), (0, words)).drop("starts", "ends"), "spans")
    at = lambda s, c: F.max(F.when(F.col("size") == s, F.col(c)))
    spans = spans.groupBy("text_key").agg(at(0, "n_removed").alias("r"), at(0, "n_spans").alias("s"), at(0, "kept_sha256").alias("h"), at(1, "n_spans").alias("p"), at(1, "n_removed").alias("q"))
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("text_key"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"))
    none = lambda c, name: F.coalesce(c, F.lit(0).cast("long")).alias(name)
    return rows.join(written(spans, "spans"), "text_key", "left").select("doc_id", "n_bytes", none("r", "n_removed"), none("s", "n_spans"), F.coalesce("h", "whole").alias("kept_sha256"), none("p", "n_passages"), none("q", "passage_bytes"))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return settled(lambda: dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "op6")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages: runs of repeated ``PASSAGE``-byte strings that hold ``PASSAGE_WORDS``
    words or more, in all their places. A character cut in two goes whole; ``n_chars`` follows."""
    spans = settled(lambda: repeated_spans(docs, lengths=(PASSAGE,), least_words=(PASSAGE_WORDS,)).select("text_key", "starts", "ends"), "spans")
    keyed = docs.withColumn("_keyloom_key", _key("text"))
    place = docs.columns.index("text")

    def cut(parts):
        for part in parts:
            for at in range(0, part.num_rows, 256):
                rows = part.slice(at, 256)
                texts = [t if a is None else kept(t.encode(), a, b).decode("utf-8", "ignore") for t, a, b in zip(rows.column(place).to_pylist(), rows.column(rows.num_columns - 2).to_pylist(), rows.column(rows.num_columns - 1).to_pylist())]
                cols = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(rows.columns[:-2])]
                yield pa.RecordBatch.from_arrays(cols, names=[f"c{i}" for i in range(len(cols))])

    joined = keyed.join(spans.withColumnRenamed("text_key", "_keyloom_key"), "_keyloom_key", "left").select(*docs.columns, "starts", "ends")
    types = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = joined.toDF(*(f"c{i}" for i in range(len(docs.columns))), "s", "e").mapInArrow(cut, types).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
