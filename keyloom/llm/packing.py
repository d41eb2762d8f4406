"""Operator 2, packing: vector bin packing by the dot-product heuristic.

Examples have a size in three dimensions: tokens, segments (one a piece) and loss-bearing tokens. A
sequence is filled bin by bin: of the waiting pieces that fit in every dimension, the one whose size
vector has the largest dot product with the room that is left goes in. What no whole piece fills is
closed with the head of a piece that is cut there; a tail of a block that is less than a full sequence
is laid out as sequences of powers of two tokens, which need no padding.

A block is up to ``BLOCK_ROWS`` rows or ``BLOCK_TOKENS`` ids of one input partition, in the order of the
ids and texts: memory is bounded, nothing is shuffled, and a task that runs again gives the same
sequences for the same rows. The sequence id holds the partition in its upper bits.

Defined results: a null or empty text is one piece of the single end id; repeated rows are packed each;
a text of any length is cut into full sequences first; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens, segments and loss-bearing tokens that a sequence holds at most.
MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS = 2048, 256, 2048
BLOCK_ROWS, BLOCK_TOKENS = 4096, 8_000_000
#: The same limits for turns of conversations: half of a sequence may bear loss.
TURN_LIMITS = (2048, 64, 1024)
END_ID = 1
#: Distinct runs that a worker keeps.
_CACHE = 250_000
# The tokenizer's pre-token pattern (and line ends), and the characters for which this pattern is used here.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n").findall
_PLAIN = re.compile(r"[\x21-\x7e\u00c0-\u024f]*").fullmatch
_LATIN = re.compile(r"[\x00-\x7e\u00c0-\u024f]*").fullmatch


def pack(sizes: np.ndarray, losses: np.ndarray, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)):
    """Pieces (example, start, length, sequence, offset) of examples of ``sizes`` tokens each.

    The last ``losses[i]`` tokens of example i bear loss. Every sequence keeps all three limits.
    """
    tokens_max, segments_max, loss_max = limits
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    unit = np.array([1 / tokens_max, 1 / segments_max, 1 / loss_max])
    longest = min(tokens_max, loss_max)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    item, start, length = [], [], []
    for i, n in enumerate(sizes.tolist()):
        at = 0
        while n - at >= longest:  # whole sequences need no partner
            pieces.append((i, at, longest, sequence, 0))
            sequence, at = sequence + 1, at + longest
        if n > at:
            item.append(i), start.append(at), length.append(n - at)
    item, start, length = (np.array(x, np.int64) for x in (item, start, length))

    def loss_of(i, s, n):
        return np.maximum(0, s + n - np.maximum(s, sizes[i] - losses[i]))

    loss = loss_of(item, start, length)
    order = np.argsort(-length, kind="stable")
    item, start, length, loss = item[order], start[order], length[order], loss[order]
    left, waiting = np.ones(len(item), bool), len(item)
    spare = int(length.sum())
    while waiting:
        room = np.array([tokens_max, segments_max, loss_max])
        if spare < tokens_max:  # the tail of the block
            room[0] = 1 << (spare.bit_length() - 1)
        goal, offset = int(room[0]), 0
        while room[0] and waiting:
            if room[1] < 1:
                break
            fits = np.flatnonzero(left & (length <= room[0]) & (loss <= room[2]))
            if len(fits):
                gain = length[fits] * unit[0] * room[0] * unit[0] + unit[1] * room[1] * unit[1] + loss[fits] * unit[2] * room[2] * unit[2]
                k, n = int(fits[gain.argmax()]), -1
                n = int(length[k])
            else:
                k = int(np.flatnonzero(left)[0])
                n = int(min(length[k], room[0]))
                while n and loss_of(item[k], start[k], n) > room[2]:
                    n = int(n - (loss_of(item[k], start[k], n) - room[2]))
                if n <= 0:
                    break
            part = int(loss_of(item[k], start[k], n))
            pieces.append((int(item[k]), int(start[k]), n, sequence, offset))
            offset, room = offset + n, room - [n, 1, part]
            if n == length[k]:
                left[k], waiting = False, waiting - 1
            else:
                start[k], length[k], loss[k] = start[k] + n, length[k] - n, loss[k] - part
            spare -= n
        sequence += 1
        if offset < goal and waiting and offset == 0:
            raise ValueError("an example does not fit the limits")
        if waiting and waiting < len(left) // 2:
            keep = np.flatnonzero(left)
            item, start, length, loss, left = item[keep], start[keep], length[keep], loss[keep], np.ones(len(keep), bool)
    return pieces, sequence


class _Numbers(dict):
    """String -> its number; new ones wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class _Ids:
    """Id arrays by number, one after another."""

    def __init__(self):
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])

    def __getitem__(self, numbers: np.ndarray) -> np.ndarray:
        n = self.lengths[numbers]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - ends + n, n)]


def _lowered(text: str) -> str:
    """The text as the tokenizer normalises it where it holds ASCII and Latin letters only; else as it is."""
    if text.isascii():
        return text.lower() if "<|" not in text else text
    return unicodedata.normalize("NFC", text).lower() if _LATIN(text) and "<|" not in text else text


@lru_cache(1)
def _tokenizer(path: str) -> Callable[[list[str | None]], list[np.ndarray]]:
    """Texts -> id arrays. The tokenizer treats the runs between spaces and line ends alone, so each distinct
    run is encoded once by a worker. Runs of Latin letters, digits and ASCII signs are cut into pre-tokens here and only
    the pre-tokens that are new go through the tokenizer's model; any other run goes through the whole tokenizer."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t, bytewise = Tokenizer.from_file(path), ByteLevel(add_prefix_space=False, use_regex=False)
    runs, pieces, run_ids, piece_ids = _Numbers(), _Numbers(), _Ids(), _Ids()

    def flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(f) for f in found], np.int64)
        return np.fromiter((i for f in found for i in f), np.uint32, n.sum()), n

    def encode(new: list[str]) -> None:
        """Plain runs first, joined by line ends, then the others."""
        plain = [w for w in new if _PLAIN(w) and "<|" not in w]
        other = [w for w in new if not _PLAIN(w) or "<|" in w]
        joined = "\n".join(plain)
        cut = _PRETOKEN((joined if joined.isascii() else unicodedata.normalize("NFC", joined)).lower())
        numbers = np.fromiter(map(pieces.__getitem__, cut), np.int64, len(cut))
        piece_ids.append(*flat([[] if p == "\n" else [x.id for x in t.model.tokenize(p if p.isascii() else bytewise.pre_tokenize_str(p)[0][0])] for p in pieces.new]))
        pieces.new = []
        total = np.concatenate([[0], np.cumsum(piece_ids.lengths[numbers])])
        ends = np.append(np.flatnonzero(numbers == pieces["\n"]) if len(plain) > 1 else np.zeros(0, np.int64), len(numbers))
        bounds = total[ends] if plain else np.zeros(0, np.int64)
        ids, lengths = flat([t.encode(w, add_special_tokens=False).ids for w in other])
        run_ids.append(np.concatenate([piece_ids[numbers], ids]), np.concatenate([np.diff(bounds, prepend=0), lengths]))
        for i, w in enumerate([*plain, *other]):
            runs[w] = len(run_ids.lengths) - len(new) + i

    def ids_of(texts: list[str | None]) -> list[np.ndarray]:
        nonlocal runs, pieces, run_ids, piece_ids
        if len(runs) > _CACHE:
            runs, pieces, run_ids, piece_ids = _Numbers(), _Numbers(), _Ids(), _Ids()
        if not pieces:
            pieces["\n"] = 0
            piece_ids.append(np.zeros(0, np.uint32), np.zeros(1, np.int64))
        parts = [_lowered(x or "").replace("\n", " ").split(" ") for x in texts]
        numbers = [np.fromiter(map(runs.__getitem__, p), np.int64, len(p)) for p in parts]
        if runs.new:
            new, first = runs.new, len(run_ids.lengths)
            encode(new)
            order = np.fromiter(map(runs.__getitem__, new), np.int64, len(new))
            numbers = [np.where(own >= first, order[np.maximum(own - first, 0)], own) for own in numbers]
            runs.new = []
        return [run_ids[own] for own in numbers]

    return ids_of


def _blocks(batches: Iterator[pa.RecordBatch], encode) -> Iterator[tuple[list, list[np.ndarray]]]:
    keys, arrays, total = [], [], 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for at in range(0, len(ids), 512):
            for key, own in zip(ids[at : at + 512], encode(texts.slice(at, 512).to_pylist())):
                keys.append(key)
                arrays.append(np.append(own, np.uint32(END_ID)).astype("<u4"))
                total += len(own) + 1
                if len(keys) >= BLOCK_ROWS or total >= BLOCK_TOKENS:
                    yield keys, arrays
                    keys, arrays, total = [], [], 0
    if keys:
        yield keys, arrays


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
                   limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS)) -> DataFrame:
    """One row per piece of every document. All ids of a document but its first bear loss."""

    def run(batches):
        encode, first = _tokenizer(tokenizer_path), TaskContext.get().partitionId() << 36
        for keys, arrays in _blocks(batches, encode):
            order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0, arrays[i].tobytes()))
            sizes = np.array([len(arrays[i]) for i in order], np.int64)
            pieces, used = pack(sizes, sizes - 1, limits)
            rows = []
            for i, at, n, sequence, offset in pieces:
                own = arrays[order[i]]
                loss = min(n, at + n - 1)
                rows.append((keys[order[i]], at, n, zlib.crc32(own[at : at + n].tobytes()), len(own), first + sequence, offset, loss))
            first += used
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(doc_id, text).mapInArrow(run, SCHEMA)


TURNS = "conv_id {}, turn {}, start long, length long, loss_tokens long, turn_tokens long, sequence_id long, offset long"


def pack_turns(turns: DataFrame, tokenizer_path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
               bearing: tuple[str, ...] = ("assistant",), limits: tuple[int, int, int] = TURN_LIMITS) -> DataFrame:
    """Instruction data: one row per piece of every turn. All ids of a turn whose role is among ``bearing`` bear loss, those of other turns
    none, so that all three limits bind: a sequence holds so many loss-bearing tokens at most, and other turns fill its rest. A turn is
    an example of its own, so a conversation of any length needs no task to itself. A null role bears no loss."""
    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_id, turn)]
    schema = TURNS.format(*kinds)

    def run(batches):
        encode, first = _tokenizer(tokenizer_path), TaskContext.get().partitionId() << 36
        head = next(batches, None)
        if head is None:
            return
        key_types = [head.schema.field("key").type.field(k).type for k in ("c", "t")]
        for keys, arrays in _blocks(chain([head], batches), encode):
            order = sorted(range(len(keys)), key=lambda i: (*((keys[i][k] is None, keys[i][k] or 0) for k in ("c", "t")), arrays[i].tobytes()))
            sizes = np.array([len(arrays[i]) for i in order], np.int64)
            losses = np.where([keys[i]["b"] for i in order], sizes, 0)
            pieces, used = pack(sizes, losses, limits)
            rows = [(keys[order[i]]["c"], keys[order[i]]["t"], at, n, n if losses[i] else 0, int(sizes[i]), first + sequence, offset) for i, at, n, sequence, offset in pieces]
            first += used
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(zip(*rows), [*key_types, *[pa.int64()] * 6])], names=names)

    bears = F.coalesce(F.col(role).isin(*bearing), F.lit(False))
    source = turns.select(F.struct(F.col(conv_id).alias("c"), F.col(turn).alias("t"), bears.alias("b")).alias("key"), F.col(text).alias("text"))
    return source.mapInArrow(run, schema)


def pack_conversations(spark, sf_dir: str) -> DataFrame:
    return pack_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), _path())


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), _path())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every document left."""
    return pack_documents(docs, _path())
