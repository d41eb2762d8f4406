"""Operator 4, token counts: unigram segmentation with dynamic programming shared along a trie.

A text's pre-tokens are its maximal runs of non-blank characters, each with the piece marker in front. A worker
inserts the distinct pre-tokens in a trie, whose nodes hold the forward score of their prefix (the best
segmentation's log-probability and its number of tokens) and the pieces that go on beyond it: it is computed once, when the first pre-token that
has the prefix comes, and shared by all others. The terminal node's count is stored by pre-token, and a
text's count is the sum over its pre-tokens. The trie and the counts outlive a task and start anew beyond a size.

The pieces are those of a public tokenizer file, whose scores are ranks; a piece of rank r has
log-probability -ln(r + 2) - ``PIECE_COST``. A character in no piece costs one token for each of its UTF-8
bytes. Ties in score go to fewer tokens.

Defined results: a null, empty or blank text has no pre-token and no token; repeated rows count alike; a
pre-token of any length is handled whole.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import portions

MARK, PIECE_COST, BYTE_SCORE = "▁", 2.0, -14.0
#: Distinct pre-tokens whose counts a worker keeps, nodes of its trie, and characters beyond which a pre-token is not inserted.
CACHE, NODES, LONG = 300_000, 400_000, 200


def pieces(model_path: str) -> dict[str, float]:
    """Piece -> log-probability from the ranks of a sentencepiece file (control and byte pieces left out)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    return {sp.id_to_piece(i): -math.log(rank + 2) - PIECE_COST for rank, i in enumerate(usable)}


class Trie:
    """Pre-tokens by shared prefix. A node is [score, minus tokens, live, children]: the best segmentation of its prefix, and the
    pieces that have begun in the prefix and can go on, as (place in the pieces' own trie, score and minus tokens before the piece).
    A child takes its forward score from its parent's live pieces alone."""

    def __init__(self, scores: dict[str, float]):
        self.pieces: dict = {}
        for piece, score in scores.items():
            at = self.pieces
            for c in piece[:-1]:
                at = at.setdefault(c, [None, {}])[1]
            at.setdefault(piece[-1], [None, {}])[0] = score
        self._renew()

    def _renew(self) -> None:
        self.root, self.nodes = [0.0, 0, (), {}], 0

    def count(self, word: str) -> int:
        """Tokens of a word, which is inserted unless it is very long."""
        node, step = self.root, self._step
        if len(word) > LONG:
            for c in word:
                node = step(node, c)
            return -node[1]
        if self.nodes > NODES:
            self._renew()
            node = self.root
        for c in word:
            children = node[3]
            child = children.get(c)
            if child is None:
                child = children[c] = step(node, c)
                self.nodes += 1
            node = child
        return -node[1]

    def _step(self, node: list, c: str) -> list:
        """The node of a prefix with one more character."""
        score, minus, live, _ = node
        size = 1 if c < "\x80" else len(c.encode("utf-8", "replace"))
        top, top_minus, alive = score + BYTE_SCORE * size, minus - size, []
        for pieces, before, less in (*live, (self.pieces, score, minus)):
            found = pieces.get(c)
            if found is not None:
                own, longer = found
                if own is not None:
                    s, m = before + own, less - 1
                    if s > top or s == top and m > top_minus:
                        top, top_minus = s, m
                if longer:
                    alive.append((longer, before, less))
        return [top, top_minus, alive, {}]


class Counts(dict):
    """Pre-token -> tokens, computed on first use."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.trie = Trie(scores)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = n = self.trie.count(MARK + word)
        return n


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without Python's search for cycles: the trie has none, and passes over its nodes would take most of the time."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(1)
def _counts(model_path: str) -> Counts:
    return Counts(pieces(model_path))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", n_words: str = "n_pretokens", n_tokens: str = "n_tokens") -> DataFrame:
    """``docs`` without its text, with the number of pre-tokens and tokens."""
    kept = [c for c in docs.columns if c not in (text, n_words, n_tokens)]

    def run(batches):
        get = _counts(model_path).__getitem__
        for batch in batches:
            for part in portions(batch, batch.num_columns - 1):
                words = [(t or "").split() for t in part.column(part.num_columns - 1).to_pylist()]
                with _uncollected():
                    n = [sum(map(get, own)) for own in words]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([len(own) for own in words], pa.int64()), pa.array(n, pa.int64())], names=[*(f"c{i}" for i in range(len(kept))), "w", "n"])

    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)), F.col(text).alias("t"))
    types = "".join(f"c{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(kept))
    return source.mapInArrow(run, f"{types}w long, n long").toDF(*kept, n_words, n_tokens)


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
