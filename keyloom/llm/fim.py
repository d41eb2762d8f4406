"""Operator 12, fill-in-middle: documents are cut in three and rearranged, in a pyarrow.compute pipeline.

Per run of rows (bounded in bytes): a text's units get an end mark and are split at it into a list array; the lists are
flattened beside the indices of their parents, which gives each unit's ordinal; units are filtered by role (prefix up to
the first cut, middle up to the second, then suffix), rebuilt into lists, and each list is joined to a piece. The pieces are
joined element by element in the order of the form. The mark is the byte 0xFF, which UTF-8 never holds. Cuts come from SHA-256 of
``seed:id``, so that they don't depend on partitions; the digest is computed by Spark.

A unit is ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``. Forms: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle)
and ``spm`` (suffix, prefix, middle), each piece after its sentinel. A text that is empty or holds a sentinel stays plain, so that
:func:`restored` finds every text again.

Defined results: a null text is empty; a null id is hashed as an empty one; repeated rows give equal results; a text of any length is one
row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import portions

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 42, 50, 80

_UNIT, _END = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)", b"\xff"


def _mod(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(units: pa.Array, parents: pa.Array, role: pa.Array, rows: int) -> pa.Array:
    """The units of one role, rebuilt into a list for each of ``rows`` parents and joined."""
    own = pc.filter(parents, role)
    counts = pc.value_counts(own)
    n = pa.array(np.zeros(rows, np.int64)) if not len(counts) else pc.fill_null(pc.take(counts.field("counts"), pc.index_in(pa.array(np.arange(rows)), counts.field("values"))), 0)
    ends = pc.cumulative_sum(n)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, pc.filter(units, role)).cast(pa.list_(pa.binary())), b"")


def rearranged(texts: pa.Array, h: list[pa.Array], rate: int = RATE, spm: int = SPM) -> list[pa.Array]:
    """(output, n, form, prefix_chars, middle_chars) of texts and four arrays of draws; lengths are null where plain."""
    texts, rows = pc.fill_null(texts.cast(pa.binary()), b""), len(texts)
    lists = pc.split_pattern(pc.replace_substring_regex(texts, _UNIT, b"\\1" + _END), _END)  # each list ends with an empty rest
    n = pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())
    units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(pc.add(n, 1)), pc.add(n, 1))
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parents))
    cuts = [_mod(x, pc.add(n, 1)) for x in h[:2]]
    low, high = (pc.take(f(*cuts), parents) for f in (pc.min_element_wise, pc.max_element_wise))
    before, after = pc.less(ordinal, low), pc.greater_equal(ordinal, high)
    prefix, middle, suffix = (_joined(units, parents, role, rows) for role in (before, pc.invert(pc.or_(before, after)), after))

    held = pc.equal(pc.binary_length(texts), 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = pc.or_(held, pc.match_substring(texts, mark))
    hundred = pa.scalar(100, pa.int64())
    plain = pc.or_(held, pc.greater_equal(_mod(h[2], hundred), rate))
    form = pc.if_else(plain, "plain", pc.if_else(pc.less(_mod(h[3], hundred), spm), "spm", "psm"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    join = lambda *parts: pc.binary_join_element_wise(*(pa.scalar(x, pa.binary()) if isinstance(x, bytes) else x for x in parts), pa.scalar(b"", pa.binary()))
    output = pc.if_else(plain, texts, pc.if_else(pc.equal(form, "spm"), join(s, suffix, p, prefix, m, middle), join(p, prefix, s, suffix, m, middle)))
    lengths = [pc.if_else(plain, None, pc.utf8_length(x.cast(pa.string())).cast(pa.int64())) for x in (prefix, middle)]
    return [output.cast(pa.string()), n, form, *lengths]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per document: its id, ``output``, ``n`` units, ``form``, ``prefix_chars`` and ``middle_chars``.

    ``rate`` of a hundred documents are rearranged, ``spm`` of a hundred of those with the suffix first."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i}") for i in range(4)]
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in portions(batch, 1):
                found = rearranged(part.column(1), [part.column(2 + i) for i in range(4)], rate, spm)
                yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["id", "output", "n", "form", "prefix_chars", "middle_chars"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), *draws)
    return rows.mapInArrow(run, f"id {kind}, output string, n long, form string, prefix_chars long, middle_chars long").withColumnRenamed("id", doc_id)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text behind an output: a text that holds a sentinel is plain, so each splits its output once."""
    parts = F.split(F.col(output), "|".join((PREFIX, SUFFIX, MIDDLE)))
    first, second = F.when(F.col(form) == "psm", parts[1]).otherwise(parts[2]), F.when(F.col(form) == "psm", parts[2]).otherwise(parts[1])
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(F.concat(first, parts[3], second))


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(u[greatest(a, b) + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
