"""Removal of byte strings that occur more than once, by a radix sort of suffixes to a set depth.

Suffixes are told apart only through their first ``WINDOW`` bytes, digit by digit
from the most significant, and a suffix that is alone in its group drops out. The
digits are chosen by content, so that they mean the same in every text: the first
is the anchor of the window (see ``repeats``), the second the block of suffixes
around it, whose equal groups hold repeated windows through their whole depth.
Groups that are small after two digits are finished by comparing bytes, as radix
sorts finish small buckets; large ones go through one more pass over whole windows.

Null texts count as empty ones; texts shorter than a window are kept whole.
Matches never cross texts, and bytes are removed whatever characters they are part
of. Repeated rows are copies of each other. Rows that share an id are separate
texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textarrays as ta
from tessera.llm.repeats import Units, without_repeats
from tessera.sources.tables import table

#: Bytes of a window, and of the k-grams that anchors are chosen from.
WINDOW, ANCHOR = 200, 50

_BYTE = ta.mixed(np.arange(1, 257, dtype=np.uint64))


def _split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = ta.raw(text)
    return _BYTE[data], data, offsets


def _finish(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    kept, at = [], 0
    for a, z in spans:
        kept.append(text[at:a])
        at = z
    kept.append(text[at:])
    kept = b"".join(kept)
    return len(text), len(text) - len(kept), kept


def units(window: int = WINDOW, anchor: int = ANCHOR) -> Units:
    """Bytes, ``window`` of them in a window."""
    return Units(window, min(anchor, window), np.uint8, _split, _finish)


def remove_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For each row ``id, n_units, n_removed, n_spans`` and ``kept``, its other bytes."""
    return without_repeats(docs, units(window, anchor), id_col, text_col, bytes)


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of what is left of every document."""
    docs = table(spark, folder, "documents")
    left = without_repeats(docs, units(), "doc_id", "text", lambda kept: hashlib.sha256(kept).digest())
    return left.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES = {
    "op10_suffix_dedup": f"""
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), g AS (
  SELECT doc_id, unnest(range(0, len(x) // 2 - {WINDOW - 1})) AS p, x FROM h WHERE len(x) >= {2 * WINDOW}
), k AS (
  SELECT doc_id, p, md5(x[2 * p + 1 : 2 * p + {2 * WINDOW}]) AS k FROM g
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1
), s AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM r
), m AS (
  SELECT doc_id, p, sum(CASE WHEN b IS NULL OR p > b + {WINDOW} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s
), spans AS (
  SELECT doc_id, run, min(p) AS a, max(p) + {WINDOW} AS z FROM m GROUP BY doc_id, run
), pieces AS (
  SELECT doc_id, run AS o, z - a AS gone, x[2 * coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 : 2 * a] AS piece FROM spans JOIN h USING (doc_id)
  UNION ALL
  SELECT doc_id, max(run) + 1 AS o, 0 AS gone, any_value(x)[2 * max(z) + 1 :] AS piece FROM spans JOIN h USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY o) AS y, sum(gone) AS gone, count(*) - 1 AS runs FROM pieces GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM h LEFT JOIN kept USING (doc_id)
"""
}
