"""Removal of word passages that occur more than once, by compacting a de Bruijn graph.

Edges of the graph are runs of ``WINDOW`` words. Edges with one anchor (see
``repeats``) form a path of the text; a path whose anchor has no other content
anywhere doesn't branch and is one row, however often it occurs. Joins on anchors
find these paths and the few that branch. Only branching paths are taken apart
again: their words, fetched at their source coordinates, are compared word hash
by word hash. Repeated paths that touch in a text merge to one span.

Null and empty texts have no words; texts shorter than a window are kept whole.
Repeated rows are copies of each other, so their windows repeat. Rows that share an
id are separate texts. An empty table gives no rows.
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

#: Words of a window, and of the k-grams that anchors are chosen from.
WINDOW, ANCHOR = 35, 12


def _split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, distinct, offsets = ta.words(text)
    units = ta.hashes(distinct)[ids]
    return units, units, offsets


def _finish(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    words = text.split()
    kept, at = [], 0
    for a, z in spans:
        kept += words[at:a]
        at = z
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def units(window: int = WINDOW, anchor: int = ANCHOR) -> Units:
    """Words, ``window`` of them in a window."""
    return Units(window, min(anchor, window), np.uint64, _split, _finish)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For each row ``id, n_units, n_removed, n_spans`` and ``kept``, its other words joined by a space, in UTF-8."""
    return without_repeats(docs, units(window), id_col, text_col, bytes)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of what is left of every document."""
    docs = table(spark, folder, "documents")
    left = without_repeats(docs, units(), "doc_id", "text", lambda kept: hashlib.sha256(kept).digest())
    return left.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {
    "op7_substring_dedup": rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(ws) - {WINDOW - 2})) AS p, ws FROM w WHERE len(ws) >= {WINDOW}
), h AS (
  SELECT doc_id, p, md5(array_to_string(ws[p : p + {WINDOW - 1}], ' ')) AS k FROM g
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS q FROM r
), l AS (
  SELECT doc_id, list(q) AS qs FROM c GROUP BY doc_id
), o AS (
  SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS q FROM w
), k AS (
  SELECT o.doc_id, string_agg(x, ' ' ORDER BY q) AS kept FROM o ANTI JOIN c ON o.doc_id = c.doc_id AND o.q = c.q GROUP BY o.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
}
