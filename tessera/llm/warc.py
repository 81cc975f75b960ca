"""WARC archives of pages, and one globally ordered index of their captures.

``write_archives`` stores each page as a WARC/1.1 record through Spark's text
writer, so archives go to any file system that Spark knows. A payload that was
seen before is a ``revisit`` record that names the first capture.
``read_archives`` parses the files by Content-Length. ``merge_index`` brings the
captures, locally sorted by archive, into one order by URL key and timestamp: runs are written
in blocks, the blocks are cut at the ends of key ranges, and the task of a range merges
its runs with a loser tree. Blocks reach it in the order of their first rows, so a run's next
block is read when the merge comes to it, and a task holds no more than one block of each run, however long the runs are.

Null and empty payloads are records of length zero. A null URL has an empty
URL key, a null timestamp is the epoch. Rows with equal page ids are separate records; captures of equal URL key and timestamp
follow in the order of archive and position. An empty table gives no
archives and an empty index.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_sample, shared_folder, written
from tessera.sources.tables import table

#: Payloads of fewer bytes are always stored, never referred to.
MIN_REVISIT_BYTES = 100
#: Records in one archive at most: it bounds what a reading task holds.
RECORDS_PER_ARCHIVE = 2_000
#: Captures in one block of a run at most.
BLOCK_ROWS = 256
#: Captures at most that decide where key ranges end, and of how many in a run one is asked.
SAMPLED_CAPTURES, SAMPLE_STEP = 10_000, 32
EPOCH = "1970-01-01T00:00:00Z"
INDEX_SCHEMA = "url_key string, capture_ts string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, position long"
#: A block has an array for each column of the index.
BLOCK_SCHEMA = ", ".join(f"{x.split()[0]} array<{x.split()[1]}>" for x in INDEX_SCHEMA.split(", "))
#: The order of captures, and where it stands in a row of the index.
ORDER = ("url_key", "capture_ts", "archive", "position")
PLACES = [[x.split()[0] for x in INDEX_SCHEMA.split(", ")].index(name) for name in ORDER]
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels in reverse, then the rest in lower case."""
    bare = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(www\.)?", ""))
    host, rest = F.regexp_extract(bare, r"^[^/?#]*", 0), F.regexp_extract(bare, r"^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, ts: Column) -> DataFrame:
    """Rows with the text of their record."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.coalesce(ts, F.lit(EPOCH)).alias("capture_ts"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("size", F.octet_length("payload").cast("long"))
    # One row for each payload that occurs again. The copies are narrow, and the partial minimum meets a hot payload before the shuffle.
    first = (
        rows.filter(F.col("size") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "first_id")
    )
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.col("capture_ts")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-URL-Key", url_key(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first_id").cast("string"), F.lit(">")))).otherwise(""),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    return rows.select(record.alias("value"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts: Column | None = None) -> None:
    """Write one record for each row of ``pages`` to gzipped archives in ``path``.

    Of rows with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that with
    the smallest id is a response and the others revisit it without a payload.
    """
    records = _records(pages, id_col, url_col, payload_col, F.lit(EPOCH) if ts is None else ts)
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(path)


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position in the uncompressed archive, headers, payload) of each record."""
    unzip, at, buffer = zlib.decompressobj(31), 0, b""
    source = memoryview(data)
    fed = 0

    def more() -> bool:
        nonlocal buffer, fed
        if fed >= len(source):
            return False
        buffer += unzip.decompress(source[fed : fed + 65536])
        fed += 65536
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("an archive ends inside a record's header")
                return
        first, *lines = buffer[:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = dict(x.split(": ", 1) for x in lines if ": " in x)
        stop = end + 4 + int(head["Content-Length"])
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError("an archive ends inside a record")
        yield at, head, buffer[end + 4 : stop]
        at, buffer = at + stop + 4, buffer[stop + 4 :]


def _id(urn: str | None) -> int | None:
    number = re.search(r"-?\d+", urn or "")
    return int(number[0]) if number else None


def _index_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
            rows = []
            for at, h, payload in parse_archive(content.as_buffer().to_pybytes()):
                kind, digest = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: the payload at byte {at} differs from its digest")
                rows.append((h.get("WARC-URL-Key", ""), h["WARC-Date"], _id(h.get("WARC-Record-ID")), kind, _id(h.get("WARC-Refers-To")), int(h["WARC-Payload-Length"]), digest, path, at))
            rows.sort(key=lambda r: (r[0].encode(), r[1], r[8]))  # the run of this archive
            for i in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 5000], strict=True), schema.types, strict=True)], schema=schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of the archives in ``path``; each archive is a run sorted by URL key and timestamp."""
    schema = _arrow_schema(INDEX_SCHEMA)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(lambda batches: _index_rows(batches, schema), INDEX_SCHEMA)


class LoserTree:
    """Merges sorted runs: an inner node holds the run that lost there, so each step costs one path to the root."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.sources = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.sources]
        self._build()

    def _build(self) -> None:
        self.k = max(1, len(self.sources))
        self.tree = [-1] * self.k
        for run in range(len(self.sources)):
            self._play(run)

    def add(self, run: Iterable[tuple]) -> None:
        """One more run. Runs that have ended leave, and the others play again."""
        live = [i for i, head in enumerate(self.heads) if head is not None]
        source = iter(run)
        self.sources = [*(self.sources[i] for i in live), source]
        self.heads = [*(self.heads[i] for i in live), next(source, None)]
        self._build()

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, run: int) -> None:
        at = (run + self.k) // 2
        while at > 0:
            if self.tree[at] < 0:
                self.tree[at] = run
                return
            if self._beats(self.tree[at], run):
                self.tree[at], run = run, self.tree[at]
            at //= 2
        self.tree[0] = run

    def before(self, bound: tuple | None) -> Iterator[tuple]:
        """Elements below ``bound`` in order, or all; those from it on stay."""
        while self.sources and (head := self.heads[self.tree[0]]) is not None and (bound is None or head < bound):
            best = self.tree[0]
            yield head
            self.heads[best] = next(self.sources[best], None)
            self._play(best)

    def __iter__(self) -> Iterator[tuple]:
        return self.before(None)


def merge_blocks(blocks: Iterable[list[tuple]]) -> Iterator[tuple]:
    """One order of sorted blocks that come in the order of their first elements: no block is read before the merge comes to it."""
    tree = LoserTree([])
    for block in blocks:
        yield from tree.before(block[0])
        tree.add(block)
    yield from tree


def _as_blocks(columns: list[pa.Array], starts: list[int], schema: pa.Schema) -> list[pa.Array]:
    """The columns as lists that begin at ``starts``."""
    offsets = pa.array([*starts, len(columns[0])], pa.int32())
    return [pa.ListArray.from_arrays(offsets, c).cast(t) for c, t in zip(columns, schema.types, strict=False)]


def _orders(columns: list[pa.Array]) -> list[tuple]:
    return list(zip(*(columns[i].to_pylist() for i in PLACES), strict=True))


def _runs(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Index rows in blocks; a block ends with its run, so at the latest where the order breaks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order, starts = _orders(batch.columns), [0]
        for i in range(1, len(order)):
            if i - starts[-1] == BLOCK_ROWS or order[i][2] != order[i - 1][2] or order[i] < order[i - 1]:
                starts.append(i)
        yield pa.RecordBatch.from_arrays(_as_blocks(batch.columns, starts, schema), schema=schema)


def _cut(batches: Iterator[pa.RecordBatch], ends: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks cut where a key range ends, each with the number of its range."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = batch.column(0).offsets.to_pylist()
        begins = {x - offsets[0] for x in offsets[:-1]}
        columns = [c.flatten() for c in batch.columns]
        ranges = [bisect_right(ends, x) for x in _orders(columns)]
        starts = [i for i, x in enumerate(ranges) if i in begins or x != ranges[i - 1]]
        arrays = [*_as_blocks(columns, starts, schema), pa.array([ranges[i] for i in starts], pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _merge(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Merges the blocks of one range."""
    serial = itertools.count()

    def blocks() -> Iterator[list[tuple]]:
        for batch in batches:
            for b in range(batch.num_rows):
                rows = zip(*(batch.column(j)[b].values.to_pylist() for j in range(len(schema))), strict=True)
                yield [(*(row[i] for i in PLACES), next(serial), row) for row in rows]

    rows = (x[-1] for x in merge_blocks(blocks()))
    while part := list(itertools.islice(rows, 5000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def merge_index(index: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in one order by URL key, timestamp, archive and position.

    The order has no ties, so a hot URL, even with one timestamp, is spread over ranges. These end at quantiles of at most
    ``SAMPLED_CAPTURES`` captures at regular places of the runs; the bound touches how even the ranges are, never the result.
    """
    n = partitions or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, blocks = _arrow_schema(INDEX_SCHEMA), _arrow_schema(BLOCK_SCHEMA)
    pieces = _arrow_schema(f"{BLOCK_SCHEMA}, range int")
    runs = written(index.mapInArrow(lambda batches: _runs(batches, blocks), BLOCK_SCHEMA))
    size = F.size(ORDER[0])
    at = F.explode(F.sequence(F.least(F.lit(SAMPLE_STEP // 2), F.floor(size / 2).cast("int")), size - 1, F.lit(SAMPLE_STEP))).alias("at")
    asked = runs.select(at, *ORDER).select(F.struct(*[F.get(name, F.col("at")).alias(name) for name in ORDER]).alias("asked"))
    sample = sorted(tuple(r.asked) for r in bounded_sample(asked, "asked", SAMPLED_CAPTURES).collect())
    ends = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    cut = runs.mapInArrow(lambda batches: _cut(batches, ends, pieces), f"{BLOCK_SCHEMA}, range int")
    dealt = cut.repartitionByRange(len(ends) + 1, "range").sortWithinPartitions(*[F.get(name, F.lit(0)) for name in ORDER])
    return dealt.drop("range").mapInArrow(lambda batches: _merge(batches, rows), INDEX_SCHEMA)


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as read back from its archive, through the merged index."""
    path = shared_folder(spark)
    write_archives(table(spark, folder, "pages"), path)
    index = merge_index(read_archives(spark, path))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
ORACLES = {
    "op8_warc": f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= {MIN_REVISIT_BYTES} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
}
