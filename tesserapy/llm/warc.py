"""WARC writing with revisits, and reading by boundary-chain verification.

Writing: payload digests are counted with partial aggregation, without the
payloads; of equal payloads the smallest id is written in full and the others as
revisit records. The digests that repeat are folded into a table of bits of a
fixed size, and only pages whose bit is set meet the repeated digests in a join:
a page that shares its payload with no other never leaves its task, but for the
few whose bit is set by chance. The files are written by Spark's own writer, so
they may lie in any store.

Reading: tasks look for the version line wherever it stands, and emit each
candidate's offset with the offset of the record that would follow it by its
Content-Length. From the start of a file, pointer jumping then marks what is
reachable. A version line inside a payload is never reached and is dropped.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FOLDED, checkpoint, discard, parted, shared_dir

LEAST = 100
FILE_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_END = b"\r\n\r\n"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, folded: int = FOLDED) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, refers_to (null for responses).

    Null payloads are empty. Payloads under ``least`` bytes are all responses.
    Rows that repeat both id and payload are all responses; a null id is never
    referred to unless no other row has the payload, and then its copies are
    responses too. A payload is one value of a row, however long it is. No pages:
    no rows. Other columns of the pages are left, whatever their names.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).cast("long").alias("n_bytes"))
    long = F.col("n_bytes") >= least
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = checkpoint(first.select(F.col("digest").alias("repeated"), "first"))
    key = F.when(long, F.xxhash64("digest"))
    several, alone = parted(rows, key, first.select(F.xxhash64("repeated").alias("key")), folded)
    joined = several.join(first, F.col("digest") == F.col("repeated"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    alone = alone.withColumn("refers_to", F.lit(None).cast(pages.schema[id_col].dataType))
    return alone.unionByName(joined.select(*rows.columns, refers.alias("refers_to")))


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(">"))


def record(rows: DataFrame) -> DataFrame:
    """One column: each row's record without the two line ends after it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), _record_id(F.col("refers_to")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("__body"), F.lit("\r\n\r\n"),
    )
    return rows.withColumn("__body", body).select(F.concat(head, F.col("__body")).alias("value"))


def write(rows: DataFrame, path: str, per_file: int = 0) -> None:
    """Write decided rows as WARC files (``part-*.txt``) under the path."""
    writer = record(rows).write.mode("overwrite").option("lineSep", "\r\n\r\n")
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}", text) else None


def _key(text: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
    return int(m[1]) if m else None


COLUMNS = (
    "file string, start long, next long, size long, record_type string, page_id long, refers_to long, url string,"
    " payload_bytes long, payload_digest string, payload binary"
)
_NAMES = [c.split()[0] for c in COLUMNS.split(",")]


def parse(content: bytes, keep: bool) -> list[tuple]:
    """A row for each version line in a file, whether it begins a record or not."""
    out, view = [], memoryview(content)
    for m in _MAGIC.finditer(content):
        a, stop = m.start(), content.find(_END, m.end())
        fields = _fields(content[a:stop]) if stop >= 0 else {}
        length = _number(fields.get("content-length"))
        after = -1 if stop < 0 or length is None or length < 0 else stop + 4 + length + 4
        if after > len(content) or after >= 0 and content[after - 4 : after] != _END:
            after = -1
        kind, payload, size = fields.get("warc-type"), None, None
        digest = (fields.get("warc-payload-digest") or "").removeprefix("sha256:") or None
        if after >= 0:
            block = view[stop + 4 : after - 4]
            cut = content.find(_END, stop + 4, after - 4)
            if cut >= 0:
                payload = block[cut + 4 - (stop + 4) :]
                size = _number(_fields(content[stop + 4 : cut]).get("content-length")) if kind == "revisit" else len(payload)
                if kind != "revisit":
                    digest = hashlib.sha256(payload).hexdigest()
        out.append((a, after, len(content), kind, _key(fields.get("warc-record-id")), _key(fields.get("warc-refers-to")), fields.get("warc-target-uri"), size, digest, bytes(payload) if keep and payload is not None else None))
    return out


def reachable(start: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates (sorted by offset) a file's first record leads to.

    Each round a marked candidate marks what its pointer names, and every
    pointer is replaced by its pointer's pointer. The last slot is the end.
    """
    n = len(start)
    to = np.searchsorted(start, after)
    exact = np.zeros(n, bool)
    inside = (to < n) & (after >= 0)
    exact[inside] = start[to[inside]] == after[inside]
    to = np.append(np.where(exact, to, n), n)
    mark = np.zeros(n + 1, bool)
    if n and start[0] == 0:
        mark[0] = True
    for _ in range(max(1, int(n).bit_length())):
        mark[to[mark]] = True
        to = to[to]
    mark = mark[:n]
    return mark & (after >= 0)


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of WARC files: file, start, record_type, page_id, refers_to, url,
    payload_bytes, payload_digest (recomputed for responses), payload if asked for.

    A task reads a file and emits its candidates; a second one for each file
    jumps pointers over offsets. The chain of a damaged file ends at the damage.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame([(file, *r) for r in parse(content, payloads)], columns=_NAMES)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content").mapInPandas(scan, COLUMNS)
    found = checkpoint(found)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", ignore_index=True)
        ok = reachable(pdf["start"].to_numpy(), pdf["next"].to_numpy(), int(pdf["size"].iloc[0]))
        return pdf.loc[ok, ["file", "start"]]

    kept = found.select("file", "start", "next", "size").groupBy("file").applyInPandas(chain, "file string, start long")
    kept = kept.select(F.col("file").alias("__file"), F.col("start").alias("__start"))
    joined = found.join(kept, (F.col("file") == F.col("__file")) & (F.col("start") == F.col("__start")))
    names = ["file", "start", "record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    return joined.select(*names)


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES, **columns) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A row of the pages is a row of the result, repeated rows too; null and empty
    payloads, null URLs and ids, long payloads, and tables without rows or with
    other columns are as in ``decide`` and ``read``. Without a path the files lie
    in the shared folder and are deleted once they are read.
    """
    spark, own = pages.sparkSession, path is None
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    html = F.col(columns.get("html_col", "html"))
    mean = pages.agg(F.avg(F.coalesce(F.octet_length(html), F.lit(0)) + 500)).first()[0]
    write(decide(pages, least=least, **columns), path, max(1, int(file_bytes / (mean or 1))))
    records = read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if own:  # what read() returns lies in a checkpoint
        discard(spark, path)
    return records
