"""WARC archives: one gzip member per record, and a splittable reader.

**Writing.** Every task writes its rows to archives of its own in the shared folder, under names no other
attempt uses, and returns a manifest row (path, bytes, records). The manifest is a committed table, so
files of lost attempts are never read. Of records with equal payloads of at least ``MIN_REVISIT`` bytes the
one with the largest page id is the response and the others revisit it; which one that is comes from a
grouped maximum over digests (combined before the shuffle) that is joined back, so a payload that a third
of all pages share is a skewed join side that adaptive execution splits, never one group in one task.

**Reading.** Archives are cut into byte ranges without looking inside. A task searches its range for the
gzip magic, accepts a candidate when it inflates to a WARC header and its member ends at another member
or the end of the file, and owns the records that start inside its range, reading past its end for the last
of them. Payload digests are checked against the header, and the records read from every archive against
the manifest's number.

Defined cases: null html is an empty payload; a null url has no target header; a null page id is written as
such and read back as null, and revisits a page with an id where there is one; rows that repeat the
winning id are all responses; an empty table gives an empty manifest and result.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import register, shared_path, small_batches, staged, table

MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 4 << 20
#: Reading tasks; beyond it a task reads several ranges.
MAX_TASKS = 20_000
DATE = "2024-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_HEAD = b"WARC/1."
RECORD = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long")


def _ident(page_id) -> str:
    return "<urn:x-page:none>" if pd.isna(page_id) else f"<urn:x-page:{int(page_id)}>"


def _page(ident: str | None) -> int | None:
    last = (ident or "none>")[:-1].rpartition(":")[2]
    return None if last == "none" else int(last)


def _quoted(url: str) -> str:
    """A url fit for a header line, reversibly."""
    return "".join(f"%{ord(c):02X}" if c in "%\r\n" else c for c in url) if set(url) & set("\r\n") \
        else url


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member; a revisit keeps the headers of the page and leaves its payload out."""
    revisit = not pd.isna(refers_to)
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_ident(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Refers-To: {_ident(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parsed(data: bytes) -> tuple:
    """A record's columns of ``RECORD``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return (_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, refers)


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and refers_to (null: a response)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    winners = (rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("digest")
               .agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(winners, "digest", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).drop("top")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, digest, refers_to); the manifest (path, bytes, records)."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = fs.FileSystem.from_uri(folder)
        out, name, size, n, done = None, "", 0, 0, []
        for b in batches:
            for row in b.itertuples(index=False):
                if out is None:
                    store.create_dir(top, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                url = row.url if isinstance(row.url, str) else None
                member = record(row.page_id, url, row.html.encode("utf-8", "surrogatepass"),
                                row.digest, row.refers_to)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    small_batches(pages.sparkSession)
    return pages.mapInPandas(write, "path string, bytes long, records long")


class _Window:
    """Bytes of a file from a position on, read on in blocks when asked for more."""

    def __init__(self, file, start: int, block: int = 1 << 20):
        self.file, self.start, self.block, self.data = file, start, block, b""
        file.seek(start)

    def upto(self, end: int) -> bool:
        while self.start + len(self.data) < end:
            more = self.file.read(max(self.block, end - self.start - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def drop(self, to: int) -> None:
        self.data, self.start = self.data[to - self.start:], to


def _member(win: _Window, at: int) -> tuple[bytes, int] | None:
    """The content and end of the gzip member at ``at``; None if there is no record."""
    unpack, out, pos, head = zlib.decompressobj(31), [], at, b""
    try:
        while not unpack.eof:
            if not win.upto(pos + 1):
                return None
            piece = win.data[pos - win.start:pos - win.start + 65536]
            out.append(unpack.decompress(piece))
            pos += len(piece)
            if len(head) < len(_HEAD):  # the first bytes of a member may inflate to nothing yet
                head += out[-1][:len(_HEAD) - len(head)]
                if not _HEAD.startswith(head) or unpack.eof and head != _HEAD:
                    return None
    except zlib.error:
        return None
    end = pos - len(unpack.unused_data)
    if win.upto(end + 3):  # a member nested in another's stored bytes is not followed by a member
        if win.data[end - win.start:end - win.start + 3] != _MAGIC:
            return None
    elif win.upto(end + 1):
        return None
    return b"".join(out), end


def range_records(file, start: int, end: int) -> Iterator[bytes]:
    """The records that start in [start, end)."""
    win, at = _Window(file, start), start
    while at < end:
        win.upto(min(end, at + (1 << 20)) + 2)
        limit = min(end + 2, win.start + len(win.data))
        hit = win.data.find(_MAGIC, at - win.start, limit - win.start)
        if hit < 0:
            if limit >= end + 2 or not win.upto(limit + 1):
                return
            at = max(at + 1, limit - 2)
            win.drop(at)
            continue
        at = win.start + hit
        got = _member(win, at)
        if got is None:
            at += 1
            continue
        yield got[0]
        at = got[1]
        win.drop(at)


def read_archives(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``manifest`` (path, bytes, records) to the records' columns of ``RECORD``; an error if an archive
    gives another number of records."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                store, path = fs.FileSystem.from_uri(row.path)
                rows = []
                with store.open_input_file(path) as file:
                    for data in range_records(file, row.start, row.end):
                        rows.append(parsed(data))
                        if len(rows) == 1000:
                            yield _frame(rows, names).assign(path=row.path)
                            rows = []
                if rows:
                    yield _frame(rows, names).assign(path=row.path)

    step = F.lit(split_bytes).cast("long")
    ranges = manifest.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step))
        .alias("start")).select("path", "start", F.least(F.col("start") + step, F.col("bytes"))
                                .alias("end"))
    # Rows here are few bytes but much work, so their number decides, not their size.
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 0
    found = staged(ranges.repartition(max(1, min(int(total), MAX_TASKS)), "path", "start")
                   .mapInPandas(read, f"{RECORD}, path string"), "records")
    counts = found.groupBy("path").agg(F.count("*").alias("found"))
    wrong = (manifest.select("path", "records").join(counts, "path", "left")
             .where(~F.col("records").eqNullSafe(F.coalesce("found", F.lit(0))))).first()
    if wrong:
        raise ValueError(f"{wrong['path']}: {wrong['found'] or 0} of {wrong['records']} records read")
    return found.drop("path")


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


OP6_SQL = f"""
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END
  AS record_type, refers_to, url
FROM (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM top THEN top END AS refers_to
  FROM (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS
      payload_digest, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS top FROM pages))"""


@register("op6_warc", OP6_SQL)
def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    manifest = staged(write_archives(pages, shared_path(spark, "warc")), "manifest")
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                          "refers_to", "url")
