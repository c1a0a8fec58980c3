"""WARC archives: records in segments with chunked transfer framing, written and read as tables.

Writing: equal payloads are one response (the least page_id) and revisits that refer to it. A response is an HTTP
message with a chunked body; a record over `segment` bytes becomes a first segment and continuation records that name
it as their origin. Spark's own text writer stores the records (its line separator is the blank line that ends every
WARC record), so files reach any store that Spark writes to, and a lost task is written again.

Reading: files are cut into records; continuations are grouped by origin identifier, ordered by segment number,
checked for gaps and against the total length, and joined; chunked framing is decoded; the payload is checked against
its digest; revisits take the payload of what they refer to. What fails is reported in `error` and has no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm._io import spread_join, written

SEGMENT, CHUNK = 32_768, 8_192
#: Bytes of records that a file is made for; whole files are read.
FILE_BYTES = 16 << 20
_END = b"\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """The bare base32 form of a SHA-1 digest, in upper case: eight groups of 20 bits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int) -> bytes:
    out = [b"%x\r\n%s\r\n" % (len(part := payload[i : i + size]), part) for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def _record(kind: str, name: str, url: str | None, block: bytes, *more: tuple[str, object]) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), *more, ("Content-Length", len(block))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block


def records(name: str, url: str | None, payload: bytes, digest: str, refers: str | None, segment: int, chunk: int) -> list[bytes]:
    """A page's records, without the blank line after each."""
    digest = f"sha1:{digest}"
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return [_record("revisit", name, url, block, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", refers))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk)
    if len(block) <= segment:
        return [_record("response", name, url, block, ("WARC-Payload-Digest", digest))]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", name, url, parts[0], ("WARC-Payload-Digest", digest), ("WARC-Segment-Number", 1))]
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if i == len(parts) else []
        out.append(_record("continuation", f"{name[:-1]}:segment:{i}>", url, part, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", i), *last))
    return out


def _build(segment: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page, dup, url, payload, digest, first_page, first_dup in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                refers = None if (page, dup) == (first_page, first_dup) else f"<urn:page:{first_page}:{first_dup}>"
                new = records(f"<urn:page:{page}:{dup}>", url, payload.encode(), digest, refers, segment, chunk)
                out += new
                size += sum(map(len, new))
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, segment: int = SEGMENT, chunk: int = CHUNK, file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for every row of pages (page_id, url, html) into gzip files under `path`.

    A null html is an empty payload, a null url an empty one; rows with a null page_id are left out. Of equal payloads
    of at least `least_bytes` the least page_id is the response; rows with the same page_id are told apart by a number.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).where("page_id is not null")
    size = rows.agg(F.sum(F.octet_length("payload") + 600)).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    # the shuffle that makes the files also brings the rows of a page_id together
    rows = rows.withColumn("key", F.concat(F.sha2("payload", 256), F.lit(":"), F.octet_length("payload")))
    numbered = "row_number() over (partition by page_id order by key, url)"
    light = rows.select("page_id", "url", "key").withColumn("dup", F.expr(numbered)).withColumn("key", F.when(F.substring_index("key", ":", -1).cast("long") >= least_bytes, F.col("key")).otherwise(F.concat_ws("/", "page_id", "dup", "key")))
    light = written(light.select("page_id", "dup", "key"), "warc-pages")
    firsts = light.groupBy("key").agg(F.min(F.struct("page_id", "dup")).alias("first"))
    chosen = spread_join(light, firsts, ["key"]).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("dup", "first"))).alias("firsts"))
    full = rows.repartition(files, "page_id").withColumn("dup", F.expr(numbered)).join(chosen, "page_id").withColumn("first", F.col("firsts")[F.col("dup")])
    full = full.select("page_id", "dup", "url", "payload", base32_sha1(F.col("payload")).alias("digest"), F.col("first.page_id").alias("first_page"), F.col("first.dup").alias("first_dup"))
    built = full.mapInArrow(_build(segment, chunk), "value binary")
    built.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _END.decode()).option("compression", "gzip").text(path)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a file's bytes, gzip members joined or not."""
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest) + member.flush())
            rest = member.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.index(_END, at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, unframed."""
    head, _, body = block.partition(_END)
    return unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:\s*chunked", head) else body


def _checked(block: bytes, digest: str | None) -> tuple[bytes | None, str | None, str | None]:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, str(e)
    got = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and digest.removeprefix("sha1:") != got:
        return None, None, "the payload differs from its digest"
    return payload, got, None


_PARTS = "record_id string, type string, url string, refers string, told string, segment int, total long, block binary, payload binary, n long, digest string, error string"


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARTS.split(", ")]
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _PARTS.split(", ")])
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for head, block in parsed(data.as_py()):
                    kind, number = head.get("warc-type"), head.get("warc-segment-number")
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    row = dict.fromkeys(names) | {"record_id": head.get("warc-segment-origin-id") if kind == "continuation" else head["warc-record-id"]}
                    if kind != "continuation":
                        row |= {"type": kind, "url": head.get("warc-target-uri"), "refers": head.get("warc-refers-to"), "told": head.get("warc-payload-digest")}
                    if number:
                        total = head.get("warc-segment-total-length")
                        row |= {"segment": int(number), "total": int(total) if total else None, "block": block}
                    elif kind == "response":
                        payload, digest, error = _checked(block, row["told"])
                        row |= {"payload": payload if payloads else None, "n": None if payload is None else len(payload), "digest": digest, "error": error}
                    rows.append(row)
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _join_segments(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for segments, total, told, payload, n, digest, error in zip(*[batch.column(c).to_pylist() for c in ("segments", "total", "told", "payload", "n", "digest", "error")], strict=True):
                if segments:
                    block = b"".join(s["block"] for s in segments)
                    if [s["segment"] for s in segments] != list(range(1, len(segments) + 1)) or total is None:
                        payload, digest, error = None, None, "segments are missing"
                    elif len(block) != total:
                        payload, digest, error = None, None, "segments differ from the total length"
                    else:
                        payload, digest, error = _checked(block, told)
                    n = None if payload is None else len(payload)
                out.append((payload if payloads else None, n, digest, error))
            cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 4, (pa.binary(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("record_id", "type", "url", "refers")), *cols], ["record_id", "type", "url", "refers", "payload", "n", "digest", "error"])

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """record_id, record_type, url, refers_to (record), payload, payload_bytes, payload_digest, error of each record.

    Files under `path` may be plain or gzip. Without payloads only their sizes and digests are kept. Segments of one
    record meet in one task, as its payload has to; nothing else is grouped.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = files.mapInArrow(_read(payloads), _PARTS)
    found = parts.groupBy("record_id").agg(
        *[F.max(c).alias(c) for c in ("type", "url", "refers", "told", "total", "payload", "n", "digest", "error")],
        F.sort_array(F.collect_list(F.when(F.col("segment").isNotNull(), F.struct("segment", "block")))).alias("segments"),
    )
    whole = found.mapInArrow(_join_segments(payloads), "record_id string, type string, url string, refers string, payload binary, n long, digest string, error string")
    whole = written(whole, "warc-records")
    given = whole.where("type = 'response'").select(F.col("record_id").alias("refers"), *[F.col(c).alias(f"{c}_") for c in ("payload", "n", "digest", "error")])
    # only revisits look for a response, and a response may have any number of them
    again = F.coalesce(F.col("type") == "revisit", F.lit(False))
    met = spread_join(whole.where(again), given, ["refers"], "left").unionByName(whole.where(~again), allowMissingColumns=True)
    pick = lambda c: F.when(F.col("type") == "revisit", F.col(f"{c}_")).otherwise(F.col(c))
    lost = (F.col("type") == "revisit") & F.col("n_").isNull()
    return met.select(
        "record_id", F.coalesce("type", F.lit("continuation")).alias("record_type"), "url", F.col("refers").alias("refers_to"),
        pick("payload").alias("payload"), pick("n").alias("payload_bytes"), pick("digest").alias("payload_digest"), F.when(lost, F.coalesce("error_", F.lit("what it refers to is missing"))).otherwise(F.when(F.col("type").isNull(), F.lit("its origin is missing")).otherwise(F.col("error"))).alias("error"),
    )


def archived_pages(pages: DataFrame, path: str, **more: int) -> DataFrame:
    """Writes pages to an archive and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, error."""
    write_archive(pages, path, **more)
    found = read_archive(pages.sparkSession, path, payloads=False)
    page = lambda c: F.split_part(F.col(c), F.lit(":"), F.lit(3)).cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "error")
