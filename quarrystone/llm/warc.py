"""Web archives: writing captures as WARC records, and transaction assembly on reading.

The writer makes three records of a capture: a request, a response (or, where another capture holds the
payload already, a revisit), and metadata. Request and metadata name the response in WARC-Concurrent-To.
Records end in two line ends, which is how the text sink ends its rows, so records are rows
and any file system that Spark writes to will do.

The reader goes by Content-Length. Spark's text source cuts an archive at each `WARC/1.`, a separator that no
part of which can begin another, so the pieces are exact; a task lays them end to end again and takes records off by their
lengths, so a payload may hold anything. Transactions are then joined by their records' identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import text as T
from quarrystone.llm.work import Work

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: What the text source cuts archives at: the beginning of each record, of this version or the one before.
CUT = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_RECORD = "record_id string, kind string, concurrent_to string, refers_to string, uri string, digest string, fields string, payload_bytes long, payload_digest string, whole boolean"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a text's UTF-8 bytes in base32: 32 upper-case characters."""
    digits = F.upper(F.sha1(payload.cast("binary")))
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _key(page: Column, digest: Column, url: Column, number: Column) -> Column:
    """What a row's three records are named by: page_id (empty: null), payload, URL, and a number among rows that are equal in these."""
    return F.concat_ws(":", F.coalesce(page.cast("string"), F.lit("")), digest, F.lower(F.hex(F.xxhash64(url))), number.cast("string"))


def _urn(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), key, F.lit(">"))


def page_of(urn: Column) -> Column:
    """The page_id in a record's identifier; null if it had none."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:capture:[a-z]+:(-?[0-9]*):", 1), F.lit("")).cast("long")


def _record(kind: Column | str, own: Column, date: str, fields: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A record's text, from its version line to its block's end; fields whose value is null are left out."""
    lines = [("WARC-Type", F.lit(kind) if isinstance(kind, str) else kind), ("WARC-Record-ID", own), ("WARC-Date", F.lit(date)), *fields, ("Content-Type", F.lit(content_type)), ("Content-Length", F.octet_length(block).cast("string"))]
    head = F.concat_ws(CRLF, *[F.concat(F.lit(f"{name}: "), value) for name, value in lines])
    return F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF + CRLF), block)


def _clean(value: Column) -> Column:
    """A header value on one line: control characters and blanks are percent-coded, and `%` too where they are."""
    bad = value.rlike(r"[\x00-\x20\x7f]")
    coded = F.regexp_replace(value, "%", "%25")
    for c, code in ((" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        coded = F.replace(coded, F.lit(c), F.lit(code))
    return F.when(bad, F.regexp_replace(coded, r"[\x00-\x1f\x7f]", "%00")).otherwise(value)


def records(pages: DataFrame, work: Work, least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """(record): three records per row of `pages` (page_id, url, html): request, response or revisit, metadata.

    The payload is the html's UTF-8 bytes (null: none). Of rows with equal payloads of at least `least_bytes` bytes, one with
    the largest page_id (null is the least) is the response, and the others revisit it; of rows that share that page_id, the
    one with the first URL. A null url is an empty one. Rows are captures of their own, even where they are
    equal in all three columns: such rows are gathered to one with a count and dealt out again. `date` is by default now.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", base32_sha1(F.col("html")))
    # Only digests, ids and URLs move to find the copies; then each html moves once, to meet its part in them.
    same = [F.col("page_id"), F.col("digest"), F.col("url")]
    ids = work.put(pages.where(F.octet_length("html") >= least_bytes).groupBy(*same).agg(F.count("*").alias("c")), "ids")
    short = pages.where(F.octet_length("html") < least_bytes).groupBy(*same).agg(F.count("*").alias("c")).where("c > 1")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.bitwise_not("page_id").alias("largest"), "page_id", "url"))
    copies = ids.groupBy("digest").agg(F.sum("c").alias("all"), first.alias("first")).where("all > 1").select("digest", F.col("first.page_id").alias("of_page"), F.col("first.url").alias("of_url"))
    plan = ids.join(copies, "digest").select(*same, "c", _key(F.col("of_page"), F.col("digest"), F.col("of_url"), F.lit(0)).alias("holder"))
    if least_bytes:
        plan = plan.union(short.select(*same, "c", F.lit(None).cast("string").alias("holder")))
    plan = work.put(plan, "plan").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("url").alias("u"), "c", "holder")
    rows = pages.join(plan, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")) & (F.col("url") == F.col("u")), "left").drop("p", "d", "u")
    if plan.where("c > 1").limit(1).count():
        equal = rows.where("c > 1").groupBy(*same, "c", "holder").agg(F.first("html").alias("html"))
        equal = equal.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("c").cast("int") - 1)))
        rows = rows.where("c is null or c = 1").withColumn("number", F.lit(0)).unionByName(equal)
    else:
        rows = rows.withColumn("number", F.lit(0))
    rows = rows.withColumn("key", _key(F.col("page_id"), F.col("digest"), F.col("url"), F.col("number")))
    key, original = F.col("key"), F.when(F.col("holder") != F.col("key"), F.col("holder"))
    uri, sha = ("WARC-Target-URI", _clean(F.col("url"))), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    own = _urn("response", key)
    host = F.regexp_extract("url", r"://([^/?#\s]*)", 1)
    # What is asked for is the path with its query; one that is empty is the root's.
    target = F.regexp_extract("url", r"://[^/?#\s]*([^#\s]*)", 1)
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    request = _record("request", _urn("request", key), date, [uri, ("WARC-Concurrent-To", own)], "application/http; msgtype=request", F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1" + CRLF + "Host: "), host, F.lit(CRLF + CRLF)))
    response = _record("response", own, date, [uri, sha], "application/http; msgtype=response", F.concat(F.lit(HTTP + CRLF), F.col("html")))
    revisit = _record("revisit", own, date, [uri, sha, ("WARC-Profile", F.lit(REVISIT_PROFILE)), ("WARC-Refers-To", _urn("response", original))], "application/http; msgtype=response", F.lit(HTTP + CRLF))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    metadata = _record("metadata", _urn("metadata", key), date, [uri, ("WARC-Concurrent-To", own)], "application/warc-fields", F.concat(F.lit("page_id: "), page, F.lit(CRLF)))
    return rows.select(F.explode(F.array(request, F.when(original.isNull(), response).otherwise(revisit), metadata)).alias("record"))


def write_archives(pages: DataFrame, path: str, work: Work, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Writes the records of `pages` as archives under `path`, one for each task."""
    records(pages, work, least_bytes).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record: record_id, kind, concurrent_to, refers_to, uri, digest, fields (of the block of metadata), payload_bytes, payload_digest and (with `payloads`) payload (of responses), whole.

    whole is false where the archive ends before the block does, or a record has no length. A task reads an archive from its
    beginning and holds one record at a time; so archives must be compressed (as is usual, by gzip, in one member or many), or no larger
    than a split of the text source, and a larger one raises an error. HTTP chunks are taken apart. Field names may be in any case.
    """
    raw = spark.read.option("lineSep", CUT.decode()).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    schema = f"{_RECORD}, payload string" if payloads else _RECORD

    def run(batches):
        file, held, size, need = None, [], 0, None
        out: list[tuple] = []
        volume = 0
        names = [x.split()[0] for x in schema.split(", ")]

        def flush():
            nonlocal volume
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            kinds = [pa.int64() if x == "payload_bytes" else pa.bool_() if x == "whole" else pa.string() for x in names]
            # Payloads of other encodings are carried as they are.
            arrays = [_strings(c) if x == "payload" else pa.array(list(c), k) for x, k, c in zip(names, kinds, cols, strict=True)]
            out.clear()
            volume = 0
            return pa.RecordBatch.from_arrays(arrays, names)

        def take():
            nonlocal held, size, need, volume
            row = _parsed(b"".join(held), payloads)
            held, size, need = [], 0, None
            if row:
                out.append(row)
                volume += len(row[-1] or b"") if payloads else 0

        for batch in batches:
            files, starts, pieces = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                piece = pieces[i].as_py()
                if file is None or files[i].as_py() != file:
                    if held:
                        take()
                    file = files[i].as_py()
                    if starts[i].as_py():
                        raise ValueError(f"{file}: an archive that is not compressed must fit one split of the text source")
                    # What stands before the first record, usually nothing, is no record.
                    continue
                if held and need is not None and size >= need:
                    take()
                held += [CUT, piece]
                size += len(CUT) + len(piece)
                if need is None:
                    need = _end(held[1] if len(held) == 2 else b"".join(held)[len(CUT) :])
                if len(out) >= 4096 or volume > 8 << 20:
                    yield flush()
        if held:
            take()
        if out:
            yield flush()

    return raw.mapInArrow(T.trimmed(run), schema)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)
_FIELD = re.compile(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)")
_CHUNKED = re.compile(rb"\r\ntransfer-encoding:[ \t]*chunked", re.I)


def _strings(values: tuple) -> pa.Array:
    """Bytes as an array of strings, unchecked."""
    raw = pa.array(list(values), pa.binary())
    return pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), raw.null_count, raw.offset)


def _end(piece: bytes) -> int | None:
    """Bytes from the record's beginning to its block's end; None if its head goes on."""
    head = piece.find(b"\r\n\r\n")
    if head < 0:
        return None
    length = _LENGTH.search(piece, 0, head)
    return len(CUT) + head + 4 + (int(length[1]) if length else 0)


def _parsed(record: bytes, payloads: bool) -> tuple | None:
    """A record's row; None if it has no head."""
    head = record.find(b"\r\n\r\n")
    if head < 0:
        return None
    own: dict[bytes, str] = {}
    for name, value in _FIELD.findall(record, 0, head):
        own.setdefault(name.strip().lower(), value.strip().decode("utf-8", "replace"))
    length = own.get(b"content-length", "")
    block = record[head + 4 : head + 4 + int(length)] if length.isdigit() else record[head + 4 :]
    kind, payload = own.get(b"warc-type"), None
    if kind == "response":
        at = block.find(b"\r\n\r\n")
        payload = block[at + 4 :] if at >= 0 else b""
        if at >= 0 and _CHUNKED.search(block, 0, at):
            payload = b"".join(_chunks(payload))
    digest = own.get(b"warc-payload-digest")
    row = (
        own.get(b"warc-record-id"), kind, own.get(b"warc-concurrent-to"), own.get(b"warc-refers-to"), own.get(b"warc-target-uri"), digest and digest.removeprefix("sha1:"),
        block.decode("utf-8", "replace") if kind == "metadata" else None,
        None if payload is None else len(payload), None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
        length.isdigit() and len(block) == int(length),
    )
    return (*row, payload) if payloads else row


def _chunks(body: bytes) -> Iterator[bytes]:
    """The parts of an HTTP body in chunks; what follows a broken size is one more."""
    at = 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at : end if end >= 0 else len(body)].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            yield body[at:]
            return
        if end < 0 or not int(size, 16):
            return
        yield body[end + 2 : end + 2 + int(size, 16)]
        at = end + 2 + int(size, 16) + 2


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Transaction assembly: a nested row per capture from the records of the archives under `path`, joined through concurrent-to identifiers.

    record_id, uri, record_type (response or revisit), refers_to, digest, whole, request (record_id), metadata
    (record_id, fields), response (payload_bytes, payload_digest), payload. Bytes and digest are those of the full payload, computed
    from what was read: a revisit's are those of the response it refers to, whose payload isn't repeated. A capture without a request
    or metadata has null there; records that belong to no response are left out; a record read twice counts once. Archives
    are parsed once into a table of heads, and payloads are moved only if they are asked for.
    """
    work = Work(spark, "captures")
    once = lambda df, key: df.dropDuplicates([key])
    heads = work.put(read_records(spark, path, payloads=False), "heads")
    main = once(heads.where("kind in ('response', 'revisit')"), "record_id").withColumnRenamed("kind", "record_type").drop("concurrent_to", "fields")
    # What revisits refer to, as a table: its join with them may meet a response that a third of them share.
    full = once(heads.where("kind = 'response'"), "record_id").select(F.col("record_id").alias("refers_to"), *[F.col(x).alias(f"full_{x}") for x in ("payload_bytes", "payload_digest")])
    full = work.put(full, "responses")
    own = F.struct("payload_bytes", "payload_digest").alias("response")
    cols = ["record_id", "uri", "record_type", "refers_to", "digest", "whole"]
    revisits = main.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(full, "refers_to", "left").withColumnsRenamed({"full_payload_bytes": "payload_bytes", "full_payload_digest": "payload_digest"})
    every = main.where("record_type = 'response'").select(*cols, own).union(revisits.select(*cols, own))
    beside = lambda kind, *more: once(heads.where(F.col("kind") == kind), "concurrent_to").select(F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id"), *more).alias(kind))
    payloads = once(read_records(spark, path).where("kind = 'response'").select("record_id", "payload"), "record_id")
    return every.join(beside("request"), "record_id", "left").join(beside("metadata", "fields"), "record_id", "left").join(payloads, "record_id", "left").select(*cols, "request", "metadata", "response", "payload")


def archive_and_assemble(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes `pages` into archives in the shared folder and returns the captures read back from them."""
    work = Work(pages.sparkSession, "warc")
    write_archives(pages, f"{work.path}/archives", work, least_bytes)
    work.drop("ids", "plan")
    return captures(pages.sparkSession, f"{work.path}/archives")
