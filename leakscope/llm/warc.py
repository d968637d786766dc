"""WARC archives: written as one gzip stream a file, normalised to one member a record, read back by offset.

``write_archives`` uses Spark's text writer.  Its line separator is the end mark of a
WARC record, so each file is a valid archive in a single gzip member, on any store that
Spark writes to, with Spark's own commit.  ``normalise`` inflates each such stream once
and rewrites every record as a member of its own, with a sidecar of offsets beside it.
``read_records`` then reads members by their offsets, so that one large archive is
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import ship, text_or_empty

ship(__name__)

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Payloads below this many bytes are never turned into revisits.
LEAST_BYTES = 100
READ = 1 << 20
#: Bytes of archives that a task reads back.
TASK = 64 << 20
INDEX = "archive string, offset long, length long, record_id string"


def _safe(c: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]", "%0A")


def deduplicated(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, bytes, digest, refers_to``: the last is the smallest id with an equal payload, null for that page itself."""
    rows = pages.select(F.col(id).alias("page_id"), F.col(url).alias("url"), text_or_empty(F.col(html)).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    first = rows.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Pages that can have no partner, as all empty ones, are dealt out evenly.
    key = F.when(F.col("bytes") >= LEAST_BYTES, F.col("digest")).otherwise(F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string")))
    found = rows.withColumn("_key", key).join(first.select(F.col("digest").alias("_key"), "first"), "_key", "left")
    return found.withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first", "_key")


def write_archives(records: DataFrame, path: str) -> None:
    """Records of ``deduplicated`` as WARC files, each one gzip stream."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", _safe(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        optional("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.lit("Content-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit(END),
    )
    body = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")))
    records.select(body.alias("value")).write.option("compression", "gzip").option("lineSep", END).text(path)


def _open(uri: str):
    """File system and path of a uri; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _records(stream):
    """Header and payload of each record of an inflated stream, read piece by piece."""
    rest = b""

    def more() -> bool:
        nonlocal rest
        piece = stream.read(READ)
        rest += piece
        return bool(piece)

    while True:
        while (at := rest.find(b"\r\n\r\n")) < 0:
            if not more():
                if rest.strip():
                    raise ValueError("archive ends within a record header")
                return
        head, rest = rest[:at].lstrip(b"\r\n"), rest[at + 4 :]
        fields = _fields(head)
        size, pieces = int(fields["content-length"]), []
        while (lacking := size - len(rest)) > 0:
            pieces.append(rest)
            size -= len(rest)
            rest = stream.read(max(READ, min(lacking, 16 * READ)))
            if not rest:
                raise ValueError("archive ends within a record")
        pieces.append(rest[:size])
        rest = rest[size:]
        while len(rest) < 4 and more():
            pass
        rest = rest[4:] if rest.startswith(b"\r\n\r\n") else rest
        yield head, fields, b"".join(pieces)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives below ``source``; the offset index ``(archive, offset, length, record_id)``.

    Every record becomes its own gzip member.  An archive is one stream and so one task,
    which holds one record at a time.  Each attempt writes files of its own name, and only
    archives that a finished task reports count, so a lost executor leaves nothing wrong.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "length")
    tasks = files.repartitionByRange(max(1, files.count()), "path").select("path")

    def rewrite(batches):
        import gzip
        import json
        import uuid
        import zlib

        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                name = f"{target}/{path.rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex}.warc.gz"
                store, place = _open(path)
                out_store, out = _open(name)
                out_store.create_dir(out.rsplit("/", 1)[0], recursive=True)
                sidecar, offset = [], 0
                with store.open_input_stream(place, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream, out_store.open_output_stream(out, compression=None) as sink:
                    for head, fields, payload in _records(stream):
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(head + b"\r\n\r\n") + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()
                        sink.write(member)
                        sidecar.append((name, offset, len(member), fields.get("warc-record-id", "")))
                        offset += len(member)
                names = ("archive", "offset", "length", "record_id")
                with out_store.open_output_stream(out.removesuffix(".warc.gz") + ".index.json", compression=None) as index:
                    index.write("".join(json.dumps(dict(zip(names, x))) + "\n" for x in sidecar).encode())
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name], pa.string()), "records": pa.array([len(sidecar)], pa.int64())})

    done = tasks.mapInArrow(rewrite, "archive string, records long")
    manifest = f"{target}/manifest"
    done.write.parquet(manifest)
    done = spark.read.parquet(manifest)
    if done.isEmpty():
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.index.json").json(target).join(done.select("archive"), "archive", "left_semi")


def read_records(index: DataFrame) -> DataFrame:
    """Records by their offsets: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload``.

    Digest and length of a response are taken from the payload that was read; a revisit has
    no payload (null) and carries those of the full one in its header.
    """

    def read(batches):
        import hashlib
        import zlib

        import pyarrow as pa

        archive, source = None, None
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
        number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:none>" else None
        for batch in batches:
            out, held = [], 0
            for row in batch.to_pylist():
                if row["archive"] != archive:
                    archive = row["archive"]
                    store, place = _open(archive)
                    source = store.open_input_file(place)
                source.seek(row["offset"])
                head, _, rest = zlib.decompress(source.read(row["length"]), 31).partition(b"\r\n\r\n")
                fields = _fields(head)
                payload = rest[: int(fields["content-length"])]
                revisit = fields["warc-type"] == "revisit"
                out.append({
                    "page_id": number(fields["warc-record-id"]),
                    "payload_bytes": int(fields["x-payload-length"]) if revisit else len(payload),
                    "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                    "record_type": fields["warc-type"], "refers_to": number(fields.get("warc-refers-to")),
                    "url": fields.get("warc-target-uri"), "payload": None if revisit else payload,
                })
                held += len(payload)
                if held > 1 << 24:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    # A count by the bytes of the archives: left to itself, Spark would go by those of the index.
    whole, records = index.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, -(-whole // TASK), min(records, index.sparkSession.sparkContext.defaultParallelism))
    return index.repartitionByRange(tasks, "archive", "offset").mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write, normalise and read back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row for each page.

    A null html is an empty payload.  Of equal payloads of 100 bytes or more the smallest
    page_id is the response and the others revisit it; rows that repeat that page_id are
    responses too, and so is a row without an id.
    """
    spark = pages.sparkSession
    source, target = shared_dir(spark, "warc-streams"), shared_dir(spark, "warc")
    write_archives(deduplicated(pages, id, url, html), source)
    return read_records(normalise(spark, source, target)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f
"""
