"""WARC archives: written by Spark, read through a Python data source.

Writing needs no shuffle of payloads: which payloads repeat is found on their
digests alone.  A record is one text value, so Spark's own writer and its
commit protocol put the archives wherever Spark can write.

Reading plans partitions of whole files, takes predicates on the record type
and on other headers down to the reader, parses the header block of a record
first, and seeks past the payload when the headers rule the record out or the
payload is not asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition,
                                    IsNotNull)

from skein.llm import common
from skein.session import scratch_path

MIN_REVISIT = 1000            # payload bytes from which copies become revisits
FILE_ROWS = 5000              # records a file holds at most
PARTITION_BYTES = 32 << 20    # files are read together up to this size
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, "
          "payload_bytes bigint, refers_to string, payload string")
#: column -> header
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}


# ---- writing ----------------------------------------------------------------
def header(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def safe(url: Column) -> Column:
    """A url as a header value: percent sign, line ends and control bytes are
    escaped, so that no url can add a header."""
    out = F.regexp_replace(url, "%", "%25")
    for b in [*range(0x20), 0x7F]:
        out = F.replace(out, F.lit(chr(b)), F.lit(f"%{b:02X}"))
    return out


def digests(pages: DataFrame) -> DataFrame:
    """``pages`` with payload, payload_bytes, payload_digest."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload.cast("binary")).alias("payload_digest"), F.col("page_id").alias("order"))


def records(pages: DataFrame) -> DataFrame:
    """(value): one WARC record a row, without its last line ends."""
    d = digests(pages)
    # equal payloads: the digest and length are grouped, a count and a maximum a task and payload
    groups = (d.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest", "payload_bytes")
              .agg(F.max("order").alias("last"), F.count("*").alias("n")).where("n > 1")
              .select("payload_digest", "payload_bytes", F.col("last").cast("string").alias("last")))
    groups = common.store(groups, "warc-copies")        # stored: its size decides how it is joined
    d = d.join(groups, ["payload_digest", "payload_bytes"], "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    body = F.when(revisit, "").otherwise(F.concat(http, "payload"))
    block = F.octet_length(body)
    ident = lambda c: F.concat(F.lit(f"<{ID}"), c, F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", F.coalesce(ident(F.col("page_id")), F.lit(f"<{ID}>"))),
        header("WARC-Target-URI", safe(F.col("url"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        header("WARC-Refers-To", F.when(revisit, ident(F.col("last")))),
        header("WARC-Profile", F.when(revisit, PROFILE)),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        header("Content-Length", block.cast("string")), F.lit("\r\n"))
    return d.select(F.concat(head, body).alias("value"))


def write(pages: DataFrame, path: str) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html)."""
    (records(pages).write.option("lineSep", END).option("maxRecordsPerFile", FILE_ROWS).text(path))


# ---- reading ----------------------------------------------------------------
def filesystem(path: str):
    """(filesystem, path): local folders and any store that Arrow knows."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, frozenset]] = []     # header column, accepted values
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]):
        """Equality, IN and presence of header columns are done here."""
        for f in filters:
            col = getattr(f, "attribute", ())
            name = col[0] if len(col) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADERS and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.present.append(name)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs
        f, root = filesystem(self.path)
        infos = f.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((i.path, i.size) for i in infos
                       if i.is_file and i.base_name[:1] not in "._" and i.size)
        out, run, size = [], [], 0
        for path, n in found:
            if run and size + n > PARTITION_BYTES:
                out.append(Files(run))
                run, size = [], 0
            run.append(path)
            size += n
        return [*out, Files(run)] if run else out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        f, _ = filesystem(self.path)
        for path in partition.files:
            with f.open_input_file(path) as raw:
                yield from self.records(raw)

    def records(self, raw) -> Iterator[tuple]:
        buf = Window(raw)
        while (head := buf.header()) is not None:
            fields = parse(head)
            block = int(fields.get("content-length", 0))
            if self.accepts(fields):
                yield self.row(fields, buf.take(block) if self.payload else None)
            buf.skip_to(block + len(END))

    def accepts(self, fields: dict) -> bool:
        return (all(value(fields, c) in v for c, v in self.wanted)
                and all(value(fields, c) is not None for c in self.present))

    def row(self, fields: dict, block: bytes | None) -> tuple:
        body = None
        if block is not None and fields.get("warc-type") != "revisit":
            body = block[block.index(b"\r\n\r\n") + 4:].decode()
        size = fields.get("warc-payload-length")
        return (*[value(fields, c) for c in ("record_type", "record_id", "target_uri", "payload_digest")],
                None if size is None else int(size), value(fields, "refers_to"), body)


class Window:
    """A file read forward in pieces; what is skipped is not read."""
    PIECE = 1 << 16

    def __init__(self, raw):
        self.raw, self.buf, self.at = raw, b"", 0

    def fill(self) -> bool:
        more = self.raw.read(self.PIECE)
        self.buf, self.at = self.buf[self.at:] + more, 0
        return bool(more)

    def header(self) -> bytes | None:
        """The next header block, with the place behind it; None at the end."""
        while (end := self.buf.find(b"\r\n\r\n", self.at)) < 0:
            if not self.fill():
                if self.buf[self.at:].strip():
                    raise ValueError("the archive ends within a header")
                return None
        head = self.buf[self.at:end]
        self.at = end + 4
        self.taken = 0
        return head

    def take(self, n: int) -> bytes:
        missing = n - (len(self.buf) - self.at)
        if missing > 0:         # read in one call: a long block is not copied piece by piece
            self.buf, self.at = self.buf[self.at:] + self.raw.read(missing), 0
            if len(self.buf) < n:
                raise ValueError("the archive ends within a record")
        return self.buf[self.at:self.at + n]

    def skip_to(self, n: int) -> None:
        """Move ``n`` bytes on."""
        have = len(self.buf) - self.at
        if n <= have:
            self.at += n
        else:
            self.raw.seek(self.raw.tell() + n - have)
            self.buf, self.at = b"", 0


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip(" ") for k, _, v in (x.partition(":") for x in lines[1:])}


def value(fields: dict, column: str) -> str | None:
    v = fields.get(HEADERS[column].lower())
    if v is None:
        return None
    if column == "target_uri":
        return unquote(v)
    if column == "payload_digest":
        return v.removeprefix("sha1:")
    if column in ("record_id", "refers_to"):
        return v.removeprefix(f"<{ID}").removesuffix(">") or None
    return v


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; option payload=false leaves
    payloads null and unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], str(self.options.get("payload", "true")).lower() == "true")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives in ``path``: SCHEMA.  Filters on header
    columns are pushed down."""
    common.prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    Null html is an empty payload, a null url has no target, a null page_id no
    id.  Rows that repeat a page_id with the same payload are the same record,
    written as often as there are rows, and count as one page: where it is the
    largest of its payload, all of them are responses.  Other columns are not
    archived.  An empty table gives no archive and no rows.  A very long
    payload is read in one piece, in time linear in its length.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)


