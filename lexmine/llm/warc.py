"""WARC archives of pages, read back into capture histories that are ordered over the whole cluster.

Archives are written by Spark's own text writer, a record a row, so they land in any store Spark writes to and
a lost executor leaves nothing half written: a record ends in two line ends, which is the separator of rows.
A file is one gzip stream; a capture's offset and length count bytes of the unpacked file. Equal payloads are
found by digest alone, and payloads go from the scan into the archive without a shuffle unless the digests
that repeat are too many to broadcast.

The index is an external merge. The captures of each archive are sorted where they are read (a run), cut at
splitters into ranges and packed into blocks. A range's blocks come to one task in the order of their first
captures; the task merges the runs with a loser tree and holds one block of each run that it is inside of.
Splitters are places in the order of captures, so the captures of one URL may be cut too.

Odd rows. A null html is an empty payload; a null url is left out of its record, and control characters and
spaces, which no URI holds, are left out of others. A null page_id is written as an empty one and read back as
null; such a row revisits the least page_id of its payload, and is a response where all ids are null. Rows equal
in id and payload don't revisit each other. Records of one URL and date go by page_id, nulls first, then by
place in the archive. An empty table gives an archive without records. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmine.llm.common import checkpoint, partitions
from lexmine.sources.shared import shared_folder

#: Bytes from which on a payload may be a revisit; records a file at most; repeated digests that are broadcast at most.
LEAST, PER_FILE, BROADCAST_ROWS = 100, 10_000, 100_000
#: Captures in a block; about how many, chosen by hash, splitters are taken from.
BLOCK, SAMPLE = 512, 10_000
# The WARC 1.1 names of an identical-payload revisit.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: The id of a page's record, and the first second that made-up capture dates count from.
RECORD, EPOCH = "urn:lexmine:page:", 1_704_067_200


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload, size, digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("n"), F.count("page_id").alias("named"))
    repeated = checkpoint(groups.where("first IS NOT NULL AND (first <> last OR n > named)").select("digest", "first"))
    both = rows.join(F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated, "digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return both.select("page_id", "url", "payload", "size", "digest", F.when(revisits, F.col("first")).alias("refers_to"))


def capture_date(page_id: Column) -> Column:
    """A date for pages that have none: as many seconds after the epoch as the id says."""
    at = F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(page_id.cast("string").try_cast("long"), F.lit(0)), F.lit(10**9)))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record(date: Column) -> Column:
    """A row of typed() as the text of its WARC record, without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit(f"<{RECORD}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    fields = {
        "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
        "WARC-Record-ID": name(F.col("page_id")),
        "WARC-Date": date,
        "WARC-Target-URI": F.col("url"),
        "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")),
        "WARC-Refers-To": F.when(revisit, name(F.col("refers_to"))),
        "WARC-Profile": F.when(revisit, PROFILE),
        "Content-Type": F.lit("application/http; msgtype=response"),
        "Content-Length": F.octet_length(block).cast("string"),
    }
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()])  # nulls are left out
    return F.concat(head, F.lit(END), block)


def write_archives(pages: DataFrame, path: str, least: int = LEAST, date: Column | None = None, per_file: int = PER_FILE) -> None:
    """A WARC record for each row of pages (page_id, url, html), in gzip files of per_file records at most."""
    text = typed(pages, least).select(record(capture_date(F.col("page_id")) if date is None else date).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str | None) -> str:
    """A URL's place in the index: host turned round, without www, port, scheme and fragment, then path and query."""
    if not url:
        return ""
    rest = url.partition("#")[0].partition("://")
    host, slash, path = (rest[2] or rest[0]).partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")/" + path if slash or host else url


def records(stream) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """The records of an unpacked archive: offset, length, header fields in lower case, block."""
    at = 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at byte {start}")
        fields = {}
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        at += len(line) + len(block)
        if len(block) != int(fields["content-length"]):
            raise ValueError(f"the record at byte {start} is cut off")
        yield start, at - start, fields, block


ID, CAPTURE = "long", "urlkey string, date string, page_id {id}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id}, archive string, offset long, length long"


def _capture(archive: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(END.encode())
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload at byte {offset} of {archive} is damaged")
    named = lambda f: (fields.get(f, "").strip("<>").removeprefix(RECORD) or None)
    url = fields.get("warc-target-uri")
    return url_key(url), fields["warc-date"], named("warc-record-id"), url, fields["warc-type"], size, digest, named("warc-refers-to"), archive, offset, length


def _order(c: tuple) -> tuple:
    """Captures go by URL key, date, page_id (nulls first) and place."""
    return c[0], c[1], c[2] is not None, 0 if c[2] is None else c[2], c[8], c[9]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(of_id: str) -> pa.Schema:
    kind = pa.string() if of_id == "string" else pa.int64()
    return pa.schema([("urlkey", pa.string()), ("date", pa.string()), ("page_id", kind), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", kind), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def read_archives(spark: SparkSession, path: str, ids: str = ID) -> DataFrame:
    """The captures of all archives below path, each archive's in order: a run. Payloads are checked against their digests. ids: long or string."""
    schema, whole = _schema(ids), ids != "string"

    def runs(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                archive = name.as_py().rpartition("/")[2]
                found = []
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as unpacked:
                    for one in records(unpacked):
                        c = _capture(archive, *one)
                        found.append((*c[:2], int(c[2]) if whole and c[2] is not None else c[2], *c[3:7], int(c[7]) if whole and c[7] is not None else c[7], *c[8:]))
                found.sort(key=_order)
                if found:
                    yield _batch(found, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(runs, CAPTURE.format(id=ids))


class LoserTree:
    """The least head of many sorted sources. An inner node keeps the loser of its match, so a winner's successor plays log k matches."""

    def __init__(self):
        self.heads: list[tuple | None] = []  # (order, ...) of each source; None: exhausted
        self.losers: list[int] = []
        self.winner = -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x < y)

    def build(self) -> None:
        """Play all matches, after a source has been added or has come back."""
        k = len(self.heads)
        self.losers = [0] * k
        won = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = won[1] if k > 1 else k - 1

    def replace(self, head: tuple | None) -> None:
        """The winner's next head."""
        best = self.winner
        self.heads[best] = head
        node = (best + len(self.heads)) // 2
        while node:
            if self._beats(self.losers[node], best):
                self.losers[node], best = best, self.losers[node]
            node //= 2
        self.winner = best

    def least(self) -> tuple | None:
        return self.heads[self.winner] if self.heads else None


def merged(blocks: Iterator[tuple[object, list[tuple]]]) -> Iterator[tuple]:
    """Merge blocks (run, captures in order), which come by their first captures, into one order. Holds a block of each run it is inside of."""
    tree, source, rest = LoserTree(), {}, []
    waiting = next(blocks, None)
    while True:
        least = tree.least()
        while waiting is not None and (least is None or _order(waiting[1][0]) < least[0]):
            run, captures = waiting
            k = source.get(run)
            if k is None:
                k = source[run] = len(tree.heads)
                tree.heads.append(None)
                rest.append(iter(()))
            rest[k] = chain_of(rest[k], captures)
            if tree.heads[k] is None:
                tree.heads[k] = next(((_order(c), c) for c in rest[k]), None)
                tree.build()
            least = tree.least()
            waiting = next(blocks, None)
        if least is None:
            return
        yield least[1]
        tree.replace(next(((_order(c), c) for c in rest[tree.winner]), None))


def chain_of(before: Iterator[tuple], captures: list[tuple]) -> Iterator[tuple]:
    yield from before
    yield from captures


def capture_histories(captures: DataFrame, ids: str = ID) -> DataFrame:
    """Captures (the runs of read_archives) in the order of URL key and date over all partitions: the index of the archives."""
    spark = captures.sparkSession
    parts, schema, fields = partitions(spark), _schema(ids), CAPTURE.format(id=ids)
    total = max(1, captures.count())
    sample = captures.where(F.pmod(F.xxhash64("archive", "offset"), F.lit(total)) < SAMPLE)  # about SAMPLE rows of an index
    some = sorted(_order((r["urlkey"], r["date"], r["page_id"], *[None] * 5, r["archive"], r["offset"])) for r in sample.select("urlkey", "date", "page_id", "archive", "offset").collect())
    cuts = [some[len(some) * k // parts] for k in range(1, parts)] if some else []
    packed = pa.schema([("range", pa.int32()), ("urlkey", pa.string()), ("date", pa.string()), ("page_id", schema.field("page_id").type), ("archive", pa.string()), ("offset", pa.int64()), ("rows", pa.list_(pa.struct(list(schema))))])

    def cut(batches):
        for batch in batches:
            for archive, run in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda c: c[8]):
                out, held, place = [], [], None
                for c in run:
                    at = bisect_right(cuts, _order(c))
                    if held and (at != place or len(held) == BLOCK):
                        out.append((place, *held[0][:3], archive, held[0][9], [dict(zip(schema.names, x, strict=True)) for x in held]))
                        held = []
                    place = at
                    held.append(c)
                out.append((place, *held[0][:3], archive, held[0][9], [dict(zip(schema.names, x, strict=True)) for x in held]))
                yield _batch(out, packed)

    def merge(batches):
        def blocks():
            for batch in batches:
                for run, rows in zip(batch.column("archive"), batch.column("rows"), strict=True):
                    yield run.as_py(), [tuple(r.values()) for r in rows.as_py()]

        held = []
        for c in merged(blocks()):
            held.append(c)
            if len(held) == 10_000:
                yield _batch(held, schema)
                held = []
        if held:
            yield _batch(held, schema)

    blocks = captures.mapInArrow(cut, f"range int, urlkey string, date string, page_id {ids}, archive string, offset long, rows array<struct<{', '.join(f.replace(' ', ': ') for f in fields.split(', '))}>>")
    dealt = blocks.repartitionByRange(parts, "range").sortWithinPartitions("range", "urlkey", "date", "page_id", "archive", "offset")
    return dealt.mapInArrow(merge, fields)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def archived(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write pages (page_id, url, html) as archives, read them back, and give their capture histories in order."""
    spark = pages.sparkSession
    ids = "string" if dict(pages.dtypes)["page_id"] == "string" else ID
    path = path or archive_folder(spark)
    write_archives(pages, path, least)
    return capture_histories(checkpoint(read_archives(spark, path, ids)), ids)
