"""WARC archives of web pages with a two-level capture index.

Records are written by the tasks that hold them, one gzip member each. Of pages with equal
payloads one is a response and the others are revisits that refer to it. The captures' URL keys
(host reversed, then the path) are sorted over all tasks into index files: compressed blocks of
captures, then a sparse directory with the first key of every block. A lookup binary-searches
the files' first keys, the directory and the block, and reads ranges: of the index one
directory and the blocks it needs, of the archives the records.

Files go through pyarrow's file systems, so the folder may be on any store those know.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from cohortspan.llm.common import HOT_KEYS, HOT_ROWS, durable, look_up, quoted, scratch, shuffle_width

#: Captures of an index block.
BLOCK = 2048
#: Bytes of a range read of an archive, about, and the largest gap read over.
RANGE = 8 << 20
GAP = 1 << 16
MAGIC = b"CDXZ"
_LEVEL = 6
_SALTS = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROWS = 1000
_ENTRY = "key string, warc string, offset long, length long"
_RECORD = "record_id string, page_id long, url string, record_type string, refers string, payload_bytes long, payload_digest string"


def url_key(url: Column) -> Column:
    """``com,example,www)/path?query`` of a URL: scheme, user, port and the host's case go.

    What is no URL with a scheme is its own key; null has the empty key.
    """
    scheme = "(?i)^[a-z][a-z0-9+.-]*://"
    rest = F.regexp_replace(url, scheme, "")
    site = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.lower(F.regexp_replace(F.regexp_replace(site, "^.*@", ""), ":[0-9]*$", ""))
    turned = F.concat_ws(",", F.reverse(F.split(host, "[.]")))
    key = F.concat(turned, F.lit(")"), F.substring(rest, F.length(site) + 1, F.length(rest)))
    return F.coalesce(F.when(url.rlike(scheme), key).otherwise(url), F.lit(""))


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urllib.parse.urlparse(path).path
    return fs.FileSystem.from_uri(path)


def _range(path: str, offset: int, length: int) -> bytes:
    store, at = _opened(path)
    with store.open_input_file(at) as file:
        return file.read_at(length, offset)


def record(kind: str, record_id: str, payload: bytes, page_id: int | None, url: str | None, sha: str, date: str, refers: str = "", refers_url: str | None = None) -> bytes:
    """A response with its payload, or a revisit without, as one gzip member."""
    safe = "!#$%&'()*+,/:;=?@[]~"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        http, payload = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n", b""
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": None if url is None else urllib.parse.quote(url, safe=safe),
        "WARC-Payload-Digest": f"sha1:{sha}", "X-Page-ID": page_id, "Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + len(payload),
    }
    if kind == "revisit":
        target = None if refers_url is None else urllib.parse.quote(refers_url, safe=safe)
        fields |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": refers, "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return b"".join([packer.compress(head.encode()), packer.compress(http), packer.compress(payload), packer.compress(b"\r\n\r\n"), packer.flush()])


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload of a record."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:20]!r}")
    fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    size = int(fields["content-length"])
    block, tail = data[end + 4:end + 4 + size], data[end + 4 + size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("a WARC record has another length than its header says")
    return fields, block[block.index(b"\r\n\r\n") + 4:]


def _pages(pages: DataFrame, page_id: str, url: str, html: str, least: int) -> DataFrame:
    """Pages with the digest that names their payload; null below ``least`` bytes."""
    payload = F.coalesce(quoted(html), F.lit("")).cast("binary")
    rows = pages.select(quoted(page_id).cast("long").alias("page_id"), quoted(url).alias("url"), payload.alias("payload"))
    return rows.withColumn("name", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))


def _dealt(pages: DataFrame, width: int) -> DataFrame:
    """All records to write, equal payloads side by side, each group's response first.

    Payloads of many pages are few: their pages are counted, the response is taken from map-side
    reduced rows, and the revisits, which need no payload, are dealt out anew.
    """
    first = F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("url").isNull(), F.col("url"))
    named = pages.where("name is not null")
    sizes = named.groupBy("name").agg(F.count("*").alias("n"))
    sizes = durable(sizes.where(F.col("n") >= HOT_ROWS))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(sizes.where(F.col("n") >= -(-total // HOT_KEYS)).select("name"))
    light = pages.join(hot, "name", "left_anti").select(
        "name", "page_id", "url", "payload", F.lit(False).alias("later"), F.lit(None).cast("string").alias("refers_url"), F.lit(None).cast("string").alias("sha"),
        F.when(F.col("name").isNull(), F.pmod(F.monotonically_increasing_id(), _SALTS)).otherwise(0).alias("salt"),
    )
    counts = durable(named.withColumn("sha", F.sha1("payload")).join(hot, "name").groupBy("name", "sha", "page_id", "url").agg(F.count("*").alias("copies")))
    heads = counts.groupBy("name").agg(F.min(first).alias("low")).select("name", F.col("low.page_id").alias("low_id"), F.col("low.url").alias("low_url"))
    bodies = named.join(hot, "name").groupBy("name").agg(F.first("payload").alias("payload"))
    responses = heads.join(bodies, "name").select(
        "name", F.col("low_id").alias("page_id"), F.col("low_url").alias("url"), "payload", F.lit(False).alias("later"),
        F.lit(None).cast("string").alias("refers_url"), F.lit(None).cast("string").alias("sha"), F.lit(0).cast("long").alias("salt"),
    )
    rest = F.col("copies") - (F.col("page_id").eqNullSafe(F.col("low_id")) & F.col("url").eqNullSafe(F.col("low_url"))).cast("int")
    later = counts.join(F.broadcast(heads), "name").withColumn("rest", rest).where("rest > 0")
    later = later.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rest")))).select(
        "name", "page_id", "url", F.lit(None).cast("binary").alias("payload"), F.lit(True).alias("later"), F.col("low_url").alias("refers_url"), "sha",
        F.pmod(F.xxhash64("page_id", "url", "copy"), F.lit(_SALTS)).alias("salt"),
    )
    rows = light.unionByName(responses).unionByName(later).withColumn("key", url_key(F.col("url"))).repartition(width, "name", "salt")
    return rows.sortWithinPartitions("name", "salt", F.col("later"), F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url")


def _write_records(rows: DataFrame, folder: str, date: str) -> DataFrame:
    """Write the archives, one for each task; (key, page_id, warc, offset, length) of their records."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # an attempt that is lost leaves a file that no index names
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        file, offset, head = None, 0, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if file is None:
                    store, at = _opened(f"{folder}/{name}")
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    file = store.open_output_stream(at, compression=None)
                page_id, url = None if pd.isna(row.page_id) else int(row.page_id), row.url
                own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{offset}')}>"
                response = None if row.name is None else f"<urn:uuid:{uuid.UUID(hex=row.name[:32])}>"
                if row.later:
                    sha = base64.b32encode(bytes.fromhex(row.sha)).decode()
                    member = record("revisit", own, b"", page_id, url, sha, date, response, row.refers_url)
                elif response is not None and head is not None and head[0] == row.name:
                    member = record("revisit", own, b"", page_id, url, head[2], date, response, head[1])
                else:
                    sha = digest(row.payload)
                    member = record("response", response or own, bytes(row.payload), page_id, url, sha, date)
                    head = (row.name, url, sha)
                file.write(member)
                out.append((row.key, name, offset, len(member)))
                offset += len(member)
            yield pd.DataFrame(out, columns=["key", "warc", "offset", "length"])
        if file is not None:
            file.close()

    return rows.select("name", F.col("page_id").cast("string").alias("page_id"), "url", "payload", "later", "refers_url", "sha", "key").mapInPandas(written, _ENTRY)


@dataclass(frozen=True)
class Archive:
    """Archives and their capture index; ``files`` has a row for each index file, in key order."""

    spark: SparkSession
    folder: str
    files: tuple[tuple[str, str, str, int, int], ...]  # name, first key, last key, place and size of the directory


def _write_index(entries: DataFrame, folder: str, width: int, block: int) -> list[tuple]:
    """Sort the captures into index files of compressed blocks and a directory each."""

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        file, at, held, directory, last = None, 0, [], [], ""

        def put(lines: list[list]) -> None:
            nonlocal at
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), _LEVEL)
            file.write(packed)
            directory.append([lines[0][0], at, len(packed)])
            at += len(packed)

        for batch in batches:
            held += batch[["key", "warc", "offset", "length"]].to_numpy(object).tolist()
            if held and file is None:
                store, path = _opened(f"{folder}/{name}")
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                file = store.open_output_stream(path, compression=None)
            while len(held) >= block:
                put(held[:block])
                last, held = held[block - 1][0], held[block:]
        if file is None:
            return
        if held:
            put(held)
            last = held[-1][0]
        packed = zlib.compress(json.dumps(directory).encode(), _LEVEL)
        file.write(packed + struct.pack("<Q", len(packed)) + MAGIC)
        file.close()
        yield pd.DataFrame([(name, directory[0][0], last, at, len(packed))], columns=["name", "first", "last", "offset", "length"])

    order = ["key", "warc", "offset"]
    files = entries.repartitionByRange(width, *order).sortWithinPartitions(*order).mapInPandas(written, "name string, first string, last string, offset long, length long")
    return sorted((tuple(r) for r in files.collect()), key=lambda r: (r[1], r[2], r[0]))  # one row for each task


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = "2000-01-01T00:00:00Z", block: int = BLOCK) -> Archive:
    """Write a record for every page, and the capture index.

    Of pages with equal payloads (by SHA-256) of at least ``least`` bytes the one with the smallest
    page_id is the response (null ones last, then by URL), the others are its revisits; smaller
    payloads are all responses. A null text is an empty payload, a null URL has the empty key and
    no target. The table has no capture time: ``date`` stands in every record.
    """
    spark = pages.sparkSession
    width = shuffle_width(spark)
    entries = durable(_write_records(_dealt(_pages(pages, page_id, url, html, least), width), folder, date))
    return Archive(spark, folder, tuple(_write_index(entries, folder, width, block)))


class _Directory:
    """An index file opened by its directory; the block read last is kept."""

    def __init__(self, path: str, offset: int, length: int):
        self.path = path
        packed = _range(path, offset, length + 12)
        if packed[-4:] != MAGIC or struct.unpack("<Q", packed[-12:-4])[0] != length:
            raise ValueError(f"{path} is no capture index")
        self.blocks = json.loads(zlib.decompress(packed[:length]))
        self.firsts = [b[0] for b in self.blocks]
        self.number, self.lines, self.keys = -1, [], []

    def _block(self, number: int) -> None:
        if number != self.number:
            _, offset, length = self.blocks[number]
            self.lines = [json.loads(x) for x in zlib.decompress(_range(self.path, offset, length)).split(b"\n")]
            self.number, self.keys = number, [x[0] for x in self.lines]

    def find(self, key: str) -> Iterator[list]:
        """All captures of a key."""
        number = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while number < len(self.blocks) and self.firsts[number] <= key:
            self._block(number)
            start, end = bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)
            yield from self.lines[start:end]
            number += 1


def captures(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, warc, offset, length) of every capture of the distinct keys in column ``key``.

    Each key goes to the index files whose range has it, found by binary search; keys are sorted, so
    a task opens neighbouring files and reads each block once.
    """
    files, folder = archive.files, archive.folder
    firsts, lasts = [f[1] for f in files], [f[2] for f in files]

    @F.pandas_udf("array<int>")
    def among(of: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))) for k in of], dtype=object)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, directory, out = -1, None, []
        for batch in batches:
            for number, key in zip(batch["file"], batch["key"]):
                if number != opened:
                    opened, directory = number, _Directory(f"{folder}/{files[number][0]}", *files[number][3:])
                for line in directory.find(key):
                    out.append(line)
                    if len(out) >= _ROWS:
                        yield pd.DataFrame(out, columns=["key", "warc", "offset", "length"])
                        out = []
        yield pd.DataFrame(out, columns=["key", "warc", "offset", "length"])

    asked = keys.select("key").distinct().select("key", F.explode(among("key")).alias("file"))
    asked = asked.repartitionByRange(shuffle_width(archive.spark), "file", "key").sortWithinPartitions("file", "key")
    return asked.mapInPandas(found, _ENTRY)


def records(archive: Archive, entries: DataFrame, payload: bool = False) -> DataFrame:
    """The records of captures, read by ranges and checked against their digests.

    Gives record_id, page_id, url, record_type, refers (the record a revisit refers to),
    payload_bytes and payload_digest, of what the record itself holds; ``payload`` adds the payload.
    """
    folder = archive.folder

    def fetched(warc: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
        start, end = places[0][0], places[-1][0] + places[-1][1]
        data = _range(f"{folder}/{warc}", start, end - start)
        for offset, length in places:
            yield data[offset - start:offset - start + length]

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        warc, places = "", []
        for batch in batches:
            for name, offset, length in zip(batch["warc"], batch["offset"].tolist(), batch["length"].tolist()):
                end = places[-1][0] + places[-1][1] if places else 0
                if places and (name != warc or offset > end + GAP or offset + length - places[0][0] > RANGE):
                    yield warc, places
                    places = []
                warc = name
                places.append((offset, length))
        if places:
            yield warc, places

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for warc, places in ranges(batches):
            out = []
            for member in fetched(warc, places):
                fields, body = parse(member)
                kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(body) != named:
                    raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
                page = fields.get("x-page-id")
                row = (fields["warc-record-id"], None if page is None else int(page), fields.get("warc-target-uri"), kind, fields.get("warc-refers-to"), len(body), named)
                out.append((*row, body) if payload else row)
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(page_id=frame["page_id"].astype(object).where(frame["page_id"].notna(), None) if frame["page_id"].isna().all() else pd.array([r[1] for r in out], dtype="Int64"))

    schema = _RECORD + (", payload binary" if payload else "")
    dealt = entries.repartitionByRange(shuffle_width(archive.spark), "warc", "offset").sortWithinPartitions("warc", "offset")
    return dealt.mapInPandas(read, schema)


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to; revisits take the payload's from their response."""
    found = durable(found)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = found.where("record_type = 'response'")
    revisits = found.where("record_type = 'revisit'").select("page_id", "record_type", F.col("refers").alias("record_id"))
    counts = revisits.groupBy("record_id").agg(F.count("*").alias("n"))
    answers = durable(responses.select("record_id", F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(counts, "record_id"))
    own = responses.withColumn("refers_to", F.lit(None).cast("long"))
    return own.select(*columns).unionByName(look_up(revisits, answers, ["record_id"]).select(*columns))


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from its archives.

    All pages are written and indexed, every URL key is looked up in the index, and the captures'
    records are read. Rows that repeat a page_id, a URL or both have a record each; other columns
    are ignored.
    """
    archive = write(pages, scratch(pages.sparkSession, "warc"), page_id, url, html, least)
    keys = pages.select(url_key(quoted(url)).alias("key"))
    return resolved(records(archive, captures(archive, keys)))
