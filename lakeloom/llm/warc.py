"""WARC archives with a two-level capture index.

Writing: pages are range-partitioned by their capture key (reversed-host URL,
page_id), and each task writes its sorted records to WARC files, one gzip
member a record. The records' places (file, offset, length) are sorted as they
come, so the same pass cuts them into compressed index blocks of
``BLOCK_ENTRIES`` and writes one sparse directory (first key of each block) per
partition. Only one line per partition (its first key and its directory) comes
to the driver; that list is bounded by the number of partitions.

Looking up: the list is binary-searched for the partition, its directory for
the block, the block for the entry, and a range read gets the record. Directories,
blocks and open files are kept in small caches, so keys in sorted order read
each of them once.

Payloads: of records with equal payloads of at least ``MIN_REVISIT`` bytes the one
with the smallest page_id is a response, the others are revisits that name it;
reading a revisit looks its target up in the same index.

Files are written through pyarrow's file systems to a folder that all executors
share (by default below spark.checkpoint.dir). A task attempt writes files of its
own names, and only the names that a finished attempt returned are used, so lost
executors and retries leave stray files at worst.

Edge cases: a null html is an empty payload, a null URL an empty key; rows that
repeat a page_id and a URL are separate records and all are read; if all page_ids
of a payload are null they are responses; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import secrets
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import checkpoint_dir, materialise

MIN_REVISIT = 100
BLOCK_ENTRIES = 512
ARCHIVE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_NO_ID = -(1 << 63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def surt(url: Column) -> Column:
    """Capture key of a URL: labels of the host reversed, then ")" and the path; scheme and fragment are dropped."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^(?:[^/?@]*@)?([^/?:]*)", 1))
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    port = F.regexp_extract(bare, r"^[^/?]*?(:[0-9]+)(?:[/?]|$)", 1)
    return F.when(bare == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "file://" + "/" + folder[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


# --- records ---------------------------------------------------------------------------------


def _header(lines: list[tuple[str, str]], block: bytes) -> bytes:
    told = "".join(f"{k}: {v}\r\n" for k, v in [*lines, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + told.encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str:
    return quote(url or "", safe="/:?#[]@!$&'()*+,;=%-._~")


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: dict | None) -> bytes:
    """A response, or a revisit of ``first`` (page_id, url, surt)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first:
        lines += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _urn(first["page_id"])), ("WARC-Refers-To-Target-URI", _uri(first["url"])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Key", quote(first["surt"]))]
        return _header(lines, http)
    return _header(lines, http + payload)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of one record; a revisit's payload is empty."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# --- writing ----------------------------------------------------------------------------------


def _entry(key: bytes, page: int, file: str, offset: int, length: int) -> bytes:
    return b"\t".join([quote(key).encode(), str(page).encode(), file.encode(), str(offset).encode(), str(length).encode()])


def _write(folder: str, block_entries: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        stem = secrets.token_hex(12)
        archive = None
        number = at = 0
        name, told_for, targets = "", None, {}
        entries: list[bytes] = []
        directory: list[tuple[bytes, int, int, int, int]] = []
        index, index_at, first = None, 0, None

        def flush() -> None:
            nonlocal index, index_at, entries, first
            if not entries:
                return
            block = zlib.compress(b"\n".join(entries), 6)
            index = index or fs.open_output_stream(f"{root}/{stem}.cdx", compression=None)
            index.write(block)
            directory.append((*first, index_at, len(block), len(entries)))
            index_at += len(block)
            entries, first = [], None

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for r in batch.slice(start, 64).to_pylist():
                    if (r["surt"], r["page_id"]) != told_for:
                        told_for, targets = (r["surt"], r["page_id"]), {}
                    if r["kind"] == 0:
                        targets[r["digest"]] = {"page_id": r["first_id"], "url": r["url"], "surt": r["first_surt"]}
                        continue
                    if archive is None or at >= archive_bytes:
                        if archive is not None:
                            archive.close()
                        name, number, at = f"{stem}-{number:05d}.warc.gz", number + 1, 0
                        archive = fs.open_output_stream(f"{root}/{name}", compression=None)
                        info = gzip.compress(_header([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), 1, mtime=0)
                        archive.write(info)
                        at = len(info)
                    member = gzip.compress(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], targets.get(r["digest"])), 3, mtime=0)
                    archive.write(member)
                    key, page = r["surt"].encode(), _NO_ID if r["page_id"] is None else r["page_id"]
                    first = first or (key, page)
                    entries.append(_entry(key, page, name, at, len(member)))
                    at += len(member)
                    if len(entries) >= block_entries:
                        flush()
        flush()
        if archive is not None:
            archive.close()
        if index is not None:
            index.close()
            with fs.open_output_stream(f"{root}/{stem}.dir", compression=None) as out:
                out.write(zlib.compress(b"\n".join(b"\t".join([quote(k).encode(), *(str(x).encode() for x in rest)]) for k, *rest in directory), 6))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]], pa.binary()), pa.array([directory[0][1]], pa.int64()), pa.array([stem])], ["key", "page", "stem"])

    return run


def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Rows to write, by capture key: each page (kind 1) and, before it, the response its payload repeats (kind 0).

    The payloads take part in no join: what a revisit names is found on narrow
    rows, summed before their shuffle, and goes to the writer as rows of its own,
    which meet the page under the same key.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumns({"surt": surt(F.col("url")), "digest": F.sha2("html", 256)})
    told = p.where(F.octet_length("html") >= min_revisit).select("page_id", "url", "surt", "digest")
    first = told.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "surt"), "page_id").alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1 and f.page_id is not null").select("digest", "f")
    named = told.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("f.page_id")))
    named = named.select("surt", "page_id", F.lit(0).alias("kind"), "digest", F.col("f.url").alias("url"), F.lit(None).cast("string").alias("html"), F.col("f.page_id").alias("first_id"), F.col("f.surt").alias("first_surt"))
    page = p.select("surt", "page_id", F.lit(1).alias("kind"), "digest", "url", "html", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_surt"))
    return page.unionByName(named)


class Archive:
    """A written collection: its folder and the sparse list of partitions."""

    def __init__(self, folder: str, parts: list[tuple[bytes, int, str]]) -> None:
        self.folder, self.parts = folder, parts

    def reader(self) -> Reader:
        return Reader(self)


def write_archives(pages: DataFrame, folder: str | None = None, block_entries: int = BLOCK_ENTRIES, archive_bytes: int = ARCHIVE_BYTES, min_revisit: int = MIN_REVISIT) -> Archive:
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/warc-{secrets.token_hex(8)}"
    rows = captures(pages, min_revisit).repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id", "kind")
    written = materialise(rows.mapInArrow(_write(folder, block_entries, archive_bytes), "key binary, page long, stem string"))
    return Archive(folder, sorted((bytes(r.key), r.page, r.stem) for r in written.collect()))


# --- looking up --------------------------------------------------------------------------------


class Reader:
    """Binary searches over the two levels, then range reads."""

    def __init__(self, archive: Archive, cached: int = 8) -> None:
        self.fs, self.root = file_system(archive.folder)
        self.parts = archive.parts
        self.first = [(k, p) for k, p, _ in archive.parts]
        self.caches: dict[str, OrderedDict] = {x: OrderedDict() for x in ("dir", "block", "file", "page")}
        self.cached = cached

    def _kept(self, kind: str, key, make: Callable, most: int | None = None):
        cache = self.caches[kind]
        if key in cache:
            cache.move_to_end(key)
        else:
            cache[key] = make()
            if len(cache) > (most or self.cached):
                _, old = cache.popitem(last=False)
                if kind == "file":
                    old.close()
        return cache[key]

    def _range(self, name: str, offset: int, length: int) -> bytes:
        f = self._kept("file", name, lambda: self.fs.open_input_file(f"{self.root}/{name}"))
        f.seek(offset)
        return f.read(length)

    def _directory(self, part: int) -> tuple[list[tuple[bytes, int]], list[tuple[int, int]]]:
        def read():
            with self.fs.open_input_file(f"{self.root}/{self.parts[part][2]}.dir") as f:
                rows = [x.split(b"\t") for x in zlib.decompress(f.read()).split(b"\n")]
            return [(unquote(r[0].decode(), errors="surrogateescape").encode("utf-8", "surrogateescape"), int(r[1])) for r in rows], [(int(r[2]), int(r[3])) for r in rows]

        return self._kept("dir", part, read)

    def _block(self, part: int, block: int) -> tuple[list[tuple[bytes, int]], list[tuple[str, int, int]]]:
        def read():
            offset, length = self._directory(part)[1][block]
            rows = [x.split(b"\t") for x in zlib.decompress(self._range(f"{self.parts[part][2]}.cdx", offset, length)).split(b"\n")]
            return [(unquote(r[0].decode(), errors="surrogateescape").encode("utf-8", "surrogateescape"), int(r[1])) for r in rows], [(r[2].decode(), int(r[3]), int(r[4])) for r in rows]

        return self._kept("block", (part, block), read)

    def find(self, key: bytes, page: int | None) -> Iterator[tuple[str, int, int]]:
        """Places of the records with this capture key and page."""
        wanted = (key, _NO_ID if page is None else page)
        part = max(0, bisect_left(self.first, wanted) - 1)
        started = False
        while part < len(self.parts) and self.first[part] <= wanted:
            starts, _ = self._directory(part)
            block = 0 if started else max(0, bisect_left(starts, wanted) - 1)
            while block < len(starts) and starts[block] <= wanted:
                keys, places = self._block(part, block)
                at = bisect_left(keys, wanted)
                while at < len(keys) and keys[at] == wanted:
                    yield places[at]
                    at += 1
                block += 1
            part, started = part + 1, True

    def records(self, key: bytes, page: int | None) -> Iterator[tuple[dict[str, str], bytes]]:
        for name, offset, length in self.find(key, page):
            yield parse_record(gzip.decompress(self._range(name, offset, length)))

    def all_of(self, key: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """Records of a capture key, in order of page."""
        low = (key, _NO_ID)
        part = max(0, bisect_left(self.first, low) - 1)
        for p in range(part, len(self.parts)):
            if self.first[p][0] > key:
                return
            starts, _ = self._directory(p)
            for block in range(max(0, bisect_left(starts, low) - 1), len(starts)):
                if starts[block][0] > key:
                    return
                for (k, _), place in zip(*self._block(p, block), strict=True):
                    if k == key:
                        yield parse_record(gzip.decompress(self._range(*place)))

    def payload_facts(self, key: bytes, page: int | None, digest: str) -> tuple[int, str]:
        """(bytes, SHA-256) of the response's payload that a revisit names; kept for the revisits of a popular page.

        Captures of one page_id may differ: the digest says which of them is meant, and is computed from the payload itself.
        """

        def read():
            same = (x for x in self.records(key, page) if x[0]["WARC-Type"] == "response" and x[0]["WARC-Payload-Digest"] == digest)
            payload = next(same)[1]
            return len(payload), hashlib.sha256(payload).hexdigest()

        return self._kept("page", (key, page, digest), read, 4096)

    def digest_rows(self, key: bytes, page: int | None) -> Iterator[tuple]:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records found."""
        for headers, payload in list(self.records(key, page)):
            kind, target = headers["WARC-Type"], None
            if kind == "revisit":
                target = page_of(headers["WARC-Refers-To"])
                n, digest = self.payload_facts(unquote(headers["X-Refers-To-Key"]).encode(), target, headers["WARC-Payload-Digest"])
            else:
                n, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if headers["WARC-Payload-Digest"] != f"sha256:{digest}":
                raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
            yield page_of(headers["WARC-Record-ID"]), n, digest, kind, target


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_back(archive: Archive, keys: DataFrame) -> DataFrame:
    """One row per record found for keys (surt, page_id), in any order; equal keys are looked up once."""
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in _READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, last = archive.reader(), None
        for batch in batches:
            out: list[tuple] = []
            for key, page in zip(batch.column("surt").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                if (key, page) != last:
                    out += reader.digest_rows((key or "").encode(), page)
                    last = (key, page)
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    # Keys are narrow but each stands for a range read: a given number of partitions isn't coalesced by size.
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = keys.select("surt", "page_id").repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return sorted_.mapInArrow(run, _READ)


def warc_round_trip(pages: DataFrame, folder: str | None = None, **options: int) -> DataFrame:
    archive = write_archives(pages, folder, **options)
    keys = pages.select(surt(F.col("url").cast("string")).alias("surt"), F.col("page_id").cast("long").alias("page_id"))
    return read_back(archive, keys)


def lookup(spark: SparkSession, archive: Archive, urls: list[str]) -> list[tuple[dict[str, str], bytes]]:
    """Records of a few URLs whatever their page, read on the driver: the capture-index service in small."""
    if not urls:
        return []
    reader, out = archive.reader(), []
    for r in spark.range(1).select(F.explode(F.array(*[surt(F.lit(u)) for u in urls])).alias("k")).collect():
        out += reader.all_of(r.k.encode())
    return out
