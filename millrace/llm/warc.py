"""WARC archives: writing, reading back, and one globally ordered capture index from locally sorted runs.

Spark's text sink writes the archives: a row is a record, and the sink's line separator is the empty line pair
that ends a record, so each file is a plain WARC/1.1 file in any file system that Spark writes. Each file is a
run, sorted by url key and time. Reading takes a file at a time and follows Content-Length; its index entries
are then dealt out by range of (url key, time, page), and each range, of bounded size, merges its slices of the
runs with a loser tree, which gives the capture history over all archives in order.

Only pages that may be copies are shuffled, to learn which page had the payload first; the others are written where
they are read.

Of records with equal payloads of at least `least_bytes` bytes, that with the smallest page_id is a response
and the others are revisits that refer to it; smaller ones are all responses.

Defined results: a null html is an empty payload. A null page_id comes after all others (it is a revisit if a
known page has the payload). Rows that repeat the smallest page_id of a payload are all responses. A null url
has an empty url key; CR and LF in urls are written as %0A, here and in keys. Columns besides those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.url_filter import LOWER, UPPER

RANGE_ROWS = 500_000
#: Bytes of payloads in a file and in a partition of the join, payloads of the smallest size class, words of the filter
#: of copies, rows of one payload for each salt.
FILE_BYTES, PARTITION_BYTES, SMALLEST, WORDS, SALT_ROWS = 64 << 20, 128 << 20, 8 << 10, 1 << 17, 4_096
BASE32HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CDX = "run string, offset long, length long, url_key string, ts string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 160 bits are four runs of eight base-32 digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload), i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), BASE32HEX, BASE32)


def url_key(url: Column) -> Column:
    """Sort-friendly url: host labels in reverse, then path and query, lower case."""
    at = F.instr(url, "://")
    rest = F.translate(F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.coalesce(url, F.lit(""))), UPPER, LOWER)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def _copies(slim: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, bytes, first, n) of the payloads that repeat and are not all of unnamed pages."""
    each = slim.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return each.where("n > 1 AND first IS NOT NULL")


def _with_first(rows: DataFrame, copies: DataFrame, partitions: int) -> DataFrame:
    """rows with `first`, the page that the row's payload was met on first, if it repeats.

    A filter tells which rows may be copies: each repeating payload sets two bits in one of WORDS words. Rows that it
    doesn't hold stay where they are; the others are joined. A word also has the salts of its most frequent payload,
    by which that payload's rows are dealt out.
    """
    h = F.xxhash64("digest", "bytes")
    word = lambda x: F.pmod(x, F.lit(WORDS)).cast("int")
    bit = lambda x, by: F.expr(f"shiftleft(1L, int(pmod(shiftright({x}, {by}), 64)))")
    marks = copies.withColumn("h", h).select(word(F.col("h")).alias("word"), bit("h", 20).bitwiseOR(bit("h", 40)).alias("bits"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    # WORDS rows at most
    words = F.broadcast(marks.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.max("salts").alias("salts")))
    told = rows.withColumn("h", h).withColumn("word", word(F.col("h"))).join(words, "word", "left")
    mask = bit("h", 20).bitwiseOR(bit("h", 40))
    may = F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))
    told = told.withColumn("salt", F.when(may, F.pmod(F.xxhash64("page_id", "key"), F.col("salts")).cast("int")))
    alone = told.where("salt IS NULL").select(*rows.columns, F.lit(None).cast("long").alias("first"))
    salts = copies.withColumn("word", word(h)).join(words, "word").select("digest", "bytes", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    keys = ["digest", "bytes", "salt"]
    met = told.where("salt IS NOT NULL").repartition(partitions, *keys).join(salts.repartition(partitions, *keys), keys, "left").select(*alone.columns)
    return alone.unionByName(met)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, time_col: str | None = None, file_bytes: int = FILE_BYTES, scratch: Scratch | None = None) -> None:
    """Writes page rows (page_id, url, html) as WARC files, each sorted by url key and time. A file's payloads hold
    file_bytes at most, or one record: pages are written by size class, each with as many records a file as fit."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    seconds = F.unix_timestamp(time_col) if time_col else F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9)) + 1_577_836_800
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    # what the header will hold, as reading takes the key from there
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "%0A")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), payload.alias("html"), F.octet_length(payload).alias("bytes"),
        base32_sha1(payload.cast("binary")).alias("digest"), F.timestamp_seconds(F.coalesce(seconds, F.lit(0))).alias("at"), url_key(url).alias("key"),
    )
    slim = scratch.save(rows.select("page_id", "bytes", "digest"), "payloads")
    copies = scratch.save(_copies(slim, least_bytes), "copies")
    total = copies.agg(F.sum(F.col("bytes").cast("long") * F.col("n"))).first()[0] or 0
    partitions = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    size = F.ceil(F.log2(F.greatest("bytes", F.lit(SMALLEST)) / SMALLEST) / 3).cast("int")
    classes = sorted(r[0] for r in slim.select(size.alias("size")).distinct().collect())  # 7 at most, as bytes are an int
    for c in classes or [0]:
        own = _with_first(rows.where(size == c) if len(classes) > 1 else rows, copies, partitions)
        _write_records(own, f"{path}/size={c}", max(1, file_bytes // (SMALLEST * 8**c)))
    scratch.drop("payloads", "copies")


def _write_records(rows: DataFrame, path: str, records_per_file: int) -> None:
    rows = rows.withColumn("again", F.coalesce(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.lit(False)))
    crlf = F.lit("\r\n")
    date = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), "bytes", F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("again"), "").otherwise(F.col("html")))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), date),
        F.concat(F.lit("WARC-Target-URI: "), "url"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(F.col("again"), F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), "first", F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    ]
    rows = rows.withColumn("block", block).withColumn("value", F.concat(F.concat_ws("\r\n", *fields), crlf, crlf, "block"))
    runs = rows.sortWithinPartitions("key", "at", "page_id").select("value")
    runs.write.mode("overwrite").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)


def records(data: bytes):
    """(offset, length, headers, block) of every record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, end + 8 + size - at, headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def _page(uri: str) -> int | None:
    number = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def _surt(url: str) -> str:
    rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url.split("://", 1)[-1]).split("#")[0]
    cut = next((i for i, c in enumerate(rest) if c in "/?"), len(rest))
    return ",".join(rest[:cut].split(".")[::-1]) + ")" + rest[cut:]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all records, each archive's in its own order; payload digests are taken from the payloads."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = []
                for offset, length, head, block in records(data.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, size, refers = head["WARC-Payload-Digest"].removeprefix("sha1:"), len(payload), None
                    if head["WARC-Type"] == "revisit":
                        refers, size = _page(head["WARC-Refers-To"]), int(http.rpartition(b"Content-Length: ")[2])
                    elif digest != (digest := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"payload digest differs at byte {offset} of {name.as_py()}")
                    ts = "".join(c for c in head["WARC-Date"] if c.isdigit())
                    rows.append((name.as_py(), offset, length, _surt(head["WARC-Target-URI"]), ts, _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], refers))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CDX.split(", ")])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, CDX)


def loser_merge(runs: list[list[tuple]]):
    """Merges sorted lists: each inner node of the tree keeps the loser of its match, the winner goes up."""
    k = len(runs)
    heads, at = [run[0] if run else None for run in runs], [0] * k

    def beats(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None
        return (heads[a], a) < (heads[b], b)

    tree, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], tree[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not None:
        yield heads[best]
        at[best] += 1
        heads[best] = runs[best][at[best]] if at[best] < len(runs[best]) else None
        node = (best + k) // 2
        while node:
            if beats(tree[node], best):
                tree[node], best = best, tree[node]
            node //= 2


def merge_index(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """All entries with `capture_rank`, their place (from 0) in the order of url key, time and page."""
    order = [F.col("url_key"), F.col("ts"), F.col("page_id").asc_nulls_last()]
    # a range holds slices of runs, of RANGE_ROWS entries in all or so, which is what a task holds; offsets rise with
    # the key inside a run, so each slice comes in order
    ranges = -(-entries.count() // RANGE_ROWS)
    many = ranges > int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = (entries.repartitionByRange(ranges, *order) if many else entries.repartitionByRange(*order)).sortWithinPartitions("run", "offset")
    names = [c.split()[0] for c in CDX.split(", ")]

    def run(frames):
        runs: dict[str, list[tuple]] = {}
        whole = []
        for frame in frames:
            base = sum(map(len, whole))
            whole.append(frame)
            page = frame["page_id"].astype("float64")
            for i, (name, key, ts, null, number) in enumerate(zip(frame["run"], frame["url_key"], frame["ts"], page.isna(), frame["page_id"].fillna(0), strict=True)):
                runs.setdefault(name, []).append((key, ts, bool(null), int(number), base + i))
        if not whole:
            return
        rows = pd.concat(whole, ignore_index=True)
        merged = rows.iloc[[m[4] for m in loser_merge(list(runs.values()))]]
        yield merged.assign(part=TaskContext.get().partitionId(), local=range(len(merged)))

    merged = scratch.save(slices.mapInPandas(run, f"{CDX}, part long, local long"), "merged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = merged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return merged.join(F.broadcast(parts), "part").select(*names, (F.col("first") + F.col("local")).alias("capture_rank"))


def archive(pages: DataFrame, least_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes pages to archives, reads them back and merges their indexes: one row per page."""
    scratch = scratch or Scratch(pages.sparkSession, "warc")
    write_warc(pages, f"{scratch.path}/archives", least_bytes, scratch=scratch)
    entries = scratch.save(read_warc(pages.sparkSession, f"{scratch.path}/archives"), "cdx")
    return merge_index(entries, scratch)
