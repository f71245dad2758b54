"""WARC archives of pages, and one index over them by an external merge of locally sorted runs.

Every partition writes one archive, a gzip member per record, and sorts the captures it wrote by URL key and timestamp:
a run. Ranges of the key space then merge the runs' slices with a k-way loser tree, giving globally ordered capture
histories, and number the captures of each URL key. Pages whose payload another page with a smaller page_id has too become revisit records that refer to it.
Reading back goes by the index: each archive's captures in the order of their offsets.

Rows: a null html is an empty payload, a null url has an empty key; a null page_id is kept, takes part in no choice of
the response, and its record is a response if no page with an id has that payload. Repeated page_ids are one page's
captures: those with the smallest id of a payload are all responses. An empty table writes no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import files
from .runtime import columns_or_null, fresh_path, materialize, maybe_broadcast, ship

#: Used for captures whose table has no column `ts`.
DATE = "2000-01-01T00:00:00Z"
INDEX = "urlkey string, ts string, page_id long, archive string, position long, length long"
NAMES = [x.split()[0] for x in INDEX.split(", ")]
#: Index entries that one merge task holds, about.
RANGE_ROWS = 200_000
#: Bytes of archives that one reading task goes through, about.
READ_BYTES = 256 << 20
ORDER = [*NAMES, "range", "place", "capture"]
RECORD = "page_id long, url string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, capture long"


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, without scheme, leading www, port 80 or 443, and fragment."""
    rest = url.strip().lower().split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cut = min((i for i in (rest.find(c) for c in "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2], rest[cut:] or "/"
    name, _, port = host.partition(":")
    labels = [x for x in name.split(".") if x]
    if labels and labels[0] == "www":
        labels = labels[1:]
    return ",".join(labels[::-1]) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def header_value(text: str) -> str:
    """One line: a line break inside a value would end the header."""
    return " ".join(text.split())


def compose(page_id: int | None, url: str, ts: str, payload: bytes, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Target-URI": header_value(url),
        "WARC-Date": ts,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "X-Payload-Length": str(len(payload)),
    }
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to)}
    else:
        body += payload
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple:
    """Page id, URL, date, payload length and digest, type, referred page and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    number = lambda x: None if x == "<urn:page:none>" else int(x.removeprefix("<urn:page:").rstrip(">"))
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    kind, said = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if digest(payload) != said:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
        size, refers = len(payload), None
    else:
        size, refers, payload = int(fields["X-Payload-Length"]), number(fields["WARC-Refers-To"]), None
    return number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Date"], size, said, kind, refers, payload


def roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id and refers_to of the pages that revisit another one's payload; counts and minima meet per digest before any join."""
    seen = materialize(pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sum"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("size")).where(F.col("size") >= least_bytes), "digests")
    first = seen.groupBy("sum", "size").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("captures")).where("captures > 1 and refers_to is not null")
    return seen.join(maybe_broadcast(materialize(first, "repeated")), ["sum", "size"]).where("page_id is null or page_id > refers_to")


def write(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives; returns the captures' index entries, a sorted run per archive."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    pages = columns_or_null(pages, page_id="long", url="string", html="string", ts="string")
    again = roles(pages, least_bytes)
    named = materialize(again.where("page_id is not null").select("page_id", "refers_to", "sum").distinct(), "revisits")
    none = maybe_broadcast(materialize(again.where("page_id is null").select("sum", F.col("refers_to").alias("refers_none")).distinct(), "revisits"))
    html = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    ready = pages.withColumn("sum", html).join(maybe_broadcast(named), ["page_id", "sum"], "left")
    if not again.where("page_id is null").isEmpty():
        ready = ready.join(none, "sum", "left").withColumn("refers_to", F.when(F.col("page_id").isNull(), F.col("refers_none")).otherwise(F.col("refers_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/archive-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at, made = None, 0, []
        for b in batches:
            for i in range(0, b.num_rows, 500):
                for page_id, url, html, ts, refers_to in zip(*(b.slice(i, 500).column(c).to_pylist() for c in ("page_id", "url", "html", "ts", "refers_to")), strict=True):
                    out = out or files.create(name)
                    ts = header_value(ts or "") or DATE
                    member = gzip.compress(compose(page_id, url or "", ts, (html or "").encode(), refers_to), 1, mtime=0)
                    out.write(member)
                    made.append((url_key(url or ""), ts, page_id, name, at, len(member)))
                    at += len(member)
        if out is not None:
            out.close()
            made.sort(key=order_key)
            for i in range(0, len(made), 10_000):
                yield index_batch(made[i : i + 10_000])

    return materialize(ready.select("page_id", "url", "html", "ts", "refers_to").mapInArrow(run, INDEX), "runs")


def order_key(entry: tuple) -> tuple:
    """URL key, timestamp, page (null first), and the place in the archives."""
    key, ts, page_id, archive, position, _ = entry
    return key, ts, page_id is not None, page_id or 0, archive, position


def index_batch(entries: list[tuple], names: list[str] = NAMES) -> pa.RecordBatch:
    kinds = [pa.string() if x in ("urlkey", "ts", "archive") else pa.int64() for x in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*entries, strict=True)) or [[]] * len(names), kinds, strict=True)], names)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so each entry that goes out replays one path to the root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.keys = [order_key(r[0]) if r else None for r in runs]
        self.losers = [-1] * len(runs)
        self.winner = self.play(1) if runs else -1

    def before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def play(self, node: int) -> int:
        n = len(self.runs)
        if node >= n:
            return node - n
        a, b = self.play(2 * node), self.play(2 * node + 1)
        win, lose = (a, b) if self.before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple]:
        n = len(self.runs)
        while n and self.keys[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = order_key(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + n) // 2
            while node >= 1:
                if self.before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge(runs: DataFrame) -> DataFrame:
    """The index in global order of URL key, timestamp and page: the captures of range 0, then of range 1 and so on, each in
    the order of place; capture numbers those of a URL key from 1. A range is one task's merge of the runs' slices, which it
    holds; there are as many ranges as keep it to about RANGE_ROWS. Entries of one run arrive in its order; what is read out
    of order starts another run."""
    spark = runs.sparkSession
    ship(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place, key, capture = TaskContext.get().partitionId(), 0, None, 0
        slices: dict[str, list[list[tuple]]] = {}
        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = slices.setdefault(entry[3], [[]])
                if own[-1] and order_key(own[-1][-1]) > order_key(entry):
                    own.append([])
                own[-1].append(entry)
        out = []
        for entry in LoserTree([r for own in slices.values() for r in own]):
            capture = capture + 1 if entry[0] == key else 1
            key = entry[0]
            out.append((*entry, at, place, capture))
            place += 1
            if len(out) == 10_000:
                yield index_batch(out, ORDER)
                out = []
        yield index_batch(out, ORDER)

    merged = materialize(runs.repartitionByRange(parts, "urlkey", "ts", "page_id", "archive", "position").mapInArrow(run, f"{INDEX}, range long, place long, capture long"), "index")
    # a key that goes on in the next range is counted on: of each range the first key, and the last one with its captures
    ends = merged.groupBy("range").agg(F.min("urlkey").alias("first"), F.max(F.struct("urlkey", "capture")).alias("last"))
    keys = ends.select("range", F.col("first").alias("urlkey"), F.lit(0).cast("long").alias("n")).unionByName(ends.select("range", "last.urlkey", F.col("last.capture").alias("n")))
    before = Window.partitionBy("urlkey").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    starts = keys.withColumn("counted", F.sum("n").over(before)).where("counted > 0").select("range", "urlkey", "counted").distinct()
    full = merged.join(maybe_broadcast(starts), ["range", "urlkey"], "left")
    return full.select(*NAMES, "range", "place", (F.col("capture") + F.coalesce("counted", F.lit(0))).alias("capture"))


def read(index: DataFrame) -> DataFrame:
    """The records that the index names, with their capture numbers: each archive is read front to back, in slices of about
    READ_BYTES by tasks of their own."""
    spark = index.sparkSession
    ship(spark)
    index = columns_or_null(index, archive="string", position="long", length="long", capture="long")
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for i in range(0, b.num_rows, 500):
                out = []
                for archive, position, length, capture in zip(*(b.slice(i, 500).column(c).to_pylist() for c in ("archive", "position", "length", "capture")), strict=True):
                    if archive != name:
                        if f is not None:
                            f.close()
                        name, f = archive, files.open_random(archive)
                    f.seek(position)
                    out.append((*parse(gzip.decompress(f.read(length))), capture))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ordered = index.withColumn("slice", F.expr(f"position div {READ_BYTES}")).repartition(tasks, "archive", "slice").sortWithinPartitions("archive", "position").drop("slice")
    return ordered.mapInArrow(run, RECORD)
