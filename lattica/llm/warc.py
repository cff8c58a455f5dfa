"""WARC archives written and read through Spark, and the external merge of their capture indexes."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import cut, heavy_join, quoted, shared_dir, tuned

#: Payloads below this size are never revisits.
MIN_BYTES = 100

#: Bytes of one archive file on average, records in it at most, and index entries in one merged range on average.
ARCHIVE_BYTES, RECORDS, RANGE_ROWS = 16_000_000, 4_096, 100_000

DATE = "2024-01-01T00:00:00Z"

_INDEX = (
    "seq long, urlkey string, stamp string, page_id long, archive string, offset long, length long, "
    "payload_bytes long, payload_digest string, record_type string, refers_to long"
)
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: str | None) -> str:
    """Sort key: host labels from the right, without a leading www, then path and query, in lower case."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if labels and labels[0] == "www":
        labels = labels[1:]
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(labels))}{f':{port}' if port and port not in (80, 443) else ''}){tail.lower()}"


def records(pages: DataFrame, id_col: str, url_col: str, html_col: str, time_col: str | None) -> DataFrame:
    """One row (value) for each page: its WARC record, but for the two line ends that close it.

    A payload with more than a ten-thousandth of all copies meets its first page by a broadcast, so its bodies stay where they are.
    """
    made = pages.select(
        F.col(quoted(id_col)).cast("long").alias("_id"), F.col(quoted(url_col)).cast("string").alias("_url"), F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")).alias("_body"),
        (F.date_format(F.col(quoted(time_col)), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(DATE)).alias("_date"),
    ).withColumn("_sha", F.sha2("_body", 256))
    long = F.octet_length("_body") >= MIN_BYTES
    counted = made.filter(long).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    first = cut(counted.filter("_n > 1"), "payloads")
    copies = first.agg(F.sum("_n")).first()[0] or 0
    alone = made.filter(~long).withColumns({"_first": F.lit(None).cast("long"), "_n": F.lit(None).cast("long")})
    told = heavy_join(made.filter(long), first, "_sha", "_n", copies, "left").unionByName(alone).withColumn("_revisit", F.expr("coalesce(_first IS NOT NULL AND NOT _id <=> _first, false)"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    uri = F.regexp_replace(F.coalesce(F.nullif(F.trim("_url"), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("none")))), "[\\x00-\\x20\\x7F]+", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("_revisit"), "revisit").otherwise("response"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("_id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.coalesce("_date", F.lit(DATE))), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_sha"))),
        line("X-Payload-Length", F.octet_length("_body").cast("string")),
        F.when(F.col("_revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("_first").cast("string"), F.lit(">"))),
        )).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    block = F.concat(F.lit(_HTTP), F.when(F.col("_revisit"), "").otherwise(F.col("_body")))
    return told.select(F.concat(head, line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n\r\n"), block).alias("value"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """Write WARC/1.1 archives below ``path`` with Spark's own writer.

    Its line separator is the two line ends that close each record, so the files are plain WARC in any store
    that Spark can write to; they aren't compressed, so an index's offset and length fetch a record
    by one ranged read. Records a file come from the mean payload, ARCHIVE_BYTES a file on average. Among
    equal payloads of MIN_BYTES at least, the page with the smallest id is the response (null ids come
    last, equal rows are all responses).
    """
    mean = pages.agg(F.avg(F.octet_length(F.col(quoted(html_col)).cast("string")))).first()[0] or 0
    rows = records(pages, id_col, url_col, html_col, time_col)
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", int(max(1, min(RECORDS, ARCHIVE_BYTES // (mean + 600))))).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, by Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        begin = stop + 4
        end = begin + int(fields["content-length"])
        yield at, end + 4 - at, fields, data[begin:end]
        at = end + 4


def _entry(name: str, offset: int, length: int, fields: dict[str, str], block: bytes) -> dict:
    number = lambda x: int(x) if (x := x.rpartition(":")[2].rstrip(">")) not in ("", "none") else None
    revisit = fields["warc-type"] == "revisit"
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    body = block.partition(b"\r\n\r\n")[2]
    if not revisit and hashlib.sha256(body).hexdigest() != stated:
        raise ValueError(f"damaged payload in {name} at {offset}")
    uri = fields["warc-target-uri"]
    return {
        "urlkey": "" if uri.startswith("urn:page:") else url_key(uri), "stamp": fields["warc-date"], "page_id": number(fields["warc-record-id"]), "archive": name, "offset": offset, "length": length,
        "payload_bytes": int(fields["x-payload-length"]) if revisit else len(body), "payload_digest": stated, "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if revisit else None,
    }


_ARROW = pa.schema(
    [("seq", pa.int64())]
    + [(n, pa.string()) for n in ("urlkey", "stamp")]
    + [("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _order(e: dict) -> tuple:
    return (e["urlkey"], e["stamp"], e["page_id"] is None, e["page_id"] or 0, e["archive"], e["offset"])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives below ``path``, as locally sorted runs: one for each archive, ``seq`` the place in it."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                short = name.rpartition("/")[2]
                run = sorted((_entry(short, *record) for record in parse_warc(content.as_py())), key=_order)
                yield pa.RecordBatch.from_pylist([{"seq": i, **e} for i, e in enumerate(run)], schema=_ARROW)

    files = tuned(spark).read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    return files.mapInArrow(index, _INDEX)


class LoserTree:
    """k-way merge of sorted runs of (key, value): each inner node holds the loser of its match, the top the winner.

    Taking the winner replays one path to the root, log2(k) comparisons for each entry. Runs are
    read one entry at a time and must ascend; of equal keys the earlier run wins.
    """

    def __init__(self, runs: Iterable[Iterable[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(len(self.runs), 1)
        for i in range(len(self.runs)):
            self._replay(i, build=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, i: int, build: bool = False) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            if build and self.tree[node] < 0:
                self.tree[node] = i
                return
            if self._less(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[w := self.tree[0]]) is not None:
            yield head
            self.heads[w] = next(self.runs[w], None)
            if self.heads[w] is not None and self.heads[w][0] < head[0]:
                raise ValueError("a run isn't sorted")
            self._replay(w)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Globally ordered capture histories: partitions by ranges of (urlkey, stamp, page), each merged by a loser tree.

    Page and place are part of the range key, so one host or URL with a third of all captures is
    cut like any other. A task holds the entries of one range (RANGE_ROWS on average) as Arrow columns, not
    payloads; runs are laid out by their places ``seq`` (Spark may deliver blocks in any order) and merged as they stand.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=_ARROW).combine_chunks()
        if not table.num_rows:
            return
        table = table.take(pc.sort_indices(table, sort_keys=[("archive", "ascending"), ("seq", "ascending")]))
        names, starts = table["archive"].to_pylist(), [0]
        starts += [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
        keys, stamps, pages, places = (table[c].to_pylist() for c in ("urlkey", "stamp", "page_id", "offset"))

        def run(a: int, b: int) -> Iterator[tuple]:
            for i in range(a, b):
                yield (keys[i], stamps[i], pages[i] is None, pages[i] or 0, names[i], places[i]), i

        merged = (i for _, i in LoserTree(run(a, b) for a, b in itertools.pairwise(starts)))
        while rows := list(itertools.islice(merged, 8_192)):
            yield from table.take(pa.array(rows)).drop_columns("seq").combine_chunks().to_batches()

    n = max(1, -(-runs.count() // RANGE_ROWS), runs.sparkSession.sparkContext.defaultParallelism)
    ranges = runs.repartitionByRange(n, "urlkey", "stamp", F.col("page_id").isNull(), "page_id", "archive", "offset")
    return ranges.mapInArrow(merge, _INDEX.removeprefix("seq long, "))


def capture_histories(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, read them back and merge their indexes.

    Returns an entry for each page, in global order by URL key, time and page. Null html is an
    empty payload; null or empty URLs sort first under the key ''; null ids come back as null and
    sort last within URL key and time; ties go by archive and offset; repeated rows give repeated records; a
    very long page makes a large archive of its own size and is indexed whole; other columns are
    ignored; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = path or shared_dir(spark, "warc")
    write_warc(pages, path, **columns)
    return merge_runs(cut(read_runs(spark, path), "runs"))
