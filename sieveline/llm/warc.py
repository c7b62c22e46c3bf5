"""Merkle fixity audit of WARC archives and their replicas.

Records lie in files, in order of offset. Leaves hash a record with its offset range; inner nodes hash the digests of
FANOUT children in order and span their range; file roots are joined by more levels up to one root for the archive.
Two replicas are compared from their roots down: of each level only children of nodes that differ are compared, and
only the folders are read that hold the files of such nodes, so branches in folders without a difference are not opened.
What is left at the leaves are the damaged ranges.

A node gathers FANOUT children at most. Files hold a bounded number of records. Each level is written to shared storage
in SPANS folders of neighbouring files at most. Leaves carry the digests of their records and what a report says of
them, so records are read once for each replica, to hash them.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import CLEANUP, new_path, setting, staged

FANOUT = 16
FILE_RECORDS = 1024
SPANS, CHUNK_FILES = 256, 256
_NODE = "level int, span long, file long, idx long, start long, stop long, digest string, sha string"


def warc_record(uri: Column, payload: Column) -> Column:
    """The bytes of a resource record; null fields count as empty. The record id comes from the content."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    uri = F.coalesce(F.regexp_replace(uri, r"[\r\n]+", " "), F.lit(""))
    name = F.sha2(F.concat(uri.cast("binary"), body), 256)
    dashed = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), dashed, F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """(file, idx, start, stop, page_id, copies, record): pages as records of WARC files, on shared storage.

    Rows that are the same in page_id, url and html are one record with their number as copies. Pages are dealt to
    files by hash, about file_records each, and stand in order of page_id, url, and digest. Null page_ids stand last in
    their file; null urls and html make records with an empty one. Other columns are ignored; an empty table makes no file.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", warc_record(F.col("url"), F.col("html")).alias("record"))
    rows = rows.withColumn("sha", F.sha2("record", 256))
    copies = staged(rows.groupBy("page_id", "url", "sha").agg(F.count("*").alias("copies"), F.min(F.octet_length("record")).cast("long").alias("size")), "copies")
    files = max(1, -(-copies.count() // file_records))
    place = copies.withColumn("file", F.pmod(F.xxhash64("sha", "page_id"), F.lit(files)))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_last(), "sha")
    place = place.withColumn("idx", F.row_number().over(order).cast("long") - 1).withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = place.select("file", "idx", (F.col("stop") - F.col("size")).alias("start"), "stop", "copies", F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("sha").alias("_sha"))
    one = rows.join(place, F.col("page_id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url")) & (F.col("sha") == F.col("_sha")))
    # of repeated rows one record is stored: they are equal, so any of them
    one = one.select("file", "idx", "start", "stop", "page_id", "copies", "record")
    if not copies.where("copies > 1").isEmpty():
        one = one.groupBy("file", "idx", "start", "stop", "page_id", "copies").agg(F.first("record").alias("record"))
    return staged(one, "archive")


@dataclass
class Tree:
    """The stored levels of a replica: level 0 are leaves, the last is the root. within: levels whose nodes lie within
    one file; above them nodes stand for whole files and groups of files. width: files of a folder, by level."""

    spark: SparkSession
    path: str
    rest: str
    within: int
    width: list[int]

    @property
    def levels(self) -> int:
        return len(self.width)

    def level(self, n: int, files: list[range] | None = None) -> DataFrame:
        """The nodes of a level; files: only folders that hold files (or groups of files) of these ranges."""
        nodes = self.spark.read.schema(_NODE + (", rest " + self.rest if n == 0 else "")).option("basePath", self.path).parquet(f"{self.path}/level={n}")
        if files is None:
            return nodes
        spans = {f for r in files for f in range(r.start // self.width[n], (r.stop - 1) // self.width[n] + 1)}
        return nodes.where(F.col("span").isin(sorted(spans)))

    def root(self) -> str | None:
        row = self.level(self.levels - 1).select("digest").first() if self.levels else None
        return row.digest if row else None


def _parents(nodes: DataFrame, file: Column, idx: Column, fanout: int) -> DataFrame:
    kids = F.sort_array(F.collect_list(F.struct("file", "idx", "digest")))
    node = F.sha2(F.concat_ws("", F.lit("node"), F.transform(kids, lambda k: F.coalesce(k["digest"], F.lit("-")))), 256)
    up = nodes.groupBy(file.alias("file"), F.floor(idx / fanout).alias("idx")).agg(F.min("start").alias("start"), F.max("stop").alias("stop"), node.alias("digest"))
    return up.select("file", "idx", "start", "stop", "digest", F.lit(None).cast("string").alias("sha"))


def merkle_tree(records: DataFrame, fanout: int = FANOUT) -> Tree:
    """The tree of a replica (file, idx, start, stop, record, and columns that reports carry). A record that can't be
    read is null. An empty replica has no levels."""
    spark, path = records.sparkSession, new_path(records.sparkSession, "tree")
    rest = records.drop("file", "idx", "start", "stop", "record")
    # a struct even where nothing is left to carry
    rest = F.struct(*[F.col(f"`{c}`") for c in rest.columns], F.lit(0).alias("_none"))
    sha = F.sha2("record", 256)
    leaf = F.when(F.col("record").isNotNull(), F.sha2(F.concat_ws(":", F.lit("leaf"), "start", "stop", sha), 256))
    shape = records.agg(F.max("idx"), F.max("file")).first()
    if shape[0] is None:
        return Tree(spark, path, "struct<_none:int>", 0, [])
    tree = Tree(spark, path, "", 0, [])

    def put(df: DataFrame, files: int) -> None:
        width = max(1, -(-files // SPANS))
        out = df.withColumn("span", F.floor(F.col("file") / width))
        # neighbouring files are written together: few files in each folder, and no task holds a folder
        out = out.repartition(F.floor(F.col("file") / min(width, CHUNK_FILES))) if files > 1 else out
        with setting(spark, CLEANUP, "true"):
            out.write.partitionBy("span").parquet(f"{path}/level={tree.levels}")
        tree.width.append(width)

    leaves = records.select("file", "idx", "start", "stop", leaf.alias("digest"), sha.alias("sha"), rest.alias("rest"))
    tree.rest = leaves.schema["rest"].dataType.simpleString()
    last, files = shape[0], shape[1] + 1
    put(leaves, files)
    while last:
        put(_parents(tree.level(tree.levels - 1), F.col("file"), F.col("idx"), fanout), files)
        last //= fanout
    tree.within = tree.levels
    while files > 1:
        files = -(-files // fanout)
        put(_parents(tree.level(tree.levels - 1), F.floor(F.col("file") / fanout), F.lit(0), fanout), files)
    return tree


def damaged_leaves(a: Tree, b: Tree, fanout: int = FANOUT) -> DataFrame:
    """(file, idx, start, stop, status, and sha and rest of each side): leaves of a that b lacks or holds otherwise, and
    leaves only b has.

    status: corrupt, missing (from b, or unreadable there) or extra. Both trees should be of one layout; trees of
    different height are compared from their leaves.
    """
    key = ["file", "idx"]
    alike = (a.within, a.levels) == (b.within, b.levels)
    differing, files = None, None
    for n in reversed(range(a.levels)) if alike else [0]:
        x, y = a.level(n, files), b.level(n, files)
        if differing is not None:
            up = differing.select(F.col("file").alias("_f"), F.col("idx").alias("_i"))
            # the nodes above these: FANOUT neighbours within a file, or FANOUT files
            on = (F.col("file") == F.col("_f")) & (F.floor(F.col("idx") / fanout) == F.col("_i")) if n + 1 < a.within else F.floor(F.col("file") / fanout) == F.col("_f")
            x, y = x.join(up, on, "left_semi"), y.join(up, on, "left_semi")
        own = [] if n else ["sha", "rest"]
        x = x.select(*key, "start", "stop", "digest", *own).withColumn("_here", F.lit(True))
        y = y.select(*key, *[F.col(c).alias(f"_{c}") for c in ("start", "stop", "digest", *own)]).withColumn("_there", F.lit(True))
        both = x.join(y, key, "full").where(~F.col("digest").eqNullSafe(F.col("_digest")) | F.col("_here").isNull() | F.col("_there").isNull())
        status = F.when(F.col("_here").isNull(), "extra").when(F.col("_digest").isNull(), "missing").otherwise("corrupt")
        differing = both.select(*key, F.coalesce("start", "_start").alias("start"), F.coalesce("stop", "_stop").alias("stop"), status.alias("status"), *own, *[f"_{c}" for c in own])
        if n:
            differing = staged(differing, "differing")
            files = _few_files(differing, 1 if n < a.within else fanout, max(a.width[n - 1], b.width[n - 1]))
    return differing


def _few_files(differing: DataFrame, fanout: int, width: int) -> list[range]:
    """Ranges of files (or groups of files) under the nodes that differ: a range for each folder of that width, so little
    more than SPANS on the driver."""
    below = differing.select(F.explode(F.sequence(F.col("file") * fanout, F.col("file") * fanout + (fanout - 1))).alias("f"))
    return [range(r[0] * width, (r[0] + 1) * width) for r in below.select(F.floor(F.col("f") / width)).distinct().collect()]


def audit(replica_a: DataFrame, replica_b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """For each record of a, and each that only b has: its columns but the bytes (of b's for those), record_sha256 and
    status (intact, corrupt, missing in b, or extra in b).

    Replicas: file, idx (place in the file, from 0), start, stop, record, and other columns, which are reported; (file,
    idx) tell records apart. A null record is one that can't be read; its record_sha256 is null. Where a null record
    stands in both, it is intact: both hold the same. Empty replicas have no records. The replicas should have the same
    columns; one of theirs that is named like a column of the report comes back as own_ and its name.
    """
    a, b = merkle_tree(replica_a, fanout), merkle_tree(replica_b, fanout)
    place, names = ("file", "idx", "start", "stop"), {}
    for c in replica_a.columns:
        if c != "record":
            own = c
            while own in ("record_sha256", "status") or (own != c and own in replica_a.columns):
                own = f"own_{own}"
            names[c] = own

    def report(nodes: DataFrame, status: Column) -> DataFrame:
        return nodes.select(*[F.col(c) if c in place else F.col(f"rest.`{c}`").alias(own) for c, own in names.items()], F.col("sha").alias("record_sha256"), status.alias("status"))

    if not a.levels:
        return report(b.level(0), F.lit("extra")) if b.levels else replica_a.select(*[F.col(f"`{c}`").alias(own) for c, own in names.items()], F.lit(None).cast("string").alias("record_sha256"), F.lit("intact").alias("status")).limit(0)
    if not b.levels:
        return report(a.level(0), F.lit("missing"))
    if a.root() == b.root():
        return report(a.level(0), F.lit("intact"))
    found = staged(damaged_leaves(a, b, fanout), "damaged")
    marks = found.where("status <> 'extra'").select("file", "idx", "status")
    rows = report(a.level(0).join(marks, ["file", "idx"], "left"), F.coalesce("status", F.lit("intact")))
    extra = found.where("status = 'extra'").select("file", "idx", "start", "stop", F.col("_sha").alias("sha"), F.col("_rest").alias("rest"))
    return rows.unionByName(report(extra, F.lit("extra")), allowMissingColumns=True)


def rotted(records: DataFrame, share: int = 16) -> DataFrame:
    """A replica with simulated bit rot, for drills: about one record in share is damaged, one in share**2 unreadable,
    chosen by digest. A damaged record has its last byte before the end mark changed."""
    sha = F.sha2("record", 256)
    damaged = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit("?\r\n\r\n").cast("binary"))
    dice = F.pmod(F.xxhash64(sha), F.lit(share * share))
    return records.withColumn("record", F.when(dice == 0, F.lit(None).cast("binary")).when(dice % share == 0, damaged).otherwise(F.col("record")))


def page_audit(pages: DataFrame) -> DataFrame:
    """A fixity drill over all pages: archive them, compare with a replica under bit rot, and report every record.

    (file, idx, start, stop, page_id, copies, record_sha256, status). Null urls and html count as empty; null page_ids
    are records like others, last in their file; repeated rows are one record with copies. Other columns are ignored.
    """
    stored = archive(pages)
    return audit(stored, rotted(stored))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, start, stop, record, state): the records of WARC files (plain, or gzip members) under a path that
    Spark can read. Offsets are those in the stored file. An empty file has no records.

    state: whole; truncated (the file ends within the record, which holds what is left); damaged (bytes that can't be
    unpacked or aren't a record, up to the next record that can be told apart; record is null for those of a gzip
    member, and the bytes themselves otherwise). A file comes as one value, so it must be smaller than 2 GB; its
    records are handed on a few at a time.
    """
    schema = pa.schema([("path", pa.string()), ("idx", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("record", pa.binary()), ("state", pa.string())])

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for i, (a, b, r, state) in enumerate(split_records(data.as_py() or b"")):
                    rows.append({"path": name.as_py(), "idx": i, "start": a, "stop": b, "record": r, "state": state})
                    held += len(r or b"")
                    if len(rows) == 256 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, idx long, start long, stop long, record binary, state string")


def numbered(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas as read_warc gives them, with one numbering of their files, by name without folders, for audit().
    Records that aren't whole are null there. One row for each file name is sorted in one task."""

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("name", F.element_at(F.split("path", "/"), -1))

    names = staged(named(a).select("name").union(named(b).select("name")).distinct().withColumn("file", F.row_number().over(Window.orderBy("name")).cast("long") - 1), "names")
    record = F.when(F.col("state") == "whole", F.col("record"))
    return tuple(named(df).join(names, "name").select("file", "idx", "start", "stop", "name", record.alias("record")) for df in (a, b))


def _member(data: bytes, at: int) -> tuple[int, bytes | None, str]:
    """(stop, record, state) of the gzip member at a place; read in steps, so that no copy of the rest is made."""
    member, out, pos = zlib.decompressobj(31), [], at
    try:
        while not member.eof and pos < len(data):
            step = data[pos : pos + (1 << 16)]
            out.append(member.decompress(step))
            pos += len(step)
    except zlib.error:
        return _next_member(data, at + 1), None, "damaged"
    if not member.eof:
        following = _next_member(data, at + 1)
        return (len(data), b"".join(out), "truncated") if following == len(data) else (following, None, "damaged")
    return pos - len(member.unused_data), b"".join(out), "whole"


def _next_member(data: bytes, at: int) -> int:
    """Where the next bytes stand that unpack to the head of a record, or the end."""
    while (at := data.find(b"\x1f\x8b\x08", at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(data[at : at + 4096], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(data)


def _plain(data: bytes, at: int) -> tuple[int, bytes, str]:
    """(stop, record, state) of the record at a place that isn't packed."""
    head = data.find(b"\r\n\r\n", at) if data[at : at + 5] == b"WARC/" else -1
    for line in data[at:head].split(b"\r\n") if head >= 0 else []:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            stop = head + 4 + int(value) + 4
            if stop > len(data):
                return len(data), data[at:], "truncated"
            if data[stop - 4 : stop] == b"\r\n\r\n":
                return stop, data[at:stop], "whole"
    # no record here: up to the next that begins after an end mark, or as a member
    found = data.find(b"\r\n\r\nWARC/", at)
    stop = min(found + 4 if found >= 0 else len(data), _next_member(data, at + 1))
    return stop, data[at:stop], "damaged"


def split_records(data: bytes) -> Iterator[tuple[int, int, bytes | None, str]]:
    """(start, stop, record, state) of each record in the bytes of a WARC file, in one pass."""
    at = 0
    while at < len(data):
        stop, record, state = (_member if data[at : at + 2] == b"\x1f\x8b" else _plain)(data, at)
        yield at, stop, record, state
        at = stop


def gzip_record(record: bytes) -> bytes:
    """A record as a gzip member, the same each time."""
    return gzip.compress(record, mtime=0)
