"""WARC archives written and read by Spark, records told from look-alikes by their boundary chain.

Writing: records with equal payloads are found by digest; the one with the largest page id is a response, the others
are revisits that name it. Each task writes archives of a bounded number of records with the text writer.

Reading: the text reader splits archives of any size at the record magic, so each piece between two magics is a
candidate record. A task knows where each piece of its split begins and, from the candidate's Content-Length, where
its successor must begin. The true records are those reachable from the start of the file. Inside a split a task
follows successors to the first one beyond it; pointer jumping over these exits (the reachable set doubles its reach
each round) finds where the chain enters each split, and each split then marks its own chain. Pieces off the chain are
payload text that looks like a record, and are put back into the payload they belong to.

Defined results: null payloads are empty; payloads may hold the magic or whole records; null or odd urls are written
without control characters; null page ids are read back as null; repeated rows that share a group's largest id
are responses each; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candleforge.llm.common import shared_dir, stored, table

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS_PER_FILE = 50_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LENGTH = re.compile(rb"^Content-Length:[ \t]*(\d{1,15})[ \t]*\r?$", re.I | re.M)


def base32_sha1(column):
    """Bare upper-case base32 SHA-1: five hex digits make four base32 digits."""
    hexes = F.sha1(F.encode(column, "UTF-8"))
    groups = [F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def warc_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``record``: the text of each page's record, from MAGIC to before the closing END."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id"), F.col("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("digest")
    )
    # Groups of one need no partner; the others are written, so that both sides of the join can be split at hot keys.
    groups = stored(
        rows.filter(F.col("n") >= least_bytes)
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    rows = rows.join(groups, ["digest", "n"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]+", "%20")
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.when(revisit, F.lit(len(HTTP)).cast("long")).otherwise(F.col("n") + len(HTTP)).cast("string"), F.lit(END + HTTP),
    )
    return rows.select(F.when(revisit, head).otherwise(F.concat(head, "payload")).alias("record"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives under ``path``: part files of at most RECORDS_PER_FILE records."""
    warc_records(pages, least_bytes).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


HEADER = "file string, block long, rel long, size long, next_rel long, exit_rel long, whole boolean"
META = "kind string, page_id long, n long, digest string, refers_to long"


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"^" + re.escape(name) + rb":[ \t]*(.*?)[ \t]*\r?$", head, re.I | re.M)
    return m[1] if m else None


def _number(value: bytes | None) -> int | None:
    m = re.search(rb"(-?\d+)>?\Z", value or b"")
    return int(m[1]) if m else None


def _candidate(piece: bytes) -> tuple[int, int, bytes]:
    """Of a piece after its magic: bytes of its header, of its block (-1: none stated), and the header."""
    cut = piece.find(b"\r\n\r\n")
    if cut < 0:
        return len(piece), -1, piece
    head = piece[: cut + 2]
    m = LENGTH.search(head)
    return cut + 4, int(m[1]) if m else -1, head


def _meta(head: bytes, block: bytes | None) -> tuple:
    """kind, page_id, payload bytes, digest and refers_to of a record; the payload itself is measured if it is there."""
    kind = (_field(head, b"WARC-Type") or b"").decode("utf-8", "replace")
    page, refers = _number(_field(head, b"WARC-Record-ID")), _number(_field(head, b"WARC-Refers-To"))
    if kind == "revisit" or block is None:
        digest = (_field(head, b"WARC-Payload-Digest") or b"").decode("utf-8", "replace").removeprefix("sha1:")
        return kind, page, _number(_field(head, b"X-Payload-Length")), digest, refers
    payload = block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block
    return kind, page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), refers


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The pieces between magics, with the file and the first byte of the split that they were read from."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(F.encode("value", "UTF-8").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    )


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes | None]]:
    """File, split, offset within the split's pieces, and piece; a None piece ends each split."""
    key, rel = None, 0
    for batch in batches:
        for piece, file, block in zip(*(batch.column(c) for c in ("piece", "file", "block")), strict=True):
            own = (file.as_py(), block.as_py())
            if own != key:
                if key:
                    yield *key, rel, None
                key, rel = own, 0
            data = piece.as_py()
            yield *key, rel, data
            rel += len(data) + len(MAGIC)
    if key:
        yield *key, rel, None


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Each piece as a candidate record: place, stated successor, first successor beyond the split, and its fields."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for file, block, rel, piece in _by_split(batches):
            if piece is not None:
                head_bytes, block_bytes, head = _candidate(piece)
                size = len(piece) + len(MAGIC)
                if block_bytes < 0:
                    rows.append((file, block, rel, size, None, None, False, None, None, None, None, None))
                    continue
                total = len(MAGIC) + head_bytes + block_bytes + len(END)
                whole = len(piece) >= head_bytes + block_bytes + len(END)
                meta = _meta(head, piece[head_bytes : head_bytes + block_bytes] if whole else None)
                rows.append((file, block, rel, size, rel + total, None, whole, *meta))
            elif rows:
                # From the last piece to the first: each successor's exit is known before it is asked for.
                out: dict[int, int] = {}
                for i in range(len(rows) - 1, -1, -1):
                    if (to := rows[i][4]) is not None:
                        out[rows[i][2]] = exit_rel = out.get(to, to) if to < rel else to
                        rows[i] = (*rows[i][:5], exit_rel, *rows[i][6:])
                yield from _arrow(rows).to_batches(max_chunksize=20_000)
                rows = []

    return _pieces(spark, path).mapInArrow(scan, f"{HEADER}, {META}")


def _arrow(rows: list[tuple]) -> pa.Table:
    kinds = [("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("next_rel", pa.int64()), ("exit_rel", pa.int64()), ("whole", pa.bool_()),
             ("kind", pa.string()), ("page_id", pa.int64()), ("n", pa.int64()), ("digest", pa.string()), ("refers_to", pa.int64())]
    return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], [n for n, _ in kinds])


def chain(found: DataFrame) -> DataFrame:
    """``found`` (stored candidates) with absolute offsets ``at`` and ``on_chain``, true where the file's start reaches."""
    # A piece follows its magic, so the record of a piece begins MAGIC bytes before it; the piece before the first
    # magic of a file is empty and stands for no record.
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored(splits.select("file", "block", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("base")))
    placed = found.join(F.broadcast(splits) if splits.count() < 100_000 else splits, ["file", "block"])
    nodes = placed.filter(F.col("exit_rel").isNotNull()).select(
        "file", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("exit_rel")).alias("to")
    )
    # Only the start and the stated exits can be where the chain enters a split.
    entries = nodes.select("file", F.col("to").alias("at")).union(nodes.select("file").distinct().select("file", F.lit(0).cast("long").alias("at")))
    jump = stored(nodes.join(entries.distinct(), ["file", "at"]))
    reached = stored(jump.filter("at = 0").select("file", "at"))
    n = reached.count()
    while n:
        further = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        grown = stored(reached.union(further).distinct())
        twice = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at")))
        jump = stored(twice.select(F.col("a.file"), F.col("a.at"), F.col("b.to")))
        reached, last, n = grown, n, grown.count()
        if n == last:
            break

    def mark(key, rows: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        index = {a: i for i, a in enumerate(rows["at"].tolist())}
        on = np.zeros(len(rows), bool)
        to = rows["to"].tolist()
        for a in entered["at"].tolist():
            i = index.get(a)
            while i is not None and not on[i]:
                on[i] = True
                i = None if pd.isna(to[i]) else index.get(int(to[i]))
        rows["on_chain"] = on
        return rows[["file", "block", "at", "on_chain"]]

    rows = placed.select("file", "block", (F.col("base") + F.col("rel")).alias("at"), (F.col("base") + F.col("next_rel")).alias("to"))
    ends = splits.withColumn("until", F.lead("base").over(Window.partitionBy("file").orderBy("block")))
    entered = reached.join(ends, "file").filter((F.col("at") >= F.col("base")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    marked = (
        rows.groupBy("file", "block")
        .cogroup(entered.select("file", "block", "at").groupBy("file", "block"))
        .applyInPandas(mark, "file string, block long, at long, on_chain boolean")
    )
    return placed.withColumn("at", F.col("base") + F.col("rel")).join(marked, ["file", "block", "at"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per true record: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    found = stored(candidates(spark, path))
    in_file = Window.partitionBy("file").orderBy("at")
    linked = stored(
        chain(found)
        .withColumn("record", F.last(F.when(F.col("on_chain"), F.col("at")), ignorenulls=True).over(in_file))
        .filter("record is not null")
    )
    result = ["page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"]
    simple = linked.filter("on_chain and (whole or kind = 'revisit')").select(*result)
    # Payloads that hold the magic: their pieces are read again and put together.
    broken = linked.filter("on_chain and not whole and kind != 'revisit'").select("file", "record")
    wanted = stored(linked.join(broken, ["file", "record"], "left_semi").select("file", "block", "rel", "at", "record"))
    if wanted.isEmpty():
        return simple

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, rel, piece in _by_split(batches):
            if piece is not None:
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([rel]), pa.array([piece])], ["file", "block", "rel", "piece"])

    def assemble(key, rows: pd.DataFrame) -> pd.DataFrame:
        data = MAGIC.encode().join(rows.sort_values("at")["piece"].tolist())
        head_bytes, block_bytes, head = _candidate(data)
        kind, page, n, digest, refers = _meta(head, data[head_bytes : head_bytes + block_bytes])
        return pd.DataFrame({"page_id": pd.array([page], "Int64"), "payload_bytes": [n], "payload_digest": [digest], "record_type": [kind], "refers_to": pd.array([refers], "Int64")})

    pieces = _pieces(spark, path).mapInArrow(scan, "file string, block long, rel long, piece binary")
    mended = (
        pieces.join(wanted, ["file", "block", "rel"])
        .groupBy("file", "record")
        .applyInPandas(assemble, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    )
    return simple.unionByName(mended)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)
