"""Removal of repeated substrings by interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of ``least`` bytes that covers it also starts earlier, in a smaller document or earlier in the
same one. Suffixes of the whole corpus don't fit in one place, so equal strings are first brought together: each string
of ``least`` bytes is filed under the least hash of the k-grams inside it, which depends on the string alone.
Neighbouring strings mostly have the same one, so a text is a series of runs, about 35 strings each.

1. Runs are filed by key in compact rows, with a hash of their bytes. Equal runs are collapsed to the first, in each
   batch and then in each file, and the others' strings are marked; so a hot key costs each batch its distinct runs.
   What is left alone under its key has no twin and goes no further.
2. The texts meet the list of their runs that share a key with a different one, and those runs' bytes are filed by
   key. Runs of keys with very many are cut to single strings filed by their own hash as well, so a boundary that many
   documents share doesn't gather in one place.
3. In each file a suffix array is sorted and its Burrows-Wheeler transform expanded breadth first: intervals of
   suffixes with a common string are extended backward, eight bytes a step, and split by the symbols before them; intervals of one suffix are dropped, and at ``least``
   bytes the expansion stops. What shares an interval then is equal, and all but the first start is marked.
4. The texts meet their marked strings, and the covered bytes are removed.

Defined results: null and empty texts have no bytes; texts shorter than ``least`` lose nothing; rows with a null id
lose nothing; rows that share an id are one document, of which one text is compared; texts may be as long as Spark's
strings, 2 GB; runs are taken as equal by hashes of about 100 bits; an empty table gives an empty result; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import map_arrow, stored, table
from candleforge.llm.shingles import bytes_of, mixed, powers, range_hashes, slices

LEAST, GRAM = 100, 32
#: Strings of a run at most.
RUN = 255
#: A key is hot above this many runs and above this share of all runs, so there are at most 1 / HOT_SHARE hot keys.
HOT, HOT_SHARE = 2_000, 1 / 500_000
#: Bytes of text for each file of runs and for each group of texts, whatever the number of shuffle partitions.
FILE_BYTES, GROUP_BYTES = 8 << 20, 2 << 20
#: Bytes of text that are worked on at once, so that work arrays of some 60 bytes for each stay small; a longer text, or the runs of one key, go alone.
SLICE = 1 << 20


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def window_keys(data: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """By start of each string of ``least`` bytes: the least hash of a k-gram inside it, and whether it is there twice."""
    n, width = len(data), least - gram + 1
    if n < least:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    # The low bits tell places apart that are less than 128 bytes from each other: once rising, once falling.
    low = np.uint64(127)
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: n - gram + 1]) & ~low
    place = np.arange(len(grams), dtype=np.uint64) & low
    one, other = _sliding_min(grams | place, width), _sliding_min(grams | (low - place), width)
    return one >> np.uint64(7), (one & low) != low - (other & low)


def runs_of(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """Key, text, first and last string start (in the text) of each run, and whether it may hold equal strings itself."""
    keys, twice = window_keys(data, least, gram)
    n = len(keys)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty, np.zeros(0, bool)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + least <= offsets[1:][of]
    new = np.ones(n, bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    # Long runs, of periodic text, are cut.
    at = np.flatnonzero(new)
    size = np.diff(np.r_[at, n])
    inside = np.logical_or.reduceat(twice, at) | (size > least - gram + 1)
    pieces = -(-size // RUN)
    start = np.repeat(at, pieces) + RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    end = np.minimum(start + RUN, np.repeat(at + size, pieces)) - 1
    inside = np.repeat(inside, pieces)
    keep = valid[start]
    start, end = start[keep], end[keep]
    text = of[start]
    end = np.minimum(end, offsets[1:][text] - least)
    return keys[start], text, start - offsets[:-1][text], end - offsets[:-1][text], inside[keep]


def _split(of: np.ndarray) -> list[np.ndarray]:
    """Row numbers of each value of ``of``, by rising value."""
    order = np.argsort(of, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(of) else []


def _long(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int64)


def _int(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.int32)


def _deltas(ids: np.ndarray) -> bytes:
    """Ids by rising place, as differences, which compress well."""
    return np.diff(ids, prepend=0).tobytes()


def _undeltas(parts) -> np.ndarray:
    return np.concatenate([np.cumsum(np.frombuffer(p, np.int64)) for p in parts] or [np.zeros(0, np.int64)])


def _twins(key: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs that equal one that starts earlier, and of the others, by key."""
    order = np.lexsort((start, doc, whole, key))
    twin = np.zeros(len(key), bool)
    twin[1:] = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
    return order[twin], order[~twin]


def filed_keys(docs: DataFrame, files: int, least: int, gram: int) -> DataFrame:
    """Distinct runs of each batch by file; ``sure`` rows hold runs that equal one of the same batch."""

    def batch_runs(batch: pa.RecordBatch) -> pa.Table | None:
        ids = batch.column("doc_id").to_numpy()
        found, begin = [], 0
        for run in slices(batch.column("text"), SLICE):
            data, offsets = bytes_of(run)
            key, text, start, end, inside = runs_of(data, offsets, least, gram)
            whole = range_hashes(data, offsets[text] + start, offsets[text] + end + least)
            found.append((key, whole, ids[begin : begin + len(run)][text], start.astype(np.int32), (end - start).astype(np.uint8), inside))
            begin += len(run)
        key, whole, doc, start, more, inside = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(key):
            return None
        twins, first = _twins(key, whole, doc, start)
        first = np.sort(first)

        def row(at: np.ndarray, sure: bool) -> tuple:
            # Any file passes on what is marked for sure; by document, so that the batches' don't meet in one.
            by = mixed(doc[at[:1]].astype(np.uint64)) if sure else key[at[:1]]
            return (int(by[0] % np.uint64(files)), sure, b"" if sure else (key[at] >> np.uint64(25)).astype(np.uint32).tobytes(), b"" if sure else whole[at].tobytes(),
                    _deltas(doc[at]), start[at].tobytes(), more[at].tobytes(), b"" if sure else inside[at].tobytes())

        rows = [row(first[p], False) for p in _split(key[first] % np.uint64(files))]
        if len(twins):
            rows.append(row(np.sort(twins), True))
        kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 6)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "sure", "keys", "wholes", "docs", "starts", "sizes", "inside"])

    return map_arrow(docs, batch_runs, "file int, sure boolean, keys binary, wholes binary, docs binary, starts binary, sizes binary, inside binary")


def sorted_runs(filed: DataFrame, hot: int) -> DataFrame:
    """Runs of which the first (doc_id, first, last) strings are marked, or wanted with their bytes; hot keys have no doc_id."""

    def in_file(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sure, rows = rows[rows["sure"]], rows[~rows["sure"]]
        keys, whole = np.frombuffer(b"".join(rows["keys"]), np.uint32), np.frombuffer(b"".join(rows["wholes"]), np.uint64)
        doc, start, inside = _undeltas(rows["docs"]), _int(rows["starts"]), np.frombuffer(b"".join(rows["inside"]), bool)
        end = start + np.frombuffer(b"".join(rows["sizes"]), np.uint8)
        twins, first = _twins(keys, whole, doc, start)
        own, inverse, count = np.unique(keys[first], return_inverse=True, return_counts=True)
        wanted = first[(count[inverse] > 1) | inside[first]]
        heavy = own[count > hot].astype(np.int64) | (int(key[0]) << 32)
        sure_start = _int(sure["starts"])
        parts = (
            (_undeltas(sure["docs"]), sure_start, sure_start + np.frombuffer(b"".join(sure["sizes"]), np.uint8), False, 0),
            (doc[twins], start[twins], end[twins], False, 0),
            (doc[wanted], start[wanted], end[wanted], True, 0),
        )
        out = [pd.DataFrame({"doc_id": pd.array(d, "Int64"), "first": a, "last": b, "wanted": w, "hot_key": k}) for d, a, b, w, k in parts]
        out.append(pd.DataFrame({"doc_id": pd.array([None] * len(heavy), "Int64"), "first": 0, "last": 0, "wanted": False, "hot_key": heavy}))
        return pd.concat([x for x in out if len(x)] or out[:1])

    return filed.groupBy("file").applyInPandas(in_file, "doc_id long, first int, last int, wanted boolean, hot_key long")


def filed_runs(docs: DataFrame, wanted: DataFrame, hot_keys: np.ndarray, files: int, parts: int, least: int, gram: int) -> DataFrame:
    """The wanted runs with their bytes, in ``parts`` files; ``files`` are those in which hot keys were found."""
    kinds = {"file": pa.int32(), "keys": pa.binary(), "docs": pa.binary(), "starts": pa.binary(), "ends": pa.binary(), "bytes": pa.binary()}

    def in_group(texts: pa.Table, lists: pa.Table) -> pa.Table:
        rows = []
        if lists.num_rows and texts.num_rows:
            ids = texts["doc_id"].combine_chunks().to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            # Only texts with wanted runs are cut to runs again; a run is told by (document, start).
            place = np.searchsorted(ids, lists["doc_id"].combine_chunks().to_numpy())
            have, place = np.unique(place, return_inverse=True)
            marks = np.unique((place.astype(np.int64) << 32) | lists["first"].combine_chunks().to_numpy())
            ids, begin = ids[have], 0
            for run in slices(texts["text"].combine_chunks().take(pa.array(order[have])), SLICE):
                data, offsets = bytes_of(run)
                key, text, start, end, _ = runs_of(data, offsets, least, gram)
                keep = np.isin(((text + begin) << 32) | start, marks)
                key, doc, shift = key[keep], ids[begin + text[keep]], -offsets[text[keep]]
                low, high = start[keep] - shift, end[keep] - shift
                begin += len(run)
                if len(hot_keys) and (hot := np.isin((key % np.uint64(files)) << np.uint64(32) | (key >> np.uint64(25)) & np.uint64(0xFFFFFFFF), hot_keys)).any():
                    size = (high - low + 1)[hot]
                    one = np.repeat(low[hot] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    own_key = mixed(np.repeat(key[hot], size) + range_hashes(data, one, one + least))
                    doc, shift = np.concatenate([doc[~hot], np.repeat(doc[hot], size)]), np.concatenate([shift[~hot], np.repeat(shift[hot], size)])
                    key, low, high = np.concatenate([key[~hot], own_key]), np.concatenate([low[~hot], one]), np.concatenate([high[~hot], one])
                for at in _split(key % np.uint64(parts)):
                    blob = b"".join([data[a : b + least].tobytes() for a, b in zip(low[at].tolist(), high[at].tolist(), strict=True)])
                    rows.append((int(key[at[0]] % np.uint64(parts)), key[at].tobytes(), doc[at].tobytes(), (low + shift)[at].astype(np.int32).tobytes(), (high + shift)[at].astype(np.int32).tobytes(), blob))
        if not rows:
            return pa.schema(kinds).empty_table()
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), zip(*rows, strict=True), strict=True)})

    out = "file int, keys binary, docs binary, starts binary, ends binary, bytes binary"
    return docs.groupBy("group").cogroup(wanted.groupBy("group")).applyInArrow(in_group, out)


def suffix_order(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each suffix's place when sorted by its first ``depth`` bytes at least, and the eight bytes at each place as one symbol."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    symbol = np.zeros(n, np.uint64)
    for i in range(8):
        symbol = (symbol << np.uint64(8)) | padded[i : n + i].astype(np.uint64)
    order = np.argsort(symbol)
    new = np.r_[False, symbol[order][1:] != symbol[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    reach = 8
    while reach < depth and rank.max(initial=0) < n - 1:
        ahead = np.zeros(n, np.int64)
        ahead[: max(n - reach, 0)] = rank[reach:] + 1
        both = rank * (n + 1) + ahead
        order = np.argsort(both)
        new = np.r_[False, both[order][1:] != both[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        reach *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return place, symbol


def equal_strings(data: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (into ``starts``) and interval of those whose strings of ``least`` bytes have an equal one."""
    place, symbol = suffix_order(data, least)
    head = (least - 1) % 8 + 1
    at = starts + least - head
    who = np.argsort(place[at])
    at = at[who]
    mark = symbol[at] >> np.uint64(64 - 8 * head)
    interval = np.cumsum(np.r_[False, mark[1:] != mark[:-1]]) if len(at) else np.zeros(0, np.int64)
    done = head
    while True:
        # Intervals of one suffix are done with.
        size = np.bincount(interval, minlength=1)
        keep = size[interval] > 1
        at, who, interval = at[keep], who[keep], interval[keep]
        if done == least or not len(at):
            return who, interval
        # One step backward: the symbol before each suffix, and the suffix that begins with it.
        at = at - 8
        before = symbol[at]
        order = np.argsort(place[at])
        at, who, interval, before = at[order], who[order], interval[order], before[order]
        interval = np.cumsum(np.r_[False, (interval[1:] != interval[:-1]) | (before[1:] != before[:-1])])
        done += 8


def key_slices(key: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of the runs, by key, in slices of about ``most`` bytes; the runs of a key stay together."""
    order = np.argsort(key, kind="stable")
    edge = np.r_[0, np.cumsum(size[order])]
    bounds = np.r_[np.flatnonzero(np.diff(key[order])) + 1, len(order)]
    out, begin = [], 0
    while begin < len(order):
        fits = int(np.searchsorted(edge, edge[begin] + most, side="right")) - 1
        at = max(int(np.searchsorted(bounds, fits, side="right")) - 1, int(np.searchsorted(bounds, begin, side="right")))
        out.append(order[begin : bounds[at]])
        begin = int(bounds[at])
    return out


def marked_strings(filed: DataFrame, least: int) -> DataFrame:
    """First and last start of the strings that start earlier elsewhere, by document."""

    def in_file(rows: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(rows["keys"]), np.uint64)
        docs, starts, ends = _long(rows["docs"]), _int(rows["starts"]).astype(np.int64), _int(rows["ends"]).astype(np.int64)
        texts = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
        sizes = ends - starts + least
        lows = np.cumsum(sizes) - sizes
        out = [(docs[:0], starts[:0], ends[:0])]
        # Equal strings have one key, so each slice of keys is a work of its own.
        for part in key_slices(keys, sizes, SLICE):
            key, doc, start, end, size = keys[part], docs[part], starts[part], ends[part], sizes[part]
            low = np.cumsum(size) - size
            text = texts[np.repeat(lows[part] - low, size) + np.arange(size.sum())]
            # Cut runs of hot keys may be equal again.
            twins, single = _twins(key, range_hashes(text, low, low + size), doc, start)
            out.append((doc[twins], start[twins], end[twins]))
            n = (end - start + 1)[single]
            of = np.repeat(single, n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, interval = equal_strings(text, low[of] + inner, least)
            own_doc, own_start = doc[of[who]], start[of[who]] + inner[who]
            order = np.lexsort((own_start, own_doc, interval))
            again = order[np.r_[False, interval[order][1:] == interval[order][:-1]]] if len(order) else order
            again = again[np.lexsort((own_start[again], own_doc[again]))]
            own_doc, own_start = own_doc[again], own_start[again]
            if len(again):
                new = np.r_[True, (own_doc[1:] != own_doc[:-1]) | (own_start[1:] > own_start[:-1] + 1)]
                last = np.r_[np.flatnonzero(new)[1:] - 1, len(again) - 1]
                out.append((own_doc[new], own_start[new], own_start[last]))
        doc, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"doc_id": doc, "first": start.astype(np.int32), "last": end.astype(np.int32)})

    return filed.groupBy("file").applyInPandas(in_file, "doc_id long, first int, last int")


def without(data: bytes, starts: np.ndarray, ends: np.ndarray, least: int) -> tuple[bytes, int, int]:
    """What is left of ``data`` without the strings from ``starts`` to ``ends``; bytes and runs removed."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.minimum(starts, len(data)), 1)
    np.add.at(edge, np.minimum(ends + least, len(data)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def substring_dedup(df: DataFrame, least: int = LEAST, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256, and what is kept if ``with_text``."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    known = docs.filter("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files, groups = total // FILE_BYTES + 1, total // GROUP_BYTES + 1
    hot = max(HOT, int(total * 2 / (least - gram) * HOT_SHARE))
    runs = stored(sorted_runs(filed_keys(known, files, least, gram), hot))
    hot_keys = np.array([r[0] for r in runs.filter("doc_id IS NULL").select("hot_key").collect()], np.int64).astype(np.uint64)

    def in_groups(rows: DataFrame) -> DataFrame:
        return rows.withColumn("group", F.pmod("doc_id", F.lit(groups)).cast("int"))

    # Rows with a null id meet no list, so any group will do.
    own_group = F.coalesce(F.pmod("doc_id", F.lit(groups)), F.pmod(F.xxhash64("text"), F.lit(groups))).cast("int")
    grouped = docs.withColumn("group", own_group)
    wanted = in_groups(runs.filter("wanted").select("doc_id", "first"))
    # Runs overlap, so what is wanted may have several times the texts' bytes.
    size = runs.filter("wanted").agg(F.sum(F.col("last").cast("long") - F.col("first") + least)).first()[0] or 0
    filed = filed_runs(in_groups(known), wanted, hot_keys, files, max(files, size // FILE_BYTES + 1), least, gram)
    more = stored(marked_strings(filed, least))
    marked = in_groups(runs.filter("doc_id IS NOT NULL AND NOT wanted").select("doc_id", "first", "last").unionByName(more))

    def in_group(texts: pa.Table, lists: pa.Table) -> pa.Table:
        doc, start, end = (lists[c].combine_chunks().to_numpy().astype(np.int64) for c in ("doc_id", "first", "last"))
        order = np.argsort(doc, kind="stable")
        doc, start, end = doc[order], start[order], end[order]
        out = []
        for i, text in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist(), strict=True):
            a, b = (0, 0) if i is None else np.searchsorted(doc, [i, i + 1])
            kept, removed, spans = without(text, start[a:b], end[a:b], least) if b > a else (text, 0, 0)
            out.append((i, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds.items(), columns, strict=True)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    result = grouped.groupBy("group").cogroup(marked.groupBy("group")).applyInArrow(in_group, schema)
    return result if with_text else result.drop("kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
