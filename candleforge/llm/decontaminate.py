"""Benchmark decontamination by latent semantic retrieval.

Words (runs of letters, digits and non-ASCII characters, A-Z in lower case) are hashed to terms. Document frequencies
count every document of the corpus. Benchmark items are cut into overlapping passages, whose TF-IDF matrix A gets a
distributed randomised SVD: a random block of vectors is multiplied by A'A, partial sums coming from the tasks and
orthonormalised blocks of fixed size going back, and a small eigenproblem gives the latent basis. Each document is cut
into overlapping windows of words; a window is projected to the latent space and searched for passages by cosine.
Of a large benchmark the basis keeps only a part of each passage. Passages of which it keeps less than ``KEPT`` are
searched by their full TF-IDF cosine as well, through postings of their heavy terms, whatever the number of items.
Windows of which too little weight lies on benchmark terms are skipped first, as no passage can be that near to them.
A candidate item is confirmed around its window: the longest common subsequence must hold most of the item's words
within a stretch not much longer than the item. If an item marks its answer ("Answer: ..."), a stretch with less than
``VERBATIM`` of the item's words must have most of the answer's words too; other items have no answer to look for.

Benchmarks go in blocks of at most ``BLOCK`` items, so what a task holds is bounded; every document meets every block.

Defined results: null and empty texts leak nothing; items without words, or null, match nothing; items and documents
that occur twice give a row for each item and document id once per row; an empty corpus or benchmark gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import map_arrow, stored, table, text_or_empty
from candleforge.llm.shingles import bytes_of, lower_ascii, range_hashes, slices

TERM_BITS = 16
RANK, SPARE, ITERATIONS, SEED = 256, 16, 2, 20240501
WINDOW, STRIDE = 32, 16
#: Least cosine of a candidate, least share of an item's words in the common subsequence and of its answer's words.
LEAST_COSINE, LEAST_COMMON, LEAST_ANSWER = 0.4, 0.7, 0.5
#: Passages that keep less than this of their length in the latent space are searched in full, and the length of their
#: lightest terms that get no postings.
KEPT, TAIL = 0.9, 0.2
#: Window and passage scores held at once.
SCORES = 4_000_000
#: A stretch that is compared has this many times an item's words.
STRETCH = 1.5
#: From this share of an item's words on, its answer isn't asked for.
VERBATIM = 0.85
BLOCK = 20_000
#: What marks an answer, at the start of a line or sentence.
ANSWER = re.compile(r"(?:^|\n|(?<=[.!?])\s)\s*(?:answer|a)\s*:", re.IGNORECASE)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts in a row, and the words before each text."""
    data, offsets = bytes_of(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = lower_ascii(data)
    word = _IS_WORD[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    inside = word[starts]
    starts, ends = starts[inside], ends[inside]
    return range_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each term, and documents; a vector of fixed size whatever the corpus."""

    def batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = np.zeros(1 << TERM_BITS, np.int64)
        for run in slices(batch.column("text")):
            hashes, first = word_hashes(run)
            of = np.repeat(np.arange(len(run)), np.diff(first))
            counts += np.bincount(np.unique((of << TERM_BITS) | terms_of(hashes)) & ((1 << TERM_BITS) - 1), minlength=1 << TERM_BITS)
        at = np.flatnonzero(counts)
        # A last row, of no term, counts the documents.
        return pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*counts[at].tolist(), batch.num_rows], pa.int64())], ["term", "n"])

    counts = map_arrow(docs.select("text"), batch_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    out = np.zeros(1 << TERM_BITS, np.int64)
    terms = found[found["term"] >= 0]
    out[terms["term"].to_numpy()] = terms["n"].to_numpy()
    return out, int(found.loc[found["term"] < 0, "n"].sum())


def weights(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Smoothed inverse document frequencies."""
    return np.log((1.0 + n) / (1.0 + frequencies)).astype(np.float32) + np.float32(0.01)


def passage_starts(n: int) -> list[int]:
    """Starts of an item's passages of WINDOW words; the last ends with the item."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def passages(items: DataFrame) -> DataFrame:
    """``terms`` of each passage of the benchmark items."""

    def batch_passages(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, first = word_hashes(batch.column("text"))
        terms = terms_of(hashes)
        out = []
        for i in range(batch.num_rows):
            own = terms[first[i] : first[i + 1]]
            out += [own[s : s + WINDOW].tolist() for s in passage_starts(len(own))] if len(own) else []
        return pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], ["terms"])

    return map_arrow(items.select("text"), batch_passages, "terms array<int>")


def rows_of(terms: list[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse TF-IDF rows of unit length: row, term and value of each entry."""
    of = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    keys, tf = np.unique((of << TERM_BITS) | np.concatenate(terms).astype(np.int64), return_counts=True)
    row, term = keys >> TERM_BITS, keys & ((1 << TERM_BITS) - 1)
    value = tf * idf[term]
    norm = np.sqrt(np.bincount(row, value**2, len(terms)))
    return row, term, value / norm[row]


def times_gram(rows: DataFrame, block: tuple[np.ndarray, np.ndarray] | None, rank: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A'A times ``block`` (random if None), where A has the TF-IDF rows of ``rows``: the terms that have a row, and these.

    Only terms of the benchmark have rows, in the block too, so that the driver holds no more than these.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((block, idf))

    def partial(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        own, own_idf = shared.value
        row, term, value = rows_of([np.asarray(t, np.int64) for t in batch.column("terms").to_pylist()], own_idf)
        used, at = np.unique(term, return_inverse=True)
        x = own[1][np.searchsorted(own[0], used)] if own else np.random.default_rng(SEED).standard_normal((1 << TERM_BITS, rank), np.float32)[used]
        dense = np.zeros((batch.num_rows, rank), np.float32)
        np.add.at(dense, row, x[at] * value[:, None].astype(np.float32))
        out = np.zeros((len(used), rank), np.float32)
        np.add.at(out, at, dense[row] * value[:, None].astype(np.float32))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([v.tobytes() for v in out], pa.binary())], ["term", "part"])

    def total(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack([np.frombuffer(p, np.float32) for p in parts["part"]])
        return pd.DataFrame({"term": [key[0]], "part": [vectors.sum(axis=0, dtype=np.float64).astype(np.float32).tobytes()]})

    parts = map_arrow(rows, partial, "term int, part binary").groupBy("term").applyInPandas(total, "term int, part binary").toArrow()
    shared.destroy()
    terms = parts["term"].to_numpy()
    out = np.frombuffer(b"".join(x.as_py() for x in parts["part"]), np.float32).reshape(len(terms), rank)
    order = np.argsort(terms)
    return terms[order].astype(np.int64), out[order]


def latent_basis(rows: DataFrame, idf: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Terms that the basis touches and their rows of it: the leading right singular vectors of the TF-IDF matrix."""
    wide = rank + SPARE
    used, block = times_gram(rows, None, wide, idf)
    for _ in range(ITERATIONS):
        q = np.zeros_like(block)
        ortho = np.linalg.qr(block)[0]
        q[:, : ortho.shape[1]] = ortho
        block = times_gram(rows, (used, q), wide, idf)[1]
    small = q.T.astype(np.float64) @ block
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    keep = np.argsort(values)[::-1][:rank]
    keep = keep[values[keep] > 1e-6 * max(values.max(), 1e-30)]
    return used, (q @ vectors[:, keep]).astype(np.float32)


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    best = np.zeros(len(b) + 1, np.int64)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(b == x, best[:-1] + 1, 0)))
    return int(best[-1])


class Matcher:
    """Search of one block of benchmark items."""

    def __init__(self, items: list[tuple], idf: np.ndarray, used: np.ndarray, basis: np.ndarray):
        self.idf, self.basis = idf, np.vstack([basis, np.zeros((1, basis.shape[1]), np.float32)])
        self.slot = np.full(1 << TERM_BITS, len(used), np.int32)
        self.slot[used] = np.arange(len(used))
        self.items, of, terms = [], [], []
        for item_id, text in items:
            words, _ = word_hashes(pa.array([text]))
            marked = ANSWER.split(text)
            answer, _ = word_hashes(pa.array([marked[-1] if len(marked) > 1 else ""]))
            if len(words):
                of += [len(self.items)] * len(passage_starts(len(words)))
                terms += [terms_of(words)[s : s + WINDOW] for s in passage_starts(len(words))]
                self.items.append((item_id, words, answer if len(answer) else words))
        self.of = np.array(of, np.int64)
        self.passages = np.zeros((0, basis.shape[1]), np.float32)
        if terms:
            row, term, value = rows_of(terms, idf)
            projected = self._projected(row, term, value, len(terms))
            norm = np.linalg.norm(projected, axis=1, keepdims=True)
            self.passages = projected / np.maximum(norm, 1e-9)
            self._index(np.flatnonzero(norm[:, 0] < KEPT), row, term, value)

    def _index(self, left: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        """Postings of the heavy terms, and all terms, of the passages ``left`` that the basis keeps too little of."""
        self.left = left
        own = np.isin(row, left)
        row, term, value = np.searchsorted(left, row[own]), term[own], value[own]
        self.left_keys, self.left_values = (row << TERM_BITS) | term, value
        self.left_first = np.searchsorted(row, np.arange(len(left) + 1))
        order = np.lexsort((value, row))
        square = np.cumsum(value[order] ** 2)
        before = np.r_[0.0, square][self.left_first[:-1]]
        light = np.zeros(len(row), bool)
        light[order] = square - before[row[order]] <= TAIL**2
        self.tail = np.sqrt(np.bincount(row[light], value[light] ** 2, len(left)))
        by_term = np.flatnonzero(~light)[np.argsort(term[~light], kind="stable")]
        self.post_row, self.post_value = row[by_term], value[by_term]
        self.post_first = np.searchsorted(term[by_term], np.arange((1 << TERM_BITS) + 1))

    def _full_search(self, terms: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Window, passage and cosine of the passages left that are as near as ``least`` by all their terms."""
        row, term, value = rows_of(terms, self.idf)
        lengths = self.post_first[term + 1] - self.post_first[term]
        at = np.repeat(self.post_first[term] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        score = np.bincount(np.repeat(row, lengths) * len(self.left) + self.post_row[at], np.repeat(value, lengths) * self.post_value[at], len(terms) * len(self.left))
        # The light terms add no more than their length.
        score = score.reshape(len(terms), -1)
        windows, near = np.nonzero((score > 0) & (score >= least - self.tail - 1e-9))
        many = self.left_first[near + 1] - self.left_first[near]
        pair = np.repeat(np.arange(len(near)), many)
        at = np.repeat(self.left_first[near] - np.cumsum(many) + many, many) + np.arange(many.sum())
        wanted = (windows[pair] << TERM_BITS) | (self.left_keys[at] & ((1 << TERM_BITS) - 1))
        keys = (row << TERM_BITS) | term
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        cosine = np.bincount(pair, np.where(keys[place] == wanted, value[place], 0.0) * self.left_values[at], len(near))
        good = cosine >= least
        return windows[good], self.left[near[good]], cosine[good]

    def _projected(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, self.basis.shape[1]), np.float32)
        for a in range(0, len(row), 100_000):
            b = min(a + 100_000, len(row))
            starts = np.flatnonzero(np.r_[True, row[a + 1 : b] != row[a : b - 1]])
            sums = np.add.reduceat(self.basis[self.slot[term[a:b]]] * value[a:b, None].astype(np.float32), starts, axis=0)
            out[row[a:b][starts]] += sums
        return out

    def windows(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end word of the windows of each text."""
        n = np.diff(first)
        count = np.where(n == 0, 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1)
        text = np.repeat(np.arange(len(n)), count)
        start = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        return text, start, np.minimum(start + WINDOW, first[text + 1])

    def candidates(self, hashes: np.ndarray, first: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """Text, item, start and end word, and cosine.

        A window is two blocks of STRIDE words; with linear term frequencies its projection is the sum of theirs. Two
        bounds spare work without losing a passage: no cosine exceeds the share of weight on benchmark terms, nor the
        length of the projection; and the length of the window's vector is at least that with each word counted apart.
        """
        text, start, end = self.windows(hashes, first)
        if not len(text) or not len(self.passages):
            return []
        terms = terms_of(hashes)
        slot = self.slot[terms]
        known = slot < len(self.basis) - 1
        square = self.idf[terms].astype(np.float64) ** 2
        on, every = np.r_[0.0, np.cumsum(square * known)], np.r_[0.0, np.cumsum(square)]
        length = np.sqrt(np.maximum(every[end] - every[start], 1e-12))
        # A repeated term weighs as its square in the vectors and once for each time here, so the bound leaves room.
        keep = np.flatnonzero(on[end] - on[start] >= 0.5 * least**2 * length**2)
        found: dict[tuple[int, int, int], tuple[int, float]] = {}

        def add(windows: np.ndarray, passages: np.ndarray, cosine: np.ndarray) -> None:
            for w, p, c in zip(windows.tolist(), passages.tolist(), cosine.tolist(), strict=True):
                key = (int(text[w]), int(self.of[p]), int(start[w]))
                if c >= least and (key not in found or found[key][1] < c):
                    found[key] = (int(end[w]), c)

        step = max(1, min(4096, SCORES // max(1, len(self.left))))
        for a in range(0, len(keep) if len(self.left) else 0, step):
            part = keep[a : a + step]
            windows, passages, cosine = self._full_search([terms[start[w] : end[w]] for w in part], least)
            add(part[windows], passages, cosine)
        for a in range(0, len(keep), 4096):
            part = keep[a : a + 4096]
            middle = np.minimum(start[part] + STRIDE, end[part])
            bounds = np.unique(np.concatenate([start[part], middle, end[part]]))
            sums = self._block_sums(bounds, slot, terms)
            at = np.searchsorted(bounds, [start[part], middle])
            vectors = sums[at[0]] + np.where((middle < end[part])[:, None], sums[np.minimum(at[1], len(sums) - 1)], 0)
            near = np.flatnonzero(np.linalg.norm(vectors, axis=1) >= least * length[part])
            if not len(near):
                continue
            part = part[near]
            rows, passages = np.nonzero(vectors[near] @ self.passages.T >= least * length[part][:, None])
            if not len(rows):
                continue
            hit, rows = np.unique(rows, return_inverse=True)
            row, term, value = rows_of([terms[start[w] : end[w]] for w in part[hit]], self.idf)
            exact = self._projected(row, term, value, len(hit))
            cosine = np.einsum("ij,ij->i", exact[rows], self.passages[passages])
            add(part[hit][rows], passages, cosine)
        return [(t, i, s, e, c) for (t, i, s), (e, c) in found.items()]

    def _block_sums(self, bounds: np.ndarray, slot: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Projection of the words between each two neighbouring bounds; stretches between windows, longer than a block, are left out."""
        size = np.diff(bounds)
        out = np.zeros((max(len(size), 1), self.basis.shape[1]), np.float32)
        place = np.arange(STRIDE)
        # Small runs of blocks, so that the gathered rows stay in the cache; missing words take the basis' row of zeros.
        for a in range(0, len(size), 128):
            own = size[a : a + 128, None]
            inside = (place < own) & (own <= STRIDE)
            at = np.where(inside, bounds[a : a + len(own), None] + place, 0)
            rows = self.basis[np.where(inside, slot[at], len(self.basis) - 1)]
            out[a : a + len(own)] = np.matmul(self.idf[terms[at]][:, None, :], rows)[:, 0]
        return out

    def confirm(self, hashes: np.ndarray, low: int, high: int, item: int, start: int, end: int) -> tuple[float, float]:
        """Largest shares of the item's and of its answer's words that one stretch near the window has in order; those of a stretch that confirms the item go first."""
        _, words, answer = self.items[item]
        n, m = len(words), max(int(STRETCH * len(words)), len(words) + 4)
        a, b = max(low, start - n), min(high, end + n)
        best = (False, 0.0, 0.0)
        for s in range(a, max(a, b - m) + 1, max(1, n // 4)):
            stretch = hashes[s : min(s + m, b)]
            if np.isin(words, stretch).mean() > max(best[1] if best[0] else 0.0, LEAST_COMMON - 1e-9):
                common, part = longest_common(words, stretch) / n, longest_common(answer, stretch) / len(answer)
                best = max(best, (is_leak(common, part), common, part))
        return best[1:]


def is_leak(common: float, answer: float) -> bool:
    return common >= VERBATIM or (common >= LEAST_COMMON and answer >= LEAST_ANSWER)


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    rank: int = RANK, least_cosine: float = LEAST_COSINE, block: int = BLOCK,
) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, cosine, common and answer."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).filter(F.length(F.trim("text")) > 0)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, cosine double, common double, answer double"
    rows = stored(passages(items))
    if rows.isEmpty():
        return spark.createDataFrame([], schema)
    frequencies, n = document_frequencies(docs)
    idf = weights(frequencies, n)
    used, basis = latent_basis(rows, idf, rank)
    blocks = max(1, -(-items.count() // block))
    parts = []
    for k in range(blocks):
        # By hash, each block is a share of the items of about the same size.
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(([tuple(r) for r in own.collect()], idf, used, basis))
        parts.append(_search(docs, shared, schema, least_cosine))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_matchers: dict[int, Matcher] = {}


def _matcher(shared) -> Matcher:
    """This worker's matcher of a broadcast block; the last one is kept."""
    if shared.value[0] is not _matchers.get("items"):
        _matchers.clear()
        _matchers.update(items=shared.value[0], matcher=Matcher(*shared.value))
    return _matchers["matcher"]


def _search(docs: DataFrame, shared, schema: str, least_cosine: float) -> DataFrame:
    def batch_leaks(batch: pa.RecordBatch) -> pa.RecordBatch:
        matcher = _matcher(shared)
        at, items, scores = [], [], []
        begin = 0
        for run in slices(batch.column("text")):
            hashes, first = word_hashes(run)
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for text, item, start, end, cosine in matcher.candidates(hashes, first, least_cosine):
                common, answer = matcher.confirm(hashes, first[text], first[text + 1], item, start, end)
                if is_leak(common, answer):
                    best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (common, answer, cosine))
            for (text, item), (common, answer, cosine) in sorted(best.items()):
                at.append(begin + text)
                items.append(matcher.items[item][0])
                scores.append((cosine, common, answer))
            begin += len(run)
        columns = [pa.array([s[i] for s in scores], pa.float64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items), *columns], ["doc_id", "item_id", "cosine", "common", "answer"])

    return map_arrow(docs, batch_leaks, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id stay."""
    found = stored(leaks(docs, benchmark).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", *[F.round(c, 6).alias(c) for c in ("cosine", "common", "answer")])
