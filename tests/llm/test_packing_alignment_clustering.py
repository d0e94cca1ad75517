import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from candleforge.llm import alignment, clustering, packing, vocabularies

ALPHABET = ["a", "b", "é", "1", "'s", " ", "  ", "\n", "日", "\U0001f600", "<|endoftext|>", "...", "Z", "the", "ing", "\x1c", "\x85", "　", "▁", "<s>", "<0x0A>", "\t", "'"]


def samples(n: int, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    name = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(name)
    plain.encode_special_tokens = True
    return Tokenizer.from_file(name), plain, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_vocabularies_equal_libraries(libraries):
    default, plain, _ = libraries
    own = vocabularies.byte_vocabulary("byte_bpe_50k.json")
    assert own.fast is not None
    for text in samples(3000):
        assert own.encode(text) == default.encode(text, add_special_tokens=False).ids
        assert own.encode_plain(text) == plain.encode(text, add_special_tokens=False).ids


def _fits(sizes: list[int], capacity: int, bins: int) -> bool:
    """Whether the sizes fit into so many bins, by trying all ways."""
    room = [capacity] * bins

    def put(i: int) -> bool:
        if i == len(sizes):
            return True
        for b in range(bins):
            if room[b] >= sizes[i] and room[b] not in room[:b]:
                room[b] -= sizes[i]
                if put(i + 1):
                    return True
                room[b] += sizes[i]
        return False

    return put(0)


def test_fullest_combination_equals_all_subsets():
    rng = random.Random(4)
    for _ in range(150):
        sizes, room = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 60)
        best = max(t for m in range(1 << len(sizes)) if (t := sum(s for i, s in enumerate(sizes) if m >> i & 1)) <= room)
        found = packing.fullest(dict(Counter(sizes)), room)
        assert sum(x * n for x, n in found) == best
        assert all(n <= Counter(sizes)[x] for x, n in found)


def test_combinations_use_all_pieces_in_few_bins():
    rng = random.Random(5)
    worse = 0
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 40) for _ in range(rng.randrange(1, 12))), reverse=True)
        plan = packing.combinations(dict(Counter(sizes)), 40)
        assert sum((Counter({x: n * times for x, n in uses}) for uses, times in plan), Counter()) == Counter(sizes)
        assert all(sum(x * n for x, n in uses) <= 40 for uses, _ in plan)
        bins = sum(times for _, times in plan)
        worse += bins > 1 and _fits(sizes, 40, bins - 1)
    assert worse <= 3
    many = Counter(min(2048, max(1, int(rng.lognormvariate(6.2, 1.2)))) for _ in range(20_000))
    used = sum(times for _, times in packing.combinations(dict(many)))
    assert used <= 1.002 * -(-sum(x * n for x, n in many.items()) // 2048) + 1


def check_packing(rows, got, library, capacity):
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, text, *_ in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces.pop(doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // capacity)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert not pieces
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_packing(spark, docs, rows, libraries, empty):
    for capacity in (2048, 64):
        got = packing.pack_documents(docs, capacity=capacity).collect()
        bins = check_packing(rows, got, libraries[0], capacity)
        assert bins <= 1.02 * -(-sum(r.length for r in got) // capacity) + 1
    assert packing.pack_documents(empty).count() == 0


def test_packing_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b")] * 40 + [(None, "a b"), (1, "<|endoftext|> x"), (1, None)], "doc_id long, text string").repartition(5)
    got = packing.pack_documents(df, capacity=8).collect()
    assert len(got) == 43
    assert sorted({r.offset for r in got}) == [0, 3, 6] or len({(r.sequence_id, r.offset) for r in got}) == 43
    assert len({(r.sequence_id, r.offset) for r in got}) == 43


def aligned(texts, plain, pieces):
    """Numbers, groups and links by definition, a row a text."""
    a_bytes, b_bytes = vocabularies.byte_vocabulary("byte_bpe_50k.json").bytes, vocabularies.piece_vocabulary("piece_bpe_32k.model").bytes
    rows, counts = [], Counter()
    for text in texts:
        a = plain.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pieces.encode(text or "")
        if not text or any(b"".join(of[i] for i in ids) != f" {text}".encode() for ids, of in ((a, a_bytes), (b, b_bytes))):
            rows.append((0, 0, 0, 0, "", []))
            continue
        ends = [dict(zip(np.cumsum([len(of[i]) for i in ids]).tolist(), ids, strict=True)) for ids, of in ((a, a_bytes), (b, b_bytes))]
        common, begin, groups = sorted(set(ends[0]) & set(ends[1])), 0, []
        for end in common:
            groups.append("|".join(",".join(str(i) for e, i in side.items() if begin < e <= end) for side in ends))
            begin = end
        links = [(ends[0][e], ends[1][e]) for e in common]
        counts.update(links)
        rows.append((len(a), len(b), len(common), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest(), links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*r[:5], sum(counts[x] == best[x[1]] for x in r[5]), sum(counts[x] for x in r[5])) for r in rows]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 0])
def test_alignment(spark, docs, rows, libraries, empty, monkeypatch, broadcast_pairs):
    monkeypatch.setattr(alignment, "SLICE", 2000)
    more = [(1000 + i, t) for i, t in enumerate(samples(300))]
    df = docs.select("doc_id", "text", "key", "a", "b", "n").union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "'x'", "'x'", "'x'", "'x'"))
    got = {r.doc_id: r for r in alignment.align_tokenizers(df, broadcast_pairs=broadcast_pairs).collect()}
    texts = {r[0]: r[1] for r in [*rows, *more]}
    for doc_id, want in zip(texts, aligned(texts.values(), *libraries[1:]), strict=True):
        assert tuple(got[doc_id][c] for c in COLUMNS) == want, texts[doc_id]
    twice = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], "doc_id long, text string")
    out = alignment.align_tokenizers(twice, broadcast_pairs=broadcast_pairs).collect()
    assert sorted((r.doc_id is None, r.n_links, r.count_sum) for r in out) == sorted([(False, 0, 0), (False, 2, 6), (False, 2, 6), (True, 2, 6)])
    assert alignment.align_tokenizers(empty, broadcast_pairs=broadcast_pairs).count() == 0


def clusters_of(vectors: dict[int, list[float]], k: int, rounds: int):
    ints = {i: np.floor(np.array(v, np.float64) * 256).astype(np.int64) for i, v in vectors.items()}
    order = sorted(ints, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centroids = [ints[i] for i in order[:k]]
    nearest = lambda v: min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for v in ints.values():
            members[nearest(v)[1]].append(v)
        centroids = [np.array([sum(map(int, c)) // len(members[j]) for c in zip(*members[j], strict=True)]) if members[j] else c for j, c in enumerate(centroids)]
    found = {i: nearest(v) for i, v in ints.items()}
    own = Counter()
    for d, j in found.values():
        own[j] += d
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return {i: (j, d, own[j], sum(own.values()), digest[j]) for i, (d, j) in found.items()}


@pytest.mark.parametrize(("widths", "broadcast_bytes"), [((1,), 1 << 26), ((2,), 1 << 26), ((1, 2), 0)])
def test_clustering(spark, widths, broadcast_bytes):
    rng = np.random.default_rng(6)
    vectors = {i: np.float32(rng.normal(i % 5, 0.4, 6)).tolist() for i in range(180)}
    for i in range(180, 230):
        vectors[i] = vectors[0]
    vectors[230], vectors[231] = [500_000.0, -500_000.0] + [0.0] * 4, [0.0] * 6
    bad = [(300, [1.0] * 5), (301, None), (302, [1.0, None] + [0.0] * 4), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, []), (306, [1e9] * 6)]
    df = spark.createDataFrame([*vectors.items(), *bad], "vec_id long, embedding array<float>").selectExpr("*", "'x' AS cluster", "1 AS v", "2 AS block").repartition(4)
    got = clustering.cluster_vectors(df, dims=6, clusters=9, widths=widths, broadcast_bytes=broadcast_bytes).collect()
    assert {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got} == clusters_of(vectors, 9, 5)


def test_clustering_few_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [5.0, 5.0]), (None, [5.0, 5.1])], "vec_id long, embedding array<double>")
    got = clustering.cluster_vectors(df, dims=2, clusters=40).collect()
    assert len(got) == 4
    assert {r.cluster for r in got if r.vec_id == 1} == {next(r.cluster for r in got if r.vec_id == 1)}
    assert clustering.cluster_vectors(df.filter(F.col("vec_id").isNull()), dims=2).count() == 0
    assert clustering.cluster_vectors(df.limit(0), dims=2).count() == 0
