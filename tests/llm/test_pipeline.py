import random

import numpy as np
import pytest

from candleforge.llm import decontaminate
from tests.llm.conftest import prose


def items(spark):
    rows = [(i, " ".join(f"q{i}w{k} the" for k in range(12)) + f". Answer{i} is blue{i}.") for i in range(20)] + [(90, None), (91, "  "), (92, "\n\t"), (93, "?!")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def leaky(spark):
    rows, bench = items(spark)
    docs = [(i, prose(100 + i, 150)) for i in range(40)]
    docs[3] = (3, prose(3, 80) + " " + rows[5][1] + " " + prose(4, 80))
    docs[4] = (4, rows[6][1])
    words = rows[7][1].split()
    del words[4], words[9]
    words.insert(6, "really")
    docs[5] = (5, prose(5, 33) + "\n" + " ".join(words).upper() + "!! " + prose(6, 50))
    docs += [(50, None), (51, ""), (52, rows[5][1].split()[0])]
    return rows, bench, docs, spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")


def test_leaks_are_found(spark, leaky):
    _, bench, _, docs = leaky
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(3, 5), (4, 6), (5, 7)}
    by_block = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block=7).collect()}
    assert by_block == got
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d[0] for d in leaky[2]} - {3, 4, 5}
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_latent_search_recall(spark, leaky):
    """Passages found by latent cosine against those by the full TF-IDF cosine."""
    rows, bench, docs_rows, docs = leaky
    import pyarrow as pa

    frequencies, n = decontaminate.document_frequencies(docs.select("doc_id", decontaminate.text_or_empty("text").alias("text")))
    idf = decontaminate.weights(frequencies, n)
    used, basis = decontaminate.latent_basis(decontaminate.passages(bench.filter("text IS NOT NULL")), idf)
    own = [r for r in rows if r[1] and r[1].strip()]
    matcher = decontaminate.Matcher(own, idf, used, basis)
    hashes, first = decontaminate.word_hashes(pa.array([t or "" for _, t in docs_rows]))
    found = {(t, i) for t, i, *_ in matcher.candidates(hashes, first, decontaminate.LEAST_COSINE)}
    terms = decontaminate.terms_of(hashes)

    def dense(x):
        v = np.zeros(1 << decontaminate.TERM_BITS)
        np.add.at(v, x, 1.0)
        v *= idf
        return v / max(np.linalg.norm(v), 1e-9)

    wanted = set()
    text, start, end = matcher.windows(hashes, first)
    passages = [(i, dense(decontaminate.terms_of(w)[s : s + 32])) for i, (_, w, _) in enumerate(matcher.items) for s in decontaminate.passage_starts(len(w))]
    for t, s, e in zip(text, start, end, strict=True):
        v = dense(terms[s:e])
        wanted |= {(int(t), i) for i, p in passages if v @ p >= decontaminate.LEAST_COSINE}
    assert wanted and len(found & wanted) >= 0.9 * len(wanted)


def test_recall_of_a_large_benchmark(spark):
    """Verbatim copies of some of thousands of items of a shared vocabulary, far more than the basis has directions."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(6000)]
    share = 1.0 / np.arange(20, 6020)
    share /= share.sum()

    def text(n):
        return " ".join(vocabulary[k] for k in rng.choice(6000, n, p=share))

    own = [(i, text(60)) for i in range(2000)]
    docs = [text(50) + " " + own[i][1] + " " + text(50) for i in range(0, 2000, 20)]
    frame = spark.createDataFrame([(t,) for t in docs] + [(text(200),) for _ in range(300)], "text string")
    frequencies, n = decontaminate.document_frequencies(frame)
    idf = decontaminate.weights(frequencies, n)
    used, basis = decontaminate.latent_basis(decontaminate.passages(spark.createDataFrame(own, "item_id long, text string")).cache(), idf)
    matcher = decontaminate.Matcher(own, idf, used, basis)
    hashes, first = decontaminate.word_hashes(pa.array(docs))
    found = {(t, i) for t, i, *_ in matcher.candidates(hashes, first, decontaminate.LEAST_COSINE)}
    assert {(k, 20 * k) for k in range(100)} <= found


def test_truncated_items_leak_and_marked_answers_count(spark):
    head = " ".join(f"p{k} the" for k in range(20)) + ". "
    ask = " ".join(f"s{k} of" for k in range(20)) + "? Answer: "
    reply = "red green blue black white grey pink gold"
    bench = spark.createDataFrame([(1, head + "Last words of this one."), (2, ask + reply)], "item_id long, text string")
    tail = prose(7, 60)
    inner = ask.split("?")[0].split()
    del inner[3:8]
    # Without its last sentence; the question without the answer; that reworded; reworded with the answer.
    docs = [(1, head + tail), (2, ask.split("?")[0] + ". " + tail), (3, " ".join(inner) + ". " + tail), (4, " ".join(inner) + "? Answer: " + reply + " " + tail)]
    # A first stretch with much of the question and no answer, then one that has less of it but the answer.
    other = ask.split("?")[0].split()
    docs.append((5, " ".join(other[1:]) + ". " + prose(8, 70) + " " + " ".join(inner) + "? Answer: " + reply))
    df = spark.createDataFrame(docs + [(10 + i, prose(50 + i, 120)) for i in range(30)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 1), (4, 2), (5, 2)}


def test_longest_common():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.longest_common(np.array(a), np.array(b)) == table[-1][-1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows, bench = items(spark)
    docs = [(i, prose(i, 120), "en", "s", 0) for i in range(30)]
    docs[2] = (2, " ".join(rows[3][1].split()) + " " + docs[2][1], "en", "s", 0)
    docs += [(40, docs[1][1], "en", "s", 0), (41, "!! ".join("JUNK WORDS SHOUTED HERE AND THERE BY SOMEONE WHO NEVER STOPS".split() * 3) + "!!", "en", "s", 0), (42, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 2 not in got and 41 not in got and 42 not in got
    assert set(range(30)) - {2} <= set(got)
    assert got[5].n_tokens > 100
    state = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, state, str(tmp_path))
        assert out.columns == state.columns, name


def test_gram_rows_are_those_of_the_benchmark_only(spark):
    """What comes to the driver has a row for each term of the benchmark, not for every term there could be."""
    rows = spark.createDataFrame([([5, 9, 9],), ([9, 40000],)], "terms array<int>")
    idf = np.ones(1 << decontaminate.TERM_BITS, np.float32)
    a = np.zeros((2, 3))
    a[0, :2], a[1, 1:] = np.array([1, 2]) / 5**0.5, np.array([1, 1]) / 2**0.5
    used, block = decontaminate.times_gram(rows, (np.array([5, 9, 40000]), np.eye(3, dtype=np.float32)), 3, idf)
    assert used.tolist() == [5, 9, 40000] and np.allclose(block, a.T @ a, atol=1e-6)
    start = np.random.default_rng(decontaminate.SEED).standard_normal((1 << decontaminate.TERM_BITS, 4), np.float32)[used]
    used, block = decontaminate.times_gram(rows, None, 4, idf)
    assert block.shape == (3, 4) and np.allclose(block, a.T @ a @ start, atol=1e-5)
