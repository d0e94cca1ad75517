import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from candleforge.llm import graph, line_dedup, near_dedup, quality, substring_dedup
from candleforge.llm.common import Scratch, perhaps_in
from candleforge.llm.shingles import shingle_sets

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def groups(ids, linked) -> dict:
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert graph.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0
    ids = {x for e in edges for x in e}
    assert got == groups(ids, edges)


@pytest.mark.parametrize("percent", [60, 80])
def test_close_pairs_miss_no_similar_pair(spark, percent):
    """Of crowded sets, every pair of other parts that is similar enough is proposed, and few of the others."""
    rng = random.Random(percent)
    sets = {}
    for k in range(12):
        base = rng.sample(range(1000 * k, 1000 * k + 300), rng.randrange(5, 200))
        for _ in range(12):
            own = {x if rng.random() < 0.93 else rng.randrange(10**6) for x in base}
            sets[len(sets)] = own | {rng.randrange(50) for _ in range(rng.randrange(6))}
    part = {i: i // 3 if i % 12 < 6 else i for i in sets}
    wanted = {(a, b) for a in sets for b in sets if a > b and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    elements = spark.createDataFrame([(i, part[i], len(s), x) for i, s in sets.items() for x in s], "node long, part long, n int, element long")
    with Scratch(spark) as scratch:
        got = {tuple(r) for r in graph.close_pairs(elements, percent, scratch).collect()}
    assert wanted and wanted <= got and len(got) < len(sets) ** 2 / 4
    assert all(part[a] != part[b] for a, b in got)


def test_linked_components_of_a_cloud_take_few_pairs(spark):
    """Sets of one bucket that are mostly not quite similar: pairs in proportion to the sets, and no link lost."""
    rng = random.Random(11)
    base = set(range(300))
    sets = {0: base}
    for i in range(1, 160):
        sets[i] = {x for x in base if rng.random() < 0.8} | {rng.randrange(10**4) + 10**6 for _ in range(8)}
    # Two that are near each other only, and one near those through the first.
    sets[200] = set(sorted(sets[7])[5:]) | {10**7 + 1}
    sets[201] = set(sorted(sets[200])[:-5]) | {10**7 + 2}
    linked = [(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    asked = []

    def confirm(pairs):
        own = [tuple(r) for r in pairs.collect()]
        asked.extend(own)
        return spark.createDataFrame([p for p in own if p in set(linked)], "a long, b long")

    lists = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, set array<long>")
    with Scratch(spark) as scratch:
        slots = scratch.stored(spark.createDataFrame([(i, 1) for i in sets], "node long, key long"))
        parts = graph.linked_components(slots, confirm, lambda members: members.join(lists, "node").select("node", "part", "set"), scratch)
        got = {r.node: r.component for r in parts.collect()}
    expected = groups(sets, linked)
    assert expected[201] == expected[200] == expected[7] and {i: got.get(i, i) for i in sets} == expected
    assert len(asked) == len(set(asked)) < 4 * len(sets)


@pytest.mark.parametrize("block, most", [(4096, 1 << 32), (4, 1 << 32), (4, 100)])
def test_open_buckets_are_compared_in_cells(spark, monkeypatch, block, most):
    """Every similar pair that shares an open bucket is proposed once, without a row for each element of small buckets' sets."""
    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph, "MOST_PAIRS", most)
    if most > 100:
        monkeypatch.setattr(graph, "prefixes", lambda *_: pytest.fail("elements became rows"))
    rng = random.Random(5)
    sets, slots = {}, set()
    for k in range(6):
        base = rng.sample(range(1000 * k, 1000 * k + 300), 40 + 30 * k)
        for _ in range(14):
            i = len(sets)
            sets[i] = frozenset(x if rng.random() < 0.93 else rng.randrange(10**6) for x in base)
            slots |= {(i, rng.randrange(4)), (i, 10 + k), (i, 20 + rng.randrange(3))}
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    linked = [(a, b) for a in sets for b in sets if a > b and similar(a, b) and {k for i, k in slots if i == a} & {k for i, k in slots if i == b}]
    asked = []

    def confirm(pairs):
        own = [tuple(r) for r in pairs.collect()]
        asked.extend(own)
        return spark.createDataFrame([p for p in own if similar(*p)], "a long, b long")

    lists = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, set array<long>").repartition(3)
    with Scratch(spark) as scratch:
        met = scratch.stored(spark.createDataFrame(sorted(slots), "node long, key long"))
        parts = graph.linked_components(met, confirm, lambda members: members.join(lists, "node").select("node", "part", "set"), scratch)
        got = {r.node: r.component for r in parts.collect()}
    assert len(linked) > 40 and {i: got.get(i, i) for i in sets} == groups(sets, linked)
    assert len(asked) == len(set(asked)) < len(sets) ** 2 / 4


def test_pairs_inside_equal_all_pairs():
    rng = np.random.default_rng(4)
    cell, part, n = rng.integers(0, 5, 300), rng.integers(0, 40, 300), rng.integers(150, 400, 300)
    bits = rng.integers(-(1 << 63), 1 << 63, (12, 8))[rng.integers(0, 12, 300)] ^ (1 << rng.integers(0, 64, (300, 8)))
    got = [tuple(sorted(x)) for x in zip(*(y.tolist() for y in graph.pairs_inside(cell, part, n, bits, 80)), strict=True)]
    differ = lambda i, j: sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(bits[i], bits[j], strict=True))
    close = lambda i, j: 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and 180 * differ(i, j) <= 20 * (n[i] + n[j])
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cell[i] == cell[j] and part[i] != part[j] and close(i, j)}
    assert want and len(got) == len(set(got)) and set(got) == want


def test_close_pairs_of_large_sets_that_meet_by_chance(spark):
    """Large sets that share a few elements aren't proposed, though their bitmaps tell nothing; similar ones are."""
    rng = random.Random(11)
    sets = {i: set(rng.sample(range(20000), 1000)) for i in range(40)}
    for i in range(10):
        sets[40 + i] = set(rng.sample(sorted(sets[i]), 890 + i)) | {10**6 + 1000 * i + k for k in range(105)}
    wanted = {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    rows = spark.createDataFrame([(i, i, sorted(s)) for i, s in sets.items()], "node long, part long, set array<long>")
    with Scratch(spark) as scratch:
        got = {(r.a, r.b) for r in graph.close_sets(rows, 80, scratch).collect()}
    assert len(wanted) > 3 and wanted <= got and len(got) < 30


def test_shared_bands_are_those_of_several_lines(spark):
    """Each band that different lines have, with each of them once, whatever batch they and their copies are in."""
    rng = random.Random(12)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(4, 300))) for _ in range(60)]
    texts += [x + "!" for x in texts] + texts[:20]
    number = {x: i for i, x in enumerate(dict.fromkeys(texts))}
    lines = spark.createDataFrame([(number[x], x) for x in texts], "h long, line string").repartition(7)
    having = defaultdict(set)
    for r in line_dedup.with_bands(lines).collect():
        for key in r.bands:
            having[key].add(r.h)
    for n in (1, 10**7):
        got = [(r.node, r.key) for r in line_dedup.shared_bands(lines, n).collect()]
        assert len(got) == len(set(got)) and set(got) == {(h, k) for k, hs in having.items() if len(hs) > 1 for h in hs}


def test_sketches_fill_every_bin_and_estimate():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    y = np.unique(np.concatenate([x[: int(len(x) * 0.9)], rng.integers(0, 1 << 63, 40).astype(np.uint64)]))
    one = np.array([12345], np.uint64)
    bins = near_dedup.sketches(np.concatenate([x, y, one]), np.cumsum([0, len(x), len(y), 1]), 190)
    assert (bins != 0).all()
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((bins[0] == bins[1]).mean() - true) < 0.12


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(docs, rows, empty, size):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, size).collect()}
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = groups(sets, linked)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), expected[i], expected[i] == i) for i, s in sets.items()}
    assert expected[22] == 20 == expected[21] and expected[30] == 29
    assert near_dedup.near_duplicates(empty, size).count() == 0
    assert near_dedup.first_of_each(docs, size).columns == docs.columns


def test_near_duplicates_of_repeated_and_null_ids(spark):
    one, two = "one two three four five six", "six five four three two one"
    rows = [(5, one), (5, two), (5, None), (3, one), (2, two), (None, one), (9, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows) and all(r.kept is not None for r in got)
    assert {(r.component_id, r.kept) for r in got if r.doc_id == 5} in ({(2, False)}, {(3, False)})
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id == 9] == [(9, True)]


def test_rows_with_a_null_id_stay(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (None, None), (None, "one two three four five six")]
    got = near_dedup.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {tuple(r) for r in got} == {rows[0], *rows[2:]}


def test_perhaps_in_keeps_all_that_meet(spark):
    """Rows that meet a key stay, and few others, so that a join after it shuffles few texts."""
    rows = spark.createDataFrame([(i, "t") for i in [*range(-50, 3000), None]], "doc_id long, text string")
    keys = spark.createDataFrame([(7 * i,) for i in range(-5, 300)], "doc_id long")
    got = [r.doc_id for r in perhaps_in(rows, keys, "doc_id").collect()]
    assert {7 * i for i in range(-5, 300)} <= set(got) and len(got) == len(set(got)) < 320
    assert perhaps_in(rows, keys.filter("doc_id IS NULL"), "doc_id").isEmpty()
    named = rows.withColumn("doc_id", rows.doc_id.cast("string"))
    assert {r.doc_id for r in perhaps_in(named, keys.selectExpr("string(doc_id)"), "doc_id").collect()} >= {str(7 * i) for i in range(-5, 300)}


def test_near_duplicates_of_a_crowd(spark):
    """Many changed copies of a text, of which some are near and some aren't quite."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(0, "other text here")]
    for i in range(1, 90):
        words = base[:]
        for _ in range(rng.choice([1, 3, 4, 5, 6])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 4) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.component_id for r in got} == groups(sets, linked)


def test_line_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in line_dedup.removed_lines(docs).collect()}
    lines = {}
    for i, t, *_ in sorted(rows):
        for p, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                lines.setdefault(line, (i, p))
    sets = {x: frozenset(x[k : k + 5] for k in range(len(x) - 4)) or frozenset([x]) for x in lines}
    order = sorted(lines, key=lines.get)
    index = {x: k for k, x in enumerate(order)}
    linked = [(index[a], index[b]) for a in order for b in order if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    first = groups(range(len(order)), linked)
    for i, t, *_ in rows:
        own = [p for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        gone = [p for p in own if lines[order[first[index[t.split("\n")[p]]]]] != (i, p)]
        assert got[i].removed == gone if gone else i not in got
    left = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert left[31] == "a b\nshared line of some length here" and left[32] == "" and left[21] == "" and left[23] is None
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.removed_lines(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_finds_similar_lines_of_every_length(spark):
    """Lines that differ by a mark, a digit or a word, against brute force over the pairs, by length."""
    rng = random.Random(7)
    pairs = [("Subscribe now", "Subscribe now!")]
    for length in (9, 12, 16, 24, 36, 50, 90, 300, 1200):
        for _ in range(40):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(length - 2)).strip() + "xy"
            words = line.split()
            words[rng.randrange(len(words))] = "changed"
            at = rng.randrange(len(line))
            pairs += [(line, line + rng.choice("!?.")), (line, line[:at] + str(rng.randrange(10)) + line[at + 1 :]), (line, " ".join(words)), (line, line[1:])]
            pairs.append((line, "".join(c if rng.random() < 0.97 else "#" for c in line)))

    def of(x):
        return {x[k : k + 5] for k in range(len(x) - 4)} or {x}

    wanted = [(a, b) for a, b in pairs if a != b and 100 * len(of(a) & of(b)) >= 80 * len(of(a) | of(b))]
    lines = list(dict.fromkeys(x for pair in wanted for x in pair))
    keys = {lines[r.h]: set(r.bands) for r in line_dedup.with_bands(spark.createDataFrame(list(enumerate(lines)), "h long, line string")).collect()}
    missed = [(a, b) for a, b in wanted if not keys[a] & keys[b]]
    assert len(wanted) > 700 and not missed
    rows = [(0, "Subscribe now"), (1, "Subscribe now!"), (2, "Something else"), (3, "Log in 1"), (4, "Log in")]
    got = {r.doc_id: r.removed for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [0]}


def test_line_shingles_are_those_of_utf16_units():
    lines = ["", "a", "abcd", "abcd\r", "abcde", "abcdefg", "日本\U0001f600 x", "aaaaaaa" * 200, "".join(chr(97 + k * k % 23) for k in range(900))]
    hashes, at = line_dedup.shingle_hashes(pa.array(lines))

    def of(x):
        units = x.encode("utf-16-le")
        return [units[2 * k : 2 * k + 10] for k in range(len(units) // 2 - 4)] or [units]

    own = [of(x) for x in lines]
    assert np.diff(at).tolist() == [len(x) for x in own]
    flat, seen = [x for shingles in own for x in shingles], {}
    assert all(seen.setdefault(x, h) == h for x, h in zip(flat, hashes.tolist(), strict=True)) and len(set(seen.values())) == len(seen)
    sizes = line_dedup.common_sizes((hashes, at), (hashes[at[1] :], np.append(at[1:] - at[1], len(hashes) - at[1])))
    assert sizes.tolist()[:-1] == [[len(set(a)), len(set(b)), len(set(a) & set(b))] for a, b in zip(own, own[1:], strict=False)]
    most = line_dedup.SIGNATURE + line_dedup.RUN - 1
    for rows, width in line_dedup.alike(np.diff(at)):
        for i, got in zip(rows, line_dedup.least_hashes(hashes, at, rows, width), strict=True):
            assert got[got != line_dedup.END].tolist() == sorted(set(hashes[at[i] : at[i + 1]].tolist()))[:most]


def brute_substrings(rows, least: int) -> dict:
    seen, out = set(), {}
    for i, text in sorted(rows):
        gone = bytearray(len(text))
        for p in range(len(text) - least + 1):
            window = text[p : p + least]
            if window in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(window)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        out[i] = (len(text), sum(gone), sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1, 2000])
def test_substring_dedup(spark, docs, rows, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rng = random.Random(1)
    parts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 90))) for _ in range(25)] + ["x" * 40, "é" * 30, "ab" * 50]
    more = [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randrange(12)))) for i in range(40)] + [(150, "ab" * 300), (151, "zq" * 60), (152, "a" * 99)]
    all_rows = [(i, t) for i, t, *_ in rows] + more
    df = docs.select("doc_id", "text", "key", "group").unionByName(spark.createDataFrame([(i, t, "k", "g") for i, t in more], "doc_id long, text string, key string, group string"))
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_dedup(df).collect()}
    assert got == brute_substrings([(i, (t or "").encode()) for i, t in all_rows], 100)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_key_slices_keep_keys_whole():
    key = np.array([5, 1, 5, 2, 9, 9, 9, 1], np.uint64)
    size = np.array([10, 4, 10, 5, 30, 30, 30, 4])
    parts = substring_dedup.key_slices(key, size, 25)
    assert sorted(np.concatenate(parts).tolist()) == list(range(8))
    assert [set(key[p].tolist()) for p in parts] == [{1, 2}, {5}, {9}]
    assert substring_dedup.key_slices(key[:0], size[:0], 25) == []


def test_substring_dedup_in_small_slices(spark, monkeypatch):
    """Strings found whatever the slices of a file, with a hot key cut to single strings."""
    monkeypatch.setattr(substring_dedup, "SLICE", 700)
    monkeypatch.setattr(substring_dedup, "HOT", 3)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(240))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(60, 200))) + passage[rng.randrange(40) :] + "".join(rng.choice("xyz") for _ in range(90)) for _ in range(60)]
    rows = [*enumerate(texts), (70, texts[3]), (71, texts[9][:150])]
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_substrings([(i, t.encode()) for i, t in rows], 100)


def test_shingle_sets_are_sets_of_words():
    texts = ["A b c d e", "a  B\tc d\ne", "", "a b", "x a b c d e"]
    hashes, at = shingle_sets(pa.array(texts), 4)
    sets = [set(hashes[at[i] : at[i + 1]].tolist()) for i in range(5)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and not sets[2] and len(sets[3]) == 1 and sets[0] < sets[4]


def test_quality(docs, rows, empty):
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        count = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if count[tuple(words[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert tuple(got[i])[1:7] == (*base, failed)
        assert not (failed and got[i].kept)
    assert got[5].kept and got[27].kept
    assert quality.quality_report(empty).count() == 0
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.quality_filter(empty).count() == 0


def test_quality_rejects_junk(spark):
    rng = random.Random(2)
    words = [f"word{k}" for k in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " | ".join(rng.choice(words) for _ in range(60)), "en", "s") for i in range(20)] + [(2000, " ".join(w.upper() + "!!" for w in words[:60]), "en", "s")]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(300)) and not any(kept for i, kept in got.items() if i >= 1000)


def test_quality_adapts_to_the_source(spark):
    """The same texts pass in a source of their like and fail in another; verdicts equal those of exact quartiles."""
    rng = random.Random(9)
    words = [f"word{k}" for k in range(3000)]

    def text(share, long=0):
        return " ".join(rng.choice(words) + ("+" * long) + (" |" if rng.random() < share else "") for _ in range(60))

    rows = [(text(0.0), "en", "prose") for _ in range(250)] + [(text(0.6), "en", "code") for _ in range(250)] + [(text(rng.random()), "en", "mixed") for _ in range(250)]
    rows += [(text(0.0, rng.randrange(9)), "de", "prose") for _ in range(250)] + [(text(0.3), "fr", "small") for _ in range(20)]
    rows += [(t, "en", s) for t in (text(0.6), text(0.5), text(0.0, 8)) for s in ("prose", "code")] + [("x" * 90 + " " + text(0), None, None)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    got = {r.doc_id: r.kept for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}

    def measures(t):
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        n, chars = max(1, len(w)), sum(map(len, w))
        return {"symbol_rate": sum(c in "#*$%&|<>" for c in t) / n, "capital_rate": sum("A" <= c <= "Z" for c in t) / max(1, chars), "shout_rate": t.count("!") / n,
                "dup_line_rate": (len(lines) - len(set(lines))) / max(1, len(lines)), "word_length": chars / n}

    by = defaultdict(list)
    for _, t, lang, source in rows:
        for key in ((lang, source), (lang,), ()):
            by[key].append(measures(t))
    for i, t, lang, source in rows:
        group = next((by[k] for k in ((lang, source), (lang,)) if len(by[k]) >= quality.LEAST_ROWS), by[()])
        kept = True
        for m, (least, lower) in quality.MEASURES.items():
            values = sorted(g[m] for g in group)
            low, high = (values[max(0, -(-len(values) * q // 4) - 1)] for q in (1, 3))
            spread = max(high - low, least)
            kept &= (not lower or measures(t)[m] >= low - 3 * spread) and measures(t)[m] <= high + 3 * spread
        assert got[i] == kept, (i, lang, source)
    n = len(rows)
    assert not got[n - 7] and got[n - 6] and not got[n - 5] and got[n - 4]


def test_covered_words_counts_each_word_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 2, 1, 3, 1],), ([5, 5, 5],), ([7, 8],)], "x array<bigint>")
    got = [r[0] for r in df.select(quality.covered_words(F.col("x"))).collect()]
    expected = []
    for x in ([1, 2, 1, 3, 1], [5, 5, 5], [7, 8]):
        by = defaultdict(list)
        for i, v in enumerate(x):
            by[v].append(i)
        expected.append(len({i + j for at in by.values() if len(at) > 1 for i in at for j in range(5)}))
    assert got == expected
