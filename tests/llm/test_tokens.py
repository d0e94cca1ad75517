import hashlib
import random

import public_tokenizers
import pytest

from candleforge.llm import bpe, token_counts

ALPHABET = ["a", "b", "é", "é", "Σ", "İ", "1", "'s", " ", "  ", "\n", "日", "\U0001f600", "<|endoftext|>", "...", "Z", "zz", "the", "ing", "٣", "ሴ", "▁", "<s>"]


def samples(n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_backtracking_encoder_equals_library(library):
    own = bpe.encoder("word_bpe_49k.json")
    for text in samples(800):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_digests_and_round_trip(docs, rows, library, empty):
    got = {r.doc_id: r for r in bpe.encode_digests(docs, "word_bpe_49k.json").collect()}
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        own = got[doc_id]
        assert own.n_tokens == len(ids)
        assert own.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = bpe.decode_ids(bpe.encode_ids(docs, "word_bpe_49k.json"), "word_bpe_49k.json")
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in decoded.collect()} == {i: r.decoded_sha256 for i, r in got.items()}
    assert bpe.encode_digests(empty, "word_bpe_49k.json").count() == 0


def test_spliced_encoding_equals_whole():
    sp = token_counts.processor("piece_bpe_32k.model")
    for text in samples(800, 9):
        if text:
            assert token_counts.encode_spliced(sp, text, 16, 4) == sp.encode(text)
    solid = "".join(random.Random(5).choice("abcdefgh") for _ in range(3000))
    assert token_counts.encode_spliced(sp, solid, 300, 20) == sp.encode(solid)
    assert token_counts.encode_spliced(sp, "a" * 3000, 300, 20) == sp.encode("a" * 3000)


def test_token_counts(docs, rows, empty):
    sp = token_counts.processor("piece_bpe_32k.model")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, "piece_bpe_32k.model", chunk_chars=500, overlap_chars=50).collect()}
    for doc_id, text, *_ in rows:
        n = len(sp.encode(text or ""))
        assert tuple(got[doc_id]) == (doc_id, len((text or "").encode()), n, n > 4096)
    assert token_counts.count_tokens(empty, "piece_bpe_32k.model").count() == 0
