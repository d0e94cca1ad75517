"""Token ids of public vocabularies, and the bytes that each id stands for."""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

from candleforge.llm.bpe import byte_alphabet


def _path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class ByteVocabulary:
    """A byte-level vocabulary file of the ``tokenizers`` library.

    Where its merges are in the order of their ids, encoding goes through tiktoken's merges over the file's own entries,
    several times as fast as the library with the same ids; a file of another build, and texts with special strings that
    aren't plain text, go to the library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], {c: b for b, c in enumerate(byte_alphabet())}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.path = path
        entries = {t: i for t, i in model["vocab"].items() if t not in self.specials}
        known = {i: bytes(byte_of[c] for c in t) for t, i in entries.items()} | {i: t.encode() for t, i in self.specials.items()}
        #: Each id's bytes; those of special tokens are their strings'.
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        before = spec.get("pre_tokenizer") or {}
        ordered = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and not model.get("ignore_merges") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and [entries.get(t) for t in merged] == list(range(256, 256 + len(merged))) and len(entries) == 256 + len(merged)
        )
        ranks = {self.bytes[i]: i for i in entries.values()}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ordered else None

    @cached_property
    def library(self):
        """The library's own tokenizer, loaded where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @cached_property
    def library_plain(self):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = True
        return own

    def encode_plain(self, text: str) -> list[int]:
        """Ids where special strings are plain text."""
        return self.fast(text) if self.fast else self.library_plain.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        """Ids as the library gives them by default, without added special tokens."""
        if self.fast is None or any(s in text for s in self.specials):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast(text)


class PieceVocabulary:
    """A SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        by_byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        #: Each id's bytes, with the sign for a space as a space.
        self.bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(by_byte, pieces, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, before which the model puts a space."""
        return self.library.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def byte_vocabulary(name: str) -> ByteVocabulary:
    return ByteVocabulary(_path(name))


@lru_cache(maxsize=2)
def piece_vocabulary(name: str) -> PieceVocabulary:
    return PieceVocabulary(_path(name))
