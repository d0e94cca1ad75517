"""Exact byte-pair encoding by longest matches with backtracking, and decoding through an offset table.

A vocabulary file of the ``tokenizers`` library is read for its vocabulary, merges and added tokens. The text is cut
at added tokens, then at white space; each stretch is brought to NFC and lower case and cut into words. The encoder
lists, by an Aho-Corasick automaton of all tokens, every token at every place of a word, takes the longest one whose
pair with the token before is compatible (the merges leave the two apart), and steps back when none fits. As each
prefix of a word has one valid encoding, a place that failed once fails for good and is never visited twice, so a
word takes linear time. Decoding looks ids up in one byte string through a table of offsets.

Stretches and words repeat, so each worker remembers a bounded number of short ones.

Defined results: null and empty texts have no tokens and decode to the empty string; ids that the vocabulary lacks
can't arise as every byte is a token; texts of any length are encoded whole, in memory that grows with the longest
word and text; an empty table gives an empty result; repeated rows are encoded row by row; columns besides id and text
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import map_arrow, table, text_or_empty

#: Stretches, and words, that a worker remembers in each of two generations, and the longest of them.
MEMORY, REMEMBERED = 250_000, 64
#: Pairs whose compatibility a worker remembers.
PAIRS = 2_000_000
#: Unicode White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Added to the last character of a word, so that "at the end" is part of the alphabet.
FINAL = 0x1000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordEncoder:
    """Backtracking encoder of one vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text_of.update({i: t for t, i in self.specials.items()})
        self.special_rx = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.stretches = re.compile(f"[^{SPACE}]+").findall
        self.bytes = byte_alphabet()
        own = {self._own(t): i for t, i in model["vocab"].items()}
        self.own_of = {i: t for t, i in own.items()}
        self.rank = {(self._own(a), self._own(b)): r for r, (a, b) in enumerate(map(self._pair, model["merges"]))}
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[str, tuple[str, str]] = {}
        for t, i in own.items():
            if self._merge(t) == [t]:
                self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        formed = {t: self.rank[p] for t, p in self.halves.items()}
        #: Whether each merge comes after those that made its two halves, as in every trained vocabulary.
        self.ordered = all(r > max(formed.get(a, -1), formed.get(b, -1)) for (a, b), r in self.rank.items())
        self.rights: dict[int, list[tuple[str, int]]] = {}
        self.lefts: dict[int, list[tuple[str, int]]] = {}
        self.compatible: dict[int, bool] = {}
        self.new_words: dict[str, tuple[str, int, str]] = {}
        self.old_words: dict[str, tuple[str, int, str]] = {}
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.pieces = [self.text_of.get(i, "") for i in range(max(self.text_of) + 1)]
        data = [p.encode("utf-8") for p in self.pieces]
        self.blob, self.offsets = b"".join(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]).tolist()

    @staticmethod
    def _pair(merge) -> tuple[str, str]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        return a, b

    def _own(self, token: str) -> str:
        """A token's text over the alphabet of 256 characters and 256 final ones."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + FINAL)
        return token

    def _merge(self, text: str) -> list[str]:
        """The merges as defined: the pair of lowest rank first, its leftmost place first."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 30:
                break
            at = ranks.index(low)
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart; looked up in the pair table, which fills as pairs occur."""
        known = self.compatible.get((left << 32) | right)
        if known is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[(left << 32) | right] = not self._crosses(left, right)
        return known

    def _edge(self, token: int, side: int) -> list[tuple[str, int]]:
        """The parts that stand at a token's edge while it is merged, each with the rank of the merge that takes it."""
        part, taken, out = self.own_of[token], 1 << 30, []
        while True:
            out.append((part, taken))
            halves = self.halves.get(part)
            if halves is None:
                return out
            part, taken = halves[side], self.rank[halves]

    def _crosses(self, left: int, right: int) -> bool:
        """Whether a merge joins the two tokens' texts across their border."""
        if not self.ordered:
            a, b = self.own_of[left], self.own_of[right]
            return self._merge(a + b) != [a, b]
        ends = self.rights.get(left)
        if ends is None:
            ends = self.rights[left] = self._edge(left, 1)
        starts = self.lefts.get(right)
        if starts is None:
            starts = self.lefts[right] = self._edge(right, 0)
        rank = self.rank
        for a, a_taken in ends:
            for b, b_taken in starts:
                r = rank.get((a, b))
                # At equal rank the place further left goes first: inside the left token, or at the border.
                if r is not None and r < a_taken and r <= b_taken:
                    return True
        return False

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer."""
        # Printable ASCII stands for itself in the byte alphabet.
        symbols = word if word.isascii() and word.isprintable() and " " not in word else "".join([self.bytes[b] for b in word.encode("utf-8")])
        if self.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + FINAL)
        n = len(symbols)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (token, length) in self.automaton.iter(symbols):
            at[end + 1 - length].append((token, end + 1))
        # Matches come by rising end, so each list is from the shortest to the longest token; what is left of it is untried.
        known, fits = self.compatible.get, self.fits
        out: list[int] = []
        places: list[int] = []
        dead: set[int] = set()
        place, last = 0, -1
        while place < n:
            untried = at[place]
            while untried:
                token, end = untried.pop()
                if end in dead:
                    continue
                fit = True if last < 0 else known((last << 32) | token)
                if fit or fit is None and fits(last, token):
                    out.append(token)
                    places.append(place)
                    last, place = token, end
                    break
            else:
                # A place with no valid way on fails for good: each prefix has one valid encoding.
                dead.add(place)
                out.pop()
                place = places.pop()
                last = out[-1] if out else -1
        return out

    def word(self, word: str) -> tuple[str, int, str]:
        """Decimal ids, their count and the decoded text of a word; a bounded number of words is remembered."""
        found = self.new_words.get(word)
        if found is None:
            found = self.old_words.get(word)
            if found is None:
                ids = self.encode_word(word)
                found = (" ".join(map(str, ids)), len(ids), self.decode(ids))
            if len(word) <= REMEMBERED:
                if len(self.new_words) >= MEMORY:
                    self.old_words, self.new_words = self.new_words, {}
                self.new_words[word] = found
        return found

    def _stretch(self, raw: str) -> tuple[str, int, str]:
        found: list[tuple[str, int, str]] = []
        at = 0
        for m in [*self.special_rx.finditer(raw), None] if self.special_rx and "<" in raw else [None]:
            part = raw[at : m.start() if m else len(raw)]
            if part:
                # Lower case goes by character, so the capital sigma has one lower form.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                found += map(self.word, self.words(part))
            if m:
                found.append((str(self.specials[m[0]]), 1, m[0]))
                at = m.end()
        if len(found) == 1:
            return found[0]
        return " ".join([f[0] for f in found]), sum([f[1] for f in found]), " ".join([f[2] for f in found])

    def stretch(self, raw: str) -> tuple[str, int, str]:
        """Decimal ids, their count and the decoded text of a stretch without white space."""
        found = self.young.get(raw)
        if found is None:
            found = self.old.get(raw)
            if found is None:
                found = self._stretch(raw)
            if len(raw) <= REMEMBERED:
                if len(self.young) >= MEMORY:
                    self.old, self.young = self.young, {}
                self.young[raw] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for s in self.stretches(text) for i in self.stretch(s)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by single spaces, as the library does for a vocabulary without a decoder."""
        o, blob = self.offsets, self.blob
        return b" ".join([blob[o[i] : o[i + 1]] for i in ids]).decode("utf-8")

    def digest(self, text: str) -> tuple[int, str, str]:
        memory, get = self.young.get, self.stretch
        found = [memory(s) or get(s) for s in self.stretches(text)]
        found = [f for f in found if f[1]]
        ids = hashlib.sha256(" ".join([f[0] for f in found]).encode()).hexdigest()
        return sum([f[1] for f in found]), ids, hashlib.sha256(" ".join([f[2] for f in found]).encode()).hexdigest()


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> WordEncoder:
    import public_tokenizers

    return WordEncoder(vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary))


def _over(df: DataFrame, id_col: str, text_col: str, make, fields: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}")


def encode_ids(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the array of token ids."""

    def batch_ids(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(vocabulary)
        ids = [own.encode(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _over(df, id_col, text_col, batch_ids, "ids array<int>")


def decode_ids(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and the text that the library decodes the ids to; null ids decode to the empty string."""

    def batch_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(vocabulary)
        texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return map_arrow(rows, batch_texts, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def encode_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, and SHA-256 of the decimal ids and of the decoded text."""

    def batch_digests(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(vocabulary)
        found = [own.digest(t) for t in batch.column("text").to_pylist()]
        n, ids, decoded = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _over(df, id_col, text_col, batch_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), "word_bpe_49k.json")
