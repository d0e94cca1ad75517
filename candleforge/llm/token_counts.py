"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

A text of up to ``chunk_chars`` characters is encoded at once. A longer one is cut into chunks that overlap by
``overlap_chars``; each is encoded with byte offsets. Two neighbours are spliced at a boundary inside the overlap
where both have the same token, over the same bytes, on either side of it. Byte-pair encodings are decided pairwise:
a token sequence is the encoding of its text exactly if each pair of neighbours is the encoding of the pair's text.
At such a boundary every pair of the spliced sequence is a pair of one of the two encodings, so the splice is the
encoding of the joined text. Where no boundary qualifies the overlap is doubled, up to encoding both chunks as one.

Defined results: null and empty texts have 0 bytes and 0 tokens; ties and repeated rows are counted row by row;
an empty table gives an empty result; columns besides the two named are left out.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleforge.llm.common import map_arrow, table, text_or_empty

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
TOKEN_LIMIT = 4096

#: id, first byte and end byte in the whole text.
Token = tuple[int, int, int]


@lru_cache(maxsize=4)
def processor(model: str):
    """The SentencePiece processor of a model file, or of a name that the tokenizer package knows."""
    import os

    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model if os.path.isabs(model) else public_tokenizers.path(model))


def encode_with_offsets(sp, text: str, start_byte: int) -> list[Token]:
    proto = sp.encode(text, return_type="proto")
    return [(p.id, start_byte + p.begin, start_byte + p.end) for p in proto.pieces]


def splice_point(left: list[Token], right: list[Token], low: int, high: int) -> tuple[int, int] | None:
    """Tokens of ``left`` and of ``right`` before the stable boundary nearest the middle of bytes ``low`` to ``high``."""
    starts = {(a, b): i + 1 for i, (a, b) in enumerate(zip(right, right[1:], strict=False)) if a[1] >= low}
    best = None
    for i in range(len(left) - 1, 0, -1):
        if left[i - 1][1] < low:
            break
        j = starts.get((left[i - 1], left[i]))
        cut = left[i][1]
        if j is not None and left[i - 1][2] == cut and (best is None or abs(2 * cut - low - high) < best[0]):
            best = (abs(2 * cut - low - high), i, j)
    return best and best[1:]


def encode_spliced(sp, text: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> list[int]:
    """Ids of ``text`` by chunks; equal to encoding it at once."""
    size = [0]
    for a in range(0, len(text), overlap_chars):
        size.append(size[-1] + len(text[a : a + overlap_chars].encode("utf-8")))

    def byte_of(char: int) -> int:
        block, rest = divmod(char, overlap_chars)
        return size[block] + len(text[char - rest : char].encode("utf-8"))

    end = min(chunk_chars, len(text))
    done = encode_with_offsets(sp, text[:end], 0)
    begin = 0
    while end < len(text):
        overlap, to = overlap_chars, min(end + chunk_chars, len(text))
        while True:
            start = max(begin, end - overlap)
            if start == begin:
                # The overlap has reached the chunk's own start: both are encoded as one, from the text's beginning.
                done, begin = encode_with_offsets(sp, text[:to], 0), 0
                break
            right = encode_with_offsets(sp, text[start:to], byte_of(start))
            at = splice_point(done, right, byte_of(start), byte_of(end))
            if at:
                done, begin = done[: at[0]] + right[at[1] :], start
                break
            overlap *= 2
        end = to
    return [token for token, _, _ in done]


def count_tokens(
    df: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens as the model's library gives them, and whether they pass ``limit``."""

    def batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        sp = processor(model)
        texts = batch.column("text").to_pylist()
        short = [t for t in texts if len(t) <= chunk_chars]
        counted = iter(sp.encode(short, num_threads=1))
        tokens = [len(next(counted)) if len(t) <= chunk_chars else len(encode_spliced(sp, t, chunk_chars, overlap_chars)) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
        )

    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = map_arrow(rows, batch_counts, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
