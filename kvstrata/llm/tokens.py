"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The public split pattern of that vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a rank file, loaded once in each worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, enc) -> int:
    """Tokens of a text; null and empty texts have none.  Byte pair merging takes near linear time, also where a long text has no place to split it."""
    return len(enc.encode_ordinary(text)) if text else 0


def with_tokens(df: DataFrame, text_col: str, keep: list[str], out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` of ``df`` and the token count of ``text_col`` (0 for null)."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keep).dtypes) + f", `{out}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            counts = [token_count(x, enc) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, out])

    return df.select(*keep, text_col).mapInArrow(run, schema)
