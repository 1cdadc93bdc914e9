"""Token counts of texts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Vocabulary file of the tokenizer; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE vocabularies of this kind split a text first.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str) -> object:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(df: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """The rows with ``text`` replaced by ``tokens``, its number of tokens; null texts have 0.  No shuffle."""
    others = [c for c in df.columns if c != text]
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(n, pa.int64())], names=[*others, "tokens"])

    return df.mapInArrow(run, f"{kinds}, tokens long")
