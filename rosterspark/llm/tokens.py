"""Token counts of texts with a public byte-level BPE, on Arrow batches."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files; a parameter, never part of this repository.
TOKENIZER_DIR = os.environ.get("ROSTERSPARK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.bytes_of[rank] = len(token)

    def count(self, text: str | None) -> int:
        return len(self.encoding.encode_ordinary(text)) if text else 0

    def ends(self, text: str) -> np.ndarray:
        """Byte offset in ``text`` at which each token ends."""
        return np.cumsum(self.bytes_of[np.asarray(self.encoding.encode_ordinary(text), dtype=np.int64)])


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def tokenizer_path(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> str:
    return os.path.join(folder, vocabulary)


def with_sizes(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """(keep..., n_tokens) of each row; a null or empty text has 0 tokens. Whole texts are read, none is returned."""
    path = path or tokenizer_path()
    slim = df.select(*keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            sizes = pa.array([t.count(x) for x in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], sizes], names=[*keep, "n_tokens"])

    kept = slim.select(*keep)
    schema = kept.schema.add("n_tokens", "long")
    return slim.mapInArrow(run, schema)
