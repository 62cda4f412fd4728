"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A rank file as tiktoken reads it: a base64 token and its rank on each line.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding(path: str = RANKS):
    """The tokenizer of a rank file, loaded once per process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_sizes(df: DataFrame, text: str, path: str | None = None) -> DataFrame:
    """The columns but ``text``, and n_tokens; null and empty texts have 0.

    ``path`` is the rank file, by default the one that the session names in ``spark.tessela.ranks``, else ``RANKS``.
    """
    path = path or df.sparkSession.conf.get("spark.tessela.ranks", RANKS)
    rest = [c for c in df.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "n_tokens bigint"])

    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(n, pa.int64())], [*rest, "n_tokens"])

    return df.select(*rest, text).mapInArrow(size, schema)
