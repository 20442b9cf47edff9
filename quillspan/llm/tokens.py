"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the splitting pattern of this vocabulary, as its distributor gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of a rank file; loaded once in a Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_sizes(docs: DataFrame, key: str, text: str, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens, *keep): the size of each text. A null text has 0 tokens; a row with a null id is left out."""

    name = os.path.basename(path)
    if os.path.exists(path):
        docs.sparkSession.sparkContext.addFile(path)  # the vocabulary reaches executors whether or not they have the folder

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = SparkFiles.get(name)
        enc = encoder(sent if os.path.exists(sent) else path)
        for batch in batches:
            texts = batch.pop("text__").fillna("").tolist()
            batch["n_tokens"] = [len(x) for x in enc.encode_ordinary_batch(texts, num_threads=1)]
            yield batch

    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), *[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").alias("text__")).where("id is not null")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text__"]
    return source.mapInPandas(run, ", ".join([*fields, "n_tokens long"]))
