"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies.

The join runs inside each block of documents, against a bounded memo that lives as long as the worker:
no ids are materialised and nothing is shuffled. A pre-token is worked out once per worker, not once per occurrence.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens remembered by a worker before the memo starts anew; about 200 MB at most.
MEMO = 1_000_000

#: Pre-token patterns of the two vocabularies, as their .json files and library define them.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts with other characters, or with what may be a special token, go through the library as a whole: character
#: classes and case rules outside these ranges may differ between Unicode versions.
UNSURE = regex.compile("[^\t\n\r\x20-\x7e¡-įı-ž‐-‧€]|<\\|")

_TOKENIZERS: dict[int, object] = {}


def tokenizer(blob: str):
    """The tokenizer of a .json file's content, one per worker."""
    key = hash(blob)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(blob)
        t.no_truncation()
        t.no_padding()
        _TOKENIZERS[key] = t
    return _TOKENIZERS[key]


class Pieces(dict):
    """Pre-token to its number of pieces, worked out on first sight."""

    def __init__(self, tok):
        super().__init__()
        self.tok = tok

    def learn(self, words: set[str]) -> None:
        """Count the pieces of all unknown words at once."""
        new = [w for w in words if w not in self]
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            for w, e in zip(part, self.tok.encode_batch(part, add_special_tokens=False), strict=True):
                self[w] = len(e)


def blocks(texts: list, most: int = 4_000_000) -> Iterator[list]:
    """Runs of texts with about `most` characters each."""
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(t or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_tokens, over_limit (more than `limit` tokens).

    The file is read on the driver and sent along, so executors need no path. Null and empty texts have 0 tokens.
    Repeated rows and null ids pass through. Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        blob = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(blob.value)
        find = regex.compile(BYTE_LEVEL).findall
        pieces = Pieces(tok)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for block in blocks(batch.column(1).to_pylist()):
                frequencies = [None if UNSURE.search(t) else Counter(find(t)) for t in block]
                if len(pieces) > MEMO:
                    pieces.clear()
                pieces.learn(set().union(*(f for f in frequencies if f is not None)))
                for t, f in zip(block, frequencies, strict=True):
                    n_bytes.append(len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")))
                    n_tokens.append(
                        len(tok.encode(t, add_special_tokens=False)) if f is None
                        else sum(n * pieces[w] for w, n in f.items())
                    )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    rows = docs.select(id_col, text_col)
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
