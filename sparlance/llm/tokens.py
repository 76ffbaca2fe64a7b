"""Problem 6: encoding of the whole corpus with a public tokenizer.

Short texts are encoded as they are. A long text is cut into halves again and again; the
halves are encoded on their own, those of very long texts in tasks of their own, and joined
in a tree. At each join a window around the cut is encoded again and grows until its first
and its last piece agree with what both sides have; from there on both sides are exact.
A single piece without a boundary (a long run of letters) is joined in the same way on the
level of its byte pairs: the window grows until its first and last token agree with both sides.
Byte-pair encodings are determined by adjacent pairs of tokens, so that agreement suffices.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary is looked for unless a path is given.
DEFAULT_VOCABULARY = os.environ.get("SPARLANCE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed: the vocabulary's rule for cutting a text into pieces.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text of more characters is cut; a text of more than SPREAD_CHARS goes to several tasks.
LEAF_CHARS = 2_048
SPREAD_CHARS = 1 << 20


class Codec:
    """A byte-pair vocabulary with a tree-wise encoder."""

    def __init__(self, data: bytes, leaf: int = LEAF_CHARS) -> None:
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.encoding = tiktoken.Encoding("sparlance", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})
        self.word = {i: b for b, i in ranks.items()}
        self.piece = regex.compile(PIECE)
        self.leaf = leaf

    # a piece is (its characters, its ids)
    def _ids(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "replace")
        if len(data) <= 4 * self.leaf:
            return self.encoding._encode_single_piece(data)
        middle = len(data) // 2
        return self._join_bytes(self._tree_bytes(data[:middle]), self._tree_bytes(data[middle:]))

    def _tree_bytes(self, data: bytes) -> list[int]:
        if len(data) <= 4 * self.leaf:
            return self.encoding._encode_single_piece(data)
        middle = len(data) // 2
        return self._join_bytes(self._tree_bytes(data[:middle]), self._tree_bytes(data[middle:]))

    def _join_bytes(self, a: list[int], b: list[int]) -> list[int]:
        """Ids of the concatenation of two encoded byte strings that lie in one piece."""
        if not a or not b:
            return a + b
        size = 4
        while True:
            m, n = min(size, len(a)), min(size, len(b))
            window = self.encoding._encode_single_piece(b"".join(self.word[i] for i in a[len(a) - m :] + b[:n]))
            left = m == len(a) or len(window) > 1 and window[0] == a[len(a) - m]
            right = n == len(b) or len(window) > 1 and window[-1] == b[n - 1]
            if left and right:
                return a[: len(a) - m] + window + b[n:]
            size *= 2

    def _pieces(self, text: str) -> list[tuple[str, list[int]]]:
        return [(p, self._ids(p)) for p in self.piece.findall(text)]

    def join(self, a: list, b: list) -> list:
        """Pieces of the concatenation of two cut texts."""
        if not a or not b:
            return a + b
        size = 2
        while True:
            m, n = min(size, len(a)), min(size, len(b))
            window = self.piece.findall("".join(p for p, _ in a[len(a) - m :] + b[:n]))
            left = m == len(a) or len(window) > 1 and window[0] == a[len(a) - m][0]
            right = n == len(b) or len(window) > 1 and window[-1] == b[n - 1][0]
            if left and right:
                break
            size *= 2
        known = {p: i for p, i in a[len(a) - m :] + b[:n]}
        seam = (a[-1][0] + b[0][0]) if len(a[-1][0]) + len(b[0][0]) > self.leaf else None
        fresh = []
        for p in window:
            if p in known:
                fresh.append((p, known[p]))
            elif p == seam:  # one long piece that the cut went through
                fresh.append((p, self._join_bytes(a[-1][1], b[0][1])))
            else:
                fresh.append((p, self._ids(p)))
        return a[: len(a) - m] + fresh + b[n:]

    def tree(self, text: str) -> list:
        """Pieces of a text, by halves."""
        if len(text) <= self.leaf:
            return self._pieces(text)
        middle = len(text) // 2
        return self.join(self.tree(text[:middle]), self.tree(text[middle:]))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; [] for an empty text and for None."""
        if not text:
            return []
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        return [i for _, ids in self.tree(text) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.word[i] for i in ids)


@lru_cache(maxsize=4)
def _codec(data: bytes, leaf: int) -> Codec:
    return Codec(data, leaf)


def _broadcast_vocabulary(spark: SparkSession, path: str | None):
    with open(path or DEFAULT_VOCABULARY, "rb") as f:
        return spark.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB


def encode_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, leaf: int = LEAF_CHARS, spread: int = SPREAD_CHARS) -> DataFrame:
    """(key, ids) of every row, without special tokens; a null and an empty text give an empty list.

    Strings that look like special tokens are ordinary text. Repeated rows give repeated rows.
    Texts of more than `spread` characters are encoded in parts by several tasks, and the parts,
    numbered in order, are joined pairwise where they come together.
    """
    shared = _broadcast_vocabulary(docs.sparkSession, vocabulary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = "key long, ids array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, leaf)
        for batch in batches:  # Arrow throughout: a null key must not turn the others into floats
            ids = pa.array([codec.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), ids], ["key", "ids"])

    long_text = F.coalesce(F.char_length("text") > spread, F.lit(False))
    short = rows.where(~long_text).mapInArrow(whole, schema)
    row = rows.where(long_text).select(F.monotonically_increasing_id().alias("row"), F.col("key").cast("string").alias("key"), "text")
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.char_length("text") - 1) / F.lit(spread)))
    parts = row.select("row", "key", "text", F.explode(starts).alias("part"))
    parts = parts.select("row", "key", "part", F.expr(f"substring(text, int(part * {spread} + 1), {spread})").alias("text"))
    parts = parts.repartition("row", "part")

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value, leaf)
        for pdf in batches:
            out = []
            for row_, key_, part, t in zip(pdf.row, pdf.key, pdf.part, pdf.text):
                pieces = codec.tree(t)
                out.append((row_, key_, part, [p for p, _ in pieces], [i for _, i in pieces]))
            yield pd.DataFrame(out, columns=["row", "key", "part", "pieces", "ids"])

    done = parts.mapInPandas(leaves, "row long, key string, part long, pieces array<string>, ids array<array<int>>")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        codec = _codec(shared.value, leaf)
        level = [[(p, list(i)) for p, i in zip(r.pieces, r.ids)] for r in pdf.sort_values("part").itertuples()]
        while len(level) > 1:
            level = [codec.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pd.DataFrame({"key": [pdf.key.iloc[0]], "ids": [[i for _, ids in level[0] for i in ids]]})

    spread_out = done.groupBy("row").applyInPandas(together, "key string, ids array<int>").select(F.col("key").cast("long").alias("key"), "ids")
    return short.unionByName(spread_out).select(F.col("key").alias(key), "ids")


def token_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens) of every row; 0 for null and empty texts."""
    return encode_texts(docs, key=key, text=text, vocabulary=vocabulary).select(key, F.size("ids").cast("long").alias("n_tokens"))
