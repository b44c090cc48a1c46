"""Byte-level BPE encoding and decoding with a segment tree of pair ranks."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Children of a node of the segment tree.
FAN = 4
#: Most stretches, and most pieces, whose tokens a worker remembers; then it starts afresh.
REMEMBERED = 400_000
#: A space between two white characters, or after one at the end of the text.
WIDE = re.compile(r"\s (?:\s|\Z)")
#: Texts of more characters are cut into pieces as a stream.
STREAM_CHARS, STREAM_PIECES = 1 << 20, 1 << 16


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one piece. Leaves of the segment tree are byte positions; each holds the rank of the pair that starts at this live
    position with its live right neighbour, scaled so that the smallest value is the leftmost pair of the lowest rank. An inner node holds the smallest value of
    its FAN children, up to a root of FAN at most. A merge updates the leaves of the merged position, of the one that goes and of the live left neighbour,
    and the nodes above them: logarithmic in the length of the piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    none = 1 << 62
    get = ranks.get
    leaf = [none if (rank := get(piece[i : i + 2])) is None else rank * n + i for i in range(n - 1)]
    leaf.append(none)
    levels = [leaf]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[i : i + FAN]) for i in range(0, len(below), FAN)])
    root, inner = levels[-1], list(zip(levels, levels[1:], strict=False))
    right = list(range(1, n + 1))  # start of the live right neighbour; n at the end
    left = list(range(-1, n - 1))

    while (least := min(root)) < none:
        i = least % n
        gone = right[i]
        after = right[gone]
        right[i] = after
        leaf[gone] = none
        if after < n:
            left[after] = i
            rank = get(piece[i : right[after]])
            leaf[i] = none if rank is None else rank * n + i
        else:
            leaf[i] = none
        before = left[i]
        if before >= 0:
            rank = get(piece[before:after])
            leaf[before] = none if rank is None else rank * n + before
        for at in (gone, i, before) if inner else ():
            for below, above in inner:
                if at < 0:
                    break
                at //= FAN
                above[at] = min(below[at * FAN : at * FAN + FAN])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class _Memory(dict):
    """What `make` gives for a key, kept for short keys."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.make(key)
        if len(key) <= 64:
            self[key] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary.

    With the production pattern a text is first cut at single spaces (any other pattern is matched over whole texts). Where a space has white space on at most one side, and isn't the end of white space that ends the text, the
    pattern puts a boundary before it whatever stands around, so each stretch, with its leading space, is cut into pieces by itself, and a worker remembers the tokens of
    stretches. Texts with a space between two white characters, or with white space before a space at their end, and very long ones, are matched as a whole.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.decimal = {rank: str(rank) for rank in self.token}
        self.pattern = regex.compile(pattern)
        self.cuts = pattern == public_files()[1]
        self.pieces = _Memory(self._piece)
        self.stretches = _Memory(lambda stretch: self._stretch(" " + stretch))

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        return (self.ranks[raw],) if raw in self.ranks else tuple(merge(raw, self.ranks))

    def _stretch(self, stretch: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(stretch))))

    def runs(self, text: str) -> Iterator[list]:
        """The ids of a text, in lists of bounded length."""
        if not text:
            return
        if self.cuts and len(text) <= STREAM_CHARS and not WIDE.search(text):
            first, *rest = text.split(" ")
            yield [*(self._stretch(first) if first else ()), *chain.from_iterable(map(self.stretches.__getitem__, rest))]
            return
        matches = self.pattern.finditer(text)
        while run := [self.pieces[m.group()] for m in islice(matches, STREAM_PIECES)]:
            yield list(chain.from_iterable(run))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.runs(text)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def digests(self, text: str, keep: bool) -> tuple[int, str, str, list[int] | None]:
        """Number of tokens, digest of their decimal form, digest of the bytes that they decode to, and the tokens if asked for."""
        n, first, said, back, kept = 0, True, hashlib.sha256(), hashlib.sha256(), [] if keep else None
        for ids in self.runs(text):
            said.update(("" if first else ",").encode() + ",".join(map(self.decimal.__getitem__, ids)).encode())
            back.update(self.decode(ids))
            n += len(ids)
            first = False
            if keep:
                kept.extend(ids)
        return n, said.hexdigest(), back.hexdigest(), kept


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encodes and decodes every whole text; one row per row of docs, without a shuffle: doc_id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256.

    path: a file of base64 tokens and ranks that is installed on every machine. pattern: cuts a text into pieces, each of which is encoded
    separately, without special tokens. A null text is empty: no tokens, and the digests of no bytes. Ids may be null or repeated; other columns of
    docs are ignored; an empty table gives an empty one. A very long text is cut as a stream, and a very long piece costs n log n.
    """
    names = ["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                made = [own.digests(t or "", with_ids) for t in part.column(1).to_pylist()]
                n, said, back, ids = zip(*made, strict=True)
                columns = [part.column(0), pa.array(n, pa.int64()), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), pa.array(said), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    return small_batches(chosen).mapInArrow(run, "doc_id bigint, n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string")


def public_files() -> tuple[str, str]:
    """Path of the production vocabulary and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of documents, one row each, by the production vocabulary and pattern. Null and empty texts have 0 tokens and the digests of nothing; repeated rows and null ids get a row each."""
    return encode_texts(table(spark, sf_dir, "documents"), *public_files(), with_ids=False)
