"""Encoding texts with a public byte-level BPE tokenizer by a tree of joins.

A text is halved recursively down to leaves, every leaf is encoded by the same
encoder, and neighbours are joined bottom-up; a text of one leaf is a tree of one
node. The join is associative: it looks for a certain cut near the seam in either
part, in windows that grow until there is one, re-encodes what lies between the
two cuts and keeps all tokens outside. Decoding concatenates the bytes of the
pieces in order.

Why the tokens outside are stable: the byte-level pattern cuts a text from left to
right into words, and merges never cross cuts. Its alternatives are a contraction,
letters, numbers or other signs, each of the last three with at most one space
before, and white space. So no word holds (a) white space behind another
character, nor (b) anything but letters behind a letter. A cut between such two
characters is made whatever the rest of the text is: the tokens before it and
behind it are those of the two stretches encoded alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 4096
WINDOW_CHARS = 64
#: characters that one Python call handles at once
SLICE_CHARS = 4_000_000

# certain cuts; letters, signs and blanks whose class is the same in every version of Unicode
_LETTER = "A-Za-z\u0430-\u044f\u0410-\u042f\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5"
_CUT = re.compile(f"(?<=[^\\s\x00-\x1f\x85])(?=[ \\n\\r\\t])|(?<=[{_LETTER}])(?=[0-9.,;:!?()\u3001\u3002\uff0c\uff01\uff1a\uff1b\uff1f])")


@lru_cache(maxsize=4)
def _encoder(path: str | None):
    """The encoder of a file of ranks (base64 bytes and rank on each line)."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def _encode(encoder, text: str) -> list[int]:
    return encoder.encode_ordinary(text)


@dataclass
class Part:
    """An encoded stretch: characters start to end of a text, and its ids."""

    start: int
    end: int
    ids: list[int]


def _last_cut(text: str, start: int, end: int, window: int) -> int:
    """The last certain cut within (start, end), else start."""
    while True:
        lo = max(start, end - window)
        cuts = [m.start() for m in _CUT.finditer(text, lo, end) if lo < m.start()]
        if cuts or lo == start:
            return cuts[-1] if cuts else start
        window *= 2


def _first_cut(text: str, start: int, end: int, window: int) -> int:
    """The first certain cut within (start, end), else end."""
    while True:
        hi = min(end, start + window)
        at = next((m.start() for m in _CUT.finditer(text, start, hi) if start < m.start()), None)
        if at is not None or hi == end:
            return end if at is None else at
        window *= 2


def join(encoder, text: str, a: Part, b: Part, window: int = WINDOW_CHARS) -> Part:
    """The encoding of neighbouring parts from theirs."""
    if a.start == a.end or b.start == b.end:
        return b if a.start == a.end else a
    lo, hi = _last_cut(text, a.start, a.end, window), _first_cut(text, b.start, b.end, window)
    kept = len(a.ids) - len(_encode(encoder, text[lo : a.end]))
    dropped = len(_encode(encoder, text[b.start : hi]))
    return Part(a.start, b.end, a.ids[:kept] + _encode(encoder, text[lo:hi]) + b.ids[dropped:])


def _reduce(encoder, text: str, start: int, end: int, leaf: int) -> Part:
    """Halves a stretch down to leaves, encodes them and joins them up the tree."""
    if end - start <= leaf:
        return Part(start, end, _encode(encoder, text[start:end]))
    mid = (start + end) // 2
    return join(encoder, text, _reduce(encoder, text, start, mid, leaf), _reduce(encoder, text, mid, end, leaf))


def encode_all(texts: Iterable[str | None], ranks_path: str | None = None, leaf: int = LEAF_CHARS) -> list[list[int]]:
    """Token ids of each text, without special tokens; an empty list for an empty
    and for a null text."""
    encoder = _encoder(ranks_path)
    return [_reduce(encoder, t, 0, len(t), leaf).ids if t else [] for t in texts]


def decode(parts: Iterable[Iterable[int]], ranks_path: str | None = None) -> str:
    """The text of consecutive pieces of ids: byte strings concatenate."""
    encoder = _encoder(ranks_path)
    return b"".join(encoder.decode_bytes(list(p)) for p in parts).decode()


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > SLICE_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def encode_texts(df: DataFrame, id_col: str, text_col: str, ranks_path: str | None = None, leaf: int = LEAF_CHARS, counts_only: bool = False) -> DataFrame:
    """One row per row of ``df``: id and ``ids`` (array<int>), or ``n_tokens``
    with ``counts_only``. Null and empty texts give an empty list, repeated rows
    and ids come out as often as they go in, other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _slices([len(t or "") for t in texts]):
                ids = encode_all(texts[lo:hi], ranks_path, leaf)
                n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                if counts_only:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n)], names=["id", "n_tokens"])
                    continue
                flat = np.fromiter((x for y in ids for x in y), dtype=np.int32, count=int(n.sum()))
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["id", "ids"])

    source = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, "id bigint, n_tokens bigint" if counts_only else "id bigint, ids array<int>")
    return out.withColumnRenamed("id", id_col)
