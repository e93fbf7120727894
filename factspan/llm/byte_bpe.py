"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is encoded by the library in one call where it is short.  A long one is cut first, at places where two matches
of the splitting pattern always meet, whatever stands around them: ahead of white space that follows another character,
between a letter and a digit, and ahead of or behind punctuation that can be no contraction.  Only a run of white space
needs more care, since its last character may belong to the match after it and the library's matcher gives up on runs of
some hundred thousand characters: such a run is encoded as the single match it is.  Hence ids are those of the uncut
text, and memory follows the longest single match.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import slices, string_buffer

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Texts of more characters are cut in parts of about as many.
PART = 1 << 16

# White space as the pattern's \s has it, and characters that are letters, digits and punctuation in every
# version of Unicode.  The apostrophe is left out of the last, for contractions.
_SPACE = r"\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_LETTER = r"A-Za-zÀ-ÖØ-öа-яА-Яぁ-ゖァ-ヺ一-龥가-힣"
_DIGIT = r"0-9"
_OTHER = r"!-&(-/:-@\[-`{-~。、，！？；："

_CUT = re.compile(
    rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_LETTER}])(?=[{_DIGIT}{_OTHER}])|(?<=[{_DIGIT}])(?=[{_LETTER}{_OTHER}])|(?<=[{_OTHER}])(?=[{_LETTER}{_DIGIT}])")
_RUN = re.compile(rf"[{_SPACE}]+")


@functools.cache
def encoders(ranks: str, pattern: str) -> tuple:
    """The encoding of the rank file, and one that takes any text as a single match."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}
    return (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}),
            tiktoken.Encoding("single", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={}))


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """``text`` in parts that are encoded alone, and whether a part is a single match: a run of white space longer than
    ``size``, without its last character where another follows it."""
    at, n = 0, len(text)
    while n - at > size:
        cut = _CUT.search(text, at + size)
        end = cut.start() if cut else n
        if end - at > size:  # no part holds a long run: it starts a part of its own, since a cut is ahead of every run
            for run in _RUN.finditer(text, at, end):
                if run.end() - run.start() > size:
                    if run.start() > at:
                        yield text[at:run.start()], False
                    stop = run.end() if run.end() == n else run.end() - 1
                    yield text[run.start():stop], True
                    at = stop
        if end > at:
            yield text[at:end], False
        at = end
    if n > at:
        yield text[at:], False


def encode(text: str, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, size: int = PART) -> np.ndarray:
    """The ids of ``text``, as the library gives them for the whole text, without special tokens."""
    split, single = encoders(ranks, pattern)
    if len(text) <= size:
        return np.array(split.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array((single if alone else split).encode_ordinary(p), dtype="<u4") for p, alone in parts(text, size)])


def decode(ids: np.ndarray, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, size: int = PART) -> bytes:
    """The bytes of ``ids``; they need not be whole characters."""
    split, _ = encoders(ranks, pattern)
    return b"".join(split.decode_bytes(ids[k:k + size].tolist()) for k in range(0, len(ids), size))


def encoded(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for every row of ``docs(doc_id, text, ...)``: ``ids`` as little-endian unsigned 32-bit
    numbers.  Other columns are not read.

    A null text counts as empty and has no ids; bytes that are no UTF-8 count as U+FFFD.  Repeated rows and null
    ids give rows of their own; an empty table gives an empty result.  ``ranks`` must be readable on every executor.
    """
    def run(batches):
        for b in batches:
            buf, offsets = string_buffer(b.column(1))
            for lo, hi in slices(offsets):
                data = buf[offsets[lo]:offsets[hi]].tobytes()
                ends = (offsets[lo:hi + 1] - offsets[lo]).tolist()
                ids = [encode(data[x:y].decode("utf-8", "replace"), ranks, pattern) for x, y in zip(ends, ends[1:])]
                yield pa.record_batch([b.column(0).slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64()),
                                       pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decoded(rows: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``rows`` of ``encoded`` with ``decoded``: the bytes of the ids (null ids: none)."""
    def run(batches):
        for b in batches:
            buf, offsets = string_buffer(b.column(2))
            for lo, hi in slices(offsets):
                data = [decode(np.frombuffer(buf[x:y].tobytes(), "<u4"), ranks, pattern) for x, y in zip(offsets[lo:hi].tolist(), offsets[lo + 1:hi + 1].tolist())]
                yield pa.record_batch([*(c.slice(lo, hi - lo) for c in b.columns), pa.array(data, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = rows.select("doc_id", "n_tokens", "ids")
    return rows.mapInArrow(run, rows.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",decoded:binary")
