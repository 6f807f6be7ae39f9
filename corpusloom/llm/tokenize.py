"""Encoding with a public tokenizer (problem 8) by tree concatenation.

A text above LEAF characters is halved at any character down to leaves, which are encoded in parallel threads; neighbours
are joined pairwise. A window around each join is encoded afresh, pre-tokenizer included, and grows until both sides agree:
its edges must be borders of pieces whatever surrounds them. That holds between a character that is no white space and
white space behind it, since no alternative of the pattern runs from the one into the other, none looks behind, and what
looks ahead sees the same there as at the end of a text. Outside the window the tokens of both sides are those of the whole.

A window may hold a piece longer than LONG bytes (an unbroken string): merges never leave a piece, so it is joined by the
same tree over its bytes. There agreement is tested token by token: a token sequence is the encoding of its bytes if and
only if every two neighbouring tokens encode to themselves; within the left side, the window and the right side that holds
already, so the two pairs at the window's edges decide.

Defined results: null text gives null ids, empty text an empty list; other columns are passed over; repeated rows give
repeated rows unless the caller drops them.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corpusloom.session import spread

#: Where the vocabulary files lie; a parameter of every function that reads one.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes above which one piece is joined by halves of its own, characters of a leaf, of the first window on either side.
LONG, LEAF, WINDOW = 4096, 2048, 64
#: Threads that encode the leaves of a text.
THREADS = 2
#: Pre-tokenizer pattern of the vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts a batch handed to the tokenizer holds at most, in characters.
BATCH_CHARS = 8_000_000

_loaded: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a .tiktoken file, loaded once a process."""
    if path not in _loaded:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        # merges within given bytes are not in the library's public interface
        if not callable(getattr(getattr(enc, "_core_bpe", None), "encode_single_piece", None)):
            raise RuntimeError(f"tiktoken {getattr(tiktoken, '__version__', '?')} does not encode single pieces; another version is needed")
        _loaded[path] = enc
    return _loaded[path]


_pools: dict[int, ThreadPoolExecutor] = {}


def pool() -> ThreadPoolExecutor:
    """The threads of this process (a forked worker makes its own)."""
    if os.getpid() not in _pools:
        _pools[os.getpid()] = ThreadPoolExecutor(THREADS)
    return _pools[os.getpid()]


def stable(enc, left: int, right: int) -> bool:
    """Whether two neighbouring tokens stay as they are when their bytes are encoded together."""
    return enc._core_bpe.encode_single_piece(enc.decode_bytes([left, right])) == [left, right]


def join_encoded(enc, left: list[int], right: list[int], window: int = 4) -> list[int]:
    """The encoding of the concatenation of two encoded byte strings of one piece."""
    if not left or not right:
        return left + right
    while True:
        a, b = left[-window:], right[:window]
        fresh = enc._core_bpe.encode_single_piece(enc.decode_bytes(a + b))
        at_start, at_end = len(a) == len(left), len(b) == len(right)
        if (at_start or stable(enc, left[-window - 1], fresh[0])) and (at_end or stable(enc, fresh[-1], right[window])):
            return left[: len(left) - len(a)] + fresh + right[len(b) :]
        window *= 2


def encode_piece(enc, data: bytes, leaf: int = LEAF) -> list[int]:
    """Tree concatenation over one piece."""
    if len(data) <= leaf:
        return enc._core_bpe.encode_single_piece(data)
    parts = list(pool().map(enc._core_bpe.encode_single_piece, [data[i : i + leaf] for i in range(0, len(data), leaf)]))
    while len(parts) > 1:
        parts = [join_encoded(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


_border = re.compile(r"(?<=\S)(?=\s)")


def plain(enc, text: str) -> np.ndarray:
    """The library's encoding of a leaf."""
    return enc.encode_to_numpy(text, allowed_special=set(), disallowed_special=())


def whole(enc, text: str) -> np.ndarray:
    """Token ids of a window; pieces above LONG bytes by their own tree."""
    if len(text) <= LONG // 4 or not _long_run.search(text):
        return plain(enc, text)
    import regex

    out: list[int] = []
    for m in regex.finditer(PATTERN, text):
        data = m.group().encode()
        out += encode_piece(enc, data) if len(data) > LONG else enc._core_bpe.encode_single_piece(data)
    return np.asarray(out, dtype=np.uint32)


#: A piece may exceed LONG bytes only where a run without white space, or of white space, has LONG / 4 characters.
_long_run = re.compile(r"\S{%d}|\s{%d}" % (LONG // 4, LONG // 4))


def window_edges(text: str, a: int, mid: int, b: int, window: int = WINDOW) -> tuple[int, int]:
    """The edges of the window around MID in text[a:b]: the nearest sure borders on both sides, or the ends."""
    reach, lo, hi = window, a, b
    while True:  # the left edge
        found = [m.start() for m in _border.finditer(text, max(a, mid - reach), mid)]
        found = [i for i in found if a < i < mid and not text[i - 1].isspace() and text[i].isspace()]
        if found:
            lo = found[-1]
            break
        if mid - reach <= a:
            break
        reach *= 2
    reach = window
    while True:
        m = next((m for m in _border.finditer(text, mid, min(b, mid + reach)) if mid < m.start() < b), None)
        if m:
            hi = m.start()
            break
        if mid + reach >= b:
            break
        reach *= 2
    return lo, hi


def tokens_after(enc, ids: np.ndarray, text: str) -> int:
    """How many tokens at the end of IDS spell TEXT."""
    left, k = len(text.encode()), 0
    while left > 0:
        k += 1
        left -= len(enc.decode_single_token_bytes(int(ids[len(ids) - k])))
    if left:
        raise AssertionError("a window's edge is no border of tokens")
    return k


def tokens_before(enc, ids: np.ndarray, text: str) -> int:
    """How many tokens at the start of IDS spell TEXT."""
    left, k = len(text.encode()), 0
    while left > 0:
        left -= len(enc.decode_single_token_bytes(int(ids[k])))
        k += 1
    if left:
        raise AssertionError("a window's edge is no border of tokens")
    return k


def join_texts(enc, text: str, left: tuple[int, int, np.ndarray], right: tuple[int, int, np.ndarray]) -> tuple[int, int, np.ndarray]:
    """Two encoded neighbours (start, end, ids) of TEXT as one."""
    (a, mid, x), (_, b, y) = left, right
    lo, hi = window_edges(text, a, mid, b)
    fresh = whole(enc, text[lo:hi])
    head = x[: len(x) - tokens_after(enc, x, text[lo:mid])] if lo > a else x[:0]
    tail = y[tokens_before(enc, y, text[mid:hi]) :] if hi < b else y[:0]
    return a, b, np.concatenate([head, fresh, tail])


def encode(enc, text: str, leaf: int = LEAF) -> np.ndarray:
    """Token ids of one text by tree concatenation."""
    if len(text) <= leaf:
        return plain(enc, text)
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # lone surrogates become one sign, as the library has it
    count = 1 << (-(-len(text) // leaf) - 1).bit_length()
    cuts = [len(text) * i // count for i in range(count + 1)]
    parts = list(pool().map(lambda s: (*s, plain(enc, text[s[0] : s[1]])), zip(cuts, cuts[1:])))
    while len(parts) > 1:
        parts = [join_texts(enc, text, parts[i], parts[i + 1]) for i in range(0, len(parts), 2)]
    return parts[0][2]


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut where their texts exceed CHARS bytes, so that a worker's memory stays bounded."""
    for batch in batches:
        ends = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).cumsum()
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right"))
            stop = max(stop, at + 1)
            yield batch.slice(at, stop - at)
            at = stop


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """KEY and ids (array<int>) of every row."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in text_slices(batches):
            texts = batch.column(1).to_pylist()
            found = [None if x is None else encode(enc, x) for x in texts]
            ends = np.cumsum([0] + [0 if x is None else len(x) for x in found], dtype=np.int32)
            flat = np.concatenate([x for x in found if x is not None] or [np.zeros(0, np.uint32)]).astype(np.int32)
            nulls = np.array([x is None for x in found] + [False])
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=nulls), pa.array(flat)) if nulls.any() else pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """KEY and tokens (0 for null and empty texts)."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in text_slices(batches):
            sizes = [0 if not x else len(encode(enc, x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], names=[key, "tokens"])

    return spread(docs.select(key, text)).mapInArrow(run, f"`{key}` {kind}, tokens int")


def decoded(ids: DataFrame, key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """KEY and the text that ids (array<int>) spell; null for null."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)
    kind = ids.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else enc.decode_bytes(x).decode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")
