"""Vectorised word handling on Arrow string columns, shared by the llm operators.

A batch of texts is one byte array with document bounds.  Words are found with
a 256-entry class table and hashed with one prefix sum, so there is no Python
work per word.  A-Z count as a-z.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
BASE = 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 20
#: Rows of a batch of whole texts on the way back to Spark, which holds a batch twice.
OUT_ROWS = 1000


def worker_cache(key: str, make: Callable[[], object]):
    """One object per Python worker process; it outlives the task that made it."""
    store = sys.modules.setdefault("quarry_llm_worker_cache", types.ModuleType("quarry_llm_worker_cache")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_class(kind: str) -> np.ndarray:
    """bool[256]: 'space' words are runs without space and \\t..\\r; 'alnum' words
    are runs of digits, ASCII letters and all bytes of non-ASCII characters;
    'letters' words are those without digits."""
    c = np.arange(256)
    if kind == "space":
        return ~((c == 0x20) | ((c >= 0x09) & (c <= 0x0D)))
    if kind == "alnum":
        return ((c >= 0x30) & (c <= 0x39)) | ((c >= 0x41) & (c <= 0x5A)) | ((c >= 0x61) & (c <= 0x7A)) | (c >= 0x80)
    if kind == "letters":
        return ((c >= 0x41) & (c <= 0x5A)) | ((c >= 0x61) & (c <= 0x7A)) | (c >= 0x80)
    raise ValueError(f"unknown word class {kind!r}")


def _byte_values() -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = worker_cache("powers", dict)
    if held.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            held[name] = np.cumprod(p)
        held["n"] = size
    return held["up"], held["down"]


def find_words(data: np.ndarray, bounds: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; words first[d]:first[d+1] are document d's."""
    is_word = worker_cache(f"class-{kind}", lambda: word_class(kind))[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = False, False
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    before[bounds[bounds < n]] = False
    after[bounds[bounds > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, A-Z as a-z."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    v = worker_cache("bytes", _byte_values)[data]
    v *= up[: len(data)]
    np.cumsum(v, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLDEN)


def hash_list(words: list[str], kind: str) -> np.ndarray:
    """Hashes of single words, as :func:`hash_words` gives them inside texts."""
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = find_words(data, np.array([0, len(data)]), kind)
    return hash_words(data, starts, ends)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, bounds) for runs of whole texts of about ``limit`` bytes; null is empty.

    A text longer than ``limit`` is a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, doc): every run of ``width`` words, or the whole sequence of a shorter, non-empty text."""
    n_words = np.diff(first)
    docs = np.arange(len(n_words))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc_of = np.repeat(docs, n_words)
    acc = words.copy()
    pad = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(1, width):
        acc = acc * U64(BASE) + pad[k : k + len(words)]
    whole = np.arange(len(words)) + width <= first[doc_of + 1]
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    out, owner = [mix64(acc[whole])], [doc_of[whole]]
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            at = first[short] + k
            inside = k < n_words[short]
            s = np.where(inside, s * U64(BASE) + pad[np.minimum(at, len(words))], s)
        out.append(mix64(s ^ (mix64(n_words[short].astype(np.uint64)) | U64(1))))
        owner.append(short)
    return np.concatenate(out), np.concatenate(owner)
