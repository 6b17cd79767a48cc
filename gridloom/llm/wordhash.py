"""Words of whole texts as 64-bit hashes, straight from Arrow's UTF-8 buffers.

A batch is cut into chunks of whole documents of about ``CHUNK`` bytes, and
hashing goes in blocks of that size cut between words, so memory is bounded by
the longest word and 8 bytes a word of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1_000_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift-multiply, the constants of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(is_word) -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte is part of a word, its 64-bit value); A-Z have the values of a-z."""
    member = np.array([bool(is_word(b)) for b in range(256)])
    folded = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint64)
    return member, mix64((folded + np.uint64(1)) * _GOLD)


#: Runs of anything but ASCII white space.
SPACED = byte_table(lambda b: b not in (32, 9, 10, 11, 12, 13))
#: Runs of ASCII letters and digits and of non-ASCII bytes.
LETTERS = byte_table(lambda b: b >= 128 or chr(b).isalnum())


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole documents; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    if not len(texts):
        return
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1, row + 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _word_end(raw: np.ndarray, member: np.ndarray, at: int, stop: int) -> int:
    """The first separator from ``at`` on, or ``stop`` if there is none before it."""
    while at < stop:
        gaps = np.flatnonzero(~member[raw[at : min(at + CHUNK, stop)]])
        if len(gaps):
            return at + int(gaps[0])
        at = min(at + CHUNK, stop)
    return stop


def hash_words(raw: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], stem: int = 0) -> tuple[np.ndarray, ...]:
    """(hashes of all words, index of each document's first word, with the total at the end).

    With ``stem``, also the hashes of the words' first so many bytes.
    """
    member, value = table
    found, stems, counts = [], [], np.zeros(len(offsets), dtype=np.int64)
    begin, edges = 0, offsets[1:-1]
    while begin < len(raw):
        end = min(begin + CHUNK, len(raw))
        if end < len(raw):  # cut where no word is cut: after a separator, or at a document's edge
            gaps = np.flatnonzero(~member[raw[begin:end]])
            cut = edges[np.searchsorted(edges, begin, "right") : np.searchsorted(edges, end, "right")]
            if len(gaps) or len(cut):
                end = max(begin + int(gaps[-1]) + 1 if len(gaps) else 0, int(cut[-1]) if len(cut) else 0)
            else:  # one word fills the block: go on to its end
                end = _word_end(raw, member, end, int(edges[k]) if (k := np.searchsorted(edges, end)) < len(edges) else len(raw))
        part = raw[begin:end]
        inside = member[part]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        own = edges[(edges > begin) & (edges < end)] - begin
        start[own] = inside[own]
        first = np.flatnonzero(start)
        if len(first):
            word = np.cumsum(start) - 1
            place = np.arange(len(part)) - first[np.maximum(word, 0)]
            place[~inside] = 0
            powers = np.cumprod(np.full(int(place.max()) + 1, 0xD6E8FEB86659FD93, dtype=np.uint64))
            terms = value[part] * powers[place]
            terms[~inside] = 0
            found.append(mix64(np.add.reduceat(terms, first)))
            if stem:
                stems.append(mix64(np.add.reduceat(np.where(place < stem, terms, np.uint64(0)), first)))
            docs = np.searchsorted(offsets, first + begin, "right") - 1
            counts[1:] += np.bincount(docs, minlength=len(offsets) - 1)
        begin = end
    joined = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (found, stems)]
    return (joined[0], np.cumsum(counts), joined[1]) if stem else (joined[0], np.cumsum(counts))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every ``size`` consecutive words of one sequence; of the whole if it is shorter."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix64(out * _GOLD + words[k : k + len(out)])
    return out
