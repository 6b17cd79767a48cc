"""Language identification of mixed text by Viterbi over per-word scores.

Training counts, for every language label, the character trigrams of the words
(hashed to ``BUCKETS``) and the scripts of the letters, over all training
rows.  To label a text, each word's script ranges narrow the languages that
may have written it, its trigrams give a log-likelihood for each of those, and
Viterbi with a switching penalty joins the words into spans of one language.
A document's language is the one that most of its letters are given to, and
its score their share.

The model is BUCKETS x labels numbers (64k x 4 bytes a label) whatever the
corpus; counts are summed a partition at a time before the shuffle, so hot
sources need no care.  Texts are labelled one by one, whole.  A long text is
read in pieces cut between words and scored in blocks of words, so what it
takes grows with its words (some 30 bytes each and 2 bytes a letter); its path
is found in blocks that are walked side by side.

Defined cases: texts that are null, empty or without a letter (general
category L; combining marks belong to the word of the letter before them but
are none) get ``und`` and score 0; words without letters are part of no span; with no training rows
every text with letters is ``und`` too; ties go to the first language by name;
ids are only passed on; extra columns are left alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import ship

BUCKETS = 1 << 16
#: Cost in nats of a change of language between two words.
PENALTY = 6.0
#: Pseudo-count of each trigram bucket.
SMOOTH = 0.05
#: A label is a candidate for a script if this share of its letters is in it.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Characters that are cut into words at once, and words that are scored at once.
CHUNK, BLOCK = 1_000_000, 1 << 16
#: Words from which on a text's path is found in blocks; the labels are the same.
LONG = 4_000
#: First and last code points of scripts, in one place.
SCRIPTS = {
    "Latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x0530, 0x058F)],
    "Hebrew": [(0x0590, 0x05FF)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
OTHER = len(SCRIPTS)


@cache
def _letters() -> np.ndarray:
    """By code point: the script's index for letters and marks, -1 for anything else."""
    table = np.full(0x110000, -1, dtype=np.int8)
    for point in range(0x110000):
        if unicodedata.category(chr(point))[0] in "LM":
            table[point] = OTHER
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            part = table[first : last + 1]
            part[part == OTHER] = k
    return table


@cache
def _marks() -> np.ndarray:
    """By code point: whether it is a combining mark."""
    table = np.zeros(0x110000, dtype=bool)
    for point in range(0x110000):
        table[point] = unicodedata.category(chr(point))[0] == "M"
    return table


@dataclass
class Words:
    """The words (runs of letters and marks with a letter at least) of some texts, in order.

    ``sizes`` counts the letters and marks of a word, ``letters`` the letters,
    ``first`` is the place of its first trigram.
    """

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    trigram: np.ndarray
    first: np.ndarray
    sizes: np.ndarray
    letters: np.ndarray


def _pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """(parts, the text of each, where it begins there) of about CHUNK characters, cut between words."""
    parts: list[str] = []
    of: list[int] = []
    at: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        begin = 0
        gaps = _gaps(text) if len(text) > CHUNK else None
        while True:
            end = min(begin + CHUNK, len(text))
            if end < len(text):  # back to the end of a word, or on if one word fills the piece
                before = int(np.searchsorted(gaps, end, "right")) - 1
                if before >= 0 and gaps[before] > begin:
                    end = int(gaps[before])
                else:
                    end = int(gaps[before + 1]) if before + 1 < len(gaps) else len(text)
            parts.append(text[begin:end])
            of.append(k)
            at.append(begin)
            size += end - begin
            if size >= CHUNK:
                yield parts, of, at
                parts, of, at, size = [], [], [], 0
            begin = end
            if begin >= len(text):
                break
    if parts:
        yield parts, of, at


def _gaps(text: str) -> np.ndarray:
    """Where a text has characters that are part of no word."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.flatnonzero(_letters()[points] < 0)


def words_of(texts: list[str]) -> Words:
    found = [_words_of(*p) for p in _pieces([t.lower() for t in texts])]
    if len(found) == 1:
        return found[0]
    if not found:
        return _words_of([""], [0], [0])
    column = lambda name: np.concatenate([getattr(w, name) for w in found])
    sizes = column("sizes")
    return Words(column("doc"), column("start"), column("end"), column("script"), column("trigram"), np.cumsum(sizes) - sizes, sizes, column("letters"))


def _words_of(parts: list[str], of: list[int], at: list[int]) -> Words:
    lengths = np.array([len(t) for t in parts], dtype=np.int64)
    points = np.frombuffer("\n".join(parts).encode("utf-32-le", "replace"), dtype=np.uint32)
    script = _letters()[points]
    inside = script >= 0
    before = np.r_[False, inside[:-1]]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    if len(end) < len(start):
        end = np.r_[end, len(points)]
    marks = np.r_[0, np.cumsum(_marks()[points])]
    letters = end - start - (marks[end] - marks[start])
    real = letters > 0
    if not real.all():
        for a, b in zip(start[~real], end[~real], strict=True):
            inside[a:b] = False
        start, end, letters = start[real], end[real], letters[real]
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    where = np.flatnonzero(inside)
    here = np.where(inside, points, 0).astype(np.uint32)
    prior, after = np.r_[np.uint32(0), here[:-1]], np.r_[here[1:], np.uint32(0)]
    h = (prior[where] * np.uint32(0x9E3779B1)) ^ (here[where] * np.uint32(0x85EBCA77)) ^ (after[where] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(16)
    part = np.searchsorted(begins, start, "right") - 1
    sizes = end - start
    move = (np.array(at, dtype=np.int64) - begins)[part]
    return Words(np.array(of, dtype=np.int64)[part], start + move, end + move, script[start], (h % BUCKETS).astype(np.uint16), np.cumsum(sizes) - sizes, sizes, letters)


@dataclass
class Model:
    languages: list[str]
    #: log-probabilities, BUCKETS x languages
    scores: np.ndarray
    #: scripts x languages: whether the language is a candidate
    candidates: np.ndarray


def _text_chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about CHUNK characters."""
    row, held, size = 0, [], 0
    for k, x in enumerate(column):
        text = x.as_py() or ""
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield row, held
            row, held, size = k + 1, [], 0
    if held:
        yield row, held


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trigrams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array(batch.column(0).to_pylist(), dtype=object)
        for row, texts in _text_chunks(batch.column(1)):
            w = words_of(texts)
            of = labels[row : row + len(texts)]
            for language in set(of):
                mine = (of == language)[w.doc]
                got = np.bincount(w.trigram[np.repeat(mine, w.sizes)], minlength=BUCKETS)
                trigrams[language] = trigrams.get(language, 0) + got
                got = np.bincount(w.script[mine], weights=w.letters[mine], minlength=OTHER + 1).astype(np.int64)
                scripts[language] = scripts.get(language, 0) + got
    for language, n in trigrams.items():
        n = np.r_[n, scripts[language]]
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], names=["lang", "bucket", "n"])


def train(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang") -> Model:
    """Counts over all rows with a label and a text; one vector a label comes to the driver."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(label_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    counted = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    languages = sorted(set(found.column("lang").to_pylist()))
    n = np.zeros((BUCKETS + OTHER + 1, len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    n[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    used = max(int((grams.sum(1) > 0).sum()), 1)
    scores = np.log((grams + SMOOTH) / (grams.sum(0) + SMOOTH * used)).astype(np.float32)
    candidates = scripts >= SCRIPT_SHARE * scripts.sum(0)
    candidates &= scripts > 0
    return Model(languages, scores, candidates)


def _step(score: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores after one more word, whether the best way to each language comes from another one, from which) of many lanes."""
    top = score.argmax(1)
    jump = score[np.arange(len(score)), top][:, None] - PENALTY
    moved = jump > score
    return np.where(moved, jump, score) + fit, moved, top


def _short_paths(fit: np.ndarray, first: np.ndarray, size: np.ndarray, path: np.ndarray) -> None:
    """Fills the best paths of many texts, all of them a word at a time."""
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best = fit[first].astype(np.float64)
    back = np.zeros(fit.shape, dtype=bool)  # whether the best way to a word's language comes from another one
    source = np.zeros(len(fit), dtype=np.int16)
    live = len(size)
    for t in range(1, int(size[0])):
        while size[live - 1] <= t:
            live -= 1
        at = first[:live] + t
        best[:live], back[at], source[at] = _step(best[:live], fit[at])
    state = best.argmax(1)
    live = 0
    for t in range(int(size[0]) - 1, -1, -1):
        while live < len(size) and size[live] > t:
            live += 1
        at = first[:live] + t
        path[at] = state[:live]
        state[:live] = np.where(back[at, state[:live]], source[at], state[:live])


def _long_path(fit: np.ndarray) -> np.ndarray:
    """The best path of one long text, its blocks side by side.

    A block maps the scores before it to those after it by the best way from
    every language to every other, and blocks are joined in order by these
    maps; from the scores at its begin, each block then takes the same steps as
    a walk over the whole text, and the way back is found likewise.
    """
    n, k = fit.shape
    length = max(int(np.sqrt(n)), 1)
    blocks = -(-n // length)
    laid = np.zeros((blocks * length, k), np.float32)
    laid[:n] = fit  # a word without a preference changes no path at the end
    laid = laid.reshape(blocks, length, k)
    maps = np.full((blocks, k, k), -np.inf)
    maps[:, np.arange(k), np.arange(k)] = 0.0
    maps = maps.reshape(blocks * k, k)
    for t in range(length):
        maps = _step(maps, np.repeat(laid[:, t], k, axis=0))[0]
    maps = maps.reshape(blocks, k, k)
    begins = np.empty((blocks, k))
    begins[0] = laid[0, 0]
    before = _through(laid[0], begins[0])
    for b in range(1, blocks):
        begins[b] = before
        before = (before[:, None] + maps[b]).max(0)
    back, source = np.zeros(laid.shape, dtype=bool), np.zeros((blocks, length), dtype=np.int16)
    best = begins
    for t in range(length):
        if t == 0:  # the text's first word follows none
            later, back[1:, 0], source[1:, 0] = _step(best[1:], laid[1:, 0])
            best = np.vstack([best[:1], later])
        else:
            best, back[:, t], source[:, t] = _step(best, laid[:, t])
    lanes, every = np.arange(blocks), np.tile(np.arange(k), (blocks, 1))
    for t in range(length - 1, -1, -1):  # from each language after the block to the one before it
        every = np.where(np.take_along_axis(back[:, t], every, 1), source[:, t, None], every)
    state = np.empty(blocks, dtype=np.int64)
    state[-1] = best[-1].argmax()
    for b in range(blocks - 1, 0, -1):
        state[b - 1] = every[b, state[b]]
    path = np.empty((blocks, length), dtype=np.int64)
    for t in range(length - 1, -1, -1):
        path[:, t] = state
        state = np.where(back[lanes, t, state], source[:, t], state)
    return path.reshape(-1)[:n]


def _through(fit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The scores after the first block, whose first word has the scores ``first``."""
    best = first[None].astype(np.float64)
    for t in range(1, len(fit)):
        best = _step(best, fit[t][None])[0]
    return best[0]


def label_words(model: Model, w: Words) -> np.ndarray:
    """The index of each word's language on the best path of its document."""
    n, k = len(w.doc), len(model.languages)
    if not n or not k:
        return np.full(n, -1)
    fit = np.empty((n, k), np.float32)
    for at in range(0, n, BLOCK):
        first = w.first[at : at + BLOCK]
        until = w.first[at + BLOCK] if at + BLOCK < n else len(w.trigram)
        fit[at : at + BLOCK] = np.add.reduceat(model.scores[w.trigram[first[0] : until]], first - first[0], axis=0)
    allowed = model.candidates[w.script]
    allowed[~allowed.any(1)] = True  # a script that no label has: all stay in
    fit[~allowed] = -1e9
    path = np.zeros(n, dtype=np.int64)
    docs, first, size = np.unique(w.doc, return_index=True, return_counts=True)
    for k in np.flatnonzero(size > LONG):
        path[first[k] : first[k] + size[k]] = _long_path(fit[first[k] : first[k] + size[k]])
    short = size <= LONG
    if short.any():
        _short_paths(fit, first[short], size[short], path)
    return path


def _kept(model, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for row, texts in _text_chunks(batch.column(text_at)):
                w = words_of(texts)
                path = label_words(m, w)
                share = np.zeros((len(texts), max(len(m.languages), 1)))
                if m.languages:
                    np.add.at(share, (w.doc, path), w.letters)
                total = share.sum(1)
                yield batch.slice(row, len(texts)).filter(pa.array((total > 0) & (share.max(1) >= least * total)))

    return run


def _labelled(model, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = pa.array([*m.languages, UNKNOWN])
        for batch in batches:
            for row, texts in _text_chunks(batch.column(1)):
                w = words_of(texts)
                path = label_words(m, w)
                k = len(m.languages)
                share = np.zeros((len(texts), max(k, 1)))
                if k:
                    np.add.at(share, (w.doc, path), w.letters)
                total = share.sum(1)
                lang = np.where(total > 0, share.argmax(1), k)
                score = np.where(total > 0, share.max(1) / np.maximum(total, 1), 0.0)
                change = np.r_[True, (w.doc[1:] != w.doc[:-1]) | (path[1:] != path[:-1])] if len(w.doc) and k else np.zeros(0, bool)
                begin = np.flatnonzero(change)
                spans = np.bincount(w.doc[begin], minlength=len(texts)) if k else np.zeros(len(texts), np.int64)
                out = [batch.column(0).slice(row, len(texts)), names.take(pa.array(lang)), pa.array(score), pa.array(spans.astype(np.int64))]
                cols = ["id", "lang_pred", "score", "n_spans"]
                if with_spans:
                    last = np.r_[begin[1:], len(w.doc)] - 1 if len(begin) else begin
                    fields = {"lang": names.take(pa.array(path[begin])), "start": pa.array(w.start[begin]), "end": pa.array(w.end[last])}
                    each = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
                    out.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(spans)].astype(np.int32)), each))
                    cols.append("spans")
                yield pa.RecordBatch.from_arrays(out, names=cols)

    return run


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """One row a document: id, lang_pred, score, n_spans and, if asked for, spans of (lang, start, end) in lower-cased code points."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, lang_pred string, score double, n_spans bigint" + ", spans array<struct<lang:string,start:bigint,end:bigint>>" * spans
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(_labelled(shared, spans), schema)


def select(docs: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents of which at least that share of the letters is in one language; all columns as they were."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_kept(shared, docs.columns.index(text_col), least), docs.schema)
