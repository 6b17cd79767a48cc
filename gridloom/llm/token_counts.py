"""Token counts by a compiled finite-state transducer of a BPE model.

A byte-pair encoding is a deterministic transducer over characters: what
follows depends only on the longest suffix that can still become part of a
piece and, for each position inside it, on the last token before it.  A
transition emits the change in the number of tokens.  States and transitions
are compiled on demand and kept.

Where a space follows something else, and at a line's end, the transducer is
back in its start state.  So a unit (a run of spaces with the word after it, or
a line's end) maps every state that can come before it to the same number of
tokens.  The units of a batch are cut out of Arrow's UTF-8 buffer, told apart
by Arrow's dictionary encoding, and each distinct one is read by the transducer
once; the state maps of all units then compose by a prefix scan, which for
constant maps is a running sum.

A unit of more than ``CHUNK`` characters (text without spaces) is cut into
chunks.  A chunk's state map reads on from any incoming state until that run
meets the run from the start state, usually after a few characters; from there
on the two are one.  State maps are associative and compose in a logarithmic
number of rounds, so time and memory grow with the text and no faster.

Counts are exact for models whose pieces hold no space after another
character, with no normalisation and byte fallback; other models are refused.

Rows are counted one by one: no shuffle and no key.  Defined cases: null and
empty texts have no tokens; ids are only passed on, so repeated rows and null
ids are fine; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.tables import ship

SPACE = "▁"
#: Characters of a long unit's chunk, and how many of its first states a state map keeps.
CHUNK, MEET = 1 << 12, 64
#: Kept states, and kept characters of units and heads of units; beyond these they are compiled anew.
STATES, KEPT = 400_000, 8_000_000
#: Characters of a unit that are read at once where they were read before; longer units than ``SHORT`` bytes are not kept.
HEAD, SHORT = 7, 64
#: Bytes in which units are cut out.
BLOCK = 1 << 22
LIMIT = 4096


def read_model(path: str) -> dict[str, float]:
    """The pieces of a SentencePiece BPE model with their scores; refuses what the transducer can't follow."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(Path(path).read_bytes())
    trained, norm = model.trainer_spec, model.normalizer_spec
    kinds = pb.ModelProto.SentencePiece
    pieces = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    odd = [p.piece for p in model.pieces if p.type in (kinds.USER_DEFINED, kinds.UNUSED)]
    spaced = [p for p in pieces if SPACE in p.lstrip(SPACE)]
    if trained.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not trained.byte_fallback:
        raise ValueError("only plain byte-fallback BPE models without normalisation are supported")
    if odd or spaced or trained.treat_whitespace_as_suffix or any("\n" in p for p in pieces):
        raise ValueError("the model has pieces that cross words")
    return pieces


_NEVER = float("-inf")


class Transducer:
    """Compiled on demand from the pieces of a model."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.paths = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.histories: dict[str, tuple] = {}
        self.shapes: dict[str, tuple] = {}
        self.units: dict[bytes, int] = {}
        self.held = self.pairs = 0
        #: by token: by the token before it whether the two can stand side by side
        self.allowed: dict[str, dict] = {}
        self._clear()

    def _clear(self) -> None:
        # a state: (suffix, for each position in it where a piece may begin and at its end: (last token, tokens since then, negated))
        # its arcs: by character the next state's arcs and the change in the number of tokens; under None the state itself
        self.states: dict[tuple, dict] = {}
        self.heads: dict[str, tuple[dict, int]] = {}
        self.start = self._state(("", ((None, 0),)))
        if self.pairs > 2 * STATES:
            self.allowed.clear()
            self.shapes.clear()
            self.pairs = 0

    def _state(self, state: tuple) -> dict:
        if (arcs := self.states.get(state)) is None:
            arcs = self.states[state] = {None: state}
        return arcs

    def _history(self, token: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """(whether plain BPE makes one token of it, the merges on the way: score, first and last part after it).

        A merge joins the adjacent pair of the best score, the leftmost of equals, until none is a piece.
        """
        if (got := self.histories.get(token)) is None:
            parts, merges = list(token), []
            while True:
                best, where = None, -1
                for k in range(len(parts) - 1):
                    score = self.pieces.get(parts[k] + parts[k + 1])
                    if score is not None and (best is None or score > best):
                        best, where = score, k
                if where < 0:
                    break
                parts[where : where + 2] = [parts[where] + parts[where + 1]]
                merges.append((best, parts[0], parts[-1]))
            got = self.histories[token] = (len(parts) == 1, merges)
        return got

    def _follows(self, before: str, token: str) -> bool:
        """Whether ``token``, which plain BPE makes, can stand right after ``before``.

        Both are made by their own merges, in turn by score, unless a merge
        across the boundary comes first.
        """
        right, left = self._history(token)[1], self._history(before)[1]
        a, b, i, j = before[-1], token[0], 0, 0
        while True:
            across = self.pieces.get(a + b)
            next_left = left[i][0] if i < len(left) else _NEVER
            next_right = right[j][0] if j < len(right) else _NEVER
            if across is not None and across > next_left and across >= next_right:
                return False
            if i < len(left) and next_left >= next_right:
                a = left[i][2]
                i += 1
            elif j < len(right):
                b = right[j][1]
                j += 1
            else:
                return True

    def _shape(self, grown: str) -> tuple:
        """(where tokens end that end here, longest first, with what may stand before them; the suffix that goes on; its places that go on)."""
        size = len(grown)
        cut = next((k for k in range(size) if grown[k:] in self.paths), size)
        ends = [(k, token, self.allowed.setdefault(token, {None: True})) for k in range(size) if (token := grown[k:]) in self.pieces and self._history(token)[0]]
        if len(self.shapes) > STATES:
            self.shapes.clear()
        got = self.shapes[grown] = (ends, grown[cut:], [k if grown[k:] in self.paths else -1 for k in range(cut, size)])
        return got

    def step(self, arcs: dict, char: str) -> tuple[dict, int]:
        """Compile a transition: (the next state's arcs, change in the number of tokens)."""
        suffix, last = arcs[None]
        if char not in self.pieces:  # byte fallback: a token a byte, and nothing merges across it
            arcs[char] = arc = (self._state(("", ((None, 0),))), len(char.encode("utf-8", "surrogatepass")))
            return arc
        grown = suffix + char
        ends, rest, places = self.shapes.get(grown) or self._shape(grown)
        for start, token, allowed in ends:
            before, since = last[start]
            follows = allowed.get(before)
            if follows is None:
                follows = allowed[before] = self._follows(before, token)
                self.pairs += 1
            if follows:
                break
        else:
            raise AssertionError(f"no token ends {grown!r}")
        emitted = since + 1
        # only where a piece may still begin does it matter what stood before
        kept = [(last[k][0], last[k][1] - emitted) if k >= 0 else None for k in places]
        kept.append((token, 0))
        arcs[char] = arc = (self._state((rest, tuple(kept))), emitted)
        return arc

    def read(self, arcs: dict, tokens: int, text: str) -> tuple[dict, int]:
        for char in text:
            arc = arcs.get(char) or self.step(arcs, char)
            arcs = arc[0]
            tokens += arc[1]
        return arcs, tokens

    def count_unit(self, unit: str) -> int:
        """Tokens of a unit, read from the start state; where its first characters lead is kept."""
        if len(self.states) > STATES:
            self._clear()
        if len(unit) > CHUNK:
            return self._count_long(unit)
        head = unit[:HEAD]
        got = self.heads.get(head)
        if got is None:
            got = self.heads[head] = self.read(self.start, 0, head)
        return self.read(*got, unit[HEAD:])[1]

    def _count_long(self, unit: str) -> int:
        """By the state maps of chunks, composed two by two in rounds (a carry of maps of 1, 2, 4, ... chunks)."""
        carry: list[StateMap | None] = []
        for at in range(0, len(unit), CHUNK):
            if len(self.states) > STATES:
                self._clear()
            made, level = StateMap.of(self, unit, at, min(at + CHUNK, len(unit))), 0
            while level < len(carry) and carry[level] is not None:
                made, carry[level], level = carry[level].then(self, made), None, level + 1
            carry[level : level + 1] = [made]
        whole = None
        for made in carry:
            if made is not None:
                whole = made if whole is None else made.then(self, whole)
        return whole.tokens

    def count(self, unit: bytes) -> int:
        """Tokens of a unit with plain spaces."""
        got = self.units.get(unit)
        if got is None:
            got = self.count_unit(unit.decode().replace(" ", SPACE))
            if len(unit) <= SHORT:
                self.held += len(unit) + 20
                if self.held > KEPT:
                    self.units.clear()
                    self.held = 0
                self.units[unit] = got
        return got


class StateMap:
    """What the part of a text from ``lo`` to ``hi`` does to an incoming state.

    ``seen``: the states and tokens of the run from the start state at its first
    places; ``out`` and ``tokens``: where that run ends.  ``parts`` are the two
    maps that this one is composed of, if it is.
    """

    __slots__ = ("hi", "lo", "out", "parts", "seen", "text", "tokens")

    @classmethod
    def of(cls, t: Transducer, text: str, lo: int, hi: int) -> StateMap:
        self = cls()
        self.text, self.lo, self.hi, self.parts, self.seen = text, lo, hi, None, []
        arcs, tokens = t.start, 0
        for char in text[lo : min(lo + MEET, hi)]:
            arcs, tokens = t.read(arcs, tokens, char)
            self.seen.append((arcs, tokens))
        self.out, self.tokens = t.read(arcs, tokens, text[min(lo + MEET, hi) : hi])
        return self

    def then(self, t: Transducer, after: StateMap) -> StateMap:
        """First this map, then that one."""
        both = StateMap()
        both.text, both.lo, both.hi, both.seen, both.parts = self.text, self.lo, after.hi, self.seen, (self, after)
        both.out, more = after.apply(t, self.out)
        both.tokens = self.tokens + more
        return both

    def apply(self, t: Transducer, arcs: dict) -> tuple[dict, int]:
        """(state at the end, tokens) for an incoming state."""
        tokens = 0
        for char, (own, at) in zip(self.text[self.lo : self.hi], self.seen):
            arcs, tokens = t.read(arcs, tokens, char)
            if arcs is own or arcs[None] == own[None]:
                return self.out, tokens + self.tokens - at
        if self.parts:  # the runs have not met yet
            first = self.parts[0]
            while first.parts:
                first = first.parts[0]
            arcs, more = t.read(arcs, 0, self.text[first.lo + len(first.seen) : first.hi])
            return self._rest(t, first.hi, arcs, tokens + more)
        return t.read(arcs, tokens, self.text[self.lo + len(self.seen) : self.hi])

    def _rest(self, t: Transducer, at: int, arcs: dict, tokens: int) -> tuple[dict, int]:
        """Go on from the place ``at``, where a part of this map begins, part by part."""
        stack = [self]
        while stack:
            part = stack.pop()
            if part.hi <= at:
                continue
            if part.lo < at:
                stack += part.parts[::-1]
                continue
            arcs, more = part.apply(t, arcs)
            tokens += more
        return arcs, tokens


def unit_edges(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of some texts, and the end of the last one."""
    found, begins = [], offsets[:-1][np.diff(offsets) > 0]
    lo, end = int(offsets[0]), int(offsets[-1])
    for at in range(lo, end, BLOCK):
        part = raw[max(at - 1, lo) : min(at + BLOCK, end)]
        space, line = part == 32, part == 10
        edge = line.copy()
        edge[1:] |= line[:-1] | (space[1:] & ~space[:-1])
        edge[0] |= space[0]
        edge = edge[1:] if at > lo else edge
        own = begins[np.searchsorted(begins, at) : np.searchsorted(begins, at + BLOCK)]
        edge[own - at] = True
        found.append(np.flatnonzero(edge) + at)
    return np.concatenate([*found, [end]]).astype(np.int64)


def count_texts(t: Transducer, texts: pa.Array) -> np.ndarray:
    """The number of tokens of each text."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    out = np.zeros(len(texts), np.int64)
    _, offs, data = texts.buffers()
    if not len(texts) or data is None:
        return out
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(raw[offsets[0] : offsets[-1]] == 0xE2)
    if len(marks) and SPACE.encode() in raw[offsets[0] : offsets[-1]].tobytes():  # the model takes it for a space
        return count_texts(t, pc.replace_substring(texts, SPACE, " "))
    if offsets[-1] == offsets[0]:
        return out
    edges = unit_edges(raw, offsets)
    of_unit = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), data]).dictionary_encode()
    known = np.fromiter(map(t.count, of_unit.dictionary.to_pylist()), np.int64, len(of_unit.dictionary))
    tokens = known[of_unit.indices.to_numpy()]
    some = np.flatnonzero(np.diff(offsets) > 0)
    first = np.searchsorted(edges, offsets[some])  # the model puts a space before a text
    tokens[first] = [t.count(b" " + raw[edges[k] : edges[k + 1]].tobytes()) for k in first]
    before = np.concatenate([[0], np.cumsum(tokens)])
    out[some] = before[np.r_[first[1:], len(tokens)]] - before[first]
    return out


_compiled: dict[str, Transducer] = {}


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, over_limit.  The driver reads the model; its pieces go along with the tasks."""
    ship(docs.sparkSession)
    pieces = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _compiled:  # kept for the worker's next tasks
            _compiled[model_path] = Transducer(pieces.value)
        t = _compiled[model_path]
        for batch in batches:
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = count_texts(t, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
