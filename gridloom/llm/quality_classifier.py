"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, and only the bag has a
label.  Every passage is encoded (lengths, shares of symbol, digit, upper-case
and other bytes, repetition, hashed byte pairs), a small layer turns this into
a representation, gated attention weighs the passages, and the weighted sum is
scored.  All weights are learned together from the documents' labels.

The fit runs on the driver on all passages of about ``SAMPLE`` labelled
documents, drawn by a hash of the id; fewer documents if they have more than
``FIT_BYTES`` of text: a bounded sample whatever the corpus.  Each class may
fill half of the sample, and what one leaves the other takes, so a rare label
is there; a document counts for as many as its class had for each one drawn,
so scores are those of the whole.  Scoring encodes every passage of every
document, in chunks of bounded size, row by row: no shuffle, no key.

Defined cases: null, empty and blank texts are one empty passage and get the
model's score for that; without labels of both classes the score is the share
of label 1 (0.5 if there are none); an id labelled twice takes its higher
label; ids are only passed on, so repeated rows are fine; extra columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labels import labelled, rates
from gridloom.llm.tables import ship
from gridloom.llm.wordhash import SPACED, chunks, hash_words

PASSAGE = 64
SAMPLE, FIT_BYTES = 6_000, 48 << 20
THRESHOLD = 0.7
HIDDEN, GATE = 16, 8
ROUNDS, RATE, DECAY = 200, 0.03, 1e-4
PAIR_BUCKETS = 64
_CLASSES = [
    np.isin(np.arange(256), list(b"#*$%&|<>!@=~^_\\{}[]")),
    (np.arange(256) >= 48) & (np.arange(256) <= 57),
    (np.arange(256) >= 65) & (np.arange(256) <= 90),
    (np.arange(256) >= 97) & (np.arange(256) <= 122),
    np.isin(np.arange(256), list(b".,;:?'\"()-")),
    np.arange(256) == 10,
    np.arange(256) >= 128,
]
WIDTH = 5 + len(_CLASSES) + PAIR_BUCKETS


def encode(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, index of each text's first passage, with the total at the end)."""
    words, first = hash_words(raw, offsets, SPACED)
    docs = len(offsets) - 1
    size = np.diff(first)
    passages = np.maximum(-(-size // PASSAGE), 1)
    begin = np.r_[0, np.cumsum(passages)]
    doc = np.repeat(np.arange(docs), size)
    of_word = begin[doc] + (np.arange(len(words)) - first[doc]) // PASSAGE
    total = int(begin[-1])
    # bytes belong to the passage of the word that began last in their text
    inside = SPACED[0][raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(raw)]
    start[edge] = inside[edge]
    nth = np.cumsum(start) - 1
    of_doc = np.repeat(np.arange(docs), np.diff(offsets))
    nth = np.maximum(nth, first[of_doc]) if len(raw) else nth
    of_byte = np.where(size[of_doc] > 0, of_word[np.minimum(nth, max(len(words) - 1, 0))] if len(words) else 0, begin[of_doc])
    n_words = np.bincount(of_word, minlength=total).astype(np.float64)
    n_bytes = np.bincount(of_byte, minlength=total).astype(np.float64)
    some, much = np.maximum(n_words, 1), np.maximum(n_bytes, 1)
    x = np.zeros((total, WIDTH), np.float32)
    x[:, 0] = np.log1p(n_words)
    x[:, 1] = np.log1p(n_bytes / some)
    x[:, 2] = np.log1p(np.bincount(of_byte, weights=~inside, minlength=total) / some)
    if len(words):
        order = np.lexsort((words, of_word))
        p, h = of_word[order], words[order]
        new = np.r_[True, (p[1:] != p[:-1]) | (h[1:] != h[:-1])]
        x[:, 3] = np.bincount(p[new], minlength=total) / some
        again = np.flatnonzero((words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])) + 1
        x[:, 4] = np.bincount(of_word[again], minlength=total) / some
    for k, kind in enumerate(_CLASSES):
        x[:, 5 + k] = np.bincount(of_byte[kind[raw]], minlength=total) / much
    if len(raw) > 1:
        pair = ((raw[:-1].astype(np.int64) * 31 + raw[1:]) * 40503 >> 4) % PAIR_BUCKETS
        at = (of_byte[:-1] * PAIR_BUCKETS + pair)[of_doc[:-1] == of_doc[1:]]  # a text's last byte and the next one's first are no pair
        x[:, 5 + len(_CLASSES) :] = np.bincount(at, minlength=total * PAIR_BUCKETS).reshape(total, PAIR_BUCKETS) / much[:, None]
    return x, begin


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None


def _forward(w: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags with all that the gradient needs; ``begin`` has each bag's first passage."""
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    size = np.diff(begin)
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, begin[:-1]), size))
    a = e / np.repeat(np.add.reduceat(e, begin[:-1]), size)
    z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
    logit = z @ w["c"] + w["d"][0]
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}


def _gradient(w: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> dict[str, np.ndarray]:
    f = _forward(w, x, begin)
    size = np.diff(begin)
    by_bag = (f["score"] - y) * (1 / len(y) if weight is None else weight / weight.sum())
    dz = np.repeat(by_bag[:, None] * w["c"], size, axis=0)
    da = (dz * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["a"] * da, begin[:-1]), size)
    de = f["a"] * (da - mean)
    gated = de[:, None] * w["a"]
    dt, dg = gated * f["g"] * (1 - f["t"] ** 2), gated * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {"W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ by_bag, "d": np.array([by_bag.sum()])}


def fit(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """Learn all weights from bags of passage features, one label a bag and what each bag counts for, by Adam on the whole sample."""
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), {}, float(y.mean()) if len(y) else 0.5)
    x = np.vstack(bags).astype(np.float64)
    begin = np.r_[0, np.cumsum([len(b) for b in bags])]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    x = (x - mean) / scale
    rng = np.random.default_rng(5)
    shapes = {"W": (WIDTH, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    m, v = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    for step in range(1, ROUNDS + 1):
        for k, g in _gradient(w, x, begin, y, weight).items():
            g = g + DECAY * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, raw, offsets in chunks(batch.column(1)):
            x, begin = encode(raw, offsets)
            bags = [x[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(bags)), pa.array(bags, pa.binary())], names=["label", "bag"])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    ship(docs.sparkSession)
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max((F.col(label_col) > 0).cast("int")).alias(label_col))
    share = rates({r[0]: r[1] for r in marks.groupBy(label_col).count().collect()}, SAMPLE)
    drawn = lambda seed, i, rate: F.pmod(F.xxhash64(F.lit(seed), F.col(i).cast("string")), F.lit(1 << 30)) < rate
    by_class = F.when(F.col(label_col) == 1, int(share.get(1, 1.0) * (1 << 30))).otherwise(int(share.get(0, 1.0) * (1 << 30)))
    rows, _ = labelled(docs, marks.filter(drawn("fit", id_col, by_class)), label_col=label_col, id_col=id_col, text_col=text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > FIT_BYTES:
        rows = rows.filter(drawn("bytes", "id", int(FIT_BYTES / size * (1 << 30))))
    got = rows.select("label", "text").mapInArrow(_bags, "label int, bag binary").toArrow()
    bags = [np.frombuffer(b.as_py(), np.float32).reshape(-1, WIDTH) for b in got.column("bag")]
    order = sorted(range(len(bags)), key=lambda k: bags[k].tobytes())  # as rows come in any order
    y = (got.column("label").to_numpy() > 0).astype(np.float64)
    weight = np.where(y > 0, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
    return fit([bags[k] for k in order], y[order], weight[order])


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for row, raw, offsets in chunks(batch.column(1)):
                x, begin = encode(raw, offsets)
                docs = len(begin) - 1
                if m.constant is None:
                    f = _forward(m.weights, (x - m.mean) / m.scale, begin)
                    score, top = f["score"], np.maximum.reduceat(f["a"], begin[:-1])
                else:
                    score, top = np.full(docs, m.constant), 1 / np.diff(begin)
                out = [batch.column(0).slice(row, docs), pa.array(score), pa.array(np.diff(begin)), pa.array(top)]
                yield pa.RecordBatch.from_arrays(out, names=["id", "score", "n_passages", "top_weight"])

    return run


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, score, n_passages, top_weight (the largest attention weight), predicted."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = base.mapInArrow(_scores(shared), f"id {kind}, score double, n_passages bigint, top_weight double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
