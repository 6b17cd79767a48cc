"""Training rows: documents joined with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most this many labels (16 bytes each) are broadcast; beyond it the join is by shuffle.
BROADCAST_LABELS = 2_000_000


def labelled(docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """((id, label, text), number of labels); an id labelled more than once counts once, with its highest label."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    n = marks.count()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(marks) if n <= BROADCAST_LABELS else marks, "id"), n


def rates(n: dict[int, int], most: int) -> dict[int, float]:
    """The share to draw of each class: half of ``most`` for each, and what one leaves for the other."""
    small = min(n.values(), default=0)
    room = {k: max(most // 2, most - small) if v > small else most // 2 for k, v in n.items()}
    return {k: min(1.0, room[k] / v) for k, v in n.items() if v}


def logistic(x, y, *, weight=None, ridge: float = 1e-2, rounds: int = 50):
    """Weights and a last bias of a ridge logistic regression, by Newton steps."""
    import numpy as np

    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
