"""Symmetric systems of 7 x 7 blocks: nodes of few neighbours are eliminated level by level, the rest is solved densely or by conjugate gradients.

A level is an independent set of nodes of about the least degree, so its
blocks are worked side by side; a chain halves with each level.  The order is
found once (``Plan``) and used for every system over the same pairs.
"""

from __future__ import annotations

import numpy as np

#: Nodes that are not worth another level; most neighbours of an eliminated node; pairs (for a node or a pair at first) beyond which none is eliminated.
FEW, NEIGHBOURS, ROOM = 48, 16, 8
#: Nodes up to which the rest is solved densely.
DENSE = 400


def sums(at: np.ndarray):
    """How rows for the places ``at`` are added up: (order, starts, places), or just the places where none comes twice."""
    order = np.argsort(at, kind="stable")
    places, starts = np.unique(at[order], return_index=True)
    return (None, None, at) if len(places) == len(at) else (order, starts, places)


def add(table: np.ndarray, to: tuple, rows: np.ndarray) -> None:
    order, starts, places = to
    if len(places):
        table[places] += rows if order is None else np.add.reduceat(rows[order], starts, axis=0)


class Plan:
    """The order in which ``n`` nodes are eliminated whose different pairs i < j are coupled."""

    def __init__(self, n: int, i: np.ndarray, j: np.ndarray):
        near: list[dict[int, int]] = [{} for _ in range(n)]
        for p, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            near[a][b] = near[b][a] = p
        self.pairs, room = len(i), ROOM * (n + len(i))
        self.steps: list[tuple] = []
        left = list(range(n))
        while len(left) > FEW and self.pairs < room:
            most = max(2, min(len(near[v]) for v in left) + 1)
            if most > NEIGHBOURS:
                break
            shut, picked, of = bytearray(n), bytearray(n), {}
            for v in left:
                if shut[v] or len(near[v]) > most:
                    continue
                picked[v] = 1
                ends = sorted(near[v])
                own = [near[v][u] for u in ends]
                fill = []
                for a, u in enumerate(ends):
                    shut[u] = 1
                    del near[u][v]
                    for w in ends[a + 1 :]:
                        if w not in near[u]:
                            near[u][w] = near[w][u] = self.pairs
                            self.pairs += 1
                        fill.append(near[u][w])
                of.setdefault(len(ends), []).append((v, ends, own, fill))
            for k, found in of.items():
                v, ends, own, fill = (np.array(x, int).reshape(len(found), -1) for x in zip(*found, strict=True))
                self.steps.append((k, v[:, 0], ends, own, v > ends, [sums(ends[:, a]) for a in range(k)], [sums(fill[:, c]) for c in range(k * (k - 1) // 2)]))
            left = [v for v in left if not picked[v]]
        self.rest = np.array(left, int)
        place = {v: k for k, v in enumerate(left)}
        found = [(place[v], place[u], p) for v in left for u, p in near[v].items() if v < u]
        self.rest_pairs = np.array(found, int).reshape(-1, 3).T

    def solve(self, own: np.ndarray, pairs: np.ndarray, right: np.ndarray) -> np.ndarray:
        """x of H x = right, where H has the blocks ``own`` (n, 7, 7) and ``pairs`` (i's rows, j's columns)."""
        own, right = own.copy(), right[:, :, None].copy()
        pairs = np.concatenate([pairs, np.zeros((self.pairs - len(pairs), 7, 7))])
        kept = []
        for k, v, ends, at, turned, own_sums, fills in self.steps:
            back = np.linalg.inv(own[v])
            x = back @ right[v]
            blocks = pairs[at]
            blocks = np.where(turned[:, :, None, None], blocks.transpose(0, 1, 3, 2), blocks)
            follow, c = back[:, None] @ blocks, 0
            for a in range(k):
                up = blocks[:, a].transpose(0, 2, 1)
                add(own, own_sums[a], -up @ follow[:, a])
                add(right, own_sums[a], -up @ x)
                for b in range(a + 1, k):
                    add(pairs, fills[c], -up @ follow[:, b])
                    c += 1
            kept.append((v, ends, follow, x))
        out = np.zeros_like(right[:, :, 0])
        n, (i, j, p) = len(self.rest), self.rest_pairs
        if n:
            out[self.rest] = _rest(own[self.rest], i, j, pairs[p], right[self.rest, :, 0])
        for v, ends, follow, x in reversed(kept):
            out[v] = x[:, :, 0] - (follow @ out[ends][:, :, :, None]).sum((1, 3))
        return out


def _rest(own: np.ndarray, i: np.ndarray, j: np.ndarray, x: np.ndarray, right: np.ndarray) -> np.ndarray:
    n = len(own)
    if n > DENSE:
        every = np.arange(n)
        return conjugate(np.r_[every, i, j], np.r_[every, j, i], np.concatenate([own, x, x.transpose(0, 2, 1)]), np.zeros((n, 7)), right)
    h = np.zeros((n, 7, n, 7))
    h[np.arange(n), :, np.arange(n)] = own
    h[i, :, j], h[j, :, i] = x, x.transpose(0, 2, 1)
    return np.linalg.solve(h.reshape(7 * n, 7 * n), right.ravel()).reshape(n, 7)


def conjugate(i: np.ndarray, j: np.ndarray, x: np.ndarray, extra: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The step that solves (blocks x at (i, j), and ``extra`` on the diagonal) step = right; every node has a block of its own."""
    n = len(right)
    order = np.argsort(i, kind="stable")
    i, j, x = i[order], j[order], x[order]
    begin = np.searchsorted(i, np.arange(n))
    own = np.zeros((n, 7, 7))
    np.add.at(own, i[i == j], x[i == j])
    own += np.einsum("ni,ij->nij", extra, np.eye(7))
    near = np.linalg.inv(own)
    times = lambda v: np.add.reduceat(np.einsum("nij,nj->ni", x, v[j]), begin, axis=0) + extra * v
    step, left = np.zeros_like(right), right
    z = np.einsum("nij,nj->ni", near, left)
    p, rho, least = z.copy(), (left * z).sum(), 1e-20 * max((right * right).sum(), 1e-300)
    for _ in range(20 * n):
        if (left * left).sum() <= least:
            break
        q = times(p)
        alpha = rho / (p * q).sum()
        step, left = step + alpha * p, left - alpha * q
        z = np.einsum("nij,nj->ni", near, left)
        rho, before = (left * z).sum(), rho
        p = z + rho / before * p
    return step
