"""Edit distances and chains over batches of sequences: numpy kernels that tasks call. functions.sequence.edit_identity is the banded column of a pair.

Pairs stand side by side (a lane each); the loop is over one sequence's
positions, so the steps do not grow with the number of pairs.
"""

from __future__ import annotations

import numpy as np

#: Cells that a step holds at once.
CELLS = 1 << 22
_FAR = 10_000
#: Codes that stand beyond the ends of a query and of a target: they equal nothing.
QUERY_END, TARGET_END = 254, 255


def codes(s: str) -> np.ndarray:
    """A sequence's bytes."""
    return np.frombuffer(s.encode("latin-1", "replace"), np.uint8)


def stacked(rows: list[np.ndarray], fill: int, width: int | None = None) -> np.ndarray:
    """Sequences of unequal length as the rows of one array."""
    width = max((len(r) for r in rows), default=0) if width is None else width
    out = np.full((len(rows), width), fill, np.uint8)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r[:width]
    return out


def prefix_edits(query: np.ndarray, target: np.ndarray, band: int) -> np.ndarray:
    """(lanes, n + 1): edits between the first i characters of both rows, for every i; exact wherever they are at most `band`, more than `band` elsewhere."""
    lanes, n = query.shape
    out = np.zeros((lanes, n + 1), np.int16)
    wide = 2 * band + 1
    step = max(1, CELLS // wide)
    offset = np.arange(-band, band + 1, dtype=np.int16)
    for at in range(0, lanes, step):
        q = query[at : at + step]
        r = np.full((len(q), n + 2 * band), TARGET_END, np.uint8)
        r[:, band : band + n] = target[at : at + step]
        prev = np.broadcast_to(np.where(offset >= 0, offset, _FAR).astype(np.int16), (len(q), wide)).copy()
        for i in range(1, n + 1):
            row = prev + (r[:, i - 1 : i - 1 + wide] != q[:, i - 1 : i])
            np.minimum(row[:, :-1], prev[:, 1:] + 1, out=row[:, :-1])
            row = np.minimum.accumulate(row - offset, axis=1) + offset  # gaps along the target
            np.minimum(row, _FAR, out=row)
            out[at : at + step, i] = row[:, band]
            prev = row
    return out


def semiglobal_edits(query: np.ndarray, target: np.ndarray, lengths: np.ndarray, target_lengths: np.ndarray) -> np.ndarray:
    """Fewest edits that turn each query into any piece of its target (both ends of the target are free). Rows are padded."""
    lanes, m = target.shape
    out = lengths.astype(np.int64).copy()
    step = max(1, CELLS // (m + 1))
    along = np.arange(m + 1, dtype=np.int32)
    for at in range(0, lanes, step):
        q, t, n, k = query[at : at + step], target[at : at + step], lengths[at : at + step], target_lengths[at : at + step]
        prev = np.zeros((len(q), m + 1), np.int32)
        for i in range(1, int(n.max(initial=0)) + 1):
            row = np.empty_like(prev)
            row[:, 0] = i
            row[:, 1:] = np.minimum(prev[:, :-1] + (t != q[:, i - 1 : i]), prev[:, 1:] + 1)
            prev = np.minimum.accumulate(row - along, axis=1) + along
            last = np.flatnonzero(n == i)
            if len(last):
                inside = along[None] <= k[last][:, None]
                out[at + last] = np.where(inside, prev[last], _FAR + i).min(1)
    return out


def chain(query_pos: np.ndarray, target_pos: np.ndarray, weight: np.ndarray, query_len: int, k: int) -> tuple[float, float]:
    """Score and covered share of the query of the best chain of seeds: weights less 0.01 for each base by which two gaps differ and 0.005 for each base between their diagonals. Ties go to the earlier seed in order of query, then target."""
    if not len(query_pos) or query_len <= 0 or k <= 0:
        return 0.0, 0.0
    order = np.lexsort((target_pos, query_pos))
    q, t, w = query_pos[order].astype(np.int64), target_pos[order].astype(np.int64), weight[order].astype(np.float64)
    best, came = w.copy(), np.full(len(q), -1)
    for i in range(1, len(q)):
        dq, dt = q[i] - q[:i], t[i] - t[:i]
        apart = np.abs(dq - dt)
        value = np.where((dq > 0) & (dt > 0), best[:i] + w[i] - (0.01 * apart + 0.005 * apart), -np.inf)
        j = int(value.argmax())
        if value[j] > best[i]:
            best[i], came[i] = value[j], j
    at = int(best.argmax())
    score = max(0.0, float(best[at]))
    if score <= 0:
        at = 0
    covered, reach = 0, None
    spots = []
    while at >= 0:
        spots.append(int(q[at]))
        at = int(came[at])
    for s in sorted(spots):
        covered += k if reach is None or s > reach else s + k - reach
        reach = s + k
    return score, min(max(covered / max(1, query_len), 0.0), 1.0)
