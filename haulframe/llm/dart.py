"""DartMinHash: sparse weighted signatures from hashed darts.

Every element owns a half plane of weight against rank, cut into cells: weight and rank
octaves, large ones into parts of unit area.  A hash of element and cell says how many
darts (a Poisson number) fall into the cell, and where.  A set with weights sees the darts
below its weights and below a rank at which about ``k (ln k + 2)`` of them are expected,
whatever the number of elements.  A dart is hashed to one of k coordinates; the earliest
dart of a coordinate is a consistent weighted sample, so two sets agree in a coordinate
with the probability of their weighted Jaccard similarity.  A set that leaves a coordinate
empty looks at twice the rank again.
"""

from __future__ import annotations

import math

import numpy as np

from haulframe.llm.common import seeded

#: The first rank cell ends here; each further one is as high as all before it.
FIRST_RANK = 2.0 ** -6
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fraction(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulated probabilities of 0, 1, 2 ... darts."""
    chance, total, steps, i = math.exp(-mean), math.exp(-mean), [], 0
    while chance > 1e-18:
        steps.append(total)
        i += 1
        chance *= mean / i
        total += chance
    return np.array(steps)


def _cell_darts(element, weight, limit, owner, low_w, width, low_r, height, seed):
    """Darts of one cell of the given elements: id, rank and owner."""
    area = width * height
    parts = max(1, int(area))
    step = height / parts
    steps = _poisson_steps(area / parts)
    if parts == 1:
        cell, low, at = seeded(element, seed), np.full(len(element), low_r), np.arange(len(element))
    else:
        used = np.minimum(np.ceil((limit - low_r) / step), parts).astype(np.int64)
        at = np.repeat(np.arange(len(element)), used)
        part = np.arange(len(at)) - np.repeat(np.cumsum(used) - used, used)
        cell = seeded(seeded(element, seed)[at] + part.astype(np.uint64) * _ODD, 5)
        low = low_r + part * step
    count = np.searchsorted(steps, _fraction(seeded(cell, 6)), side="right")
    hit = np.flatnonzero(count)
    count = count[hit]
    at, low = np.repeat(at[hit], count), np.repeat(low[hit], count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    dart = seeded(np.repeat(cell[hit], count) + nth.astype(np.uint64) * _ODD, 8)
    rank = low + step * _fraction(seeded(dart, 9))
    keep = (rank < limit[at])
    if low_w > 0 or not (weight == 1).all():
        keep &= low_w + width * _fraction(seeded(dart, 10)) < weight[at]
    return dart[keep], rank[keep], owner[at[keep]]


def darts(element: np.ndarray, weight: np.ndarray, limit: np.ndarray, owner: np.ndarray):
    """All darts below the weight and below the rank limit of each element."""
    found = []
    for octave in range(64):
        low_w, width = (0.0, 1.0) if octave == 0 else (2.0 ** (octave - 1),) * 2
        heavy = weight > low_w
        if not heavy.any():
            break
        e, w, t, o = element[heavy], weight[heavy], limit[heavy], owner[heavy]
        low_r, height, cell = 0.0, FIRST_RANK, 0
        while len(e):
            found.append(_cell_darts(e, w, t, o, low_w, width, low_r, height,
                                     1000 + octave * 64 + cell))
            low_r += height
            height, cell = low_r, cell + 1
            on = t > low_r
            if not on.all():
                e, w, t, o = e[on], w[on], t[on], o[on]
    return (np.concatenate(x) for x in zip(*found))


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, sets: int,
               k: int) -> np.ndarray:
    """A row of k dart ids per set; elements are distinct within a set.

    A set without elements of positive weight has a row of zeros.
    """
    out = np.zeros((sets, k), np.uint64)
    total = np.bincount(owner, weights=weight, minlength=sets)
    expected = k * (math.log(k) + 2)
    todo = total > 0
    scale = 1.0
    while todo.any():
        mine = todo[owner] & (weight > 0)
        e, w, o = element[mine], weight[mine], owner[mine]
        dart, rank, of = darts(e, w, scale * expected / total[o], o)
        slot = of * k + (seeded(dart, 12) % np.uint64(k)).astype(np.int64)
        best = np.full(sets * k, np.inf)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        sample = np.zeros(sets * k, np.uint64)
        sample[slot[first]] = dart[first]
        full = np.isfinite(best).reshape(sets, k).all(axis=1) & todo
        out[full] = sample.reshape(sets, k)[full]
        todo &= ~full
        scale *= 2
    return out


def band_hashes(rows: np.ndarray, bands: int) -> np.ndarray:
    """A hash per band of each signature; bands have hashes apart from each other."""
    sets, k = rows.shape
    per_band = k // bands
    grouped = rows.reshape(sets, bands, per_band)
    total = np.zeros((sets, bands), np.uint64)
    for i in range(per_band):
        total += seeded(grouped[:, :, i], i)
    return seeded(total + np.arange(bands, dtype=np.uint64) * _ODD, 13)
