"""Gamma variates and samples that weighted sampling draws consistently from a term's hash.

For term x and sample k: r and c are Gamma(2, 1), beta is uniform, all read from fixed tables at
places that (x, k) determines. For weight S, t = floor(ln S / r + beta), y = exp(r (t - beta)) and
a = c / (y e^r). The term with the least a, with its t, is sample k of a weighted set; two sets agree
on it with the probability of their generalised Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BITS = 16
_rng = np.random.Generator(np.random.PCG64(19970830))
_R = _rng.gamma(2.0, 1.0, 1 << _BITS).astype(np.float32)
_C = _rng.gamma(2.0, 1.0, 1 << _BITS).astype(np.float32)
_BETA = _rng.random(1 << _BITS).astype(np.float32)
# What e^-(r (1 - beta)) is for weight 1, where t = 0.
_UNIT = np.exp(-_R * (1 - _BETA))
_STEP = _rng.integers(0, 2**63, 1 << 10, dtype=np.uint64) * U64(2) + U64(1)
MAX_SAMPLES = len(_STEP)


def signatures(terms: np.ndarray, log_weight: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """``[sets, samples]`` 32-bit marks of the chosen (term, t).

    ``terms`` are well-mixed 64-bit hashes, those of set i at ``first[i]:first[i+1]``, each term once
    per set. ``a`` is computed from (term, t) alone, so its bits mark the pair. A set without terms
    has the mark 0 throughout.
    """
    out = np.zeros((len(first) - 1, samples), np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    starts = first[:-1][full]
    other = np.flatnonzero(log_weight != 0)
    s = log_weight[other].astype(np.float32)
    low = U64((1 << _BITS) - 1)
    for k in range(samples):
        q = terms * _STEP[k]
        q >>= U64(64 - 2 * _BITS)
        ir = (q & low).astype(np.int32)
        q >>= U64(_BITS)
        c = _C.take(q.astype(np.int32))
        a = c * _UNIT.take(ir)
        if len(other):
            r, beta = _R.take(ir[other]), _BETA.take(ir[other])
            t = np.floor(s / r + beta)
            a[other] = c[other] * np.exp(-r * (t - beta + 1))
        out[full, k] = np.minimum.reduceat(a, starts).view(np.uint32)
    return out
