"""Exact products of integer matrices by Strassen's recursion.

A product of matrices of any shape is padded with zeros to even sides, cut into
quarters and put together from seven products of sums of quarters. All sums are
64-bit integers. A leaf is a plain product: where its size proves that every sum
stays below 2^53 it runs on doubles, which hold such integers exactly, else on
64-bit integers.
"""

from __future__ import annotations

import numpy as np

LEAF = 16  # a side of this length or less is not cut any more
_EXACT = 1 << 53


def _largest(a: np.ndarray) -> int:
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if _largest(a) * _largest(b) * max(a.shape[1], 1) < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(a: np.ndarray) -> np.ndarray:
    """The matrix with a row and a column of zeros added where their number is odd."""
    odd = [(0, n % 2) for n in a.shape]
    return np.pad(a, odd) if any(n for _, n in odd) else a


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices; an inner side that differs is padded with zeros."""
    inner = max(a.shape[1], b.shape[0])
    if a.shape[1] != b.shape[0]:
        a = np.pad(a, [(0, 0), (0, inner - a.shape[1])])
        b = np.pad(b, [(0, inner - b.shape[0]), (0, 0)])
    if min(a.shape[0], inner, b.shape[1]) <= LEAF:
        return _plain(a, b)
    rows, columns = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    (m, k), n = (s // 2 for s in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    p1 = multiply(a11 + a22, b11 + b22)
    p2 = multiply(a21 + a22, b11)
    p3 = multiply(a11, b12 - b22)
    p4 = multiply(a22, b21 - b11)
    p5 = multiply(a11 + a12, b22)
    p6 = multiply(a21 - a11, b11 + b12)
    p7 = multiply(a12 - a22, b21 + b22)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out[:rows, :columns]
