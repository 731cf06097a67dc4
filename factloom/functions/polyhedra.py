"""Iteration spaces A x <= b: bounds, Fourier-Motzkin elimination, emptiness, integer row echelon form."""

from __future__ import annotations

from fractions import Fraction
from math import gcd


def from_ranges(ranges: list[tuple[str, dict, dict]]) -> tuple[list[list[Fraction]], list[Fraction], list[str]]:
    """(A, b, variables) of loops (variable, lower, upper); bounds map names to coefficients, "" is the constant."""
    names = [v for v, _, _ in ranges]
    for _, lo, hi in ranges:
        names += [n for n in (*lo, *hi) if n and n not in names]
    a, b = [], []
    for v, lo, hi in ranges:
        for bound, sign in ((lo, -1), (hi, 1)):
            row = [Fraction(0)] * len(names)
            row[names.index(v)] += sign
            for n, c in bound.items():
                if n:
                    row[names.index(n)] -= sign * Fraction(c)
            a.append(row)
            b.append(sign * Fraction(bound.get("", 0)))
    return a, b, names


def eliminate(a, b, k: int):
    """The system without variable k (its column stays, all zero): each lower bound meets each upper bound."""
    low = [(r, c) for r, c in zip(a, b) if r[k] < 0]
    high = [(r, c) for r, c in zip(a, b) if r[k] > 0]
    rows = [(r, c) for r, c in zip(a, b) if r[k] == 0]
    for r, c in low:
        for s, d in high:
            rows.append(([x / -r[k] + y / s[k] for x, y in zip(r, s)], c / -r[k] + d / s[k]))
    kept = list(dict.fromkeys((tuple(r), c) for r, c in rows if any(r) or c < 0))
    return [list(r) for r, _ in kept], [c for _, c in kept]


def is_empty(a, b) -> bool:
    """Whether no rational point satisfies the system."""
    for k in range(len(a[0]) if a else 0):
        a, b = eliminate(a, b, k)
    return any(c < 0 for c in b)


def bounds(a, b, k: int) -> tuple[list, list]:
    """(lower, upper) bounds of variable k: (coefficients of the others, constant)."""
    low, high = [], []
    for r, c in zip(a, b):
        if r[k]:
            other = [-x / r[k] if i != k else Fraction(0) for i, x in enumerate(r)]
            (high if r[k] > 0 else low).append((other, c / r[k]))
    return low, high


def nest_bounds(a, b, order: list[int]) -> list[tuple[list, list]]:
    """Bounds of each loop of a nest, outermost first: an inner loop's bounds name only loops outside it."""
    out = []
    for at in range(len(order) - 1, -1, -1):
        out.append(bounds(a, b, order[at]))
        a, b = eliminate(a, b, order[at])
    return out[::-1]


def row_echelon(m: list[list[int]]) -> list[list[int]]:
    """Integer row echelon form; rows are kept free of common factors."""
    m, at = [list(r) for r in m], 0
    for k in range(len(m[0]) if m else 0):
        pick = next((i for i in range(at, len(m)) if m[i][k]), None)
        if pick is None:
            continue
        m[at], m[pick] = m[pick], m[at]
        for i in range(at + 1, len(m)):
            f, g = m[i][k], m[at][k]
            m[i] = [x * g - y * f for x, y in zip(m[i], m[at])]
            d = gcd(*m[i]) or 1
            m[i] = [x // d for x in m[i]]
        at += 1
    return m


def independent(m: list[list[int]]) -> bool:
    """Whether each equation names one variable at most and no two rows share one."""
    used = [[k for k, x in enumerate(r) if x] for r in m]
    flat = [k for u in used for k in u]
    return all(len(u) <= 1 for u in used) and len(flat) == len(set(flat))


def one_variable_systems(m: list[list[int]], b: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """(variable, its equations (coefficient, right-hand side)) of an independent system, in order of the variables."""
    found: dict[int, list[tuple[int, int]]] = {}
    for row, c in zip(m, b):
        used = [k for k, x in enumerate(row) if x]
        if len(used) > 1:
            raise ValueError("an equation names several variables")
        for k in used:
            found.setdefault(k, []).append((row[k], c))
    return sorted(found.items())


def back_substitution(m: list[list[int]], b: list[int]) -> list[Fraction]:
    """The solution of an upper triangular system; a zero on the diagonal raises."""
    x = [Fraction(0)] * len(b)
    for i in range(len(b) - 1, -1, -1):
        if not m[i][i]:
            raise ValueError("the matrix is singular")
        x[i] = (Fraction(b[i]) - sum(Fraction(m[i][k]) * x[k] for k in range(i + 1, len(b)))) / m[i][i]
    return x
