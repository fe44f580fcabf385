"""Edit distance with adjacent swaps, cut off at a limit."""

from __future__ import annotations


def edits(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance, or limit + 1 when it is larger."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return limit + 1
    while n and m and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    k = 0
    while k < n and k < m and a[k] == b[k]:
        k += 1
    a, b, n, m = a[k:n], b[k:m], n - k, m - k
    if not n or not m:
        return min(n + m, limit + 1)
    before: list[int] = []
    row = list(range(m + 1))
    for i in range(1, n + 1):
        older, before, row = before, row, [i] + [0] * m
        x = a[i - 1]
        for j in range(1, m + 1):
            v = before[j - 1] if x == b[j - 1] else 1 + min(before[j - 1], before[j], row[j - 1])
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                v = min(v, older[j - 2] + 1)
            row[j] = v
        if min(row) > limit and (not before or min(before) > limit):
            return limit + 1
    return min(row[m], limit + 1)
