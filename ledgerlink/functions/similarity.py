"""String similarity: edit ratios in an Arrow UDF, once for each distinct pair.

A ratio is 100 * 2 * LCS / (|a| + |b|), by a bit-parallel longest common
subsequence.  Two empty strings, or one, score 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ["ratio", "partial", "token_sort", "token_set", "jaro_winkler"]


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, rows of the table as bits of one integer."""
    return _lengths(_masks(a), len(a), b)[-1]


def _lengths(masks: dict[str, int], n: int, b: str) -> list[int]:
    """The same for each beginning of ``b``, the empty one first; ``masks`` of a text of ``n`` characters."""
    full = (1 << n) - 1
    row, out = full, [0]
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
        out.append(n - row.bit_count())
    return out


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one, windows at its ends included; of equal lengths either may be cut."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    if len(a) == len(b) and a != b:
        return max(_windows(a, b), _windows(b, a))
    return _windows(short, long)


def _windows(short: str, long: str) -> float:
    n, masks = len(short), _masks(short)
    # windows at the start and at the end come from one pass each, forwards and backwards
    ends = [_lengths(masks, n, long[:n]), _lengths(_masks(short[::-1]), n, long[: -n - 1 : -1])]
    best = max(200.0 * x / (n + k) for lengths in ends for k, x in enumerate(lengths) if k)
    return max([best, *(200.0 * _lengths(masks, n, long[k : k + n])[-1] / (2 * n) for k in range(1, len(long) - n))])


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one = " ".join(filter(None, (both, " ".join(sorted(x - y)))))
    two = " ".join(filter(None, (both, " ".join(sorted(y - x)))))
    return max(ratio(one, two), ratio(both, one), ratio(both, two))


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """In [0, 1]; the common prefix counts where the Jaro similarity is over 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for ch, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro)


SCORERS = {"ratio": ratio, "partial": partial, "token_sort": token_sort, "token_set": token_set, "jaro_winkler": jaro_winkler}


def table(wanted: dict[str, tuple[str, Column, Column]]) -> Column:
    """A struct of scores, name: (kind, a, b), from one pass through Python, each distinct pair of texts scored once a batch."""
    sides = [c for _, a, b in wanted.values() for c in (a, b)]
    kinds = [k for k, _, _ in wanted.values()]
    names = list(wanted)

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(*columns: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str, str], float] = {}
        out = {}
        for n, kind, a, b in zip(names, kinds, columns[::2], columns[1::2], strict=True):
            scorer, got = SCORERS[kind], []
            for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
                key = (kind, x, y)
                if key not in known:
                    known[key] = scorer(x, y)
                got.append(known[key])
            out[n] = got
        return pd.DataFrame(out)

    return run(*sides)


def scores(a: Column, b: Column) -> Column:
    """A struct of all scores."""
    return table({n: (n, a, b) for n in NAMES})


def score(kind: str, a: Column, b: Column) -> Column:
    """One score."""
    return table({kind: (kind, a, b)})[kind]


DIFFERENCE = T.StructType([T.StructField(c, T.ArrayType(T.StringType())) for c in ("missing", "extra")])


def unmatched(words: list[str], others: list[str], joined: str) -> list[str]:
    """Words that neither stand in ``joined`` (three letters or more) nor come within a ratio of 80 of another word."""
    return [w for w in words if not (len(w) >= 3 and w in joined) and all(ratio(w, o) < 80 for o in others)]


@F.pandas_udf(DIFFERENCE)
def name_difference(name1: pd.Series, name2: pd.Series, alias2: pd.Series) -> pd.DataFrame:
    """Words of either name without a like in the other, typing errors aside; an alias counts as part of the second name."""
    rows = []
    for a, b, alias in zip(name1.fillna(""), name2.fillna(""), alias2.fillna(""), strict=True):
        first, second = a.split(), b.split()
        rows.append((unmatched(first, second + alias.split(), (b + alias).replace(" ", "")), unmatched(second, first, a.replace(" ", ""))))
    return pd.DataFrame(rows, columns=DIFFERENCE.names)
