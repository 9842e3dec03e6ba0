"""Small bars and windows, and the same operators written out over Python lists."""

import datetime as dt
import math
import random

START = dt.datetime(2020, 1, 1)

BARS = "sid bigint, exchangeCD string, datetime timestamp_ntz, open double, high double, low double, close double"


def day(i):
    return START + dt.timedelta(days=i)


def random_bars(counts, seed=1, step=dt.timedelta(days=1)):
    """``counts[sid]`` bars per security, at irregular times."""
    rng = random.Random(seed)
    rows = []
    for sid, count in counts.items():
        at = START
        for _ in range(count):
            at += step * rng.randint(1, 4)
            rows.append((sid, "X", at, *(rng.uniform(5, 15) for _ in range(4))))
    rng.shuffle(rows)
    return rows


def by_sid(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {sid: sorted(rs, key=lambda r: (r[2], r[1])) for sid, rs in out.items()}


def windows_of(rows, n):
    found = []
    for sid, rs in by_sid(rows).items():
        found += [(sid, rs[i][2], rs[i + n - 1][2]) for i in range(len(rs) - n + 1)]
    return found


def bars_in(rows, sid, begin, end):
    return sorted((r for r in rows if r[0] == sid and begin <= r[2] <= end), key=lambda r: (r[2], r[1]))


def _kernel(x):
    return [[math.dist(a, b) for b in x] for a in x]


def _centred(d):
    n = len(d)
    rows = [sum(r) / n for r in d]
    grand = sum(rows) / n
    return [[d[i][j] - rows[i] - rows[j] + grand for j in range(n)] for i in range(n)]


def _cov(a, b):
    n = len(a)
    total = sum(a[i][j] * b[i][j] for i in range(n) for j in range(n))
    return math.sqrt(max(total, 0.0)) / n


def _scaled(x, normalize):
    if normalize == "none":
        return x
    means = [sum(c) / len(x) for c in zip(*x)]
    return [[v / m for v, m in zip(r, means)] for r in x]


def correlation(x, y, normalize="mean", passes=2):
    """The score from its definition; None where it is undefined."""
    if len(x) != len(y):
        return None
    try:
        a, b = _scaled(x, normalize), _scaled(y, normalize)
        for _ in range(passes):
            a, b = _kernel(a), _kernel(b)
        a, b = _centred(a), _centred(b)
        return _cov(a, b) / math.sqrt(_cov(a, a) * _cov(b, b))
    except ZeroDivisionError:
        return None
