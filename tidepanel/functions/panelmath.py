"""Numeric helpers on a block of packed series (rows = series, columns = periods, NaN = missing)."""

from __future__ import annotations

import hashlib

import numpy as np


def as_block(rows, length: int | None = None) -> np.ndarray:
    return np.array([np.asarray(r, dtype=float) for r in rows], dtype=float).reshape(len(rows), -1 if length is None else length)


def _diff(a: np.ndarray) -> np.ndarray:
    out = np.full_like(a, np.nan)
    out[:, 1:] = a[:, 1:] - a[:, :-1]
    return out


def stationary_rows(v: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The transform codes applied to every row of the block."""
    logs = np.log(np.where(v > 0, v, np.nan))
    by_code = {2: lambda a, b: _diff(a), 3: lambda a, b: _diff(_diff(a)), 4: lambda a, b: b, 5: lambda a, b: _diff(b), 6: lambda a, b: _diff(_diff(b))}
    x = v.copy()
    for code, rule in by_code.items():
        at = codes == code
        if at.any():
            x[at] = rule(v[at], logs[at])
    at = codes == 7
    if at.any():
        level = v[at]
        ratio = np.full_like(level, np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio[:, 1:] = np.where(level[:, :-1] != 0, level[:, 1:] / level[:, :-1], np.nan)
        x[at] = _diff(ratio)
    return x


def scale_rows(x: np.ndarray, ddof: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(z, mean, deviation) over the observed cells; a zero or undefined deviation counts as 1."""
    seen = ~np.isnan(x)
    n = seen.sum(axis=1)
    filled = np.where(seen, x, 0.0)
    mu = filled.sum(axis=1) / np.maximum(n, 1)
    dev = np.where(seen, x - mu[:, None], 0.0)
    sd = np.sqrt((dev**2).sum(axis=1) / np.maximum(n - ddof, 1))
    sd = np.where((sd > 0) & (n > ddof), sd, 1.0)
    return (x - mu[:, None]) / sd[:, None], mu, sd


def _seen_index(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest observed cell at or before, and at or after; -1 and T where there is none."""
    t = v.shape[1]
    pos = np.where(np.isnan(v), -1, np.arange(t))
    before = np.maximum.accumulate(pos, axis=1)
    pos = np.where(np.isnan(v), t, np.arange(t))
    after = np.minimum.accumulate(pos[:, ::-1], axis=1)[:, ::-1]
    return before, after


def fill_rows(v: np.ndarray, rule: str, days: np.ndarray, limit: int = 3) -> np.ndarray:
    """Interpolate gaps (``short``: whole gaps of at most ``limit``; ``first``: first cells of any gap), then carry."""
    t = v.shape[1]
    if t == 0:
        return v
    before, after = _seen_index(v)
    idx = np.arange(t)
    has_p, has_q = before >= 0, after < t
    p, q = np.clip(before, 0, t - 1), np.clip(after, 0, t - 1)
    rows = np.arange(len(v))[:, None]
    vp, vq = v[rows, p], v[rows, q]
    axis = idx.astype(float) if rule == "short" else days.astype(float)
    span = axis[q] - axis[p]
    with np.errstate(divide="ignore", invalid="ignore"):
        line = vp + (vq - vp) * (axis[idx] - axis[p]) / span
    if rule == "short":
        use = has_p & has_q & (q - p - 1 <= limit)
    else:
        line = np.where(has_q, line, vp)
        use = has_p & (idx - p <= limit)
    out = np.where(np.isnan(v) & use, line, v)
    before, after = _seen_index(out)
    p, q = np.clip(before, 0, t - 1), np.clip(after, 0, t - 1)
    return np.where(before >= 0, out[rows, p], np.where(after < t, out[rows, q], np.nan))


def ready_rows(x: np.ndarray, ratio: float, rule: str, days: np.ndarray):
    """Model-ready block without its first two columns: (z, mean, deviation, usable rows)."""
    cut = x[:, 2:]
    usable = np.isnan(cut).mean(axis=1) < 1 - ratio if cut.shape[1] else np.zeros(len(x), bool)
    filled = fill_rows(cut, rule, days[2:])
    usable &= ~np.isnan(filled).any(axis=1)
    z, mu, sd = scale_rows(filled)
    return z, mu, sd, usable


def last_two(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last and last-but-one observed value of each row, NaN where absent."""
    last, prev = np.full(len(v), np.nan), np.full(len(v), np.nan)
    for i, row in enumerate(v):
        seen = row[~np.isnan(row)]
        if len(seen):
            last[i] = seen[-1]
        if len(seen) > 1:
            prev[i] = seen[-2]
    return last, prev


def level_rows(f: np.ndarray, last: np.ndarray, prev: np.ndarray, codes: np.ndarray, repeat: bool = False) -> np.ndarray:
    """Invert paths ``f`` (rows x ... x steps, steps on the last axis) from the anchors."""
    shape = (len(f),) + (1,) * (f.ndim - 1)
    a, b, code = last.reshape(shape), prev.reshape(shape), codes.reshape(shape)
    if repeat:
        b = np.where(np.isnan(b), a, b)
    steps = np.arange(1, f.shape[-1] + 1)
    c1 = np.cumsum(f, axis=-1)
    c2 = np.cumsum(c1, axis=-1)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        la, lb = np.log(np.where(a > 0, a, np.nan)), np.log(np.where(b > 0, b, np.nan))
        g = np.where(b != 0, a / b - 1, np.nan)
        choices = [
            (2, a + c1), (3, a + steps * (a - b) + c2), (4, np.exp(f)), (5, np.exp(la + c1)),
            (6, np.exp(la + steps * (la - lb) + c2)), (7, a * np.cumprod(1 + g + c1, axis=-1)),
        ]
    out = f.copy()
    for number, level in choices:
        out = np.where(code == number, level, out)
    if repeat:
        out = np.where(np.isnan(out) & ~np.isnan(f), a, out)
    return np.where(np.isnan(a), np.nan, out)


def stream(*parts) -> np.random.Generator:
    """Random stream named by its parts: the same on every run, executor and partitioning.

    Each part is preceded by its length, so no two lists of parts share a name.
    """
    named = b"".join(len(p).to_bytes(8, "big") + p for p in (str(p).encode() for p in parts))
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.blake2b(named, digest_size=16).digest(), "big")))
