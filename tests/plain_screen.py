"""The screen of one slice on arrays, against which the plans over all slices are held."""

import numpy as np

from tallyfold.operators.screening import average_linkage


def ranks(windows: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each row, averaged over ties."""
    order = np.argsort(windows, 1, kind="stable")
    ordered = np.take_along_axis(windows, order, 1)
    new = np.concatenate([np.ones((len(windows), 1), bool), ordered[:, 1:] != ordered[:, :-1]], 1)
    place = np.arange(1, windows.shape[1] + 1)
    first = np.maximum.accumulate(np.where(new, place, 0), 1)
    last = np.minimum.accumulate(np.where(np.concatenate([new[:, 1:], np.ones((len(windows), 1), bool)], 1), place, windows.shape[1] + 1)[:, ::-1], 1)[:, ::-1]
    out = np.empty(windows.shape)
    np.put_along_axis(out, order, (first + last) / 2, 1)
    return out


def rolling_rank_correlation(x: np.ndarray, z: np.ndarray, window: int, chunk: int = 4096) -> np.ndarray:
    """At each row the rank correlation of the last `window` rows; nan before there are so many, and where a side has one value."""
    out = np.full(len(x), np.nan)
    view = np.lib.stride_tricks.sliding_window_view
    for a in range(0, len(x) - window + 1, chunk):
        b = min(a + chunk + window - 1, len(x))
        rx, rz = (ranks(view(v[a:b], window)) - (window + 1) / 2 for v in (x, z))
        bottom = np.sqrt((rx * rx).sum(1) * (rz * rz).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out[a + window - 1 : b] = np.where(bottom > 0, (rx * rz).sum(1) / bottom, np.nan)
    return out


def screen(x: np.ndarray, rho: np.ndarray, groups: list[str], per_group: int, cut: float, cap: int) -> tuple[list[int], np.ndarray]:
    """Columns that pass the five steps, best first, and all coefficients: those that vary, |mean rank correlation|, the best of each group, one of each cluster of correlated ones, at most cap.

    rho: rolling rank correlations of the slice's rows, nan where a window is not whole. Ties go to the earlier column.
    """
    alive = np.flatnonzero(x.std(0) > 0) if len(x) else np.zeros(0, int)
    known = ~np.isnan(rho)
    ic = np.abs(np.where(known, rho, 0).sum(0) / np.maximum(known.sum(0), 1))
    by: dict[str, list[int]] = {}
    for c in sorted(alive.tolist(), key=lambda c: (-ic[c], c)):
        by.setdefault(groups[c], []).append(c)
    kept = sorted(c for members in by.values() for c in members[:per_group])
    if len(kept) > 1:
        corr = np.abs(np.corrcoef(x[:, kept].T))
        of = average_linkage(np.clip(1 - np.where(np.isnan(corr), 0, corr), 0, None), cut)
        best: dict[int, int] = {}
        for c, k in sorted(zip(kept, of), key=lambda t: (-ic[t[0]], t[0])):
            best.setdefault(k, c)
        kept = list(best.values())
    return sorted(kept, key=lambda c: (-ic[c], c))[:cap], ic
