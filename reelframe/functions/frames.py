"""Neighbourhood operations on frames held as row-major arrays; one numpy pass per frame shape and batch."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARR = T.ArrayType(T.DoubleType())


def _by_shape(px, h, w, fn):
    """Apply fn(stack of (n, h, w)) to the frames of each shape and keep their order."""
    import numpy as np
    import pandas as pd

    out = [None] * len(px)
    shape = pd.DataFrame({"h": h.to_numpy(), "w": w.to_numpy()})
    for (hh, ww), rows in shape.groupby(["h", "w"]).groups.items():
        i = rows.to_numpy()
        x = np.stack(px.iloc[i].to_numpy()).astype(float).reshape(len(i), hh, ww)
        for k, y in zip(i, fn(x)):
            out[k] = np.ascontiguousarray(y, dtype=float).ravel()
    return pd.Series(out)


def _windows(x, r, mode, fill=0.0):
    import numpy as np

    kw = {"constant_values": fill} if mode == "constant" else {}
    p = np.pad(x, ((0, 0), (r, r), (r, r)), mode=mode, **kw)
    return np.lib.stride_tricks.sliding_window_view(p, (2 * r + 1, 2 * r + 1), axis=(1, 2))


def _max_pool(x, r):
    import numpy as np

    return _windows(x, r, "constant", -np.inf).max(axis=(3, 4))


def reliable_mask(window: int = 5, ratio: float = 0.1):
    """1.0 where (max - min) / (mean + 1e-6) of the window is below `ratio` and the depth is positive."""

    @F.pandas_udf(_ARR)
    def run(px, h, w):
        r = window // 2

        def fn(x):
            hi, lo = _max_pool(x, r), -_max_pool(-x, r)
            mean = _windows(x, r, "constant").mean(axis=(3, 4))
            return ((hi - lo) / (mean + 1e-6) < ratio) & (x > 0)

        return _by_shape(px, h, w, fn)

    return run


def morph(kind: str, size: int = 5, pad: str = "edge"):
    """Erosion (minimum) or dilation (maximum) over a square window; edges replicated or zero."""

    @F.pandas_udf(_ARR)
    def run(px, h, w):
        def fn(x):
            win = _windows(x, size // 2, pad)
            return win.min(axis=(3, 4)) if kind == "erode" else win.max(axis=(3, 4))

        return _by_shape(px, h, w, fn)

    return run


OPEN, PEAK, COVERED = 0, 1, 2


def _near(flags, r: int):
    """Cells with a set cell at most r rows and columns away, by counts from a summed-area table."""
    import numpy as np

    *lead, h, w = flags.shape
    area = np.zeros((*lead, h + 1, w + 1), np.int64)
    area[..., 1:, 1:] = flags.cumsum(-2).cumsum(-1)
    y0, y1 = np.clip(np.arange(h) - r, 0, h), np.clip(np.arange(h) + r + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - r, 0, w), np.clip(np.arange(w) + r + 1, 0, w)
    rows = area[..., y1, :] - area[..., y0, :]
    return rows[..., x1] - rows[..., x0] > 0


def grid_nms(radius: int, passes: int = 3):
    """Scores of the peaks of a map, zero elsewhere. A peak is an open cell that no cell of its window tops, cells already taken or covered
    counting as zero; a pass takes all peaks and covers their windows, and the passes after the first find peaks that covered ones hid."""

    @F.pandas_udf(_ARR)
    def run(px, h, w):
        import numpy as np

        def peaks(x):
            state = np.full(x.shape, OPEN, np.int8)
            for _ in range(passes):
                live = np.where(state == OPEN, x, 0.0)
                found = (state == OPEN) & (live >= _max_pool(live, radius))
                if not found.any():
                    break
                state[found] = PEAK
                state[_near(found, radius) & (state == OPEN)] = COVERED
            return x * (state == PEAK)

        return _by_shape(px, h, w, peaks)

    return run


def resize(new_h: int, new_w: int, mode: str = "bilinear"):
    """Bilinear (pixel centres aligned) or nearest resize; 'mask' is bilinear, then > 0.9."""

    @F.pandas_udf(_ARR)
    def run(px, h, w):
        import numpy as np

        def fn(x):
            hh, ww = x.shape[1:]
            if mode == "nearest":
                iy = np.minimum((np.arange(new_h) * hh / new_h).astype(int), hh - 1)
                ix = np.minimum((np.arange(new_w) * ww / new_w).astype(int), ww - 1)
                return x[:, iy][:, :, ix]

            def taps(n, m):
                c = np.maximum((np.arange(n) + 0.5) * m / n - 0.5, 0)
                lo = np.minimum(c.astype(int), m - 1)
                return lo, np.minimum(lo + 1, m - 1), c - lo

            y0, y1, fy = taps(new_h, hh)
            x0, x1, fx = taps(new_w, ww)
            rows = x[:, y0] * (1 - fy)[None, :, None] + x[:, y1] * fy[None, :, None]
            out = rows[:, :, x0] * (1 - fx) + rows[:, :, x1] * fx
            return (out > 0.9).astype(float) if mode == "mask" else out

        return _by_shape(px, h, w, fn)

    return run
