"""Autocorrelation, lag correlation, spectra and filters of time series.

Lag operators are windows; filters and multitaper spectra run one series at a
time in grouped pandas functions (a series is bounded by its time axis).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def autocorrelation(df: DataFrame, by: list[str], order: list[str], lag: int = 1, value: str = "value") -> DataFrame:
    """``sum(d_t d_{t+lag}) / ((n - lag) var_pop)``."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    d = df.withColumn("_d", F.col(value) - F.avg(value).over(w))
    d = d.withColumn("_p", F.lag("_d", lag).over(w.orderBy(*order)))
    n = F.count("_d")
    return d.groupBy(*by).agg((F.sum(F.col("_d") * F.col("_p")) / F.nullif(n - lag, F.lit(0)) / F.nullif(F.sum(F.col("_d") ** 2) / F.nullif(n, F.lit(0)), F.lit(0.0))).alias("autocorrelation"))


def lag_correlation(df: DataFrame, by: list[str], order: list[str], max_lag: int, a: str = "a", b: str = "b") -> DataFrame:
    """Correlation of ``a`` and ``b`` for each lag in steps; negative: a leads. One shuffle for all lags."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    for k in range(-max_lag, max_lag + 1):
        x, y = (F.lag(a, -k).over(w), F.col(b)) if k < 0 else (F.col(a), F.lag(b, k).over(w) if k else F.col(b))
        df = df.withColumn(f"_x{k + max_lag}", F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y"))))
    aggs = [F.struct(F.lit(k).alias("lag"), F.corr(F.col(f"_x{k + max_lag}.x"), F.col(f"_x{k + max_lag}.y")).alias("corr")).alias(f"c{k + max_lag}") for k in range(-max_lag, max_lag + 1)]
    wide = df.groupBy(*by).agg(*aggs)
    return wide.select(*by, F.explode(F.array(*[f"c{k}" for k in range(2 * max_lag + 1)])).alias("c")).select(*by, "c.lag", "c.corr")


def prewhiten(df: DataFrame, by: list[str], order: list[str], value: str = "value") -> DataFrame:
    """``x_t - r x_{t-1}`` with the series' own lag-1 autocorrelation; the first value stays."""
    r = autocorrelation(df, by, order, 1, value)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    lagged = df.withColumn("_p", F.lag(value).over(w)).withColumn("_k", F.row_number().over(w))
    joined = lagged.join(r, by) if by else lagged.crossJoin(F.broadcast(r))
    return joined.withColumn("white", F.when(F.col("_k") == 1, F.col(value)).otherwise(F.col(value) - F.col("autocorrelation") * F.col("_p"))).drop("_p", "_k", "autocorrelation")


def red_noise(f: Column, rho: float, dt: float) -> Column:
    """Unnormalised AR(1) spectrum."""
    return (1 - rho**2) / (1 - 2 * rho * F.cos(2 * math.pi * f * dt) + rho**2)


def red_noise_spectrum(freqs: DataFrame, rho: float, dt: float, by: list[str] | None = None, f: str = "f") -> DataFrame:
    """AR(1) spectrum that sums to one over the frequencies."""
    by = by or []
    s = freqs.withColumn("_s", red_noise(F.col(f), rho, dt))
    total = s.groupBy(*by).agg(F.sum("_s").alias("_t"))
    joined = s.join(total, by) if by else s.crossJoin(F.broadcast(total))
    return joined.withColumn("power", F.col("_s") / F.col("_t")).drop("_s", "_t")


# -- kernels over one series ------------------------------------------------


def butterworth(order: int, cutoff: float | tuple[float, float], fs: float, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a digital Butterworth filter (``low``, ``high`` or ``band``), by the bilinear transform."""
    poles = np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda c: 2 * fs * math.tan(math.pi * c / fs)
    if kind == "band":
        lo, hi = warp(cutoff[0]), warp(cutoff[1])
        bw, w0 = hi - lo, math.sqrt(lo * hi)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        p = np.concatenate([half + root, half - root])
        z, gain = np.zeros(order), bw**order
    else:
        w0 = warp(cutoff)
        p, z, gain = (poles * w0, np.zeros(0), w0**order) if kind == "low" else (w0 / poles, np.zeros(order), 1.0)
    degree = len(p) - len(z)
    zd = np.concatenate([(2 * fs + z) / (2 * fs - z), -np.ones(degree)])
    pd_ = (2 * fs + p) / (2 * fs - p)
    gain = gain * np.real(np.prod(2 * fs - z + 0j) / np.prod(2 * fs - p))
    # Conjugate poles in pairs; real ones in pairs, or one alone.
    upper = sorted((x for x in pd_ if x.imag > 1e-12), key=abs)
    real = sorted(x.real for x in pd_ if abs(x.imag) <= 1e-12)
    groups = [[x, np.conj(x)] for x in upper] + [real[k : k + 2] for k in range(0, len(real), 2)]
    zeros = sorted(np.real(zd))
    sections = []
    for g in groups:
        # Zeros at -1 and 1 are shared out evenly between the sections of a band.
        own = [zeros.pop(0), zeros.pop()] if len(g) == 2 and kind == "band" else [zeros.pop(0) for _ in g]
        b, a = np.real(np.poly(own)), np.real(np.poly(g))
        sections.append((np.pad(b, (0, 3 - len(b))), np.pad(a, (0, 3 - len(a)))))
    sections[0] = (sections[0][0] * gain, sections[0][1])
    return sections


#: Samples that a filter section takes as one block.
BLOCK = 64


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: list[float]) -> np.ndarray:
    """One section over ``x`` from the state ``z``: whole blocks by matrix products, the state from block to block."""
    short = max(1, min(BLOCK, len(x)))
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    push = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    # Rows of ``see``: what the state at the block's start gives to each output; ``kick``: what each input gives to the next state.
    see, kick = np.empty((short, 2)), np.empty((short, 2))
    row, col = np.array([1.0, 0.0]), push
    for k in range(short):
        see[k], kick[short - 1 - k] = row, col
        row, col = row @ step, step @ col
    impulse = np.concatenate([[b[0]], see[:-1] @ push])
    lag = np.subtract.outer(np.arange(short), np.arange(short))
    own = np.where(lag >= 0, impulse[lag], 0.0)
    blocks = np.pad(x.astype(float), (0, -len(x) % short)).reshape(-1, short)
    gain, over = blocks @ kick, np.linalg.matrix_power(step, short)
    states = np.empty((len(blocks), 2))
    now = np.array(z, dtype=float)
    for k in range(len(blocks)):
        states[k] = now
        now = over @ now + gain[k]
    return (blocks @ own.T + states @ see.T).ravel()[: len(x)]


def _pass(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    level = float(x[0])
    for b, a in sections:
        dc = b.sum() / a.sum()
        z2 = (b[2] - a[2] * dc) * level
        z1 = (b[1] - a[1] * dc) * level + z2
        x = _run(b, a, x, [z1, z2])
        level *= dc
    return x


def zero_phase(sections: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Forward and backward pass with odd padding, each started in its steady state."""
    taps = 2 * len(sections) + 1
    taps -= min(sum(b[2] == 0 for b, _ in sections), sum(a[2] == 0 for _, a in sections))
    pad = min(3 * taps, len(x) - 1)
    if pad < 1:
        return x.astype(float)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]).astype(float)
    y = _pass(sections, _pass(sections, ext)[::-1])[::-1]
    return y[pad:-pad]


def _largest_of_tridiagonal(diag: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, the largest first, by multisection on counts of negative pivots."""
    reach = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    lo, hi = np.full(count, (diag - reach).min()), np.full(count, (diag + reach).max())
    below = len(diag) - np.arange(count)  # eigenvalues up to the wanted one
    square = off**2
    share = np.arange(1, 64) / 64
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(10):
            x = lo[:, None] + (hi - lo)[:, None] * share
            pivot = diag[0] - x
            negative = (pivot < 0).astype(np.int64)
            for d, q in zip(diag[1:].tolist(), square.tolist(), strict=True):
                pivot = d - x - q / pivot
                negative += pivot < 0
            at = (negative < below[:, None]).sum(axis=1)
            edge = np.concatenate([lo[:, None], x, hi[:, None]], axis=1)
            lo, hi = edge[np.arange(count), at], edge[np.arange(count), at + 1]
    return (lo + hi) / 2


def _vector_of_tridiagonal(diag: np.ndarray, off: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector: pivots from both ends meet where their sum is least."""
    n = len(diag)
    least = np.finfo(float).eps ** 2 * max(np.abs(diag).max(), np.abs(off).max(), 1e-300)
    shifted = (diag - value).tolist()
    square = (off**2).tolist()
    down, up = [0.0] * n, [0.0] * n
    down[0], up[-1] = shifted[0], shifted[-1]
    for k in range(1, n):
        down[k] = shifted[k] - square[k - 1] / (down[k - 1] if abs(down[k - 1]) > least else least)
        up[n - 1 - k] = shifted[n - 1 - k] - square[n - 1 - k] / (up[n - k] if abs(up[n - k]) > least else least)
    front, back = np.array(down), np.array(up)
    front[np.abs(front) <= least], back[np.abs(back) <= least] = least, least
    meet = int(np.abs(front + back - np.array(shifted)).argmin())
    left = np.cumprod((-off[:meet] / front[:meet])[::-1])[::-1]
    right = np.cumprod(-off[meet:] / back[meet + 1 :])
    vec = np.concatenate([left, [1.0], right])
    return vec / np.linalg.norm(vec)


@lru_cache(maxsize=16)
def slepian_tapers(n: int, nw: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Discrete prolate spheroidal sequences and their concentration, from the commuting tridiagonal matrix.

    Kept for each length, as all series of a field have the same one; memory is ``n`` times ``count``.
    """
    k = np.arange(n)
    w = nw / n
    count = min(count, n)
    diag = ((n - 1 - 2 * k) / 2.0) ** 2 * math.cos(2 * math.pi * w)
    off = k[1:] * (n - k[1:]) / 2.0
    tapers = np.stack([_vector_of_tridiagonal(diag, off, v) for v in _largest_of_tridiagonal(diag, off, count)])
    for i, t in enumerate(tapers):
        if (i % 2 == 0 and t.sum() < 0) or (i % 2 == 1 and t[np.argmax(np.abs(t) > 1e-7)] < 0):
            tapers[i] = -t
    lag = np.arange(n)
    kernel = np.where(lag == 0, 2 * w, np.sin(2 * math.pi * w * lag) / np.where(lag == 0, 1, math.pi * lag))
    spread = np.fft.irfft(np.abs(np.fft.rfft(tapers, 2 * n, axis=1)) ** 2, 2 * n, axis=1)[:, :n]
    concentration = (spread * kernel * np.where(lag == 0, 1, 2)).sum(axis=1)
    tapers.flags.writeable = concentration.flags.writeable = False
    return tapers, concentration


def multitaper(x: np.ndarray, dt: float, nw: float = 4.0, adaptive: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power spectral density from 2 nw - 1 tapers.

    ``adaptive``: the eigenspectra of a frequency are weighed by how much of them is signal and not leakage (Thomson's
    fixed point, at most 150 rounds); else by concentration.
    """
    tapers, weight = slepian_tapers(len(x), nw, max(1, int(2 * nw - 1)))
    centred = x - x.mean()
    spec = np.abs(np.fft.rfft(tapers * centred, axis=1)) ** 2 * dt
    share = weight[:, None]
    psd = (share * spec).sum(0) / weight.sum()
    if adaptive and len(weight) > 1:
        leak = np.maximum(1 - share, 0.0) * np.mean(centred**2) * dt
        level = spec[:2].mean(axis=0)
        for _ in range(150):
            d = np.sqrt(share) * level / np.maximum(share * level + leak, np.finfo(float).tiny)
            new = (d**2 * spec).sum(0) / np.maximum((d**2).sum(0), np.finfo(float).tiny)
            done = np.abs(new - level).max() <= 1e-10 * max(level.max(), np.finfo(float).tiny)
            level = new
            if done:
                break
        psd = level
    psd = psd.copy()
    psd[1 : len(psd) - (len(x) % 2 == 0)] *= 2
    return np.fft.rfftfreq(len(x), dt), psd


def lanczos(x: np.ndarray, cutoff: float) -> np.ndarray:
    """Low-pass by a sinc damped by Lanczos factors; ``cutoff`` in cycles a sample, two periods to each side.

    Beyond its ends the series goes on mirrored in its end points.
    """
    half = min(len(x) - 1, math.ceil(2 / cutoff))
    if half < 1:
        return x.astype(float)
    k = np.arange(-half, half + 1)
    weight = 2 * cutoff * np.sinc(2 * cutoff * k) * np.sinc(k / (half + 1))
    ext = np.concatenate([2 * x[0] - x[half:0:-1], x, 2 * x[-1] - x[-2 : -half - 2 : -1]]).astype(float)
    return np.convolve(ext, weight / weight.sum(), "valid")


def f_quantile_2(p: float, d2: float) -> float:
    """Quantile of the F distribution with 2 and ``d2`` degrees of freedom."""
    return d2 / 2 * ((1 - p) ** (-2 / d2) - 1)


def red_noise_threshold(freq: np.ndarray, psd: np.ndarray, dt: float, nw: float = 4.0, significance: float = 0.95, prewhitened: bool = False) -> np.ndarray:
    """Power that a spectrum must pass to differ from red noise (or white noise, if prewhitened).

    The noise level is the AR(1) spectrum fitted to the running median of the spectrum.
    """
    width = max(3, int(0.1 * len(psd)) // 2 * 2 + 1)
    half = width // 2
    padded = np.concatenate([np.zeros(half), psd, np.zeros(half)])
    median = np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)
    if prewhitened:
        base = np.full(len(psd), 1.0)
    else:
        shape = lambda r: (1 - r * r) / (1 - 2 * r * np.cos(2 * np.pi * freq * dt) + r * r)
        trial = np.linspace(0, 0.999, 1000)
        fits = [shape(r) / shape(r).sum() * psd.sum() for r in trial]
        base = fits[int(np.argmin([((median - f) ** 2).sum() for f in fits]))]
    return base * f_quantile_2(significance, 2 * int(2 * nw) - 2)


def _per_series(df: DataFrame, by: list[str], t: str, value: str, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    base = df.select(*by, t, F.col(value).cast("double").alias(value))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        has = pdf[value].notna().to_numpy()
        if has.sum() > 3:
            pdf.loc[has, value] = fn(pdf[t].to_numpy(float)[has], pdf[value].to_numpy(float)[has])
        return pdf

    return base.groupBy(*by).applyInPandas(run, base.schema)


def lowpass_filter(df: DataFrame, by: list[str], t: str, years: float | None, order: int = 3, value: str = "value", method: str = "butterworth") -> DataFrame:
    """Zero-phase low-pass at a period of ``years`` by ``butterworth`` or ``lanczos``; none: values as they are. Missing times are passed over."""
    if method not in ("butterworth", "lanczos"):
        raise ValueError(f"no low-pass filter is named {method}")
    if not years:
        return df.select(*by, t, value)

    def run(x: np.ndarray, v: np.ndarray) -> np.ndarray:
        step = float(np.median(np.diff(x)))
        return lanczos(v, step / years) if method == "lanczos" else zero_phase(butterworth(order, 1 / years, 1 / step, "low"), v)

    return _per_series(df, by, t, value, run)


def highpass_filter(df: DataFrame, by: list[str], t: str, years: float, order: int = 3, value: str = "value") -> DataFrame:
    return _per_series(df, by, t, value, lambda x, v: zero_phase(butterworth(order, 1 / years, 1 / float(np.median(np.diff(x))), "high"), v))


def bandpass_filter(df: DataFrame, by: list[str], t: str, lower: float, upper: float, order: int = 3, value: str = "value") -> DataFrame:
    """Keeps periods between ``lower`` and ``upper`` years."""
    return _per_series(df, by, t, value, lambda x, v: zero_phase(butterworth(order, (1 / upper, 1 / lower), 1 / float(np.median(np.diff(x))), "band"), v))


def spectrum_multitaper(df: DataFrame, by: list[str], t: str, nw: float = 4.0, significance: float | None = None, value: str = "value", adaptive: bool = True) -> DataFrame:
    """``frequency, power[, threshold]`` of each series; times are spaced evenly, gaps interpolated."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[value]).sort_values(t)
        x, v = pdf[t].to_numpy(float), pdf[value].to_numpy(float)
        out = {"frequency": np.zeros(0), "power": np.zeros(0), "threshold": np.zeros(0)}
        if len(v) > 8:
            dt = float(np.median(np.diff(x)))
            even = np.linspace(x[0], x[-1], round((x[-1] - x[0]) / dt) + 1)
            f, p = multitaper(np.interp(even, x, v), dt, nw, adaptive)
            out = {"frequency": f, "power": p, "threshold": red_noise_threshold(f, p, dt, nw, significance) if significance else np.full(len(f), np.nan)}
        frame = pd.DataFrame(out)
        for k, c in enumerate(by):
            frame.insert(k, c, key[k])
        return frame

    return df.select(*by, F.col(t).cast("double").alias(t), F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(run, f"{kinds}, frequency double, power double, threshold double")


def ar1_sinusoid(n: int, rho: float, period: float, amplitude: float, seed: int) -> np.ndarray:
    """Test series: AR(1) noise and a sine."""
    rng = np.random.default_rng(seed)
    noise = np.zeros(n)
    for k in range(1, n):
        noise[k] = rho * noise[k - 1] + rng.normal()
    return noise + amplitude * np.sin(2 * np.pi * np.arange(n) / period)
