"""Detectors of beats and breaths in numpy, by sensor: heart (electrical), pulse (optical), respiration."""

from __future__ import annotations

import numpy as np

from . import dsp


def band_passed(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """The part of a signal between two frequencies, without delay: its spectrum with raised-cosine edges a tenth of each limit wide.
    The signal is mirrored at both ends, so that they don't ring."""
    x = np.asarray(x, float)
    n = len(x)
    if n < 4:
        return x - x.mean() if n else x
    line = np.concatenate([2 * x[0] - x[:0:-1], x, 2 * x[-1] - x[-2::-1]])
    f = np.fft.rfftfreq(len(line), 1 / fs)
    rise = np.clip((f - 0.9 * low) / (0.2 * low), 0, 1) if low > 0 else np.ones(len(f))
    fall = np.clip((1.1 * high - f) / (0.2 * high), 0, 1)
    gain = (0.5 - 0.5 * np.cos(np.pi * rise)) * (0.5 - 0.5 * np.cos(np.pi * fall))
    return np.fft.irfft(np.fft.rfft(line) * gain, n=len(line))[n - 1 : 2 * n - 1]


def running_mean(x: np.ndarray, width: int) -> np.ndarray:
    """Means of width values around each, the ends repeated."""
    width = max(1, width)
    ahead = width // 2
    sums = np.concatenate([[0.0], np.cumsum(np.pad(x, (ahead, width - 1 - ahead), mode="edge"))])
    return (sums[width:] - sums[:-width]) / width


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _apart(places: list[int], heights: np.ndarray, least: float) -> np.ndarray:
    """Places in order, of two that are closer than least the higher one."""
    kept: list[int] = []
    for p in places:
        if kept and p - kept[-1] < least:
            if heights[p] > heights[kept[-1]]:
                kept[-1] = p
        else:
            kept.append(p)
    return np.array(kept, int)


def heart_beats(x: np.ndarray, fs: float) -> np.ndarray:
    """Beats of an electrical heart signal. Its steepness, smoothed over 0.1 s, exceeds one and a half times its mean of 0.75 s around a
    beat; the beat is the highest sample of such a stretch, if that is at least two fifths as long as stretches are on average."""
    x = np.asarray(x, float)
    if len(x) < fs or x.std() == 0:
        return np.zeros(0, int)
    clean = band_passed(x, fs, 0.5, min(40.0, 0.45 * fs))
    steep = running_mean(np.abs(np.gradient(clean)), round(0.1 * fs))
    stretches = _runs(steep > 1.5 * running_mean(steep, round(0.75 * fs)))
    if not stretches:
        return np.zeros(0, int)
    least = 0.4 * np.mean([b - a for a, b in stretches])
    places = [a + int(np.argmax(clean[a:b])) for a, b in stretches if b - a >= least]
    return _apart(places, clean, 0.3 * fs)


def pulse_beats(x: np.ndarray, fs: float) -> np.ndarray:
    """Beats of an optical pulse signal, by two moving averages: where the squared upper part of the signal, averaged over a systole
    (0.111 s), exceeds its average over a beat (0.667 s) by a fiftieth of its mean, for a systole at least, its highest sample is a beat."""
    x = np.asarray(x, float)
    if len(x) < fs or x.std() == 0:
        return np.zeros(0, int)
    clean = band_passed(x, fs, 0.5, min(8.0, 0.45 * fs))
    power = np.maximum(clean, 0) ** 2
    systole, beat = round(0.111 * fs), round(0.667 * fs)
    above = running_mean(power, systole) > running_mean(power, beat) + 0.02 * power.mean()
    places = [a + int(np.argmax(clean[a:b])) for a, b in _runs(above) if b - a >= max(1, systole)]
    return _apart(places, clean, 0.3 * fs)


def breaths(x: np.ndarray, fs: float) -> dict[str, float]:
    """The breath features of a signal cleaned of drift and of what is faster than breathing (below 0.05, above 3 cycles a second). What is
    left of a flat line is rounding, not breath."""
    x = np.asarray(x, float)
    clean = band_passed(x, fs, 0.05, min(3.0, 0.45 * fs))
    if len(x) == 0 or clean.std() <= 1e-9 * np.abs(x).max():
        return dict.fromkeys(dsp.BREATH, np.nan)
    return dsp.breath(clean, fs)


def rhythm(at: np.ndarray, fs: float) -> dict[str, float | None]:
    """Heart features of beat places: missing below five beats."""
    if len(at) < 5:
        return dict.fromkeys(dsp.HEART)
    gaps = np.diff(at) / fs * 1000
    return {**dsp.hrv_time(gaps), **dict(zip(dsp.HEART[5:], dsp.hrv_bands(gaps), strict=True))}


def heart(x: np.ndarray, fs: float) -> dict[str, float | None]:
    return rhythm(heart_beats(x, fs), fs)


def pulse(x: np.ndarray, fs: float) -> dict[str, float | None]:
    return rhythm(pulse_beats(x, fs), fs)
