"""Signal kernels in numpy: Butterworth design, forward-backward filtering, Fourier resampling, wavelets, areas."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, cutoff: float | tuple[float, float], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital filter; cutoffs are fractions of the Nyquist frequency.

    Analogue prototype, transformed in its poles and zeros, then mapped by the
    bilinear transform with warped cutoffs.
    """
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if (edges <= 0).any() or (edges >= 1).any():
        raise ValueError("cutoffs lie between 0 and the Nyquist frequency")
    warped = 4 * np.tan(np.pi * edges / 2)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    zeros = np.zeros(0, complex)
    gain = 1.0
    if kind == "lowpass":
        poles, gain = poles * warped[0], warped[0] ** order
    elif kind == "highpass":
        gain = float(np.real(1 / np.prod(-poles)))
        poles, zeros = warped[0] / poles, np.zeros(order, complex)
    elif kind == "bandpass":
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half**2 - centre**2)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), width**order
    else:
        raise ValueError("kind is lowpass, highpass or bandpass")
    digital_gain = gain * np.real(np.prod(4 - zeros) / np.prod(4 - poles))
    digital_zeros = np.concatenate([(4 + zeros) / (4 - zeros), -np.ones(len(poles) - len(zeros))])
    return np.real(digital_gain * np.poly(digital_zeros)), np.real(np.poly((4 + poles) / (4 - poles)))


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State of the filter that a constant input of one leaves unchanged."""
    n = len(a)
    shift = np.zeros((n - 1, n - 1))
    shift[:, 0] = -a[1:]
    shift[:-1, 1:] = np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - shift, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filter columns from a state; one step over all columns at a time."""
    z = state.copy()
    out = np.empty_like(x)
    for i in range(len(x)):
        y = b[0] * x[i] + z[0]
        z[:-1] = z[1:] + np.outer(b[1:-1], x[i]) - np.outer(a[1:-1], y)
        z[-1] = b[-1] * x[i] - a[-1] * y
        out[i] = y
    return out


def forward_backward(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of columns, ends extended by odd reflection of three filter lengths."""
    b, a = b / a[0], a / a[0]
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"a signal of more than {pad} rows is needed")
    long = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    z = _steady(b, a)[:, None]
    once = _run(b, a, long, z * long[0])
    twice = _run(b, a, once[::-1], z * once[-1])[::-1]
    return twice[pad:-pad]


def detrend(x: np.ndarray) -> np.ndarray:
    """Less the least-squares line of each column."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    spread = (t**2).sum()
    slope = t @ x / spread if spread else np.zeros(x.shape[1])
    return x - x.mean(0) - np.outer(t, slope)


def clean(x: np.ndarray, *, detrended: bool = True, standardize: bool = True, confounds: np.ndarray | None = None, low_pass: float | None = None, high_pass: float | None = None, ensure_finite: bool = False, sampling_freq: float = 1.0) -> np.ndarray:
    """Columns detrended, filtered, freed of confounds, standardised and made finite, in this order."""
    x = np.asarray(x, float)
    if detrended:
        x = detrend(x)
    nyquist = sampling_freq / 2
    band = None
    if low_pass is not None and high_pass is not None:
        band = butterworth(5, (high_pass / nyquist, low_pass / nyquist), "bandpass")
    elif low_pass is not None:
        band = butterworth(5, low_pass / nyquist, "lowpass")
    elif high_pass is not None:
        band = butterworth(5, high_pass / nyquist, "highpass")
    if band:
        x = forward_backward(*band, x)
    if confounds is not None:
        c = np.asarray(confounds, float).reshape(len(x), -1)
        if band:
            c = forward_backward(*band, c)
        design = np.column_stack([c, np.ones(len(c))])
        x = x - design @ np.linalg.lstsq(design, x, rcond=None)[0]
    if standardize:
        sd = x.std(0, ddof=1) if len(x) > 1 else np.zeros(x.shape[1])
        x = (x - x.mean(0)) / np.where(sd == 0, 1.0, sd)
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) if ensure_finite else x


def resample(x: np.ndarray, n_out: int) -> np.ndarray:
    """Columns resampled in the Fourier domain; a shared Nyquist term is split or joined."""
    n = len(x)
    spectrum = np.fft.rfft(x, axis=0)
    m = min(n, n_out)
    kept = np.zeros((n_out // 2 + 1, x.shape[1]), complex)
    kept[: m // 2 + 1] = spectrum[: m // 2 + 1]
    if m % 2 == 0 and n_out != n:
        kept[m // 2] *= 2 if n_out < n else 0.5
    return np.fft.irfft(kept, n_out, axis=0) * (n_out / n)


def morlet(freq: float, num_cyc: float = 3, sampling_freq: float = 30.0) -> np.ndarray:
    """Complex wave under a Gaussian of num_cyc cycles, over plus and minus num_cyc periods."""
    t = np.arange(-num_cyc / freq, num_cyc / freq, 1.0 / sampling_freq)
    width = num_cyc / (2 * np.pi * freq)
    return np.exp(2j * np.pi * freq * t) * np.exp(-(t**2) / (2 * width**2))


def convolve_same(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The middle of the full convolution, as long as x."""
    n = len(x) + len(kernel) - 1
    size = 1 << (n - 1).bit_length()
    full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(kernel, size))[:n]
    start = (len(kernel) - 1) // 2
    return full[start : start + len(x)]


def simpson(y: np.ndarray) -> float:
    """Area over unit steps; with an even number of points the last step uses the cubic correction."""
    n = len(y)
    if n < 2:
        return 0.0
    if n == 2:
        return float(y[0] + y[1]) / 2
    odd = y if n % 2 else y[:-1]
    area = float(odd[0] + odd[-1] + 4 * odd[1:-1:2].sum() + 2 * odd[2:-1:2].sum()) / 3
    if n % 2 == 0:
        area += float(5 * y[-1] + 8 * y[-2] - y[-3]) / 12
    return area


def area_histogram(values: np.ndarray, edges: np.ndarray | None = None, strict: bool = True) -> np.ndarray:
    """Counts of areas between zero crossings of the signed squares: six bins above, six below.

    strict keeps the established segments: up to the first crossing, then from each later one to
    the next, so the stretch after the first crossing is left out. Otherwise all stretches count.
    """
    edges = np.logspace(0, 5, 7) if edges is None else edges
    v = np.sign(values) * np.square(values)
    cuts = np.flatnonzero(np.diff(np.sign(v)))
    if strict:
        bounds = [(0, cuts[0])] * bool(len(cuts)) + [(a, b) for a, b in zip(cuts[1:], [*cuts[2:], len(v)], strict=True)]
    else:
        marks = [0, *(cuts + 1), len(v)]
        bounds = list(zip(marks, marks[1:], strict=False))
    areas = np.array([simpson(v[a:b]) for a, b in bounds if b > a])
    return np.concatenate([np.histogram(areas[areas > 0], edges)[0], np.histogram(-areas[areas < 0], edges)[0]])
