"""Pixel kernels: NumPy functions of decoded images (RGB, 0 to 1, height x width x 3).

All run inside Arrow batches of one task; pixels never become rows.  Feature
groups and the channels' measures take stacks of images of one size, too (any axes
in front): a value for each image, so that small images cost no calls of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = 1e-6
# Luminance weights of red, green and blue.
LUMA = np.array([0.299, 0.587, 0.114])


def _weighted(rgb: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (rgb.reshape(-1, 3) @ weights).reshape(rgb.shape[:-1])


def luma(rgb: np.ndarray) -> np.ndarray:
    return _weighted(rgb, LUMA)


def lightness(rgb: np.ndarray) -> np.ndarray:
    """CIE L of sRGB, scaled to 0..1 in steps of 1/255."""
    linear = np.where(rgb <= 0.04045, rgb / 12.92, ((rgb + 0.055) / 1.055) ** 2.4)
    y = _weighted(linear, np.array([0.212671, 0.715160, 0.072169]))
    l_star = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    return np.rint(l_star * 255 / 100) / 255


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value."""
    high, low = rgb.max(axis=-1), rgb.min(axis=-1)
    span = high - low
    safe = np.where(span > 0, span, 1.0)
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    hue = np.where(high == r, (g - b) / safe, np.where(high == g, 2 + (b - r) / safe, 4 + (r - g) / safe))
    hue = np.where(span > 0, hue * 60 % 360, 0.0)
    return hue, np.where(high > 0, span / np.where(high > 0, high, 1.0), 0.0), high


def shrink(rgb: np.ndarray, most: int) -> np.ndarray:
    """Area average down to a long side of ``most``; smaller images stay."""
    h, w = rgb.shape[:2]
    scale = most / max(h, w)
    if scale >= 1:
        return rgb
    return area_resize(rgb, max(1, round(h * scale)), max(1, round(w * scale)))


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the part of the source that each target pixel covers."""
    for axis, size in ((0, height), (1, width)):
        image = np.moveaxis(image, axis, 0)
        n = image.shape[0]
        edges = np.linspace(0, n, size + 1)
        total = np.concatenate([np.zeros((1, *image.shape[1:])), np.cumsum(image, axis=0)])
        whole = np.minimum(edges.astype(int), n - 1)
        at = total[whole] + (edges - whole).reshape(-1, *[1] * (image.ndim - 1)) * image[whole]
        image = np.moveaxis(np.diff(at, axis=0) / (n / size), 0, axis)
    return image


def _flat(x: np.ndarray) -> np.ndarray:
    """The pixels of each image on one axis."""
    return x.reshape(*x.shape[:-2], -1)


def _padded(x: np.ndarray, k: int) -> np.ndarray:
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + [(k, k)] * 2, mode="reflect" if min(x.shape[-2:]) > k else "edge")


def sobel(gray: np.ndarray) -> np.ndarray:
    """Magnitude of the 3x3 Sobel gradients, borders mirrored."""
    p = _padded(gray, 1)
    dx = (p[..., :-2, 2:] + 2 * p[..., 1:-1, 2:] + p[..., 2:, 2:]) - (p[..., :-2, :-2] + 2 * p[..., 1:-1, :-2] + p[..., 2:, :-2])
    dy = (p[..., 2:, :-2] + 2 * p[..., 2:, 1:-1] + p[..., 2:, 2:]) - (p[..., :-2, :-2] + 2 * p[..., :-2, 1:-1] + p[..., :-2, 2:])
    return np.hypot(dx, dy)


def laplacian(gray: np.ndarray) -> np.ndarray:
    p = _padded(gray, 1)
    return p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * gray


def gaussian(gray: np.ndarray, size: int = 15) -> np.ndarray:
    """Gaussian blur; sigma follows from the window as 0.3 * ((size - 1) / 2 - 1) + 0.8."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    k = np.exp(-(at**2) / (2 * sigma**2))
    k /= k.sum()
    p = _padded(gray, size // 2)
    rows = sum(k[i] * p[..., i : i + gray.shape[-2], :] for i in range(size))
    return sum(k[i] * rows[..., i : i + gray.shape[-1]] for i in range(size))


def counts(values: np.ndarray, low: float, high: float, bins: int, where: np.ndarray | None = None) -> np.ndarray:
    """How many of each image's values lie in each of ``bins`` equal bins, the last one closed; those outside are dropped."""
    flat, edges = _flat(values), np.linspace(low, high, bins + 1)
    kept = (flat >= low) & (flat <= high)
    if where is not None:
        kept &= _flat(where)
    at = np.minimum(np.searchsorted(edges, flat, "right") - 1, bins - 1)
    lead = flat.shape[:-1]
    image = np.arange(int(np.prod(lead, dtype=int))).reshape(*lead, 1)
    return np.bincount((image * bins + at)[kept], minlength=image.size * bins).reshape(*lead, bins)


def hist(values: np.ndarray, low: float, high: float, bins: int, where: np.ndarray | None = None) -> np.ndarray:
    n = counts(values, low, high, bins, where).astype(float)
    return n / np.maximum(n.sum(-1, keepdims=True), 1.0)


def _share(hit: np.ndarray, of: np.ndarray, none: float) -> np.ndarray:
    """The share of hits among some pixels, ``none`` where there are no such pixels."""
    n = _flat(of).sum(-1)
    return np.where(n > 0, _flat(hit & of).sum(-1) / np.maximum(n, 1), none)


# ---- feature groups ---------------------------------------------------------------------------------------------


def brightness(rgb: np.ndarray) -> list[np.ndarray]:
    """Mean, deviation, 10th and 90th percentile and robust skew of lightness."""
    x = _flat(lightness(rgb))
    p10, p50, p90 = np.percentile(x, [10, 50, 90], axis=-1)
    mean, std = x.mean(-1), x.std(-1)
    return [mean, std, p10, p90, (mean - p50) / (std + EPS)]


def lighting(rgb: np.ndarray) -> list[np.ndarray]:
    """Contrast by the median, 80th percentile, mean and deviation of edges."""
    x = lightness(rgb)
    p10, p50, p80, p90 = np.percentile(_flat(x), [10, 50, 80, 90], axis=-1)
    edge = _flat(sobel(x))
    return [(p90 - p10) / np.maximum(p50, 0.01), p80, edge.mean(-1), edge.std(-1)]


def color(rgb: np.ndarray) -> list[np.ndarray]:
    """Warm-cool bias, mean and deviation of saturation, weighted bias, low and high saturation, hue strength."""
    hue, s, v = hsv(rgb)
    bias = rgb[..., 0] - rgb[..., 2]
    weight = s * np.sqrt(v)
    lit = v > 0.08
    vivid = counts(hue, 0, 360, 24, (s > 0.15) & lit)
    n = vivid.sum(-1)
    strength = np.where(n >= 32, vivid.max(-1) / np.maximum(n, 1), 0.0)
    weighted = _flat(bias * weight).sum(-1) / (_flat(weight).sum(-1) + EPS)
    return [_flat(bias).mean(-1), _flat(s).mean(-1), _flat(s).std(-1), weighted, _share(s < 0.12, lit, 1.0), _share(s > 0.55, lit, 0.0), strength]


def spatial(rgb: np.ndarray) -> list[np.ndarray]:
    """Centroid of light (relative), its spread, share above the 80th percentile, asymmetry."""
    x = lightness(rgb)
    h, w = x.shape[-2:]
    total = _flat(x).sum(-1) + EPS
    ys, xs = np.mgrid[:h, :w]
    cx, cy = _flat(x * xs).sum(-1) / total, _flat(x * ys).sum(-1) / total
    spread = np.sqrt(_flat(x * ((xs - cx[..., None, None]) ** 2 + (ys - cy[..., None, None]) ** 2)).sum(-1) / total) / max(h, w)
    half = lambda a: np.abs(_flat(a[..., : a.shape[-1] // 2]).mean(-1) - _flat(a[..., a.shape[-1] - a.shape[-1] // 2 :]).mean(-1)) if a.shape[-1] > 1 else np.zeros(a.shape[:-2])
    bright = _flat(x) > np.percentile(_flat(x), 80, axis=-1)[..., None]
    return [cx / max(w, 1), cy / max(h, 1), spread, bright.mean(-1), half(x) + half(x.swapaxes(-1, -2))]


#: Extractors by group, of images or stacks of them; more can be added.  A group's names come from the configuration, in order.
EXTRACTORS: dict[str, Callable[[np.ndarray], list[np.ndarray]]] = {
    "brightness": brightness,
    "lighting": lighting,
    "color": color,
    "spatial_lighting": spatial,
    "subject_bg": lambda rgb: [np.zeros(rgb.shape[:-3])],
}


# ---- histogram channel ------------------------------------------------------------------------------------------


def histograms(rgb: np.ndarray) -> dict:
    """Brightness and saturation (16 bins), hue (24 bins over pixels with colour, zeros below 32 of them)."""
    hue, s, v = hsv(rgb)
    vivid = (s > 0.12) & (v > 0.08)
    valid = _flat(vivid).sum(-1) >= 32
    return {"brightness_hist": hist(luma(rgb), 0, 1, 16), "saturation_hist": hist(s, 0, 1, 16), "hue_hist": np.where(valid[..., None], hist(hue, 0, 360, 24, vivid), 0.0), "hue_valid": valid}


def brightness_shape(rgb: np.ndarray) -> dict:
    """Shares of dark, middle and bright pixels, entropy (nats) and peak of a 32-bin lightness histogram."""
    x = lightness(rgb)
    h, x = hist(x, 0, 1, 32), _flat(x)
    return {"dark": (x < 0.25).mean(-1), "mid": ((x >= 0.25) & (x <= 0.75)).mean(-1), "bright": (x > 0.75).mean(-1), "entropy": -(h * np.log(h + 1e-8)).sum(-1), "peak": h.argmax(-1)}


# ---- quality channel --------------------------------------------------------------------------------------------


def _rounded(x: np.ndarray) -> np.ndarray:
    """To four digits, as Python rounds one number."""
    return np.array([round(float(v), 4) for v in np.ravel(x)]).reshape(np.shape(x))


def quality(rgb: np.ndarray) -> dict:
    """Blur, sharpness, edges on a 0..255 scale, local contrast and hue coverage."""
    light = luma(rgb)
    gray = np.rint(light * 255)
    lap = _flat(laplacian(gray)).var(-1)
    grad = _flat(sobel(gray))
    local = _flat(np.abs(light - gaussian(light)))
    hue, s, v = hsv(rgb)
    covered = np.count_nonzero(counts(hue, 0, 360, 24, (s > 0.12) & (v > 0.08)), axis=-1) / 24
    return {
        "blur_laplacian_var": _rounded(lap),
        "sharpness_score": _rounded(np.log1p(lap)),
        "edge_density": (grad > 0.08).mean(-1),
        "edge_mean": grad.mean(-1),
        "edge_p95": np.percentile(grad, 95, axis=-1),
        "local_contrast_mean": local.mean(-1),
        "local_contrast_p95": np.percentile(local, 95, axis=-1),
        "hue_coverage": covered,
        "hue_concentration": 1 - covered,
    }


def metadata(rgb: np.ndarray, alpha: np.ndarray | None) -> dict:
    """Sizes, aspect (short by long), orientation, and shares of extreme and transparent pixels of a 256-pixel sample."""
    *lead, h, w, _ = rgb.shape
    step = max(1, -(-max(h, w) // 256))
    sample = _flat(luma(rgb[..., ::step, ::step, :]))
    over, under = (sample > 0.98).mean(-1), (sample < 0.02).mean(-1)
    same = {
        "width": w,
        "height": h,
        "megapixels": round(w * h / 1e6, 4),
        "short_side": min(w, h),
        "long_side": max(w, h),
        "aspect_ratio": round(min(w, h) / max(w, h), 4),
        "orientation": "landscape" if w > h else "portrait" if h > w else "square",
        "has_alpha": alpha is not None,
    }
    return {k: np.full(lead, v) for k, v in same.items()} | {
        "transparent_ratio": np.zeros(lead) if alpha is None else (_flat(alpha[..., ::step, ::step]) < 0.05).mean(-1),
        "overexposed_ratio": over,
        "underexposed_ratio": under,
        "clipping_ratio": over + under,
    }


# ---- perceptual hashes ------------------------------------------------------------------------------------------


def _bits(flags: np.ndarray) -> int:
    """Bits as a signed 64-bit number."""
    return int(np.packbits(flags.ravel()[:64].astype(np.uint8)).view(">u8")[0].astype(np.int64))


def _dct(n: int) -> np.ndarray:
    k, x = np.mgrid[:n, :n]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def phash(rgb: np.ndarray) -> int:
    """Low frequencies of a 32x32 cosine transform above their median."""
    c = _dct(32)
    low = (c @ area_resize(luma(rgb), 32, 32) @ c.T)[:8, :8]
    return _bits(low > np.median(low))


def dhash(rgb: np.ndarray) -> int:
    """Whether each of 8x8 pixels is brighter than its left neighbour."""
    small = area_resize(luma(rgb), 8, 9)
    return _bits(small[:, 1:] > small[:, :-1])


def whash(rgb: np.ndarray) -> int:
    """The 8x8 approximation of a Haar transform, without its mean, above the median."""
    small = area_resize(luma(rgb), 64, 64)
    low = small.reshape(8, 8, 8, 8).mean(axis=(1, 3))
    low = low - low.mean()
    return _bits(low > np.median(low))


def colorhash(rgb: np.ndarray, bits: int = 3) -> int:
    """Shares of black, grey, and six faint and six bright hues, ``bits`` bits each."""
    hue, s, v = hsv(rgb)
    black = v < 1 / 8
    gray = ~black & (s < 1 / 3)
    rest = ~black & ~gray
    bright = rest & (s > 2 / 3)
    faint = rest & ~bright
    most = 2**bits
    level = lambda n, of: min(most - 1, int(n / max(of, 1) * most))
    values = [level(black.sum(), black.size), level(gray.sum(), black.size)]
    colored = max(int(rest.sum()), 1)
    for mask in (faint, bright):
        values += [level(n, colored) for n in np.histogram(hue[mask], bins=6, range=(0, 360))[0]]
    out = 0
    for x in values:
        out = out << bits | x
    return out


HASHES = {"phash": phash, "dhash": dhash, "whash": whash, "colorhash": colorhash}


# ---- depth (maps that come as files) ----------------------------------------------------------------------------


def depth_features(depth: np.ndarray, confidence: np.ndarray | None = None) -> list[float]:
    return [depth.mean(), depth.var(), 1.0 if confidence is None else confidence.mean()]


def coupling(rgb: np.ndarray, depth: np.ndarray) -> list[float]:
    """Correlation of light and depth gradients, and the depth's variance at the strongest tenth of light edges."""
    light, far = sobel(luma(rgb)).ravel(), sobel(depth).ravel()
    r = float(np.corrcoef(light, far)[0, 1]) if light.std() > 0 and far.std() > 0 else 0.0
    strong = depth.ravel()[light > np.percentile(light, 90)]
    return [r, float(strong.var()) if strong.size > 10 else 0.0]


def legacy_warm_cool(rgb: np.ndarray) -> float:
    """The older warm/cool column: the mean of red less blue."""
    return float((rgb[..., 0] - rgb[..., 2]).mean())


def legacy_vector(rgb: np.ndarray) -> list[float]:
    """The older 11 features: lightness (4), contrast, shadow, highlight and hard-edge shares, colour (3)."""
    x = lightness(rgb)
    p10, p50, p90 = np.percentile(x, [10, 50, 90])
    edge = sobel(x)
    _, s, _ = hsv(rgb)
    return [x.mean(), x.std(), p10, p90, (p90 - p10) / max(p50, 0.01), (x < np.percentile(x, 20)).mean(), (x > np.percentile(x, 80)).mean(), (edge > np.percentile(edge, 90)).mean(), (rgb[..., 0] - rgb[..., 2]).mean(), s.mean(), s.std()]
