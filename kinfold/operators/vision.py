"""Image measures in NumPy, for Arrow and pandas workers: no image library is needed beyond the JVM's decoder.

Pixels are arrays of height x width x 3 (RGB, 0 to 255) or height x width (gray).
"""

from __future__ import annotations

import numpy as np

#: Weights of red, green and blue in gray; fixed values.
GRAY = np.array([0.299, 0.587, 0.114])
#: Side of the gray canvas on which images are compared; largest difference of log aspect ratios.
SIDE, ASPECT = 384, 0.12
#: Pixels that a mask must leave for a measure to say anything.
LEAST_PIXELS = 64


def gray(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(float) if pixels.ndim == 2 else pixels[..., :3].astype(float) @ GRAY


def _weights(n: int, m: int) -> np.ndarray:
    """m x n matrix that averages n samples into m by area; linear between samples where it enlarges."""
    if m <= n:
        edges = np.linspace(0, n, m + 1)
        at = np.arange(n)
        return np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None) * (m / n)
    place = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(place.astype(int), max(n - 2, 0))
    out = np.zeros((m, n))
    out[np.arange(m), low] = 1 - (place - low)
    if n > 1:
        out[np.arange(m), low + 1] += place - low
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return _weights(image.shape[0], height) @ image @ _weights(image.shape[1], width).T


def turned(image: np.ndarray) -> list[np.ndarray]:
    """The eight orientations: four turns, each also mirrored."""
    return [np.rot90(x, k) for x in (image, image[:, ::-1]) for k in range(4)]


def correlation(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Normalised cross correlation. Where one side has no contrast: 1 if both are equal but for their means, else 0; NaN under a mask of
    too few pixels."""
    if mask is not None:
        if mask.sum() < LEAST_PIXELS:
            return float("nan")
        a, b = a[mask], b[mask]
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a * a).sum() * (b * b).sum())
    if scale <= 1e-12:
        return float(np.allclose(a, b))
    return float((a * b).sum() / scale)


def gradient(image: np.ndarray) -> np.ndarray:
    """Magnitude of the Sobel gradient, edges repeated."""
    p = np.pad(image, 1, mode="edge")
    down = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    right = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    return np.hypot(down, right)


def _smooth(image: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    reach = 5
    w = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    w /= w.sum()
    p = np.pad(image, reach, mode="reflect" if min(image.shape) > reach else "edge")
    rows = sum(w[i] * p[i : i + image.shape[0]] for i in range(2 * reach + 1))
    return sum(w[i] * rows[:, i : i + image.shape[1]] for i in range(2 * reach + 1))


def similarity(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> float:
    """Structural similarity with an 11 x 11 Gaussian window, averaged over the mask; NaN under a mask of too few pixels."""
    if mask is not None and mask.sum() < LEAST_PIXELS:
        return float("nan")
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ma, mb = _smooth(a), _smooth(b)
    va, vb, cov = _smooth(a * a) - ma * ma, _smooth(b * b) - mb * mb, _smooth(a * b) - ma * mb
    out = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return float((out if mask is None else out[mask]).mean())


def matched_light(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b under the linear change of brightness and contrast that brings it nearest to a, as whole gray values; b itself where it has no contrast."""
    x, y = b.ravel(), a.ravel()
    spread = ((x - x.mean()) ** 2).mean()
    if spread < 1e-8:
        return b
    slope = ((x - x.mean()) * (y - y.mean())).mean() / spread
    return np.floor(np.clip(slope * b + y.mean() - slope * x.mean(), 0, 255))


def direct(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    """The best of b's eight orientations against a: correlation, gradient correlation, structural similarity after matching the light, and
    their blend.

    Orientations whose aspect differs too much are skipped; if all are, the measures are NaN and the score is -999.
    """
    one = gray(a)
    ratio = np.log(one.shape[1] / one.shape[0])
    small = np.rint(resize(one, SIDE, SIDE))
    edges = gradient(small)
    best = {"orientation": -1, "ncc": float("nan"), "gradient_ncc": float("nan"), "ssim": float("nan"), "score": -999.0}
    for i, other in enumerate(turned(gray(b))):
        if abs(np.log(other.shape[1] / other.shape[0]) - ratio) > ASPECT:
            continue
        other = np.rint(resize(other, SIDE, SIDE))
        ncc, edge, ssim = correlation(small, other), correlation(edges, gradient(other)), similarity(small, matched_light(small, other))
        score = 0.4 * ncc + 0.3 * edge + 0.3 * ssim
        if score > best["score"]:
            best = {"orientation": i, "ncc": ncc, "gradient_ncc": edge, "ssim": ssim, "score": score}
    return best


# perceptual hashes


def _bits(flags: np.ndarray) -> int:
    return int("".join("1" if x else "0" for x in flags.ravel()), 2)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    m = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n))
    m[0] *= np.sqrt(0.5)
    return m * np.sqrt(2 / n)


_DCT = _cosines(32)


def p_hash(image: np.ndarray) -> int:
    """Low frequencies of a 32 x 32 cosine transform above their median."""
    low = (_DCT @ resize(image, 32, 32) @ _DCT.T)[:8, :8]
    return _bits(low > np.median(low))


def d_hash(image: np.ndarray) -> int:
    """Whether each of 8 x 9 cells is darker than its right neighbour."""
    small = resize(image, 8, 9)
    return _bits(small[:, 1:] > small[:, :-1])


def a_hash(image: np.ndarray) -> int:
    small = resize(image, 8, 8)
    return _bits(small > small.mean())


def w_hash(image: np.ndarray) -> int:
    """Means of the 2 x 2 blocks of 16 x 16 pixels, one level of a Haar transform, above their median."""
    small = resize(image, 16, 16)
    low = (small[::2, ::2] + small[1::2, ::2] + small[::2, 1::2] + small[1::2, 1::2]) / 4
    return _bits(low > np.median(low))


HASHES = {"phash": p_hash, "dhash": d_hash, "ahash": a_hash, "whash": w_hash}


def hashes(pixels: np.ndarray) -> dict[str, object]:
    """Each hash as 16 hex digits with its variants over the eight orientations, colour means and deviations, entropy of gray."""
    g = gray(pixels)
    out: dict[str, object] = {}
    for name, f in HASHES.items():
        out[name] = f"{f(g):016x}"
        out[f"{name}_variants"] = sorted({f"{f(x):016x}" for x in turned(g)})
    counts = np.bincount(np.clip(np.rint(g), 0, 255).astype(int).ravel(), minlength=256)
    p = counts[counts > 0] / counts.sum()
    colour = pixels if pixels.ndim == 3 else np.repeat(pixels[..., None], 3, 2)
    out |= {"mean_rgb": colour[..., :3].reshape(-1, 3).mean(0).tolist(), "std_rgb": colour[..., :3].reshape(-1, 3).std(0).tolist(), "gray_entropy": float(-(p * np.log2(p)).sum())}
    return out


# transforms for positive controls, and features that tell what a model may take a short cut by


#: Transforms of the positive controls: share cut off each side (top, bottom, left, right), gain and offset of brightness; fixed values.
CUTS = {"center_crop_15": (0.075, 0.075, 0.075, 0.075), "corner_crop_20": (0.0, 0.2, 0.0, 0.2), "combined_crop_brightness": (0.1, 0.1, 0.1, 0.1)}
LIGHT = {"brightness_065": (0.65, 0.0), "brightness_135": (1.35, 0.0), "combined_crop_brightness": (0.78, 12.0)}
SHRUNK, LEAST_SIDE = {"resize_045": 0.45}, 32


def transformed(pixels: np.ndarray, kind: str) -> np.ndarray:
    """The image under a transform of the positive controls. Those that go through JPEG elsewhere end before it: there is no encoder here."""
    h, w = pixels.shape[:2]
    if kind == "mirror_horizontal":
        return pixels[:, ::-1]
    if kind in ("rotate90", "rotate180", "rotate270"):
        return np.rot90(pixels, int(kind[6:]) // 90)
    if kind not in CUTS and kind not in LIGHT and kind not in SHRUNK:
        raise ValueError(f"no transform {kind}")
    if kind in CUTS:
        top, bottom, left, right = CUTS[kind]
        edge = lambda n, share: max(1, round(n * share)) if share else 0
        keep_h, keep_w = (max(2, int(n * (1 - far))) if not near else n - edge(n, far) for n, near, far in ((h, top, bottom), (w, left, right)))
        pixels = pixels[edge(h, top) : keep_h, edge(w, left) : keep_w]
    if kind in LIGHT:
        gain, offset = LIGHT[kind]
        pixels = np.clip(pixels.astype(float) * gain + offset, 0, 255).astype(pixels.dtype)
    if kind in SHRUNK:
        height, width = (max(LEAST_SIDE, int(n * SHRUNK[kind])) for n in (h, w))
        pixels = np.stack([np.clip(np.rint(resize(pixels[..., c].astype(float), height, width)), 0, 255) for c in range(3)], 2).astype(pixels.dtype)
    return pixels


def canvas(pixels: np.ndarray, kind: str, share: float = 0.2) -> np.ndarray:
    """blur, gray, border (the middle blanked) or center (the border blanked)."""
    h, w = pixels.shape[:2]
    if kind == "blur":
        small = [resize(pixels[..., c].astype(float), 32, 32) for c in range(3)]
        return np.clip(np.stack([resize(x, h, w) for x in small], 2), 0, 255).astype(np.uint8)
    if kind == "gray":
        return np.repeat(np.clip(np.rint(gray(pixels)), 0, 255).astype(np.uint8)[..., None], 3, 2)
    out, dy, dx = pixels.copy(), int(h * share), int(w * share)
    if kind == "border":
        out[dy : h - dy, dx : w - dx] = 127
    elif kind == "center":
        out[:dy], out[h - dy :], out[:, :dx], out[:, w - dx :] = 127, 127, 127, 127
    else:
        raise ValueError(f"no canvas {kind}")
    return out


def colour_features(pixels: np.ndarray) -> np.ndarray:
    """124 numbers: 16-bin histograms of R, G, B, H, S, V with mean and deviation of each, and one of gray."""
    rgb = pixels[..., :3].reshape(-1, 3).astype(float) / 255
    top, low = rgb.max(1), rgb.min(1)
    span = top - low
    with np.errstate(divide="ignore", invalid="ignore"):
        r, g, b = rgb.T
        hue = np.select([span == 0, top == r, top == g], [0.0, ((g - b) / span) % 6, (b - r) / span + 2], (r - g) / span + 4) / 6
        sat = np.where(top > 0, span / top, 0.0)
    out = []
    for block in (rgb, np.stack([np.nan_to_num(hue), sat, top], 1)):
        out += [np.histogram(block[:, i], 16, (0, 1))[0] / len(block) for i in range(3)] + [block.mean(0), block.std(0)]
    return np.concatenate([*out, np.histogram(gray(pixels) / 255, 16, (0, 1))[0] / len(rgb)])
