"""Dense stencils on haloed tiles: smoothing, edge strength, orientation, ridges, oriented filters, soft skeletons.

Cells go to each tile whose halo has them, one task works on a tile's arrays, and only core cells come back. A halo
covers the whole support of a kernel, so results do not depend on the tile size; arrays end where the raster
ends, so that its edges are treated as edges and a tile's are not.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.order import exact_quantiles

TILE = 256
Arrays = dict[str, np.ndarray]


def reach(sigma: float) -> int:
    """Support of a Gaussian cut at four deviations."""
    return int(4 * sigma + 0.5)


def on_tiles(cells: DataFrame, columns: list[str], halo: int, kernel: Callable[[Arrays], Arrays], outputs: list[str], height: int, width: int, tile: int = TILE) -> DataFrame:
    """row, col and ``outputs`` of ``kernel`` over arrays of ``columns`` and valid; missing cells are invalid and NaN."""

    def owners(x: str, size: int):
        low = F.greatest(F.lit(0), F.floor((F.col(x) - halo) / tile))
        high = F.least(F.lit((size - 1) // tile), F.floor((F.col(x) + halo) / tile))
        return F.sequence(low.cast("int"), high.cast("int"))

    dealt = cells.select("row", "col", "valid", *columns).withColumn("tile_r", F.explode(owners("row", height))).withColumn("tile_c", F.explode(owners("col", width)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(pdf["tile_r"].iloc[0]) * tile, int(pdf["tile_c"].iloc[0]) * tile
        r0, c0 = max(0, tr - halo), max(0, tc - halo)
        shape = min(height, tr + tile + halo) - r0, min(width, tc + tile + halo) - c0
        r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
        arrays: Arrays = {"valid": np.zeros(shape, bool)}
        arrays["valid"][r, c] = pdf["valid"].to_numpy().astype(bool)
        for name in columns:
            arrays[name] = np.full(shape, np.nan)
            arrays[name][r, c] = pdf[name].to_numpy(float)
        found = kernel(arrays)
        core = (r + r0 >= tr) & (r + r0 < tr + tile) & (c + c0 >= tc) & (c + c0 < tc + tile)
        return pd.DataFrame({"row": r[core] + r0, "col": c[core] + c0} | {k: found[k][r[core], c[core]].astype(float) for k in outputs})

    return dealt.groupBy("tile_r", "tile_c").applyInPandas(run, "row long, col long, " + ", ".join(f"{k} double" for k in outputs))


def _correlate(x: np.ndarray, kernel: np.ndarray, mode: str) -> np.ndarray:
    h, w = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = np.pad(x, ((h, h), (w, w)), mode={"nearest": "edge", "reflect": "symmetric"}[mode])
    out = np.zeros_like(x, dtype=float)
    for i, j in zip(*np.nonzero(kernel)):
        out += kernel[i, j] * padded[i : i + x.shape[0], j : j + x.shape[1]]
    return out


def gaussian(x: np.ndarray, sigma: float, mode: str = "reflect") -> np.ndarray:
    if sigma <= 0:
        return x.astype(float)
    r = reach(sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    return _correlate(_correlate(x, k[:, None], mode), k[None, :], mode)


def laplacian(x: np.ndarray) -> np.ndarray:
    return _correlate(x, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float), "reflect")


def masked_gaussian(x: np.ndarray, valid: np.ndarray, sigma: float) -> np.ndarray:
    """Normalised convolution over valid finite cells; 0 where they weigh nothing."""
    ok = valid & np.isfinite(x)
    filled = np.where(ok, x, 0.0)
    if sigma <= 0:
        return filled
    weight = gaussian(ok.astype(float), sigma, "nearest")
    return np.where(weight > 1e-6, gaussian(filled, sigma, "nearest") / np.maximum(weight, 1e-6), 0.0)


def _gradient(x: np.ndarray, axis: int) -> np.ndarray:
    return np.gradient(x, axis=axis) if x.shape[axis] > 1 else np.zeros_like(x)


def _mean_over(bands: list[str], f: Callable[[str], tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    parts = [f(b) for b in bands]
    return [sum(p) / len(bands) for p in zip(*parts)]


def smoothed(cells: DataFrame, band: str, sigma: float, height: int, width: int, tile: int = TILE) -> DataFrame:
    return on_tiles(cells, [band], reach(sigma), lambda a: {"smooth": masked_gaussian(a[band], a["valid"], sigma)}, ["smooth"], height, width, tile)


def structure_tensor(cells: DataFrame, bands: list[str], sigma: float, window: float, height: int, width: int, tile: int = TILE) -> DataFrame:
    """coherence (0 to 1) and orientation of the smoothed gradient products; 0 outside valid cells."""

    def kernel(a: Arrays) -> Arrays:
        def products(b: str) -> tuple[np.ndarray, ...]:
            s = masked_gaussian(a[b], a["valid"], sigma)
            gy, gx = _gradient(s, 0), _gradient(s, 1)
            return tuple(masked_gaussian(p, a["valid"], window) for p in (gx * gx, gy * gy, gx * gy))

        xx, yy, xy = _mean_over(bands, products)
        gap = np.sqrt(np.maximum((xx + yy) ** 2 - 4 * (xx * yy - xy * xy), 0))
        return {"coherence": np.where(a["valid"], np.clip(gap / (xx + yy + 1e-6), 0, 1), 0), "orientation": np.where(a["valid"], 0.5 * np.arctan2(2 * xy, xx - yy), 0)}

    return on_tiles(cells, bands, reach(sigma) + 1 + reach(window), kernel, ["coherence", "orientation"], height, width, tile)


def scaled_by(values: DataFrame, cells: DataFrame, column: str, fit: str, quantile: float | None, low: float, least: float = 0.0, stat: float | None = None) -> DataFrame:
    """``column`` divided by the fit cells' exact quantile of its size (or their maximum), clipped to low..1; all 0 if that is not above ``least``.

    ``stat`` is a value from an earlier pass, to be used instead.
    """
    if stat is None:
        own = values.join(cells.where(F.col(fit) & F.col("valid")).select("row", "col"), ["row", "col"], "left_semi")
        size = F.abs(column)
        one = own.agg(F.array(F.max(size)).alias("q")) if quantile is None else exact_quantiles(own, size, [quantile])
        stat = (one.first()["q"] or [0.0])[0] or 0.0
    x = F.greatest(F.lit(low), F.least(F.lit(1.0), F.col(column) / stat)) if stat > least else F.lit(0.0)
    return values.withColumn(column, x)


def ridge_valley(cells: DataFrame, bands: list[str], scales: list[float], window: float, fit: str, height: int, width: int, tile: int = TILE) -> DataFrame:
    """Signed curvature response over scales: valleys above 0, ridges below, by the fit cells' 99th percentile."""

    def kernel(a: Arrays) -> Arrays:
        valley = ridge = np.zeros(a["valid"].shape)
        for scale in scales:

            def second(b: str, scale: float = scale) -> tuple[np.ndarray, ...]:
                s = masked_gaussian(a[b], a["valid"], scale)
                gy, gx = _gradient(s, 0), _gradient(s, 1)
                return tuple(masked_gaussian(p, a["valid"], window) for p in (_gradient(gx, 1), _gradient(gy, 0), _gradient(gx, 0)))

            xx, yy, xy = _mean_over(bands, second)
            half, root = (xx + yy) / 2, np.sqrt(np.maximum(((xx - yy) / 2) ** 2 + xy * xy, 0))
            valley = np.maximum(valley, 2 * root * np.maximum(half + root, 0))
            ridge = np.maximum(ridge, 2 * root * np.maximum(root - half, 0))
        return {"response": np.where(a["valid"], valley - ridge, 0)}

    halo = max(reach(s) for s in scales) + 2 + reach(window)
    return scaled_by(on_tiles(cells, bands, halo, kernel, ["response"], height, width, tile), cells, "response", fit, 0.99, -1.0)


def gabor(wavelength: float, angle: float, gamma: float = 0.5) -> np.ndarray:
    """Real kernel of zero mean; its side is at least three deviations and odd."""
    sigma = wavelength / (2 * math.pi * 0.56)
    half = (math.ceil(3 * sigma) | 1) // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1].astype(float)
    u, v = x * math.cos(angle) + y * math.sin(angle), y * math.cos(angle) - x * math.sin(angle)
    k = np.exp(-(u * u + (gamma * v) ** 2) / (2 * sigma * sigma)) * np.cos(2 * math.pi * u / wavelength)
    return k - k.mean()


def steerable(cells: DataFrame, bands: list[str], sigma: float, wavelength: float, angles: int, fit: str, height: int, width: int, tile: int = TILE) -> DataFrame:
    """Largest mean response over angles, by the fit cells' 99th percentile."""
    kernels = [gabor(wavelength, math.pi * i / angles) for i in range(angles)]

    def kernel(a: Arrays) -> Arrays:
        flat = [masked_gaussian(a[b], a["valid"], sigma) for b in bands]
        best = np.max([sum(np.abs(_correlate(x, k[::-1, ::-1], "nearest")) for x in flat) / len(bands) for k in kernels], axis=0)
        return {"response": np.where(a["valid"], best, 0)}

    halo = reach(sigma) + len(kernels[0]) // 2
    return scaled_by(on_tiles(cells, bands, halo, kernel, ["response"], height, width, tile), cells, "response", fit, 0.99, 0.0, 1e-6)


def edge_strength(values: DataFrame, cells: DataFrame, column: str, epsilon: float, lam: float, fit: str, height: int, width: int, tile: int = TILE, edge_max: float | None = None) -> DataFrame:
    """Laplacian of a Gaussian, by the fit cells' largest, through tanh(10 (1 + lam) x), smoothed again."""
    sigma = max(0.5, epsilon)
    base = values.join(cells.select("row", "col", "valid"), ["row", "col"])
    first = on_tiles(base, [column], reach(sigma) + 1, lambda a: {"edge": np.abs(laplacian(gaussian(np.nan_to_num(a[column]), sigma)))}, ["edge"], height, width, tile)
    if edge_max is None:
        edge_max = first.join(cells.where(fit).select("row", "col"), ["row", "col"], "left_semi").agg(F.max("edge")).first()[0] or 0.0
    scaled = first.withColumn("edge", F.tanh(F.col("edge") / (edge_max if edge_max > 0 else 1.0) * 10 * (1 + lam)))
    scaled = scaled.join(cells.select("row", "col", "valid"), ["row", "col"])
    return on_tiles(scaled, ["edge"], reach(0.3 * sigma), lambda a: {"edge": gaussian(np.nan_to_num(a["edge"]), 0.3 * sigma)}, ["edge"], height, width, tile)


def log_edges(cells: DataFrame, bands: list[str], sigma: float, epsilon: float, fit: str, height: int, width: int, tile: int = TILE) -> DataFrame:
    """Edge strength of the bands' joint gradient: each band cut to its fit percentiles 2 and 98, smoothed; gradients' root mean square by the fit's largest."""
    long = cells.where(F.col(fit) & F.col("valid")).select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("x")) for b in bands])).alias("s")).select("s.*")
    cuts = {r["band"]: r["q"] for r in exact_quantiles(long, "x", [0.02, 0.98], ["band"]).collect()}

    def kernel(a: Arrays) -> Arrays:
        energy = np.zeros(a["valid"].shape)
        for b in bands:
            lo, hi = cuts.get(b, (0.0, 0.0))
            x = np.clip((a[b] - lo) / (hi - lo), 0, 1) if hi > lo else np.full(a[b].shape, 0.5)
            s = masked_gaussian(x, a["valid"], sigma)
            energy += _gradient(s, 0) ** 2 + _gradient(s, 1) ** 2
        return {"norm": np.sqrt(energy / len(bands))}

    norm = on_tiles(cells, bands, reach(sigma) + 1, kernel, ["norm"], height, width, tile)
    top = norm.join(cells.where(F.col(fit) & F.col("valid")).select("row", "col"), ["row", "col"], "left_semi").agg(F.max("norm")).first()[0] or 0.0
    if top > 0:
        norm = norm.withColumn("norm", F.col("norm") / top)
    return edge_strength(norm, cells, "norm", epsilon, 0.1, fit, height, width, tile)


def _pool(x: np.ndarray, largest: bool) -> np.ndarray:
    """3 x 3 pool; outside the raster is 0."""
    p = np.pad(x, 1)
    views = [p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)]
    return np.max(views, axis=0) if largest else np.min(views, axis=0)


def soft_skeleton(x: np.ndarray, iterations: int = 5) -> np.ndarray:
    """Top hats of successive erosions, summed and clipped to 0..1."""
    total = np.zeros_like(x, dtype=float)
    for i in range(iterations + 1):
        x = _pool(x, False) if i else x
        total += np.maximum(x - _pool(_pool(x, False), True), 0)
    return np.clip(total, 0, 1)


def skeletons(cells: DataFrame, height: int, width: int, iterations: int = 5, tile: int = TILE) -> DataFrame:
    """soft, of the predictions, and target, of the truth, inside valid cells."""

    def kernel(a: Arrays) -> Arrays:
        p = np.where(a["valid"], np.nan_to_num(a["p"]), 0)
        t = np.where(a["valid"], np.nan_to_num(a["truth"]), 0)
        return {"soft": soft_skeleton(p, iterations), "target": (soft_skeleton(t, iterations) > 0.5).astype(float)}

    numbers = cells.withColumn("truth", F.col("truth").cast("double"))
    return on_tiles(numbers, ["p", "truth"], iterations + 3, kernel, ["soft", "target"], height, width, tile)


def skeleton_recall_loss(found: DataFrame) -> DataFrame:
    """1 - recall of the target skeleton; 0 if there is none."""
    hit, n = F.sum(F.col("soft") * F.col("target")), F.sum("target")
    recall = F.when(n > 0, 1 - hit / (n + 1e-12)).otherwise(0.0)
    return found.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), recall)).alias("loss"), n.alias("target_cells"))


def haar_energy(x: np.ndarray, level: int) -> np.ndarray:
    """Sum of the squared undecimated Haar details at dilation 2^(level - 1); the neighbours are the next cells, mirrored at the edges."""
    d = 1 << (level - 1)

    def ahead(y: np.ndarray, axis: int) -> np.ndarray:
        at = np.arange(y.shape[axis]) + d
        last = y.shape[axis] - 1
        at = np.where(at > last, 2 * last - at, at)
        return np.take(y, np.clip(at, 0, last), axis)

    low, high = (x + ahead(x, 1)) / 2, (x - ahead(x, 1)) / 2
    return (low - ahead(low, 0)) ** 2 + (high + ahead(high, 0)) ** 2 + (high - ahead(high, 0)) ** 2


def wavelet_entropy(cells: DataFrame, bands: list[str], sigma: float, levels: list[int], height: int, width: int, tile: int = TILE) -> DataFrame:
    """entropy of the levels' shares of detail energy, mean over bands; 0 without energy and outside valid cells. ``scaled_by`` divides by the 99th percentile."""
    if not levels or any(x != int(x) or not 1 <= x <= 6 for x in levels):
        raise ValueError("levels must be whole numbers from 1 to 6")

    def kernel(a: Arrays) -> Arrays:
        total = np.zeros(a["valid"].shape)
        for b in bands:
            e = np.stack([haar_energy(masked_gaussian(a[b], a["valid"], sigma), int(x)) for x in levels])
            whole = e.sum(0)
            q = e / (whole + 1e-12)
            total += np.where(whole > 1e-12, np.maximum(-(q * np.log(q + 1e-12)).sum(0), 0), 0)
        return {"entropy": np.where(a["valid"], total / len(bands), 0)}

    return on_tiles(cells, bands, reach(sigma) + (1 << (int(max(levels)) - 1)), kernel, ["entropy"], height, width, tile)


def multiband_edges(cells: DataFrame, bands: list[str], epsilon: float, lam: float, fit: str, height: int, width: int, tile: int = TILE, norm: bool = False) -> DataFrame:
    """Edge strength of each band, then the mean or the vector norm over bands, at most 1."""
    parts = None
    for b in bands:
        own = edge_strength(cells.select("row", "col", F.when(F.col("valid"), F.col(b)).otherwise(0.0).alias(b)), cells, b, epsilon, lam, fit, height, width, tile).withColumnRenamed("edge", f"e_{b}")
        parts = own if parts is None else parts.join(own, ["row", "col"])
    e = [F.col(f"e_{b}") for b in bands]
    total = F.sqrt(sum((x * x for x in e), F.lit(0.0)) / len(e)) if norm else sum(e, F.lit(0.0)) / len(e)
    return parts.select("row", "col", F.least(F.lit(1.0), total).alias("edge"))


KINDS = ("gradient_energy", "phase_edge", "mumford_shah_log", "structure_tensor_coherence", "structure_tensor_orientation", "ridge_valley_response", "steerable_filter", "wavelet_entropy")


def lineament_features(cells: DataFrame, groups: dict[str, list[str]], kind: str, fit: str, height: int, width: int, sigma: float = 1.0, window: float = 2.0, epsilon: float = 1.0, wavelength: float = 6.0, angles: int = 8, levels: tuple[int, ...] = (1, 2, 3), scales: tuple[float, ...] = (), tile: int = TILE) -> DataFrame:
    """row, col and one derived column for each group of bands."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(KINDS)}")
    out = None
    for name, bands in groups.items():
        if kind in ("gradient_energy", "phase_edge"):

            def energy(a: Arrays, bands: list[str] = bands) -> Arrays:
                s = [masked_gaussian(a[b], a["valid"], sigma) for b in bands]
                e = np.sqrt(sum(_gradient(x, 0) ** 2 + _gradient(x, 1) ** 2 for x in s) / len(bands))
                e = e if kind == "gradient_energy" else 4 * epsilon * e / (1 + 4 * epsilon * e)
                return {"x": np.where(a["valid"], e, 0)}

            own = on_tiles(cells, bands, reach(sigma) + 1, energy, ["x"], height, width, tile)
        elif kind == "mumford_shah_log":
            own = log_edges(cells, bands, sigma, epsilon, fit, height, width, tile).withColumnRenamed("edge", "x")
        elif kind.startswith("structure_tensor"):
            own = structure_tensor(cells, bands, sigma, window, height, width, tile).withColumnRenamed(kind.rpartition("_")[2], "x")
        elif kind == "ridge_valley_response":
            own = ridge_valley(cells, bands, list(scales or (sigma,)), window, fit, height, width, tile).withColumnRenamed("response", "x")
        elif kind == "steerable_filter":
            own = steerable(cells, bands, sigma, wavelength, angles, fit, height, width, tile).withColumnRenamed("response", "x")
        else:
            own = scaled_by(wavelet_entropy(cells, bands, sigma, list(levels), height, width, tile), cells, "entropy", fit, 0.99, 0.0, 1e-6).withColumnRenamed("entropy", "x")
        own = own.select("row", "col", F.col("x").alias(name))
        out = own if out is None else out.join(own, ["row", "col"])
    return out


#: What a configuration that does not name a setting means.
LINEAMENT_DEFAULTS = {
    "kind": "phase_edge", "sigma_pixels": 1.0, "phase_epsilon_pixels": 1.0, "structure_tensor_window": 3.0, "ridge_valley_scales": None,
    "steerable_wavelength": 8.0, "steerable_orientations": 8, "wavelet_levels": None,
}


def lineament_settings(config: dict) -> dict:
    """The arguments of ``lineament_features`` that a configuration means, checked; settings of other names are ignored."""
    own = {k: config.get(k, v) for k, v in LINEAMENT_DEFAULTS.items()}
    out = {
        "kind": str(own["kind"]), "sigma": float(own["sigma_pixels"]), "epsilon": float(own["phase_epsilon_pixels"]), "window": float(own["structure_tensor_window"]),
        "wavelength": float(own["steerable_wavelength"]), "angles": int(own["steerable_orientations"]),
    }
    if own["ridge_valley_scales"] is not None:
        out["scales"] = tuple(float(x) for x in own["ridge_valley_scales"])
    if own["wavelet_levels"] is not None:
        out["levels"] = tuple(own["wavelet_levels"])
    rules = {
        "kind must be one of " + ", ".join(KINDS): out["kind"] in KINDS, "sigma_pixels must be finite and not negative": math.isfinite(out["sigma"]) and out["sigma"] >= 0,
        "phase_epsilon_pixels must be positive": 0 < out["epsilon"] < math.inf, "structure_tensor_window must be positive": 0 < out["window"] < math.inf,
        "steerable_wavelength must be positive": 0 < out["wavelength"] < math.inf, "steerable_orientations must be positive": out["angles"] >= 1,
        "ridge_valley_scales must be positive": all(0 < x < math.inf for x in out.get("scales", ())) and out.get("scales") != (),
        "wavelet_levels must be whole numbers from 1 to 6": all(x == int(x) and 1 <= x <= 6 for x in out.get("levels", ())) and out.get("levels") != (),
    }
    if wrong := [text for text, right in rules.items() if not right]:
        raise ValueError("; ".join(wrong))
    return out


def tile_halo(kind: str, sigma: float = 1.0, window: float = 2.0, epsilon: float = 1.0, wavelength: float = 6.0, levels: tuple[int, ...] = (1, 2, 3)) -> int:
    """The true support of each kind, which is also the buffer that keeps fit cells from seeing held-out ones."""
    s = max(0.5, epsilon)
    return {
        "gradient_energy": reach(sigma) + 1,
        "phase_edge": reach(sigma) + 1,
        "mumford_shah_log": reach(sigma) + 1 + reach(s) + 1 + reach(0.3 * s),
        "structure_tensor_coherence": reach(sigma) + 1 + reach(window),
        "structure_tensor_orientation": reach(sigma) + 1 + reach(window),
        "ridge_valley_response": reach(sigma) + 2 + reach(window),
        "steerable_filter": reach(sigma) + len(gabor(wavelength, 0.0)) // 2,
        "wavelet_entropy": reach(sigma) + (1 << (max(levels) - 1)),
    }[kind]
