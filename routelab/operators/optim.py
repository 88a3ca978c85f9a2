"""Bounded minimisation on the driver, numeric Hessians and standard errors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from routelab.functions.scalar import two_sided_p

Objective = Callable[[np.ndarray], float]
Slope = Callable[[np.ndarray], np.ndarray]


@dataclass
class Minimum:
    x: np.ndarray
    value: float
    converged: bool
    iterations: int


def gradient(f: Objective, x: np.ndarray, low: np.ndarray, high: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Central differences, one-sided at a bound."""
    out = np.empty(len(x))
    for k in range(len(x)):
        h = step * max(1.0, abs(x[k]))
        a, b = x.copy(), x.copy()
        a[k], b[k] = max(low[k], x[k] - h), min(high[k], x[k] + h)
        out[k] = (f(b) - f(a)) / (b[k] - a[k])
    return out


def projected_bfgs(f: Objective, x0: Sequence[float], bounds: Sequence[tuple[float, float]], max_iter: int = 200, tol: float = 1e-6, slope: Slope | None = None) -> Minimum:
    """Quasi-Newton descent within a box: steps bend at bounds, curvature is kept for the free coordinates; without a slope by differences."""
    slope = slope or (lambda x: gradient(f, x, low, high))
    low, high = (np.array(b, float) for b in zip(*bounds))
    x = np.clip(np.array(x0, float), low, high)
    value, g, h = f(x), slope(x), np.eye(len(x))
    for at in range(max_iter):
        free = ~(((x <= low) & (g > 0)) | ((x >= high) & (g < 0)))
        if np.abs(np.where(free, g, 0)).max() < tol * max(1.0, abs(value)):
            return Minimum(x, value, True, at)
        d = np.where(free, -(np.where(free[:, None] & free[None], h, 0) @ np.where(free, g, 0)), 0)
        if d @ g >= 0:
            h, d = np.eye(len(x)), np.where(free, -g, 0)
        t, new = 1.0, x
        for _ in range(40):
            new = np.clip(x + t * d, low, high)
            found = f(new)
            if np.isfinite(found) and found <= value + 1e-4 * g @ (new - x):
                break
            t /= 2
        else:
            return Minimum(x, value, False, at)
        g_new = slope(new)
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            r, i = 1 / (s @ y), np.eye(len(x))
            h = (i - r * np.outer(s, y)) @ h @ (i - r * np.outer(y, s)) + r * np.outer(s, s)
        small = abs(value - found) <= 1e-12 * max(1.0, abs(value)) and np.abs(s).max() <= 1e-10
        x, value, g = new, found, g_new
        if small:
            return Minimum(x, value, True, at + 1)
    return Minimum(x, value, False, max_iter)


def nelder_mead(f: Objective, x0: Sequence[float], bounds: Sequence[tuple[float, float]], max_iter: int = 2000, xatol: float = 1e-5, fatol: float = 1e-7) -> Minimum:
    """Downhill simplex; points are clipped into the box."""
    low, high = (np.array(b, float) for b in zip(*bounds))
    clip = lambda x: np.clip(x, low, high)
    n = len(x0)
    points = [clip(np.array(x0, float))]
    for k in range(n):
        p = points[0].copy()
        p[k] += 0.05 * max(1.0, abs(p[k])) * (-1 if p[k] + 0.05 > high[k] else 1)
        points.append(clip(p))
    values = [f(p) for p in points]
    for at in range(max_iter):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if max(np.abs(p - points[0]).max() for p in points[1:]) <= xatol and values[-1] - values[0] <= fatol:
            return Minimum(points[0], values[0], True, at)
        middle = np.mean(points[:-1], 0)
        reflected = clip(2 * middle - points[-1])
        v = f(reflected)
        if v < values[0]:
            far = clip(3 * middle - 2 * points[-1])
            w = f(far)
            points[-1], values[-1] = (far, w) if w < v else (reflected, v)
        elif v < values[-2]:
            points[-1], values[-1] = reflected, v
        else:
            near = clip((middle + (reflected if v < values[-1] else points[-1])) / 2)
            w = f(near)
            if w < min(v, values[-1]):
                points[-1], values[-1] = near, w
            else:
                points = [points[0], *(clip((p + points[0]) / 2) for p in points[1:])]
                values = [values[0], *(f(p) for p in points[1:])]
    return Minimum(points[0], values[0], False, max_iter)


def minimise(f: Objective, x0: Sequence[float], bounds: Sequence[tuple[float, float]], method: str = "bfgs", slope: Slope | None = None) -> Minimum:
    if method == "bfgs":
        return projected_bfgs(f, x0, bounds, slope=slope)
    if method == "nelder-mead":
        return nelder_mead(f, x0, bounds)
    raise ValueError(f"unknown method {method}")


def hessian(f: Objective, x: np.ndarray, eps: float = 1e-4) -> np.ndarray:
    """Central second differences with steps eps * max(|x|, 1)."""
    n = len(x)
    h = eps * np.maximum(np.abs(x), 1.0)
    out = np.empty((n, n))
    at = lambda *moves: f(x + sum(s * h[k] * np.eye(n)[k] for k, s in moves))
    for i in range(n):
        for j in range(i, n):
            corners = at((i, 1), (j, 1)) - at((i, 1), (j, -1)) - at((i, -1), (j, 1)) + at((i, -1), (j, -1))
            out[i, j] = out[j, i] = corners / (4 * h[i] * h[j])
    return out


def standard_errors(f: Objective, x: np.ndarray, names: Sequence[str], eps: float = 1e-4) -> dict[str, dict[str, float]]:
    """:func:`errors_of` the numeric Hessian."""
    return errors_of(hessian(f, np.asarray(x, float), eps), x, names)


def errors_of(curvature: np.ndarray, x: Sequence[float], names: Sequence[str]) -> dict[str, dict[str, float]]:
    """se, z and two-sided p of each parameter, whose variances are the inverse curvature's; NaN where that gives none."""
    regular = np.linalg.matrix_rank(curvature) == len(names)
    variance = np.diag(np.linalg.inv(curvature) if regular else np.linalg.pinv(curvature))
    curved = np.abs(np.diag(curvature)) > 1e-12 * np.abs(curvature).max()  # the data say nothing of a parameter without curvature
    se = {n: float(np.sqrt(v)) if v >= 0 and c else float("nan") for n, v, c in zip(names, variance, curved)}
    z = {n: float(value / se[n]) if se[n] > 0 else float("nan") for n, value in zip(names, x)}
    return {"se": se, "z": z, "pval": {n: two_sided_p(v) if np.isfinite(v) else float("nan") for n, v in z.items()}}
