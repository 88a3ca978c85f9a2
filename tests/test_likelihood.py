"""The one-job likelihood against plain numpy: value, gradient, curvature, fits and standard errors."""

import math

import numpy as np
import pytest

from routelab.config import Betas
from routelab.operators import eps, optim
from routelab.operators.likelihood import LEAST_P, newton

SCHEMA = "obs_id bigint, path_text string, chosen boolean, ivt_min double, wait_min double, walk_min double, n_transfers bigint, expanded_path_size double, sampling_correction double"


def made(n_obs=400, seed=7):
    rng, rows = np.random.default_rng(seed), []
    for obs in range(n_obs):
        k = int(rng.integers(2, 7))
        x = np.column_stack([rng.uniform(0, 20, k), rng.uniform(0, 10, k), rng.uniform(0, 8, k), rng.integers(0, 3, k), rng.uniform(0.2, 1, k)])
        c = rng.normal(0, 0.5, k)
        u = -(x[:, :4] @ [0.3, 0.2, 0.25, 0.8]) + 0.6 * np.log(x[:, 4]) + c + rng.gumbel(size=k)
        rows += [(obs, str(j), bool(j == u.argmax()), *map(float, x[j, :3]), int(x[j, 3]), float(x[j, 4]), float(c[j])) for j in range(k)]
    return rows


def brute(rows):
    """The negative log-likelihood by loops."""
    sets = {}
    for r in rows:
        sets.setdefault(r[0], []).append(r)

    def f(b):
        total = 0.0
        for own in sets.values():
            u = [b[4] * math.log(max(r[7], 1e-9)) + r[8] - b[0] * r[3] - b[1] * r[4] - b[2] * r[5] - b[3] * r[6] for r in own]
            e = [math.exp(v - max(u)) for v in u]
            total -= sum(math.log(max(x / sum(e), LEAST_P)) for x, r in zip(e, own) if r[2])
        return total

    return f


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def model(spark, rows):
    return eps.logit(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_value_gradient_and_curvature(model, rows):
    f, n = brute(rows), 5
    points = [np.array([0.3, 0.2, 0.25, 0.8, 0.6]), np.zeros(n), np.array([-0.1, 0.4, 0.0, 1.0, -2.0])]
    before = model.jobs
    for p, local in zip(points, model.at(points)):
        assert local.value == pytest.approx(f(p), rel=1e-12)
        assert local.gradient == pytest.approx(optim.gradient(f, p, np.full(n, -9.0), np.full(n, 9.0)), abs=1e-4)
        assert local.hessian == pytest.approx(optim.hessian(f, p), rel=1e-4, abs=1e-3)
    assert model.jobs == before + 1 and model.n_obs == 400


def test_fit_and_errors_are_brute_force(spark, rows, model):
    f = brute(rows)
    fit = eps.fit(spark.createDataFrame(rows, SCHEMA), Betas(0.0, 0.0, 0.0, 0.0, 0.0), errors=True)
    best = optim.minimise(f, [0.3, 0.2, 0.25, 0.8, 0.6], [(-5, 5)] * 5)
    x = np.array(list(fit["betas"].values()))
    assert fit["converged"] and x == pytest.approx(best.x, abs=1e-5) and -fit["log_likelihood"] == pytest.approx(best.value, abs=1e-6)
    numeric = optim.standard_errors(f, x, eps.NAMES)
    assert [fit["se"][n] for n in eps.NAMES] == pytest.approx([numeric["se"][n] for n in eps.NAMES], rel=1e-5)
    before = model.jobs
    assert newton(model, np.zeros(5), [(-5, 5)] * 5).converged and model.jobs - before <= 12
    bfgs = eps.fit(spark.createDataFrame(rows, SCHEMA), method="bfgs")
    assert list(bfgs["betas"].values()) == pytest.approx(x, abs=1e-4)


def test_bounds_hold(model):
    found = newton(model, np.zeros(5), [(-5, 5), (-5, 0.1), (-5, 5), (-5, 5), (0.9, 5)])
    assert found.converged and found.x[1] == 0.1 and found.x[4] == 0.9


def test_lost_choices_and_flat_attributes(spark, rows):
    """Observations without their chosen row count nowhere; an attribute that never differs keeps its start and has no errors."""
    some = [r[:5] + (3.0,) + r[6:] for r in rows if not (r[2] and r[0] % 4 == 0)]
    fit = eps.fit(spark.createDataFrame(some, SCHEMA), Betas(0.1, 0.1, 0.7, 0.1, 0.1), errors=True)
    assert fit["n_obs"] == len({r[0] for r in some if r[2]})
    assert fit["converged"] and fit["betas"]["walk"] == pytest.approx(0.7) and not fit["z"]["walk"] == fit["z"]["walk"]


def test_far_points_stay_finite(model, rows):
    p = np.array([400.0, -300.0, 50.0, 80.0, 20.0])
    local = model.at([p])[0]
    assert local.value == pytest.approx(brute(rows)(p), rel=1e-9) and np.isfinite(local.gradient).all() and np.isfinite(local.hessian).all()
