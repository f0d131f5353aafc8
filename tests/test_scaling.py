import numpy as np
import pytest

from hemline.operators import scaling as Z


def _frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "y double")


def _llf(y, lam):
    bc = np.log(y) if abs(lam) < 1e-9 else (y**lam - 1) / lam
    return (lam - 1) * np.log(y).sum() - len(y) / 2 * np.log(bc.var())


@pytest.mark.parametrize("power", [3.0, 0.0, -1.0])
def test_lambda_maximises_the_likelihood(spark, power):
    z = np.random.default_rng(1).normal(10, 1, 800)
    y = np.exp(z / 5) if power == 0 else z ** (1 / power)
    lam = Z.fit_boxcox(_frame(spark, y), "y")
    best = _llf(y, lam)
    assert all(_llf(y, lam + d) <= best + 1e-9 for d in (-0.1, -0.001, -0.0002, 0.0002, 0.001, 0.1))


def test_fit_needs_positive_varied_values(spark):
    with pytest.raises(ValueError, match="positive"):
        Z.fit_boxcox(_frame(spark, [0, 1, 2]), "y")
    with pytest.raises(ValueError, match="different"):
        Z.fit_boxcox(_frame(spark, [3, 3, 3]), "y")
    with pytest.raises(ValueError, match="equal"):
        Z.fit_anchor(_frame(spark, [1, 3, 3, 3, 3, 3, 3, 3, 3, 3]), "y")


@pytest.mark.parametrize(
    "form,lam,low",
    [("power", None, 0), ("power", 0.0, 1), ("power", -0.7, 0), ("boxcox", None, 1), ("boxcox", 0.0, 0), ("boxcox", 0.5, 1)],
)
def test_anchor_round_trip(spark, form, lam, low):
    df = _frame(spark, range(low, 60))
    scaler = Z.fit_anchor(df, "y", form=form, lam=lam)
    assert scaler.shift == (1.0 if low <= 0 else 0.0)
    rows = scaler.unscale(scaler.scale(df, "y")).collect()
    assert np.allclose([r.y for r in rows], [r.restored for r in rows])


def test_one_unit_does_not_lift_large_negatives(spark):
    with pytest.raises(ValueError, match="positive"):
        Z.fit_anchor(_frame(spark, range(-3, 60)), "y")


def test_anchors_run_downward(spark):
    df = _frame(spark, range(1, 101))
    scaler = Z.fit_anchor(df, "y")
    lo, hi = Z.quantiles(df, "y")
    rows = scaler.scale(_frame(spark, [lo, hi]), "y").collect()
    assert np.allclose([r.scaled for r in rows], [1.0, -1.0])


def test_zero_is_shifted_and_undone(spark):
    df = _frame(spark, [0, 0, 1, 2, 5, 9, 30])
    for scaler in (Z.fit_anchor(df, "y"), Z.fit_standard(df, "y")):
        assert scaler.shift == 1.0
        rows = scaler.unscale(scaler.scale(df, "y")).collect()
        assert np.allclose([r.y for r in rows], [r.restored for r in rows])


def test_standard_uses_population_deviation(spark):
    df = _frame(spark, np.random.default_rng(3).gamma(2, 9, 500) + 1)
    scaled = np.array([r.scaled for r in Z.fit_standard(df, "y").scale(df, "y").collect()])
    assert abs(scaled.mean()) < 1e-9 and abs(scaled.std() - 1) < 1e-9


def test_quantiles_by_rank_equal_numpy(spark, monkeypatch):
    values = np.random.default_rng(5).integers(0, 400, 3000).astype(float)
    df = _frame(spark, np.concatenate([values, np.full(1500, 77.0)])).repartition(6)
    y = [r.y for r in df.collect()]
    want = np.quantile(y, [0.0, 0.16, 0.5, 0.84, 1.0])
    assert np.allclose(Z.quantiles(df, "y", [0.0, 0.16, 0.5, 0.84, 1.0]), want)
    monkeypatch.setattr(Z, "QUANTILE_LIMIT", 1)
    assert np.allclose(Z.quantiles(df, "y", [0.0, 0.16, 0.5, 0.84, 1.0]), want)
    # A coarse sketch, which may miss the rank, must not change the result.
    monkeypatch.setattr(Z, "SKETCH_ACCURACY", 5)
    assert np.allclose(Z.quantiles(df, "y", [0.0, 0.16, 0.5, 0.84, 1.0]), want)
    assert abs(Z.quantiles(df, "y", [0.5], approx=True)[0] - want[2]) <= 2


def test_residual_scalers(spark):
    df = _frame(spark, [1, 3, 5])
    assert [r.scaled for r in Z.fit_linear_scaler(df, "y").scale(df, "y").collect()] == [0.0, 0.5, 1.0]
    z = [r.scaled for r in Z.fit_linear_scaler(df, "y", "standard").scale(df, "y").collect()]
    assert np.allclose(z, (np.array([1, 3, 5]) - 3) / np.std([1, 3, 5]))
    flat = _frame(spark, [4, 4])
    for method in ("minmax", "standard"):
        scaler = Z.fit_linear_scaler(flat, "y", method)
        rows = scaler.unscale(scaler.scale(flat, "y")).collect()
        assert [(r.scaled, r.restored) for r in rows] == [(0.0, 4.0)] * 2
