"""ARMA candidates, coefficients and summary measures against NumPy."""

import datetime
import math

import numpy as np
import pytest

from tillroll.operators import arma, timeseries


def month(i):
    return datetime.date(2001 + i // 12, 1 + i % 12, 1)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    e = rng.normal(size=80) * 10
    ma = [100 + e[i] + 0.8 * (e[i - 1] if i else 0) for i in range(80)]
    season = [100 + 20 * math.sin(i * math.pi / 6) + e[i] for i in range(80)]
    return {"ma": ma, "season": season, "walk": list(np.cumsum(e) + 500), "short": [5.0, 7, 4, 8, 6, 9, 5.5, 7.5]}


@pytest.fixture(scope="module")
def series(spark, values):
    rows = [(s, i + 1, month(i), float(v)) for s, ys in values.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "series string, t int, Date date, TotalSales double").repartition(3).cache()


def design(y, terms):
    """Columns of a candidate, by NumPy: (rows scored, response, matrix)."""
    z = np.array(y) - np.mean(y)
    held = {"z": z, "d": np.concatenate(([np.nan], np.diff(z)))}
    lag = lambda x, k: np.concatenate((np.full(k, np.nan), x[:-k]))
    for c, e in (("z", "e"), ("d", "u")):
        x = np.column_stack([np.ones(len(z)), *(lag(held[c], k) for k in (1, 2, 3))])
        ok = ~np.isnan(x).any(axis=1)
        b = np.linalg.lstsq(x[ok], held[c][ok], rcond=None)[0]
        held[e] = held[c] - x @ b
        for k in (1, 2):
            held[f"{c}{k}"] = lag(held[c], k)
        held[f"{e}1"] = lag(held[e], 1)
    held["zs"] = lag(z, 12)
    rows = np.arange(len(z)) >= 12
    return rows, held[terms[0]], np.column_stack([np.ones(len(z)), *(held[x] for x in terms[1])])


def test_candidates_are_least_squares(series, values):
    _, fits = timeseries.candidate_values(series)
    got = {r["series"]: r["fits"] for r in fits.select("series", "fits").collect()}
    for s in ("ma", "season", "walk"):
        for m, (y, xs) in arma.CANDIDATES.items():
            rows, response, x = design(values[s], (y, xs))
            b = np.linalg.lstsq(x[rows], response[rows], rcond=None)[0]
            assert np.allclose(got[s][m]["b"], b, rtol=1e-6, atol=1e-8)
            assert np.allclose(got[s][m]["v"], np.diag(np.linalg.inv(x[rows].T @ x[rows])), rtol=1e-6)


def test_terms_are_found_and_no_series_loses(series):
    fits = timeseries.forecast_accuracy(series).collect()
    best = {r["series"]: r["model"] for r in fits if r["chosen"]}
    assert best["ma"] in ("ma1", "arma11") and "sar1" in best["season"]
    for s in best:
        own = {r["model"]: r["aicc"] for r in fits if r["series"] == s}
        assert own[best[s]] <= min(v for m, v in own.items() if m in timeseries.CLOSED)
        assert len({r["m"] for r in fits if r["series"] == s}) == 1                  # all on the same rows


def test_forecast_follows_the_recursion(series, values):
    got = sorted((r["h"], r["forecast"], r["se"], r["model"]) for r in timeseries.forecast(series).where(
        "series = 'season'").collect())
    model = got[0][3]
    y, xs = arma.CANDIDATES[model]
    assert y == "z"
    rows, response, x = design(values["season"], (y, xs))
    b = np.linalg.lstsq(x[rows], response[rows], rcond=None)[0]
    by = dict(zip(xs, b[1:]))
    z, psi = list(np.array(values["season"]) - np.mean(values["season"])), [0.0] * 12 + [1.0]
    long = np.column_stack([np.ones(77), *(np.array(z)[3 - k:80 - k] for k in (1, 2, 3))])
    e_n = (np.array(z)[3:] - long @ np.linalg.lstsq(long, np.array(z)[3:], rcond=None)[0])[-1]
    sigma = math.sqrt(((response - x @ b)[rows] ** 2).sum() / (rows.sum() - len(b)))
    for h in range(12):
        shock = by.get("e1", 0) * e_n if h == 0 else 0
        z.append(b[0] + by.get("z1", 0) * z[-1] + by.get("z2", 0) * z[-2] + by.get("zs", 0) * z[-12] + shock)
        psi.append(by.get("z1", 0) * psi[-1] + by.get("z2", 0) * psi[-2] + by.get("zs", 0) * psi[-12]
                   + (by.get("e1", 0) if h == 0 else 0))
        assert got[h][1] == pytest.approx(z[-1] + np.mean(values["season"]), rel=1e-8)
        assert got[h][2] == pytest.approx(sigma * math.sqrt(sum(p * p for p in psi[12:13 + h])), rel=1e-8)


def test_summary_measures(series, values):
    fitted = timeseries.fitted_values(series).collect()
    for r in timeseries.forecast_summary(series).collect():
        y = np.array(values[r["series"]])
        own = sorted((f for f in fitted if f["series"] == r["series"]), key=lambda f: f["Date"])
        skip = 12 if len(y) > 16 else 2
        e = np.array([f["residual"] for f in own[skip:]])
        scored = y[skip:]
        assert r["me"] == pytest.approx(e.mean(), abs=1e-9) and r["mae"] == pytest.approx(abs(e).mean())
        assert r["rmse"] == pytest.approx(math.sqrt((e * e).mean())) and r["mape"] == pytest.approx(100 * abs(e / scored).mean())
        c = e - e.mean()
        assert r["acf1"] == pytest.approx((c[1:] * c[:-1]).sum() / (c * c).sum())
        if len(y) > 16:
            assert r["mase"] == pytest.approx(abs(e).mean() / abs(y[12:] - y[:-12]).mean())
        else:
            assert r["mase"] is None
        assert r["aic"] == pytest.approx(2 * (r["p"] + 1) - 2 * r["loglik"])


def test_coefficients_of_closed_models(spark):
    rng = np.random.default_rng(3)
    y = [10.0]
    for _ in range(14):
        y.append(0.7 * y[-1] + rng.normal())
    df = spark.createDataFrame([("s", i + 1, month(i), v) for i, v in enumerate(y)],
                               "series string, t int, Date date, TotalSales double")
    got = {r["term"]: r for r in timeseries.forecast_coefficients(df).collect()}
    chosen = next(r for r in timeseries.forecast_accuracy(df).collect() if r["chosen"])
    assert chosen["model"] in ("ar1", "ar1_diff", "mean", "drift", "ar2") and len(got) == chosen["p"]
    if chosen["model"] == "ar1":
        x = np.column_stack([np.ones(14), y[:-1]])
        b = np.linalg.lstsq(x, np.array(y[1:]), rcond=None)[0]
        se = chosen["sigma"] * np.sqrt(np.diag(np.linalg.inv(x.T @ x)))
        assert np.allclose([got["const"]["estimate"], got["y1"]["estimate"]], b)
        assert np.allclose([got["const"]["std_error"], got["y1"]["std_error"]], se)


def test_constant_and_tiny_series(spark):
    rows = [("flat", i + 1, month(i), 5.0) for i in range(30)] + [("one", 1, month(0), 3.0)]
    df = spark.createDataFrame(rows, "series string, t int, Date date, TotalSales double")
    assert timeseries.forecast_accuracy(df).count() == 0 and timeseries.forecast_summary(df).count() == 0
    assert timeseries.forecast(df).count() == 0 and timeseries.forecast_coefficients(df).count() == 0
