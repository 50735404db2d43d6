import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import cycles as cy
from barloom.operators import tensor as tn


@pytest.fixture(scope="module")
def wave(make_bars):
    rng = np.random.default_rng(5)
    t = np.arange(220)
    return make_bars({"S": 100 + 5 * np.sin(2 * np.pi * t / 20) + rng.normal(scale=0.2, size=220), "N": 100 + rng.normal(size=220)}).cache()


def test_dominant_cycle_of_a_sine(wave):
    top = cy.dominant_cycles(wave, window=200).where("symbol = 'S' AND k = 1").first()
    assert top["period"] == pytest.approx(20, abs=1)
    assert cy.rolling_dominant_period(wave).where("symbol = 'S' AND period NOT BETWEEN 18 AND 22").count() == 0
    assert cy.rolling_dominant_period(wave, window=31).where("period IS NOT NULL").count() == 0


def test_filters_are_orthonormal():
    for order in cy.DAUBECHIES:
        low, high = cy.filter_pair(order)
        assert low.sum() == pytest.approx(math.sqrt(2)) and (low**2).sum() == pytest.approx(1)
        assert high.sum() == pytest.approx(0, abs=1e-9) and (low * high).sum() == pytest.approx(0, abs=1e-9)


def energies_one(x, order):
    low, high = cy.filter_pair(order)
    out = []
    for _ in range(int(math.log2(len(x))) - 1):
        p = np.pad(x, len(low) - 1, mode="reflect")
        d = np.convolve(p, high, mode="valid")[::2]
        out.append((d * d).mean())
        x = np.convolve(p, low, mode="valid")[::2]
        if len(x) < 8:
            break
    return np.array(out)


def test_detail_energies_against_convolution():
    x = np.random.default_rng(6).normal(size=(4, 128))
    for order in cy.DAUBECHIES:
        np.testing.assert_allclose(cy.detail_energies(x, order), [energies_one(r, order) for r in x])


def test_dwt_gate_window_by_window(wave):
    series = cy.centred_returns(wave).cache()
    got = cy.dwt_gate(series, window=64, orders=(4,), block=50).orderBy("symbol", "bar_no").toPandas()
    for name, g in series.orderBy("symbol", "bar_no").toPandas().groupby("symbol"):
        x, want = g["x"].to_numpy(), np.zeros(len(g), bool)
        for i in range(63, len(g)):
            e = energies_one(x[i - 63 : i + 1], 4)
            band = e[3:6]
            want[i] = len(band) >= 2 and band.max() / (np.median(band) + 1e-12) >= 2.5
        np.testing.assert_array_equal(got.loc[got["symbol"] == name, "ok"].to_numpy(), want)


@pytest.mark.parametrize("kind", ["morlet", "ricker"])
@pytest.mark.parametrize("rows", [220, 60])
def test_cwt_gate_against_whole_series(wave, kind, rows):
    series = cy.centred_returns(wave.where(F.col("bar_no") < rows)).cache()
    got = cy.cwt_gate(series, kind=kind, window=40, block=64).where("symbol = 'S'").orderBy("bar_no").toPandas()["ok"].to_numpy()
    x = series.where("symbol = 'S'").orderBy("bar_no").toPandas()["x"].to_numpy()
    power = []
    for p in np.linspace(10.0, 80.0, 48):
        c = np.convolve(x, np.conjugate(cy.wavelet(kind, p)[::-1]), mode="same")
        start = (c.size - x.size) // 2
        power.append(np.abs(c[start : start + x.size]) ** 2)
    power = np.array(power)
    want = power.max(axis=0) / (np.median(power, axis=0) + 1e-12) >= 1.8
    want[:39] = False
    np.testing.assert_array_equal(got, want)


def test_dmd_gate_window_by_window(wave):
    rows = cy.centred_returns(wave).withColumnRenamed("x", "ret").where("symbol = 'N'").cache()
    got = cy.dmd_gate(rows, block=50).orderBy("bar_no").toPandas()["ok"].to_numpy()
    x = rows.orderBy("bar_no").toPandas()["ret"].to_numpy()
    for i in range(59, len(x), 13):
        h = np.array([x[i - 59 + k : i - 59 + k + 51] for k in range(10)])
        u, s, vh = np.linalg.svd(h[:, :-1], full_matrices=False)
        a = u[:, :3].T @ h[:, 1:] @ vh[:3].T / s[:3]
        assert got[i] == (np.log(np.abs(np.linalg.eigvals(a))).max() >= 0)
    assert not got[:59].any()


def test_kernels_do_not_depend_on_blocks(wave):
    series = cy.centred_returns(wave).cache()
    for fn in (lambda b: cy.rolling_dominant_period(wave, window=40, block=b), lambda b: cy.kernel_gate(series, "dwt_db2", block=b),
               lambda b: cy.kernel_gate(series, "cwt_ricker", block=b)):
        assert fn(16).exceptAll(fn(4096)).count() == 0


def test_ar_coefficients_and_forecast(spark):
    rng = np.random.default_rng(7)
    x = np.zeros(400)
    for t in range(2, 400):
        x[t] = 0.5 * x[t - 1] - 0.3 * x[t - 2] + rng.normal()
    pdf = pd.DataFrame({"symbol": "A", "ts": pd.date_range("2024-01-01", periods=400), "bar_no": range(400), "ret": x})
    df = spark.createDataFrame(pdf).cache()
    beta = cy.ar_coefficients(df, p=2).first()["beta"]
    a = np.column_stack([x[1:-1], x[:-2]])
    np.testing.assert_allclose(beta, np.linalg.solve(a.T @ a + 1e-6 * np.eye(2), a.T @ x[2:]), rtol=1e-9)
    assert cy.ar_coefficients(df.where("bar_no < 20"), p=2).first()["beta"] is None
    f = cy.ar_forecast(df, 2, value="ret", p=2, differenced=False).first()["forecast"]
    y1 = beta[0] * x[-1] + beta[1] * x[-2]
    np.testing.assert_allclose(f, [y1, beta[0] * y1 + beta[1] * x[-1]])


def test_modes_equal_direct_svd(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5, 120))
    pdf = pd.DataFrame([(f"s{i}", d, x[i, t]) for i in range(5) for t, d in enumerate(pd.date_range("2024-01-01", periods=120))], columns=["symbol", "ts", "ret"])
    got = tn.dynamic_modes(spark.createDataFrame(pdf), 3).toPandas()
    u, s, vh = np.linalg.svd(x[:, :-1], full_matrices=False)
    small = u[:, :3].T @ x[:, 1:] @ vh[:3].T / s[:3]
    lam, w = np.linalg.eig(small)
    b = np.linalg.lstsq(x[:, 1:] @ vh[:3].T / s[:3] @ w, x[:, 0].astype(complex), rcond=None)[0]
    key = lambda z: np.sort_complex(np.round(z, 8))
    np.testing.assert_allclose(key(got["eig_real"].to_numpy() + 1j * got["eig_imag"].to_numpy()), key(lam), atol=1e-7)
    np.testing.assert_allclose(np.sort(got["amplitude_abs"]), np.sort(np.abs(b)), rtol=1e-6)


def test_tensor_factors(spark, wave):
    t = tn.tensor_long(wave, ("returns", "rv", "hl_range", "dollar_volume", "depth"))
    assert "depth" not in {r[0] for r in t.select("feature").distinct().collect()}
    cp = tn.cp_decompose(t, 2, sweeps=5)
    assert all(b <= a + 1e-9 for a, b in zip(cp.errors, cp.errors[1:]))
    full, core = tn.tucker_decompose(t, (8, 2, 4))
    norm = t.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    assert (core**2).sum() == pytest.approx(norm)
    u = np.array(full.time.toPandas()["x"].tolist())
    gram = u.T @ u
    big = np.abs(core).reshape(len(core), -1).sum(axis=1) > 1e-6
    np.testing.assert_allclose(gram[np.ix_(big, big)], np.eye(big.sum()), atol=1e-6)
    z = t.toPandas().pivot_table(index="symbol", columns=["ts", "feature"], values="z", fill_value=0.0)
    left = np.linalg.svd(z.to_numpy(), full_matrices=False)[0][:, :2]
    got = np.array(full.asset.toPandas().set_index("symbol").loc[z.index]["x"].tolist())
    np.testing.assert_allclose(np.abs(got.T @ left), np.eye(2), atol=1e-6)
