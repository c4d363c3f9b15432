"""Filters are orthogonal; packets against plain convolution, and back."""

import datetime as dt

import numpy as np
import pytest

from tidewatch.operators import wavelets


@pytest.mark.parametrize("wavelet", ["db1", "db2", "db4", "db8", "sym4", "sym8"])
def test_filters_are_orthogonal(wavelet):
    h = wavelets.scaling_filter(wavelet)
    n = len(h) // 2
    for shift in range(n):
        assert h[2 * shift :] @ h[: len(h) - 2 * shift] == pytest.approx(float(shift == 0), abs=1e-6)
    for k in range(min(n, 4)):  # vanishing moments
        assert ((-1.0) ** np.arange(2 * n) * np.arange(2 * n) ** k) @ h == pytest.approx(0, abs=1e-4)


@pytest.mark.parametrize(("wavelet", "levels"), [("db2", 2), ("sym4", 3)])
def test_packets_and_back(spark, wavelet, levels):
    rng, day = np.random.default_rng(5), dt.date(2020, 1, 1)
    data = {"a": rng.normal(size=41), "b": rng.normal(size=64), "short": rng.normal(size=3), "one": np.array([2.0])}
    df = spark.createDataFrame([(k, day + dt.timedelta(days=i), float(v)) for k, x in data.items() for i, v in enumerate(x)], "label string, ts date, v double")
    packets = wavelets.wavelet_packets(df, "v", wavelet, levels)
    back = wavelets.from_wavelet_packets(packets, wavelet, levels).toPandas().sort_values("k")
    for k, x in data.items():
        assert back[back.label == k]["value"].to_numpy() == pytest.approx(x, abs=1e-7)
    h = wavelets.scaling_filter(wavelet)
    x, pad = data["a"], len(h) - 1
    full = np.convolve(np.pad(x, pad, mode="symmetric"), h[::-1], mode="valid")[1::2]
    got = wavelets.wavelet_packets(df, "v", wavelet, 1).where("label = 'a' AND path = 'a'").toPandas().sort_values("k")["value"].to_numpy()
    assert len(got) == (len(x) + len(h) - 1) // 2 and got == pytest.approx(full[: len(got)], abs=1e-9)
