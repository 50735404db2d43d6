import sys
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", partitions=4)


@pytest.fixture(scope="session")
def make_bars(spark):
    """bars from closes per symbol; open, high and low follow the close unless given."""

    def build(closes: dict, **cols):
        frames = []
        for s, c in closes.items():
            n = len(c)
            f = pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n), "bar_no": range(n), "close": [float(x) for x in c]})
            for k in ("open", "high", "low"):
                f[k] = [float(x) for x in cols.get(k, c)]
            f["volume"] = 1.0
            f["signal"] = [float(x) for x in cols.get("signal", [0] * n)]
            frames.append(f)
        df = spark.createDataFrame(pd.concat(frames))
        return df.withColumn("ts", df["ts"].cast("timestamp_ntz")).withColumn("bar_no", df["bar_no"].cast("long"))

    return build
