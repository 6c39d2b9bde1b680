import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import local_session

    session = local_session("tests", cpus=4, partitions=4)
    yield session
    session.stop()


@pytest.fixture
def walk():
    """Seeded geometric walks: ``walk(names, rows)`` gives panel rows."""
    import datetime as dt

    import numpy as np

    def make(names: int = 4, rows: int = 400, seed: int = 20260101, sigma: float = 0.015):
        rng = np.random.default_rng(seed)
        start = dt.datetime(2022, 1, 3, 10)
        out = []
        for i in range(names):
            close = 100 * np.exp(np.cumsum(rng.normal(0, sigma, rows)))
            for k in range(rows):
                at = start + dt.timedelta(days=k)
                out.append((f"NSE:INE{i:04d}", f"SYM{i:02d}", at, at + dt.timedelta(hours=2), float(close[k]), float(1000 + (k * 7 + i) % 90)))
        return out, "instrument_id string, symbol string, event_time timestamp, receive_time timestamp, close double, volume double"

    return make
