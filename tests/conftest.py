import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from barsmith.session import get_spark  # noqa: E402
from barsmith.sources.bars import complete_bars  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "4", 4)
    yield session
    session.stop()


@pytest.fixture
def make_bars(spark):
    """Bars from rows of dicts; dates count from 2000-01-01 when given as numbers."""

    def build(rows):
        out = []
        for r in rows:
            d = r.get("date", 0)
            day = d if isinstance(d, dt.date) else dt.date(2000, 1, 1) + dt.timedelta(days=d)
            c = float(r.get("close", 100))
            prev = r.get("prev_close")
            out.append((
                r.get("symbol", "A"), r.get("symbol", "A"), day,
                None if prev is None else float(prev), float(r.get("open_price", c)),
                float(r.get("high", c)), float(r.get("low", c)), c, int(r.get("volume", 100)),
                float(r.get("value", 1e10)), int(r.get("foreign_buy", 0)),
                int(r.get("foreign_sell", 0)), int(r.get("bid_volume", 0)),
                int(r.get("offer_volume", 0)), 10**9))
        return complete_bars(spark.createDataFrame(
            out, "symbol string, name string, date date, prev_close double, open_price double, "
            "high double, low double, close double, volume long, value double, foreign_buy long, "
            "foreign_sell long, bid_volume long, offer_volume long, listed_shares long"))

    return build
