import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidepanel.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """Long panel from {series: values}; monthly from 2000-01, panel ``p``."""
    import datetime

    def build(columns, codes=None, panel_id="p", parts=3):
        rows = []
        for name, values in columns.items():
            n = len(values)
            for i, v in enumerate(values):
                ds = datetime.date(2000 + i // 12, i % 12 + 1, 1)
                v = None if v is None or v != v else float(v)
                rows.append((panel_id, name, ds, i + 1, v, n, (codes or {}).get(name, 1)))
        schema = "panel_id string, series string, ds date, t int, value double, n_periods int, tcode int"
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build
