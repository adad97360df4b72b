import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from darwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, 4, "8g", **{"spark.python.sql.dataFrameDebugging.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def inventory(spark):
    """A small inventory with the awkward rows: see the comments."""
    from darwise.sources.files import PROJECTS, SALES, UNITS

    def project(i, name, launch, total):
        return (i, name, name, "مدينة", "City", "حي", "District", launch, "2027-01", total)

    projects = [
        project("P1", "Alpha", "2024-01", 30),
        project("P2", "Beta", "2024-06", 10),  # first sale before its launch
        project("P3", "Gamma", "2024-01", 5),  # no sales
        project("P4", "Delta", "2025-12", 5),  # too short a history for the backtest
    ]
    units, sales = [], []

    def unit(i, pid, kind, area, status, floor=None):
        units.append((i, pid, i, kind, kind, 3, 2, area, floor, "sea", "بحر", 1, area * 5000.0, status, status, "2027-01"))

    def sale(i, pid, day, price, method="bank_financing"):
        import datetime

        bank = "Bank" if method == "bank_financing" else None
        sales.append((len(sales) + 1, i, pid, datetime.date.fromisoformat(day), price, 2.5, method, bank, "City"))

    for n in range(24):
        uid = f"A{n:02d}"
        unit(uid, "P1", "villa" if n % 3 else "apartment", 100.0 + n, "sold", n if n % 3 == 0 else None)
        year, month = divmod(n // 2, 12)
        sale(uid, "P1", f"{2025 + year}-{month + 1:02d}-{15 + n % 2:02d}", 500000.0 + 7000 * n, "cash" if n % 4 == 0 else "bank_financing")
    for n in range(4):
        unit(f"A9{n}", "P1", "villa", 150.0, "available" if n else "reserved")
    for n in range(8):
        uid = f"B{n:02d}"
        unit(uid, "P2", "duplex", 0.0 if n == 0 else 80.0, "sold")  # one unit without an area
        sale(uid, "P2", f"2024-{5 + (n % 2):02d}-10" if n < 2 else f"2025-{n + 1:02d}-10", 300000.0 + n)
    unit("C00", "P3", "villa", 200.0, "available")
    unit("D00", "P4", "villa", 210.0, "sold")
    sale("D00", "P4", "2025-12-31", 900000.0)  # the last sale is on a 31st
    return {
        "projects": spark.createDataFrame(projects, PROJECTS),
        "units": spark.createDataFrame(units, UNITS),
        "sales": spark.createDataFrame(sales, SALES),
    }
