import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tracewell.session import session, ship

    s = session("tests", os.environ.get("TEST_CPUS", "8"), **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
