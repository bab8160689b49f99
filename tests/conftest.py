import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from cindertrail.session import get_session

    s = get_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


LOG_SCHEMA = (
    "id long, ts timestamp, ingested_at timestamp, level string, service string, host string, ip string, http_method string, endpoint string, "
    "status int, response_ms long, request_id string, user_id string, message string, trace_id string, source string"
)


@pytest.fixture(scope="session")
def logs(spark):
    """Rows of log_events from dicts; ts is given in seconds since the epoch."""
    from datetime import datetime, timezone

    def make(rows):
        names = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
        out = []
        for i, r in enumerate(rows):
            r = {"id": i, **r}
            if isinstance(r.get("ts"), (int, float)):
                r["ts"] = datetime.fromtimestamp(r["ts"], tz=timezone.utc)
            out.append(tuple(r.get(n) for n in names))
        return spark.createDataFrame(out, LOG_SCHEMA)

    return make
