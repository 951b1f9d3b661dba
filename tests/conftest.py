import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from offerloom.schema import OFFER_FIELDS, conform  # noqa: E402
from offerloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", 4, str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    return session


T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="session")
def offer_rows(spark):
    """offers(dict, ...): offers with defaults; `run` is a day number, `pos` the argument order."""
    kinds = dict(OFFER_FIELDS)

    def make(*rows):
        names = sorted({k for r in rows for k in r} - {"run", "hour"} | {"slug", "run_ts", "fetched_at", "source_order", "pos", "url", "source", "title"})
        data = []
        for i, r in enumerate(rows):
            run = T0 + timedelta(days=r.get("run", 0))
            full = {"slug": "p", "run_ts": run, "fetched_at": run + timedelta(hours=r.get("hour", 0)), "source_order": 0, "pos": i, "url": f"https://v{i}.com/x", "source": "serper_shopping", "title": f"item {i}", **r}
            data.append(tuple(full.get(n) for n in names))
        return conform(spark.createDataFrame(data, ", ".join(f"`{n}` {kinds[n]}" for n in names)))

    return make
