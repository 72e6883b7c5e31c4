import json
import tempfile

import pytest

from meterlake.session import get_session
from meterlake.sources.prices import default_prices


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "meterlake-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"),
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "5000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def prices(spark):
    return default_prices(spark)


@pytest.fixture()
def put(tmp_path):
    """Writes JSON lines (dicts or raw text) to a file below the test's folder."""

    def write(name, *lines):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
        return str(tmp_path)

    return write


@pytest.fixture()
def make_usage(spark):
    """Usage rows from short dicts."""
    from meterlake.schemas import TOKENS, USAGE

    def build(*rows):
        full = []
        for number, row in enumerate(rows):
            values = {
                "provider": "claude", "session_id": "s", "model": "claude-3-opus", "total_cost": None,
                "project": None, "instance_id": None, "_file": "f", "_ord": number, **{name: 0 for name in TOKENS}, **row,
            }
            full.append(tuple(values[field.name] for field in USAGE))
        return spark.createDataFrame(full, USAGE)

    return build


def claude_line(ts="2024-01-15T10:00:00Z", model="claude-3-opus", tokens=(100, 50, 0, 0), **more):
    """A Claude log record; ``mid`` and ``rid`` are the ids of message and request."""
    message = {
        "model": model,
        "usage": {
            "input_tokens": tokens[0], "output_tokens": tokens[1],
            "cache_creation_input_tokens": tokens[2], "cache_read_input_tokens": tokens[3],
        },
    }
    if "mid" in more:
        message["id"] = more.pop("mid")
    if "rid" in more:
        more["requestId"] = more.pop("rid")
    return {"timestamp": ts, "message": message, **more}
