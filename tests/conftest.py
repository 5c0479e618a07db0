import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from spanloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "spanloom-tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def lines(spark, tmp_path):
    """Write JSON values as lines under <platform>/<session>/<name> and read them back."""
    import json

    from spanloom.sources.jsonl import read_lines

    def make(values, platform="claude", session="s1", name="log.jsonl", end="\n"):
        folder = tmp_path / platform / session
        folder.mkdir(parents=True, exist_ok=True)
        text = "\n".join(v if isinstance(v, str) else json.dumps(v) for v in values) + end
        (folder / name).write_text(text, encoding="utf-8")
        return read_lines(spark, str(folder / name))

    return make
