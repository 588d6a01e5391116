import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from trialframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=["whole", "split"])
def chunked(request, spark):
    """Run a test with plain windows and with groups cut into small chunks."""
    spark.conf.set("spark.trialframe.chunkRows", "1000000" if request.param == "whole" else "40")
    yield request.param
    spark.conf.unset("spark.trialframe.chunkRows")


class Tree:
    """Writes a result tree of our own making."""

    def __init__(self, root: Path):
        self.root = root

    def put(self, path: str, text: str) -> None:
        target = self.root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)

    def job(self, suite: str, exp: str, run: int, rep: int, config: dict, files: dict, host: str = "small/host_0"):
        base = f"{suite}/{exp}/run_{run}/rep_{rep}"
        self.put(f"{base}/config.json", json.dumps(config))
        for name, text in files.items():
            self.put(f"{base}/{host}/{name}", text)


@pytest.fixture
def tree(tmp_path):
    return Tree(tmp_path)


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: repr(r)) if not order else out
