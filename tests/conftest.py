import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from srcweave.session import build_session  # noqa: E402
from srcweave.sources.corpus import as_source_files  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Make a table of files from ``{path: text}``; the first folder is the project."""

    def make(texts):
        rows = [(p.split("/")[1], p, t) for p, t in texts.items()]
        return as_source_files(
            spark.createDataFrame(rows, "project_id string, file_path string, content string")
        )

    return make
