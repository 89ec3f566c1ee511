import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tabsmith.session import get_spark  # noqa: E402
from tools.limit import limited  # noqa: E402

#: Seconds that a test may run jobs; a query that never ends fails alone.
LIMIT = 240


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests", "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def time_limit(request):
    if "spark" not in request.fixturenames:
        yield
        return
    with limited(request.getfixturevalue("spark"), LIMIT):
        yield
