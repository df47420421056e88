import json
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from duskwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "duskwatch-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden():
    """(line, fragment of the winning rule's title) pairs."""
    text = (ROOT / "FIXTURES.md").read_text(encoding="utf-8")
    rows = [json.loads(row) for row in text.splitlines() if row.startswith('{"ref_line"')]
    return [(row["line"], row["expect"]) for row in rows]


@pytest.fixture(scope="session")
def pack(spark):
    from duskwatch.operators.rules import compile_pack
    from duskwatch.sources.rulepack import scan_rules

    return compile_pack(scan_rules(spark))
