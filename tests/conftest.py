import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from thresher.session import local_session  # noqa: E402

LINES = "source_id string, line_number bigint, raw_line string, device_type string, vendor string"
TEMPLATES = "device_type string, vendor string, seq bigint, template_id string, regex string, is_active boolean"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Normalized lines of one source and library."""
    from thresher.operators.lines import normalize_lines

    def build(texts, source="a"):
        rows = [(source, i, text, "d", "v") for i, text in enumerate(texts, 1)]
        return normalize_lines(spark.createDataFrame(rows, LINES))

    return build


@pytest.fixture
def library(spark):
    from checks.fixtures import complete

    def build(regexes, active=None):
        rows = [
            ("d", "v", i, f"d-v-{i:04d}", r, True if active is None else active[i - 1])
            for i, r in enumerate(regexes, 1)
        ]
        return complete(spark.createDataFrame(rows, TEMPLATES))

    return build
