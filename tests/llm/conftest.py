import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import frame, rough_rows  # noqa: E402


@pytest.fixture(scope="session")
def rough(spark):
    return frame(spark, rough_rows())


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, []).filter("false")
