import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import ODD, documents  # noqa: E402
from tessera.llm.common import workers_import  # noqa: E402


@pytest.fixture(scope="session", autouse=True)
def _importable(spark):
    workers_import(spark)


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])
