import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plain import awkward_documents


@pytest.fixture(scope="session")
def documents(spark):
    return awkward_documents(spark).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
