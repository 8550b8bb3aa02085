import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rolescope.schemas import JOBS  # noqa: E402
from rolescope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def jobs_from(spark):
    """A jobs table from dicts; columns left out are NULL, the key has defaults."""

    def build(*rows):
        filled = []
        for i, row in enumerate(rows, 1):
            base = {f: None for f in JOBS.fieldNames()} | {
                "id": i, "job_id": str(i), "company": "acme", "ats": "lever", "title": f"title {i}",
            }
            filled.append(tuple((base | row)[f] for f in JOBS.fieldNames()))
        return spark.createDataFrame(filled, JOBS)

    return build
