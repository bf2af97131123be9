import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from dossier.session import get_spark

    s = get_spark("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
                                          "spark.checkpoint.dir": tempfile.mkdtemp(prefix="dossier-tests-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
