import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from punctual.session import build_session
    s = build_session("local[4]", 8, app_name="punctual-tests", extra={
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="punctual-test-ckpt-")})
    from punctual.operators import modeling
    from punctual.plans import q_modeling
    q_modeling.GRID = modeling.SMALL_GRID
    yield s
    s.stop()
