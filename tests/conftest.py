import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cirrus.session import get_spark
    scratch = tempfile.mkdtemp(prefix="cirrus-test-")
    s = get_spark("local[*]", 8, extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                                        "spark.local.dir": os.path.join(scratch, "local")})
    yield s
    s.stop()
