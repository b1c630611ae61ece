import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from reclaim.session import get_spark
    # tests only: a scratch folder is the shared folder of the session
    s = get_spark("local[4]", 4, extra={"spark.ui.showConsoleProgress": "false",
                                        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="reclaim-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def stored(spark):
    """The derived inventory of the smallest data as a stored table; queries over
    that folder read it from then on."""
    from reclaim.sources import store_inventory
    return store_inventory(spark, "/root/testdata/sf0.001", f"{tempfile.mkdtemp(prefix='reclaim-inv-')}/inventory")
