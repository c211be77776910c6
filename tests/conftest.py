import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("washbay-tests")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from washbay.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)          # the session's folder, or a temporary one when it names none
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
