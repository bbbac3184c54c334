import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle.session import session

    made = session("local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="3g", spark_ui_showConsoleProgress="false", spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
