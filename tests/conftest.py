import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from staffscope import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session.build("local[8]", 4, **{
        "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
