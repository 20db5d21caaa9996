from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lakeloom.session import session

    root = tmp_path_factory.mktemp("spark")
    s = session(
        "tests",
        "local[4]",
        spark_sql_shuffle_partitions="4",
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory="4g",
        spark_sql_warehouse_dir=str(root / "warehouse"),
        spark_checkpoint_dir=str(root / "shared"),
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
