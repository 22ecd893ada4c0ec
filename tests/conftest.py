import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexspan.session import session

    s = session(
        "local[*]", "tests", spark_ui_enabled="false", spark_sql_shuffle_partitions="8", spark_driver_memory="6g", spark_ui_showConsoleProgress="false",
        spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def values(frame):
    """Rows as sorted text, by column name, however a library types numbers."""
    import numpy as np
    import pandas as pd

    def text(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return str([text(y) for y in x])
        if x is None or pd.isna(x):
            return "NULL"
        return f"{float(x):.6g}" if isinstance(x, (int, float, np.number, bool, np.bool_)) else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))
