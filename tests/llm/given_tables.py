"""The small given tables as plain rows."""

import os

import pyarrow.parquet as pq

DIR = "/root/testdata/sf0.001"


def rows(name):
    path = f"{DIR}/{name}.parquet"
    assert os.path.exists(path)
    return pq.read_table(path).to_pylist()
