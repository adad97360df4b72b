"""Executors have no copy of the package: every operator's functions travel by value."""

import os
import subprocess
import sys

import pytest


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"
RUN = """
import sys
sys.path.insert(0, {root!r})  # of the driver alone: workers start elsewhere, without it
from darwise.session import local_session
import __spark_entry__ as entry
spark = local_session(4, 4, "4g")
spark.sparkContext.setLogLevel("ERROR")

def found(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("darwise") is not None))

assert spark.range(4).mapInPandas(found, "id long").agg({{"id": "max"}}).first()[0] == 0
for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit() or name == "pipeline":
        print(name, query(spark, {small!r}).count())
"""


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_all_operators_on_bare_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, small=SMALL)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    counts = dict(line.split() for line in run.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counts) == 14 and all(int(n) > 0 for n in counts.values())
