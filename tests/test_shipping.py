"""The workers get the package wherever the driver was started."""

import os
import subprocess
import sys

from conftest import ROOT

RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from ashlar.session import local_session
spark = local_session("2", 2)
print("ROWS", entry.queries()["f3_reroute_stream"](spark, "/root/testdata/sf0.001").count())
"""


def test_stream_from_another_folder(tmp_path):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT)], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
