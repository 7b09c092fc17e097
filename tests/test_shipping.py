"""Tasks find the package's code although it is installed nowhere."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from corpusflow.session import get_spark
from corpusflow.operators import encode, vector
spark = get_spark("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "item_id bigint, content string")
items = encode.embed(rows, dim=8)
asked = encode.embed(rows.withColumnRenamed("item_id", "query_id"), dim=8, side="query")
print("FOUND", vector.knn(asked, items, 1).count())
"""


def test_code_travels_with_the_tasks(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=180
    )
    assert "FOUND 2" in done.stdout, done.stderr[-2000:]
