"""Workers need no copy of the repository: the driver knows it by its search path alone and starts elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

from tests.llm.conftest import SF

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
find = F.udf(lambda x: str(__import__("importlib.util").util.find_spec("parcel" + "cube")))
assert spark.range(1).select(find("id")).first()[0] == "None"
from parcelcube.llm import queries
for name in {names!r}:
    rows = queries.queries()[name](spark, {sf!r}).count()
    assert rows > 0, name
    print("done", name)
"""


def test_queries_run_on_workers_without_the_repository(tmp_path):
    names = ["op1_language_id", "op3_ann", "op5_decontaminate", "op8_url_filter"]
    script = SCRIPT.format(repo=str(Path(__file__).resolve().parents[2]), shared=str(tmp_path / "shared"), names=names, sf=SF)
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=600)
    assert [x.split()[1] for x in ran.stdout.splitlines() if x.startswith("done")] == names, ran.stderr[-3000:]
