"""The engine is whole without the text operators: their folders, and the pipeline with them, may go."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parents[2]

RUN = """
import __spark_entry__ as contract
from ledgerwake import queries as engine
assert set(contract.queries()) == set(engine.QUERIES) == set(contract.oracle_sql()) and len(engine.QUERIES) > 50
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert contract.queries()["panel_dense"](spark, "/root/testdata/sf0.001").count() > 0
"""


def test_entry_without_the_text_operators(tmp_path):
    for pipeline in (True, False):
        own = tmp_path / str(pipeline)
        shutil.copytree(ROOT / "ledgerwake", own / "ledgerwake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists())]:
            shutil.copy(ROOT / name, own / name)
        run = RUN if pipeline else RUN.partition("from pyspark")[0]
        done = subprocess.run([sys.executable, "-c", run], cwd=own, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", **{k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}})
        assert done.returncode == 0, done.stderr[-2000:]


def test_entry_with_the_text_operators_half_gone(tmp_path):
    """Their folder holds nothing but compiled files, or a module that they need isn't installed."""
    for lacking in ("sources", "modules"):
        own = tmp_path / lacking
        shutil.copytree(ROOT / "ledgerwake", own / "ledgerwake", ignore=shutil.ignore_patterns("__pycache__"))
        shutil.copy(ROOT / "__spark_entry__.py", own / "__spark_entry__.py")
        (own / "corpus_pipeline.py").write_text("from ledgerwake.llm import byte_bpe\n")
        shutil.rmtree(own / "ledgerwake" / "llm", ignore_errors=True)
        (own / "ledgerwake" / "llm" / "__pycache__").mkdir(parents=True)
        if lacking == "modules":
            (own / "ledgerwake" / "llm" / "__init__.py").touch()
            (own / "ledgerwake" / "llm" / "queries.py").write_text("import a_module_that_is_not_installed\n")
        done = subprocess.run([sys.executable, "-c", RUN.partition("from pyspark")[0]], cwd=own, capture_output=True, text=True, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
        assert done.returncode == 0 and "is left out" in done.stderr, done.stderr[-2000:]
