import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_loads_without_a_session():
    """The SQL and the query list must be readable before any Spark session exists."""
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_entry_runs_from_another_folder(tmp_path):
    """Workers that cannot import the package still run its Python functions."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "assert e.entry(s).count() > 0\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, stderr=subprocess.DEVNULL)


def test_boosters_and_search_are_registered_with_their_defaults(monkeypatch):
    from checks import training as T

    asked = []

    class Trainer:
        def fit(self, rows, seed):
            return self

        def transform(self, rows):
            return rows

    monkeypatch.setattr(T, "rows", lambda spark, folder: None)
    monkeypatch.setattr(T, "params", lambda rows: None)
    monkeypatch.setattr(T.Mo, "trainer", lambda name, **hyper: asked.append((name, hyper)) or Trainer())
    monkeypatch.setattr(T.Bt, "search", lambda rows, params, name, trials: (name, trials))
    T.gradient_boosting(None, "")
    T.second_booster(None, "")
    assert asked == [("gradient_boosting", {}), ("lightgbm", {})]
    name, trials = T.parameter_search(None, "")
    assert name == "gradient_boosting" and len(trials) == 10 and all(set(t) == set(T.Bt.SEARCH) for t in trials)
