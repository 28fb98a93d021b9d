import os

import pytest

from support import DATA, compare
from veriframe.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, Q.queries(), Q.oracle_sql(), name) > 0


def test_pipeline(spark):
    import corpus_pipeline as P

    import json

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = P.run(spark, DATA)
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    kept = P.identify(spark, docs, DATA)
    assert kept.columns == list(P.COLUMNS) and kept.count() > 0.9 * docs.count()
    assert json.dumps([n for n, _ in P.STAGES])


def test_entry_without_llm(tmp_path):
    """A copy without this subpackage, its tests and the pipeline still gives the other queries; any other missing module fails."""
    import shutil
    import subprocess
    import sys

    import __spark_entry__ as e

    top = os.path.dirname(os.path.abspath(e.__file__))
    names = e.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    shutil.copytree(f"{top}/veriframe", tmp_path / "veriframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    ask = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    rest = {n for n in names if n != "pipeline" and not n.startswith("op")}
    assert said.returncode == 0, said.stderr[-500:]
    assert set(said.stdout.splitlines()[0].split()) == rest and set(said.stdout.splitlines()[1].split()) == {n for n in e.oracle_sql() if n in rest}
    (tmp_path / "veriframe/llm").mkdir()
    (tmp_path / "veriframe/llm/__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import not_here\n")
    assert "not_here" in subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}).stderr
