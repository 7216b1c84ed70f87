import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_works_without_the_corpus_operators(tmp_path):
    """A copy without them imports and has the other queries."""
    code = "import __spark_entry__ as e; assert 'tversky_components' in e.queries() and set(e.oracle_sql()) <= set(e.queries()); print(not any(k.startswith('op') for k in e.queries()))"
    for p in ("__spark_entry__.py", "gridloom"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "gridloom" / "llm")], check=True)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "True", out.stderr


def test_a_broken_operator_is_not_passed_over(tmp_path):
    """Only absent corpus operators are: a module that cannot import what it names is an error."""
    package = tmp_path / "gridloom"
    for p in ("__spark_entry__.py", "gridloom"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(package / "llm")], check=True)
    (package / "llm").mkdir()
    (tmp_path / "corpus_pipeline.py").write_text("from gridloom.llm import registry\n")
    (package / "llm" / "__init__.py").write_text("")
    for broken in ("import no_such_module_at_all\n", "from gridloom.plans import no_such_plan\n", "import gridloom.llm.no_such_part\n"):
        (package / "llm" / "registry.py").write_text(broken)
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
        assert out.returncode != 0 and "no_such" in out.stderr


def test_every_sql_has_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
