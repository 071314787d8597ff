"""The entry module with the corpus operators, without them, and without their vocabularies."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
NAMES = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def imported(folder, before=""):
    done = subprocess.run([sys.executable, "-c", before + NAMES], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, oracle = (line.split() for line in done.stdout.splitlines())
    assert set(oracle) <= set(queries)
    return queries


@pytest.fixture()
def without(tmp_path):
    shutil.copytree(ROOT / "kinmat", tmp_path / "kinmat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_entry_without_the_corpus_operators(without):
    queries = imported(without)
    assert len(queries) > 60 and not [q for q in queries if q.startswith("op") or q == "pipeline"]


def test_entry_without_vocabularies():
    queries = imported(ROOT, "import sys; sys.modules['public_tokenizers'] = None; ")
    assert len(queries) > 60 and not [q for q in queries if q.startswith("op")]


def test_a_fault_in_an_operator_is_no_absence(without):
    (without / "kinmat/llm").mkdir()
    (without / "kinmat/llm/__init__.py").write_text("")
    (without / "kinmat/llm/queries.py").write_text("import no_such_module\n")
    (without / "corpus_pipeline.py").write_text("")
    done = subprocess.run([sys.executable, "-c", NAMES], cwd=without, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
