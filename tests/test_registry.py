"""The registry in processes of its own: without a session, and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*sorted(q))"


def names(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run(
        [sys.executable, "-B", "-c", SAY], cwd=folder, env=env, capture_output=True, text=True, timeout=120
    )
    assert said.returncode == 0, said.stderr[-2000:]
    return set(said.stdout.split())


def copied(tmp_path, *left_out):
    there = tmp_path / "copy"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *left_out))
    return there


def test_queries_are_read_without_a_session():
    found = names(ROOT)
    assert len(found) >= 55
    if os.path.isdir(os.path.join(ROOT, "emberframe", "llm")):
        assert {f"op{n}" for n in range(1, 14)} <= {x.partition("_")[0] for x in found} and "pipeline" in found


def test_queries_are_read_without_the_subpackage(tmp_path):
    """Also where the pipeline's file is still there, and where the folder is there but empty."""
    there = copied(tmp_path, "llm")
    found = names(there)
    assert len(found) >= 55 and not any(
        x.startswith("op") and x[2:3].isdigit() for x in found
    ) and "pipeline" not in found
    (there / "emberframe" / "llm").mkdir()
    assert names(there) == found
    (there / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(there) == found


def test_any_other_missing_module_is_an_error(tmp_path):
    there = copied(tmp_path, "llm")
    (there / "corpus_pipeline.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=there, capture_output=True, text=True, timeout=120)
    assert said.returncode and "no_such_module" in said.stderr
