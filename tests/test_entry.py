import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LOAD = """
import __spark_entry__ as entry
names = set(entry.queries())
assert "engine_cards" in names and set(entry.oracle_sql()) <= names, names
print(len([n for n in names if n.startswith("op") and n[2].isdigit()]), "pipeline" in names)
"""


def _load(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", LOAD], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def _copy(tmp_path, without):
    shutil.copytree(os.path.join(ROOT, "sightline"), tmp_path / "sightline", ignore=shutil.ignore_patterns("__pycache__", *without))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in without:
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    return tmp_path


def test_loads_without_the_training_data_operators(tmp_path):
    """corpus_pipeline.py in place, the operators' folder gone."""
    assert _load(_copy(tmp_path, ["llm"])) == ["0", "False"]


def test_loads_beside_an_empty_operators_folder(tmp_path):
    folder = _copy(tmp_path, ["llm"])
    (folder / "sightline" / "llm").mkdir()
    assert _load(folder) == ["0", "False"]


def test_an_error_inside_the_operators_is_not_hidden(tmp_path):
    folder = _copy(tmp_path, ["llm"])
    (folder / "sightline" / "llm").mkdir()
    (folder / "sightline" / "llm" / "catalog.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", LOAD], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr
