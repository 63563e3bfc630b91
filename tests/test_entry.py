"""The entry with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TOLD = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def told(folder):
    done = subprocess.run(
        [sys.executable, "-B", "-c", TOLD], cwd=folder, capture_output=True, text=True, timeout=120,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    return done.returncode, done.stdout.split("\n")[:2], done.stderr


def tree(folder, *without):
    for name in ("vitaloom", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if not os.path.exists(source) or name in without:
            continue
        if os.path.isdir(source):
            skip = shutil.ignore_patterns("__pycache__", *without)
            shutil.copytree(source, folder / name, ignore=skip)
        else:
            shutil.copy(source, folder)
    return folder


@pytest.mark.parametrize("without", [("llm",), ("llm", "corpus_pipeline.py")])
def test_without_the_subpackage(tmp_path, without):
    code, (names, sqls), error = told(tree(tmp_path, *without))
    assert code == 0, error
    names, sqls = set(names.split()), set(sqls.split())
    assert len(names) > 60 and sqls == names
    assert not any(n.startswith("op") or n == "pipeline" for n in names)


def test_a_broken_module_is_an_error(tmp_path):
    folder = tree(tmp_path)
    if not (folder / "vitaloom" / "llm").exists():
        pytest.skip("the subpackage is not there")
    with open(folder / "vitaloom" / "llm" / "queries.py", "a") as out:
        out.write("\nimport vitaloom.llm.nothing_of_this_name\n")
    code, _, error = told(folder)
    assert code != 0 and "nothing_of_this_name" in error
