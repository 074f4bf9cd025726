"""The entry module, with and without the folders of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def said(folder: Path) -> list[set[str]]:
    done = subprocess.run([sys.executable, "-c", SAY], cwd=folder, capture_output=True, text=True, timeout=120, check=True)
    return [set(line.split()) for line in done.stdout.splitlines()[-2:]]


def copied(to: Path) -> Path:
    for name in ("newsloom", "tests", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, to / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    return to


def is_llm(name: str) -> bool:
    return name == "pipeline" or name[:2] == "op" and name[2:3].isdigit()


def test_without_the_folders_all_else_is_there(tmp_path):
    whole, twins = said(ROOT)
    assert twins <= whole
    bare = copied(tmp_path)
    for folder in ("newsloom/llm", "tests/llm"):
        shutil.rmtree(bare / folder, ignore_errors=True)
    rest = {n for n in whole if not is_llm(n)}
    # With and without the pipeline's file.
    assert said(bare) == [rest, {n for n in twins if not is_llm(n)}]
    (bare / "corpus_pipeline.py").unlink(missing_ok=True)
    assert said(bare)[0] == rest
    # The other tests find all they import, and the fast ones pass.
    ran = subprocess.run([sys.executable, "-m", "pytest", "tests/test_text.py", "tests/test_relevance.py", "-q", "-x"], cwd=bare, capture_output=True, text=True, timeout=600)
    assert ran.returncode == 0, ran.stdout[-2000:]
    done = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q"], cwd=bare, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stdout[-2000:]
