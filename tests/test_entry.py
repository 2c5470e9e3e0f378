"""The driver contract, with and without the text operators."""

import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "throw_identity" in __spark_entry__.queries()


def test_entry_imports_without_the_text_operators(tmp_path):
    """As if the folder and the pipeline were deleted."""
    for p in REPO.iterdir():
        if p.name in ("__spark_entry__.py", "factloom"):
            (tmp_path / p.name).symlink_to(p) if p.is_file() else (tmp_path / p.name).mkdir()
    for p in (REPO / "factloom").iterdir():
        if p.name != "llm":
            (tmp_path / "factloom" / p.name).symlink_to(p)
    code = textwrap.dedent("""
        import __spark_entry__ as e
        names = set(e.queries())
        assert names and not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
    """)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)
