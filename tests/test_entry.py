import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_the_llm_folder():
    code = "import sys; sys.modules['rivulet.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'feed_publish' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode == 0


def test_nothing_else_imports_the_llm_folder():
    for p in (ROOT / "rivulet").rglob("*.py"):
        assert "llm" in p.relative_to(ROOT).parts or "rivulet.llm" not in p.read_text()


def test_flagship(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns == ["event_id", "feed", "user_id", "value", "seq"]
