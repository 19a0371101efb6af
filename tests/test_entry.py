import re
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_every_oracle_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]


def test_only_the_entry_knows_the_training_operators():
    for p in (ROOT / "scriptorium").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"import.*\bllm\b|\.llm", p.read_text()), p


def test_without_the_training_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "scriptorium.llm", None)  # as if a library they need were missing
    assert len(entry.queries()) > 100 and not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
