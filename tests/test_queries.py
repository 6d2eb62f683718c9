import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from textloom.plans.catalog import ORACLE, QUERIES
from textloom.session import table

from .sqlcheck import FOLDER, connection, differences
from .test_operators import _brute_bpe

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def database():
    return connection()


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, database, name):
    assert differences(spark, QUERIES[name], ORACLE[name], database) == ([], [])


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).count() > 0


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_byte_pairs_of_whole_endings(spark):
    ends = {r.ending for r in QUERIES["url_endings"](spark, str(FOLDER)).collect() if r.ending}
    want = Counter()
    for symbols, n in _brute_bpe(sorted(ends), 1000)[1].items():
        for symbol in symbols:
            want[symbol] += n * (len(symbol) >= 5)
    got = {r.symbol: r.n for r in QUERIES["url_byte_pairs"](spark, str(FOLDER)).collect()}
    assert got == {k: n for k, n in want.items() if n} and any(c.isdigit() for c in "".join(got))


def test_registry():
    assert set(ORACLE) <= set(QUERIES)


def test_core_does_not_import_the_training_package():
    for path in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "textloom").parts:
            assert not re.search(r"(?m)^\s*(from|import)\s+[\w.]*\bllm\b", path.read_text()), path


def test_entry_without_the_training_package():
    code = "import sys; sys.modules['textloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('p1_') for k in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(len(QUERIES)), "False"]


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
def test_only_needed_columns_are_read(spark):
    plan = QUERIES["corpus_unigrams"](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert "text_html" not in plan and "lemmas" in plan
    assert "text" in table(spark, str(FOLDER), "articles").columns
