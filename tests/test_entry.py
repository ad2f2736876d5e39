"""The driver contract, and that the rest works without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame_or_rows, columns):
    clean = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(str(clean(r[c])) for c in columns) for r in frame_or_rows))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["segment_counts", "field_presence", "corpus_fingerprint", "corpus_diff_fields", "path_presence", "custom_rules", "redact_hash", "batch_counts", "guard_running_zscore", "stream_events"])
def test_against_oracle(spark, name):
    from hatlake.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    found = registry.queries()[name](spark, str(DATA))
    wanted = con.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    wanted_rows = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
    assert rows(found.collect(), columns) == rows(wanted_rows, columns)


def test_imports_without_the_corpus_subpackage(tmp_path):
    script = "import sys; sys.modules['hatlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", script], cwd=ROOT, check=True)
