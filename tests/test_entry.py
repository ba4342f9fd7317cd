"""The driver contract, and the engine without the llm folder."""

import hashlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from emberlog.functions import masking
from emberlog.plans import queries as log_queries

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_a_name_in_both():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(log_queries.ORACLE_SQL) == set(log_queries.QUERIES)


def _plain(value):
    return None if value != value else value


@pytest.mark.parametrize("name", sorted(log_queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    want = con.execute(log_queries.ORACLE_SQL[name]).fetchall()
    names = [d[0] for d in con.description]
    got = log_queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(map(_plain, r)) for r in got.select(*names).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, (tuple(map(_plain, r)) for r in want)))


def test_without_the_llm_folder(tmp_path):
    root = Path(__spark_entry__.__file__).parent
    copy = tmp_path / "repo"
    shutil.copytree(root / "emberlog", copy / "emberlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cards' in q and not any(k.startswith('op') for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=60)
    for file in (root / "emberlog").rglob("*.py"):
        if "llm" not in file.parts:
            assert "emberlog.llm" not in file.read_text()


def test_template_hash_reads_every_line(spark, tmp_path):
    texts = ["first 1\nlater 0x1f\r\n\nlast \"q\" é", "first 2\nonly here 10.0.0.1", "one line", "", None, "\n\nafter blanks 2024-01-02T03:04:05Z\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    patterns = {masking.mask_text(line) for text in texts for line in (text or "").split("\n")}
    want = {(hashlib.md5(p.encode()).hexdigest(), masking.fnv_text(p)) for p in patterns}
    got = log_queries.template_hash(spark, str(tmp_path)).select("pattern_md5", "hash").collect()
    assert len(want) == 7 and sorted(map(tuple, got)) == sorted(want)
