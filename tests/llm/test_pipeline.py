import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as P
from lodestone.llm import packing, tokens
from lodestone.session import table

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    docs = table(spark, SF, "documents")
    for _, stage in P.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        kept = {r.doc_id for r in left.select("doc_id").collect()}
        assert kept <= ids and kept
        docs = left.cache()
    enc = tokens.encoder(tokens.RANKS).encoding
    want = sorted((r.doc_id, n) for r in docs.collect() for n in packing.decompose(__import__("numpy").array([len(enc.encode_ordinary(r.text))]))[1].tolist())
    assert sorted((r.doc_id, r.bucket) for r in P.pack(spark, docs, SF).collect()) == want
    assert sorted((r.doc_id, r.bucket) for r in P.run(spark, SF).collect()) == want


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            left = stage(spark, docs, SF)
            assert left.columns == docs.columns and left.count() <= docs.count()
        P.pack(spark, docs, SF).count()


def test_line_dedup_sets_n_chars(spark):
    left = P.line_dedup(spark, table(spark, SF, "documents"), SF)
    assert left.where("n_chars <> length(text)").count() == 0


def test_rest_imports_without_this_subpackage(tmp_path):
    for p in ("__spark_entry__.py", *[str(x.relative_to(ROOT)) for x in (ROOT / "lodestone").rglob("*.py") if "llm" not in x.parts]):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text((ROOT / p).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_ranked' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
    for x in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in x.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", x.read_text(), re.M), x


def test_queries_are_registered():
    import __spark_entry__ as e

    q = e.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and set(e.oracle_sql()) <= set(q)


def test_item_cut_by_line_dedup_still_marks_its_document(spark, tmp_path):
    first, middle, last = "Which of the northern harbours freezes over first in winter", "when the wind has blown from the east for several weeks on end", "and the river brings no warmer water from the hills behind it"
    spark.createDataFrame([(1, f"{first}\n{middle}\n{last}")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"One host begins so. {first}\n{middle}\n{last} One host ends.", f"Another begins. {first}\n{middle}\n{last} Another ends.", f"A third host has nothing of it.\nIt stays, {first[:30]}"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    left = P.line_dedup(spark, docs, str(tmp_path))
    assert sum(middle in r.text for r in left.collect()) == 1
    assert [r.doc_id for r in P.benchmark_filter(spark, left, str(tmp_path)).collect()] == [2]
