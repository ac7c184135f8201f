import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from eventloom.llm import langid, mixing, queries, secrets
from eventloom.llm.common import Written
from tests.llm.test_simhash import groups, shingles

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, some):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mixing", "bpe"]
    docs, rows = some, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = Written(stage(spark, docs, SF), name).df
        rows[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == some.columns
    start = {r["doc_id"]: r for r in some.collect()}
    filters = langid.train(some)
    assert {r["doc_id"] for r in rows["language"]} == {i for i, r in start.items() if filters.predict(r["text"])[1] >= corpus_pipeline.LEAST_SCORE}
    held = {r["doc_id"]: shingles(r["text"]) for r in rows["language"]}
    alike = groups(sorted(held), lambda a, b: held[a] == held[b] or len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b]))
    kept = {r["doc_id"] for r in rows["near_duplicates"]}
    assert kept == {i for i, g in alike.items() if i == g} and len(kept) == len(rows["near_duplicates"])
    assert {r["doc_id"] for r in rows["secrets"]} == kept
    assert secrets.report(spark.createDataFrame(rows["secrets"], some.schema)).where("n_assign + n_access + n_hex > 0").count() == 0
    changed = {r["doc_id"] for r in rows["secrets"] if r["text"] != start[r["doc_id"]]["text"]}
    found = {r["doc_id"] for r in secrets.report(spark.createDataFrame(rows["near_duplicates"], some.schema)).where("spans != ''").collect()}
    assert changed == found
    mixed = mixing.repeated(spark.createDataFrame(rows["secrets"], some.schema)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {i: sum(r["doc_id"] == i for r in rows["mixing"]) for i in {r["doc_id"] for r in rows["mixing"]}}
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in rows["mixing"])
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in rows["bpe"]) == want


def test_odd_documents_pass_all_stages(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = Written(stage(spark, docs, SF), name).df
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_registry():
    assert sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [q for n in range(1, 11) for q in queries.QUERIES if q.startswith(f"op{n}_")]
    assert len(queries.QUERIES) == 10


def test_rest_stands_without_this_subpackage(tmp_path):
    import shutil

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "eventloom", tmp_path / "eventloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 40"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    for p in (root / "eventloom").rglob("*.py"):
        assert "llm" in p.parts or "llm" not in p.read_text()


