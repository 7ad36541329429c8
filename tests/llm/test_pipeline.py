import pytest

import corpus_pipeline
from conftest import TESTDATA
from isobar.llm import pieces
from test_contamination import plain_windows
from test_lines import slow as slow_lines
from test_simhash import slow_components, slow_fingerprint

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")


def test_stages_against_plain_loops(spark, tmp_path):
    folder = str(TESTDATA)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    found = {}
    for name, stage in stages.items():
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        found[name] = (before.collect(), docs.collect())
        assert name == "sentencepiece" or docs.columns == columns

    before, after = found["language_id"]
    assert {r.doc_id for r in before if any(c.isalpha() for c in r.text)} == {r.doc_id for r in after}

    before, after = found["line_dedup"]
    gone = {k[0]: set(v) for k, v in slow_lines(spark, [(r.doc_id, r.text) for r in before]).items()}
    want = {r.doc_id: "\n".join(t for i, t in enumerate(r.text.split("\n")) if i not in gone.get(r.doc_id, ())) for r in before}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = found["simhash_near_dedup"]
    prints = {r.doc_id: slow_fingerprint(r.text) for r in before}
    root = slow_components(list(prints.values()))
    groups = {}
    for i, fp in prints.items():
        groups[root[fp]] = min(groups.get(root[fp], i), i)
    assert sorted(r.doc_id for r in after) == sorted(groups.values())

    before, after = found["benchmark_decontamination"]
    items = [plain_windows(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in before if any(w and len(w & plain_windows(r.text)) >= 0.8 * len(w) for w in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == dirty

    before, after = found["sentencepiece"]
    coder = pieces.Coder(pieces.load())
    assert {r.doc_id: r.ids for r in after} == {r.doc_id: coder.encode(r.text) for r in before}
    assert all(r.exact for r in after)


def test_run_over_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{TESTDATA}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{TESTDATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_pass_every_stage(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").limit(30)
    names = ("_text", "_row", "row", "fp", "_bad", "text_hash", "_removed", "_kid", "_th", "kid", "th", "removed", "c0", "Text_", "a.b")
    wide = docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names]).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = sorted((r.doc_id, r.text) for r in stage(spark, docs, str(TESTDATA)).collect())
        kept = stage(spark, wide, str(TESTDATA))
        assert kept.columns == wide.columns
        rows = kept.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == plain
        assert all(r[n] == n for r in rows for n in names)
    assert pieces.encode(wide).where("exact AND _text = '_text'").count() == 30
