import importlib

pipeline = importlib.import_module("corpus_pipeline")
fmindex, lines, mixing, quality, shingles = (importlib.import_module(f"fleetloom.llm.{x}") for x in ("fmindex", "lines", "mixing", "quality", "shingles"))
SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, [{r.doc_id for r in docs.collect()}]
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    for i, (name, stage) in enumerate(pipeline.STAGES):
        if i == 0:
            want = {r.doc_id for r in quality.quality_scores(docs, labels).collect() if r.predicted}
        elif i == 1:
            cut = {r.doc_id: r.n_removed for r in lines.line_report(docs).collect()}
            want = set(cut)
        elif i == 2:
            want = {r.doc_id for r in shingles.near_duplicates(docs).collect() if r.kept}
        elif i == 3:
            want = {r.doc_id for r in fmindex.contamination(docs, bench).collect() if not r.contaminated}
        else:
            want = {r.doc_id for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        assert {r.doc_id for r in rows} == want and len(rows) == len(want) > 0
        if i < 4:
            assert after.columns == columns
        if i == 1:
            before = {r.doc_id: r.text for r in docs.collect()}
            assert all((before[r.doc_id] == r.text) == (cut[r.doc_id] == 0) and r.n_chars == len(r.text) for r in rows)
            assert any(cut.values())
        docs = after
        ids.append(want)
    assert len(ids[1]) < len(ids[0]) and len(ids[3]) < len(ids[2]) and len(ids[4]) <= len(ids[3])
    assert docs.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert {tuple(r) for r in pipeline.run(spark, SMALL).collect()} == {tuple(r) for r in docs.collect()}
