"""Row ids that hold when Spark deals the files out anew, as after losing an executor."""

import random

import pytest
from pyspark.sql import functions as F

from fleetloom.llm import common, lines, mixlm, shingles, warc

SPLIT = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"


@pytest.fixture
def dealt(spark):
    """A function that has files dealt out in a few large or in many small partitions from now on."""
    before = {k: spark.conf.get(k, None) for k in SPLIT}

    def deal(small):
        for k, v in zip(SPLIT, ("2k", "1k", "37") if small else ("128m", "4m", "2")):
            spark.conf.set(k, v)

    yield deal
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = [" ".join(word() for _ in range(9)) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(line) for _ in range(4)) + f"\n{word()} {word()} {word()} {i}", f"http://x/{i}") for i in range(300)]
    rows += [(1000 + i, rows[i][1], "http://y") for i in range(0, 300, 7)]
    path = str(tmp_path_factory.mktemp("many")) + "/t.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, url string").repartition(23, "doc_id").write.parquet(path)
    return path


def test_ids_stay(spark, files, dealt):
    dealt(False)
    df = common.stable_row_id(spark.read.parquet(files).filter("doc_id <> 4").select("text", "doc_id"), "n")
    few = {r.doc_id: r.n for r in df.collect()}
    assert df.columns == ["text", "doc_id", "n"] and len(set(few.values())) == len(few)
    dealt(True)
    again = spark.read.parquet(files).filter("doc_id <> 4").select("text", "doc_id")
    assert again.rdd.getNumPartitions() > 20
    assert {r.doc_id: r.n for r in common.stable_row_id(again, "n").collect()} == few


def test_many_files_are_written_with_their_ids(spark, files, dealt, monkeypatch):
    monkeypatch.setattr(common, "MOST_FILES", 5)
    df = common.stable_row_id(spark.read.parquet(files))
    few = {r.doc_id: r.rid for r in df.collect()}
    dealt(True)
    assert {r.doc_id: r.rid for r in df.select("*").collect()} == few and len(set(few.values())) == len(few)


def test_clashing_names_stay_as_they_are(spark, tmp_path):
    names = ("rid", "_rid", "_removed", "file_path", "row_index", "file_number", "_metadata", "n")
    df = spark.createDataFrame([(i, f"some words of line {i % 2} and more of it") for i in range(6)], "doc_id long, text string")
    df = df.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in names})
    df.write.parquet(str(tmp_path / "t"))
    for source in (df, spark.read.parquet(str(tmp_path / "t"))):
        for out in (lines.drop_lines(source), shingles.keep_one(source)):
            assert out.columns == df.columns and out.count() > 0
            assert all(r[c] == f"{c}-{r.doc_id}" for r in out.collect() for c in names)


@pytest.mark.parametrize("name", ["lines", "cut", "near", "kept", "warc", "scores"])
def test_results_stay_when_files_are_dealt_out_anew(spark, files, dealt, name):
    run = {
        "lines": lines.line_report, "cut": lines.drop_lines, "near": lambda d: shingles.near_duplicates(d).drop("rid"), "kept": shingles.keep_one,
        "warc": lambda d: warc.warc_round_trip(d.withColumnsRenamed({"doc_id": "page_id", "text": "html"}), min_payload=0), "scores": mixlm.score_documents,
    }[name]
    dealt(False)
    want = sorted(map(repr, run(spark.read.parquet(files)).collect()))
    dealt(False)
    later = run(spark.read.parquet(files))  # its first jobs run now, the last one after the change
    dealt(True)
    # The frame is planned anew, as the partitions of a stage are found when it runs.
    assert sorted(map(repr, later.select("*").collect())) == want
