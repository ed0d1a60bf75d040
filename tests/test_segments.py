"""A feed of text segments: appended to between runs, rotated, cut into pieces, truncated, replaced, purged."""

import pytest
from pyspark.errors import PySparkException, StreamingQueryException

from fleetloom.sources import segments
from fleetloom.streaming import minutes


@pytest.fixture
def feed(spark, tmp_path):
    src, out, cp = (tmp_path / x for x in ("src", "out", "cp"))
    src.mkdir()

    class Feed:
        folder = src

        def append(self, name, data):
            with open(src / name, "ab") as f:
                f.write(data)

        def run(self, **options):
            stream = segments.segment_stream(spark, str(src), **options)
            minutes.run_batches(stream, minutes.stream_ingest(str(out)), str(cp), closing=False)
            if not out.exists():
                return []
            back = spark.read.option("basePath", str(out)).parquet(str(out)).collect()
            return sorted((segments.segment_order(r["segment"])[-1], r["position"], r["value"]) for r in back)

    return Feed()


def test_growing_segment_no_line_twice_or_lost(feed):
    feed.append("log.000001", b"one\ntwo\nth")
    assert feed.run() == [("log.000001", 0, "one"), ("log.000001", 4, "two")]
    feed.append("log.000001", b"ree\n\nfo")
    assert feed.run()[2:] == [("log.000001", 8, "three"), ("log.000001", 14, "")]
    assert len(feed.run()) == 4
    # Rotated: the old segment is complete, its last line needs no line feed.
    feed.append("log.000001", b"ur")
    feed.append("log.000002", "fünf\nse".encode())
    assert feed.run()[4:] == [("log.000001", 15, "four"), ("log.000002", 0, "fünf")]
    feed.append("log.000002", b"chs\n")
    feed.append("log.000003", b"")
    assert feed.run()[6:] == [("log.000002", 6, "sechs")]


def test_starts_inside_a_segment(feed):
    feed.append("log.9", b"old\n")
    feed.append("log.10", b"a\nbb\nccc\n")
    feed.append("log.11", b"d\n")
    assert feed.run(start_segment="log.10", start_position=2) == [("log.10", 2, "bb"), ("log.10", 5, "ccc"), ("log.11", 0, "d")]
    # The checkpoint counts from now on, not the start that is asked for.
    feed.append("log.11", b"e\n")
    assert feed.run(start_segment="log.9")[3:] == [("log.11", 2, "e")]


def test_start_must_be_a_line(spark, feed):
    feed.append("log.1", b"abc\n")
    with pytest.raises(PySparkException, match="no line of log.1 begins at 2"):
        segments.segment_lines(spark, str(feed.folder), "log.1", 2).collect()


def test_order_is_that_of_numbers():
    names = ["log.1000000", "log.999999", "b/part-2", "b/part-10", "log.01", "log.1"]
    assert sorted(names, key=segments.segment_order) == ["b/part-2", "b/part-10", "log.01", "log.1", "log.999999", "log.1000000"]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 1000])
def test_pieces_of_any_size_give_the_same_lines(feed, size):
    data = b"\n\na\nlonger than a piece\n\nxy\n" + b"z" * 50 + b"\nend"
    feed.append("log.1", data)
    folder = segments.SegmentFolder({"path": str(feed.folder), "bytes_per_task": size})
    got = []
    feed.append("log.2", b"")
    for piece in folder.pieces(folder.first(), folder.latest()):
        for batch in folder.lines(piece):
            got += [(r["position"], r["value"].encode()) for r in batch.to_pylist()]
    expected, at = [], 0
    for line in data.split(b"\n"):
        expected.append((at, line))
        at += len(line) + 1
    assert got == expected


def test_large_segment_is_many_tasks(spark, feed):
    feed.append("log.1", b"".join(b"%d\n" % i for i in range(1000)))
    lines = segments.segment_lines(spark, str(feed.folder), bytes_per_task=100)
    assert lines.rdd.getNumPartitions() == 39
    assert sorted(int(r["value"]) for r in lines.collect()) == list(range(1000))


def test_empty_and_missing_folder(spark, feed):
    assert feed.run() == []
    assert segments.segment_lines(spark, str(feed.folder / "none")).count() == 0
    (feed.folder / "_temporary").mkdir()
    feed.append("_temporary/part-1", b"not yet\n")
    feed.append(".hidden", b"no\n")
    feed.append("log.1", b"no line feed")
    assert feed.run() == []
    feed.append("log.1", b"\n")
    assert feed.run() == [("log.1", 0, "no line feed")]


@pytest.mark.parametrize("later, message", [(b"", "the feed ends at log.1:4, before log.1:8"), (b"three\n", "log.1 was truncated: 4 bytes, read up to 8")])
def test_truncated_segment_stops(feed, later, message):
    feed.append("log.1", b"one\ntwo\n")
    feed.run()
    (feed.folder / "log.1").write_bytes(b"one\n")
    if later:
        feed.append("log.2", later)
    with pytest.raises(StreamingQueryException, match=message):
        feed.run()


def test_replaced_segment_stops(feed):
    feed.append("log.1", b"one\ntwo\n")
    feed.run()
    (feed.folder / "log.1").write_bytes(b"another file\n")
    with pytest.raises(StreamingQueryException, match="is not the one that was read up to 8"):
        feed.run()


def test_purged_segment(feed):
    feed.append("log.1", b"one\n")
    feed.run()
    (feed.folder / "log.1").unlink()
    feed.append("log.2", b"two\n")
    with pytest.raises(StreamingQueryException, match="log.1 is gone; it was read up to 4"):
        feed.run()
    assert feed.run(missing="skip") == [("log.1", 0, "one"), ("log.2", 0, "two")]
