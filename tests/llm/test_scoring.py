import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fleetloom.llm import fmindex, mixlm, quality
from fleetloom.llm.common import LOWER, UPPER

TABLE = str.maketrans(UPPER, LOWER)
SMALL = "/root/testdata/sf0.001"


def tokens(text):
    return [x for x in re.split("[ \t\n\v\f\r]+", (text or "").translate(TABLE)) if x] + ["\n"]


def base_expected(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    count = Counter(x for (_, t, *_), h in zip(rows, held, strict=True) if not h for x in tokens(t))
    total, kinds = sum(count.values()), len(count)
    return [
        (i, h, len(tokens(t)), sum(count[x] > 0 for x in tokens(t)), total, round(sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in tokens(t)), 6))
        for (i, t, *_), h in zip(rows, held, strict=True)
    ]


def test_base_equals_plain_count(awkward, plain):
    found = mixlm.score_documents(awkward).collect()
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found]
    assert sorted(got, key=repr) == sorted(base_expected(plain), key=repr)
    assert all(r.score < 0 for r in found)
    for r in found:
        assert (r.bits_per_byte is None) == (r.n_bytes == 0)
        if r.n_bytes:
            assert abs(r.bits_per_byte * r.n_bytes + r.score / math.log10(2)) < 1e-6 * abs(r.score) + 1e-6
    same = {}
    for r in found:
        if r.doc_id == 700:
            same.setdefault(r.n_tokens, set()).add(round(r.score, 9))
    assert all(len(v) == 1 for v in same.values())


def test_scores_do_not_depend_on_held_out_texts(spark, awkward):
    from pyspark.sql import functions as F

    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    other = awkward.withColumn("text", F.when(held, F.reverse("text")).otherwise(F.col("text")))
    a, b = ({(r.doc_id, r.n_tokens, r.base_score, r.score) for r in mixlm.score_documents(df).collect() if not r.held_out} for df in (awkward, other))
    assert a == b


def test_probabilities_sum_to_one():
    """All texts of one byte, two bytes, ... share what the shorter ones leave: over the first symbol the sum is one."""
    rng = np.random.default_rng(0)
    code = mixlm.build_code(rng.integers(0, 50, (256, mixlm.SYMBOLS)))
    tables = [mixlm.to_cells(rng.integers(0, 9, (1 << 16, 2)))] + [mixlm.to_cells(rng.integers(0, 4, (1 << 16, 2))) for _ in range(mixlm.HASHED)]
    mixer = mixlm._fresh_mixer(code, tables, 16)

    def log2p(symbols):
        texts = pa.array([bytes(s) for s in symbols], pa.binary())
        return np.concatenate([mixer.score(d, o) for _, _, d, o in mixlm._pieces(texts)])

    empty = 2.0 ** log2p([[]])[0]
    ends = np.exp2(log2p([[b] for b in range(256) if not 65 <= b <= 90]))
    assert 0 < empty < 1 and ends.sum() < 1 - empty


def test_held_out_texts_are_predicted(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r for r in mixlm.score_documents(df).collect() if r.held_out]
    bits = -sum(r.score for r in rows) / math.log10(2) / sum(r.n_bytes for r in rows)
    assert len(rows) > 10 and bits < 2.9  # bytes alone take 4.6 bits


def test_empty_tables(nothing, spark):
    assert mixlm.score_documents(nothing).collect() == []
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(nothing, labels).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.contamination(nothing, bench).collect() == []


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = [r for r in quality.quality_scores(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.93


def test_quality_does_not_read_held_out_labels(spark, awkward):
    from pyspark.sql import functions as F

    labels = awkward.select("doc_id", (F.length("text") % 2).cast("int").alias("quality")).filter("doc_id is not null").distinct()
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r for r in quality.quality_scores(awkward, x).collect()), key=repr) for x in (labels, flipped))
    assert a == b and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in a)
    none = quality.quality_scores(awkward, labels.filter("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5} and len(none) == len(a)
    out = quality.keep_good(awkward, labels)
    assert out.columns == awkward.columns and out.count() == sum(r.predicted for r in a)


def test_pool_violators():
    y, n = np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1, 1, 1, 2, 1.0])
    assert np.allclose(quality.pool_violators(y, n), [0.1, 0.3, 0.3, 0.3, 0.9])


def windows(text, width):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))
    return w, [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []


@pytest.mark.parametrize("width, block_bytes", [(13, 1 << 20), (4, 200), (2, 10)])
def test_contamination_equals_brute_force(spark, awkward, plain, width, block_bytes):
    texts = [t for _, t, _ in plain if t]
    items = [(1, texts[0]), (2, texts[40][:200]), (3, "the"), (4, None), (5, ""), (6, "the of"), (7, "東 xyz!"), (1, texts[7]), (None, texts[9]), (10, texts[41])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = {}
    for item, text in items:
        for w in windows(text, width)[1]:
            known.setdefault(w, set()).add("null" if item is None else str(item))
    want = []
    for doc_id, text, _ in plain:
        words = windows(text, width)[0]
        hit, named = [False] * len(words), set()
        for i in range(len(words)):
            for k in range(1, min(width, len(words) - i) + 1):
                if found := known.get(tuple(words[i : i + k])):
                    named |= found
                    hit[i : i + k] = [True] * k
        n = sum(hit)
        want.append((doc_id, len(words), n, sorted(named), n > 0 and 20 * n >= len(words)))
    found = fmindex.contamination(awkward, bench, width=width, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in found), key=repr) == sorted(want, key=repr)
    assert all(sum(s["to"] - s["from"] for s in r.spans) == r.n_hit for r in found)
    left = fmindex.drop_contaminated(awkward, bench, width=width, block_bytes=block_bytes)
    assert left.columns == awkward.columns and left.count() == sum(not w[4] for w in want)


def test_index_finds_what_is_there():
    rng = np.random.default_rng(5)
    for _ in range(20):
        text = np.concatenate(([0], rng.integers(0, 5, 300), [0]))
        index = fmindex.FMIndex(text, 3)
        patterns = rng.integers(1, 5, (12, 4))
        length = rng.integers(1, 5, 12)
        lo, hi = index.search(patterns, length)
        for p, k, a, b in zip(patterns, length, lo, hi, strict=True):
            want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == p[:k]).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_contexts_of_every_training_document_count(spark):
    """Each held-out text repeats one training document; none of them may be unknown, also if its weights were fitted on it."""
    rng = np.random.default_rng(6)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 400)) for _ in range(60)]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    others = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = list(zip(others[:60], texts, strict=True)) + list(zip(held[:60], texts, strict=True))
    found = [r for r in mixlm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    bits = [r.bits_per_byte for r in found]
    assert len(bits) == 60 and max(bits) < 1.5 * np.median(bits)


def test_sample_is_written_before_one_task_reads_it(awkward, monkeypatch):
    made, write_out = {}, mixlm.write_out
    monkeypatch.setattr(mixlm, "write_out", lambda df, label: made.setdefault(label, write_out(df, label)))
    mixlm.score_documents(awkward)
    assert made["sample"].columns == ["_text"]


def test_weights_are_fitted_on_every_training_document(spark, monkeypatch):
    """Every decision of every training document is in the table that weights and refinement are solved from, long texts included."""
    rng = np.random.default_rng(7)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 8, n)) for n in [300] * 30 + [2 * mixlm.SAMPLE_LONGEST]] + [None, ""]
    seen, solve = [], mixlm.solve
    monkeypatch.setattr(mixlm, "solve", lambda mixer, outcomes: seen.append((mixer.code, outcomes.sum())) or solve(mixer, outcomes))
    found = mixlm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    (code, decisions), want = seen[0], 0
    for r in found:
        if not r.held_out:
            raw = (texts[r.doc_id] or "").encode()
            want += code.length[np.frombuffer(b"\n" + raw, np.uint8), np.append(np.frombuffer(raw, np.uint8), mixlm.END)].sum()
    assert len(texts[30]) > mixlm.SAMPLE_LONGEST and decisions == want


def test_solved_weights_cost_least():
    rng = np.random.default_rng(8)
    code = mixlm.build_code(np.zeros((256, mixlm.SYMBOLS), np.int64))
    mixer = mixlm._fresh_mixer(code, [], 16)
    steps = rng.integers(0, 16, (200_000, mixlm.HASHED))
    want = np.array([0.1, 0.5, 0.2, 0.4])
    bit = rng.random(len(steps)) < 1 / (1 + np.exp(-(mixlm._STEP[steps] @ want)))
    at = 5
    for s in steps.T:
        at = at * 16 + s
    mixlm.solve(mixer, np.bincount(2 * at + bit, minlength=mixlm.OUTCOMES))
    assert np.abs(mixer.weights[5] - want).max() < 0.03 and np.abs(mixer.weights[4] - 0.3).max() < 1e-6
