from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from fleetloom.llm import columns


def brute(rows, width):
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    count = Counter(t[s : s + width] for _, t in data for s in range(len(t) - width + 1))
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, int)
        for s in range(len(t) - width + 1):
            if count[t[s : s + width]] > 1:
                gone[s] += 1
                gone[s + width] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), runs, sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, most_spans", [(200, 4096), (64, 4096), (100, 1)])
def test_equal_to_brute_force(awkward, plain, width, most_spans):
    found = columns.remove_repeats(awkward, width=width, most_spans=most_spans)
    rows = sorted((tuple(r)[:5] for r in found.collect()), key=repr)
    assert rows == brute(plain, width)
    assert sum(r[2] for r in rows) > 5000


def test_long_text_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(columns, "CHUNK", 500)
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    text = long + long[700:1400]
    found = list(columns._find(iter([_batch([text])]), 100))
    starts = sorted((s, n) for b in found for s, n in zip(b["s"].to_pylist(), b["n"].to_pylist(), strict=True))
    assert sum(n for _, n in starts) == len(text) - 99
    assert all(a + n == b for (a, n), (b, _) in zip(starts[:-1], starts[1:], strict=True))


def _batch(texts):
    import pyarrow as pa

    n = len(texts)
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())] + [pa.array([0] * n, pa.int64())] * 3, ["_text", "t1", "t2", "doc_id"])


def test_kept_bytes_fit_the_spans(awkward):
    for r in columns.remove_repeats(awkward).collect():
        assert sum(s["to"] - s["from"] for s in r.spans) == r.n_removed == r.n_bytes - len(r.kept)
        assert sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_empty_table_and_narrow_strings(nothing):
    assert columns.remove_repeats(nothing).collect() == []
    with pytest.raises(ValueError):
        columns.remove_repeats(nothing, width=10)
