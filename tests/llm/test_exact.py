from collections import defaultdict
from hashlib import sha256

import pytest

from fleetloom.llm import naming
from fleetloom.llm.common import LOWER, UPPER

TABLE = str.maketrans(UPPER, LOWER)


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[(text or "").translate(TABLE)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            out.append((i, keep, len(ids), k == 0, sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [7, 64, 4096])
def test_equal_texts_share_a_name(awkward, plain, block_bytes):
    found = naming.exact_dedup(awkward, block_bytes=block_bytes)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(plain)


def test_prefixes_and_shifts_keep_apart(spark):
    texts = ["a" * n for n in range(1, 40)] + ["b" + "a" * n for n in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert naming.exact_dedup(df, block_bytes=3).filter("group_size > 1").count() == 0


def test_empty_table(nothing):
    assert naming.exact_dedup(nothing).collect() == []
