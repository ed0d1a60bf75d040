from collections import Counter

import pytest

from fleetloom.llm import lengths


def direct(texts):
    with open(lengths.VOCABULARY, "rb") as f:
        encoder = lengths._encoder(f.read(), lengths.PATTERN)
    return [len(encoder.encode_ordinary(t or "")) for t in texts]


@pytest.mark.parametrize("span", [1, 64, 1024])
def test_table_equals_direct_counts(awkward, plain, monkeypatch, span):
    monkeypatch.setattr(lengths, "SPAN", span)
    n = direct([t for _, t, _ in plain])
    table = lengths.length_table(lengths.token_lengths(awkward))
    want = {
        k: (c, sum(x >= k for x in n), sum(x for x in n if x >= k), len(n), sum(n), sum(min(x, k) for x in n), sum(x <= k for x in n) / len(n))
        for k, c in Counter(n).items()
    }
    assert {r.length: tuple(r)[1:] for r in table.collect()} == want
    limits = [0, 1, 7, 100, 2048, 10**6]
    assert [tuple(r) for r in lengths.at_limits(table, limits).collect()] == [(k, sum(x > k for x in n), sum(min(x, k) for x in n)) for k in limits]
    for share, length in lengths.quantiles(table, [0.0, 0.1, 0.5, 0.99, 1.0]).collect():
        assert length == min(k for k in n if sum(x <= k for x in n) >= share * len(n))


def test_groups_and_clashing_columns(awkward, plain):
    rows = lengths.length_table(lengths.token_lengths(awkward, keep=["source"]), by=["source"]).collect()
    n = direct([t for _, t, _ in plain])
    for source in {s for *_, s in plain}:
        own = [x for x, (*_, s) in zip(n, plain, strict=True) if s == source]
        assert {(r.length, r.n_docs, r.tokens_all) for r in rows if r.source == source} == {(k, c, sum(own)) for k, c in Counter(own).items()}


def test_round_trip_of_the_encoder():
    with open(lengths.VOCABULARY, "rb") as f:
        encoder = lengths._encoder(f.read(), lengths.PATTERN)
    for text in ("", "Hello  wörld 東京\n\n\t12", "x" * 5000):
        assert encoder.decode(encoder.encode_ordinary(text)) == text


def test_empty_table(nothing):
    table = lengths.length_table(lengths.token_lengths(nothing))
    assert table.collect() == [] and [tuple(r) for r in lengths.at_limits(table, [5]).collect()] == [(5, 0, 0)]
