"""String kernels against plain sets, the fit against one dense system, and held-out rows."""

import random
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetloom.llm import langid, queries
from fleetloom.llm.common import LOWER, UPPER, bytes_of

SMALL = "/root/testdata/sf0.01"
WORDS = {"xx": "ka ko mi ta ro ne sa".split(), "yy": "blen strum grof plin drask".split(), "zz": "東 京 é à ü ö".split()}
TABLE = str.maketrans(UPPER, LOWER)


def made(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))).capitalize(), lang))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit("clash") for c in ("h", "rank", "share", "letters", "k", "part", "source", "held_out", "score")})


def grams_of(text):
    b = (text or "").translate(TABLE).encode()
    return {b[i : i + n] for n in range(1, langid.SPAN + 1) for i in range(len(b) - n + 1)}


@pytest.mark.parametrize("piece", [3, 7, 1 << 20])
def test_grams_are_those_of_each_text(monkeypatch, piece):
    texts = ["", "a", "ab", "abc abd", None, "été 東京", "x" * 30, ""]
    every = {g for t in texts for g in grams_of(t)}
    # The longest n-gram of a text that is no more than that n-gram.
    bins = {g: [int(b[0]) for _, b in langid.grams(*bytes_of(pa.array([g]))) if len(b)][-1] for g in every}
    assert len(set(bins.values())) == len(bins)
    monkeypatch.setattr(langid, "PIECE", piece)
    data, offsets = bytes_of(pa.array(texts))
    found = [set() for _ in texts]
    for row, b in langid.grams(data, offsets):
        for r, v in zip(row.tolist(), b.tolist()):
            found[r].add(v)
    assert found == [{bins[g] for g in grams_of(t)} for t in texts]


def test_scores_equal_plain_kernels(spark):
    rows = made(60)
    df = frame(spark, rows)
    model = langid.fit(df, landmarks=10_000, ridge=1e-3)
    train = [r for r in rows if crc32(str(r[0]).encode()) % 5 != 0]
    sets = [grams_of(t) for _, t, _ in train]
    known = {g for s in sets for g in s if sum(g in o for o in sets) > 1}
    assert len(known) == len(model.landmarks)  # no two n-grams share a bin here
    root = lambda s: max(1, len(s & known)) ** 0.5
    kernel = lambda a, b: len(a & b & known) / root(a) / root(b)
    inner = np.array([[kernel(a, b) for b in sets] for a in sets])
    k = np.column_stack((inner, np.ones(len(sets))))
    y = np.array([[r[2] == x for x in sorted(WORDS)] for r in train], float)
    weights = np.zeros((len(sets) + 1, len(sets) + 1))
    weights[:-1, :-1] = inner
    alpha = np.linalg.lstsq(k.T @ k + 1e-3 * len(sets) * weights, k.T @ y, rcond=1e-10)[0]
    want = np.array([[kernel(grams_of(t), s) for s in sets] + [1] for _, t, _ in rows]) @ alpha
    data = bytes_of(pa.array([t.translate(TABLE) for _, t, _ in rows]))
    got = np.concatenate([model.scores(x) for x in langid.presence(*data, model.place, len(model.landmarks))])
    assert np.abs(got - want).max() < 2e-3
    found = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(found[r[0]].lang_pred == sorted(WORDS)[w.argmax()] and abs(found[r[0]].score - min(1, w.max())) < 2e-3 for r, w in zip(rows, want) if np.sort(w)[-1] - np.sort(w)[-2] > 0.01)


def test_two_products_give_the_same(spark):
    model = langid.fit(frame(spark, made(80)), landmarks=6)
    x = next(langid.presence(*bytes_of(pa.array([t for _, t, _ in made(20, 2)])), model.place, len(model.landmarks)))
    direct = model.scores(x)
    model.direct = None
    assert np.abs(direct - model.scores(x)).max() < 1e-4


def test_awkward_rows(spark):
    rows = made(200) + [(900, None, "xx"), (901, "", "xx"), (902, "12, 34!", "yy"), (903, "Ω", None), (904, "ka ko " * 400_000, "xx"), (None, "ka ko mi ta", "yy")]
    rows += [(905, "blen strum", "yy")] * 40 + [(906, "grof plin drask", None), (907, "東", "zz")]
    found = langid.identify(frame(spark, rows))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = found.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and all(by[i].score == 0 for i in (900, 901, 902))
    assert by[904].lang_pred == "xx" == by[None].lang_pred and by[905].lang_pred == by[906].lang_pred == "yy" and by[907].lang_pred == "zz"
    assert by[903].lang_pred in WORDS and not by[None].held_out
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang for r in got for i, _, lang in rows[:200] if r.doc_id == i) >= 198


def test_labels_of_held_out_rows_are_not_read(spark):
    rows = made(120)
    turned = [(i, t, "xx" if crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows]
    both = [sorted(tuple(r) for r in langid.identify(frame(spark, x)).collect()) for x in (rows, turned)]
    assert both[0] == both[1]


def test_nothing_to_learn_and_nothing(spark):
    assert langid.identify(frame(spark, [])).collect() == []
    (r,) = langid.identify(frame(spark, [(1, "some words", None)])).collect()
    assert (r.lang_pred, r.score) == ("und", 0.0)
    one = langid.identify(frame(spark, [(1, "ka ko mi", "xx"), (5, "ka ro", "xx")])).collect()
    assert {r.lang_pred for r in one} == {"xx"}


def test_held_out_rows_of_the_documents(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.QUERIES["op11_string_kernel"](spark, SMALL).collect() if r.held_out]
    assert len(held) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
