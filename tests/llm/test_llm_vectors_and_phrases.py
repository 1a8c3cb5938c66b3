"""Nearest neighbours, hard negatives and phrases against brute force, with odd rows, ties, copies and long texts."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import cells, hard_negatives, nearest, phrases

VECTORS = "vec_id long, embedding array<double>, label int, _n string, dims string, score string, rank string"


def vector_rows(n=260, dims=6, seed=5):
    """Three clusters, copies of one vector, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dims))
    v = centres[np.arange(n) % 3] + 0.2 * rng.normal(size=(n, dims))
    v[::4] = v[0]
    v[1::9] *= 2  # exact: cosines stay equal
    rows = [(i, [float(x) for x in v[i]], int(i % 4), "n", "d", "s", "r") for i in range(n)]
    rows += [rows[50], rows[50], rows[7]]  # repeated rows
    odd = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf"), 1.0], [None, 1.0], [1.0, -2.0]]
    rows += [(1000 + 50 * i, e, 1, "n", "d", "s", "r") for i, e in enumerate(odd)]
    return rows + [(None, [1.0] * dims, 1, "n", "d", "s", "r"), (1500, [1.0] * dims, None, "n", "d", "s", "r")]


def taking_part(rows):
    fine = lambda e: e is not None and all(x is not None and math.isfinite(x) for x in e)
    return [r for r in rows if r[0] is not None and fine(r[1])]


def padded(a, b):
    n = max(len(a), len(b))
    return [*a, *[0] * (n - len(a))], [*b, *[0] * (n - len(b))]


def cosine(a, b):
    a, b = padded(a, b)
    return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))


@pytest.fixture
def small_cells(monkeypatch):
    for name, value in (("ASKED", 4), ("HELD", 90), ("FEWEST", 60)):
        monkeypatch.setattr(cells, name, value)


def test_nearest(spark, small_cells, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", (2, 32))
    rows = vector_rows()
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in nearest.nearest(df.where("vec_id % 50 = 0"), df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    fine = [r for r in taking_part(rows) if any(r[1])]
    asked = {r[0]: r[1] for r in fine if r[0] % 50 == 0}
    assert got.keys() == asked.keys() and len(asked) > 6
    for q, v in asked.items():
        best = sorted((-round(cosine(v, r[1]), 9), r[0]) for r in fine if r[0] != q)[:5]
        assert sorted(got[q]) == [(i + 1, n, -s) for i, (s, n) in enumerate(best)]


def test_nearest_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1e300, 1e300]), (3, [1e-300, 0.0])], "vec_id long, embedding array<double>")
    got = nearest.nearest(df.where("vec_id % 50 = 0"), df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got] == [
        (0, 1, 3, 1.0), (0, 2, 50, 0.707107), (50, 1, 0, 0.707107), (50, 2, 3, 0.707107)
    ]
    assert nearest.nearest(df.where("false"), df).count() == nearest.nearest(df, df.where("false")).count() == 0


def test_tiles_leave_few_pairs():
    """The error bounds hold, and leave a small part of all pairs to be recomputed."""
    rng = np.random.default_rng(1)
    rows = [(i, False, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 48)))]
    schema = pa.schema([("vec_id", pa.int64()), ("asked", pa.bool_()), ("v", pa.list_(pa.float64()))])
    (coded,) = nearest._coded([pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)])
    side = nearest._Side(pa.Table.from_batches([coded]), 48)
    a, b = slice(0, 60), slice(0, 3000)
    row, at = nearest.survivors(side, side, a, b, np.full(60, -np.inf), 5)
    assert len(row) < 0.02 * 60 * 3000
    data = np.array([r[2] for r in rows])
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    cosines = unit[a] @ unit.T
    np.fill_diagonal(cosines, -9)
    best = np.argsort(-cosines, axis=1)[:, :5]
    assert {(i, j) for i in range(60) for j in best[i].tolist()} <= set(zip(row.tolist(), at.tolist()))


def brute_negatives(rows):
    fine = [(r[0], r[2], [math.floor(256 * x) for x in r[1]]) for r in taking_part(rows) if r[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(*padded(a, b)))
    out = Counter()
    for q, label, v in {r[0]: r for r in fine if r[0] % 50 == 0}.values():
        scored = sorted((-dot(v, e), i, lab) for i, lab, e in fine if i != q)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(i, -s) for s, i, lab in scored if lab != label and -50 * ps <= -100 * s <= -95 * ps][:3]
            out.update((q, p, n + 1, i, -ps, s) for n, (i, s) in enumerate(fits))
    return out


def test_hard_negatives(spark, small_cells, monkeypatch):
    for name, value in (("BUCKET", 16), ("ANCHORS", 3), ("SAMPLE", 40)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vector_rows()
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), phrases.F.col("vec_id") % 50 == 0).collect()
    want = brute_negatives(rows)
    assert Counter(tuple(r) for r in got) == want and len(want) > 20


def test_hard_negatives_few_and_empty(spark):
    schema = "vec_id long, embedding array<double>, label int"
    anchor = phrases.F.col("vec_id") % 50 == 0
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.7, 0.5], 2), (3, [1e12, 1e12], 1), (50, [-1.0, 0.0], 2), (51, [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, schema)
    got = hard_negatives.hard_negatives(df, anchor).collect()
    assert Counter(tuple(r) for r in got) == brute_negatives([(*r,) for r in rows]) != {}
    for none in (df.where("false"), df.where("label = 1"), df.where("vec_id = 0")):
        assert hard_negatives.hard_negatives(none, anchor).count() == 0


def test_coordinate_ranges_leave_few_rows():
    rng = np.random.default_rng(3)
    data = np.floor(256 * rng.normal(size=(4000, 8)))
    length = np.linalg.norm(data, axis=1)
    order = np.argsort(-length)[:1000]
    bucket = hard_negatives.Bucket(data[order], length[order], order, np.zeros(1000))
    for i in range(20):
        cosines = (data[order] @ data[i]) / (bucket.longest * length[i])
        found = bucket.feasible(data[i] / length[i], 0.9)
        assert set(np.flatnonzero(cosines >= 0.9)) <= set(found.tolist()) and len(found) < 300
    assert len(bucket.feasible(data[0] / length[0], 1.1)) == 0


def brute_phrases(rows, least, best):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + n])) for n in range(1, 6) for i in range(len(words) - n + 1))
    out = []
    often = {k: a for k, a in f.items() if a >= least and len(k[1]) >= 2}
    for (lang, p), a in often.items():
        within = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(other == lang and len(q) > len(p) and b >= a and within(q) for (other, q), b in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    for r in out:
        ranks[r[0]] += 1
        if ranks[r[0]] <= best:
            yield (r[0], ranks[r[0]], *r[1:])


def phrase_rows():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)] + ["Éa", "é", " x", "A", "a"]
    rows = []
    for i in range(60):
        some = rng.choice(words, size=40, p=np.arange(35, 0, -1) / 630)
        rows.append((" ".join(some).replace("w3", "w3.").replace("w7", "w7\t \n"), ("en", "de", None)[i % 3]))
    copies = [("Of this hot line, all COPIES tell: the same five and six words", "en")] * 40
    long = ("one two three four " * 500 + "x" * 400 + " five six seven " * 300, "de")
    return [*rows, *copies, long, (None, "en"), ("", "en"), (" \t\n.", None), ("...", "fr")]


@pytest.mark.parametrize("piece, part_mass", [(1 << 20, 1 << 27), (100, 700)])
def test_phrases(spark, monkeypatch, piece, part_mass):
    """With pieces of 100 bytes long texts are cut; with partitions of 700 n-grams there are many summaries."""
    monkeypatch.setattr(phrases, "PIECE", piece)
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, "p", "n", 1) for r in rows], "text string, lang string, phrase string, n string, part int")
    got = phrases.collocations(df, least=4, best=50, part_mass=part_mass).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_phrases(rows, 4, 50))
    assert phrases.collocations(df.where("false")).count() == 0


def test_cut_texts_keep_their_words(monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 20)
    text = "aa bb cc, dd ee " + "z" * 90 + " ff gg hh ii jj kk. " * 9
    seeds = np.zeros(2, dtype=np.uint64)
    cut = Counter((n, int(x)) for w in phrases.words_of(pa.array([None, text])) for n, _, found in phrases.grams(w, seeds) for x in found)
    monkeypatch.setattr(phrases, "PIECE", 1 << 20)
    assert cut == Counter((n, int(x)) for w in phrases.words_of(pa.array([None, text])) for n, _, found in phrases.grams(w, seeds) for x in found)


def test_summary_keeps_what_is_frequent():
    rng = np.random.default_rng(4)
    stream = np.concatenate([np.repeat(np.arange(40), 25), np.arange(1000, 9000), np.repeat(7, 4000)])
    rng.shuffle(stream)
    summary = phrases.Summary(capacity=(len(stream) - 4000) // 25 + 1, threshold=25)
    for part in np.array_split(stream, 30):
        summary.add(*np.unique(part, return_counts=True))
    kept = summary.survivors()
    assert set(range(40)) <= set(kept.tolist()) and len(summary.keys) <= summary.capacity
    tight = phrases.Summary(capacity=5, threshold=25)
    for part in np.array_split(stream, 30):
        tight.add(*np.unique(part, return_counts=True))
    assert set(range(40)) <= set(tight.survivors().tolist()) and tight.error == 24
    values = np.array([0, 1, 255, 256, 70000, 2**32 - 1])
    assert (phrases.unplanes(phrases.planes(values)) == values).all()
