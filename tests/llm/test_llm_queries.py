"""The registered queries of the training-data operators against SQL or brute force."""

import hashlib
import html
import re
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from ledgerloom.llm import near_dup, sharding
from ledgerloom.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, small, name):
    assert compare(QUERIES[name](spark, small), connect(small), ORACLES[name]) == []


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_html_text(spark, small):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op3_html_text"](spark, small).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", article)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
        text = "\n\n".join(x for x in blocks if x)
        assert (got[k].text, got[k].n_chars) == (text, len(text))


def test_decontamination(spark, small, docs):
    plain = lambda t: re.sub(r"\s+", " ", t.lower())
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = {r.doc_id: r.leaks for r in QUERIES["op4_decontamination"](spark, small).collect()}
    whole = {d.doc_id: [i for i, t in items if t in plain(d.text)] for d in docs}
    assert len(got) == len(docs)
    assert {k for k, v in got.items() if v} == {k for k, v in whole.items() if v} != set()
    assert all(set(v) <= set(got[k]) for k, v in whole.items())


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact_components(rows):
    """Component of every id, from all pairs of texts."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates(spark, small, docs):
    got = {r.doc_id: r for r in QUERIES["op6_near_dup"](spark, small).collect()}
    want = exact_components([(d.doc_id, d.text) for d in docs])
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {d.doc_id: len(shingles(d.text)) for d in docs}
    assert all(r.kept == (k == want[k]) for k, r in got.items())
    assert len(set(want.values())) < len(docs)


def test_language(spark, small, docs):
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, small).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    held = [d for d in docs if got[d.doc_id].held_out and d.lang]
    right = sum(got[d.doc_id].lang_pred == d.lang for d in held)
    assert right >= 0.95 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in got.values())


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    text, found = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    for rank, (kind, shape, valid) in enumerate(kinds):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(shape, text) if valid(m)]
    return sorted(found)


def test_pii(spark, small, docs):
    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, small).collect()}
    assert len(got) == len(docs)
    for d in docs:
        spans, r = base_spans(d.text), got[d.doc_id]
        text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        counts = Counter(k for _, _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))


def test_pipeline(spark, small, docs, tmp_path):
    """Each stage against brute force, on what its predecessor wrote."""
    frame, folders = spark.read.parquet(f"{small}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        before = frame.collect()
        stage(spark, frame, small).write.parquet(folders.setdefault(name, str(tmp_path / name)))
        frame = spark.read.parquet(folders[name])
        after = frame.collect()
        ids = {r.doc_id for r in after}
        if name == "language":
            assert {r.doc_id for r in before} - ids <= {r.doc_id for r in before if len(r.text or "") < 400}
            assert len(ids) >= 0.98 * len(before)
        elif name == "near_duplicates":
            assert ids == set(exact_components([(r.doc_id, r.text) for r in before]).values())
        elif name == "decontamination":
            plain = lambda t: re.sub(r"\s+", " ", t.lower())
            items = [plain(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            assert ids == {r.doc_id for r in before if not any(t in plain(r.text) for t in items)}
        elif name == "mixing":
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folders['decontamination']}/*.parquet'")
            taken = con.sql(ORACLES["op7_mixing"]).fetchall()  # doc_id, size, source_size, target, taken
            times = {k: n // s + (2 * (n % s) >= s) for k, s, _, _, n in taken if s}
            assert Counter(r.doc_id for r in after) == Counter({k: n for k, n in times.items() if n})
        if name == "sharding":
            owner = sharding.lookup_table()
            for r in after:
                slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % sharding.SLOTS
                assert (r.slot, r.shard) == (slot, sharding.SHARDS[owner[slot]])
            assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
        else:
            assert frame.columns == columns
    assert Counter(map(tuple, corpus_pipeline.run(spark, small).collect())) == Counter(map(tuple, after))


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    """A chain of copies, each near the next only, with blocks of a few members."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(30)] + [(100, "lone text of its own here")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_components(rows)
    assert got[29] == 0


def test_blocks_by_bytes_and_dealt_copies(spark, monkeypatch):
    """Long texts that share a bucket lie in blocks of few bytes; many copies are joined by their salts."""
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 4096)
    monkeypatch.setattr(near_dup, "SALTS", 4)
    words = [f"w{i}" for i in range(2600)]
    rows = [(i, " ".join(words[40 * i : 40 * i + 600])) for i in range(40)]
    rows += [(200 + i, rows[7][1]) for i in range(60)] + [(300 + i, "five words that stand alone") for i in range(60)]
    rows += [(400, None), (401, ""), (402, " ")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == exact_components(rows)
    assert {got[i] for i in range(200, 260)} == {0} and {got[i] for i in range(300, 360)} == {300}
    assert [got[i] for i in (400, 401, 402)] == [400, 401, 402]
