"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import (
    cells, components, decontamination, hashing, html_text, language_id, license_scan, mixing, near_dup, pii, sharding, topk, url_filter,
)

NAMES = "doc_id long, text string, lang string, source string, n_chars long, _words string, size string, score string, key string, shard string, id string, a string"
PROSE = "Released under the MIT License. Write to jo@mail.example.com or to 10.0.0.1 now please. "


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), "w", "z", "c", "k", "h", "i", "a")


@pytest.fixture(scope="module")
def messy(spark):
    """Null id, null, empty and blank texts, a long text, repeated rows, columns of the operators' names."""
    long = "many words of a very long text " * 20_000
    rows = [row(1, PROSE * 3), row(1, PROSE * 3), row(2, None), row(3, ""), row(4, " \n\t"), row(5, long), row(None, PROSE), row(6, PROSE, None, None)]
    return spark.createDataFrame(rows, NAMES)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], NAMES)


def test_license(messy, empty):
    got = license_scan.scan(messy).select("doc_id", "n_words", "n_base", "first_word", "labels", "_words", "key").collect()
    assert len(got) == 8 and all(r["_words"] == "w" for r in got)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_base, by[1].first_word, by[1].labels) == (3, 3, "mit")
    for i in (2, 3, 4):
        assert (by[i].n_words, by[i].n_base, by[i].first_word, by[i].labels) == (0, 0, None, "")
    assert by[5].n_words == 140_000
    assert license_scan.scan(empty).count() == 0


def test_license_method_labels(spark):
    texts = [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "the GNU Lesser General Public License", "mit licence", "mit license mit license", "MIT the license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [(r.labels, r.base_labels, r.n_base, r.last_word) for r in license_scan.scan(df).orderBy("doc_id").collect()]
    assert got == [("bsd", "", 0, None), ("gpl,lgpl", "gpl", 1, 3), ("", "", 0, None), ("mit", "mit", 2, 2), ("", "", 0, None)]


def test_license_whole_texts(spark):
    """Whole texts are found by their key phrase and agreement, also where words in them differ."""
    text = {t.label: t.text for t in license_scan.TEMPLATES}
    mit = text["mit-full"]
    texts = [
        f"Copyright 2020 {mit}", f"see {mit.replace('HOLDERS', 'owners')} end", mit[: len(mit) // 4], mit.replace("obtaining", "getting"),
        text["bsd-2-clause"], text["bsd-3-clause"], text["isc-full"], text["zlib"] * 2,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = license_scan.scan(df).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == [
        "mit-full,mit-text", "mit-full,mit-text", "mit-text", "", "bsd,bsd-2-clause", "bsd,bsd-3-clause", "isc,isc-full", "zlib",
    ]
    assert all(r.n_base == 0 and r.base_labels == "" for r in rows)
    assert [round(r.score, 3) == 1 for r in rows] == [True, True, True, False, True, True, True, True]


def test_license_words_apart(spark):
    """Postings that tell different starts are no proposal, however many there are."""
    df = spark.createDataFrame([(0, "license general public license mit " * 2000), (1, "public license general " * 2000)], "doc_id long, text string")
    rows = license_scan.scan(df).orderBy("doc_id").collect()
    assert [(r.labels, r.n_base) for r in rows] == [("gpl,mit", 3999), ("gpl", 1999)]


def test_sharding(messy, empty, spark, tmp_path):
    placed = sharding.place(messy, sharding.document_key(messy))
    got = placed.collect()
    assert len(got) == 8 and {r["_words"] for r in got} == {"w"}
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.place(empty, sharding.document_key(empty)).count() == 0
    sharding.write_shards(placed, str(tmp_path / "shards"), parts=2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 8


def test_sharding_balance_and_stability():
    names = [f"n{i}" for i in range(20)]
    owner = sharding.lookup_table(names)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 19)
    assert moved < 0.1 * len(owner)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], slots=100)


def test_html():
    page = (
        "<html><body class='has-sidebar'><header><h1>Site</h1><nav><a href=x>Home</a></nav></header>"
        "<aside>side</aside><div class='cookie-notice'>we use cookies</div>"
        "<main><article><header><h1>Head&amp;line</h1><span class=share>share</span></header>"
        "<p>One <b>bold</b>\n  &eacute;t&#233;<br>more<p>Two<div class=ad>buy</div><ul><li>x<li>y</ul>"
        "<form><input><button>go</button></form><script>var a='<p>no</p>';</script><style>p{}</style><!-- no <p>no</p> -->"
        "<p>Last</p></article><section id=comments><article class=comment><p>" + "nice post " * 50 + "</p></article></section></main>"
        "<footer>&copy; x</footer>"
    )
    assert html_text.main_text(page) == "Head&line\n\nOne bold été more\n\nTwo\n\nx\n\ny\n\nLast"
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "<article></article>", "<!-- open", "<script>x")] == [""] * 6
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<div>a</div>" * 3 + "<a href='\">b") != ""


def test_html_without_article():
    page = (
        "<body><div id=menu><a>Home</a><a>News</a></div><div>" + "".join(f"<p>{'long text ' * 12}{i}</p>" for i in range(4))
        + "</div>" + "<ul>" + "".join(f"<li><a href=x>other page number {i}</a></li>" for i in range(12)) + "</ul></body>"
    )
    text = html_text.main_text(page)
    assert text.startswith("long text") and "3" in text and "number 5" not in text


def test_html_plain_divs_are_not_cut():
    paragraphs = [f"paragraph {i} " + "with many words " * 8 for i in range(6)]
    p = [f"<p>{x}</p>" for x in paragraphs]
    links = "<ul>" + "".join(f"<li><a href=x{i}>a linked source {i}</a></li>" for i in range(5)) + "</ul>"
    furniture = "<div class=advert>buy</div><div class='related'>more</div><div id=newsletter>mail us</div>"
    opening = "<div>Title</div><p>By Jo</p><p>In short</p><p>And so</p><p>It goes</p>"
    body = opening + p[0] + links + p[1] + p[2] + furniture + "".join(p[3:]) + links
    linked = [f"a linked source {i}" for i in range(5)]
    first = ["Title", "By Jo", "In short", "And so", "It goes", paragraphs[0].strip(), *linked]
    want = first + [x.strip() for x in paragraphs[1:]] + linked
    menu = "<ul>" + "".join(f"<li><a href=x>page {i}</a></li>" for i in range(9)) + "</ul>"
    assert html_text.main_text(f"<body>{menu}<div>{body}</div>{menu}</body>").split("\n\n") == want
    parted = f"<body>{menu}<div><div>{opening}{p[0]}{links}</div>{furniture}<div>" + "".join(p[1:]) + f"{links}</div></div>{menu}</body>"
    assert html_text.main_text(parted).split("\n\n") == want
    divs = f"<body>{menu}<div><div>Title</div>{furniture}<div>{paragraphs[0]}</div>{furniture}<div>{paragraphs[1]}</div></div>{menu}"
    assert html_text.main_text(divs).split("\n\n") == ["Title", paragraphs[0].strip(), paragraphs[1].strip()]
    assert html_text.main_text(f"<p>one</p>{furniture}<p>two</p>") == "one\n\ntwo"


@pytest.mark.parametrize("name", ["post category-social", "tag-cookies", "category-advertising", "comment", "banner", "social"])
def test_html_articles_are_no_furniture_by_class(name):
    text = "some words of the text " * 9
    assert html_text.main_text(f"<div>site</div><article class='{name}'><p>{text}</p></article>") == text.strip()


@pytest.mark.parametrize("name", ["content-sidebar", "col-no-sidebar", "sidebar-left", "left-sidebar", "discussion", "banner"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_html_containers_of_the_text_are_no_furniture(name, inner):
    text = "some words of the text " * 9
    if name == "discussion" and inner == "div":
        return  # cannot be told from comments
    page = f"<body><div>site</div><div class='{name}'><{inner}><p>{text}</p><div class=ad>buy</div></{inner}></div></body>"
    assert html_text.main_text(page).split("\n\n")[-1] == text.strip()


@pytest.mark.parametrize("name", ["site-footer", "main-nav", "post-comments", "cookie-notice", "ad", "related-posts", "right-sidebar"])
def test_html_furniture_by_class(name):
    text = "some words of the text " * 9
    page = f"<body><div><p>{text}</p><div class={name}>{'more words ' * 9}</div><p>{text}</p></div></body>"
    assert html_text.main_text(page) == f"{text.strip()}\n\n{text.strip()}"
    assert html_text.main_text(page.replace("div>", "article>", 1)) == f"{text.strip()}\n\n{text.strip()}"


def test_html_text_of_several_articles():
    text = ["first entry of a log " * 9, "second entry of it " * 7]
    entries = "".join(f"<article><h2>Entry</h2><p>{x}</p></article>" for x in text)
    page = f"<main>{entries}<article><a href=x>next log</a></article></main><div><article><p>{'other story ' * 9}</p></article></div>"
    assert html_text.main_text(page).split("\n\n") == ["Entry", text[0].strip(), "Entry", text[1].strip()]


def test_html_long_and_frame(spark):
    page = "<article>" + "<p>some words here</p>" * 20_000 + "</article>" + "<b>" * 20_000
    assert html_text.main_text(page).count("\n\n") == 19_999
    df = spark.createDataFrame([(1, None, "t"), (2, "<p>x</p>", "t"), (2, "<p>x</p>", "t")], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]


ITEM = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion of remarkable strength"


def edits(a, b):
    """Fewest edits that turn a into a run of b."""
    before = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j - 1] + (x != y), before[j] + 1, now[-1] + 1))
        before = now
    return min(before)


def test_leaks_against_full_alignment():
    rng = np.random.default_rng(3)
    ix = decontamination.index([(1, ITEM)])
    texts = []
    for n in range(60):
        changed = list(ITEM)
        for _ in range(n % 16):
            at = int(rng.integers(len(changed)))
            kind = rng.integers(3)
            changed[at : at + (kind != 1)] = [] if kind == 0 else ["#"]
        texts.append("before it " + "".join(changed) + " after it all")
    got = [bool(x) for x in decontamination.leaks(pa.array(texts), ix)]
    want = [any(edits(p.decode(), t) <= e for p, e in zip(ix.pieces, ix.edits, strict=True)) for t in texts]
    assert got == want and 5 < sum(got) < 55


def test_leaks_of_partial_passages_at_all_offsets():
    rng = np.random.default_rng(7)
    item = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size=rng.integers(2, 9))) for _ in range(80))
    ix = decontamination.index([(1, item), (2, ITEM)])
    for length in (89, 96, 105, 120, 128):
        texts = [f"WORDS BEFORE IT {item[k : k + length]} AND AFTER" for k in range(len(item) - length + 1)]
        assert all(x == [1] for x in decontamination.leaks(pa.array(texts), ix)), length
    # 7 edits in 96 bytes, at every offset
    changed = [list(item[k : k + 96]) for k in range(len(item) - 95)]
    for x in changed:
        for at in range(6, 96, 13):
            x[at] = "#"
    assert all(x == [1] for x in decontamination.leaks(pa.array(["so " + "".join(x) + " it is" for x in changed]), ix))
    assert decontamination.leaks(pa.array([item[k : k + 70] for k in range(len(item) - 69)]), ix) == [[]] * (len(item) - 69)


def test_leaks_in_messy_texts(messy, empty, spark):
    ix = decontamination.index([(1, ITEM), (1, ITEM), (2, None), (None, ITEM), (3, "short"), (4, "twelve chars")])
    long = "unrelated words in between here " * 80_000
    texts = [None, "", ITEM.upper(), long + ITEM, long[: decontamination.CHUNK * 2 - 40] + ITEM + long, "x" * 3_000_000, "say twelve chars now", ITEM[:40]]
    assert decontamination.leaks(pa.array(texts), ix) == [[], [], [1], [1], [1], [], [4], []]
    assert decontamination.leaks(pa.array(texts), decontamination.index([])) == [[]] * len(texts)
    bench = spark.createDataFrame([(7, PROSE)], "item_id long, text string")
    got = decontamination.mark_leaks(messy, bench).select("doc_id", "leaks").collect()
    assert sorted((r.doc_id or 0, r.leaks) for r in got) == [(0, [7]), (1, [7]), (1, [7]), (2, []), (3, []), (4, []), (5, []), (6, [7])]
    assert decontamination.mark_leaks(empty, bench).count() == 0
    assert decontamination.mark_leaks(messy, bench.where("false")).where(F.size("leaks") > 0).count() == 0


def test_leaks_in_turns(messy, spark, monkeypatch):
    bench = spark.createDataFrame([(i, PROSE if i == 3 else f"other item number {i} " * 4) for i in range(9)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "SLICE", 200)
    got = {r.doc_id: r.leaks for r in decontamination.mark_leaks(messy, bench).collect()}
    assert got[1] == [3] and got[2] == []


def changes(spark, rows):
    return spark.createDataFrame(rows, "list string, domain string, action string, day string").withColumn("day", F.col("day").cast("date"))


def test_url_filter(spark):
    lists = changes(spark, [
        ("spam", "bad.example.com", "add", "2024-01-10"), ("spam", "bad.example.com", "add", "2024-01-10"),
        ("spam", "bad.example.com", "remove", "2024-02-01"), ("spam", "bad.example.com", "add", "2024-03-01"),
        ("adult", "EXAMPLE.com", "add", "2024-02-15"), ("adult", None, "add", "2024-01-01"), ("adult", "x.org", "drop", "2024-01-01"),
        ("spam", "same.org", "add", "2024-01-05"), ("spam", "same.org", "remove", "2024-01-05"),
    ])
    rows = [
        (1, "https://www.Bad.example.com:80/x", "2024-01-09"), (2, "https://bad.example.com/", "2024-01-10"),
        (3, "https://a.bad.example.com/", "2024-01-31"), (4, "https://bad.example.com", "2024-02-01"), (5, "http://u@bad.example.com", "2024-03-05"),
        (6, "http://notbad.example.com", "2024-02-14"), (7, None, "2024-01-10"), (8, "no url", "2024-01-10"), (9, "https://bad.example.com/", None),
        (2, "https://bad.example.com/", "2024-01-10"), (10, "http://same.org", "2024-01-06"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, day string").select("page_id", "url", F.col("day").cast("date").alias("fetched"), F.lit(1).alias("_day"), F.lit(2).alias("domain"))
    got = sorted((r.page_id, r.blocked, r.lists, r.entry) for r in url_filter.filter_urls(df, lists).collect())
    spam = (True, "spam", "bad.example.com")
    assert got == [
        (1, False, None, None), (2, *spam), (2, *spam), (3, *spam), (4, False, None, None), (5, True, "adult,spam", "bad.example.com"),
        (6, False, None, None), (7, False, None, None), (8, False, None, None), (9, False, None, None), (10, False, None, None),
    ]
    assert url_filter.filter_urls(df, lists.where("false")).where("blocked").count() == 0
    assert url_filter.filter_urls(df.where("false"), lists).count() == 0


def test_near_dup(messy, empty):
    rows = near_dup.near_duplicates(messy).collect()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows}
    prose = len({tuple((PROSE * 3).split()[i : i + 5]) for i in range(len((PROSE * 3).split()) - 4)})
    once = len(PROSE.split()) - 4
    assert (2, 0, 2, True) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert (None, once, None, True) in got and (1, prose, 1, True) in got
    assert len(rows) == 8
    assert near_dup.near_duplicates(empty).count() == 0


def test_near_dup_copies_and_short_texts(spark):
    rows = [(i, "a b c") for i in range(50)] + [(60, "a b"), (61, "A  B"), (62, "word")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0, 1) for i in range(50))
    assert (got[60], got[61], got[62]) == ((60, 1), (60, 1), (62, 1))


def test_components(spark):
    rng = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (700, 700)] + [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 80, (60, 2))]
    links = spark.createDataFrame(path, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500
    for a, b in path:
        assert got.get(a, a) == got.get(b, b)
    assert components.components(links.where("false")).count() == 0


def test_word_numbers_of_long_texts():
    text = "aBé cd\x0b ef\x1fg " * 300_000
    (a,) = hashing.shingle_sets(pa.array([text]))
    (b,) = hashing.shingle_sets(pa.array([text[:150]]))
    assert np.array_equal(a, b)
    first, second, third = hashing.shingle_sets(pa.array(["x" * 3_000_000, None, "one two"]))
    assert (len(first), len(second), len(third)) == (1, 0, 1)


def test_mixing(messy, empty, spark):
    got = mixing.mix(messy).collect()
    assert len(got) == 8 and all(r["_words"] == "w" for r in got)
    assert all(r.repeats * r.size + r.part <= 2 * r.size or r.size == 0 for r in got)
    total = {r.source: r.target for r in got}
    for source, target in total.items():
        taken = sum(r.repeats * r.size + r.part for r in got if r.source == source)
        assert abs(taken - target) <= 4
    assert [r.size for r in got if r.doc_id in (2, 3, 4)] == [0, 0, 0]
    assert mixing.mix(empty).count() == 0
    # equal draws: one id for all rows
    same = spark.createDataFrame([(1, "w " * 10, "a")] * 9 + [(2, "w " * 600, "b")], "doc_id long, text string, source string")
    rows = mixing.mix(same).where("source = 'b'").collect()
    assert abs(sum(r.repeats * r.size + r.part for r in rows) - rows[0].target) <= 1


def test_water_level(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_table(sized, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    # 3165 words: a and null stop at 200 and 20; b gets a third of the rest, c stops at 2000
    assert got["a"] == 200 and got[None] == 20
    assert abs(got["b"] - 981.6666667) < 1e-3 and abs(got["c"] - 1963.3333333) < 1e-3
    full = {r.source: r.target for r in mixing.source_table(sized, (3.0, 1.0), 5.0, 2.0).collect()}
    assert full == {"a": 200, "b": 2000, "c": 2000, None: 20}


LANGS = [(i, t, lang) for i, (t, lang) in enumerate(
    [("the cat and the dog were in the house with that thing", "en"), ("der hund und die katze waren nicht in dem haus", "de")] * 30)]


def test_language(messy, empty, spark):
    model = language_id.fit([(lang, t) for _, t, lang in LANGS])
    texts = [None, "", "123 ...", "…", "the dog", "der hund", "the house and that dog " * 20_000]
    got = language_id.predict(model, pa.array(texts))
    assert got.field(0).to_pylist() == ["und"] * 4 + ["en", "de", "en"]
    assert got.field(1).to_pylist()[:4] == [0.0] * 4
    assert language_id.identify(messy, model).count() == 8
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    unknown = language_id.identify(messy, language_id.train(messy.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in unknown.collect()} == {"und"}


def test_code_switched_words_have_their_own_language():
    model = language_id.fit([(lang, t) for _, t, lang in LANGS])
    text = b"the cat and the house with that dog und die katze waren nicht in dem haus"
    data = np.frombuffer(text, np.uint8)
    starts, stops, _, marginal = language_id.label_words(model, data, np.array([0, len(data)]))
    labels = [model.languages[k] for k in marginal.argmax(axis=1)]
    assert labels[:6] == ["en"] * 6 and labels[-6:] == ["de"] * 6
    assert np.allclose(marginal.sum(axis=1), 1)


def test_runs_of_a_long_text_are_labelled_as_one_chain(monkeypatch):
    model = language_id.fit([(lang, t) for _, t, lang in LANGS])
    rng = np.random.default_rng(5)
    words = "the cat dog house that thing der hund die katze haus nicht zzz q".split()
    text = " ".join(rng.choice(words, 1500)).encode()
    data, cuts = np.frombuffer(text + text[:400], np.uint8), np.array([0, len(text), len(text) + 400])
    in_runs = language_id.label_words(model, data, cuts)[3]
    monkeypatch.setattr(language_id, "RUN", 1 << 20)
    assert np.allclose(in_runs, language_id.label_words(model, data, cuts)[3], atol=1e-6)


def test_languages_of_long_texts_only_are_learned(spark):
    long = {"en": "the cat and the dog were in the house ", "de": "der hund und die katze waren nicht im haus "}
    rows = [(i, t * 800, lang) for i in range(12) for lang, t in long.items()]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"] and all(len(t) * 800 > language_id.SAMPLE_CHARS for t in long.values())
    assert language_id.predict(model, pa.array(["der hund", "the dog"])).field(0).to_pylist() == ["de", "en"]


def test_texts_in_several_languages_are_sure():
    third = ("le chat et le chien sont dans la maison avec cette chose", "fr")
    texts = [(lang, t) for _, t, lang in LANGS] + [(third[1], third[0])] * 30
    mixed = " ".join(dict.fromkeys(t for _, t in texts))
    _, score, certainty = language_id.predict(language_id.fit(texts), pa.array([mixed, "12 34", None])).flatten()
    assert score[0].as_py() < 0.5 and certainty[0].as_py() > 0.8 and certainty.to_pylist()[1:] == [0.0, 0.0]
    alone = language_id.predict(language_id.fit([("en", "the cat")]), pa.array(["the cat", "12"]))
    assert alone.field(2).to_pylist() == [1.0, 0.0]


def test_columns_named_like_those_put_aside(spark, small):
    rows = [(i, PROSE, "en", "s", 1, "a", "b") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, own_size string, own__size string")
    out = corpus_pipeline.mix_sources(spark, df, small)
    assert out.columns == df.columns and {(r["size"], r.own_size, r.own__size) for r in out.collect()} == {(1, "a", "b")}


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(2)
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    scores = rng.normal(size=(1, 4, 3))
    want = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        s = model.start[path[0]] + sum(scores[0, t, k] for t, k in enumerate(path)) + sum(model.transitions[x, y] for x, y in zip(path, path[1:]))
        for t, k in enumerate(path):
            want[t, k] += np.exp(s)
    want /= want.sum(axis=1, keepdims=True)
    padded = np.concatenate([scores, np.full((1, 2, 3), -np.inf)], axis=1)
    assert np.allclose(language_id.forward_backward(padded, model)[0][0, :4], want)
    assert np.allclose(language_id._marginals(padded, model)[0, :4], want)


def test_pii(messy, empty):
    rows = pii.find(messy).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 8
    assert [s.kind for s in got[6].base] == ["email", "ip"] and got[6]["_words"] == "w"
    assert got[2].base == [] and got[3].base == [] and got[5].base == []
    assert pii.find(empty).count() == 0


def test_pii_long_runs(spark):
    texts = ["1" * 50_000, "a" * 50_000, "1 " * 20_000, "+1" + "(" * 20_000, "x@y.de " * 5_000, "é 1.2.3.4.5 999.1.1.1 a@b@c.de"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(df).collect()}
    assert [len(got[i]) for i in range(5)] == [0, 0, 0, 0, 5_000]
    assert got[4][-1] == ("email", 34_993, 34_999)
    assert got[5] == [("ip", 2, 9), ("email", 24, 30)]


def test_pii_discovers_by_context(spark):
    rows = [(i, f"please call me +1 555 000 {1000 + i} today") for i in range(8)]
    rows += [(100, "so please call me 555-0199-77 now"), (101, "the number 555-0199-77 again"), (102, "order item 77-88-99-11 here")]
    rows += [(103, "so please call me 555-0199-77 now")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == got[103] == [("phone", 18, 29)] and got[101] == [("phone", 11, 22)] and got[102] == []


def test_top_k(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.5]), (20, [0.5, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [2.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(r) for r in topk.top_k(df.where("vec_id % 20 = 0"), df, k=3).collect())
    assert got == [
        (0, 1, 6, 8192), (0, 2, 1, 6144), (0, 3, 2, 6144), (20, 1, 1, 6144), (20, 2, 2, 6144), (20, 3, 2, 6144),
    ]
    assert topk.top_k(df.where("vec_id = 20"), df, k=50).count() == 6
    assert topk.top_k(df.where("false"), df).count() == 0 and topk.top_k(df.where("vec_id = 0"), df.where("false")).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    data = np.round(rng.normal(size=(600, 7)) * 2, 1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    ints = np.floor(data * 64).astype(int)
    got = topk.top_k(df.where("vec_id % 20 = 0"), df.repartition(5), k=7).collect()
    for q in range(0, 600, 20):
        score = ints @ ints[q]
        best = sorted((i for i in range(600) if i != q), key=lambda i: (-score[i], i))[:7]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(i, score[i]) for i in best]


def test_top_k_large_numbers(spark):
    rows = [(0, [2.0**25, 1.0]), (1, [2.0**25, 3.0]), (2, [2.0**25, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df.where("vec_id = 0"), df, k=2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**62 + 3 * 4096), (2, 2**62 + 2 * 4096)]


def test_top_k_completes_collected_scores_only(spark, small):
    """The thresholds decide: below all pairs are completed, and what is left out is below the cutoff."""
    data = np.array([r[0] for r in topk.usable(spark.read.parquet(f"{small}/embeddings.parquet")).select("_v").collect()])
    data = np.floor(data * topk.SCALE)
    total = data @ data.T
    cutoff = np.sort(total, axis=1)[:, -topk.K].astype(np.int64)
    lists = topk._lists(data, data, topk.PARTS)
    row, at = topk.collected(lists, cutoff)
    assert (topk.completed(lists, row, at) == total[row, at]).all() and 0 < len(row) < 0.5 * total.size
    left = np.ones(total.shape, dtype=bool)
    left[row, at] = False
    assert (total < cutoff[:, None])[left].all()
    row, at = topk.heads(lists, topk.K)
    assert len(row) <= topk.PARTS * topk.K * len(data) and len(set(zip(row, at, strict=True))) == len(row)


def test_top_k_in_many_cells(spark, monkeypatch):
    """Small cells, negative scores, ties, repeated rows and repeated queries, against brute force."""
    monkeypatch.setattr(cells, "ASKED", 7)
    monkeypatch.setattr(cells, "HELD", 40)
    monkeypatch.setattr(cells, "FEWEST", 16)
    rng = np.random.default_rng(9)
    data = np.vstack([-np.abs(rng.integers(-3, 4, size=(120, 5))) / 2, rng.integers(-3, 4, size=(80, 5)) / 2])
    ids = [*range(200), *range(0, 200, 8)]
    df = spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in ids], "vec_id long, embedding array<float>")
    got = topk.top_k(df.where("vec_id % 10 = 0"), df, k=6, parts=3).collect()
    ints = np.floor(data * 64).astype(int)
    for q in range(0, 200, 10):
        best = sorted((-int(ints[i] @ ints[q]), i) for i in ids if i != q)[:6]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == best


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_take_messy_tables(spark, small, messy, empty, stage):
    name, run = corpus_pipeline.STAGES[stage]
    for df in (messy, empty):
        out = run(spark, df, small)
        rows = out.collect()
        if name != "sharding":
            assert out.columns == df.columns
        assert all(r["_words"] == "w" and r["size"] == "z" and r["score"] == "c" for r in rows)
        assert bool(rows) == (df is messy)
