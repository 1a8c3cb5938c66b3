"""License scans by a positional index of rare words.

Every template is a run of words. How rare each licence word is comes from all
scanned files; the rarest words of a template are its postings. A file's words
that have postings tell (template, start); a start that all postings of the template
tell is a proposal, and the others meet no further test. It is kept if all words of
the template's mandatory key phrase stand at their relative positions and enough
of its words, weighed by rarity, agree there.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.once import select_once
from ledgerloom.llm.common import ascii_lower, keeps_names, table
from ledgerloom.llm.registry import query

#: Words: digits, letters a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # words that must stand in the file, a run of words of ``text``
    base: bool = False

    @cached_property
    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())

    @cached_property
    def key_span(self) -> range:
        words, key = self.words, re.findall(WORD, self.key.lower())
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return range(at, at + len(key))


# Whole texts of public licences, without their copyright lines.
_MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.
"""
_BSD_CLAUSES = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC = """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
3. This notice may not be removed or altered from any source distribution.
"""
# Phrases and texts of public licences and the labels they stand for.
TEMPLATES = (
    Template("mit", "mit license", "mit license", base=True),
    Template("apache", "apache license", "apache license", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("gpl-3.0", "gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-4.0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    Template("mit-full", _MIT, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd-2-clause", _BSD_CLAUSES + _BSD_DISCLAIMER, "redistributions of source code must retain the above copyright notice"),
    Template("bsd-3-clause", _BSD_CLAUSES + _BSD_THIRD + _BSD_DISCLAIMER, "contributors may be used to endorse or promote products derived from this software"),
    Template("isc-full", _ISC, "for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    Template("zlib", _ZLIB, "the origin of this software must not be misrepresented"),
)
#: Postings of a template: the so many rarest words of its key phrase, all of which stand wherever it is found.
POSTINGS = 3
#: Least share of a template's words, weighed by rarity, that must agree.
AGREEMENT = 0.6


def words_of(text: Column) -> Column:
    # Splitting takes a tenth of the time that extracting all matches does.
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def rarity(files: DataFrame, text: str = "text") -> dict[str, float]:
    """Inverse document frequency, over all files, of every word of the templates.

    At most one row for each of these words reaches the driver.
    """
    vocabulary = sorted({w for t in TEMPLATES for w in t.words})
    own = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, vocabulary)))
    counts = files.select(F.explode(F.array_append(own, F.lit(""))).alias("word")).groupBy("word").count()
    seen = {r.word: r["count"] for r in counts.collect()}
    n = seen.pop("", 0)  # the empty word stands once in every file
    return {w: math.log((n + 1) / (seen.get(w, 0) + 1)) + 1.0 for w in vocabulary}


def rarest(t: Template, idf: dict[str, float]) -> list[str]:
    return sorted({t.words[p] for p in t.key_span}, key=lambda w: (-idf[w], w))[:POSTINGS]


def _struct(fields: dict[str, object]) -> str:
    text = lambda v: "'" + v + "'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)
    return "named_struct(" + ", ".join(f"'{k}', {text(v)}" for k, v in fields.items()) + ")"


@keeps_names
def scan(files: DataFrame, text: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """``files`` with n_words, n_base, first_word, last_word, base_labels, labels and score added.

    Null and empty texts have no words: counts 0, no first and last word, empty
    labels, score 0. ``score`` is the largest agreement of an accepted template (1:
    all its words stand there). Repeated phrases are all counted. Columns of these
    names are replaced. All work on a file stays in its row; nothing is shuffled.
    """
    idf = rarity(files, text) if idf is None else idf
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    keep = [f"`{c}`" for c in files.columns if c.lower() not in added]

    postings: dict[str, list[tuple[int, int]]] = {}
    for k, t in enumerate(TEMPLATES):
        for w in rarest(t, idf):
            postings.setdefault(w, []).extend((k, p) for p in t.key_span if t.words[p] == w)
    index = F.expr(
        "map(" + ", ".join(f"'{w}', array({', '.join(_struct({'k': k, 'p': p}) for k, p in places)})" for w, places in postings.items()) + ")"
    )
    of_words = F.expr(
        "array(" + ", ".join(
            "array(" + ", ".join(
                _struct({"p": p, "w": w, "i": idf[w] / total, "must": int(p in t.key_span)}) for p, w in enumerate(t.words)
            ) + ")" for t in TEMPLATES for total in [sum(idf[x] for x in t.words)]
        ) + ")"
    )
    label = F.array(*[F.lit(t.label) for t in TEMPLATES])
    is_base = F.array(*[F.lit(t.base) for t in TEMPLATES])

    words = select_once(files.select(*keep), keep, [words_of(F.col(text)).alias("_words")])
    # Positions of words with postings, then what they tell as start * templates + template.
    n = len(TEMPLATES)
    size = F.size("_words")
    places = F.when(size > 0, F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("_words", i).isin(*postings))).otherwise(
        F.array().cast("array<int>")
    )
    hits = select_once(words, [*keep, "_words"], [places.alias("_places")])
    told = F.flatten(
        F.transform(
            "_places",
            lambda i: F.transform(F.element_at(index, F.get("_words", i)), lambda x: ((i - x["p"]) * n + x["k"]).cast("long")),
        )
    )
    hits = select_once(hits, [*keep, "_words"], [F.sort_array(told).alias("_told")])
    # A posting tells a start once; where all postings of a template do, the sorted starts stand so many times in a row.
    needed = F.array(*[F.lit(sum(t.words[p] in rarest(t, idf) for p in t.key_span)) for t in TEMPLATES])
    proposed = F.filter("_told", lambda c, i: F.get("_told", i + F.get(needed, F.pmod(c, F.lit(n)).cast("int")) - 1) == c)
    stands = lambda at, x: F.coalesce(F.get("_words", at + x["p"]) == x["w"], F.lit(False))

    def judged(c: Column) -> Column:
        k, at = F.pmod(c, F.lit(n)).cast("int"), F.floor(c / n).cast("int")
        own = F.get(of_words, k)
        key = F.forall(own, lambda x: (x["must"] == 0) | stands(at, x))
        agreement = F.aggregate(own, F.lit(0.0), lambda a, x: a + F.when(stands(at, x), x["i"]).otherwise(0.0))
        return F.struct(k.alias("k"), at.alias("at"), F.when(key, agreement).otherwise(0.0).alias("share"))

    kept = F.filter(F.transform(proposed, judged), lambda x: x["share"] >= AGREEMENT)
    found = select_once(hits, [*keep, F.size("_words").cast("long").alias("n_words")], [kept.alias("_found")])
    base = F.filter("_found", lambda x: F.get(is_base, x["k"]))
    starts = F.transform(base, lambda x: x["at"].cast("long"))
    names = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: F.get(label, x["k"])))), ",")
    return found.select(
        *keep, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("_found")).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("_found", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    rows = ", ".join(
        f"({k}, '{t.label}', {t.base}, {p}, '{w}', {p in t.key_span})" for k, t in enumerate(TEMPLATES) for p, w in enumerate(t.words)
    )
    return rf"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
    w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
    t (k, label, base, p, word, must) AS (VALUES {rows}),
    idf AS (
        SELECT v.word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(d.df, 0) + 1)) + 1 AS idf
        FROM (SELECT DISTINCT word FROM t) AS v
        LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS df FROM w GROUP BY word) AS d ON v.word = d.word),
    rare AS (
        SELECT k, word FROM (
            SELECT k, u.word, row_number() OVER (PARTITION BY k ORDER BY idf DESC, u.word) AS r
            FROM (SELECT DISTINCT k, word FROM t WHERE must) AS u JOIN idf ON idf.word = u.word) AS x WHERE r <= {POSTINGS}),
    weight AS (SELECT t.*, idf / sum(idf) OVER (PARTITION BY k) AS i FROM t JOIN idf ON idf.word = t.word),
    proposed AS (
        SELECT DISTINCT w.doc_id, t.k, w.pos - t.p AS st
        FROM w JOIN t ON t.must AND t.word = w.word JOIN rare ON rare.k = t.k AND rare.word = t.word),
    judged AS (
        SELECT p.doc_id, p.k, p.st, any_value(x.label) AS label, any_value(x.base) AS base,
               sum(CASE WHEN w.pos IS NULL THEN 0 ELSE x.i END) AS share, bool_and(w.pos IS NOT NULL OR NOT x.must) AS fine
        FROM proposed AS p JOIN weight AS x ON x.k = p.k
        LEFT JOIN w ON w.doc_id = p.doc_id AND w.pos = p.st + x.p AND w.word = x.word
        GROUP BY p.doc_id, p.k, p.st),
    found AS (
        SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(st) FILTER (WHERE base) AS first_word, max(st) FILTER (WHERE base) AS last_word,
               coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ','), '') AS base_labels,
               array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, least(1.0, max(share)) AS score
        FROM judged WHERE fine AND share >= {AGREEMENT} GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
           CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
           coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
    FROM docs AS d LEFT JOIN found AS f ON f.doc_id = d.doc_id"""


@query(_oracle())
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License labels and places of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return scan(docs).drop("text")
