"""Language of texts by a linear-chain conditional random field over their words.

A word's features are its affixes and character n-grams (as UTF-8 bytes, hashed into
one weight table) and its entry in a lexicon counted from the labelled sample; learned
transitions say how likely the language stays or changes from word to word. The field
labels every word by forward-backward, so code-switched texts get a label for each
word; a text's language is the one with the largest mean probability of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import keeps_names, table
from ledgerloom.llm.hashing import PIECE, word_spans
from ledgerloom.llm.registry import query

#: The field is fitted on at most so many labelled texts, the same number for each
#: language; of a longer text so many characters are learned from.
SAMPLE = 800
SAMPLE_CHARS = 20_000
#: Words labelled at once. In a longer text each run is labelled within the chain of this
#: run and so many words on either side, whose own labels come from their own runs: what
#: stands farther off no longer moves a marginal.
RUN = 256
MARGIN = 32
BUCKETS = 1 << 16
#: Times a word must stand in the sample to be in the lexicon.
LEXICON_COUNT = 3
STEPS = 40
RATE = 0.1
DECAY = 1e-3
UNKNOWN = "und"
#: Columns that a prediction adds.
FOUND = ("lang_pred", "score", "certainty")

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ORDERS = (2, 3, 4)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # of each feature bucket and language
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # word numbers, sorted
    entries: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trust: np.ndarray = field(default_factory=lambda: np.ones(1))  # weight of the lexicon


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets of rows in them, first row) of lower-cased texts; null counts as empty.

    A text longer than a piece comes in several, cut at white space where there is some.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1, first + 1)
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= PIECE:
            yield data[begin:end], offsets[first : last + 1] - begin, first
        else:
            while begin < end:
                stop = min(begin + PIECE, end)
                if stop < end:
                    spaces = np.flatnonzero(data[begin:stop] == 32)
                    stop = begin + int(spaces[-1]) + 1 if len(spaces) else stop
                yield data[begin:stop], np.array([0, stop - begin]), first
                begin = stop
        first = last


def features(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of the words at the given places, and of each the word it belongs to."""
    length = stops - starts + 2  # with a mark before and after
    first = np.cumsum(length) - length
    word = np.repeat(np.arange(len(starts)), length)
    inner = np.arange(int(length.sum())) - np.repeat(first, length)
    edge = (inner == 0) | (inner == np.repeat(length, length) - 1)
    marked = np.where(edge, 32, data[np.minimum(np.repeat(starts, length) + np.maximum(inner - 1, 0), len(data) - 1)]).astype(np.uint32)
    buckets, owners = [], []
    for n in _ORDERS:
        left = np.repeat(length, length) - inner
        at = np.flatnonzero(left >= n)
        gram = np.zeros(len(at), dtype=np.uint32)
        for k in range(n):
            gram = gram * np.uint32(257) + marked[at + k]
        gram = (gram ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        buckets.append(((gram ^ (gram >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        owners.append(word[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _summed(values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owners, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def _lexicon(model: Model, numbers: np.ndarray) -> np.ndarray:
    if not len(model.lexicon):
        return np.zeros((len(numbers), len(model.languages)))
    at = np.minimum(np.searchsorted(model.lexicon, numbers), len(model.lexicon) - 1)
    return np.where((model.lexicon[at] == numbers)[:, None], model.entries[at], 0.0)


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Score of every language for every word."""
    bucket, owner = features(data, starts, stops)
    return _summed(model.weights[bucket], owner, len(starts)) + model.trust * _lexicon(model, numbers)


def forward_backward(scores: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word and summed marginals of every pair of neighbours.

    ``scores`` has chains, places and languages; a place of all -inf is beyond a
    chain's end.
    """
    chains, places, n = scores.shape
    there = np.isfinite(scores[:, :, 0])
    shine = np.where(there[:, :, None], np.exp(scores - np.max(scores, axis=2, keepdims=True, where=there[:, :, None], initial=-1e300)), 1.0)
    move = np.exp(model.transitions - model.transitions.max())
    ahead = np.empty_like(shine)
    state = np.exp(model.start - model.start.max()) * shine[:, 0]
    ahead[:, 0] = state / state.sum(axis=1, keepdims=True)
    for t in range(1, places):
        state = (ahead[:, t - 1] @ move) * shine[:, t]
        ahead[:, t] = state / state.sum(axis=1, keepdims=True)
    back = np.ones((chains, n))
    marginal = np.zeros_like(shine)
    pairs = np.zeros((n, n))
    for t in range(places - 1, -1, -1):
        both = ahead[:, t] * back
        marginal[:, t] = both / both.sum(axis=1, keepdims=True)
        if t:
            lit = shine[:, t] * back
            joint = ahead[:, t - 1, :, None] * move * lit[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[there[:, t]].sum(axis=0)
            step = lit @ move.T
            back = np.where(there[:, t, None], step / step.sum(axis=1, keepdims=True), 1.0)
    marginal[~there] = 0
    return marginal, pairs


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit the field on (language, text) rows.

    A text's words carry its language. Runs of words of different texts are chained,
    so that the transitions see changes of language.
    """
    languages = sorted({lang for lang, _ in rows})
    n = len(languages)
    model = Model(languages, np.zeros((BUCKETS, n)), np.zeros((n, n)), np.zeros(n))
    texts = pa.array([t for _, t in rows], pa.large_string())
    label_of = np.array([languages.index(lang) for lang, _ in rows])
    buffers, starts, stops, numbers, docs = [], [], [], [], []
    at = 0
    for data, cuts, first in pieces(texts):
        a, b, h = word_spans(data, cuts, _GAP)
        starts.append(a + at), stops.append(b + at), numbers.append(h)
        docs.append(np.searchsorted(cuts, a, side="right") - 1 + first)
        buffers.append(data)
        at += len(data)
    if not at or not sum(map(len, starts)):
        return model
    data, starts, stops, numbers, docs = map(np.concatenate, (buffers, starts, stops, numbers, docs))
    label = label_of[docs]
    _, one, word = np.unique(numbers, return_index=True, return_inverse=True)
    vocabulary = len(one)

    counts = np.stack([np.bincount(word[label == k], minlength=vocabulary) for k in range(n)], axis=1)
    often = counts.sum(axis=1) >= LEXICON_COUNT
    shares = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * n))
    model.lexicon = numbers[one[often]]
    model.entries = np.clip(shares - shares.mean(axis=1, keepdims=True), -2, 2)[often]
    model.trust = np.array([0.1])

    # Chains: runs of 4 to 40 words of one text, most followed by a run of the same language.
    rng = np.random.default_rng(seed)
    cut = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (rng.random(len(docs) - 1) < 0.05)))
    ends = np.append(cut[1:], len(docs))
    order = rng.permutation(len(cut))
    stay = rng.random(len(cut)) < 0.7
    order = np.concatenate([order[stay[order]][np.argsort(label[cut[order[stay[order]]]], kind="stable")], order[~stay[order]]])
    line = np.concatenate([np.arange(cut[i], ends[i]) for i in order])
    chains = -(-len(line) // RUN)
    grid = np.full(chains * RUN, -1)
    grid[: len(line)] = line
    grid = grid.reshape(chains, RUN)
    real = grid >= 0
    words, gold = word[grid], label[grid]

    bucket, owner = features(data, starts[one], stops[one])
    lex = _lexicon(model, numbers[one])
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.weights, model.transitions, model.start, model.trust)]
    truth = np.zeros((*grid.shape, n))
    np.put_along_axis(truth, gold[:, :, None], 1.0, axis=2)
    truth[~real] = 0
    seen = np.zeros((n, n))
    follow = real[:, 1:]
    np.add.at(seen, (gold[:, :-1][follow], gold[:, 1:][follow]), 1)
    for step in range(1, STEPS + 1):
        scores = _summed(model.weights[bucket], owner, vocabulary) + model.trust * lex
        marginal, pairs = forward_backward(np.where(real[:, :, None], scores[words], -np.inf), model)
        miss = truth - marginal
        of_word = _summed(miss[real], words[real], vocabulary)
        gradient = [
            _summed(of_word[owner], bucket, BUCKETS), seen - pairs, miss[:, 0].sum(axis=0), np.array([(of_word * lex).sum()])
        ]
        for x, g, m in zip((model.weights, model.transitions, model.start, model.trust), gradient, moments, strict=True):
            g = g / len(line) - DECAY / len(line) * x
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.999 * m[1] + 0.001 * g * g
            x += RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    model.weights = model.weights.astype(np.float32)
    return model


def label_words(model: Model, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and marginals of every word."""
    starts, stops, numbers = word_spans(data, cuts, _GAP)
    row = np.searchsorted(cuts, starts, side="right") - 1
    if not len(starts):
        return starts, stops, row, np.zeros((0, len(model.languages)))
    distinct, one, word = np.unique(numbers, return_index=True, return_inverse=True)
    scores = emissions(model, data, starts[one], stops[one], distinct)
    first, end = np.searchsorted(row, row), np.searchsorted(row, row, side="right")
    new = np.flatnonzero((np.arange(len(row)) - first) % RUN == 0)
    stop = np.append(new[1:], len(row))
    begin, size = np.maximum(first[new], new - MARGIN), np.minimum(end[new], stop + MARGIN)
    size -= begin
    out = np.empty((len(row), len(model.languages)))
    order = np.argsort(size, kind="stable")
    for group in np.array_split(order, max(1, len(order) // 256)):  # chains of about the same size
        longest = int(size[group].max(initial=0))
        places = begin[group, None] + np.arange(longest)
        real = np.arange(longest) < size[group, None]
        chain = np.where(real[:, :, None], scores[word[np.minimum(places, len(row) - 1)]], -np.inf)
        own = (places >= new[group, None]) & (places < stop[group, None])
        out[places[own]] = _marginals(chain, model)[own]
    return starts, stops, row, out


def _marginals(scores: np.ndarray, model: Model) -> np.ndarray:
    """As ``forward_backward``, without the pairs."""
    chains, places, n = scores.shape
    scores = np.ascontiguousarray(scores.transpose(1, 0, 2))
    there = np.isfinite(scores[:, :, :1])
    top = scores.max(axis=2, keepdims=True)
    shine = np.where(there, np.exp(scores - np.where(there, top, 0.0)), 1.0)
    move = np.exp(model.transitions - model.transitions.max())
    ahead = np.empty_like(shine)
    state = np.exp(model.start - model.start.max()) * shine[0]
    ahead[0] = state / state.sum(axis=1, keepdims=True)
    for t in range(1, places):
        state = (ahead[t - 1] @ move) * shine[t]
        state /= state.sum(axis=1, keepdims=True)
        ahead[t] = state
    back = np.ones((chains, n))
    for t in range(places - 1, 0, -1):
        ahead[t] *= back
        step = (shine[t] * back) @ move.T
        step /= step.sum(axis=1, keepdims=True)
        back = np.where(there[t], step, 1.0)
    ahead[0] *= back
    ahead /= ahead.sum(axis=2, keepdims=True)
    return ahead.transpose(1, 0, 2)


def predict(model: Model, texts: pa.Array) -> pa.Array:
    """(lang_pred, score, certainty) of each text.

    ``score`` is the mean probability of the text's language, ``certainty`` how far the mean
    probability of each word's own best language is above a guess (0) towards sure (1).
    """
    n = len(model.languages)
    sure = np.zeros(len(texts))
    total, count = np.zeros((len(texts), n)), np.zeros(len(texts))
    plain = np.zeros(len(texts), dtype=bool)  # has an ASCII letter
    for data, cuts, first in pieces(texts) if n else ():
        starts, stops, row, marginal = label_words(model, data, cuts)
        if len(row):
            rows = len(cuts) - 1
            total[first : first + rows] += _summed(marginal, row, rows)
            count[first : first + rows] += np.bincount(row, minlength=rows)
            sure[first : first + rows] += np.bincount(row, marginal.max(axis=1), minlength=rows)
            ascii_letters = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
            plain[first : first + rows] |= ascii_letters[cuts[1:]] > ascii_letters[cuts[:-1]]
    names, scores, certain = [], [], []
    for i in range(len(texts)):
        lettered = count[i] > 0 and n > 0 and (plain[i] or any(map(str.isalpha, texts[i].as_py())))
        best = int(np.argmax(total[i])) if lettered else -1
        names.append(model.languages[best] if lettered else UNKNOWN)
        scores.append(float(min(1.0, total[i, best] / count[i])) if lettered else 0.0)
        above = (sure[i] / count[i] - 1 / n) / (1 - 1 / n) if lettered and n > 1 else float(lettered)
        certain.append(float(min(1.0, max(0.0, above))))
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(certain, pa.float64())], names=list(FOUND))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from the fit; without id it is not, and is not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled texts that are not held out, at most ``sample`` of them.

    For each language the texts of smallest digest are taken; equal texts count once, and
    of a text longer than SAMPLE_CHARS its first so many characters.
    """
    learned = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    ).withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    keyed = learned.select("lang", F.xxhash64("text").alias("digest"), "text")
    # The digests of each language are thinned to the share that gives the wanted number.
    sizes = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.approx_count_distinct("digest", 0.02).alias("n")).collect()}
    each = max(1, sample // max(1, len(sizes)))
    limits = [(lang, min(1.0, each / n)) for lang, n in sizes.items()]
    if not limits:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    share = F.create_map(*[F.lit(x) for pair in limits for x in pair])[F.col("lang")]
    place = F.pmod(F.col("digest"), F.lit(1_000_003)) / 1_000_003.0
    rows = keyed.where(place <= share).groupBy("lang", "digest").agg(F.min("text").alias("text"))
    found = sorted((r.lang, r.digest, r.text) for r in rows.collect())
    return fit([(lang, text) for lang, _, text in found])


@keeps_names
def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and certainty added (replacing such columns).

    ``und`` with score 0 for null and empty texts and those without a letter, and for
    all texts if the model knows no language. Equal texts have equal results.
    """
    kind = T.StructType([T.StructField(c, T.StringType() if c == "lang_pred" else T.DoubleType()) for c in FOUND])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield predict(model, batch)

    keep = [f"`{c}`" for c in docs.columns if c.lower() not in FOUND]
    return docs.select(*keep, run(F.col(text)).alias("_found")).select(*keep, "_found.*")


@query()
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, folder, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
