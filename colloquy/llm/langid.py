"""Language of every word in a text, by a linear-chain conditional random field.

Words are runs of letters and marks. A word's emission scores are sums of learned weights of
its features: letter pairs and triples with word edges, affixes of three letters, and the word
itself where it is in the lexicon of frequent training words. Learned transition weights tie
neighbouring words together, so a span in another language is labelled as such while a lone odd
word is not. Forward-backward gives each word's label probabilities; a document's language is
the label with the largest mean over its words, which is also the score.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import hashed_span, small

FEATURES = 1 << 17
#: Most training documents of one language, most characters of one, and most documents in all: what the driver may hold.
SAMPLE_DOCS = 250
SAMPLE_CHARS = 12_000
SAMPLE_TOTAL = 2_000
#: Languages that are learned, those of most documents.
MOST_LANGS = 1_000
#: Values of the hash that chooses them.
HASHES = 1 << 40
#: Languages that have FEATURES slots each and texts in full slices; more languages share fewer slots and have smaller slices.
FULL_LANGS = 64
#: Numbers in the transfer matrices that are multiplied at once.
TRANSFERS = 1 << 22
LEXICON = 20_000
SEGMENT = 32
#: Characters that are scored at a time.
SLICE_CHARS = 250_000
UNKNOWN = "und"
SPACE = re.compile(r"\s")

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@cache
def letter_classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, and its lower-case form; zero outside words."""
    low = np.zeros(sys.maxunicode + 2, np.uint32)
    letter = np.zeros(sys.maxunicode + 2, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low[i] = ord(c.lower()[0])
        elif i > 127 and unicodedata.category(c)[0] == "M":
            low[i] = i
    return letter, low


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points with gaps between them, and where each text begins."""
    joined = "\n\n\n".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.cumsum([3, *(len(t) + 3 for t in texts)])
    return codes, begins[:-1]


def slices(texts: list[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts that come to ``most`` characters (SLICE_CHARS) at most, or of one longer text."""
    i, most = 0, SLICE_CHARS if most is None else most
    while i < len(texts):
        stop, chars = i + 1, len(texts[i])
        while stop < len(texts) and chars + len(texts[stop]) <= most:
            chars += len(texts[stop])
            stop += 1
        yield i, stop
        i = stop


def cut_at_spaces(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Pieces of a text of ``most`` characters and what is left of the last word, or of ``most`` more."""
    at = 0
    while at < len(text):
        space = SPACE.search(text, at + most, at + 2 * most)
        end = space.start() if space else min(len(text), at + 2 * most)
        yield at, end
        at = end


def spread(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _K[1]
    return (h >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Words:
    """Words of some texts: first letter, place after the last, text, and hashed features by letter."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    local: np.ndarray  # (features, letters): slots of the features that begin at each code point, 0 where there is none
    whole: np.ndarray  # a 64-bit hash of each word


def find_words(texts: list[str]) -> Words:
    letter, low = letter_classes()
    codes, begins = code_points(texts)
    c = low[codes].astype(np.uint64)
    inside = c > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    letters = np.concatenate([[0], np.cumsum(letter[codes])])
    real = letters[end] > letters[start]  # marks alone are no word
    start, end = start[real], end[real]
    n = len(c)
    nxt = [np.concatenate([c[k:], np.zeros(k, np.uint64)]) for k in range(4)]
    inside = np.concatenate([inside, np.zeros(4, bool)])
    pair = nxt[0] * _K[0] + nxt[1] * _K[1]
    triple = pair + nxt[2] * _K[2] + np.uint64(7)
    four = triple + nxt[3] * _K[3] + np.uint64(11)
    bits = FEATURES.bit_length() - 1
    local = np.zeros((3, n), np.int64)
    in2 = inside[:n] | inside[1 : n + 1]
    in3 = inside[1 : n + 1]
    prefix = ~inside[:n] & inside[1 : n + 1] & inside[2 : n + 2] & inside[3 : n + 3]
    suffix = inside[:n] & inside[1 : n + 1] & inside[2 : n + 2] & ~inside[3 : n + 3]
    for row, hashed, valid in ((0, pair, in2), (1, triple, in3), (2, four, prefix | suffix)):
        at = np.flatnonzero(valid)
        local[row, at] = np.maximum(1, spread(hashed[at], bits))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _K[2])]))
    inverse = np.uint64(pow(int(_K[2]), -1, 1 << 64))
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * power[:n])])
    whole = (sums[end] - sums[start]) * back[start]
    return Words(start, end, np.searchsorted(begins, start, side="right") - 1, local, whole)


@dataclass
class LanguageModel:
    """Weights small enough to broadcast: (slots + LEXICON) x languages floats, where slots x languages is bounded."""

    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray  # sorted hashes of frequent words
    words: np.ndarray
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def emissions(self, found: Words) -> np.ndarray:
        if not len(found.start):
            return np.zeros((0, len(self.langs)), np.float32)
        local = self.slots(found.local)
        by_letter = self.weights[local[0]]
        by_letter += self.weights[local[1]]
        by_letter += self.weights[local[2]]
        scores = np.add.reduceat(by_letter, found.start - 1, axis=0)
        return scores + self.words[self.known(found.whole)]

    def slots(self, local: np.ndarray) -> np.ndarray:
        """The features' rows in ``weights``, which may have fewer than FEATURES."""
        if len(self.weights) >= FEATURES:
            return local
        return np.where(local > 0, np.maximum(1, local * len(self.weights) // FEATURES), 0)

    def known(self, whole: np.ndarray) -> np.ndarray:
        """Row in ``words`` of each hash; row 0 stands for any other word."""
        if not len(self.lexicon):
            return np.zeros(len(whole), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, whole), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == whole, at + 1, 0)

    def probabilities(self, scores: np.ndarray, counts: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of each word by forward-backward over each text.

        Texts are cut into segments, whose transfer matrices are multiplied all at once; the
        chain over a text's segments then gives each segment its inflow from both sides. This is
        the exact recursion, with as many steps as a segment has words. ``before`` and ``after``
        are the inflow to all texts, where these are pieces of longer ones.
        """
        size, n = len(self.langs), len(scores)
        if not n:
            return np.zeros((0, size))
        step, padded, there, row, column, first, per_text, product = self.transfers(scores, counts)
        segments = len(product)
        into = np.full((segments, size), 1.0 / size)
        back = np.ones((segments, size))
        if before is not None:
            into[first[:-1]] = before
        if after is not None:
            back[first[1:] - 1] = after
        longest = int(per_text.max())
        by_length = np.argsort(-per_text, kind="stable")
        lengths = -per_text[by_length]
        for k in range(1, longest):
            texts = by_length[: np.searchsorted(lengths, -k, side="left")]  # those with more than k segments
            at = first[texts] + k
            moved = np.einsum("ni,nij->nj", into[at - 1], product[at - 1])
            into[at] = moved / moved.sum(axis=1, keepdims=True)
        for k in range(longest - 1, 0, -1):
            texts = by_length[: np.searchsorted(lengths, -k, side="left")]
            at = first[texts] + k
            moved = np.einsum("nij,nj->ni", product[at], back[at])
            back[at - 1] = moved / moved.sum(axis=1, keepdims=True)
        forward = np.empty_like(padded)
        state = into
        for t in range(SEGMENT):
            moved = (state @ step) * padded[:, t]
            state = np.where(there[:, t, None], moved / moved.sum(axis=1, keepdims=True), state)
            forward[:, t] = state
        state = back
        for t in range(SEGMENT - 1, -1, -1):
            forward[:, t] *= state
            moved = (padded[:, t] * state) @ step.T
            state = np.where(there[:, t, None], moved / moved.sum(axis=1, keepdims=True), state)
        found = forward[row, column]
        return found / found.sum(axis=1, keepdims=True)

    def transfers(self, scores: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """The segments of some texts' words, and each segment's transfer matrix, scaled."""
        size, n = len(self.langs), len(scores)
        step = np.exp(self.transitions - self.transitions.max())
        emit = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64) + 1e-30
        per_text = -(-counts // SEGMENT)
        first = np.concatenate([[0], np.cumsum(per_text)])
        segments = int(first[-1])
        word_first = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        order = np.arange(n) - word_first[owner]
        row, column = first[owner] + order // SEGMENT, order % SEGMENT
        there = np.zeros((segments, SEGMENT), bool)
        there[row, column] = True
        padded = np.ones((segments, SEGMENT, size))
        padded[row, column] = emit
        # Words past a text's end change nothing.
        product = np.broadcast_to(np.eye(size), (segments, size, size)).copy()
        for t in range(SEGMENT):
            at = np.flatnonzero(there[:, t])
            moved = (product[at].reshape(-1, size) @ step).reshape(-1, size, size) * padded[at, t][:, None, :]
            product[at] = moved / moved.max(axis=(1, 2), keepdims=True)
        return step, padded, there, row, column, first, per_text, product

    def predict_long(self, text: str, most: int) -> tuple[str, float]:
        """The language and score of one text, from pieces of about ``most`` characters.

        One pass over the pieces leaves a matrix of each, from which the inflow to each piece from
        both sides follows; a second one works out the probabilities with it. The result is that
        of the whole text. A run of more than ``most`` characters without white space counts as
        several words.
        """
        size, pieces = len(self.langs), list(cut_at_spaces(text, most))
        matrices = []
        for start, stop in pieces:
            scores, whole = self.emissions(find_words([text[start:stop]])), np.eye(size)
            for product in self.transfers(scores, np.array([len(scores)]))[-1] if len(scores) else ():
                whole = whole @ product
                whole /= whole.max()
            matrices.append(whole)
        after, state = [np.ones(size)], np.full(size, 1.0 / size)
        for whole in reversed(matrices[1:]):
            moved = whole @ after[-1]
            after.append(moved / moved.sum())
        sums, words = np.zeros(size), 0
        for (start, stop), whole, back in zip(pieces, matrices, reversed(after), strict=True):
            scores = self.emissions(find_words([text[start:stop]]))
            sums += self.probabilities(scores, np.array([len(scores)]), state, back).sum(axis=0)
            words += len(scores)
            state = state @ whole
            state /= state.sum()
        best = int(sums.argmax())
        return (self.langs[best], min(1.0, float(sums[best] / words))) if words else (UNKNOWN, 0.0)

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts' word counts, their words' label probabilities, and the words' places (text, start, end)."""
        scores, counts, places = [], [np.zeros(0, np.int64)], []
        for i, stop in slices(texts, SLICE_CHARS * FULL_LANGS // max(FULL_LANGS, len(self.langs))):
            found = find_words(texts[i:stop])
            scores.append(self.emissions(found))
            counts.append(np.bincount(found.text, minlength=stop - i))
            offset = np.cumsum([3, *(len(t) + 3 for t in texts[i:stop])])[found.text]
            places.append(np.stack([found.text + i, found.start - offset, found.end - offset], axis=1))
        counts = np.concatenate(counts)
        if not scores or not counts.sum():
            return counts, np.zeros((0, len(self.langs))), np.zeros((0, 3), np.int64)
        scores, words = np.concatenate(scores), np.concatenate([[0], np.cumsum(counts)])
        # Texts of one call are those whose transfer matrices fit, one text at least.
        group = np.cumsum(-(-counts // SEGMENT)) * len(self.langs) ** 2 // TRANSFERS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
        found = [self.probabilities(scores[words[a] : words[b]], counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return counts, np.concatenate(found), np.concatenate(places)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language and score of each text, from as many texts at a time as fit a slice, or a piece of one."""
        langs, scores = [], []
        most = SLICE_CHARS * FULL_LANGS // max(FULL_LANGS, len(self.langs))
        for i, stop in slices(texts, most):
            if len(texts[i]) > most and self.langs:
                lang, score = self.predict_long(texts[i], most)
                langs.append(lang)
                scores.append(score)
                continue
            counts, probabilities, _ = self.label(texts[i:stop])
            sums = np.zeros((stop - i, len(self.langs)))
            has = counts > 0
            if has.any():
                sums[has] = np.add.reduceat(probabilities, (np.cumsum(counts) - counts)[has], axis=0)
            means = sums / np.maximum(counts, 1)[:, None]
            best = means.argmax(axis=1) if len(self.langs) else np.zeros(stop - i, int)
            langs += [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            scores += [min(1.0, float(m[b])) if h else 0.0 for m, b, h in zip(means, best, has, strict=True)]
        return langs, scores


def training_sample(docs: DataFrame, per_lang: int, most_chars: int, id_col: str, text_col: str, lang_col: str, total: int, most_langs: int) -> list[tuple[str, str]]:
    """A bounded sample of every language: spans of the texts of least hash in each.

    The languages' counts say how small a hash has to be to come into question, so that no more
    than a few times the sample is shuffled, whatever the table's size.
    """
    own = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull())
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(min(most_langs, total)).collect()
    if not counts:
        return []
    each = min(per_lang, total // len(counts))
    rules = [(lang, HASHES if n <= 8 * each else -(-HASHES * 4 * each // n)) for lang, n in counts]
    rules = F.broadcast(docs.sparkSession.createDataFrame(rules, "lang string, below long"))
    ranked = Window.partitionBy("lang").orderBy("h", "k", "text")
    placed = own.where(F.col("text").isNotNull()).join(rules, "lang").withColumn("h", F.pmod(F.xxhash64("k", "text"), F.lit(HASHES)))
    cut = placed.where(F.col("h") < F.col("below")).select("lang", hashed_span("text", most_chars, "h").alias("text"), "h", "k")
    rows = cut.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= each)
    return sorted((r.lang, r.text) for r in rows.select("lang", "text").collect())


def fit_languages(docs: DataFrame, per_lang: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", epochs: int = 4, seed: int = 7, total: int = SAMPLE_TOTAL, most_langs: int = MOST_LANGS) -> LanguageModel:
    """Learn the ``most_langs`` languages of most documents, from at most ``per_lang`` of each and ``total`` in all.

    Texts of all lengths come in alike; of one with more than ``most_chars`` characters a span of
    so many is learned from, which begins anywhere, by hash. Documents of rarer languages teach
    nothing, and are predicted as one of the others.

    Spans of documents in different languages are spliced into training sequences, so that
    changes of language are seen. Rows without text or language teach nothing; without any
    usable row the model knows no language and every text is undetermined.
    """
    return train(training_sample(docs, per_lang, most_chars, id_col, text_col, lang_col, total, most_langs), epochs, seed)


def train(sample: list[tuple[str, str]], epochs: int, seed: int) -> LanguageModel:
    langs = sorted({lang for lang, _ in sample})
    size = len(langs)
    features = FEATURES
    while features * size > FEATURES * FULL_LANGS and features > FEATURES >> 7:
        features //= 2
    model = LanguageModel(langs, np.zeros((features, size), np.float32), np.zeros(0, np.uint64), np.zeros((1, size), np.float32), np.zeros((size, size)))
    if not size:
        return model
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(langs)}
    # Words of all texts, a slice at a time; of their features only the slots are kept, in order of the words.
    owner, whole, many, slot = [], [], [], []
    for first, upto in slices([text for _, text in sample]):
        found = find_words([text for _, text in sample[first:upto]])
        span = found.end - found.start + 1
        word = np.repeat(np.arange(len(span)), span)
        spot = np.repeat(found.start - 1, span) + np.arange(len(word)) - np.repeat(np.cumsum(span) - span, span)
        slots = model.slots(found.local)[:, spot]
        used = slots > 0
        owner.append(found.text + first)
        whole.append(found.whole)
        many.append(np.bincount(np.repeat(word[None], 3, axis=0)[used], minlength=len(span)))
        slot.append(slots.T[used.T].astype(np.int32))
    owner, whole, many, slot = (np.concatenate(x) for x in (owner, whole, many, slot))
    if not len(owner):
        return model
    truth = np.array([number[lang] for lang, _ in sample])[owner]
    hashes, often = np.unique(whole, return_counts=True)
    if len(hashes) > LEXICON:
        hashes = np.sort(hashes[np.argsort(-often, kind="stable")[:LEXICON]])
    model.lexicon = hashes
    model.words = np.zeros((len(hashes) + 1, size), np.float32)
    lexical = model.known(whole)
    at = np.concatenate([[0], np.cumsum(many)])
    # Training sequences: spans of 4 to 64 words, in random order, cut to equal length.
    cuts, i = [], 0
    while i < len(owner):
        upto = min(int(np.searchsorted(owner, owner[i], side="right")), i + int(rng.integers(4, 65)))
        cuts.append((i, upto))
        i = upto
    rng.shuffle(cuts)
    order = np.concatenate([np.arange(a, b) for a, b in cuts])
    length = 64
    order = np.resize(order, -(-len(order) // length) * length).reshape(-1, length)
    grad_w, grad_t, grad_l = np.full(model.weights.shape, 1e-3), np.full((size, size), 1.0), np.full(model.words.shape, 1e-3)
    for epoch in range(epochs):
        rate = 0.4 / (1 + epoch)
        for rows in np.array_split(rng.permutation(len(order)), max(1, len(order) // 128)):
            words = order[rows].ravel()
            counts = at[words + 1] - at[words]
            spots = np.repeat(at[words] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            slots, of = slot[spots], np.repeat(np.arange(len(words)), counts)
            scores = np.stack([np.bincount(of, model.weights[slots, k], len(words)) for k in range(size)], axis=1) + model.words[lexical[words]]
            posterior, expected, seen = sequence_gradient(scores.reshape(-1, length, size), model.transitions, truth[words].reshape(-1, length))
            error = posterior.reshape(-1, size)
            error[np.arange(len(words)), truth[words]] -= 1
            for k in range(size):
                g = np.bincount(slots, error[of, k], features) / len(rows) + 1e-5 * model.weights[:, k]
                grad_w[:, k] += g * g
                model.weights[:, k] -= rate * g / np.sqrt(grad_w[:, k])
                g = np.bincount(lexical[words], error[:, k], len(model.words)) / len(rows) + 1e-5 * model.words[:, k]
                g[0] = 0
                grad_l[:, k] += g * g
                model.words[:, k] -= rate * g / np.sqrt(grad_l[:, k])
            g = (expected - seen) / len(rows)
            grad_t += g * g
            model.transitions -= rate * g / np.sqrt(grad_t)
    model.weights[0] = 0
    return model


def sequence_gradient(scores: np.ndarray, transitions: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities, expected transition counts and true transition counts of equally long sequences."""
    n, length, size = scores.shape
    step = np.exp(transitions - transitions.max())
    emit = np.exp(scores - scores.max(axis=2, keepdims=True)) + 1e-30
    forward, back = np.empty_like(emit), np.ones_like(emit)
    state = np.full((n, size), 1.0 / size)
    for t in range(length):
        state = (state @ step) * emit[:, t]
        state /= state.sum(axis=1, keepdims=True)
        forward[:, t] = state
    expected = np.zeros((size, size))
    state = np.ones((n, size))
    for t in range(length - 1, 0, -1):
        right = emit[:, t] * state
        joint = forward[:, t - 1][:, :, None] * step * right[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        state = right @ step.T
        state /= state.sum(axis=1, keepdims=True)
        back[:, t - 1] = state
    posterior = forward * back
    posterior /= posterior.sum(axis=2, keepdims=True)
    seen = np.bincount((truth[:, :-1] * size + truth[:, 1:]).ravel(), minlength=size * size).reshape(size, size)
    return posterior, expected, seen


def label_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Rows (doc_id, lang_pred, score), one for each row of ``docs``; the text is all that is looked at.

    ``spans=True`` adds ``spans``: runs of words of one most likely language, as (lang, start, end)
    in characters. ``und`` with score 0 stands for texts that are null, empty or without a letter,
    and for all texts if the model knows no language. Map-only: repeated rows and null ids need
XX
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                langs, scores = own.predict(texts) if own.langs else ([UNKNOWN] * len(texts), [0.0] * len(texts))
                columns, names = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                if spans:
                    columns.append(pa.array(word_spans(own, texts), pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * spans
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least the score ``least``.

    Null and empty texts, and those without a letter, go. Rows are judged one by one: repeated
    ones share their fate, ids are not looked at, and an empty table gives no rows. A model that
    knows no language can reject nothing: all rows stay.
    """
    if not model.langs:
        return docs
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in small(batches):
            langs, scores = own.predict([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([lang != UNKNOWN and scores[k] >= least for k, lang in enumerate(langs)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def word_spans(model: LanguageModel, texts: list[str]) -> list[list[dict]]:
    found: list[list[dict]] = [[] for _ in texts]
    if model.langs:
        _, probabilities, places = model.label(texts)
        for (text, start, end), k in zip(places.tolist(), probabilities.argmax(axis=1) if len(places) else [], strict=True):
            lang = model.langs[k]
            if found[text] and found[text][-1]["lang"] == lang:
                found[text][-1]["end"] = end
            else:
                found[text].append({"lang": lang, "start": start, "end": end})
    return found
