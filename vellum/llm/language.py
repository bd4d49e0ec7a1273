"""Language identification by a linear-chain conditional random field (operator 6).

Words are the positions of the chain, languages the labels.  A word's emission scores are
sums of weights of its features: hashed byte n-grams of the word between boundary marks
(those at a mark are its affixes) and the word itself if it is in the lexicon of the
training text.  Learned transition scores say how often speakers switch.  Forward-backward
gives each word's label distribution; the mean over the words of a text names its
language, and the parts of the others show code-switching.

Training text is a bounded sample (``PER_LANGUAGE`` documents a language, of each a stretch of
at most ``MAX_CHARS`` characters, ``CHAINS`` chains): chains are put together from stretches of words
of different languages, so that transitions are learned from switches.  Everything else
covers all rows and whole texts: a chain is up to ``CHAIN`` consecutive words, and every
word of a text is in one.

Scale: prediction is one pass without a shuffle; drawing the sample shuffles hashes only.  The model is a table of ``BUCKETS`` rows a language plus at most ``LEXICON``
words, so its broadcast does not grow with the data.

Defined results: a null text or one without a letter is ``und`` with score 0; if nothing
can be learned, so is every text; null languages are not learned; a null id is never held
out and never learned from; repeated rows are predicted each; an empty table has an empty
result; ties go to the language that is first in order; input columns called like a result
give way, any other column may be there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import in_arrow, slices, sole, with_columns
from .staging import sendable, without

#: Bounds of the training sample.
PER_LANGUAGE, MAX_CHARS, CHAINS = 150, 20_000, 4000
#: Size of the model.
BUCKETS, LEXICON, ORDERS = 1 << 16, 20_000, (1, 2, 3, 4, 5)
#: Words in a chain; words whose scores a worker remembers.
CHAIN, WORDS_HELD = 128, 150_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _LETTERS.findall(text.lower()) if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words, one after the other, and where each word's begin."""
    joined = "".join([f"^{w}$" for w in words]).encode()
    b = np.frombuffer(joined, np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w.encode()) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(len(b))  # bytes of the word from here on
    out, owner = [], []
    word = np.repeat(np.arange(len(words)), sizes)
    code = np.zeros(len(b), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint64(257) + b[n - 1 :] + np.uint64(1)
        whole = left[:m] >= n
        if n in ORDERS:
            h = ((code[whole] * np.uint64(8) + np.uint64(n)) * _ODD) >> np.uint64(48)
            out.append(h.astype(np.int64) & (BUCKETS - 1))
            owner.append(word[:m][whole])
    if not out:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    flat, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (chain, position, label) and pair marginals (label, label) summed; longest chain first."""
    n, steps, k = emission.shape
    e = np.exp(emission - emission.max(axis=2, keepdims=True))
    s, m = np.exp(start), np.exp(move)
    alpha = np.zeros_like(e)
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # chains longer than t
    for t in range(steps):
        a = alive[t]
        now = e[:a, t] * (s if t == 0 else alpha[:a, t - 1] @ m)
        alpha[:a, t] = now / now.sum(axis=1, keepdims=True)
    beta = np.ones((n, k), e.dtype)
    gamma, pairs = np.zeros_like(e), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        a = alive[t]
        g = alpha[:a, t] * beta[:a]
        gamma[:a, t] = g / g.sum(axis=1, keepdims=True)
        if t:
            ahead = e[:a, t] * beta[:a]
            back = ahead @ m.T
            joint = (alpha[:a, t - 1] / np.maximum((alpha[:a, t - 1] * back).sum(axis=1, keepdims=True), 1e-30)).T @ ahead * m
            pairs += joint
            beta[:a] = back / back.sum(axis=1, keepdims=True)
    return gamma, pairs


class Model:
    """Weights, and predictions with a bounded memory of words."""

    def __init__(self, languages: list[str], lexicon: dict[str, int]) -> None:
        k = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS + len(lexicon) + 1, k), np.float32)  # the last row stays zero
        self.start, self.move = np.zeros(k), np.zeros((k, k))
        self.forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        """Let go of the words' scores."""
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.languages)), np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Emission scores of distinct words."""
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        flat, bounds = features(words)
        known = np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))
        sums = np.add.reduceat(self.weights[flat], bounds[:-1], axis=0) / np.sqrt(np.diff(bounds))[:, None]
        return sums + self.weights[np.where(known >= 0, BUCKETS + known, len(self.weights) - 1)]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Label distributions of the words of each text."""
        if len(self.rows) > WORDS_HELD:
            self.forget()
        new = list({w for t in texts for w in t} - self.rows.keys())
        if new:
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            parts = [self.word_scores(new[a : a + 8192]) for a in range(0, len(new), 8192)]
            self.scores = np.concatenate([self.scores, *parts])
        ids = np.fromiter((self.rows[w] for t in texts for w in t), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.cumsum([0, *sizes])
        firsts = np.concatenate([np.arange(a, b, CHAIN) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) if len(ids) else np.zeros(0, int)
        ends = offsets[np.searchsorted(offsets, firsts, "right")]
        lengths = np.minimum(CHAIN, ends - firsts)
        out = np.zeros((len(ids), len(self.languages)), np.float32)
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), 2048):
            rows = order[a : a + 2048]
            n = lengths[rows]
            at = firsts[rows][:, None] + np.arange(n[0])
            real = np.arange(n[0]) < n[:, None]
            emission = self.scores[ids[np.where(real, at, 0)]]
            gamma, _ = forward_backward(emission, n, self.start, self.move)
            out[at[real]] = gamma[real]
        return [out[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language)."""
    languages = sorted({lang for _, lang in samples})
    texts = {lang: [w for t, own in samples if own == lang for w in [words_of(t)] if w] for lang in languages}
    languages = [lang for lang in languages if texts[lang]]
    counts = Counter(w for lang in languages for t in texts[lang] for w in t)
    common = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if n >= 3][:LEXICON]
    model = Model(languages, {w: i for i, w in enumerate(common)})
    if not languages:
        return model
    rng = np.random.default_rng(seed)
    chains: list[tuple[list[str], list[int]]] = []
    for _ in range(CHAINS):
        words, labels = [], []
        while len(words) < 24:
            k = int(rng.integers(len(languages)))
            doc = texts[languages[k]][int(rng.integers(len(texts[languages[k]])))]
            a = int(rng.integers(len(doc)))
            part = doc[a : a + int(rng.integers(3, 16))]
            words += part
            labels += [k] * len(part)
        chains.append((words, labels))
    # Adagrad on the conditional log-likelihood, in batches.
    grown = [np.full(x.shape, 1e-3) for x in (model.weights, model.start, model.move)]
    k = len(languages)
    for _ in range(3):
        rng.shuffle(chains)
        for a in range(0, len(chains), 100):
            batch = sorted(chains[a : a + 100], key=lambda c: -len(c[0]))
            lengths = np.array([len(c[0]) for c in batch])
            vocabulary = list({w for c in batch for w in c[0]})
            index = {w: i for i, w in enumerate(vocabulary)}
            scores = model.word_scores(vocabulary)
            ids = np.zeros((len(batch), lengths[0]), np.int64)
            gold = np.zeros((len(batch), lengths[0], k))
            for i, (words, labels) in enumerate(batch):
                ids[i, : len(words)] = [index[w] for w in words]
                gold[i, np.arange(len(labels)), labels] = 1
            real = np.arange(lengths[0]) < lengths[:, None]
            gamma, pairs = forward_backward(scores[ids].astype(np.float64), lengths, model.start, model.move)
            slope = (gold - gamma)[real]
            by_word = np.stack([np.bincount(ids[real], slope[:, j], len(vocabulary)) for j in range(k)], axis=1)
            flat, bounds = features(vocabulary)
            spread = np.repeat(by_word / np.sqrt(np.diff(bounds))[:, None], np.diff(bounds), axis=0)
            change = np.zeros(model.weights.shape)
            for j in range(k):
                change[:BUCKETS, j] = np.bincount(flat, spread[:, j], BUCKETS)
            known = np.array([model.lexicon.get(w, -1) for w in vocabulary])
            change[BUCKETS + known[known >= 0]] += by_word[known >= 0]
            moved = np.zeros((k, k))
            for _, labels in batch:
                np.add.at(moved, (labels[:-1], labels[1:]), 1)
            steps = (change - 1e-4 * model.weights, gold[:, 0].sum(axis=0) - gamma[:, 0].sum(axis=0), moved - pairs)
            for target, total, step, rate in zip((model.weights, model.start, model.move), grown, steps, (0.5, 0.1, 0.1), strict=True):
                total += step * step
                target += rate * step / np.sqrt(total)
    return model


def held_out() -> F.Column:
    """Rows that must not be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learn from a bounded sample of the rows that are not held out: text and lang only.

    The sample is drawn from ids and hashes alone; texts are fetched for it.  Of a text over
    ``MAX_CHARS`` a stretch of that length is taken.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.char_length("text") > 0))
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("language"))
    narrow = usable.select(F.col("lang").alias("__lang"), draw.alias("__draw"))
    order = Window.partitionBy("__lang").orderBy("__draw")
    drawn = narrow.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= PER_LANGUAGE).drop("__n").distinct()
    start = F.pmod(draw, F.greatest(F.char_length("text") - MAX_CHARS, F.lit(0)) + 1) + 1
    texts = usable.select("lang", draw.alias("draw"), F.substring("text", start.cast("int"), F.lit(MAX_CHARS)).alias("text"))
    picked = texts.join(sendable(drawn), (F.col("lang") == F.col("__lang")) & (F.col("draw") == F.col("__draw"))).select("lang", "draw", "text")
    once = Window.partitionBy("lang").orderBy("draw", "text")  # rows may share an id
    picked = picked.withColumn("n", F.row_number().over(once)).filter(F.col("n") <= PER_LANGUAGE)
    rows = sorted((r["lang"], r["draw"], r["text"]) for r in picked.collect())  # PER_LANGUAGE a language
    return train([(text, lang) for lang, _, text in rows])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and shares, the part of each language in the text's words."""
    base = without(docs, "lang_pred", "score", "shares")
    keep = base.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    share = T.StructType([T.StructField("lang", T.StringType()), T.StructField("part", T.DoubleType())])
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("shares", T.ArrayType(share))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sole("language", model.forget)
        for whole in batches:
            for batch in slices(whole, text, 1 << 19):
                words = [words_of(t) for t in batch.column(text).to_pylist()] if model.languages else [[]] * batch.num_rows
                langs, scores, shares = [], [], []
                for found in model.marginals(words) if model.languages else [np.zeros((0, 0))] * batch.num_rows:
                    if not len(found):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        shares.append([])
                        continue
                    mean = found.mean(axis=0, dtype=np.float64)
                    best = int(mean.argmax())
                    langs.append(model.languages[best])
                    scores.append(min(1.0, float(mean[best])))
                    shares.append([{"lang": x, "part": float(p)} for x, p in zip(model.languages, mean, strict=True)])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("part", pa.float64())]))
                yield with_columns(batch, keep, {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "shares": pa.array(shares, kind)})

    return in_arrow(base, run, T.StructType([*base.schema.fields, *new]))
