"""Language identification by a linear-chain conditional random field over words.

A word's score for each language is a sum of weights of its features: the word itself if it is in the lexicon (the training
words that occur twice), its affixes, and the 2- to 4-grams of its bytes, hashed into a table.
Transitions between the languages of neighbouring words are learned too: training sequences join stretches of texts in
different languages, as code-switched text does. Forward-backward gives each word's language probabilities; a document gets
the language with the largest mean probability over its words that have a letter, and that mean as its score.

Training uses a bounded sample of labelled rows (TRAIN_DOCS for each language of at most TRAIN_CHARS characters each, the least
by a hash of id and text; equal rows count once). Prediction covers every
word of every text. A text that is null or has no letter gets `und` with score 0; so does every text if no row is labelled.
Repeated rows get equal values; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import crc_mod, held, map_lists, read, release, ship

UNDETERMINED = "und"
TRAIN_DOCS = 200
TRAIN_CHARS = 200_000
TABLE_BITS = 17
TABLE = 1 << TABLE_BITS
SEQUENCE = 32
STRETCH = 12
EPOCHS = 2
RATE = 0.5
#: Words after which a worker's table of scores starts anew; a word takes about 200 bytes.
CACHE_WORDS = 150_000
BATCH = 500
STEP = 32
LETTER = re.compile(r"[^\W\d_]")
#: What is cut from both ends of a word.
EDGES = string.punctuation + string.digits + "\u00ab\u00bb\u201c\u201d\u201e\u2018\u2019\u2026\u2013\u2014\u00a1\u00bf"


def core(word: str) -> str:
    return word.strip(EDGES).lower()


def grams(cores: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of the words' features, and the word that each belongs to. Words without a core have none.

    The features are the 2- to 4-grams of the UTF-8 bytes between two marks, so that the first and last ones are affixes, and
    the word itself if it is in the lexicon. All words are hashed at once.
    """
    raw = [b"\x02" + c.encode() + b"\x03" if c else b"" for c in cores]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    rows, owners = [], []
    code = data
    for n in (2, 3, 4):
        code = code[: len(data) - n + 1] * np.uint64(257) + data[n - 1 :] if len(data) >= n else data[:0]
        inside = owner[: len(code)] == owner[n - 1 :][: len(code)]
        rows.append(((code[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        owners.append(owner[: len(code)][inside])
    known = [(k, TABLE + lexicon[c]) for k, c in enumerate(cores) if c in lexicon]
    rows.append(np.array([r for _, r in known], np.int64))
    owners.append(np.array([k for k, _ in known], np.int64))
    return np.concatenate(rows), np.concatenate(owners)


def forward_backward(scores: np.ndarray, transition: np.ndarray, lengths: list[int], moves: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities of each word of sequences laid end to end.

    To moves (labels by labels), if given, the probabilities of the label pairs of neighbouring words are added, summed over
    all neighbours: the expected number of each transition, which is the derivative of the log partition function by it.

    Sequences are cut into blocks of STEP words. Products of the words' transfer matrices give each block's matrix, a pass
    over the blocks of each sequence gives the messages at block borders, and a pass within all blocks at once gives those
    at each word: the same numbers as word by word.
    """
    n, m = scores.shape
    if not n:
        return scores.copy()
    spread = np.exp(transition - transition.max())
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    sizes = np.asarray(lengths, dtype=np.int64)
    blocks = -(-sizes // STEP)
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    within = np.arange(n) - np.repeat(starts, sizes)
    row, col = np.repeat(first, sizes) + within // STEP, within % STEP
    total = int(blocks.sum())
    e = np.ones((total, STEP, m))
    e[row, col] = emit
    real = np.zeros((total, STEP), bool)
    real[row, col] = True
    head = np.zeros(total, bool)
    head[first[blocks > 0]] = True
    eye = np.eye(m)
    # transfer matrices; a sequence's first word has no transition, and places after its end change nothing
    free = np.broadcast_to(np.ones((m, m)) / m, (total, m, m))

    def matrix(t: int) -> np.ndarray:
        base = np.where((head & (t == 0))[:, None, None], free, spread)
        return np.where(real[:, t, None, None], base * e[:, t, None, :], eye)

    product = np.broadcast_to(eye, (total, m, m)).copy()
    for t in range(STEP):
        product = product @ matrix(t)
        product /= product.sum(axis=(1, 2), keepdims=True)
    into, back = np.ones((total, m)) / m, np.ones((total, m)) / m
    order = np.argsort(-blocks, kind="stable")
    first, blocks = first[order], blocks[order]
    most = int(blocks[0])
    for k in range(1, most):
        now = first[: int((blocks > k).sum())] + k
        v = np.einsum("bi,bij->bj", into[now - 1], product[now - 1])
        into[now] = v / v.sum(axis=1, keepdims=True)
    for k in range(most - 2, -1, -1):
        now = first[: int((blocks > k + 1).sum())] + k
        v = np.einsum("bij,bj->bi", product[now + 1], back[now + 1])
        back[now] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((total, STEP, m))
    a = into
    for t in range(STEP):
        a = np.einsum("bi,bij->bj", a, matrix(t))
        a = a / a.sum(axis=1, keepdims=True)
        alpha[:, t] = a
    beta = back
    for t in range(STEP - 1, -1, -1):
        step = matrix(t)
        if moves is not None:
            pair = (alpha[:, t - 1] if t else into)[:, :, None] * step * beta[:, None, :]
            pair = pair[real[:, t] & ~(head & (t == 0))]
            moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        alpha[:, t] *= beta
        beta = np.einsum("bij,bj->bi", step, beta)
        beta = beta / beta.sum(axis=1, keepdims=True)
    out = alpha[row, col]
    return out / out.sum(axis=1, keepdims=True)


class Model:
    """Labels, feature weights (rows by labels), transitions and the lexicon (word to row)."""

    def __init__(self, labels: list[str], weights: np.ndarray, transition: np.ndarray, lexicon: dict[str, int]):
        self.labels, self.weights, self.transition, self.lexicon = labels, weights, transition, lexicon

    def scores(self, cores: list[str]) -> np.ndarray:
        """The sums of the words' feature weights: words by labels."""
        rows, owners = grams(cores, self.lexicon)
        w = self.weights[rows]
        return np.stack([np.bincount(owners, w[:, k], len(cores)) for k in range(len(self.labels))], axis=1)


class WordTable:
    """Scores of the words seen of late, by number."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.labels)))
        self.lettered = np.zeros(0, bool)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.model.scores([core(w) for w in new])])
            self.lettered = np.concatenate([self.lettered, [LETTER.search(w) is not None for w in new]])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def train(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fits the model to (text, label) rows by steps along the gradient of the sequences' log-likelihood.

    Transitions move by the gradient itself. A word's weights move by a step rule instead: its gradient is clipped and shared
    out over its features, so that long words, which have more of them, do not move faster than short ones.
    """
    labels = sorted({y for _, y in rows})
    counts = Counter(core(w) for t, _ in rows for w in t.split())
    lexicon = {w: k for k, w in enumerate(sorted(w for w, n in counts.items() if n > 1 and w))}
    rng = np.random.default_rng(seed)
    stretches = []
    for text, y in rows:
        words, at = text.split(), 0
        while at < len(words):
            size = int(rng.integers(3, STRETCH + 1))
            stretches.append((words[at : at + size], labels.index(y)))
            at += size
    m = len(labels)
    model = Model(labels, np.zeros((TABLE + len(lexicon), m), np.float32), np.zeros((m, m)), lexicon)
    for epoch in range(EPOCHS):
        order, k = rng.permutation(len(stretches)), 0
        while k < len(order):
            words, gold, lengths = [], [], []
            while k < len(order) and len(words) < 8192:
                size = 0
                stay = rng.random() < 0.5  # half of the sequences keep to one language, as most texts do
                tag = stretches[order[k]][1]
                while k < len(order) and size < SEQUENCE:
                    s, y = stretches[order[k]]
                    if stay and y != tag and size:
                        break
                    words += s
                    gold += [y] * len(s)
                    size += len(s)
                    k += 1
                lengths.append(size)
            distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids = np.array([distinct[w] for w in words])
            feats, owners = grams([core(w) for w in distinct], lexicon)
            weights = model.weights[feats]
            scores = np.stack([np.bincount(owners, weights[:, c], len(distinct)) for c in range(m)], axis=1)
            expected = np.zeros((m, m))
            p = forward_backward(scores[ids], model.transition, lengths, expected)
            y = np.eye(m)[gold]
            by_word = np.stack([np.bincount(ids, (y - p)[:, c], len(distinct)) for c in range(m)], axis=1)
            sizes = np.maximum(np.bincount(owners, minlength=len(distinct)), 1)
            rate = RATE / (1 + epoch)
            np.add.at(model.weights, feats, rate * (np.clip(by_word, -5, 5) / sizes[:, None])[owners])
            inner = np.ones(len(words) - 1, bool)
            inner[np.cumsum(lengths)[:-1] - 1] = False
            model.transition += rate * 10 * (np.einsum("ni,nj->ij", y[:-1][inner], y[1:][inner]) - expected) / len(words)
    return model


def training_rows(docs: DataFrame, may_learn: Column, per_label: int = TRAIN_DOCS) -> list[tuple[str, str]]:
    """At most per_label (text, lang) rows of each language: those with the least hashes of their id and text.

    The hash's cut for a language follows from a sketch of the number of its distinct hashes, so that neither rows that
    share an id nor those without one come in greater number.
    """
    rows = docs.where(may_learn & F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1_000_000_007)) / 1_000_000_007.0
    counts = rows.select("lang", unit.alias("u")).groupBy("lang").agg(F.approx_count_distinct("u").alias("n")).collect()
    picked = F.lit(False)
    for r in counts:
        picked = picked | ((F.col("lang") == r["lang"]) & (unit < min(1.0, 1.4 * per_label / max(1, r["n"]) + 1e-9)))
    by_label: dict[str, list[tuple[float, str]]] = {}
    for r in rows.where(picked).select("lang", "text", unit.alias("u")).distinct().collect():
        by_label.setdefault(r["lang"], []).append((r["u"], r["text"]))
    return [(t, lang) for lang, found in sorted(by_label.items()) for _, t in sorted(found)[:per_label]]


def labelled_words(words: list[list[str]], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels for the words of all sequences end to end, and which words have a letter."""
    numbers = table.numbers([w for x in words for w in x])
    return forward_backward(table.scores[numbers], table.model.transition, [len(x) for x in words]), table.lettered[numbers]


def predictor(docs: DataFrame, may_learn: Column):
    """Trains on docs and gives a function of texts to (lang_pred, score) for use in tasks."""
    rows = training_rows(docs, may_learn)
    model = docs.sparkSession.sparkContext.broadcast(train(rows) if rows else None)  # of fixed size
    key = uuid.uuid4().hex

    def predict(texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if model.value is None:
            return out
        table = word_table(model, key)
        for at in range(0, len(texts), BATCH):
            some = [k for k in range(at, min(at + BATCH, len(texts))) if texts[k] and LETTER.search(texts[k])]
            if not some:
                continue
            words = [texts[k].split() for k in some]
            p, lettered = labelled_words(words, table)
            owner = np.repeat(np.arange(len(some)), [len(w) for w in words])[lettered]
            n = np.bincount(owner, minlength=len(some))
            mean = np.stack([np.bincount(owner, c, len(some)) for c in p[lettered].T], axis=1) / n[:, None]
            for k, row in zip(some, mean, strict=True):
                best = int(row.argmax())
                out[k] = (model.value.labels[best], float(min(1.0, row[best])))
        return out

    return predict


def word_table(model: Broadcast, key: str) -> WordTable:
    """The worker's table for a model; it lasts until another operator runs there."""
    return held(("words", key), lambda: WordTable(model.value))


def identify(docs: DataFrame, may_learn: Column) -> DataFrame:
    """doc_id, lang_pred, score of each row of docs (doc_id, text, lang); lang is read only where may_learn holds."""
    predict = predictor(docs, may_learn)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for x in batches:
            found = predict(x["text"])
            yield {"doc_id": x["doc_id"], "lang_pred": [lang for lang, _ in found], "score": [s for _, s in found]}

    return map_lists(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double", holds=True)


def keep_known(docs: DataFrame, may_learn: Column, least: float = 0.5) -> DataFrame:
    """The rows of docs that have a language with at least that score, with their columns."""
    ship(docs.sparkSession)
    predict = predictor(docs, may_learn)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([lang != UNDETERMINED and score >= least for lang, score in predict(list(texts))], dtype=bool)
        release(keep=True)

    return docs.where(F.pandas_udf(run, "boolean")(F.col("text")))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    out = identify(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
