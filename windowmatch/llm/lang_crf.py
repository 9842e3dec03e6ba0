"""Language identification: a linear-chain conditional random field over the words of a text.

Every word has one hidden language. Emission weights come from prefixes, suffixes, character
n-grams and a lexicon; transition weights say how readily a text switches. Both are trained
together by maximising the conditional likelihood of labelled word sequences. A text is labelled by
forward-backward: the marginals of its words, averaged, give its language and its score.

The model is fitted on the driver on a sample of at most ``PER_LANGUAGE`` labelled texts for each
language (texts up to ``LONGEST`` characters), chosen by a hash of the id. Training sequences splice
stretches of texts of different languages, so that the transitions are learned on switching text.
Prediction covers every word of every text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windowmatch.llm.shared import by_hash, free_name

#: Bounds of the training sample.
PER_LANGUAGE = 250
LONGEST = 20_000

UNKNOWN = "und"
BUCKETS = 1 << 16
LEXICON = 1500
SEQUENCES, SWITCHES = 2000, 4
ROUNDS, RATE, DECAY = 40, 0.15, 1e-4
#: Words of one block of forward-backward, and known words kept by a worker.
BLOCK, KNOWN = 400_000, 200_000
#: Longer words are handled one by one.
LONG_WORD = 32

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS.findall(text.lower()) if text else []


def _marked(words: list[str], width: int) -> np.ndarray:
    """Code points of the words between a start and an end mark, zeros behind."""
    letters = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width)
    marked = np.zeros((len(words), width + 2), np.uint64)
    marked[:, 1:-1] = letters
    marked[:, 0] = ord("<")
    marked[np.arange(len(words)), 1 + (letters > 0).sum(1)] = ord(">")
    return marked


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (word, feature) and whether they apply: n-grams of one to three marked letters, and
    prefixes and suffixes of three and four letters."""
    marked = _marked(words, max(map(len, words)))
    n, width = marked.shape
    ends = (marked > 0).sum(1)

    def bucket(grams: list[np.ndarray], kind: int) -> np.ndarray:
        mixed = np.full_like(grams[0], kind)
        for g in grams:
            mixed = (mixed ^ g) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return (mixed % np.uint64(BUCKETS)).astype(np.int32)

    found, valid = [], []
    for size in (1, 2, 3):
        found.append(bucket([marked[:, k : width - size + 1 + k] for k in range(size)], size))
        valid.append(marked[:, size - 1 :] > 0)
    for size in (4, 5):
        if width < size:
            continue
        found.append(bucket([marked[:, k : k + 1] for k in range(size)], size))
        valid.append((ends >= size)[:, None])
        behind = np.maximum(ends - size, 0)
        found.append(bucket([marked[np.arange(n), behind + k][:, None] for k in range(size)], 10 + size))
        valid.append((ends >= size)[:, None])
    return np.concatenate(found, 1), np.concatenate(valid, 1)


def _lexicon_bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@dataclass
class Crf:
    """Languages, lexicon, emission weights (bucket, language), transitions (from, to), start."""

    labels: list[str]
    lexicon: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    _places: dict = field(default_factory=dict, repr=False)
    _rows: np.ndarray = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_places": {}, "_rows": None}

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission weights of words."""
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        rows = np.zeros((len(words), len(self.labels)))
        for group in [short, *([i] for i, w in enumerate(words) if len(w) > LONG_WORD)]:
            if not group:
                continue
            found, valid = features([words[i] for i in group])
            total = np.zeros((len(group), len(self.labels)))
            for column in range(found.shape[1]):
                total += self.emission[found[:, column]] * valid[:, column, None]
            listed = np.array([self.lexicon.get(words[i], -1) for i in group])
            total += self.emission[listed] * (listed >= 0)[:, None]
            rows[group] = total / np.sqrt(valid.sum(1) + (listed >= 0))[:, None]
        return rows

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emission weights of the words that have a letter, and which words those are.

        The worker remembers the weights of up to ``KNOWN`` words besides those of this call.
        """
        new = list(set(words).difference(self._places))
        if self._rows is None or len(self._places) + len(new) > KNOWN:
            self._places, self._rows = {}, np.zeros((1, len(self.labels)))
            new = list(set(words))
        if new:
            kept = [w for w in new if w.isalpha() or any(map(str.isalpha, w))]
            self._places.update(zip(kept, range(len(self._rows), len(self._rows) + len(kept))))
            self._places.update(dict.fromkeys(set(new).difference(kept), 0))
            if kept:
                self._rows = np.concatenate([self._rows, self.scores(kept)])
        places = np.fromiter(map(self._places.__getitem__, words), np.int64, len(words))
        return self._rows[places[places > 0]], places > 0


def _packed(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the sequences (longest first), place of each (step, sequence), sequences per step."""
    order = np.argsort(-lengths, kind="stable")
    sizes = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
    return order, np.concatenate([[0], np.cumsum(sizes)]), sizes


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Word marginals of sequences that lie one after the other, the transition counts expected, log Z.

    All sequences take a step at once; forward messages are normalised at every step.
    """
    order, at, sizes = _packed(lengths)
    first = (np.cumsum(lengths) - lengths)[order]
    place = np.concatenate([first[:n] + t for t, n in enumerate(sizes)])
    peak = emission.max(1, keepdims=True)
    weight = np.exp(emission - peak)[place]
    trans = np.exp(transition)
    ahead = np.empty_like(weight)
    norm = np.empty(len(weight))
    now = weight[: sizes[0]] * np.exp(start)
    for t, n in enumerate(sizes):
        if t:
            now = (now[:n] @ trans) * weight[at[t] : at[t + 1]]
        total = now.sum(1)
        now = now / total[:, None]
        norm[at[t] : at[t + 1]] = total
        ahead[at[t] : at[t + 1]] = now
    back = np.ones((sizes[-1], weight.shape[1]))
    marginal = np.empty_like(weight)
    expected = np.zeros_like(trans)
    for t in range(len(sizes) - 1, -1, -1):
        low, high = at[t], at[t + 1]
        marginal[low:high] = ahead[low:high] * back
        if t:
            seen = weight[low:high] * back / norm[low:high, None]
            expected += trans * (ahead[at[t - 1] : at[t - 1] + sizes[t]].T @ seen)
            back = np.concatenate([seen @ trans.T, np.ones((sizes[t - 1] - sizes[t], weight.shape[1]))])
    out = np.empty_like(marginal)
    out[place] = marginal / marginal.sum(1, keepdims=True)
    return out, expected, float(np.log(norm).sum() + peak.sum())


def _sequences(texts: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Training sequences: some of one text, some spliced from stretches of several texts."""
    made = []
    by_label = {}
    for words, label in texts:
        by_label.setdefault(label, []).append(words)
    kinds = sorted(by_label)
    for _ in range(SEQUENCES):
        words, labels = [], []
        for _ in range(int(rng.integers(1, SWITCHES + 1))):
            label = kinds[int(rng.integers(len(kinds)))]
            text = by_label[label][int(rng.integers(len(by_label[label])))]
            size = int(rng.integers(3, 40))
            begin = int(rng.integers(0, max(1, len(text) - size)))
            words += text[begin : begin + size]
            labels += [label] * len(text[begin : begin + size])
        made.append((words, labels))
    return made


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Crf:
    """Train on (text, language) pairs. Without a labelled text that has words, nothing is learned."""
    labels = sorted({lang for text, lang in rows if words_of(text)})
    k = len(labels)
    texts = [(words_of(t), labels.index(lang)) for t, lang in rows if words_of(t)]
    texts = [([w for w in words if len(w) <= LONG_WORD], label) for words, label in texts]
    if not labels:
        return Crf([], {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    counts = [Counter() for _ in labels]
    for words, label in texts:
        counts[label].update(words)
    lexicon = {w: _lexicon_bucket(w) for c in counts for w, n in c.most_common(LEXICON) if n > 1}
    model = Crf(labels, lexicon, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k))
    if k == 1:
        return model
    sequences = _sequences(texts, np.random.default_rng(seed))
    vocabulary = {w: i for i, w in enumerate(sorted({w for words, _ in sequences for w in words}))}
    tokens = np.array([vocabulary[w] for words, _ in sequences for w in words])
    gold = np.array([y for _, ys in sequences for y in ys])
    lengths = np.array([len(words) for words, _ in sequences])
    starts = np.cumsum(lengths) - lengths
    buckets, valid = features(list(vocabulary))
    listed = np.array([lexicon.get(w, -1) for w in vocabulary])[:, None]
    buckets, valid = np.concatenate([buckets, listed], 1), np.concatenate([valid, listed >= 0], 1)
    sizes = valid.sum(1)
    flat, cuts, scale = buckets[valid], np.cumsum(sizes) - sizes, 1 / np.sqrt(sizes)
    used, inner = np.unique(flat, return_inverse=True)
    truth = np.zeros((len(tokens), k))
    truth[np.arange(len(tokens)), gold] = 1
    begins = truth[starts].sum(0)
    steps = np.zeros((k, k))
    inside = np.ones(len(tokens), bool)
    inside[starts] = False
    np.add.at(steps, (gold[:-1][inside[1:]], gold[1:][inside[1:]]), 1)
    weights, squares = np.zeros((len(used), k)), np.full((len(used), k), 1e-8)
    side = [[model.transition, np.full((k, k), 1e-8)], [model.start, np.full(k, 1e-8)]]
    for _ in range(ROUNDS):
        per_word = np.add.reduceat(weights[inner], cuts, axis=0) * scale[:, None]
        marginal, expected, _ = forward_backward(per_word[tokens], lengths, model.transition, model.start)
        gap = truth - marginal
        by_word = np.stack([np.bincount(tokens, gap[:, j], len(vocabulary)) for j in range(k)], 1) * scale[:, None]
        spread = np.repeat(by_word, sizes, axis=0)
        grad = np.stack([np.bincount(inner, spread[:, j], len(used)) for j in range(k)], 1) / len(tokens)
        grad -= DECAY * weights / len(labels)
        squares += grad**2
        weights += RATE * grad / np.sqrt(squares)
        for (value, square), change in zip(side, (steps - expected, begins - marginal[starts].sum(0))):
            change = change / len(tokens)
            square += change**2
            value += RATE * change / np.sqrt(square)
    model.emission[used] = weights
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf:
    """Fit on a bounded sample of the labelled rows of ``docs`` (see the module's text).

    Rows whose text or language is NULL are not learned from.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) <= LONGEST))
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    # one pass for all languages: a few more than wanted by a hash of the id, then the first ones
    shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * PER_LANGUAGE / n))))
    some = rows.where(by_hash(F.col("id"), F.element_at(shares, F.col("lang"))))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id", "text"))
    sample = some.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PER_LANGUAGE)
    ordered = sample.select("lang", "place", "text").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(ordered, key=lambda r: (r["lang"], r["place"]))])


def _blocks(lengths: list[int]):
    """Groups of sequences of similar length with at most ``BLOCK`` words, or of a single sequence."""
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    group, size = [], 0
    for i in order:
        if group and size + lengths[i] > BLOCK:
            yield group
            group, size = [], 0
        group.append(i)
        size += lengths[i]
    if group:
        yield group


def predict(model: Crf, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and mean marginal of every text; ('und', 0) without a letter."""
    return [(lang, score) for lang, score, _ in judge(model, texts)]


def judge(model: Crf, texts: list[str | None]) -> list[tuple[str, float, float]]:
    """Like ``predict``, and how certain the words are: the mean of each word's greatest marginal. A text
    of several languages has a low score and certain words."""
    answers = [(UNKNOWN, 0.0, 0.0)] * len(texts)
    if not model.labels:
        return answers
    for group in _blocks([len(t) if t else 0 for t in texts]):
        words = [words_of(texts[i]) for i in group]
        emission, lettered = model.emissions([w for ws in words for w in ws])
        owners = np.repeat(np.arange(len(group)), [len(ws) for ws in words])[lettered]
        lengths = np.bincount(owners, minlength=len(group))
        full = np.flatnonzero(lengths)
        if not len(full):
            continue
        lengths = lengths[full]
        marginal, _, _ = forward_backward(emission, lengths, model.transition, model.start)
        starts = np.cumsum(lengths) - lengths
        means = np.add.reduceat(marginal, starts, axis=0) / lengths[:, None]
        certain = np.add.reduceat(marginal.max(1), starts) / lengths
        for i, mean, sure in zip(full, means, certain):
            best = int(mean.argmax())
            answers[group[i]] = (model.labels[best], float(min(1.0, mean[best])), float(min(1.0, sure)))
    return answers


def language_column(spark, model: Crf, text: Column) -> Column:
    """A struct (lang, score, certain) for a text column. The model has a fixed size and is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(judge(shared.value, texts.tolist()), columns=["lang", "score", "certain"])

    return F.pandas_udf(batch, "lang string, score double, certain double")(text)


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, language and score of every row of ``docs``; repeated rows and NULL ids stay as they are."""
    found = docs.select(F.col(id_col).alias("doc_id"), language_column(docs.sparkSession, model, F.col(text_col)).alias("p"))
    return found.select("doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, model: Crf, text_col: str = "text", least: float = 0.35) -> DataFrame:
    """``docs`` without texts that have no letter, or whose words have no certain language: the mean of
    each word's greatest marginal is under ``least``. If nothing could be learned, all texts with a letter stay.
    """
    if not model.labels:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    name = free_name(docs, "language_found")
    found = docs.withColumn(name, language_column(docs.sparkSession, model, F.col(text_col)))
    return found.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.certain") >= least)).drop(name)
