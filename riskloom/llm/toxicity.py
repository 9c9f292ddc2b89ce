"""Toxicity by weak supervision.

Many voters look at a text: the hand-written lexicon, ``LEXICONS`` lexicons of words and word beginnings that labelled rows show to be toxic
(dealt by hash, so each covers all languages), and patterns of shouting, address and repetition. A generative label model estimates from the
votes on all documents how often each voter fires in either class and which voters are correlated; it needs no labels but the
share of class 1. The texts are counted by what votes they get (a vote pattern), by Spark over all documents; moments of the counted patterns give
the first rates and the correlated pairs, and expectation-maximisation on the same counts refines the rates of all voters. A logistic model on hashed words, word
beginnings and patterns is then trained on the posterior labels of a sample, so
that it also scores texts on which no voter fires.

Vote patterns are at most 2 ** voters numbers (some thousands occur). The sample is at most ``SAMPLE`` labelled rows and ``PLAIN`` rows of all documents, by hash of the
id; held-out rows are in neither the lexicons nor the sample. Without labels the hand-written lexicon and the patterns vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fold, gather, labelled_sample, plain_sample, text_or_empty
from riskloom.llm.textbytes import LOWER, SCORED_BYTES, RangeHash, bucket, row_groups, runs, string_buffers, unique_pairs

SAMPLE = 8000
#: Rows of all documents in the sample, besides the labelled ones.
PLAIN = SAMPLE // 2
BITS = 21
PARTS, HELD_OUT = 5, 0
LEXICONS = 16
PATTERNS = 6

#: Insults that need no label.
WORDS = ("idiot stupid moron loser pathetic worthless scum trash clown disgusting dumb imbecile fool vermin filth freak creep jerk "
         "bastard bitch cunt whore slut retard asshole shit fuck fucking ugly subhuman parasite coward liar").split()
ADDRESS = "you your yours youre u ur thou du dich dir tu te toi vous usted ustedes vosotros".split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _word_ids(words: list[str]) -> np.ndarray:
    data, offsets = string_buffers(pa.array(words))
    return bucket(RangeHash(data)(offsets[:-1], offsets[1:]) >> np.uint64(8), 1, BITS)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs: lower-case words and their first 4, 5 and 6 bytes."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if not len(data):
        return row, row
    start, end = runs(_LETTER[data], offsets[:-1])
    h = RangeHash(LOWER[data])
    found = [(row[start], bucket(h(start, end) >> np.uint64(8), 1, BITS))]
    for n in (4, 5, 6):
        long = end - start > n
        a = start[long]
        found.append((row[a], bucket(h(a, a + n) >> np.uint64(8), n, BITS)))
    return unique_pairs(np.concatenate([r for r, _ in found]), np.concatenate([f for _, f in found]), BITS)


def pattern_votes(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Rows x patterns: shouting marks, capitals, address, short, long, few distinct words."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    at = np.repeat(np.arange(n), size)
    share = lambda mask: np.bincount(at, mask, n) / np.maximum(size, 1)
    address = np.zeros(1 << BITS, bool)
    address[_word_ids(ADDRESS)] = True
    distinct = np.bincount(rows, minlength=n) / np.maximum(size, 1)
    return np.stack([share(data == 33) > 0.01, share(_UPPER[data]) > 0.3, np.bincount(rows, address[found], n) > 0,
                     size < 200, size > 5000, distinct < 0.05], axis=1)


#: The feature that stands for each pattern.
PATTERN_IDS = bucket(np.arange(PATTERNS), 20, BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs by row: words, word beginnings and patterns."""
    rows, found = word_features(data, offsets)
    own, which = np.nonzero(pattern_votes(data, offsets, rows, found))
    rows, found = np.concatenate([rows, own]), np.concatenate([found, PATTERN_IDS[which]])
    return unique_pairs(rows, found, BITS)


@dataclass
class Voters:
    """The voter that a feature fires (-1: none), and how many lexicons there are."""

    of_feature: np.ndarray
    lexicons: int

    def __call__(self, rows: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """Votes (texts x voters) of the features of n texts."""
        votes = np.zeros((n, self.lexicons + PATTERNS), bool)
        who = self.of_feature[found]
        votes[rows[who >= 0], who[who >= 0]] = True
        return votes


def induce(rows: np.ndarray, found: np.ndarray, y: np.ndarray, lexicons: int = LEXICONS, chance: float = 5e-5) -> Voters:
    """Features that occur mostly in class 1 of the labelled rows, dealt to lexicons by hash; the hand-written words that
    are not among them are lexicon 0. ``chance`` bounds (by Chernoff) the probability that a neutral feature looks as one-sided."""
    table = np.full(1 << BITS, -1, np.int16)
    if len(y) and 0 < y.sum() < len(y):
        one = np.bincount(found[y[rows] == 1], minlength=1 << BITS)
        zero = np.bincount(found[y[rows] == 0], minlength=1 << BITS)
        base = y.mean()
        total = one + zero
        share = np.clip(one / np.maximum(total, 1), 1e-9, 1 - 1e-9)
        distance = share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))
        strong = (share > 0.8) & (total * distance > -np.log(chance))
        strong[PATTERN_IDS] = False
        ids = np.flatnonzero(strong)
        table[ids] = 1 + bucket(ids, 9, BITS) % lexicons
    own = _word_ids(WORDS)
    table[own[table[own] < 0]] = 0
    table[PATTERN_IDS] = lexicons + 1 + np.arange(PATTERNS)
    return Voters(table, lexicons + 1)


def _vote_patterns(batches: Iterator[pa.RecordBatch], voters: Voters) -> Iterator[pa.RecordBatch]:
    """(pattern, n): how many texts get exactly these votes, one bit for each voter."""
    bits = 1 << np.arange(voters.lexicons + PATTERNS, dtype=np.int64)
    for batch in batches:
        data, offsets = string_buffers(batch.column(0))
        seen = [voters(*features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a).astype(np.int64) @ bits for a, b in row_groups(offsets)]
        if seen:
            pattern, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n.astype(np.int64))], ["pattern", "n"])


def vote_patterns(docs: DataFrame, voters: Voters, text_column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(patterns x voters, number of texts) over all documents."""
    told = (docs.select(text_or_empty(text_column).alias("text")).mapInArrow(partial(_vote_patterns, voters=voters), "pattern long, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")).toArrow())  # 2 ** voters rows at most
    order = np.argsort(told["pattern"].to_numpy())
    pattern, n = told["pattern"].to_numpy()[order], told["n"].to_numpy()[order]
    return (pattern[:, None] >> np.arange(voters.lexicons + PATTERNS)) & 1 > 0, n.astype(float)


@dataclass
class LabelModel:
    """Firing rates by class, and a weight for each voter that shares out what correlated voters say together."""

    prior: float
    rate1: np.ndarray
    rate0: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        fires = self.weight * (np.log(self.rate1) - np.log(self.rate0))
        silent = self.weight * (np.log1p(-self.rate1) - np.log1p(-self.rate0))
        z = np.log(self.prior) - np.log1p(-self.prior) + votes @ fires + (~votes) @ silent
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(pairs: np.ndarray, n: int, prior: float, lexicons: int, correlated: float = 0.1, rounds: int = 50) -> LabelModel:
    """Method of moments. For voters independent given the class, cov(i, j) = prior (1 - prior) d_i d_j off the diagonal, where d is the
    difference of firing rates; d is the rank-one fit. Pairs whose class-conditional correlation stays above ``correlated``, at most the strongest quarter,
    are left out of the fit, and share their weight. The sign, which moments leave open, is that by which the lexicons speak for class 1."""
    mean = np.diag(pairs) / n
    cov = pairs / n - np.outer(mean, mean)
    scale = prior * (1 - prior)
    m = len(mean)
    use = ~np.eye(m, dtype=bool)
    edge = correlated
    d = np.sqrt(np.maximum(np.diag(cov), 0))
    resid = np.zeros((m, m))
    apart = ~np.eye(m, dtype=bool)
    alone = lambda pairs: np.where(pairs, np.abs(cov), 0).max(axis=1) <= 1e-4 * scale
    for _ in range(4):
        for _ in range(rounds):
            # half a step: the full one maps k d to d / k and back
            moved = 0.5 * (d + (np.where(use, cov / scale, 0) @ d) / np.maximum(use @ d**2, 1e-12))
            d = np.where(alone(apart) | ~alone(use), moved, d)  # a voter whose every partner is masked keeps what it had
            d = np.clip(d, -np.minimum(1, mean / (1 - prior) + 1e-9), np.minimum(1, mean / prior + 1e-9))
        within = np.maximum(mean * (1 - mean) - scale * d**2, 1e-9)
        resid = (cov - scale * np.outer(d, d)) / np.sqrt(np.outer(within, within))
        # a quarter of the pairs at most, or nothing would be left to fit
        edge = max(correlated, float(np.quantile(np.abs(resid[apart]), 0.75)))
        use = apart & (np.abs(resid) < edge)
    if d[:lexicons].sum() < 0:
        d = -d
    rate = lambda x: np.clip(x, 1e-3, 1 - 1e-3)
    linked = np.clip(resid - np.diag(np.diag(resid)), 0, 1)
    linked[linked < edge] = 0
    return LabelModel(prior, rate(mean + (1 - prior) * d), rate(mean - prior * d), 1 / np.sqrt(1 + linked.sum(axis=1)))


def refine(model: LabelModel, votes: np.ndarray, n: np.ndarray, rounds: int = 20, anchor: float = 0.05) -> LabelModel:
    """Expectation-maximisation on counted vote patterns (no labels) from the moments' solution, for which a share ``anchor`` of the texts speaks."""
    start, held = model, anchor * n.sum() + 2
    for _ in range(rounds):
        post = model.posterior(votes)
        one, zero = n * post, n * (1 - post)
        rate1 = (one @ votes + held * start.rate1) / (one.sum() + held)
        rate0 = (zero @ votes + held * start.rate0) / (zero.sum() + held)
        model = LabelModel(start.prior, np.clip(rate1, 1e-4, 1 - 1e-4), np.clip(rate0, 1e-4, 1 - 1e-4), start.weight)
    return model


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, found = features(data, offsets)
        z = np.bincount(rows, self.weights[found], len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(rows: np.ndarray, found: np.ndarray, target: np.ndarray, l2: float = 1e-3, steps: int = 200) -> Model:
    """Logistic regression on soft targets. Indicators are scaled by their log-count ratio under the targets, so neutral words stay
    near zero; gradient steps are Adam's."""
    n, size = len(target), 1 << BITS
    if not n:
        return Model(np.zeros(size, np.float32), -30.0)
    one, zero = np.bincount(found, target[rows], size), np.bincount(found, 1 - target[rows], size)
    p, q = (one + 1) / (target.sum() + 2), (zero + 1) / (n - target.sum() + 2)
    ratio = np.log(p / q)
    ratio[one + zero < 5] = 0
    keep = np.abs(ratio[found]) > 1
    rows, found = rows[keep], found[keep]
    ids, col = np.unique(found, return_inverse=True)
    value = ratio[found]
    w, bias, prior = np.zeros(len(ids)), 0.0, float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    bias = np.log(prior / (1 - prior))
    m, v = np.zeros(len(ids) + 1), np.zeros(len(ids) + 1)
    for t in range(1, steps + 1):
        guess = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[col] * value, n) + bias, -30, 30)))
        err = (guess - target) / n
        grad = np.append(np.bincount(col, err[rows] * value, len(ids)) + l2 * w / max(1, n / 1000), err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(size, np.float32)
    weights[ids] = w * ratio[ids]
    return Model(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic",
        sample: int = SAMPLE, lexicons: int = LEXICONS) -> Model:
    """Lexicons from the labelled sample, label model from the vote patterns of all documents, linear model from posterior labels."""
    held_out = fold(id_column, PARTS) == HELD_OUT
    row, found, y = gather(labelled_sample(labels, docs, label, held_out, sample, id_column, text_column), features)
    voters = induce(row, found, y, lexicons)
    votes, n = vote_patterns(docs, voters, text_column)
    prior = float(np.clip(y.mean() if len(y) else 0.1, 0.01, 0.99))
    pairs = (votes * n[:, None]).T @ votes
    model = refine(label_model(pairs, max(n.sum(), 1.0), prior, voters.lexicons), votes, n)
    own, seen, mark = gather(plain_sample(docs, held_out, min(sample, PLAIN), id_column, text_column), features)
    row, found = np.concatenate([row, own + len(y)]), np.concatenate([found, seen])
    size = len(y) + len(mark)
    return logistic(row, found, model.posterior(voters(row, found, size)))


def _scores(texts: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    for column in texts:
        data, offsets = string_buffers(column)
        parts = [model.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_groups(offsets, SCORED_BYTES)]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())


def score_column(model: Model, text_column: str = "text") -> Column:
    """The score of each whole text, 0 to 1."""
    def scores(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _scores(texts, model)

    return F.arrow_udf(scores, "double")(text_or_empty(text_column))


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 if score >= threshold).

    A null text is empty; an empty text gets the score of a text without words. Without labels only the hand-written lexicon and the
    patterns vote, with a share of class 1 of 0.1. Repeated rows are scored each; null ids stay null. Other
    columns are not read.
    """
    model = fit(docs, labels, id_column, text_column, sample=sample)
    return (docs.select(F.col(id_column).alias("doc_id"), fold(id_column, PARTS).eqNullSafe(F.lit(HELD_OUT)).alias("held_out"),
                        score_column(model, text_column).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
