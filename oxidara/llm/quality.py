"""Quality by weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, a linear scorer.

1. Each of the LABELLERS looks at one trait of a text and votes good, bad or nothing.  Each kind of junk shows in more than one trait, so
   labellers overlap.  The votes of all documents are counted by pattern; there are at most 3**len(LABELLERS) patterns, whatever the number of documents.
2. Labellers of one kind of junk agree and say nothing of the others, so given just "bad" their votes are not independent.  The label model
   therefore has one good class and one bad class for each labeller to begin with (the kind of junk that it looks for; those that no second labeller sees are given up).  Expectation-maximisation on the pattern counts estimates how often each labeller votes what in each class, and
   the share of each class; nothing is bounded or fixed.  A pattern's label is the posterior of good, and ``LabelModel.accuracy`` gives the
   estimated share of right ones among each labeller's votes.  It starts from the votes' majority: two complaints make a document bad, a single one
   leaves it open, so a complaint that the labeller's partners contradict ends as an error of the labeller.
3. These posteriors are the labels of a hashed linear scorer (shapes of neighbouring bytes, words, repeated words), fitted on a
   sample of at most about ``sample`` documents.
4. The scorer scores every whole text.

Results for unusual rows: null and empty texts are bad (score 0); repeated ids stay rows of their own; tables of copies of one text, or of too
few texts for a sample, get the posterior of their votes instead of a scorer's score; an empty table
gives no rows; other columns are ignored.  No label and no other column is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oxidara.llm.rows import and_fields, own_columns
from oxidara.llm.words import Run, Words, not_blank, runs, words

LABELLERS = ("symbols", "signed_words", "capitals", "exclamations", "repeated_words", "longest_run", "repeated_lines", "bars", "bare_signs", "sentences", "word_length", "size")
BAD, GOOD, NONE = 0, 1, 2
#: Documents that the linear scorer is fitted on.
SAMPLE = 4000
WORD_BITS = 11
#: With fewer documents in the sample there is no scorer.
LEAST_SAMPLE = 20
#: Votes of each kind that each class is thought to have besides.
SMOOTHING = 0.05
#: Words that a text is thought to have besides, of which nothing is known: a single word says little.
FEW = 30

# Classes of bytes for the shapes.
_CLASSES = np.full(256, 15, dtype=np.int64)
for _i, _group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", bytes(range(128, 256)), b".", b",", b"!", b"?", b"|", b"'\"`", b"()[]{}", b"-_", b";:")):
    _CLASSES[list(_group)] = _i
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _HIGH, _STOP, _COMMA, _SHOUT, _ASK, _BAR, _QUOTE, _BRACKET, _DASH, _COLON, _SIGN = range(16)
SHAPES = 256
FEATURES = SHAPES + (1 << WORD_BITS) + 1


def _sums(values: np.ndarray, run: Run) -> np.ndarray:
    """Sums over the bytes of each row."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[run.offsets[1:]] - total[run.offsets[:-1]]


def _same_as_before(found: Words) -> np.ndarray:
    same = np.zeros(len(found.value), dtype=bool)
    same[1:] = (found.value[1:] == found.value[:-1]) & (found.owner[1:] == found.owner[:-1])
    return same


def _longest_run(found: Words, same: np.ndarray, rows: int) -> np.ndarray:
    """The largest number of equal words in a row, by document."""
    out = np.zeros(rows)
    if len(same):
        began = np.flatnonzero(~same)
        np.maximum.at(out, found.owner[began], np.diff(np.append(began, len(same))))
    return out


def _repeated_lines(run: Run) -> np.ndarray:
    """Share of a row's bytes in lines that stood before in it."""
    line = np.ones(256, dtype=bool)
    line[ord("\n")] = False
    found = words(run, line)
    out = np.zeros(run.rows)
    if len(found.value):
        order = np.lexsort((found.value, found.owner))
        again = np.zeros(len(order), dtype=bool)
        own, value = found.owner[order], found.value[order]
        again[1:] = (own[1:] == own[:-1]) & (value[1:] == value[:-1])
        size = (found.end - found.begin)[order]
        out = np.bincount(own, weights=size * again, minlength=run.rows) / np.maximum(np.bincount(own, weights=size, minlength=run.rows), 1)
    return out


def _bare(kind: np.ndarray, found: Words) -> np.ndarray:
    """If a word has neither letters nor digits."""
    solid = np.concatenate(([0], np.cumsum((kind == _LOWER) | (kind == _UPPER) | (kind == _HIGH) | (kind == _DIGIT))))
    return solid[found.end] == solid[found.begin]


def votes(run: Run) -> np.ndarray:
    """document x labeller votes."""
    kind = _CLASSES[run.data]
    at = np.repeat(np.arange(run.rows), np.diff(run.offsets))
    count = np.bincount(at * 16 + kind, minlength=16 * run.rows).reshape(run.rows, 16).astype(float)
    found = words(run, not_blank())
    n = found.counts(run.rows).astype(float)
    some = np.maximum(n, 1)
    same = _same_as_before(found)
    repeats = np.bincount(found.owner, weights=same, minlength=run.rows)
    signed = np.bincount(found.owner, weights=kind[found.end - 1] == _SIGN, minlength=run.rows)
    bare = np.bincount(found.owner, weights=_bare(kind, found), minlength=run.rows)
    letters = count[:, _LOWER] + count[:, _UPPER] + count[:, _HIGH] / 2
    solid = np.maximum(count.sum(axis=1) - count[:, _SPACE] - count[:, _LINE], 1)
    traits = {
        "symbols": (count[:, _SIGN] / solid, 0.01, 0.05),
        "signed_words": (signed / some, 0.02, 0.1),
        "capitals": (count[:, _UPPER] / np.maximum(letters, 1), 0.2, 0.5),
        "exclamations": (count[:, _SHOUT] / some, 0.05, 0.25),
        "repeated_words": (repeats / some, 0.05, 0.2),
        "longest_run": (_longest_run(found, same, run.rows), 3, 5),
        "repeated_lines": (_repeated_lines(run), 0.1, 0.6),
        "bars": (count[:, _BAR] / some, 0.02, 0.15),
        "bare_signs": (bare / some, 0.02, 0.15),
        "sentences": (some / (count[:, _STOP] + count[:, _ASK] + count[:, _SHOUT] + count[:, _COLON] + 1), 40, 120),
        "word_length": (np.abs(solid / some - 6.5), 3.5, 6.0),
    }
    out = np.full((run.rows, len(LABELLERS)), NONE, dtype=np.int8)
    for i, name in enumerate(LABELLERS):
        if name == "size":
            out[n >= 8, i] = GOOD
            out[n == 0, i] = BAD
        else:
            value, good, bad = traits[name]
            out[value <= good, i] = GOOD
            out[value >= bad, i] = BAD
    return out


def _codes(vote: np.ndarray) -> np.ndarray:
    return vote.astype(np.int64) @ (3 ** np.arange(len(LABELLERS)))


def patterns(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class LabelModel:
    """rates[c, j, v]: how often labeller j votes v on documents of class c; class 0 is good, the others are kinds of junk."""

    rates: np.ndarray
    shares: np.ndarray

    def classes(self, vote: np.ndarray) -> np.ndarray:
        """row x class posteriors."""
        j = np.arange(vote.shape[1])
        log = np.log(self.shares)[:, None] + np.log(self.rates[:, j, vote.astype(np.int64)]).sum(axis=2)
        p = np.exp(log - log.max(axis=0))
        return (p / p.sum(axis=0)).T

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        """Probability of good for each row of votes."""
        return self.classes(vote)[:, 0]

    def accuracy(self) -> np.ndarray:
        """Share of right ones among the votes for good or bad that each labeller is expected to give."""
        said = self.shares[:, None, None] * self.rates
        right = said[0, :, GOOD] + said[1:, :, BAD].sum(axis=0)
        return right / (said[:, :, GOOD] + said[:, :, BAD]).sum(axis=0)


def label_model(vote: np.ndarray, n: np.ndarray, steps: int = 500, tolerance: float = 1e-7) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of vote, each met n times).

    Once it has settled, bad classes that fewer than two labellers see (complain in more often than they approve) go, the likeliest to be noise
    first: votes can't tell such a class from that labeller's errors.  Its documents begin anew as good, and the rest settles again."""
    n = n.astype(float)
    bad = vote == BAD
    complaints = bad.sum(axis=1)
    weight = np.zeros((len(vote), 1 + vote.shape[1]))
    weight[:, 0] = np.where(complaints > 1, 0.1, np.where(complaints == 1, 0.5, 1.0))
    weight[:, 1:] = bad * ((1 - weight[:, 0]) / np.maximum(complaints, 1))[:, None]
    while True:
        model, weight = _settled(vote, n, weight, steps, tolerance)
        seen_by = (model.rates[1:, :, BAD] > model.rates[1:, :, GOOD]).sum(axis=1)
        if not len(seen_by) or seen_by.min() > 1:
            return model
        least = 1 + int(seen_by.argmin())
        weight[:, 0] += weight[:, least]
        weight = np.delete(weight, least, axis=1)


def _settled(vote: np.ndarray, n: np.ndarray, weight: np.ndarray, steps: int, tolerance: float) -> tuple[LabelModel, np.ndarray]:
    """Steps of expectation-maximisation, until the mean log-likelihood gains less than tolerance, and the posteriors (row x class)."""
    before = -np.inf
    for _ in range(steps):
        rates = np.stack([((weight * n[:, None]).T @ (vote == v)) for v in range(3)], axis=2) + SMOOTHING
        rates /= rates.sum(axis=2, keepdims=True)
        shares = (weight * n[:, None]).sum(axis=0) + SMOOTHING
        model = LabelModel(rates, shares / shares.sum())
        j = np.arange(vote.shape[1])
        log = np.log(model.shares)[:, None] + np.log(rates[:, j, vote.astype(np.int64)]).sum(axis=2)
        now = float((n * np.logaddexp.reduce(log, axis=0)).sum() / max(n.sum(), 1))
        weight = model.classes(vote)
        if now - before < tolerance:
            break
        before = now
    return model, weight


def _pairs(run: Run) -> np.ndarray:
    """The shape at each byte: its class and the class before it."""
    kind = _CLASSES[run.data]
    before = np.roll(kind, 1)
    before[run.offsets[:-1][run.offsets[:-1] < len(kind)]] = _LINE
    return before * 16 + kind


def _word_slots(run: Run) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a run, their hashed places and if they repeat the word before (such a word counts as that only)."""
    found = words(run, not_blank())
    return found, (found.value >> np.uint64(64 - WORD_BITS)).astype(np.int64), _same_as_before(found)


def features(run: Run) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row, the features that are not zero and their values (shares within their kind)."""
    shape = _pairs(run)
    found, slot, same = _word_slots(run)
    counts = found.counts(run.rows)
    ends = np.cumsum(counts)
    repeats = np.bincount(found.owner, weights=same, minlength=run.rows)
    for i in range(run.rows):
        own = shape[run.offsets[i] : run.offsets[i + 1]]
        x = np.zeros(FEATURES, dtype=np.float32)
        if len(own):
            x[:SHAPES] = np.bincount(own, minlength=SHAPES) / len(own)
        if counts[i]:
            own, again = slot[ends[i] - counts[i] : ends[i]], same[ends[i] - counts[i] : ends[i]]
            x[SHAPES:-1] = np.bincount(own[~again], minlength=1 << WORD_BITS) / (counts[i] + FEW)
            x[-1] = repeats[i] / counts[i]
        some = np.flatnonzero(x)
        yield some.astype(np.int32), x[some]


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def scores(self, run: Run) -> np.ndarray:
        w = self.weights
        n_bytes = np.diff(run.offsets)
        z = _sums(w[:SHAPES][_pairs(run)], run) / np.maximum(n_bytes, 1)
        found, slot, same = _word_slots(run)
        n = found.counts(run.rows)
        z += np.bincount(found.owner, weights=np.where(same, 0.0, w[SHAPES:-1][slot]), minlength=run.rows) / (n + FEW)
        z += w[-1] * np.bincount(found.owner, weights=same, minlength=run.rows) / np.maximum(n, 1)
        out = 1 / (1 + np.exp(-np.clip(z + self.bias, -500, 500)))
        out[found.counts(run.rows) == 0] = 0.0
        return out


def linear_scorer(x: np.ndarray, y: np.ndarray, steps: int = 300, decay: float = 1e-3) -> Scorer:
    """Logistic regression on standardised features by gradient descent with momentum estimates (Adam)."""
    scale = np.sqrt((x.astype(np.float64) ** 2).sum(axis=0) / max(len(x), 1)).astype(np.float32)
    scale = np.where(scale > 0, np.maximum(scale, 1e-3), 1).astype(np.float32)
    z = x / scale
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -30, 30)))
        error = ((p - y) / max(len(y), 1)).astype(np.float32)
        g, gb = error @ z + decay * w, float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Scorer((w / scale).astype(np.float64), b)


@dataclass
class Model:
    labels: LabelModel
    #: None if there was nothing to fit it on
    scorer: Scorer | None


def fit(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Model:
    """The label model from the votes on all rows, and the scorer from about ``sample`` of them."""
    rows = own_columns(docs, {"text": text_col})

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for piece in runs(batch.column("text")):
                total += np.bincount(_codes(votes(piece)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    counted = rows.mapInArrow(vote, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    vote_rows, n = patterns(counted["code"].to_numpy(dtype=np.int64)), counted["n"].to_numpy()
    labels = label_model(vote_rows, n)
    share = min(1.0, sample / max(int(n.sum()), 1))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, at, value = [], [], []
            for piece in runs(batch.column("text")):
                y += labels.posterior(votes(piece)).tolist()
                for some, x in features(piece):
                    at.append(some)
                    value.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.float64()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["y", "at", "value"])

    # copies of one text have one hash: told apart, they would all be in the sample or none
    found = chosen.dropDuplicates(["text"]).mapInArrow(describe, "y double, at array<int>, value array<float>").limit(2 * sample).collect()
    x = np.zeros((len(found), FEATURES), dtype=np.float32)
    for i, row in enumerate(found):
        x[i, row["at"]] = row["value"]
    if len(found) < LEAST_SAMPLE:
        return Model(labels, None)
    return Model(labels, linear_scorer(x, np.array([row["y"] for row in found])))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, weak_label (probability of good by the votes), score, predicted (1: good)."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            weak, own = [np.empty(0)], [np.empty(0)]
            for piece in runs(batch.column("text")):
                by_votes = known.labels.posterior(votes(piece))
                weak.append(by_votes)
                own.append(by_votes if known.scorer is None else known.scorer.scores(piece))
            y = np.concatenate(own)
            arrays = [batch.column("doc_id"), pa.array(np.concatenate(weak)), pa.array(y), pa.array((y >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "weak_label", "score", "predicted"])

    return rows.mapInArrow(run, and_fields(rows.schema["doc_id"], "weak_label double, score double, predicted int"))
