"""Toxicity by a bidirectional gated recurrent network with attention pooling, over character and word inputs.

Word inputs: a word's own hash and the hashes of its beginnings and its end stand for the log-odds of toxic against clean documents that they were
met in, counted on the training sample; for training they are taken from the other half of the sample, so the network never sees what a document
says about itself.  Character inputs: the word's characters are read by a convolution over three neighbouring ones (borders included), whose
filters are CHARS learned numbers for each hashed triple, averaged over the word; they are trained with the network.  Two gated
recurrent layers read the window in either direction; attention over their states pools them into one logit.

All windows of WINDOW words, one beginning every STRIDE words, are scored, so every word of a text is in two of them but at its ends.  The text's
score is that of its worst window, put on the scale of probabilities by a logistic fit on the sample.
Training is plain numpy: back-propagation through time with Adam, on windows chosen per document by multiple-instance rules (the
most suspicious window of a toxic document; the most suspicious ones and random ones of a clean one).

The sample is bounded: at most about ``sample`` labelled documents, half of them toxic where there are enough, and ``most_bytes`` bytes of text.  Of an id
that repeats, one text is in it.

Results for unusual rows: texts without a word (null, empty) get the least score that there is, below 1e-12; if the
labels hold one class only or nothing, every score is that class's smoothed share; rows that repeat an id stay rows of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxidara.llm.rows import own_columns
from oxidara.llm.words import Run, borders, letters_and_digits, mix, prefix_sums, runs, spans

WINDOW, STRIDE = 32, 16
SAMPLE, MOST_BYTES = 3000, 64 << 20
HASH_BITS = 18
#: Bytes of a word's beginnings and of its end that are inputs beside the whole word.
HEADS, TAIL = (3, 4, 5, 6), 4
#: Learned numbers for each triple of characters, and bits of a triple's hash.
CHARS, TRIPLE_BITS = 4, 12
#: Inputs that need no training, and all.
FIXED = 2 + len(HEADS) + 1
INPUTS = FIXED + CHARS
HIDDEN = 8


def word_hashes(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """input x word table places, and the row of each word."""
    begin, end, owner = borders(run, letters_and_digits())
    if not len(begin):
        return np.empty((FIXED - 1, 0), dtype=np.int64), owner
    total = prefix_sums(run.data)
    found = [spans(run.data, begin, end, total)]
    found += [mix(spans(run.data, begin, np.minimum(begin + k, end), total) + np.uint64(k)) for k in HEADS]
    found.append(mix(spans(run.data, np.maximum(end - TAIL, begin), end, total) + np.uint64(99)))
    return (np.stack(found) >> np.uint64(64 - HASH_BITS)).astype(np.int64), owner


def word_triples(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """The hashed triple of characters (bytes) around each byte of each word, and where each word begins among them."""
    begin, end, _ = borders(run, letters_and_digits())
    data = run.data
    inside = letters_and_digits()[data]
    before, after = np.zeros(len(data), dtype=np.uint32), np.zeros(len(data), dtype=np.uint32)
    before[1:], after[:-1] = data[:-1], data[1:]
    before[begin] = 0
    after[end - 1] = 0
    code = ((before << np.uint32(16)) | (data.astype(np.uint32) << np.uint32(8)) | after)[inside]
    code = (code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TRIPLE_BITS)
    return code.astype(np.uint16), np.cumsum(end - begin) - (end - begin)


def read_characters(filters: np.ndarray, triples: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """word x CHARS: the mean of the filters at a word's triples."""
    if not len(begin):
        return np.empty((0, filters.shape[1]), dtype=np.float32)
    sizes = np.diff(np.append(begin, len(triples)))[:, None]
    return np.add.reduceat(filters[triples], begin, axis=0) / sizes.astype(np.float32)


def log_odds(places: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Log-odds of each table place, by the documents it was met in.  places: per document."""
    met = np.zeros((2, 1 << HASH_BITS), dtype=np.int32)
    for at, y in zip(places, toxic.astype(int).tolist(), strict=True):
        met[y, np.unique(at)] += 1
    n = np.maximum(np.bincount(toxic.astype(int), minlength=2), 1)
    # a place that was met in few documents says little: shrunk towards the share of toxic documents
    prior = 2 * n / n.sum()
    return (np.log((met[1] + prior[1]) / prior[1] / (n[1] + 2) * n[1]) - np.log((met[0] + prior[0]) / prior[0] / (n[0] + 2) * n[0])).astype(np.float32)


def fixed_inputs(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """word x input; the last of these is 1 for each word, 0 for padding."""
    x = np.empty((places.shape[1], FIXED), dtype=np.float32)
    x[:, :-1] = table[places].T
    x[:, -1] = 1
    return x


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word (among a document's) and document of every window."""
    each = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), each)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    return number * STRIDE, owner


def window_words(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """window x place word numbers (the number of words stands for padding), and each window's document."""
    first, owner = windows(counts)
    begin = (np.cumsum(counts) - counts)[owner]
    at = first[:, None] + np.arange(WINDOW)
    return np.where(at < counts[owner][:, None], begin[:, None] + at, counts.sum()), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights of both directions: input to the three gates, state to them, attention and the output."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    #: triple x CHARS, the filters of the characters
    filters: np.ndarray = field(default_factory=lambda: np.zeros((1 << TRIPLE_BITS, CHARS), dtype=np.float32))

    @classmethod
    def new(cls, seed: int) -> Network:
        r = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["W" + d] = r.normal(0, 0.3, (INPUTS, 3 * HIDDEN))
            w["U" + d] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            w["a" + d] = r.normal(0, 0.3, HIDDEN)
            w["o" + d] = r.normal(0, 0.3, HIDDEN)
        w["wa"], w["wo"] = r.normal(0, 0.3, INPUTS), r.normal(0, 0.3, INPUTS)
        w["bias"] = np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in w.items()}, r.normal(0, 0.05, (1 << TRIPLE_BITS, CHARS)).astype(np.float32))

    def _read(self, x: np.ndarray, words: np.ndarray, d: str, keep: bool) -> tuple[list[np.ndarray], list[tuple]]:
        """States of one direction at each place of the windows; keep: what the way back needs."""
        w, u, h = self.weights, self.weights["U" + d], HIDDEN
        gates = x @ w["W" + d]
        state = np.zeros((len(words), h), dtype=np.float32)
        states, kept = [None] * WINDOW, [None] * WINDOW
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            g = gates[words[:, t]]
            s = state @ u
            zr = _sigmoid(g[:, : 2 * h] + s[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(g[:, 2 * h :] + r * s[:, 2 * h :])
            new = c + z * (state - c)
            if keep:
                kept[t] = (state, z, r, c, s[:, 2 * h :])
            states[t] = state = new
        return states, kept

    def forward(self, x: np.ndarray, words: np.ndarray, keep: bool = False):
        """The logit of each window.  x: word x input with a row of padding at the end."""
        w = self.weights
        pad = len(x) - 1
        forth, kept_f = self._read(x, words, "f", keep)
        back, kept_b = self._read(x, words, "b", keep)
        direct_a, direct_o = x @ w["wa"], x @ w["wo"]
        e = np.stack([forth[t] @ w["af"] + back[t] @ w["ab"] for t in range(WINDOW)], axis=1) + direct_a[words]
        e[words == pad] = -1e9
        e -= e.max(axis=1, keepdims=True)
        alpha = np.exp(e)
        alpha /= alpha.sum(axis=1, keepdims=True)
        value = np.stack([forth[t] @ w["of"] + back[t] @ w["ob"] for t in range(WINDOW)], axis=1) + direct_o[words]
        logit = (alpha * value).sum(axis=1) + w["bias"][0]
        return (logit, alpha, value, forth, back, kept_f, kept_b) if keep else logit

    def gradients(self, x: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of all weights, and under "x" (window x place x input) of the inputs."""
        w, h = self.weights, HIDDEN
        logit, alpha, value, forth, back, kept_f, kept_b = self.forward(x, words, keep=True)
        d_logit = ((_sigmoid(logit) - y) * weight).astype(np.float32)
        d_value = alpha * d_logit[:, None]
        d_e = alpha * (value - (alpha * value).sum(axis=1, keepdims=True)) * d_logit[:, None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["bias"][0] = d_logit.sum()
        inside = x[words]
        g["wa"] = np.einsum("bt,bti->i", d_e, inside)
        g["wo"] = np.einsum("bt,bti->i", d_value, inside)
        d_x = d_e[:, :, None] * w["wa"] + d_value[:, :, None] * w["wo"]
        for d, states, kept in (("f", forth, kept_f), ("b", back, kept_b)):
            u = w["U" + d]
            d_state = np.zeros((len(words), h), dtype=np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == "f" else range(WINDOW):
                state, z, r, c, s = kept[t]
                g["a" + d] += d_e[:, t] @ states[t]
                g["o" + d] += d_value[:, t] @ states[t]
                d_new = d_state + d_e[:, t, None] * w["a" + d] + d_value[:, t, None] * w["o" + d]
                d_c = d_new * (1 - z) * (1 - c * c)
                d_z = d_new * (state - c) * z * (1 - z)
                d_r = d_c * s * r * (1 - r)
                d_gates = np.concatenate((d_z, d_r, d_c), axis=1)
                g["W" + d] += inside[:, t].T @ d_gates
                d_x[:, t] += d_gates @ w["W" + d].T
                d_s = np.concatenate((d_z, d_r, d_c * r), axis=1)
                g["U" + d] += state.T @ d_s
                d_state = d_new * z + d_s @ u.T
        g["x"] = d_x
        return g


@dataclass
class Sample:
    """Words of the training documents: their fixed inputs, and which kind of word each is; triples and begin: of the kinds of words."""

    x: np.ndarray
    kind: np.ndarray
    triples: np.ndarray
    begin: np.ndarray

    def _letters(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the distinct kinds each word is, and these kinds' triples and where each begins among them."""
        used, which = np.unique(kinds, return_inverse=True)
        sizes = np.diff(np.append(self.begin, len(self.triples)))[used]
        begin = np.cumsum(sizes) - sizes
        return which, self.triples[np.arange(sizes.sum()) + np.repeat(self.begin[used] - begin, sizes)], begin

    def batch(self, filters: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of the words of some windows (with padding at the end), and the windows over them."""
        there = words < len(self.x)
        flat = words[there]
        x = np.zeros((len(flat) + 1, INPUTS), dtype=np.float32)
        x[:-1, :FIXED] = self.x[flat]
        which, triples, begin = self._letters(self.kind[flat])
        x[:-1, FIXED:] = read_characters(filters, triples, begin)[which]
        local = np.full(words.shape, len(flat))
        local[there] = np.arange(len(flat))
        return x, local

    def filter_gradients(self, d_x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """triple x CHARS, from the gradients of the inputs of those windows."""
        there = words < len(self.x)
        which, triples, begin = self._letters(self.kind[words[there]])
        by_kind = np.zeros((len(begin), CHARS), dtype=np.float32)
        np.add.at(by_kind, which, d_x[there][:, FIXED:])
        sizes = np.diff(np.append(begin, len(triples)))
        by_kind /= sizes[:, None]
        of = np.repeat(np.arange(len(sizes)), sizes)
        return np.stack([np.bincount(triples, weights=by_kind[of, c], minlength=1 << TRIPLE_BITS) for c in range(CHARS)], axis=1).astype(np.float32)


def train(sample: Sample, words: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam on windows with labels y."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    known = net.weights | {"filters": net.filters}
    m = {k: np.zeros_like(v) for k, v in known.items()}
    v = {k: np.zeros_like(x) for k, x in known.items()}
    steps = max(1, -(-len(words) // batch))
    epochs = max(epochs, min(60, 150 // steps))
    t = 0
    for epoch in range(epochs):
        order = r.permutation(len(words))
        for k in range(steps):
            part = order[k * batch : (k + 1) * batch]
            t += 1
            now = rate * (1 - epoch / epochs)
            scale = weight[part] / weight[part].sum()
            x, local = sample.batch(net.filters, words[part])
            found = net.gradients(x, local, y[part], scale)
            found["filters"] = sample.filter_gradients(found.pop("x"), words[part])
            for key, g in found.items():
                g = np.clip(g, -1, 1)
                m[key] = 0.9 * m[key] + 0.1 * g
                v[key] = 0.99 * v[key] + 0.01 * g * g
                step = now * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.99**t)) + 1e-6)
                if key == "filters":
                    # decayed: triples that few words have stay near nothing
                    net.filters = (net.filters * (1 - FILTER_DECAY * now) - FILTER_RATE * step).astype(np.float32)
                else:
                    net.weights[key] = (net.weights[key] - step).astype(np.float32)
    return net


#: Share of a filter that each step takes back, times the learning rate, and the share of that rate by which filters learn.  Faster ones learn the
#: sample by heart.
FILTER_DECAY, FILTER_RATE = 2.0, 0.1


@dataclass
class Model:
    table: np.ndarray | None
    network: Network | None
    slope: float
    offset: float

    def scores(self, run: Run) -> np.ndarray:
        """The probability of each row of a run (in lower case)."""
        logit = np.full(run.rows, -np.inf)
        if self.network is not None:
            places, owner = word_hashes(run)
            if len(owner):
                x = np.concatenate((fixed_inputs(self.table, places), read_characters(self.network.filters, *word_triples(run))), axis=1)
                worst = document_logits(self.network, x, np.bincount(owner, minlength=run.rows))
                logit = worst
        z = np.clip(np.where(np.isfinite(logit), self.slope * np.clip(logit, -1e6, 1e6) + self.offset, -LARGEST if self.network is not None else self.offset), -LARGEST, LARGEST)
        return 1 / (1 + np.exp(-z))


#: Windows that are read side by side.
STEP = 2048
#: Scores are within the logistic function of plus and minus this.
LARGEST = 30


def document_logits(net: Network, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The largest logit among each document's windows; -inf without words."""
    words, owner = window_words(counts)
    out = np.full(len(counts), -np.inf)
    for at in range(0, len(words), STEP):
        part = words[at : at + STEP]
        there = part < len(x)
        low, high = int(part[0, 0]), int(part[there].max()) + 1  # windows are in the order of the words
        own = np.zeros((high - low + 1, x.shape[1]), dtype=np.float32)
        own[:-1] = x[low:high]
        np.maximum.at(out, owner[at : at + STEP], net.forward(own, np.where(there, part - low, high - low)))
    return out


def fit_texts(texts: list[str], toxic: np.ndarray, seed: int = 5) -> Model:
    """Train on labelled texts."""
    toxic = np.asarray(toxic).astype(int)
    if len(set(toxic.tolist())) < 2:
        share = (toxic.sum() + 0.5) / (len(toxic) + 1)
        share = 0.01 if not len(toxic) else share
        return Model(None, None, 1.0, float(np.log(share / (1 - share))))
    r = np.random.default_rng(seed)
    places: list[np.ndarray] = []
    triples, begins, values = [], [], []
    before = 0
    for run in runs(pa.array(texts, pa.large_string()), lower=True):
        found, owner = word_hashes(run)
        some, begin = word_triples(run)
        triples.append(some)
        begins.append(begin + before)
        before += len(some)
        first, last, _ = borders(run, letters_and_digits())
        values.append(spans(run.data, first, last) if len(first) else np.empty(0, dtype=np.uint64))
        cuts = np.cumsum(np.bincount(owner, minlength=run.rows))
        places += np.split(found.astype(np.int32), cuts[:-1], axis=1)
    half = r.permutation(len(texts)) % 2
    tables = [log_odds([p for p, h in zip(places, half, strict=True) if h != k], toxic[half != k]) for k in (0, 1)]
    each = [fixed_inputs(tables[h], p) for p, h in zip(places, half.tolist(), strict=True)]
    # the characters of each different word once
    _, first, kind = np.unique(np.concatenate(values), return_index=True, return_inverse=True)
    begin = np.concatenate(begins)
    sizes = np.diff(np.append(begin, before))[first]
    ends = np.cumsum(sizes)
    letters = np.concatenate(triples)[np.arange(sizes.sum()) + np.repeat(begin[first] - (ends - sizes), sizes)]
    xs, words, y, weight = [], [], [], []
    at = 0
    for x, label in zip(each, toxic.tolist(), strict=True):
        if not len(x):
            continue
        own, _ = window_words(np.array([len(x)]))
        suspicion = np.concatenate((x[:, :-1].sum(axis=1), [0.0]))[own].max(axis=1)
        order = np.argsort(-suspicion, kind="stable")
        some = order[:1] if label else np.unique(np.concatenate((order[:2], r.integers(0, len(own), 2))))
        xs.append(x)
        words.append(np.where(own[some] < len(x), own[some] + at, -1))
        y += [label] * len(some)
        weight += [1.0 / len(some)] * len(some)
        at += len(x)
    sample = Sample(np.concatenate(xs), kind.astype(np.int32), letters, ends - sizes)
    index = np.concatenate(words)
    index[index < 0] = len(sample.x)
    y, weight = np.array(y, dtype=np.float32), np.array(weight, dtype=np.float32)
    for label in (0, 1):
        weight[y == label] *= 0.5 / weight[y == label].sum()
    net = train(sample, index, y, weight / weight.mean(), seed=seed)
    counts = np.array([len(e) for e in each])
    whole = np.concatenate((sample.x, read_characters(net.filters, sample.triples, sample.begin)[sample.kind]), axis=1)
    logit = np.clip(document_logits(net, whole, counts), -50, 50)
    slope, offset = _scale(logit, toxic)
    return Model(log_odds(places, toxic), net, slope, offset)


def _scale(logit: np.ndarray, y: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Logistic fit of the labels on the logits of the worst windows, both classes of equal weight."""
    centre, width = logit.mean(), max(logit.std(), 1e-6)
    z = (logit - centre) / width
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(steps):
        error = weight * (_sigmoid(a * z + b) - y)
        a -= 2.0 * ((error * z).sum() + 1e-3 * a)
        b -= 2.0 * error.sum()
    return float(a / width), float(b - a * centre / width)


def fit(docs: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE, most_bytes: int = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a sample of the labelled documents.  where: a condition on the columns doc_id and label of the labels."""
    known = own_columns(labels, {"doc_id": id_col, "label": label_col}).where("doc_id IS NOT NULL AND label IN (0, 1)")
    if where is not None:
        known = known.where(where)
    n = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # as many as the sample may hold of each class, the rest of a scarce class goes to the other one
    toxic = min(n.get(1, 0), max(sample // 2, sample - n.get(0, 0)))
    wanted = {1: toxic, 0: min(n.get(0, 0), sample - toxic)}
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    least = [int((1 << 30) * min(1.0, wanted[y] / max(n.get(y, 0), 1))) for y in (0, 1)]
    chosen = known.where(spot < F.when(F.col("label") == 1, least[1]).otherwise(least[0])).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = chosen.withColumn("spot", spot).orderBy("spot", "doc_id").limit(2 * sample)
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    # about ``sample`` labels, whatever the size of the input: bounded, so they may be broadcast.  One text for each id leaves a task
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "spot").agg(F.min("text").alias("text"))
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("spot", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most 2 * sample rows
    found = texts.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") <= most_bytes).select("doc_id", "text", "label").collect()
    found.sort(key=lambda row: (row["doc_id"], row["text"] or ""))  # training does not depend on Spark's order
    return fit_texts([row["text"] or "" for row in found], np.array([row["label"] for row in found]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, predicted (1 if score >= 0.5)."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = np.concatenate([np.empty(0), *(known.scores(piece) for piece in runs(batch.column("text"), lower=True))])
            arrays = [batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
