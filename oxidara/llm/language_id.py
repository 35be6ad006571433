"""Language identification as inference in a mixture of languages.

Every language has a model of character n-grams (three bytes of lower-case text, word borders included), counted over all documents
that may be learned from.  A document is a mixture: each of its words comes from one language, with the likelihood that
the language's n-grams give the word.  Expectation-maximisation estimates the proportions of all languages.  Then
the set of languages is selected by penalised likelihood: the sets nested by proportion are
compared, and a language more must raise the log-likelihood by PENALTY * log(words).  EM runs until the distance to the largest likelihood, which
the gradient bounds, is below TOLERANCE; by the same bound a set that could not gain enough even with all languages is not fitted.  The prediction is the language with the largest proportion within the selected set.

Results for unusual rows: a null text, or one without a letter, is ``und`` with score 0 and no languages; rows with a
null language are not learned from; if there is nothing to learn from, everything is ``und``; repeated ids stay rows
of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxidara.llm.rows import and_fields, own_columns
from oxidara.llm.words import Run, borders, runs

UNDETERMINED = "und"
#: N-grams are told apart by a hash of so many bits.
GRAM_BITS = 18
#: What a language more must bring, times the logarithm of the number of words.
PENALTY = 1.0
#: Steps at most, and how far from its largest value a log-likelihood may be.
STEPS, TOLERANCE = 400, 0.01
SMOOTHING = 0.1
#: A word counts at most exp(-MOST_APART) for a language, compared with its likeliest one.
MOST_APART = 40.0

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[128:] = True
_INSIDE[ord("a") : ord("z") + 1] = True


def _grams(run: Run, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-gram around each byte of each word, and where each word starts among them."""
    data = run.data
    inside = _INSIDE[data]
    before, after = np.zeros(len(data), dtype=np.uint32), np.zeros(len(data), dtype=np.uint32)
    before[1:], after[:-1] = data[:-1], data[1:]
    before[begin] = 0
    after[end - 1] = 0
    code = ((before << np.uint32(16)) | (data.astype(np.uint32) << np.uint32(8)) | after)[inside]
    code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)
    return code.astype(np.int64), np.cumsum(end - begin) - (end - begin)


@dataclass
class Model:
    languages: list[str]
    #: language x hashed n-gram
    log_p: np.ndarray


def fit(docs: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the n-grams of each language over all rows (those that ``where`` keeps)."""
    rows = own_columns(docs if where is None else docs.where(where), {"text": text_col, "lang": lang_col}).where("lang IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for piece in runs(batch.column("text"), lower=True):
                begin, end, owner = borders(piece, _INSIDE)
                if not len(begin):
                    continue
                code, _ = _grams(piece, begin, end)
                own = lang[piece.first : piece.first + piece.rows]
                names, number = np.unique(own.astype(str), return_inverse=True)
                of = np.repeat(number[owner], end - begin)
                found = np.bincount(of * (1 << GRAM_BITS) + code, minlength=len(names) << GRAM_BITS).reshape(len(names), -1)
                for name, counts in zip(names.tolist(), found, strict=True):
                    tables[name] = tables[name] + counts if name in tables else counts
        for name, counts in tables.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most 2**GRAM_BITS rows for each language
    languages = sorted(found["lang"].unique().tolist())
    table = np.zeros((len(languages), 1 << GRAM_BITS))
    for i, name in enumerate(languages):
        own = found[found["lang"] == name]
        table[i, own["gram"].to_numpy()] = own["n"].to_numpy()
    kinds = max(1, int((table.sum(axis=0) > 0).sum()))
    log_p = np.log((table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * (kinds + 1)))
    return Model(languages, log_p.astype(np.float32))


def _proportions(likelihood: np.ndarray, at: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM: language x document proportions, each document's log-likelihood, and a bound that no proportions exceed.

    likelihood: language x word; at: first word of each document; allowed: language x document.  A step multiplies each proportion by the
    mean over the words of likelihood over mixture; as the logarithm is concave, the largest of these factors bounds what is left to gain."""
    share = allowed / allowed.sum(axis=0)
    reached, bound = np.empty(len(at)), np.empty(len(at))
    active, words, begin = np.arange(len(at)), likelihood, at
    for step in range(STEPS):
        n = counts[active]
        own = np.repeat(np.arange(len(active)), n)
        mixed = (words * share[:, active][:, own]).sum(axis=0)
        factor = np.add.reduceat(words / mixed, begin, axis=1) / n
        reached[active] = np.add.reduceat(np.log(mixed), begin)
        left = n * np.log(np.maximum((factor * allowed[:, active]).max(axis=0), 1.0))
        bound[active] = reached[active] + left
        go = left > TOLERANCE
        if step + 1 == STEPS or not go.any():
            break
        now = share[:, active] * factor
        share[:, active[go]] = (now / now.sum(axis=0))[:, go]
        if not go.all():
            words, active = words[:, go[own]], active[go]
            begin = np.cumsum(counts[active]) - counts[active]
    return share, reached, bound


def mixtures(model: Model, run: Run) -> tuple[np.ndarray, np.ndarray]:
    """document x language proportions of the selected sets (zero outside), and the number of words."""
    k = len(model.languages)
    out = np.zeros((run.rows, k))
    begin, end, owner = borders(run, _INSIDE)
    n_words = np.bincount(owner, minlength=run.rows)
    if not len(begin) or not k:
        return out, n_words
    code, start = _grams(run, begin, end)
    score = np.stack([np.add.reduceat(model.log_p[i][code], start, dtype=np.float64) for i in range(k)])
    score -= score.max(axis=0)
    np.maximum(score, -MOST_APART, out=score)
    docs = np.flatnonzero(n_words)
    counts = n_words[docs]
    at = np.cumsum(counts) - counts
    likelihood = np.exp(score)
    share, _, full = _proportions(likelihood, at, counts, np.ones((k, len(docs))))
    order = np.argsort(-share, axis=0, kind="stable")
    alone = np.add.reduceat(score, at, axis=1)
    price = PENALTY * np.log(counts + 1.0)
    single = alone.argmax(axis=0)
    best = alone.max(axis=0)
    chosen = np.zeros_like(share)
    chosen[single, np.arange(len(docs))] = 1.0
    doubtful = np.flatnonzero(full - best > price)
    for size in range(2, k + 1):
        doubtful = doubtful[full[doubtful] - (size - 1) * price[doubtful] > best[doubtful]]
        if not len(doubtful):
            break
        allowed = np.zeros((k, len(doubtful)))
        np.put_along_axis(allowed, order[:size, doubtful], 1.0, axis=0)
        words = np.repeat(at[doubtful] - (np.cumsum(counts[doubtful]) - counts[doubtful]), counts[doubtful]) + np.arange(counts[doubtful].sum())
        own, reached, _ = _proportions(likelihood[:, words], np.cumsum(counts[doubtful]) - counts[doubtful], counts[doubtful], allowed)
        gain = reached - (size - 1) * price[doubtful]
        better = gain > best[doubtful]
        best[doubtful[better]] = gain[better]
        chosen[:, doubtful[better]] = own[:, better]
    out[docs] = chosen.T
    return out, n_words


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (its proportion), languages and shares of the selected set."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes x 2**GRAM_BITS for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            text = batch.column("text")
            letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            found = [mixtures(known, piece)[0] for piece in runs(text, lower=True)]
            share = np.concatenate(found) if found else np.zeros((0, len(known.languages)))
            share[~letter] = 0
            best = share.argmax(axis=1) if share.shape[1] else np.zeros(len(share), dtype=np.int64)
            score = share.max(axis=1, initial=0.0)
            best[score == 0] = -1
            doc, lang = np.nonzero(share)
            order = np.lexsort((lang, -share[doc, lang], doc))
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(share))))).astype(np.int32))
            languages = pa.ListArray.from_arrays(offsets, pa.array(names[lang[order]].tolist(), pa.string()))
            shares = pa.ListArray.from_arrays(offsets, pa.array(share[doc, lang][order]))
            arrays = [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score), languages, shares]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "languages", "shares"])

    return rows.mapInArrow(run, and_fields(rows.schema["doc_id"], "lang_pred string, score double, languages array<string>, shares array<double>"))
