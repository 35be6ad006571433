"""Token counts by compiled finite-state transducers.

Two deterministic transducers, whose transitions are annotated with the number of outputs they
emit, count the tokens of a byte-level BPE vocabulary with an end-of-word mark:

* the word transducer reads character classes and emits the starts of pieces (the split pattern);
  it has six states.  Texts are laid end to end and cut into chunks of equal length.  Each chunk is
  run from all six states at once, which gives its state map; the maps compose associatively, so
  a parallel prefix scan (log2 of the number of chunks rounds) yields the true state at the begin of each chunk, and one more run
  of all chunks side by side emits.  A text thus never has to be read from its begin by one loop.
* the merge transducer reads the bytes of a piece and emits token counts.  It is compiled from the
  vocabulary, state by state as they are first reached.  It rests on a property of BPE: a
  sequence of tokens is the encoding of its string exactly if each neighbouring pair is the
  encoding of that pair's string; hence the last token of each prefix is unique, and
  tokens(prefix) = tokens(prefix before its last token) + 1.  A state holds the longest suffix that
  can still begin a token, with the last tokens and relative counts at the places in it; a
  transition's annotation is the change of the count, so annotations of a piece add up to its tokens.

Rows: null and empty texts have 0 bytes and 0 tokens; texts are never cut short; special strings inside
a text count as one token each, the library's default; one row for each row of docs, repeated ids
included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oxidara.llm.bpe import CHUNK_CHARS, SPACE, Vocabulary, vocabulary
from oxidara.llm.rows import own_columns

#: Characters of a chunk whose state maps are composed.
CHUNK = 512
#: Transitions, pair answers and piece counts that a Python worker keeps; beyond it they are compiled anew.
MOST_STATES, MOST_PIECES = 400_000, 600_000

# Character classes and states of the word transducer.
GAP, LETTER, NUMBER, SIGN, QUOTE, ONE, TWO, E, L = range(9)  # ONE: s t m d; TWO: r v
FRESH, IN_WORD, IN_SIGNS, QUOTED, QUOTED_TWO, QUOTED_L = range(6)
#: Emissions: a piece starts here; a piece starts at the character before.
HERE, BEFORE = 1, 2


def word_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission for each state and class of the pattern
    's|'t|'re|'ve|'m|'ll|'d|letters+|number|signs+ on lower-case text."""
    to, out = np.zeros((6, 9), dtype=np.int8), np.zeros((6, 9), dtype=np.int8)
    letters = (LETTER, ONE, TWO, E, L)
    for state in range(6):
        for c in range(9):
            if c == GAP:
                to[state, c] = FRESH
            elif c == NUMBER:
                to[state, c], out[state, c] = FRESH, HERE
            elif c in letters:
                to[state, c], out[state, c] = IN_WORD, 0 if state == IN_WORD else HERE
            else:
                signs = state in (IN_SIGNS, QUOTED)
                to[state, c] = IN_SIGNS if signs or c == SIGN else QUOTED
                out[state, c] = 0 if signs else HERE
    for c, state in ((ONE, FRESH), (TWO, QUOTED_TWO), (L, QUOTED_L)):
        to[QUOTED, c], out[QUOTED, c] = state, 0
    # after 're, 've, 'll the piece is whole; else the letter before began a word of its own
    for state, whole in ((QUOTED_TWO, E), (QUOTED_L, L)):
        for c in range(9):
            if c == whole:
                to[state, c], out[state, c] = FRESH, 0
            elif c in letters:
                to[state, c], out[state, c] = IN_WORD, BEFORE
            else:
                out[state, c] |= BEFORE
    return to, out


TO, OUT = word_transducer()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(i))[0], SIGN) for i in range(0x110000)), dtype=np.int8, count=0x110000)
    import regex

    blank = regex.compile(f"[{SPACE}]")
    for i in range(0x3001):
        if blank.match(chr(i)):
            table[i] = GAP
    for group, c in (("'", QUOTE), ("stmd", ONE), ("rv", TWO), ("e", E), ("l", L)):
        table[[ord(x) for x in group]] = c
    return table


def piece_starts(kinds: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """True where a piece starts; kinds: classes of a stream of characters that begins and ends with GAP."""
    n = len(kinds)
    chunks = -(-n // chunk)
    grid = np.zeros(chunks * chunk, dtype=np.int8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(chunks, chunk).T)
    to = TO.ravel()
    # state maps of all chunks: where each of the six states leads
    state = np.broadcast_to(np.arange(6, dtype=np.int16)[:, None], (6, chunks)).copy()
    for column in columns:
        state = to[state * 9 + column].astype(np.int16)
    # prefix scan: after it, column i holds the composition of the maps of chunks 0..i
    maps, step = state.T.copy(), 1
    while step < chunks:
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        maps = np.concatenate((maps[:step], later))
        step *= 2
    state = np.concatenate(([FRESH], maps[:-1, FRESH])).astype(np.int16)
    emitted = np.empty((chunk, chunks), dtype=np.int8)
    out = OUT.ravel()
    for i, column in enumerate(columns):
        at = state * 9 + column
        emitted[i] = out[at]
        state = to[at].astype(np.int16)
    emitted = emitted.T.ravel()[:n]
    starts = (emitted & HERE) > 0
    starts[:-1] |= (emitted[1:] & BEFORE) > 0
    return starts


class MergeTransducer:
    """Counts the tokens of pieces; transitions are compiled when they are first needed."""

    def __init__(self, v: Vocabulary):
        self.tokens: dict[str, int] = {}
        for text, i in v.ids.items():
            ends = text.endswith(v.suffix)
            body = v.token_bytes[i]
            if body:
                self.tokens[body[:-1].decode("latin1") + chr(body[-1] + 256 * ends)] = i
        self.heads = {token[:k] for token in self.tokens for k in range(1, len(token) + 1)}
        self.spelling = {i: token for token, i in self.tokens.items()}
        size = v.size
        self.merge = {int(k): (int(r), int(v.made[r])) for k, r in zip(v.pair_keys, v.pair_ranks, strict=True)}
        self.size = size
        self.clear()

    def clear(self) -> None:
        #: (state, symbol) -> (next state, change of the token count)
        self.arcs: dict[int, tuple[int, int]] = {}
        self.states: list[tuple[str, tuple[int, ...], tuple[int, ...]]] = []
        self.numbers: dict[tuple, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[bytes, int] = {}
        self._number(("", (-1,), (0,)))

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _merged(self, text: str) -> list[int]:
        ids = [self.tokens[c] for c in text]
        while len(ids) > 1:
            ranked = [(self.merge[key], i) for i in range(len(ids) - 1) if (key := ids[i] * self.size + ids[i + 1]) in self.merge]
            if not ranked:
                break
            (_, made), i = min(ranked)
            ids[i : i + 2] = [made]
        return ids

    def _fit(self, left: int, right: int) -> bool:
        """If two tokens stay apart and whole; left is -1 at the begin of a piece."""
        if (left, right) not in self.pairs:
            one = [right] if left < 0 else [left, right]
            self.pairs[left, right] = self._merged("".join(self.spelling[i] for i in one)) == one
        return self.pairs[left, right]

    def _arc(self, state: int, symbol: int) -> tuple[int, int]:
        # lasts[k], counts[k]: last token and relative count k symbols before the end of the suffix
        suffix, lasts, counts = self.states[state]
        text = suffix + chr(symbol)
        for k in range(len(text), 0, -1):
            token = self.tokens.get(text[-k:])
            if token is not None and self._fit(lasts[k - 1], token):
                break
        else:
            raise ValueError(f"no token ends {text!r}")
        change = counts[k - 1] + 1
        keep = next((j for j in range(len(text), 0, -1) if text[-j:] in self.heads), 0)
        new = (text[len(text) - keep :], (token, *lasts[:keep]), (0, *(c - change for c in counts[:keep])))
        self.arcs[state << 9 | symbol] = arc = (self._number(new), change)
        return arc

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: the sum of the annotations along its path."""
        state = total = 0
        get, last = self.arcs.get, len(piece) - 1
        for i, b in enumerate(piece):
            symbol = b if i < last else b | 256
            arc = get(state << 9 | symbol)
            if arc is None:
                arc = self._arc(state, symbol)
            state = arc[0]
            total += arc[1]
        return total

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece, pieces met before from memory."""
        if len(self.states) > MOST_STATES or len(self.pieces) > MOST_PIECES:
            self.clear()
        known, count = self.pieces, self.count
        found = np.fromiter(map(known.get, pieces, repeat(-1)), dtype=np.int64, count=len(pieces))
        for i in np.flatnonzero(found < 0).tolist():
            n = known.get(pieces[i], -1)
            if n < 0:
                known[pieces[i]] = n = count(pieces[i])
            found[i] = n
        return found


@lru_cache(maxsize=2)
def merge_transducer(path: str) -> MergeTransducer:
    return MergeTransducer(vocabulary(path))


def count_texts(path: str, texts: list[str | None], chunk: int = CHUNK) -> list[int]:
    """Tokens of each text under a vocabulary of words (with an end-of-word mark)."""
    v, machine = vocabulary(path), merge_transducer(path)
    if not v.words_only:
        raise ValueError("the word transducer is that of vocabularies with an end-of-word mark")
    totals = [0] * len(texts)
    at = 0
    while at < len(texts):
        parts: list[str] = []
        owner: list[int] = []
        chars, first = 0, at
        while at < len(texts) and (at == first or chars + len(texts[at] or "") <= CHUNK_CHARS):
            text = texts[at] or ""
            chars += len(text)
            found = [text]
            if v.special_pattern is not None and any(s in text for s in v.special):
                found = v.special_pattern.split(text)
                totals[at] += sum(part in v.special for part in found)
                found = [part for part in found if part not in v.special]
            parts += [v.normalise(part) for part in found]
            owner += [at] * len(found)
            at += 1
        # a line feed stands between parts, and no part can be told from its neighbours without it
        stream = np.frombuffer(("\n" + "\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = classes()[stream]
        starts = piece_starts(kinds, chunk)
        solid = kinds != GAP
        begins = np.flatnonzero(starts[solid])
        kept = stream[solid]
        if not len(kept):
            continue
        size = 1 + (kept > 0x7F).astype(np.int64) + (kept > 0x7FF) + (kept > 0xFFFF)
        place = np.concatenate(([0], np.cumsum(size)))
        flat = kept.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        offsets = np.append(place[begins], place[-1]).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        tokens = machine.counts(pieces.to_pylist())
        lengths = np.fromiter(chain((1,), (len(p) + 1 for p in parts)), dtype=np.int64, count=len(parts) + 1)
        ends = np.cumsum(lengths)  # where each part begins in the stream, and the last one ends
        part = np.searchsorted(ends, np.flatnonzero(starts), side="right") - 1
        sums = np.bincount(part, weights=tokens, minlength=len(parts)).astype(np.int64)
        for i, n in zip(owner, sums.tolist(), strict=True):
            totals[i] += n
    return totals


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            text = batch.column("text")
            tokens = pa.array(count_texts(path, text.to_pylist()), pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            arrays = [batch.column("doc_id"), n_bytes, tokens, pc.greater(tokens, limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
