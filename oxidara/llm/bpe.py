"""Byte-pair encoding and decoding by a segment tree over adjacent pair ranks.

A word of n symbols has n-1 adjacent pairs.  The leaves of a segment tree hold the merge rank of
each pair joined with its position, so the root is the lowest rank and, among equals, the leftmost
place.  A merge changes three leaves (the merged pair, the pair before, the pair swallowed), each
a point update of log2(n) nodes; the loop ends when the root holds no mergeable pair.

Many words advance together: a batch is a matrix with one tree per row, and each round takes the
root of every row that still has a mergeable pair.  Rows never influence each other, so the result
is that of the one-word algorithm.  Words are encoded once and remembered in a cache of bounded
size; the cache changes speed only.

Rows of ``encode_frame``: null text counts as empty and gives no ids.  Texts are never cut.  Rows that repeat an id stay rows of
their own, an empty table gives no rows, other columns are ignored whatever their names.
Special strings of the vocabulary found inside a text become their own id, as the tokenizers
library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from oxidara.llm.rows import own_columns

#: Leaves of pairs that cannot merge.
NONE = np.int64(1) << 62
#: Words remembered by one Python worker; beyond it the memory starts afresh.
CACHE_WORDS = 1_200_000
#: Characters tokenized at a time inside a task; texts are never split, a longer one goes alone.
CHUNK_CHARS = 3_000_000
#: Cells of the tree matrix that are worked on at a time.
TREE_CELLS = 1 << 17

# White space of the pre-tokenizer's \s, as the Unicode property White_Space has it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The split patterns of the two public vocabularies.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: First letters of keys; texts that hold them themselves go the plain way.
RAW, SPECIAL = "\1", "\2"
#: Characters that Python's split() takes for white space, but the vocabularies' \s does not, and SPECIAL.
NOT_SPACE = re.compile("[\x1c-\x1f\2]")
#: Characters for which a text is not cut at every space and line feed: other white space and the first letters of keys.
UNEASY = re.compile("[\1\2\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def uneasy(text: str) -> bool:
    """If white space adjoins white space, stands at an end or is of a rare kind."""
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or UNEASY.search(text) is not None


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + extra)
    return [letters[b] for b in range(256)]


def lower_by_character(text: str) -> str:
    """Lower case of each character alone: a capital sigma is not sensitive to its place."""
    return text.replace("Σ", "σ").lower()


class Vocabulary:
    """A byte-level BPE vocabulary read from a ``tokenizer.json`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        self.words_only = bool(self.suffix)
        self.has_decoder = spec["decoder"] is not None
        letters = byte_letters()
        self.byte_ids = np.array([self.ids[c] for c in letters], dtype=np.int64)
        self.last_ids = np.array([self.ids[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = 1 + max(max(self.ids.values()), *self.special.values())
        keys = np.array([self.ids[a] * self.size + self.ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks, self.made = keys[order], order.astype(np.int64), made
        self.token_text = [""] * self.size
        for text, i in (self.ids | self.special).items():
            self.token_text[i] = text
        to_byte = {c: b for b, c in enumerate(letters)}
        self.token_bytes = [b""] * self.size
        for text, i in self.ids.items():
            body = text[: -len(self.suffix)] if self.suffix and text.endswith(self.suffix) else text
            self.token_bytes[i] = bytes(to_byte[c] for c in body)
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        self.pattern = regex.compile(WORD_PATTERN if self.words_only else BYTE_PATTERN)
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.cache = WordCache(self)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, NONE where a pair has no merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def normalise(self, text: str) -> str:
        return lower_by_character(unicodedata.normalize("NFC", text)) if self.words_only else text

    def words(self, text: str) -> list[str]:
        """Keys of the words of a text in order; ``pieces`` turns a key into what is to be merged.

        Words are cut where the split pattern surely cuts, which is cheap and lets repeated words
        be encoded once.  A key is a word (after a space, where spaces count), a line feed, MARK
        and RAW with a word that has no space before it, or MARK and SPECIAL with a special string."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self._words(text)
        found: list[str] = []
        for part in self.special_pattern.split(text):
            found += [SPECIAL + part] if part in self.special else self._words(part)
        return found

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        if self.words_only:
            text = self.normalise(text)
            return text.split(" ") if NOT_SPACE.search(text) else text.split()
        if uneasy(text):
            return [RAW + piece for piece in self.pattern.findall(text)]
        return (RAW + text.replace("\n", " \n " + RAW)).split(" ")

    def pieces(self, key: str) -> list[bytes]:
        """What the merges work on for a key: the pieces of the split pattern in UTF-8."""
        if not self.words_only:
            key = key[1:] if key[0] == RAW else key if key == "\n" else " " + key
        return [piece.encode("utf-8", "surrogatepass") for piece in self.pattern.findall(key)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each word has."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        counts = np.zeros(len(words), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        classes = np.ceil(np.log2(np.maximum(lengths - 1, 1))).astype(np.int64)
        for k in np.unique(classes[lengths > 0]):
            rows = np.flatnonzero((classes == k) & (lengths > 0))
            step = max(1, TREE_CELLS >> int(k + 1))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                ids, n = self._merge(flat, starts[part], lengths[part], int(k))
                counts[part] = n
                parts.append((part, ids))
        out = np.empty(int(counts.sum()), dtype=np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts)))[:-1]
        for part, ids in parts:
            out[ragged(offsets[part], counts[part])] = ids
        return out, counts

    def _merge(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Encode words of at most 2**k + 1 symbols: one segment tree of 2**k leaves for each.

        The last two columns of a row of symbols stay empty, so links beyond the word lead there."""
        n, leaves = len(starts), 1 << k
        wide, width = leaves + 3, 2 * leaves
        inside = np.arange(wide)[None, :] < lengths[:, None]
        symbol = np.full((n, wide), -1, dtype=np.int64)
        symbol[inside] = self.byte_ids[flat[ragged(starts, lengths)]]
        symbol[np.arange(n), lengths - 1] = self.last_ids[flat[starts + lengths - 1]]
        tree = np.full((n, width), NONE, dtype=np.int64)
        r, c = np.nonzero(inside[:, 1 : leaves + 1])
        rank = self.ranks(symbol[r, c], symbol[r, c + 1])
        tree[r, leaves + c] = np.where(rank < NONE, (rank << k) | c, NONE)
        for level in range(k - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        after = np.tile(np.arange(1, wide + 1), n)  # links to the next and the previous living symbol
        before = np.tile(np.arange(-1, wide - 1), n)
        symbol, tree = symbol.ravel(), tree.ravel()
        rows = np.flatnonzero(tree[1::width] < NONE)
        while len(rows):
            base, top = rows * wide, rows * width
            root = tree[top + 1]
            at, made = root & (leaves - 1), self.made[root >> k]
            gone = after[base + at]
            far = after[base + gone]
            back = before[base + at]
            has = back >= 0
            back = np.where(has, back, at)
            symbol[base + at] = made
            symbol[base + gone] = -1
            after[base + at] = far
            before[base + far] = at
            ahead = symbol[base + far]
            new, behind = np.split(self.ranks(np.concatenate((made, symbol[base + back])), np.concatenate((ahead, made))), 2)
            own = np.where((ahead >= 0) & (new < NONE), (new << k) | at, NONE)
            leaf = top + leaves
            tree[leaf + back] = np.where(behind < NONE, (behind << k) | back, NONE)
            tree[leaf + np.minimum(gone, leaves - 1)] = NONE
            tree[leaf + at] = own
            for node in (gone, back, at):
                node = leaves + np.minimum(node, leaves - 1)
                for _ in range(k):
                    less = np.minimum(tree[top + node], tree[top + (node ^ 1)])
                    node = node >> 1
                    tree[top + node] = less
            rows = rows[tree[top + 1] < NONE]
        alive = symbol >= 0
        return symbol[alive], alive.reshape(n, wide).sum(axis=1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, as the library's decode(ids, skip_special_tokens=False).

        Without a decoder in the vocabulary, tokens are joined by one space; else bytes are joined
        and malformed sequences are replaced."""
        table = self.token_bytes if self.has_decoder else self.token_text
        if self.has_decoder:
            return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()
        return " ".join(map(table.__getitem__, ids.tolist())).encode()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for counts[0] places, then the same of the next ones."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


class WordCache:
    """Ids of words met before, in two flat arrays; it empties itself when it is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.empty(0, dtype=np.int32)
        self.starts = np.empty(0, dtype=np.int64)
        self.counts = np.empty(0, dtype=np.int64)

    def __getstate__(self) -> None:
        raise TypeError("a cache stays in its worker")

    def slots_of(self, words: list[str]) -> np.ndarray:
        """The slot of each word."""
        found = np.fromiter(map(self.slots.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        fresh = list(dict.fromkeys([words[i] for i in missing]))
        if len(self.slots) + len(fresh) > CACHE_WORDS and self.slots:
            self.clear()
            return self.slots_of(words)
        v = self.vocabulary
        pieces = [[] if w[:1] == SPECIAL else v.pieces(w) for w in fresh]
        known = {piece: i for i, piece in enumerate(dict.fromkeys(chain.from_iterable(pieces)))}
        each, sizes = v.encode_words(list(known))
        n_pieces = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        of = np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), dtype=np.int64, count=int(n_pieces.sum()))
        counts = sizes[of]
        ids = each[ragged((np.cumsum(sizes) - sizes)[of], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        ends = total[np.cumsum(n_pieces)]
        starts = np.concatenate(([0], ends[:-1]))
        counts = ends - starts
        for i, w in enumerate(fresh):
            if w[:1] == SPECIAL and w[1:] in v.special:
                starts[i], counts[i] = len(ids), 1
                ids = np.append(ids, v.special[w[1:]])
        first = len(self.starts)
        self.slots.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        self.starts = np.concatenate((self.starts, len(self.ids) + starts))
        self.counts = np.concatenate((self.counts, counts))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        found[missing] = np.fromiter(map(self.slots.__getitem__, [words[i] for i in missing]), dtype=np.int64, count=len(missing))
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in each Python process."""
    return Vocabulary(path)


def encode_texts(v: Vocabulary, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: the index of the first, their ids one after another, and the end of each text's ids.

    A run holds about CHUNK_CHARS characters; every text is whole in one run."""
    at = 0
    while at < len(texts):
        words: list[str] = []
        ends: list[int] = []
        first, chars = at, 0
        while at < len(texts) and (at == first or chars + len(texts[at] or "") <= CHUNK_CHARS):
            text = texts[at] or ""
            if text:
                words += v.words(text)
            ends.append(len(words))
            chars += len(text)
            at += 1
        if not words:
            yield first, np.empty(0, dtype=np.int32), np.zeros(len(ends), dtype=np.int64)
            continue
        slot = v.cache.slots_of(words)
        counts = v.cache.counts[slot]
        ids = v.cache.ids[ragged(v.cache.starts[slot], counts)]
        reached = np.concatenate(([0], np.cumsum(counts)))
        yield first, ids, reached[np.array(ends, dtype=np.int64)]


def ids_of(v: Vocabulary, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text."""
    for _, ids, ends in encode_texts(v, texts):
        begin = 0
        for end in ends.tolist():
            yield ids[begin:end]
            begin = end


def encode_frame(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: id_col, n_tokens, ids_sha256, decoded_sha256 [, ids, decoded].

    The hashes are lowercase hexadecimal: of the ids as little-endian unsigned 32-bit integers, and
    of the decoded text in UTF-8.  One row for each row of docs, repeated ids included."""
    rows = own_columns(docs, {"doc_id": id_col, "text": text_col})
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n, of_ids, of_text, kept, plain = [], [], [], [], []
            for ids in ids_of(v, texts):
                decoded = v.decode(ids)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                of_text.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    kept.append(ids)
                    plain.append(decoded.decode())
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(kept, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, schema)
