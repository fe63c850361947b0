"""BPE encoding and decoding with a public vocabulary.

The tokenizer of the given file is followed exactly: special tokens in the raw
text stand alone, the rest is NFC-normalised, white space is folded, letters are
lower-cased one by one, words are cut by the file's pattern, and each word's
bytes are merged by rank, the last symbol carrying the end-of-word mark.

Merging works on all new words of a batch at once through a pair occurrence
index: every mergeable pair, named by its rank, maps to its positions in the
partition's symbols.  Active ranks are taken in ascending order; all places of a
rank are merged together, and the pairs that arise next to them join the lists
of their own ranks.  A token is only ever merged by ranks above the one that
made it (checked when the file is read), so this order is each word's own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words remembered per Python worker; beyond it the memory starts anew.
REMEMBERED = 200_000


def _byte_names() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {}, 256
    for b in range(256):
        if b in plain:
            names[b] = chr(b)
        else:
            names[b] = chr(extra)
            extra += 1
    return names


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, mark = model["vocab"], model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.names = [""] * size
        for name, i in [*ids.items(), *self.special.items()]:
            self.names[i] = name
        names = _byte_names()
        self.inner = np.array([ids.get(names[b], -1) for b in range(256)], np.int64)
        self.final = np.array([ids.get(names[b] + mark, -1) for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        born = np.full(size, -1, np.int64)
        born[self.made[::-1]] = rank[::-1]
        last = np.full(size, -1, np.int64)
        last[self.made] = rank
        if (last != born).any() or (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("a merge comes before one that makes its parts")
        self.shift = np.int64(size)
        keys = left * self.shift + right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.left, self.right = left, right

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        key = a * self.shift + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)


def merge_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, concatenated, and the words' offsets."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum(sizes)
    symbol = vocab.inner[raw]
    symbol[end[sizes > 0] - 1] = vocab.final[raw[end[sizes > 0] - 1]]
    word = np.repeat(np.arange(len(words)), sizes)
    if (symbol < 0).any():                       # bytes that the vocabulary lacks
        known = symbol >= 0
        symbol, word = symbol[known], word[known]
    n = len(symbol)
    after = np.arange(1, n + 1)
    if n:
        after[np.concatenate([word[1:] != word[:-1], [True]])] = -1
    before = np.full(n + 1, -1, np.int64)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    alive = np.ones(n, bool)

    index: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(places: np.ndarray) -> None:
        """Add pairs that start at ``places`` to the lists of their ranks."""
        r = vocab.ranks(symbol[places], symbol[after[places]])
        places, r = places[r >= 0], r[r >= 0]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        places, r = places[order], r[order]
        cut = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        for k, at in zip(r[cut].tolist(), np.split(places, cut[1:])):
            if k in index:
                index[k].append(at)
            else:
                index[k] = [at]
                heapq.heappush(active, k)

    note(np.flatnonzero(after >= 0))
    while active:
        k = heapq.heappop(active)
        lists = index.pop(k)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = vocab.left[k], vocab.right[k]
        nxt = after[at]
        ok = alive[at] & (symbol[at] == a) & (nxt >= 0)
        at, nxt = at[ok], nxt[ok]
        ok = symbol[nxt] == b
        at, nxt = at[ok], nxt[ok]
        if a == b and len(at) > 1:               # runs of one symbol: from the left
            at = np.sort(at)
            taken, keep = -1, np.zeros(len(at), bool)
            for i, (p, q) in enumerate(zip(at.tolist(), after[at].tolist())):
                if p != taken:
                    keep[i], taken = True, q
            at = at[keep]
            nxt = after[at]
        if not len(at):
            continue
        symbol[at] = vocab.made[k]
        alive[nxt] = False
        beyond = after[nxt]
        after[at] = beyond
        has = beyond >= 0
        before[beyond[has]] = at[has]
        prior = before[at]
        prior = prior[prior >= 0]
        # a neighbour that merged in this round is itself in ``at``
        prior = prior[alive[prior]]
        note(np.unique(np.concatenate([prior, at[has]])))
    counts = np.bincount(word[alive], minlength=len(words)) if n else np.zeros(len(words), int)
    return symbol[alive], np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Encodes texts; remembers the ids of words it has met."""

    def __init__(self, vocab: Vocabulary):
        import regex
        self.vocab = vocab
        self.cut = regex.compile(vocab.pattern).findall
        self.space = regex.compile(r"\s+")
        self.specials = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") \
            if vocab.special else None
        self.reset()

    def reset(self) -> None:
        """Forget all words; special tokens come first, with their own ids."""
        special = list(self.vocab.special.items())
        # an unknown word gets the next place as it is looked up
        self.place: dict[str, int] = defaultdict(count(len(special)).__next__)
        self.place.update({" " + name: i for i, (name, _) in enumerate(special)})
        self.ids = np.array([i for _, i in special], np.uint32)
        self.offs = np.arange(len(special) + 1)
        self.shown = [name for name, _ in special]

    def words(self, text: str) -> list[str]:
        if self.specials is None or not any(s in text for s in self.vocab.special):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.specials.split(text)):
            # a special token stands as a word with a leading blank, which no
            # word of the pattern can have
            out += [" " + part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.cut(self.space.sub(" ", text).lower())

    def learn(self) -> None:
        """Encode the words that were looked up and are not known yet."""
        fresh = list(islice(self.place, len(self.shown), None))
        if not fresh:
            return
        flat, offs = merge_words(self.vocab, [w.encode() for w in fresh])
        names = [self.vocab.names[i] for i in flat.tolist()]
        at = offs.tolist()
        self.shown += [" ".join(names[a:b]) for a, b in zip(at[:-1], at[1:])]
        self.offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
        self.ids = np.concatenate([self.ids, flat.astype(np.uint32)])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """(ids, decoded text) of each text.  Decoding without a decoder joins
        the tokens' names by blanks."""
        if len(self.place) > REMEMBERED:
            self.reset()
        place, words = self.place, self.words
        cut = [np.array([place[w] for w in words(t)], np.int64) for t in texts]
        self.learn()
        shown = self.shown
        for at in cut:
            start, size = self.offs[at], self.offs[at + 1] - self.offs[at]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            where = np.arange(total) + np.repeat(start - (ends - size), size)
            yield self.ids[where], " ".join([shown[i] for i in at[size > 0].tolist()])


_encoders: dict[str, Encoder] = {}


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path)
        if enc is None:
            enc = _encoders[path] = Encoder(Vocabulary(path))
        for batch in batches:
            for lo, part in _portions(batch.column(1)):
                n, h, d = [], [], []
                for ids, shown in enc.encode(part):
                    n.append(len(ids))
                    h.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    d.append(hashlib.sha256(shown.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), pa.array(n, pa.int64()),
                     pa.array(h), pa.array(d)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _portions(texts: pa.Array, limit: int = 1 << 24) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about ``limit`` bytes."""
    from .kernel import text_blocks
    for lo, hi, _, _ in text_blocks(texts, limit):
        yield lo, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoders.get(path)
        if enc is None:
            enc = _encoders[path] = Encoder(Vocabulary(path))
        for batch in batches:
            for lo, part in _portions(batch.column(1)):
                ids, shown = zip(*((i.astype(np.int64), s) for i, s in enc.encode(part)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(part)), pa.array(ids, pa.list_(pa.int64())),
                     pa.array(shown)], names=["doc_id", "ids", "decoded"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<long>, decoded string for every row.

    Null texts count as empty: no ids, an empty decoded text.  ``path`` names
    the tokenizer file on every machine.  Other columns are ignored; repeated
    rows give repeated results; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(_tokens(path), "doc_id long, ids array<long>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of
    :func:`encode`'s columns, made where the ids are, so that no id leaves its
    task."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .mapInArrow(_digests(path),
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
