"""Cross-tokenizer alignment by products of token-byte incidence matrices.

Two tokenizers cut the same bytes.  Side A is a byte-level BPE file and encodes a
blank and the text; side B is a sentence-piece model with byte fallback, which
adds the blank itself.  In the incidence matrix of a side, row i has a one in the
columns of the bytes of token i.  The matrices are compressed sparse rows built
by hand over a block of whole texts, and products are taken row by row after
Gustavson: row i of A.T gathers the rows of T that row i of A names and adds up
equal columns.

* A.B' (B transposed) has at (i, j) the number of bytes that tokens i and j share:
  the overlap links.  Those whose tokens end together are the links of the report.
* The ends that both sides share cut the tokens into groups.  The product of the
  token-group incidence matrices has a one for every pair of a shared group: the
  group links.

How often a pair of ids is linked in the corpus is a grouped sum.  Pairs that
hold at least 1 / ``HEAVY`` of all links, of which there can be at most ``HEAVY``,
are looked up in a broadcast table; all others meet in a join in which no key is
frequent.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .bpe import _byte_names
from .store import written

#: Pairs with at least this share of all links are heavy; so there are no more of them.
HEAVY = 1 << 16
#: Entries of a product that are held at once.
ENTRIES = 1 << 21

_BLANK = "▁"

# fixed value: how byte-level pre-tokenizers cut a text into words
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Rows:
    """Compressed sparse rows of ones: row i holds ``cols[ptr[i]:ptr[i + 1]]``."""

    ptr: np.ndarray
    cols: np.ndarray
    width: int

    def transposed(self) -> Rows:
        order = np.argsort(self.cols, kind="stable")
        rows = np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))[order]
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(self.cols, minlength=self.width))]),
                    rows, len(self.ptr) - 1)


def runs(ends: np.ndarray) -> Rows:
    """Incidence of consecutive tokens that end at ``ends`` with their bytes."""
    n = int(ends[-1]) if len(ends) else 0
    return Rows(np.concatenate([[0], ends]), np.arange(n), n)


def members(group: np.ndarray, n: int) -> Rows:
    """Incidence of tokens with the one group that each is in."""
    return Rows(np.arange(len(group) + 1), group, n)


def product_sizes(a: Rows, b: Rows) -> np.ndarray:
    """Terms of every row of the product, before equal columns are added up."""
    terms = np.concatenate([[0], np.cumsum(np.diff(b.ptr)[a.cols])])
    return terms[a.ptr[1:]] - terms[a.ptr[:-1]]


def product(a: Rows, b: Rows, entries: int = ENTRIES
            ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, value) of a.b in order, in blocks of whole rows with about
    ``entries`` terms."""
    before = np.concatenate([[0], np.cumsum(product_sizes(a, b))])
    lo, n = 0, len(a.ptr) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + entries, "right")) - 1)
        inner = a.cols[a.ptr[lo]:a.ptr[hi]]
        row = np.repeat(np.arange(lo, hi), np.diff(a.ptr[lo:hi + 1]))
        size = np.diff(b.ptr)[inner]
        at = np.cumsum(size) - size
        col = b.cols[np.arange(int(size.sum())) + np.repeat(b.ptr[inner] - at, size)]
        key = np.repeat(row, size) * b.width + col
        if (key[1:] < key[:-1]).any():
            key.sort()
        first = np.flatnonzero(np.concatenate([[len(key) > 0], key[1:] != key[:-1]]))
        value = np.diff(np.concatenate([first, [len(key)]]))
        yield key[first] // b.width, key[first] % b.width, value
        lo = hi


def _by_rank(path: str, tokenizer, raw: list[bytes]):
    """tiktoken's encoder for a byte-level file that it equals, else None.

    It merges the neighbours whose joint bytes have the lowest id, of any two that
    make a token.  That follows the file's list of merges if ids rise along the
    list and each token's own bytes merge to it: neighbours that make a token are
    then always a pair of the list.
    """
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] \
        and cut.get("use_regex", True) and model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    special = {t["content"] for t in spec["added_tokens"]}
    names = sorted((n for n in model["vocab"] if n not in special), key=model["vocab"].get)
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if not plain or made != sorted(set(made)) or any(len(tokenizer.model.tokenize(n)) != 1 for n in names):
        return None
    return tiktoken.Encoding("a", pat_str=_WORD, special_tokens={},
                             mergeable_ranks={raw[i]: i for i in map(model["vocab"].get, names)})


class Sides:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # a task is one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {name: b for b, name in _byte_names().items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for name, i in self.a.get_vocab().items():
            plain = all(c in byte for c in name)
            self.bytes_a[i] = bytes(byte[c] for c in name) if plain else name.encode()
        self.ranked = _by_rank(path_a, self.a, self.bytes_a)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace(_BLANK, " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        most = max(len(self.bytes_a), len(self.bytes_b))
        #: Decimal ids with what follows them in a text of groups.
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(most)] + list(map(str, range(most)))
        self.most = most

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides; none where a side's bytes aren't the blank and the text."""
        spaced = [" " + t for t in texts]
        ids = map(self.ranked.encode_ordinary, spaced) if self.ranked else \
            (x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False))
        out = []
        for t, s, a, b in zip(texts, spaced, ids, self.b.encode(texts, num_threads=1)):
            whole = s.encode()
            same = t and b"".join(map(self.bytes_a.__getitem__, a)) == whole \
                and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((a, b) if same else ([], []))
        return out


_sides: dict[tuple[str, str], Sides] = {}


def _load(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _sides:
        _sides[path_a, path_b] = Sides(path_a, path_b)
    return _sides[path_a, path_b]


class Block:
    """Tokens of a run of whole texts, and the links between their sides."""

    def __init__(self, sides: Sides, texts: list[str]):
        coded = sides.encode(texts)
        self.sides = sides
        self.ids, self.at, self.ends, self.text = [], [], [], []
        for k, size in enumerate((sides.size_a, sides.size_b)):
            counts = np.array([len(c[k]) for c in coded], np.int64)
            ids = np.array([i for c in coded for i in c[k]], np.int64)
            self.ids.append(ids)
            self.at.append(np.concatenate([[0], np.cumsum(counts)]))
            self.ends.append(np.cumsum(size[ids]))
            self.text.append(np.repeat(np.arange(len(texts)), counts))
        self.rows = [runs(e) for e in self.ends]
        left, right, found = [], [], np.zeros(len(self.ids[0]), np.int64)
        for i, j, _, together in self.overlaps():
            left.append(i[together])
            right.append(j[together])
            found += np.bincount(i, minlength=len(found))
        self.left, self.right = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (left, right))
        self.n_overlaps = found
        # a link that ends both its tokens ends a group
        self.group = [np.searchsorted(linked, np.arange(len(ids)))
                      for linked, ids in zip((self.left, self.right), self.ids)]

    def per_text(self, of_a_tokens: np.ndarray) -> pa.Array:
        """Sum over the A tokens of each text."""
        before = np.concatenate([[0], np.cumsum(of_a_tokens)])[self.at[0]]
        return pa.array(np.diff(before))

    def overlaps(self) -> Iterator[tuple[np.ndarray, ...]]:
        """(A token, B token, shared bytes, whether they end together)."""
        a, b = self.rows
        for i, j, n in product(a, b.transposed()):
            yield i, j, n, self.ends[0][i] == self.ends[1][j]

    def members(self) -> tuple[Rows, Rows]:
        a, b = (members(g, len(self.left)) for g in self.group)
        return a, b.transposed()

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(A token, B token) of every pair in one group."""
        for i, j, _ in product(*self.members()):
            yield i, j

    def group_text(self, t: int) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of text t, group by group."""
        ids = [self.ids[k][self.at[k][t]:self.at[k][t + 1]] for k in (0, 1)]
        group = [self.group[k][self.at[k][t]:self.at[k][t + 1]] for k in (0, 1)]
        if not len(ids[0]):
            return ""
        # group borders: "|" behind a group's last A token, ";" behind its last B token
        mark = []
        for k, border in ((0, 1), (1, 2)):
            last = np.concatenate([group[k][1:] != group[k][:-1], [True]])
            mark.append(np.where(last, border, 0))
        mark[1][-1] = 3
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        code = (np.concatenate(ids) + np.concatenate(mark) * self.sides.most)[order]
        return "".join(map(self.sides.shown.__getitem__, code.tolist()))


def _blocks(sides: Sides, texts: pa.Array) -> Iterator[tuple[int, int, Block]]:
    """(first row, rows, block) of runs of whole texts."""
    for lo, hi, _, _ in kernel.text_blocks(texts):
        yield lo, hi - lo, Block(sides, [t or "" for t in texts.slice(lo, hi - lo).to_pylist()])


def _summaries(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _load(path_a, path_b)
        span = len(sides.bytes_a) * len(sides.bytes_b)
        for batch in batches:
            for lo, n, block in _blocks(sides, batch.column(1)):
                linked = np.bincount(block.left, minlength=len(block.ids[0]))
                pair = block.ids[0][block.left] * len(sides.bytes_b) + block.ids[1][block.right]
                key, times = np.unique(block.text[0][block.left] * span + pair, return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(n + 1) * span).astype(np.int32))
                n_groups = [0 if a == b else int(block.group[0][b - 1] - block.group[0][a]) + 1
                            for a, b in zip(block.at[0][:-1], block.at[0][1:])]
                texts = [block.group_text(t) for t in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.diff(block.at[0])), pa.array(np.diff(block.at[1])),
                     pa.array(n_groups, pa.int64()), block.per_text(linked), block.per_text(block.n_overlaps),
                     block.per_text(product_sizes(*block.members())),
                     pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts]),
                     pa.ListArray.from_arrays(ends, pa.array(key % span)),
                     pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64)))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared",
                           "groups_sha256", "pairs", "times"])
    return run


def _link_rows(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _load(path_a, path_b)
        for batch in batches:
            for lo, n, block in _blocks(sides, batch.column(1)):
                for i, j, n_bytes, together in block.overlaps():
                    yield _link_batch(batch.column(0).slice(lo, n), block, "overlap", i, j, n_bytes, together)
                for i, j in block.shared():
                    together = block.ends[0][i] == block.ends[1][j]
                    yield _link_batch(batch.column(0).slice(lo, n), block, "group", i, j, None, together)
    return run


def _link_batch(doc_ids: pa.Array, block: Block, kind: str, i: np.ndarray, j: np.ndarray,
                n_bytes: np.ndarray | None, together: np.ndarray) -> pa.RecordBatch:
    text = block.text[0][i]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(text)), pa.array([kind] * len(i), pa.string()),
         pa.array(i - block.at[0][text]), pa.array(j - block.at[1][text]),
         pa.array(block.ids[0][i]), pa.array(block.ids[1][j]),
         pa.nulls(len(i), pa.int64()) if n_bytes is None else pa.array(n_bytes), pa.array(together)],
        names=["doc_id", "kind", "a_at", "b_at", "a_id", "b_id", "n_bytes", "together"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def token_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, kind, a_at, b_at, a_id, b_id, n_bytes, together: one row per link.

    ``overlap`` links are pairs of tokens that share ``n_bytes`` bytes, ``group``
    links (n_bytes null) are pairs of tokens of one group; ``together`` tells
    whether both tokens end at the same byte.  Texts without tokens have no row;
    repeated rows have repeated links; other columns are ignored.
    """
    return _texts(docs).mapInArrow(
        _link_rows(path_a, path_b), "doc_id long, kind string, a_at long, b_at long, a_id long, b_id long, "
                                    "n_bytes long, together boolean")


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: sizes, counts of links of each kind, the digest of
    its groups, and the distinct pairs of ids (a * B's vocabulary + b) whose
    tokens end together, with how often they do."""
    return _texts(docs).mapInArrow(
        _summaries(path_a, path_b), "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                    "n_overlaps long, n_shared long, groups_sha256 string, "
                                    "pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame, vocabulary_b: int) -> DataFrame:
    """pair, n, best: links of each pair in the corpus, and whether no other pair
    of its B id has more."""
    counts = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")) \
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n"))
    counts = written(counts.withColumn("b", F.pmod("pair", F.lit(vocabulary_b))), "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return written(counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def alignment_report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document the columns of :func:`aligned` without its lists, ``n_best``
    (links whose pair is the most frequent of its B id, ties included) and
    ``count_sum`` (the pairs' counts, summed over the links).

    Texts that are null or empty, or whose tokens of a side aren't the bytes of a
    blank and the text, have zeros and an empty digest.  Rows are told apart by a
    number given where they are written, so null and repeated doc_ids stand for
    themselves, and equal texts each count.  Other columns are ignored; an empty
    table gives an empty result.
    """
    import sentencepiece
    size = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = written(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = pair_counts(rows, size)
    least = -(-(pairs.agg(F.sum("n")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(pairs.filter(F.col("n") >= least))
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")) \
        .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rare = each.join(heavy.select("pair"), "pair", "left_anti") \
        .join(pairs.filter(F.col("n") < least), "pair")
    sums = each.join(heavy, "pair").unionByName(rare).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return rows.drop("pairs", "times").join(sums, "row", "left").drop("row") \
        .fillna(0, ["n_best", "count_sum"]) \
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                "n_overlaps", "n_shared")
