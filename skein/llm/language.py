"""Language identification: script ranges, then Viterbi over per-word scores.

Words are runs of letters and their marks.  A word's script (the first of
``SCRIPTS`` that holds its first letter) narrows the languages that can have written
it to those that write a fair share of their letters in that script.  Each of them
scores the word by the log-probabilities of its character trigrams, the word's
borders included.  A Viterbi path over the words, where going from one language to
another costs ``SWITCH``, labels spans of a text that mixes languages.

The path is exact and taken for many texts at once.  Texts are cut into chunks of
``CHUNK`` words.  The chunks of longer texts are run from every language before
them; their best scores (a product of matrices in the max-plus sense) are chained,
which tells the language before and at the end of each.  Then all chunks are run
and traced back side by side.

Trigram counts are grouped sums over all training texts, hashed to ``BUCKETS``
places; the model is languages x BUCKETS numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

BUCKETS = 1 << 16
#: Cost of a change of language between two words, in nats.
SWITCH = 6.0
#: Share of a language's letters from which a script counts as its own.
FAIR = 0.02
CHUNK = 256
SMOOTH = 0.5
UNKNOWN = "und"

# fixed values: first and last code points of scripts, after the Unicode blocks
SCRIPTS = [
    ("latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("armenian", [(0x530, 0x58F)]),
    ("hebrew", [(0x590, 0x5FF), (0xFB1D, 0xFB4F)]),
    ("arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x900, 0x97F)]),
    ("bengali", [(0x980, 0x9FF)]),
    ("tamil", [(0xB80, 0xBFF)]),
    ("thai", [(0xE00, 0xE7F)]),
    ("georgian", [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)]),
    ("ethiopic", [(0x1200, 0x139F)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]),
    ("kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)]),
]
#: Scripts written without blanks: a letter of theirs is a word.
_SINGLE = ("han", "kana", "thai")
OTHER = len(SCRIPTS)


class _Letters:
    """Per code point: letter, mark, script, and the lower-case letter."""

    def __init__(self) -> None:
        n = sys.maxunicode + 1
        self.letter, self.mark = np.zeros(n, bool), np.zeros(n, bool)
        self.lower = np.arange(n, dtype=np.uint32)
        for cp in range(n):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                self.letter[cp] = True
                low = chr(cp).lower()
                if len(low) == 1:
                    self.lower[cp] = ord(low)
            elif kind == "M":
                self.mark[cp] = True
        self.script = np.full(n, OTHER, np.uint8)
        self.single = np.zeros(n, bool)
        for k, (name, ranges) in reversed(list(enumerate(SCRIPTS))):
            for first, last in ranges:
                self.script[first:last + 1] = k
                self.single[first:last + 1] = name in _SINGLE


_letters: list[_Letters] = []


def letters() -> _Letters:
    if not _letters:
        _letters.append(_Letters())
    return _letters[0]


@dataclass
class Words:
    """Words of a run of texts: code points from ``start`` to ``end`` of the text
    (``text``), their script, letters and hashed trigrams (``grams[at[i]:at[i + 1]]``)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    grams: np.ndarray
    at: np.ndarray


def cut(buf: np.ndarray, offs: np.ndarray) -> Words:
    """The words of a block of texts."""
    table = letters()
    point = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]      # in code points
    letter = table.letter[point]
    inside = letter | table.mark[point]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = begin[:-1][begin[1:] > begin[:-1]]
    first[borders] = inside[borders]
    first |= letter & table.single[point]
    after_single = np.zeros(len(point), bool)
    after_single[1:] = table.single[point[:-1]] & letter[1:]
    first |= after_single
    place = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    word_of = np.cumsum(first)[place] - 1                # a mark that follows nothing starts a word
    size = np.bincount(word_of, minlength=len(starts))
    n_letters = np.bincount(word_of, letter[place], len(starts)).astype(np.int64)
    low = table.lower[point[place]].astype(np.uint64)
    edge = np.cumsum(size)
    is_last = np.zeros(len(place), bool)
    is_last[edge - 1] = True
    is_first = np.zeros(len(place), bool)
    is_first[edge - size] = True
    before = np.where(is_first, 0, np.concatenate([[0], low[:-1]])) if len(low) else low
    after = np.where(is_last, 0, np.concatenate([low[1:], [0]])) if len(low) else low
    code = (before.astype(np.uint64) << np.uint64(42)) | (low << np.uint64(21)) | after.astype(np.uint64)
    grams = (kernel.mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)
    text = np.searchsorted(begin, starts, "right") - 1
    keep = n_letters > 0                                 # words of marks alone say nothing
    if not keep.all():
        grams = grams[keep[word_of]]
        starts, size, n_letters, text = starts[keep], size[keep], n_letters[keep], text[keep]
    at = np.concatenate([[0], np.cumsum(size)])
    return Words(text, starts - begin[text], starts + size - begin[text], table.script[point[starts]],
                 n_letters, grams, at)


def _steps(score: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray, switch: float,
           came: np.ndarray | None = None) -> np.ndarray:
    """Run ``state`` (chunks, ..., languages), which holds the first words, over the
    chunks' other words.  ``came`` gets the language before each word, by step.  The
    longer chunks stand in front."""
    k = score.shape[1]
    middle = (1,) * (state.ndim - 2)
    for t in range(1, int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -t, "left"))
        now = state[:live]
        top = now.argmax(axis=-1)[..., None]
        jump = np.take_along_axis(now, top, -1) - switch
        stay = now >= jump
        if came is not None:
            came[t, :live] = np.where(stay, np.arange(k), top)
        state[:live] = np.where(stay, now, jump) + score[start[:live] + t].reshape(live, *middle, k)
    return state


def best_paths(score: np.ndarray, offs: np.ndarray, switch: float = SWITCH, chunk: int = CHUNK) -> np.ndarray:
    """For each word the language of the best path through its text.

    ``score`` is (words, languages); text t has the words offs[t] to offs[t + 1].
    A path gains the scores of its words and loses ``switch`` at each change.
    """
    n, k = score.shape
    out = np.zeros(n, np.int64)
    if not n:
        return out
    chunks = -(-np.diff(offs) // chunk)
    owner = np.repeat(np.arange(len(chunks)), chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = offs[:-1][owner] + nth * chunk
    length = np.minimum(start + chunk, offs[1:][owner]) - start
    change = np.where(np.eye(k, dtype=bool), 0.0, -switch)

    # best scores of the chunks of longer texts from each language before them, chained
    entry, last = np.full(len(owner), -1), np.full(len(owner), -1)
    several = np.flatnonzero(chunks[owner] > 1)
    via = np.zeros((len(several), k), np.int64)
    value = np.zeros(k)
    per_turn = max(1, (1 << 20) // (k * k))
    for lo in range(0, len(several), per_turn):
        own = several[lo:lo + per_turn]
        order = np.argsort(-length[own], kind="stable")
        state = change + score[start[own[order]]][:, None, :]
        reach = np.empty_like(state)
        reach[order] = _steps(score, start[own[order]], length[own[order]], state, switch)
        for i, c in enumerate(own.tolist()):
            if nth[c] == 0:                              # a text may begin in any language at no cost
                value = np.zeros(k)
            total = reach[i] + value[:, None]
            via[lo + i], value = total.argmax(axis=0), total.max(axis=0)
            if nth[c] == chunks[owner[c]] - 1:
                last[c] = value.argmax()
    for i in range(len(several) - 1, -1, -1):
        c = several[i]
        if nth[c]:
            entry[c] = last[c - 1] = via[i, last[c]]

    # each chunk by itself, from the language before it to its last one
    order = np.argsort(-length, kind="stable")
    start, length, entry, last = start[order], length[order], entry[order], last[order]
    state = score[start] + np.where(entry[:, None] < 0, 0.0, change[entry])
    came = np.zeros((int(length[0]), len(start), k), np.int16)
    state = _steps(score, start, length, state, switch, came)
    now, row = np.where(last < 0, state.argmax(axis=1), last), np.arange(len(start))
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        out[start[:live] + t] = now[:live]
        if t:
            now[:live] = came[t, row[:live], now[:live]]
    return out


@dataclass
class Model:
    """Languages, their trigrams' log-probabilities (buckets, languages) and the
    scripts that they write (scripts, languages)."""

    languages: list[str]
    table: np.ndarray
    writes: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """(words, languages); languages that don't write a word's script have the
        least score of those that do, less ``SWITCH``.  A script that no language
        writes tells none apart."""
        if not len(words.start):
            return np.zeros((0, len(self.languages)))
        out = np.add.reduceat(self.table[words.grams], words.at[:-1], axis=0).astype(float)
        own = self.writes[words.script]
        some = own.any(axis=1)
        least = np.where(own, out, np.inf).min(axis=1, initial=np.inf)
        out = np.where(own, out, np.minimum(out, (least - SWITCH)[:, None]))
        return np.where(some[:, None], out, 0.0)


def fit(languages: list[str], counts: np.ndarray, scripts: np.ndarray) -> Model:
    """From trigram counts (languages, BUCKETS) and letters by script (languages,
    scripts)."""
    smooth = counts + SMOOTH
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, np.ascontiguousarray(table.T, np.float32), (share >= FAIR).T)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of the task: counts by bucket, and by script after the buckets."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            words = cut(buf, offs)
            names, which = np.unique(np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object),
                                     return_inverse=True)
            of_word = which[words.text]
            of_gram = np.repeat(of_word, np.diff(words.at))
            width = BUCKETS + OTHER + 1
            block = np.bincount(of_gram * width + words.grams, minlength=len(names) * width)
            block = block + np.bincount(of_word * width + BUCKETS + words.script, words.letters,
                                        len(names) * width).astype(np.int64)
            for name, row in zip(names, block.reshape(len(names), width)):
                sums[name] = sums[name] + row if name in sums else row
    for name, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])],
            names=["lang", "bucket", "n"])


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(4)) == 2


def train(docs: DataFrame) -> Model:
    """Counts over all texts with a language whose id isn't held out.

    Null texts, languages and ids are left out, and so are languages without a
    letter.  The driver gets one row per language and bucket.
    """
    doc_id = F.col("doc_id").cast("long")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & doc_id.isNotNull() & ~held_out(doc_id)) \
        .select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names, which = np.unique(np.array(rows["lang"].to_pylist(), object), return_inverse=True)
    sums = np.zeros((len(names), BUCKETS + OTHER + 1))
    sums[which, rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return fit(names.tolist(), sums[:, :BUCKETS], sums[:, BUCKETS:])


def label(model: Model, buf: np.ndarray, offs: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a block of texts and the language of each."""
    words = cut(buf, offs)
    ends = np.searchsorted(words.text, np.arange(len(offs)))
    return words, best_paths(model.scores(words), ends)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()),
                             ("letters", pa.int64())]))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans array<struct<start, end, lang, letters>> for every row.

    A span goes from the first to behind the last word (in code points) of a run
    of words of one language.  Null texts, texts without a letter, and any text
    while no language is learned, have no span.  Repeated rows give repeated
    results; other columns are never read; an empty table gives an empty result.
    """
    names = np.array(model.languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
                n = hi - lo
                words, lang = label(model, buf, offs) if len(names) else (cut(buf[:0], offs * 0), np.zeros(0, int))
                new = np.ones(len(lang), bool)
                new[1:] = (lang[1:] != lang[:-1]) | (words.text[1:] != words.text[:-1])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(lang)]])[:len(first)] - 1
                total = np.add.reduceat(words.letters, first) if len(first) else np.zeros(0, np.int64)
                parts = pa.StructArray.from_arrays(
                    [pa.array(words.start[first], pa.int64()), pa.array(words.end[last], pa.int64()),
                     pa.array(names[lang[first]], pa.string()), pa.array(total, pa.int64())],
                    fields=list(_SPANS.value_type))
                at = np.searchsorted(words.text[first], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.ListArray.from_arrays(pa.array(at), parts)],
                    names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<start:long,end:long,lang:string,letters:long>>")


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans: the language with most letters
    in a text's spans (the first by name, on ties) and its share of the letters;
    ``und`` and 0 without spans."""
    each = F.transform(F.array_distinct("spans.lang"), lambda name: F.struct(
        (-F.aggregate(F.filter("spans", lambda s: s["lang"] == name), F.lit(0).cast("long"),
                      lambda total, s: total + s["letters"])).alias("less"), name.alias("lang")))
    whole = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["letters"])
    return spans(docs, model).select("doc_id", "spans", F.array_min(each).alias("best"), whole.alias("letters")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce("best.lang", F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(-F.col("best.less") / F.col("letters"), F.lit(0.0)).alias("score"),
        F.size("spans").alias("n_spans"))
