"""Cross-tokenizer alignment, language identification and the prefix trie."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import alignment, kernel, language, prefix_trie, queries
from tests.conftest import SF_CHECK, SF_SMALL

from . import brute

PATHS = [queries.tokenizer_path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
AWKWARD = [None, "", " ", "  two  blanks ", "a", "The same cut.", "The same cut.", "日本語 🙂 é́ x y",
           "<|endoftext|> and </s> <0x41>", "▁under", "tab\tnew\nline\r\n", "ab" * 40_000, "x\x00y", "ﬁ ½ Å"]


def table(spark, values=AWKWARD):
    rows = [(i, t, "row", 7, ["p"]) for i, t in enumerate(values)] + [(None, "null id", "row", 7, None), (5, "The same cut.", "z", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, times int, pairs array<string>")


# -- alignment -----------------------------------------------------------------

def coders():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    sides = alignment.Sides(*PATHS)
    return (lambda t: [(i, sides.bytes_a[i]) for i in a.encode(" " + t, add_special_tokens=False).ids],
            lambda t: [(i, sides.bytes_b[i]) for i in b.encode(t)])


def expected(docs):
    rows = docs.collect()
    for r, x in zip(rows, brute.aligned([r.text for r in rows], *coders())):
        yield (r.doc_id, *x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "")


def shown(rows):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                   for r in rows), key=repr)


def test_alignment_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = queries.op12_tokenizer_alignment(spark, SF_SMALL).collect()
    assert shown(got) == sorted(expected(docs), key=repr)


def test_alignment_awkward_texts(spark):
    docs = table(spark)
    got = alignment.alignment_report(docs, *PATHS).collect()
    assert shown(got) == sorted(expected(docs), key=repr)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].n_a for i in (0, 1, 9)] == [0, 0, 0] and by_id[4].n_links == 1
    assert alignment.alignment_report(docs.limit(0), *PATHS).count() == 0


def test_encoder_by_rank_equals_the_file(spark):
    sides = alignment.Sides(*PATHS)
    texts = [t or "" for t in AWKWARD] + [r.text for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()]
    rng = random.Random(2)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x110000)]))
                      for _ in range(200)) for _ in range(50)]
    by_rank = [a for a, _ in sides.encode(texts)]
    assert sides.ranked is not None
    sides.ranked = None
    assert by_rank == [a for a, _ in sides.encode(texts)]


def test_rare_pairs_are_joined(spark, monkeypatch):
    """With few heavy pairs most are found by the join; the result is the same."""
    docs = table(spark)
    whole = shown(alignment.alignment_report(docs, *PATHS).collect())
    for heavy in (1, 20):
        monkeypatch.setattr(alignment, "HEAVY", heavy)
        assert shown(alignment.alignment_report(docs, *PATHS).collect()) == whole


def test_token_links_are_the_products(spark):
    docs = spark.createDataFrame([(1, "The same cut of überhaupt 日本語"), (2, None), (None, "x")], "doc_id long, text string")
    encode_a, encode_b = coders()
    want = set()
    for r in docs.collect():
        if r.text:
            sides = [encode(r.text) for encode in (encode_a, encode_b)]
            ends = [np.cumsum([len(x) for _, x in s]) for s in sides]
            common = sorted(set(ends[0]) & set(ends[1]))
            for i, (a, raw) in enumerate(sides[0]):
                for j, (b, raw_b) in enumerate(sides[1]):
                    shared = min(ends[0][i], ends[1][j]) - max(ends[0][i] - len(raw), ends[1][j] - len(raw_b))
                    together = bool(ends[0][i] == ends[1][j])
                    if shared > 0:
                        want.add((r.doc_id, "overlap", i, j, a, b, int(shared), together))
                    if np.searchsorted(common, ends[0][i]) == np.searchsorted(common, ends[1][j]):
                        want.add((r.doc_id, "group", i, j, a, b, None, together))
    got = [tuple(r) for r in alignment.token_links(docs, *PATHS).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    report = {r.doc_id: r for r in alignment.alignment_report(docs, *PATHS).collect()}
    for doc in (1, None):
        assert report[doc].n_overlaps == sum(x[0] == doc and x[1] == "overlap" for x in got)
        assert report[doc].n_shared == sum(x[0] == doc and x[1] == "group" for x in got)


def test_products_of_random_matrices():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n, m, k = rng.integers(1, 9, 3)
        x, y = (rng.random(s) < 0.4 for s in ((n, m), (m, k)))
        a, b = (alignment.Rows(np.concatenate([[0], np.cumsum(d.sum(1))]), np.nonzero(d)[1], d.shape[1])
                for d in (x, y))
        out = np.zeros((n, k), int)
        for i, j, v in alignment.product(a, b, entries=5):
            out[i, j] += v
        assert (out == x.astype(int) @ y.astype(int)).all()
        assert (alignment.product_sizes(a, b) == (x.astype(int) @ y.astype(int)).sum(1)).all()
        t = b.transposed()
        assert all((t.cols[t.ptr[c]:t.ptr[c + 1]] == np.flatnonzero(y[:, c])).all() for c in range(k))


# -- language ------------------------------------------------------------------

def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").collect()}
    rows = queries.op11_language_id(spark, SF_CHECK).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred in set(docs.values()) | {"und"}
    for held in (True, False):
        own = [r.lang_pred == docs[r.doc_id] for r in rows if r.held_out == held]
        assert len(own) > 200 and np.mean(own) >= 0.98


def test_best_paths_equal_plain_version():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(0, 30, rng.integers(1, 6))
        offs = np.concatenate([[0], np.cumsum(sizes)])
        score = rng.normal(0, 3, (offs[-1], rng.integers(1, 5)))
        path = language.best_paths(score, offs, 2.0, chunk=int(rng.integers(1, 8)))
        for a, b in zip(offs[:-1], offs[1:]):
            if b > a:
                own = path[a:b]
                total = score[np.arange(a, b), own].sum() - 2.0 * (own[1:] != own[:-1]).sum()
                assert total == pytest.approx(brute.best_path(score[a:b].tolist(), 2.0))


def plain_words(text):
    """(start, end, letters) of runs of letters and marks; some scripts' letters are words."""
    import unicodedata
    table, out, at = language.letters(), [], None
    for i, c in enumerate(text + "\x00"):
        kind = unicodedata.category(c)[0]
        new = kind == "L" and (table.single[ord(c)] or (i and table.single[ord(text[i - 1])]))
        if at is not None and (kind not in "LM" or new):
            out.append((at, i, sum(unicodedata.category(x)[0] == "L" for x in text[at:i])))
            at = None
        if at is None and kind in "LM":
            at = i
    return [w for w in out if w[2]]


def test_words_of_texts():
    texts = ["", "It's 3 words", "日本語 abc漢d", "été ́", "ЖЁ ΟΔΟΣ x_y", "123 ...", "́", "a", "नमस्ते दुनिया"]
    [(_, _, buf, offs)] = kernel.text_blocks(pa.array(texts))
    words = language.cut(buf, offs)
    got = [[] for _ in texts]
    for t, s, e, n in zip(words.text, words.start, words.end, words.letters):
        got[t].append((int(s), int(e), int(n)))
    assert got == [plain_words(t) for t in texts]
    assert (np.diff(words.at) == words.end - words.start).all()


def train_rows(spark):
    """Invented languages: two share a script, one writes another."""
    rng = random.Random(5)
    parts = {"aa": ["tho", "ing", "wh", "ed"], "bb": ["sch", "ung", "öz", "ei"], "cc": ["жив", "ост", "ная"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(60)), lang)
            for i in range(400) for lang in [("aa", "bb", "cc")[i % 3]]]


def test_mixed_texts_and_edge_cases(spark):
    rows = train_rows(spark)
    docs = spark.createDataFrame(rows + [(None, "schungöz", "zz"), (9001, None, "aa"), (9002, "thing", None),
                                         (9003, "12 !", "nn")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.languages == ["aa", "bb", "cc"]
    one, two, three = (next(t for _, t, l in rows if l == lang)[:60] for lang in ("aa", "bb", "cc"))
    mixed = f"{one}. {two} 12 {three}"
    cases = [(0, mixed), (1, None), (2, ""), (3, "12 ?! 日"), (4, "12 ?!"), (None, one), (5, one), (5, one),
             (6, one + " " + two[:9] + " " + one), (7, (one + " ") * 5000)]
    probe = spark.createDataFrame([(i, t, "cc", 1) for i, t in cases], "doc_id long, text string, lang string, spans int")
    found = language.spans(probe, model).collect()
    assert len(found) == len(cases)
    [first] = [r for r in found if r.doc_id == 0]
    assert [s.lang for s in first.spans] == ["aa", "bb", "cc"]
    assert [(s.start, s.end) for s in first.spans][0][0] == 0 and first.spans[-1].end == len(mixed.rstrip())
    got = {(r.doc_id, r.lang_pred, r.n_spans, round(r.score, 2)) for r in language.predicted(probe, model).collect()}
    assert {(1, "und", 0, 0.0), (2, "und", 0, 0.0), (4, "und", 0, 0.0), (None, "aa", 1, 1.0), (5, "aa", 1, 1.0),
            (7, "aa", 1, 1.0)} <= got
    assert next(x[1] for x in got if x[0] == 3) != "und"       # a letter of a script that none writes
    assert language.predicted(probe.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0))
    assert {r.lang_pred for r in language.predicted(probe, nothing).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    rows = [r for r in train_rows(spark)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    wrong = [(i, t, "xx" if i in held else lang) for i, t, lang in rows]
    model = language.train(spark.createDataFrame(wrong, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "cc"]


# -- prefix trie ---------------------------------------------------------------

def nodes(df):
    return sorted(tuple(r) for r in prefix_trie.trie(df).collect())


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "conv_id long, turn long, role string, text string, depth int, p1 string")


def test_trie_equals_plain_version(spark):
    df = spark.read.parquet(f"{SF_CHECK}/conversations.parquet")
    got = sorted(tuple(r) for r in queries.op13_prefix_trie(spark, SF_CHECK).collect())
    assert got == brute.trie([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


@pytest.mark.parametrize("height", [64, 3])
def test_trie_awkward_turns(spark, monkeypatch, height):
    """Null ids, turns, roles and texts, ties, repeats, missing heads, deep and
    turnless conversations, one prefix that most share; with shallow bands the
    bands' tops are rolled up over several levels."""
    monkeypatch.setattr(prefix_trie, "HEIGHT", height)
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    rng = random.Random(height)
    rows = []
    for c in [*range(0, 30), *range(301, 340), 100, 205]:
        for t in range(rng.choice([1, 2, 5, 9, 40 if c < 10 else 3])):
            rows.append((c if rng.random() > 0.03 else None, t if rng.random() > 0.1 else None,
                         rng.choice(["user", None]) if t > 2 else "user",
                         rng.choice(["x", "yy", None, "ü🙂"]) if t > 1 else "same"))
    rows += [(7, 3, "user", "twice"), (7, 3, "user", "twice"), (8, 3, "b", "a"), (8, 3, "a", "b")]
    assert nodes(turns(spark, rows)) == brute.trie(rows)


def test_trie_long_conversation_over_many_partitions(spark):
    rows = [(1, t, "user", str(t % 3)) for t in range(700)] + [(c, 0, "user", "0") for c in range(2, 30)]
    assert nodes(turns(spark, rows).repartition(7)) == brute.trie(rows)


def test_trie_of_nothing(spark):
    assert nodes(turns(spark, [(1, 1, "a", "b")]).limit(0)) == []
    assert nodes(turns(spark, [(None, 1, "a", "b")])) == []
