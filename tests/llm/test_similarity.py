"""Near-duplicate documents, lines, passages and vectors, and the pipeline."""

import collections
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import embed_dedup, line_dedup, links, near_dup, quality, queries, repeats
from skein.llm.components import components
from skein.llm.links import bitmap, colliding, jaccard_links, linked
from skein.llm.marks import maybe_in
from skein.llm.store import freed, written
from tests.conftest import SF_CHECK, SF_SMALL

from . import brute


def documents(spark, sf=SF_CHECK):
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def base_text(seed, n):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def hot_texts():
    """A large group of copies, a chain of near copies, a common line."""
    out = [" ".join(base_text(1, 60))] * 300
    chain = base_text(2, 120)
    for i in range(60):
        chain = chain[:]
        chain[(i * 2) % 120] = f"x{i}"
        out.append(" ".join(chain))
    out += [" ".join(base_text(100 + i, 40)) + "\na line that stands in very many texts of this table" for i in range(200)]
    return out + [None, "", "  ", "one two", "One  two", "one two three", "z" * 50_000, " ".join(["the"] * 20_000)]


# -- union-find and buckets -----------------------------------------------------

def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(1000 + i, 1001 + i) for i in range(64)] \
        + [(2000, 2001 + i) for i in range(500)] + [(5, 5), (7, None)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    true = [(a, b) for a, b in links if b is not None and a != b]
    want = brute.roots({x for p in true for x in p}, true)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_loses_no_link_that_the_star_misses(spark):
    # one bucket; the smallest id is linked with none, the others form a path
    sets = {0: range(900, 920), **{i: range(i, i + 20) for i in range(1, 150)}}
    frame = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "id long, items array<long>")
    members = colliding(frame.select("id", F.lit(7).cast("long").alias("key")))
    got = {r.id: r.root for r in linked(members, frame, 75, 100).collect()}
    assert got == {i: 1 for i in range(1, 150)}


# -- documents --------------------------------------------------------------------

def check_near(rows, by_id):
    want = brute.roots(by_id, brute.near_links(by_id))
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (
            len(brute.shingles(by_id[r.doc_id])), want[r.doc_id], want[r.doc_id] == r.doc_id), r.doc_id
    assert len(rows) == len(by_id)


def test_bitmap_lets_every_key_through(spark):
    rows = spark.range(200000).selectExpr("if(id = 5, null, id) AS id", "'x' AS y")
    for n in (0, 1, 3000):
        keys = written(spark.range(n).selectExpr("id * 7 AS k"), "keys")
        left = {r.id for r in maybe_in(rows, "id", keys).collect()}
        assert {7 * i for i in range(n)} <= left
        assert len(left) <= n + 200000 / 16
    assert maybe_in(rows.limit(0), "id", keys).count() == 0


def test_bitmaps_of_sets_keep_every_true_pair(spark):
    rng = random.Random(5)
    base = [[rng.getrandbits(62) - 2 ** 61 for _ in range(n)] for n in (1, 2, 5, 40, 400)]
    own = [b[:len(b) - k] + [rng.getrandbits(62) for _ in range(extra)]
           for b in base for k in range(min(3, len(b))) for extra in range(3)]
    items = spark.createDataFrame([(i, x) for i, xs in enumerate(own) for x in xs], "id long, h long")
    sets = items.groupBy("id").agg(F.collect_set("h").alias("items"), bitmap("h").alias("bits")) \
        .withColumn("size", F.size("items"))
    pairs = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own))]
    got = jaccard_links(spark.createDataFrame(pairs, "a long, b long"), written(sets, "sets"), 80, 100)
    true = {(i, j) for i, j in pairs
            if 100 * len(set(own[i]) & set(own[j])) >= 80 * len(set(own[i]) | set(own[j]))}
    assert {(r.a, r.b) for r in got.collect()} == true and true


def test_near_duplicates_equal_brute_force(spark):
    check_near(queries.op8_near_duplicates(spark, SF_CHECK).collect(), texts(documents(spark)))


def test_near_duplicates_hot_and_awkward(spark):
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(hot_texts())],
                                 "doc_id long, text string, n_shingles int, kept boolean")
    check_near(near_dup.near_duplicates(docs).collect(), dict(enumerate(hot_texts())))
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    want = brute.roots(range(len(hot_texts())), brute.near_links(dict(enumerate(hot_texts()))))
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_duplicates_null_and_repeated_ids(spark):
    t = " ".join(base_text(9, 30))
    docs = spark.createDataFrame([(None, t), (4, t), (4, t), (None, "lone words here"), (None, None)],
                                 "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert got == sorted([("None", "4", False), ("4", "4", True), ("4", "4", True),
                          ("None", "None", True), ("None", "None", True)])


def test_stages_decide_rows_that_share_an_id_one_by_one(spark):
    t, lone, more = (" ".join(base_text(s, 30)) for s in (9, 10, 11))
    leak = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").filter("text is not null").first().text
    rows = [(None, t), (4, t), (None, lone), (None, more), (None, None), (None, ""), (6, t), (6, lone + " and more"),
            (7, "four clean words here"), (7, leak), (None, leak)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], documents(spark, SF_SMALL).schema)

    def left(out):
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    got = left(near_dup.deduplicated(docs))
    kept = {(r.doc_id, r.n_shingles) for r in near_dup.near_duplicates(docs).collect() if r.kept}
    assert {(i, len(brute.shingles(x))) for i, x in got} == kept
    assert got == sorted([r for r in rows if r not in {(None, t), (6, t), (None, leak)}], key=str)
    assert left(corpus_pipeline.drop_near_duplicates(spark, docs, SF_CHECK)) == got
    assert left(corpus_pipeline.drop_benchmark_leaks(spark, docs, SF_CHECK)) == sorted(
        [r for r in rows if r[1] != leak], key=str)


def test_crafted_words_link_nothing(spark):
    from .test_text_operators import TWINS
    docs = spark.createDataFrame([(i, f"one two three four {w}") for i, w in enumerate(TWINS)], "doc_id long, text string")
    assert [r.component_id for r in near_dup.near_duplicates(docs).orderBy("doc_id").collect()] == [0, 1]
    filler = " ".join(base_text(1, 60))
    docs = spark.createDataFrame([(i, f"{filler[:120]} {w} {filler[:120]}") for i, w in enumerate(TWINS)], "doc_id long, text string")
    assert repeats.repeated_passages(docs).count() == 0


def test_circulant_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    shared, own = rng.integers(0, 1 << 63, 3000, dtype=np.uint64), rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.sort(shared), np.sort(np.concatenate([shared, own]))
    sig = near_dup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.15


# -- lines ----------------------------------------------------------------------------

def line_set(line, k=7):
    return {line[i:i + k] for i in range(max(1, len(line) - k + 1))}


def brute_lines(by_id):
    places, sets = collections.defaultdict(list), {}
    for d, t in by_id.items():
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\x0b\f\r"):
                places[line].append((d, n))
                if line not in sets:
                    sets[line] = line_set(line)
    held = collections.defaultdict(list)
    for line, s in sets.items():
        for g in s:
            held[g].append(line)
    common = collections.Counter()
    for who in held.values():
        for i, a in enumerate(who):
            for b in who[i + 1:]:
                common[min(a, b), max(a, b)] += 1
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    groups = collections.defaultdict(list)
    for line, root in brute.roots(sets, links).items():
        groups[root] += places[line]
    dropped = collections.defaultdict(list)
    for group in groups.values():
        for d, n in sorted(group)[1:]:
            dropped[d].append(n)
    count = collections.Counter(d for where in places.values() for d, _ in where)
    return count, {d: sorted(v) for d, v in dropped.items()}


def check_lines(rows, by_id):
    count, dropped = brute_lines(by_id)
    assert {r.doc_id: r.n_lines for r in rows} == count
    assert {r.doc_id: r.dropped for r in rows if r.dropped} == dropped
    assert all(r.n_dropped == len(r.dropped) for r in rows)


def test_lines_equal_brute_force(spark):
    check_lines(queries.op7_line_dedup(spark, SF_CHECK).collect(), texts(documents(spark)))


def test_lines_hot_and_awkward(spark):
    own = hot_texts() + ["日本語" * 30, "日本語" * 30 + "。", "x" * 40 + "1\r\ny", "\n\n  \nshort", "short\nshort"]
    docs = spark.createDataFrame([(i, t, "clash", -5) for i, t in enumerate(own)],
                                 "doc_id long, text string, line string, n_chars long")
    rows = line_dedup.line_report(docs).collect()
    check_lines(rows, dict(enumerate(own)))
    assert line_dedup.line_report(docs.limit(0)).count() == 0
    cut = line_dedup.without_repeated_lines(docs)
    assert cut.columns == docs.columns
    _, dropped = brute_lines(dict(enumerate(own)))
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    for i, t in enumerate(own):
        gone = set(dropped.get(i, ()))
        want = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone) if gone else t
        assert got[i] == (want, len(want) if gone else -5)


def test_lines_of_rows_without_an_id_or_of_one_id(spark):
    header, more = "the header line of this table", " ".join(base_text(31, 30))
    rows = [(None, f"{header}\nfirst"), (None, f"{header}\n{more}"), (3, f"{header}\nthird row"), (3, f"{more}\nfourth"),
            (None, f"{header}\nfirst")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.text for r in line_dedup.without_repeated_lines(docs).collect())
    texts_of = collections.Counter(line for t in got for line in t.split("\n"))
    assert texts_of[header] == 2 and texts_of[more] == 1        # equal rows are decided alike
    assert sorted(texts_of) == sorted({header, more, "first", "third row", "fourth"})


def test_edited_lines_are_found(spark):
    """Lines of 20 to 40 words with one word replaced: nine of ten are linked."""
    rng = random.Random(12)
    lines = [line for t in texts(documents(spark)).values() for line in (t or "").split("\n")
             if 20 <= len(line.split(" ")) <= 40]
    lines = rng.sample(sorted(set(lines)), 300)
    vocabulary = sorted({w for line in lines for w in line.split(" ")})
    edited = []
    for line in lines:
        w = line.split(" ")
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        edited.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines + edited)], "doc_id long, text string")
    rows = line_dedup.line_report(docs).collect()
    check_lines(rows, dict(enumerate(lines + edited)))
    assert sum(bool(r.dropped) for r in rows if r.doc_id >= len(lines)) >= 0.9 * len(lines)


def test_many_small_sets_without_links(spark):
    """A bucket of 3 000 sets of ten items, none of them linked."""
    rng = random.Random(4)
    sets = [(i, rng.sample(range(40), 10)) for i in range(3000)]
    frame = spark.createDataFrame(sets, "id long, items array<long>")
    members = colliding(frame.select("id", F.lit(7).cast("long").alias("key")))
    got = {r.id: r.root for r in linked(members, frame, 95, 100).collect()}
    by_set = collections.defaultdict(list)
    for i, s in sets:
        by_set[frozenset(s)].append(i)
    assert got == {i: min(own) for own in by_set.values() if len(own) > 1 for i in own}


def test_members_compared_with_the_centre_are_done(spark, monkeypatch):
    """Buckets of up to three members are settled by the stars alone."""
    def more(*_):
        raise AssertionError("members that have no pair left")

    monkeypatch.setattr(links, "able", more)
    monkeypatch.setattr(links, "_across", more)
    sets = [(i, list(range(10 * i, 10 * i + 10))) for i in range(6)] + [(6, list(range(50, 59)))]
    frame = spark.createDataFrame(sets, "id long, items array<long>")
    buckets = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 2), (2, 3), (3, 4), (3, 5), (3, 6), (4, 0), (4, 3)],
                                    "key long, id long")
    assert {r.id: r.root for r in linked(colliding(buckets), frame, 80, 100).collect()} == {5: 5, 6: 5}


def test_marks_keep_every_key_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).select(F.xxhash64("id").alias("key")).union(spark.range(2).select("id"))
    rows = spark.range(40_000).select("id", F.xxhash64("id").alias("key")) \
        .union(spark.createDataFrame([(-1, 0), (-2, 1), (-3, None)], "id long, key long"))
    left = {r.id for r in maybe_in(rows, "key", written(keys, "test-marks")).collect()}
    assert {*range(0, 40_000, 2), -1, -2} <= left and -3 not in left and len(left) < 21_500


def test_coordinates_are_short_and_keep_their_order(spark):
    """Minima are what line dedup shuffles most of: 24 bits each, in the order of the halves they come from."""
    frame = spark.range(2000).select(F.xxhash64("id").alias("x"))
    rows = frame.select("x", line_dedup._low("x").alias("low"), line_dedup._high("x").alias("high")).collect()
    assert all(0 <= r.low < 1 << 24 and -1 << 23 <= r.high < 1 << 23 for r in rows)
    for of, part in ((lambda r: r.x & 0xFFFFFFFF, "low"), (lambda r: r.x >> 32, "high")):
        values = [r[part] for r in sorted(rows, key=of)]
        assert values == sorted(values) and len(set(values)) > 1990


def test_words_are_taken_in_one_step(spark):
    """The shingles that signatures are made of begin at words and, in longer runs, from the 13th character on."""
    for line in ("one  two\tthree", "a" + "bcdefghijklm" * 3 + " x", "x" * 12 + " y" * 9, " é日本語" * 5, "z", "日本語の" * 9 + "。"):
        want = [line[i:i + 7] for i in range(len(line)) if not line[i].isspace()
                and (not line[:i] or line[i - 1].isspace() or i >= 12 and not re.search(r"\s", line[i - 12:i]))]
        frame = spark.createDataFrame([(line,)], "line string")
        assert frame.select(F.regexp_extract_all("line", F.lit(line_dedup.CHOSEN), F.lit(1))).first()[0] == want


def test_lines_need_no_python(spark):
    plan = line_dedup.without_repeated_lines(documents(spark, SF_SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_lines_meet_by_shingles_at_every_position(spark):
    """Lines that end in short words: one changed letter is in few shingles, but in most of those that begin at words."""
    rng = random.Random(8)
    by_id = {}
    for i in range(60):
        head = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12 + i))
        by_id[2 * i], by_id[2 * i + 1] = (f"{head} {' '.join('abcd')} {end}" for end in "ef")
    docs = spark.createDataFrame(sorted(by_id.items()), "doc_id long, text string")
    rows = line_dedup.line_report(docs).collect()
    check_lines(rows, by_id)
    assert sum(r.n_dropped for r in rows) == 60


def test_line_signatures_by_size_of_set(spark):
    """Sets of all sizes have bands, next ones share a kind, and similar sets meet."""
    rng = random.Random(9)
    lines = ["".join(chr(rng.randrange(97, 123)) for _ in range(n)) for n in range(1, 160)] + ["日本語😀 " * 9]
    frame = spark.createDataFrame([(2 * i + j, x[:len(x) - j * (len(x) // 10)]) for i, x in enumerate(lines) for j in (0, 1)],
                                  "id long, line string")
    keys = collections.defaultdict(set)
    for r in line_dedup.signatures(frame).collect():
        assert len(set(r["keys"])) == line_dedup.BANDS and not keys[r.id] & set(r["keys"])
        keys[r.id] |= set(r["keys"])
    assert all(bool(keys[2 * i] & keys[2 * i + 1]) or len(x) - 6 < 10 for i, x in enumerate(lines))
    got = frame.select("line", line_dedup.shingles(F.col("line")).alias("h")).collect()
    assert all(len(set(r.h)) == len(line_set(r.line)) and len(r.h) == max(1, len(r.line) - 6) for r in got)


def test_line_tables_go_when_they_are_read(spark):
    """What the steps of line dedup wrote does not add up on disk."""
    base = os.path.dirname(written(spark.range(1), "one")._scratch).removeprefix("file:")
    before = set(os.listdir(base))
    rows = line_dedup.line_report(documents(spark, SF_SMALL)).collect()
    left = {x.rpartition("-")[0] for x in set(os.listdir(base)) - before}
    assert rows and "classes" in left and not left & {"bands", "twice", "rest", "members", "wanted", "ids", "near-lines", "sets", "several"}


def test_shuffles_of_written_tables_go_at_once(spark):
    """Shuffle files go when the job ends, not when the driver happens to collect its garbage."""
    def shuffles():
        held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks().mkString(",")
        return {b for b in held.split(",") if b.startswith("shuffle")}
    before = shuffles()
    table = written(spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count(), "one")
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and table.count() == 97
    freed(table)
    assert not os.path.exists(table._scratch.removeprefix("file:"))


def test_line_signatures_hold_a_number_a_band(spark):
    """What the executors hold and shuffle for a line is one number for each band."""
    lines = spark.range(9).select("id", F.col("id").cast("string").alias("line"))
    plan = line_dedup.signatures(lines)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("min(") == 2 * line_dedup.BANDS and "partial_min(" in plan


# -- passages -------------------------------------------------------------------------

def brute_passages(by_id):
    owners = collections.defaultdict(set)
    w = {d: brute.words(t) for d, t in by_id.items()}
    for d, own in w.items():
        for i in range(len(own) - 49):
            owners[tuple(own[i:i + 50])].add(d)
    covered = {}
    for d, own in w.items():
        hit = set()
        for i in range(len(own) - 49):
            if len(owners[tuple(own[i:i + 50])]) > 1:
                hit.update(range(i, i + 50))
        if hit:
            covered[d] = hit
    return covered, owners, w


def check_passages(rows, by_id):
    covered, owners, w = brute_passages(by_id)
    got = collections.defaultdict(set)
    for r in rows:
        assert r.other_doc_id != r.doc_id and r.end_word - r.start_word >= 50
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert set(got) == set(covered)
    for d, own in got.items():
        assert own <= covered[d]
    assert sum(map(len, got.values())) == sum(map(len, covered.values()))


def test_passages_equal_brute_force(spark):
    check_passages(queries.op3_repeated_passages(spark, SF_CHECK).collect(), texts(documents(spark)))


@pytest.mark.parametrize("partitions", [4, 37])
def test_passages_hot_and_awkward(spark, partitions):
    passage = " ".join(base_text(77, 55))
    own = [" ".join(base_text(500 + i, 90)) + f"\n{passage}\t" + " ".join(base_text(900 + i, 30)) for i in range(300)]
    own += hot_texts() + [" ".join(base_text(77, 49)), passage.upper(), " ".join(base_text(78, 50)) * 1]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(own)], "doc_id long, text string, start_word int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        check_passages(repeats.repeated_passages(docs).collect(), dict(enumerate(own)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert repeats.repeated_passages(docs.limit(0)).count() == 0


def check_passages_exactly(rows, by_id):
    """Every word of every window that stands in another document, no more."""
    check_passages(rows, by_id)
    covered, _, _ = brute_passages(by_id)
    got = collections.defaultdict(set)
    for r in rows:
        got[r.doc_id].update(range(r.start_word, r.end_word))
    assert got == covered


def near_copies(n, length, seed):
    rng = random.Random(seed)
    base = base_text(seed, length)
    return [" ".join(f"e{rng.randrange(10 ** 6)}" if rng.random() < 0.05 else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("n", [60, 300])
def test_passages_of_near_copies_exactly(spark, n):
    own = dict(enumerate(near_copies(n, 300, n)))
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    check_passages_exactly(repeats.repeated_passages(docs).collect(), own)


def test_passages_between_longer_matches_on_one_side(spark):
    # around each of 40 shared runs of 50 words, one document shares more words
    # to the right of it and one more to the left, both of too few in all
    own = []
    for k in range(40):
        run, a, b = base_text(3000 + k, 50), base_text(4000 + k, 60), base_text(5000 + k, 60)
        own += [a + run + b, base_text(6000 + k, 60) + run + base_text(7000 + k, 60)]
        for cut in range(2, 34, 3):
            own.append(base_text(8000 + 40 * cut + k, 30) + run[cut:] + b[:cut - 1])
            own.append(a[len(a) - cut + 1:] + run[:50 - cut] + base_text(9900 + 40 * cut + k, 30))
    own = {i: " ".join(w) for i, w in enumerate(own)}
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    check_passages_exactly(repeats.repeated_passages(docs).collect(), own)


# -- vectors ----------------------------------------------------------------------------

def check_vectors(rows, vectors):
    """vectors: (vec_id, embedding, label)."""
    unit = {}
    for i, v, label in vectors:
        ok = v is not None and label is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)
        if ok and any(v):
            x = np.array(v, np.float64)
            unit[i] = (label, x / np.linalg.norm(x))
    links = []
    for label in {u[0] for u in unit.values()}:
        ids = sorted(i for i, u in unit.items() if u[0] == label)
        x = np.array([unit[i][1] for i in ids])
        a, b = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
        links += [(ids[i], ids[j]) for i, j in zip(a, b)]
    want = brute.roots([i for i, _, _ in vectors], links)
    n = collections.Counter(x for p in links for x in p)
    for r in rows:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)


def test_vectors_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    rows = queries.op6_embedding_near_dup(spark, SF_CHECK).collect()
    assert len(rows) == table.count()
    check_vectors(rows, [(r.vec_id, r.embedding, r.label) for r in table.collect()])


def test_vectors_recall_on_the_bench_table(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    rows = queries.op6_embedding_near_dup(spark, sf).collect()
    total = 0
    for label in {r.label for r in table}:
        x = np.array([r.embedding for r in table if r.label == label], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        total += int((x @ x.T >= 0.98).sum()) - len(x)
    assert sum(r.n_links for r in rows) >= 0.9 * total


def test_vectors_hot_and_awkward(spark):
    rng = np.random.default_rng(1)
    own = [(i, rng.standard_normal(8).tolist(), 1) for i in range(300)]
    hot = rng.standard_normal(8)
    own += [(1000 + i, hot.tolist(), 1) for i in range(200)]
    own += [(2000 + i, (hot + rng.standard_normal(8) * 0.08).tolist(), 1) for i in range(1500)]
    own += [(93000, None, 1), (93001, [0.0] * 8, 1), (93002, [1.0, None] * 4, 1), (93003, [float("nan")] * 8, 1),
            (93004, [float("inf")] * 8, 1), (93005, hot.tolist(), None), (93006, hot.tolist(), 2), (93007, [], 1),
            (93008, (hot * 1e-30).tolist(), 1), (93009, (-hot).tolist(), 1), (93010, [-0.0] * 8, 1)]
    table = spark.createDataFrame([(*r, "clash") for r in own],
                                  "vec_id long, embedding array<float>, label int, kept string")
    true = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    check_vectors(embed_dedup.embedding_links(table).collect(), true)
    assert embed_dedup.embedding_links(table.limit(0)).count() == 0
    twice = embed_dedup.embedding_links(table.union(table.filter("vec_id < 3"))).collect()
    assert len(twice) == len(own) + 3
    check_vectors(twice, true)


def test_windows_emit_what_counting_all_pairs_finds():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 24))
    x[450:] = x[:450] + rng.standard_normal((450, 24)) * 0.2
    p = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ embed_dedup.directions(24)
    group, side = rng.integers(0, 3, 900), rng.integers(0, 2, 900)
    far = np.abs(p[:, None, :] - p[None, :, :])
    near = ((far <= embed_dedup.HALF).sum(axis=2) >= embed_dedup.least_count()) \
        & (far[:, :, 0] <= embed_dedup.WIDE) & (group[:, None] == group[None, :])
    want = set(zip(*(a.tolist() for a in np.nonzero(np.triu(near, 1)))))

    def emitted(sides):
        pairs = [(min(a, b), max(a, b)) for i, j in embed_dedup.candidates(p, group, sides)
                 for a, b in zip(i.tolist(), j.tolist())]
        assert len(pairs) == len(set(pairs))
        return set(pairs)

    assert len(want) > 50 and emitted(np.full(900, 2)) == want
    assert emitted(side) == {(a, b) for a, b in want if side[a] != side[b]}


def test_cuts_bring_pairs_at_the_limit_together():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((20_000, 16))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((20_000, 16))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for k in (1, 4, 9):
        shared = embed_dedup.cut_keys(a, k) == embed_dedup.cut_keys(b, k)
        assert shared.shape[1] == embed_dedup.tables(k) and shared.any(axis=1).mean() > 0.9999


@pytest.mark.parametrize("block", [48, 4096])
def test_vectors_in_many_cuts_link_once(spark, monkeypatch, block):
    """Cheap moves make small labels use many cuts, and small blocks cut their lists."""
    monkeypatch.setattr(embed_dedup, "MOVE", 0.01)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 12))
    x[300:] = x[rng.integers(0, 40, 400)] + rng.standard_normal((400, 12)) * 0.1
    own = [(i, v.tolist(), 1 if i % 3 else 2) for i, v in enumerate(x)]
    table = spark.createDataFrame(own, "vec_id long, embedding array<double>, label int")
    check_vectors(embed_dedup.embedding_links(table).collect(), own)


# -- pipeline -------------------------------------------------------------------------

def test_pipeline_stages_against_plain_versions(spark):
    from .test_text_operators import expected_digests
    docs = documents(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        out = stage(spark, docs, SF_CHECK)
        if k < 4:
            assert out.columns == docs.columns
            path = f"{spark.conf.get('spark.checkpoint.dir')}/test-pipeline-{k}"
            out.write.mode("overwrite").parquet(path)
            after = texts(docs := spark.read.parquet(path))
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
            wrong = sum((i in after) != (q == 1) for i, q in labels.items())
            assert wrong <= 0.02 * len(labels) and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            _, dropped = brute_lines(before)
            left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in set(dropped.get(i, ())))
                    for i, t in before.items()}
            assert after == {i: t for i, t in left.items() if t.strip() or not before[i].strip()}
            assert len(after) < len(before)
        elif name == "near_dedup":
            want = brute.roots(before, brute.near_links(before))
            assert after == {i: t for i, t in before.items() if want[i] == i}
        elif name == "decontamination":
            items = {r.item_id: r.text for r in spark.read.parquet(f"{SF_CHECK}/benchmark.parquet").collect()}
            bad = {d for d, _ in brute.contained(before, items)}
            assert after == {i: t for i, t in before.items() if i not in bad}
        else:
            got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
            assert got == {i: expected_digests(t) for i, t in before.items()}
            whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF_CHECK).collect()}
            assert whole == {i: v[0] for i, v in got.items()}


def test_pipeline_on_awkward_documents(spark, tmp_path):
    docs = documents(spark, SF_SMALL)
    odd = spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", "en", "s", 0),
                                 (None, "w " * 40, "en", "s", 80)], docs.schema)
    whole = docs.union(odd).withColumn("score", F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, whole, SF_SMALL)
        assert out.columns == whole.columns and out.count() <= whole.count()
        assert stage(spark, whole.limit(0), SF_SMALL).count() == 0
    assert quality.LIMIT == 0.3
