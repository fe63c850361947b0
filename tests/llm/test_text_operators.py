"""Operators that work on one text at a time, and decontamination and sharding."""

import hashlib
import struct
import zlib

import pytest

from skein.llm import bpe, decontaminate, licenses, quality, queries, secrets, sharding
from tests.conftest import SF_CHECK

from . import brute

AWKWARD = [None, "", " ", "\n\t", "a", "a b c d", "A b\x0bc\x0cd e f", "Ǆ İ ſ K Σας ΟΔΟΣ", "x" * 70_000,
           "the " * 9000, "a\x00b", "é́ é     \x85 \x1c|", "<|endoftext|> x<|startoftext|>y <|end",
           "it's we'll I'D 3.14 №½ ١٢ 日本語 🙂🙂", "aaaa aaaaa ababab", "don''t 's 'sx"]


def awkward(spark):
    rows = [(i, t, "z", -1) for i, t in enumerate(AWKWARD)] + [(None, "null id here", "z", 0), (3, AWKWARD[3], "z", -1)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_tokens int")


def empty(spark):
    return awkward(spark).limit(0)


def documents(spark):
    return spark.read.parquet(f"{SF_CHECK}/documents.parquet")


def texts(spark):
    return {r.doc_id: r.text for r in documents(spark).collect()}


# -- BPE ---------------------------------------------------------------------

def expected_digests(text):
    from tokenizers import Tokenizer
    tok = expected_digests.__dict__.setdefault("tok", Tokenizer.from_file(queries.tokenizer_path()))
    ids = tok.encode(text or "", add_special_tokens=False).ids
    shown = tok.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
            hashlib.sha256(shown.encode()).hexdigest())


def test_bpe_equals_the_public_library(spark):
    own = texts(spark)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
           for r in queries.op2_bpe_round_trip(spark, SF_CHECK).collect()}
    assert got == {i: expected_digests(t) for i, t in own.items()}


def test_bpe_awkward_texts(spark):
    docs = awkward(spark)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                 for r in bpe.encode_digests(docs, queries.tokenizer_path()).collect())
    want = sorted((r.doc_id if r.doc_id is not None else -1, *expected_digests(r.text)) for r in docs.collect())
    assert got == want
    assert bpe.encode_digests(empty(spark), queries.tokenizer_path()).count() == 0


def test_bpe_ids_and_digests_agree(spark):
    docs, path = awkward(spark), queries.tokenizer_path()
    whole = sorted((str(r.doc_id), len(r.ids), hashlib.sha256(r.decoded.encode()).hexdigest())
                   for r in bpe.encode(docs, path).collect())
    assert whole == sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256)
                           for r in bpe.encode_digests(docs, path).collect())


def test_bpe_random_words():
    import random
    rng = random.Random(5)
    enc = bpe.Encoder(bpe.Vocabulary(queries.tokenizer_path()))
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.tokenizer_path())
    lines = ["".join(rng.choice("aaabcdeéthin 's.1ñß") for _ in range(rng.randrange(60))) for _ in range(800)]
    for line, (ids, _) in zip(lines, enc.encode(lines)):
        assert ids.tolist() == tok.encode(line, add_special_tokens=False).ids, line


# -- secrets -----------------------------------------------------------------

def check_secrets(rows, by_id):
    for r in rows:
        want = brute.base_spans(by_id[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r.doc_id, joined, r.spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want)
                                                          for kind in ("assign", "access", "hex"))
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_secrets_on_documents(spark):
    rows = queries.op4_secret_scan(spark, SF_CHECK).collect()
    assert len(rows) == documents(spark).count()
    check_secrets(rows, texts(spark))


def test_secrets_awkward(spark):
    payload = "abcdefghijklmnopqrstuvwxyz0123"
    good = "ghp_" + payload + secrets.checksum(payload)
    bad = "ghp_" + payload + "zzzzzz"
    own = ["token=secret=abcdefgh", "API_KEY : 'abc", "apikey='abcdef'", "PassWord\":\"xyzzy-12 passwd=1",
           "AKIA" + "A" * 16 + "x AKIAB", "é日 token = deadbeefdeadbeefdeadbeef", "f" * 23 + " " + "0" * 24,
           "toKen=abcdef token=abcdef", "tok", "en=abcdefgh", good + " " + bad, "ſecret=abcdefg toKen:abcdefg",
           "secret" * 50 + "=aaaaaaa", "token==abcdefgh", "a" * 30_000, f"npm_{payload}{secrets.checksum(payload)}x",
           *AWKWARD]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(own)], "doc_id long, text string, spans string")
    rows = secrets.secret_digests(docs).collect()
    check_secrets(rows, dict(enumerate(own)))
    found = {r.doc_id: r.spans for r in rows}
    assert "github:0:40" in found[10] and found[10].count("github") == 1
    assert "npm" not in found[15]
    assert secrets.secret_digests(empty(spark)).count() == 0
    assert secrets.secret_digests(awkward(spark)).count() == len(AWKWARD) + 2


# -- licences ----------------------------------------------------------------

def check_licenses(rows, by_id):
    for r in rows:
        n, places = brute.phrase_places(by_id[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(places)), r.doc_id
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels


def test_licenses_on_documents(spark):
    rows = queries.op9_license_scan(spark, SF_CHECK).collect()
    check_licenses(rows, texts(spark))
    assert any("notice:gpl" in r.labels for r in rows)


def test_license_templates(spark):
    own = ["Released under the MIT License.", "released under the terms of the Expat MIT license",
           "released under some MIT license", "Licensed under the Apache License, Version 2.0",
           "licensed under the apache license 2.0", "licensed under the apache license version 3.0",
           "Licensed under CC BY-NC 4.0.", "mit", "license mit license mit license", "general public", *AWKWARD]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(own)], "doc_id long, text string, label string")
    rows = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    check_licenses(rows.values(), dict(enumerate(own)))
    assert [rows[i].labels for i in range(9)] == [
        "mit,notice:mit", "mit,notice:mit", "mit", "apache,notice:apache", "apache,notice:apache", "apache",
        "notice:cc", "", "mit"]
    assert [rows[i].score for i in (0, 2, 7)] == [1.0, 0.5, 0.0]
    assert licenses.license_report(empty(spark)).count() == 0


def expansions(template, fill):
    """Every wording of a template: each optional region in or out, regions to be
    replaced with ``fill`` words."""
    import itertools
    import re
    parts = re.split(r"<<opt>>(.*?)<<end>>", " ".join(template.split()))
    for chosen in itertools.product([True, False], repeat=len(parts) // 2):
        text = "".join(p if i % 2 == 0 else p * chosen[i // 2] for i, p in enumerate(parts))
        yield re.sub(r"<<var:(\d+)-(\d+)>>", lambda m: " ".join(["Someone"] * min(max(fill, int(m[1])), int(m[2]))), text).split()


def plain_matches(words, templates):
    """(label, start, end) of the longest wording of each template at each place."""
    out = set()
    for label, template in templates:
        wordings = {tuple(w.lower() for w in e) for fill in range(1, 13) for e in expansions(template, fill)}
        for start in range(len(words)):
            ends = [start + len(e) for e in wordings if len(words) - start >= len(e) and all(
                a in (b, "someone") for a, b in zip(e, words[start:start + len(e)]))]
            if ends:
                out.add((label, start, max(ends)))
    return out


def test_license_texts_equal_a_plain_matcher(spark):
    """Every template's wordings, whole, with one word altered, cut short and in other
    words, against all expansions of all templates."""
    import random
    rng = random.Random(8)
    templates = [(label, t) for label, _, t in licenses.TEMPLATES]
    own = []
    for _, t in templates:
        for e in rng.sample(list(expansions(t, 3)), 2 if "<<opt>>" in t else 1):
            at = rng.randrange(len(e))
            own += [e, e[:at] + ["altered"] + e[at + 1:], e[:-1], ["so", "says"] + e + ["and", "more"]]
    docs = spark.createDataFrame([(i, ", ".join(e).upper()) for i, e in enumerate(own)], "doc_id long, text string")
    got = {r.doc_id: {(m.label, m.start, m.end) for m in r.matches} for r in licenses.license_scan(docs).collect()}
    for i, e in enumerate(own):
        assert got[i] == plain_matches([w.lower() for w in e], templates), e
    labels = {label for m in got.values() for label, _, _ in m}
    assert labels == {label for label, _ in templates}


def test_license_variants_are_told_apart(spark):
    text = {label: " ".join(next(expansions(t, 2))) for label, _, t in licenses.TEMPLATES if label.startswith("text:")}
    own = [*text.values(), text["text:mit"].replace("merge", "never merge"), text["text:bsd-3"].split("this software is")[0]]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    rows = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_report(docs).collect()}
    for i, label in enumerate(text):
        assert {x for x in rows[i] if x.startswith("text:")} == {label}
    assert rows[len(text)] == {"notice:mit"} and rows[len(text) + 1] == {"notice:bsd"}


# -- decontamination -----------------------------------------------------------

def found_pairs(docs, items):
    return {(r.doc_id, r.item_id): (r.n_item, r.n_shared)
            for r in decontaminate.contaminated(docs, items).collect()}


def test_decontamination_equals_brute_force(spark):
    items = spark.read.parquet(f"{SF_CHECK}/benchmark.parquet")
    want = brute.contained(texts(spark), {r.item_id: r.text for r in items.collect()})
    assert want and found_pairs(documents(spark), items) == want


def test_short_items_are_found_inside_longer_texts(spark):
    asked = {1: "alpha beta gamma delta", 2: "Omega", 3: "two words", 4: "five words make one shingle", 5: " "}
    own = {0: "alpha beta gamma delta", 1: "x y ALPHA beta gamma delta z w", 2: "alpha beta gamma x delta", 3: "omega",
           4: "an omega in " + "filler " * 5000, 5: "two  words", 6: "words two", 7: "so five words make one shingle here",
           8: None, 9: "delta alpha beta gamma", 10: " ".join(f"w{i}" for i in range(9000)) + " two words"}
    docs = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    items = spark.createDataFrame(list(asked.items()), "item_id long, text string")
    want = brute.contained(own, asked)
    assert {d for d, i in want if i == 1} == {0, 1} and {d for d, i in want if i == 2} == {3, 4}
    assert found_pairs(docs, items) == want


#: Two words of 1 024 letters that a polynomial modulo 2**64 can't tell apart.
TWINS = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024)) for flip in (0, 1)]


def test_words_that_a_polynomial_confuses_differ():
    from skein.llm import kernel
    a, b = kernel.hash_words(TWINS)
    assert a != b and kernel.hash_words([TWINS[0].upper()])[0] == a


def test_decontamination_tells_crafted_words_apart(spark):
    text = "one two three four {} five six seven eight".format
    docs = spark.createDataFrame([(0, text(TWINS[0])), (1, text(TWINS[1]))], "doc_id long, text string")
    items = spark.createDataFrame([(7, text(TWINS[0]))], "item_id long, text string")
    assert set(found_pairs(docs, items)) == {(0, 7)}


def test_decontamination_awkward(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    short = "alpha beta"
    own = [item, f"x y {item} z", f"{item.replace('twelve', 'x')}", "one two three four five " * 3000, short,
           f"{short} gamma", " ".join(f"w{i}" for i in range(50_000)) + " " + item, item.upper(),
           "one two three four five six seven eight x nine ten eleven twelve", None, "", item]
    docs = spark.createDataFrame([(i % 11, t, "clash") for i, t in enumerate(own)],
                                 "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, item, 0.5), (2, short, 0.5), (3, None, 0.5), (4, "", 0.5), (1, item, 0.5)],
                                  "item_id long, text string, containment double")
    want = {}
    for i, t in enumerate(own):
        for (_, q), v in brute.contained({0: t}, {1: item, 2: short}).items():
            want[i % 11, q] = max(want.get((i % 11, q), v), v, key=lambda x: x[1])
    assert found_pairs(docs, items) == want
    assert found_pairs(docs.limit(0), items) == found_pairs(docs, items.limit(0)) == {}
    assert decontaminate.decontaminated(docs, items).columns == docs.columns
    kept = {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()}
    assert kept == {i % 11 for i in range(len(own))} - {d for d, _ in want}


# -- sharding ------------------------------------------------------------------

def check_shards(rows, by_id, shards=16):
    assert len({r.doc_id for r in rows}) == len(by_id)
    slots = {}
    for r in rows:
        text = by_id[r.doc_id]
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == brute.crc(text)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_sharding_is_near_equal_and_keeps_groups(spark):
    by_id = texts(spark)
    rows = queries.op5_vector_sharding(spark, SF_CHECK).collect()
    check_shards(rows, by_id)
    size, place = {}, {}
    for r in rows:
        size[r.shard] = size.get(r.shard, 0) + r.size
        place.setdefault(by_id[r.doc_id], set()).add(r.shard)
    assert max(size.values()) <= 1.01 * min(size.values())
    assert all(len(s) == 1 for s in place.values())


def test_sharding_splits_a_group_that_no_shard_holds(spark):
    own = ["hot text " * 20] * 1500 + [f"text {i} " * (i % 37) for i in range(3000)] + [None, "", None]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(own)], "doc_id long, text string, shard int")
    rows = sharding.shard(docs).collect()
    check_shards(rows, dict(enumerate(own)))
    size = [sum(r.size for r in rows if r.shard == s) for s in range(16)]
    assert max(size) <= 1.02 * min(size)
    assert sharding.shard(docs.limit(0)).count() == 0
    assert len(sharding.shard(docs.limit(3)).collect()) == 3


def plain_packing(groups, shards=16):
    """Groups (bytes, tokens, rows) from heavy to light, each to the best bin."""
    totals = [max(sum(g[k] for g in groups), 1) for k in range(3)]
    left = [[1 / shards] * 3 for _ in range(shards)]
    out = {}
    for i in sorted(range(len(groups)), key=lambda i: (-groups[i][0], i)):
        v = [groups[i][k] / totals[k] for k in range(3)]
        fits = [s for s in range(shards) if left[s][0] >= v[0]]
        pick = max(fits, key=lambda s: (sum(a * b for a, b in zip(left[s], v)), left[s][0], -s)) if fits else \
            max(range(shards), key=lambda s: (left[s][0], -s))
        left[pick] = [a - b for a, b in zip(left[pick], v)]
        out[i] = pick
    return out, left


def test_packing_is_the_plain_greedy_one():
    import numpy as np
    rng = np.random.default_rng(3)
    groups = [tuple(int(x) for x in rng.integers(1, 2000, 3)) for _ in range(400)]
    want, left = plain_packing(groups)
    got = sharding.pack(np.array(groups, float), 16)
    own = np.zeros((16, 3))
    np.add.at(own, got, np.array(groups, float) / np.array(groups, float).sum(0))
    assert np.allclose(np.sort(1 / 16 - own, axis=0), np.sort(np.array(left), axis=0), atol=1e-9)
    assert sum(got[i] == s for i, s in want.items()) >= 0.99 * len(groups)


@pytest.mark.parametrize("units", [1 << 16, 200])
def test_every_group_is_placed_by_the_rule(spark, monkeypatch, units):
    """Bytes and tokens come out balanced whether groups are packed in one part or in
    several of few groups, whose bins can't be as even."""
    monkeypatch.setattr(sharding, "UNITS", units)
    by_id = texts(spark)
    rows = queries.op5_vector_sharding(spark, SF_CHECK).collect()
    check_shards(rows, by_id)
    sums = {}
    for r in rows:
        own = sums.setdefault(r.shard, [0, 0, 0])
        own[0] += r.size
        own[1] += len(brute.words(by_id[r.doc_id]))
        own[2] += 1
    assert len(sums) == 16
    for k, most in ((0, 1.01 if units > 1000 else 1.06), (1, 1.1)):
        assert max(s[k] for s in sums.values()) <= most * min(s[k] for s in sums.values())
    if units > 1000:
        groups = {}
        for i, t in by_id.items():
            g = groups.setdefault(t, [0, 0, 0])
            g[0] += len((t or "").encode()) + 1
            g[1] += len(brute.words(t))
            g[2] += 1
        _, left = plain_packing(sorted(map(tuple, groups.values())))
        total = sum(len((t or "").encode()) + 1 for t in by_id.values())
        spread = (max(s[0] for s in sums.values()) - min(s[0] for s in sums.values())) / total
        assert spread <= max(x[0] for x in left) - min(x[0] for x in left) + 1e-3


# -- quality -------------------------------------------------------------------

@pytest.fixture(scope="module")
def model(spark):
    return quality.train(documents(spark), spark.read.parquet(f"{SF_CHECK}/labels.parquet"))


def test_quality_on_held_out_labels(spark, model):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    rows = [r for r in quality.scored(documents(spark), model).collect() if r.doc_id in labels]
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right = sum(r.predicted == labels[r.doc_id] for r in out)
    assert len(out) > 30 and right >= 0.95 * len(out)
    assert sum(r.predicted for r in out if labels[r.doc_id]) >= 0.98 * sum(labels[r.doc_id] for r in out)


def test_quality_awkward(spark, model):
    docs = awkward(spark).withColumnRenamed("spans", "score")
    rows = quality.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(docs.limit(0), model).count() == 0
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted)


def test_quality_without_labels(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([(None, 1, 0), (0, None, 0), (2, 7, 1)], "doc_id long, quality int, toxic int")
    rows = quality.scored(docs, quality.train(docs, none)).collect()
    assert {round(r.score, 6) for r in rows} == {0.5}
    assert quality.scored(docs, quality.train(docs, none.limit(0))).count() == docs.count()


def test_quality_uses_pairs(model):
    assert len(model.pairs) == quality.PAIRS and model.tables.any()
