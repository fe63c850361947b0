"""Plain versions of the operators' definitions, for small tables."""

import collections
import hashlib
import re
import zlib

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_links(texts):
    """Pairs with 100 * intersection >= 75 * union, by an inverted list."""
    sets = {i: shingles(t) for i, t in texts.items()}
    held = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    common = collections.Counter()
    for who in held.values():
        for n, a in enumerate(who):
            for b in who[n + 1:]:
                common[min(a, b), max(a, b)] += 1
    return [(a, b) for (a, b), c in common.items()
            if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]


def contained(docs, items):
    out = {}
    asked = {i: shingles(t) for i, t in items.items()}
    short = {len(words(t)) for t in items.values()} & {1, 2, 3, 4}
    for d, text in docs.items():
        own, w = shingles(text), words(text)
        own |= {tuple(w[i:i + n]) for n in short for i in range(len(w) - n + 1)}
        for i, q in asked.items():
            if q and 100 * len(q & own) >= 75 * len(q):
                out[d, i] = (len(q), len(q & own))
    return out


BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
                              .replace("(password|passwd|secret|token|api_?key)",
                                       "((?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                                                         for w in ("password", "passwd", "secret", "token", "api_?key")) + "))"))),
        ("access", re.compile(r"AKIA[A-Z0-9]+")), ("hex", re.compile(r"[0-9a-f]+"))]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), k, m.end()))
    return [(BASE[k][0], a, b) for a, k, b in sorted(out)]


def crc(text):
    return zlib.crc32((text or "").encode())


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def phrase_places(text):
    w = license_words(text)
    out = []
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), sorted(out)


def aligned(texts, encode_a, encode_b):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups text).
    encode_*: (id, bytes) of each token; ``texts`` in any order, repeats count."""
    rows, count = [], collections.Counter()
    for text in texts:
        a, b = (encode_a(text), encode_b(text)) if text else ([], [])
        whole = b" " + (text or "").encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        groups, left, right, links = [], [], [], []
        end_a, end_b, n_b = 0, 0, 0
        for i, raw in a:
            end_a += len(raw)
            left.append(i)
            while n_b < len(b) and end_b + len(b[n_b][1]) <= end_a:
                end_b += len(b[n_b][1])
                right.append(b[n_b][0])
                n_b += 1
            if end_a == end_b:
                links.append((left[-1], right[-1]))
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                left, right = [], []
        rows.append((len(a), len(b), links, ";".join(groups)))
        count.update(links)
    most = collections.defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    return [(n_a, n_b, len(links), len(links), sum(count[x] == most[x[1]] for x in links),
             sum(count[x] for x in links), shown) for n_a, n_b, links, shown in rows]


def best_path(score, switch):
    """Best total of a path through rows of scores."""
    value = score[0]
    for row in score[1:]:
        value = [row[j] + max(v - (switch if i != j else 0) for i, v in enumerate(value)) for j in range(len(row))]
    return max(value)


def trie(rows):
    """Nodes of the trie of (conv_id, turn, role, text) rows, as the contract has them."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((m[0], len(node), members[node[:-1]][0] if node else None, len(m), len(children[node]),
                   leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
                  for node, m in members.items())
