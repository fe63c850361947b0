"""Secret scans: keyword automaton, anchored patterns, checksum validation.

One Aho-Corasick pass over the lower-cased text finds the few places where a
keyword of a kind stands; only there the kind's pattern is tried, anchored at
the hit.  Runs of hexadecimal digits have no keyword and are found by one
vectorised pass over the bytes.  Tokens that embed a checksum (six base-62
digits of the CRC-32 of the payload) are accepted only when it is right.

Kinds: assign, access and hex as fixed patterns; github and npm tokens on top.
Spans are (kind, start, end) in code points, end exclusive.  Matches of one
kind are leftmost and do not overlap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

# fixed values
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*"""
                    r"""["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", re.ASCII)
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", re.ASCII)
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
            "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github",
            "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}


def checksum(payload: str) -> str:
    """Six base-62 digits of the payload's CRC-32."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def _accepted(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= LEAST_ASSIGN
    if kind == "access":
        return len(m[0]) >= LEAST_ACCESS
    return checksum(m[1]) == m[2]


def _automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _hex_runs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, _ = kernel.word_bounds(buf, offs, _HEX)
    long = ends - starts >= LEAST_HEX
    return starts[long], ends[long]


def block_spans(automaton, buf: np.ndarray, offs: np.ndarray) -> dict[int, list]:
    """Spans by text of one block, each (start, kind number, end)."""
    raw = buf.tobytes()
    lower = raw.lower().decode()                  # bytes: A-Z only, same length
    text = raw.decode()
    lead = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before a byte
    at = lead[offs]
    out: dict[int, list] = {}
    for b, e in zip(*_hex_runs(buf, offs)):
        t = int(np.searchsorted(offs, b, "right")) - 1
        out.setdefault(t, []).append((int(lead[b] - at[t]), 2, int(lead[e] - at[t])))
    done: dict[str, int] = {}
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in automaton.iter(lower))
    for start, kind in hits:
        if start < done.get(kind, 0):
            continue
        t = int(np.searchsorted(at, start, "right")) - 1
        m = PATTERNS[kind].match(text, start, int(at[t + 1]))
        if m is None:
            continue
        good = _accepted(kind, m)
        if good or kind in BASE_KINDS:
            done[kind] = m.end()
        if good:
            out.setdefault(t, []).append((start - int(at[t]), KINDS.index(kind), m.end() - int(at[t])))
    for spans in out.values():
        spans.sort()
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            found = block_spans(automaton, buf, offs)
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found.get(t, ())]
                    for t in range(hi - lo)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(rows, kind_of)],
                names=["doc_id", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> for every row, by start and
    then kind.  Null and empty texts have no spans; other columns are ignored;
    repeated rows give repeated results."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base kinds, and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return secrets(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        *[count(k).alias(f"n_{k}") for k in KINDS[3:]])
