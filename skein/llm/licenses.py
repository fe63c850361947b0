"""License scans: templates with optional and replaceable regions as automata.

``text:`` labels stand for the whole mandatory wording of a licence, each variant with
a template of its own; an altered or shortened text isn't accepted and has at most the
``notice:`` label of its opening or of a reference to the licence.

A template is wording with mark-up: ``<<opt>>...<<end>>`` may be left out and
``<<var:a-b>>`` stands for a to b arbitrary words.  Each template is compiled to
a non-deterministic automaton over word hashes; it accepts a run of words whose
mandatory wording matches exactly.  Automata start only where their first word
stands and only in texts that hold the template's trigger word, both found by
comparing arrays of word hashes.

Words: after lower-casing A-Z, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

# fixed values: base phrases and their labels
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# fixed values: the wording of public licences, in parts that several of them share
_MIT_GRANT = """permission is hereby granted free of charge to any person obtaining a copy of this software and
associated documentation files the software to deal in the software without restriction including without limitation
the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so"""
_MIT_NOTICE = """subject to the following conditions the above copyright notice and this permission notice
<<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software"""
_MIT_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not
limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
the <<var:1-8>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
arising from out of or in connection with the software or the use or other dealings in the software"""
_BSD_START = """redistribution and use in source and binary forms with or without modification are permitted
provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above
copyright notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form
must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
and or other materials provided with the distribution"""
_BSD_NAMES = """<<opt>>3<<end>> neither the name of <<var:1-12>> nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission"""
_BSD_END = """this software is provided by <<var:1-8>> as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event
shall <<var:1-8>> be liable for any direct indirect incidental special exemplary or consequential damages including
but not limited to procurement of substitute goods or services loss of use data or profits or business interruption
however caused and on any theory of liability whether in contract strict liability or tort including negligence or
otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_ISC_GRANT = "permission to use copy modify and <<opt>>or<<end>> distribute this software for any purpose with or " \
             "without fee is hereby granted"
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies"
_ISC_WARRANTY = """the software is provided as is and <<var:1-8>> disclaims all warranties with regard to this software
including all implied warranties of merchantability and fitness in no event shall <<var:1-8>> be liable for any
special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
performance of this software"""
_APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance
with the license you may obtain a copy of the license at <<var:1-12>> unless required by applicable law or agreed to in
writing software distributed under the license is distributed on an as is basis without warranties or conditions of
any kind either express or implied see the license for the specific language governing permissions and limitations
under the license"""

# fixed values: label, trigger word, template; ``text`` is a licence's whole mandatory
# wording, one template a variant, ``notice`` a reference to a licence or its opening
TEMPLATES = [
    ("notice:mit", "license", "released under <<opt>>the terms of<<end>> the <<opt>>expat<<end>> mit license"),
    ("notice:mit", "license", "licensed under <<opt>>the terms of<<end>> the mit license"),
    ("notice:mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of "
                                 "this software and associated documentation files the software"),
    ("notice:apache", "license", "licensed under the apache license <<opt>>version<<end>> 2 0"),
    ("notice:apache", "license", "you may not use this file except in compliance with the license"),
    ("notice:gpl", "license", "licensed under <<opt>>the terms of<<end>> the gnu <<opt>>lesser<<end>> "
                              "<<opt>>affero<<end>> general public license <<opt>>as published by the "
                              "free software foundation either<<end>> version <<var:1-2>>"),
    ("notice:gpl", "license", "redistribute it and or modify it under the terms of the gnu general public "
                              "license as published by the free software foundation"),
    ("notice:cc", "licensed", "licensed under <<opt>>a<<end>> <<opt>>creative commons<<end>> cc by "
                              "<<opt>>nc<<end>> <<opt>>nd<<end>> <<opt>>sa<<end>> <<var:1-2>>"),
    ("notice:bsd", "redistribution", "redistribution and use in source and binary forms with or without "
                                     "modification are permitted provided that the following conditions are met"),
    ("notice:isc", "permission", _ISC_GRANT),
    ("text:mit", "permission", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("text:mit-0", "permission", f"{_MIT_GRANT} {_MIT_WARRANTY}"),
    ("text:bsd-2", "redistribution", f"{_BSD_START} {_BSD_END}"),
    ("text:bsd-3", "redistribution", f"{_BSD_START} {_BSD_NAMES} {_BSD_END}"),
    ("text:isc", "permission", f"{_ISC_GRANT} {_ISC_NOTICE} {_ISC_WARRANTY}"),
    ("text:0bsd", "permission", f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    ("text:apache", "license", _APACHE),
]


class Automaton:
    """States in a row; ``word[s]`` is the hash that leads on, 0 any word;
    ``skip[s]`` lists states reachable without a word."""

    def __init__(self, template: str):
        self.word: list[int] = []
        self.skip: list[list[int]] = []
        opened: list[int] = []
        first: str | None = None
        for mark, word in re.findall(r"<<([^>]*)>>|(\w+)", template):
            if word:
                first = first or word
                self._add(int(kernel.hash_words([word])[0]))
            elif mark == "opt":
                opened.append(len(self.word))
                self._add(None)
            elif mark == "end":
                self.skip[opened.pop()].append(len(self.word))
            else:
                low, high = map(int, mark.removeprefix("var:").split("-"))
                for k in range(high):
                    at = len(self.word)
                    self._add(0)
                    if k >= low:
                        self.skip[at].append(at + 1)
        if opened or self.word[0] is None or not self.word[0]:
            raise ValueError("a template begins with a mandatory word and closes its regions")
        self.first = self.word[0]
        self.size = len(self.word)

    def _add(self, word: int | None) -> None:
        self.word.append(word)
        self.skip.append([len(self.word)] if word is None else [])

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            s = todo.pop()
            for t in self.skip[s] if s < self.size else ():
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def run(self, words: list[int], start: int) -> int | None:
        """End of the longest accepted run from ``start``, or None."""
        now, best = self._closed({0}), None
        for i in range(start, len(words)):
            now = self._closed({s + 1 for s in now if s < self.size
                                and self.word[s] is not None and self.word[s] in (0, words[i])})
            if self.size in now:
                best = i + 1
            if not now:
                break
        return best


def compiled(templates=TEMPLATES) -> list[tuple[str, int, Automaton]]:
    return [(label, int(kernel.hash_words([trigger])[0]), Automaton(text))
            for label, trigger, text in templates]


def _phrase_places(words: np.ndarray, text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    k = len(phrase)
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = text[:n] == text[k - 1:]
    for j, h in enumerate(phrase):
        ok &= words[j:j + n] == h
    return np.flatnonzero(ok)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    phrases = [(label, kernel.hash_words(p.split())) for label, p in PHRASES.items()]
    automata = compiled()
    triggers = np.array([t for _, t, _ in automata], np.uint64)
    names = pa.list_(pa.string())
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for lo, hi, buf, offs in kernel.text_blocks(batch.column(1)):
            words, at = kernel.word_hashes(buf, offs, kernel.ALNUM)
            text = np.repeat(np.arange(hi - lo), np.diff(at))
            places: dict[int, list[tuple[int, str]]] = {}
            for label, phrase in phrases:
                for p in _phrase_places(words, text, phrase):
                    t = int(text[p])
                    places.setdefault(t, []).append((int(p - at[t]), label))
            found: dict[int, list] = {}
            for t in np.unique(text[np.isin(words, triggers)]).tolist():
                own = words[at[t]:at[t + 1]]
                held = set(own[np.isin(own, triggers)].tolist())
                plain = own.tolist()
                for label, trigger, automaton in automata:
                    if trigger in held:
                        for s in np.flatnonzero(own == np.uint64(automaton.first)).tolist():
                            e = automaton.run(plain, s)
                            if e is not None:
                                found.setdefault(t, []).append({"label": label, "start": s, "end": e})
            rows = range(hi - lo)
            base = [sorted(places.get(t, ())) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at).astype(np.int64)),
                 pa.array([len(b) for b in base], pa.int64()),
                 pa.array([b[0][0] if b else None for b in base], pa.int64()),
                 pa.array([b[-1][0] if b else None for b in base], pa.int64()),
                 pa.array([sorted({x for _, x in b}) for b in base], names),
                 pa.array([sorted(found.get(t, ()), key=lambda m: (m["start"], m["label"], m["end"]))
                           for t in rows], spans)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "matches"])


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: word count, base phrases and accepted templates
    (matches: label, start, end in words).  Null and empty texts have no words
    and no labels; other columns are ignored; repeated rows give repeated
    results.  Overlapping matches of different templates all count."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
               "base array<string>, matches array<struct<label:string,start:long,end:long>>")


def license_report(docs: DataFrame) -> DataFrame:
    """Labels as strings and a score: 1 where a template is accepted, 0.5 where
    only a base phrase stands, else 0."""
    labels = F.array_sort(F.array_distinct(F.concat("base", F.col("matches.label"))))
    return license_scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.col("n_base") > 0, 0.5).otherwise(0.0).alias("score"))
