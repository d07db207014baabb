"""License scans with template markup compiled to token automata.

A template is mandatory wording with optional regions
(``<<beginOptional>> ... <<endOptional>>``, nestable) and replaceable ones
(``<<var;words=a-b>>``: a to b words of any kind).  It is compiled to an
automaton over words and accepts a place in a text only if the mandatory
wording is there word for word.  The longest run of mandatory words picks the
places where the automaton is tried, so most texts are passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Templates and their labels.
TEMPLATES = (
    ("<<beginOptional>>this <<var;words=1-2>> is<<endOptional>> licensed under the gnu general public license"
     "<<beginOptional>> as published by the free software foundation<<endOptional>><<beginOptional>> either"
     "<<endOptional>> version 3", "gpl-3"),
    ("<<beginOptional>>this <<var;words=1-2>> is<<endOptional>> licensed under the gnu general public license"
     "<<beginOptional>> as published by the free software foundation<<endOptional>><<beginOptional>> either"
     "<<endOptional>> version 2", "gpl-2"),
    ("licensed under the apache license version 2<<beginOptional>> 0<<endOptional>>"
     "<<beginOptional>> the license you may not use this file except in compliance with the license"
     "<<endOptional>>", "apache-2"),
    ("<<beginOptional>><<var;words=1-3>> is <<endOptional>>released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by nc"
     "<<beginOptional>> <<var;words=0-1>> 0<<endOptional>>", "cc-by-nc"),
    ("licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>creative commons "
     "attribution noncommercial<<beginOptional>> <<var;words=1-2>><<endOptional>> license", "cc-by-nc"),
    ("licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by sa", "cc-by-sa"),
    ("licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>cc by "
     "<<var;words=1-1>> 0 international", "cc-by"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("copyright <<beginOptional>>c <<endOptional>><<var;words=0-8>> all rights reserved", "all-rights-reserved"),
    # whole license bodies
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions "
     "<<beginOptional>>the above copyright notice and this permission notice <<beginOptional>>including the next "
     "paragraph <<endOptional>>shall be included in all copies or substantial portions of the software <<endOptional>>"
     "the software is provided as is without warranty of any kind express or implied including but not limited to the "
     "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall "
     "<<var;words=1-12>> be liable for any claim damages or other liability whether in an action of contract tort or "
     "otherwise arising from out of or in connection with the software or the use or other dealings in the software",
     "mit"),
    ("permission to use copy modify and <<beginOptional>>or <<endOptional>>distribute this software for any purpose "
     "with or without fee is hereby granted provided that the above copyright notice and this permission notice appear "
     "in all copies the software is provided as is and <<var;words=1-8>> disclaims all warranties with regard to this "
     "software including all implied warranties of merchantability and fitness in no event shall <<var;words=1-8>> be "
     "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of "
     "use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
     "connection with the use or performance of this software", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met <<beginOptional>>1 <<endOptional>>redistributions of source code must retain the "
     "above copyright notice this list of conditions and the following disclaimer <<beginOptional>>2 <<endOptional>>"
     "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
     "following disclaimer in the documentation and or other materials provided with the distribution "
     "<<beginOptional>><<beginOptional>>3 <<endOptional>>neither the name of <<var;words=1-8>> nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior "
     "written permission <<endOptional>>this software is provided by <<var;words=1-8>> as is and any express or implied "
     "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
     "purpose are disclaimed", "bsd"),
)

# A-Z to a-z; every other ASCII byte outside 0-9 and a-z ends a word; bytes of other characters belong to words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))
_MARK = re.compile(r"<<beginOptional>>|<<endOptional>>|<<var;words=(\d+)-(\d+)>>")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Automaton:
    """States 0 .. n; ``on[s]`` maps a word (None: any word) to next states; ``free[s]``: next states without a word."""
    label: str
    on: list[list[tuple[bytes | None, int]]]
    free: list[list[int]]
    final: int
    anchor: bytes       # longest run of mandatory words, joined by blanks
    lead: int           # words before the anchor at most
    length: int         # words of a match at most

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def longest(self, words: list[bytes], start: int) -> int:
        """Words of the longest match that starts at ``start``; 0 if none."""
        states, best = self.closure({0}), 0
        for i in range(start, min(len(words), start + self.length)):
            w = words[i]
            states = self.closure({t for s in states for on, t in self.on[s] if on is None or on == w})
            if not states:
                break
            if self.final in states:
                best = i + 1 - start
        return best


def compile_template(markup: str, label: str) -> Automaton:
    """Automaton of a template; ValueError for unbalanced marks or no mandatory word."""
    on: list[list[tuple[bytes | None, int]]] = [[]]
    free: list[list[int]] = [[]]
    opened: list[int] = []
    runs: list[tuple[list[bytes], int]] = [([], 0)]
    length, at = 0, 0

    def state() -> int:
        on.append([])
        free.append([])
        return len(on) - 1

    def word(w: bytes | None) -> None:
        nonlocal at, length
        s = state()
        on[at].append((w, s))
        at = s
        length += 1

    pos = 0
    for m in [*_MARK.finditer(markup), None]:
        for w in words_of(markup[pos:m.start() if m else None]):
            if not opened:
                if not runs[-1][0]:
                    runs[-1] = ([], length)
                runs[-1][0].append(w)
            word(w)
        if m is None:
            break
        pos = m.end()
        runs.append(([], length))
        if m[0] == "<<beginOptional>>":
            opened.append(at)
        elif m[0] == "<<endOptional>>":
            if not opened:
                raise ValueError(f"endOptional without a beginning in the template of {label}")
            s = state()
            free[at].append(s)
            free[opened.pop()].append(s)
            at = s
        else:
            least, most = int(m[1]), int(m[2])
            ends = [at] if least == 0 else []
            for i in range(most):
                word(None)
                if i + 1 >= least:
                    ends.append(at)
            s = state()
            for e in ends:
                free[e].append(s)
            at = s
    if opened:
        raise ValueError(f"beginOptional without an end in the template of {label}")
    run, lead = max(runs, key=lambda r: len(r[0]))
    if not run:
        raise ValueError(f"the template of {label} has no mandatory word")
    return Automaton(label, on, free, at, b" ".join(run), lead, length)


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which ``phrase`` stands; ``joined`` is blank-led and blank-closed."""
    needle, at, last, n = b" " + phrase + b" ", -1, 0, 0
    while (at := joined.find(needle, at + 1)) >= 0:
        n += joined.count(b" ", last, at)
        last = at
        yield n


def scan(text: str | None, phrases: list[tuple[bytes, str]], automata: list[Automaton]
         ) -> tuple[int, list[tuple[str, str, int, int]]]:
    """Number of words, and matches ``(kind, label, first word, words)``."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    found = [("base", label, at, p.count(b" ") + 1) for p, label in phrases for at in places(joined, p)]
    for a in automata:
        tried = -1
        for at in places(joined, a.anchor):
            # earliest start first; a match is never searched again from inside
            for start in range(max(tried + 1, at - a.lead), at + 1):
                tried = start
                n = a.longest(words, start)
                if n and start + n > at:
                    found.append(("template", a.label, start, n))
                    tried = max(tried, at)
                    break
    return len(words), found


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """``doc_id, n_words, matches`` for every row of ``docs(doc_id, text, ...)``;
    a match is ``struct(kind, label, first_word, words)``, of kind ``base`` (a
    phrase) or ``template``.

    Whole texts are scanned, A-Z lower-cased; a null or empty text has no words
    and no matches.  Null and repeated doc_ids stay row by row; other columns
    are ignored; no rows give no rows."""
    plain = [(b" ".join(words_of(p)), label) for p, label in phrases]
    automata = [compile_template(m, label) for m, label in templates]
    match = pa.struct([("kind", pa.string()), ("label", pa.string()), ("first_word", pa.int64()),
                       ("words", pa.int64())])
    names = ("kind", "label", "first_word", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [scan(t.as_py(), plain, automata) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([n for n, _ in out], pa.int64()),
                 pa.array([[dict(zip(names, m, strict=True)) for m in found] for _, found in out], pa.list_(match))],
                ["doc_id", "n_words", "matches"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_words long, matches "
                               "array<struct<kind:string,label:string,first_word:long,words:long>>")
