"""SentencePiece BPE encoding with a prefix table, and decoding.

The encoding of a text by merges has this property: every prefix has exactly
one last token, and a token may follow another if and only if the two alone
encode to themselves.  So an Aho-Corasick automaton over the vocabulary lists,
at each place, the tokens that end there; the one that is compatible with the
last token of the prefix before it is the prefix's own; and the ids are read
backwards from the end.  Time is linear in the text, whatever the merge order.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"         # stands for a blank in pieces
CACHE_WORDS = 500_000    # encoded words kept by a worker
CACHE_PAIRS = 1_000_000  # pairs of pieces whose compatibility is kept by a worker
CACHE_CHARS = 64         # longest word kept
OUT_BYTES = 16 << 20
SLICE = 1 << 20          # characters of a long text that are split into words at once
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af"    # of Latin script
NEVER = float("-inf")    # score of a pair that is no piece


def word_slices(text: str) -> Iterator[tuple[int, int]]:
    """Borders of parts of about ``SLICE`` characters that each begin a run of blanks."""
    at = 0
    while len(text) - at > SLICE:
        end = text.rfind(" ", at + 1, at + SLICE)
        while end > at and text[end - 1] in (" ", SPACE):
            end = text.rfind(" ", at + 1, end)
        if end <= at:
            break
        yield at, end
        at = end
    yield at, len(text)


class MergeEncoder:
    """Encoder of one SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_proto=model)
        normal = [i for i in range(sp.get_piece_size())
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece goes on after its first word; words can't be encoded alone")
        # line feeds also part words if no piece holds one, and letters and other signs if none holds both
        stop = "" if any("\n" in p for p in self.id) else "\n"
        line = "|\n" if stop else ""
        self.words = re.compile(f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{LETTERS}{SPACE}{stop}]+|{SPACE}+{line}")
        if any(self.words.findall(p) != [p] for p in self.id):
            self.words = re.compile(f"{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+{line}")
        self.matches = ahocorasick.Automaton()
        for p in self.id:
            if self.merged(p) == [p]:                      # pieces that no merge order reaches never occur
                self.matches.add_word(p, (self.id[p], len(p)))
        self.matches.make_automaton()
        self.size = {i: len(p) for i, p in self.text.items()}
        self.compatible: dict[int, dict[int, bool]] = {i: {} for i in self.id.values()}    # by left and right
        self.pairs = 0
        self.history: dict[str, list[tuple[float, str, str]]] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merges by definition: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def states(self, piece: str) -> list[tuple[float, str, str]]:
        """The merges of one piece: before each its score and the first and last part; -inf after the last."""
        known = self.history.get(piece)
        if known is None:
            parts, known = list(piece), []
            while True:
                best, at = NEVER, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1], NEVER)
                    if s > best:
                        best, at = s, i
                known.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.history[piece] = known
        return known

    def follows(self, left: str, right: str) -> bool:
        """Whether the two pieces side by side encode to themselves: each goes
        through its own merges, best first and the left one's first among
        equals, and no pair across the border is ever the next best."""
        a, b, i, j = self.states(left), self.states(right), 0, 0
        while True:
            own, _, x = a[i]
            other, y, _ = b[j]
            across = self.score.get(x + y, NEVER)
            if across > own and across >= other:
                return False
            if own >= other:
                if own == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def prefix_table(self, word: str) -> list[int]:
        """For each prefix of ``word`` the id of its last token; 0 at the start
        and after a character that is in no piece and so never merges."""
        last, compatible = [0] * (len(word) + 1), self.compatible
        for end, (i, size) in self.matches.iter(word):
            end += 1
            if last[end]:
                continue
            before = last[end - size]
            if before:
                fits = compatible[before].get(i)
                if fits is None:
                    fits = compatible[before][i] = self.follows(self.text[before], self.text[i])
                    self.pairs += 1
                if not fits:
                    continue
            last[end] = i
        return last

    def encode_word(self, word: str) -> list[int]:
        last, at, out, size = self.prefix_table(word), len(word), [], self.size
        while at:
            i = last[at]
            if i:
                out.append(i)
                at -= size[i]
            else:
                at -= 1
                out.extend(self.byte[b] for b in reversed(word[at].encode("utf-8", "replace")))
        out.reverse()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), np.int32).tolist()

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a text as native int32 bytes."""
        if not text:
            return b""
        if len(text) > SLICE:
            return b"".join(
                self.encode_words(self.words.findall((SPACE if not a else "") + text[a:b].replace(" ", SPACE)))
                for a, b in word_slices(text))
        return self.encode_words(self.words.findall(SPACE + text.replace(" ", SPACE)))

    def encode_words(self, words: list[str]) -> bytes:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        if self.pairs > CACHE_PAIRS:
            for pairs in self.compatible.values():
                pairs.clear()
            self.pairs = 0
        own = {}
        for w in set(words).difference(known):
            (known if len(w) <= CACHE_CHARS else own)[w] = array("i", self.encode_word(w)).tobytes()
        if own:
            return b"".join([known[w] if w in known else own[w] for w in words])
        return b"".join([known[w] for w in words])

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=1)
def encoder_of(model: bytes) -> MergeEncoder:
    """The encoder of a worker, which its next task goes on with."""
    return MergeEncoder(model)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs(doc_id, text, ...)``.

    ``ids`` are those of the model without begin or end ids; ``decoded`` is
    their text.  A null or empty text has no ids and decodes to an empty
    text.  Null and repeated doc_ids stay row by row; other columns are
    ignored; no rows give no rows."""
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())   # a vocabulary file, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        for b in batches:
            doc, ids, decoded, size = [], [], [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = np.frombuffer(encoder.encode_bytes(text.as_py() or ""), np.int32)
                doc.append(doc_id)
                ids.append(one)
                decoded.append(encoder.decode(one.tolist()) if len(one) else "")
                size += 4 * len(one) + len(decoded[-1])
                if size > OUT_BYTES:
                    yield made(doc, ids, decoded)
                    doc, ids, decoded, size = [], [], [], 0
            yield made(doc, ids, decoded)

    def made(doc, ids, decoded) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        flat = np.concatenate([np.empty(0, np.int32), *ids])
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
             pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
