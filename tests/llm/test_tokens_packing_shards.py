import random
import string
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from ligandspark.llm import packing, pieces, sharding

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [" ", "  ", "a", "B", "the", "▁", "\n", "é", "é", "漢", "😀", "<s>", "<|endoftext|>", "\t", "ing", " in",
            "0", "1", ".", ",", "!", "'s", "İ", "Σ", "\xa0", "ß", "\x00", "�", "K"]


def bins_of_bfd(lengths, capacity):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        if k == len(rooms):
            n, room = n + 1, capacity
        else:
            room = rooms.pop(k)
        insort(rooms, room - x)
    return n


def test_word_encoder_is_the_tokenizer():
    model = open(WORD, "rb").read()
    own, lib, rng = packing._encoder(model), Tokenizer.from_str(model.decode()), random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        assert own(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_best_fit_by_counts_is_best_fit_one_by_one():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 16, 50, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        fills, bins = packing.best_fit_decreasing(dict(Counter(lengths)), capacity)
        assert bins == bins_of_bfd(lengths, capacity)
        content, placed = defaultdict(list), Counter()
        for f in fills:
            for k in range(f.count):
                content[f.bin + k // f.per_bin].append((f.offset + k % f.per_bin * f.length, f.length))
            placed[f.length] += f.count
        assert placed == Counter(lengths) and set(content) == set(range(bins))
        for parts in content.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity


def test_pack(odd_docs, no_docs, odd_rows):
    lib = Tokenizer.from_file(WORD)
    assert packing.pack(no_docs, WORD).count() == 0
    for capacity in (4096, 50):
        rows = packing.pack(odd_docs, WORD, capacity).collect()
        got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"]), r["ids_crc32"]) for r in rows),
                     key=str)
        want = []
        for i, t in odd_rows:
            ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            for k, s in enumerate(range(0, len(ids), capacity)):
                b = ids[s:s + capacity].tobytes()
                want.append((i, k, s, len(b) // 4, b, zlib.crc32(b)))
        assert got == sorted(want, key=str)
        places = defaultdict(list)
        for r in rows:
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sorted(places) == list(range(bins_of_bfd([r["length"] for r in rows], capacity)))
        for parts in places.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= capacity


def test_closing_marks_part_words(monkeypatch):
    import tokenizers

    library, whole = tokenizers.Tokenizer.from_file(WORD), []

    class Seen:
        model = library.model

        @staticmethod
        def from_str(_):
            return Seen()

        def encode_batch_fast(self, texts, **how):
            whole.extend(texts)
            return library.encode_batch_fast(texts, **how)

    monkeypatch.setattr(tokenizers, "Tokenizer", Seen)
    own, marks = packing._encoder(open(WORD, "rb").read()), string.punctuation
    rng = random.Random(3)
    texts = [w + "".join(rng.choice(marks) for _ in range(rng.randint(0, 4))) + after
             for w in ("Xylomar", "\u00dcbel", "don't", "x<|endoftext|>", "e\u0301", "7a") for after in ("", "s", "\u0301") for _ in range(200)]
    for t in texts:
        assert own(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    whole.clear()
    own(" ".join("Xylomar" + a + b for a in "*#$%&" for b in "*#$%&"))
    assert not any(c.isalpha() for t in whole for c in t)


def test_pieces_are_the_library():
    model = open(PIECE, "rb").read()
    own, lib, rng = pieces.MergeEncoder(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [a + " " * n + b for n in range(40) for a in ("", "x") for b in ("", "y", "\n")]
    for t in texts:
        assert own.encode(t) == lib.encode(t), t


def test_parts_of_words_are_encoded_once(monkeypatch):
    own, done = pieces.encoder_of(open(PIECE, "rb").read()), []
    assert own is pieces.encoder_of(open(PIECE, "rb").read())      # the next task of a worker goes on with it
    own.known.clear()
    encode_word = own.encode_word
    monkeypatch.setattr(own, "encode_word", lambda w: (done.append(w), encode_word(w))[1])
    for t in ("Xylomar, xylomar", "Xylomar. xylomar!", "Xylomar *** xylomar (Xylomar)"):
        assert own.encode(t) == own.library.encode(t), t
    assert sum(w.lstrip("\u2581").lower() == "xylomar" for w in done) == len(done) - 6 == 3


def test_pieces_in_a_row_are_the_library(monkeypatch):
    model = open(PIECE, "rb").read()
    own, lib, rng = pieces.MergeEncoder(model), sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(2)
    texts = ["".join(rng.choice(list(own.id)[:9000]) for _ in range(rng.randint(2, 9))).replace("\u2581", " ") for _ in range(3000)]
    want = [lib.encode(t) for t in texts]
    assert [own.encode(t) for t in texts] == want
    monkeypatch.setattr(pieces, "CACHE_WORDS", 0)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 10)
    monkeypatch.setattr(pieces, "CACHE_CHARS", 4)
    assert [own.encode(t) for t in texts] == want


def test_encode_decode(odd_docs, no_docs, odd_rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in pieces.encode_decode(odd_docs, PIECE).collect()), key=str)
    want = [(i, lib.encode(t or ""), lib.decode(lib.encode(t or "")) if t else "") for i, t in odd_rows]
    assert got == sorted(want, key=str)
    assert pieces.encode_decode(no_docs, PIECE).count() == 0


def test_shards(odd_docs, no_docs, odd_rows):
    assert sharding.shuffle_to_shards(no_docs).count() == 0
    for n in (1, 3, 8, 100):
        rows = sharding.shuffle_to_shards(odd_docs, n).collect()
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(odd_rows)
        size = Counter(r["shard"] for r in rows)
        assert sorted(size.values(), reverse=True) == [s for s in
                                                       [len(rows) // n + (k < len(rows) % n) for k in range(n)] if s]
        for s, k in size.items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(k))


def test_matrix_has_exact_margins_and_the_right_law():
    starts = np.array([0, 5, 5, 12, 40, 41], np.int64)
    for shards, each in ((2, 3), (3, 7)):           # one level of the block tree, and two
        k = shards * each
        blocks = np.diff(sharding.first_slot(np.arange(k + 1), 41, shards, each))
        assert blocks.sum() == 41 and blocks.min() >= 41 // k and blocks.max() <= -(-(41 // shards + 1) // each)
        total, square, n = np.zeros((5, k)), np.zeros((5, k)), 600
        for seed in range(n):
            m = np.zeros((5, k), np.int64)
            for p in range(5):
                to, c = sharding.matrix_row(p, starts, 41, shards, each, seed)
                assert (c > 0).all() and len(set(to.tolist())) == len(to)
                m[p, to] = c
            assert (m.sum(1) == np.diff(starts)).all() and (m.sum(0) == blocks).all()
            total, square = total + m, square + m * m
        r, mean = np.diff(starts)[:, None], np.outer(np.diff(starts), blocks) / 41
        var = mean * (41 - r) / 41 * (41 - blocks) / 40
        assert np.abs(total / n - mean).max() < 0.35
        assert np.abs(square / n - (total / n) ** 2 - var).max() < 0.6


def test_draws_go_with_the_rows_of_a_partition(monkeypatch):
    """100 times the partitions and blocks: the draws of one partition of 1,000
    rows grow by the logarithms only."""
    widths, plain = [], sharding.split
    monkeypatch.setattr(sharding, "split", lambda rng, c, t: (widths.append(len(c)), plain(rng, c, t))[1])
    for parts in (100, 10_000):
        starts, each = np.arange(parts + 1, dtype=np.int64) * 1000, parts * 1000 // 40_000 + 6
        widths.clear()
        _, n = sharding.matrix_row(parts // 3, starts, parts * 1000, 8, each, 1)
        levels = np.log(8 * each) / np.log(sharding.FAN) + 1
        assert n.sum() == 1000 and max(widths) <= sharding.FAN
        assert len(widths) <= min(1000, 8 * each) * levels * np.log2(2 * parts)


def test_large_hypergeometric(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(sharding, "EXACT_LIMIT", 0)
    mine = [sharding.hypergeometric(rng, 3000, 7000, 2000) for _ in range(4000)]
    lib = rng.hypergeometric(3000, 7000, 2000, 4000)
    assert abs(np.mean(mine) - 600) < 1.5 and abs(np.std(mine) / np.std(lib) - 1) < 0.06
    monkeypatch.setattr(sharding, "EXACT_LIMIT", 10 ** 9)
    big = [sharding.hypergeometric(rng, 4 * 10 ** 9, 6 * 10 ** 9, 10 ** 9) for _ in range(300)]
    assert abs(np.mean(big) - 4e8) < 4000


def test_large_envelope_holds():
    """The rejection envelope covers the weights: the accepted ratio stays within one."""
    import math
    for good, bad, sample in ((50, 70, 30), (1000, 10, 500), (3, 4000, 900), (3000, 7000, 2000)):
        n = good + bad
        mean = sample * good / n
        sd = math.sqrt(max(1.0, mean * bad / n * (n - sample) / (n - 1)))
        w = lambda k: -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1)
                        + math.lgamma(bad - sample + k + 1))
        low, high = max(0, sample - bad), min(good, sample)
        mode = min(high, max(low, (sample + 1) * (good + 1) // (n + 2)))
        for k in range(low, high + 1):
            assert math.exp(w(k) - w(mode)) <= 4.0 / (1.0 + ((k - mode) / sd) ** 2) + 1e-9, (good, bad, sample, k)


def test_slices_of_long_texts_change_nothing(monkeypatch):
    rng = random.Random(7)
    word, piece = open(WORD, "rb").read(), open(PIECE, "rb").read()
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    a, b = packing._encoder(word), pieces.MergeEncoder(piece)
    want = [(a(t), b.encode(t)) for t in texts]
    monkeypatch.setattr(packing, "SLICE", 9)
    monkeypatch.setattr(pieces, "SLICE", 9)
    assert [(a(t), b.encode(t)) for t in texts] == want
