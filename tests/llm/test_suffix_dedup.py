import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ligandspark.llm import common, suffix_dedup, suffixes
from tests.llm.conftest import make


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        out.append(bytes(c for c, g in zip(d, gone) if not g))
    return out


def run(docs, **how):
    rows = suffix_dedup.dedup(docs, **how).collect()
    for r in rows:
        data, at, left = (r["text"] or "").encode(), 0, b""
        for s in r["spans"]:
            assert at <= s["start"] < s["end"]
            left, at = left + data[at:s["start"]], s["end"]
        assert left + data[at:] == bytes(r["kept"])
        assert r["n_bytes"] == len(data) and r["n_removed"] == len(data) - len(r["kept"])
    return sorted(((r["doc_id"], r["text"] or "", bytes(r["kept"])) for r in rows), key=str)


def want(rows, length):
    return sorted(((i, t or "", k) for (i, t), k in zip(rows, brute([t for _, t in rows], length))), key=str)


@pytest.mark.parametrize("limit", [suffixes.SMALL_ALPHABET, 0])
def test_suffix_array(limit, monkeypatch):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", limit)
    rng = random.Random(3)
    for _ in range(150):
        symbols = rng.choice([2, 3, 40])
        t = [rng.randint(1, symbols) for _ in range(rng.randint(0, 50))] + [0]
        sa = suffixes.suffix_array(np.array(t, np.int32), symbols + 1)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        phi, lcp = suffixes.common_prefixes(np.array(t, np.int32), sa)
        for k in range(1, len(sa)):
            a, b, n = sa[k], sa[k - 1], 0
            while t[a + n] == t[b + n]:
                n += 1
            assert (phi[a], lcp[a]) == (b, n)


def test_repeated_starts():
    rng = random.Random(8)
    for _ in range(100):
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        n = rng.randint(1, 8)
        seen = Counter(x[i:i + n] for x in texts for i in range(len(x) - n + 1))
        assert [s.tolist() for s in suffixes.repeated_starts(texts, n)] == [
            [i for i in range(len(x) - n + 1) if seen[x[i:i + n]] > 1] for x in texts]
    cores = [b"core" * 3] * 3 + [b"other123core"]
    for _ in range(100):
        texts, at = [], []
        for _ in range(rng.randint(1, 8)):
            left = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 3)))
            right = bytes(rng.choice(b"ab") for _ in range(3))
            texts.append(left + rng.choice(cores) + right[:3])
            at.append(len(left))
        n = 15                                        # every 15 bytes hold the 12 of the core
        seen = Counter(x[i:i + n] for x in texts for i in range(len(x) - n + 1))
        assert [s.tolist() for s in suffixes.repeated_starts_around(texts, at, 12, n)] == [
            [i for i in range(len(x) - n + 1) if seen[x[i:i + n]] > 1] for x in texts]


def test_contexts_count_loops():
    rng = random.Random(9)
    block = bytes(rng.choice(b"abcdefgh") for _ in range(150))
    *_, picks = suffix_dedup.contexts(block * 4, 400, 64)
    assert picks.max() == 2
    *_, picks = suffix_dedup.contexts(bytes(rng.choice(b"abcdefgh") for _ in range(3000)), 400, 64)
    assert picks.max() == 1 and picks.min() == 1


def test_odd_rows(odd_docs, odd_rows):
    assert run(odd_docs) == want(odd_rows, 400)


def test_no_rows(no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0
    assert suffix_dedup.cut_repeats(no_docs).count() == 0


@pytest.mark.parametrize("hot", [1 << 20, 2000, 0])
def test_random_texts_with_hot_groups(spark, hot, words):
    rng = random.Random(hot)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(n) for n in (8, 12, 20, 40)]
    rows = []
    for i in range(120):
        parts = [say(rng.randint(1, 30))]
        if rng.random() < 0.7:
            parts.append(passages[0 if i % 3 == 0 else rng.randrange(4)])
        if rng.random() < 0.2:
            parts.append(passages[rng.randrange(4)])
        parts.append(say(rng.randint(0, 30)))
        rows.append((i, " ".join(parts)))
    rows += [(200, "ab" * 200), (201, "z" * 90), (202, rows[3][1]), (203, rows[3][1])]
    got = run(make(spark, rows).repartition(4), length=40, gram=8, hot_bytes=hot)
    assert got == want(rows, 40)


def test_cut_repeats(spark, words):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = say(150)
    rows = [(1, say(50) + passage + say(20)), (2, "é" + passage + "é"), (3, say(200)), (4, None)]
    docs = make(spark, rows)
    out = {r["doc_id"]: r for r in suffix_dedup.cut_repeats(docs).collect()}
    assert suffix_dedup.cut_repeats(docs).columns == docs.columns
    assert out[3]["text"] == rows[2][1] and out[4]["text"] is None
    kept = brute([t for _, t in rows], 400)
    for i in (1, 2):
        assert out[i]["text"] == kept[i - 1].decode("utf-8", "ignore") and out[i]["n_chars"] == len(out[i]["text"])


def brute_passages(texts, length, n):
    """Bytes left without the repeated ``length``-byte strings and ``n``-word passages."""
    data = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    said = [[d[a:b] for a, b in w] for d, w in zip(data, at)]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    stand = Counter(tuple(w[i:i + n]) for w in said for i in range(len(w) - n + 1))
    out = []
    for d, places, w in zip(data, at, said):
        gone = bytearray(len(d))
        ranges = [(i, i + length) for i in range(len(d) - length + 1) if seen[d[i:i + length]] > 1]
        ranges += [(places[i][0], places[i + n - 1][1]) for i in range(len(w) - n + 1) if stand[tuple(w[i:i + n])] > 1]
        for a, b in ranges:
            gone[a:b] = b"\1" * (b - a)
        out.append(bytes(c for c, g in zip(d, gone) if not g))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 0])
def test_passages_of_words(spark, hot):
    rng = random.Random(hot)
    lexicon = ["a", "é", "to", "ñu", "the", "word", "long" * 30, "z"] + [f"w{i}" for i in range(40)]
    say = lambda n: [rng.choice(lexicon) for _ in range(n)]
    blank = lambda w: "".join(x + rng.choice([" ", "\n", "  ", "\t "]) for x in w)
    passages = [say(n) for n in (5, 6, 7, 15)]
    rows = [(i, blank(say(rng.randint(0, 20)) + (passages[i % 4] if i % 3 else []) + say(rng.randint(0, 9))))
            for i in range(80)]
    rows += [(100, None), (101, ""), (102, "a " * 30), (103, rows[1][1]), (104, "x" * 500), (105, "y" + "x" * 500)]
    got = run(make(spark, rows).repartition(4), length=120, gram=8, hot_bytes=hot, words=6)
    left = brute_passages([t for _, t in rows], 120, 6)
    assert got == sorted(((i, t or "", k) for (i, t), k in zip(rows, left)), key=str)
    assert left != brute([t for _, t in rows], 120)


def test_pipeline_cuts_passages_of_over_50_words(spark):
    """A passage of 51 words with fewer bytes than LENGTH goes from all its texts."""
    rng = random.Random(51)
    say = lambda n: " ".join("".join(rng.choice("aeioubdr") for _ in range(4)) for _ in range(n))
    passage = say(51)
    assert len(passage) < suffix_dedup.LENGTH
    rows = [(i, f"{say(70)}. {passage} {say(30)}") for i in range(3)] + [(3, say(150)), (4, None)]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_stage(spark, make(spark, rows), "").collect()}
    assert [out[i] for i in range(5)] == [t and t.replace(passage, "") for _, t in rows]


def test_passing_tables_go(spark):
    import glob

    base = common._scratch_base(spark)
    with common.passing(spark):
        gone = common.written(spark.range(3), "test-gone")
        stays = common.written(gone.where("id > 0"), "test-stays", keep=True)
    assert stays.count() == 2
    folder = base.removeprefix("file://").removeprefix("file:")
    assert not glob.glob(f"{folder}/test-gone*") and glob.glob(f"{folder}/test-stays*")
