import numpy as np
from xxhash import xxh64_intdigest

from ligandspark.llm import simhash
from ligandspark.llm.components import connected_components
from tests.llm.conftest import make


def brute_fp(text, n=3):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words, w = [], ""
    for ch in lower + " ":
        if ch in " \t\n\x0b\x0c\r":
            if w:
                words.append(w)
            w = ""
        else:
            w += ch
    if not words:
        return 0
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius):
    """fps: list of ints -> group number of each."""
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_fingerprints(odd_rows):
    for _, t in odd_rows:
        assert simhash.simhash(t) == brute_fp(t)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 300).astype(np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    near2 = near ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    codes = np.unique(np.concatenate((base, near, near2, [np.uint64(0), ~np.uint64(0)])))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(codes)
    for radius in (0, 1, 2, 5):
        got = {(int(a), int(b)) for who, leaf in index.search(codes, radius) for a, b in zip(who, leaf)}
        want = {(i, j) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= radius)}
        assert got == want


def test_links_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_PARTS", 9)
    rng = np.random.default_rng(2)
    seed = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    codes = [seed]
    for _ in range(4):
        codes.append(codes[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)))
    codes = np.unique(np.concatenate(codes))
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    comp = {r["node"]: r["component"] for r in connected_components(simhash.hamming_links(df)).collect()}
    mine = [comp.get(int(c), int(c)) for c in codes.view(np.int64)]
    want = brute_groups([int(c) for c in codes], 2)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_whole_operator(spark, odd_docs, odd_rows):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in
                  simhash.near_duplicates(odd_docs).collect()), key=str)
    fps = [brute_fp(t) for _, t in odd_rows]
    group = brute_groups(fps, 2)
    first = {}
    for (i, _), g in zip(odd_rows, group):
        first[g] = min((x for x in (first.get(g), i) if x is not None), default=None)
    want = sorted(((i, f"{f:016x}", first[g]) for (i, _), f, g in zip(odd_rows, fps, group)), key=str)
    assert got == want


def test_empty_and_keep_one(spark, odd_docs, no_docs, odd_rows):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and None not in ids and ids.count(1) == 1 and 2 not in ids
    same = make(spark, [(None, "a b c d"), (None, "a b c d"), (3, "other words are here now"), (3, "other words are here now")])
    assert sorted((r["doc_id"] for r in simhash.keep_one(same).collect()), key=str) == [3, None]


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (500, 400), (400, 500)]
    got = {r["node"]: r["component"] for r in
           connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}, 400: 400, 500: 400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
