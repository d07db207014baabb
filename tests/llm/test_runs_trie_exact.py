"""Periodic runs, the prefix trie and exact dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ligandspark.llm import exact, queries, runs, trie
from ligandspark.llm.recompression import Grammar


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- runs -------------------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w, least=6, times=4):
    """Every stretch with period q that cannot be made longer, by comparing all words q apart."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, found):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found))


def periodic(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    if n > 6 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 4))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return np.array(w, np.int64)


def test_extensions_equal_direct_comparison():
    rng = random.Random(3)
    for letters in (1, 2, 5, 50):
        s = np.concatenate([[1000], periodic(rng, 700, letters), [1001]])
        i, j = (np.array(x) for x in zip(*[rng.sample(range(1, 701), 2) for _ in range(400)]))
        g = Grammar(s)
        right, left = g.extend(i, j, 1), g.extend(i, j, -1)
        for a, b, r, le in zip(i, j, right, left):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            m = 0
            while min(a, b) - m >= 0 and s[a - m] == s[b - m]:
                m += 1
            assert (r, le) == (n, m)


@pytest.mark.parametrize(("least", "times"), [(6, 4), (4, 2), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(7)
    for _ in range(150):
        texts = [periodic(rng, rng.choice([0, 1, 5, 6, 7, 40, 150]), rng.choice([1, 2, 3, 9]))
                 for _ in range(rng.randint(1, 6))]
        for t, r in zip(texts, runs.find_runs(texts, least, times)):
            assert [tuple(x) for x in r.tolist()] == brute_runs(t.tolist(), least, times)


def test_long_runs_in_a_long_text():
    w = np.concatenate([np.arange(1000), np.tile(np.arange(37), 3000), np.zeros(200_000, np.int64), np.arange(50)])
    (found,) = runs.find_runs([w])
    assert [tuple(r) for r in found.tolist()] == [(1000, 111_001, 37), (112_000, 200_001, 1)]
    # a 0 follows either stretch, and makes its run one word longer
    assert runs.dropped(len(w), found).sum() == 111_001 - 37 + 200_000


def test_collapse_keeps_rows_and_columns(spark, odd_docs, odd_rows, no_docs):
    loops = [(500, "a b " * 9), (501, "x\n" * 40 + "y"), (502, "q q " * 3 + "q q q q q q q")]
    docs = odd_docs.unionByName(spark.createDataFrame(loops, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumn("runs", F.lit("clash")).withColumn("n_words", F.lit(1))
    got = runs.collapse_runs(docs)
    assert set(got.columns) == {*docs.columns, "collapsed"}
    want = sorted((i is not None, i or 0, len(words_of(t)), tuple(brute_runs(words_of(t))),
                   brute_collapsed(words_of(t), brute_runs(words_of(t)))) for i, t in odd_rows + loops)
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"])
                  for r in got.collect())
    assert rows == want and any(r[3] for r in rows)
    assert runs.collapse_runs(no_docs).count() == 0


def test_op11(spark, sf):
    docs = duckdb.connect().execute(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").fetchall()
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert len(got) == len(docs)
    changed = 0
    for i, text in docs:
        w = words_of(text)
        n, h = len(w), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        found = brute_runs(w)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (best[1] and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r["collapsed_sha256"] == sha(brute_collapsed(w, found))
    assert changed


# --- trie -------------------------------------------------------------------

def brute_trie(paths):
    """``paths``: conv_id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, held in members.items():
        under = [x for x in members if x[:len(node)] == node]
        inner = {x[:-1] for x in members if x}
        ends = sorted(c for c in held if len(paths[c]) == len(node))
        out.add((min(held), len(node), min(members[node[:-1]]) if node else None, len(held),
                 sum(len(x) == len(node) + 1 for x in under), sum(x not in inner for x in under),
                 sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x), sha(",".join(map(str, ends)))))
    return out


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.sha256(
        f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[:h[c]] + own[c][h[c]:] for c in own}


CONVERSATION = "conv_id long, turn long, role string, text string, key string, kids int"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 1, "user", ""), (0, 1, "user", ""), (3, 0, None, "lonely"),
            (300, 5, "user", "ab"), (300, 5, "user", "aa")]
    # no conversation 400 to begin with, and fewer turns than are replaced: no turn is left
    rows.append((next(c for c in range(401, 500) if zlib.crc32(str(c).encode()) % 6 > 1), 0, "user", "short"))
    for c in range(1, 60):
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yes ü", "no", "漢"])))
    rows += [(100, t, "user", f"line {t}") for t in range(150)] + [(150, t, "user", f"line {t}") for t in range(90)]
    return rows


def read(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize("ranges", ["4"])
def test_op12_on_odd_conversations(spark, talks, tmp_path, ranges):
    from ligandspark.plans.scan import RANGE_CONF
    df = spark.createDataFrame([(*r, "k", 3) for r in talks], CONVERSATION).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    if ranges:                                  # one conversation over many ranges
        spark.conf.set(RANGE_CONF, ranges)
    try:
        got = read(queries.op12_prefix_trie(spark, str(tmp_path)))
    finally:
        spark.conf.unset(RANGE_CONF)
    want = brute_trie(brute_rebuilt(talks))
    assert len(got) == len(want) and set(got) == want
    assert min(len(p) for p in brute_rebuilt(talks).values()) == 0      # turnless conversations are there


def test_op12_without_conversations(spark, tmp_path):
    spark.createDataFrame([], CONVERSATION).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).count() == 0


def test_op12_and_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    got = read(queries.op12_prefix_trie(spark, sf))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sql = con.execute(f"select {', '.join(cols)} from ({queries.ORACLE['op12_prefix_trie']})").fetchall()
    assert len(got) == len(sql) and set(got) == set(sql)
    rows = con.execute("select conv_id, turn, role, text from conversations").fetchall()
    assert set(got) == brute_trie(brute_rebuilt(rows))


def test_subtree_sums_of_deep_and_bushy_trees(spark):
    rng = random.Random(2)
    parent = {(0, 0): None}
    for i in range(1, 25):                      # paths that leave the tree at any node
        p = rng.choice(list(parent))
        for d in range(p[1] + 1, p[1] + rng.choice([2, 5, 40])):
            parent[(i, d)] = p
            p = (i, d)
    kids = defaultdict(int)
    total = {k: (1, k[0] * 7 + k[1]) for k in parent}
    for k, p in parent.items():
        if p:
            kids[p] += 1
    for k in sorted(parent, key=lambda k: -k[1]):
        p = parent[k]
        if p:
            total[p] = tuple(a + b for a, b in zip(total[p], total[k]))
    rows = [(k[0], k[1], p[0] if p else None, kids[k], 1, k[0] * 7 + k[1]) for k, p in parent.items()]
    df = spark.createDataFrame(rows, "conv_id long, depth long, parent_conv_id long, kids long, one long, w long")
    got = {(r["conv_id"], r["depth"]): (r["one"], r["w"]) for r in trie.subtree_sums(df, ["one", "w"]).collect()}
    assert got == total


def test_id_lists_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = [(bytes([k % 3]), k * k - 50) for k in range(200)]
    got = {bytes(r["key"]): r["ends_sha256"] for r in trie.id_digests(spark.createDataFrame(
        rows, "key binary, conv_id long").repartition(5)).collect()}
    assert got == {bytes([m]): sha(",".join(map(str, sorted(i for k, i in rows if k == bytes([m]))))) for m in range(3)}


# --- exact dedup ------------------------------------------------------------

def digests(n, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (n, 32), np.uint8)


@pytest.mark.parametrize("n", [0, 1, 2, 17, 5000])
def test_perfect_hash_is_minimal(n):
    d = digests(n)
    ph = exact.PerfectHash.of_bytes(exact.PerfectHash.of(d).to_bytes())
    assert sorted(ph.slots(d)) == list(range(n)) and ph.size == n
    others = ph.slots(digests(1000, 2))
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_perfect_hash_refuses_equal_digests():
    with pytest.raises(ValueError, match="distinct"):
        exact.PerfectHash.of(np.repeat(digests(3), 2, axis=0))


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("slots", [65_536, 4])
def test_exact_dedup_of_odd_rows(spark, odd_docs, odd_rows, monkeypatch, slots):
    monkeypatch.setattr(exact, "SLOTS", slots)
    extra = [(900, "A  B"), (901, "É"), (902, "é"), (None, "only here"), (None, "only here")]
    rows = odd_rows + extra
    docs = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("loc", F.lit(2))
    got = exact.exact_dedup(docs).collect()
    want = brute_exact(rows)
    key = lambda r: str(r)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(
        ((i, *want[low(t)], sha(low(t))) for i, t in rows), key=key)
    kept = [(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert sorted(kept, key=key) == sorted(((want[t][0], sha(t)) for t in want), key=key)
    assert {r["in_history"] for r in got} == {True, False}
    stay = exact.drop_repeats(docs)
    assert stay.columns == docs.columns
    assert sorted(((r["doc_id"], sha(low(r["text"]))) for r in stay.collect()), key=key) == sorted(kept, key=key)


def test_exact_dedup_of_no_rows(spark, no_docs):
    assert exact.exact_dedup(no_docs).count() == 0 and exact.drop_repeats(no_docs).count() == 0


def test_members_are_told_by_their_bytes(spark):
    """A new digest that falls on a slot of another digest is no member."""
    old, new = digests(40, 3), digests(400, 4)
    make = lambda d, first: spark.createDataFrame(
        [(bytearray(x.tobytes()), first + k, k, 1) for k, x in enumerate(d)], "digest binary, keep_id long, keep_loc long, n long")
    groups = exact.look_up(exact.build_index(make(old, 0), 2), make(np.concatenate([new, old[:5]]), 1000), 2).collect()
    assert len(groups) == 440 and sum(r["member"] for r in groups) == 40
    assert sorted(r["keep_id"] for r in groups if r["member"] and r["n"] == 2) == list(range(1400, 1405))


def test_op13_and_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "in_history"]
    got = sorted(tuple(r[c] for c in cols) for r in queries.op13_exact_dedup(spark, sf).collect())
    assert got == sorted(con.execute(f"select {', '.join(cols)} from ({queries.ORACLE['op13_exact_dedup']})").fetchall())
