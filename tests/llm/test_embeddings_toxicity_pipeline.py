import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ligandspark.llm import embeddings, queries, toxicity
from tests.llm.conftest import make
from tests.llm.test_simhash import brute_fp, brute_groups
from tests.llm.test_suffix_dedup import brute as brute_cut

SCHEMA = "vec_id long, embedding array<float>, label int, key string, filter int, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], b, "k", 1, 2)
                                  for i, v, b in rows], SCHEMA)


def brute_links(rows, least=0.93):
    unit = []
    for _, v, b in rows:
        ok = b is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(np.float64) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    n, group = [0] * len(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= least:
                n[i] += 1
                n[j] += 1
                g, h = group[i], group[j]
                group = [h if x == g else x for x in group]
    return n, group


def sample(seed, clusters=6, size=30, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(clusters):
        z = rng.standard_normal(dim)
        for _ in range(size):
            v = z + rng.standard_normal(dim) * rng.choice([0.05, 0.15, 0.3])
            rows.append((len(rows), v.astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + k, rng.standard_normal(dim).astype(np.float32).tolist(), k % 3) for k in range(100)]
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_links_of_clusters(spark, tile, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rows = sample(3)
    rows += [(1000 + k, rows[0][1], 0) for k in range(25)]
    n, group = brute_links(rows)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors(spark, rows).repartition(3)).collect()}
    links = sum(got[i]["n_links"] for i, _, _ in rows)
    assert links <= sum(n) and links >= 0.97 * sum(n)
    assert all(got[i]["n_links"] <= k for (i, _, _), k in zip(rows, n))
    first = {}
    for (i, _, _), g in zip(rows, group):
        first[g] = min(first.get(g, i), i)
    same = sum(got[i]["component_id"] == first[g] for (i, _, _), g in zip(rows, group))
    assert same >= 0.98 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        u = rng.standard_normal(64)
        u /= np.linalg.norm(u)
        r = rng.standard_normal(64)
        r -= (r @ u) * u
        r /= np.linalg.norm(r)
        rows += [(2 * k, u.tolist(), k), (2 * k + 1, (0.931 * u + np.sqrt(1 - 0.931 ** 2) * r).tolist(), k)]
    got = embeddings.near_duplicates(vectors(spark, rows)).collect()
    assert sum(r["n_links"] for r in got) / 800 >= 0.95


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0, 0.0], 0),
            (8, [1.0, None, 3.0], 0), (9, [1.0, float("nan"), 3.0], 0), (10, [float("inf"), 1.0, 1.0], 0),
            (11, [1.0, 2.0, 3.0, 0.0], 0), (12, [2.0, 4.0, 6.0], 0), (13, [-1.0, -2.0, -3.0], 0), (None, [9.0, 1.0, 1.0], 0)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in
                  embeddings.near_duplicates(vectors(spark, rows)).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (12, 3, 1, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13)]
    assert got == sorted(want, key=str)
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0


# --------------------------------------------------------------------- toxicity

def talk(words, seed, n=500):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "scum", "zorpAm", "zorpol", "Moron"]))
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_chain_on_held_out_rows(spark, words):
    docs, labels = talk(words, 1)
    extra = [(1000, None), (1001, ""), (1002, "you zorpxx and zorpyy moron"), (None, "scum idiot moron"), (3, docs[3][1])]
    df = make(spark, docs + extra)
    train = spark.createDataFrame([x for x in labels if x[0] < 350] + [(None, 1, 1), (7777, 1, 1), (4, 1, None)], LABELS)
    got = toxicity.toxicity(df, train)
    assert got.count() == len(docs) + len(extra)
    rows = got.select("doc_id", "is_toxic", "p_insult", "p_contempt", "p_toxic").collect()
    held = [(r["is_toxic"], r["doc_id"] % 6 == 0) for r in rows if r["doc_id"] is not None and 350 <= r["doc_id"] < 500]
    assert sum(a == b for a, b in held) / len(held) >= 0.98
    odd = {r["doc_id"]: r["is_toxic"] for r in rows if r["doc_id"] is None or r["doc_id"] >= 1000}
    assert odd == {1000: False, 1001: False, 1002: True, None: True}
    kept = toxicity.drop_toxic(df, train)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if not r["is_toxic"])


def test_chain_without_labels_or_rows(spark, words, no_docs):
    docs, labels = talk(words, 2, 30)
    none = spark.createDataFrame([], LABELS)
    assert toxicity.toxicity(make(spark, docs), none).where("is_toxic").count() == 0
    clean = spark.createDataFrame([(i, q, 0) for i, q, _ in labels], LABELS)
    assert toxicity.toxicity(make(spark, docs), clean).where("is_toxic").count() == 0
    assert toxicity.toxicity(no_docs, none).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.7])
def test_chain_at_any_share_of_toxic_labels(spark, words, share):
    rng = random.Random(9)
    bad = ["idiot", "scum", "moron", "trash"]
    toxic = {i: rng.random() < share for i in range(600)}
    docs = [(i, " ".join([rng.choice(words) for _ in range(60)] + [rng.choice(bad) for _ in range(3 * toxic[i])]))
            for i in toxic]
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(400)], LABELS)
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.toxicity(make(spark, docs), labels).collect()}
    right = {want: [got[i] == want for i in range(400, 600) if toxic[i] == want] for want in (True, False)}
    assert all(sum(r) / len(r) >= 0.95 for r in right.values()), {k: sum(r) / len(r) for k, r in right.items()}


def test_chain_sees_hundreds_of_toxic_words(spark, words):
    rng = random.Random(10)
    bad = ["".join(rng.choice("bcdfghjklmnprstvz") + rng.choice("aeiou") for _ in range(4)) for _ in range(400)]
    toxic = {i: i % 4 == 0 for i in range(12_000)}
    docs = [(i, " ".join([rng.choice(words) for _ in range(20)] + rng.sample(bad, toxic[i]))) for i in toxic]
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(10_000)], LABELS)
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.toxicity(make(spark, docs), labels).collect()}
    held = range(10_000, 12_000)
    found = sum(got[i] and toxic[i] for i in held)
    recall, precision = found / sum(toxic[i] for i in held), found / sum(got[i] for i in held)
    print(f"recall {recall:.3f} precision {precision:.3f}")
    assert recall >= 0.95 and precision >= 0.95


def test_sparse_rows_fit_like_full_ones():
    rng = np.random.default_rng(1)
    x = (rng.random((200, 8)) < 0.3).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.random(200) > 1.2).astype(float)
    n = rng.integers(1, 4, 200).astype(float)
    sparse = toxicity.Rows.of_hits([np.flatnonzero(r) for r in x], 8)
    full = toxicity.Rows(np.zeros(0, int), np.zeros(0, int), 0, x)
    a, b = toxicity.fit_linear(sparse, y, n), toxicity.fit_linear(full, y, n)
    assert np.allclose(a.weights, b.weights, atol=1e-6) and np.isclose(a.intercept, b.intercept, atol=1e-6)
    p = b.probability(full)
    assert np.allclose(x.T @ (n * (y - p)), toxicity.RIDGE * b.weights, atol=1e-3)    # the optimum
    assert np.isclose((n * (y - p)).sum(), 0, atol=1e-3)


def test_chain_feeds_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 6)).astype(float)
    first = (x[:, 0] + x[:, 1] > 1).astype(float)
    second = ((first + x[:, 2]) > 1).astype(float)
    models = toxicity.fit_models(x, np.stack([first, second], 1), np.arange(400) % 5)
    assert len(models[0].weights) == 6 and len(models[1].weights) == 7
    assert models[1].weights[6] > 0.5           # the earlier category counts
    chain = toxicity.Chain({str(i): i for i in range(6)}, ("a", "b"), models)
    p = chain.probabilities([list(np.flatnonzero(r)) for r in x])
    assert ((p[:, 1] > 0.5) == second).mean() > 0.95


# --------------------------------------------------------------------- pipeline

def test_stages_and_run(spark, words, tmp_path, monkeypatch):
    rng = random.Random(4)
    docs, labels = talk(words, 5, 200)
    passage = " ".join(rng.choice(words) for _ in range(140))
    docs += [(500, docs[1][1]), (501, docs[1][1]), (502, None), (503, "")]
    docs += [(600 + k, " ".join(rng.choice(words) for _ in range(60)) + " " + passage + " "
              + " ".join(rng.choice(words) for _ in range(60))) for k in range(5)]
    make(spark, docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    toxic = {i for i, t in docs if i < 200 and i % 6 == 0}
    left = [(i, t) for i, t in docs if i not in toxic]
    group = brute_groups([brute_fp(t) for _, t in left], 2)
    first = {}
    for (i, _), g in zip(left, group):
        first[g] = min(first.get(g, i), i)
    left = [(i, t) for (i, t), g in zip(left, group) if first[g] == i]
    cut = [(i, None if t is None else b.decode("utf-8", "ignore")) for (i, t), b in
           zip(left, brute_cut([t for _, t in left], 400))]
    frame, names = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    want = [dict((i, t) for i, t in docs if i not in toxic), dict(left), dict(cut)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        names.append(name)
        if k < 3:
            assert frame.columns == make(spark, []).columns
            assert {r["doc_id"]: r["text"] for r in frame.collect()} == want[k]
    assert names == ["toxicity", "simhash", "suffix_dedup", "packing"]
    assert any(t and passage[:100] not in t for i, t in cut if 600 <= i < 605)
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.select(*own).collect())) == sorted(map(tuple, frame.select(*own).collect()))


def test_queries_have_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_digest_queries_on_a_given_table(spark, sf):
    import duckdb

    con = duckdb.connect()
    rows = queries.op9_sharding(spark, sf).toPandas()
    docs = con.execute(f"select doc_id, text from read_parquet('{sf}/documents.parquet')").df()
    assert len(rows) == len(docs) and set(rows.law) == {"rows"} and rows.grown_shard.isna().all()
    import zlib

    text = dict(zip(docs.doc_id, docs.text))
    assert all(zlib.crc32(text[i].encode()) == c and len(text[i].encode()) + 1 == s
               for i, c, s in zip(rows.doc_id, rows.text_crc32, rows["size"]))
