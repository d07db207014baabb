"""The registered queries on a given table against brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ligandspark.llm import queries
from tests.llm.test_embeddings_toxicity_pipeline import brute_links
from tests.llm.test_simhash import brute_fp, brute_groups
from tests.llm.test_suffix_dedup import brute as brute_cut
from tests.llm.test_tokens_packing_shards import bins_of_bfd
from tests.llm.test_urls_licenses_merkle import (
    brute_base, brute_fingerprint, brute_host_path, brute_labels, brute_rule,
)


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.connect().execute(
        f"select doc_id, coalesce(text, '') from read_parquet('{sf}/documents.parquet') order by doc_id desc").fetchall()


def result(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def test_op1(spark, sf):
    rows = duckdb.connect().execute(f"select page_id, url from read_parquet('{sf}/pages.parquet')").fetchall()
    got = {r["page_id"]: r for r in result(spark, sf, "op1_url_filters")}
    assert len(got) == len(rows)
    for i, url in rows:
        host, path = brute_host_path(url)
        rule = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1])
        assert got[i]["verdict"] == (rule[0] if rule else "block" if got[i]["p_block"] > 0.5 else "allow")


def test_op2(spark, sf, docs):
    lib, want = Tokenizer.from_file(queries.WORD_BPE), []
    for i, t in docs:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        want += [(i, k, s, len(ids[s:s + 4096]), zlib.crc32(np.array(ids[s:s + 4096], "<u4").tobytes()))
                 for k, s in enumerate(range(0, len(ids), 4096))]
    rows = result(spark, sf, "op2_best_fit_packing")
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(bins) == bins_of_bfd([w[3] for w in want], 4096)
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096


def test_op3_and_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    cols = ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(tuple(r[c] for c in cols) for r in result(spark, sf, "op3_embedding_dedup"))
    sql = con.execute(queries.ORACLE["op3_embedding_dedup"]).df()
    assert got == sorted(map(tuple, sql[cols].itertuples(index=False)))
    rows = con.execute("select vec_id, embedding, label from embeddings").fetchall()
    n, _ = brute_links(rows)
    assert {i: k for i, k, _, _ in got} == {r[0]: k for r, k in zip(rows, n)}


def test_op4(spark, sf, docs):
    fps = [brute_fp(t) for _, t in docs]
    group, first = brute_groups(fps, 2), {}
    for (i, _), g in zip(docs, group):
        first[g] = min(first.get(g, i), i)
    want = sorted((i, f"{f:016x}", first[g]) for (i, _), f, g in zip(docs, fps, group))
    assert sorted(map(tuple, result(spark, sf, "op4_simhash"))) == want


def test_op5(spark, sf, docs):
    got = {r["doc_id"]: r for r in result(spark, sf, "op5_license_scans")}
    for i, t in docs:
        n, hits = brute_base(t)
        at = [k for k, _ in hits]
        assert (got[i]["n_words"], got[i]["n_base"]) == (n, len(hits))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in hits}))
        labels, covered = brute_labels(t)
        assert got[i]["labels"] == ",".join(sorted(labels))
        assert len(covered) / max(1, n) <= got[i]["score"] + 1e-9 and got[i]["score"] <= 1.0
        assert (got[i]["score"] > 0) == bool(labels)


def test_op5_score_counts_each_word_once(spark, tmp_path):
    rows = [(1, "x y licensed under the apache license version 2 z w"), (2, "under the mit license"), (3, None), (4, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in queries.op5_license_scans(spark, str(tmp_path)).collect()}
    assert got == {1: pytest.approx(7 / 11), 2: 1.0, 3: 0.0, 4: 0.0}


def test_op6(spark, sf, docs):
    got = {r["doc_id"]: r for r in result(spark, sf, "op6_document_fingerprints")}

    def likeness(a, b):
        if a.split(":")[0] == b.split(":")[0]:
            return 1.0
        a, b = ({x.split(":")[2][k:k + 8] for k in range(0, len(x.split(":")[2]), 8)} for x in (a, b))
        return len(a & b) / len(a | b)

    for k, (i, t) in enumerate(docs):
        following, third = docs[(k + 1) % len(docs)][1], len(t) // 3
        edited = t[:len(t) - third] + following[:third]
        own, changed = brute_fingerprint(t, True), brute_fingerprint(edited, True)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(edited))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, changed)
        assert r["near_edited"] == pytest.approx(likeness(own, changed))
        assert r["near_next"] == pytest.approx(likeness(own, brute_fingerprint(following, True)))


def test_op7(spark, sf, docs):
    got = {r["doc_id"]: r for r in result(spark, sf, "op7_suffix_dedup")}
    for (i, t), kept in zip(docs, brute_cut([t for _, t in docs], 400)):
        n = len(t.encode())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, n - len(kept), sha(kept))
        assert (got[i]["n_spans"] > 0) == (len(kept) < n)


def test_op8(spark, sf, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
    want = []
    for i, t in docs:
        ids = lib.encode(t)
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else "")))
    assert sorted(map(tuple, result(spark, sf, "op8_sentencepiece"))) == sorted(want)


def test_op10(spark, sf, docs):
    con = duckdb.connect()
    labels = dict(con.execute(f"select doc_id, toxic from read_parquet('{sf}/labels.parquet')").fetchall())
    got = {r["doc_id"]: r for r in result(spark, sf, "op10_toxicity")}
    assert sorted(got) == sorted(i for i, _ in docs)
    assert all(r["kept"] != r["is_toxic"] for r in got.values())
    assert not any(got[i]["is_toxic"] for i, y in labels.items() if i in got and not y)
