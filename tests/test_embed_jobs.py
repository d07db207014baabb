import os
import tempfile

import pandas as pd

from ligandspark.operators.embed import featurize_protein, featurize_smiles


def test_featurize_smiles_quarantine_and_write(spark):
    rows = [(1, "CCO", "train"), (2, "xyz", "train"), (3, "c1ccccc1", "test"), (4, "", "test")]
    df = spark.createDataFrame(rows, "row_id long, smiles string, split string")
    out = os.path.join(tempfile.mkdtemp(prefix="ls-feat-"), "k")
    good, bad, obs = featurize_smiles(df, "row_id", "smiles", out, fmt="csv", dim=8, layout="split_files")
    assert sorted(r["row_id"] for r in bad.collect()) == [2, 4]
    assert obs.get["failed"] == 2 and obs.get["rows"] == 4
    back = spark.read.option("header", True).csv(os.path.join(out, "train.csv"))
    assert [c for c in back.columns if c.startswith("k_bert_")] == [f"k_bert_{i}" for i in range(1, 9)]
    assert back.count() == 1


def test_featurize_protein_with_failing_encoder(spark):
    df = spark.createDataFrame([(1, "MKV"), (2, "BAD"), (3, "")], "row_id long, seq string")

    def enc(texts: pd.Series):
        out = []
        for t in texts:
            if "X" in t:          # B -> X: this encoder refuses rare residues
                raise ValueError("rare residue")
            out.append([float(len(t)), 1.0])
        return out

    good, bad, obs = featurize_protein(df, "row_id", "seq", encoder=enc, dim=2)
    assert sorted(r["row_id"] for r in good.collect()) == [1, 3]
    errs = {r["row_id"]: r["error"] for r in bad.collect()}
    assert list(errs) == [2] and "rare residue" in errs[2]


def test_every_different_gram_is_hashed_once_per_task():
    import hashlib

    import pyarrow as pa

    from ligandspark.operators.embed import GramBuckets

    lists = [["C", "C", "O"], None, [], ["[C@H]", "C"], ["O"], ["C", "C", "O"]]
    grams = GramBuckets(8)
    got = grams.counts(pa.array(lists, pa.list_(pa.string())))
    for row, tokens in zip(got, lists, strict=True):
        want = [0] * 8
        for g in (tokens or []) + [f"{a} {b}" for a, b in zip((tokens or [])[:-1], (tokens or [])[1:])]:
            want[int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 8] += 1
        assert row.tolist() == want
    assert set(grams.known) == {"C", "O", "[C@H]", "C C", "C O", "[C@H] C"}
