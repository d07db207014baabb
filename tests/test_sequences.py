from pyspark.sql import functions as F

from ligandspark.functions import sequences as S


def _one(spark, text, expr_fn):
    df = spark.createDataFrame([(text,)], "s string")
    return df.select(expr_fn(F.col("s")).alias("v")).first()["v"]


def test_tokens_drop_unmatched(spark):
    assert _one(spark, "BrB[nH]xyzK", S.smiles_tokens) == ["Br", "B", "[nH]"]


def test_unknown_bracket_and_percent(spark):
    seq = _one(spark, "[13CH4]%12Br.Cl", lambda c: S.canonical_tokens(S.smiles_tokens(c)))
    assert seq == ["[other_atom]", "[other_token]", "Br", "[other_token]", "Cl"]
    mask = _one(spark, "[13CH4]%12Br.Cl", lambda c: S.atom_mask(S.smiles_tokens(c)))
    assert mask[:6] == [0, 1, 0, 1, 0, 1]


def test_known_isotope_not_atom(spark):
    mask = _one(spark, "[2H]C#N", lambda c: S.atom_mask(S.smiles_tokens(c)))
    ids = _one(spark, "[2H]C#N", lambda c: S.token_ids(S.smiles_tokens(c)))
    assert mask[:5] == [0, 0, 1, 0, 1]
    assert ids[:5] == [1, S.VOCAB.index("[2H]"), 3, 25, 10]


def test_empty_string(spark):
    ids = _one(spark, "", lambda c: S.token_ids(S.smiles_tokens(c)))
    mask = _one(spark, "", lambda c: S.atom_mask(S.smiles_tokens(c)))
    assert ids == [1] + [0] * 200 and mask == [0] * 201


def test_length_limit_and_cut(spark):
    s200, s201 = "C" * 200, "C" * 100 + "N" * 101
    assert _one(spark, s200, S.cut_smiles) == s200
    assert _one(spark, s201, S.cut_smiles) == s201[0:200]     # start (201-200)//2 = 0
    s205 = "".join("CNOSP"[i % 5] for i in range(205))
    assert _one(spark, s205, S.cut_smiles) == s205[2:202]
    assert _one(spark, s201, lambda c: S.token_ids(S.smiles_tokens(c))) is None
    assert _one(spark, s200, lambda c: S.fits(S.smiles_tokens(c))) is True


def test_positions(spark):
    pos = _one(spark, "CC(=O)N", lambda c: S.mask_positions(S.atom_mask(S.smiles_tokens(c))))
    assert pos == [1, 2, 5, 7]


def test_protein_prepare(spark):
    assert _one(spark, "MKUZ", S.protein_prepare) == "<AA2fold> M K X X"
    for s in ["mkv", "MkV", "123", ""]:
        v = _one(spark, s, S.protein_prepare)
        assert v.startswith("<fold2AA> ")
        assert v[len("<fold2AA> "):] == " ".join(list(s))


def test_one_pass_encoding_matches(spark):
    rows = [("BrB[nH]xyzK",), ("[13CH4]%12Br.Cl",), ("[2H]C#N",), ("",), ("c1ccccc1O[Se]pb",)]
    df = spark.createDataFrame(rows, "s string").withColumn("tok", S.smiles_tokens(F.col("s")))
    out = df.select(S.token_ids(F.col("tok")).alias("a"), S.encode_ids(F.col("tok")).alias("b"),
                    S.atom_mask(F.col("tok")).alias("m1"), S.mask_from_ids(S.encode_ids(F.col("tok"))).alias("m2"))
    for r in out.collect():
        assert r["a"] == r["b"] and r["m1"] == r["m2"]
