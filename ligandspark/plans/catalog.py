"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads whole test tables and returns scalar, long-form columns;
doubles are rounded to 6 decimals (computed in double) so that results can be
compared with an independent SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligandspark.operators import metrics as M
from ligandspark.operators.centroid import fold_centroid_scores
from ligandspark.operators.folds import stratified_folds as folds_op
from ligandspark.plans import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[r6(c).alias(c) for c in df.columns if c not in keep])


REPORT7 = ["accuracy", "precision", "recall", "f1", "specificity", "roc_auc", "pr_auc"]
REPORT9 = ["auc", "accuracy", "se", "sp", "f1", "pre", "rec", "err", "mcc"]


# ---------------------------------------------------------------------------
# flagship: folds -> per-fold standardization -> centroid score -> report
# ---------------------------------------------------------------------------

@register
def centroid_cv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = T.embeddings(spark, sf_dir).select("vec_id", "features", "y")
    folded = materialize(folds_op(emb, "y", "vec_id", n_folds=3, shuffle=False), "folded")
    scored = fold_centroid_scores(folded, "fold", "y", "features")
    rep = M.report7(scored, ["fold"], "p", "y")
    return rounded(rep, ["fold"])


# ---------------------------------------------------------------------------
# sequences (F1-F9, P9, P10) and embedding jobs
# ---------------------------------------------------------------------------

from ligandspark.functions import sequences as S  # noqa: E402
from ligandspark.operators import embed as EM  # noqa: E402
from ligandspark.session import materialize, scratch_path  # noqa: E402
from ligandspark.sources import io as IO  # noqa: E402
from pyspark.sql import types as TT  # noqa: E402
from ligandspark.plans.sizing import collect_small, spread  # noqa: E402
from ligandspark.session import read_table  # noqa: E402


def _docs(spark, sf_dir):
    # text work is CPU-bound: make sure every core gets a share
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def smiles_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("tok", S.smiles_tokens(F.col("text")))
    return d.select(
        "doc_id",
        F.size("tok").cast("long").alias("n_tokens"),
        S.dropped_chars(F.col("text"), F.col("tok")).cast("long").alias("dropped_chars"),
        F.md5(F.array_join("tok", " ")).alias("tokens_md5"),
    )


@register
def smiles_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("tok", S.smiles_tokens(F.col("text")))
    d = d.withColumn("cut", F.when(F.size("tok") > S.MAX_TOKENS, S.middle_chars(F.col("text"))).otherwise(F.col("text")))
    d = d.withColumn("ctok", S.cut_tokens(F.col("text"), F.col("tok")))
    return d.select(
        "doc_id",
        F.size("tok").cast("long").alias("n_tokens"),
        S.fits(F.col("tok")).alias("fits"),
        F.length("cut").cast("long").alias("cut_len"),
        F.size("ctok").cast("long").alias("cut_n_tokens"),
        F.md5("cut").alias("cut_md5"),
    )


def _encoded(spark, sf_dir):
    d = _docs(spark, sf_dir)
    d = d.withColumn("tok", S.smiles_tokens(F.col("text")))
    d = d.withColumn("ctok", S.cut_tokens(F.col("text"), F.col("tok")))
    # ids are referenced several times below, so the optimizer keeps them as
    # one projection instead of inlining (and recomputing) them
    d = d.withColumn("ids", S.encode_ids(F.col("ctok")))
    return d.select("doc_id", "tok", "ctok", "ids", S.mask_from_ids(F.col("ids")).alias("mask"))


@register
def smiles_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _encoded(spark, sf_dir)
    return e.select(
        "doc_id",
        # P10 on the uncut text: the padded sequence has 201 entries exactly
        # when the text has at most 200 tokens
        S.fits(F.col("tok")).alias("valid_raw"),
        (F.size("ids") == S.MAX_TOKENS + 1).alias("valid"),
        F.aggregate("mask", F.lit(0), lambda a, m: a + m).cast("long").alias("n_atoms"),
        F.size(F.filter("ids", lambda i: i == S.VOCAB.index(S.OTHER_ATOM))).cast("long").alias("n_other_atom"),
        F.size(F.filter("ids", lambda i: i == S.VOCAB.index(S.OTHER_TOKEN))).cast("long").alias("n_other_token"),
        F.md5(F.array_join(F.when(F.size("ids") == S.MAX_TOKENS + 1, F.col("ids")), ",")).alias("ids_md5"),
    )


@register
def atom_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct = _cut_tokens(spark, sf_dir)
    enc = S.encode_tokens_long(ct, "doc_id", "ctok")
    return enc.where(F.col("atom") == 1).select("doc_id", F.col("pos").alias("atom_pos"), "token_id")


@register
def protein_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("prep", S.protein_prepare(F.col("text")))
    return d.select(
        "doc_id",
        F.substring_index("prep", " ", 1).alias("prefix"),
        F.length("prep").cast("long").alias("prepared_len"),
        F.md5("prep").alias("prepared_md5"),
    )


BATCH_SIZE = 8


@register
def batch_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    # residues + direction prefix token + end token
    d = d.select("doc_id", (F.length("text") + 2).cast("long").alias("seq_len"),
                 (F.col("doc_id") / BATCH_SIZE).cast("long").alias("batch_id"))
    padded, n_pad = S.batch_padding(F.col("seq_len"), F.col("batch_id"))
    return d.select("doc_id", "batch_id", "seq_len", padded.alias("padded_len"), n_pad.alias("n_pad"))


EMBED_DIM = 64


def _cut_tokens(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("tok", S.smiles_tokens(F.col("text")))
    return d.select("doc_id", S.cut_tokens(F.col("text"), F.col("tok")).alias("ctok"))


@register
def embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = _docs(spark, sf_dir).select("doc_id", S.smiles_tokens(F.col("text")).alias("tok"))
    c = EM.hashed_ngram_counts(tok, "doc_id", "tok", EMBED_DIM)
    return c.select("doc_id", F.col("dim").cast("int").alias("dim"), F.col("cnt").cast("long").alias("cnt"))


def _split(spark, sf_dir):
    """All documents with a split, and beside each one a row (id -1 - doc_id) of
    its non-SMILES signs only, which has no token."""
    d = _docs(spark, sf_dir)
    signs = F.replace(F.regexp_replace("text", r"[^ \-,;_]", ""), F.lit("-"), F.lit(""))
    both = F.array(F.struct("doc_id", "text"), F.struct((-1 - F.col("doc_id")).alias("doc_id"), signs.alias("text")))
    return d.select(F.explode(both).alias("r"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split")
                    ).select("r.doc_id", "r.text", "split")


@register
def embed_quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _split(spark, sf_dir).withColumn("ok", F.size(S.smiles_tokens(F.col("text"))) > 0)
    return v.groupBy("split").agg(F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


@register
def featurize_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 as a job: whole token sequences -> hashed vectors -> quarantine ->
    per-split tables (S5), read back (S1); one row per input row."""
    out = scratch_path(spark, "featurized-smiles")
    good, bad, _ = EM.featurize_smiles(_split(spark, sf_dir), "doc_id", "text", out, dim=EMBED_DIM)
    schema = TT.StructType([f for f in good.drop("error", "split").schema.fields])
    back = IO.read_split_pair(spark, out, schema, fmt="parquet", layout="partitioned")
    n = F.aggregate("features", F.lit(0.0), lambda s, x: s + x).cast("long")
    return (back.select("doc_id", "split", n.alias("n_grams"), F.element_at("features", 1).cast("long").alias("first_dim"),
                        F.lit(None).cast("string").alias("error"))
            .unionByName(bad.select("doc_id", "split", F.lit(None).cast("long").alias("n_grams"),
                                    F.lit(None).cast("long").alias("first_dim"), "error")))


def letter_encoder(texts):
    """Counts of four letters; raises for a text without letters (so it is quarantined)."""
    out = []
    for t in texts:
        if not any(c.isascii() and c.isalpha() for c in t):
            raise ValueError("no letters")
        out.append([t.count(c) for c in "ACGT"])
    return out


@register
def embed_callable(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = EM.embed_rows(_split(spark, sf_dir), "text", letter_encoder, 4)
    f = F.col("features")
    return out.select("doc_id", F.col("error").isNull().alias("ok"), "error",
                      *[f[i].cast("long").alias(c) for i, c in enumerate("acgt")])


@register
def featurize_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 as a job with a Python encoder over the prepared strings."""
    good, bad, _ = EM.featurize_protein(_split(spark, sf_dir), "doc_id", "text", encoder=letter_encoder, dim=4)
    both = good.unionByName(bad)
    return both.groupBy("split").agg(F.count_if(F.col("error").isNull()).alias("n_ok"),
                                     F.count_if(F.col("error").isNotNull()).alias("n_failed"),
                                     F.sum(F.element_at("features", 1)).cast("long").alias("sum_a"))


# ---------------------------------------------------------------------------
# metrics over scored events
# ---------------------------------------------------------------------------

from ligandspark.operators import ensemble as EN  # noqa: E402
from ligandspark.operators.folds import class_weight_by_fold, task_pos_weight  # noqa: E402
from ligandspark.functions import vectors as V  # noqa: E402


@register
def binary_report7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    return rounded(M.report7(ev, ["fold"], "p", "y"), ["fold"])


@register
def binary_report9(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    return rounded(M.report9(ev, ["fold"], "p", "y"), ["fold"])


@register
def auc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    return rounded(M.ranking_metrics(ev, ["user_id"], "p", "y").select("user_id", "roc_auc"), ["user_id"])


@register
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    return rounded(M.ranking_metrics(ev, ["fold"], "p", "y").select("fold", "average_precision"), ["fold"])


@register
def pr_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    return rounded(M.ranking_metrics(ev, ["fold"], "p", "y").select("fold", "pr_auc_trapezoid"), ["fold"])


@register
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    return rounded(M.roc_points(ev, ["fold"], "p", "y"), ["fold"])


@register
def fold_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    rep = M.report7(ev, ["fold"], "p", "y")
    return rounded(rep.agg(*[F.avg(c).alias(c) for c in REPORT7]), [])


@register
def bce_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = T.scored_events(spark, sf_dir)
    w = class_weight_by_fold(ev, "fold", "y").select("fold", "pos_weight")
    j = ev.join(F.broadcast(w), "fold")  # one row per fold
    loss = j.groupBy("fold").agg(F.first("pos_weight").alias("pos_weight"),
                                 F.avg(M.weighted_bce(F.col("logit"), F.col("y"), F.col("pos_weight"))).alias("loss"))
    return rounded(loss, ["fold"])


# ---------------------------------------------------------------------------
# masked multi-task (documents x labels): P6, A3, A8, A10, A16, A17, A24, A25
# ---------------------------------------------------------------------------

TASKS = ("quality", "toxic")


def doc_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long (doc_id, task, y, mask, logit): a document without a labels row
    has mask 0 and y NULL.  Scores: quality = ln(1 + n_chars) - 7.5, toxic =
    20 * upper-case share - 1.5."""
    d = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    lab = read_table(spark, sf_dir, "labels")
    d = d.join(lab, "doc_id", "left")
    # upper-case letters A-Z counted with translate (a character map, no regex)
    upper = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    upper_share = upper / F.greatest(F.length("text"), F.lit(1))
    logits = {"quality": F.log1p(F.col("n_chars").cast("double")) - 7.5, "toxic": F.lit(20.0) * upper_share - 1.5}
    cells = F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).alias("y"),
                               F.col(t).isNotNull().cast("double").alias("mask"), logits[t].alias("logit"))
                      for t in TASKS])
    return d.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.*")


@register
def multitask_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    # roc_auc and roc_prc of compute_metric from one ranking pass
    m = M.masked(doc_tasks(spark, sf_dir)).withColumn("_p", M.sigmoid(F.col("logit")))
    r = M.ranking_metrics(m, ["task"], "_p", "y")
    out = r.select("task", (F.col("n_pos") + F.col("n_neg")).alias("n"), F.round("roc_auc", 4).alias("roc_auc"),
                   F.col("pr_auc_trapezoid").alias("roc_prc"))
    return rounded(out, ["task", "n"])


@register
def task_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lt = doc_tasks(spark, sf_dir)
    auc = M.compute_metric(lt, "roc_auc")
    return rounded(auc.agg(F.avg("value").alias("mean_roc_auc"), F.count(F.lit(1)).alias("n_tasks")), ["n_tasks"])


@register
def task_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(task_pos_weight(doc_tasks(spark, sf_dir)), ["task", "n_pos", "n_neg"])


@register
def masked_cell_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lt = doc_tasks(spark, sf_dir)
    cell = M.weighted_bce(F.col("logit"), F.coalesce(F.col("y"), F.lit(0))) * (F.col("mask") != 0).cast("double")
    return rounded(lt.agg(F.count(F.lit(1)).alias("n_cells"), F.avg(cell).alias("loss")), ["n_cells"])


LOSS_BATCH = 32


@register
def batch_loss_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    lt = doc_tasks(spark, sf_dir).withColumn("batch", (F.col("doc_id") / LOSS_BATCH).cast("long"))
    cell = M.weighted_bce(F.col("logit"), F.coalesce(F.col("y"), F.lit(0))) * (F.col("mask") != 0).cast("double")
    per = lt.groupBy("batch").agg(F.avg(cell).alias("loss"), F.countDistinct("doc_id").alias("rows"))
    return rounded(per.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("rows").alias("n_rows"),
                           F.sum(F.col("loss") * F.col("rows")).alias("total_loss")), ["n_batches", "n_rows"])


# ---------------------------------------------------------------------------
# regression metrics (lineitem): A12-A15
# ---------------------------------------------------------------------------

@register
def regression_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("task"), F.col("l_quantity").alias("y"),
                     (F.col("l_extendedprice") / 1000.0).alias("pred"),
                     (F.col("l_linestatus") == "F").cast("double").alias("mask"))
    r = M.regression_metrics(M.masked(rows), ["task"], "y", "pred")
    return rounded(r, ["task", "n", "n_dropped"])


# ---------------------------------------------------------------------------
# embeddings: vectors, standardization, folds, ensembles, pooling
# ---------------------------------------------------------------------------

WIDTH = 64


@register
def vector_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", "label", "features")
    w = V.to_wide(e, "features", "f_", WIDTH)
    return rounded(w, ["vec_id", "label"])


@register
def vector_from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    w = V.to_wide(e, "features", "f_", WIDTH)
    back = w.select("vec_id", V.from_wide(V.numbered("f_", WIDTH)).alias("v"))
    return rounded(back.select("vec_id", F.posexplode("v").alias("dim", "value")), ["vec_id", "dim"])


def subset_positions(width: int = WIDTH, seed: int = 47) -> list[float]:
    """A fixed selection vector (the form M3 returns) used by vector_subset."""
    import numpy as np
    return list(np.random.RandomState(seed).rand(width))


@register
def vector_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    idx = V.selected_indexes(subset_positions())
    s = e.select("vec_id", V.subset(F.col("features"), subset_positions()).alias("v"))
    m = F.create_map(*[c for k, i in enumerate(idx) for c in (F.lit(k), F.lit(i))])
    out = s.select("vec_id", F.posexplode("v").alias("k", "value"))
    return rounded(out.select("vec_id", (F.col("k") + 1).alias("new_dim"),
                              F.element_at(m, F.col("k")).alias("src_dim"), "value"),
                   ["vec_id", "new_dim", "src_dim"])


@register
def standardize_train_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ligandspark.operators.assemble import standardize_train_fit as fit
    e = T.embeddings(spark, sf_dir).select("vec_id", "split", "features")
    z = fit(e, "features", "split", "train")
    return rounded(z.select("vec_id", "split", F.posexplode("features").alias("dim", "z")), ["vec_id", "split", "dim"])


@register
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ligandspark.operators.folds import stratified_folds as folds
    e = T.embeddings(spark, sf_dir).select("vec_id", "label")
    return folds(e, "label", "vec_id", n_folds=3, shuffle=False)


@register
def stratified_folds_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ligandspark.operators.folds import stratified_folds as folds
    e = T.embeddings(spark, sf_dir).select("vec_id", "label")
    return folds(e, "label", "vec_id", n_folds=5, shuffle=True, seed=47)


@register
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ligandspark.operators.folds import stratified_folds as folds
    e = T.embeddings(spark, sf_dir).select("vec_id", "y")
    f = folds(e, "y", "vec_id", n_folds=5, shuffle=True, seed=47)
    return rounded(class_weight_by_fold(f, "fold", "y"), ["fold", "n_pos", "n_neg"])


def _emb_logits(spark, sf_dir):
    """A fixed linear scorer over the embeddings: logit = 4 * sum(features)."""
    e = T.embeddings(spark, sf_dir)
    return e.withColumn("logit", F.lit(4.0) * F.aggregate("features", F.lit(0.0), lambda s, x: s + x)) \
            .withColumn("mask", (F.col("variant") != 3).cast("double"))


@register
def tta_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb_logits(spark, sf_dir)
    g = EN.tta_ensemble(e, "sample_id", "logit", "y", "mask")
    return rounded(g, ["sample_id", "n_copies"])


@register
def variant_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb_logits(spark, sf_dir)
    g = EN.variant_ensemble(e, "sample_id", "variant", "logit", "y")
    return rounded(g, ["sample_id", "y", "n_variants"])


@register
def variant_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir)
    return rounded(EN.variant_consensus(e, "sample_id", "variant"), ["sample_id"])


DIVERSITY_BATCH = 32


@register
def batch_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).withColumn("batch", (F.col("vec_id") / DIVERSITY_BATCH).cast("long"))
    return rounded(EN.batch_diversity(e, "batch"), ["batch", "batch_rows"])


@register
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sequence = sample (5 positions); mean over positions > 0."""
    e = T.embeddings(spark, sf_dir).where(F.col("variant") > 0)
    lng = e.select("sample_id", F.posexplode("features").alias("dim", "x"))
    return rounded(lng.groupBy("sample_id", "dim").agg(F.avg("x").alias("value")), ["sample_id", "dim"])


@register
def first_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position-0 vector of each sequence, and the count of its
    'atom' positions (label < 5 marks an atom position)."""
    e = T.embeddings(spark, sf_dir)
    atoms = e.groupBy("sample_id").agg(F.count_if((F.col("y") == 1) & (F.col("variant") > 0)).alias("n_atoms"))
    first = e.where(F.col("variant") == 0).select("sample_id", F.posexplode("features").alias("dim", "value"))
    return rounded(first.join(atoms, "sample_id"), ["sample_id", "dim", "n_atoms"])


POOL_BINS = 10


@register
def adaptive_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", V.adaptive_avg_pool(F.col("features"), POOL_BINS).alias("b"))
    return rounded(e.select("vec_id", F.posexplode("b").alias("bin", "value")), ["vec_id", "bin"])


@register
def eval_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: score all rows, sigmoid, 9-metric list (single task)."""
    ev = T.scored_events(spark, sf_dir)
    return rounded(M.report9(ev, [], "p", "y"), [])


@register
def eval_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: mean of logits, labels and masks over copies (A19), then the
    9-metric list.  Copies of a test-table sample do not all share a label,
    so the averaged label is binarized at 0.5 (copies of a real sample agree,
    where this is the identity)."""
    e = _emb_logits(spark, sf_dir)
    g = EN.tta_ensemble(e, "sample_id", "logit", "y", "mask")
    g = g.withColumn("y", (F.col("mean_y") >= 0.5).cast("int"))
    return rounded(M.report9(g, [], "p", "y"), [])


@register
def eval_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M10 + S8: per sample the mean of five variant logits (prediction),
    the label and the mean canonical-variant cosine."""
    e = _emb_logits(spark, sf_dir)
    g = EN.variant_ensemble(e, "sample_id", "variant", "logit", "y")
    c = EN.variant_consensus(T.embeddings(spark, sf_dir), "sample_id", "variant")
    out = g.join(c, "sample_id").select(
        F.col("sample_id").cast("string").alias("smiles"), F.col("p").alias("prediction"),
        F.col("y").alias("label"), "cos_similarity")
    return rounded(out, ["smiles", "label"])


@register
def eval_variants_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _emb_logits(spark, sf_dir)
    g = EN.variant_ensemble(e, "sample_id", "variant", "logit", "y")
    return rounded(M.report9(g, [], "p", "y"), [])


# ---------------------------------------------------------------------------
# sources and sinks (S1, S5, S8, S9, U0), assembly
# ---------------------------------------------------------------------------

from ligandspark.operators import assemble as AS  # noqa: E402
from ligandspark.operators import history as H  # noqa: E402


@register
def csv_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the embeddings as a split pair of wide CSV tables into the shared
    checkpoint folder (S5), read them back with an explicit schema (S1) and
    union the splits (U0)."""
    e = T.embeddings(spark, sf_dir).select("vec_id", "label", "split", "features")
    out = scratch_path(spark, "csv-split")
    IO.write_feature_table(e, out, "features", prefix="f_", width=WIDTH, fmt="csv")
    schema = IO.feature_schema([("vec_id", TT.LongType()), ("label", TT.IntegerType())], "f_", WIDTH, label=None)
    back = IO.read_split_pair(spark, out, schema)
    return rounded(back, ["split", "vec_id", "label"])


def _drug_block(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("row_id"),
                    F.when(F.col("p_partkey") % 5 == 0, "test").otherwise("train").alias("split"),
                    F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("features"))


def _target_block(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_partkey").alias("row_id")).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    return g.select("row_id", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train").alias("split"),
                    F.array("q", "d").alias("features"))


@register
def feature_blocks_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = AS.standardize_train_fit(_drug_block(spark, sf_dir))
    t = AS.standardize_train_fit(_target_block(spark, sf_dir))
    j = AS.concat_blocks(d, t, ["row_id", "split"])
    return rounded(j.select("row_id", "split", F.posexplode("features").alias("dim", "value")),
                   ["row_id", "split", "dim"])


@register
def feature_blocks_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    # part keys are dense and order keys sparse, so either side has keys of its own
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.array("o_totalprice").alias("features"))
    return AS.unmatched_keys(_drug_block(spark, sf_dir), orders, ["row_id"])


@register
def star_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    fact = li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("drug_id"),
                     F.col("l_suppkey").alias("target_id"),
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))
    drugs = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("drug_id"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("drug_features"))
    targets = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("target_id"),
        F.array(F.col("s_nationkey").cast("double"), F.col("s_acctbal")).alias("target_features"))
    j = AS.star_lookup(fact, drugs, targets)
    x = F.concat("drug_features", "target_features")
    return rounded(j.select("l_orderkey", "l_linenumber", "drug_id", "target_id", "label",
                            *[F.element_at(x, i).alias(f"x_{i}") for i in range(1, 5)]),
                   ["l_orderkey", "l_linenumber", "drug_id", "target_id", "label"])


# ---------------------------------------------------------------------------
# metric histories (W3-W5): run = user_id, epochs in (ts, event_id) order,
# score = value
# ---------------------------------------------------------------------------

PATIENCE = 5


def _history(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "event_id", F.col("value").alias("score"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"))
    return H.number_epochs(ev, "run", "_t", "event_id", "epoch").drop("_t")


@register
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = H.running_best(_history(spark, sf_dir), "run", "epoch", "score")
    return rounded(h.select("run", "epoch", "score", "running_best"), ["run", "epoch"])


@register
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.best_epoch(_history(spark, sf_dir), "run", "epoch", "score"), ["run", "best_epoch"])


@register
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = H.early_stop(_history(spark, sf_dir), "run", "epoch", "score", PATIENCE)
    return rounded(e, ["run", "n_epochs", "stop_epoch", "best_epoch"])


# ---------------------------------------------------------------------------
# kNN (J4, J5, T2, A29), selection (M3), wavelets (F12-F17, M5, M6),
# training (M1, M2, M4, M7, B3)
# ---------------------------------------------------------------------------

import numpy as np  # noqa: E402

from ligandspark.operators import knn as KN  # noqa: E402
from ligandspark.operators import pivots as PV  # noqa: E402
from ligandspark.operators import select as SEL  # noqa: E402
from ligandspark.operators import train as TR  # noqa: E402
from ligandspark.operators import wavelet_layer as WL  # noqa: E402
from ligandspark.operators import wavelet_train as WT  # noqa: E402
from ligandspark.functions import wavelets as WV  # noqa: E402

KNN_K = 3
KNN_FOLDS = 3


def _knn_input(spark, sf_dir):
    from ligandspark.operators.folds import stratified_folds as folds
    e = T.embeddings(spark, sf_dir).select("vec_id", "label", "features")
    return materialize(folds(e, "label", "vec_id", n_folds=KNN_FOLDS, shuffle=False), "knn-input")


@register
def knn_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _knn_input(spark, sf_dir)
    neigh = KN.knn_neighbours(f, "vec_id", "features", KNN_K, "label", "fold")
    pred = KN.knn_vote(neigh).select(F.col("qid").alias("vec_id"), "pred")
    out = pred.join(f.select("vec_id", "fold", "label"), "vec_id")
    return out.select("vec_id", "fold", "pred", (F.col("pred") == F.col("label")).cast("int").alias("hit"))


def cost_candidates(width: int = WIDTH, n: int = 4, seed: int = 11) -> np.ndarray:
    """Fixed candidate positions (rows) for subset_cost, plus an empty mask."""
    pos = np.random.RandomState(seed).rand(n, width)
    return np.vstack([pos, np.zeros((1, width))])


@register
def subset_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _knn_input(spark, sf_dir)
    masks = KN.masks_from_positions(cost_candidates())
    c = KN.subset_cost(f, "vec_id", "features", "label", "fold", masks, KNN_K)
    return rounded(c, ["cand", "n_selected"])


COS_TOPK = 5


@register
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    n = KN.knn_neighbours(e, "vec_id", "features", COS_TOPK, metric="cosine")
    # the ranking comes from the numpy blocks; the reported value is F10 in
    # the JVM (sequential sums), joined back on the two ids (k rows per id)
    qv = e.select(F.col("vec_id").alias("qid"), F.col("features").alias("_a"))
    rv = e.select(F.col("vec_id").alias("rid"), F.col("features").alias("_b"))
    j = n.join(qv, "qid").join(rv, "rid")
    return rounded(j.select(F.col("qid").alias("vec_id"), "rank", F.col("rid").alias("neighbor_id"),
                            V.cosine(F.col("_a"), F.col("_b")).alias("cos")), ["vec_id", "rank", "neighbor_id"])


@register
def select_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the selected 0-based feature indexes (S6) with their cost."""
    f = _knn_input(spark, sf_dir)
    idx, best, curve = SEL.select_features(f, "vec_id", "features", "label", "fold", WIDTH)
    return spark.createDataFrame([(i, best, float(curve[0])) for i in idx],
                                 "feature_index int, best_cost double, first_cost double")


@register
def selection_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: the best cost after each round of the search."""
    f = _knn_input(spark, sf_dir)
    _, _, curve = SEL.select_features(f, "vec_id", "features", "label", "fold", WIDTH, max_iter=10)
    return SEL.convergence_table(spark, curve)


@register
def subset_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memoized objective over two generations on one layout, in which
    positions come again."""
    f = _knn_input(spark, sf_dir)
    objective, layout = SEL.feature_subset_objective(f, "vec_id", "features", "label", "fold", KNN_K)
    try:
        pos = cost_candidates()
        first = objective(pos[:3])
        second = objective(pos[1:])
    finally:
        layout.release()
    rows = [(1, i, float(c)) for i, c in enumerate(first)] + [(2, i + 1, float(c)) for i, c in enumerate(second)]
    return rounded(spark.createDataFrame(rows, "generation int, cand int, cost double"), ["generation", "cand"])


COS_LEAST = 0.25


@register
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of distinct vectors with at least this cosine, by class
    representatives, with the number of rows of either class."""
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    pairs, _ = PV.cosine_at_least(e, "vec_id", "features", COS_LEAST)
    # rows that repeat a class's id stand in its pairs as often
    each = F.explode(F.array_repeat(F.lit(0), F.col("same_a") * F.col("same_b")))
    pairs = pairs.withColumn("_each", each)
    return rounded(pairs.select("a", "b", "cos", "n_a", "n_b"), ["a", "b", "n_a", "n_b"])


@register
def wavelet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", F.posexplode("features").alias("dim", "x"))
    x, n = F.col("x"), F.col("dim")
    return rounded(e.select("vec_id", "dim", WV.mexican_hat(x).alias("mexican_hat"), WV.morlet(x).alias("morlet"),
                            WV.dog(x).alias("dog"), WV.meyer(x).alias("meyer"),
                            WV.shannon(x, n, F.lit(WIDTH)).alias("shannon")), ["vec_id", "dim"])


def spread_layer(n_in: int, n_out: int, wavelet: str, seed: int) -> WL.WaveletLayer:
    """A layer with fixed random weights, scales in [0.5, 1.5) and translations in [-0.1, 0.1)."""
    rng, b = np.random.RandomState(seed), 1.0 / np.sqrt(n_in)
    w, s, t = (rng.uniform(lo, hi, (n_out, n_in)) for lo, hi in ((-b, b), (0.5, 1.5), (-0.1, 0.1)))
    return WL.WaveletLayer(w, s, t, wavelet)


def layer_params():
    return [spread_layer(WIDTH, 8, "mexican_hat", 7), spread_layer(8, 4, "dog", 8)]


@register
def wavelet_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    out = WL.score_layers(e, "vec_id", "features", layer_params()[:1])
    return rounded(out.select("vec_id", F.posexplode("features").alias("j", "value")), ["vec_id", "j"])


@register
def wavelet_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    out = WL.score_layers(e, "vec_id", "features", layer_params())
    return rounded(out.select("vec_id", F.posexplode("features").alias("j", "value")), ["vec_id", "j"])


def _train_split(spark, sf_dir):
    from ligandspark.operators.folds import stratified_folds as folds
    e = T.embeddings(spark, sf_dir)
    tr = folds(e.where(F.col("split") == "train").select("vec_id", "y", "features"), "y", "vec_id",
               n_folds=5, shuffle=True, seed=47)
    tr = materialize(tr, "train-split")
    te = e.where(F.col("split") == "test").select("vec_id", "y", "features")
    return tr, te


@register
def cv_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, _ = _train_split(spark, sf_dir)
    preds, models, weights = TR.cross_validate(tr, "features", "y", "fold")
    return rounded(M.report7(preds, ["fold"], "p", "y"), ["fold"])


@register
def independent_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr, te = _train_split(spark, sf_dir)
    _, models, _ = TR.cross_validate(tr, "features", "y", "fold")
    preds = TR.independent_test(te, TR.model_table(spark, models), "features")
    return rounded(M.report7(preds, ["fold"], "p", "y"), ["fold"])


@register
def cv_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with the standardization of each fold's training rows, models saved."""
    tr, _ = _train_split(spark, sf_dir)
    preds, _, _ = TR.cross_validate(tr, "features", "y", "fold", per_fold=True, save_to=scratch_path(spark, "fold-models"))
    return rounded(M.report7(preds, ["fold"], "p", "y"), ["fold"])


WAVELET_STEPS = 15


@register
def wavelet_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: weights, scales and translations trained on the training split."""
    e = T.embeddings(spark, sf_dir).select("vec_id", "y", "split", "features")
    tr = e.where(F.col("split") == "train")
    n = tr.agg(F.count_if(F.col("y") == 0).alias("neg"), F.count_if(F.col("y") == 1).alias("pos")).first()
    w = n["neg"] / n["pos"] if n["pos"] else 1.0
    model = WT.fit(tr, "features", "y", WT.WaveletClassifier.init(WIDTH), w, WAVELET_STEPS)
    preds = WT.score(e.where(F.col("split") == "test"), "features", model)
    return rounded(M.report7(preds.withColumn("g", F.lit(1)), ["g"], "p", "y").drop("g"), [])


def fixed_wavelet() -> WT.WaveletClassifier:
    """Weights (i % 5 - 2) / 8, scales 1 + i % 3 / 4, translations (i % 7 - 3) / 50."""
    i = np.arange(WIDTH)
    return WT.WaveletClassifier((i % 5 - 2) / 8.0, 1.0 + i % 3 / 4.0, (i % 7 - 3) / 50.0, 1.5, -0.25, "mexican_hat",
                                0.1, 0.04)


@register
def wavelet_classifier_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 scoring with fixed parameters."""
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    return rounded(WT.score(e, "features", fixed_wavelet()).select("vec_id", "logit", "p"), ["vec_id"])


@register
def wavelet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 training loss, its gradient by bias and gain, and the moments of the
    wavelet sums, at fixed parameters."""
    e = T.embeddings(spark, sf_dir).select("y", "features")
    loss, g, m = WT.loss_and_gradient(e, "features", "y", fixed_wavelet(), 2.0)
    row = (float(loss), float(g[-2]), float(g[-1]), float(m.mean[0]), float(m.std[0]))
    return rounded(spark.createDataFrame([row], "loss double, by_gain double, by_bias double, mean double, std double"), [])


# ---------------------------------------------------------------------------
# Prediction accumulation
# ---------------------------------------------------------------------------

from ligandspark.operators.accumulate import MeterState  # noqa: E402


@register
def streaming_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events are counted in year by year, one year a second time,
    with a compaction between; the metrics per fold come from the state."""
    ev = T.scored_events(spark, sf_dir)
    state = MeterState(spark, scratch_path(spark, "meter"))
    preds = ev.select(F.lit("events").alias("run"), F.col("fold").cast("string").alias("task"), "logit",
                      F.col("y").cast("double").alias("y"), F.lit(1.0).alias("mask"), F.year("ts").alias("year"))
    years = sorted(r["year"] for r in collect_small(preds.select("year").distinct(), 10_000))
    for y in years:
        state.add(y, preds.where(F.col("year") == y))
        if y == years[0]:
            state.compact()
    state.add(years[0], preds.where(F.col("year") == years[0]))
    m = state.metrics()
    return rounded(m.select("task", "roc_auc", "average_precision", "pr_auc_trapezoid"), ["task"])


# ---------------------------------------------------------------------------
# scans and sinks as roundtrips (S2-S4, S6-S9), label attach (J3), metric
# dispatch (A16), clip (F18), saved fold models (M2)
# ---------------------------------------------------------------------------

def _doubles(*names: str) -> TT.StructType:
    return TT.StructType([TT.StructField(n, TT.DoubleType()) for n in names])


@register
def star_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star tables written as CSV per split, with columns in another
    order and more of them, read back by name with positional dimension ids (J2),
    summed per split and label."""
    out = scratch_path(spark, "star")
    part = read_table(spark, sf_dir, "part").orderBy("p_partkey").select(
        "p_name", F.col("p_retailprice").alias("d_2"), F.col("p_size").cast("double").alias("d_1"))
    supp = read_table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(
        F.col("s_acctbal").alias("t_2"), F.col("s_nationkey").cast("double").alias("t_1"), "s_name")
    fact = read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") - 1).alias("drug_id"), (F.col("l_suppkey") - 1).alias("target_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_orderkey") % 5 == 0).alias("held_out"))
    for sp in IO.SPLITS:
        part.write.options(**IO.CSV).csv(f"{out}/{sp}/drugs.csv")
        supp.write.options(**IO.CSV).csv(f"{out}/{sp}/targets.csv")
        fact.where(F.col("held_out") == (sp == "test")).write.options(**IO.CSV).csv(f"{out}/{sp}/interactions.csv")
    scans = IO.read_star_splits(spark, out, ["d_1", "d_2"], ["t_1", "t_2"], _doubles("d_1", "d_2"), _doubles("t_1", "t_2"))
    rows = None
    for sp, (f, d, t) in scans.items():
        j = AS.star_lookup(f, d, t).withColumn("split", F.lit(sp))
        rows = j if rows is None else rows.unionByName(j)
    x = F.concat("drug_features", "target_features")
    sums = rows.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.element_at(x, i)).alias(f"x_{i}") for i in range(1, 5)])
    return sums.select("split", "label", "n", *[F.round(f"x_{i}", 2).alias(f"x_{i}") for i in range(1, 5)])


@register
def numbered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``Label`` and numbered feature columns, written in another order beside
    another column, and read back by name."""
    out = scratch_path(spark, "numbered")
    e = T.embeddings(spark, sf_dir).select("features", F.col("label").alias("Label"), "vec_id")
    wide = V.to_wide(e, "features", "Feature_", WIDTH).select("Label", *V.numbered("Feature_", WIDTH)[::-1], "vec_id")
    wide.write.options(**IO.CSV).csv(out)
    back = IO.read_numbered_features(spark, out, WIDTH)
    d = back.select("label", F.posexplode("features").alias("dim", "x"))
    return d.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 6).alias("total"))


@register
def csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4 with malformed rows: beside each good line of an event there is one whose
    value is no number (for purchases) or whose last field is missing (others)."""
    out = scratch_path(spark, "malformed")
    ev = read_table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.round("value", 3).alias("value"), "event_type")
    good = F.concat_ws(",", "event_type", "user_id", "value", "event_id")
    bad = F.when(F.col("event_type") == "purchase", F.concat_ws(",", "event_type", "user_id", F.lit("n/a"), "event_id")
                 ).otherwise(F.concat_ws(",", "event_type", "user_id", "value"))
    lines = ev.select(F.explode(F.array(good, bad)).alias("value"))
    # every file begins with the header: the text sink has none, so it is the CSV sink's, of one unquoted column
    lines.select(F.col("value").alias("event_type,user_id,value,event_id")).write.options(
        header=True, quote="", escape="", sep="\u0001").csv(out)
    schema = TT.StructType([TT.StructField("event_id", TT.LongType()), TT.StructField("value", TT.DoubleType())])
    rows = IO.read_csv(spark, out, schema, malformed="quarantine")
    kept = IO.good_rows(rows).agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"),
                                  F.round(F.sum("value"), 2).alias("total"), F.sum("event_id").alias("ids"))
    gone = IO.malformed_rows(rows).groupBy(
        F.when(F.col("row").contains("n/a"), "no number").otherwise("missing field").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("total"), F.lit(None).cast("long").alias("ids"))
    return kept.unionByName(gone)


@register
def selection_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S7: the chosen indexes as a table, and both splits reduced to them
    with renumbered columns, written and read back."""
    out = scratch_path(spark, "selection")
    IO.write_selected_indexes(spark, V.selected_indexes(subset_positions()), f"{out}/indexes")
    idx = sorted(r[0] for r in spark.read.parquet(f"{out}/indexes").collect())
    e = T.embeddings(spark, sf_dir).select("vec_id", "split", "features")
    IO.write_reduced_tables(e, idx, f"{out}/reduced")
    schema = IO.feature_schema([("vec_id", TT.LongType())], "Feature_", len(idx), label=None)
    back = IO.read_split_pair(spark, f"{out}/reduced", schema)
    d = back.select("vec_id", "split", F.posexplode(V.from_wide(V.numbered("Feature_", len(idx)))).alias("k", "value"))
    return d.select("vec_id", "split", (F.col("k") + 1).alias("new_dim"), r6("value").alias("value"))


@register
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction table of :func:`eval_variants`, written and read back."""
    out = scratch_path(spark, "predictions")
    IO.write_predictions(eval_variants(spark, sf_dir), out)
    schema = TT.StructType([TT.StructField("smiles", TT.StringType()), *_doubles("prediction").fields,
                            TT.StructField("label", TT.IntegerType()), *_doubles("cos_similarity").fields])
    return IO.read_csv(spark, out, schema)


@register
def metric_report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 7-metric report per fold, written, read back and shown with 3 digits."""
    out = scratch_path(spark, "report")
    IO.write_metric_report(M.report7(T.scored_events(spark, sf_dir), ["fold"], "p", "y"), out)
    return IO.show_metric_report(spark.read.parquet(out))


@register
def labelled_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load -> standardize -> join -> label (S1, A1, J1, J3): both feature
    blocks and the label of each row, by row id and split."""
    d = AS.standardize_train_fit(_drug_block(spark, sf_dir))
    t = AS.standardize_train_fit(_target_block(spark, sf_dir))
    y = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").endswith("1").cast("int").alias("label"))
    j = AS.concat_blocks(d, t, ["row_id", "split"]).join(y, "row_id")
    return rounded(j.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), *[
        F.avg(F.element_at("features", i)).alias(f"mean_{i}") for i in range(1, 5)]), ["split", "label", "n"])


@register
def metric_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric name over the masked long task table."""
    lt = materialize(doc_tasks(spark, sf_dir), "tasks")
    out = None
    for name in M.METRIC_NAMES:
        m = M.compute_metric(lt, name)
        if name == "return_pred_true":
            m = m.groupBy("task").agg(F.sum(F.col("y_pred") * F.col("y_true")).alias("value"))
        m = m.select("task", F.lit(name).alias("metric"), r6("value").alias("value"))
        out = m if out is None else out.unionByName(m)
    return out


CLIP = (-0.1, 0.1)


@register
def clipped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every feature clipped into a fixed range."""
    e = T.embeddings(spark, sf_dir).select("vec_id", F.posexplode("features").alias("dim", "x"))
    return rounded(e.select("vec_id", "dim", V.clip(F.col("x"), *CLIP).alias("value")), ["vec_id", "dim"])


def fixed_models(spark: SparkSession, folds: int = 3) -> DataFrame:
    """Fold models with fixed weights ``((fold + 1) * (i + 1) % 7 - 3) / 2``."""
    rows = [(f, [((f + 1) * (i + 1) % 7 - 3) / 2.0 for i in range(WIDTH)], 0.1 * f) for f in range(folds)]
    return spark.createDataFrame(rows, "fold int, weights array<double>, intercept double")


@register
def saved_models_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 with models saved and loaded: every fold model scores the test split."""
    path = scratch_path(spark, "models")
    TR.save_models(fixed_models(spark), path)
    e = T.embeddings(spark, sf_dir)
    scored = TR.independent_test(e.where(F.col("split") == "test"), TR.load_models(spark, path), "features")
    return rounded(M.report7(scored, ["fold"], "p", "y"), ["fold"])


@register
def fixed_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logit and probability of every row under one fixed linear model."""
    m = fixed_models(spark).where("fold = 1").first()
    e = T.embeddings(spark, sf_dir).select("vec_id", "features")
    out = TR.score(e, TR.LinearModel(np.array(m["weights"]), m["intercept"]), "features")
    return rounded(out.select("vec_id", "logit", "p"), ["vec_id"])


@register
def cv_fixed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1's scoring: each row under the model of its own fold, and the report."""
    folded = _knn_input(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("int"))
    return rounded(M.report7(TR.score_held_out(folded, fixed_models(spark), "features", "fold"), ["fold"], "p", "y"), ["fold"])


@register
def fold_loss_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: weighted loss and gradient of all fold models at fixed weights, from one
    scan: each over the rows of the other folds."""
    folded = _knn_input(spark, sf_dir).withColumn("y", (F.col("label") < 5).cast("int"))
    models = sorted(fixed_models(spark).collect(), key=lambda r: r["fold"])
    points = np.array([[*r["weights"], r["intercept"]] for r in models])
    loss, g = TR.fold_sums(folded, "features", "y", "fold", np.arange(len(models)), points, np.array([2.0, 0.5, 1.25]))
    rows = [(f, i, float(loss[f]), float(g[f, i])) for f in range(len(models)) for i in range(WIDTH + 1)]
    df = spark.createDataFrame(rows, "fold int, dim int, loss double, gradient double")
    return df.select("fold", "dim", F.round("loss", 4).alias("loss"), F.round("gradient", 4).alias("gradient"))


@register
def wavelet_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the wavelet of every name, by name, summed; and the answer to a name
    that is none."""
    e = T.embeddings(spark, sf_dir).select(F.posexplode("features").alias("dim", "x"))
    sums = e.agg(*[F.sum(WV.wavelet(n, F.col("x"), F.col("dim"), F.lit(WIDTH))).alias(n) for n in WV.WAVELETS])
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 4).alias("total")) for n in WV.WAVELETS])
    out = sums.select(F.explode(cells).alias("c")).select("c.*", F.lit(None).cast("string").alias("error"))
    try:
        WV.wavelet("haar", F.col("x"))
        raise AssertionError("an unknown name was taken")
    except ValueError as err:
        bad = spark.createDataFrame([("haar", None, str(err))], "name string, total double, error string")
    return out.unionByName(bad)
