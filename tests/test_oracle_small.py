"""Oracle tests: registered queries vs their DuckDB SQL on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from ligandspark.session import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ["centroid_cv_report", "smiles_encode", "binary_report9", "auc_by_group", "stratified_folds_seeded",
          "early_stop", "knn_vote", "wavelet_layer", "variant_consensus", "feature_blocks_join", "streaming_meter",
          "feature_blocks_unmatched", "tta_ensemble", "star_csv_scan", "featurize_smiles", "embed_callable",
          "labelled_blocks", "metric_dispatch", "saved_models_test", "selection_sinks", "numbered_scan", "csv_quarantine",
          "cosine_pairs", "cosine_threshold", "subset_objective", "fixed_model_scores", "cv_fixed_models",
          "fold_loss_gradient", "wavelet_classifier_fixed", "wavelet_loss", "wavelet_dispatch", "eval_single",
          "batch_diversity", "standardize_train_fit", "prediction_sink"]


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = df.columns
    got = _norm([tuple(r) for r in df.collect()])
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    want = _norm([tuple(row[i] for i in idx) for row in rel.fetchall()])
    assert got == want
