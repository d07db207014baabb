"""DuckDB SQL for each registered query, written from the definitions (not from
the Spark plans).  Tables are the pre-registered views of the test data."""

from __future__ import annotations

ORACLE: dict[str, str] = {}


def report7_sql(src: str, g: str, p: str = "p", y: str = "y", digits: int | None = 6) -> str:
    """7-metric report per group ``g`` over relation ``src`` with prob ``p``."""
    if digits is None:
        return _report7_raw(src, g, p, y)
    return f"""
    cc AS (
      SELECT {g},
        count(*) FILTER (WHERE {y} = 0 AND NOT ({p} > 0.5)) AS tn,
        count(*) FILTER (WHERE {y} = 0 AND {p} > 0.5) AS fp,
        count(*) FILTER (WHERE {y} = 1 AND NOT ({p} > 0.5)) AS fn,
        count(*) FILTER (WHERE {y} = 1 AND {p} > 0.5) AS tp
      FROM {src} GROUP BY {g}),
    rk AS ({ranking_sql(src, g, p, y)})
    SELECT cc.{g},
      round((tp + tn)::DOUBLE / (tn + fp + fn + tp), 6) AS accuracy,
      round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
      round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
      round(CASE WHEN tn + fp = 0 THEN 1 ELSE tn::DOUBLE / (tn + fp) END, 6) AS specificity,
      round(rk.roc_auc, 6) AS roc_auc,
      round(rk.average_precision, 6) AS pr_auc
    FROM cc LEFT JOIN rk ON cc.{g} = rk.{g}
    """


def _report7_raw(src: str, g: str, p: str, y: str) -> str:
    return f"""
    cc AS (
      SELECT {g},
        count(*) FILTER (WHERE {y} = 0 AND NOT ({p} > 0.5)) AS tn,
        count(*) FILTER (WHERE {y} = 0 AND {p} > 0.5) AS fp,
        count(*) FILTER (WHERE {y} = 1 AND NOT ({p} > 0.5)) AS fn,
        count(*) FILTER (WHERE {y} = 1 AND {p} > 0.5) AS tp
      FROM {src} GROUP BY {g}),
    rk AS ({ranking_sql(src, g, p, y)}),
    rep AS (SELECT cc.{g},
      (tp + tn)::DOUBLE / (tn + fp + fn + tp) AS accuracy,
      CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
      CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
      CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1,
      CASE WHEN tn + fp = 0 THEN 1 ELSE tn::DOUBLE / (tn + fp) END AS specificity,
      rk.roc_auc, rk.average_precision AS pr_auc
    FROM cc LEFT JOIN rk ON cc.{g} = rk.{g})
    """


def report9_sql(src: str, g: str, p: str = "p", y: str = "y", emit_group: bool = True) -> str:
    """9-metric report (decisions p >= 0.5) per group ``g``."""
    sel = f"cc.{g}, " if emit_group else ""
    return f"""
    cc AS (
      SELECT {g},
        count(*) FILTER (WHERE {y} = 0 AND NOT ({p} >= 0.5)) AS tn,
        count(*) FILTER (WHERE {y} = 0 AND {p} >= 0.5) AS fp,
        count(*) FILTER (WHERE {y} = 1 AND NOT ({p} >= 0.5)) AS fn,
        count(*) FILTER (WHERE {y} = 1 AND {p} >= 0.5) AS tp
      FROM {src} GROUP BY {g}),
    rk AS ({ranking_sql(src, g, p, y)})
    SELECT {sel}
      round(rk.roc_auc, 6) AS auc,
      round((tp + tn)::DOUBLE / (tn + fp + fn + tp), 6) AS accuracy,
      round(round(CASE WHEN tp + fn = 0 THEN NULL ELSE tp::DOUBLE / (tp + fn) END, 4), 6) AS se,
      round(round(CASE WHEN tn + fp = 0 THEN NULL ELSE tn::DOUBLE / (tn + fp) END, 4), 6) AS sp,
      round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
      round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS pre,
      round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS rec,
      round(1 - (tp + tn)::DOUBLE / (tn + fp + fn + tp), 6) AS err,
      round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
            ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn)
                 / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc
    FROM cc LEFT JOIN rk ON cc.{g} = rk.{g}
    """


def ranking_sql(src: str, g: str, p: str = "p", y: str = "y") -> str:
    """SELECT g, roc_auc, average_precision, pr_auc_trapezoid.

    AUC from the Mann-Whitney rank sum with average ranks for ties;
    AP and trapezoid from the steps of recall over descending distinct scores."""
    return f"""
      WITH d AS (
        SELECT {g}, {p}::DOUBLE AS s, sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN {y} = 0 THEN 1 ELSE 0 END) AS neg
        FROM {src} WHERE {p} IS NOT NULL AND NOT isnan({p}::DOUBLE) AND {y} IN (0, 1)
        GROUP BY {g}, {p}::DOUBLE),
      c AS (
        SELECT *,
          coalesce(sum(pos + neg) OVER (PARTITION BY {g} ORDER BY s ASC
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
          sum(pos) OVER (PARTITION BY {g} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
          sum(neg) OVER (PARTITION BY {g} ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
          sum(pos) OVER (PARTITION BY {g}) AS P,
          sum(neg) OVER (PARTITION BY {g}) AS N
        FROM d),
      r AS (SELECT *, tp::DOUBLE / nullif(P, 0) AS recall, tp::DOUBLE / (tp + fp) AS prec FROM c),
      l AS (SELECT *, coalesce(lag(recall) OVER (PARTITION BY {g} ORDER BY s DESC), 0) AS recall0,
                   coalesce(lag(prec) OVER (PARTITION BY {g} ORDER BY s DESC), 1) AS prec0 FROM r)
      SELECT {g},
        CASE WHEN max(P) > 0 AND max(N) > 0 THEN
          (sum(pos * (below + (pos + neg + 1) / 2.0)) - max(P) * (max(P) + 1) / 2.0) / (max(P) * max(N)) END AS roc_auc,
        sum((recall - recall0) * prec) AS average_precision,
        sum((recall - recall0) * (prec + prec0) / 2.0) AS pr_auc_trapezoid
      FROM l GROUP BY {g}
    """


def unshuffled_folds_sql(src: str, label: str, row_id: str, n: int, order: str | None = None) -> str:
    """CTE body list producing ``folded`` = src + fold (stratified, classes in
    order of first appearance, quotas from round-robin dealing)."""
    order = order or row_id
    return f"""
    cls AS (SELECT {label}, count(*) AS cnt, min({row_id}) AS first_id FROM {src} GROUP BY {label}),
    cls2 AS (SELECT {label}, cnt, coalesce(sum(cnt) OVER (ORDER BY first_id, {label}
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM cls),
    qq AS (SELECT {label}, ff.fold::INTEGER AS fold,
             floor((st + cnt - 1 - ff.fold) / {n}) - floor((st - 1 - ff.fold) / {n}) AS quota
           FROM cls2, (SELECT unnest(range({n})) AS fold) ff),
    qq2 AS (SELECT {label}, fold,
              sum(quota) OVER (PARTITION BY {label} ORDER BY fold) - quota AS lo,
              sum(quota) OVER (PARTITION BY {label} ORDER BY fold) AS hi FROM qq),
    rr AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {order}, {row_id}) - 1 AS rn FROM {src}),
    folded AS (SELECT rr.* EXCLUDE (rn), qq2.fold FROM rr JOIN qq2
               ON rr.{label} = qq2.{label} AND rr.rn >= qq2.lo AND rr.rn < qq2.hi)
    """


EMB = """emb AS (SELECT vec_id, CAST(label < 5 AS INTEGER) AS y, label, embedding,
                    CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
                    vec_id // 5 AS sample_id, CAST(vec_id % 5 AS INTEGER) AS variant
             FROM embeddings)"""

EMB_LONG = """emb_long AS (SELECT vec_id, y, label, split, sample_id, variant,
                    CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
                    unnest(embedding)::DOUBLE AS x FROM emb)"""


ORACLE["centroid_cv_report"] = f"""
WITH {EMB},
src AS (SELECT vec_id, y, embedding FROM emb),
{unshuffled_folds_sql('src', 'y', 'vec_id', 3)},
lng AS (SELECT vec_id, y, fold, generate_subscripts(embedding, 1) - 1 AS dim,
               unnest(embedding)::DOUBLE AS x FROM folded),
fs AS (SELECT unnest(range(3))::INTEGER AS f),
st AS (SELECT fs.f, l.dim, avg(l.x) AS mu,
              CASE WHEN stddev_pop(l.x) = 0 THEN 1 ELSE stddev_pop(l.x) END AS sd
       FROM lng l JOIN fs ON l.fold <> fs.f GROUP BY fs.f, l.dim),
ce AS (SELECT fs.f, l.y, l.dim, avg(l.x) AS cx FROM lng l JOIN fs ON l.fold <> fs.f GROUP BY fs.f, l.y, l.dim),
zc AS (SELECT ce.f, ce.y, ce.dim, (ce.cx - st.mu) / st.sd AS c FROM ce JOIN st ON ce.f = st.f AND ce.dim = st.dim),
z AS (SELECT l.vec_id, l.y, l.fold, l.dim, (l.x - st.mu) / st.sd AS z FROM lng l JOIN st ON st.f = l.fold AND st.dim = l.dim),
sc AS (SELECT z.vec_id, z.y, z.fold,
              sum((z.z - cn.c) * (z.z - cn.c)) - sum((z.z - cp.c) * (z.z - cp.c)) AS logit
       FROM z JOIN zc cn ON cn.f = z.fold AND cn.dim = z.dim AND cn.y = 0
              JOIN zc cp ON cp.f = z.fold AND cp.dim = z.dim AND cp.y = 1
       GROUP BY z.vec_id, z.y, z.fold),
scored AS (SELECT vec_id, y, fold, 1.0 / (1.0 + exp(-logit)) AS p FROM sc),
{report7_sql('scored', 'fold')}
"""


# ---------------------------------------------------------------------------
# sequences
# ---------------------------------------------------------------------------

# Fixed values, identical to ligandspark.functions.sequences.
SMILES_RE = r"(\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|\%[0-9]{2}|[0-9])"
VOCAB_SQL = ("['[PAD]', '[GLO]', 'c', 'C', '(', ')', 'O', '1', '2', '=', 'N', '3', 'n', '4', '[C@H]', 'F', "
             "'[C@@H]', '-', 'S', '/', 'Cl', '[nH]', 's', 'o', '5', '#', '[C@]', '[C@@]', '\\', '[O-]', "
             "'[N+]', 'Br', '6', 'P', '[n+]', '7', 'I', '[S+]', '8', '[N-]', '[Si]', 'B', '9', '[2H]', "
             "'[Se]', '[other_atom]', '[other_token]']")
ATOMS_SQL = ("['c', 'C', 'O', 'N', 'n', '[C@H]', 'F', '[C@@H]', 'S', 'Cl', '[nH]', 's', 'o', '[C@]', "
             "'[C@@]', '[O-]', '[N+]', 'Br', 'P', '[n+]', 'I', '[S+]', '[N-]', '[Si]', 'B', '[Se]', "
             "'[other_atom]']")


def _tok(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{SMILES_RE}', 1)"


CUT = f"""CASE WHEN len({_tok('text')}) > 200
          THEN substring(text, CAST(floor((length(text) - 200) / 2) AS BIGINT) + 1, 200) ELSE text END"""

ORACLE["smiles_tokens"] = f"""
WITH t AS (SELECT doc_id, text, {_tok('text')} AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens,
  CAST(length(text) - coalesce(list_sum(list_transform(tok, lambda x: length(x))), 0) AS BIGINT) AS dropped_chars,
  md5(array_to_string(tok, ' ')) AS tokens_md5
FROM t
"""

ORACLE["smiles_cut"] = f"""
WITH t AS (SELECT doc_id, text, {_tok('text')} AS tok, {CUT} AS cut FROM documents)
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_tokens, len(tok) <= 200 AS fits,
  CAST(length(cut) AS BIGINT) AS cut_len, CAST(len({_tok('cut')}) AS BIGINT) AS cut_n_tokens,
  md5(cut) AS cut_md5
FROM t
"""

ENCODED = f"""
t0 AS (SELECT doc_id, text, {_tok('text')} AS tok, {_tok(CUT)} AS ctok FROM documents),
t1 AS (SELECT doc_id, tok, ctok,
          list_concat(['[GLO]'], ctok, list_transform(range(greatest(200 - len(ctok), 0)), lambda x: '[PAD]')) AS pseq,
          list_concat(['[GLO]'], tok, list_transform(range(greatest(200 - len(tok), 0)), lambda x: '[PAD]')) AS praw
       FROM t0),
t2 AS (SELECT doc_id, tok, praw,
          list_transform(pseq, lambda x: CASE WHEN list_contains({VOCAB_SQL}, x) THEN x
                                          WHEN contains(x, '[') THEN '[other_atom]'
                                          ELSE '[other_token]' END) AS seq
       FROM t1),
enc AS (SELECT doc_id, tok, praw, seq,
          CASE WHEN len(seq) = 201 THEN list_transform(seq, lambda x: CAST(list_position({VOCAB_SQL}, x) - 1 AS INTEGER)) END AS ids,
          list_transform(seq, lambda x: CASE WHEN list_contains({ATOMS_SQL}, x) THEN 1 ELSE 0 END) AS mask
        FROM t2)
"""

ORACLE["smiles_encode"] = f"""
WITH {ENCODED}
SELECT doc_id, len(praw) = 201 AS valid_raw, ids IS NOT NULL AS valid,
  CAST(list_sum(mask) AS BIGINT) AS n_atoms,
  CAST(len(list_filter(seq, lambda x: x = '[other_atom]')) AS BIGINT) AS n_other_atom,
  CAST(len(list_filter(seq, lambda x: x = '[other_token]')) AS BIGINT) AS n_other_token,
  md5(array_to_string(ids, ',')) AS ids_md5
FROM enc
"""

ORACLE["atom_positions"] = f"""
WITH {ENCODED},
x AS (SELECT doc_id, ids, unnest(mask) AS m, generate_subscripts(mask, 1) AS i FROM enc)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS atom_pos, CAST(ids[i] AS INTEGER) AS token_id FROM x WHERE m = 1
"""

ORACLE["protein_prepare"] = """
WITH s AS (SELECT doc_id, array_to_string(string_split(regexp_replace(text, '[UZOB]', 'X', 'g'), ''), ' ') AS sp
           FROM documents),
p AS (SELECT doc_id, CASE WHEN upper(sp) = sp AND lower(sp) <> sp THEN '<AA2fold>' ELSE '<fold2AA>' END
                     || ' ' || sp AS prep FROM s)
SELECT doc_id, split_part(prep, ' ', 1) AS prefix, CAST(length(prep) AS BIGINT) AS prepared_len,
       md5(prep) AS prepared_md5 FROM p
"""

ORACLE["batch_padding"] = """
WITH s AS (SELECT doc_id, CAST(length(text) + 2 AS BIGINT) AS seq_len, CAST(doc_id // 8 AS BIGINT) AS batch_id
           FROM documents)
SELECT doc_id, batch_id, seq_len, max(seq_len) OVER (PARTITION BY batch_id) AS padded_len,
       max(seq_len) OVER (PARTITION BY batch_id) - seq_len AS n_pad FROM s
"""

_BUCKET = "CAST(('0x' || substr(md5(g), 1, 8))::BIGINT % 64 AS INTEGER)"
ORACLE["embed_hashed"] = f"""
WITH t AS (SELECT doc_id, {_tok('text')} AS tok FROM documents),
grams AS (SELECT doc_id, unnest(list_concat(tok,
            list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS g
          FROM t WHERE len(tok) > 0)
SELECT doc_id, {_BUCKET} AS dim, count(*) AS cnt FROM grams GROUP BY doc_id, {_BUCKET}
"""

# every document, and a row of its non-SMILES signs
SPLIT_DOCS = """sd AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents
    UNION ALL SELECT -1 - doc_id, replace(regexp_replace(text, '[^ \\-,;_]', '', 'g'), '-', ''),
      CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END FROM documents)"""

ORACLE["embed_quarantine_counts"] = f"""
WITH {SPLIT_DOCS}, t AS (SELECT split, len({_tok('text')}) AS n FROM sd)
SELECT split, count(*) FILTER (WHERE n > 0) AS n_ok, count(*) FILTER (WHERE n = 0) AS n_failed FROM t GROUP BY split
"""

ORACLE["featurize_smiles"] = f"""
WITH {SPLIT_DOCS}, t AS (SELECT doc_id, split, {_tok('text')} AS tok FROM sd),
grams AS (SELECT doc_id, unnest(list_concat(tok,
            list_transform(range(1, len(tok)), lambda i: tok[i] || ' ' || tok[i + 1]))) AS g
          FROM t WHERE len(tok) > 0),
c AS (SELECT doc_id, count(*) AS n_grams, count(*) FILTER (WHERE {_BUCKET} = 0) AS first_dim FROM grams GROUP BY doc_id)
SELECT t.doc_id, t.split, c.n_grams, c.first_dim,
       CASE WHEN c.doc_id IS NULL THEN 'no tokens to embed' END AS error
FROM t LEFT JOIN c ON t.doc_id = c.doc_id
"""

ORACLE["embed_callable"] = f"""
WITH {SPLIT_DOCS}, t AS (SELECT doc_id, text, regexp_matches(text, '[A-Za-z]') AS ok FROM sd)
SELECT doc_id, ok, CASE WHEN NOT ok THEN 'ValueError: no letters' END AS error,
  {', '.join(f"CASE WHEN ok THEN CAST(length(text) - length(replace(text, '{c}', '')) AS BIGINT) END AS {c.lower()}" for c in "ACGT")}
FROM t
"""

ORACLE["featurize_protein"] = f"""
WITH {SPLIT_DOCS},
s AS (SELECT split, array_to_string(string_split(regexp_replace(text, '[UZOB]', 'X', 'g'), ''), ' ') AS sp FROM sd),
p AS (SELECT split, CASE WHEN upper(sp) = sp AND lower(sp) <> sp THEN '<AA2fold>' ELSE '<fold2AA>' END
                    || ' ' || sp AS prep FROM s)
SELECT split, count(*) AS n_ok, CAST(0 AS BIGINT) AS n_failed,
       CAST(sum(length(prep) - length(replace(prep, 'A', ''))) AS BIGINT) AS sum_a
FROM p GROUP BY split
"""


# ---------------------------------------------------------------------------
# scored events
# ---------------------------------------------------------------------------

EV = """ev AS (SELECT event_id, user_id, ts, value, CAST(event_type = 'purchase' AS INTEGER) AS y,
           (value - 100.0) / 25.0 AS logit, 1.0 / (1.0 + exp(-((value - 100.0) / 25.0))) AS p,
           CAST(user_id % 5 AS INTEGER) AS fold, 1 AS g0 FROM events)"""

ORACLE["binary_report7"] = f"WITH {EV}, {report7_sql('ev', 'fold')}"
ORACLE["binary_report9"] = f"WITH {EV}, {report9_sql('ev', 'fold')}"
ORACLE["eval_single"] = f"WITH {EV}, {report9_sql('ev', 'g0', emit_group=False)}"
ORACLE["auc_by_group"] = f"WITH {EV}, rk AS ({ranking_sql('ev', 'user_id')}) SELECT user_id, round(roc_auc, 6) AS roc_auc FROM rk"
ORACLE["average_precision"] = f"WITH {EV}, rk AS ({ranking_sql('ev', 'fold')}) SELECT fold, round(average_precision, 6) AS average_precision FROM rk"
ORACLE["pr_trapezoid"] = f"WITH {EV}, rk AS ({ranking_sql('ev', 'fold')}) SELECT fold, round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM rk"
ORACLE["roc_points"] = f"""
WITH {EV},
d AS (SELECT fold, p AS s, sum(y) AS pos, count(*) - sum(y) AS neg FROM ev GROUP BY fold, p),
c AS (SELECT fold, s,
        sum(pos) OVER (PARTITION BY fold ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
        sum(neg) OVER (PARTITION BY fold ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
        sum(pos) OVER (PARTITION BY fold) AS P, sum(neg) OVER (PARTITION BY fold) AS N FROM d)
SELECT fold, round(s, 6) AS threshold,
  round(CASE WHEN N = 0 THEN NULL ELSE fp::DOUBLE / N END, 6) AS fpr,
  round(CASE WHEN P = 0 THEN NULL ELSE tp::DOUBLE / P END, 6) AS tpr
FROM c
"""
ORACLE["fold_mean"] = f"""
WITH {EV}, {report7_sql('ev', 'fold', digits=None)}
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
       round(avg(f1), 6) AS f1, round(avg(specificity), 6) AS specificity, round(avg(roc_auc), 6) AS roc_auc,
       round(avg(pr_auc), 6) AS pr_auc FROM rep
"""

SOFTPLUS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


def _bce(x: str, y: str, w: str = "1.0") -> str:
    return (f"({w} * {y} * {SOFTPLUS.format(x='-(' + x + ')')} + "
            f"(1 - {y}) * {SOFTPLUS.format(x=x)})")


ORACLE["bce_weighted"] = f"""
WITH {EV},
cnt AS (SELECT fold, sum(y) AS np, count(*) - sum(y) AS nn FROM ev GROUP BY fold),
w AS (SELECT fold, (sum(nn) OVER () - nn)::DOUBLE / (sum(np) OVER () - np) AS pos_weight FROM cnt)
SELECT ev.fold, round(max(w.pos_weight), 6) AS pos_weight,
       round(avg({_bce('ev.logit', 'ev.y', 'w.pos_weight')}), 6) AS loss
FROM ev JOIN w ON ev.fold = w.fold GROUP BY ev.fold
"""

# ---------------------------------------------------------------------------
# documents x labels, two tasks
# ---------------------------------------------------------------------------

DT = """dt AS (
  SELECT d.doc_id, 'quality' AS task, l.quality AS y,
         CASE WHEN l.quality IS NOT NULL THEN 1.0 ELSE 0.0 END AS mask,
         ln(1 + d.n_chars::DOUBLE) - 7.5 AS logit
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT d.doc_id, 'toxic' AS task, l.toxic AS y,
         CASE WHEN l.toxic IS NOT NULL THEN 1.0 ELSE 0.0 END AS mask,
         20.0 * length(regexp_replace(d.text, '[^A-Z]', '', 'g'))::DOUBLE / greatest(length(d.text), 1) - 1.5 AS logit
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

ORACLE["multitask_masked"] = f"""
WITH {DT},
m AS (SELECT task, y, 1.0 / (1.0 + exp(-logit)) AS p FROM dt WHERE mask <> 0),
rk AS ({ranking_sql('m', 'task')}),
n AS (SELECT task, count(*) AS n FROM m GROUP BY task)
SELECT rk.task, n.n, round(round(rk.roc_auc, 4), 6) AS roc_auc, round(rk.pr_auc_trapezoid, 6) AS roc_prc
FROM rk JOIN n ON rk.task = n.task
"""
ORACLE["task_mean"] = f"""
WITH {DT},
m AS (SELECT task, y, 1.0 / (1.0 + exp(-logit)) AS p FROM dt WHERE mask <> 0),
rk AS ({ranking_sql('m', 'task')})
SELECT round(avg(round(roc_auc, 4)), 6) AS mean_roc_auc, count(*) AS n_tasks FROM rk
"""
ORACLE["task_class_weights"] = f"""
WITH {DT}
SELECT task, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y = 0) AS n_neg,
       round(count(*) FILTER (WHERE y = 0) / (count(*) FILTER (WHERE y = 1) + 1e-8), 6) AS pos_weight
FROM dt GROUP BY task
"""
ORACLE["masked_cell_loss"] = f"""
WITH {DT}
SELECT count(*) AS n_cells,
       round(avg({_bce('logit', 'coalesce(y, 0)')} * CASE WHEN mask <> 0 THEN 1.0 ELSE 0.0 END), 6) AS loss
FROM dt
"""
ORACLE["batch_loss_total"] = f"""
WITH {DT},
b AS (SELECT doc_id // 32 AS batch,
             avg({_bce('logit', 'coalesce(y, 0)')} * CASE WHEN mask <> 0 THEN 1.0 ELSE 0.0 END) AS loss,
             count(DISTINCT doc_id) AS nrows
      FROM dt GROUP BY doc_id // 32)
SELECT count(*) AS n_batches, CAST(sum(nrows) AS BIGINT) AS n_rows, round(sum(loss * nrows), 6) AS total_loss FROM b
"""

ORACLE["regression_masked"] = """
WITH r AS (SELECT l_returnflag AS task, l_quantity AS y, l_extendedprice / 1000.0 AS pred
           FROM lineitem WHERE l_linestatus = 'F'),
m AS (SELECT task, avg(y) AS my FROM r GROUP BY task)
SELECT r.task, count(*) AS n, CAST(0 AS BIGINT) AS n_dropped,
  round(avg(abs(y - pred)), 6) AS l1_mean, round(sum(abs(y - pred)), 6) AS l1_sum,
  round(avg((y - pred) * (y - pred)), 6) AS mse, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse,
  round(avg(abs(y - pred)), 6) AS mae,
  round(round(1 - sum((y - pred) * (y - pred)) / sum((y - m.my) * (y - m.my)), 4), 6) AS r2
FROM r JOIN m ON r.task = m.task GROUP BY r.task
"""

# ---------------------------------------------------------------------------
# embeddings
# ---------------------------------------------------------------------------

ORACLE["vector_wide"] = ("SELECT vec_id, label, "
                         + ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS f_{i}" for i in range(1, 65))
                         + " FROM embeddings")
ORACLE["vector_from_wide"] = f"""
WITH {EMB}, {EMB_LONG}
SELECT vec_id, dim, round(x, 6) AS value FROM emb_long
"""


def _subset_pairs() -> str:
    import numpy as np
    pos = np.random.RandomState(47).rand(64)
    idx = [i for i, p in enumerate(pos) if p > 0.5]
    return ", ".join(f"({k + 1}, {i})" for k, i in enumerate(idx))


ORACLE["vector_subset"] = f"""
WITH sel(new_dim, src_dim) AS (VALUES {_subset_pairs()})
SELECT e.vec_id, CAST(sel.new_dim AS INTEGER) AS new_dim, CAST(sel.src_dim AS INTEGER) AS src_dim,
       round(e.embedding[sel.src_dim + 1]::DOUBLE, 6) AS value
FROM embeddings e, sel
"""

ORACLE["standardize_train_fit"] = f"""
WITH {EMB}, {EMB_LONG},
st AS (SELECT dim, avg(x) AS mu, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd
       FROM emb_long WHERE split = 'train' GROUP BY dim)
SELECT l.vec_id, l.split, l.dim, round((l.x - st.mu) / st.sd, 6) AS z FROM emb_long l JOIN st ON l.dim = st.dim
"""

ORACLE["stratified_folds"] = f"""
WITH src AS (SELECT vec_id, label FROM embeddings), {unshuffled_folds_sql('src', 'label', 'vec_id', 3)}
SELECT vec_id, label, fold FROM folded
"""
SEEDED = "('0x' || substr(md5('47-' || CAST(vec_id AS VARCHAR)), 1, 15))::BIGINT"
ORACLE["stratified_folds_seeded"] = f"""
WITH src AS (SELECT vec_id, label FROM embeddings), {unshuffled_folds_sql('src', 'label', 'vec_id', 5, SEEDED)}
SELECT vec_id, label, fold FROM folded
"""
ORACLE["class_weights"] = f"""
WITH {EMB}, src AS (SELECT vec_id, y FROM emb), {unshuffled_folds_sql('src', 'y', 'vec_id', 5, SEEDED)},
cnt AS (SELECT fold, sum(y) AS np, count(*) - sum(y) AS nn FROM folded GROUP BY fold)
SELECT fold, CAST(sum(np) OVER () - np AS BIGINT) AS n_pos, CAST(sum(nn) OVER () - nn AS BIGINT) AS n_neg,
       round((sum(nn) OVER () - nn)::DOUBLE / (sum(np) OVER () - np), 6) AS pos_weight FROM cnt
"""

EMB_LOGIT = f"""{EMB},
el AS (SELECT *, 4.0 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS logit,
  CASE WHEN variant <> 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM emb)"""

ORACLE["tta_ensemble"] = f"""
WITH {EMB_LOGIT}
SELECT sample_id, round(avg(logit), 6) AS logit, round(avg(y::DOUBLE), 6) AS mean_y, round(avg(mask), 6) AS mean_mask,
       count(*) AS n_copies, round(1.0 / (1.0 + exp(-avg(logit))), 6) AS p
FROM el GROUP BY sample_id
"""
VARIANT_ENS = """ve AS (SELECT sample_id, avg(logit) AS logit, max(CASE WHEN variant = 0 THEN y END) AS y,
                  count(*) AS n_variants, 1.0 / (1.0 + exp(-avg(logit))) AS p, 1 AS g0
           FROM el GROUP BY sample_id)"""
ORACLE["variant_ensemble"] = f"""
WITH {EMB_LOGIT}, {VARIANT_ENS}
SELECT sample_id, round(logit, 6) AS logit, y, n_variants, round(p, 6) AS p FROM ve
"""
ORACLE["eval_variants_report"] = f"WITH {EMB_LOGIT}, {VARIANT_ENS}, {report9_sql('ve', 'g0', emit_group=False)}"
ORACLE["eval_augmented"] = f"""
WITH {EMB_LOGIT},
te AS (SELECT sample_id, 1.0 / (1.0 + exp(-avg(logit))) AS p, CAST(avg(y::DOUBLE) >= 0.5 AS INTEGER) AS y, 1 AS g0
       FROM el GROUP BY sample_id),
{report9_sql('te', 'g0', emit_group=False)}
"""

COS = """cs AS (
  SELECT v.sample_id, v.variant,
    list_sum(list_transform(list_zip(c.embedding, v.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE))
    / (sqrt(list_sum(list_transform(c.embedding, lambda x: x::DOUBLE * x::DOUBLE)))
       * sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS cos
  FROM emb v JOIN emb c ON c.sample_id = v.sample_id AND c.variant = 0 AND v.variant <> 0),
vc AS (SELECT sample_id, (count(*) - sum(cos)) / (2.0 * count(*)) AS consensus,
              1 - 2 * (count(*) - sum(cos)) / (2.0 * count(*)) AS cos_similarity FROM cs GROUP BY sample_id)"""
ORACLE["variant_consensus"] = f"""
WITH {EMB}, {COS}
SELECT sample_id, round(consensus, 6) AS consensus, round(cos_similarity, 6) AS cos_similarity FROM vc
"""
ORACLE["eval_variants"] = f"""
WITH {EMB_LOGIT}, {VARIANT_ENS}, {COS}
SELECT CAST(ve.sample_id AS VARCHAR) AS smiles, round(ve.p, 6) AS prediction, ve.y AS label,
       round(vc.cos_similarity, 6) AS cos_similarity
FROM ve JOIN vc ON ve.sample_id = vc.sample_id
"""
ORACLE["batch_diversity"] = f"""
WITH {EMB}, b AS (SELECT vec_id, vec_id // 32 AS batch, embedding FROM emb),
pr AS (SELECT a.batch,
         abs(list_sum(list_transform(list_zip(a.embedding, c.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE))
         / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)))
            * sqrt(list_sum(list_transform(c.embedding, lambda x: x::DOUBLE * x::DOUBLE))))) AS ac
       FROM b a JOIN b c ON a.batch = c.batch AND a.vec_id < c.vec_id),
n AS (SELECT batch, count(*) AS batch_rows FROM b GROUP BY batch)
SELECT n.batch, n.batch_rows, round(2.0 * coalesce(sum(pr.ac), 0) / (n.batch_rows * n.batch_rows), 6) AS diversity
FROM n LEFT JOIN pr ON n.batch = pr.batch GROUP BY n.batch, n.batch_rows
"""
ORACLE["mean_pool"] = f"""
WITH {EMB}, {EMB_LONG}
SELECT sample_id, dim, round(avg(x), 6) AS value FROM emb_long WHERE variant > 0 GROUP BY sample_id, dim
"""
ORACLE["first_pool"] = f"""
WITH {EMB}, {EMB_LONG},
a AS (SELECT sample_id, count(*) FILTER (WHERE y = 1 AND variant > 0) AS n_atoms FROM emb GROUP BY sample_id)
SELECT l.sample_id, l.dim, a.n_atoms, round(l.x, 6) AS value
FROM emb_long l JOIN a ON l.sample_id = a.sample_id WHERE l.variant = 0
"""
ORACLE["adaptive_pool"] = f"""
WITH {EMB}, {EMB_LONG},
bins AS (SELECT unnest(range(10)) AS bin),
bb AS (SELECT bin, CAST(floor(bin * 64 / 10.0) AS INTEGER) AS lo, CAST(ceil((bin + 1) * 64 / 10.0) AS INTEGER) AS hi FROM bins)
SELECT l.vec_id, CAST(bb.bin AS INTEGER) AS bin, round(avg(l.x), 6) AS value
FROM emb_long l JOIN bb ON l.dim >= bb.lo AND l.dim < bb.hi GROUP BY l.vec_id, bb.bin
"""

ORACLE["csv_split_roundtrip"] = ("SELECT CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, vec_id, label, "
                                 + ", ".join(f"round(embedding[{i}]::DOUBLE, 6) AS f_{i}" for i in range(1, 65))
                                 + " FROM embeddings")

BLOCKS = """
db AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
              [p_size::DOUBLE, p_retailprice] AS f FROM part),
tb AS (SELECT l_partkey AS row_id, CASE WHEN l_partkey % 5 = 0 THEN 'test' ELSE 'train' END AS split,
              [avg(l_quantity), avg(l_discount)] AS f FROM lineitem GROUP BY l_partkey)"""


def _std_block(name: str) -> str:
    return f"""
{name}l AS (SELECT row_id, split, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS dim, unnest(f) AS x FROM {name}),
{name}s AS (SELECT dim, avg(x) AS mu, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd
            FROM {name}l WHERE split = 'train' GROUP BY dim),
{name}z AS (SELECT l.row_id, l.split, l.dim, (l.x - s.mu) / s.sd AS z FROM {name}l l JOIN {name}s s ON l.dim = s.dim)"""


ORACLE["feature_blocks_join"] = f"""
WITH {BLOCKS}, {_std_block('db')}, {_std_block('tb')}
SELECT row_id, split, dim, round(z, 6) AS value FROM dbz WHERE row_id IN (SELECT row_id FROM tb)
UNION ALL
SELECT row_id, split, CAST(dim + 2 AS INTEGER) AS dim, round(z, 6) AS value FROM tbz WHERE row_id IN (SELECT row_id FROM db)
"""
ORACLE["feature_blocks_unmatched"] = """
SELECT p_partkey AS row_id, 'left_only' AS side FROM part WHERE p_partkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL
SELECT o_orderkey AS row_id, 'right_only' AS side FROM orders WHERE o_orderkey NOT IN (SELECT p_partkey FROM part)
"""
ORACLE["star_lookup"] = """
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey AS drug_id, l.l_suppkey AS target_id,
       CAST(l.l_returnflag = 'R' AS INTEGER) AS label,
       round(p.p_size::DOUBLE, 6) AS x_1, round(p.p_retailprice, 6) AS x_2,
       round(s.s_nationkey::DOUBLE, 6) AS x_3, round(s.s_acctbal, 6) AS x_4
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
"""

HIST = """h AS (SELECT user_id AS run, event_id, value AS score,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM events)"""
ORACLE["running_best"] = f"""
WITH {HIST}
SELECT run, epoch, round(score, 6) AS score,
       round(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_best
FROM h
"""
ORACLE["best_epoch"] = f"""
WITH {HIST},
r AS (SELECT run, epoch, score, row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) AS k FROM h)
SELECT run, epoch AS best_epoch, round(score, 6) AS best_score FROM r WHERE k = 1
"""
ORACLE["early_stop"] = f"""
WITH {HIST},
a AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM h),
b AS (SELECT *, CASE WHEN prev IS NULL OR score > prev THEN epoch END AS imp FROM a),
c AS (SELECT *, max(imp) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp,
             greatest(coalesce(prev, score), score) AS best FROM b),
s AS (SELECT run, min(epoch) AS stop_epoch FROM c WHERE epoch - last_imp >= 5 GROUP BY run),
g AS (SELECT run, count(*) AS n_epochs, max(imp) AS last_all, max(score) AS max_all FROM c GROUP BY run)
SELECT g.run, g.n_epochs, s.stop_epoch,
       CASE WHEN s.stop_epoch IS NULL THEN g.last_all ELSE c.last_imp END AS best_epoch,
       round(CASE WHEN s.stop_epoch IS NULL THEN g.max_all ELSE c.best END, 6) AS best_score
FROM g LEFT JOIN s ON g.run = s.run LEFT JOIN c ON c.run = s.run AND c.epoch = s.stop_epoch
"""

# ---------------------------------------------------------------------------
# kNN
# ---------------------------------------------------------------------------

KNN_FOLDED = f"""src AS (SELECT vec_id, label, embedding FROM embeddings),
{unshuffled_folds_sql('src', 'label', 'vec_id', 3)}"""

SQD = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: (t[1]::DOUBLE - t[2]::DOUBLE) * (t[1]::DOUBLE - t[2]::DOUBLE)))"

ORACLE["knn_vote"] = f"""
WITH {KNN_FOLDED},
pr AS (SELECT a.vec_id AS qid, a.fold, a.label AS qlabel, b.vec_id AS rid, b.label AS rlabel, round({SQD}, 9) AS d
       FROM folded a JOIN folded b ON a.fold <> b.fold),
tk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rn FROM pr),
vt AS (SELECT qid, fold, qlabel, rlabel, count(*) AS c FROM tk WHERE rn <= 3 GROUP BY qid, fold, qlabel, rlabel),
pk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, rlabel) AS k FROM vt)
SELECT qid AS vec_id, fold, rlabel AS pred, CAST(rlabel = qlabel AS INTEGER) AS hit FROM pk WHERE k = 1
"""


def _cand_dims() -> str:
    import numpy as np
    pos = np.vstack([np.random.RandomState(11).rand(4, 64), np.zeros((1, 64))])
    rows = [f"({c}, {d})" for c in range(pos.shape[0]) for d in range(64) if pos[c, d] > 0.5]
    return ", ".join(rows)


ORACLE["subset_cost"] = f"""
WITH {KNN_FOLDED},
cd(cand, dim) AS (VALUES {_cand_dims()}),
cands AS (SELECT unnest(range(5))::INTEGER AS cand),
ns AS (SELECT c.cand, CAST(count(cd.dim) AS INTEGER) AS n_selected FROM cands c LEFT JOIN cd ON c.cand = cd.cand GROUP BY c.cand),
lg AS (SELECT vec_id, fold, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM folded),
pd AS (SELECT a.vec_id AS qid, b.vec_id AS rid, a.dim, (a.x - b.x) * (a.x - b.x) AS sq
       FROM lg a JOIN lg b ON a.dim = b.dim AND a.fold <> b.fold),
dd AS (SELECT cd.cand, pd.qid, pd.rid, round(sum(pd.sq), 9) AS d FROM pd JOIN cd ON pd.dim = cd.dim
       GROUP BY cd.cand, pd.qid, pd.rid),
tk AS (SELECT dd.*, f.label AS rlabel, row_number() OVER (PARTITION BY cand, qid ORDER BY d, rid) AS rn
       FROM dd JOIN folded f ON f.vec_id = dd.rid),
vt AS (SELECT cand, qid, rlabel, count(*) AS c FROM tk WHERE rn <= 3 GROUP BY cand, qid, rlabel),
pk AS (SELECT *, row_number() OVER (PARTITION BY cand, qid ORDER BY c DESC, rlabel) AS k FROM vt),
hit AS (SELECT pk.cand, f.fold, CAST(pk.rlabel = f.label AS DOUBLE) AS h FROM pk JOIN folded f ON f.vec_id = pk.qid WHERE k = 1),
acc AS (SELECT cand, avg(a) AS accuracy FROM (SELECT cand, fold, avg(h) AS a FROM hit GROUP BY cand, fold) GROUP BY cand)
SELECT ns.cand, ns.n_selected, round(acc.accuracy, 6) AS accuracy,
       round(CASE WHEN ns.n_selected = 0 THEN 1.0 ELSE 1 - acc.accuracy + 0.005 * ns.n_selected / 64.0 END, 6) AS cost
FROM ns LEFT JOIN acc ON ns.cand = acc.cand
"""

COSX = """list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda t: t[1]::DOUBLE * t[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)))
     * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"""
ORACLE["cosine_pairs"] = f"""
WITH pr AS (SELECT a.vec_id, b.vec_id AS neighbor_id, {COSX} AS cos FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
tk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cos, 9) DESC, neighbor_id) AS rank FROM pr)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(cos, 6) AS cos FROM tk WHERE rank <= 5
"""

# ---------------------------------------------------------------------------
# wavelets
# ---------------------------------------------------------------------------

import math as _m  # noqa: E402

_MH = 2.0 / (_m.sqrt(3.0) * _m.pi ** 0.25)


def _psi(name: str, z: str, n: str = "0", N: str = "64") -> str:
    if name == "mexican_hat":
        return f"({_MH!r} * (({z}) * ({z}) - 1) * exp(-0.5 * ({z}) * ({z})))"
    if name == "morlet":
        return f"(cos(5.0 * ({z})) * exp(-0.5 * ({z}) * ({z})))"
    if name == "dog":
        return f"(-({z}) * exp(-0.5 * ({z}) * ({z})))"
    if name == "meyer":
        v = f"abs({z})"
        t = f"(2 * {v} - 1)"
        nu = f"({t} * {t} * {t} * {t} * (35 - 84 * {t} + 70 * {t} * {t} - 20 * {t} * {t} * {t}))"
        return (f"(sin(pi() * {v}) * CASE WHEN {v} <= 0.5 THEN 1.0 WHEN {v} >= 1.0 THEN 0.0 "
                f"ELSE cos(pi() / 2 * {nu}) END)")
    if name == "shannon":
        win = f"(CASE WHEN {N} = 1 THEN 1.0 ELSE 0.54 - 0.46 * cos(2 * pi() * {n} / ({N} - 1)) END)"
        return f"((CASE WHEN ({z}) = 0 THEN 1.0 ELSE sin({z}) / ({z}) END) * {win})"
    raise ValueError(name)


ORACLE["wavelet_values"] = f"""
WITH {EMB}, {EMB_LONG}
SELECT vec_id, dim, round({_psi('mexican_hat', 'x')}, 6) AS mexican_hat, round({_psi('morlet', 'x')}, 6) AS morlet,
       round({_psi('dog', 'x')}, 6) AS dog, round({_psi('meyer', 'x')}, 6) AS meyer,
       round({_psi('shannon', 'x', 'dim', '64')}, 6) AS shannon
FROM emb_long
"""


def _layer_sql(name: str, src: str, layer, wavelet: str, n_in: int) -> str:
    """CTEs: {name}_p params, {name}_o pre-activations, {name} normalized (vec_id, j, v)."""
    out, inn = layer.weights.shape
    vals = ", ".join(f"({j}, {i}, {float(layer.weights[j, i])!r}, {float(layer.scale[j, i])!r}, "
                     f"{float(layer.translation[j, i])!r})"
                     for j in range(out) for i in range(inn))
    z = "((x.v - p.t) / p.s)"
    return f"""
{name}_p(j, i, w, s, t) AS (VALUES {vals}),
{name}_o AS (SELECT x.vec_id, p.j, sum(p.w * {_psi(wavelet, z, 'p.i', str(n_in))}) AS o
             FROM {src} x JOIN {name}_p p ON x.i = p.i GROUP BY x.vec_id, p.j),
{name}_st AS (SELECT j, avg(o) AS mu, var_pop(o) AS s2 FROM {name}_o GROUP BY j),
{name} AS (SELECT o.vec_id, o.j AS i, (o.o - st.mu) / sqrt(st.s2 + 1e-5) AS v
           FROM {name}_o o JOIN {name}_st st ON o.j = st.j)"""


def _layers():
    import numpy as np

    def init(n_in, n_out, seed):
        rng = np.random.RandomState(seed)
        b = 1.0 / np.sqrt(n_in)
        w = rng.uniform(-b, b, (n_out, n_in))
        s = rng.uniform(0.5, 1.5, (n_out, n_in))
        t = rng.uniform(-0.1, 0.1, (n_out, n_in))

        class L:
            pass
        lay = L()
        lay.weights, lay.scale, lay.translation = w, s, t
        return lay
    return init(64, 8, 7), init(8, 4, 8)


_L1, _L2 = _layers()
X0 = f"""{EMB}, {EMB_LONG}, x0 AS (SELECT vec_id, dim AS i, x AS v FROM emb_long)"""
ORACLE["wavelet_layer"] = f"""
WITH {X0}, {_layer_sql('l1', 'x0', _L1, 'mexican_hat', 64)}
SELECT vec_id, CAST(i AS INTEGER) AS j, round(v, 6) AS value FROM l1
"""
ORACLE["wavelet_stack"] = f"""
WITH {X0}, {_layer_sql('l1', 'x0', _L1, 'mexican_hat', 64)}, {_layer_sql('l2', 'l1', _L2, 'dog', 8)}
SELECT vec_id, CAST(i AS INTEGER) AS j, round(v, 6) AS value FROM l2
"""

ORACLE["streaming_meter"] = f"""
WITH {EV}, rk AS ({ranking_sql('ev', 'fold')})
SELECT CAST(fold AS VARCHAR) AS task, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision,
       round(pr_auc_trapezoid, 6) AS pr_auc_trapezoid FROM rk
"""


# ---------------------------------------------------------------------------
# roundtrips, label attach, metric dispatch, clip, saved models
# ---------------------------------------------------------------------------

ORACLE["star_csv_scan"] = """
WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS id, p_size::DOUBLE AS d_1, p_retailprice AS d_2 FROM part),
s AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS id, s_nationkey::DOUBLE AS t_1, s_acctbal AS t_2 FROM supplier)
SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, CAST(l_returnflag = 'R' AS INTEGER) AS label,
  count(*) AS n, round(sum(d_1), 2) AS x_1, round(sum(d_2), 2) AS x_2, round(sum(t_1), 2) AS x_3, round(sum(t_2), 2) AS x_4
FROM lineitem JOIN p ON l_partkey = p.id JOIN s ON l_suppkey = s.id GROUP BY 1, 2
"""
ORACLE["numbered_scan"] = f"""
WITH {EMB}, {EMB_LONG}
SELECT label, dim, count(*) AS n, round(sum(x), 6) AS total FROM emb_long GROUP BY label, dim
"""
ORACLE["selection_sinks"] = f"""
WITH sel(new_dim, src_dim) AS (VALUES {_subset_pairs()})
SELECT e.vec_id, CASE WHEN e.vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CAST(sel.new_dim AS INTEGER) AS new_dim,
       round(e.embedding[sel.src_dim + 1]::DOUBLE, 6) AS value
FROM embeddings e, sel
"""
ORACLE["prediction_sink"] = ORACLE["eval_variants"]
ORACLE["metric_report_sink"] = f"""
WITH {EV}, rep7 AS (WITH {report7_sql('ev', 'fold')})
SELECT fold, {', '.join(f"round({m}, 3) AS {m}" for m in
                        ("accuracy", "precision", "recall", "f1", "specificity", "roc_auc", "pr_auc"))} FROM rep7
"""
ORACLE["labelled_blocks"] = f"""
WITH {BLOCKS}, {_std_block('db')}, {_std_block('tb')},
j AS (SELECT row_id, split, dim + 1 AS k, z FROM dbz WHERE row_id IN (SELECT row_id FROM tb)
      UNION ALL SELECT row_id, split, dim + 3 AS k, z FROM tbz WHERE row_id IN (SELECT row_id FROM db))
SELECT j.split, CAST(ends_with(p.p_brand, '1') AS INTEGER) AS label, count(DISTINCT j.row_id) AS n,
  {', '.join(f"round(avg(z) FILTER (WHERE k = {i}), 6) AS mean_{i}" for i in range(1, 5))}
FROM j JOIN part p ON j.row_id = p.p_partkey GROUP BY 1, 2
"""
ORACLE["metric_dispatch"] = f"""
WITH {DT},
m AS (SELECT task, y::DOUBLE AS y, logit, 1.0 / (1.0 + exp(-logit)) AS p FROM dt WHERE mask <> 0),
rk AS ({ranking_sql('m', 'task')}),
g AS (SELECT task, avg(abs(y - logit)) AS l1, avg((y - logit) * (y - logit)) AS mse,
        sum((y - logit) * (y - logit)) AS sse, sum(y * logit) AS yp, var_pop(y) * count(*) AS sst FROM m GROUP BY task),
a AS (SELECT g.task, round(rk.roc_auc, 4) AS roc_auc, l1, sqrt(mse) AS rmse, mse AS mae, mse, rk.pr_auc_trapezoid AS roc_prc,
        CASE WHEN sst > 0 THEN round(1 - sse / sst, 4) END AS r2, yp AS return_pred_true
      FROM g JOIN rk ON g.task = rk.task)
{' UNION ALL '.join(f"SELECT task, '{m}' AS metric, round({m}, 6) AS value FROM a" for m in
                    ("roc_auc", "l1", "rmse", "mae", "mse", "roc_prc", "r2", "return_pred_true"))}
"""
ORACLE["clipped_values"] = f"""
WITH {EMB}, {EMB_LONG} SELECT vec_id, dim, round(greatest(least(x, 0.1), -0.1), 6) AS value FROM emb_long
"""
ORACLE["saved_models_test"] = f"""
WITH {EMB}, {EMB_LONG},
fm AS (SELECT unnest(range(3))::INTEGER AS fold),
sc AS (SELECT fold, vec_id, any_value(y) AS y,
         sum(x * (((fold + 1) * (dim + 1) % 7 - 3) / 2.0)) + 0.1 * fold AS logit
       FROM emb_long, fm WHERE split = 'test' GROUP BY fold, vec_id),
s AS (SELECT fold, y, 1.0 / (1.0 + exp(-logit)) AS p FROM sc), {report7_sql('s', 'fold')}
"""

# ---------------------------------------------------------------------------
# objective, threshold cosine, malformed CSV rows, fixed models
# ---------------------------------------------------------------------------

ORACLE["subset_objective"] = f"""
WITH c AS ({ORACLE['subset_cost']})
SELECT 1::INTEGER AS generation, cand, cost FROM c WHERE cand < 3
UNION ALL SELECT 2::INTEGER AS generation, cand, cost FROM c WHERE cand >= 1
"""
ORACLE["cosine_threshold"] = f"""
WITH c AS (SELECT min(vec_id) AS id, embedding, count(*) AS n FROM embeddings GROUP BY embedding),
p AS (SELECT a.id AS a, b.id AS b, {COSX} AS cos, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.id < b.id)
SELECT a, b, round(cos, 6) AS cos, n_a, n_b FROM p WHERE round(cos, 9) >= 0.25
"""
ORACLE["csv_quarantine"] = """
SELECT 'good' AS kind, count(*) AS n, round(sum(round(value, 3)), 2) AS total, sum(event_id)::BIGINT AS ids FROM events
UNION ALL SELECT CASE WHEN event_type = 'purchase' THEN 'no number' ELSE 'missing field' END, count(*), NULL, NULL
FROM events GROUP BY 1
"""
ORACLE["fixed_model_scores"] = f"""
WITH {EMB}, {EMB_LONG},
s AS (SELECT vec_id, sum(x * ((2 * (dim + 1) % 7 - 3) / 2.0)) + 0.1 AS logit FROM emb_long GROUP BY vec_id)
SELECT vec_id, round(logit, 6) AS logit, round(1.0 / (1.0 + exp(-logit)), 6) AS p FROM s
"""
# rows of the three unshuffled folds with y, their features, and the fixed model of each fold
FIXED_FOLDS = f"""{KNN_FOLDED},
fl AS (SELECT vec_id, fold, CAST(label < 5 AS INTEGER) AS y, generate_subscripts(embedding, 1) - 1 AS dim,
         unnest(embedding)::DOUBLE AS x FROM folded),
fm AS (SELECT unnest(range(3))::INTEGER AS model),
sc AS (SELECT model, vec_id, any_value(fold) AS fold, any_value(y) AS y,
         sum(x * (((model + 1) * (dim + 1) % 7 - 3) / 2.0)) + 0.1 * model AS logit FROM fl, fm GROUP BY model, vec_id)"""
ORACLE["cv_fixed_models"] = f"""
WITH {FIXED_FOLDS}, s AS (SELECT fold, y, 1.0 / (1.0 + exp(-logit)) AS p FROM sc WHERE model = fold), {report7_sql('s', 'fold')}
"""
ORACLE["fold_loss_gradient"] = f"""
WITH {FIXED_FOLDS},
r AS (SELECT model, vec_id, CASE WHEN y = 1 THEN [2.0, 0.5, 1.25][model + 1] ELSE 1.0 END AS w, y, logit,
        1.0 / (1.0 + exp(-logit)) AS p FROM sc WHERE model <> fold),
t AS (SELECT model, round(sum(w * (ln(1.0 + exp(-abs(logit))) + greatest(logit, 0) - y * logit)), 4) AS loss,
        sum(w * (p - y)) AS g FROM r GROUP BY model),
d AS (SELECT r.model, fl.dim, sum(r.w * (r.p - r.y) * fl.x) AS g FROM r JOIN fl ON r.vec_id = fl.vec_id GROUP BY r.model, fl.dim)
SELECT d.model AS fold, CAST(d.dim AS INTEGER) AS dim, t.loss, round(d.g, 4) AS gradient FROM d JOIN t ON d.model = t.model
UNION ALL SELECT model, 64, loss, round(g, 4) FROM t
"""
ORACLE["wavelet_dispatch"] = f"""
WITH {EMB}, {EMB_LONG}
{' UNION ALL '.join(f"SELECT '{n}' AS name, round(sum({_psi(n, 'x', 'dim', '64')}), 4) AS total, NULL::VARCHAR AS error FROM emb_long"
                    for n in ('mexican_hat', 'morlet', 'dog', 'meyer', 'shannon'))}
UNION ALL SELECT 'haar', NULL, 'no wavelet is named ''haar''; there are mexican_hat, morlet, dog, meyer, shannon'
"""
FIXED_WAVELET = f"""{EMB}, {EMB_LONG},
wu AS (SELECT vec_id, any_value(y) AS y, sum(((dim % 5 - 2) / 8.0)
         * {_psi('mexican_hat', '((x - (dim % 7 - 3) / 50.0) / (1.0 + dim % 3 / 4.0))')}) AS u FROM emb_long GROUP BY vec_id)"""
ORACLE["wavelet_classifier_fixed"] = f"""
WITH {FIXED_WAVELET}, z AS (SELECT vec_id, 1.5 * (u - 0.1) / sqrt(0.04 + 1e-5) - 0.25 AS logit FROM wu)
SELECT vec_id, round(logit, 6) AS logit, round(1.0 / (1.0 + exp(-logit)), 6) AS p FROM z
"""
ORACLE["wavelet_loss"] = f"""
WITH {FIXED_WAVELET}, st AS (SELECT avg(u) AS mean, stddev_pop(u) AS std FROM wu),
z AS (SELECT y, CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END AS w, (u - mean) / sqrt(std * std + 1e-5) AS h FROM wu, st),
l AS (SELECT y, w, h, 1.5 * h - 0.25 AS logit, 1.0 / (1.0 + exp(-(1.5 * h - 0.25))) AS p FROM z)
SELECT round(avg(w * (ln(1.0 + exp(-abs(logit))) + greatest(logit, 0) - y * logit)), 6) AS loss,
  round(avg(w * (p - y) * h), 6) AS by_gain, round(avg(w * (p - y)), 6) AS by_bias,
  round(any_value(mean), 6) AS mean, round(any_value(std), 6) AS std FROM l, st
"""
