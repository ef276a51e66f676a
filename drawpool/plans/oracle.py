"""DuckDB SQL for every SQL-checkable query of ``catalog`` (the oracle).

Written independently of the Spark code: relational CTEs (explode -> join ->
group), window ranks instead of array functions.  Tables are the driver's
pre-registered views.  Floats are rounded to 6 digits, integers are BIGINT.
"""

from __future__ import annotations

from ..sources.adaptors import LANG_HYPOTHESES, QUALITY_HYPOTHESES
from . import catalog as C

WS = r"'[ \n\t\r]+'"
WORD = r"'[ \n\t\r.,;!?]+'"


def H(seed, *cols) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in cols])
    return f"md5(concat_ws(':', {parts}))"


def toks(expr: str, lower: bool = False, pattern: str = WS) -> str:
    e = f"lower({expr})" if lower else expr
    return f"list_filter(regexp_split_to_array({e}, {pattern}), lambda t: t <> '')"


def hypo_values(d: dict) -> str:
    rows = ", ".join(f"({i}, '{lab}', '{d[lab]}')" for i, lab in enumerate(sorted(d)))
    return (f"(SELECT CAST(hypo_pos AS BIGINT) AS hypo_pos, hlab, hypothesis "
            f"FROM (VALUES {rows}) t(hypo_pos, hlab, hypothesis))")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


R6 = "round(CAST({} AS DOUBLE), 6)"


def r6(x, name):
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


METRICS = ["f1_macro", "f1_micro", "accuracy_balanced", "accuracy", "precision_macro",
           "recall_macro", "precision_micro", "recall_micro"]

# ---------------------------------------------------------------- adaptors
PQ = ("pq AS (SELECT d.doc_id AS idx, d.text, 'q' || CAST(l.quality AS VARCHAR) || '_t' || "
      "CAST(l.toxic AS VARCHAR) AS label_text FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
VEC = ("vec AS (SELECT vec_id AS idx, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS VARCHAR) AS label_text "
       "FROM embeddings)")
VECX = ("vecx AS (SELECT idx, label_text, unnest(x) AS val, unnest(range(len(x))) AS pos FROM vec)")
VOC = ("voc AS (SELECT label_text AS lab, row_number() OVER (ORDER BY label_text) - 1 AS k "
       "FROM (SELECT DISTINCT label_text FROM vec WHERE label_text IS NOT NULL))")
TR0 = f"tr0 AS (SELECT idx FROM vec ORDER BY {H(42, 'idx')}, idx LIMIT {C.N_TRAIN_VEC})"
PL0 = "pl0 AS (SELECT idx FROM vec WHERE idx NOT IN (SELECT idx FROM tr0))"


def score_ctes(tr: str, pl: str, s: str) -> list[str]:
    """Centroid logits, softmax, 4-digit ranks, margin and predictions of
    the pool ``pl`` under centroids fitted on ``tr``."""
    return [
        f"cent{s} AS (SELECT x.label_text AS lab, x.pos, avg(x.val) AS c FROM vecx x "
        f"JOIN {tr} t ON x.idx = t.idx GROUP BY x.label_text, x.pos)",
        f"logit{s} AS (SELECT x.idx, v.k, v.lab, {C.SC.CENTROID_SCALE} * coalesce(sum(x.val * c.c), 0) AS z "
        f"FROM vecx x JOIN {pl} p ON x.idx = p.idx CROSS JOIN voc v "
        f"LEFT JOIN cent{s} c ON c.lab = v.lab AND c.pos = x.pos GROUP BY x.idx, v.k, v.lab)",
        f"sm{s} AS (SELECT idx, k, lab, z, exp(z - max(z) OVER (PARTITION BY idx)) AS e FROM logit{s})",
        f"pr{s} AS (SELECT idx, k, lab, z, e / sum(e) OVER (PARTITION BY idx) AS p FROM sm{s})",
        f"rk{s} AS (SELECT *, round(p, 4) AS p4, "
        f"row_number() OVER (PARTITION BY idx ORDER BY round(p, 4) DESC, k) AS r4, "
        f"row_number() OVER (PARTITION BY idx ORDER BY z DESC, k) AS rz, "
        f"row_number() OVER (PARTITION BY idx ORDER BY p DESC, k) AS rp FROM pr{s})",
        f"mg{s} AS (SELECT idx, round(max(CASE WHEN r4 = 1 THEN p4 END) - coalesce(max(CASE WHEN r4 = 2 THEN p4 END), "
        f"max(CASE WHEN r4 = 1 THEN p4 END)), 4) AS margin, "
        f"max(CASE WHEN r4 = 1 THEN lab END) AS label_text_pred, max(CASE WHEN rz = 1 THEN lab END) AS pred_z, "
        f"max(CASE WHEN rz = 1 THEN k END) AS pred_pos, "
        f"max(CASE WHEN rp = 1 THEN lab END) AS pred_p, max(p) AS p_max FROM rk{s} GROUP BY idx)",
    ]


def metric_ctes(gp: str, s: str) -> list[str]:
    """Confusion counts -> per class -> the eight metrics (``mfin{s}``)."""
    return [
        f"conf{s} AS (SELECT gold, pred, count(*) AS n FROM {gp} GROUP BY gold, pred)",
        f"pc0{s} AS (SELECT gold AS cls, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, n AS true_n, 0 AS pred_n "
        f"FROM conf{s} UNION ALL SELECT pred AS cls, 0 AS tp, 0 AS true_n, n AS pred_n FROM conf{s})",
        f"pc{s} AS (SELECT cls, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(true_n) AS DOUBLE) AS true_n, "
        f"CAST(sum(pred_n) AS DOUBLE) AS pred_n FROM pc0{s} WHERE cls IS NOT NULL GROUP BY cls)",
        f"pcm{s} AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS prec, "
        f"CASE WHEN true_n > 0 THEN tp / true_n ELSE 0.0 END AS rec FROM pc{s})",
        f"pcf{s} AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 "
        f"FROM pcm{s})",
        f"met{s} AS (SELECT avg(prec) AS precision_macro, avg(rec) AS recall_macro, avg(f1) AS f1_macro, "
        f"avg(CASE WHEN true_n > 0 THEN rec END) AS accuracy_balanced, sum(tp) AS stp, sum(true_n) AS strue, "
        f"sum(pred_n) AS spred FROM pcf{s})",
        f"mic{s} AS (SELECT *, CASE WHEN spred > 0 THEN stp / spred ELSE 0.0 END AS precision_micro, "
        f"CASE WHEN strue > 0 THEN stp / strue ELSE 0.0 END AS recall_micro FROM met{s})",
        f"mfin{s} AS (SELECT coalesce(f1_macro, 0.0) AS f1_macro, "
        f"CASE WHEN precision_micro + recall_micro > 0 THEN 2 * precision_micro * recall_micro / "
        f"(precision_micro + recall_micro) ELSE 0.0 END AS f1_micro, "
        f"coalesce(accuracy_balanced, 0.0) AS accuracy_balanced, recall_micro AS accuracy, "
        f"coalesce(precision_macro, 0.0) AS precision_macro, coalesce(recall_macro, 0.0) AS recall_macro, "
        f"precision_micro, recall_micro, CAST(coalesce(strue, 0) AS BIGINT) AS n_rows FROM mic{s})",
    ]


def metric_select(s: str, digits: int | None = None) -> str:
    def col(m):
        x = f"round({m}, {digits})" if digits is not None else m
        return r6(x, m)
    return ", ".join(col(m) for m in METRICS) + ", n_rows"


def rounds_ctes(n_rounds: int) -> list[str]:
    ctes = [VEC, VECX, VOC, TR0, PL0]
    for r in range(n_rounds):
        s = f"_{r}"
        ctes += score_ctes(f"tr{r}", f"pl{r}", s)
        ctes.append(f"gp{s} AS (SELECT m.idx, v.label_text AS gold, m.pred_z AS pred FROM mg{s} m "
                    f"JOIN vec v ON m.idx = v.idx)")
        ctes += metric_ctes(f"gp{s}", s)
        ctes.append(f"dr{s} AS (SELECT * FROM (SELECT idx, margin, label_text_pred, "
                    f"row_number() OVER (ORDER BY margin, idx) AS margin_rank FROM mg{s}) "
                    f"WHERE margin_rank <= {C.N_DRAW})")
        ctes.append(f"tr{r + 1} AS (SELECT idx FROM tr{r} UNION ALL SELECT idx FROM dr{s})")
        ctes.append(f"pl{r + 1} AS (SELECT idx FROM pl{r} WHERE idx NOT IN (SELECT idx FROM dr{s}))")
    return ctes


ROUND0 = rounds_ctes(1)


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _metrics_hist(n):
    return _union([f"SELECT CAST({r} AS BIGINT) AS iter, {metric_select(f'_{r}')}, (SELECT count(*) FROM tr{r}) AS n_train "
                   f"FROM mfin_{r}" for r in range(n)])


def _samples_hist(n):
    return _union([f"SELECT CAST({r + 1} AS BIGINT) AS iter, idx, {r6('margin', 'margin')}, label_text_pred, "
                   f"row_number() OVER (ORDER BY {H(42, 'idx')}, idx) AS shuffle_rank FROM dr_{r}"
                   for r in range(n)])


NR = C.N_ROUNDS
SQL: dict[str, str] = {}

SQL["pool_contract"] = with_(
    "pv AS (SELECT vec_id AS idx, '' AS text, CAST(label AS VARCHAR) AS label_text FROM embeddings)",
    PQ,
    "pl AS (SELECT doc_id AS idx, text, lang AS label_text FROM documents)",
    f"pg AS (SELECT doc_id AS idx, text, {toks('text', True, WORD)}[1] AS label_text FROM documents)",
) + _union([
    f"SELECT '{n}' AS table_name, count(*) AS n_rows, count(DISTINCT idx) AS n_idx, "
    f"CAST(coalesce(sum(CASE WHEN idx IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_null_idx, "
    f"CAST(coalesce(sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_null_text, "
    f"CAST(coalesce(sum(CASE WHEN label_text IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_null_label FROM {t}"
    for n, t in [("pool_vec", "pv"), ("pool_quality", "pq"), ("pool_lang", "pl"), ("pool_gen", "pg")]])

# n draws give n + 1 fits: the model trained on the last draw is evaluated as well
SQL["metrics_history"] = with_(*rounds_ctes(NR + 1)) + _metrics_hist(NR + 1)
SQL["al_one_round"] = with_(*rounds_ctes(1)) + _metrics_hist(1)
SQL["sample_history"] = with_(*rounds_ctes(NR)) + _samples_hist(NR)
SQL["scored_long"] = with_(*rounds_ctes(NR + 1)) + _union(
    [f"SELECT CAST({r} AS BIGINT) AS iter, 'corpus' AS split, idx, gold, pred FROM gp_{r}" for r in range(NR + 1)])
SQL["learning_curve"] = with_(*rounds_ctes(NR + 1), f"mh AS ({_metrics_hist(NR + 1)})", f"sh AS ({_samples_hist(NR)})") + (
    "SELECT m.iter, (SELECT count(*) FROM sh WHERE sh.iter <= m.iter) AS n_labels, "
    + ", ".join(f"m.{c}" for c in METRICS) + " FROM mh m")
SQL["update_round"] = with_(*rounds_ctes(1)) + (
    "SELECT (SELECT count(DISTINCT idx) FROM tr1) AS n_train, (SELECT count(*) FROM pl1) AS n_pool")
SQL["al_rounds"] = with_(*rounds_ctes(NR)) + _union(
    [f"SELECT idx, CAST({r + 1} AS BIGINT) AS iter FROM dr_{r}" for r in range(NR)])

_USER = "(SELECT * FROM conversations WHERE role = 'user')"
_ANS = ("fa AS (SELECT conv_id AS idx, arg_min(text, turn) AS first_text, count(*) AS n "
        "FROM conversations WHERE role = 'assistant' GROUP BY conv_id)")
_QA = f"qa AS (SELECT conv_id AS idx FROM {_USER} u GROUP BY conv_id)"
_QAL = ("qal AS (SELECT q.idx, CASE WHEN coalesce(a.n, 0) > 0 THEN a.first_text ELSE 'unanswerable' END "
        "AS label_text FROM qa q LEFT JOIN fa a ON q.idx = a.idx)")
SQL["first_answer_default"] = with_(_ANS, _QA, _QAL) + "SELECT idx, label_text FROM qal"
SQL["label_length_max"] = with_(_ANS, _QA, _QAL) + \
    "SELECT CAST(max(length(label_text)) AS BIGINT) AS max_label_chars FROM qal"
SQL["qa_prompt"] = (
    "SELECT conv_id AS idx, 'Context: ' || arg_max(text, turn) || chr(10) || chr(10) || 'Question: ' || "
    "arg_min(text, turn) || chr(10) || chr(10) || 'Extract the answer from the context. Extracted answer: ' "
    f"AS text_prepared FROM {_USER} u GROUP BY conv_id")
SQL["context_quote_prompt"] = (
    "SELECT conv_id, turn, coalesce(lag(text) OVER w, '') || '  || The quote: \"' || coalesce(text, '') || "
    "'\" End of the quote ||  ' || coalesce(lead(text) OVER w, '') AS text_prepared FROM conversations "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
_TL = ", ".join(f"'{x}'" for x in C.TASK_LABELS)
SQL["task_label_filter"] = with_(PQ) + f"SELECT idx, label_text FROM pq WHERE label_text IN ({_TL})"
SQL["label_codes_first_seen"] = with_(
    PQ, "f AS (SELECT label_text, min(idx) AS fi FROM pq WHERE label_text IS NOT NULL GROUP BY label_text)",
    "c AS (SELECT label_text, row_number() OVER (ORDER BY fi) - 1 AS code FROM f)") + (
    "SELECT pq.idx, pq.label_text, CAST(coalesce(c.code, -1) AS BIGINT) AS label FROM pq "
    "LEFT JOIN c ON pq.label_text = c.label_text")
SQL["label_codes_alpha"] = with_(PQ) + (
    "SELECT label_text, CAST(row_number() OVER (ORDER BY label_text) - 1 AS BIGINT) AS code "
    "FROM (SELECT DISTINCT label_text FROM pq WHERE label_text IS NOT NULL)")
SQL["label_vocab"] = with_(PQ) + (
    "SELECT string_agg(label_text, ',' ORDER BY label_text) AS vocab, CAST(count(*) AS BIGINT) AS k "
    "FROM (SELECT DISTINCT label_text FROM pq WHERE label_text IS NOT NULL)")
SQL["label_distribution"] = with_(PQ) + (
    "SELECT label_text, count(*) AS n FROM pq WHERE label_text IS NOT NULL GROUP BY label_text")
SQL["pred_vs_gold_head"] = with_(*ROUND0) + (
    f"SELECT m.idx, m.pred_z AS label_text_pred, v.label_text FROM mg_0 m JOIN vec v ON m.idx = v.idx "
    f"ORDER BY m.idx LIMIT {C.HEAD_ROWS}")
B = C.TOKEN_BUDGET
SQL["token_budget_audit"] = with_(f"t AS (SELECT doc_id AS idx, len({toks('text')}) AS n FROM documents)") + (
    f"SELECT idx, n AS n_tokens, least(n, {B}) AS n_kept, n - least(n, {B}) AS n_dropped, "
    f"CAST(CASE WHEN n > {B} THEN 1 ELSE 0 END AS BIGINT) AS truncated FROM t")
SQL["pair_token_budget"] = with_(
    f"h AS {hypo_values(LANG_HYPOTHESES)}",
    f"p AS (SELECT d.doc_id AS idx, h.hypo_pos, len({toks('d.text')}) AS a, len({toks('h.hypothesis')}) AS b "
    f"FROM documents d JOIN h own ON d.lang = own.hlab CROSS JOIN h)") + (
    f"SELECT idx, hypo_pos, a AS n_text, b AS n_hypo, "
    f"CAST(CASE WHEN a + b <= {B} THEN a WHEN 2 * least(a, b) <= {B} THEN (CASE WHEN a <= b THEN a ELSE {B} - b END) "
    f"ELSE {(B + 1) // 2} END AS BIGINT) AS keep_text, "
    f"CAST(CASE WHEN a + b <= {B} THEN b WHEN 2 * least(a, b) <= {B} THEN (CASE WHEN a <= b THEN {B} - a ELSE b END) "
    f"ELSE {B // 2} END AS BIGINT) AS keep_hypo FROM p")
SQL["pool_minus_train"] = with_(VEC, TR0) + \
    "SELECT idx, label_text FROM vec WHERE idx NOT IN (SELECT idx FROM tr0)"
_LG = "lg AS (SELECT user_id AS idx, event_type AS label, ts, event_id AS seq FROM events)"
SQL["train_rows_current"] = with_(
    _LG,
    "lp AS (SELECT idx, label AS label_text FROM (SELECT idx, label, row_number() OVER "
    "(PARTITION BY idx ORDER BY ts, seq) AS rn FROM lg) WHERE rn = 1)",
    "lt AS (SELECT idx, label FROM (SELECT idx, label, row_number() OVER "
    "(PARTITION BY idx ORDER BY ts DESC, seq DESC) AS rn FROM lg) WHERE rn = 1)",
    f"ids AS (SELECT idx FROM lp ORDER BY {H(42, 'idx')}, idx LIMIT {C.N_LEDGER_TRAIN})") + (
    "SELECT lp.idx, coalesce(lt.label, lp.label_text) AS label_text, lp.label_text AS label_orig FROM lp "
    "JOIN ids ON lp.idx = ids.idx LEFT JOIN lt ON lp.idx = lt.idx")


def strat(src, seed, cap, name):
    return (f"{name} AS (SELECT idx, label_text, rn FROM (SELECT idx, label_text, row_number() OVER "
            f"(PARTITION BY label_text ORDER BY {H(seed, 'idx')}, idx) AS rn FROM {src} "
            f"WHERE label_text IS NOT NULL) WHERE rn <= {cap})")


_SPLIT = [PQ, strat("pq", 42, 30, "corp"), strat("pq", 84, 30, "t0"),
          "tst AS (SELECT idx, label_text FROM t0 WHERE idx NOT IN (SELECT idx FROM corp))"]
SQL["test_minus_corpus"] = with_(*_SPLIT) + "SELECT idx, label_text FROM tst"
SQL["corpus_test_split"] = with_(*_SPLIT) + (
    "SELECT idx, label_text, 'corpus' AS split FROM corp UNION ALL SELECT idx, label_text, 'test' FROM tst")
SQL["stratified_sample"] = with_(PQ, strat("pq", 42, 30, "s")) + "SELECT idx, label_text, rn AS rank FROM s"
SQL["seed_train_overlap"] = with_(*_SPLIT, strat("pq", 126, 10, "st")) + (
    "SELECT st.idx, st.label_text, CAST(CASE WHEN st.idx IN (SELECT idx FROM corp) THEN 1 ELSE 0 END AS BIGINT) "
    "AS in_corpus, CAST(CASE WHEN st.idx IN (SELECT idx FROM tst) THEN 1 ELSE 0 END AS BIGINT) AS in_test FROM st")
SQL["uniform_sample"] = with_(PQ) + (
    f"(SELECT idx, label_text, 'corpus' AS split FROM pq ORDER BY {H(42, 'idx')}, idx LIMIT {C.N_UNIFORM}) "
    f"UNION ALL (SELECT idx, label_text, 'test' AS split FROM pq ORDER BY {H(84, 'idx')}, idx "
    f"LIMIT {C.N_UNIFORM // 2})")
SQL["train_ids_union"] = with_(
    PQ, f"d1 AS (SELECT idx, CAST(1 AS BIGINT) AS iter FROM pq ORDER BY {H(42, 'idx')}, idx LIMIT 50)",
    f"d2 AS (SELECT idx, CAST(2 AS BIGINT) AS iter FROM pq ORDER BY {H(84, 'idx')}, idx LIMIT 50)") + (
    "SELECT idx, min(iter) AS iter FROM (SELECT * FROM d1 UNION ALL SELECT * FROM d2) GROUP BY idx")
SQL["nli_trainset"] = with_(
    PQ, f"h AS {hypo_values(QUALITY_HYPOTHESES)}",
    "ex AS (SELECT pq.idx, pq.label_text, h.hypo_pos, h.hlab FROM pq CROSS JOIN h)",
    "pos AS (SELECT idx, hypo_pos FROM ex WHERE label_text IS NOT DISTINCT FROM hlab)",
    "npos AS (SELECT hypo_pos, count(*) AS cap FROM pos GROUP BY hypo_pos)",
    f"neg AS (SELECT idx, hypo_pos, row_number() OVER (PARTITION BY hypo_pos ORDER BY {H(42, 'hlab', 'idx')}, idx) "
    "AS rn FROM ex WHERE label_text IS DISTINCT FROM hlab)") + (
    "SELECT idx, hypo_pos, CAST(0 AS BIGINT) AS label FROM pos UNION ALL SELECT n.idx, n.hypo_pos, "
    "CAST(1 AS BIGINT) AS label FROM neg n "
    "JOIN npos c ON n.hypo_pos = c.hypo_pos WHERE n.rn <= c.cap")
SQL["nli_trainset_shared"] = with_(
    f"h AS {hypo_values(LANG_HYPOTHESES)}", "ex AS (SELECT d.doc_id AS idx, d.lang, h.hypo_pos, h.hlab FROM documents d CROSS JOIN h)",
    "pos AS (SELECT idx, hypo_pos FROM ex WHERE lang IS NOT DISTINCT FROM hlab)",
    "npos AS (SELECT hypo_pos, count(*) AS cap FROM pos GROUP BY hypo_pos)",
    f"neg AS (SELECT idx, hypo_pos, row_number() OVER (PARTITION BY hypo_pos ORDER BY {H(42, 'idx')}, idx) AS rn FROM ex WHERE lang IS DISTINCT FROM hlab)") + (
    "SELECT idx, hypo_pos, CAST(0 AS BIGINT) AS label FROM pos UNION ALL SELECT n.idx, n.hypo_pos, CAST(1 AS BIGINT) FROM neg n "
    "JOIN npos c ON n.hypo_pos = c.hypo_pos WHERE n.rn <= c.cap")
SQL["nli_testset"] = with_(f"h AS {hypo_values(LANG_HYPOTHESES)}") + (
    "SELECT d.doc_id AS idx, h.hypo_pos, CAST(CASE WHEN h.hypothesis = own.hypothesis THEN 0 ELSE 1 END AS BIGINT) "
    "AS label "
    "FROM documents d JOIN h own ON d.lang = own.hlab CROSS JOIN h")
SQL["annotation_latest"] = (
    "SELECT idx, label, n_annotations FROM (SELECT user_id AS idx, event_type AS label, "
    "count(*) OVER (PARTITION BY user_id) AS n_annotations, row_number() OVER (PARTITION BY user_id "
    "ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
SQL["annotation_stream_latest"] = SQL["annotation_latest"]
SQL["annotation_state"] = f"SELECT idx, label FROM ({SQL['annotation_latest']})"
_FED = [_LG, "prd AS (SELECT idx, label AS pred FROM (SELECT idx, label, row_number() OVER (PARTITION BY idx ORDER BY ts, seq) AS rn FROM lg) WHERE rn = 1)"]
for _k in range(len(C.FEEDS)):
    _of = ", ".join(map(str, C.FEEDS[:_k + 1]))
    _FED += [f"gpf{_k} AS (SELECT l.label AS gold, p.pred FROM (SELECT idx, label, row_number() OVER (PARTITION BY idx ORDER BY ts DESC, seq DESC) AS rn "
             f"FROM lg WHERE seq % {len(C.FEEDS)} IN ({_of})) l JOIN prd p ON p.idx = l.idx WHERE rn = 1)", *metric_ctes(f"gpf{_k}", f"_f{_k}")]
SQL["metrics_by_retraction"] = with_(*_FED) + _union([f"SELECT CAST({k} AS BIGINT) AS feed, {metric_select(f'_f{k}')} FROM mfin_f{k}" for k in range(len(C.FEEDS))])
SQL["merge_predictions"] = with_(*ROUND0) + (
    f"SELECT m.idx, v.label_text, CAST(len(v.x) AS BIGINT) AS n_features, {r6('list_sum(v.x)', 'sum_features')}, "
    f"m.pred_p AS label_text_pred, {r6('m.p_max', 'prob_pred')}, p.k AS pos, {r6('p.p', 'prob')} "
    "FROM mg_0 m JOIN vec v ON m.idx = v.idx JOIN pr_0 p ON p.idx = m.idx")
SQL["round_counts"] = with_(
    f"h AS {hypo_values(LANG_HYPOTHESES)}",
    "c AS (SELECT d.doc_id AS idx FROM documents d JOIN h own ON d.lang = own.hlab CROSS JOIN h)",
    f"t AS (SELECT doc_id AS idx FROM documents ORDER BY {H(42, 'doc_id')}, doc_id LIMIT 100)") + (
    "SELECT (SELECT count(*) FROM c) AS n_corpus_rows, (SELECT count(DISTINCT idx) FROM c) AS n_corpus_idx, "
    "(SELECT count(DISTINCT idx) FROM t) AS n_train, "
    "(SELECT count(DISTINCT idx) FROM c WHERE idx NOT IN (SELECT idx FROM t)) AS n_pool")
SQL["confusion_counts"] = with_(*ROUND0) + "SELECT gold, pred, count(*) AS n FROM gp_0 GROUP BY gold, pred"
SQL["eval_metrics"] = with_(
    *ROUND0, "gpp AS (SELECT m.idx, v.label_text AS gold, m.label_text_pred AS pred FROM mg_0 m "
    "JOIN vec v ON m.idx = v.idx)", *metric_ctes("gpp", "_e")) + f"SELECT {metric_select('_e')} FROM mfin_e"
SQL["standard_eval"] = with_(*ROUND0) + f"SELECT {metric_select('_0')} FROM mfin_0"
SQL["class_report"] = with_(
    *ROUND0,
    "cr AS (SELECT v.lab AS label_text, coalesce(p.prec, 0.0) AS precision, coalesce(p.rec, 0.0) AS recall, "
    "coalesce(p.f1, 0.0) AS f1, CAST(coalesce(p.true_n, 0) AS BIGINT) AS support, coalesce(p.tp, 0) AS tp "
    "FROM voc v LEFT JOIN pcf_0 p ON p.cls = v.lab)") + _union([
        f"SELECT label_text, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')}, support "
        "FROM cr",
        "SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), "
        "round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM cr",
        "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), "
        "CAST(sum(support) AS BIGINT) "
        "FROM cr",
        "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), "
        "round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), "
        "CAST(sum(support) AS BIGINT) FROM cr"])

_GEN = [
    f"pg AS (SELECT doc_id AS idx, {toks('text', True, WORD)} AS toks FROM documents)",
    "gold AS (SELECT idx, toks[1] AS gold FROM pg)",
    "tc AS (SELECT idx, tok, count(*) AS n FROM (SELECT idx, unnest(toks) AS tok FROM pg) GROUP BY idx, tok)",
    "prd AS (SELECT idx, tok AS pred FROM (SELECT idx, tok, row_number() OVER (PARTITION BY idx "
    "ORDER BY n DESC, tok) AS rn FROM tc) WHERE rn = 1)",
    "gpg AS (SELECT g.idx, g.gold, p.pred FROM gold g LEFT JOIN prd p ON g.idx = p.idx)",
]
SQL["eval_open_vocab"] = with_(*_GEN, *metric_ctes("gpg", "_g")) + f"SELECT {metric_select('_g')} FROM mfin_g"
SQL["generation_eval"] = with_(*_GEN, *metric_ctes("gpg", "_g")) + f"SELECT {metric_select('_g', 3)} FROM mfin_g"

_NLI = [
    f"h AS {hypo_values(LANG_HYPOTHESES)}",
    f"htok AS (SELECT DISTINCT hypo_pos, unnest({toks('hypothesis', True, WORD)}) AS tok FROM h)",
    f"dt AS (SELECT doc_id AS idx, lang, list_distinct({toks('text', True, WORD)}) AS tt FROM documents)",
    "dtok AS (SELECT idx, unnest(tt) AS tok FROM dt)",
    "ovc AS (SELECT x.idx, ht.hypo_pos, count(*) AS c FROM dtok x JOIN htok ht ON x.tok = ht.tok "
    "GROUP BY x.idx, ht.hypo_pos)",
    "zz AS (SELECT d.idx, h.hypo_pos, h.hlab, CAST(coalesce(o.c, 0) AS DOUBLE) AS z_entail, 1.0 AS z_not, "
    "CASE WHEN h.hypothesis = own.hypothesis THEN 0 ELSE 1 END AS label FROM dt d JOIN h own ON d.lang = own.hlab "
    "CROSS JOIN h LEFT JOIN ovc o ON o.idx = d.idx AND o.hypo_pos = h.hypo_pos)",
    "zp AS (SELECT *, 1.0 / (1.0 + exp(z_not - z_entail)) AS p_entail, "
    "row_number() OVER (PARTITION BY idx ORDER BY z_entail DESC, hypo_pos) AS rzp, "
    "row_number() OVER (PARTITION BY idx ORDER BY label, hypo_pos) AS rlab, "
    "row_number() OVER (PARTITION BY idx ORDER BY round(1.0 / (1.0 + exp(z_not - z_entail)), 4) DESC, hypo_pos) "
    "AS r4 FROM zz)",
    "np AS (SELECT idx, count(*) AS n_hypo, max(CASE WHEN rzp = 1 THEN hypo_pos END) AS pred_pos, "
    "max(CASE WHEN rlab = 1 THEN hypo_pos END) AS gold_pos FROM zp GROUP BY idx)",
]
SQL["nli_overlap_logits"] = with_(*_NLI) + \
    f"SELECT idx, hypo_pos, {r6('z_entail', 'z_entail')}, {r6('z_not', 'z_not')} FROM zz"
SQL["nli_regroup"] = with_(*_NLI) + "SELECT idx, n_hypo, pred_pos, gold_pos FROM np"
SQL["nli_predict"] = with_(*_NLI) + (
    f"SELECT z.idx, z.hypo_pos, {r6('z.p_entail', 'p_entail')}, "
    "CAST(CASE WHEN z.hypo_pos = n.pred_pos THEN 1 ELSE 0 END AS BIGINT) AS is_pred, "
    "CAST(CASE WHEN z.hypo_pos = n.gold_pos THEN 1 ELSE 0 END AS BIGINT) AS is_gold FROM zp z JOIN np n "
    "ON z.idx = n.idx")
SQL["nli_eval"] = with_(*_NLI, "gpn AS (SELECT idx, gold_pos AS gold, pred_pos AS pred FROM np)",
                        *metric_ctes("gpn", "_n")) + f"SELECT {metric_select('_n')} FROM mfin_n"
SQL["zero_shot_round"] = with_(
    *_NLI,
    "zm AS (SELECT idx, round(max(CASE WHEN r4 = 1 THEN round(p_entail, 4) END) - "
    "coalesce(max(CASE WHEN r4 = 2 THEN round(p_entail, 4) END), max(CASE WHEN r4 = 1 THEN round(p_entail, 4) END)), 4) "
    "AS margin, max(CASE WHEN r4 = 1 THEN hlab END) AS label_text_pred FROM zp GROUP BY idx)",
    f"zd AS (SELECT * FROM zm ORDER BY margin, idx LIMIT {C.N_DRAW_ZERO_SHOT})") + (
    f"SELECT idx, {r6('margin', 'margin')}, label_text_pred, row_number() OVER (ORDER BY {H(42, 'idx')}, idx) "
    "AS shuffle_rank FROM zd")

SQL["breaking_ties_half"] = with_(
    *_NLI,
    "zm AS (SELECT idx, round(max(CASE WHEN r4 = 1 THEN round(p_entail, 4) END) - max(CASE WHEN r4 = 2 THEN round(p_entail, 4) END), 4) AS margin, "
    "max(CASE WHEN r4 = 1 THEN hlab END) AS label_text_pred FROM zp GROUP BY idx)",
    "zr AS (SELECT *, row_number() OVER (ORDER BY margin, idx) AS margin_rank FROM zm)",
    "zd AS (SELECT * FROM zr WHERE margin_rank <= greatest(1, (SELECT count(*) FROM zm) // 2))") + (
    f"SELECT idx, {r6('margin', 'margin')}, label_text_pred, margin_rank, row_number() OVER (ORDER BY {H(42, 'idx')}, idx) AS shuffle_rank FROM zd")
SQL["answer_codes"] = with_(
    _GEN[0], "g AS (SELECT toks[1] AS label_text, min(idx) AS fi FROM pg WHERE toks[1] IS NOT NULL GROUP BY 1)") + (
    "SELECT label_text, row_number() OVER (ORDER BY label_text) - 1 AS alpha_code, row_number() OVER (ORDER BY fi, label_text) - 1 AS first_code FROM g")
SQL["class_report_open"] = with_(
    *_GEN, *metric_ctes("gpg", "_g"),
    "cr AS (SELECT p.cls AS label_text, p.prec AS precision, p.rec AS recall, p.f1, CAST(p.true_n AS BIGINT) AS support, p.tp FROM pcf_g p "
    "WHERE p.cls IN (SELECT gold FROM gold))") + _union([
        f"SELECT label_text, {r6('precision', 'precision')}, {r6('recall', 'recall')}, {r6('f1', 'f1')}, support FROM cr",
        "SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM cr",
        "SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM cr",
        "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
        "round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM cr"])

SQL["zip_csv_source"] = "SELECT conv_id, turn, role, length(text) AS n_chars, md5(text) AS text_md5 FROM conversations"
_LISTS = ", ".join(f"({i}, {[w for w in LANG_HYPOTHESES[k].split()]})" for i, k in enumerate(sorted(LANG_HYPOTHESES)))
SQL["score_text_batches"] = with_(f"wl AS (SELECT CAST(pos AS BIGINT) AS pos, ws FROM (VALUES {_LISTS}) v(pos, ws))", f"tx AS (SELECT doc_id AS idx, {toks('text')} AS t FROM documents)") + (
    f"SELECT idx, pos, {r6('len(list_filter(t, lambda x: list_contains(ws, x)))', 'logit')} FROM tx CROSS JOIN wl")
_POST = "round(1.0 / (1.0 + exp(1.0 - {})), 4)"
SQL["nli_postings"] = with_(
    *_NLI, "q AS (SELECT idx, max(CASE WHEN rzp = 1 THEN hypo_pos END) AS pred_pos, max(z_entail) AS z, count(*) FILTER (z_entail > 0) AS n, "
    "max(CASE WHEN rzp = 2 THEN z_entail END) AS z2 FROM zp GROUP BY idx)") + (
    f"SELECT idx, pred_pos, {r6('z', 'z_entail')}, n AS n_shared, round({_POST.format('z')} - {_POST.format('z2')}, 4) AS margin FROM q")
SQL["nli_postings_open"] = with_(
    _GEN[0], "hy AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS pos FROM (SELECT DISTINCT toks[1] AS w FROM pg WHERE toks[1] IS NOT NULL))",
    "dw AS (SELECT DISTINCT idx, unnest(toks) AS w FROM pg)", "sh AS (SELECT idx, min(pos) AS pos, count(*) AS n FROM dw JOIN hy USING (w) GROUP BY idx)") + (
    "SELECT pg.idx, CAST(coalesce(pos, 0) AS BIGINT) AS pred_pos, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS DOUBLE) AS z_entail, CAST(coalesce(n, 0) AS BIGINT) AS n_shared, "
    f"CASE WHEN n = 1 THEN round({_POST.format('1.0')} - {_POST.format('0.0')}, 4) ELSE 0.0 END AS margin FROM pg LEFT JOIN sh ON pg.idx = sh.idx")

_UNI = [
    f"ws AS (SELECT doc_id AS idx, {toks('text')} AS toks FROM documents)",
    "cnt AS (SELECT tok, count(*) AS c FROM (SELECT unnest(toks) AS tok FROM ws) GROUP BY tok)",
    "tot AS (SELECT CAST(sum(c) + count(*) AS DOUBLE) AS denom FROM cnt)",
    "fst AS (SELECT idx, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM ws)",
    "stp AS (SELECT f.idx, f.pos, ln((coalesce(c.c, 0) + 1) / (SELECT denom FROM tot)) AS step FROM fst f "
    "LEFT JOIN cnt c ON f.tok = c.tok)",
    f"seqs AS (SELECT w.idx, round(coalesce(sum(s.step), 0.0) / ({C.SC.INPUT_LEN} + count(CASE WHEN s.step < 0 THEN 1 END)), 9) "
    "AS score FROM ws w LEFT JOIN stp s ON w.idx = s.idx GROUP BY w.idx)",
]
SQL["unigram_step_scores"] = with_(*_UNI) + f"SELECT idx, pos, {r6('step', 'step')} FROM stp"
SQL["sequence_score"] = with_(*_UNI) + f"SELECT idx, {r6('score', 'score')} FROM seqs"
SQL["min_certainty"] = with_(
    *_UNI, f"sd AS (SELECT idx, score, row_number() OVER (ORDER BY score, idx) AS score_rank FROM seqs)") + (
    f"SELECT idx, {r6('score', 'score')}, score_rank, row_number() OVER (ORDER BY {H(42, 'idx')}, idx) "
    f"AS shuffle_rank FROM sd WHERE score_rank <= {C.N_DRAW}")
SQL["breaking_ties"] = with_(*ROUND0) + (
    f"SELECT idx, {r6('margin', 'margin')}, label_text_pred, margin_rank, row_number() OVER "
    f"(ORDER BY {H(42, 'idx')}, idx) AS shuffle_rank FROM dr_0")
_BLOCKED = "SELECT m.idx, m.{pred} AS pred, m.pred_pos, round(m.p_max, 6) AS prob, " + r6("m.margin", "margin") + " FROM {mg} m"
SQL["blocked_margins"] = with_(*ROUND0) + _BLOCKED.format(pred="pred_z", mg="mg_0")
SQL["blocked_instances"] = with_(
    VEC, VECX, TR0, PL0, "voci AS (SELECT lpad(CAST(idx AS VARCHAR), 12, '0') AS lab, idx AS ti, row_number() OVER (ORDER BY lpad(CAST(idx AS VARCHAR), 12, '0')) - 1 AS k FROM tr0)",
    f"li AS (SELECT x.idx, v.k, v.lab, {C.SC.CENTROID_SCALE} * sum(x.val * t.val) AS z FROM vecx x JOIN pl0 p ON x.idx = p.idx CROSS JOIN voci v "
    "JOIN vecx t ON t.idx = v.ti AND t.pos = x.pos GROUP BY x.idx, v.k, v.lab)",
    "si AS (SELECT *, exp(z - max(z) OVER (PARTITION BY idx)) AS e FROM li)",
    "pi AS (SELECT *, e / sum(e) OVER (PARTITION BY idx) AS p, row_number() OVER (PARTITION BY idx ORDER BY z DESC, k) AS r FROM si)",
    "mi AS (SELECT idx, max(CASE WHEN r = 1 THEN lab END) AS pred_z, max(CASE WHEN r = 1 THEN k END) AS pred_pos, max(p) AS p_max, "
    "round(max(CASE WHEN r = 1 THEN round(p, 4) END) - max(CASE WHEN r = 2 THEN round(p, 4) END), 4) AS margin FROM pi GROUP BY idx)") + \
    _BLOCKED.format(pred="pred_z", mg="mi")
SQL["margin_scores"] = with_(*ROUND0) + f"SELECT idx, {r6('margin', 'margin')}, label_text_pred FROM mg_0"
SQL["shuffled_sample"] = with_(VEC, TR0) + \
    f"SELECT idx, row_number() OVER (ORDER BY {H(C.SM.SEED_TEST, 'idx')}, idx) AS shuffle_rank FROM tr0"
SQL["scaled_probs"] = with_(*ROUND0) + (
    f"SELECT r.idx, r.lab AS label_text, {r6('r.p4', 'prob')}, "
    f"{r6('r.p4 / sum(r.p4) OVER (PARTITION BY r.idx)', 'prob_scaled')} FROM rk_0 r JOIN dr_0 d ON r.idx = d.idx")
SQL["train_plus_scored"] = with_(*ROUND0) + (
    "SELECT t.idx, 'train' AS split, v.label_text, CAST(NULL AS VARCHAR) AS label_text_pred, CAST(NULL AS BIGINT) AS pos, "
    "CAST(NULL AS DOUBLE) AS prob FROM tr0 t JOIN vec v ON t.idx = v.idx UNION ALL "
    f"SELECT m.idx, 'corpus', v.label_text, m.pred_z, p.k, {R6.format('p.p')} FROM mg_0 m JOIN vec v ON m.idx = v.idx "
    "JOIN pr_0 p ON p.idx = m.idx")
SQL["softmax_probs"] = with_(*ROUND0) + f"SELECT idx, k AS pos, {r6('p', 'prob')} FROM pr_0"
SQL["argmax_label"] = with_(*ROUND0) + "SELECT idx, pred_pos, pred_z AS label_text_pred FROM mg_0"
SQL["naive_certainty"] = with_(VEC, VECX) + (
    f"SELECT idx, {r6('sum(m)', 'certainty')} FROM (SELECT idx, pos // 2 AS st, max(val) AS m FROM vecx "
    "GROUP BY idx, pos // 2) GROUP BY idx")
SQL["centroid_logits"] = with_(*ROUND0) + f"SELECT idx, k AS pos, {r6('z', 'logit')} FROM logit_0"
SQL["score_batch_udf"] = SQL["centroid_logits"]
_TS = f"ts AS (SELECT idx FROM pl0 ORDER BY {H(C.SM.SEED_TEST, 'idx')}, idx LIMIT {C.N_TEST_SLOT})"
SQL["test_slot_round"] = with_(*ROUND0, _TS) + (
    "SELECT CASE WHEN m.idx IN (SELECT idx FROM ts) THEN 'test' ELSE 'corpus' END AS split, m.idx, v.label_text AS gold, "
    f"m.pred_z AS pred, p.k AS pos, {r6('p.p', 'prob')} FROM mg_0 m JOIN vec v ON m.idx = v.idx JOIN pr_0 p ON p.idx = m.idx")
SQL["test_slot_metrics"] = with_(
    *ROUND0, _TS, "gpt AS (SELECT * FROM gp_0 WHERE idx IN (SELECT idx FROM ts))", *metric_ctes("gpt", "_ts")) + \
    f"SELECT {metric_select('_ts')} FROM mfin_ts"
SQL["generation_round"] = with_(*_GEN, *_UNI) + (
    f"SELECT g.idx, g.gold, g.pred, {r6('s.score', 'score')} FROM gpg g JOIN seqs s ON g.idx = s.idx")
# a fitted model's values are not for SQL; what every fit must give is
_FIT = "CAST((SELECT count(*) FROM {voc}) AS BIGINT) AS n_probs, CAST(1 AS DOUBLE) AS prob_sum, CAST(1 AS BIGINT) AS pred_has_max FROM {pool}"
SQL["fit_score_vectors"] = with_(VEC, VOC, TR0, PL0) + "SELECT idx, " + _FIT.format(voc="voc", pool="pl0")
SQL["fit_score_text"] = with_(
    PQ, f"tq AS (SELECT idx FROM pq ORDER BY {H(42, 'idx')}, idx LIMIT {C.N_UNIFORM})",
    "pt AS (SELECT idx FROM pq WHERE idx NOT IN (SELECT idx FROM tq))",
    "vq AS (SELECT DISTINCT label_text FROM pq WHERE label_text IS NOT NULL)") + "SELECT idx, " + _FIT.format(voc="vq", pool="pt")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
