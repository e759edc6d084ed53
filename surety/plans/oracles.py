"""SQL for the query catalogue, written from the definitions: pairs are compared with pairs, percentiles are ranked."""

from __future__ import annotations

from surety.functions import philox
from surety.functions.probit import probit_sql
from surety.functions.text import PUNCTUATION
from surety.operators.cost import PRICES
from surety.plans import prompts
from surety.sources.corpora import CHOICE_INSTRUCTION

ORACLES: dict[str, str] = {}

BINARY = "(SELECT l_orderkey, l_partkey, l_linenumber::BIGINT AS k, (l_returnflag = 'R')::INT AS correct, (l_linestatus = 'F')::INT AS yes FROM lineitem)"
ORDERS = "(SELECT o_orderkey AS id, o_custkey % 10 AS k, (o_orderstatus = 'F')::INT AS correct, CASE WHEN regexp_extract(o_orderpriority, '[0-9]+')::INT BETWEEN 1 AND 5 THEN regexp_extract(o_orderpriority, '[0-9]+')::INT ELSE 3 END AS grade, o_orderpriority AS meta_output FROM orders)"
EVENTS = "(SELECT event_id AS id, event_type AS k, (json_extract_string(props, '$.k')::INT >= 50)::INT AS correct, least(3, floor(value / 25))::INT AS grade, value AS score FROM events)"
GRADE_CASE = r"""CASE regexp_extract(lower(t), '(?:^|[^\p{L}\p{N}_])([abcd])', 1) WHEN 'a' THEN 3 WHEN 'b' THEN 2 WHEN 'c' THEN 1 WHEN 'd' THEN 0 ELSE
  CASE WHEN contains(lower(t), 'certain') OR contains(lower(t), 'sure') THEN 3 WHEN contains(lower(t), 'probably') OR contains(lower(t), 'think') THEN 2
  WHEN contains(lower(t), 'not know') OR contains(lower(t), 'no idea') THEN 0 ELSE 1 END END"""
DOCS = f"(SELECT d.doc_id AS id, lang AS k, quality AS correct, {GRADE_CASE.replace('t)', 'd.text)')} AS grade FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"
LOGITS = "(SELECT vec_id, label, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS g, embedding[5]::DOUBLE AS n, embedding[6]::DOUBLE AS y FROM embeddings)"
WEIGHTS = "(SELECT label || '/' || vec_id AS name, i AS pos, embedding[i + 1]::DOUBLE AS value FROM (SELECT label, vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings))"
TURNS = "(SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant')"
TOKENS = "(SELECT item_id, item_id // 8 AS batch, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM benchmark)"


def _rate(part: str, whole: str) -> str:
    return f"least(greatest({part}::DOUBLE / {whole}, 0.0001), 0.9999)"


def _d_prime(hits: str, right: str, alarms: str, wrong: str) -> str:
    return f"CASE WHEN {right} = 0 OR {wrong} = 0 THEN 'nan'::DOUBLE ELSE {probit_sql(_rate(hits, right))} - ({probit_sql(_rate(alarms, wrong))}) END"


def _sums(view: str, thresholds) -> str:
    at = ", ".join(f"count(*) FILTER (correct = 1 AND grade >= {t}) AS h{t}, count(*) FILTER (correct = 0 AND grade >= {t}) AS a{t}" for t in thresholds)
    return f"(SELECT k, count(*) FILTER (correct = 1) AS r, count(*) FILTER (correct = 0) AS w, {at} FROM {view} GROUP BY k)"


def _pairs(view: str, by="k") -> str:
    """Concordant, discordant, tied counts from all pairs of a right and a wrong trial, counted by grade."""
    keys = by.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    cells = f"(SELECT {by}, correct, grade, count(*)::DOUBLE AS n FROM {view} GROUP BY {by}, correct, grade)"
    names = ", ".join(f"a.{k}" for k in keys)
    return f"""(SELECT {by}, coalesce(c, 0) AS c, coalesce(d, 0) AS d, coalesce(t, 0) AS t, r, w, g FROM
      (SELECT {by}, count(*) FILTER (correct = 1)::DOUBLE AS r, count(*) FILTER (correct = 0)::DOUBLE AS w FROM {view} GROUP BY {by}) z
      LEFT JOIN (SELECT {names}, sum(CASE WHEN a.grade > b.grade THEN a.n * b.n ELSE 0 END) AS c, sum(CASE WHEN a.grade < b.grade THEN a.n * b.n ELSE 0 END) AS d, sum(CASE WHEN a.grade = b.grade THEN a.n * b.n ELSE 0 END) AS t
        FROM {cells} a JOIN {cells} b ON {on} WHERE a.correct = 1 AND b.correct = 0 GROUP BY {names}) y USING ({by})
      LEFT JOIN (SELECT {by}, sum(n * (n - 1) / 2) AS g FROM (SELECT {by}, grade, sum(n) AS n FROM {cells} GROUP BY {by}, grade) GROUP BY {by}) x USING ({by}))"""


GAMMA = "CASE WHEN c + d > 0 THEN (c - d) / (c + d) ELSE 0.0 END"
AUROC = "CASE WHEN r > 0 AND w > 0 THEN (c + t / 2) / (r * w) ELSE 0.5 END"
TAU = "CASE WHEN r > 0 AND w > 0 AND (r + w) * (r + w - 1) / 2 > g THEN (c - d) / sqrt(((r + w) * (r + w - 1) / 2 - g) * ((r + w) * (r + w - 1) / 2 - r * (r - 1) / 2 - w * (w - 1) / 2)) ELSE 0.0 END"


def _ece(view: str) -> str:
    return f"""(SELECT k, sum(CASE WHEN hi > lo THEN n / total * abs(acc - (grade - lo) / (hi - lo)::DOUBLE) ELSE 0.0 END) AS ece FROM
      (SELECT *, min(grade) OVER (PARTITION BY k) AS lo, max(grade) OVER (PARTITION BY k) AS hi, sum(n) OVER (PARTITION BY k) AS total FROM
        (SELECT k, grade, count(*)::DOUBLE AS n, avg(correct) AS acc FROM {view} GROUP BY k, grade)) GROUP BY k)"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _fill(template: str, question: str, answer="''") -> str:
    out, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{question}"), rest.find("{answer}")) if i >= 0), default=len(rest))
        if at:
            out.append(_quote(rest[:at]))
        if rest[at:].startswith("{question}"):
            out.append(question)
            at += len("{question}")
        elif rest[at:].startswith("{answer}"):
            out.append(answer)
            at += len("{answer}")
        rest = rest[at:]
    return " || ".join(out)


def _language(templates: dict[str, str], lang: str) -> str:
    of = {k: _fill(v, "question") for k, v in templates.items()}
    return f"CASE WHEN {lang} = 'ko' THEN {of['ko']} WHEN {lang} LIKE 'zh%' THEN {of['zh']} WHEN {lang} = 'es' THEN {of['es']} ELSE {of['en']} END"


def _joined(x: str) -> str:
    return f"array_to_string({x}, ',')"


ORACLES["inclusion_correctness"] = "SELECT doc_id, (EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(d.text), lower(b.text))))::BIGINT AS correct FROM documents d"
ORACLES["inclusion_by_answers"] = "SELECT item_id, 1::BIGINT AS correct FROM benchmark UNION ALL SELECT item_id + 1000000, 0::BIGINT FROM benchmark"
ORACLES["mmlu_letter"] = r"""SELECT doc_id, nullif(l, '') AS letter, coalesce(l = 'A', false)::BIGINT AS correct FROM (SELECT doc_id, regexp_extract(upper(text), '(?:^|[^\p{L}\p{N}_])([ABCD])(?:$|[^\p{L}\p{N}_])', 1) AS l FROM documents)"""
ORACLES["graded_parse"] = f"SELECT doc_id, ({GRADE_CASE})::BIGINT AS grade FROM (SELECT doc_id, text AS t FROM documents)"
ORACLES["graded_parse_strict"] = rf"SELECT conv_id, turn, ({GRADE_CASE})::BIGINT AS grade, regexp_matches(lower(t), '(?:^|[^\p{{L}}\p{{N}}_])[abcd]')::BIGINT AS parsed_ok FROM (SELECT conv_id, turn, text AS t FROM conversations)"
ORACLES["gsm8k_last_number"] = r"""SELECT page_id, x AS number, coalesce(abs(x - 1000) < 1e-6 OR abs(x - try_cast(nullif(regexp_extract(url, '([0-9]+)', 1), '') AS DOUBLE)) < 1e-6, false)::BIGINT AS correct
  FROM (SELECT page_id, url, try_cast(replace(regexp_extract_all(url, '-?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?')[-1], ',', '') AS DOUBLE) AS x FROM pages)"""
ORACLES["numeric_parse_fok"] = f"SELECT id, grade::BIGINT AS grade FROM {ORDERS}"
ORACLES["numeric_parse_10"] = "SELECT page_id, coalesce(list_filter(list_transform(regexp_extract_all(html, '[0-9]+'), lambda x: try_cast(x AS BIGINT)), lambda x: x BETWEEN 1 AND 10)[1], 5)::BIGINT AS grade FROM pages"
ORACLES["yes_parse_by_lang"] = "SELECT doc_id, lang, contains(lower(text), CASE WHEN lang = 'ko' THEN '예' WHEN lang LIKE 'zh%' THEN '是' WHEN lang = 'es' THEN 'sí' ELSE 'yes' END)::BIGINT AS yes FROM documents"
ORACLES["idw_abstention"] = f"SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 OR contains(lower(answer), 'i don''t know') THEN 'no' ELSE 'yes' END AS meta_answer FROM {TURNS}"
ORACLES["parse_dispatch"] = f"""SELECT id, m AS meta_type, (CASE m WHEN 'graded' THEN {GRADE_CASE} WHEN 'binary' THEN contains(lower(t), 'yes')::INT WHEN 'numeric' THEN coalesce(try_cast(regexp_extract(t, '[0-9]+') AS INT), 5) ELSE coalesce(try_cast(regexp_extract(t, '[0-9]+') AS INT), 3) END)::BIGINT AS value, (m <> 'binary')::BIGINT AS graded
  FROM (SELECT id, ['graded', 'fok', 'jol', 'numeric', 'binary'][k % 5 + 1] AS m, meta_output AS t FROM {ORDERS})"""
ORACLES["scorer_dispatch"] = f"""SELECT id, m AS dataset, (CASE m WHEN 'mmlu' THEN 0 WHEN 'gsm8k' THEN (t LIKE '1%')::INT ELSE (contains(t, '1') OR contains(lower(t), 'low'))::INT END)::BIGINT AS correct FROM (SELECT id, ['mmlu', 'gsm8k', 'trivia_qa'][k % 3 + 1] AS m, meta_output AS t FROM {ORDERS})"""
ORACLES["row_metrics"] = f"SELECT correct::BIGINT AS correct, yes::BIGINT AS yes, count(*) AS n, sum(CASE WHEN yes = 1 THEN 1 - correct END)::BIGINT AS wrong_yes, sum(CASE WHEN yes = 0 THEN correct END)::BIGINT AS wrong_no, sum((correct = yes)::INT)::BIGINT AS aligned FROM {BINARY} GROUP BY ALL"
ORACLES["binary_metrics"] = f"SELECT k, count(*) AS n, avg(correct) AS accuracy, avg(yes) AS yes_rate, avg((correct = yes)::INT) AS meta_alignment FROM {BINARY} GROUP BY k"
ORACLES["failure_ratios"] = f"SELECT k, coalesce(avg(1 - correct) FILTER (yes = 1), 0.0) AS yes_failure_ratio, coalesce(avg(correct) FILTER (yes = 0), 0.0) AS no_failure_ratio FROM {BINARY} GROUP BY k"
ORACLES["type2_dprime"] = f"SELECT k, round({_d_prime('h', 'r', 'a', 'w')}, 9) AS d_prime FROM (SELECT k, sum(correct) AS r, sum(1 - correct) AS w, sum(correct * yes) AS h, sum((1 - correct) * yes) AS a FROM {BINARY} GROUP BY k)"
ORACLES["relative_meta_information"] = f"""WITH t AS (SELECT k, correct, yes, count(*)::DOUBLE AS n FROM {BINARY} GROUP BY ALL),
  p AS (SELECT k, correct, yes, n / sum(n) OVER (PARTITION BY k) AS p, sum(n) OVER (PARTITION BY k, correct) / sum(n) OVER (PARTITION BY k) AS pc, sum(n) OVER (PARTITION BY k, yes) / sum(n) OVER (PARTITION BY k) AS py FROM t),
  h AS (SELECT k, -sum(pc * log2(pc)) AS h FROM (SELECT DISTINCT k, correct, pc FROM p) GROUP BY k)
  SELECT k, round(sum(p * log2(p / (pc * py))) / any_value(h), 9) AS rmi FROM p JOIN h USING (k) GROUP BY k"""
ORACLES["multi_threshold_dprime"] = "SELECT k, " + ", ".join(f"round({_d_prime(f'h{t}', 'r', f'a{t}', 'w')}, 9) AS d_prime_t{t}" for t in range(1, 6)) + f" FROM {_sums(ORDERS, range(1, 6))}"
ORACLES["graded_dprime"] = f"SELECT k, round({_d_prime('h2', 'r', 'a2', 'w')}, 9) AS d_prime FROM {_sums(EVENTS, [2])}"
ORACLES["calibration_error"] = f"SELECT k, round(ece, 9) AS ece FROM {_ece(ORDERS)}"
ORACLES["gamma"] = f"SELECT k, round({GAMMA}, 9) AS gamma FROM {_pairs(ORDERS)}"
ORACLES["kendall_tau"] = f"SELECT k, round({TAU}, 9) AS tau_b FROM {_pairs(EVENTS)}"
ORACLES["type2_auroc"] = f"SELECT k, round({AUROC}, 9) AS auroc FROM {_pairs(DOCS)}"
ORACLES["roc_points"] = f"SELECT a.k, a.t::BIGINT AS threshold, round(avg((b.grade >= a.t)::INT) FILTER (b.correct = 0), 9) AS fpr, round(avg((b.grade >= a.t)::INT) FILTER (b.correct = 1), 9) AS tpr FROM (SELECT DISTINCT k, grade AS t FROM {EVENTS}) a JOIN {EVENTS} b ON a.k = b.k GROUP BY a.k, a.t"
ORACLES["auroc_continuous"] = f"""WITH r AS (SELECT k, correct, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2.0 AS rank FROM {EVENTS}),
  s AS (SELECT k, sum(correct)::BIGINT AS r, sum(1 - correct)::BIGINT AS w, sum(rank) FILTER (correct = 1) AS u FROM r GROUP BY k)
  SELECT k, r AS right, w AS wrong, round((u - r * (r + 1) / 2.0) / (r::DOUBLE * w), 9) AS auroc FROM s"""
ORACLES["grade_distribution"] = "SELECT k, " + ", ".join(f"round(avg((grade = {g})::INT), 9) AS grade_{g}_ratio" for g in range(1, 6)) + f" FROM {ORDERS} GROUP BY k"
MEANS = f"(SELECT k, avg(grade) AS m, avg(grade) FILTER (correct = 1) AS a, avg(grade) FILTER (correct = 0) AS b, avg(correct) AS acc, avg(((grade >= 2) = (correct = 1))::INT) AS al, count(*) AS n FROM {EVENTS} GROUP BY k)"
ORACLES["grade_means"] = f"SELECT k, round(m, 9) AS mean_grade, round(a, 9) AS mean_grade_correct, round(b, 9) AS mean_grade_incorrect, round(a - b, 9) AS grade_separation FROM {MEANS}"
ORACLES["graded_bundle"] = f"""SELECT k, n, round(acc, 9) AS accuracy, round({GAMMA}, 9) AS gamma_correlation, round({TAU}, 9) AS kendall_tau, round(ece, 9) AS calibration_error, round({AUROC}, 9) AS type2_auroc, round(d1, 9) AS d_prime_t1, round(d3, 9) AS d_prime_t3, round(al, 9) AS meta_alignment
  FROM {MEANS} m JOIN {_pairs(EVENTS)} p USING (k) JOIN {_ece(EVENTS)} e USING (k) JOIN (SELECT k, {_d_prime('h1', 'r', 'a1', 'w')} AS d1, {_d_prime('h3', 'r', 'a3', 'w')} AS d3 FROM {_sums(EVENTS, [1, 3])}) d USING (k)"""
ORACLES["parsed_metrics"] = f"""SELECT k, round(d, 9) AS d_prime_type2, round(al, 9) AS meta_alignment, round(ga, 9) AS gamma_correlation, round(m, 9) AS mean_grade
  FROM (SELECT k, {_d_prime('h3', 'r', 'a3', 'w')} AS d FROM {_sums(ORDERS, [3])}) JOIN (SELECT k, {GAMMA} AS ga FROM {_pairs(ORDERS)}) USING (k) JOIN (SELECT k, avg(grade) AS m, avg(((grade >= 3) = (correct = 1))::INT) AS al FROM {ORDERS} GROUP BY k) USING (k)"""
ORACLES["sharded_gamma"] = f"SELECT k, round(avg(x), 9) AS gamma FROM (SELECT k, s, {GAMMA} AS x FROM {_pairs(f'(SELECT *, id % 4 AS s FROM {ORDERS})', 'k, s')}) GROUP BY k"
ORACLES["ignoring_mean"] = f"SELECT k, round(avg(1 - correct) FILTER (yes = 1), 9) AS mean FROM {BINARY} GROUP BY k"
CONFIDENCE = "list_sum(list_transform([0, 1, 2, 3], lambda i: i * exp(g[i + 1]))) / list_sum(list_transform(g, lambda x: exp(x))) / 3"
ORACLES["logit_confidence"] = f"SELECT vec_id, round({CONFIDENCE}, 9) AS confidence FROM {LOGITS}"
ORACLES["yes_no_confidence"] = f"SELECT vec_id, round(exp(y - n), 9) AS yes_over_no, round(1 - 1 / (exp(y - n) + 1), 9) AS confidence, CASE WHEN y > n THEN 'Yes' ELSE 'No' END AS meta_answer FROM {LOGITS}"
CONFIDENT = f"(SELECT label::BIGINT AS label, vec_id % 2 AS correct, vec_id % 4 AS grade, {CONFIDENCE} AS x FROM {LOGITS})"
ORACLES["verbal_logit_pearson"] = f"SELECT label, round(coalesce(corr(grade / 3.0, x), 0.0), 8) AS pearson FROM {CONFIDENT} GROUP BY label"
ORACLES["logit_means"] = f"SELECT label, round(avg(x), 9) AS logit_mean_confidence, round(coalesce(avg(x) FILTER (correct = 1), 0.0), 9) AS logit_mean_confidence_correct, round(coalesce(avg(x) FILTER (correct = 0), 0.0), 9) AS logit_mean_confidence_incorrect FROM {CONFIDENT} GROUP BY label"
ORACLES["option_tokens"] = "SELECT DISTINCT c::BIGINT AS grade, ascii(c)::VARCHAR AS token_ids FROM (SELECT unnest(string_split(o_orderpriority, '')) AS c FROM orders) WHERE c IN ('1', '2', '3', '4', '5')"
ORACLES["rewards_binary"] = f"SELECT k, sum(correct)::BIGINT AS correct, sum((correct = yes)::INT)::BIGINT AS alignment, sum(CASE WHEN correct = 1 AND yes = 1 THEN 2 WHEN correct = 0 AND yes = 1 THEN 0 ELSE 1 END)::BIGINT AS combined FROM {BINARY} GROUP BY k"
ORACLES["rewards_graded"] = " UNION ALL ".join(f"SELECT id, '{n}' AS kind, round(1 + (2 * correct - 1) * (grade - {low}) / {span}.0, 9) AS reward FROM {view}" for n, view, low, span in (("graded", EVENTS, 0, 3), ("graded_fok", ORDERS, 1, 4), ("graded_numeric", ORDERS, 1, 9)))
ORACLES["rewards_quadratic"] = f"SELECT id, round(2 * (1 - pow(grade / 3.0 - correct, 2)), 9) AS reward FROM {EVENTS}"
ORACLES["seed_rewards_zscore"] = f"""WITH p AS (SELECT k AS iteration, l_partkey % 32 AS seed, avg(correct + (correct = yes)::INT) AS reward FROM {BINARY} GROUP BY ALL)
  SELECT iteration, seed, round(reward, 9) AS reward, round((reward - avg(reward) OVER (PARTITION BY iteration)) / (stddev_samp(reward) OVER (PARTITION BY iteration) + 1e-8), 6) AS z FROM p"""
TRIALS = f"(SELECT 'm' || id % 3 AS model, 'd' || k % 4 AS dataset, 'fok' AS meta_type, correct, grade FROM {ORDERS})"
BY = "model, dataset, meta_type"
LONG = f"""(SELECT {BY}, 'accuracy' AS metric, avg(correct) AS value FROM {TRIALS} GROUP BY ALL UNION ALL SELECT {BY}, 'mean_grade', avg(grade) FROM {TRIALS} GROUP BY ALL
  UNION ALL SELECT {BY}, 'gamma_correlation', {GAMMA} FROM {_pairs(TRIALS, BY)} UNION ALL SELECT {BY}, 'type2_auroc', {AUROC} FROM {_pairs(TRIALS, BY)})"""
ORACLES["transfer_matrix"] = f"SELECT {BY}, metric, round(value, 9) AS value FROM {LONG}"
ORACLES["baseline_delta"] = f"SELECT a.model, a.dataset, a.meta_type, a.metric, round(b.value, 9) AS baseline, round(a.value, 9) AS value, round(a.value - b.value, 9) AS delta FROM {LONG} a JOIN {LONG} b USING (dataset, meta_type, metric) WHERE b.model = 'm0' AND a.model <> 'm0' AND metric IN ('accuracy', 'mean_grade')"
MODELS = f"(SELECT *, 'm' || id % 2 AS m, score / 200 AS x FROM {EVENTS})"
RANKS = f"(SELECT m, k, correct, rank() OVER (PARTITION BY m, k ORDER BY x) + (count(*) OVER (PARTITION BY m, k, x) - 1) / 2.0 AS rank FROM {MODELS})"
_MEAN = lambda probe, metric, of: f"SELECT m AS model, k AS dataset, '{probe}' AS meta_type, '{metric}' AS metric, round({of}, 8) AS value FROM {MODELS} GROUP BY m, k"
ORACLES["transfer_results"] = " UNION ALL ".join(
    [
        _MEAN("binary", "accuracy", "avg(correct)"),
        _MEAN("graded", "accuracy", "avg(correct)"),
        _MEAN("binary", "yes_rate", "avg((grade >= 2)::INT)"),
        _MEAN("binary", "yes_failure_ratio", "coalesce(avg(1 - correct) FILTER (grade >= 2), 0.0)"),
        _MEAN("graded", "mean_grade", "avg(grade)"),
        _MEAN("graded", "logit_mean_confidence", "avg(x)"),
        f"SELECT m, k, 'graded', 'gamma_correlation', round({GAMMA}, 8) FROM {_pairs(MODELS, 'm, k')}",
        f"SELECT m, k, 'graded', 'logit_type2_auroc', round((sum(rank) FILTER (correct = 1) - sum(correct) * (sum(correct) + 1) / 2.0) / (sum(correct)::DOUBLE * sum(1 - correct)), 8) FROM {RANKS} GROUP BY m, k",
    ]
)
ORACLES["run_product"] = "SELECT r_name, n_name FROM (SELECT DISTINCT r_name FROM region), (SELECT DISTINCT n_name FROM nation)"
PRICE = " UNION ALL ".join(f"SELECT {i} AS o, '{m}' AS m, {a}::DOUBLE AS a, {b}::DOUBLE AS b" for i, (m, a, b) in enumerate(PRICES))
ORACLES["api_cost"] = f"""WITH u AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'gpt-5.2-2025-12-11' WHEN 1 THEN 'gemini-3-flash' ELSE 'unlisted' END AS model, sum(length(text))::BIGINT AS p, sum(turn + 1)::BIGINT AS c FROM conversations GROUP BY ALL), l AS ({PRICE}),
  j AS (SELECT u.*, (SELECT a FROM l WHERE contains(u.model, l.m) OR contains(l.m, u.model) ORDER BY o LIMIT 1) AS a, (SELECT b FROM l WHERE contains(u.model, l.m) OR contains(l.m, u.model) ORDER BY o LIMIT 1) AS b FROM u)
  SELECT model, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, round(p / 1e6 * a, 9) AS input_cost, round(c / 1e6 * b, 9) AS output_cost, round(p / 1e6 * a + c / 1e6 * b, 9) AS total_cost FROM j"""
DELTA = f"(SELECT name, pos, value AS base, value * (1 + pos % 5 * 0.25) - value AS value FROM {WEIGHTS})"
KTH = f"(SELECT abs(value) AS t FROM {DELTA} ORDER BY abs(value) LIMIT 1 OFFSET (SELECT greatest(floor(count(*) * (1 - 0.3))::BIGINT, 1) - 1 FROM {DELTA}))"
ORACLES["weight_delta"] = f"SELECT name, pos, round(value, 9) AS value FROM {DELTA}"
ORACLES["magnitude_prune"] = f"SELECT name, pos, round(CASE WHEN abs(value) < t THEN 0.0 ELSE value END, 9) AS value FROM {DELTA}, {KTH}"
ORACLES["magnitude_prune_bottom"] = f"SELECT name, pos, round(CASE WHEN abs(value) < t THEN value ELSE 0.0 END, 9) AS value FROM {DELTA}, {KTH} WHERE NOT starts_with(name, '3/')"
ORACLES["apply_delta"] = f"SELECT name, pos, round(base + CASE WHEN starts_with(name, '7/') OR abs(value) < t THEN 0.0 ELSE value END, 9) AS value FROM {DELTA}, {KTH}"
PADDED = f"(SELECT *, max(len(ids)) OVER (PARTITION BY batch) - len(ids) AS gap FROM {TOKENS})"
ORACLES["left_pad"] = f"SELECT item_id, {_joined('list_concat(list_transform(range(gap), lambda x: 0), ids)')} AS ids, {_joined('list_concat(list_transform(range(gap), lambda x: 0), list_transform(ids, lambda x: 1))')} AS mask FROM {PADDED}"
ORACLES["tuning_batch"] = f"SELECT item_id, {_joined('list_concat(list_transform(range(gap), lambda x: 2), ids)')} AS ids, {_joined('list_concat(list_transform(range(gap), lambda x: -100), ids)')} AS labels FROM {PADDED}"
ORACLES["select_meta"] = f"""SELECT item_id, {_joined('s')} AS ids, {_joined('list_transform(s, lambda x: CASE WHEN x = 2 THEN -100 ELSE x END)')} AS labels FROM
  (SELECT item_id, list_concat(list_transform(range(w - len(p)), lambda x: 2), p) AS s FROM (SELECT item_id, CASE WHEN item_id % 2 = 1 THEN ids[3:6] ELSE ids[1:5] END AS p, max(greatest(len(ids[1:5]), len(ids[3:6]))) OVER (PARTITION BY batch) AS w FROM {TOKENS}))"""
ORACLES["shifted_token_accuracy"] = f"SELECT item_id, len(list_filter(ids[3:], lambda x: x = 4))::BIGINT AS matches, len(ids[3:])::BIGINT AS counted, len(ids[3:])::BIGINT AS valid FROM {TOKENS}"
ORACLES["token_weighted_loss"] = "SELECT k, round(l, 9) AS loss, round(exp(l), 9) AS perplexity, round(a, 9) AS accuracy FROM (SELECT l_returnflag AS k, sum(l_discount * l_quantity::BIGINT) / sum(l_quantity::BIGINT) AS l, sum(l_quantity::BIGINT % 7)::DOUBLE / sum(l_quantity::BIGINT) AS a FROM lineitem GROUP BY ALL)"
ORACLES["warmup_schedule"] = "SELECT n_nationkey::BIGINT AS n_nationkey, round(CASE WHEN n_nationkey < 7 THEN n_nationkey / 7.0 ELSE greatest(0.0, (24 - n_nationkey) / 17.0) END, 9) AS rate, (n_nationkey % 7)::BIGINT AS batch FROM nation"
ORACLES["running_best"] = "SELECT a.o_orderkey, (NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.o_totalprice <= a.o_totalprice))::BIGINT AS best FROM orders a"
ORACLES["entity_split"] = "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) WHERE i < n // 2)"
LANG = "['en', 'ko', 'zh_cn', 'es', 'de'][conv_id % 5 + 1]"
ORACLES["prompt_build"] = f"SELECT conv_id, turn, {_language(prompts.DIRECT, LANG)} AS direct_prompt, {_language(prompts.BINARY, LANG)} AS meta_prompt, {_fill(prompts.META['graded'], 'question')} AS graded_prompt FROM {TURNS}"
ORACLES["jol_prompt"] = f"SELECT conv_id || '/' || turn AS question_id, {_fill(prompts.META['jol'], 'question', chr(40) + 'CASE WHEN conv_id % 2 = 0 THEN answer ELSE chr(32)[1:0] END' + chr(41))} AS meta_prompt FROM {TURNS}"
ORACLES["chat_render"] = f"SELECT conv_id, turn, '<user>' || question || '</user><assistant>' AS chat FROM {TURNS}"
ORACLES["mmlu_format"] = f"""SELECT 'mmlu_' || doc_id AS question_id, {_quote(CHOICE_INSTRUCTION)} || w[1] || chr(10) || 'A) ' || w[2] || chr(10) || 'B) ' || w[3] || chr(10) || 'C) ' || w[4] || chr(10) || 'D) ' || w[5] AS question, ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS answer, CASE WHEN lang <> 'en' THEN lang ELSE 'unknown' END AS subject
  FROM (SELECT doc_id, lang, string_split(text, ' ') AS w FROM documents) WHERE len(w) >= 5"""
ORACLES["gsm8k_gold"] = "SELECT 'gsm8k_' || o_orderkey AS question_id, CASE WHEN contains(g, ',') THEN g || '|' || replace(g, ',', '') ELSE g END AS answers FROM (SELECT o_orderkey, format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS g FROM orders) WHERE o_orderkey % 7 <> 0"
ORACLES["dedupe_aliases"] = "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) > 1))), '|') AS answers FROM benchmark"
ORACLES["text_normalize"] = f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(text), {_quote(PUNCTUATION)}, ''), '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g'), '(^|[^\\p{{L}}\\p{{N}}_])(a|an|the)($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\3', 'g'), '\\s+', ' ', 'g'), '  +', ' ', 'g')) AS text FROM documents"
ORACLES["limit_offset"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100"
ORACLES["contingency_cube"] = f"SELECT k, grade::BIGINT AS grade, sum(correct)::BIGINT AS right, count(*) AS n FROM {EVENTS} GROUP BY CUBE (k, grade)"


def _philox_sql(rows: str) -> str:
    """CTEs r0 to r10 and g (columns of rows, noise) from rows (name, pos, seed, ...), a CTE for each round."""
    word = lambda x: f"({x})::UBIGINT"
    parts = [f"r0 AS (SELECT *, {word('(pos // 4) & 4294967295')} AS a, {word('(pos // 4) >> 32')} AS b, ('0x' || substr(md5(name), 1, 8))::UBIGINT AS c, ('0x' || substr(md5(name), 9, 8))::UBIGINT AS d, {word('seed & 4294967295')} AS k0, {word('(seed >> 32) & 4294967295')} AS k1 FROM {rows})"]
    m0, m1 = (f"{m}::UBIGINT" for m in philox.MULTIPLIERS)
    for i in range(philox.ROUNDS):
        parts.append(f"r{i + 1} AS (SELECT * EXCLUDE (a, b, c, d, k0, k1), xor(xor((c * {m1}) >> 32, b), k0) AS a, (c * {m1}) & 4294967295::UBIGINT AS b, xor(xor((a * {m0}) >> 32, d), k1) AS c, (a * {m0}) & 4294967295::UBIGINT AS d, (k0 + {philox.STEPS[0]}::UBIGINT) & 4294967295::UBIGINT AS k0, (k1 + {philox.STEPS[1]}::UBIGINT) & 4294967295::UBIGINT AS k1 FROM r{i})")
    unit = lambda x: f"(({x}::DOUBLE + 0.5) / 4294967296.0::DOUBLE)"
    pick = lambda x, y: f"(CASE WHEN pos % 4 < 2 THEN {unit(x)} ELSE {unit(y)} END)"
    angle = f"2 * pi() * {pick('b', 'd')}"
    parts.append(f"g AS (SELECT * EXCLUDE (a, b, c, d, k0, k1), sqrt(-2 * ln({pick('a', 'c')})) * CASE WHEN pos % 2 = 0 THEN cos({angle}) ELSE sin({angle}) END AS noise FROM r{philox.ROUNDS})")
    return ", ".join(parts)


ORACLES["evolution_noise"] = f"WITH s AS (SELECT name, pos, unnest([0, 7, 1099511627776]::BIGINT[]) AS seed FROM {WEIGHTS}), {_philox_sql('s')} SELECT name, pos, seed, round(noise, 7) AS noise FROM g"
ORACLES["evolution_update"] = f"""WITH p AS (SELECT l_partkey % 32 AS seed, avg(correct + (correct = yes)::INT) AS reward FROM {BINARY} WHERE k = 1 GROUP BY ALL),
  z AS (SELECT seed::BIGINT AS seed, (reward - avg(reward) OVER ()) / (stddev_samp(reward) OVER () + 1e-8) AS z, count(*) OVER () AS n FROM p),
  s AS (SELECT w.name, w.pos, w.value, z.seed, z.z, z.n FROM {WEIGHTS} w, z), {_philox_sql('s')}
  SELECT name, pos, round(any_value(value) + sum(noise * z * 0.1 / n), 7) AS value FROM g GROUP BY name, pos"""
