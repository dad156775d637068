"""DuckDB/ANSI SQL equivalents of the registered queries (the oracle).

The CTE chain mirrors plans.flow: tx -> labelled -> feat -> split ->
scores.  Double outputs are rounded to 6 decimals (plus 0.0, which turns
-0.0 into 0.0) on both sides; money-like rounding uses floor(x*100+0.5)/100.
"""

from __future__ import annotations


def U(key: str, salt: str) -> str:
    """Keyed uniform in (0, 1), identical to functions.hashing.keyed_uniform."""
    return (f"((CAST(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8))"
            f" AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0)")


def RND(expr: str) -> str:
    """SQL twin of registry.round6."""
    x = f"CAST({expr} AS DOUBLE)"
    return (f"(CASE WHEN abs({x}) < 1e9 THEN floor(floor({x} * 1e9 + 0.5) / 1e9 * 1e6 + 0.5) / 1e6 "
            f"ELSE round({x}, 6) END + 0.0)")


def R(expr: str, alias: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {alias}"


def fix_rounding(sql: str) -> str:
    """Rewrite every `round(<expr>, 6) + 0.0` into RND(<expr>)."""
    out, i = [], 0
    while True:
        k = sql.find("round(", i)
        if k < 0:
            out.append(sql[i:])
            return "".join(out)
        if k > 0 and (sql[k - 1].isalnum() or sql[k - 1] == "_"):
            out.append(sql[i:k + 6])
            i = k + 6
            continue
        depth, j = 0, k + 5
        while True:
            ch = sql[j]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    break
            j += 1
        inner = sql[k + 6:j]
        tail = sql[j + 1:]
        if inner.rstrip().endswith(", 6") and tail.startswith(" + 0.0"):
            out.append(sql[i:k])
            out.append(RND(fix_rounding(inner.rstrip()[:-3])))
            i = j + 1 + len(" + 0.0")
        else:
            out.append(sql[i:k + 6])
            i = k + 6


def MONEY(expr: str) -> str:
    return f"(floor(({expr}) * 100.0 + 0.5) / 100.0)"


TX = """tx AS (
  SELECT CAST(event_id AS BIGINT) AS tx_id,
         CAST(user_id AS BIGINT) AS customer_id,
         CASE WHEN isnan(value) THEN NULL ELSE CAST(value AS DOUBLE) END AS transaction_amount,
         CAST(hour(ts) AS INTEGER) AS hour_of_day,
         CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
              WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS INTEGER) AS merchant_category,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS distance_from_home,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 90 THEN 1 ELSE 0 END
           AS is_international,
         0 AS is_fraud,
         CAST(ts AS TIMESTAMP) AS "timestamp"
  FROM events)"""

TX_COLS = ("tx_id, customer_id, transaction_amount, hour_of_day, day_of_week, merchant_category, "
           "distance_from_home, is_international, is_fraud, \"timestamp\"")

PROFILE = """prof AS (
  SELECT customer_id, avg(transaction_amount) AS avg_amount,
         coalesce(stddev_samp(transaction_amount), 0.0) AS std_amount,
         min(hour_of_day) AS active_hour_start, max(hour_of_day) AS active_hour_end
  FROM tx GROUP BY customer_id)"""

LABELLED = f"""sel AS (SELECT tx.*, {U('tx_id', 'sel')} AS u_sel FROM tx),
chosen AS (
  SELECT s.*, p.avg_amount, p.std_amount,
         CASE WHEN {U('s.tx_id', 'type')} < 0.4 THEN 'amount'
              WHEN {U('s.tx_id', 'type')} < 0.75 THEN 'geo' ELSE 'velocity' END AS v,
         sqrt(-2.0 * ln({U('s.tx_id', 'n1')})) * cos(2 * pi() * {U('s.tx_id', 'n2')}) AS z
  FROM sel s LEFT JOIN prof p ON s.customer_id = p.customer_id
  WHERE s.u_sel < 0.02),
labelled AS (
  SELECT {TX_COLS}, CAST(NULL AS VARCHAR) AS attack_vector
  FROM sel WHERE u_sel >= 0.02 OR tx_id IS NULL
  UNION ALL
  SELECT tx_id, customer_id,
    {MONEY("CASE v WHEN 'amount' THEN avg_amount * (5.0 + 15.0 * " + U('tx_id', 'amt') + ") "
           "WHEN 'geo' THEN greatest(0.01, 1.5 * avg_amount + std_amount * z) "
           "ELSE greatest(0.01, 2.0 * avg_amount + std_amount * z) END")} AS transaction_amount,
    CAST(CASE WHEN v = 'velocity' THEN floor(6.0 * {U('tx_id', 'hour')})
              ELSE floor(24.0 * {U('tx_id', 'hour')}) END AS INTEGER) AS hour_of_day,
    CAST(floor(7.0 * {U('tx_id', 'day')}) AS INTEGER) AS day_of_week,
    CAST(floor(15.0 * {U('tx_id', 'mc')}) AS INTEGER) AS merchant_category,
    {MONEY("CASE v WHEN 'amount' THEN 5.0 * " + U('tx_id', 'dist') +
           " WHEN 'geo' THEN 50.0 + 450.0 * " + U('tx_id', 'dist') +
           " ELSE 10.0 + 40.0 * " + U('tx_id', 'dist') + " END")} AS distance_from_home,
    CASE WHEN v = 'geo' AND {U('tx_id', 'intl')} > 0.5 THEN 1 ELSE 0 END AS is_international,
    1 AS is_fraud, "timestamp", v AS attack_vector
  FROM chosen)"""

W_CUST = 'PARTITION BY customer_id ORDER BY "timestamp", tx_id'

FEAT = f"""stats AS (
  SELECT customer_id, avg(transaction_amount) AS cust_mean,
         coalesce(stddev_samp(transaction_amount), 1.0) AS cust_std,
         quantile_cont(transaction_amount, 0.5) AS cust_median
  FROM labelled WHERE customer_id IS NOT NULL GROUP BY customer_id),
joined AS (
  SELECT l.*, s.cust_mean, s.cust_std, s.cust_median
  FROM labelled l LEFT JOIN stats s ON l.customer_id = s.customer_id),
gapped AS (
  SELECT *, coalesce(CAST(date_diff('microsecond', lag("timestamp") OVER ({W_CUST}), "timestamp")
                     AS DOUBLE) / 1000000.0, 9999.0) AS gap_seconds
  FROM joined),
feat0 AS (
  SELECT {TX_COLS},
    transaction_amount - cust_mean AS amount_deviation,
    CASE WHEN cust_std = 0 THEN NULL ELSE (transaction_amount - cust_mean) / cust_std END
      AS amount_zscore,
    transaction_amount / CASE WHEN cust_median = 0 THEN 1.0 ELSE cust_median END
      AS amount_to_median_ratio,
    CAST(sum(CASE WHEN gap_seconds < 3600 THEN 1 ELSE 0 END)
         OVER ({W_CUST} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_frequency_1h,
    CAST(sum(CASE WHEN gap_seconds < 86400 THEN 1 ELSE 0 END)
         OVER ({W_CUST} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS tx_frequency_24h,
    sin(2 * pi() * hour_of_day / 24.0) AS hour_sin,
    cos(2 * pi() * hour_of_day / 24.0) AS hour_cos,
    sin(2 * pi() * day_of_week / 7.0) AS day_sin,
    cos(2 * pi() * day_of_week / 7.0) AS day_cos,
    transaction_amount * distance_from_home AS amount_x_distance,
    transaction_amount * is_international AS amount_x_international
  FROM gapped),
feat AS (SELECT *, amount_zscore * tx_frequency_1h AS zscore_x_frequency FROM feat0)"""

SPLIT = """split AS (
  SELECT *, CASE WHEN pos < floor(n_rows * 0.8) THEN 1 ELSE 0 END AS is_train
  FROM (SELECT *, row_number() OVER (ORDER BY "timestamp", tx_id) - 1 AS pos,
               count(*) OVER () AS n_rows FROM feat))"""

SCORES = """scores AS (
  SELECT tx_id, 'zscore_rule' AS model, CAST(is_fraud AS INTEGER) AS label,
         coalesce(abs(amount_zscore), 0.0) AS score,
         CASE WHEN coalesce(abs(amount_zscore), 0.0) > 3.0 THEN 1 ELSE 0 END AS prediction
  FROM split WHERE is_train = 0
  UNION ALL
  SELECT tx_id, 'ratio_rule', CAST(is_fraud AS INTEGER),
         coalesce(abs(amount_to_median_ratio), 0.0),
         CASE WHEN coalesce(abs(amount_to_median_ratio), 0.0) > 5.0 THEN 1 ELSE 0 END
  FROM split WHERE is_train = 0)"""

CURVE = """per_score AS (
  SELECT model, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
  FROM scores WHERE score IS NOT NULL GROUP BY model, score),
curve AS (
  SELECT *, CAST(sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS BIGINT) AS tp,
            CAST(sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS BIGINT) AS fp,
            CAST(sum(pos) OVER (PARTITION BY model) AS BIGINT) AS n_pos,
            CAST(sum(neg) OVER (PARTITION BY model) AS BIGINT) AS n_neg
  FROM per_score)"""

CONF = """conf AS (
  SELECT model,
    CAST(count(*) FILTER (WHERE label = 0 AND prediction = 0) AS BIGINT) AS tn,
    CAST(count(*) FILTER (WHERE label = 0 AND prediction = 1) AS BIGINT) AS fp,
    CAST(count(*) FILTER (WHERE label = 1 AND prediction = 0) AS BIGINT) AS fn,
    CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS BIGINT) AS tp
  FROM scores GROUP BY model),
metrics AS (
  SELECT model,
    coalesce(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 0.0) AS accuracy,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
    coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1_score,
    tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
    CAST(fn AS DOUBLE) * 1000.0 + CAST(fp AS DOUBLE) * 50.0 AS total_cost
  FROM conf)"""

AUC = """auc AS (
  SELECT model,
    CASE WHEN max(n_pos) > 0 AND max(n_neg) > 0 THEN
      sum(CAST(neg AS DOUBLE) * CAST(2 * tp - pos AS DOUBLE))
      / (2.0 * CAST(max(n_pos) AS DOUBLE) * CAST(max(n_neg) AS DOUBLE)) END AS auc_roc,
    CASE WHEN max(n_pos) > 0 THEN
      sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE))
      / CAST(max(n_pos) AS DOUBLE) END AS auc_pr
  FROM curve GROUP BY model)"""

TOURNAMENT = """tour AS (
  SELECT m.model, accuracy, precision, recall, f1_score, a.auc_roc, a.auc_pr, total_cost,
         row_number() OVER (ORDER BY f1_score DESC, m.model) AS rank
  FROM metrics m LEFT JOIN auc a ON m.model = a.model)"""

OPTIMAL = """pts AS (
  SELECT model, score,
    coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS p,
    CASE WHEN n_pos = 0 THEN 1.0 ELSE coalesce(CAST(tp AS DOUBLE) / nullif(n_pos, 0), 0.0) END AS r
  FROM curve),
pts_f1 AS (SELECT *, 2.0 * (p * r) / (p + r + 1e-10) AS f1 FROM pts),
optimal AS (
  SELECT model, score AS optimal_threshold, f1 AS f1_at_optimal,
         p AS precision_at_optimal, r AS recall_at_optimal
  FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score ASC) AS rn
        FROM pts_f1) WHERE rn = 1)"""


def chain(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = (TX, PROFILE, LABELLED)
FEAT_CHAIN = BASE + (FEAT,)
SPLIT_CHAIN = FEAT_CHAIN + (SPLIT,)
SCORE_CHAIN = SPLIT_CHAIN + (SCORES,)

FEATURE_DOUBLES = ["transaction_amount", "distance_from_home", "amount_deviation",
                   "amount_zscore", "amount_to_median_ratio", "hour_sin", "hour_cos",
                   "day_sin", "day_cos", "amount_x_distance", "amount_x_international",
                   "zscore_x_frequency"]
FEATURE_OTHERS = ["tx_id", "customer_id", "hour_of_day", "day_of_week", "merchant_category",
                  "is_international", "is_fraud", '"timestamp"', "tx_frequency_1h",
                  "tx_frequency_24h"]


def select(others: list[str], doubles: list[str], source: str, where: str = "") -> str:
    cols = list(others) + [R(d, d) for d in doubles]
    w = f" WHERE {where}" if where else ""
    return f"SELECT {', '.join(cols)} FROM {source}{w}"
