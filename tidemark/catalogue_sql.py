"""SQL for the registered queries, from common table expressions over the star schema."""

from __future__ import annotations

CUT = "cut AS (SELECT unnest([DATE '1997-06-30', DATE '1999-01-31', DATE '2000-12-31']) AS cutoff)"


def _end(d: str, months: int) -> str:
    """The month end some months after d's month."""
    return f"last_day(CAST(date_trunc('month', {d}) + INTERVAL '{months}' MONTH AS DATE))"


def _days(later: str, earlier: str) -> str:
    return f"date_diff('day', {earlier}, {later})"


def _r(x: str, places: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {places})"


CTES = {
    "tx": """tx AS (SELECT CAST(o_custkey AS VARCHAR) AS msno, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS payment_method_id,
      CASE o_orderkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 180 WHEN 2 THEN 365 ELSE 540 END AS payment_plan_days, CAST(round(o_totalprice) AS BIGINT) AS plan_list_price,
      CASE WHEN o_orderkey % 7 = 0 THEN CAST(floor(CAST(round(o_totalprice) AS DOUBLE) * CAST(0.8 AS DOUBLE)) AS BIGINT) ELSE CAST(round(o_totalprice) AS BIGINT) END AS actual_amount_paid,
      CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_auto_renew, CAST(o_orderdate AS DATE) AS transaction_date,
      CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey % 4 WHEN 0 THEN 90 WHEN 1 THEN 180 WHEN 2 THEN 365 ELSE 540 END AS INTEGER) AS membership_expire_date,
      CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS is_cancel, o_orderkey AS tx_id FROM orders WHERE o_custkey IS NOT NULL)""",
    "members": """members AS (SELECT CAST(c_custkey AS VARCHAR) AS msno, CAST(c_nationkey AS BIGINT) AS city, CAST(floor(c_acctbal / 100) AS BIGINT) AS bd,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'male' WHEN 'MACHINERY' THEN 'female' ELSE 'unknown' END AS gender, c_custkey % 5 AS registered_via,
      DATE '1994-01-01' + CAST(c_custkey % 2500 AS INTEGER) AS registration_init_time FROM customer)""",
    "logs": """daily AS (SELECT CAST(o_custkey AS VARCHAR) AS msno, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS k, l_extendedprice AS total_secs
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    logs AS (SELECT msno, last_day(date) AS month_end, CAST(sum(q) AS BIGINT) AS num_25, CAST(sum(k) AS BIGINT) AS num_50, CAST(sum(q % 7) AS BIGINT) AS num_75, CAST(sum(k % 3) AS BIGINT) AS num_985,
      CAST(sum(q + k) AS BIGINT) AS num_100, CAST(sum(q % 11) AS BIGINT) AS num_unq, sum(greatest(CAST(0 AS DOUBLE), least(CAST(86400 AS DOUBLE), total_secs))) AS total_secs, count(DISTINCT date) AS days_active, max(date) AS last_date
      FROM daily GROUP BY msno, last_day(date))""",
    "last_tx": """last_tx AS (SELECT * FROM (SELECT cutoff, tx.*, row_number() OVER (PARTITION BY cutoff, msno ORDER BY transaction_date DESC, membership_expire_date DESC, tx_id DESC) AS rn
      FROM cut JOIN tx ON transaction_date <= cutoff) z WHERE rn = 1)""",
    "pop": f"pop AS (SELECT msno, cutoff, membership_expire_date AS expire_date FROM last_tx WHERE membership_expire_date > cutoff AND membership_expire_date <= {_end('cutoff', 1)})",
    "lab": """renewed AS (SELECT DISTINCT p.msno, p.cutoff FROM pop p JOIN tx t ON t.msno = p.msno WHERE t.is_cancel = 0 AND t.transaction_date > p.cutoff AND t.transaction_date <= p.expire_date + 30
      AND t.membership_expire_date > p.expire_date),
    lab AS (SELECT p.msno, p.cutoff, p.expire_date, CASE WHEN r.msno IS NULL THEN 1 ELSE 0 END AS is_churn FROM pop p LEFT JOIN renewed r ON r.msno = p.msno AND r.cutoff = p.cutoff)""",
}
_ZERO = lambda x: f"coalesce({x}, 0)"
CTES["feat"] = f"""paid AS (SELECT *, CASE WHEN {_days("transaction_date", "lag(membership_expire_date) OVER (PARTITION BY msno ORDER BY transaction_date, membership_expire_date, tx_id)")} > 30 THEN 1 ELSE 0 END AS lapsed
      FROM tx WHERE is_cancel = 0),
    lapses AS (SELECT cutoff, msno, sum(lapsed) AS n_lapses FROM cut JOIN paid ON transaction_date <= cutoff GROUP BY cutoff, msno),
    hist AS (SELECT cutoff, msno, count(*) AS n_tx, count(*) FILTER (WHERE transaction_date > cutoff - 180) AS n_tx_180d, sum(is_cancel) AS n_cancel, sum(CASE WHEN transaction_date > cutoff - 365 THEN is_cancel ELSE 0 END) AS n_cancel_365d,
      min(transaction_date) AS first, avg(is_auto_renew) AS auto_renew_share, count(DISTINCT payment_plan_days) AS n_plans, avg(actual_amount_paid) AS avg_paid FROM cut JOIN tx ON transaction_date <= cutoff GROUP BY cutoff, msno),
    heard AS (SELECT cutoff, msno, sum(CASE WHEN month_end = cutoff THEN days_active END) AS d1, sum(CASE WHEN month_end = cutoff THEN total_secs END) AS s1, sum(CASE WHEN month_end = cutoff THEN num_unq END) AS u1,
      sum(CASE WHEN month_end > {_end("cutoff", -3)} THEN days_active END) AS d3, sum(CASE WHEN month_end > {_end("cutoff", -3)} THEN total_secs END) AS s3, sum(CASE WHEN month_end > {_end("cutoff", -3)} THEN num_100 END) AS p3,
      sum(CASE WHEN month_end > {_end("cutoff", -3)} THEN num_25 + num_50 + num_75 + num_985 + num_100 END) AS all3, max(month_end) AS last_month FROM cut JOIN logs ON month_end <= cutoff GROUP BY cutoff, msno),
    base AS (SELECT p.msno, p.cutoff, p.expire_date, l.payment_plan_days AS plan_days, l.plan_list_price AS list_price, l.actual_amount_paid AS amount_paid, l.plan_list_price - l.actual_amount_paid AS discount,
      l.is_auto_renew AS auto_renew, l.is_cancel AS cancel_last, {_days("l.membership_expire_date", "p.cutoff")} AS days_to_expire, {_days("p.cutoff", "l.transaction_date")} AS days_since_last_tx,
      coalesce(CAST(l.payment_method_id AS VARCHAR), 'missing') AS payment_method, {_ZERO("h.n_tx")} AS n_tx, {_ZERO("h.n_tx_180d")} AS n_tx_180d, {_ZERO("h.n_cancel")} AS n_cancel, {_ZERO("h.n_cancel_365d")} AS n_cancel_365d,
      {_days("p.cutoff", "h.first")} AS tenure_days, h.auto_renew_share, h.n_plans, h.avg_paid, {_ZERO("s.n_lapses")} AS n_lapses, CASE WHEN m.bd BETWEEN 10 AND 80 THEN m.bd END AS age,
      {_days("p.cutoff", "m.registration_init_time")} AS reg_days, coalesce(CAST(m.city AS VARCHAR), 'missing') AS city, coalesce(CAST(m.registered_via AS VARCHAR), 'missing') AS registered_via, coalesce(m.gender, 'missing') AS gender,
      CAST({_ZERO("g.d1")} AS DOUBLE) / day(p.cutoff) AS days_active_m1, CAST({_ZERO("g.s1")} AS DOUBLE) / day(p.cutoff) AS secs_m1, CAST({_ZERO("g.u1")} AS DOUBLE) / day(p.cutoff) AS unique_songs_m1,
      CAST({_ZERO("g.d3")} AS DOUBLE) / {_days("p.cutoff", _end("p.cutoff", -3))} AS days_active_m3, CAST({_ZERO("g.s3")} AS DOUBLE) / {_days("p.cutoff", _end("p.cutoff", -3))} AS secs_m3,
      CAST(g.p3 AS DOUBLE) / nullif(g.all3, 0) AS completion_ratio, coalesce((year(p.cutoff) - year(g.last_month)) * 12 + month(p.cutoff) - month(g.last_month), 99) AS months_since_active
      FROM pop p LEFT JOIN last_tx l ON l.msno = p.msno AND l.cutoff = p.cutoff LEFT JOIN hist h ON h.msno = p.msno AND h.cutoff = p.cutoff LEFT JOIN lapses s ON s.msno = p.msno AND s.cutoff = p.cutoff
      LEFT JOIN members m ON m.msno = p.msno AND (m.registration_init_time IS NULL OR m.registration_init_time <= p.cutoff) LEFT JOIN heard g ON g.msno = p.msno AND g.cutoff = p.cutoff),
    feat AS (SELECT *, (days_active_m1 + 0.03) / (days_active_m3 + 0.03) AS activity_trend FROM base)"""
CTES["scored"] = """scored AS (SELECT f.*, b.is_churn, CAST(CAST(20 + 12 * (1 - auto_renew) + 25 * cancel_last + 4 * least(n_lapses, 5) + floor(least(days_since_last_tx, 300) / 10.0) AS BIGINT) AS DOUBLE) / 100 AS p
      FROM feat f JOIN lab b ON b.msno = f.msno AND b.cutoff = f.cutoff)"""
_FEATURES = ("tx", "members", "logs", "last_tx", "pop", "feat")
_SCORED = ("tx", "members", "logs", "last_tx", "pop", "lab", "feat", "scored")


def with_ctes(select: str, *names: str) -> str:
    return "WITH " + ",\n    ".join([CUT, *(CTES[n] for n in names)]) + "\n" + select


def scored(select: str, *more: str) -> str:
    return "WITH " + ",\n    ".join([CUT, *(CTES[n] for n in _SCORED), *more]) + "\n" + select


TEXT = {"payment_method", "city", "registered_via", "gender"}


def features(names: tuple[str, ...]) -> str:
    columns = ", ".join(n if n in TEXT else f"{_r(n)} AS {n}" for n in names)
    return with_ctes(f"SELECT msno, cutoff, {columns} FROM feat", *_FEATURES)


# --- calendar and cleaning ---------------------------------------------------------------------------------------

_NUMBER = lambda d: f"CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS BIGINT)"
MONTH_ENDS = f"SELECT d, last_day(d) AS month_end, {_end('d', 1)} AS next_end, {_end('d', -3)} AS end_3_before, {_NUMBER('d')} AS as_number FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_custkey IS NOT NULL) z"
_ENDS = "(SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS cutoff FROM orders WHERE o_custkey IS NOT NULL) z"
KNOWN_ON = f"SELECT cutoff, {_end('cutoff', 1)} + 30 AS known_on FROM {_ENDS}"
MATURE = f"SELECT cutoff, CAST(CASE WHEN (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_custkey IS NOT NULL) >= {_end('cutoff', 1)} + 30 THEN 1 ELSE 0 END AS BIGINT) AS mature FROM {_ENDS}"
ENDS_BETWEEN = """SELECT last_day(CAST(m AS DATE)) AS month_end FROM (SELECT unnest(generate_series(date_trunc('month', min(CAST(o_orderdate AS DATE))), date_trunc('month', max(CAST(o_orderdate AS DATE))), INTERVAL '1' MONTH)) AS m
  FROM orders WHERE o_custkey IS NOT NULL) z"""
CLEAN_TX = """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS msno, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS payment_method_id, CAST(30 AS BIGINT) AS payment_plan_days,
  CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 200 END AS plan_list_price, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 150 END AS actual_amount_paid, o_orderkey % 2 AS is_auto_renew,
  CAST(o_orderdate AS DATE) AS transaction_date, CAST(o_orderdate AS DATE) AS membership_expire_date, CAST(0 AS BIGINT) AS is_cancel
  FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey % 13 <> 0 AND o_orderkey % 19 <> 0"""
CLEAN_MEMBERS = """SELECT CAST(c_custkey AS VARCHAR) AS msno, CASE WHEN c_custkey % 3 = 0 THEN 99 ELSE CAST(c_nationkey AS BIGINT) END AS city, CAST(NULL AS BIGINT) AS bd,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'male' ELSE 'unknown' END AS gender, CAST(NULL AS BIGINT) AS registered_via, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '1995-01-31' END AS registration_init_time FROM customer"""
CLIP = with_ctes(
    f"SELECT msno, {_r('sum(greatest(CAST(0 AS DOUBLE), least(CAST(86400 AS DOUBLE), total_secs - 5000)))')} AS secs, count(*) FILTER (WHERE total_secs - 5000 > 86400) AS over, count(*) FILTER (WHERE total_secs < 5000) AS under FROM daily GROUP BY msno", "logs"
)
AGES = with_ctes("SELECT msno, CASE WHEN bd BETWEEN 10 AND 80 THEN bd END AS age, CASE WHEN bd > 0 AND bd < 90 THEN bd END AS age_a, CAST(CASE WHEN city = 5 THEN 1 ELSE 0 END AS DOUBLE) AS city_5 FROM members", "members")

# --- recipes -----------------------------------------------------------------------------------------------------

_SUMS = ("num_25", "num_50", "num_75", "num_985", "num_100", "num_unq", "total_secs")
_LAST = ("payment_method_id", "payment_plan_days", "plan_list_price", "actual_amount_paid", "is_auto_renew", "is_cancel")


def _mode(table: str, column: str, name: str) -> str:
    return f"{name} AS (SELECT cutoff, msno, v FROM (SELECT cutoff, msno, v, row_number() OVER (PARTITION BY cutoff, msno ORDER BY n DESC, v) AS rn FROM (SELECT cutoff, msno, {column} AS v, count(*) AS n FROM {table} GROUP BY cutoff, msno, {column}) a) b WHERE rn = 1)"


def recipe_ctes(key: str, published: bool, prefix: str = "") -> tuple[list[str], dict[str, str]]:
    """CTEs that end in <prefix>rec, and its feature columns."""
    s = prefix
    tx_on, logs_on, members_on = ("true", "true", "true") if published else ("transaction_date <= cutoff", "month_end <= cutoff", "(registration_init_time IS NULL OR registration_init_time <= cutoff)")
    ctes = [
        f"{s}vt AS (SELECT cutoff, tx.*, quarter(transaction_date) AS q FROM cut JOIN tx ON {tx_on})", f"{s}vl AS (SELECT cutoff, logs.* FROM cut JOIN logs ON {logs_on})", f"{s}vm AS (SELECT cutoff, members.* FROM cut JOIN members ON {members_on})",
        f"{s}lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cutoff, msno ORDER BY transaction_date DESC, membership_expire_date DESC, tx_id DESC) AS rn2 FROM {s}vt) z WHERE rn2 = 1)",
        f"{s}sl AS (SELECT cutoff, msno, sum(days_active) AS days, {', '.join(f'sum({c}) AS {c}' for c in _SUMS)} FROM {s}vl GROUP BY cutoff, msno)",
        f"{s}st AS (SELECT cutoff, msno, count(*) AS n, sum(actual_amount_paid) AS revenue, avg(is_auto_renew) AS auto_share, sum(is_cancel) AS cancels, max(transaction_date) AS last_day_tx FROM {s}vt GROUP BY cutoff, msno)",
    ]
    join = lambda t, a: f"LEFT JOIN {s}{t} {a} ON {a}.msno = p.msno AND {a}.cutoff = p.cutoff"
    male = "CASE WHEN m.gender = 'male' THEN 1 ELSE 0 END"
    if key == "A":
        ctes += [_mode(f"{s}vt", "payment_plan_days", f"{s}ma"), _mode(f"{s}vt", "payment_method_id", f"{s}mb"), _mode(f"{s}vt", "q", f"{s}mc")]
        columns = {
            "regist_trans": "t.n", "mode_plan_days": "ma.v", "mode_payment_method": "mb.v", "revenue": "t.revenue", "is_auto_renew": "t.auto_share", "regist_cancels": "t.cancels", "mode_quarter": "mc.v",
            "tenure": _days("t.last_day_tx", "m.registration_init_time"), **{f"avg_{c}": f"ln(1 + CAST(g.{c} AS DOUBLE) / nullif(g.days, 0))" for c in _SUMS}, "age": "CASE WHEN m.bd > 0 AND m.bd < 90 THEN m.bd END", "city": "m.city", "gender_male": male,
        }
        joins = [join("ma", "ma"), join("mb", "mb"), join("mc", "mc")]
    elif key == "B":
        columns = {**{c: f"l.{c}" for c in _LAST}, "transaction_date": _NUMBER("l.transaction_date"), "membership_expire_date": _NUMBER("l.membership_expire_date"), "city": "m.city", "bd": "m.bd", "gender_male": male, "registered_via": "m.registered_via", "registration_init_time": _NUMBER("m.registration_init_time")}
        joins = []
    else:
        columns = {
            "trans_count": "coalesce(t.n, 0)", **{c: f"l.{c}" for c in _LAST}, "transaction_date": _NUMBER("l.transaction_date"), "membership_expire_date": _NUMBER("l.membership_expire_date"), "logs_count": "coalesce(g.days, 0)", **{c: f"coalesce(g.{c}, 0)" for c in _SUMS},
            "bd": "m.bd", "registration_init_time": _NUMBER("m.registration_init_time"), **{f"city_{v}": f"CASE WHEN m.city = {v} THEN 1 ELSE 0 END" for v in (1, 4, 5, 13, 22)},
            **{f"registered_via_{v}": f"CASE WHEN m.registered_via = {v} THEN 1 ELSE 0 END" for v in (3, 4, 7, 9)}, "gender_male": male,
        }
        joins = []
    select = ", ".join(f"CAST({x} AS DOUBLE) AS {name}" for name, x in columns.items())
    ctes.append(f"{s}rec AS (SELECT p.msno, p.cutoff, {select} FROM pop p {join('st', 't')} {join('lt', 'l')} {join('vm', 'm')} {join('sl', 'g')} {' '.join(joins)})")
    return ctes, columns


_RECIPE = ("tx", "members", "logs", "last_tx", "pop")


def recipe(key: str, published: bool) -> str:
    ctes, columns = recipe_ctes(key, published)
    return "WITH " + ",\n    ".join([CUT, *(CTES[n] for n in _RECIPE), *ctes]) + f"\nSELECT msno, cutoff, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM rec"


MODES = "WITH " + ",\n    ".join([CTES["tx"], "v AS (SELECT 1 AS cutoff, *, quarter(transaction_date) AS q FROM tx)", _mode("v", "payment_plan_days", "ma"), _mode("v", "payment_method_id", "mb"), _mode("v", "q", "mc")]) + (
    "\nSELECT ma.msno, CAST(ma.v AS BIGINT) AS mode_plan_days, CAST(mb.v AS BIGINT) AS mode_payment_method, CAST(mc.v AS BIGINT) AS mode_quarter FROM ma JOIN mb ON mb.msno = ma.msno JOIN mc ON mc.msno = ma.msno"
)

# --- leakage -----------------------------------------------------------------------------------------------------


def _pairs(key: str) -> list[str]:
    pub, columns = recipe_ctes(key, True, "a_")
    own, _ = recipe_ctes(key, False, "b_")
    union = " UNION ALL ".join(f"SELECT '{c}' AS feature, y.is_churn, x.{c} AS a, z.{c} AS b FROM a_rec x JOIN b_rec z ON z.msno = x.msno AND z.cutoff = x.cutoff JOIN lab y ON y.msno = x.msno AND y.cutoff = x.cutoff" for c in columns)
    return [CUT, *(CTES[n] for n in (*_RECIPE, "lab")), *pub, *own, f"pairs AS ({union})"]


_CHANGE = """change AS (SELECT feature, avg(CASE WHEN a IS NULL AND b IS NULL THEN 0.0 WHEN a IS NULL OR b IS NULL THEN 1.0 WHEN abs(a - b) <= 1e-8 + 1e-5 * abs(b) THEN 0.0 ELSE 1.0 END) AS changed_share,
    avg(CASE WHEN a IS NOT DISTINCT FROM b THEN 0.0 ELSE 1.0 END) AS changed_strict FROM pairs GROUP BY feature)"""


def _signal(values: str, name: str) -> list[str]:
    """values: a query of (feature, is_churn, x)."""
    n = name
    return [
        f"{n}v AS ({values})", f"{n}m AS (SELECT feature, median(x) AS mid, min(x) AS lo, max(x) AS hi FROM {n}v GROUP BY feature)",
        f"{n}f AS (SELECT v.feature, v.is_churn, coalesce(v.x, m.mid) AS x FROM {n}v v JOIN {n}m m ON m.feature = v.feature)",
        f"{n}d AS (SELECT feature, x, sum(is_churn) AS pos, sum(1 - is_churn) AS neg FROM {n}f GROUP BY feature, x)",
        f"{n}r AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY x) - neg AS below FROM {n}d)",
        f"{n}a AS (SELECT feature, CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (sum(pos) * sum(neg)) AS auc FROM {n}r GROUP BY feature)",
        f"{n}s AS (SELECT m.feature, CASE WHEN m.lo IS NULL OR m.lo = m.hi THEN 0.5 ELSE greatest(a.auc, 1 - a.auc) END AS signal FROM {n}m m LEFT JOIN {n}a a ON a.feature = m.feature)",
    ]


def changed(key: str) -> str:
    return "WITH " + ",\n    ".join([*_pairs(key), _CHANGE]) + f"\nSELECT feature, {_r('changed_share')} AS changed_share, {_r('changed_strict')} AS changed_strict FROM change"


def signal(key: str) -> str:
    return "WITH " + ",\n    ".join([*_pairs(key), *_signal("SELECT feature, is_churn, a AS x FROM pairs", "g_")]) + f"\nSELECT feature, {_r('signal', 4)} AS signal FROM g_s"


def leak_table(key: str) -> str:
    ctes = [*_pairs(key), _CHANGE, *_signal("SELECT feature, is_churn, a AS x FROM pairs", "u_"), *_signal("SELECT feature, is_churn, b AS x FROM pairs", "w_")]
    return "WITH " + ",\n    ".join(ctes) + f"""
SELECT c.feature, {_r('changed_share')} AS changed_share, {_r('changed_strict')} AS changed_strict, {_r('u.signal', 4)} AS signal_published, {_r('w.signal', 4)} AS signal_honest, CAST(CASE WHEN changed_share > 0.005 THEN 1 ELSE 0 END AS BIGINT) AS leaked
FROM change c JOIN u_s u ON u.feature = c.feature JOIN w_s w ON w.feature = c.feature"""


# --- metrics, models and money -----------------------------------------------------------------------------------

_BY_SCORE = "d AS (SELECT cutoff, p, sum(is_churn) AS pos, sum(1 - is_churn) AS neg FROM scored GROUP BY cutoff, p)"
_RANKED = "r AS (SELECT *, sum(neg) OVER (PARTITION BY cutoff ORDER BY p) - neg AS below, sum(pos) OVER (PARTITION BY cutoff ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY cutoff ORDER BY p DESC) AS fp FROM d)"
_BOTH = "CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN %s END"
AUC = scored(f"SELECT cutoff, {_r(_BOTH % 'CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (sum(pos) * sum(neg))')} AS auc FROM r GROUP BY cutoff", _BY_SCORE, _RANKED)
AP = scored(f"SELECT cutoff, {_r(_BOTH % 'sum(CAST(pos * tp AS DOUBLE) / (tp + fp)) / sum(pos)')} AS ap FROM r GROUP BY cutoff", _BY_SCORE, _RANKED)
_MIXED = "CASE WHEN max(is_churn) = 1 AND min(is_churn) = 0 THEN %s END"
_P = "greatest(1e-6, least(1 - 1e-6, p))"
LOSS = scored(f"""SELECT cutoff, count(*) AS n, {_r('avg(is_churn)')} AS churn_rate, {_r(_MIXED % f'-avg(CASE WHEN is_churn = 1 THEN ln({_P}) ELSE ln(1 - {_P}) END)')} AS log_loss, {_r(_MIXED % f'avg(({_P} - is_churn) * ({_P} - is_churn))')} AS brier FROM scored GROUP BY cutoff""")
_HARD = "h AS (SELECT cutoff, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE p >= 0.5 AND is_churn = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE p >= 0.5 AND is_churn = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE p < 0.5 AND is_churn = 1) AS DOUBLE) AS fn FROM scored GROUP BY cutoff)"
HARD = scored(f"SELECT cutoff, {_r('(n - fp - fn) / n')} AS accuracy, {_r('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {_r('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {_r('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall FROM h", _HARD)
_LAST_CUT = "DATE '2000-12-31'"
NOBODY = scored(f"SELECT msno, cutoff, (SELECT {_r('avg(is_churn)')} FROM scored WHERE cutoff < {_LAST_CUT}) AS p FROM scored WHERE cutoff = {_LAST_CUT}")
_GROUP = "CASE WHEN coalesce(auto_renew, 0) >= 1 THEN 0 ELSE 1 END + 2 * CASE WHEN coalesce(cancel_last, 0) >= 1 THEN 1 ELSE 0 END"
RULE = scored(
    f"SELECT s.msno, s.cutoff, {_r(f'coalesce(g.rate, (SELECT avg(is_churn) FROM scored WHERE cutoff < {_LAST_CUT}))')} AS p FROM (SELECT *, {_GROUP} AS grp FROM scored WHERE cutoff = {_LAST_CUT}) s LEFT JOIN g ON g.grp = s.grp",
    f"g AS (SELECT {_GROUP} AS grp, avg(is_churn) AS rate FROM scored WHERE cutoff < {_LAST_CUT} GROUP BY {_GROUP})",
)
KNN = """WITH e AS (SELECT vec_id, embedding, CAST(label % 2 AS DOUBLE) AS y FROM embeddings),
    d AS (SELECT a.vec_id, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS rn FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, round(avg(y), 6) AS p FROM d WHERE rn <= 27 GROUP BY vec_id"""
_SWEEP = "c AS (SELECT s.cutoff, CAST(i AS DOUBLE) / 100 AS threshold, count(*) FILTER (WHERE s.p >= CAST(i AS DOUBLE) / 100) AS offers, count(*) FILTER (WHERE s.p >= CAST(i AS DOUBLE) / 100 AND s.is_churn = 1) AS leavers_reached FROM scored s CROSS JOIN (SELECT unnest(generate_series(1, 99)) AS i) t GROUP BY s.cutoff, i)"
_SAVED = f"{_r('leavers_reached * 60.0 - offers * 5.0')} AS saved"
CURVE = scored(f"SELECT cutoff, {_r('threshold')} AS threshold, offers, leavers_reached, {_SAVED} FROM c", _SWEEP)
BEST = scored(f"SELECT cutoff, {_r('threshold')} AS threshold, {_SAVED}, offers, leavers_reached FROM (SELECT *, row_number() OVER (PARTITION BY cutoff ORDER BY leavers_reached * 60.0 - offers * 5.0 DESC, threshold) AS rn FROM c) z WHERE rn = 1", _SWEEP)
SAVINGS = scored(f"SELECT *, {_SAVED} FROM (SELECT cutoff, count(*) FILTER (WHERE p >= 0.5) AS offers, count(*) FILTER (WHERE p >= 0.5 AND is_churn = 1) AS leavers_reached FROM scored GROUP BY cutoff) z")
POLICY = scored(
    f"SELECT policy, offers, leavers_reached, {_SAVED} FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS policy, count(*) FILTER (WHERE {sent}) AS offers, count(*) FILTER (WHERE {sent} AND is_churn = 1) AS leavers_reached FROM scored" for name, sent in (("money_threshold", "p >= 0.09"), ("default_0_5", "p >= 0.5"), ("everyone", "true"), ("nobody", "false"))) + ") z"
)
_BANDED = "b AS (SELECT CAST(i AS BIGINT) AS band, CAST(coalesce(sum(is_churn), 0) AS BIGINT) AS leavers, CAST(coalesce(sum(1 - is_churn), 0) AS BIGINT) AS stayers FROM (SELECT unnest(generate_series(0, 99)) AS i) t LEFT JOIN scored s ON greatest(0, least(99, CAST(floor(s.p * 100) AS INTEGER))) = i GROUP BY i)"
BANDS = scored("SELECT band, leavers, stayers FROM b", _BANDED)
CALCULATOR = scored(f"SELECT {_r('band / 100.0')} AS threshold, CAST(offers AS BIGINT) AS offers, CAST(leavers_reached AS BIGINT) AS leavers_reached, {_SAVED} FROM (SELECT band, sum(leavers + stayers) OVER (ORDER BY band DESC) AS offers, sum(leavers) OVER (ORDER BY band DESC) AS leavers_reached FROM b) z", _BANDED)
GAIN = scored(f"SELECT msno, cutoff, {_r('p * 60 - 5')} AS gain, {_r('5.0 / 60.0')} AS break_even FROM scored")
OFFERS = scored(f"""SELECT substr(msno, 1, 12) AS customer, {_r('p', 3)} AS chance, {_r('p * 60 - 5', 2)} AS expected_gain_eur, expire_date AS expires, CAST(coalesce(auto_renew, 0) AS BIGINT) AS auto_renew, CAST(round(days_active_m1 * day(cutoff)) AS BIGINT) AS listening_days_last_month
FROM scored WHERE cutoff = {_LAST_CUT} AND p >= 0.3 ORDER BY {_r('p', 3)} DESC, msno LIMIT 200""")

# --- drift -------------------------------------------------------------------------------------------------------

_DRIFT = ("auto_renew", "amount_paid", "discount", "plan_days", "n_lapses", "days_active_m1", "secs_m1", "completion_ratio", "age")
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, cutoff, CAST(coalesce({f}, -1) AS DOUBLE) AS x FROM feat" for f in _DRIFT)
_FIRST = "DATE '1997-06-30'"


def _shares(name: str, cutoff: str) -> list[str]:
    return [
        f"{name}n AS (SELECT v.feature, len(list_filter(e.edges, lambda y: y <= v.x)) AS bin, count(*) AS n FROM vals v JOIN e ON e.feature = v.feature WHERE v.cutoff = {cutoff} GROUP BY 1, 2)",
        f"{name}t AS (SELECT feature, sum(n) AS total FROM {name}n GROUP BY feature)",
        f"{name}s AS (SELECT bins.feature, bins.bin, coalesce(CAST(n AS DOUBLE) / total, 0) AS share FROM bins LEFT JOIN {name}n ON {name}n.feature = bins.feature AND {name}n.bin = bins.bin LEFT JOIN {name}t ON {name}t.feature = bins.feature)",
    ]


_EDGES = [
    f"vals AS ({_LONG})", f"qs AS (SELECT feature, list_sort(list_distinct([{', '.join(f'round(quantile_cont(x, {i / 10}), 9)' for i in range(11))}])) AS d FROM vals WHERE cutoff = {_FIRST} GROUP BY feature)",
    "e AS (SELECT feature, CASE WHEN len(d) > 2 THEN list_slice(d, 2, len(d) - 1) ELSE CAST([] AS DOUBLE[]) END AS edges FROM qs)", "bins AS (SELECT feature, unnest(generate_series(0, len(edges))) AS bin FROM e)", *_shares("ref_", _FIRST),
]
_NUMERIC_PSI = [*_EDGES, *_shares("cur_", _LAST_CUT), "np AS (SELECT a.feature, round(sum((greatest(b.share, 1e-4) - greatest(a.share, 1e-4)) * ln(greatest(b.share, 1e-4) / greatest(a.share, 1e-4))), 4) AS psi FROM ref_s a JOIN cur_s b ON b.feature = a.feature AND b.bin = a.bin GROUP BY a.feature)"]
_CATEGORY_PSI = [
    f"ca AS (SELECT payment_method AS bin, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM feat WHERE cutoff = {_FIRST}) AS share FROM feat WHERE cutoff = {_FIRST} GROUP BY payment_method)",
    f"cb AS (SELECT payment_method AS bin, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM feat WHERE cutoff = {_LAST_CUT}) AS share FROM feat WHERE cutoff = {_LAST_CUT} GROUP BY payment_method)",
    "cp AS (SELECT 'payment_method' AS feature, round(sum((greatest(coalesce(b.share, 0), 1e-4) - greatest(coalesce(a.share, 0), 1e-4)) * ln(greatest(coalesce(b.share, 0), 1e-4) / greatest(coalesce(a.share, 0), 1e-4))), 4) AS psi FROM ca a FULL OUTER JOIN cb b ON b.bin = a.bin)",
]


def _over_features(select: str, more: list[str]) -> str:
    return "WITH " + ",\n    ".join([CUT, *(CTES[n] for n in _FEATURES), *more]) + "\n" + select


EDGES = _over_features(f'SELECT feature, CAST(bin AS BIGINT) AS bin, {_r("share")} AS share FROM ref_s', _EDGES)
PSI_NUMERIC = _over_features("SELECT feature, psi FROM np", _NUMERIC_PSI)
PSI_CATEGORY = _over_features("SELECT feature, psi FROM cp", _CATEGORY_PSI)
DRIFT = _over_features("SELECT feature, psi, CAST(CASE WHEN psi >= 0.2 THEN 1 ELSE 0 END AS BIGINT) AS warning FROM (SELECT * FROM np UNION ALL SELECT * FROM cp) z", [*_NUMERIC_PSI, *_CATEGORY_PSI])

# --- samples, audit, replay --------------------------------------------------------------------------------------


def _hash(key: str, seed: int) -> str:
    return f"((({key} % 2147483647) + {seed * 7919 + 1}) * 48271) % 2147483647"


SAMPLE = f"SELECT c_custkey FROM customer ORDER BY {_hash('c_custkey', 0)}, c_custkey LIMIT 100"
SPLIT = f"""SELECT o_orderkey, CAST(y AS BIGINT) AS y, CAST(CASE WHEN rn <= floor(total * CAST(0.7 AS DOUBLE)) THEN 1 ELSE 0 END AS BIGINT) AS is_train FROM (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY {_hash('o_orderkey', 42)}, o_orderkey) AS rn,
  count(*) OVER (PARTITION BY y) AS total FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS y FROM orders) a) b"""
OVERSAMPLE = """SELECT CAST(y AS BIGINT) AS y, CASE WHEN y = 1 THEN greatest((SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0), count(*)) ELSE count(*) END AS n, count(DISTINCT o_orderkey) AS keys
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS y FROM orders) a GROUP BY y"""
PROFILE = with_ctes("SELECT min(transaction_date) AS first_date, max(transaction_date) AS last_date, count(DISTINCT msno) AS n_users, count(*) AS n_transactions FROM tx", "tx")
_ENDS_ALL = "ends AS (SELECT DISTINCT last_day(CAST(m AS DATE)) AS c FROM (SELECT unnest(generate_series(DATE '1994-01-01', DATE '2002-12-01', INTERVAL '1' MONTH)) AS m) z)"
PICK = f"""WITH tx AS (SELECT max(CAST(o_orderdate AS DATE)) AS data_end FROM orders WHERE o_custkey IS NOT NULL), {_ENDS_ALL},
    test AS (SELECT max(c) AS c FROM ends, tx WHERE {_end('c', 1)} + 30 <= data_end), valid AS (SELECT max(e.c) AS c FROM ends e, test t WHERE {_end('e.c', 1)} + 30 <= t.c)
SELECT 'data_end' AS role, data_end AS cutoff FROM tx UNION ALL SELECT 'test', c FROM test UNION ALL SELECT 'valid', c FROM valid
UNION ALL SELECT concat('train_', CAST(i AS VARCHAR)), last_day(CAST(date_trunc('month', c) - CAST(4 - i AS INTEGER) * INTERVAL '1' MONTH AS DATE)) FROM valid CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS i) k"""

#: The rule model's replay: each month is scored by the rule fitted on the four months before its latest mature one, and that one.
REPLAY = ""


def replay_sql() -> str:
    months = "cut AS (SELECT last_day(CAST(m AS DATE)) AS cutoff FROM (SELECT unnest(generate_series(DATE '1997-01-01', DATE '1998-12-01', INTERVAL '1' MONTH)) AS m) z)"
    grp = "CASE WHEN is_auto_renew >= 1 THEN 0 ELSE 1 END + 2 * CASE WHEN is_cancel >= 1 THEN 1 ELSE 0 END"
    ctes = [
        months, CTES["tx"], CTES["last_tx"], CTES["pop"], CTES["lab"], f"g AS (SELECT b.cutoff, b.msno, b.is_churn, {grp} AS grp FROM lab b JOIN last_tx l ON l.msno = b.msno AND l.cutoff = b.cutoff)",
        f"ticks AS (SELECT t.cutoff AS today, max(c.cutoff) AS valid FROM cut t JOIN cut c ON {_end('c.cutoff', 1)} + 30 <= t.cutoff WHERE t.cutoff >= DATE '1998-01-31' GROUP BY t.cutoff)",
        f"pool AS (SELECT today, grp, is_churn FROM ticks JOIN g ON g.cutoff <= valid AND g.cutoff >= {_end('valid', -4)})", "rates AS (SELECT today, grp, avg(is_churn) AS rate FROM pool GROUP BY today, grp)", "overall AS (SELECT today, avg(is_churn) AS rate FROM pool GROUP BY today)",
        "s AS (SELECT g.cutoff, g.is_churn, coalesce(r.rate, o.rate) AS p FROM g JOIN overall o ON o.today = g.cutoff LEFT JOIN rates r ON r.today = g.cutoff AND r.grp = g.grp)",
    ]
    return "WITH " + ",\n    ".join(ctes) + f"\nSELECT cutoff, {_end('cutoff', 1)} + 30 AS answers_known_on, count(*) AS n_scored, {_r('sum(p)', 4)} AS expected_leavers, CAST(sum(is_churn) AS BIGINT) AS leavers FROM s GROUP BY cutoff"


REPLAY = replay_sql()
