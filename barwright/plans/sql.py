"""SQL of the shared tables, for the oracle statements: with_(name, ...) gives the WITH clause of these."""

from __future__ import annotations

W20 = 20
CTES = {
    "bars": ((), """SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, arg_min(px, row(l_orderkey, l_linenumber, px)) AS open, max(px) AS high, min(px) AS low,
  arg_max(px, row(l_orderkey, l_linenumber, px)) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_extendedprice / l_quantity AS px FROM lineitem) l JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "sess": (("bars",), "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS session_no FROM (SELECT DISTINCT date FROM bars)"),
    "feat": (("bars",), """SELECT *, close / nullif(lag(close, 1) OVER w, 0) - 1 AS ret_1d, close / nullif(lag(close, 5) OVER w, 0) - 1 AS ret_5d, close / nullif(lag(close, 21) OVER w, 0) - 1 AS ret_21d,
  avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol_avg_20,
  avg(close * volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS dollar_vol_avg_20,
  (high - low) / nullif(close, 0) AS range_pct FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""),
    "last": (("feat",), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM feat) WHERE rn <= 100"),
    "univ": ((), """SELECT s_name AS ticker, n_name AS name, r_name AS exchange, s_acctbal < 0 AS is_etf, s_suppkey % 17 = 0 AS is_test_issue, s_suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "samp": (("bars",), """SELECT substr(sha1(upper(ticker) || '|' || CAST(date AS VARCHAR) || '|' || setup), 1, 16) AS sample_id, ticker, date AS asof_date, setup, label FROM
  (SELECT ticker, date, CASE WHEN month(date) % 2 = 0 THEN 'flag' ELSE 'gap' END AS setup, close > open AS label FROM bars WHERE day(date) = 15)"""),
    "plan": (("samp", "sess"), """SELECT sample_id, ticker, asof_date, setup, label, d.date AS bar_date, d.session_no - (a.session_no - 19) AS t
  FROM samp JOIN sess a ON a.date = asof_date JOIN sess d ON d.session_no BETWEEN a.session_no - 19 AND a.session_no WHERE a.session_no >= 19"""),
    "win": (("plan", "bars"), """SELECT p.*, b.open, CASE WHEN bar_date <> asof_date THEN high END AS high, CASE WHEN bar_date <> asof_date THEN low END AS low,
  CASE WHEN bar_date <> asof_date THEN close END AS close, CASE WHEN bar_date <> asof_date THEN volume END AS volume
  FROM plan p LEFT JOIN bars b ON b.ticker = p.ticker AND b.date = p.bar_date"""),
    "plan60": (("samp", "sess"), """SELECT sample_id, ticker, asof_date, setup, label, d.date AS bar_date, d.session_no - (a.session_no - 59) AS t
  FROM samp JOIN sess a ON a.date = asof_date JOIN sess d ON d.session_no BETWEEN a.session_no - 59 AND a.session_no WHERE a.session_no >= 59"""),
    "win60": (("plan60", "bars"), """SELECT p.*, b.open, CASE WHEN bar_date <> asof_date THEN high END AS high, CASE WHEN bar_date <> asof_date THEN low END AS low,
  CASE WHEN bar_date <> asof_date THEN close END AS close, CASE WHEN bar_date <> asof_date THEN volume END AS volume
  FROM plan60 p LEFT JOIN bars b ON b.ticker = p.ticker AND b.date = p.bar_date"""),
    "ctx": (("samp", "sess", "bars"), """SELECT p.*, b.open, b.high, b.low, b.close, b.volume FROM (
  SELECT sample_id, s.ticker, asof_date, setup, label, d.date AS bar_date, CAST(d.session_no - a.session_no AS INTEGER) AS t_rel
  FROM samp s JOIN sess a ON a.date = asof_date JOIN sess d ON d.session_no BETWEEN a.session_no - 19 AND a.session_no + 5
  WHERE a.session_no >= 19 AND a.session_no + 5 <= (SELECT max(session_no) FROM sess)) p LEFT JOIN bars b ON b.ticker = p.ticker AND b.date = p.bar_date"""),
    "preds": ((), "SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang AS setup, quality AS y_true, (n_chars % 97) / 97.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)"),
}


def with_(*names: str, more: str = "", **own: str) -> str:
    """WITH clause of the named tables and what they need; `more` are further ones, as text, and `own` takes the place of
    tables of these names."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in CTES[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join([*(f"{n} AS ({own.get(n, CTES[n][1])})" for n in order), *([more] if more else [])]) + "\n"


def r(expr: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0"


def rs(*cols: str, places: int = 6, prefix: str = "") -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"round({prefix}{c}, {places}) + 0.0 AS {c}" for c in cols)
