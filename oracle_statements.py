"""The registered queries once more, as plain SQL over the given tables."""

from __future__ import annotations

N = 10
LONG_N = 60
SAMPLES = 100
SEED = 42
PRICES = ("open", "high", "low", "close")


def _r6(expr: str, name: str) -> str:
    """Six decimals, by the same steps as in Spark; minus zero becomes zero."""
    value = f"round({expr} * 1000000.0::DOUBLE) / 1000000.0::DOUBLE"
    return f"CASE WHEN {value} = 0 THEN 0.0 ELSE {value} END AS {name}"


def _bars(name: str = "bars", where: str = "true", unit: str = "month") -> str:
    at = "(l_shipdate, l_orderkey, l_linenumber, l_partkey)"
    return f"""{name} AS (
  SELECT l_suppkey AS sid, date_trunc('{unit}', l_shipdate)::TIMESTAMP AS datetime,
         arg_min(p, {at}) AS open, max(p) AS high, min(p) AS low,
         arg_max(p, {at}) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem WHERE {where}) t
  GROUP BY 1, 2)"""


BARS = _bars()

def _windows(n: int = N) -> str:
    return f"""windows AS (
  SELECT * FROM (
    SELECT sid, datetime AS begintime,
           lead(datetime, {n - 1}) OVER (PARTITION BY sid ORDER BY datetime) AS endtime,
           {n}::INTEGER AS period
    FROM bars) s
  WHERE endtime IS NOT NULL)"""


WINDOWS = _windows()

SAMPLE = f"""sample AS (
  SELECT w.* FROM windows w JOIN (SELECT sid, count(*) AS len FROM bars GROUP BY sid) c USING (sid)
  ORDER BY -ln((('0x' || substr(md5(concat_ws('|', w.sid,
             epoch_us(w.begintime), '{SEED}')), 1, 13))::BIGINT + 0.5)
             / 4503599627370496.0) / (len / (len - {N - 1})), sid, begintime, endtime
  LIMIT {SAMPLES})"""

PAIRS = """pairs AS (
  SELECT w.sid, w.begintime, w.endtime, b.datetime, b.open, b.high, b.low, b.close,
         row_number() OVER (PARTITION BY w.sid, w.begintime ORDER BY b.datetime) - 1 AS i
  FROM windows w JOIN bars b
    ON b.sid = w.sid AND b.datetime >= w.begintime AND b.datetime <= w.endtime)"""


def _scaled(normalize: str, prices: tuple[str, ...] = PRICES) -> str:
    if normalize == "mean":
        cells = [f"{c} / nullif(avg({c}) OVER (PARTITION BY sid, begintime), 0) AS {c}" for c in prices]
    else:
        cells = list(prices)
    return f"scaled AS (SELECT sid, begintime, endtime, i, {', '.join(cells)} FROM pairs)"


def _distance1(prices: tuple[str, ...] = PRICES) -> str:
    return f"""distance1 AS (
  SELECT a.sid, a.begintime, a.endtime, a.i, b.i AS j,
         sqrt({' + '.join(f'(a.{c} - b.{c}) * (a.{c} - b.{c})' for c in prices)}) AS d
  FROM scaled a JOIN scaled b ON a.sid = b.sid AND a.begintime = b.begintime)"""


DISTANCE1 = _distance1()

DISTANCE2 = """distance2 AS (
  SELECT a.sid, a.begintime, a.endtime, a.i, b.i AS j,
         sqrt(sum((a.d - b.d) * (a.d - b.d))) AS d
  FROM distance1 a JOIN distance1 b
    ON a.sid = b.sid AND a.begintime = b.begintime AND a.j = b.j
  GROUP BY 1, 2, 3, 4, 5)"""


def _centred(passes: int) -> str:
    return f"""centred AS (
  SELECT sid, begintime, endtime, i, j,
         d - avg(d) OVER (PARTITION BY sid, begintime, i)
           - avg(d) OVER (PARTITION BY sid, begintime, j)
           + avg(d) OVER (PARTITION BY sid, begintime) AS c
  FROM distance{passes})"""


FIRST = "first AS (SELECT sid, begintime FROM windows ORDER BY sid, begintime LIMIT 1)"

def _covs(n: int = N) -> str:
    return f"""pattern AS (SELECT c.i, c.j, c.c FROM centred c JOIN first f USING (sid, begintime)),
pattern_cov AS (SELECT sqrt(greatest(sum(c * c), 0)) / {n} AS cov_bb FROM pattern),
covs AS (
  SELECT c.sid, c.begintime, c.endtime,
         sqrt(greatest(sum(c.c * p.c), 0)) / {n} AS cov_ab,
         sqrt(greatest(sum(c.c * c.c), 0)) / {n} AS cov_aa
  FROM centred c JOIN pattern p USING (i, j) GROUP BY 1, 2, 3),
scores AS (
  SELECT sid, begintime, endtime, cov_ab, cov_aa, cov_bb,
         cov_ab / nullif(sqrt(cov_aa * cov_bb), 0) AS similarity
  FROM covs, pattern_cov)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _steps(normalize: str = "mean", passes: int = 2, n: int = N, prices: tuple[str, ...] = PRICES) -> list[str]:
    distances = [_distance1(prices), DISTANCE2][:passes]
    return [BARS, _windows(n), PAIRS, _scaled(normalize, prices), *distances, _centred(passes)]


def _scores(normalize: str = "mean", passes: int = 2, n: int = N, prices: tuple[str, ...] = PRICES) -> str:
    return _with(*_steps(normalize, passes, n, prices), FIRST, _covs(n))


def _wide(table: str, value: str, prefix: str) -> str:
    cells = [
        _r6(f"max({value}) FILTER (WHERE j = {j})", f"{prefix}{j}") for j in range(N)
    ]
    return f"SELECT sid, begintime, i, {', '.join(cells)} FROM {table} GROUP BY sid, begintime, i"


def statements() -> dict[str, str]:
    similarity = _scores() + f"SELECT sid, begintime, endtime, {_r6('similarity', 'similarity')} FROM scores"
    window_bars = _with(BARS, WINDOWS) + f"""
      SELECT w.sid, w.begintime, w.endtime, w.period, b.datetime, {', '.join('b.' + c for c in PRICES)}
      FROM windows w LEFT JOIN bars b
        ON b.sid = w.sid AND b.datetime >= w.begintime AND b.datetime <= w.endtime"""

    def hits(exclude: str, k: int) -> str:
        order = "similarity DESC, sid DESC, begintime DESC, endtime DESC"
        return _scores() + f"""
      SELECT rank, {_r6('similarity', 'similarity')}, sid, begintime, endtime FROM (
        SELECT *, (row_number() OVER (ORDER BY {order}))::INTEGER AS rank
        FROM scores WHERE similarity IS NOT NULL AND NOT isnan(similarity) AND {exclude}) t
      WHERE rank <= {k}"""

    def corr(normalize: str = "mean", passes: int = 2, **options) -> str:
        return _scores(normalize, passes, **options) + (
            f"SELECT sid, begintime, endtime, {_r6('similarity', 'similarity')} FROM scores"
        )

    delta = _with(
        BARS,
        _bars("returned", "l_returnflag = 'R'"),
        _bars("final", "l_linestatus = 'F'"),
        """delta AS (
  SELECT sid, (datetime + INTERVAL 1 MONTH)::TIMESTAMP AS datetime, open, high, low, close, volume, 1 AS seq
  FROM returned
  UNION ALL SELECT *, 2 AS seq FROM final),
fresh AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY sid, datetime ORDER BY seq DESC) AS rn FROM delta) d
  WHERE rn = 1),
merged AS (
  SELECT sid, datetime, open, high, low, close, volume FROM fresh
  UNION ALL
  SELECT sid, datetime, open, high, low, close, volume FROM bars b
  WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.sid = b.sid AND f.datetime = b.datetime))""",
    )
    return {
        "row_count": "SELECT count(*) AS n_rows FROM lineitem",
        "line_scan": (
            "SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), "
            "chr(13), chr(10)), chr(10))) AS value FROM documents"
        ),
        "bars_scan": _with(BARS) + "SELECT sid, datetime, open, high, low, close, volume FROM bars",
        "bars_by_sid": _with(BARS) + "SELECT sid, datetime, open, high, low, close FROM bars WHERE sid = 7",
        "bars_time_range": _with(BARS) + """
          SELECT sid::INTEGER AS sid, n_name AS "exchangeCD", datetime, open, high, low, close
          FROM bars JOIN supplier ON s_suppkey = sid JOIN nation ON n_nationkey = s_nationkey
          WHERE datetime >= TIMESTAMP '1996-01-01' AND datetime <= TIMESTAMP '1997-06-01'""",
        "bars_semi_sids": _with(BARS, WINDOWS, SAMPLE) + """
          SELECT sid, datetime, open, high, low, close FROM bars
          WHERE sid IN (SELECT sid FROM sample)""",
        "distinct_sids": _with(BARS) + "SELECT DISTINCT sid FROM bars",
        "sid_list": _with(BARS) + """
          SELECT sid // 32 AS block, string_agg(sid::VARCHAR, ',' ORDER BY sid) AS sids
          FROM (SELECT DISTINCT sid FROM bars) t GROUP BY 1""",
        "sid_series": _with(BARS) + """
          SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY datetime) - 1 AS pos,
                 datetime, open, high, low, close FROM bars""",
        "bars_shuffled": _with(BARS) + f"""
          SELECT sid, datetime, open, high, low, close, row_number() OVER (ORDER BY
                   ('0x' || substr(md5(concat_ws('|', sid, epoch_us(datetime), '{SEED}')), 1, 13))::BIGINT,
                   sid, datetime) - 1 AS place
          FROM bars""",
        "bars_union": _with(
            _bars("returned", "l_returnflag = 'R'"), _bars("kept", "l_returnflag <> 'R'")
        ) + "SELECT * FROM returned UNION ALL SELECT * FROM kept",
        "bars_upsert": delta + "SELECT * FROM merged",
        "bars_table": delta + """
          SELECT m.sid::INTEGER AS sid, n_name AS "exchangeCD", datetime, open, high, low, close,
                 open AS pre_close, volume
          FROM merged m JOIN supplier ON s_suppkey = m.sid JOIN nation ON n_nationkey = s_nationkey""",
        "bulk_load": "SELECT o_orderkey AS key, o_orderpriority AS value FROM orders",
        "csv_ingest": _with(BARS) + """
          SELECT b.sid::INTEGER AS sid, n_name AS "exchangeCD", datetime, open, high, low, close,
                 CASE WHEN volume > 30 THEN open END AS pre_close, volume
          FROM bars b JOIN supplier ON s_suppkey = b.sid JOIN nation ON n_nationkey = s_nationkey""",
        "csv_ingest_mixed": _with(BARS) + """
          SELECT b.sid::INTEGER AS sid, n_name AS "exchangeCD", datetime, open, high, low, close,
                 CASE WHEN volume > 30 THEN open END AS pre_close, volume
          FROM bars b JOIN supplier ON s_suppkey = b.sid JOIN nation ON n_nationkey = s_nationkey""",
        "time_parse": "SELECT l_orderkey, l_linenumber, "
        + ", ".join(f"l_shipdate::TIMESTAMP AS t{i}" for i in range(12)) + " FROM lineitem",
        **dict.fromkeys(("bars_import", "bars_bulk_load"), _with(BARS) + """
          SELECT b.sid::INTEGER AS sid, n_name AS "exchangeCD", datetime, open, high, low, close,
                 open AS pre_close, volume
          FROM bars b JOIN supplier ON s_suppkey = b.sid JOIN nation ON n_nationkey = s_nationkey"""),
        "windows_all": _with(BARS, WINDOWS) + "SELECT sid, begintime, endtime, period FROM windows",
        "windows_table": _with(BARS, WINDOWS) + "SELECT sid, begintime, endtime, period FROM windows",
        "namespace_windows": _with(BARS, WINDOWS)
        + "SELECT sid::INTEGER AS sid, begintime, endtime, period FROM windows",
        "windows_limit": _with(BARS, WINDOWS) + """
          SELECT sid, begintime, endtime, period FROM windows ORDER BY sid, begintime, endtime LIMIT 500""",
        "windows_indexed": _with(BARS, WINDOWS) + """
          SELECT sid, begintime, endtime, row_number() OVER (ORDER BY sid, begintime) - 1 AS sample_id
          FROM windows""",
        "windows_sample": _with(BARS, WINDOWS, SAMPLE) + "SELECT sid, begintime, endtime, period FROM sample",
        "pattern_split": _with(BARS, WINDOWS, FIRST) + """
          SELECT w.sid, w.begintime, w.endtime,
                 CASE WHEN f.sid IS NULL THEN 'sample' ELSE 'pattern' END AS part
          FROM windows w LEFT JOIN first f ON f.sid = w.sid AND f.begintime = w.begintime""",
        "window_bars": window_bars,
        "window_bars_grouped": window_bars,
        "window_matrix": _with(BARS, WINDOWS, PAIRS) + "SELECT sid, begintime, i, open, high, low, close FROM pairs",
        "window_mean": _with(BARS, WINDOWS, PAIRS) + f"""
          SELECT sid, begintime, {', '.join(_r6(f'sum({c} ORDER BY i) / count({c})', f'mean_{c}') for c in PRICES)}
          FROM pairs GROUP BY sid, begintime""",
        "window_stddev": _with(BARS, WINDOWS, PAIRS) + f"""
          SELECT sid, begintime, {', '.join(_r6(f'stddev_samp({c})', f'std_{c}') for c in PRICES)}
          FROM pairs GROUP BY sid, begintime""",
        "normalize": _with(BARS, WINDOWS, PAIRS, _scaled("mean")) + f"""
          SELECT sid, begintime, i, {', '.join(_r6(c, c) for c in PRICES)} FROM scaled""",
        "pair_distance": _with(BARS, WINDOWS, PAIRS, _scaled("mean"), DISTANCE1)
        + _wide("distance1", "d", "d"),
        "center_distance": _with(*_steps()) + _wide("centred", "c", "c"),
        "dist_cov": _scores() + f"""
          SELECT sid, begintime, endtime, {_r6('cov_ab', 'cov_ab')}, {_r6('cov_aa', 'cov_aa')}
          FROM scores""",
        "dist_corr": corr(),
        "dist_corr_raw": corr(normalize="none"),
        "dist_corr_textbook": corr(passes=1),
        "similarity": similarity,
        "similarity_grouped": similarity,
        "similarity_all": similarity,
        "similarity_samples": _scores() + f"""
          SELECT row_number() OVER (ORDER BY sid, begintime) - 1 AS sample_id, {_r6('similarity', 'similarity')}
          FROM scores""",
        "similarity_long_pattern": corr(passes=1, n=LONG_N),
        "similarity_close_only": corr(prices=("close",)),
        "topk": hits("true", 25),
        **dict.fromkeys(
            ("pattern_search", "pattern_search_every"),
            hits("(sid, begintime) <> (SELECT (sid, begintime) FROM first)", 10),
        ),
    }
