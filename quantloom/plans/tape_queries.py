"""Queries over the tape: scans, cleaning, audits, bars, joins, aggregates, sorts and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.frames import diff, full, frame, ratio, rolling, rounded
from quantloom.operators import bars as B
from quantloom.operators import cleaning as C
from quantloom.operators.asof import asof_backward, asof_forward
from quantloom.plans.registry import query
from quantloom.sources.tape import TICKS_SQL, table, ticks

BAR = 500.0
BARS_SQL = f"{TICKS_SQL},\n{B.volume_bars_sql(BAR)}"


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.volume_bars(ticks(spark, sf_dir), BAR)


def book_bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume bars of quotes, the bid size as volume, with all optional columns."""
    return B.volume_bars(B.order_flow(quotes(spark, sf_dir).drop("bar_id")).withColumn("vol", F.col("bid_size")), BAR)


@query("bar_volume_ohlc", f"WITH {BARS_SQL} SELECT * FROM bars")
def bar_volume_ohlc(spark, sf_dir):
    return bars_of(spark, sf_dir)


@query(
    "bar_volume_vwap",
    f"""WITH {BARS_SQL} SELECT series, bar_id, close, round(CASE WHEN count(close) OVER w >= 20 THEN
    close / nullif(sum(close * volume) OVER w / nullif(sum(volume) OVER w, 0), 0) - 1 END, 6) + 0.0 AS vwap_diff_20
    FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_id ROWS 19 PRECEDING)""",
)
def bar_volume_vwap(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    vwap = ratio(F.sum(F.col("close") * F.col("volume")).over(frame(20)), F.sum("volume").over(frame(20)))
    return b.select("series", "bar_id", "close", rounded(full(ratio("close", vwap) - 1, "close", frame(20), 20)).alias("vwap_diff_20"))


QUOTES_SQL = f"""{TICKS_SQL}, quotes AS (SELECT series, ts, seq, floor(mid / 10) * 10 AS bid, floor(mid / 10) * 10 + 10 + vol % 3 AS ask,
  vol AS bid_size, 100 - vol AS ask_size, CAST(floor(seq / 50) AS BIGINT) AS bar_id FROM ticks),
flow AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread, coalesce(
  (CASE WHEN bid > lag(bid) OVER w THEN bid_size WHEN bid = lag(bid) OVER w THEN bid_size - lag(bid_size) OVER w ELSE -lag(bid_size) OVER w END) -
  (CASE WHEN ask < lag(ask) OVER w THEN ask_size WHEN ask = lag(ask) OVER w THEN ask_size - lag(ask_size) OVER w ELSE -lag(ask_size) OVER w END), 0) AS ofi
  FROM quotes WINDOW w AS (PARTITION BY series ORDER BY ts, seq))"""


def quotes(spark, sf_dir):
    level = F.floor(F.col("mid") / 10).cast("double") * 10
    t = ticks(spark, sf_dir)
    return t.select("series", "ts", "seq", level.alias("bid"), (level + 10 + F.col("vol") % 3).alias("ask"), F.col("vol").alias("bid_size"), (100 - F.col("vol")).alias("ask_size"), F.floor(F.col("seq") / 50).cast("long").alias("bar_id"))


BOOK_SQL = f"""{QUOTES_SQL}, bs AS (SELECT *, bid_size AS vol, coalesce(sign(mid - lag(mid) OVER (PARTITION BY series ORDER BY ts, seq)), 0) * bid_size AS signed,
  CAST(floor(sum(bid_size) OVER (PARTITION BY series ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) / {BAR}) AS BIGINT) AS vb FROM flow),
book AS (SELECT series, vb AS bar_id, min(ts) AS time_start, max(ts) AS time_end, arg_min(mid, (ts, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (ts, seq)) AS close, sum(vol) AS volume,
  sum(signed) AS net_aggressor_vol, count(*) AS tick_count, sum(ofi) AS tick_ofi, avg(spread) AS tick_spread, avg(bid_size) AS avg_bid_size, avg(ask_size) AS avg_ask_size, avg(bid) AS avg_bid_price, avg(ask) AS avg_ask_price,
  CASE WHEN sum(vol) = 0 THEN 0.0 ELSE sum(signed) / sum(vol) END AS ticket_imbalance FROM bs GROUP BY series, vb)"""


@query("bar_optional_columns", f"WITH {BOOK_SQL} SELECT series, bar_id, close, volume, net_aggressor_vol, tick_ofi, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("tick_spread", "avg_bid_size", "avg_ask_size", "avg_bid_price", "avg_ask_price")) + " FROM book")
def bar_optional_columns(spark, sf_dir):
    return book_bars_of(spark, sf_dir).select("series", "bar_id", "close", "volume", "net_aggressor_vol", "tick_ofi", *[F.round(c, 6).alias(c) for c in ("tick_spread", "avg_bid_size", "avg_ask_size", "avg_bid_price", "avg_ask_price")])


@query("bar_order_flow", f"WITH {QUOTES_SQL} SELECT series, seq, mid, spread, ofi FROM flow")
def bar_order_flow(spark, sf_dir):
    return B.order_flow(quotes(spark, sf_dir)).select("series", "seq", "mid", "spread", "ofi")


@query(
    "bar_tick_stats",
    f"""WITH {QUOTES_SQL} SELECT series, bar_id, sum(ofi) AS tick_ofi, round(avg(spread), 6) AS tick_spread, round(stddev_samp(mid), 6) AS mid_std,
    arg_min(mid, (ts, seq)) AS mid_first, arg_max(mid, (ts, seq)) AS mid_last FROM flow GROUP BY series, bar_id""",
)
def bar_tick_stats(spark, sf_dir):
    return B.tick_stats(B.order_flow(quotes(spark, sf_dir))).withColumns({"tick_spread": F.round("tick_spread", 6), "mid_std": F.round("mid_std", 6)})


@query(
    "bar_time_1min",
    f"""WITH {TICKS_SQL} SELECT series, date_trunc('minute', ts) AS bar_start, arg_min(mid, (ts, seq)) AS open, max(mid) AS high, min(mid) AS low,
    arg_max(mid, (ts, seq)) AS close, sum(vol) AS volume FROM ticks GROUP BY series, date_trunc('minute', ts)""",
)
def bar_time_1min(spark, sf_dir):
    return B.time_bars(ticks(spark, sf_dir))


@query(
    "bar_grid_ffill",
    f"""WITH {TICKS_SQL}, l AS (SELECT series, date_trunc('hour', ts) AS t, arg_max(mid, (ts, seq)) AS last FROM ticks GROUP BY 1, 2),
    e AS (SELECT series, min(t) AS a, max(t) AS b FROM l GROUP BY 1), s AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM e)
    SELECT s.series, s.t, last_value(last IGNORE NULLS) OVER (PARTITION BY s.series ORDER BY s.t ROWS UNBOUNDED PRECEDING) AS price, last IS NULL AS was_gap
    FROM s LEFT JOIN l ON s.series = l.series AND s.t = l.t""",
)
def bar_grid_ffill(spark, sf_dir):
    return B.filled_grid(ticks(spark, sf_dir))


@query(
    "bar_start_shift",
    f"""WITH {TICKS_SQL}, m AS (SELECT DISTINCT series, date_trunc('minute', ts) AS ts FROM ticks),
    g AS (SELECT *, epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER w) / 1e6 AS gap, row_number() OVER w AS rn FROM m WINDOW w AS (PARTITION BY series ORDER BY ts)),
    f AS (SELECT series, quantile_cont(CASE WHEN rn <= 1000 THEN gap END, 0.5) AS median_gap, count(*) AS n FROM g GROUP BY series)
    SELECT m.series, m.ts, median_gap, median_gap BETWEEN 58 AND 62 AND n > 100 AS shifted,
    CASE WHEN median_gap BETWEEN 58 AND 62 AND n > 100 THEN m.ts + INTERVAL 60 SECOND ELSE m.ts END AS ts_end FROM m JOIN f USING (series)""",
)
def bar_start_shift(spark, sf_dir):
    m = B.time_bars(ticks(spark, sf_dir)).select("series", F.col("bar_start").alias("ts"))
    return B.bar_end_times(m)


@query("src_full_row_dedup", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def src_full_row_dedup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").dropDuplicates()


@query(
    "op_clean_prices",
    f"""WITH {TICKS_SQL}, c AS (SELECT series, seq, mid, abs(mid / nullif(lag(mid) OVER (PARTITION BY series ORDER BY ts, seq), 0) - 1) AS change FROM ticks WHERE mid > 0)
    SELECT series, seq, mid, round(change, 6) AS change FROM c WHERE coalesce(change <= 0.5, true)""",
)
def op_clean_prices(spark, sf_dir):
    return C.drop_jumps(ticks(spark, sf_dir), 0.5).select("series", "seq", "mid", F.round("change", 6).alias("change"))


@query(
    "op_keyed_dedup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS n FROM lineitem) WHERE n = 1""",
)
def op_keyed_dedup(spark, sf_dir):
    order = [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return C.keep_one(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "op_gap_finder",
    f"""WITH {TICKS_SQL}, n AS (SELECT series, ts AS gap_start, lead(ts) OVER (PARTITION BY series ORDER BY ts, seq) AS gap_end, 'inner' AS kind FROM ticks),
    e AS (SELECT series, min(ts) AS a, max(ts) AS b FROM ticks GROUP BY series)
    SELECT * FROM n WHERE gap_end > gap_start + INTERVAL 30 MINUTE
    UNION ALL SELECT series, TIMESTAMP '2023-12-31 00:00:00', a, 'head' FROM e WHERE a > TIMESTAMP '2023-12-31 00:30:00'
    UNION ALL SELECT series, b, TIMESTAMP '2024-02-01 00:00:00', 'tail' FROM e WHERE b < TIMESTAMP '2024-01-31 20:00:00'""",
)
def op_gap_finder(spark, sf_dir):
    g = C.gaps(ticks(spark, sf_dir), "2023-12-31 00:00:00", "2024-02-01 00:00:00")
    return g.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("gap_start", "gap_end")})


@query(
    "op_roll_schedule",
    """WITH d AS (SELECT DISTINCT o_orderdate AS day, o_orderdate + INTERVAL 8 DAY AS need FROM orders),
    x AS (SELECT DISTINCT date_trunc('month', o_orderdate) + INTERVAL 14 DAY AS expiry FROM orders)
    SELECT day, (SELECT min(expiry) FROM x WHERE expiry >= need) AS expiry FROM d""",
)
def op_roll_schedule(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    days = o.select(F.col("o_orderdate").alias("day"), (F.col("o_orderdate") + F.expr("interval 8 days")).alias("need"), F.lit(0).alias("g")).distinct()
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp")) + F.expr("interval 14 days")
    x = o.select(month.cast("timestamp_ntz").alias("expiry"), F.lit(0).alias("g")).distinct()
    return asof_forward(days, x, "need", "expiry", ["g"], []).select("day", F.col("asof_key").alias("expiry"))


@query(
    "op_calendar_filter",
    "SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE isodow(o_orderdate) <= 5 AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def op_calendar_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.where((F.weekday("o_orderdate") < 5) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query(
    "op_ohlc_audit",
    f"""WITH {BARS_SQL} SELECT series, count(*) AS n, count(*) FILTER (high < low) AS high_lt_low, count(*) FILTER (high < open OR high < close) AS high_lt_body,
    count(*) FILTER (low > open OR low > close) AS low_gt_body, count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS not_positive,
    count(*) FILTER (volume < 0) AS negative_volume FROM bars GROUP BY series""",
)
def op_ohlc_audit(spark, sf_dir):
    return C.ohlc_audit(bars_of(spark, sf_dir))


@query(
    "op_time_audit",
    f"""WITH {TICKS_SQL}, r AS (SELECT series, ts, lag(ts) OVER w AS before, row_number() OVER w AS rn FROM ticks WINDOW w AS (PARTITION BY series ORDER BY seq)),
    s AS (SELECT series, ts, count(*) AS n, max(rn) - min(rn) AS spread FROM r GROUP BY series, ts),
    d AS (SELECT series, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicates, max(spread) AS widest FROM s GROUP BY series),
    b AS (SELECT series, count(*) FILTER (ts < before) AS backwards, count(*) FILTER (ts > before + INTERVAL 3 DAY) AS long_gaps FROM r GROUP BY series)
    SELECT * FROM b JOIN d USING (series)""",
)
def op_time_audit(spark, sf_dir):
    return C.time_audit(ticks(spark, sf_dir)).withColumn("widest", F.col("widest").cast("long"))


_AUDIT = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "op_column_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL OR isnan({c})) AS nulls, count(*) FILTER (isinf({c})) AS infinite, coalesce(stddev_samp({c}), 0) = 0 AS constant FROM lineitem" for c in _AUDIT
    ),
)
def op_column_audit(spark, sf_dir):
    return C.column_audit(table(spark, sf_dir, "lineitem"), _AUDIT)


_LEAK = ["open", "high", "low", "volume", "ticket_imbalance"]


@query(
    "op_leak_audit",
    f"WITH {BARS_SQL}, n AS (SELECT *, lead(close) OVER (PARTITION BY series ORDER BY bar_id) / nullif(close, 0) - 1 AS nxt FROM bars) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(covar_samp({c}, nxt) / nullif(stddev_samp(CASE WHEN nxt IS NOT NULL THEN {c} END) * stddev_samp(nxt), 0), 6) AS corr, abs(covar_samp({c}, nxt) / nullif(stddev_samp(CASE WHEN nxt IS NOT NULL THEN {c} END) * stddev_samp(nxt), 0)) > 0.2 AS leaks FROM n" for c in _LEAK),
)
def op_leak_audit(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    nxt = ratio(F.lead("close").over(Window.partitionBy("series").orderBy("bar_id")), "close") - 1
    c = C.correlations_to(b.withColumn("nxt", nxt), "nxt", _LEAK)
    return c.select("column", F.round("corr", 6).alias("corr"), (F.abs("corr") > 0.2).alias("leaks"))


ASOF_SQL = f"""{TICKS_SQL}, p AS (SELECT * FROM ticks WHERE series = 'purchase'), c AS (SELECT * FROM ticks WHERE series = 'click')"""


def _two(spark, sf_dir):
    t = ticks(spark, sf_dir)
    return t.where("series = 'click'").select("user_id", "ts", "seq", "mid"), t.where("series = 'purchase'").select("user_id", F.col("ts").alias("pts"), F.col("mid").alias("price"))


@query(
    "join_asof_backward",
    f"WITH {ASOF_SQL} SELECT c.user_id, c.seq, c.mid, p.ts AS asof_key, p.mid AS price FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts >= p.ts",
)
def join_asof_backward(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return asof_backward(left, right, "ts", "pts", ["user_id"], ["price"]).drop("ts")


@query(
    "join_asof_forward",
    f"WITH {ASOF_SQL} SELECT c.user_id, c.seq, c.mid, p.ts AS asof_key, p.mid AS price FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.ts <= p.ts",
)
def join_asof_forward(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return asof_forward(left, right, "ts", "pts", ["user_id"], ["price"]).drop("ts")


@query(
    "join_asof_lagged_stale",
    f"""WITH {ASOF_SQL}, q AS (SELECT user_id, ts + INTERVAL 1 DAY AS known, mid FROM p), j AS (
    SELECT c.user_id, c.seq, c.ts, q.known AS asof_key, q.mid AS price FROM c ASOF LEFT JOIN q ON c.user_id = q.user_id AND c.ts >= q.known)
    SELECT user_id, seq, CASE WHEN ts - asof_key <= INTERVAL 5 DAY THEN asof_key END AS asof_key, CASE WHEN ts - asof_key <= INTERVAL 5 DAY THEN price END AS price FROM j""",
)
def join_asof_lagged_stale(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    right = right.withColumn("known", F.col("pts") + F.expr("interval 1 day"))
    old = (F.col("ts") - F.col("asof_key")) > F.expr("interval 5 days")
    return asof_backward(left, right, "ts", "known", ["user_id"], ["price"], stale=old).select("user_id", "seq", "asof_key", "price")


DAILY_SQL = """daily AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS qty, avg(l_discount) AS disc FROM lineitem GROUP BY 1)"""


@query(
    "join_date_ffill",
    f"""WITH {DAILY_SQL}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
    SELECT CAST(o.day AS VARCHAR) AS day, n, qty AS exact, last_value(qty IGNORE NULLS) OVER (ORDER BY o.day ROWS UNBOUNDED PRECEDING) AS filled FROM o LEFT JOIN daily USING (day)""",
)
def join_date_ffill(spark, sf_dir):
    daily = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"))
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return o.join(daily, "day", "left").select(F.col("day").cast("string").alias("day"), "n", F.col("qty").alias("exact"), F.last("qty", ignorenulls=True).over(w).alias("filled"))


@query(
    "join_outer_dates",
    f"""WITH {DAILY_SQL}, o AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1)
    SELECT CAST(coalesce(o.day, daily.day) AS VARCHAR) AS day, round(total, 2) AS total, qty FROM o FULL JOIN daily ON o.day = daily.day""",
)
def join_outer_dates(spark, sf_dir):
    daily = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("qty"))
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return o.join(daily, "day", "full").select(F.col("day").cast("string").alias("day"), "total", "qty")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("join_semi", "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def join_semi(spark, sf_dir):
    many = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").join(many, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query(
    "join_inner_grid",
    f"""WITH {TICKS_SQL}, h AS (SELECT series, date_trunc('hour', ts) AS t, arg_max(mid, (ts, seq)) AS p FROM ticks GROUP BY 1, 2)
    SELECT a.t, a.p AS click, b.p AS purchase FROM h a JOIN h b ON a.t = b.t WHERE a.series = 'click' AND b.series = 'purchase'""",
)
def join_inner_grid(spark, sf_dir):
    g = B.filled_grid(ticks(spark, sf_dir)).where(~F.col("was_gap"))
    a = g.where("series = 'click'").select("t", F.col("price").alias("click"))
    return a.join(g.where("series = 'purchase'").select("t", F.col("price").alias("purchase")), "t")


@query(
    "agg_regex_masks",
    """SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, 'the|and')) AS en_like, count(*) FILTER (regexp_matches(text, 'der|und')) AS de_like,
    count(*) FILTER (regexp_matches(lower(text), 'licen[cs]e')) AS licensed, sum(CASE WHEN regexp_matches(text, '[0-9]') THEN n_chars ELSE 0 END)::BIGINT AS chars_with_digits,
    round(count(*) FILTER (regexp_matches(text, 'the|and')) / CASE WHEN count(*) FILTER (regexp_matches(text, 'der|und')) = 0 THEN 1 ELSE count(*) FILTER (regexp_matches(text, 'der|und')) END, 6) AS en_de
    FROM documents GROUP BY source""",
)
def agg_regex_masks(spark, sf_dir):
    t = F.col("text")
    en, de = F.count_if(t.rlike("the|and")), F.count_if(t.rlike("der|und"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), en.alias("en_like"), de.alias("de_like"), F.count_if(F.lower(t).rlike("licen[cs]e")).alias("licensed"),
        F.sum(F.when(t.rlike("[0-9]"), F.col("n_chars")).otherwise(0)).alias("chars_with_digits"), F.round(en / F.when(de == 0, 1).otherwise(de), 6).alias("en_de"),
    )


@query(
    "agg_group_transform",
    f"""WITH {BARS_SQL}, d AS (SELECT *, CAST(time_start AS DATE) AS day FROM bars)
    SELECT series, bar_id, first_value(open) OVER (PARTITION BY series, day ORDER BY bar_id) AS day_open,
    bool_or(close > 400) OVER (PARTITION BY series, day ORDER BY bar_id ROWS UNBOUNDED PRECEDING) AS was_high FROM d""",
)
def agg_group_transform(spark, sf_dir):
    w = Window.partitionBy("series", F.to_date("time_start")).orderBy("bar_id").rowsBetween(Window.unboundedPreceding, 0)
    return bars_of(spark, sf_dir).select("series", "bar_id", F.first("open").over(w).alias("day_open"), F.bool_or(F.col("close") > 400).over(w).alias("was_high"))


@query(
    "agg_multi_stats",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean_qty, round(stddev_samp(l_quantity), 6) AS std_qty, min(l_quantity) AS min_qty,
    max(l_quantity) AS max_qty, count(DISTINCT l_suppkey) AS suppliers, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
    round(stddev_pop(l_tax), 6) AS std_tax FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def agg_multi_stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_qty"), F.round(F.stddev_samp("l_quantity"), 6).alias("std_qty"), F.min("l_quantity").alias("min_qty"), F.max("l_quantity").alias("max_qty"),
        F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.percentile("l_extendedprice", F.lit(0.05)), 4).alias("p5"), F.round(F.percentile("l_extendedprice", F.lit(0.5)), 4).alias("median"), F.round(F.stddev_pop("l_tax"), 6).alias("std_tax"),
    ).where("n >= 3")


_MATRIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "agg_correlation_matrix",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), 6) AS corr FROM lineitem" for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1 :]),
)
def agg_correlation_matrix(spark, sf_dir):
    return C.correlation_matrix(table(spark, sf_dir, "lineitem"), _MATRIX).withColumn("corr", F.round("corr", 6))


@query(
    "join_theta_pairs",
    """WITH s AS (SELECT o_orderpriority AS id, stddev_samp(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT a.id AS a, b.id AS b, round(abs(a.v - b.v), 4) AS gap FROM s a JOIN s b ON a.id < b.id WHERE abs(a.v - b.v) > 10""",
)
def join_theta_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("id")).agg(F.stddev_samp("o_totalprice").alias("v"))  # a few rows
    a, b = s.select(F.col("id").alias("a"), F.col("v").alias("va")), s.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    gap = F.abs(F.col("va") - F.col("vb"))
    return a.join(b, (F.col("a") < F.col("b")) & (gap > 10)).select("a", "b", F.round(gap, 4).alias("gap"))


@query("agg_row_mean", "SELECT l_orderkey, l_linenumber, l_partkey, round(list_avg(list_filter([l_discount, nullif(l_tax, 0), l_quantity / 50], lambda x: x IS NOT NULL)), 6) AS mean FROM lineitem")
def agg_row_mean(spark, sf_dir):
    held = F.array_compact(F.array("l_discount", F.nullif("l_tax", F.lit(0.0)), F.col("l_quantity") / 50))
    mean = F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(held), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(mean, 6).alias("mean"))


@query("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("sort_best_per_group", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS best, max(o_totalprice) AS price FROM orders GROUP BY o_custkey")
def sort_best_per_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"), F.max("o_totalprice").alias("price"))


@query(
    "sort_split_60_20_20",
    f"""WITH {BARS_SQL}, r AS (SELECT series, bar_id, row_number() OVER (PARTITION BY series ORDER BY bar_id) AS k, count(*) OVER (PARTITION BY series) AS n FROM bars)
    SELECT series, bar_id, CASE WHEN k <= floor(n * 0.6) THEN 'train' WHEN k <= floor(n * 0.8) THEN 'val' ELSE 'test' END AS split FROM r""",
)
def sort_split(spark, sf_dir):
    w = Window.partitionBy("series")
    k, n = F.row_number().over(w.orderBy("bar_id")), F.count("*").over(w)
    return bars_of(spark, sf_dir).select("series", "bar_id", F.when(k <= F.floor(n * 0.6), "train").when(k <= F.floor(n * 0.8), "val").otherwise("test").alias("split"))


@query(
    "set_algebra",
    """SELECT 'difference' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT 'union', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
    UNION ALL SELECT 'intersection', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def set_algebra(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, r = li.where("l_returnflag = 'A'").select("l_partkey"), li.where("l_returnflag = 'R'").select("l_partkey")
    made = {"difference": a.distinct().join(r, "l_partkey", "left_anti"), "union": a.union(r).distinct(), "intersection": a.intersect(r)}
    return C.union_all([d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in made.items()])


@query(
    "set_jaccard",
    """WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1)
    SELECT a.o_custkey, round(len(list_intersect(a.p, b.p)) / len(list_distinct(list_concat(a.p, b.p))), 6) AS jaccard FROM s a JOIN s b ON a.o_custkey + 1 = b.o_custkey""",
)
def set_jaccard(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    b = s.select((F.col("o_custkey") - 1).alias("o_custkey"), F.col("p").alias("q"))
    return s.join(b, "o_custkey").select("o_custkey", F.round(F.size(F.array_intersect("p", "q")) / F.size(F.array_union("p", "q")), 6).alias("jaccard"))


@query(
    "wn_lags",
    f"""WITH {BARS_SQL} SELECT series, bar_id, lag(close, 3) OVER w AS lag_3, lead(close, 2) OVER w AS lead_2, round(close - lag(close, 5) OVER w, 6) + 0.0 AS diff_5,
    round(close / nullif(lag(close) OVER w, 0) - 1, 6) + 0.0 AS pct_1 FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_id)""",
)
def wn_lags(spark, sf_dir):
    from quantloom.functions.frames import lag, pct_change

    return bars_of(spark, sf_dir).select("series", "bar_id", lag("close", 3).alias("lag_3"), lag("close", -2).alias("lead_2"), rounded(diff("close", 5)).alias("diff_5"), rounded(pct_change("close")).alias("pct_1"))


@query(
    "wn_moments",
    f"""WITH {BARS_SQL} SELECT series, bar_id, """
    + ", ".join(f"round(CASE WHEN count(close) OVER w >= {m} THEN {f}(close) OVER w END, 6) + 0.0 AS {f}_25" for f, m in (("sum", 25), ("avg", 10), ("min", 25), ("max", 25), ("stddev_samp", 25), ("stddev_pop", 25), ("var_samp", 25)))
    + " FROM bars WINDOW w AS (PARTITION BY series ORDER BY bar_id ROWS 24 PRECEDING)",
)
def wn_moments(spark, sf_dir):
    return bars_of(spark, sf_dir).select("series", "bar_id", *[rounded(rolling(f, "close", 25, m)).alias(f"{f}_25") for f, m in (("sum", 25), ("avg", 10), ("min", 25), ("max", 25), ("stddev_samp", 25), ("stddev_pop", 25), ("var_samp", 25))])
