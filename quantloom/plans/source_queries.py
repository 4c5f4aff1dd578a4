"""File sources, sinks, filters and text functions, each beside its SQL. What a source reads is first written from a table
in the file's own form, into the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quantloom.functions import parsing as P
from quantloom.functions.frames import ratio, rounded
from quantloom.operators import cleaning as C
from quantloom.operators.asof import asof_columns
from quantloom.operators.features import log_return
from quantloom.plans.feature_queries import BARS_SQL, RET_SQL, r
from quantloom.plans.registry import query
from quantloom.plans.tape_queries import TICKS_SQL, bars_of
from quantloom.sources import discovery as D
from quantloom.sources import logs as LG
from quantloom.sources import readers as S
from quantloom.sources.tape import table, ticks
from quantloom.streaming.live import shared_folder


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _tsv(df, path):
    df.write.option("sep", "\t").option("quote", "\u0000").option("emptyValue", "").option("nullValue", "").csv(path)


@query(
    "src_quote_tape",
    "SELECT DISTINCT 'x' AS series, event_id, CASE WHEN event_id % 3 = 0 THEN value ELSE (value + value + 2) / 2 END AS mid FROM events WHERE value IS NOT NULL AND event_id % 7 <> 0",
)
def src_quote_tape(spark, sf_dir):
    e, path, nan = table(spark, sf_dir, "events"), _place(spark, "tape"), F.lit(float("nan"))
    v, k = F.col("value"), F.col("event_id")
    none = F.lit(None).cast("double")
    raw = e.select("event_id", F.when(k % 3 == 0, nan).when(k % 7 == 0, none).otherwise(v).alias("pricebid"), F.when(k % 7 == 0, none).otherwise(v + 2).alias("priceask"), F.when((k % 3 == 0) & (k % 7 != 0), v).alias("last_price"))
    raw.union(raw.where("event_id % 2 = 0")).write.parquet(path)
    return S.quote_tape(spark, f"{path}/*.parquet", "x").select("series", "event_id", "mid")


@query(
    "src_calendar",
    "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS ts, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 0 END AS kind FROM orders",
)
def src_calendar(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders"), _place(spark, "calendar")
    event = F.when(F.col("o_orderpriority") == "1-URGENT", "nfp").when(F.col("o_orderpriority") == "2-HIGH", "CPI").otherwise("Other")
    S.write_csv(o.select(F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("timestamp_utc"), event.alias("event"), F.col("o_orderkey").cast("string").alias("impact")), path)
    return S.calendar_csv(spark, path).select(F.col("impact").cast("long").alias("k"), F.col("ts").cast("timestamp_ntz").alias("ts"), "kind")


@query(
    "src_daily_news",
    "SELECT doc_id AS k, CAST(DATE '2024-01-01' + CAST(doc_id % 28 AS INT) AS VARCHAR) AS day, n_chars AS articles, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars / 2.0 END AS tone_mean, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id % 5 AS DOUBLE) END AS tone_polarity FROM documents",
)
def src_daily_news(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents"), _place(spark, "news")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int")), "yyyyMMdd")
    tone = F.when(F.col("doc_id") % 9 == 0, "x").otherwise(F.concat_ws(",", F.col("n_chars") / 2, F.lit("1"), F.lit("2"), F.col("doc_id") % 5, F.lit("3"), F.lit("4")))
    fixed = {"DATE": day, "NUMARTS": F.col("n_chars").cast("string"), "THEMES": F.col("doc_id").cast("string"), "LOCATIONS": F.col("lang"), "TONE": tone}
    d.select(*[fixed.get(c, F.lit("")).alias(c) for c in S.DAILY_NEWS]).write.option("sep", "\t").option("header", "true").option("quote", "\u0000").csv(path)
    n = S.daily_news(spark, path)
    return n.select(F.col("THEMES").cast("long").alias("k"), F.col("date_utc").cast("string").alias("day"), F.col("num_articles").alias("articles"), "tone_mean", "tone_polarity")


@query(
    "src_event_files",
    "SELECT event_id AS k, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END AS added, value AS tone, user_id AS mentions, event_type AS code, '20240105093000' AS batch_ts FROM events",
)
def src_event_files(spark, sf_dir):
    e, path = table(spark, sf_dir, "events"), _place(spark, "20240105093000")
    fixed = {0: F.col("event_id").cast("string"), 1: F.date_format("ts", "yyyyMMdd"), 26: F.col("event_type"), 31: F.col("user_id").cast("string"), 34: F.col("value").cast("string"), 59: F.when(F.col("event_id") % 4 == 0, "never").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))}
    _tsv(e.select(*[fixed.get(i, F.lit("")).alias(f"c{i}") for i in range(S.EVENT_WIDTH)]), path)
    f = S.event_files(spark, path)
    return f.select(F.col("GlobalEventID").cast("long").alias("k"), F.col("sql_date").cast("string").alias("day"), F.col("date_added_utc").cast("timestamp_ntz").alias("added"), F.col("AvgTone").cast("double").alias("tone"), F.col("NumMentions").cast("long").alias("mentions"), F.col("EventCode").alias("code"), "batch_ts")


@query("src_mention_files", "SELECT event_id AS k, date_trunc('second', ts) AS seen, CASE WHEN event_id % 6 = 0 THEN NULL ELSE value END AS doc_tone, user_id AS confidence FROM events")
def src_mention_files(spark, sf_dir):
    e, path = table(spark, sf_dir, "events"), _place(spark, "mentions")
    fixed = {0: F.col("event_id").cast("string"), 2: F.date_format("ts", "yyyyMMddHHmmss"), 7: F.when(F.col("event_id") % 6 == 0, "n/a").otherwise(F.col("value").cast("string")), 13: F.col("user_id").cast("string")}
    _tsv(e.select(*[fixed.get(i, F.lit("")).alias(f"c{i}") for i in range(S.MENTION_WIDTH)]), path)
    return S.mention_files(spark, path).select(F.col("GlobalEventID").cast("long").alias("k"), F.col("mention_time_utc").cast("timestamp_ntz").alias("seen"), "doc_tone", F.col("Confidence").cast("long").alias("confidence"))


#: o_orderkey % 8 decides what a planted log line tells; written in the form of the live path.
_LOG = """SELECT o_orderkey AS k, o_orderdate AS t, CASE o_orderkey % 8 WHEN 0 THEN 'ENTRY' WHEN 1 THEN 'EXIT' WHEN 2 THEN 'EXIT' WHEN 4 THEN 'PNL' WHEN 5 THEN 'EXIT' WHEN 6 THEN 'PNL' END AS kind,
  CASE WHEN o_orderkey % 16 < 8 THEN 'BUY' ELSE 'SELL' END AS side, 1 + o_orderkey % 3 AS lots, 's' || o_custkey AS strategy, CASE WHEN o_orderkey % 3 = 0 THEN 'SL' ELSE 'Signal Reversal' END AS reason, o_totalprice AS price,
  CASE WHEN o_orderkey % 48 <> 6 THEN round(o_totalprice / 100 - 900, 2) + 0.0 END AS pnl FROM orders"""


def _planted_log(spark, sf_dir):
    o, path = table(spark, sf_dir, "orders"), _place(spark, "log")
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 8
    price, side = F.format_string("%.4f", "o_totalprice"), F.when(k % 16 < 8, "BUY").otherwise("SELL")
    entry = F.format_string("VIRTUAL ENTRY: %s %d.00 lots (Risk $600) Strat s%d @ %s | SL:1.0x TP:2.0x ATR", side, 1 + k % 3, F.col("o_custkey"), price)
    leave = F.format_string("VIRTUAL EXIT: %s @ %s", F.when(k % 3 == 0, "SL").otherwise("Signal Reversal"), price)
    pnl = F.when(k % 48 == 6, "Trade PnL: $-,.").otherwise(F.format_string("Trade PnL: $%,.2f | Bal: $60000", F.round(F.col("o_totalprice") / 100 - 900, 2)))
    told = F.when(kind == 0, entry).when(kind.isin(1, 2, 5), leave).when(kind.isin(4, 6), pnl).when(kind == 3, "heartbeat").otherwise("PnL unknown")
    time = F.when(kind == 7, "no time").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))
    lines = o.select("o_orderkey", F.concat(time, F.lit(",123 - PaperTrade - INFO - "), told).alias("value"))
    lines.repartitionByRange(5, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return path


@query("src_trade_log", f"WITH l AS ({_LOG}) SELECT kind, t + INTERVAL 5 HOUR AS time, CASE kind WHEN 'ENTRY' THEN side END AS side, CASE kind WHEN 'ENTRY' THEN CAST(lots AS DOUBLE) END AS lots, CASE kind WHEN 'ENTRY' THEN strategy END AS strategy, CASE kind WHEN 'EXIT' THEN reason END AS reason, CASE WHEN kind <> 'PNL' THEN price END AS price, CASE kind WHEN 'PNL' THEN pnl END AS pnl FROM l WHERE kind IS NOT NULL")
def src_trade_log(spark, sf_dir):
    """Events of a live log, whose times are those of a zone five hours behind (SRC18)."""
    e = LG.trade_events(spark, _planted_log(spark, sf_dir), "Etc/GMT+5").drop("place")
    return e.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query(
    "src_closed_trades",
    f"""WITH l AS ({_LOG}), e AS (SELECT *, lead(k, 1, 1000000000000000000) OVER (ORDER BY k) AS until FROM l WHERE kind = 'ENTRY'),
    x AS (SELECT e.k, min(l.k) AS first_exit FROM e JOIN l ON l.kind = 'EXIT' AND l.k > e.k AND l.k < e.until GROUP BY 1),
    p AS (SELECT e.k, min(l.k) AS paid FROM e JOIN x ON e.k = x.k LEFT JOIN l ON l.kind = 'PNL' AND l.k > x.first_exit AND l.k < e.until GROUP BY 1),
    z AS (SELECT e.k, max(l.k) AS last_exit FROM e JOIN p ON e.k = p.k JOIN l ON l.kind = 'EXIT' AND l.k > e.k AND l.k < least(e.until, coalesce(p.paid, e.until)) GROUP BY 1)
    SELECT e.t + INTERVAL 5 HOUR AS entry_time, e.side, CAST(e.lots AS DOUBLE) AS lots, e.strategy, e.price AS entry_price, q.t + INTERVAL 5 HOUR AS exit_time, q.price AS exit_price, q.reason, coalesce(r.pnl, 0) AS pnl
    FROM e JOIN p ON e.k = p.k JOIN z ON e.k = z.k JOIN l q ON q.k = z.last_exit LEFT JOIN l r ON r.k = p.paid""",
)
def src_closed_trades(spark, sf_dir):
    """Trades closed in a live log of several files (SRC18)."""
    t = LG.closed_trades(LG.trade_events(spark, _planted_log(spark, sf_dir), "Etc/GMT+5"))
    return t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("entry_time", "exit_time")})


@query(
    "parse_impacts",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'High' WHEN '2-HIGH' THEN 'Medium' WHEN '3-MEDIUM' THEN 'Low' WHEN '4-NOT SPECIFIED' THEN 'Holiday' ELSE 'Unknown' END AS level FROM orders",
)
def parse_impacts(spark, sf_dir):
    """Impact levels from the CSS classes of calendar rows (SC05)."""
    css = F.create_map(*[F.lit(x) for x in ("1-URGENT", "red", "2-HIGH", "ora", "3-MEDIUM", "yel", "4-NOT SPECIFIED", "gra")])
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("icon icon--ff-impact-"), F.try_element_at(css, "o_orderpriority"), F.lit(" x")).alias("c"))
    return o.select("o_orderkey", P.impact_level(F.col("c")).alias("level"))


@query(
    "op_choose_price",
    """WITH e AS (SELECT event_type AS series, event_id, CASE WHEN event_type = 'click' AND event_id % 50 = 0 THEN value END AS mid, CASE WHEN event_type IN ('click', 'view', 'error') THEN value END AS bid, CASE WHEN event_type IN ('view', 'purchase') THEN value + 1 END AS ask, CASE WHEN event_type <> 'signup' THEN value * 2 END AS last FROM events),
    s AS (SELECT series, CASE WHEN count(mid) > 0 THEN 'mid' WHEN count(bid) > 0 AND count(ask) > 0 THEN 'quote' WHEN count(last) > 0 THEN 'last' END AS source FROM e GROUP BY 1)
    SELECT e.series, event_id, source AS price_source, CASE source WHEN 'mid' THEN mid WHEN 'quote' THEN (bid + ask) / 2 WHEN 'last' THEN last END AS mid_price FROM e JOIN s ON s.series = e.series""",
)
def op_choose_price(spark, sf_dir):
    """The price of each instrument: its mid, else its quotes, else its trades (OP01)."""
    v, kind = F.col("value"), F.col("event_type")
    e = table(spark, sf_dir, "events").select(
        kind.alias("series"), "event_id", F.when((kind == "click") & (F.col("event_id") % 50 == 0), v).otherwise(F.lit(float("nan"))).alias("mid"), F.when(kind.isin("click", "view", "error"), v).alias("bid"),
        F.when(kind.isin("view", "purchase"), v + 1).alias("ask"), F.when(kind != "signup", v * 2).alias("last"),
    )
    c = C.choose_price(e, {"mid": (F.col("mid"), ["mid"]), "quote": ((F.col("bid") + F.col("ask")) / 2, ["bid", "ask"]), "last": (F.col("last"), ["last"])})
    return c.select("series", "event_id", "price_source", "mid_price")


@query("op_feature_columns", f"WITH {BARS_SQL} SELECT series, bar_id, tick_count, close * 2 AS mom_25 FROM bars")
def op_feature_columns(spark, sf_dir):
    """Bars with their features alone: prices, sizes, target and noisy columns go (OP17)."""
    b = bars_of(spark, sf_dir).withColumns({"mom_25": F.col("close") * 2, "kyle_lambda_50": F.col("close"), "avg_spread_x": F.col("close"), "target_60": F.col("close"), "day_open": F.col("open")})
    return C.feature_columns(b, target="target_60")


@query("src_last_lines", f"WITH l AS ({_LOG}), n AS (SELECT * FROM l ORDER BY k DESC LIMIT 100) SELECT row_number() OVER (ORDER BY k) AS number, coalesce(kind, 'none') AS kind FROM n")
def src_last_lines(spark, sf_dir):
    """The last hundred lines of a log (SRC18), by what they tell; a line without a time counts by its words alone."""
    n = LG.last_lines(spark, _planted_log(spark, sf_dir))
    kind = F.when(F.col("line").rlike(LG.ENTRY), "ENTRY").when(F.col("line").rlike(LG.EXIT), "EXIT").when(F.col("line").rlike(r"Trade PnL: \$"), "PNL").otherwise("none")
    return n.select("number", kind.alias("kind"))


@query("src_batches", "SELECT DISTINCT strftime(date_trunc('day', ts), '%Y%m%d%H%M%S') AS batch FROM events")
def src_batches(spark, sf_dir):
    """Stamps of the files that earlier runs wrote, one folder a day of the tape (SRC19)."""
    path = _place(spark, "batches")
    table(spark, sf_dir, "events").select(F.date_format(F.date_trunc("day", F.col("ts").cast("timestamp")), "yyyyMMddHHmmss").alias("b"), "event_id").write.partitionBy("b").csv(path)
    return S.processed_batches(spark, path)


#: Stamps of half days, a third of them seven minutes off the quarter hour; now is three minutes after the newest.
_STAMPS = "SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) + CASE WHEN hour(ts) >= 12 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END + CASE WHEN day(ts) % 3 = 0 THEN INTERVAL 7 MINUTE ELSE INTERVAL 0 MINUTE END AS t FROM events"


@query(
    "src_discovery",
    f"""WITH s AS ({_STAMPS}), n AS (SELECT max(t) + INTERVAL 3 MINUTE AS now FROM s), g AS (SELECT t, count(*) AS c FROM s GROUP BY 1), w AS (SELECT g.*, now - INTERVAL 5 MINUTE AS cut FROM g, n),
    b AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, cut - INTERVAL 2 DAY) AS a, minute(t) = 0 AS grid FROM w)
    SELECT strftime(t, '%Y%m%d%H%M%S') AS stamp, CASE WHEN day(t) % 4 = 1 THEN 'seen' WHEN grid AND t >= a AND t <= cut THEN 'new' WHEN t > cut THEN 'early' WHEN t < cut - INTERVAL 2 DAY THEN 'late' ELSE 'off' END AS state,
    CASE WHEN day(t) % 4 <> 1 AND grid AND t >= a AND t <= cut THEN c END AS rows FROM b""",
)
def src_discovery(spark, sf_dir):
    """One cycle over landed files, some listed twice: which are taken, and how many rows they bring (SS08)."""
    e, path, seen = table(spark, sf_dir, "events"), _place(spark, "landed"), _place(spark, "ledger")
    ts = F.col("ts").cast("timestamp")
    t = F.date_trunc("day", ts) + F.make_dt_interval(hours=F.when(F.hour(ts) >= 12, 12).otherwise(0), mins=F.when(F.day(ts) % 3 == 0, 7).otherwise(0))
    rows = e.select("event_id", F.date_format(t, "yyyyMMddHHmmss").alias("stamp")).repartition("stamp")
    rows.write.partitionBy("stamp").csv(f"{path}/a")
    rows.where(F.substring("stamp", 9, 2) == "12").write.partitionBy("stamp").csv(f"{path}/b")
    newest = e.agg(F.date_format(F.max(t) + F.expr("INTERVAL 3 MINUTES"), "yyyy-MM-dd HH:mm:ss")).first()[0]
    D.listed(spark, path).where(F.substring("stamp", 7, 2).cast("int") % 4 == 1).select("stamp").write.parquet(f"{seen}/cycle=0")
    found = D.states(D.listed(spark, path), D.ledger(spark, seen), newest).where("state <> 'missing'")
    read = lambda paths: spark.read.schema("event_id long").csv(paths).groupBy(F.regexp_extract(F.input_file_name(), r"stamp=(\d{14})", 1).alias("stamp")).agg(F.count("*").alias("rows"))
    new = D.take(spark, path, seen, newest, read, 1)
    new = new if new is not None else spark.createDataFrame([], "stamp string, rows long")
    return found.select("stamp", "state").join(new, "stamp", "left")


@query(
    "src_news_records",
    "SELECT 'r' || doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE TIMESTAMP '2024-03-01' + INTERVAL (doc_id % 1000) MINUTE END AS at, source AS name, lang AS places, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars / 4.0 END AS tone_mean, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id % 7 AS DOUBLE) END AS tone_polarity, '20240305101500' AS batch_ts FROM documents",
)
def src_news_records(spark, sf_dir):
    """News records of 27 columns (SRC08)."""
    d, path, k = table(spark, sf_dir, "documents"), _place(spark, "20240305101500"), F.col("doc_id")
    at = F.date_format(F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(mins=(k % 1000).cast("int")), "yyyyMMddHHmmss")
    tone = F.when(k % 9 == 0, "none").otherwise(F.concat_ws(",", F.col("n_chars") / 4, F.lit("1"), F.lit("2"), k % 7, F.lit("3"), F.lit("4"), F.lit("5")))
    fixed = {0: F.concat(F.lit("r"), k), 1: F.when(k % 5 == 0, "20241399").otherwise(at), 3: F.col("source"), 9: F.col("lang"), 15: tone}
    _tsv(d.select(*[fixed.get(i, F.lit('"x')).alias(f"c{i}") for i in range(S.NEWS_WIDTH)]), path)
    n = S.news_records(spark, path)
    return n.select(F.col("GKGRECORDID").alias("id"), F.col("date_utc").cast("timestamp_ntz").alias("at"), F.col("SourceCommonName").alias("name"), F.col("Locations").alias("places"), "tone_mean", "tone_polarity", "batch_ts")


@query("src_utc_times", "SELECT event_id, ts - INTERVAL 1 HOUR AS ts FROM events")
def src_utc_times(spark, sf_dir):
    e = S.utc_times(table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")), ["ts"], "Etc/GMT-1")
    return e.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("src_cached_table", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def src_cached_table(spark, sf_dir):
    path = _place(spark, "cache")
    make = lambda: table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    S.cached(spark, path, f"{sf_dir}/events.parquet", make)
    return S.cached(spark, path, f"{sf_dir}/events.parquet", lambda: make().withColumn("n", F.lit(-1).cast("long")))  # kept: nothing has changed


@query("src_full_row_distinct", "SELECT DISTINCT * FROM lineitem")
def src_full_row_distinct(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.union(li.where("l_quantity > 25")).dropDuplicates()


@query("snk_upsert", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS v, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS at FROM customer")
def snk_upsert(spark, sf_dir):
    """Rows written, then upserted by key, the newest winning (SNK01, SNK03, SNK04)."""
    c, path = table(spark, sf_dir, "customer").select("c_custkey"), _place(spark, "upsert")
    S.overwrite(c.select("c_custkey", F.lit("old").alias("v"), F.lit(1).alias("at")), path)
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("new").alias("v"), F.lit(2).alias("at"))
    return S.upsert(spark.read.parquet(path), new, ["c_custkey"], F.col("at"))


@query("snk_append", "SELECT n_nationkey AS k, count(*) AS n FROM nation, range(2) GROUP BY 1")
def snk_append(spark, sf_dir):
    n, path = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), _place(spark, "append")
    S.append(n, path)
    S.append(n, path)
    return spark.read.parquet(path).groupBy("k").agg(F.count("*").alias("n"))


@query("snk_by_day", f"WITH {TICKS_SQL} SELECT series, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM ticks GROUP BY 1, 2")
def snk_by_day(spark, sf_dir):
    path = _place(spark, "days")
    S.write_by_day(ticks(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("series", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("snk_csv_json", "SELECT s_suppkey AS k, s_name AS csv_name, s_name AS json_name FROM supplier")
def snk_csv_json(spark, sf_dir):
    s, a, b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), _place(spark, "csv"), _place(spark, "json")
    S.write_csv(s, a)
    S.write_json(s, b)
    left = spark.read.option("header", "true").schema("k long, csv_name string").csv(a)
    return left.join(spark.read.schema("k long, s_name string").json(b).withColumnRenamed("s_name", "json_name"), "k")


@query("snk_state", "SELECT r_regionkey AS k, 2 AS version FROM region")
def snk_state(spark, sf_dir):
    """The newest whole version of a state table (SNK08, SNK09)."""
    t, path = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k")), _place(spark, "state")
    for v in (1, 2):
        S.save_state(t.withColumn("version", F.lit(v)), path, v)
    return S.load_state(spark, path)


@query(
    "op_keep_last",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""",
)
def op_keep_last(spark, sf_dir):
    return C.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("op_trading_bars", f"WITH {BARS_SQL} SELECT series, bar_id, open, high, low, close, volume, tick_count, time_start FROM bars WHERE time_start >= TIMESTAMP '2024-01-10' AND time_start <> time_end")
def op_trading_bars(spark, sf_dir):
    return C.keep_columns(C.trading_bars(bars_of(spark, sf_dir), "2024-01-10"), ["tick_count", "missing"]).drop("time_end")


_COLS = ["open", "high", "volume", "ticket_imbalance", "twin"]


@query(
    "op_leak_and_proxy",
    f"WITH {RET_SQL}, n AS (SELECT *, 2 * log_ret AS twin, lead(log_ret) OVER (PARTITION BY series ORDER BY bar_id) AS nxt FROM ret), k AS (SELECT * FROM n WHERE nxt IS NOT NULL), c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", covar_samp({c}, nxt) / nullif(stddev_samp(CASE WHEN nxt IS NOT NULL THEN {c} END) * stddev_samp(CASE WHEN {c} IS NOT NULL THEN nxt END), 0) AS a, covar_samp({c}, log_ret) / nullif(stddev_samp(CASE WHEN log_ret IS NOT NULL THEN {c} END) * stddev_samp(CASE WHEN {c} IS NOT NULL THEN log_ret END), 0) AS b FROM k" for c in _COLS)
    + ") SELECT \"column\", " + r("a", "next_corr") + ", " + r("b", "current_corr") + ", coalesce(abs(a) > 0.2, false) AND \"column\" <> 'twin' AS leaks, coalesce(abs(b) > 0.95, false) AS proxy FROM c",
)
def op_leak_and_proxy(spark, sf_dir):
    df = log_return(bars_of(spark, sf_dir)).withColumn("twin", 2 * F.col("log_ret"))
    a = C.leak_audit(df, _COLS, known=("twin",))
    return a.withColumns({c: rounded(c) for c in ("next_corr", "current_corr")})


@query("op_drop_constant", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
def op_drop_constant(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.lit(3.0).alias("flat"), F.lit(None).cast("double").alias("empty"))
    return C.drop_constant(li, ["l_quantity", "flat", "empty"])


@query(
    "join_daily_shifted",
    f"""WITH {BARS_SQL}, o AS (SELECT DATE '2024-01-01' + CAST(row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS INT) AS day, sum(o_totalprice) AS v FROM orders GROUP BY CAST(o_orderdate AS DATE)), s AS (SELECT day, lag(v) OVER (ORDER BY day) AS v FROM o)
    SELECT b.series, b.bar_id, round(s.v, 2) AS v FROM bars b LEFT JOIN s ON CAST(b.time_start AS DATE) = s.day""",
)
def join_daily_shifted(spark, sf_dir):
    """Daily values of the row before, on bars of the day (J06)."""
    from pyspark.sql import Window

    daily = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy(F.lit(0)).orderBy("d")  # one row a day
    daily = daily.select(F.date_add(F.lit("2024-01-01").cast("date"), F.row_number().over(w) - 1).alias("day"), F.lag("v").over(w).alias("v"))
    b = bars_of(spark, sf_dir).withColumn("day", F.to_date("time_start"))
    return b.join(daily, "day", "left").select("series", "bar_id", F.round("v", 2).alias("v"))


@query(
    "join_outer_series",
    """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    c AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1), d AS (SELECT day FROM a UNION SELECT day FROM b UNION SELECT day FROM c)
    SELECT CAST(d.day AS VARCHAR) AS day, round(last_value(a.v IGNORE NULLS) OVER w, 2) AS filled, round(last_value(b.v IGNORE NULLS) OVER w, 2) AS open, last_value(c.v IGNORE NULLS) OVER w AS shipped
    FROM d LEFT JOIN a USING (day) LEFT JOIN b USING (day) LEFT JOIN c USING (day) WINDOW w AS (ORDER BY d.day ROWS UNBOUNDED PRECEDING)""",
)
def join_outer_series(spark, sf_dir):
    """Several daily series on all their days, each filled from before, in one scan (J08)."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    long = o.groupBy(F.to_date("o_orderdate").alias("d"), F.col("o_orderstatus").alias("k")).agg(F.sum("o_totalprice").alias("v")).where("k in ('F', 'O')")
    long = long.unionByName(li.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum("l_quantity").alias("v")).withColumn("k", F.lit("S")))
    names = {"filled": "F", "open": "O", "shipped": "S"}
    days = long.select(F.col("d").alias("day")).distinct()
    out = asof_columns(days, long, "day", "d", [], {n: F.when(F.col("k") == k, F.col("v")) for n, k in names.items()}, span=3650)
    return out.select(F.col("day").cast("string").alias("day"), F.round("filled", 2).alias("filled"), F.round("open", 2).alias("open"), "shipped")


@query(
    "agg_prefix_groups",
    """SELECT string_split(p_name, ' ')[1] AS prefix, count(*) AS n, round(avg(p_size), 6) AS mean_size, max(p_size) AS max_size FROM part GROUP BY 1 HAVING count(*) >= 3""",
)
def agg_prefix_groups(spark, sf_dir):
    """Groups by the first word of a name, those of three or more (AG09)."""
    prefix = F.split("p_name", " ")[0]
    return table(spark, sf_dir, "part").groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n"), F.round(F.avg("p_size"), 6).alias("mean_size"), F.max("p_size").alias("max_size")).where("n >= 3")


@query(
    "parse_dates",
    r"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 12 + 1 AS INT) AS h, CAST(o_orderkey % 60 AS INT) AS m, o_orderkey % 2 = 0 AS pm, o_orderkey % 7 = 0 AS tentative FROM orders)
    SELECT o_orderkey, CAST(day - CAST(isodow(day) - 1 AS INT) + 2 AS VARCHAR) AS event_day, CASE WHEN tentative THEN CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR ELSE CAST(day AS TIMESTAMP) + to_hours(h % 12 + CASE WHEN pm THEN 12 ELSE 0 END) + to_minutes(m) END - INTERVAL 5 HOUR AS at,
    time_bucket(INTERVAL 15 MINUTE, CAST(day AS TIMESTAMP) + to_minutes(h * 60 + m)) AS quarter FROM d""",
)
def parse_dates(spark, sf_dir):
    """Week texts, clock texts and quarters of an hour (SC07, SC08); the zone here is five hours ahead of UTC."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 12 + 1).alias("h"), (F.col("o_orderkey") % 60).alias("m"))
    monday = F.date_sub("day", F.weekday("day"))
    clock = F.when(F.col("o_orderkey") % 7 == 0, "Tentative").otherwise(F.concat(F.col("h").cast("string"), F.lit(":"), F.lpad(F.col("m").cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 2 == 0, "pm").otherwise("am")))
    at = P.clock_time(F.date_format("day", "EEE MMM d"), clock, F.year("day"), "Etc/GMT-5")
    quarter = P.quarter_hour(F.timestamp_micros((F.unix_date("day").cast("long") * 1440 + F.col("h") * 60 + F.col("m")) * 60_000_000))
    return o.select("o_orderkey", P.event_time(F.lower(F.date_format(monday, "MMMdd.yyyy"))).cast("string").alias("event_day"), at.cast("timestamp_ntz").alias("at"), quarter.cast("timestamp_ntz").alias("quarter"))


@query(
    "parse_grids",
    """SELECT o_orderkey, len(generate_series(CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INT), CAST(o_orderdate AS DATE) + 30, INTERVAL 7 DAY)) AS weeks,
    lower(strftime(CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INT), '%b%d.%Y')) AS first_week, 9 AS quarters FROM orders""",
)
def parse_grids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderdate").cast("timestamp").alias("t"))
    w = P.weeks(F.col("day"), F.date_add("day", 30))
    return o.select("o_orderkey", F.size(w).cast("long").alias("weeks"), w[0].alias("first_week"), F.size(P.quarter_hours(F.col("t"), F.col("t") + F.expr("interval 2 hours"))).alias("quarters"))


@query(
    "parse_texts",
    """SELECT p_partkey, upper(p_name[1]) || substr(p_name, 2) AS words0, CASE WHEN p_size > 25 THEN 'Ret 20 is above 1.5' ELSE 'Ret 20 is below 1.5' END AS sentence, 'eff-hurst' AS tag FROM (SELECT p_partkey, p_size, string_split(p_name, ' ')[1] AS p_name FROM part)""",
)
def parse_texts(spark, sf_dir):
    """Names and genes in words (SC12)."""
    p = table(spark, sf_dir, "part")
    sign = F.when(F.col("p_size") > 25, ">").otherwise("<")
    tag = P.strategy_tag(F.array(F.lit("hurst_100"), F.lit("eff_20"), F.lit("hurst_200")))
    return p.select("p_partkey", P.feature_words(F.split("p_name", " ")[0]).alias("words0"), P.gene_sentence(F.lit("ret_20"), sign, F.lit("1.5")).alias("sentence"), tag.alias("tag"))


_PLACES = "CASE doc_id % 4 WHEN 0 THEN 'Germany#x' WHEN 1 THEN 'New York' WHEN 2 THEN 'Lima' ELSE NULL END"
_THEMES = "CASE doc_id % 5 WHEN 0 THEN 'EPU_POLICY;ENV_OIL' WHEN 1 THEN 'ECON_INFLATION' WHEN 2 THEN 'CENTRAL_BANK' WHEN 3 THEN 'UNREST' ELSE NULL END"


def news_sql(time: str, least: int, name: str) -> str:
    """The news table over records with tone, polarity, pl (places) and th (themes)."""
    some = lambda c: f"CASE WHEN {c} = 0 THEN 1 ELSE {c} END"
    mean = lambda m: f"coalesce(sum(tone) FILTER ({m}), 0) / {some(f'count(*) FILTER ({m})')}"
    return f"""WITH n0 AS (SELECT {time} AS t, CAST(n_chars % 31 - 15 AS DOUBLE) AS tone, CAST(doc_id % 5 AS DOUBLE) AS polarity, upper(coalesce({_PLACES}, '')) AS pl, coalesce({_THEMES}, '') AS th FROM documents),
    n AS (SELECT *, regexp_matches(pl, '{"|".join(S.EUR_PLACES)}') AS eur, regexp_matches(pl, '{"|".join(S.USD_PLACES)}') AS usd, regexp_matches(pl, '{"|".join(S.LOCAL_PLACES)}') AS loc, {', '.join(f"regexp_matches(th, '{v}') AS {k}" for k, v in S.THEMES.items())} FROM n0),
    g AS (SELECT t, count(*) FILTER (eur) AS news_vol_eur, {mean('eur')} AS news_tone_eur, count(*) FILTER (usd) AS news_vol_usd, {mean('usd')} AS news_tone_usd, sum(tone) / count(*) AS global_tone, sum(polarity) / count(*) AS global_polarity, count(*) FILTER (conflict) AS conflict_intensity,
    count(*) FILTER (epu) AS epu_total, count(*) FILTER (epu AND usd) AS epu_usd, count(*) FILTER (epu AND loc) AS epu_eur, count(*) FILTER (inflation) AS inflation_vol, {mean('bank')} AS central_bank_tone, count(*) FILTER (energy AND eur) AS energy_crisis_eur FROM n GROUP BY 1),
    h AS (SELECT *, CASE WHEN count(*) OVER p >= {least} THEN avg(global_tone) OVER p END AS m, CASE WHEN count(*) OVER p >= {least} THEN stddev_samp(global_tone) OVER p END AS s FROM g WINDOW p AS (ORDER BY t ROWS UNBOUNDED PRECEDING)),
    i AS (SELECT *, (global_tone - coalesce(first_value(m IGNORE NULLS) OVER q, 0)) / nullif(coalesce(first_value(s IGNORE NULLS) OVER q, 1), 0) AS zs FROM h WINDOW q AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT {name}, news_vol_eur, {r('news_tone_eur', 'news_tone_eur')}, news_vol_usd, {r('news_tone_usd', 'news_tone_usd')}, {r('global_tone', 'global_tone')}, {r('global_polarity', 'global_polarity')}, {r('CASE WHEN zs < -2 THEN -global_polarity ELSE 0 END', 'panic_score')}, conflict_intensity, epu_total, epu_usd, epu_eur,
    epu_usd - epu_eur AS epu_diff, inflation_vol, {r('central_bank_tone', 'central_bank_tone')}, energy_crisis_eur, news_vol_eur + news_vol_usd AS total_vol FROM i"""


def _news(t, key, name):
    kinds = dict(t.dtypes)
    return t.select(key.alias(name), *[rounded(c).alias(c) if kinds[c] == "double" else F.col(c) for c in t.columns[1:]])


def _tone():
    return F.concat_ws(",", F.col("n_chars") % 31 - 15, F.lit("1"), F.lit("2"), F.col("doc_id") % 5, F.lit("0"), F.lit("9"))


@query("src_news_daily", news_sql("DATE '2024-01-01' + CAST(doc_id % 40 AS INT)", 5, "CAST(t AS VARCHAR) AS day"))
def src_news_daily(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents"), _place(spark, "gkg")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 40).cast("int")), "yyyyMMdd")
    d.select(day.alias("date_str"), _tone().alias("tone_raw"), F.expr(_PLACES).alias("LOCATIONS"), F.expr(_THEMES).alias("THEMES"), F.col("text").alias("other")).write.parquet(path)
    return _news(S.daily_news_table(spark, path), F.col("date_utc").cast("string"), "day")


@query("src_news_quarters", news_sql("TIMESTAMP '2024-01-01' + to_minutes(15 * CAST(doc_id % 70 AS INT))", 10, "t AS time_start"))
def src_news_quarters(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents"), _place(spark, "gkg15")
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("doc_id") % 70) * 900_000_000)
    d.select(at.alias("date_utc"), _tone().alias("V2Tone"), F.expr(_PLACES).alias("Locations"), F.expr(_THEMES).alias("Themes")).write.parquet(path)
    return _news(S.quarter_news_table(spark, path), F.col("time_start").cast("timestamp_ntz"), "time_start")
