"""Logs read line by line against a plain reader, cycles over landed files, and the bars around trades."""

import datetime as dt
import random
import re

import pytest

from quantloom.operators import atlas
from quantloom.sources import discovery, logs


def plain_trades(lines):
    """One trade at a time: opened by an entry, closed by exits, ended by the first profit after one."""
    trades, open_ = [], None
    for line in lines:
        try:
            time = dt.datetime.strptime(line.split(",")[0], "%Y-%m-%d %H:%M:%S")
        except ValueError:
            continue
        if m := re.search(logs.ENTRY, line):
            open_ = {"entry": time, "side": m[1], "lots": float(m[2]), "strategy": m[3], "price": float(m[4]), "exit": None}
        elif (m := re.search(logs.EXIT, line)) and open_:
            if open_["exit"] is None:
                trades.append(open_)
            open_ |= {"exit": time, "reason": m[1].strip(), "left": float(m[2]), "pnl": 0.0}
        elif (m := re.search(logs.PNL, line)) and open_ and open_["exit"]:
            try:
                open_["pnl"] = float(m[1].replace(",", ""))
            except ValueError:
                pass
            open_ = None
    return sorted((t["entry"], t["side"], t["lots"], t["strategy"], t["price"], t["exit"], t["left"], t["reason"], t["pnl"]) for t in trades)


def made(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        t = (dt.datetime(2024, 1, 2) + dt.timedelta(seconds=7 * i)).strftime("%Y-%m-%d %H:%M:%S")
        what = r.choice([f"VIRTUAL ENTRY: {r.choice(['BUY', 'SELL'])} {r.randint(1, 4)}.00 lots (Risk $600) Strat My strat {r.randint(1, 9)} @ {r.random():.5f} | SL:1x", f"VIRTUAL EXIT: {r.choice(['SL', 'TP', 'Signal Reversal'])} @ {r.random():.5f} (barrier @ 1.2)", f"Trade PnL: ${r.choice(['-12.50', '1,234.5', '+3', ',.', '-'])} | Bal: $1", "Trade PnL: lost", "heartbeat", ""])
        out.append((f"{t},123 - INFO - {what}" if r.random() < 0.95 else f"broken {what}"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closed_trades_over_split_files(spark, tmp_path, seed):
    lines = made(seed, 600)
    for k in range(3):
        (tmp_path / f"paper-{k}.log").write_text("\n".join(lines[200 * k : 200 * (k + 1)]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # each file in several splits
    try:
        events = logs.trade_events(spark, f"{tmp_path}/*.log")
        got = sorted(tuple(r) for r in logs.closed_trades(events).collect())
        tail = [r.line for r in logs.last_lines(spark, f"{tmp_path}/*.log", 250).orderBy("number").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == plain_trades(lines) and len(got) > 30
    assert tail == [x.strip() for x in lines[-250:]]


def test_zones_and_logs_without_trades(spark, tmp_path):
    (tmp_path / "a.log").write_text("2024-01-02 10:00:00,1 - VIRTUAL EXIT: SL @ 1.5\n2024-01-02 10:00:01,1 - Trade PnL: $5\nx\n")
    events = logs.trade_events(spark, f"{tmp_path}/a.log", "Etc/GMT+5")
    assert events.first().time == dt.datetime(2024, 1, 2, 15) and logs.closed_trades(events).count() == 0
    (tmp_path / "b.log").write_text("")
    assert logs.closed_trades(logs.trade_events(spark, f"{tmp_path}/b.log")).count() == 0 and logs.last_lines(spark, f"{tmp_path}/b.log").count() == 0


def test_discovery_cycles(spark, tmp_path):
    def land(stamp, name="f"):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}_{stamp}.csv").write_text(f"{stamp}\n")

    for stamp in ("20240110100000", "20240110101500", "20240108095000", "20240108094500", "20240110102500", "20240101000000", "20240110111500", "20240109000000"):
        land(stamp)
    land("20240110101500", "again")
    now = "2024-01-10 10:32:00"  # the cutoff is 10:27, the window begins at 10:15 two days before
    table = discovery.states(discovery.listed(spark, f"{tmp_path}/in"), discovery.ledger(spark, f"{tmp_path}/seen"), now)
    state = {r.stamp: r.state for r in table.collect()}
    assert {k: v for k, v in state.items() if v != "missing"} == {"20240110100000": "new", "20240110101500": "new", "20240108095000": "late", "20240108094500": "late", "20240110102500": "off", "20240101000000": "late", "20240110111500": "early", "20240109000000": "new"}
    assert sum(v == "missing" for v in state.values()) == 2 * 96 + 1 - 3 and state["20240108101500"] == "missing"
    read = lambda paths: spark.read.schema("v string").csv(paths)
    cycle = lambda now, k: discovery.take(spark, f"{tmp_path}/in", f"{tmp_path}/seen", now, read, k)
    first = sorted(r.v for r in cycle(now, 1).collect())
    assert first == ["20240109000000", "20240110100000", "20240110101500"]
    assert sorted(r.v for r in cycle(now, 1).collect()) == first  # a cycle that is run again
    assert cycle(now, 2) is None
    land("20240108110000")  # late, but due still
    assert sorted(r.v for r in cycle("2024-01-10 11:21:00", 2).collect()) == ["20240110111500"]
    assert sorted(r.v for r in cycle("2024-01-10 11:04:00", 3).collect()) == ["20240108110000"]
    assert discovery.listed(spark, f"{tmp_path}/none").count() == 0


def test_atlas_meets_by_buckets(spark):
    r = random.Random(1)
    bars = [(s, i, i * 60, 100 + r.random()) for s in "ab" for i in range(700)]
    trades = [(r.choice("ab"), f"s{r.randint(0, 1)}", e, e, min(699, e + r.randint(0, 300)), min(699, e), 1.0, "stop") for e in r.sample(range(700), 60)]
    trades = [(s, k, e, e + (x - e), e, x, side, why) for s, k, e, _, x, _, side, why in trades]
    df = spark.createDataFrame(trades, "series string, strategy_id string, entry_bar long, exit_bar long, entry_place long, exit_place long, side double, reason string")
    rows = atlas.around(atlas.numbered_trades(df, most=5), spark.createDataFrame(bars, "series string, place long, time long, close double"), bucket=64)
    got = sorted((x.series, x.strategy_id, x.trade, x.place, x.offset, x.active, x.mark) for x in rows.collect())
    want = []
    for key in {(s, k) for s, k, *_ in trades}:
        for n, t in enumerate(sorted((t for t in trades if t[:2] == key), key=lambda t: (t[2], t[3]))[:5], 1):
            e, x = t[4], t[5]
            want += [(*key, n, p, p - e, e <= p <= x, "ENTRY" if p == e else "STOP" if p == x else None) for p in range(max(0, e - 30), min(700, x + 30))]
    assert got == sorted(want, key=lambda w: w[:5])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "_bucket" in plan
    f = atlas.frames(rows).first()
    assert f.bars > 0 and f.bottom < f.top
