"""Live bars that are cut and started again: at any tick, with ticks that come twice, and with a bounded ring."""

import random

import pandas as pd
import pytest

from quantloom.streaming import live, resume


def tape(n, seed, series="a"):
    r = random.Random(seed)
    at = pd.Timestamp("2024-01-02")
    rows = []
    for i in range(n):
        at += pd.Timedelta(seconds=r.choice([0, 0, 1, 7]))  # several ticks of one time
        rows.append((series, at, i, float(r.randint(1, 9)), float(r.choice([0, 1, 2, 5]))))
    return pd.DataFrame(rows, columns=["series", "ts", "seq", "mid", "vol"])


def test_any_cut_and_any_overlap():
    ticks = tape(60, 1)
    whole, left = resume.next_bars(ticks, None, 9.0)
    assert len(whole) > 5
    for cut in range(61):
        for back in (0, 1, 10, 60):
            a, held = resume.next_bars(ticks.iloc[:cut], None, 9.0)
            b, end = resume.next_bars(ticks.iloc[max(0, cut - back) :].sample(frac=1, random_state=cut), held, 9.0)
            assert a + b == whole and end == left
    assert resume.next_bars(pd.concat([ticks, ticks]), None, 9.0) == (whole, left)


@pytest.mark.parametrize("cut", [0, 1, 17, 40, 59, 60])
def test_warm_state_goes_on_from_bars_alone(spark, cut):
    both = pd.concat([tape(60, 2), tape(45, 3, "b")])
    history = spark.createDataFrame(both)
    made, rows = {}, []
    for s, ticks in both.groupby("series"):
        made[s] = resume.next_bars(ticks, None, 9.0)
        rows += [(s, *b, True) for b in resume.next_bars(ticks.iloc[:cut], None, 9.0)[0]]
    bars = spark.createDataFrame(rows, resume.LIVE_SCHEMA)
    gap = resume.missing_ticks(history.where(f"seq < {max(50, cut)}"), bars)
    state = resume.warm_state(bars.union(bars), gap, 9.0).toPandas()
    for s, ticks in both.groupby("series"):
        mine = state[state["series"] == s]
        done = sorted(tuple(x) for x in mine[mine["kind"] != "open"][resume._BARS].itertuples(index=False, name=None))
        early, open_ = resume.next_bars(ticks[ticks["seq"] < max(50, cut)], None, 9.0)
        assert [x[0] for x in done] == [x[0] for x in early] and [x[8] for x in done] == [x[8] for x in early]
        o = mine[mine["kind"] == "open"].iloc[0]
        assert (o["bar_no"], o["ticks"], o["volume"]) == (open_[0], open_[10], open_[8]) or (open_[10] == 0 and o["bar_no"] == open_[0])


def test_limits_of_a_gap(spark):
    t = lambda h, m=0, s=0: pd.Timestamp(2024, 1, 2, h, m, s).to_pydatetime()
    history = spark.createDataFrame([("a", t(h, m), h * 60 + m, 1.0, 1.0) for h in range(12) for m in (0, 30)] + [("new", t(1), 1, 1.0, 1.0), ("a", t(11, 59, 45), 9999, 1.0, 1.0)], "series string, ts timestamp, seq long, mid double, vol double")
    bars = spark.createDataFrame([("a", 0, t(0), t(6), 360, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 3, True)], resume.LIVE_SCHEMA)
    seq = lambda **k: sorted(r.seq for r in resume.missing_ticks(history, bars, "2024-01-02 12:00:00", **k).collect())
    assert seq() == [1, 600, 630, 660, 690]
    assert seq(most=None) == [1, *range(390, 691, 30)]
    assert seq(least="7 hours") == [1]
    assert len(resume.missing_ticks(history, bars).collect()) == 13


def test_ring_is_bounded_and_replays_are_dropped(spark, tmp_path):
    ticks = tape(400, 4)
    whole, _ = resume.next_bars(ticks, None, 9.0)
    for k in range(8):  # files that overlap by half
        part = ticks.iloc[max(0, 50 * k - 25) : 50 * (k + 1)]
        raw = pd.DataFrame({"event_id": part["seq"], "ts": part["ts"], "user_id": 0, "event_type": "a", "value": part["mid"], "props": [f'{{"k": {v}}}' for v in part["vol"]]})
        raw.astype({"ts": "datetime64[us]", "user_id": "int64"}).to_parquet(f"{tmp_path}/in-{k}.parquet")
    sizes = []

    def each(batch, number, place):
        sizes.append(batch.count())
        return batch

    stream = live.tick_stream(spark, f"{tmp_path}/in-*")
    out = live.run_once(resume.live_bars(stream, 9.0, keep=6, window=True), str(tmp_path / "work"), each=each, rocks=True)
    assert len(sizes) >= 8 and max(sizes) == 6  # as much in the last batch as in the second
    got = sorted((r.bar_no, r.volume, r.ticks) for r in out.where("fresh").select("bar_no", "volume", "ticks").distinct().collect())
    kept = [(b[0], b[8], b[10]) for b in whole]
    assert set(got) <= set(kept) and got[-1] == kept[-1]
