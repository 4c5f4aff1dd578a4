import datetime as dt

from pyspark.sql import functions as F

from quantloom.sources import readers


def test_calendar_and_news(spark, tmp_path):
    (tmp_path / "cal.csv").write_text("timestamp_utc,event,impact\n2024-01-05 13:30:00,NFP,High\nbad,Other,Low\n")
    got = readers.calendar_csv(spark, f"{tmp_path}/cal.csv").orderBy("kind").collect()
    assert [(r.kind, r.ts) for r in got] == [(0, None), (1, dt.datetime(2024, 1, 5, 13, 30))]
    head = "\t".join(readers.DAILY_NEWS)
    row = lambda tone, place, theme: "\t".join(["20240105", "3", "", theme, place, "", "", tone, "", "", ""])
    (tmp_path / "n.tsv").write_text("\n".join([head, row("1.5,2,3,4,5,6", "RUSSIA", "CPI"), row("x", "DE", ""), row("-1,2", "US", "OIL")]))
    news = readers.daily_news(spark, f"{tmp_path}/n.tsv")
    assert sorted((r.tone_mean is None, r.tone_positive) for r in news.collect()) == [(False, 2.0), (False, 2.0), (True, None)]
    wide = readers.news_measures(news, "date_utc").first()
    assert (wide.total_volume, wide.usd_volume, wide.usd_tone, wide.inflation_volume) == (3, 2, 0.25, 1)
    assert readers.news_measures(news, "date_utc", whole_words=True).first().usd_volume == 1


def test_headerless_files_and_batches(spark, tmp_path):
    (tmp_path / "20240105093000.events.tsv").write_text("a\tb\t20240105093000\nc\n")
    got = readers.headerless_tsv(spark, f"{tmp_path}/*.tsv", {"id": 0, "when": 2}, 5).withColumn("t", readers.stamp(F.col("when"))).orderBy("id").collect()
    assert [(r.id, r.t, r.batch_ts) for r in got] == [("a", dt.datetime(2024, 1, 5, 9, 30), "20240105093000"), ("c", None, "20240105093000")]
    assert [r.batch for r in readers.processed_batches(spark, str(tmp_path)).collect()] == ["20240105093000"]


def test_tape_log_and_upsert(spark, tmp_path):
    nan = float("nan")
    spark.createDataFrame([(1, 10.0, 12.0, None), (1, 10.0, 12.0, None), (2, nan, 12.0, 11.5), (3, None, None, None)], "ts long, pricebid double, priceask double, last_price double").write.parquet(f"{tmp_path}/t")
    assert sorted(r.mid for r in readers.quote_tape(spark, f"{tmp_path}/t", "x").collect()) == [11.0, 11.5]
    old, new = spark.createDataFrame([(1, "a", 1)], "k long, v string, at long"), spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k long, v string, at long")
    assert sorted(map(tuple, readers.upsert(old, new, ["k"], F.col("at")).collect())) == [(1, "b", 2), (2, "c", 1)]
    readers.write_by_day(spark.sql("select 'x' series, timestamp'2024-01-05 10:00:00' ts, 1 v"), f"{tmp_path}/days")
    assert spark.read.parquet(f"{tmp_path}/days").where("day = '2024-01-05'").count() == 1


def test_strategy_files_and_state(spark, tmp_path):
    (tmp_path / "strategies_60.json").write_text('[{"name": "raw", "test_return": 0.2}]')
    (tmp_path / "strategies_60_top10.json").write_text('{"name": "ten", "horizon": 5}')
    (tmp_path / "broken.json").write_text("{")
    assert [(s["name"], s["horizon"]) for s in readers.strategy_file(spark, str(tmp_path), 60)] == [("ten", 5)]
    found = readers.find_strategy(spark, [f"{tmp_path}/none_*.json", f"{tmp_path}/broken.json", f"{tmp_path}/strategies_*.json"], "raw")
    assert found["horizon"] == 60 and found["metrics"]["robust_return"] == 0.2 and found["metrics"]["sortino_oos"] == -999
    assert readers.find_strategy(spark, [f"{tmp_path}/strategies_*.json"], "nobody") is None and readers.strategy_file(spark, str(tmp_path), 7) == []
    assert readers.load_state(spark, f"{tmp_path}/state") is None
    for v in (1, 12, 2):
        readers.save_state(spark.createDataFrame([(v,)], "v int"), f"{tmp_path}/state", v)
    (tmp_path / "state" / "version=13").mkdir()  # a write that did not end
    assert readers.load_state(spark, f"{tmp_path}/state").first().v == 12
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert readers.cached(spark, f"{tmp_path}/cache", f"{tmp_path}/strategies_60.json", make).count() == 3
    assert len(made) == 1
