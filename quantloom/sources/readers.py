"""File sources (SRC01-SRC10, SRC16-SRC19) and sinks (SNK01-SNK09), all declared; nothing is inferred from data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.frames import clean
from quantloom.functions.parsing import tone_parts
from quantloom.operators.cleaning import keep_one
from quantloom.sources.discovery import listed

#: Codes of scheduled events, and the columns of the landed news files.
EVENT_CODES = {"NFP": 1, "CPI": 2, "FOMC": 3, "ECB": 4}
DAILY_NEWS = ("DATE", "NUMARTS", "COUNTS", "THEMES", "LOCATIONS", "PERSONS", "ORGANIZATIONS", "TONE", "CAMEOEVENTIDS", "SOURCES", "SOURCEURLS")


#: Place of each column that is read from the headerless event and mention files, and their widths.
EVENTS = {
    "GlobalEventID": 0, "SQLDATE": 1, "MonthYear": 2, "Year": 3, "FractionDate": 4, "EventCode": 26, "EventRootCode": 28, "NumMentions": 31, "NumSources": 32, "NumArticles": 33, "AvgTone": 34,
    "Actor1Geo_Type": 35, "Actor1Geo_FullName": 36, "Actor1Geo_CountryCode": 37, "Actor1Geo_Lat": 40, "Actor1Geo_Long": 41, "Actor1Geo_FeatureID": 42,
    "Actor2Geo_Type": 43, "Actor2Geo_FullName": 44, "Actor2Geo_CountryCode": 45, "Actor2Geo_Lat": 48, "Actor2Geo_Long": 49, "Actor2Geo_FeatureID": 50,
    "ActionGeo_Type": 51, "ActionGeo_FullName": 52, "ActionGeo_CountryCode": 53, "ActionGeo_Lat": 56, "ActionGeo_Long": 57, "ActionGeo_FeatureID": 58, "DATEADDED": 59, "SOURCEURL": 60,
}
MENTIONS = {
    "GlobalEventID": 0, "EventTimeDate": 1, "MentionTimeDate": 2, "MentionType": 3, "MentionSourceName": 4, "MentionIdentifier": 5, "MentionDocLen": 6, "MentionDocTone": 7, "SentenceID": 8,
    "Actor1CharOffset": 9, "Actor2CharOffset": 10, "ActionCharOffset": 11, "InRawText": 12, "Confidence": 13,
}
EVENT_WIDTH, MENTION_WIDTH = 61, 14
#: What places and themes of news records are counted by.
EUR_PLACES = ("EUROPE", "BRUSSELS", "GERMANY", "FRANCE", "ITALY", "SPAIN", "EUR", "EURO")
USD_PLACES = ("UNITED STATES", "US", "WASHINGTON", "NEW YORK", "AMERICA", "FED")
LOCAL_PLACES = ("GERMANY", "BERLIN", "DE")
THEMES = {"conflict": "ARMEDCONFLICT|CRISISLEX|UNREST", "epu": "EPU", "inflation": "ECON_INFLATION|TAX_FNCACT", "bank": "CENTRAL_BANK", "energy": "ENV_OIL|ECON_ENERGY_PRICES"}


def quote_tape(spark: SparkSession, pattern: str, series: str) -> DataFrame:
    """Ticks of a parquet glob (SRC01): unreadable files are skipped, equal rows dropped, NaN is NULL, mid chosen."""
    raw = spark.read.option("ignoreCorruptFiles", "true").parquet(pattern).dropDuplicates()
    have = set(raw.columns)
    mid = [(clean("pricebid") + clean("priceask")) / 2] if {"pricebid", "priceask"} <= have else []
    price = F.coalesce(*[clean(c) for c in ("mid_price",) if c in have], *mid, *[clean(c) for c in ("last_price",) if c in have])
    return raw.withColumns({"series": F.lit(series), "mid": price}).where("mid is not null")


def calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ts, event, impact, kind) of the event calendar (SRC05); unknown events have kind 0."""
    rows = spark.read.option("header", "true").schema("timestamp_utc string, event string, impact string").csv(path)
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in EVENT_CODES.items() for x in p])[F.upper("event")], F.lit(0))
    return rows.select(F.expr("try_to_timestamp(timestamp_utc)").alias("ts"), "event", "impact", kind.alias("kind"))


def daily_news(spark: SparkSession, path: str) -> DataFrame:
    """Daily news records with a header (SRC07): tone split into six numbers, malformed numbers NULL."""
    raw = spark.read.option("sep", "\t").option("header", "true").option("quote", "").option("mode", "PERMISSIVE").schema(", ".join(f"{c} string" for c in DAILY_NEWS)).csv(path)
    names = ("tone_mean", "tone_positive", "tone_negative", "tone_polarity", "tone_activity", "tone_word_count")
    return raw.select(F.expr("try_to_date(DATE, 'yyyyMMdd')").alias("date_utc"), F.col("NUMARTS").try_cast("long").alias("num_articles"), "THEMES", "LOCATIONS", *[t.alias(n) for n, t in zip(names, tone_parts(F.col("TONE")), strict=True)])


def news_masks(places: Column, themes: Column) -> dict[str, Column]:
    """The masks of ``cross.news_table``: substrings of upper-case places, patterns of themes."""
    where = F.upper(F.coalesce(places, F.lit("")))
    what = F.coalesce(themes, F.lit(""))
    return {"eur": where.rlike("|".join(EUR_PLACES)), "usd": where.rlike("|".join(USD_PLACES)), "local": where.rlike("|".join(LOCAL_PLACES))} | {k: what.rlike(v) for k, v in THEMES.items()}


def daily_news_table(spark: SparkSession, pattern: str) -> DataFrame:
    """``cross.NEWS`` columns by day from raw parquet records (SRC02): four columns are read; records without a day go."""
    from quantloom.operators.cross import news_table

    raw = spark.read.schema("date_str string, tone_raw string, LOCATIONS string, THEMES string").parquet(pattern)
    tone = tone_parts(F.col("tone_raw"))
    rows = raw.select(F.expr("try_to_date(date_str, 'yyyyMMdd')").alias("date_utc"), tone[0].alias("tone"), tone[3].alias("polarity"), "LOCATIONS", "THEMES").where("date_utc is not null")
    masks = news_masks(F.col("LOCATIONS"), F.col("THEMES"))
    return news_table(rows.select("date_utc", "tone", "polarity", *[m.alias(k) for k, m in masks.items()]), "date_utc", {k: F.col(k) for k in masks})


def quarter_news_table(spark: SparkSession, pattern: str) -> DataFrame:
    """``cross.NEWS`` columns by time_start from 15-minute parquet records (SRC03), the tone from V2Tone."""
    from quantloom.operators.cross import news_table

    raw = spark.read.schema("date_utc timestamp, V2Tone string, Locations string, Themes string").parquet(pattern)
    tone = tone_parts(F.col("V2Tone"))
    masks = news_masks(F.col("Locations"), F.col("Themes"))
    rows = raw.where("date_utc is not null").select(F.col("date_utc").alias("time_start"), tone[0].alias("tone"), tone[3].alias("polarity"), *[m.alias(k) for k, m in masks.items()])
    return news_table(rows, "time_start", {k: F.col(k) for k in masks}, least=10)


def headerless_tsv(spark: SparkSession, path: str, columns: dict[str, int], width: int) -> DataFrame:
    """Chosen columns (name: position) of a headerless, unquoted, all-string TSV of ``width`` columns (SRC08-SRC10), with
    the 14-digit stamp of the file name as batch_ts."""
    raw = spark.read.option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").schema(", ".join(f"c{i} string" for i in range(width))).csv(path)
    return raw.select(*[F.col(f"c{i}").alias(n) for n, i in columns.items()], F.regexp_extract(F.input_file_name(), r"(\d{14})", 1).alias("batch_ts"))


#: The 27 columns of a news record that are kept, by position: fixed names of the format.
NEWS_RECORDS = {"GKGRECORDID": 0, "DATE": 1, "SourceCommonName": 3, "DocumentIdentifier": 4, "Counts": 5, "Themes": 7, "Locations": 9, "V2Tone": 15}
NEWS_WIDTH = 27


def news_records(spark: SparkSession, path: str) -> DataFrame:
    """News records (SRC08): NEWS_RECORDS columns, date_utc (NULL where malformed), tone_mean and tone_polarity (first and
    fourth part of the tone; NULL where they are no numbers), batch_ts."""
    rows = headerless_tsv(spark, path, NEWS_RECORDS, NEWS_WIDTH)
    tone = F.split("V2Tone", ",")
    part = lambda k: F.get(tone, F.lit(k)).try_cast("double")
    return rows.withColumns({"tone_mean": part(0), "tone_polarity": part(3), "date_utc": stamp(F.col("DATE"))})


def event_files(spark: SparkSession, path: str) -> DataFrame:
    """Event records (SRC09): EVENTS columns, sql_date and date_added_utc (NULL where malformed), batch_ts."""
    rows = headerless_tsv(spark, path, EVENTS, EVENT_WIDTH)
    return rows.withColumns({"sql_date": F.expr("try_to_date(SQLDATE, 'yyyyMMdd')"), "date_added_utc": stamp(F.col("DATEADDED"))})


def mention_files(spark: SparkSession, path: str) -> DataFrame:
    """Mention records (SRC10): MENTIONS columns, both times and the tone as a number, batch_ts."""
    rows = headerless_tsv(spark, path, MENTIONS, MENTION_WIDTH)
    return rows.withColumns({"event_time_utc": stamp(F.col("EventTimeDate")), "mention_time_utc": stamp(F.col("MentionTimeDate")), "doc_tone": F.col("MentionDocTone").try_cast("double")})


def utc_times(df: DataFrame, columns: list[str], zone: str = "UTC") -> DataFrame:
    """Times as UTC instants (SRC06): those without a zone are read as ``zone``'s; others are instants already."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.to_utc_timestamp(F.col(c).cast("timestamp"), zone) if kinds[c] in ("timestamp_ntz", "string") else F.col(c).cast("timestamp") for c in columns})


def newest_change(spark: SparkSession, path: str) -> Column | None:
    """The latest modification time of the files under a path; None without files. Only the listing is read."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.max("modificationTime")).first()[0]
    except AnalysisException:
        return None


def cached(spark: SparkSession, cache: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, kept at ``cache`` and made anew only where ``source`` has changed since (SRC04)."""
    have, source_at = newest_change(spark, cache), newest_change(spark, source)
    if have is None or (source_at is not None and source_at > have):
        make().write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def strategy_file(spark: SparkSession, folder: str, horizon: int) -> list[dict]:
    """Strategies of one horizon (SRC16) from the first of its files that there is: the five unique best, the ten best, the
    raw list. horizon and metrics are filled in where they are missing."""
    from quantloom.operators.signals import read_strategies

    for tail in ("_top5_unique", "_top10", ""):
        try:
            found = read_strategies(spark, f"{folder}/strategies_{horizon}{tail}.json")
        except AnalysisException:
            continue
        return [with_metrics(s, horizon) for s in found]
    return []


def with_metrics(strategy: dict, horizon: int | None = None) -> dict:
    """The strategy with horizon and metrics (SRC16): robust_return and sortino_oos fall back to the test figures, then to
    -999, the mark of none."""
    m, s = strategy.get("metrics") or {}, strategy
    robust = m.get("robust_return", s.get("robust_return", s.get("test_return", -999)))
    return s | {"horizon": s.get("horizon", horizon), "metrics": {"robust_return": robust, "full_return": m.get("full_return", s.get("full_return", -999)), "sortino_oos": m.get("sortino_oos", s.get("test_sortino", -999))}}


def find_strategy(spark: SparkSession, patterns: list[str], name: str) -> dict | None:
    """The first strategy of a name in the files of ``patterns``, in their order (SRC17); its horizon is the number in the
    file's name where it has none."""
    from quantloom.operators.signals import parse_strategies

    for pattern in patterns:
        try:
            rows = spark.read.text(pattern, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"_(\d+)[_.][^/]*$", 1).try_cast("int").alias("h"), F.input_file_name().alias("f")).orderBy("f").collect()
        except AnalysisException:
            continue
        for r in rows:  # a handful of configuration files
            for s in parse_strategies(r["value"]):
                if s.get("name") == name:
                    return with_metrics(s, r["h"])
    return None


def stamp(text: Column) -> Column:
    """'YYYYMMDDHHMMSS' as a time; anything else NULL."""
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def news_measures(rows: DataFrame, by: str, places: str = "LOCATIONS", themes: str = "THEMES", masks: dict[str, str] | None = None, whole_words: bool = False) -> DataFrame:
    """Volume and mean tone by mask and time (SRC02, SRC03, F043, AG02): masks are regular expressions on places or, with
    a leading '@', on themes. Substrings match by default, as in the surveyed system; ``whole_words`` is stricter."""
    masks = masks or {"usd": "US", "eur": "EU|DE|FR", "inflation": "@INFLATION|CPI", "central_bank": "@CENTRAL_BANK", "energy": "@OIL|GAS|ENERGY"}
    made: list[Column] = [F.count("*").alias("total_volume")]
    for name, m in masks.items():
        pattern = rf"\b({m.lstrip('@')})\b" if whole_words else m.lstrip("@")
        hit = F.coalesce(F.col(themes if m[0] == "@" else places).rlike(pattern), F.lit(False))
        n = F.count_if(hit)
        made += [n.alias(f"{name}_volume"), (F.sum(F.when(hit, F.col("tone_mean"))) / F.when(n == 0, 1).otherwise(n)).alias(f"{name}_tone")]
    return rows.groupBy(by).agg(*made)


def processed_batches(spark: SparkSession, path: str) -> DataFrame:
    """Distinct 14-digit stamps in the paths of the files under a folder (SRC19); only the listing is read."""
    return listed(spark, path).select(F.col("stamp").alias("batch"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """Union with the newest row of each key kept (SNK03, SNK04); write it to another place than ``existing``."""
    return keep_one(existing.unionByName(new, allowMissingColumns=True), keys, [newest.desc()])


def write_by_day(df: DataFrame, path: str, instrument: str = "series", ts: str = "ts") -> None:
    """Parquet partitioned by instrument and day, appended (SNK05)."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy(instrument, "day").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    """Parquet in place of what was there (SNK01)."""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Parquet beside what is there; nothing is read or rewritten (SNK02)."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with a header (SNK06)."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (SNK07)."""
    df.write.mode("overwrite").json(path)


def save_state(state: DataFrame, folder: str, version: int) -> None:
    """A state table under its version (SNK08): a version counts only once it is whole, so readers see the old or the new
    one."""
    state.write.mode("overwrite").parquet(f"{folder}/version={version}")


def load_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole version of a state table; None if there is none (SNK08)."""
    versions = [v for v in completed(spark, f"{folder}/version=*") if v]
    numbers = sorted(int(v.rsplit("version=", 1)[1]) for v in versions)
    return spark.read.parquet(f"{folder}/version={numbers[-1]}") if numbers else None


def completed(spark: SparkSession, pattern: str) -> list[str]:
    """Folders of a pattern that hold the mark of a finished write (SNK09); any store that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")  # hidden from file sources
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(f.getPath().getParent().toString() for f in found)
