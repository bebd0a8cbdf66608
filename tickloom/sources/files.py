"""Readers of landed market files. Every reader has a declared schema; empty marker files give zero rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalar import adjustment_factor, to_number
from tickloom.session import ship_package
from tickloom.sources.tables import CLIENT_TYPES

# Fixed column order of the participant open-interest file.
OI_COLUMNS = """client_type future_index_long future_index_short future_stock_long future_stock_short
    option_index_call_long option_index_put_long option_index_call_short option_index_put_short
    option_stock_call_long option_stock_put_long option_stock_call_short option_stock_put_short
    total_long_contracts total_short_contracts""".split()


def _all_strings(cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` STRING" for c in cols)


def weekdays(df: DataFrame, date: str = "date") -> DataFrame:
    return df.filter(F.dayofweek(date).between(2, 6))


def participant_oi_files(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Day files named with yyyyMMdd (or in folders day=yyyyMMdd): a title line, a header, one line per participant and a
    total that is dropped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("place"))
    named = F.coalesce(F.nullif(F.regexp_extract("place", r"/day=(\d{8})/", 1), F.lit("")), F.regexp_extract("file", r"(\d{8})", 1))
    day = F.try_to_timestamp(named, F.lit("yyyyMMdd")).cast("date")
    rows = lines.select(day.alias("date"), F.from_csv("value", _all_strings(OI_COLUMNS)).alias("r")).select(
        "date", F.trim("r.client_type").alias("client_type"), *[to_number(f"r.{c}").alias(c) for c in OI_COLUMNS[1:]]
    )
    rows = rows.filter(F.col("client_type").isin(*CLIENT_TYPES))
    if start is not None and end is not None:
        rows = rows.filter(F.col("date").between(F.lit(start), F.lit(end)))
    return weekdays(rows)


INDEX_SCHEMA = _all_strings(
    ["Index Name", "Index Date", "Open Index Value", "High Index Value", "Low Index Value", "Closing Index Value",
     "Points Change", "Change(%)", "Volume", "Turnover (Rs. Cr.)", "P/E", "P/B", "Div Yield"]
)


def index_close_files(spark: SparkSession, path: str, index_name: str | None = None) -> DataFrame:
    raw = spark.read.csv(path, schema=INDEX_SCHEMA, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    if index_name:
        raw = raw.filter(F.lower(F.trim("Index Name")) == index_name.strip().lower())
    return raw.select(
        F.trim("Index Name").alias("index_name"),
        F.try_to_timestamp("Index Date", F.lit("dd-MM-yyyy")).cast("date").alias("date"),
        to_number("`Open Index Value`").alias("open"),
        to_number("`High Index Value`").alias("high"),
        to_number("`Low Index Value`").alias("low"),
        to_number("`Closing Index Value`").alias("close"),
    )


BHAV_SCHEMA = _all_strings(
    """SYMBOL SERIES DATE1 PREV_CLOSE OPEN_PRICE HIGH_PRICE LOW_PRICE LAST_PRICE CLOSE_PRICE AVG_PRICE TTL_TRD_QNTY
    TURNOVER_LACS NO_OF_TRADES DELIV_QTY DELIV_PER""".split()
)


def bhavcopy_files(spark: SparkSession, path: str, symbols: Sequence[str] | None = None, series: str = "EQ") -> DataFrame:
    """Full-market day files with delivery figures; `-` means none."""
    raw = spark.read.csv(path, schema=BHAV_SCHEMA, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="-")
    raw = raw.filter(F.trim("SERIES") == series)
    if symbols is not None:
        raw = raw.filter(F.trim("SYMBOL").isin(*symbols))
    return raw.select(
        F.trim("SYMBOL").alias("symbol"),
        F.try_to_timestamp(F.trim("DATE1"), F.lit("dd-MMM-yyyy")).cast("date").alias("date"),
        to_number("OPEN_PRICE").alias("open"),
        to_number("HIGH_PRICE").alias("high"),
        to_number("LOW_PRICE").alias("low"),
        to_number("CLOSE_PRICE").alias("close"),
        to_number("TTL_TRD_QNTY").alias("volume"),
        to_number("DELIV_QTY").alias("deliv_qty"),
        to_number("DELIV_PER").alias("deliv_pct"),
    )


def _unzipped(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Rows of zipped day CSVs as strings: files are spread over tasks, each opened where it is read."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for blob in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(blob)) as z, z.open(z.namelist()[0]) as f:
                    day = pd.read_csv(f, dtype=str, keep_default_na=False, skipinitialspace=True)
                day.columns = [c.strip() for c in day.columns]
                yield day.reindex(columns=list(cols))

    ship_package()
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, _all_strings(cols))


def zipped_bhavcopy_files(spark: SparkSession, path: str) -> DataFrame:
    cols = "SYMBOL SERIES OPEN HIGH LOW CLOSE LAST PREVCLOSE TOTTRDQTY TOTTRDVAL TIMESTAMP".split()
    raw = _unzipped(spark, path, cols).filter(F.trim("SERIES") == "EQ")
    return raw.select(
        F.trim("SYMBOL").alias("symbol"),
        F.try_to_timestamp(F.initcap(F.trim("TIMESTAMP")), F.lit("d-MMM-yyyy")).cast("date").alias("date"),
        *[to_number(c).alias(n) for c, n in zip("OPEN HIGH LOW CLOSE TOTTRDQTY TOTTRDVAL".split(), "open high low close volume turnover".split())],
    )


def zipped_derivative_files(spark: SparkSession, path: str) -> DataFrame:
    # Fixed column list of the derivatives day file.
    cols = """INSTRUMENT SYMBOL EXPIRY_DT STRIKE_PR OPTION_TYP OPEN HIGH LOW CLOSE SETTLE_PR CONTRACTS VAL_INLAKH OPEN_INT CHG_IN_OI TIMESTAMP""".split()
    text = {"INSTRUMENT", "SYMBOL", "OPTION_TYP"}
    raw = _unzipped(spark, path, cols)
    dates = {"EXPIRY_DT", "TIMESTAMP"}
    pick = [
        F.try_to_timestamp(F.initcap(F.trim(c)), F.lit("d-MMM-yyyy")).cast("date").alias(c.lower())
        if c in dates
        else (F.trim(c) if c in text else to_number(c)).alias(c.lower())
        for c in cols
    ]
    return raw.select(*pick)


def universe(spark: SparkSession, path: str, fallback: DataFrame, column: str = "Symbol") -> DataFrame:
    """Symbols listed in a CSV, or the fallback list when the file has none."""
    listed = spark.read.csv(path, header=True).select(F.trim(column).alias("symbol")).dropna().distinct()
    n = listed.agg(F.count(F.lit(1))).scalar()
    return listed.unionByName(fallback.select("symbol").filter(n == 0))


ACTION_SCHEMA = "symbol STRING, subject STRING, purpose STRING, exDate STRING, exdate_ STRING"


def corporate_action_files(spark: SparkSession, path: str) -> DataFrame:
    """JSON actions to (symbol, ex_date, factor, purpose); sentences without a known factor are skipped."""
    raw = spark.read.text(path)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    text = F.coalesce(F.nullif(get("subject"), F.lit("")), get("purpose"))
    when = F.coalesce(get("exDate"), get("exdate"))
    day = F.coalesce(*[F.try_to_timestamp(when, F.lit(f)) for f in ("dd-MMM-yyyy", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd")])
    out = raw.select(get("symbol").alias("symbol"), day.cast("date").alias("ex_date"), adjustment_factor(text).alias("factor"), text.alias("purpose"))
    return out.filter(F.col("ex_date").isNotNull() & F.col("factor").isNotNull())


def normalise_provider(df: DataFrame, rename: dict[str, str], zone: str | None = None) -> DataFrame:
    """Provider bars to the common schema: renamed, exchange-local clock time, turnover, one row per (symbol, date)."""
    d = df.withColumnsRenamed(rename)
    if zone:
        d = d.withColumn("date", F.from_utc_timestamp("date", zone))
    d = d.withColumn("turnover", F.col("close") * F.col("volume"))
    if "load_order" not in d.columns:
        raise ValueError("provider rows need a load_order: the last loaded of two rows for one bar is kept")
    keep = F.struct("open", "high", "low", "close", "volume", "turnover")
    return d.groupBy("symbol", "date").agg(F.max_by(keep, F.col("load_order")).alias("b")).select("symbol", "date", "b.*")


def with_ticker(df: DataFrame, dictionary: DataFrame, suffix: str = ".NS") -> DataFrame:
    """Provider ticker per symbol from a dictionary, default symbol + suffix."""
    return df.join(dictionary.select("symbol", "ticker"), "symbol", "left").withColumn(
        "ticker", F.coalesce("ticker", F.concat("symbol", F.lit(suffix)))
    )


IPO_SCHEMA = "symbol STRING, companyName STRING, issueStartDate STRING, issueEndDate STRING"
STATE_SCHEMA = "last_run STRING, verdict STRING, _corrupt STRING"


def ipo_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IPO_SCHEMA).json(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Saved job state: the two fields that jobs ask for and the whole document as it is written.

    A corrupt document gives NULL fields, not an error.
    """
    d = spark.read.text(path, wholetext=True)
    field = lambda n: F.get_json_object("value", f"$.{n}").alias(n)
    return d.select(field("last_run"), field("verdict"), F.col("value").alias("document"))


def write_state(df: DataFrame, path: str) -> None:
    """Writes every column of the state as a field of its document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def is_due(state: DataFrame, as_of: str, every_days: int = 30) -> DataFrame:
    """True when there is no readable last run or it is at least `every_days` old."""
    last = F.max(F.try_to_timestamp("last_run"))
    return state.agg(F.coalesce(F.datediff(F.lit(as_of).cast("date"), last) >= every_days, F.lit(True)).alias("due"))


def append_events(df: DataFrame, path: str) -> None:
    """Audit rows of signals, executions and closes."""
    cols = ["event_type", "symbol", "action", F.round("confidence", 4).alias("confidence"), "regime", "model_version", "quantum_depth", "metadata"]
    df.select(*cols).write.mode("append").json(path)
