"""Readers over market files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.catalog.data_cat import _ACT, _J, corporate_actions, journal
from tickloom.catalog.sqltext import BENCH, DAILY, LINE, OI, final
from tickloom.functions.scalar import rounded
from tickloom.artifacts import Store
from tickloom.catalog.flow_cat import _WIDE
from tickloom.operators import flow as fl
from tickloom.operators import journal as jn
from tickloom.session import cut_lineage, scratch_path
from tickloom.sources import files as fs
from tickloom.sources import ingest as ig
from tickloom.sources import tables as tb

QUERIES, SQL = {}, {}


def _folder(spark):
    return scratch_path(spark, "files")


def _bhav(spark, d):
    path = _folder(spark)
    b = tb.bars_daily(spark, d)
    num = lambda c: F.round(c, 2).cast("decimal(18,2)").cast("string")
    rows = b.select(
        F.concat(F.lit(" "), "symbol").alias("SYMBOL"), F.when(F.day("date") % 7 == 0, " BE").otherwise(" EQ").alias("SERIES"),
        F.date_format("date", " dd-MMM-yyyy").alias("DATE1"), F.lit("1.0").alias("PREV_CLOSE"), num("open").alias("OPEN_PRICE"), num("high").alias("HIGH_PRICE"),
        num("low").alias("LOW_PRICE"), num("close").alias("LAST_PRICE"), num("close").alias("CLOSE_PRICE"), num("close").alias("AVG_PRICE"),
        F.col("volume").cast("long").cast("string").alias("TTL_TRD_QNTY"), F.lit("0").alias("TURNOVER_LACS"), F.lit("1").alias("NO_OF_TRADES"),
        F.when(F.month("date") == 3, " -").otherwise(F.col("volume").cast("long").cast("string")).alias("DELIV_QTY"),
        F.when(F.month("date") == 3, " -").otherwise("50.5").alias("DELIV_PER"),
    )
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rounded(fs.bhavcopy_files(spark, path, ["Brand#7", "Brand#11"]).select("symbol", "date", "volume", "deliv_qty", "deliv_pct"))


QUERIES["source_bhavcopy_csv"] = _bhav
SQL["source_bhavcopy_csv"] = final(
    DAILY, """SELECT symbol, date, volume, CASE WHEN month(date) <> 3 THEN volume END AS deliv_qty, CASE WHEN month(date) <> 3 THEN 50.5::DOUBLE END AS deliv_pct
  FROM bars WHERE symbol IN ('Brand#7', 'Brand#11') AND day(date) % 7 <> 0""", "symbol, date",
)


def _index(spark, d):
    path = _folder(spark)
    b = tb.benchmark_daily(spark, d)
    val = F.col("close").cast("string")
    rows = b.select(
        F.lit("Nifty 50 ").alias("Index Name"), F.date_format("date", "dd-MM-yyyy").alias("Index Date"), val.alias("Open Index Value"), val.alias("High Index Value"),
        val.alias("Low Index Value"), val.alias("Closing Index Value"), *[F.lit("0").alias(c) for c in ("Points Change", "Change(%)", "Volume", "Turnover (Rs. Cr.)", "P/E", "P/B", "Div Yield")],
    )
    rows.write.csv(path, header=True)
    return rounded(fs.index_close_files(spark, path, " NIFTY 50").select("date", "close"))


QUERIES["source_index_close_csv"] = _index
SQL["source_index_close_csv"] = final(LINE + ",\n" + BENCH, "SELECT date, close FROM bench", "date")


def _actions(spark, d):
    path = _folder(spark)
    a = corporate_actions(spark, d)
    doc = F.to_json(F.struct("symbol", F.when(F.year("ex_date") % 2 == 0, F.col("purpose")).alias("subject"), F.col("purpose"), F.date_format("ex_date", "dd-MMM-yyyy").alias("exDate")))
    a.select(doc.alias("value")).write.text(path)
    return rounded(fs.corporate_action_files(spark, path).select("symbol", "ex_date", "factor"))


QUERIES["source_corporate_actions_json"] = _actions
SQL["source_corporate_actions_json"] = final(_ACT, "SELECT * FROM act", "symbol, ex_date")


def _journal(spark, d):
    """Append opened trades, append the closing change rows, and read the current journal."""
    path = _folder(spark)
    j = journal(spark, d).filter(F.col("is_paper")).groupBy(F.col("order_ref").alias("id")).agg(
        F.max("symbol").alias("symbol"), F.max("entry_price").alias("entry_price"), F.max("pnl").alias("pnl")
    )
    none = F.lit(None)
    jn.append(j.select("id", F.lit(1).cast("long").alias("version"), "symbol", "entry_price", none.cast("double").alias("pnl"), F.lit("OPEN").alias("status")), path)
    closed = j.filter(F.col("pnl").isNotNull())
    jn.append(closed.select("id", F.lit(2).cast("long").alias("version"), none.cast("string").alias("symbol"), none.cast("double").alias("entry_price"), "pnl", F.lit("CLOSED").alias("status")), path)
    return rounded(jn.latest(spark.read.parquet(path)))


QUERIES["journal_append_and_update"] = _journal
SQL["journal_append_and_update"] = final(
    _J + ",\nq AS (SELECT order_ref AS id, max(symbol) AS symbol, max(entry_price) AS entry_price, max(pnl) AS pnl FROM j WHERE is_paper GROUP BY 1)",
    """SELECT id, symbol, entry_price, pnl, CASE WHEN pnl IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status, CASE WHEN pnl IS NULL THEN 1 ELSE 2 END::BIGINT AS version FROM q""",
    "id, symbol, status, version",
)


# --- participant files: landed by day, corrected later, and taken into a table month by month
def _oi_lines(oi):
    """Lines of the day files, with weekends moved out of the way of the reader's weekday rule, a header and a total."""
    zero = [F.lit("0")] * 6
    fields = [F.concat(F.col("client_type"), F.lit(" ")), *[F.format_string("%.4f", c) for c in fs.OI_COLUMNS[1:9]], *zero]
    body = oi.select(F.date_format("date", "yyyyMMdd").alias("day"), F.concat_ws(",", *fields).alias("value"))
    head = oi.select(F.date_format("date", "yyyyMMdd").alias("day")).distinct()
    extra = head.select("day", F.explode(F.array(F.lit("Client Type," + "x," * 13 + "x"), F.lit("TOTAL," + "1," * 13 + "1"))).alias("value"))
    return body.unionByName(extra)


def _land(df, path):
    df.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").text(path)


def _oi_files(spark, d):
    path = _folder(spark)
    _land(_oi_lines(tb.participant_oi(spark, d)), path)
    return rounded(fs.participant_oi_files(spark, path, "1996-01-01", "2000-12-31").select("date", *fs.OI_COLUMNS[:9]), 3)


QUERIES["source_participant_oi_csv"] = _oi_files
SQL["source_participant_oi_csv"] = final(
    OI, f"SELECT date, {', '.join(fs.OI_COLUMNS[:9])} FROM oi WHERE isodow(date) < 6 AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'", "date, client_type", 3
)


def _ingested(spark, d):
    """Three runs: the first years with one month wrong; the rest and that month's corrected files; nothing new."""
    folder, table = _folder(spark), _folder(spark)
    store = Store(spark, _folder(spark))
    oi = cut_lineage(tb.participant_oi(spark, d))
    wrong = F.date_format("date", "yyyy-MM") == "1996-05"
    bad = oi.withColumn("future_index_long", F.when(wrong, F.col("future_index_long") * 2).otherwise(F.col("future_index_long")))
    read = lambda s, paths: fs.participant_oi_files(s, list(paths))
    runs = []
    for part in (bad.where("date < DATE '1998-07-01'"), oi.where(wrong | (F.col("date") >= "1998-07-01")), None):
        if part is not None:
            _land(_oi_lines(part), folder)
        runs.append(ig.ingest(spark, folder, table, store, "oi", read).count())
    return ig.stored(spark, table), runs


def _landed_positioning(spark, d):
    rows, (_, second, third) = _ingested(spark, d)
    wide = fl.net_positioning(rows.select("date", *fs.OI_COLUMNS[:9]))
    return rounded(wide.withColumn("rewritten_later", F.lit(second).cast("long")).withColumn("rewritten_again", F.lit(third).cast("long")), 2)


QUERIES["landed_positioning"] = _landed_positioning
SQL["landed_positioning"] = final(
    _WIDE, """SELECT w.*, (SELECT count(DISTINCT strftime(date, '%Y-%m')) FROM oi WHERE isodow(date) < 6 AND (strftime(date, '%Y-%m') = '1996-05' OR date >= DATE '1998-07-01')) AS rewritten_later,
  0::BIGINT AS rewritten_again FROM wide w WHERE isodow(date) < 6""", "date, rewritten_later, rewritten_again", 2,
)
