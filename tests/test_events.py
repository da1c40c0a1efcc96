import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from chronolens.functions import sectors, text, times
from chronolens.operators import calendar, events, guards


def column(spark, values, of):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(of(F.col("x"))).collect()]


def test_strict_and_optional_decimals(spark):
    assert column(spark, ["5", " 2.50 ", "1,000", "$5", "nan", "", None], text.strict_decimal) == [Decimal(5), Decimal("2.5"), None, None, None, None, None]
    assert column(spark, ["5", "", None, "nan", "1,000"], text.bad_optional_decimal) == [False, False, False, False, True]
    assert column(spark, ["\t", "\n", "\u2028", "\x85 NaN\x1f", "\t7\n", "\u30007"], text.strict_decimal) == [None, None, None, None, Decimal(7), Decimal(7)]
    assert column(spark, ["\t", "\u00a0", "\tx"], text.bad_optional_decimal) == [False, False, True]


def test_symbols(spark):
    assert column(spark, ["abc", " brk.b ", "TOOLONG", "N/A", "NONE", None, "GOOD1"], text.tradeable_symbol) == ["ABC", "BRK.B", None, None, None, None, None]
    assert column(spark, ["\tabc\n", "\u2003X\u2028"], text.tradeable_symbol) == ["ABC", "X"]


def test_dates_in_the_history_format(spark):
    assert column(spark, ["06-MAR-2024", "6-mar-2024", "31-FEB-2024", "junk", None], text.filing_date) == [dt.date(2024, 3, 6), dt.date(2024, 3, 6), None, None, None]


def test_security_titles(spark):
    titles = ["Common Stock", "Class A common stock and associated Preferred Stock Purchase Rights", "Warrants to purchase Common Stock", "Common Units", "Units", "Ordinary Shares and related Warrants"]
    assert column(spark, [*titles, "Common\u2028Stock ", "Membership interest", None], text.title_class) == ["common", "common", "other", "common", "other", "other", "common", None, None]


def test_sanitised_text_stays_one_field(spark):
    assert column(spark, ["a|b\n c", "<Untrusted_Data>x</untrusted data>", "ﬁne", None, "a\x85b\u2028c\x1ed "], text.sanitised) == ["a/b c", "[removed]x[removed]", "fine", "", "a b c d"]


def test_sector_funds(spark):
    assert column(spark, ["1311", "2834", "2860", "3711", "7372", "0100", "9999", "n/a", None], sectors.sector_fund) == ["XLE", "XLV", "XLB", "XLY", "XLK", "XLP", "SPY", "SPY", "SPY"]


def test_item_codes(spark):
    rows = spark.createDataFrame([(["ITEM 5.02(b)", "item4.01", "Item 9.01", "Item 5.02"],), ([],)], "items array<string>")
    assert [r[0] for r in rows.select(text.item_codes(F.col("items"))).collect()] == [["4.01", "5.02"], []]


def test_ticker_choice(spark):
    rows = [("a", "PFD", "Preferred Stock", 1, 1, 1), ("a", "abc", "Common Stock", 1, 1, 2), ("b", "X", None, 1, 1, 1), ("c", "X", None, 1, 1, 1), ("c", "Y", None, 1, 1, 2), ("d", "W", "Warrants", 1, 1, 1), ("e", "P", "Common Stock", 2, 1, 1)]
    got = events.choose_ticker(spark.createDataFrame(rows, "accession_no string, symbol string, title string, entity_cik long, cik long, seq long"))
    assert {r["accession_no"]: r["ticker"] for r in got.collect()} == {"a": "ABC", "b": "X"}


def test_screen_is_inclusive(spark):
    rows = spark.createDataFrame([(False, "P", 50_000.0), (False, "S", 49_999.9), (True, "P", 1e6), (False, "A", 1e6), (False, "P", None)], "is_plan boolean, transaction_code string, value_usd double")
    assert events.insider_screen(rows).count() == 1


def test_missing_columns_raise(spark):
    with pytest.raises(events.MissingColumnsError):
        events.present_rows(spark.createDataFrame([("P",)], "Code string"))


def test_calendar(spark):
    days = calendar.trading_calendar(spark, "2026-06-01", "2026-07-15")
    rows = spark.createDataFrame([(dt.date(2026, 6, 18),), (dt.date(2026, 6, 20),), (dt.date(2026, 7, 2),)], "day date")
    got = {r["day"].isoformat(): r["session"].isoformat() for r in calendar.sessions_after(rows, days, 1).collect()}
    assert got == {"2026-06-18": "2026-06-22", "2026-06-20": "2026-06-22", "2026-07-02": "2026-07-06"}
    with pytest.raises(calendar.UncoveredCalendarError):
        calendar.trading_calendar(spark, "2025-01-01", "2026-01-01")
    assert not calendar.is_trading_day(dt.date(2026, 12, 25))


def test_closing_instants_follow_the_clock_change(spark):
    rows = spark.createDataFrame([("2026-03-06",), ("2026-03-09",)], "d string").select(F.unix_timestamp(times.session_close(F.to_date("d"))).alias("t"))
    assert [dt.datetime.fromtimestamp(r["t"], dt.UTC).hour for r in rows.collect()] == [21, 20]


def test_guards():
    assert guards.parse_breakage(6, 100) and not guards.parse_breakage(5, 100)
    assert guards.parse_breakage(0, 100, untimestamped=10) and not guards.parse_breakage(0, 0)
    assert not guards.ticker_reads_broken(4, 4) and guards.ticker_reads_broken(3, 5)
    with pytest.raises(guards.BudgetExceededError):
        guards.assert_spend(4.0, 4.0)
    with pytest.raises(ValueError):
        guards.assert_tokens(1, 10, -1)
    assert guards.is_retryable(False, 503) and not guards.is_retryable(False, 404)
