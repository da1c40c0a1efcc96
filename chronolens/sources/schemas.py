"""Declared schemas. Nothing is inferred from a day's values, so two days cannot disagree; absent columns read as NULL."""

from __future__ import annotations

from pyspark.sql import types as T

DECIMAL = T.DecimalType(38, 18)



def fields(*rows: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in rows])


S, L, B, D, TS, M = T.StringType(), T.LongType(), T.BooleanType(), T.DateType(), T.TimestampType(), T.DecimalType(12, 6)

INSIDER_EVENT = fields(
    ("accession_no", S, False), ("as_of", TS, False), ("cik", L, False), ("ticker", S, False), ("issuer", S, False), ("insider_name", S, False),
    ("position", S, False), ("transaction_code", S, False), ("shares", DECIMAL, False), ("price", DECIMAL, True), ("value_usd", DECIMAL, True),
    ("remaining_shares", DECIMAL, True), ("is_10b5_1", B, False), ("owner_ciks", T.ArrayType(L), True),
)
REDFLAG_EVENT = fields(
    ("accession_no", S, False), ("as_of", TS, False), ("cik", L, False), ("issuer", S, False), ("item_codes", T.ArrayType(S), False),
    ("item_text", S, False), ("has_press_release", B, False), ("ticker", S, True), ("ticker_source", S, True),
)
FILING_RECORD = fields(("accession_no", S, False), ("form", S, False), ("cik", L, False), ("company", S, False), ("as_of", TS, True), ("filing_date", D, False))
LABEL = fields(
    ("accession_no", S, False), ("abnormal_return", DECIMAL, False), ("benchmark_symbol", S, False), ("horizon_days", L, False),
    ("entry_session", D, False), ("exit_session", D, False), ("ticker_source", S, True),
)
EXCLUSION = fields(("accession_no", S, False), ("ticker", S, True), ("reason", S, False))
PREDICTION = fields(("event_id", S, False), ("arm", S, False), ("prompt_version", S, False), ("estimate", M, False), ("horizon_days", L, False), ("issuer_day_hash", S, False))
LLM_CALL = fields(
    ("run_id", S, False), ("issuer_day_hash", S, True), ("model", S, False), ("input", L, False), ("output", L, False), ("cache_read", L, False),
    ("cache_write", L, False), ("cost_usd", M, False), ("at", TS, False),
)
AGENT_EXCLUSION = fields(("issuer_day_hash", S, False), ("arm", S, False), ("prompt_version", S, False), ("reason", S, False), ("detail", S, True), ("event_ids", T.ArrayType(S), False))
FORM4_FILING = (
    "accession_no string, company string, cik long, aff10b5_one boolean, form string, as_of string, filing_date string, issuer_cik long, issuer_ticker string, "
    "reporting_owners array<struct<cik:string,name:string>>, rows array<struct<`Transaction Type`:string,Code:string,Description:string,Shares:string,Price:string,"
    "Value:string,Date:string,Form:string,Issuer:string,Ticker:string,Insider:string,Position:string,`Remaining Shares`:string,Remarks:string>>"
)
CURRENT_REPORT = "accession_no string, company string, cik long, items array<string>, has_press_release boolean, text string"
COVER_FACTS = "accession_no string, rows array<struct<concept:string,value:string,context_ref:string,is_dimensioned:boolean,entity_identifier:string,dimensions:map<string,string>>>"
NEWS = "news array<struct<id:long,headline:string,summary:string,source:string,url:string,symbols:array<string>,created_at:string,updated_at:string>>"
HORIZONS = {"insider": 5, "redflag": 20}


def horizon(domain: str) -> int:
    """Sessions a label of the domain spans; an unknown domain is a caller's error."""
    if domain not in HORIZONS:
        raise KeyError(f"no horizon is defined for {domain!r}")
    return HORIZONS[domain]
