"""Indicators of award notices in two XML layouts, by XPath on local names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all(xml: Column, path: str) -> Column:
    return F.xpath(xml, F.lit(path))


def _local(*names: str) -> str:
    return "/".join(f"*[local-name()='{n}']" for n in names)


def indicators(df: DataFrame, xml: str = "xml") -> DataFrame:
    """df with layout, tenders received, winners, and whether losers took part, are listed, and how many by name.

    In the new layout a tender is won if a settled contract names it, and its firms are found by way of its party;
    in the old one only counts are there. A text that is no notice has the layout null."""
    x = F.col(xml)
    new, old = x.rlike("<(?:\\w+:)?Contract(?:Award)?Notice[\\s>]"), x.rlike("<(?:\\w+:)?TED_EXPORT[\\s>]")
    bare = F.when(new | old, x)
    result = "//" + _local("NoticeResult")
    # each path is evaluated once: the arrays are columns before they are read several times
    df = df.withColumns(
        {
            "__tenders": F.array_distinct(_all(bare, f"{result}/{_local('LotTender', 'ID')}/text()")),
            "__won": F.array_distinct(_all(bare, f"{result}/{_local('SettledContract', 'LotTender', 'ID')}/text()")),
            "__received": _all(F.when(old, x), "//" + _local("NB_TENDERS_RECEIVED") + "/text()"),
            "schema": F.when(new, "eforms").when(old, "legacy"),
        }
    )
    new, old = F.col("schema") == "eforms", F.col("schema") == "legacy"
    df = df.withColumn("__lost", F.size(F.array_except("__tenders", "__won")))
    n_old = F.try_element_at(F.transform("__received", lambda r: r.try_cast("int")), F.lit(1))
    df = df.withColumns({"n_tenders_received": F.when(new, F.size("__tenders")).when(old, n_old), "n_winners": F.when(new, F.size("__won")).when(old, F.size(F.split(x, "<(?:\\w+:)?CONTRACTOR[\\s>]")) - 1)})
    return df.withColumns(
        {
            "had_non_winners": F.when(new | old, F.col("n_tenders_received") > F.col("n_winners")),
            "non_winners_listed": F.when(new, F.col("__lost") > 0).when(old, F.lit(False)),
            "n_non_winners_named": F.when(new, F.col("__lost")).when(old, F.lit(0)),
        }
    ).drop("__tenders", "__won", "__received", "__lost")


def bids(df: DataFrame, xml: str = "xml", key: str = "notice_id") -> DataFrame:
    """(key, tender, company, bid_value, currency) of the new layout: tender to party to organisation to name."""
    x = F.col(xml)
    result = "//" + _local("NoticeResult")
    ids = lambda *p: _all(x, result + "/" + _local(*p) + "/text()")
    table = lambda k, v: F.map_from_entries(F.filter(F.arrays_zip(k.alias("k"), v.alias("v")), lambda e: e["k"].isNotNull()))
    out = df.select(
        key,
        ids("LotTender", "ID").alias("tenders"),
        ids("LotTender", "TenderingParty", "ID").alias("parties"),
        ids("LotTender", "LegalMonetaryTotal", "PayableAmount").alias("values"),
        _all(x, result + "/" + _local("LotTender", "LegalMonetaryTotal", "PayableAmount") + "/@currencyID").alias("currencies"),
        ids("TenderingParty", "ID").alias("party_ids"),
        ids("TenderingParty", "Tenderer", "ID").alias("firm_ids"),
        _all(x, "//" + _local("Organization", "Company", "PartyIdentification", "ID") + "/text()").alias("org_ids"),
        _all(x, "//" + _local("Organization", "Company", "PartyName", "Name") + "/text()").alias("org_names"),
    )
    rows = out.select("*", F.posexplode("tenders").alias("i", "tender"))
    firm = F.try_element_at(table(F.col("party_ids"), F.col("firm_ids")), F.get("parties", F.col("i")))
    name = F.try_element_at(table(F.col("org_ids"), F.col("org_names")), firm)
    return rows.select(key, "tender", name.alias("company"), F.get("values", F.col("i")).try_cast("double").alias("bid_value"), F.get("currencies", F.col("i")).alias("currency"))


def diagnostics(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of notices by some columns, null being a value."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
