"""The two sources of notices cleaned into tables of lots, and the flags of their winners and buyers.

`national` takes the national extract (amounts in kroner, durations in months), `european` the European
one (amounts in euros, all columns text). Both give the same names for the same things. Nothing here
shuffles but the fills within a tender and the numbering of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from procurelake.functions import cpv
from procurelake.functions.scalars import iso_date, number_in, sheet_date, trimmed
from procurelake.operators import tables

#: Columns of the national extract and what they are called here.
NATIONAL = {
    "Vinders CVR": "winner_cvr",
    "Vinders navn": "winner_name",
    "Vinders land": "winner_country",
    "Navn på ordregiver": "buyer_name",
    "Publikationsdato for bekendtgørelse om indgået kontrakt": "pub_date",
    "Dato for tildeling af kontrakten": "award_date",
    "Frist for aflevering af tilbud": "submit_date",
    "Løbenummer": "tender_id",
    "Nummerplade": "lot_id",
    "Rammeaftale": "contract_type",
    "Opdelt udbud": "divided_tender",
    "Fælles-/enkeltudbud": "joint_tender",
    "Konsortium/Sammenslutning": "consortium_winner",
    "CPV-koder": "cpv_code",
    "Annulleret udbud": "tender_cancelled",
    "Helt/delvist gennemført/annulleret": "tender_status",
    "Estimat af samlet kontraktværdi - angivet i udbud": "estimated_tender_amount",
    "Estimat af delkontrakts kontraktværdi": "estimated_lot_amount",
    "Endelig kontraktværdi": "final_tender_amount",
    "Endelig værdi af delaftaler": "final_lot_amount",
    "Delkontraktnr.": "lot_number",
    "Antal delkontrakter kortlagt": "n_lots",
    "Antal delkontrakter i udbudsbekendtgørelsen": "n_lots_contracted",
    "Antal vindere på delkontrakten": "n_lot_winners",
    "Antal modtagne bud": "n_bids_received",
    "Varighed af kontrakten i måneder (min)": "contract_duration_months_min",
    "Varighed af kontrakten i måneder (max)": "contract_duration_months_max",
}
#: Columns of the European extract and what they are called here.
EUROPEAN = {
    "lot_lotId": "lot_id",
    "lot_lotNumber": "lot_number",
    "lot_bidsCount": "n_bids_received",
    "tender_lots_count": "n_lots",
    "tender_bidDeadline": "submit_date",
    "tender_awardDecisionDate": "award_date",
    "tender_cpvs": "cpv_code",
    "tender_hasLots": "divided_tender",
    "tender_isFrameworkAgreement": "contract_type",
    "tender_isJointProcurement": "joint_tender",
    "bid_isConsortium": "consortium_winner",
    "bidder_bodyIds": "winner_cvr_original",
    "bidder_name": "winner_name_original",
    "bidder_country": "winner_country_original",
    "buyer_bodyIds": "buyer_cvr_original",
    "buyer_name": "buyer_name_original",
    "buyer_country": "buyer_country_original",
}
#: What a tender is, and what a contract is, by the words of either source.
JOINT = {"Enkelt": "single", "Fælles": "joint"}
CONTRACT = {"Offentlig kontrakt": "Public contract", "Rammeaftale": "Framework agreement", "yes": "Framework agreement", "no": "Public contract"}
FRAMEWORK = "Framework agreement"
#: States of a lot that has been awarded, and the one of panels that are qualified beforehand.
AWARDED, PANEL = ("AWARDED", "PREAWARDED"), "PREAWARDED"
#: A row of the European extract that its notice doesn't have.
KNOWN_ERRORS = ({"tender_id": "b96cecee-2793-471d-896e-1c88e1feca56", "lot_id": "group_EU_tender_7b094b56ffad217bea213493b5bf7460f52036da_3", "winner_name_original": "ISS Facility Services A/S", "lot_amount": 2769258},)
#: Columns that come first in tables of lots.
FIRST = (
    "row_id tender_id lot_id lot_number n_lots n_lots_contracted n_lot_winners pub_date award_date buyer_name winner_name winner_cvr winner_country"
).split()


def recoded(c: Column, words: dict[str, str]) -> Column:
    """What a word stands for; null for any other."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c)


def ordered(df: DataFrame, first: list[str] = FIRST) -> DataFrame:
    """df with those of some columns that it has first, then all others."""
    known = [c for c in first if c in df.columns]
    return df.select(*known, *[c for c in df.columns if c not in known])


def country(c: Column) -> Column:
    """A country's code without blanks, in capitals."""
    return F.upper(trimmed(c))


def sure(c: Column) -> Column:
    """A condition that unknown is false for."""
    return F.coalesce(c, F.lit(False))


def _with_cpv(df: DataFrame) -> DataFrame:
    return df.withColumns(cpv.cleaned(F.col("cpv_code")))


def _with_currencies(df: DataFrame, own: str) -> DataFrame:
    other, change = ("eur", tables.euros) if own == "dkk" else ("dkk", tables.kroner)
    return df.withColumns({f"{a}_{own}": F.col(a) for a in ("tender_amount", "lot_amount")} | {f"{a}_{other}": change(F.col(a)) for a in ("tender_amount", "lot_amount")})


def _with_yearly(df: DataFrame, duration: str, per_year: int) -> DataFrame:
    framework = F.col("contract_type") == FRAMEWORK
    return df.withColumns({f"annualised_{a}": tables.annualised(F.col(a), F.col(duration), per_year, framework) for a in ("tender_amount", "lot_amount")})


def _with_split(df: DataFrame) -> DataFrame:
    """Lots of a tender without any lot amount share its amount; `lot_amount_orig` and a flag say so."""
    none = F.min(F.col("lot_amount").isNull().cast("int")).over(W.partitionBy("tender_id")) == 1
    df = df.withColumns({"lot_amount_orig": F.col("lot_amount"), "flag_all_orig_lot_amt_missing": none})
    return tables.split_evenly(df, "tender_id", "lot_id", "tender_amount", "lot_amount")


def national(df: DataFrame) -> DataFrame:
    """The national extract, by its own column names, as lots."""
    df = df.withColumnsRenamed(NATIONAL)
    number = lambda c: F.col(c).try_cast("double")
    months = F.coalesce(number("contract_duration_months_min"), number("contract_duration_months_max"))
    df = df.withColumns(
        {
            "joint_tender": recoded(F.col("joint_tender"), JOINT),
            "tender_amount": tables.amounts(number("final_tender_amount"), number("estimated_tender_amount")),
            "lot_amount": tables.amounts(number("final_lot_amount"), number("estimated_lot_amount")),
            "n_bidders": number("n_bids_received"),
            "award_date": sheet_date(F.col("award_date").cast("string")),
            "contract_type": recoded(F.col("contract_type"), CONTRACT),
            "flag_awarded": sure(F.col("tender_cancelled") == "Nej"),
            "contract_duration_months": months,
        }
    )
    df = _with_currencies(_with_split(df), "dkk")
    df = df.withColumn("award_end_date", tables.award_end(F.col("award_date"), months, months, F.col("flag_awarded")))
    return ordered(_with_cpv(_with_yearly(df, "contract_duration_months", 12)))


def without_errors(df: DataFrame, errors=KNOWN_ERRORS) -> DataFrame:
    """df without rows known to be wrong; a row whose amount is unknown but all else fits goes too."""
    for e in errors:
        same = F.lit(True)
        for c, v in e.items():
            same = same & ((F.round(c, 0) if isinstance(v, (int, float)) else F.col(c)) == v)
        df = df.where(~same)
    return df


def european(df: DataFrame, errors=KNOWN_ERRORS) -> DataFrame:
    """The European extract, by its own column names, as awarded lots, a row for each winner and buyer."""
    df = df.withColumnsRenamed(EUROPEAN)
    stated = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    df = df.withColumn("tender_cancelled", stated("tender_cancellationDate") | stated("lot_cancellationDate"))
    df = df.where(F.col("lot_status").isin(*AWARDED) & ~F.col("tender_cancelled"))
    parties = [F.col("buyer_name_original").asc_nulls_last(), F.col("buyer_cvr_original").desc_nulls_last(), F.col("winner_name_original").asc_nulls_last(), F.col("winner_cvr_original").desc_nulls_last()]
    df = tables.numbered(df, [F.col("tender_id").asc_nulls_last(), F.col("lot_id").asc_nulls_last(), *parties, sure(F.col("bid_isWinning") == "yes").desc()])
    df = tables.first_rows(df, ["tender_id", "lot_id", "winner_cvr_original", "winner_name_original", "buyer_cvr_original", "buyer_name_original"], [F.col("row_id")])
    number = lambda c: number_in(F.col(c))
    df = df.withColumns(
        {
            "tender_amount": tables.amounts(number("tender_finalPrice_EUR"), number("tender_estimatedPrice_EUR")),
            "lot_amount": tables.amounts(number("bid_price_EUR"), number("lot_estimatedPrice_EUR")),
            "bid_amount": number("bid_price_EUR"),
            "n_bidders": number("n_bids_received"),
            "award_date": F.coalesce(iso_date(F.col("award_date")), iso_date(F.col("tender_publications_firstdContractAwardDate"))),
            "contract_type": recoded(F.col("contract_type"), CONTRACT),
            "framework_duration_days": tables.framework_days(number("tender_estimatedDurationInDays"), number("tender_estimatedDurationInMonths"), number("tender_estimatedDurationInYears")),
        }
    )
    df = df.withColumn("framework_start_anchor", F.coalesce("award_date", iso_date(F.col("tender_estimatedStartDate"))))
    end = F.coalesce(iso_date(F.col("tender_estimatedCompletionDate")), F.date_add("framework_start_anchor", F.col("framework_duration_days").cast("int")))
    df = without_errors(df.withColumn("framework_end_date", F.when(F.col("contract_type") == FRAMEWORK, end)), errors)
    df = tables.sum_of_lots(df.withColumn("tender_amount_orig", F.col("tender_amount")), "tender_id", "lot_id", "tender_amount", "lot_amount", "row_id")
    df = _with_split(df)
    several = tables.n_distinct_over(F.col("lot_id"), W.partitionBy("tender_id")) > 1
    df = df.withColumns({"flag_lot_amt_equal_split": F.col("flag_all_orig_lot_amt_missing") & several & F.col("tender_amount").isNotNull(), "flag_framework_prequalified": F.col("lot_status") == PANEL})
    suppliers = tables.n_distinct_over(F.col("winner_name_original"), W.partitionBy("tender_id", "lot_id"))
    share = F.col("flag_framework_prequalified") & F.col("tender_amount").isNotNull()
    df = df.withColumn("lot_amount", F.when(share, F.col("tender_amount") / suppliers).otherwise(F.col("lot_amount")))
    df = _with_cpv(_with_yearly(_with_currencies(df, "eur"), "framework_duration_days", 365))
    df = df.withColumn("flag_awarded", F.col("tender_isAwarded") == "yes")
    return ordered(df.withColumns({f"{who}_country": country(F.col(f"{who}_country_original")) for who in ("winner", "buyer")}))


def _known_parties(who: str, blank_country: bool) -> dict[str, Column]:
    """Flags of what is known of a party, for columns `who`_cvr_clean, _name and _country."""
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    cvr, name, land = f"{who}_cvr_clean", f"{who}_name", f"{who}_country"
    no_cvr, no_name, no_land = empty(cvr), empty(name), empty(land) if blank_country else F.col(land).isNull()
    valid = sure(F.col(cvr).rlike("^[0-9]{8}$"))
    abroad = country(F.col(land)) != "DK"
    return {
        "valid_cvr": valid,
        f"flag_missing_{who}_cvr": no_cvr,
        f"flag_missing_{who}_name": no_name,
        f"flag_missing_{who}_country": no_land,
        f"flag_foreign_{who}": sure(abroad & (trimmed(F.col(land)) != "")) if blank_country else sure(abroad),
        "flag_missing_cvr_with_name": no_cvr & ~no_name,
        "flag_review_cvr": ~no_cvr & ~valid,
        f"flag_no_{who}_info": no_cvr & no_name & no_land,
        "flag_verify_cvr_external": (no_cvr & ~no_name) | (~no_cvr & ~valid),
    }


def national_winners(df: DataFrame) -> DataFrame:
    """Flags of winners of the national extract: rows of winner_cvr_candidate_original, winner_cvr_clean, winner_name, winner_country and the lot's columns."""
    flags = _known_parties("winner", False)
    extracted = F.count(F.lit(1)).over(W.partitionBy("tender_id", "lot_id"))
    return df.withColumn("n_winners_extracted", extracted).withColumns(
        flags
        | {
            "flag_winner_cvr_changed": sure(F.col("winner_cvr_clean") != F.col("winner_cvr_candidate_original")),
            "flag_mismatch_winner_count": sure(F.col("n_winners_extracted") != F.col("n_lot_winners")),
            "flag_review_n_winners": sure(F.col("n_winners_extracted") != F.col("n_lot_winners")),
            "flag_single_bidder": sure(F.col("n_bids_received").try_cast("double") == 1),
            "flag_multilot": sure(F.col("n_lots").try_cast("double") > 1),
            "flag_cancelled": sure(F.col("tender_cancelled") != "Nej"),
            "flag_check_fuzzy_match": flags["flag_missing_cvr_with_name"],
        }
    )


def european_parties(df: DataFrame, who: str) -> DataFrame:
    """Flags of winners or buyers of the European extract."""
    more = {
        "flag_multilot": sure(number_in(F.col("n_lots")) > 1),
        "flag_cancelled": sure(F.col("tender_cancelled")),
        "flag_check_fuzzy_match": sure((F.col(f"{who}_name") != "") & F.col(f"{who}_cvr_clean").isNull()),
    }
    if who == "winner":
        more["flag_single_bidder"] = sure(number_in(F.col("n_bids_received")) == 1)
    return df.withColumns(_known_parties(who, True) | more)


#: Where a buyer's row comes from.
ALONE, LISTED = "single buyer or joint tender with unlisted buyers", "multiple listed buyers"


def national_buyers(df: DataFrame) -> DataFrame:
    """Flags of buyers of the national extract: rows of buyer_name, buyer_name_original, source, joint_tender."""
    name, alone = F.col("buyer_name"), F.col("source") == ALONE
    missing = name.isNull() | (name == "")
    df = df.withColumns({"n_buyers_extracted": F.count(F.lit(1)).over(W.partitionBy("tender_id", "lot_id")), "n_buyers_listed_original": F.regexp_count("buyer_name_original", F.lit(";")) + 1})
    return df.withColumns(
        {
            "flag_joint_unlisted_buyers": sure((F.col("joint_tender") == "joint") & alone),
            "flag_single_buyer_name_changed": sure((name != F.col("buyer_name_original")) & alone),
            "flag_missing_buyer_name": missing,
            "flag_buyer_count_agree": sure(F.col("n_buyers_extracted") == F.col("n_buyers_listed_original")),
            "flag_check_fuzzy_match": ~missing,
        }
    )


def listed(c: Column, pattern: str) -> Column:
    """How many things a delimited text lists: its delimiters and one."""
    return F.regexp_count(c, F.lit(pattern)) + 1


def single_numbers(c: Column) -> Column:
    """Whether a field surely holds one number: eight digits, with blanks between them or not, and no other delimiter."""
    return sure(F.replace(c, F.lit(" "), F.lit("")).rlike("^[0-9]{8}$"))


def with_lot(entities: DataFrame, lots: DataFrame, keys: tuple[str, ...] = ("tender_id", "lot_id"), suffix: str = "_original") -> DataFrame:
    """Entities with the columns of their lots, all entities kept; null keys are equal. Columns of both keep the entity's, the lot's get a suffix."""
    other = lots.select(*[F.col(c).alias(f"__{c}" if c in keys else f"{c}{suffix}" if c in entities.columns else c) for c in lots.columns])
    on = F.lit(True)
    for k in keys:
        on = on & entities[k].eqNullSafe(other[f"__{k}"])
    return entities.join(other, on, "left").drop(*[f"__{k}" for k in keys])


def with_winners(df: DataFrame) -> DataFrame:
    """Lots that had winners."""
    return df.where(F.col("n_lot_winners").try_cast("double") > 0)


def to_match(df: DataFrame, who: str, danish: bool = True) -> DataFrame:
    """Rows whose number is looked up by name: flagged so and, where `danish`, in Denmark."""
    ok = F.col("flag_check_fuzzy_match")
    return df.where(ok & (country(F.col(f"{who}_country")) == "DK") if danish else ok)
