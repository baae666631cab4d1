"""The whole path from names to numbers: exact ladder, collaborations, splits of names, fuzzy passes, and what people review.

Sides differ in what they do: winners and buyers of the national source get the exact ladder and the
fuzzy passes; the European source's also the ladder without labels of a collaboration, and the search
for splits of names that stand for several firms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procurelake.functions.scalars import trimmed
from procurelake.operators import match, partitions
from procurelake.operators.session import settled

#: What was compared at each exact step, and in the fuzzy passes by step and source.
EXACT = {1: "basic name and firm type", 2: "no spaces and firm type", 3: "no spaces", 4: "broad name"}
FUZZY = {(5, "name"): "prepared main name", (5, "biname"): "prepared biname", (6, "name"): "broad main name", (6, "biname"): "broad biname"}
#: Words of each side's codes.
SIDES = {
    "national winner": {"exact": "exact matching: ", "fuzzy": "fuzzy matching: ", "single": ("single winners", "CVR source: single CVR row"), "multiple": ("multiple winners", "CVR source: multiple CVR separation"), "stated": "existing CVR, unclassified"},
    "national buyer": {"exact": "exact matching: ", "fuzzy": "fuzzy matching: "},
    "european": {
        "partition": "exact partition: ", "exact": "exact: ", "bare": "exact consortium removed: ", "fuzzy": "fuzzy: ", "filled": "source: same-name CVR fill",
        "single": ("single winner", "source: single CVR cleaning"), "multiple": ("multiple confirmed winners", "source: multiple CVR separation"), "stated": "source: existing CVR, unclassified",
    },
}
NO_MATCH, ABROAD, NO_NAME, FAILED = "matching candidate: no match found", "not a matching candidate: not marked as Danish", "not a matching candidate: no CVR name", "match failure"
#: Statuses of a split that makes a row a matter for people.
UNCLEAR = "several complete partitions"


def link(rows: DataFrame, key: DataFrame, null_safe: bool = True, splits: bool = True) -> DataFrame:
    """Rows of `match.entities` with their match, or a row for each firm of an accepted split.

    Adds matched_cvr, registered_name, name_source, n_candidates, score, match_method, match_step, and of the split
    partition_status, expanded_number, expanded_name, flag_expanded, flag_potential_multiple. Names with several
    complete splits are left to people and kept out of the fuzzy passes."""
    rows, key = settled(rows), settled(key)  # read by each ladder and pass
    plain = settled(match.exact(rows, key, null_safe=null_safe))
    rest = rows.join(plain.select("match_id"), "match_id", "left_anti")
    whole, told, parts = None, None, None
    if splits:
        rest = settled(rest)
        whole = settled(match.collaboration_ladder(rest, key, null_safe))
        rest = settled(rest.join(whole.select("match_id"), "match_id", "left_anti"))
        told, parts = partitions.searched(rest, key)
        told, parts = settled(told), settled(parts)
        rest = rest.join(told.where(F.col("partition_status").isin("accepted", UNCLEAR)).select("match_id"), "match_id", "left_anti")
    distinct, members = match.problems(settled(rest))
    best, _ = match.fuzzy(distinct, key)
    what = ["match_id", "step", "cvr", "registered_name", "name_source", "n_candidates", "score", "match_method"]
    near = match.expanded(best, members).withColumns({"n_candidates": F.lit(1).cast("long"), "match_method": F.lit("fuzzy")}).select(*what)
    same = plain if whole is None else plain.unionByName(whole)
    found = same.withColumn("match_method", F.lit("exact")).select(*what).unionByName(near)
    found = found.withColumnsRenamed({"step": "match_step", "cvr": "matched_cvr"})
    out = rows.select("match_id", "match_date", "entity_name").join(found, "match_id", "left")
    if not splits:
        return out
    out = partitions.replaced(out.join(told.select("match_id", "partition_status"), "match_id", "left"), parts)
    firm = lambda c, x: F.when(F.col("flag_expanded"), x).otherwise(F.col(c))
    out = out.withColumns({"matched_cvr": firm("matched_cvr", F.col("expanded_cvr")), "match_step": firm("match_step", F.col("expanded_step")), "match_method": firm("match_method", F.lit("exact")), "n_candidates": firm("n_candidates", F.lit(1).cast("long")), "score": firm("score", F.lit(100.0))})
    return out.withColumn("flag_potential_multiple", F.coalesce(F.col("partition_status") == UNCLEAR, F.lit(False))).drop("expanded_cvr", "expanded_step")


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _column(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def codes(df: DataFrame, side: str) -> DataFrame:
    """df with `name_match_step_code`: how a row came by its number, or why it has none.

    Reads match_method, match_step, name_source and, as far as there, stated_cvr, source, country, flag_check_fuzzy_match,
    flag_expanded, flag_filled; the first code that fits is taken."""
    words, method, step = SIDES[side], F.col("match_method"), F.col("match_step")
    expanded, asked = _is(_column(df, "flag_expanded", False)), _is(_column(df, "flag_check_fuzzy_match", True))
    stated, source = _column(df, "stated_cvr", None).cast("string"), _column(df, "source", None).cast("string")
    has, danish = _is(stated != ""), _is(F.upper(trimmed(_column(df, "country", "DK"))) == "DK")
    listed = []
    if "partition" in words:
        listed += [(expanded & (step == i), words["partition"] + w) for i, w in EXACT.items()]
    listed += [((method == "exact") & (step == i), words["exact"] + w) for i, w in EXACT.items()]
    if "bare" in words:
        listed += [((method == "exact") & (step == i + len(EXACT)), words["bare"] + w) for i, w in EXACT.items()]
    listed += [((method == "fuzzy") & (step == i) & (F.col("name_source") == s), words["fuzzy"] + w) for (i, s), w in FUZZY.items()]
    if "filled" in words:
        listed += [(_column(df, "flag_filled", False), words["filled"])]
    if "stated" in words:
        listed += [(has & (source == words[k][0]), words[k][1]) for k in ("single", "multiple")] + [(has, words["stated"]), (asked & danish, NO_MATCH), (asked, ABROAD)]
    code = F.coalesce(*[F.when(_is(c), F.lit(w)) for c, w in listed], F.lit(NO_NAME if "stated" in words else FAILED))
    return df.withColumn("name_match_step_code", code)


def reviewed(df: DataFrame, side: str) -> DataFrame:
    """df with its code, the flags of found, ambiguous and to be reviewed, `final_cvr` and `name_match_status`."""
    df = codes(df, side)
    asked, expanded = _is(_column(df, "flag_check_fuzzy_match", True)), _is(_column(df, "flag_expanded", False))
    several, stated = _is(_column(df, "flag_potential_multiple", False)), _column(df, "stated_cvr", None).cast("string")
    danish = _is(F.upper(trimmed(_column(df, "country", "DK"))) == "DK")
    found = F.col("matched_cvr").isNotNull()
    unclear = found & _is(F.col("n_candidates") > 1)
    look = (several & ~expanded) | (found & (_is(F.col("match_method") == "fuzzy") | unclear))
    final = {
        "national winner": F.when(_is(stated != ""), stated).otherwise(F.col("matched_cvr")),
        "national buyer": F.col("matched_cvr"),
        "european": F.when(expanded | (asked & danish & ~several & found), F.col("matched_cvr")).otherwise(stated),
    }[side]
    states = [(~asked, "not requested")]
    if side == "european":
        states = [(expanded, "matched - separated winner name"), *states, (several, "manual review - potential multiple winners")]
    states.append((look, "manual review - fuzzy or ambiguous match"))
    if side == "european":
        states.append((_is((F.col("match_method") == "exact") & F.col("match_step").between(len(EXACT) + 1, 2 * len(EXACT))), "matched - consortium language removed"))
    states.append((found, "matched"))
    if side != "national buyer":
        states.append((~danish, "manual review - not marked as Danish"))
    state = F.coalesce(*[F.when(c, F.lit(w)) for c, w in states], F.lit("manual review - no automatic match"))
    return df.withColumns({"flag_name_match_found": found, "flag_name_match_ambiguous": unclear, "flag_review_name_match": look, "flag_manual_name_review": asked & (~found | look), "final_cvr": final, "name_match_status": state})


def to_review(df: DataFrame, candidates: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a person has to look at, with the best candidates side by side (`match.wide` over match_id) where given."""
    rows = df.where("flag_manual_name_review")
    if candidates is not None:
        rows = rows.join(candidates, "match_id", "left")
    return rows.select(*columns) if columns else rows


def with_context(matches: DataFrame, rows: DataFrame, columns: list[str], match_id: str = "match_id") -> DataFrame:
    """Matches with columns of the rows that they are of."""
    return matches.join(rows.select(match_id, *columns), match_id, "left")
