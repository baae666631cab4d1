"""Names that may be of several firms: all ways to split them, and which of these is accepted."""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procurelake.functions.names import LEGAL_FORMS
from procurelake.operators import match
from procurelake.operators.session import settled

MAX_BOUNDARIES = 5
_FREE = r"(?<![^\W_]){}(?![^\W_])"
#: Phrases between two firms, labels of a collaboration, and boundaries between names.
JOINT = re.compile(r"joint[ -]?venture|jointventure|" + _FREE.format(r"j[.]?\s*v[.]?"), re.I)
CONSORTIUM = re.compile("konsorti|consorti", re.I)
TOGETHER = re.compile(r"sammenslutningen|i\s+samarbejde\s+med|sammen\s+med", re.I)
CONNECTORS = re.compile(r"i\s+konsorti(?:um|e)\s+med|i\s+joint[ -]?venture\s+med|joint[ -]?venture\s+med|in\s+joint[ -]?venture\s+with|in\s+j[.]?\s*v[.]?\s+with|i\s+samarbejde\s+med|sammen\s+med", re.I)
REMOVED = (
    re.compile(r"-?(?:konsortiet|konsortium|konsortie|consortium)(?:\s+(?:(?:bestående|bestaaende)\s+af|mellem|af))?", re.I),
    JOINT,
    re.compile(_FREE.format(r"sammenslutningen(?:\s+af)?"), re.I),
    re.compile(r"\(\s*(?:som|as)?\s*\)", re.I),
)
BOUNDARY = re.compile(r",\s*(?:(?:and|og|samt)\s+)?|;|/|" + _FREE.format("(?:og|and|samt)") + r"|&|\+", re.I)
FORMS = [re.compile(_FREE.format(p), re.I) for p, _ in LEGAL_FORMS]
REPRESENTED = re.compile(r"(?<![^\W_])v/", re.I)

RESULT = "struct<working_name:string,n_boundaries:int,n_legal_forms:int,too_many_delimiters:boolean,flag_joint_venture_text:boolean,flag_consortium_text:boolean,flag_collaboration_text:boolean,partitions:array<struct<partition_id:int,partition_code:int,partition_text:string,segments:array<string>>>>"


def split_name(name: str | None, most: int = MAX_BOUNDARIES) -> dict:
    """All partitions of a name at its boundaries, the finest first; none if it has too many boundaries."""
    out = {"working_name": name, "n_boundaries": 0, "n_legal_forms": 0, "too_many_delimiters": False, "flag_joint_venture_text": False, "flag_consortium_text": False, "flag_collaboration_text": False, "partitions": []}
    if name is None or not name.strip(" \t\r\n"):
        return out
    out["flag_joint_venture_text"], out["flag_consortium_text"] = bool(JOINT.search(name)), bool(CONSORTIUM.search(name))
    out["flag_collaboration_text"] = out["flag_joint_venture_text"] or out["flag_consortium_text"] or bool(TOGETHER.search(name))
    work = CONNECTORS.sub(";", name.strip(" \t\r\n"))
    for pattern in REMOVED:
        work = pattern.sub(" ", work)
    work = re.sub(r"\s+", " ", work.strip(" \t\r\n\f\v,;:-")).strip()
    masked = work
    for pattern in FORMS:
        out["n_legal_forms"] += len(pattern.findall(masked))
        masked = pattern.sub(lambda m: " " * len(m[0]), masked)
    masked = REPRESENTED.sub("  ", masked)
    cuts = [m.span() for m in BOUNDARY.finditer(masked)]
    out |= {"working_name": work, "n_boundaries": len(cuts), "too_many_delimiters": len(cuts) > most}
    if not cuts or len(cuts) > most:
        return out
    # codes count down; bit i of a code says whether to cut at boundary i
    for code in range(2 ** len(cuts) - 1, 0, -1):
        edges = [0, *itertools.chain.from_iterable(cut for i, cut in enumerate(cuts) if code >> i & 1), len(work)]
        segments = [work[a:b].strip() for a, b in zip(edges[::2], edges[1::2])]
        if all(segments):
            out["partitions"].append({"partition_id": len(out["partitions"]) + 1, "partition_code": code, "partition_text": "; ".join(segments), "segments": segments})
    return out


def _split(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([split_name(n) for n in names], columns=list(split_name(None)))


def partitioned(df: DataFrame, name: str) -> DataFrame:
    """df with `split`: what `split_name` says of a name."""
    return df.withColumn("split", F.pandas_udf(_split, RESULT)(F.col(name)))


def eligible(df: DataFrame) -> DataFrame:
    """Rows of `partitioned` worth a search: they speak of a collaboration or have two legal forms."""
    return df.where("split.flag_collaboration_text OR split.n_legal_forms >= 2")


def searched(rows: DataFrame, key: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status of each searched name, its accepted segments).

    A partition is complete if it has two firms or more, every segment has one number, and these
    numbers are distinct. One complete partition is accepted; several go to review."""
    some = settled(eligible(partitioned(rows.select("match_id", "match_date", "entity_name"), "entity_name")))
    flat = some.select("match_id", "match_date", F.explode("split.partitions").alias("p")).select("match_id", "match_date", "p.*")
    flat = flat.select("match_id", "match_date", "partition_id", "partition_text", F.posexplode("segments").alias("segment", "segment_text"))
    named = flat.select(F.xxhash64("segment_text", "match_date").alias("segment_id"), "*")
    asked = match.entities(named.select("segment_id", "segment_text", "match_date").distinct(), "segment_text", "segment_id", "match_date")
    found = match.exact(asked, key).select(F.col("match_id").alias("segment_id"), F.col("cvr").alias("segment_cvr"), F.col("step").alias("segment_step"), "n_candidates")
    tried = settled(named.join(found, "segment_id", "left"))
    scored = tried.groupBy("match_id", "partition_id", "partition_text").agg(
        F.count("*").alias("n_segments"),
        F.sum(F.col("segment_cvr").isNotNull().cast("int")).alias("n_matched"),
        F.sum(F.coalesce((F.col("n_candidates") == 1).cast("int"), F.lit(0))).alias("n_unique"),
        F.countDistinct("segment_cvr").alias("n_firms"),
    )
    n = F.col("n_segments")
    scored = scored.withColumn("complete", (n >= 2) & (F.col("n_matched") == n) & (F.col("n_unique") == n) & (F.col("n_firms") == n))
    each = scored.groupBy("match_id").agg(F.sum(F.col("complete").cast("int")).alias("n_complete"), F.max("n_matched").alias("most_matched"), F.min(F.when(F.col("complete"), F.col("partition_id"))).alias("partition_id"))
    state = F.when(F.col("split.too_many_delimiters"), "too many delimiters").when(F.col("n_complete") == 1, "accepted").when(F.col("n_complete") > 1, "several complete partitions").when(F.col("most_matched") > 0, "partly matched").otherwise("not matched")
    told = some.join(each, "match_id", "left").select("match_id", state.alias("partition_status"), F.coalesce("n_complete", F.lit(0)).alias("n_complete"), F.when(F.col("n_complete") == 1, F.col("partition_id")).alias("partition_id"))
    parts = tried.join(told.where("partition_status = 'accepted'").select("match_id", "partition_id"), ["match_id", "partition_id"])
    return told, parts.select("match_id", "segment", "segment_text", "segment_cvr", "segment_step")


def replaced(rows: DataFrame, parts: DataFrame, id_: str = "match_id") -> DataFrame:
    """Rows with an accepted partition replaced by a row for each of its firms, numbered from 1; others as they are."""
    firm = parts.select(id_, (F.col("segment") + 1).alias("expanded_number"), F.col("segment_text").alias("expanded_name"), F.col("segment_cvr").alias("expanded_cvr"), F.col("segment_step").alias("expanded_step"))
    return rows.join(firm, id_, "left").withColumn("flag_expanded", F.col("expanded_cvr").isNotNull())
