"""The queries of the operators and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procurelake.llm.spark import crc_rest, documents, prepared


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~held))
    out = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return out.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import repeats

    out = repeats.removed(documents(spark, sf_dir).select("doc_id", "text"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", cut.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import near

    out = near.linked(documents(spark, sf_dir).select("doc_id", "text"), percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM h, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 49)) AS t(i)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM w JOIN f USING (s) WHERE least < doc_id),
run AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
rest AS (SELECT doc_id, a, b, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM span),
cut AS (SELECT h.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
    any_value(substr(x, 1, 2 * (SELECT min(s.a) FROM span s WHERE s.doc_id = h.doc_id)))
    || string_agg(substr(x, 2 * b + 1, CASE WHEN next IS NULL THEN length(x) ELSE 2 * (next - b) END), '' ORDER BY a) AS kept
  FROM h JOIN rest USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, CAST(length(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN cut USING (doc_id)
"""


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) m ON m.d = d.doc_id
"""


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from procurelake.llm import bpe

    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import lm

    return lm.score(documents(spark, sf_dir).select("doc_id", "text"), F.coalesce(crc_rest("doc_id", 10) != 0, F.lit(True)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import langid

    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = F.coalesce(crc_rest("doc_id", 4) == 2, F.lit(False))
    model = langid.train(docs.where(~held).select("text", "lang"))
    return langid.predict(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import quality

    return quality.judged_by_itself(documents(spark, sf_dir).select("doc_id", "text", "lang")).drop("lang")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from procurelake.llm import packing

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


CONTROL = "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import chat

    turns = prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.sql("SELECT -7L AS conv_id, t.turn, t.role, :said AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"said": CONTROL})
    out = chat.render(chat.canonical(chat.mixed(chat.gathered(turns.unionByName(added))), "record"))
    read, loss = chat.read_turns(F.col("formatted")), F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_spans")), "")
    out = out.select("conv_id", "formatted", read.alias("read"), loss.alias("loss"))
    return out.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from procurelake.llm import edits

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return edits.with_next(docs, grouped=edits.groups(docs))


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
longer AS (
  SELECT *, length(role || text) + (length(role || text) - length(translate(role || text, '\<#', ''))) + 20 AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM longer GROUP BY conv_id
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2_SQL, "op3_near_duplicates": OP3_SQL, "op9_chat": OP9_SQL}
