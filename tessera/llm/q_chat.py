"""Query and SQL of chat formatting."""

from pyspark.sql import functions as F

from . import chat, common

#: A conversation whose texts hold control strings of common templates.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op7_chat_format(spark, sf_dir):
    """All conversations formatted, and digests of what is read back from the result."""
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    done = chat.format_chats(turns.unionByName(probe))
    back = F.array_join(F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = chat.loss_text(F.col("segments"))
    return done.select(
        "conv_id",
        F.size(chat.read_back(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(back, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), placed AS (
  SELECT *, lag(role, 1, '') OVER w AS prev, lead(role) OVER w AS next,
     role || chr(10) || text || chr(10) AS plain,
     length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'))
     + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'))
     + length('<turn role="') + length('">') + length('</turn>') + 1 AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(plain, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE prev WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
     WHEN 'assistant' THEN role = 'user' ELSE false END AND (next IS NOT NULL OR role = 'assistant')) AS valid
FROM placed GROUP BY conv_id
"""

QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {"op7_chat_format": OP7_SQL}
