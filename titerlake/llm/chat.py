"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: all turns before it are context and only its reply is trainable. A
conversation whose last turns have no reply gives one more row, without trainable text, so that no turn is lost.

Template: each turn is ``<|im_start|>role`` newline ``text`` ``<|im_end|>`` newline. A control string that occurs
inside a text gets one ``~`` after its first character, and one that already has such marks gets one more; taking
one away again restores the text exactly.

Defined cases: a null role or text counts as empty; an empty text makes an empty turn; turns are ordered by
(turn, role, text) with nulls first, so ties and repeated rows have one order and all are kept; a null conv_id is a
conversation of its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titerlake.llm.text import pick

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings that may not stand unescaped inside a text (fixed values).
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]")

_TAILS = "|".join(s[1:].replace("|", r"\|").replace("]", r"\]").replace("[", r"\[") for s in CONTROLS)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(~*)(?={_TAILS})", "$1~$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])~(~*)(?={_TAILS})", "$1$2")


def _role(role: Column) -> Column:
    """A role on one line: backslash and newline are written with a backslash."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unrole(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def expand_prefix_targets(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """Rows ``conv_id, example, trainable, formatted, loss_start, loss_end`` from rows by turn.

    ``formatted[loss_start:loss_end]`` (code points, end exclusive) is the escaped reply, the only trainable text.
    """
    rows = turns.select(*pick(("conv_id", "conv_id"), ("turn", "turn"), ("role", "role"), ("text", "text")))
    rows = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                (t["role"] == assistant).alias("reply"),
                F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"),
                escaped(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )
    last = F.size("turns")
    targets = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("at"), (t["reply"] | (i == last - 1)).alias("take"))), lambda x: x["take"])
    each = convs.select("conv_id", "turns", F.posexplode(F.transform(targets, lambda x: x["at"])).alias("example", "at"))
    now = F.element_at("turns", F.col("at") + 1)
    each = each.select(
        "conv_id",
        "example",
        now["reply"].alias("trainable"),
        F.array_join(F.transform(F.slice("turns", 1, F.col("at")), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("context"),
        now["head"].alias("head"),
        now["body"].alias("body"),
    )
    opened = F.length("context") + F.length("head")
    return each.select(
        "conv_id",
        "example",
        "trainable",
        F.concat("context", "head", "body", F.lit(END)).alias("formatted"),
        opened.alias("loss_start"),
        (opened + F.when(F.col("trainable"), F.length("body")).otherwise(0)).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(
            _unrole(F.substr(head, F.lit(len(START) + 1))).alias("role"),
            unescaped(F.substr(part, F.length(head) + 2)).alias("text"),
        )

    return F.transform(turns, turn)


def digest_examples(examples: DataFrame) -> DataFrame:
    """Per conversation, what can be read back from its examples: turns of the longest, loss text of each."""
    loss = unescaped(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = examples.withColumn("loss", loss).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = read_turns(F.col("whole"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(*pick(("conv_id", "conv_id"), ("turn", "turn"), ("role", "role"), ("text", "text")))
    probe = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    return digest_examples(expand_prefix_targets(turns.unionByName(added)))


_SQL_TAILS = "|".join(s[1:].replace("|", r"\|").replace("]", r"\]").replace("[", r"\[") for s in CONTROLS)
ORACLE_SQL = {
    "op1_chat_formatting": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '([<\[])(~*)({_SQL_TAILS})', '\1~\2\3', 'g') || '<|im_end|>' || chr(10)))
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR pos = n) AS n_examples
FROM numbered GROUP BY conv_id
"""
}
