r"""Chat formatting by prefix-target expansion.

A conversation is formatted once. Every assistant turn becomes an example of its own: all text before it is context
and only that reply is trained on. Examples are stored as offsets into the formatted conversation, n spans for n turns;
`expand` makes each of them a row with its own text, context and reply, and a loss mask over the reply.

Template: `[INST] user [/INST]`, `<s>assistant</s>`, `<SYS>system</SYS>`; any other role r is `<ROLE>r</ROLE>` followed
by the user form. A mark inside a text gets a backslash after its first character, and one more for each it has
already: `</s>` becomes `<\/s>` and `<\/s>` becomes `<\\/s>`. Taking one backslash off again restores every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.text import or_empty, sha256_hex, table

#: The strings that a text must not contain as they stand, with the backslashes that escaping puts in.
GUARD = r"([\[<])(\\*)(/?INST\]|/?s>|/?SYS>|/?ROLE>)"
GUARDED = r"([\[<])\\(\\*)(/?INST\]|/?s>|/?SYS>|/?ROLE>)"
#: One formatted turn: its role if that is none of the three, the opening mark, the text.
TURN = r"(?s)(<ROLE>.*?</ROLE>)?(\[INST\] |<s>|<SYS>)(.*?)(?: \[/INST\]|</s>|</SYS>)"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, GUARD, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, GUARDED, "$1$2$3")


def _opening(role: Column) -> Column:
    return (
        F.when(role == "assistant", "<s>")
        .when(role == "system", "<SYS>")
        .when(role == "user", "[INST] ")
        .otherwise(F.concat(F.lit("<ROLE>"), escape(role), F.lit("</ROLE>[INST] ")))
    )


def _closing(role: Column) -> Column:
    return F.when(role == "assistant", "</s>").when(role == "system", "</SYS>").otherwise(F.lit(" [/INST]"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, examples: array of (turn_no, context_end, target_start, target_chars), offsets from 0.

    Rows of a conversation are ordered by turn, then role and text where turns tie; repeated rows are turns of their
    own. A null text or role is the empty one, a null turn comes before all others, a null conv_id is a conversation
    too. A conversation without assistant turn has no examples. Other columns are ignored; an empty table gives an
    empty result. One conversation is one string, so it must fit a row.
    """
    t = turns.select("conv_id", "turn", or_empty("role").alias("role"), or_empty("text").alias("text"))
    t = t.withColumn("_before", _opening(F.col("role"))).withColumn("_body", escape(F.col("text")))
    t = t.withColumn("_whole", F.concat("_before", "_body", _closing(F.col("role"))))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    done = F.sum(F.length("_whole")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("turn_no", F.row_number().over(order) - 1).withColumn("context_end", done - F.length("_whole"))
    target = F.struct(
        "turn_no",
        "context_end",
        (F.col("context_end") + F.length("_before")).alias("target_start"),
        F.length("_body").cast("long").alias("target_chars"),
    )
    whole = F.array_sort(F.collect_list(F.struct("turn_no", "_whole")))
    return t.groupBy("conv_id").agg(
        F.array_join(F.transform(whole, lambda x: x["_whole"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", target))).alias("examples"),
    )


def expand(convs: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, turn_no, context_end, target_start, target_chars, example, context, target.

    An example is the formatted conversation up to the end of its reply: the context of all turns before it, then the
    reply in its marks. The loss mask, target_chars characters from target_start on, covers the reply and nothing else.
    All texts are cut out of the formatted conversation at the offsets, one example at a time. Their size is quadratic
    in the turns of a conversation; whoever does not select `example` and `context` does not pay for them.
    """
    cut = lambda c, start, n: F.substring(c, start.cast("int") + 1, n.cast("int"))
    e = convs.select("conv_id", "formatted", F.explode("examples").alias("_e")).select("conv_id", "formatted", "_e.*")
    # after the mark in front of the target comes the target, then the closing mark
    end = F.col("target_start") + F.col("target_chars") + len("</s>")
    e = e.withColumn("example", cut("formatted", F.lit(0), end))
    return e.select(
        "conv_id", "turn_no", "context_end", "target_start", "target_chars", "example",
        cut("example", F.lit(0), F.col("context_end")).alias("context"),
        cut("example", F.col("target_start"), F.col("target_chars")).alias("target"),
    )


def contexts(convs: DataFrame) -> DataFrame:
    """The examples as pairs of context and target."""
    return expand(convs).select("conv_id", "turn_no", "context", "target")


def read_back(convs: DataFrame) -> DataFrame:
    """What the formatted conversations and their examples say: turns, and the text under the loss mask.

    The loss text is read from the spelt-out examples, from each what its mask covers.
    """
    part = lambda n: F.regexp_extract_all("formatted", F.lit(TURN), F.lit(n))
    turns = F.arrays_zip(part(1).alias("named"), part(2).alias("opening"), part(3).alias("body"))
    role = lambda x: (
        F.when(x["opening"] == "<s>", "assistant")
        .when(x["opening"] == "<SYS>", "system")
        .when(x["named"] == "", "user")
        .otherwise(unescape(F.regexp_replace(x["named"], "^<ROLE>|</ROLE>$", "")))
    )
    said = F.transform("_turns", lambda x: F.concat(role(x), F.lit("\n"), unescape(x["body"]), F.lit("\n")))
    told = convs.withColumn("_turns", turns).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        sha256_hex(F.array_join(said, "")).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    under_mask = F.array_sort(F.collect_list(F.struct("turn_no", unescape(F.col("target")).alias("t"))))
    loss = expand(convs).groupBy(F.col("conv_id").alias("_conv")).agg(
        F.array_join(F.transform(under_mask, lambda x: x["t"]), "").alias("_loss"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    joined = told.join(loss, told["conv_id"].eqNullSafe(loss["_conv"]), "left")
    trained = or_empty("_loss")
    return joined.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length(trained).cast("long").alias("loss_chars"),
        sha256_hex(trained).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n_examples", F.lit(0).cast("long")).alias("n_examples"),
    )


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts look like the end of one turn and the start of the next."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(format_conversations(with_probe(spark, table(spark, sf_dir, "conversations"))))


_PROBE = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace({}, '([\[<])(\\*)(/?INST\]|/?s>|/?SYS>|/?ROLE>)', '\1\\\2\3', 'g')"
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
e AS (SELECT *, len({_ESCAPED.format("text")}) AS body,
        CASE role WHEN 'assistant' THEN 7 WHEN 'system' THEN 11 WHEN 'user' THEN 15
             ELSE 28 + len({_ESCAPED.format("role")}) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + marks)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM e GROUP BY conv_id
"""
