"""Chat formatting over reply trees (operator 5), with DataFrame functions only.

A message names its parent. Iterative self-joins double the jumps (parent, its parent's parent, then 4, 8 ... up); from every leaf, the
jumps list the leaf's ancestors in as many joins as the depth has bits. Branches are ranked by the mean score of
their messages, and each chosen path is formatted as one conversation.

Template: `<s>` opens a conversation; then, for each turn, `<<SYS>>text<</SYS>>` (system), `[INST]text[/INST]` (user),
`text</s>` (assistant), or `[ROLE]role[/ROLE]text[END]` (any other role). Inside texts, a control string gets a backslash
after its first character (one more, if it has some already), so that no text can hold a control string, and reading back
takes one away. The loss mask covers assistant texts, as spans of code points.

Defined results: null text and null role are empty; a null conversation id is one conversation of its own; messages without an id are left
out; of repeated ids in a conversation the least (role, text) stays; a parent that isn't there makes a root; messages on or under a cycle have
no path; ties of score go to the smaller leaf id; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.storage import Workspace

# The control strings of the template.
_BODY = r"(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|END\])"
_UNIT = r"(?s)\[INST\].*?\[/INST\]|<<SYS>>.*?<</SYS>>|\[ROLE\].*?\[/ROLE\].*?\[END\]|.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _BODY, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _BODY, "$1$2$3")


def reply_paths(messages: DataFrame) -> DataFrame:
    """(c, leaf, m, up): every message m on the path from a root to a leaf, `up` steps above that leaf.

    messages: c (never null), m (never null, unique in c), parent.
    """
    ws = Workspace(messages.sparkSession, "reply-trees")
    nodes = ws.cut(messages.select("c", "m", "parent"))
    here = nodes.select("c", F.col("m").alias("p"))
    jump = ws.cut(nodes.select("c", "m", F.col("parent").alias("p")).join(here, ["c", "p"]).select("c", "m", "p"))
    deepest = nodes.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    jumps = []
    while not jump.isEmpty() and 1 << len(jumps) < deepest:
        jumps.append(jump)
        nxt = jump.select("c", F.col("m").alias("p"), F.col("p").alias("q"))
        jump = ws.cut(jump.join(nxt, ["c", "p"]).select("c", "m", F.col("q").alias("p")))
    on = nodes.select("c", F.col("m").alias("leaf"), "m")
    if jumps:
        on = on.join(jumps[0].select("c", F.col("p").alias("m")).distinct(), ["c", "m"], "left_anti").select("c", "leaf", "m")
    if not jump.isEmpty():  # still jumping after as many steps as there are messages: a cycle
        on = on.join(jump.select("c", "m"), ["c", "m"], "left_anti").select("c", "leaf", "m")
    on = on.withColumn("up", F.lit(0).cast("long"))
    for k in reversed(range(len(jumps))):
        far = F.when(F.col("p").isNotNull(), F.array(F.struct("m", "up"), F.struct(F.col("p").alias("m"), (F.col("up") + (1 << k)).alias("up")))).otherwise(F.array(F.struct("m", "up")))
        on = on.join(jumps[k], ["c", "m"], "left").select("c", "leaf", F.inline(far))
    return on


def best_paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """(c, leaf, branch_rank, branch_score, pos, role, text): the turns of the `keep` best branches of each conversation (None: all)."""
    ws = Workspace(messages.sparkSession, "branches")
    paths = ws.cut(reply_paths(messages))
    scored = paths.join(messages.select("c", "m", "score"), ["c", "m"]).groupBy("c", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"), F.max("up").alias("depth"))
    order = Window.partitionBy("c").orderBy(F.desc("branch_score"), "leaf")
    ranked = scored.withColumn("branch_rank", F.row_number().over(order))
    chosen = ranked.where(F.col("branch_rank") <= keep) if keep else ranked
    turns = paths.join(chosen, ["c", "leaf"]).join(messages.select("c", "m", "conv_id", "role", "text"), ["c", "m"])
    return turns.select("c", "conv_id", "leaf", "branch_rank", "branch_score", (F.col("depth") - F.col("up")).alias("pos"), "role", "text")


def format_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, leaf, branch_rank, branch_score, formatted, loss_spans): a row for each path.

    loss_spans: start (code points, from 0) and length of each assistant text in `formatted`, in order.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    t = turns.select(*(x for x in turns.columns if x not in ("role", "text")), role.alias("role"), text.alias("text"))
    piece = (
        F.when(F.col("role") == "assistant", F.concat("text", F.lit("</s>")))
        .when(F.col("role") == "user", F.concat(F.lit("[INST]"), "text", F.lit("[/INST]")))
        .when(F.col("role") == "system", F.concat(F.lit("<<SYS>>"), "text", F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(F.col("role")), F.lit("[/ROLE]"), "text", F.lit("[END]")))
    )
    before = Window.partitionBy("c", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("piece", piece).withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0)) + 3)
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.char_length("text").cast("long").alias("length")))
    packed = t.groupBy("c", "leaf").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("branch_rank").alias("branch_rank"),
        F.first("branch_score").alias("branch_score"),
        F.array_sort(F.collect_list(F.struct("pos", "piece", span.alias("span")))).alias("t"),
    )
    return packed.select(
        "conv_id",
        "leaf",
        "branch_rank",
        "branch_score",
        F.concat(F.lit("<s>"), F.array_join(F.transform("t", lambda x: x.piece), "")).alias("formatted"),
        F.filter(F.transform("t", lambda x: x.span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with `turns` (role and text of each turn) and `loss_text`, both read from the formatted text."""
    text = F.col("formatted")

    def turn(u: Column) -> Column:
        n = F.char_length(u)
        user, system, other = u.startswith("[INST]"), u.startswith("<<SYS>>"), u.startswith("[ROLE]")
        role = F.when(user, F.lit("user")).when(system, F.lit("system")).when(other, unescape(F.regexp_extract(u, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1))).otherwise(F.lit("assistant"))
        body = (
            F.when(user, F.substring(u, F.lit(7), n - 13))
            .when(system, F.substring(u, F.lit(8), n - 15))
            .when(other, F.regexp_extract(u, r"(?s)^\[ROLE\].*?\[/ROLE\](.*)\[END\]$", 1))
            .otherwise(F.substring(u, F.lit(1), n - 4))
        )
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    units = F.regexp_extract_all(F.substring(text, F.lit(4), F.char_length(text)), F.lit(_UNIT), F.lit(0))
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(text, (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.withColumn("turns", F.transform(units, turn)).withColumn("loss_text", masked)


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as messages that each reply to the one before."""
    key = F.to_json(F.struct(F.col("conv_id").alias("k")))
    order = Window.partitionBy("c").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", key.alias("c"), "turn", "role", "text").withColumn("m", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "c", "m", F.when(F.col("m") > 1, F.col("m") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def tree_messages(rows: DataFrame, conv_col: str = "conv_id", id_col: str = "msg_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Any table of messages in the form that best_paths takes."""
    key = F.to_json(F.struct(F.col(conv_col).alias("k")))
    named = rows.where(F.col(id_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), key.alias("c"), F.col(id_col).alias("m"), F.col(parent_col).alias("parent"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.col(score_col).cast("double").alias("score"))
    first = Window.partitionBy("c", "m").orderBy("role", "text", "parent", "score")
    return named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Linear conversations, formatted: a row for each conversation."""
    return format_paths(best_paths(linear_messages(conversations), keep=1))


def with_probe(conversations: DataFrame, spark: SparkSession) -> DataFrame:
    """conversations and conversation -7, whose two texts hold control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_digest(formatted: DataFrame) -> DataFrame:
    read = read_back(formatted)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
