"""Chat formatting over reply trees.

Messages of a tree name their parent. Self-joins with doubled steps find the way from every
message to its root: round k joins the links with themselves, so that each message knows its
ancestor 2**k steps up and the score and length of the way there; a tree of depth d takes
log2(d) rounds, each a table in the shared folder. A branch is a path from the root to a leaf;
its score is the mean score of its messages. Branches are ranked within their tree; those
chosen are spelled out by the same links from the longest step down to the shortest, each
round adding to a path the messages a step above those it has, so every message of a path
comes once. Each path becomes one conversation.

The template writes a turn as ``### <role>: <text></turn>`` and a newline. Within roles and texts
a backslash becomes ``\\s``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\e``, and in roles a colon
becomes ``\\c``, so control strings occur where the template puts them and nowhere else, and
``turns_of`` reads all turns back. ``spans`` is the loss mask: start and length, in code points
of the formatted text, of each assistant turn's (escaped) text.

Defined cases: null texts, roles and scores are empty, empty and 0; a null tree is a tree of
its own; a parent that its tree does not hold makes a message a root; of rows with one
message id the least (by parent, role, text, score) is the message; messages in or below a
circle have no root and belong to no path (all others do, if ``branches`` is None); equal
scores rank the longer path first, then the lesser leaf; empty tables give empty
results; other columns are ignored. One conversation is one value, so its turns meet in one task;
nothing else of a tree does but rows of ids and numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

HEAD, END = "### ", "</turn>"
LEARNED = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("###"), F.lit("\\h")), F.lit(END), F.lit("\\e"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescaped(text: Column) -> Column:
    out = text
    for mark, plain in (("\\c", ":"), ("\\e", END), ("\\h", "###"), ("\\s", "\\")):
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _ways(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(one table a round: tree, id, up, the ancestor 2**k steps up), (tree, id, total, steps) of messages with a root.

    ``links`` has tree, id, up (parent or null) and score. A round joins only messages whose way
    goes on. The rounds end when there is none, or when a round has let none of them reach its
    root: then only circles are left.
    """
    made = materialize(links.select("tree", "id", "up", F.col("score").alias("total"), F.lit(1).cast("long").alias("steps")), "links-0")
    rounds, rooted, left = [], [made.where("up is null")], None
    going = made.where("up is not null")
    while (now := going.count()) and now != left:
        left = now
        rounds.append(going.select("tree", "id", "up"))
        above = _all([*rooted, going]).select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("steps").alias("further"))
        joined = going.join(above, ["tree", "up"])
        made = materialize(joined.select("tree", "id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("steps") + F.col("further")).alias("steps")), f"links-{len(rounds)}")
        rooted.append(made.where("up is null"))
        going = made.where("up is not null")
    return rounds, _all(rooted).select("tree", "id", "total", "steps")


def best_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, score, n_turns, position, id): the messages of each chosen path, position 0 at the root.

    ``messages`` has tree, id, parent and score, one row an id. ``branches`` is how many branches
    of a tree to choose, all if None.
    """
    links = messages.alias("m").join(messages.select(F.col("tree").alias("t"), F.col("id").alias("up")), (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("up")), "left")
    rounds, rooted = _ways(links.select("m.tree", "m.id", "up", F.coalesce(F.col("m.score").cast("double"), F.lit(0.0)).alias("score")))
    leaves = rooted
    if rounds:
        leaves = rooted.join(rounds[0].select("tree", F.col("up").alias("id")).distinct(), ["tree", "id"], "left_anti")
    score = F.col("total") / F.col("steps")
    order = Window.partitionBy("tree").orderBy(score.desc(), F.desc("steps"), "id")
    chosen = leaves.select("tree", F.col("id").alias("leaf"), F.row_number().over(order).alias("rank"), score.alias("score"), F.col("steps").alias("n_turns"))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    chosen = materialize(chosen, "chosen")
    parts = [chosen.select("tree", "leaf", "rank", "score", "n_turns", (F.col("n_turns") - 1).alias("position"), F.col("leaf").alias("id"))]
    for k in reversed(range(len(rounds))):
        step = F.lit(1 << k)
        further = _all(parts).where(F.col("position") >= step).join(rounds[k], ["tree", "id"])
        parts.append(materialize(further.select("tree", "leaf", "rank", "score", "n_turns", (F.col("position") - step).alias("position"), F.col("up").alias("id")), f"paths-{k}"))
    return _all(parts)


def format_trees(messages: DataFrame, branches: int | None = 1, tree: str = "tree_id", id: str = "message_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = "score") -> DataFrame:
    """Per chosen path: the tree's column, leaf, rank, score, n_turns, formatted, spans (array of start, length)."""
    points = F.col(score) if score else F.lit(0.0)
    rows = messages.select(F.struct(F.col(tree).alias("tree_id")).alias("tree"), F.col(id).alias("id"), F.col(parent).alias("parent"), F.col(role).alias("role"), F.col(text).cast("string").alias("text"), points.cast("double").alias("score"))
    with scratch() as keep:
        one = rows.groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m"))
        one = keep(materialize(one.select("tree", "id", "m.*"), "messages"))
        paths = keep(materialize(best_paths(one.select("tree", "id", "parent", "score"), branches), "paths"))
    turns = paths.join(one.select("tree", "id", "role", "text"), ["tree", "id"])
    name, said = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    turns = turns.withColumn("head", F.concat(F.lit(HEAD), escaped(name, role=True), F.lit(": "))).withColumn("said", said)
    turns = turns.withColumn("turn", F.concat("head", "said", F.lit(END + "\n"))).withColumn("learned", name == LEARNED)
    before = Window.partitionBy("tree", "leaf").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("turn")).over(before), F.lit(0)) + F.char_length("head"))
    turns = turns.withColumn("span", F.when(F.col("learned"), F.struct("start", F.char_length("said").cast("long").alias("length"))))
    whole = turns.groupBy("tree", "leaf").agg(
        F.first("rank").alias("rank"), F.first("score").alias("score"), F.first("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("position", "turn"))).alias("turns"), F.sort_array(F.collect_list("span")).alias("spans")
    )
    return whole.select(F.col("tree.tree_id").alias(tree), "leaf", "rank", "score", "n_turns", F.array_join(F.col("turns.turn"), "").alias("formatted"), "spans")


def turns_of(formatted: Column) -> Column:
    """Array of (role, text), read back from a formatted conversation."""
    parts = F.split(formatted, f"{END}\n")

    def turn(x: Column) -> Column:
        head = F.substring_index(x, ":", 1)
        role = F.substring(head, F.lit(len(HEAD) + 1), F.char_length(head))
        said = F.substring(x, F.char_length(head) + 3, F.char_length(x))
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as reply trees of one branch each: every turn replies to the one before (by turn, role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("message_id"))
    return rows.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1))


#: A conversation whose texts hold the template's own control strings.
PLANTED = "\\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.unionByName(rows.sparkSession.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], rows.schema))


def digest(made: DataFrame) -> DataFrame:
    """The columns of op12, read back from formatted texts and spans."""
    turns = F.array_join(F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    made = made.withColumn("learned", learned_text(F.col("formatted"), F.col("spans")))
    return made.select("conv_id", F.size(turns_of(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = '{LEARNED}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
       CAST(sum(length('{HEAD}' || replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '{END}', '\e'), ':', '\c') || ': ' || replace(replace(replace(t, '\', '\s'), '###', '\h'), '{END}', '\e') || '{END}') + 1) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
