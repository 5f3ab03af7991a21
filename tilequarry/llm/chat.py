"""Reply trees to training conversations, with DataFrame operations only.

Turns form trees (each names its parent).  Self-joins that double the reach of
each turn's pointer to its ancestors give every turn its depth and the summed
score of its path in log2(depth) rounds; leaves are root-to-leaf branches, ranked
by score (ties to the smaller leaf), and the chosen ones walk back along the
pointers of falling reach, so a path of n turns costs n rows and no more.  Each
chosen path is one conversation:

    <|im_start|>role\\ntext<|im_end|>\\n

Inside roles and texts ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|`` (a line break
in a role ``<|nl|>``), so no control string can come from a text, and reading back
undoes it exactly.  The loss mask lists code-point ranges of assistant texts.

Defined cases: null roles and texts are empty; null conversation ids are one
conversation; a null turn sorts first, equal turns by role and text (repeated rows
are further turns); a turn whose parent is missing is a root, and turns on a cycle
have no root and form no path; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Linear conversations as trees: (tree, node, parent, role, text, score), each
    turn the only reply to the one before."""
    rows = turns.select(F.col(conv_col).alias("tree"), F.col(turn_col).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, depth, role, text) for every turn of the ``branches``
    best-scored root-to-leaf paths of each tree."""
    nodes = nodes.withColumn("key", F.coalesce(F.col("tree").cast("string"), F.lit("null")))
    nodes = written(nodes.select("key", "tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")), "turns")
    own = nodes.select("key", F.col("node").alias("parent"), F.lit(True).alias("found"))
    reach = nodes.select("key", "node", "parent", "score").join(own, ["key", "parent"], "left")
    reach = written(reach.select("key", "node", F.when(F.col("found"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("steps"), "score"), "reach-0")
    first, ended, jumps = reach, [reach.where("up IS NULL")], []
    largest = nodes.groupBy("key").count().agg(F.max("count").alias("n")).first()["n"] or 0
    while not (active := reach.where("up IS NOT NULL")).limit(1).isEmpty():
        if 1 << len(jumps) > largest:
            break  # further than any path: what still points on is on or under a cycle
        jumps.append(active)
        known = reduce(DataFrame.union, [*ended, active])
        above = known.select("key", F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("score").alias("plus"))
        reach = active.join(above, ["key", "up"], "left").select("key", "node", F.col("next").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("score") + F.coalesce("plus", F.lit(0.0))).alias("score"))
        reach = written(reach, f"reach-{len(jumps)}")  # only what isn't at its root yet
        ended.append(reach.where("up IS NULL"))
    rooted = reduce(DataFrame.union, ended)
    parents = first.where("up IS NOT NULL").select("key", F.col("up").alias("node"))
    ranked = rooted.join(parents, ["key", "node"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "node")))
    path = ranked.where(F.col("rank") <= branches).select("key", F.col("node").alias("leaf"), "rank", "node")
    for jump in reversed(jumps):
        step = jump.select("key", "node", "up")  # each node brings its ancestor along
        path = path.join(step, ["key", "node"], "left").select("key", "leaf", "rank", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    depth = rooted.select("key", "node", F.col("steps").alias("depth"))
    return path.join(depth, ["key", "node"]).join(nodes.drop("score", "parent"), ["key", "node"]).select("tree", "leaf", "rank", "depth", "role", "text")


def conversations(paths: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one row a path; loss is an array of
    (start, stop) code points of assistant texts."""
    body = escaped(F.col("text"))
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    rows = paths.withColumn("body", body).withColumn("piece", F.concat(head, F.col("body"), F.lit(END)))
    upto = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stop = F.sum(F.length("piece")).over(upto) - len(END)
    rows = rows.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("body"))
    turn = F.struct("depth", "piece", (F.col("role") == "assistant").alias("learn"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    rows = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")))
    return rows.select("tree", "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(..., turns array of (role, text), loss_text) from ``formatted`` and ``loss`` alone."""
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    parts = F.slice(parts, 2, F.size(parts))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        at = F.length(role) + 2
        text = F.substr(p, at, F.length(p) - at - len(END) + 1)
        return F.struct(unescaped(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescaped(text).alias("text"))

    learnt = F.transform("loss", lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", unescaped(F.array_join(learnt, "")))


def digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(F.col("tree").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The query's rows in DuckDB: digests of the plain turns, and the template's lengths.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
     n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>'))
                   + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
