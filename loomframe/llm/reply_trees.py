"""Chat formatting of reply trees: every chosen path from a root to a leaf becomes one formatted conversation.

Messages name the message they answer. Iterative self-joins double the reach of every message's link (its parent, the
parent's parent, four up, ...), so depth, root and score of all branches are known after a number of rounds that grows
with the logarithm of the depth. Branches of a tree are ranked by their score, and the paths of those chosen are listed by
the same links, each (leaf, ancestor) once. Texts take no part in this: they move once, to the paths of their tree.

The template begins a turn with ``### role: `` and ends it with ``</turn>`` and a line feed. What could be mistaken for
either inside a text is escaped, reversibly: a backslash as ``\\b``, the ``<`` of ``</turn>`` as ``\\l``, a ``#`` before two
others as ``\\h``, and a ``:`` in a role as ``\\c``. Every formatted conversation comes with its turns' places in code points
and whether their text is under the loss mask (that of assistants).

Defined cases: a null text, role or score is empty or 0; a message whose parent is null or unknown is a root; messages
that repeat an id are all kept, the first in the order of their columns is the one answered; a message with a null id is
never answered; messages on or below a cycle have no root and are in no path; branches of equal score are ranked by the
leaf's place; a null conversation is one of its own; an empty table gives an empty result; further columns are ignored. A
conversation is one row, so what one branch may hold is bounded by a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.ranks import placed
from loomframe.llm.common import bounded, stored, table, union_all

END = "</turn>\n"
#: Trees with more path rows than this do not meet in one place: their texts move once more, by message.
TREE_ROWS = 100_000


def escaped(text: Column) -> Column:
    safe = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("</turn>"), F.lit("\\l/turn>"))
    return F.regexp_replace(safe, "#(?=##)", r"\\h")


def unescaped(text: Column) -> Column:
    for code, plain in (("\\l", "<"), ("\\h", "#"), ("\\c", ":"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def header(role: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit(": "))


def tree_of(conv: str = "conv_id") -> Column:
    """A key that is never null, so that null conversations meet in joins like any other."""
    return F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit(""))


def mark(text: str = "text") -> Column:
    """52 bits of the text's MD5: an order for what is equal otherwise. It is the same wherever it is computed."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 13), 16, 10).cast("long")


def doubled(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For stored ``links`` (node, up, score): the links two to the power of k up (node, up), by k, and for every message
    below a root (node, root, depth, score), the score summed from the root to it."""
    rising = stored(links.select("node", "up", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "branches")
    levels, settled, n = [], [], links.count()
    while True:
        settled.append(rising.where("up is null"))
        rising = rising.where("up is not null")
        if rising.isEmpty() or 2 ** len(levels) > n:  # no branch is as deep: only cycles go on
            return levels, union_all(settled).select("node", "root", "depth", "score")
        levels.append(rising.select("node", "up"))
        above = union_all([*settled, rising]).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), (F.col("depth") + 1).alias("more"), F.col("score").alias("over"))
        reached = rising.join(above, "up").select("node", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("over")).alias("score"))
        rising = stored(reached, "branches")


def chosen_paths(tree: DataFrame, branches: int | None = None) -> DataFrame:
    """Stored (tree, place, leaf, back, branch, score) over ``tree`` (tree, place, parent_place, score): every message of
    the best ``branches`` paths of each root (None: all), ``back`` steps before its leaf; ``branch`` is the path's rank."""
    nodes = stored(tree.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers of the stored rows
    parents = nodes.select("tree", F.col("place").alias("parent_place"), F.col("node").alias("up"))
    links = stored(nodes.join(parents, ["tree", "parent_place"], "left").select("node", "up", "tree", "place", "score"), "links")
    levels, known = doubled(links)
    answered = links.where("up is not null").select(F.col("up").alias("node")).distinct()
    leaves = known.join(answered, "node", "left_anti").join(links.select("node", "tree", F.col("place").alias("leaf")), "node")
    best = placed(leaves, "root", F.col("score").desc(), F.col("leaf")).withColumnRenamed("place", "branch")
    best = stored(best if branches is None else best.where(F.col("branch") < branches), "leaves")
    parts = [best.select(F.col("node").alias("end"), "node", F.lit(0).cast("long").alias("back"))]
    for k, level in enumerate(levels):
        further = union_all(parts).join(level, "node").select("end", F.col("up").alias("node"), (F.col("back") + 2**k).alias("back"))
        parts.append(stored(further, "paths"))
    of_leaf = best.select(F.col("node").alias("end"), "leaf", F.col("branch") + 1, "score").toDF("end", "leaf", "branch", "score")
    places = links.select("node", "tree", "place")
    return stored(union_all(parts).join(of_leaf, "end").join(places, "node").select("tree", "place", "leaf", "back", "branch", "score"), "paths")


def _lines(rows: DataFrame) -> DataFrame:
    """One row for each path over ``rows`` (tree, conv_id, leaf, back, branch, score, role, text)."""
    head, body = header(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"head": head, "body": body, "loss": F.coalesce(F.col("role") == "assistant", F.lit(False))})
    size = F.length("head") + F.length("body") + len(END)
    start = F.sum(size.cast("long")).over(Window.partitionBy("tree", "leaf").orderBy(F.col("back").desc())) - size
    rows = rows.withColumn("start", start).withColumn("text_start", F.col("start") + F.length("head")).withColumn("text_end", F.col("text_start") + F.length("body"))
    turn = F.struct((-F.col("back")).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"), "start", "text_start", "text_end", "loss")
    paths = rows.groupBy("tree", "leaf").agg(F.first("conv_id").alias("conv_id"), F.first("branch").alias("branch"), F.first("score").alias("score"), F.array_sort(F.collect_list(turn)).alias("t"))
    places = F.transform("t", lambda x: F.struct(x["start"].alias("start"), x["text_start"].alias("text_start"), x["text_end"].alias("text_end"), x["loss"].alias("loss")))
    return paths.select("conv_id", "leaf", "branch", "score", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), places.alias("turns"))


def formatted(messages: DataFrame, paths: DataFrame, *order: str) -> DataFrame:
    """Paths with their texts: conv_id, leaf, branch, score, formatted, turns (start, text_start, text_end, loss).

    ``messages`` (tree, conv_id, role, text, ...) have the places of ``paths`` in the ``order`` inside their tree. Paths
    and messages of a tree meet where both are sorted, so a text moves once whatever the number of paths.
    """
    large = bounded(stored(paths.groupBy("tree").count().where(F.col("count") > TREE_ROWS).select("tree"), "large-trees"))
    whole = large.isEmpty()
    few, texts = (paths, messages) if whole else (x.join(large, "tree", "left_anti") for x in (paths, messages))
    both = texts.withColumn("kind", F.lit(0)).unionByName(few.withColumn("kind", F.lit(1)), allowMissingColumns=True).repartition("tree")
    own = F.row_number().over(Window.partitionBy("tree").orderBy("kind", *order)) - 1
    met = both.withColumn("place", F.when(F.col("kind") == 0, own.cast("long")).otherwise(F.col("place")))
    text = F.first(F.struct("conv_id", "role", "text")).over(Window.partitionBy("tree", "place").orderBy("kind"))
    out = _lines(met.withColumn("m", text).where("kind = 1").select("tree", "leaf", "back", "branch", "score", "m.*"))
    if whole:
        return out
    many = placed(messages.join(large, "tree", "left_semi"), "tree", *order).select("tree", "place", "conv_id", "role", "text")
    return out.unionByName(_lines(paths.join(large, "tree", "left_semi").join(many, ["tree", "place"])))


def reply_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """The best ``branches`` conversations of each tree of ``messages`` (conv_id, message_id, parent_id, role, text, score)."""
    order = ("message_id", "parent_id", "score", "role", "mark")
    named = messages.select(tree_of().alias("tree"), "conv_id", "message_id", "parent_id", F.col("score").cast("double").alias("score"), "role", mark().alias("mark"), "text")
    known = stored(placed(named.select("tree", *order), "tree", *order).select("tree", "message_id", "parent_id", "score", "place"), "messages")
    answered = known.where("message_id is not null").groupBy("tree", F.col("message_id").alias("parent_id")).agg(F.min("place").alias("parent_place"))
    tree = known.join(answered, ["tree", "parent_id"], "left").select("tree", "place", "parent_place", "score")
    return formatted(named, chosen_paths(tree, branches), *order)


def threads(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text), each answering the one before, formatted: a tree of one branch for each."""
    order = ("turn", "role", "mark")
    named = turns.select(tree_of().alias("tree"), "conv_id", "turn", "role", mark().alias("mark"), "text")
    chain = placed(named.select("tree", *order), "tree", *order).select("tree", F.col("place").cast("long").alias("place"))
    before = F.when(F.col("place") > 0, F.col("place") - 1)
    return formatted(named, chosen_paths(chain.withColumns({"parent_place": before, "score": F.lit(0.0)})), *order)


def read_back(conversations: DataFrame) -> DataFrame:
    """``conversations`` (formatted, turns) with what their strings say: ``said`` (role, text) by turn, and ``loss``, the
    unescaped text under the mask."""
    pieces = F.slice(F.split("formatted", END), 1, F.size("turns"))

    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit(": "))
        return F.struct(unescaped(F.substring(p, F.lit(5), at - 5)).alias("role"), unescaped(F.substring(p, at + 2, F.length(p))).alias("text"))

    def masked(p: Column, t: Column) -> Column:
        span = F.substring(p, (t["text_start"] - t["start"] + 1).cast("int"), (t["text_end"] - t["text_start"]).cast("int"))
        return F.when(t["loss"], unescaped(span)).otherwise("")

    out = conversations.withColumn("pieces", pieces)
    return out.withColumns({"said": F.transform("pieces", turn), "loss": F.array_join(F.zip_with("pieces", "turns", masked), "")}).drop("pieces")


#: A conversation whose texts look like the template's own marks.
PROBE = r"\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every conversation, and the probe as conversation -7, as read back from its formatted string."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    probe = probe.select(*[F.col(c).cast(t).alias(c) for c, t in turns.dtypes])
    out = read_back(threads(turns.unionByName(probe)))
    lines = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) p(turn, role)
), e AS (
  SELECT *, md5(text)[1:13] AS mark, len(text) + (len(text) - len(replace(text, '\', ''))) + (len(text) - len(replace(text, '</turn>', ''))) // 7
            + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: len(x) - 2)), 0) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, mark)) AS turns_sha256,
       sum(CASE role WHEN 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE role WHEN 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, mark)) AS loss_sha256,
       sum(4 + len(role) + 2 + chars + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
