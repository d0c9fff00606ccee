"""Chat formatting of reply trees, in DataFrame functions only.

Parent links are composed with themselves (1, 2, 4, ... steps) by self-joins, so depth d
takes about log2(d) rounds. The same joins add up node scores, which ranks every
root-to-leaf branch before any path is written out; then only the chosen branches are
expanded into their nodes and formatted.

Template: <|im_start|>role LF text <|im_end|> LF for every turn. Inside roles and texts
the strings "<", any number of backslashes, "|" get one more backslash, so no control
string occurs there and the step can be undone. In roles, backslash and LF are written
as two characters first, so the first LF of a turn always ends its role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

START = "<|im_start|>"
END = "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # A doubled backslash is parked on a character that was escaped away before "\n" is read.
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Level k: (tree, node, up, total) with `up` the 2**k-th ancestor, or null past the
    root, and `total` the score of the 2**k nodes from `node` upwards."""
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("id"))
    replies = nodes.filter("parent is not null")
    linked = replies.join(known, replies.tree.eqNullSafe(F.col("t")) & (replies.parent == F.col("id")), "left")
    roots = nodes.filter("parent is null").withColumn("id", F.lit(None).cast(nodes.schema["node"].dataType))
    columns = ["tree", "node", F.col("id").alias("up"), F.col("score").alias("total")]
    level = cut_lineage(linked.select(*columns).union(roots.select(*columns)))
    most = max(1, level.count()).bit_length()
    levels = [level]
    while len(levels) <= most and not level.filter("up is not null").isEmpty():
        above = level.select(F.col("tree").alias("t"), F.col("node").alias("id"), F.col("up").alias("next"), F.col("total").alias("more"))
        # Nodes whose link is past the root are done; only the others are joined.
        open_ = level.filter("up is not null")
        joined = open_.join(above, open_.tree.eqNullSafe(F.col("t")) & (open_.up == F.col("id")))
        moved = joined.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"))
        level = cut_lineage(moved.union(level.filter("up is null")))
        levels.append(level)
    return levels


def branches(nodes: DataFrame, per_tree: int | None = 1) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, branch_score, branch_rank) of the chosen leaves, and the link levels."""
    levels = _levels(nodes)
    scored = levels[-1].filter("up is null").select("tree", F.col("node").alias("leaf"), F.col("total").alias("branch_score"))
    inner = nodes.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("id")).distinct()
    leaves = scored.join(inner, scored.tree.eqNullSafe(F.col("t")) & (scored.leaf == F.col("id")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.asc("leaf"))
    ranked = leaves.withColumn("branch_rank", F.row_number().over(order))
    return cut_lineage(ranked if per_tree is None else ranked.filter(F.col("branch_rank") <= per_tree)), levels


def format_trees(
    nodes: DataFrame,
    tree_col: str = "tree_id",
    node_col: str = "node_id",
    parent_col: str = "parent_id",
    role_col: str = "role",
    text_col: str = "text",
    score_col: str | None = "score",
    per_tree: int | None = 1,
    trained_role: str = TRAINED_ROLE,
) -> DataFrame:
    """(tree, leaf, branch_score, branch_rank, n_turns, formatted, loss_spans): one row
    for each of the `per_tree` best branches of a tree (all with None).

    A branch scores the sum of its nodes; equal sums go to the smaller leaf id. Loss
    spans are [start, end) code points of the trained role's texts in `formatted`; empty
    texts have an empty span. Null role and text are empty, a null score is 0, a null tree
    id is one tree. A parent that is null or absent makes a root. Rows that repeat a
    (tree, node) pair count once (the smallest role and text stays); rows with a null node
    id and nodes that only hang on a cycle are on no root-to-leaf path and give nothing.
    Only the named columns are read. An empty table gives no rows.
    """
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    rows = nodes.select(
        F.col(tree_col).alias("tree"),
        F.col(node_col).alias("node"),
        F.struct(
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            F.col(parent_col).alias("parent"),
            score.alias("score"),
        ).alias("turn"),
    ).filter(F.col("node").isNotNull())
    table = cut_lineage(rows.groupBy("tree", "node").agg(F.min("turn").alias("turn")).select("tree", "node", "turn.*"))
    chosen, levels = branches(table, per_tree)
    path = chosen.select("tree", "leaf", F.col("leaf").alias("at"), F.lit(0).cast("long").alias("up_by"))
    for k, level in enumerate(levels[:-1]):
        step = level.select(F.col("tree").alias("t"), F.col("node").alias("id"), "up").filter("up is not null")
        above = path.join(step, path.tree.eqNullSafe(F.col("t")) & (path["at"] == F.col("id")))
        path = cut_lineage(path.union(above.select("tree", "leaf", F.col("up").alias("at"), F.col("up_by") + 2**k)))
    texts = table.select(F.col("tree").alias("t"), F.col("node").alias("id"), "role", "text")
    turns = path.join(texts, path.tree.eqNullSafe(F.col("t")) & (path["at"] == F.col("id")))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = turns.select(
        "tree",
        "leaf",
        (-F.col("up_by")).alias("place"),
        head.alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == trained_role).alias("trained"),
    )
    length = F.length("head") + F.length("body") + len(END) + 1
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length).over(before), F.lit(0)) + F.length("head")
    spans = F.when(F.col("trained"), F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    told = pieces.withColumn("span", spans).groupBy("tree", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("place", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), "span"))).alias("turns")
    )
    made = told.select(
        F.col("tree").alias("t"),
        F.col("leaf").alias("id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join("turns.piece", "").alias("formatted"),
        F.array_compact("turns.span").alias("loss_spans"),
    )
    return chosen.join(made, chosen.tree.eqNullSafe(F.col("t")) & (chosen.leaf == F.col("id"))).drop("t", "id")


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, as they went in."""
    tail = len(END) + 1

    def turn(piece: Column) -> Column:
        end = F.locate("\n", piece)
        body = F.substring(piece, end + 1, F.length(piece) - end - tail)
        return F.struct(unescape_role(F.substring(piece, F.lit(1), end - 1)).alias("role"), unescape(body).alias("text"))

    pieces = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    cut = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return F.array_join(cut, "")
