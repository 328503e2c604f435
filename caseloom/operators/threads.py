"""Rebuild conversation threads from reply links.

Each message belongs to the conversation with the smallest label
``(root order, depth, path)`` that reaches it along the reply lists, and the labels of one
conversation in that order are its breadth-first order. ``path`` keeps the child position only
where a message has several existing children, so a long chain has an empty path.

A message with exactly one parent simply extends its parent's label. Pointer doubling therefore
collapses those into their nearest *head* - a root, or a message with several parents - in
log2(depth) rounds, and only the graph between heads is iterated to its fixpoint. All rounds
carry ids, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.constants import RESOLUTION_PATTERNS
from caseloom.functions.text import clean_text, matches_any, parse_created_at
from caseloom.operators.skew import lookup_join, number_rows
from caseloom.session import cut_and_count, cut_lineage

PAGE_TURNS = 1000


def root_order(tweet_id: Column) -> Column:
    """Numeric order of the id, then its text: stands in for the input order of a file."""
    return F.struct(tweet_id.try_cast("decimal(38,0)").alias("number"), tweet_id.alias("text"))


def message_nodes(tweets: DataFrame, order: str | None = None) -> DataFrame:
    """One row per ``tweet_id``.

    Of several rows with the same id the last by ``order`` stays, by default the one with the
    latest time. The maximum is combined before the shuffle, so a repeated id is no hot key.
    """
    text = F.col("cleaned_text") if "cleaned_text" in tweets.columns else clean_text(F.col("text"))
    last = F.col(order) if order else parse_created_at(F.col("created_at"))
    row = F.struct(
        last.alias("last"),
        F.col("created_at"),
        text.alias("text"),
        F.col("author_id"),
        F.col("inbound"),
        F.col("response_tweet_id"),
        F.col("in_response_to_tweet_id"),
    )
    picked = tweets.groupBy("tweet_id").agg(F.max(row).alias("r"))
    return picked.select(
        "tweet_id", "r.author_id", "r.inbound", "r.created_at", "r.text",
        "r.response_tweet_id", "r.in_response_to_tweet_id",
    )


def reply_edges(nodes: DataFrame) -> DataFrame:
    """``(parent, child, position, siblings)`` for every listed child that exists.

    ``siblings`` is the number of existing children of the parent. A child listed twice keeps
    its first position.
    """
    listed = nodes.where(F.col("response_tweet_id").isNotNull()).select(
        F.col("tweet_id").alias("parent"),
        F.posexplode(F.split("response_tweet_id", ",")).alias("position", "raw"),
    )
    edges, n_edges = cut_and_count(
        listed.select("parent", F.trim("raw").alias("child"), "position")
        .where(F.col("child") != "")
        .groupBy("parent", "child")
        .agg(F.min("position").alias("position"))
    )
    # A listed id can be named by very many parents; ids are unique on the other side.
    known, n_known = cut_and_count(
        lookup_join(
            edges, nodes.select(F.col("tweet_id").alias("child")), "child", "parent", "inner", n_edges
        )
    )
    siblings = known.groupBy("parent").agg(F.count("*").alias("siblings"))
    return lookup_join(known, siblings, "parent", "child", "inner", n_known)


def find_roots(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Ids of inbound messages without a parent or whose parent is not in the table.

    ``rows`` is the number of nodes, if known.
    """
    inbound = nodes.where(F.col("inbound")).select("tweet_id", "in_response_to_tweet_id")
    parent = F.col("in_response_to_tweet_id")
    orphan = inbound.where(parent.isNull() | (parent == "")).select("tweet_id")
    linked = inbound.where(parent.isNotNull() & (parent != "")).withColumnRenamed(
        "in_response_to_tweet_id", "parent"
    )
    known = nodes.select(F.col("tweet_id").alias("parent"), F.lit(True).alias("exists"))
    missing = lookup_join(linked, known, "parent", "tweet_id", "left", rows).where(
        F.col("exists").isNull()
    )
    return orphan.unionByName(missing.select("tweet_id"))


def _step(position: Column, siblings: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(siblings > 1, F.array(position)).otherwise(none)


def _to_heads(nodes: DataFrame, roots: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nearest head of every message, and the edges that enter heads.

    Returns ``(tweet_id, head, hops, path)`` and ``(parent, child, step)``.
    """
    incoming = edges.groupBy("child").agg(
        F.count("*").alias("parents"),
        F.min(F.struct("parent", "position", "siblings")).alias("only"),
    )
    marked = (
        nodes.select("tweet_id")
        .join(roots.withColumn("is_root", F.lit(True)), "tweet_id", "left")
        .join(incoming.withColumnRenamed("child", "tweet_id"), "tweet_id", "left")
    )
    is_head = F.col("is_root").isNotNull() | (F.coalesce("parents", F.lit(0)) != 1)
    state, left = cut_and_count(
        marked.select(
            "tweet_id",
            is_head.alias("done"),
            F.when(is_head, F.col("tweet_id")).otherwise(F.col("only.parent")).alias("head"),
            F.when(is_head, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("hops"),
            F.when(is_head, F.array().cast("array<int>"))
            .otherwise(_step(F.col("only.position"), F.col("only.siblings")))
            .alias("path"),
        ),
        ~F.col("done"),
    )
    heads = state.where("done")
    into_heads = edges.join(
        heads.select(F.col("tweet_id").alias("child")), "child", "left_semi"
    ).select("parent", "child", _step(F.col("position"), F.col("siblings")).alias("step"))

    finished = heads
    open_rows = state.where(~F.col("done"))
    while left:
        # ``target`` is the state of the message that each open row points at.
        target = finished.unionByName(open_rows).select(
            F.col("tweet_id").alias("head"),
            F.col("head").alias("next_head"),
            F.col("hops").alias("next_hops"),
            F.col("path").alias("next_path"),
            F.col("done").alias("next_done"),
        )
        moved = lookup_join(open_rows, target, "head", "tweet_id", "inner", left).select(
            "tweet_id",
            F.col("next_done").alias("done"),
            F.col("next_head").alias("head"),
            (F.col("hops") + F.col("next_hops")).alias("hops"),
            F.concat("next_path", "path").alias("path"),
        )
        moved, still = cut_and_count(moved, ~F.col("done"))
        finished = finished.unionByName(moved.where("done"))
        open_rows = moved.where(~F.col("done"))
        if still == left:  # only cycles that no root reaches are left
            break
        left = still
    return finished.drop("done"), into_heads


def _flat(labels: DataFrame) -> DataFrame:
    """Labels as plain columns, taken apart before a join rather than after it."""
    return labels.select(
        "tweet_id",
        F.col("label.root").alias("label_root"),
        F.col("label.depth").alias("label_depth"),
        F.col("label.path").alias("label_path"),
    )


def label_messages(nodes: DataFrame, n_nodes: int | None = None) -> DataFrame:
    """``(tweet_id, root_id, depth, path)`` of every message that some root reaches.

    ``n_nodes`` is the number of nodes, if known.
    """
    edges, n_edges = cut_and_count(reply_edges(nodes))
    roots = cut_lineage(find_roots(nodes, n_nodes))
    to_head, into_heads = _to_heads(nodes, roots, edges)

    # Edges between heads: parent's head -> child, over the parent's own path.
    parents = to_head.select(
        F.col("tweet_id").alias("parent"), F.col("head").alias("from"), "hops", "path"
    )
    links, n_links = cut_and_count(
        lookup_join(into_heads, parents, "parent", "child", "inner", n_edges).select(
            "from", "child", (F.col("hops") + 1).alias("hops"), F.concat("path", "step").alias("path")
        )
    )
    empty_path = F.array().cast("array<int>")
    label = F.struct(
        root_order(F.col("tweet_id")).alias("root"),
        F.lit(0).cast("bigint").alias("depth"),
        empty_path.alias("path"),
    )
    labels = roots.select("tweet_id", label.alias("label"))
    if n_links:
        frontier = labels
        while True:
            offers = (
                lookup_join(
                    links.withColumnRenamed("from", "tweet_id"), _flat(frontier), "tweet_id", "child", "inner", n_links
                )
                .select(
                    F.col("child").alias("tweet_id"),
                    F.struct(
                        F.col("label_root").alias("root"),
                        (F.col("label_depth") + F.col("hops")).alias("depth"),
                        F.concat("label_path", "path").alias("path"),
                    ).alias("label"),
                )
                .groupBy("tweet_id")
                .agg(F.min("label").alias("offer"))
            )
            merged, n_better = cut_and_count(
                labels.join(offers, "tweet_id", "full").select(
                    "tweet_id",
                    F.least("label", "offer").alias("label"),
                    (F.col("label").isNull() | F.coalesce(F.col("offer") < F.col("label"), F.lit(False))).alias("better"),
                ),
                F.col("better"),
            )
            labels = merged.select("tweet_id", "label")
            frontier = merged.where("better").select("tweet_id", "label")
            if not n_better:
                break
    heads = _flat(labels).withColumnRenamed("tweet_id", "head")
    members = lookup_join(
        to_head.select("tweet_id", "head", F.col("hops"), F.col("path")),
        heads, "head", "tweet_id", "inner", n_nodes,
    )
    return members.select(
        "tweet_id",
        F.col("label_root.text").alias("root_id"),
        (F.col("label_depth") + F.col("hops")).alias("depth"),
        F.concat("label_path", "path").alias("path"),
    )


def thread_turns(tweets: DataFrame, order: str | None = None) -> DataFrame:
    """Every message of every conversation that has a brand reply, with its label.

    ``(conversation_id, depth, path)`` is the breadth-first order. The texts join on the unique
    message id once the labels are known.
    """
    nodes, n_nodes = cut_and_count(message_nodes(tweets, order))
    labels = label_messages(nodes, n_nodes)
    return nodes.drop("response_tweet_id", "in_response_to_tweet_id").join(labels, "tweet_id").select(
        F.concat(F.lit("conv_"), "root_id").alias("conversation_id"),
        F.col("root_id").alias("root_tweet_id"),
        "depth", "path", "tweet_id", "author_id", "inbound", "created_at", "text",
    )


def summarise_threads(turns: DataFrame) -> DataFrame:
    """One row per conversation with at least one brand reply, without the history.

    Only aggregates that combine before the shuffle are used, so one giant thread is no problem.
    """
    key = F.struct("depth", "path")
    outbound = ~F.col("inbound")
    later_customer = F.col("inbound") & (F.col("depth") > 0)
    resolved = later_customer & matches_any("lower(text)", RESOLUTION_PATTERNS)
    first = F.struct("author_id", "created_at", "text")
    per_thread = turns.groupBy("conversation_id", "root_tweet_id").agg(
        F.min_by(first, F.when(F.col("depth") == 0, key)).alias("root"),
        F.min_by(first, F.when(outbound, key)).alias("reply"),
        F.count("*").alias("turns"),
        F.count_if(outbound).alias("replies"),
        F.coalesce(F.bool_or(resolved), F.lit(False)).alias("resolution_available"),
    )
    return per_thread.where(F.col("replies") > 0).select(
        "conversation_id",
        "root_tweet_id",
        F.col("reply.author_id").alias("brand"),
        F.col("root.author_id").alias("customer_id"),
        F.col("root.created_at").alias("timestamp"),
        F.col("root.text").alias("customer_message"),
        F.col("reply.text").alias("brand_response"),
        "turns",
        "resolution_available",
    )


def turn_positions(turns: DataFrame) -> DataFrame:
    """The turns with their 1-based ``position`` in the conversation."""
    return number_rows(turns, [F.col("depth"), F.col("path")], "conversation_id")


def history_pages(turns: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Nested history in breadth-first order, at most ``page_turns`` turns to a row.

    A usual thread is one page. Paging keeps every array small while no turn is dropped.
    """
    page = F.floor((F.col("position") - 1) / page_turns).cast("int")
    turn = F.struct("tweet_id", "author_id", "inbound", "created_at", "text")
    return (
        turn_positions(turns)
        .groupBy("conversation_id", page.alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("position", turn.alias("turn")))).alias("turns"))
        .select(
            "conversation_id", "page",
            F.transform("turns", lambda t: t["turn"]).alias("conversation_history"),
        )
    )


def conversations(
    tweets: DataFrame, order: str | None = None, page_turns: int = PAGE_TURNS
) -> tuple[DataFrame, DataFrame]:
    """The records, one row per conversation whatever its length, and their histories in pages."""
    turns = cut_lineage(thread_turns(tweets, order))
    return summarise_threads(turns), history_pages(turns, page_turns)
