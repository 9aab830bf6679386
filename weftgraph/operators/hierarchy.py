"""Parent-child links of unknown depth as full hierarchies.

Leaves are peeled bottom-up: a leaf sends the size of its subtree to its parent and
is gone. So that long chains do not need as many rounds as they have nodes, each
round also takes nodes out of chains: a node with one child left, none of whose
neighbours is taken out as well, hands its parent and its size to that child. Every
round takes a share of all nodes away, whatever the shape of the trees, so the
rounds grow with the logarithm of their number. What stays are cycles, each of them
shrunk to one node that is its own parent.

The reverse order hands root, depth, path and state down and gives nodes of chains
the size of what is below them. A round's parents and children are among the nodes
taken away after it, which are fewer than a constant times those of the round.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.durable import cut, shared_dir

STAYS, PEELED, BRIDGED = 0, 1, 2
_NO_PATH = "array<string>"
_TOP = "node string, root string, depth int, path array<string>, n_desc bigint, state string"


def _one_parent(links: DataFrame) -> DataFrame:
    links = links.select("child", "parent").filter((F.col("child") != "") & (F.col("parent") != ""))
    return links.groupBy("child").agg(F.min("parent").alias("parent"))


def _below(with_path: bool, *parts: Column | str) -> Column:
    return F.concat(*parts) if with_path else F.lit(None).cast(_NO_PATH)


def _start(links: DataFrame) -> DataFrame:
    """node, parent (null at the top), steps up to it, own (nodes of the subtree that are gone, itself included), between (those taken out on the way up), via (their names), n_children."""
    up = links.select(F.col("child").alias("node"), "parent")
    down = links.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return up.join(down, "node", "full_outer").select(
        "node", "parent", F.lit(1).alias("steps"), one.alias("own"), none.alias("between"), F.array().cast(_NO_PATH).alias("via"), F.coalesce("n_children", none).alias("n_children"),
        F.lit(None).cast("string").alias("only"), none.alias("only_between"), F.lit(STAYS).alias("what"), F.lit(0).alias("round"),
    )


def _round(before: DataFrame, with_path: bool) -> DataFrame:
    """What becomes of the nodes that stayed: `what` they are after the round. Its number is a column, so that all rounds run the same compiled code."""
    # Nodes taken out in the round before hand what they had to the child they were left with.
    handed = before.filter(F.col("what") == BRIDGED).select(
        F.col("only").alias("node"), F.col("parent").alias("new_parent"), F.col("steps").alias("more_steps"), (F.col("own") + F.col("between")).alias("more"), (_below(with_path, "via", F.array("node"))).alias("above")
    )
    got = F.col("new_parent").isNotNull()
    live = before.filter(F.col("what") == STAYS).join(handed, "node", "left").select(
        "node", F.coalesce("new_parent", "parent").alias("parent"), (F.col("steps") + F.coalesce("more_steps", F.lit(0))).alias("steps"), "own",
        (F.col("between") + F.coalesce("more", F.lit(0))).alias("between"), F.when(got & F.lit(with_path), F.concat("above", "via")).otherwise(F.col("via")).alias("via"), "n_children", "round",
    )
    leaf = F.col("n_children") == 0
    sent = live.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.sum(F.when(leaf, F.col("own") + F.col("between")).otherwise(0)).alias("got"), F.count(F.when(~leaf, 1)).alias("left"),
        F.min(F.when(~leaf, F.struct(F.col("node").alias("c"), F.col("between").alias("b")))).alias("child"),
    )
    rank = lambda c: F.xxhash64(F.col("round"), c)
    lone = (F.col("left") == 1) & F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))
    bridged = lone & (rank(F.col("node")) < rank(F.col("parent"))) & (rank(F.col("node")) < rank(F.col("child.c")))
    return live.join(sent, "node", "left").select(
        "node", "parent", "steps", (F.col("own") + F.coalesce("got", F.lit(0))).alias("own"), "between", "via", F.coalesce("left", F.lit(0)).alias("n_children"), F.col("child.c").alias("only"),
        F.coalesce("child.b", F.lit(0)).alias("only_between"), F.when(leaf, PEELED).when(F.coalesce(bridged, F.lit(False)), BRIDGED).otherwise(STAYS).alias("what"), (F.col("round") + 1).alias("round"),
    )


def hierarchy(links: DataFrame, with_path: bool = True) -> DataFrame:
    """(node, root, depth, path, n_desc, state) of every node of links (child STRING, parent STRING).

    state: 'cycle' if going up from the node leads back to it, 'below_cycle' if it
    leads to such a node, else 'ok'; root is '', depth -1 and path null if not ok.
    path goes from the root to the node. n_desc counts the other nodes from which
    going up leads to the node.

    Repeated links count once; links with a null or empty end are no links; of
    several parents of a node the smallest counts. An empty table gives no rows.
    """
    now = cut(_start(_one_parent(links)))
    rounds: list[DataFrame] = []
    going = not now.isEmpty()
    while going:
        now = cut(_round(now, with_path))
        rounds.append(now)
        # A round may take nothing away, by chance of the ranks; the end is when only rings of one node stay.
        going = not now.filter(((F.col("what") == STAYS) & (F.col("parent").isNull() | (F.col("parent") != F.col("node")))) | (F.col("what") == BRIDGED)).isEmpty()
    # All that is known lies in one folder, a part for each round, so that plans stay small.
    null, spark, folder = F.lit(None).cast(_NO_PATH), links.sparkSession, f"{shared_dir(links.sparkSession)}/hierarchy-{uuid4().hex}"
    rings = now.filter(F.col("what") == STAYS)
    rings = rings.select("node", F.lit("").alias("root"), F.lit(-1).alias("depth"), null.alias("path"), (F.col("own") + F.col("between") - 1).alias("n_desc"), F.lit("cycle").alias("state"))
    rings.write.parquet(f"{folder}/part={len(rounds)}")
    for n in reversed(range(len(rounds))):
        known = spark.read.schema(_TOP).parquet(f"{folder}/part=*")
        _handed_down(rounds[n], known, with_path).write.parquet(f"{folder}/part={n}")
    return spark.read.schema(_TOP).parquet(f"{folder}/part=*")


def _handed_down(done: DataFrame, known: DataFrame, with_path: bool) -> DataFrame:
    """The nodes peeled and bridged in one round, from those that were gone later."""
    up = known.select(F.col("node").alias("parent"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("path").alias("p_path"), F.col("state").alias("p_state"))
    down = known.select(F.col("node").alias("only"), F.col("n_desc").alias("c_desc"), F.col("state").alias("c_state"))
    top, on_ring = F.col("parent").isNull(), F.coalesce(F.col("c_state") == "cycle", F.lit(False))
    ok = top | (F.col("p_state") == "ok")

    def told(df: DataFrame, n_desc: Column, ring: Column) -> DataFrame:
        return df.select(
            "node", F.when(top, F.col("node")).when(ok, F.col("p_root")).otherwise("").alias("root"), F.when(top, 0).when(ok, F.col("p_depth") + F.col("steps")).otherwise(-1).alias("depth"),
            F.when(top & F.lit(with_path), F.array("node")).when(ok, _below(with_path, "p_path", "via", F.array("node"))).alias("path"), n_desc.alias("n_desc"),
            F.when(ring, "cycle").when(ok, "ok").otherwise("below_cycle").alias("state"),
        )

    bridged = done.filter(F.col("what") == BRIDGED).join(up, "parent").join(down, "only")
    bridged = told(bridged, F.when(on_ring, F.col("c_desc")).otherwise(F.col("own") + F.col("only_between") + F.col("c_desc")), on_ring)
    more = bridged.select(F.col("node").alias("parent"), F.col("root").alias("p_root"), F.col("depth").alias("p_depth"), F.col("path").alias("p_path"), F.col("state").alias("p_state"))
    peeled = told(done.filter(F.col("what") == PEELED).join(up.unionByName(more), "parent", "left"), F.col("own") - 1, F.lit(False))
    return bridged.unionByName(peeled)


def _ways_to_cycles(nodes: DataFrame) -> DataFrame:
    """(node, way) of nodes (child, parent), all of them on or below a cycle: the nodes on the way up, the nearest first, each once, by doubling."""
    # A way that meets a node again has met all that there are.
    st = cut(nodes.select("child", F.col("parent").alias("far"), F.array("parent").alias("way")))
    while not st.filter(F.col("far").isNotNull()).isEmpty():
        up = st.select(F.col("child").alias("far"), F.col("far").alias("far2"), F.col("way").alias("way2"))
        both = st.join(up, "far", "left").select("child", "far2", F.size("way").alias("n"), F.size("way2").alias("n2"), F.array_distinct(F.concat("way", F.coalesce("way2", F.array().cast("array<string>")))).alias("way"))
        # far2 null: the further way has met all itself.
        st = cut(both.select("child", F.when(F.size("way") == F.col("n") + F.col("n2"), F.col("far2")).alias("far"), "way"))
    return st.select(F.col("child").alias("node"), "way")


def descendants(tree: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(node, descendant, distance): every node's descendant list, a row for each, from the paths of hierarchy().

    With the links of the tree, nodes on and below cycles have theirs, too, so that
    each node has n_desc rows; distance is the least number of steps. Without, only
    nodes whose state is 'ok' have rows.
    """
    if links is not None:
        tree = cut(tree.select("node", "depth", "path", "state"))
    p = tree.filter(F.col("path").isNotNull()).select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("pos", "node"))
    out = p.filter(F.col("pos") < F.col("depth")).select("node", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    if links is None:
        return out
    lost = _one_parent(links).join(tree.filter(F.col("state") != "ok").select(F.col("node").alias("child")), "child", "left_semi")
    ways = _ways_to_cycles(lost).select(F.col("node").alias("descendant"), F.posexplode("way").alias("pos", "node"))
    return out.unionByName(ways.filter(F.col("node") != F.col("descendant")).select("node", "descendant", (F.col("pos") + 1).alias("distance")))
