"""Sharding by balanced label propagation, in DataFrame operations only.

Law `bytes`: shards hold nearly equal sizes, and linked documents (equal texts) share a shard where it has room.

1. Graph.  Every group of equal texts with two or more members is a hub, linked to its members.  Each member is a node of
   its own; the members of a group of more than SMALL_GROUP are dealt by hash into nodes that hold a bounded share of all
   bytes and of all rows, so no node is large and no hub has more than a bounded number of nodes.
2. Propagation.  Nodes begin in shards by hash.  Round by round, a node moves to the shard that holds most of the weight
   of its hubs and still has room.  Moves into a shard are admitted by hash bucket up to its quota: groups as a whole,
   nodes of large groups one by one.
3. Repair and filling.  What lies in a shard beyond an equal share is released.  It and the documents without links are laid
   on a line in hash order, tier by tier from heavy to light, and the line is cut in proportion to the room that is left
   in each shard; the last tier is light, so the shards end nearly equal.

Prefix sums use hash buckets of bounded size: sums inside a bucket, then over the bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, forget, heavy_keys, lookup

#: Rows of one bucket of a prefix sum.
BUCKET_ROWS = 20_000
ADMISSION_BUCKETS = 1024
#: Members up to which each member of a group is a node; larger groups have nodes of at most these shares of all rows and bytes.
SMALL_GROUP, NODE_ROWS, NODE_BYTES = 64, 1 / 1024, 1 / 512
#: Upper weights of the tiers, as shares of one shard; the first holds all that is heavier than the second, and so on.
TIERS = (1 / 16, 1 / 256, 1 / 4096)


def _bucketed_prefix(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, rows: int, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before this one, inside each combination of `keys`."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    b = df.withColumn("__v", value).withColumn("__b", F.pmod(F.xxhash64(F.lit("bucket"), *order), F.lit(buckets)))
    totals = b.groupBy(*keys, "__b").agg(F.sum("__v").alias("__t"))
    before = totals.select(*keys, "__b", (F.sum("__t").over(Window.partitionBy(*keys).orderBy("__b")) - F.col("__t")).alias("__before"))
    inside = F.sum("__v").over(Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__v")
    return b.withColumn("__inside", inside).join(before, [*keys, "__b"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__v", "__b", "__before", "__inside")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, quota: float, rounds: int = 8) -> DataFrame:
    """nodes (node, w, shard), links (node, hub) -> (node, w, shard) after balanced label propagation.

    Two nodes are linked if they share a hub.  A node weighs on its own shard as well, and ties go by a hash of hub and
    shard, so that the nodes of one hub want the same.  In even rounds a node moves where there is room, up to `quota`; in
    odd rounds two shards swap what wants to go each way, up to the lesser of both weights, so a full shard does not stand
    in the way (their sizes then differ by less than one admission bucket).  From the third round on half of the nodes rest,
    so that nodes of several hubs do not swap for ever.  Nodes without links keep their shard; a shard that begins above
    its quota only loses or swaps.
    """
    state = nodes
    hot = cut(heavy_keys(links, "hub", links.count()))
    buckets = min(ADMISSION_BUCKETS, max(8, (1 << 20) // shards**2))
    salt = lambda key, k: F.pmod(F.xxhash64(key, F.lit(k)), F.lit(buckets))
    idle = 0
    for k in range(rounds):
        load = state.groupBy("shard").agg(F.sum("w").alias("load"))
        room = nodes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(load), "shard", "left").select(F.col("shard").alias("to"), (F.lit(quota) - F.coalesce("load", F.lit(0))).alias("room"))
        ends = links.join(state, "node")
        held = ends.groupBy("hub", "shard").agg(F.sum("w").alias("held"))
        held = held.groupBy("hub").agg(F.collect_list(F.struct("shard", "held")).alias("held"), F.sum("held").alias("whole"))  # at most one entry a shard
        pull = lookup(ends, "hub", held, hot, "node").select("node", "w", F.col("shard").alias("mine"), "hub", "whole", F.inline("held")).withColumnRenamed("shard", "to")
        pull = pull.groupBy("node", "w", "mine", "to").agg(F.sum("held").alias("pull"), F.sum(F.pmod(F.xxhash64("hub", "to"), F.lit(1 << 20))).alias("tie"), F.max("whole").alias("whole"), F.min("hub").alias("hub"))
        swap = k % 2 == 1
        if not swap:
            pull = pull.join(F.broadcast(room), "to").where((F.col("to") == F.col("mine")) | (F.col("room") >= F.col("w")))
        wish = pull.groupBy("node", "w", "mine").agg(F.max(F.struct("pull", "tie", "to")).alias("top"), F.max("whole").alias("whole"), F.min("hub").alias("hub"))
        wish = wish.select("node", "w", "whole", "hub", "mine", F.col("top.to").alias("to")).where("to <> mine")
        if k > 1:
            wish = wish.where(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0)
        wish = wish.withColumn("bucket", F.when(F.col("whole") > quota / 256, buckets + salt("node", k)).otherwise(salt("hub", k)))
        wish = cut(wish.select("node", "w", "mine", "to", "bucket"))
        flows = wish.groupBy("mine", "to").agg(F.sum("w").alias("flow"))
        back = flows.select(F.col("to").alias("mine"), F.col("mine").alias("to"), F.col("flow").alias("back"))
        way = ["mine", "to"] if swap else ["to"]
        limit = flows.join(back, way).select(*way, F.least("flow", "back").alias("limit")) if swap else room.withColumnRenamed("room", "limit")
        sums = wish.groupBy(*way, "bucket").agg(F.sum("w").alias("s"))  # `buckets` bounds the rows
        upto = sums.withColumn("upto", F.sum("s").over(Window.partitionBy(*way).orderBy("bucket")))
        admitted = upto.join(F.broadcast(limit), way).where("upto <= limit").select(*way, "bucket")
        moves = wish.join(F.broadcast(admitted), [*way, "bucket"]).select("node", F.col("to").alias("goal"))
        new = cut(state.join(moves, "node", "left").select("node", "w", F.coalesce("goal", "shard").alias("shard"), F.col("goal").isNotNull().alias("moved")))
        idle = 0 if new.where("moved").limit(1).count() else idle + 1
        forget(wish)
        state = new.drop("moved")
        if idle == 2:
            break
    return state


def cut_edges(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: links, the pairs of nodes that share a hub (once a hub), and cut_links, those whose ends lie in two shards."""
    ends = links.join(nodes, "node").groupBy("hub", "shard").agg(F.count("*").cast("double").alias("n"))
    hubs = ends.groupBy("hub").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return hubs.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("all")) / 2), F.lit(0.0)).alias("links"), F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0.0)).alias("cut_links"))


def fill(nodes: DataFrame, load: dict[int, float], shards: int, target: float, rows: int) -> DataFrame:
    """nodes (node, w) -> (node, w, shard): a line of nodes in hash order, cut in proportion to each shard's room."""
    total = float(nodes.agg(F.sum("w")).first()[0] or 0)
    room = [max(0.0, target - load.get(s, 0.0)) for s in range(shards)]
    if not sum(room):
        room = [1.0] * shards
    ends, at = [], 0.0
    for r in room:
        at += r * total / sum(room)
        ends.append(at)
    line = _bucketed_prefix(nodes.withColumn("__one", F.lit(0)), ["__one"], [F.xxhash64("node", F.lit(11)), F.col("node")], F.col("w"), rows, "begin")
    middle = F.col("begin") + F.col("w") / 2
    usable = [s for s in range(shards) if room[s]]
    shard = F.lit(usable[-1])
    for s in reversed(usable[:-1]):
        shard = F.when(middle < ends[s], s).otherwise(shard)
    return line.select("node", "w", shard.cast("int").alias("shard"))


def graph(docs: DataFrame) -> DataFrame:
    """Each document as (row, doc_id, size, text_crc32, hub, node); hub is null if no other document has the text."""
    text = F.col("text")
    light = cut(
        docs.select(
            "doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("__n"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.when(text.isNotNull(), F.xxhash64(text)).alias("__h"),
        ).select("doc_id", (F.col("__n") + 1).alias("size"), "text_crc32", F.monotonically_increasing_id().alias("row"), F.when(F.col("__h").isNotNull(), F.xxhash64("__h", "text_crc32", "__n")).alias("gid"))
    )
    whole = light.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    rows, total = whole["n"], float(whole["bytes"] or 0)
    texts = light.where("gid IS NOT NULL")
    groups = texts.groupBy("gid").agg(F.sum("size").alias("bytes"), F.count("*").alias("members")).where("members > 1")
    pieces = F.greatest(F.lit(SMALL_GROUP), F.ceil(F.col("bytes") / max(1.0, total * NODE_BYTES)), F.ceil(F.col("members") / max(1.0, rows * NODE_ROWS)))
    linked = groups.select("gid", F.when(F.col("members") > SMALL_GROUP, pieces).otherwise(0).cast("long").alias("pieces"))
    found = lookup(texts, "gid", linked, heavy_keys(texts, "gid", rows), "row").unionByName(light.where("gid IS NULL").withColumn("pieces", F.lit(None).cast("long")))
    own = F.xxhash64(F.lit("own"), F.col("row"))
    node = F.when(F.col("pieces") > 0, F.xxhash64("gid", F.pmod(F.xxhash64("row"), F.col("pieces")))).otherwise(own)
    placed = cut(found.select("row", "doc_id", "size", "text_crc32", F.when(F.col("pieces").isNotNull(), F.col("gid")).alias("hub"), node.alias("node")))
    forget(light)
    return placed


def linked_nodes(placed: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """nodes (node, w, shard) of the documents with links, in shards by hash, and their links (node, hub)."""
    nodes = cut(placed.where("hub IS NOT NULL").groupBy("node").agg(F.sum("size").alias("w"), F.max("hub").alias("hub")))
    return nodes.select("node", "w", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(shards)).cast("int").alias("shard")), nodes.select("node", "hub")


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1.  Null texts are documents of size 1 linked to nothing; empty texts are equal
    texts.  Repeated rows, with or without an id, count each.  A text larger than a shard makes its shard larger, the
    others stay even.  Ties are broken by hashes.  Empty table: no rows.  Columns of `docs` other than doc_id and text take
    no part.
    """
    placed = graph(docs)
    whole = placed.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    rows, target = whole["n"], float(whole["bytes"] or 0) / shards
    nodes, links = linked_nodes(placed, shards)
    settled = cut(propagate(nodes, links, shards, target, rounds))
    kept = _bucketed_prefix(settled, ["shard"], [F.xxhash64("node", F.lit(3)), F.col("node")], F.col("w"), rows, "begin").withColumn("over", F.col("begin") + F.col("w") > target)
    kept = cut(kept.select("node", "w", "shard", "over"))
    fixed = kept.where("NOT over").select("node", "w", "shard")
    loads = {r["shard"]: float(r["s"]) for r in fixed.groupBy("shard").agg(F.sum("w").alias("s")).collect()}
    free = cut(placed.where("hub IS NULL").select("node", F.col("size").alias("w")).unionByName(kept.where("over").select("node", "w")))
    done = [fixed]
    above: float | None = None
    for low in (*[target * t for t in TIERS], 0.0):
        tier = free.where(F.col("w") > low) if above is None else free.where((F.col("w") > low) & (F.col("w") <= above))
        above = low
        filled = cut(fill(tier, loads, shards, target, rows))
        for r in filled.groupBy("shard").agg(F.sum("w").alias("s")).collect():
            loads[r["shard"]] = loads.get(r["shard"], 0.0) + float(r["s"])
        done.append(filled)
    forget(free)
    homes = done[0].select("node", "shard")
    for d in done[1:]:
        homes = homes.unionByName(d.select("node", "shard"))
    out = placed.join(homes, "node").select("row", "doc_id", "size", "text_crc32", "shard")
    out = _bucketed_prefix(out, ["shard"], [F.col("row")], F.lit(1).cast("long"), rows, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
