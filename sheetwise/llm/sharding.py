"""Sharding by balanced label propagation.

Documents with equal texts are one node; nodes are linked through the lines that different texts share (a line with
df nodes weighs 1 / df, so no pairs are made of what shares a line). Each round joins labels to lines, counts them and
joins the counts back: a node wants the shard that most of its links lead to. Of the nodes that want to go from shard i
to j, a quota goes: as many as want to come back, plus a part of the room below the capacity. The labels then order the
documents - shard, line community, node, id - and this order is cut into equal parts, so that counts differ by one at
most (law "rows"); only what lies across a cut, or is larger than a shard, is parted.

Null texts count as empty and have size 1. Rows are told apart by their place in the order, so equal or null ids do no
harm. Without shared lines the labels are hashes. Lines of under MIN_LINE code points make no link (a parameter). Columns
but id and text aren't read, so names can't clash; an empty table gives an empty one; texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rank import global_rank
from ._store import cut, stored

SHARDS, ROUNDS, SLACK = 8, 4, 0.02
#: Code points, without blanks at the ends, from which on a shared line links texts.
MIN_LINE = 16


def _links(df: DataFrame, nodes: DataFrame, min_line: int) -> DataFrame:
    """(node, line): the lines of each node that another node has, too."""
    line = F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")
    lines = df.select("h1", "h2", line).filter(F.length(F.trim("line")) >= min_line).select("h1", "h2", F.xxhash64("line").alias("line"))
    shared = lines.groupBy("line").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo <> hi").select("line")
    return stored(lines.join(shared, "line").distinct().join(nodes.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "line"))


def _round(links: DataFrame, labels: DataFrame, shards: int, capacity: float, step: int) -> DataFrame:
    """labels (node, docs, home, label) after one round."""
    at = links.join(labels.select("node", "label"), "node")
    votes = stored(at.groupBy("line").agg(F.count("*").alias("df"), *[F.count_if(F.col("label") == i).alias(f"v{i}") for i in range(shards)]))  # written out, so that the join below may split a line that very many nodes share
    # a node's own vote counts for no shard, so it is taken off its own
    pull = at.join(votes, "line").groupBy("node").agg(*[F.sum((F.col(f"v{i}") - (F.col("label") == i).cast("int")) / F.col("df")).alias(f"p{i}") for i in range(shards)])
    stay = F.element_at(F.array(*[F.coalesce(F.col(f"p{i}"), F.lit(0.0)) for i in range(shards)]), F.col("label") + 1)
    best = F.greatest(*[F.struct(F.col(f"p{i}").alias("pull"), (-F.abs(F.col("label") - i)).alias("near"), F.lit(i).alias("to")) for i in range(shards)])
    wish = cut(labels.join(pull, "node", "left").select("node", "docs", "home", "label", F.when((best["pull"] > stay) & F.col("p0").isNotNull(), best["to"]).otherwise(F.col("label")).alias("to")))
    flows = {(r.label, r.to): r.n for r in wish.groupBy("label", "to").agg(F.sum("docs").alias("n")).collect()}  # shards x shards numbers
    sizes = [sum(n for (i, _), n in flows.items() if i == s) for s in range(shards)]
    go = {(i, j): min(n, flows.get((j, i), 0)) for (i, j), n in flows.items() if i != j}
    for j in range(shards):
        room = max(0.0, capacity - sizes[j])
        more = {k: flows[k] - go[k] for k in go if k[1] == j}
        part = min(1.0, room / sum(more.values())) if sum(more.values()) else 0.0
        for k, n in more.items():
            go[k] += n * part
    quota = F.coalesce(*[F.when((F.col("label") == i) & (F.col("to") == j), F.lit(n / flows[i, j])) for (i, j), n in go.items()], F.lit(0.0)) if go else F.lit(0.0)
    luck = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(1 << 20)) / float(1 << 20)
    return cut(wish.select("node", "docs", "home", F.when(luck < quota, F.col("to")).otherwise(F.col("label")).alias("label")))


def shard(df: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, min_line: int = MIN_LINE) -> DataFrame:
    """One row per row of df: id, size (UTF-8 bytes + 1), text_crc32, law ("rows"), shard, slot (its place in the shard,
    from 0), grown_shard (null under this law)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(id).cast("long").alias("id"), whole.alias("text")).select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"))
    rows = stored(docs.select("id", "h1", "h2", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("text_crc32")))
    total = rows.count()
    nodes = cut(rows.groupBy("h1", "h2").agg(F.count("*").alias("docs")).withColumn("node", F.monotonically_increasing_id()))
    links = _links(docs, nodes, min_line)
    home = links.groupBy("node").agg(F.min("line").alias("home"))
    labels = nodes.select("node", "docs", "h1").join(home, "node", "left").select("node", "docs", F.coalesce("home", "h1").alias("home"))
    labels = cut(labels.select("node", "docs", "home", F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int").alias("label")))
    for step in range(rounds):
        labels = _round(links, labels, shards, (1 + SLACK) * total / shards, step)
    placed = rows.join(nodes.select("node", "h1", "h2").join(labels.select("node", "label", "home"), "node"), ["h1", "h2"])
    ranked = global_rank(placed.select("id", "size", "text_crc32", "label", "home", "node"), F.col("label"), F.col("home"), F.col("node"), F.col("id"))
    out = ranked.withColumn("shard", F.expr(f"cast(rank * {shards}L div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")  # the least rank of a shard
    return out.select(F.col("id").alias(id), "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
