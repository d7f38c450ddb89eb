"""Resolving redirect chains to records.

Chains are followed by pointer doubling instead of one join a hop: after round r
a key knows the next 2**r keys of its chain, so twenty hops cost five joins. What lies beyond
the last hop that counts is cut off, so a row stays small however long its chain is.

Rules: a target that is a record ends the chain, exactly or by its loose key
(of records with one loose key the lexicographically least); the part after
``#`` is cut from every target but the first; an alias missing from the table is
tried once by its loose key (the first record or alias seen with it); a key that leads
nowhere is returned as it is and then reported missing. Of repeated alias keys the last
target counts, yet every row gets a ledger row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.stage import release, staged

#: Fixed value: the most hops of a chain.
MOST_HOPS = 20


def alias_edges(aliases: DataFrame, records: DataFrame) -> DataFrame:
    """(node, next, done): one hop for every alias key.

    aliases: key, key_loose, cut (the target without its fragment), cut_loose, ord; records: key, loose.
    """
    last = aliases.groupBy("key").agg(F.max_by(F.struct("cut", "cut_loose"), "ord").alias("t")).select("key", F.col("t.cut").alias("name"), F.col("t.cut_loose").alias("loose"))
    hop = land(last, aliases, records)
    return hop.select(F.col("key").alias("node"), F.col("spot").alias("next"), F.col("is_record").alias("done"))


def land(names: DataFrame, aliases: DataFrame, records: DataFrame) -> DataFrame:
    """names (name, loose, ...) with ``spot``, the key each name means, and ``is_record``.

    In turn: a record of that name, a record of that loose key, an alias of that name, the first alias of that loose key.
    """
    exact = records.select(F.col("key").alias("name"), F.lit(True).alias("__r")).distinct()
    near = records.groupBy("loose").agg(F.min("key").alias("__near"))
    known = aliases.select(F.col("key").alias("name"), F.lit(True).alias("__a")).distinct()
    folded = aliases.groupBy(F.col("key_loose").alias("loose")).agg(F.min_by("key", "ord").alias("__fold"))
    rows = names.join(exact, "name", "left").join(near, "loose", "left").join(known, "name", "left").join(folded, "loose", "left")
    hit = F.when(F.col("__r"), F.col("name")).otherwise(F.col("__near"))
    spot = F.coalesce(hit, F.when(F.col("__a"), F.col("name")), F.col("__fold"), F.col("name"))
    return rows.withColumns({"spot": spot, "is_record": hit.isNotNull()}).drop("__r", "__near", "__a", "__fold")


def resolve(edges: DataFrame, starts: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """(start, resolved, status, reason) for the distinct starts: ok, missing, cycle or too_long.

    edges: node, next, done (next is a record). A chain may take ``most`` hops to a record and must reach a dead end, or
    a key for the second time, in fewer; else it is too long. A start that is no node is missing. The reason names
    the keys of a cycle up to the repeated one, and of a chain that is too long the first ``most`` ones.
    """
    keys = edges.select(F.col("node").alias("next"), F.lit(True).alias("goes_on")).distinct()
    first = edges.join(keys, "next", "left").select("node", F.array("next").alias("path"), "done", (~F.col("done") & F.col("goes_on").isNotNull()).alias("open"))
    jump, reach = staged(first), 1
    while reach <= most and not (going := jump.where("open")).isEmpty():
        ahead = jump.select(F.col("node").alias("to"), F.col("path").alias("path2"), F.col("done").alias("done2"), F.col("open").alias("open2"))
        path = F.slice(F.concat("path", "path2"), 1, most + 1)
        moved = going.withColumn("to", F.element_at("path", -1)).join(ahead, "to").select("node", path.alias("path"), F.col("done2").alias("done"), F.col("open2").alias("open"))
        jump, before = staged(jump.where("NOT open").unionByName(moved)), jump
        release(before)
        reach *= 2
    hops, last = F.size("path"), F.element_at("path", -1)
    seen = F.slice(F.concat(F.array("node"), F.col("path")), 1, most)
    # where a key comes for the second time among the first ``most``: the chain up to there
    again = F.filter(F.sequence(F.lit(2), F.size(seen)), lambda i: F.array_position(seen, F.element_at(seen, i)) < i)
    loop = F.when(F.size(seen) > 1, F.get(again, F.lit(0)))
    over = F.col("open") | (hops > most) | (~F.col("done") & (hops >= most))
    status = F.when(over & loop.isNotNull(), "cycle").when(over, "too_long").when(F.col("done"), "ok").otherwise("missing")
    reason = F.when(over & loop.isNotNull(), F.concat(F.lit("cycle:"), F.array_join(F.slice(seen, F.lit(1), loop), "->"))).when(over, F.concat(F.lit("too_long:"), F.array_join(seen, "->")))
    found = jump.select(F.col("node").alias("start"), last.alias("end"), status.alias("status"), reason.alias("reason"))
    rows = starts.select("start").distinct().join(found, "start", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    return rows.select("start", F.when(F.col("status").isin("ok", "missing"), F.coalesce("end", "start")).alias("resolved"), "status", "reason")


def ledger_status(status):
    """Ledger word of a resolution."""
    return F.when(status == "ok", "alias_mapped").when(status == "cycle", "alias_cycle").otherwise("alias_unresolved")
