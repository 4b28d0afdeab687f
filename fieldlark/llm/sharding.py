"""Sharding by balanced label propagation: documents of equal text move towards the shard that holds most of them.

Every document starts in the shard of its key's hash. A group of equal texts is kept as cells (group, shard,
documents), never as pairs. In a round each cell wants to move to the fullest shard of its group that has room
or that others leave (to one of as many as the group fills); as many documents go from one shard to another as come back or as the target's quota still
takes, in a fixed order, until no cell moves. Documents without a twin then fill the
shards up, so that the counts of the shards differ by one at most (law ``rows``).

Defined results: a null text is empty; its size is 8. Groups larger than a shard fill whole shards one after
another. Keys are of any type that has an order; repeated keys are rows of their own, and of rows with one key and
one text any may take any of their slots. No rows: no rows. Other columns are not kept. If cells still move after
``rounds``, a warning says how many groups are cut.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.llm.common import joined_groups, ordinal, release, stash

SHARDS = 24
GROUP = ["link", "text_crc32", "size"]


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = 60) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = stash(docs.select(F.col(key).alias("id"), (F.octet_length(whole) + 8).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), F.xxhash64(whole).alias("link")))
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    buckets = max(1, int(total**0.5))  # each holds as many rows as there are buckets, about
    spread = lambda *c: F.pmod(F.xxhash64(F.lit("bucket"), *c), F.lit(buckets)).cast("int")
    order = ["id", *GROUP]

    groups = stash(rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1"))
    linked = stash(joined_groups(rows, groups, GROUP))
    cells = stash(linked.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).groupBy(*GROUP, "shard").agg(F.count("*").alias("held")))
    left = set(range(shards))  # shards that documents have left in the last round
    for k in range(rounds):
        tie = F.xxhash64("link", "shard")
        ranked = cells.withColumn("_own", F.struct(F.col("held"), tie.alias("tie"), F.col("shard").alias("shard")))
        ranked = ranked.withColumn("_all", F.collect_list("_own").over(Window.partitionBy(*GROUP)))  # at most one cell a shard
        load = dict(cells.groupBy("shard").agg(F.sum("held")).collect())  # one row a shard
        room = [quota[s] - load.get(s, 0) for s in range(shards)]
        takes = F.array(*(F.lit(room[s] > 0 or s in left) for s in range(shards)))
        better = F.sort_array(F.filter("_all", lambda x: (x > F.col("_own")) & F.get(takes, x["shard"])), asc=False)
        fills = F.ceil(F.aggregate("_all", F.lit(0).cast("long"), lambda n, x: n + x["held"]) / max(1, quota[-1]))  # shards that the group needs
        best = F.get(better, F.pmod(F.xxhash64("link", "shard", F.lit(k)), F.greatest(F.least(F.size(better), fills), F.lit(1))).cast("int"))
        wishes = ranked.withColumn("target", best["shard"]).where("target IS NOT NULL").select(*GROUP, "shard", "held", "target", spread("link").alias("_bucket"))
        wanted = {(a, b): n for a, b, n in wishes.groupBy("shard", "target").agg(F.sum("held")).collect()}  # one row a pair of shards
        allowed = _flows(wanted, room)
        left = {a for (a, _), n in allowed.items() if n}
        if not left:
            break
        flow = F.get(F.array(*(F.lit(allowed.get((a, b), 0)) for a in range(shards) for b in range(shards))), F.col("shard") * shards + F.col("target"))
        placed = ordinal(wishes, ["shard", "target"], GROUP, "before", "_bucket", "held")
        moves = placed.select(*GROUP, "shard", "target", F.least(F.col("held"), F.greatest(flow - F.col("before"), F.lit(0))).alias("n")).where("n > 0")
        moves = stash(moves)
        changed = cells.unionByName(moves.select(*GROUP, "shard", (-F.col("n")).alias("held"))).unionByName(moves.select(*GROUP, F.col("target").alias("shard"), F.col("n").alias("held")))
        before, cells = cells, stash(changed.groupBy(*GROUP, "shard").agg(F.sum("held").alias("held")).where("held > 0"))
        release(before, moves)
    else:
        cut = cells.groupBy(*GROUP).count().where("count > 1").count()
        warnings.warn(f"cells still move after {rounds} rounds; {cut} groups lie in several shards", stacklevel=2)

    # The documents of a group in order take its cells' places.
    upto = F.sum("held").over(Window.partitionBy(*GROUP).orderBy("shard"))
    dealt = cells.withColumn("upto", upto).groupBy(*GROUP).agg(F.max("upto").alias("n"), F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("cells"))
    member = ordinal(linked.drop("n").withColumn("_bucket", spread("id", "link")), GROUP, ["id"], "member", "_bucket")
    chosen = joined_groups(member, stash(dealt), GROUP).select("id", *GROUP, F.get(F.filter("cells", lambda c: F.col("member") < c["upto"]), F.lit(0))["shard"].alias("shard"))
    seated = stash(ordinal(chosen.withColumn("_bucket", spread("id", "link")), ["shard"], order, "slot", "_bucket"))
    fits = F.col("slot") < F.get(F.array(*map(F.lit, quota)), F.col("shard"))
    held = dict(seated.where(fits).groupBy("shard").count().collect())  # one row a shard
    # A group's first row stands for it where the group is one row, so that no hot group is looked up.
    single = rows.groupBy(*GROUP).agg(F.count("*").alias("n"), F.first("id").alias("id")).where("n = 1")
    pool = single.select("id", *GROUP).unionByName(seated.where(~fits).select("id", *GROUP)).withColumn("_all", F.lit(0)).withColumn("_bucket", spread("id", "link"))
    ends, begins, at = [], [], 0
    for s in range(shards):
        begins.append(at - held.get(s, 0))
        at += quota[s] - held.get(s, 0)
        ends.append(at)
    queued = ordinal(stash(pool), ["_all"], order, "queue", "_bucket")
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("queue")))
    filled = queued.withColumn("shard", shard).withColumn("slot", F.col("queue") - F.get(F.array(*map(F.lit, begins)), F.col("shard")))
    columns = ["id", "size", "text_crc32", "shard", "slot"]
    out = seated.where(fits).select(*columns).unionByName(filled.select(*columns))
    return out.select(F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _flows(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many documents may go from one shard to another: as many as come back, and then into what room there is."""
    out = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    room = [max(0, r) for r in room]
    for a, b in sorted(wanted, key=lambda k: (-wanted[k], k)):
        more = min(wanted[a, b] - out[a, b], room[b])
        out[a, b] += more
        room[b] -= more
    return out
