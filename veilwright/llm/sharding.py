"""Shards by balanced label propagation.

Documents with equal texts are linked. Each starts on the shard its id hashes to. In a round, every group of linked documents
looks at where its members are and names the shard that holds most of them; members elsewhere ask to move there. A shard
accepts whole moves, in an order by hash, as long as the linked rows it then holds stay within its quota; what was refused
turns to shards with room in the next round. Documents without links have no wish. A last step evens the counts out:
shards above their quota hand over surplus rows, unlinked ones first, to shards below it.

The law is ``rows``: counts at most one apart. A group larger than a quota is cut into blocks of that size first; full blocks
get a shard each, where nothing else starts. Rounds go on until no group is split or nothing moves any more; the groups that
are left are laid one after the other into the room of the shards, so each is split into few parts. Texts are reduced to hashes before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .common import draw_of, running


@dataclass(frozen=True)
class Sharding:
    """After ``rounds`` rounds, the first one that moves nothing is the last."""

    shards: int = 16
    rounds: int = 6


def _quota(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _lookup(values: list[int], key):
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (key + 1).cast("int")).cast("long")


def _counts(df: DataFrame, shards: int, where: str = "true") -> list[int]:
    got = {r[0]: r[1] for r in df.where(where).groupBy("shard").count().collect()}
    return [got.get(i, 0) for i in range(shards)]


def shard(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (NULL), text_key.

    A NULL text is an empty one; NULL and repeated ids are placed like any other row; an empty table gives an empty
    result. Only doc_id and text are read. The driver sees row counts by shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_key")), "rows")
    total = rows.count()
    quota = _quota(total, p.shards)
    block = max(1, total // p.shards)

    sizes = rows.groupBy("text_key", "text_crc32", "size").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    keys = ["text_key", "text_crc32", "size"]
    sizes = stage(sizes.select(*[F.col(k).alias(f"_{k}") for k in keys], "members"), "groups")
    joined = rows.join(sizes, [F.col(k) == F.col(f"_{k}") for k in keys], "left").drop(*[f"_{k}" for k in keys])
    draw = draw_of(F.col("doc_id"), F.col("text_key"))
    alone = joined.where("members is null").withColumn("part", F.lit(None).cast("long"))
    some = joined.where(F.col("members") <= block).withColumn("part", F.lit(0).cast("long"))
    # A group beyond a quota is numbered and cut into blocks that fill a shard each.
    large = running(joined.where(F.col("members") > block), keys, draw, [draw, F.col("doc_id")], F.lit(1), "rank") \
        .withColumn("part", F.floor(F.col("rank") / block)).drop("rank")
    full, filled = F.lit(None).cast("int"), 0
    for g in sizes.where(F.col("members") > block).orderBy(F.desc("members"), *[f"_{k}" for k in keys]).collect():
        mine = (F.col("members") > block) & (F.col("part") < g.members // block)
        for k in keys:
            mine = mine & (F.col(k) == F.lit(g[f"_{k}"]))
        full = F.when(mine, F.pmod(F.lit(filled) + F.col("part"), F.lit(p.shards)).cast("int")).otherwise(full)
        filled += g.members // block
    free = list(range(filled, p.shards)) or list(range(p.shards))
    start = F.coalesce(full, _lookup(free, F.pmod(F.xxhash64("doc_id", "text_key", F.lit(1)), F.lit(len(free)))).cast("int"))
    state = stage(alone.unionByName(some).unionByName(large).select(
        "doc_id", *keys, F.when(F.col("part").isNotNull(), F.xxhash64("text_key", "part")).alias("group"),
        start.alias("shard")), "state")

    linked = state.where("group is not null").groupBy("group", "shard").agg(F.count(F.lit(1)).alias("held"))
    wishes = stage(linked, "labels")
    for turn in count():
        wishes, moved = _round(wishes, quota, turn, p)
        if moved is None or (not moved and turn >= p.rounds - 1):
            break
    placed = stage(_settle(state, wishes, quota, draw, p).select("doc_id", *keys, "group", "shard"), "placed")
    even = _even_out(placed, quota, p)
    slots = running(even, ["shard"], draw_of(F.col("doc_id"), F.col("text_key"), F.lit(2)),
                    [F.col("doc_id"), F.col("text_key")], F.lit(1), "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                        "slot", F.lit(None).cast("int").alias("grown_shard"), "text_key")


def _lead(members, group, quota: list[int]):
    """A place in [0, 1): large groups come first, the many small ones in an order by hash."""
    share = F.least(F.lit(1.0), members / max(1, max(quota)))
    return F.when(share > 0.125, (1 - share) / 2).otherwise(0.5 + draw_of(group) / 2)


def _settle(state: DataFrame, labels: DataFrame, quota: list[int], draw, p: Sharding) -> DataFrame:
    """Rows at the homes of their groups. Groups without one are laid end to end into the room that is left, widest first."""
    whole = labels.groupBy("group").agg(F.count(F.lit(1)).alias("places"), F.sum("held").alias("members"),
                                        F.first("shard").alias("shard"))
    homes = stage(whole.where("places = 1"), "homes")
    lead = _lead(F.col("members"), F.col("group"), quota)
    refused = stage(running(whole.where("places > 1"), [], lead, [lead, F.col("group")], F.col("members"), "ahead").select(
        F.col("group").alias("_split"), "ahead"), "refused")
    home = homes.select(F.col("group").alias("_group"), F.col("shard").alias("_home"))
    placed = state.join(home, F.col("group") == F.col("_group"), "left").withColumn("shard", F.coalesce("_home", "shard"))
    if not refused.limit(1).count():
        return placed
    fixed = {r[0]: r[1] for r in homes.groupBy("shard").agg(F.sum("members")).collect()}
    room = {i: max(0, quota[i] - fixed.get(i, 0)) for i in range(p.shards)}
    order = sorted(room, key=lambda i: (-room[i], i))
    at = F.col("ahead") + F.col("rank")
    target = F.lit(order[-1])
    for k in range(p.shards - 2, -1, -1):
        target = F.when(at < sum(room[i] for i in order[:k + 1]), F.lit(order[k])).otherwise(target)
    same = F.col("group") == F.col("_split")
    cut = running(state.join(refused, same), ["group"], draw, [draw, F.col("doc_id")], F.lit(1), "rank")
    columns = state.columns
    return placed.join(refused, same, "left_anti").select(columns).unionByName(
        cut.withColumn("shard", target.cast("int")).select(columns))


def _round(labels: DataFrame, quota: list[int], turn: int, p: Sharding) -> tuple[DataFrame, int | None]:
    """One round over (group, shard, held), and how many groups moved; None when no group is split."""
    whole = labels.groupBy("group").agg(F.count(F.lit(1)).alias("places"), F.sum("held").alias("members"))
    if not whole.where("places > 1").limit(1).count():
        return labels, None
    settled = whole.where("places = 1").select(F.col("group").alias("_g"))
    fixed = {r[0]: r[1] for r in labels.join(settled, F.col("group") == F.col("_g")).groupBy("shard")
             .agg(F.sum("held")).collect()}
    room = [quota[i] - fixed.get(i, 0) for i in range(p.shards)]
    open_groups = labels.join(settled, F.col("group") == F.col("_g"), "left_anti")
    # A group asks for the shard with most of it among those that could take it whole, else for one with much room.
    fits = open_groups.join(whole.select(F.col("group").alias("_w"), "members"), F.col("group") == F.col("_w")) \
        .withColumn("room", _lookup(room, F.col("shard")))
    roomy = sorted(range(p.shards), key=lambda i: (-room[i], i))[:max(1, p.shards // 2)]
    elsewhere = _lookup(roomy, F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(len(roomy)))).cast("int")
    rank = F.struct((F.col("room") >= F.col("members")).alias("fits"), F.col("held"), F.xxhash64("group", "shard"),
                    F.col("shard"))
    asked = fits.groupBy("group").agg(F.max(rank).alias("best"), F.first("members").alias("members")).select(
        "group", "members", F.when(F.col("best.fits"), F.col("best.shard")).otherwise(elsewhere).alias("shard"))
    lead = _lead(F.col("members"), F.col("group"), quota)
    queue = running(asked, ["shard"], lead, [lead, F.col("group")], F.col("members"), "ahead")
    accepted = stage(queue.where(F.col("ahead") + F.col("members") <= _lookup(room, F.col("shard")))
                     .select("group", "shard", F.col("members").alias("held")), "accepted")
    rest = labels.join(accepted.select(F.col("group").alias("_a")), F.col("group") == F.col("_a"), "left_anti")
    return stage(rest.unionByName(accepted), "labels"), accepted.count()


def _even_out(placed: DataFrame, quota: list[int], p: Sharding) -> DataFrame:
    """Move surplus rows, unlinked ones first, so that every shard has its quota exactly."""
    have = _counts(placed, p.shards)
    # The shards that are fullest get the larger quotas.
    order = sorted(range(p.shards), key=lambda i: (-have[i], i))
    want = [0] * p.shards
    for q, i in zip(sorted(quota, reverse=True), order, strict=True):
        want[i] = q
    over = [max(0, h - w) for h, w in zip(have, want, strict=True)]
    if not any(over):
        return placed
    # Rows leave in this order: unlinked by hash, then linked, small groups by hash, large ones one after the other. A row's place
    # is the share of all rows before it, as far as draws tell, so places are even and a group of any size lies in many buckets.
    total = sum(have)
    sizes = placed.where("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("members"))
    large = {r["group"]: r["members"] for r in sizes.where(F.col("members") > total / 256).collect()}  # fewer than 256
    linked = total - placed.where("group is null").count()
    alone, small = total - linked, linked - sum(large.values())
    own = F.when(F.col("group").isNull(), draw_of(F.col("doc_id"), F.col("text_key")) * alone)
    at = alone + small
    starts = []
    for g in sorted(large, key=lambda g: (-large[g], g)):
        starts += [F.lit(g), F.array(F.lit(float(at)), F.lit(float(large[g])))]
        at += large[g]
    if starts:
        place = F.try_element_at(F.create_map(*starts), F.col("group"))
        inside = F.get(place, F.lit(0)) + draw_of(F.col("doc_id"), F.col("text_key"), F.lit(3)) * F.get(place, F.lit(1))
        own = own.when(place.isNotNull(), inside)
    lead = own.otherwise(alone + draw_of(F.col("group")) * small) / float(total)
    ranked = running(placed, ["shard"], lead, [lead, F.col("group"), F.col("doc_id"), F.col("text_key")], F.lit(1), "rank")
    before, total = [], 0
    for o in over:
        before.append(total)
        total += o
    ticket = _lookup(before, F.col("shard")) + F.col("rank")
    ends, at = [], 0
    targets = []
    for i in range(p.shards):
        if want[i] > have[i]:
            at += want[i] - have[i]
            ends.append(at)
            targets.append(i)
    target = F.lit(targets[-1])
    for e, t in reversed(list(zip(ends[:-1], targets[:-1], strict=True))):
        target = F.when(ticket < e, F.lit(t)).otherwise(target)
    leaves = F.col("rank") < _lookup(over, F.col("shard"))
    return stage(ranked.withColumn("shard", F.when(leaves, target).otherwise(F.col("shard"))).drop("rank"), "even")
