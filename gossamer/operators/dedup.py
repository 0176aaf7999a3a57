"""Content deduplication: exact by digest, near by SimHash within a Hamming distance, greedy by arrival."""

from __future__ import annotations

from itertools import combinations, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gossamer.functions import text as T
from gossamer.operators.frontier import first_of_batch
from gossamer.session import cut_lineage


def exact_first(rows: DataFrame, key: str = "content_hash", seq: str = "seq", history: DataFrame | None = None) -> DataFrame:
    """The first row of each digest that the history does not hold."""
    out = first_of_batch(rows, key, seq)
    return out if history is None else out.join(history.select(key), key, "left_anti")


def _masks(distance: int, blocks: int, width: int = 64) -> list[int]:
    """Bit masks of which two fingerprints within the distance agree in one at least.

    The bits are cut into blocks; ``distance`` flips leave ``blocks - distance`` of them
    alone, so every choice of that many blocks is a key. More blocks make longer keys.
    """
    cuts = [width * i // blocks for i in range(blocks + 1)]
    of_block = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(x) - (1 << 64 if sum(x) >> 63 else 0) for x in combinations(of_block, blocks - distance)]


def blocks_for(rows: int, distance: int, width: int = 64) -> int:
    """As few blocks as give keys with more values than there are rows, so that a key's bucket stays small at any size."""
    need = max(1, rows).bit_length()
    blocks = distance + 1
    while (blocks - distance) * width // blocks < need and blocks < distance + 5:
        blocks += 1
    return blocks


def _near(distance: int) -> Column:
    """Rows l and r meet in a table and are within the distance."""
    return (F.col("l.table") == F.col("r.table")) & (F.col("l.bits") == F.col("r.bits")) & (T.hamming_distance("l.h", "r.h") <= distance)


def _keyed(prints: DataFrame, masks: list[int]) -> DataFrame:
    """Each row once for each mask, with the mask's number and the bits under it."""
    keys = F.array(*(F.struct(F.lit(i).alias("table"), F.col("h").bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)))
    return prints.select("*", F.explode(keys).alias("x")).select(*prints.columns, "x.table", "x.bits")


def near_pairs(rows: DataFrame, distance: int = 3, key: str = "simhash", seq: str = "seq", blocks: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """(h1, h2, distance) for all pairs of fingerprints that differ in 1 to ``distance`` bits; exact by pigeonhole.

    Pairs are sought between distinct fingerprints, so that copies do not multiply within a bucket. With a
    ``history`` of earlier fingerprints, only pairs with one of ``rows`` are sought: h1 is of ``rows``, h2 of either.
    """
    distinct = cut_lineage(rows.select(F.col(key).alias("h")).distinct())  # fingerprints are made once
    old = None if history is None else cut_lineage(history.select(F.col(key).alias("h")).distinct().join(distinct, "h", "left_anti"))
    masks = _masks(distance, blocks or blocks_for(distinct.count() + (0 if old is None else old.count()), distance))
    keyed, other, pair = _keyed(distinct, masks), distinct, F.col("l.h") < F.col("r.h")
    if old is not None:
        other = old.withColumn("old", F.lit(True)).unionByName(distinct.withColumn("old", F.lit(False)))
        pair = F.col("r.old") | pair
    near = keyed.alias("l").hint("merge").join(_keyed(other, masks).alias("r"), _near(distance) & pair)
    # a pair counts in the first table in which it meets, so that none is made twice
    flips = F.col("l.h").bitwiseXOR(F.col("r.h"))
    first = F.coalesce(*(F.when(flips.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)))
    return near.where(first == F.col("l.table")).select(F.col("l.h").alias("h1"), F.col("r.h").alias("h2"), T.hamming_distance("l.h", "r.h").cast("int").alias("distance"))


def near_any(rows: DataFrame, others: DataFrame, distance: int = 3) -> DataFrame:
    """(h): those of ``rows`` with one of ``others`` within the distance, equal ones too; pairs are not made."""
    masks = _masks(distance, blocks_for(rows.count() + others.count(), distance))
    near = _keyed(rows, masks).alias("l").join(_keyed(others, masks).alias("r").hint("merge"), _near(distance), "left_semi")
    return near.select("h").distinct()


def near_row_pairs(rows: DataFrame, distance: int = 3, key: str = "simhash", seq: str = "seq") -> DataFrame:
    """Row pairs (a < b) for reports on small tables: the pairs of fingerprints, expanded to their rows, and the copies."""
    links = near_pairs(rows, distance, key, seq)
    a, b = rows.select(F.col(key).alias("h1"), F.col(seq).alias("s1")), rows.select(F.col(key).alias("h2"), F.col(seq).alias("s2"))
    near = links.join(a, "h1").join(b, "h2").select("s1", "s2", "distance")
    copies = a.join(b, (F.col("h1") == F.col("h2")) & (F.col("s1") < F.col("s2"))).select("s1", "s2", F.lit(0).alias("distance"))
    return near.select(F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b"), "distance").unionByName(copies.select(F.col("s1").alias("a"), F.col("s2").alias("b"), "distance"))


#: Tables of so many rows are decided at once; larger ones in ranges of arrival, of which these are the ends among so many equal ones.
_AT_ONCE, _RANGES, _ENDS = 50_000, 64, (0, 2, 8, 24)


def _first_wins(edges: DataFrame, max_rounds: int | None) -> DataFrame | None:
    """(s): rows dropped among the pairs (early, late); None without pairs.

    A round keeps all rows without an undecided earlier one and drops what is linked to them; pairs with a dropped row go,
    so that each round works on what is left. The earliest row is always decided; where none is, this is an error.
    """
    dropped = None
    for done in count():
        if edges.isEmpty():
            return dropped
        lates = edges.select(F.col("late").alias("early")).distinct()
        now = cut_lineage(edges.join(lates.hint("merge"), "early", "left_anti").select(F.col("late").alias("s")).distinct())
        if done == max_rounds or now.isEmpty():
            raise RuntimeError(f"{edges.count()} pairs are undecided after {done} rounds")
        dropped = now if dropped is None else dropped.unionByName(now)
        out = now.hint("merge")
        edges = cut_lineage(edges.join(out.withColumnRenamed("s", "late"), "late", "left_anti").join(out.withColumnRenamed("s", "early"), "early", "left_anti").select("early", "late"))


def greedy_keep(rows: DataFrame, distance: int = 3, key: str = "simhash", seq: str = "seq", max_rounds: int | None = None, history: DataFrame | None = None) -> DataFrame:
    """Rows kept when each is dropped if it is near a kept earlier one: first seen wins, not transitive.

    Only the first row of a fingerprint can be kept. Large tables are taken in ranges of arrival, each larger than all
    before it: what is near a row kept before is dropped, and pairs are made of what is left only, so that a large class
    costs pairs with its few kept rows. All state is checkpointed, nothing is collected, and no join is by broadcast.
    A range takes rounds until all its rows are decided; beyond ``max_rounds`` this is an error.
    Rows of a ``history`` were kept before: what is near or equal to one is dropped, and they are not compared among each other.
    """
    distance = distance if distance > 0 else 3
    firsts = rows.groupBy(F.col(key).alias("h")).agg(F.min(seq).alias("s"))
    kept = None if history is None else cut_lineage(history.select(F.col(key).alias("h"), F.lit(None).cast(rows.schema[seq].dataType).alias("s")).distinct())
    firsts = cut_lineage(cut_lineage(firsts).repartitionByRange(_RANGES, "s").withColumn("range", F.spark_partition_id()))
    starts = (0,) if firsts.count() <= _AT_ONCE else _ENDS
    for low, high in zip(starts, (*starts[1:], None)):
        new = firsts.where((F.col("range") >= low) if high is None else F.col("range").between(low, high - 1)).select("h", "s")
        if kept is not None:
            new = cut_lineage(new.join(near_any(new, kept, distance).hint("merge"), "h", "left_anti"))
        one, two = (new.select(F.col("h").alias(f"h{i}"), F.col("s").alias(f"s{i}")).hint("merge") for i in (1, 2))
        links = near_pairs(new, distance, "h", "s").join(one, "h1").join(two, "h2")
        dropped = _first_wins(cut_lineage(links.select(F.least("s1", "s2").alias("early"), F.greatest("s1", "s2").alias("late"))), max_rounds)
        new = new if dropped is None else new.join(dropped.hint("merge"), "s", "left_anti").select("h", "s")
        kept = cut_lineage(new if kept is None else kept.unionByName(new))
    return rows.join(kept.select(F.col("s").alias(seq)).hint("merge"), seq, "left_semi")


def check_and_store(pages: DataFrame, distance: int = 3, history: DataFrame | None = None) -> DataFrame:
    """Pages with ``duplicate``: ``exact`` (same digest as an earlier page), ``near`` or none; kept pages are those without.

    ``history`` holds the digests and fingerprints kept before; they are compared with the new pages only.
    """
    signed = cut_lineage(pages.select("seq", "content_hash", "simhash"))  # fingerprints are made once
    first_rows = cut_lineage(exact_first(signed, history=history))
    firsts = first_rows.select("seq", F.lit(True).alias("__first"))
    kept = greedy_keep(first_rows, distance, history=history).select("seq", F.lit(True).alias("__kept"))
    out = pages.join(firsts.hint("merge"), "seq", "left").join(kept.hint("merge"), "seq", "left")
    return out.withColumn("duplicate", F.when(F.col("__first").isNull(), "exact").when(F.col("__kept").isNull(), "near").otherwise("none")).drop("__first", "__kept")


def signature_stats(kept: DataFrame) -> DataFrame:
    return kept.agg(F.countDistinct("content_hash").alias("exact"), F.countDistinct("simhash").alias("simhashes"))
