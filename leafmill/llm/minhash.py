"""Near-duplicate groups: an inverted join over MinHash signature coordinates, confirmed on full shingle sets.

1. ``sketches``: one narrow scan gives each document its shingle count, a 128-bit digest of its shingle set
   (``node``) and a signature of ``coordinates`` minima. Documents with equal sets are one node from here on.
2. Postings: every node is posted under each (coordinate, value). Values seen once cannot collide and are
   dropped, and with them the nodes that have fewer than ``matches`` colliding coordinates.
3. Prefix: of the nodes that are left, each is posted under its rarest shingles, as many as two similar sets cannot
   both miss. With a shingle stands how many the set has from there on: if it is the first that two sets share,
   they share no more than that, which rules most pairs out before they are made.
4. Skip merging: a posting list is not paired out. Its most central member (largest posting frequencies) meets the
   others; collisions of a pair are counted over the two signatures, pairs from ``matches`` up are confirmed on
   their sets, and links join components. A member that has met its list retires, a list whose remaining members
   are one component is skipped. Rounds take 1, 8, 64, ... members of each list that is left, so every pair that can
   be similar and is not yet connected is met: components are the same as from all pairs.

``matches`` is the largest number for which a pair at the threshold is missed with probability below 1e-8.

Work per round is the lists' length times the members taken; joins are equi-joins that adaptive execution may
split. Nothing but one count per round reaches the driver.

Defined results: null and blank texts have no shingles and are linked with nothing; a null id counts as the
smallest and comes back null, always kept; rows that repeat an id get the group of their own text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.components import roots
from leafmill.llm.keys import NO_ID, real_id, text_key, texts, with_keys
from leafmill.llm.words import Words, grams, inner, mixed, slices, words
from leafmill.shared import settle

COORDINATES = 64
MISS = 1e-8


def match_threshold(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """The most matches to ask for so that a pair of this similarity has fewer with probability under ``miss``."""
    tail, asked = 0.0, 0
    while asked < coordinates:
        tail += math.comb(coordinates, asked) * similarity**asked * (1 - similarity) ** (coordinates - asked)
        if tail >= miss:
            break
        asked += 1
    return max(1, asked)


def _shingles(found: Words, size: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each document, sorted."""
    values = grams(found.hash, size)
    start = np.flatnonzero(inner(found.first, size, len(values)))
    bounds = np.searchsorted(start, found.first)
    for i, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        if low < high:
            yield np.unique(values[start[low:high]])
        else:
            own = found.hash[found.first[i] : found.first[i + 1]]
            yield grams(np.append(own, mixed(np.uint64([len(own)]))), len(own) + 1) if len(own) else own


def sketches(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """``_id, _copy, n, node, signature`` of each row of ``_id, _copy, _text``."""
    generator = np.random.Generator(np.random.PCG64(5))
    factors = generator.integers(1, 1 << 62, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = generator.integers(0, 1 << 62, coordinates, dtype=np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_id", pa.int64()), ("_copy", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("signature", pa.list_(pa.int32()))])
        for batch in batches:
            for at, to in slices(batch["_text"]):
                part = batch.slice(at, to - at)
                sets = list(_shingles(words(part["_text"], lower=True), size))
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                minima = np.zeros((len(sets), coordinates), np.uint32)
                nodes: list[bytes | None] = [None] * len(sets)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    opens = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for j in range(coordinates):
                        minima[full, j] = np.minimum.reduceat((flat * factors[j] + shifts[j]) >> np.uint64(32), opens)
                    one, two = np.add.reduceat(flat, opens), np.add.reduceat(mixed(flat ^ shifts[0]), opens)
                    for i, a, b in zip(full, one, two):
                        nodes[i] = a.tobytes() + b.tobytes()
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * coordinates)
                signature = pa.ListArray.from_arrays(ends, pa.array(minima.reshape(-1).view(np.int32)))
                yield pa.record_batch([part["_id"], part["_copy"], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), signature], schema=schema)

    return docs.mapInArrow(scan, "_id bigint, _copy bigint, n bigint, node binary, signature array<int>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``num, shingles`` of each row of ``num, _text``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to in slices(batch["_text"]):
                part = batch.slice(at, to - at)
                sets = [s.view(np.int64) for s in _shingles(words(part["_text"], lower=True), size)]
                yield pa.record_batch([part["num"], pa.array(sets, pa.list_(pa.int64()))], ["num", "shingles"])

    return docs.mapInArrow(scan, "num bigint, shingles array<bigint>")


def _possible(left: Column, n: Column, other: Column, m: Column, share: tuple[int, int]) -> Column:
    """Whether sets of n and m can be similar enough that share none but the last ``left`` and ``other`` of their shingles."""
    return F.least(left, other) * (share[0] + share[1]) >= (n + m) * share[0]


def _links(pairs: DataFrame, members: DataFrame, sets: DataFrame, matches: int, share: tuple[int, int]) -> DataFrame:
    """Those pairs ``a, b`` whose signatures agree often enough and whose sets confirm it."""
    def sided(table: DataFrame, side: str, column: str) -> DataFrame:
        return table.select(F.col("num").alias(side), F.col(column).alias(f"{side}_{column}"))

    signed = pairs.join(sided(members, "a", "signature"), "a").join(sided(members, "b", "signature"), "b")
    agree = F.size(F.filter(F.zip_with("a_signature", "b_signature", lambda x, y: x == y), lambda same: same))
    close = signed.filter(agree >= matches).select("a", "b")
    whole = close.join(sided(sets, "a", "shingles"), "a").join(sided(sets, "b", "shingles"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles")).cast("bigint")
    union = F.size("a_shingles") + F.size("b_shingles") - common
    return whole.filter(common * share[1] >= union * share[0]).select("a", "b")


def _colliding(nodes: DataFrame, matches: int, share: tuple[int, int]) -> DataFrame:
    """Nodes with at least ``matches`` colliding coordinates, numbered."""
    pack = F.shiftleft(F.col("_at").cast("bigint"), 32).bitwiseOR(F.col("_value").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    # A smaller set is similar enough to no other than itself: one shingle more is too much.
    able = nodes.filter(F.col("n") * share[1] >= (F.col("n") + 1) * share[0])
    posted = able.select("node", F.posexplode("signature").alias("_at", "_value")).select("node", pack.alias("post"))
    # Settled, so that both sides of the join are plain shuffles and a value of very many nodes can be split.
    common = settle(posted.groupBy("post").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").select("post"), "posts")
    hits = posted.join(common, "post").groupBy("node").agg(F.count(F.lit(1)).alias("_hits")).filter(F.col("_hits") >= matches)
    return settle(hits.select("node").join(nodes, "node").withColumn("num", F.monotonically_increasing_id()), "colliding", free=True)


def _prefixes(sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``num, n, weight, post, left``: the rarest shingles of each set, with how many it has from there on.

    Two similar sets share one of their first ``n - least common + 1`` shingles in one global order. Their first
    common one leaves both with ``left`` shingles to share.
    """
    flat = sets.select("num", F.explode("shingles").alias("post"))
    often = settle(flat.groupBy("post").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    counted = flat.join(often, "post", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    ranked = counted.groupBy("num").agg(F.sort_array(F.collect_list(F.struct("often", "post"))).alias("_r"))
    n = F.size("_r").cast("bigint")
    length = n - F.ceil(n * share[0] / share[1]) + 1
    weight = F.aggregate("_r", F.lit(0).cast("bigint"), lambda sum_, hit: sum_ + hit["often"])
    cut = ranked.select("num", n.alias("n"), weight.alias("weight"), F.posexplode(F.slice("_r", F.lit(1), length.cast("int"))).alias("_at", "_hit"))
    return cut.filter("_hit.often > 1").select("num", "n", "weight", F.col("_hit.post").alias("post"), (F.col("n") - F.col("_at")).alias("left"))


def link_nodes(nodes: DataFrame, docs: DataFrame, size: int, matches: int, share: tuple[int, int]) -> DataFrame | None:
    """``node, root``: a number for each group of linked nodes; None where no two can be linked.

    ``nodes``: node, n, signature and the key of one row with that text in ``docs``.
    """
    members = _colliding(nodes, matches, share)
    found = docs.join(members.select("_id", "_copy", "num"), ["_id", "_copy"]).select("num", "_text")
    sets = settle(shingle_sets(found, size).dropDuplicates(["num"]), "sets", free=True)
    lists = settle(_prefixes(sets, share).withColumn("root", F.col("num")), "lists", free=True)
    links: DataFrame | None = None
    labels: DataFrame | None = None
    take = 1
    while True:
        about = lists.groupBy("post").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("n").alias("_least")).filter("_low != _high")
        # Lists in which all are one component are done; so are members that no size in their list can match.
        partner = F.greatest("_least", "left")
        rest = lists.join(about, "post").filter(_possible(F.col("left"), F.col("n"), partner, partner, share))
        lists = settle(rest.select("num", "n", "left", "weight", "root", "post"), "lists")
        if lists.limit(1).count() == 0:
            break
        if take == 1:
            first = lists.groupBy("post").agg(F.max(F.struct("weight", "num", "n", "left", "root")).alias("_h"))
            heads = first.select("post", "_h.*")
        else:
            central = Window.partitionBy("post").orderBy(F.desc("weight"), F.desc("num"))
            heads = lists.withColumn("_rank", F.row_number().over(central)).filter(F.col("_rank") <= take).drop("_rank")
        heads = settle(heads.select("post", *[F.col(c).alias(f"head_{c}") for c in ("num", "n", "left", "root")]), "heads")
        met = lists.join(heads, "post").filter(
            (F.col("root") != F.col("head_root")) & _possible(F.col("left"), F.col("n"), F.col("head_left"), F.col("head_n"), share)
        )
        pairs = met.select(F.least("num", "head_num").alias("a"), F.greatest("num", "head_num").alias("b")).distinct()
        fresh = settle(_links(pairs, members, sets, matches, share), "links")
        links = fresh if links is None else settle(links.unionByName(fresh), "links")
        labels = roots(links)
        waiting = lists.join(heads.select("post", F.col("head_num").alias("num")), ["post", "num"], "left_anti")
        relabelled = waiting.drop("root").join(labels.withColumnRenamed("node", "num"), "num", "left").withColumn("root", F.coalesce("root", "num"))
        lists = settle(relabelled.select("num", "n", "left", "weight", "root", "post"), "lists")
        take *= 8
    if labels is None:
        return None
    return members.select("num", "node").join(labels.withColumnRenamed("node", "num"), "num").select("node", "root")


def groups(
    docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100), coordinates: int = COORDINATES,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: its shingle count, the smallest id of its group, and whether it is that one.

    ``share``: two documents are linked if their common shingles are at least this part of all theirs.
    """
    full = members(docs, size, share, coordinates, id_column, text_column)
    component = F.coalesce("_least._id", "_id")
    return full.select(
        real_id("_id").alias(id_column), F.col("n").alias("n_shingles"), real_id(component).alias("component_id"),
        ((F.col("_id") == component) | (F.col("_id") == NO_ID)).alias("kept"),
    )


def members(docs: DataFrame, size: int, share: tuple[int, int], coordinates: int, id_column: str, text_column: str) -> DataFrame:
    """Per row of ``docs``: its key ``_id, _copy``, its shingle count ``n``, and the least key of its group, or null for a text without shingles."""
    rows = texts(docs, id_column, text_column).withColumn("_copy", F.xxhash64("_text"))
    matches = match_threshold(coordinates, share[0] / share[1])
    sketch = settle(sketches(rows, size, coordinates), "sketches")
    same = sketch.filter("n > 0").groupBy("node").agg(
        F.min(F.struct("_id", "_copy")).alias("_one"), F.any_value("n").alias("n"), F.any_value("signature").alias("signature")
    )
    nodes = settle(same.select("node", "_one._id", "_one._copy", "n", "signature"), "nodes")
    labels = link_nodes(nodes, rows, size, matches, share)
    least = nodes.select("node", F.struct("_id", "_copy").alias("_own"))
    if labels is None:
        least = least.withColumnRenamed("_own", "_least")
    else:
        linked = least.join(labels, "node")
        smallest = linked.groupBy("root").agg(F.min("_own").alias("_smallest"))
        linked = linked.join(smallest, "root").select("node", "_smallest")
        least = least.join(linked, "node", "left").select("node", F.coalesce("_smallest", "_own").alias("_least"))
    return sketch.select("_id", "_copy", "n", "node").join(least, "node", "left").select("_id", "_copy", "n", "_least")


def first_of_each_group(docs: DataFrame, size: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest id; texts without shingles stay, and rows that repeat id and text are one."""
    rows = members(docs, size, share, COORDINATES, "doc_id", "text").groupBy("_id", "_copy").agg(
        F.any_value("_least").alias("_least"), F.count(F.lit(1)).alias("_rows")
    )
    first = F.coalesce((F.col("_least._id") == F.col("_id")) & (F.col("_least._copy") == F.col("_copy")), F.lit(True))
    marked = settle(rows.select("_id", "_copy", first.alias("_first"), "_rows").filter("not _first or _rows > 1"), "marked")
    single = with_keys(docs, marked, "left_anti")
    repeated = with_keys(docs, marked.filter("_first"), "left_semi")
    repeated = repeated.withColumn("_key", text_key()).dropDuplicates(["doc_id", "_key"]).drop("_key")
    return single.unionAll(repeated)
