"""Exact Jaccard join of documents by their word n-grams, and the components of its links.

Documents of one set of n-grams are one node. Nodes meet in tiles: a tile is an n-gram of the prefix (so short
that two linked nodes share one of it) and a size band; in a tile, bitmaps of the parity of hashed n-grams give a
lower bound of the n-grams that only one of two sets has, whatever they share, and pairs that pass it are checked by
the intersection of their sorted n-gram arrays.
Before that, links to star centres, found by equal least hashes and checked the same way, contract groups of
near copies, so that the tiles only compare nodes of different groups: no link between groups is lost, and
no group is expanded into its pairs. N-grams of many documents come last in the prefix order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duewise.llm.common import Workspace, list_array, map_rows, table, texts_of
from duewise.llm.components import components
from duewise.llm.hashing import mix, range_hashes, signed, window_hashes, word_hashes
from duewise.llm.phrases import Bitmap, pair_key
from duewise.llm.registry import query

#: Star centres that each node may be compared with.
STARS = 6
#: Sets of at most so many n-grams carry their bitmaps into the tiles.
CARRIED = 512
#: Pairs of two groups that are checked before the rest of their pairs.
PICKS = 3
#: Places of texts, of three longs each, that are sent to all tasks.
FEW = 8192
#: An n-gram of so large a share of the documents counts as frequent.
FREQUENT = 0.002
#: Rows of an n-gram from which its nodes meet a centre node, round by round, before they meet in pairs.
CROWD = 16
_SALTS = np.random.default_rng(51).integers(1, 2**63, STARS + 1, dtype=np.uint64)


def ngrams(text: bytes, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct n-grams; with fewer words, of the whole sequence as one."""
    words = word_hashes(text.lower())
    if 0 < len(words) < size:
        return range_hashes(words, np.array([0]), np.array([len(words)]))
    return np.unique(window_hashes(words, size))


def band_of(n: np.ndarray, percent: int) -> np.ndarray:
    """Size band: linked sets are in equal or adjacent bands. The bands are a little wider than the ratio."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(percent / 100 - 0.01)).astype(np.int64)


def _width(band: int, percent: int) -> int:
    """Bits of a band's bitmaps: at least the largest size of the band."""
    largest = (percent / 100 - 0.01) ** -(band + 1)
    return 1 << max(6, math.ceil(math.log2(largest)))


def bitmap(grams: np.ndarray, width: int) -> np.ndarray:
    """For each of ``width`` places, whether an odd number of the n-grams falls on it."""
    bits = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & np.uint8(1)
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap's n-grams in one of the smaller ``width``."""
    while len(bits) * 64 > width:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    return docs.select("doc_id", row.alias("row_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def _described(keyed: DataFrame, size: int, percent: int) -> DataFrame:
    """node, n, band, bitmaps and least hashes of each row, and the frequent n-grams of its batch on one row of it."""

    def run(batch: pa.RecordBatch) -> dict:
        rows = [ngrams(t, size) for t in texts_of(batch)]
        n = np.array([len(g) for g in rows])
        bands = band_of(n, percent)
        plain, salted = (np.array([x.sum(dtype=np.uint64) for x in sums], np.uint64) for sums in (rows, [mix(g ^ _SALTS[-1]) for g in rows]))
        nodes = plain + salted * np.uint64(3)
        own = [bitmap(g, _width(b, percent)) for g, b in zip(rows, bands.tolist(), strict=True)]
        low = [folded(x, _width(b - 1, percent)) for x, b in zip(own, bands.tolist(), strict=True)]
        stars = [np.array([mix(g ^ s).min() for s in _SALTS[:-1]]) if len(g) else np.zeros(STARS, np.uint64) for g in rows]
        found, counts = np.unique(np.concatenate(rows), return_counts=True)
        many = counts >= max(4, FREQUENT * len(rows))
        first = np.zeros(len(rows), np.int64)
        first[0] = many.sum()
        return {c: batch.column(c) for c in ("doc_id", "row_id", "text_key")} | {
            "node": pa.array(signed(nodes)), "n": pa.array(n.astype(np.int64)), "band": pa.array(bands),
            "own": list_array(pa.array(signed(np.concatenate(own))), [len(x) for x in own]),
            "low": list_array(pa.array(signed(np.concatenate(low))), [len(x) for x in low]),
            "stars": list_array(pa.array(signed(np.concatenate(stars))), [STARS] * len(rows)),
            "frequent": list_array(pa.array(signed(found[many])), first), "frequencies": list_array(pa.array(counts[many].astype(np.int64)), first),
        }

    kinds = "node long, n long, band long, own array<long>, low array<long>, stars array<long>, frequent array<long>, frequencies array<long>"
    return map_rows(keyed, run, f"doc_id {dict(keyed.dtypes)['doc_id']}, row_id long, text_key long, {kinds}")


def _frequent(described: DataFrame) -> np.ndarray:
    """N-grams of at least a share ``FREQUENT`` / 2 of the documents, among those frequent in some batch.

    There are at most 2 * (mean set size) / ``FREQUENT`` of them whatever the corpus: a bounded broadcast.
    """
    rows = described.count()
    counts = described.where(F.size("frequent") > 0).select(F.explode(F.arrays_zip("frequent", "frequencies")).alias("x"))
    summed = counts.groupBy(F.col("x.frequent").alias("gram")).agg(F.sum("x.frequencies").alias("n")).where(F.col("n") >= FREQUENT * rows / 2)
    return np.sort(np.array([r.gram for r in summed.select("gram").toLocalIterator()], np.int64).view(np.uint64))


def _prefixes(keyed: DataFrame, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """text_key and one of the n-grams of the prefix of each row."""
    shared = keyed.sparkSession.sparkContext.broadcast(frequent)

    def run(batch: pa.RecordBatch) -> dict:
        out = []
        for text in texts_of(batch):
            grams = ngrams(text, size)
            length = len(grams) - -(-percent * len(grams) // 100) + 1 if len(grams) else 0
            last = np.isin(grams, shared.value, assume_unique=True)
            order = np.concatenate([grams[~last], grams[last]])
            out.append(order[:length])
        return {
            "row_id": batch.column("row_id"), "text_key": batch.column("text_key"),
            "prefix": list_array(pa.array(signed(np.concatenate(out))), [len(x) for x in out]),
        }

    return map_rows(keyed.select("row_id", "text_key", "text"), run, "row_id long, text_key long, prefix array<long>")


def _changed(a: Column, b: Column) -> Column:
    """Places where two bitmaps differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, x: total + x)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether the sizes and the bit counts of two nodes, ``x`` the smaller, allow the similarity.

    N-grams of both sets change the parity of a place twice, so each place that differs stands for at least one
    n-gram of one set alone, however many they share.
    """
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    mine = F.col(f"{x}.own")
    other = F.when(F.col(f"{y}.band") == F.col(f"{x}.band"), F.col(f"{y}.own")).otherwise(F.col(f"{y}.low"))
    sizes = (nx <= ny) & (100 * nx >= percent * ny) & (F.col(f"{y}.band") - F.col(f"{x}.band")).isin(0, 1)
    return sizes & ((100 + percent) * (nx + ny - _changed(mine, other)) >= 2 * percent * (nx + ny))


def _sets(pairs: DataFrame, keyed: DataFrame, nodes: DataFrame, size: int, ws: Workspace, name: str) -> DataFrame:
    """node, grams: the sorted n-grams of the nodes in ``pairs``, made from one text of each.

    A few places go to all tasks; of more, a bitmap leaves out all other texts before the shuffle.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    places = ws.stage(nodes.join(wanted, "node").select("node", "row_id", "text_key"), f"{name}-places")
    few = places.count() <= FEW
    bits = None if few else Bitmap(places.select("row_id", "text_key"), ("places", ws.path(f"{name}-places")))

    def may_be_wanted(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [batch.column(c).to_numpy().view(np.uint64) for c in ("row_id", "text_key")]
        return batch.filter(pa.array(bits.may_hold(pair_key(*own))))

    def arrays(batch: pa.RecordBatch) -> dict:
        rows = [ngrams(t, size) for t in texts_of(batch)]
        return {"node": batch.column("node"), "grams": list_array(pa.array(signed(np.concatenate(rows))), [len(g) for g in rows])}

    some = keyed if few else map_rows(keyed.select("row_id", "text_key", "text"), may_be_wanted, "row_id long, text_key long, text string")
    # Rows that repeat a row in full give a node twice; one of them stands for it.
    texts = some.join(F.broadcast(places) if few else places, ["row_id", "text_key"]).dropDuplicates(["row_id", "text_key", "node"]).select("node", "text")
    sets = ws.stage(map_rows(texts, arrays, "node long, grams array<long>"), f"{name}-sets")
    if bits:
        bits.close()
    return sets


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, by the intersection of their sorted n-gram arrays."""
    joined = pairs.select("a", "b").join(sets.withColumnRenamed("node", "a").withColumnRenamed("grams", "x"), "a").join(
        sets.withColumnRenamed("node", "b").withColumnRenamed("grams", "y"), "b"
    )

    def check(batch: pa.RecordBatch) -> dict:
        values = {}
        for c in ("x", "y"):
            lists = batch.column(c)
            values[c] = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        keep = []
        for i in range(batch.num_rows):
            x, y = (v[e[i] : e[i + 1]].view(np.uint64) for v, e in (values["x"], values["y"]))
            # Both arrays ascend: the places of one in the other give the intersection.
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int((y[at] == x).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        return {"a": kept.column("a"), "b": kept.column("b")}

    return map_rows(joined.select("a", "b", "x", "y"), check, "a long, b long")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different groups, with the groups as low and high."""
    first = groups.select(F.col("node").alias("a"), F.col("component").alias("ga"))
    second = groups.select(F.col("node").alias("b"), F.col("component").alias("gb"))
    both = pairs.join(first, "a", "left").join(second, "b", "left")
    ga, gb = F.coalesce("ga", "a"), F.coalesce("gb", "b")
    return both.where(ga != gb).select(*pairs.columns, F.least(ga, gb).alias("low"), F.greatest(ga, gb).alias("high"))


def _joined_groups(groups: DataFrame, links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return ws.stage(components(known.unionByName(links), ws, f"{name}-parts"), name)


def _allowed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) of nodes, those that sizes and bitmaps allow."""
    left = nodes.select(F.col("node").alias("a"), F.struct("n", "band", "own", "low").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.struct("n", "band", "own", "low").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    turned = (F.col("x.n") > F.col("y.n"))
    may = F.when(turned, _may_link("y", "x", percent)).otherwise(_may_link("x", "y", percent))
    return both.where(may).select(*pairs.columns)


def _narrow(bits: str) -> Column:
    """A bitmap of more than ``CARRIED`` places, folded to that many."""
    words, c = CARRIED // 64, F.col(bits)
    places = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.aggregate(
        F.sequence(i, F.size(c) - 1, F.lit(words)), F.lit(0).cast("long"), lambda total, k: total.bitwiseXOR(F.element_at(c, k + 1))
    ))
    return F.when(F.size(c) > words, places).otherwise(c).alias(bits)


def _contracted(crowds: DataFrame, groups: DataFrame, keyed: DataFrame, nodes: DataFrame, size: int, percent: int, ws: Workspace) -> DataFrame:
    """``groups`` after rounds of links between the nodes of an n-gram (gram, node, n) and one centre node of it.

    Each round has new centres, so a node costs one comparison a round for each of its n-grams, not one for each
    other node. Rounds end when they no longer join one in 32 of the groups; links that none has met stay for the tiles.
    """
    turn = 0
    while True:
        turn += 1
        named = crowds.join(groups, "node", "left").select("gram", "node", "n", F.coalesce("component", "node").alias("part"))
        before = named.agg(F.countDistinct("part")).first()[0]
        order = F.struct(F.xxhash64("node", "gram", F.lit(turn)), "node", "part", "n")
        centres = named.groupBy("gram").agg(F.max(order).alias("c"))
        centres = centres.select("gram", F.col("c.node").alias("centre"), F.col("c.part").alias("its"), F.col("c.n").alias("its_n"))
        # Pairs whose sizes allow no link are not joined to their bitmaps.
        sizes = 100 * F.least("n", "its_n") >= percent * F.greatest("n", "its_n")
        met = named.join(centres, "gram").where("part != its").where(sizes).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        pairs = ws.stage(_allowed(met.distinct(), nodes, percent), f"crowd-pairs-{turn}")
        links = ws.stage(_linked(pairs, _sets(pairs, keyed, nodes, size, ws, f"crowd-{turn}"), percent), f"crowd-links-{turn}")
        ws.drop(f"crowd-pairs-{turn}", f"crowd-{turn}-places", f"crowd-{turn}-sets")
        if links.isEmpty():
            return groups
        groups = _joined_groups(groups, links, ws, f"crowd-groups-{turn}")
        after = crowds.join(groups, "node", "left").agg(F.countDistinct(F.coalesce("component", "node"))).first()[0]
        if after * 32 > before * 31:
            return groups


def near_duplicates(docs: DataFrame, ws: Workspace, size: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of ``docs``; see :func:`grouped_rows` for the rows' keys.

    Sets are of distinct n-grams of ``size`` words, A-Z lower-cased; two rows link when 100 * intersection is at
    least ``percent`` * union; component_id is the least doc_id reachable, the row's own included. A row without
    words (null and empty texts too) has n_shingles 0 and links with nothing. Rows of one doc_id are separate
    rows of their texts; a null doc_id is never the least where another is reachable.
    """
    found = grouped_rows(docs, ws, size, percent)
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, ws: Workspace, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that of the least doc_id (null first), then of the least text hash.

    Rows without words stay. Rows that repeat another's doc_id and text count once. All columns are kept.
    """
    found = grouped_rows(docs, ws, size, percent)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("row_id", "text_key")).alias("first"))
    keepers = ws.stage(
        first.select("first.row_id", "first.text_key").unionByName(found.where("component is null").select("row_id", "text_key")).distinct(), "keepers"
    )
    own = [c for c in docs.columns if c != "text"]
    row, body = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*own).alias("own"), "text", row.alias("row_id"), F.xxhash64(body).alias("text_key"))
    kept = rows.join(keepers, ["row_id", "text_key"], "left_semi").dropDuplicates(["row_id", "text_key"])
    return kept.select("own.*", "text").select(*docs.columns)


def grouped_rows(docs: DataFrame, ws: Workspace, size: int, percent: int) -> DataFrame:
    """doc_id, row_id, text_key, n_shingles and component of each row; component is null for rows without words.

    row_id is doc_id with null as the least long, text_key a hash of the text.
    """
    keyed = _keyed(docs)
    described = ws.stage(_described(keyed, size, percent), "described")
    filled = described.where("n > 0")
    nodes = ws.stage(
        filled.groupBy("node").agg(
            F.min(F.struct("row_id", "text_key")).alias("place"), *(F.first(c).alias(c) for c in ("n", "band", "own", "low", "stars"))
        ).select("node", "place.row_id", "place.text_key", "n", "band", "own", "low", "stars"),
        "nodes",
    )
    # Stars: nodes of one least hash meet a centre that is chosen anew for each hash function.
    # The centre is the node whose own least hashes are the most common: copies with few changes are near all others.
    keys = nodes.select("node", F.posexplode("stars").alias("turn", "least"))
    sizes = ws.stage(keys.groupBy("turn", "least").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared_keys = ws.stage(keys.join(sizes, ["turn", "least"]), "star-keys")
    support = shared_keys.groupBy("node").agg(F.sum("size").alias("support"))
    keys = ws.stage(shared_keys.join(support, "node").select("node", "turn", "least", "support"), "supported")
    # Even turns take the best supported node, odd ones any node.
    rank = F.when(F.col("turn") % 2 == 0, F.col("support")).otherwise(F.lit(0))
    centres = keys.groupBy("turn", "least").agg(
        F.max(F.struct(rank.alias("rank"), F.xxhash64("node", "turn").alias("tie"), F.col("node"))).alias("centre")
    )
    centres = ws.stage(centres.select("turn", "least", F.col("centre.node").alias("b")), "centres")
    met_stars = keys.join(centres, ["turn", "least"]).where("node != b").groupBy(F.col("node").alias("a"), "b").agg(F.min("turn").alias("turn"))
    stars = ws.stage(_allowed(met_stars, nodes, percent), "stars")
    sets = _sets(stars, keyed, nodes, size, ws, "star")
    # First one centre for each node; what is still apart then meets its other centres.
    own_star = stars.groupBy("a").agg(F.min(F.struct("turn", "b")).alias("s")).select("a", "s.b")
    links = ws.stage(_linked(own_star, sets, percent), "links-1")
    groups = ws.stage(components(links, ws, "groups-1-parts"), "groups-1")
    links = ws.stage(_linked(_apart(stars, groups), sets, percent), "links-2")
    groups = _joined_groups(groups, links, ws, "groups-2")
    ws.drop("stars", "star-places", "star-sets", "centres", "sizes", "star-keys", "supported")
    # Tiles: n-grams of prefixes that more than one group has.
    frequent = _frequent(described)
    prefixes = ws.stage(_prefixes(keyed, size, percent, frequent), "prefixes")
    tokens = ws.stage(
        nodes.select("node", "row_id", "text_key", "n").join(prefixes, ["row_id", "text_key"]).join(groups, "node", "left")
        .select("node", "n", F.coalesce("component", "node").alias("part"), F.posexplode("prefix").alias("place", "gram")), "tokens",
    )
    ws.drop("prefixes")
    shared = ws.stage(
        tokens.groupBy("gram").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("rows"))
        .where("low != high").select("gram", "rows"), "shared",
    )
    meeting = ws.stage(tokens.join(shared, "gram"), "meeting")
    ws.drop("tokens", "shared")
    crowds = ws.stage(meeting.where(F.col("rows") >= CROWD).select("gram", "node", "n").distinct(), "crowds")
    groups = _contracted(crowds, groups, keyed, nodes, size, percent, ws)
    ws.drop("crowds")
    # Bitmaps travel with the rows of sets of ordinary size; those of very large sets are looked at once a pair.
    none = F.array().cast("array<long>")
    small = nodes.select("node", "n", "band", *(F.when(F.col("n") <= CARRIED, F.col(c)).otherwise(none).alias(c) for c in ("own", "low")))
    now = groups.select("node", F.col("component").alias("now"))
    places = meeting.drop("n", "rows").distinct().join(now, "node", "left").withColumn("part", F.coalesce("now", "part")).drop("now")
    met = ws.stage(places.join(small, "node"), "met")
    ws.drop("meeting")
    # Each row brings the one bitmap that its tile compares: its own band's, or that of the band below.
    plain = ["node", "part", "place", "gram", "n", "band"]
    x = met.select(*plain, F.col("band").alias("tile"), "own").alias("x")
    sides = F.array(F.struct(F.col("band").alias("tile"), "own"), F.struct((F.col("band") - 1).alias("tile"), F.col("low").alias("own")))
    y = met.select(*plain, F.explode(sides).alias("side")).select(*plain, "side.tile", "side.own").withColumn("low", F.col("own")).alias("y")
    order = (F.col("x.n") < F.col("y.n")) | (F.col("x.node") < F.col("y.node"))
    tiles = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.part") != F.col("y.part"))
    # The first common n-gram leaves room for the overlap behind it in both sets.
    total = percent * (F.col("x.n") + F.col("y.n"))
    room = [(100 + percent) * (F.col(f"{k}.n") - F.col(f"{k}.place")) >= total for k in ("x", "y")]
    sizes = (F.col("x.n") <= F.col("y.n")) & (100 * F.col("x.n") >= percent * F.col("y.n"))
    large = (F.size("x.own") == 0) | (F.size("y.own") == 0)
    near = x.join(y, tiles & order & sizes & room[0] & room[1] & F.when(large, F.lit(True)).otherwise(_may_link("x", "y", percent)))
    candidates = ws.stage(near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), large.alias("large")).distinct(), "candidates")
    # The tiles have compared the bitmaps that they carry; only those of very large sets are left to compare, folded ones first.
    wide = nodes.where(100 * F.col("n") > percent * CARRIED)
    narrow = wide.select("node", "n", "band", _narrow("own"), _narrow("low"))
    rest = _allowed(ws.stage(_allowed(candidates.where("large").select("a", "b"), narrow, percent), "rest"), wide, percent)
    pairs = ws.stage(candidates.where("not large").select("a", "b").unionByName(rest), "pairs")
    ws.drop("candidates", "met", "rest")
    sets = _sets(pairs, keyed, nodes, size, ws, "tile")
    # One link joins two groups: some pairs of each two groups first, the rest only for groups still apart.
    apart = _apart(pairs, groups)
    picks = apart.groupBy("low", "high").agg(*(
        F.min(F.struct(F.xxhash64("a", "b", F.lit(k)).alias("rank"), F.col("a"), F.col("b"))).alias(f"p{k}") for k in range(PICKS)
    ))
    picked = picks.select(F.explode(F.array(*(F.col(f"p{k}") for k in range(PICKS)))).alias("p")).select("p.a", "p.b").distinct()
    links = ws.stage(_linked(picked, sets, percent), "links-3")
    groups = _joined_groups(groups, links, ws, "groups-3")
    links = ws.stage(_linked(_apart(pairs, groups), sets, percent), "links-4")
    whole = _joined_groups(groups, links, ws, "groups-4")
    found = ws.stage(
        described.select("doc_id", "row_id", "text_key", "node", F.col("n").alias("n_shingles")).join(whole, "node", "left")
        .withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))), "found",
    )
    ws.drop("described", "nodes", "pairs", "tile-places", "tile-sets")
    return found


ORACLE = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
g as (select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(list_slice(w, i, i + 3), ' ') end as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
few as (select doc_id, s from g join (select s from g group by s having count(*) > 1) using (s)),
inter as (select a.doc_id as a, b.doc_id as b, count(*) as c from few a join few b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from inter join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
pair as (select a, b from link union select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from d union select reach.doc_id, pair.b from reach join pair on pair.a = reach.r)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, min(r) as component_id
from d left join n using (doc_id) join reach using (doc_id) group by 1, 2
"""


@query("op5_ngram_join", ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: n_shingles (4 words) and component_id (similarity of 85 per cent or more)."""
    return near_duplicates(table(spark, sf_dir, "documents"), Workspace(spark, "ngram-join"))
