"""Near-duplicate groups by an inverted join on MinHash signature coordinates.

1. One pass over the texts makes, per document, its set of word shingles (64-bit hashes of them, in which two
   different shingles of a pair of documents of 10^5 words agree with probability 10^-9): size, a digest of
   128 bits of the whole set, and a signature of ``COORDINATES`` minima. Equal sets become one node at once,
   so copies cost nothing more, however many there are.
2. Every node has one token (coordinate, value) per coordinate. Spark counts the tokens. Two sets as similar
   as asked share at least ``match_threshold`` tokens except with probability ``MISS``; so among each
   node's rarest coordinates - ``match_threshold`` + 1 tokens there is a common one (prefix), and only those
   are posted. Tokens that one node alone has are never posted.
3. Posting lists are merged round by round. The first round pairs each node with one hub, the commonest of its
   lists' hubs, so that a group of near copies gives one link a node and not one a list. The next rounds pair
   each list's members with one hub of the list, leaving out (skip) members that the components found so far already join to it and sizes that can't
   reach the similarity. Of the posted sets a sketch of ``SKETCH`` bits is made, one of each of as many further minima, and goes into the lists: members
   whose sketches differ too much aren't paired at all. Pairs are confirmed on the full sets, and the components grow. The hub is the member whose tokens are the commonest, as an original
   among its edited copies is; then the same outside of the list's main component.
4. The last round pairs what is still apart: every list's members outside its main component with all
   members of other components, so no link between components goes untested. In a long list a pair is
   left out when it provably can't be linked. Sets y and z differ in exactly the elements in which
   what they add to the hub, and what they lack of it, differ. Of these the elements that no other set
   has can't cancel, and the numbers of the others, part by part, tell how many must at least remain.

   Hubs are searched in bands of sizes and of distances from the hub, which differ too much in sets that
   can't be linked; a set with too many shingles of its own is left out altogether.

Sketches are compared where members and hubs of a list meet, so what can't be linked is no row of any later step. Hot lists and
hubs are joined by plain equi-joins with written tables, whose large keys adaptive execution splits; counts
are aggregated before the shuffle. Tables that several steps read are written to the shared folder.

Defined results: null, empty and word-less texts have an empty set and are linked with nothing. A null
doc_id is never linked and has a null component. Rows that repeat a doc_id are separate sets; the smallest
doc_id of a component names it. An empty table gives no rows. A text of any length is one set, which one
task holds. Only doc_id and text are read; ``distinct_documents`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, shingle_hashes, steps, word_hashes, written

COORDINATES = 32
MISS = 1e-6
#: Bits of a sketch; the longs that hold them.
SKETCH = 256
SKETCHED = [f"sketch_{k}" for k in range(SKETCH // 64)]
#: Rounds of one hub a list, after the first, of one hub a node.
HUB_ROUNDS = 2
#: Lists of more members are searched with the bound on differences.
LONG_LIST = 16
PARTS = 16
#: At most so many ids (8 bytes each) are broadcast to pick texts out; more are joined by shuffling.
MAX_BROADCAST = 1_000_000


def _not_space() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    return inside


INSIDE = _not_space()
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_threshold(percent: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most collisions that sets of exactly the asked similarity fall short of with at most the probability ``miss``."""
    p, below, t = percent / 100, 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def sketch_threshold(percent: int) -> int:
    """The most equal bits that sketches of sets of exactly the asked similarity fall short of with what ``match_threshold`` leaves of ``MISS``: two minima are the same as often as sets are similar, and bits of different ones are equal by half."""
    p = percent / 100
    missed = sum(math.comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t) for t in range(match_threshold(percent)))
    return match_threshold((100 + percent) / 2, SKETCH, MISS - missed)


def _sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_hashes(*word_hashes(data, off, INSIDE), size)


def _node(own: np.ndarray) -> tuple[int, int]:
    """The two halves of a 128-bit digest."""
    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches, "text"):
            codes, bounds = _sets(data, off, size)
            n = part.num_rows
            filled = np.flatnonzero(np.diff(bounds) > 0)
            minima = np.zeros((n, COORDINATES), np.uint64)
            for k in range(COORDINATES) if len(filled) else ():
                minima[filled, k] = np.minimum.reduceat((codes ^ _SEEDS[0, k]) * _SEEDS[1, k], bounds[:-1][filled])
            sizes, nodes, halves = np.zeros(n, np.int64), [None] * n, [None] * n
            for i in filled.tolist():
                own = np.unique(codes[bounds[i] : bounds[i + 1]])
                sizes[i] = len(own)
                nodes[i], halves[i] = _node(own)
            values = (minima >> np.uint64(32)).astype(np.uint32).view(np.int32).reshape(-1)
            signature = pa.ListArray.from_arrays(pa.array(np.arange(0, n * COORDINATES + 1, COORDINATES), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(nodes, pa.int64()), pa.array(halves, pa.int64()), signature], ["doc_id", "n", "node", "half", "signature"])

    return run


def _sketches(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of longs for each set, none of them empty."""
    bits = np.empty((len(starts), SKETCH), np.uint8)
    for k in range(SKETCH) if len(starts) else ():
        bits[:, k] = (np.minimum.reduceat((flat ^ _SKETCH_SEEDS[0, k]) * _SKETCH_SEEDS[1, k], starts) >> np.uint64(32)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in steps(batches, "text"):
            codes, bounds = _sets(data, off, size)
            own = [np.unique(codes[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            own = [x for x in own if len(x)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            flat = np.concatenate(own) if own else np.empty(0, np.uint64)
            sketches = _sketches(flat, offsets[:-1])
            nodes = [_node(x) for x in own]
            columns = [*(pa.array([x[k] for x in nodes], pa.int64()) for k in (0, 1)), *(pa.array(np.ascontiguousarray(x)) for x in sketches.T)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], ["node", "half", *SKETCHED, "shingles"])

    return run


def _told_apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """Different sets whose first 64 bits are the same (some in 10^10 documents) become nodes named by a hash of both halves."""
    if clashes is None:
        return rows.drop("half")
    both = rows.join(clashes, "node", "left")
    return both.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "half")).otherwise(F.col("node"))).drop("half", "clash")


def _clashes(signed: DataFrame) -> DataFrame | None:
    """(node, clash) of the nodes that stand for several sets; None if there are none."""
    found = written(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("half").alias("low"), F.max("half").alias("high")).where("low != high").select("node", F.lit(True).alias("clash")), "clashes")
    return found if found.limit(1).count() else None


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _postings(nodes: DataFrame, prefix: int) -> DataFrame:
    """(token, node, n, weight) for the prefix tokens that at least two nodes have; the weight is how common a node's tokens are."""
    tokens = nodes.select("node", "n", F.posexplode("signature").alias("at", "value")).select(
        "node", "n", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)).alias("token")
    )
    frequent = tokens.groupBy("token").count().where("count > 1")
    shared = tokens.join(frequent, "token")
    ranked = shared.groupBy("node", "n").agg(F.sum("count").alias("weight"), F.sort_array(F.collect_list(F.struct("count", "token"))).alias("own"))  # at most one a coordinate
    room = F.lit(prefix - COORDINATES) + F.size("own")  # tokens of this node alone take the first places
    return ranked.where(room > 0).select("node", "n", "weight", F.explode(F.slice("own", F.lit(1), room)).alias("own")).select(F.col("own.token").alias("token"), "node", "n", "weight")


def _alike(prefix: str, percent: int) -> Column:
    """The sketch of a row and that whose columns begin with the prefix may be those of linked sets."""
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(c).bitwiseXOR(F.col(prefix + c))) for c in SKETCHED))
    return differ <= SKETCH - sketch_threshold(percent)


def _hubs(hubs: DataFrame) -> DataFrame:
    return hubs.select("token", F.col("node").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in ("n", "component", "weight", *SKETCHED)))


def _pairs(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of members and hubs of a list in different components with sizes and sketches near enough."""
    met = members.join(_hubs(hubs), "token").where((F.col("component") != F.col("hub_component")) & _similar_sizes(F.col("n"), F.col("hub_n"), percent) & _alike("hub_", percent))
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _first_pairs(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of each node and, of the hubs of its lists with sizes and sketches near enough, the one with the commonest tokens."""
    met = members.join(_hubs(hubs), "token").where((F.col("node") != F.col("hub")) & _similar_sizes(F.col("n"), F.col("hub_n"), percent) & _alike("hub_", percent))
    one = met.groupBy("node").agg(F.max(F.struct("hub_weight", "hub"))["hub"].alias("hub"))
    return one.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _main(lists: DataFrame) -> DataFrame:
    """(token, main, members): the component with most members of a list, and how many members it has; lists of one component are left out."""
    counts = lists.groupBy("token", "component").count().groupBy("token")
    return counts.agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("members"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")


def _central(lists: DataFrame, parts: int = 2) -> DataFrame:
    """(token, hub fields) of the member with the commonest tokens, of the lists with members of several components (with ``parts`` 1 of all)."""
    return lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by(F.struct("node", "n", "component", "weight", *SKETCHED), F.struct("weight", "node")).alias("hub")).where("low < high" if parts > 1 else "true").select("token", "hub.*")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, hub, added, removed, missing): how many shingles the node has that its hub lacks, and the other way round; the latter also by ``PARTS`` residues."""
    one = sets.select("node", F.col("shingles").alias("own"))
    two = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other"))
    lost = pairs.join(one, "node").join(two, "hub").select("node", "hub", F.size("own").alias("size"), F.size("other").alias("hub_size"), F.array_except("other", "own").alias("lost"))
    removed = F.size("lost")
    missing = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.size(F.filter("lost", lambda x: F.pmod(x, F.lit(PARTS)) == k)))
    return lost.select("node", "hub", (F.col("size") - F.col("hub_size") + removed).alias("added"), removed.alias("removed"), missing.alias("missing"))


def _banded(rows: DataFrame, percent: int, first: bool) -> DataFrame:
    """The rows under every (band_one, band_two, place) in which a set that may be linked can stand, as the first or the second of a pair.

    Linked sets are in the same band of sizes or in bands next to each other, and what they add
    to the hub and lack of it, taken together, differs by at most the largest difference of two linked sets of
    these bands: so they have the same place in steps of that width, or places next to each other (so the first stands in three). A pair meets once at most.
    """
    grows = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    own, other = ("band_one", "band_two") if first else ("band_two", "band_one")
    rows = rows.withColumn(own, F.floor(F.log(F.col("n").cast("double")) / grows)).withColumn(other, F.explode(F.array(*(F.col(own) + d for d in (-1, 0, 1)))))
    width = F.floor(2 * (100 - percent) / (100 + percent) * F.exp((F.greatest("band_one", "band_two") + 1) * grows)) + 1
    place = F.floor((F.col("added") + F.col("alone") + F.col("removed")) / width)
    return rows.withColumn("place", F.explode(F.array(place - 1, place, place + 1)) if first else place)


def _apart_pairs(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of members in different components that may be linked, at least one of them outside a list's main component.

    Long lists are searched by their hub, so members that meet in many lists of one hub meet once.
    """
    sized = written(lists.join(written(_main(lists), "lists-main"), "token"), "lists-sized")
    short = sized.where(F.col("members") <= LONG_LIST)
    pairs = _pairs(short.where("component != main"), short, percent)
    long = sized.where(F.col("members") > LONG_LIST)
    if not long.limit(1).count():
        return pairs
    own = written(sets.join(long.select("node").distinct(), "node", "left_semi"), "sets-apart")
    single = own.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = single.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    hubbed = long.join(written(_central(long).select("token", F.col("node").alias("hub")), "lists-hubs"), "token").groupBy("hub", "node", "n", "component", *SKETCHED).agg(F.max((F.col("component") != F.col("main")).cast("int")).alias("apart"))
    near = _distances(hubbed.select("node", "hub"), own)
    placed = hubbed.join(near, ["node", "hub"]).join(alone, "node", "left")
    # A hub's own single shingles are among what the others lack, so they don't count again.
    is_hub = F.col("node") == F.col("hub")
    known = placed.withColumn("alone", F.when(is_hub, 0).otherwise(F.coalesce("alone", F.lit(0)))).withColumn("added", F.col("added") - F.col("alone"))
    known = written(known.select("hub", "node", "n", "component", *SKETCHED, "apart", "alone", "added", "removed", "missing"), "lists-placed")
    # What no other set has is in the difference to any set: too much of it, and the node has no partner at all.
    largest = F.col("n") * (1 + 100 / percent)
    known = known.where(is_hub | ((100 + percent) * F.col("alone") <= (100 - percent) * largest + 1))
    one, two = _banded(known.where("apart = 1"), percent, True), _banded(known, percent, False)
    two = two.select("hub", "band_one", "band_two", "place", *(F.col(c).alias(f"other_{c}") for c in ("node", "n", "component", *SKETCHED, "apart", "alone", "added", "removed", "missing")))
    least = F.col("alone") + F.col("other_alone") + F.abs(F.col("added") - F.col("other_added"))
    by_parts = reduce(lambda x, y: x + y, (F.abs(F.get("missing", F.lit(k)) - F.get("other_missing", F.lit(k))) for k in range(PARTS)))
    room = (100 - percent) * (F.col("n") + F.col("other_n"))
    may = ((100 + percent) * (least + F.abs(F.col("removed") - F.col("other_removed"))) <= room) & ((100 + percent) * (least + by_parts) <= room)
    once = (F.col("other_apart") == 0) | (F.col("node") < F.col("other_node"))
    met = one.join(two, ["hub", "band_one", "band_two", "place"]).where((F.col("component") != F.col("other_component")) & once & _similar_sizes(F.col("n"), F.col("other_n"), percent) & _alike("other_", percent) & may)
    return pairs.union(met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(one, "a").join(two, "b").where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link (a, b).

    Each turn names every node by its smallest neighbour, if that is smaller, and links by the names of their ends; links inside one name are
    gone, so what a turn reads shrinks. Nodes are digests: their order has nothing to do with links, and chains of falling names are short.
    Names are followed from the last turn back.
    """
    turns = []
    while True:
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        named = written(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "components")
        turns.append(named)
        one, two = (named.select(F.col("node").alias(c), F.col("component").alias(f"name_{c}")) for c in ("a", "b"))
        met = links.join(one, "a").join(two, "b").where("name_a != name_b")
        links = written(met.select(F.least("name_a", "name_b").alias("a"), F.greatest("name_a", "name_b").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            break
    found = turns.pop()
    while turns:
        found = written(_renamed(turns.pop(), found), "components")
    return found


def _renamed(found: DataFrame, names: DataFrame) -> DataFrame:
    """``found`` (node, component) with each component by its own name, if it has one."""
    further = names.select(F.col("node").alias("component"), F.col("component").alias("further"))
    return found.join(further, "component", "left").select("node", F.coalesce("further", "component").alias("component"))


def _grown(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components with further links, of which only those between components are gone through."""
    if found is None:
        return components(links)
    one, two = (found.select(F.col("node").alias(c), F.col("component").alias(f"name_{c}")) for c in ("a", "b"))
    between = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("name_a", "a").alias("a"), F.coalesce("name_b", "b").alias("b"))
    names = components(written(between.where("a != b").distinct(), "links"))
    new = names.join(found.select("node"), "node", "left_anti")
    return written(_renamed(found, names).unionByName(new), "components")


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id = component_id). Sets are linked if 100 * intersection >= percent * union."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = written(rows.mapInArrow(_sign(shingle), "doc_id long, n long, node long, half long, signature array<int>"), "signatures")
    clashes = _clashes(signed)
    signed = _told_apart(signed, clashes)
    known = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = written(known.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("signature").alias("signature")), "nodes")
    postings = written(_postings(nodes, COORDINATES - match_threshold(percent) + 1), "postings")
    repeated = written(postings.groupBy("token").count().where("count > 1").select("token"), "tokens")
    active = postings.join(repeated, "token")
    wanted = nodes.join(active.select("node").distinct(), "node", "left_semi").select("node", F.col("first_id").alias("doc_id"))
    ids = written(wanted.select("doc_id").distinct(), "ids")
    chosen = rows.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST else ids, "doc_id", "left_semi")
    sets = written(_told_apart(chosen.mapInArrow(_full_sets(shingle), f"node long, half long, {' long, '.join(SKETCHED)} long, shingles array<long>"), clashes).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "sets")

    active = written(active.join(sets.select("node", *SKETCHED), "node"), "lists")
    found = tested = None
    for turn in range(HUB_ROUNDS + 2):
        if found is None:
            lists = active.withColumn("component", F.col("node"))
        else:
            lists = written(active.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "lists-named")
        if turn <= HUB_ROUNDS:
            outside = lists if turn < 2 else lists.join(written(_main(lists), "lists-main"), "token").where("component != main")
            hubs = written(_central(outside, 2 if turn < 2 else 1), "hubs")
            if turn == 1 and not hubs.limit(1).count():
                break  # no list has members of several components
            pairs = _pairs(lists, hubs, percent) if turn else _first_pairs(lists, hubs, percent)
        else:
            pairs = _apart_pairs(lists, sets, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        if turn and not pairs.limit(1).count():
            continue  # the last round finds pairs that no hub has
        tested = pairs if tested is None else tested.union(pairs)
        found = _grown(found, written(_confirmed(pairs, sets, percent), "confirmed"))

    named = nodes.select("node", "first_id").join(found, "node")
    names = named.groupBy("component").agg(F.min("first_id").alias("name"))
    of_node = named.join(names, "component").select("node", "name")
    alone = nodes.select("node", "first_id").join(of_node, "node", "left").select("node", F.coalesce("name", "first_id").alias("name"))
    out = signed.select("doc_id", "n", "node").join(alone, "node", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("name", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without the near duplicates: of each group the document with the smallest doc_id stays, all columns untouched."""
    (name,) = free_names(docs.columns, "dropped_id")
    dropped = near_groups(docs, doc_id=doc_id, text=text, **options).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col(doc_id).cast("long") == F.col(name), "left_anti")
