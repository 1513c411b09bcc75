"""Exact Jaccard join of documents on word n-grams: a grouped prefix join.

A document's set is that of its distinct shingles.  Sets are in one order of all
shingles (those known to be frequent last, the rest by hash), and two sets that are
similar enough share a shingle in their prefixes.

1. Equal sets are one node.  Nodes with equal prefixes and sizes are one group.
2. Groups that share a prefix shingle are candidates if their sizes and the shingle's
   positions allow enough overlap.
3. Candidates expand to pairs of nodes; a parity sketch (each shingle flips one of
   SKETCH_BITS bits, so differing bits bound the difference from below) drops most,
   and the exact overlap of the rest decides.

Pairs are verified in two steps, which keeps them few in a large group of near
copies: first each group with the pivot of each of its prefix shingles (the group in
which that shingle stands first), then pairs across the components found so far.
Components need no more links, so of each two the most alike pair is compared first, and the
others only if they are still apart.  In the second step a shingle of more than FEW groups is
compared node by node, in cells of bounded size, by components and sketches before anything is emitted.
Of two sets the smaller one has their first common shingle in its short prefix (that of
a partner of its own size), so only short prefixes meet all prefixes: documents that share
a frequent passage and are too different to be linked over it don't meet at all, as
frequent shingles are last.

The frequent shingles are those that stand HEAVY_COUNT times or more in prefixes by hash,
MAX_HEAVY of them at most; their choice changes cost only, never results.  Frequent
shingles are aggregated before they are joined; no group is collected.

Defined results: texts without words (null ones too) have no set and no links; a text
with fewer words than a shingle has one shingle, all its words; rows with one doc_id
are judged one by one and linked if similar; a row without a doc_id links like any other
and has the component's smallest doc_id, null if none of it has one; very long texts are
handled alone; an empty table gives no rows.  Shingles are compared by 64-bit
fingerprints within a pair of sets, whole sets by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._words import Words, mix, sliced, spans_hash, windows, words_of
from ._work import Filter, batched, discarded, settled, table
from .components import components

HEAVY_COUNT, MAX_HEAVY = 32, 1 << 17
FEW, HEADS = 64, 16
#: Nodes of one chunk of a shingle of many groups, compared with another chunk at once.
CELL = 8192
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; linked if scale * intersection >= share * union."""

    width: int = 4
    share: int = 85
    scale: int = 100

    def least(self, n: np.ndarray | int) -> np.ndarray | int:
        """The smallest overlap of a set of n with any similar set."""
        return -(-self.share * n // self.scale)

    def short(self, n: Column, at: Column) -> Column:
        """Whether a shingle at this place of a set of n can be the first one that it shares with a similar set of n shingles or more."""
        return (n - at) * (self.share + self.scale) >= 2 * n * self.share

    def overlaps(self, overlap: Column, a: Column, b: Column) -> Column:
        """Whether so much overlap links sets of sizes a and b."""
        return overlap * (self.share + self.scale) >= (a + b) * self.share

    def sizes(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * self.scale >= F.greatest(a, b) * self.share)

    def sketches(self, a: Column, b: Column, na: Column, nb: Column) -> Column:
        """Whether the sketches allow the difference that a link allows."""
        return differing(a, b) * (self.share + self.scale) <= (na + nb) * (self.scale - self.share)


def differing(a: Column, b: Column) -> Column:
    """The bits in which two sketches differ."""
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, SKETCH_WORDS)), F.bit_count(a[0].bitwiseXOR(b[0])))


def shingles(w: Words, i: int, width: int) -> np.ndarray:
    """The distinct shingles of text i, ascending."""
    words = w.hash[w.first[i] : w.first[i + 1]]
    if 0 < len(words) < width:
        return spans_hash(words, np.array([0]), np.array([len(words)]), width)
    return np.unique(windows(words, width))


def signature(found: np.ndarray) -> bytes:
    """128 bits that stand for a run of shingles."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _tag(sig: bytes) -> int:
    """Half of them, as a signed number."""
    return int.from_bytes(sig[:8], "little", signed=True)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.empty(0, np.int64), *[p.view(np.int64) for p in parts]])))


def _each(docs: DataFrame, schema: str, rule: Rule, make: Callable[[list[int | None], list[int], list[np.ndarray]], list[pa.Array]], among: Filter | None = None) -> DataFrame:
    """make(doc_ids, keys, sets) over slices of docs. A row's key is a hash of its id and text; among: rows with other keys aren't read."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if among is not None:
                batch = among.keep(batch, 2)
            ids, texts, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in sliced(texts):
                w = words_of(texts[a:b], lower=True)
                yield pa.RecordBatch.from_arrays(make(ids[a:b], keys[a:b], [shingles(w, k, rule.width) for k in range(b - a)]), names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return batched(rows.withColumn("key", F.xxhash64("doc_id", "text")), run, schema)


def heavy_shingles(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, ascending, and their counts in prefixes by hash."""

    def prefixes(ids: list[int | None], keys: list[int], sets: list[np.ndarray]) -> list[pa.Array]:
        return [_lists([s[: len(s) - rule.least(len(s)) + 1] for s in sets])]

    counts = _each(docs, "prefix array<long>", rule, prefixes).select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    found = counts.where(F.col("n") >= HEAVY_COUNT).orderBy(F.desc("n"), "shingle").limit(MAX_HEAVY).toArrow()
    key, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def profiles(docs: DataFrame, rule: Rule, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, key, n (set size), sig, tag (of sig), prefix, light (prefix shingles that aren't frequent), prefix_sig and sketch of each row."""
    key, count = heavy

    def make(ids: list[int | None], keys: list[int], sets: list[np.ndarray]) -> list[pa.Array]:
        prefixes, light, sketches = [], [], []
        for s in sets:
            rank = np.zeros(len(s), np.int64)
            if len(key) and len(s):
                at = np.minimum(np.searchsorted(key, s), len(key) - 1)
                rank = np.where(key[at] == s, count[at], 0)
            p = len(s) - rule.least(len(s)) + 1 if len(s) else 0
            order = np.argsort(rank, kind="stable")[:p]
            prefixes.append(s[order])
            light.append(int((rank[order] == 0).sum()))
            bits = np.bincount((mix(s ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
            sketches.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
        sigs = [signature(s) for s in sets]
        return [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sigs, pa.binary()), pa.array([_tag(x) for x in sigs], pa.int64()), _lists(prefixes), pa.array(light, pa.int32()), pa.array([signature(p) for p in prefixes], pa.binary()), _lists(sketches)]

    return _each(docs, "doc_id long, key long, n int, sig binary, tag long, prefix array<long>, light int, prefix_sig binary, sketch array<long>", rule, make)


def wide_sketch(found: np.ndarray) -> bytes:
    """A parity sketch of four bits or more a shingle."""
    width = max(10, (4 * len(found)).bit_length())
    bits = np.bincount((mix(found ^ np.uint64(0x1F83D9ABFB41BD6B)) >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """In how many shingles two sets differ at least. A wider sketch is folded: neighbouring bits share the place that they have in a narrower one."""
    x, y = (np.unpackbits(np.frombuffer(w, np.uint8)) for w in (a, b))
    while len(x) > len(y):
        x = x[::2] ^ x[1::2]
    while len(y) > len(x):
        y = y[::2] ^ y[1::2]
    return int((x ^ y).sum())


#: What names a node's set: the key of its row and the tag of its set.
NAMES = ("akey", "atag", "bkey", "btag")


def verified(pairs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b: nodes; NAMES) whose sets are similar enough, exactly. The sets are made again from the texts of the nodes' own documents."""
    pairs = settled(pairs.select("a", "b", *NAMES), "pairs")
    asked = settled(pairs.select(F.col("akey").alias("key")).union(pairs.select("bkey")).distinct(), "asked")

    def make(ids: list[int | None], keys: list[int], sets: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array(keys, pa.int64()), pa.array([_tag(signature(s)) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([wide_sketch(s) for s in sets], pa.binary()), _lists(sets)]

    sets = settled(_each(docs, "key long, tag long, n int, wide binary, shingles array<long>", rule, make, Filter(asked, "key")), "sets")
    if not sets.groupBy("key", "tag").count().where("count > 1").isEmpty():  # repeated rows: one of each, or a pair would be compared as often as it stands there
        every, sets = sets, settled(sets.dropDuplicates(["key", "tag"]), "sets")
        discarded(every)
    # Wide sketches first: they are a tenth of the sets, and few pairs of long documents pass them without being similar.
    sides = [sets.select(F.col("key").alias(f"{x}key"), F.col("tag").alias(f"{x}tag"), F.col("n").alias(f"{x}n"), F.col("wide").alias(f"{x}wide")) for x in "ab"]
    wide = pairs.join(sides[0], ["akey", "atag"]).join(sides[1], ["bkey", "btag"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = batch.column("awide").to_pylist(), batch.column("bwide").to_pylist(), batch.column("an").to_numpy().astype(np.int64) + batch.column("bn").to_numpy()
            least = np.array([unlike(a, b) for a, b in zip(x, y, strict=True)], np.int64)
            yield batch.filter(pa.array(least * (rule.share + rule.scale) <= n * (rule.scale - rule.share))).select(["a", "b", *NAMES])

    close = settled(batched(wide, alike, "a long, b long, akey long, atag long, bkey long, btag long"), "alike")
    left = close.join(sets.select(F.col("key").alias("akey"), F.col("tag").alias("atag"), F.col("shingles").alias("x")), ["akey", "atag"])
    both = left.join(sets.select(F.col("key").alias("bkey"), F.col("tag").alias("btag"), F.col("shingles").alias("y")), ["bkey", "btag"])
    links = settled(both.where(rule.overlaps(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b"), "links")
    discarded(pairs, asked, sets, close)
    return links


def _allowed(rule: Rule, a: str, b: str) -> Column:
    """Whether sizes and positions of a common prefix shingle allow a link; a and b: prefixes of the columns n and at."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    return rule.sizes(na, nb) & rule.overlaps(F.least(na - F.col(f"{a}at"), nb - F.col(f"{b}at")), na, nb)


def _met(x: dict[str, np.ndarray], y: dict[str, np.ndarray], rule: Rule) -> np.ndarray:
    """Which of each x with each y are still apart, in order, and allowed a link by sizes, positions and sketches."""
    x, both = {c: v[:, None] for c, v in x.items() if c != "sketch"} | {"sketch": x["sketch"]}, rule.share + rule.scale
    total = x["n"] + y["n"]
    met = (x["root"] != y["root"]) & (np.minimum(x["n"], y["n"]) * rule.scale >= np.maximum(x["n"], y["n"]) * rule.share)
    met &= np.minimum(x["n"] - x["at"], y["n"] - y["at"]) * both >= total * rule.share
    inside, first = x["own"] & y["own"] & (x["row"] < y["row"]), (x["n"] < y["n"]) | (x["n"] == y["n"]) & (x["gid"] < y["gid"])
    met &= np.where(x["gid"] == y["gid"], inside, first & ~x["own"] & ~y["own"])
    i, j = np.nonzero(met)
    if 4 * len(i) < met.size:
        unlike = np.empty(len(i), np.int64)
        for low in range(0, len(i), 1 << 16):
            part = slice(low, low + (1 << 16))
            unlike[part] = np.bitwise_count(x["sketch"][i[part]] ^ y["sketch"][j[part]]).sum(axis=1)
    else:
        bits = np.zeros(met.shape, np.uint16)
        for k in range(SKETCH_WORDS):
            bits += np.bitwise_count(x["sketch"][:, k, None] ^ y["sketch"][None, :, k])
        unlike = bits[i, j].astype(np.int64)
    kept = unlike * both <= total[i, j] * (rule.scale - rule.share)
    return np.stack([i[kept], j[kept], unlike[kept]])


def crossed(many: DataFrame, rule: Rule) -> DataFrame:
    """Candidates among the nodes that meet at a shingle. A shingle's nodes are dealt into chunks of about CELL, and each pair of
    chunks is one group of rows, compared in arrays: a pair costs some 50 ns, where the same test in a join's condition took 6 µs."""
    chunks = many.groupBy("shingle").agg(F.ceil(F.count("*") / CELL).cast("int").alias("chunks"))
    rows = many.join(chunks, "shingle").withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("cell", F.explode(F.expr("concat(transform(sequence(0, chunks - 1), k -> struct(chunk as i, k as j)), transform(filter(sequence(0, chunks - 1), k -> k != chunk), k -> struct(k as i, chunk as j)))")))
    rows = rows.withColumn("isx", F.col("short") & (F.col("cell.i") == F.col("chunk"))).withColumn("isy", F.col("cell.j") == F.col("chunk")).where("isx or isy")
    numbers = ("row", "n", "at", "gid", "root", "key", "tag", "own")
    names = ["a", "b", *NAMES, "low", "high", "unlike"]

    def run(cell: pa.Table) -> pa.Table:
        held = {c: cell.column(c).to_numpy() for c in (*numbers, "isx", "isy")}
        held = {c: v if v.dtype == bool else v.astype(np.int64) for c, v in held.items()}
        held["sketch"] = cell.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
        xs, ys = np.flatnonzero(held["isx"]), np.flatnonzero(held["isy"])
        y, found = {c: v[ys] for c, v in held.items()}, [np.empty((3, 0), np.int64)]
        step = max(1, (1 << 18) // max(1, len(ys)))
        for low in range(0, len(xs), step):
            i, j, unlike = _met({c: v[xs[low : low + step]] for c, v in held.items()}, y, rule)
            found.append(np.stack([xs[low + i], ys[j], unlike]))
        i, j, unlike = np.concatenate(found, axis=1)
        if len(i):  # a pair meets at its first common shingle only, as far as the heads tell
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            before = [set(b) for b in cell.column("before").take(pa.array(used)).to_pylist()]
            new = np.array([before[p].isdisjoint(before[q]) for p, q in zip(place[: len(i)].tolist(), place[len(i) :].tolist(), strict=True)], bool)
            i, j, unlike = i[new], j[new], unlike[new]
        roots = held["root"][i], held["root"][j]
        columns = [held["row"][i], held["row"][j], *(held[c][k] for k in (i, j) for c in ("key", "tag")), np.minimum(*roots), np.maximum(*roots), unlike / np.maximum(1, held["n"][i] + held["n"][j])]
        return pa.table(dict(zip(names, map(pa.array, columns), strict=True)))

    rows = rows.select("shingle", "cell.i", "cell.j", *numbers, "isx", "isy", "before", "sketch")
    return rows.groupBy("shingle", "i", "j").applyInArrow(run, ", ".join(f"{c} {'double' if c == 'unlike' else 'long'}" for c in names))


def _named(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}{c}") for c in names])


def _merged(top: DataFrame, links: DataFrame) -> DataFrame:
    """row and root of all nodes, after links (a settled table, gone afterwards) have joined components."""
    bridges = links.join(_named(top, "a", "row", "root"), F.col("a") == F.col("arow")).join(_named(top, "b", "row", "root"), F.col("b") == F.col("brow")).select(F.col("aroot").alias("a"), F.col("broot").alias("b"))
    joined = components(bridges).select(F.col("node").alias("root"), F.col("root").alias("upper"))
    merged = settled(top.join(joined, "root", "left").select("row", F.coalesce("upper", "root").alias("root")), "roots")
    discarded(links)
    return merged


def linked(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, sig and component_id (smallest doc_id reachable by links) of each row of docs (doc_id, text)."""
    rows = settled(profiles(docs, rule, heavy_shingles(docs, rule)).withColumn("row", F.monotonically_increasing_id()), "profiles")
    nodes = settled(rows.where("n > 0").groupBy("sig", "n", "prefix_sig").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row")), "nodes")
    # What is joined is written first: then both sides of a join are plain exchanges, and Spark can split a large key.
    groups = settled(nodes.groupBy("prefix_sig", "n").agg(F.min("row").alias("gid")), "groups")
    # Which nodes each group has.
    members = nodes.join(groups, ["prefix_sig", "n"]).select("gid", "n", "doc_id", "row")
    members = settled(members.join(rows.select("row", "key", "tag", "sketch"), "row"), "members")
    discarded(groups)

    # Prefix shingles that two groups or more share, with the pivot: the group in which the shingle stands first.
    entries = rows.select("row", "prefix", "light").join(members.where("row = gid").select("gid", "n", "row"), "row")
    entries = entries.select("gid", "n", "light", F.posexplode("prefix").alias("at", "shingle"))
    entries = entries.withColumn("short", rule.short(F.col("n"), F.col("at")))
    place, over = F.struct("at", "n", "gid"), Window.partitionBy("shingle")
    light = entries.where("at < light").select("shingle", "gid", "n", "at", "short")
    light = light.withColumn("groups", F.count("*").over(over)).withColumn("pivot", F.min(place).over(over)).withColumn("any", F.max("short").over(over)).where("groups > 1 and any").drop("any")
    heavy = entries.where("at >= light").select("shingle", "gid", "n", "at", "short")
    pivots = heavy.groupBy("shingle").agg(F.count("*").alias("groups"), F.min(place).alias("pivot"), F.max("short").alias("any")).where("groups > 1 and any").drop("any")
    shared = settled(light.unionByName(heavy.join(pivots, "shingle")), "shared")
    named_rows = settled(rows.select("doc_id", "n", "sig"), "rows")
    discarded(rows)

    # First step: each group with its pivots, and each member of a group with the group's own node.
    flat = shared.select("gid", "n", "at", "short", F.col("pivot.gid").alias("pgid"), F.col("pivot.n").alias("pn"), F.col("pivot.at").alias("pat")).where("gid != pgid")
    meets = F.when(F.col("n") < F.col("pn"), F.col("short")).otherwise(rule.short(F.col("pn"), F.col("pat")))
    star = settled(flat.where(meets & _allowed(rule, "", "p")).select("gid", "pgid").distinct(), "star")
    own = members.select("gid", *[F.col(c).alias(f"b{c}") for c in ("row", "n", "key", "tag", "sketch")])
    pairs = star.join(own, "gid").unionByName(own.where("brow != gid").withColumn("pgid", F.col("gid")))
    pairs = pairs.join(_named(members.where("row = gid"), "a", "row", "n", "key", "tag", "sketch"), F.col("pgid") == F.col("arow"))
    pairs = pairs.where(rule.sketches(F.col("asketch"), F.col("bsketch"), F.col("an"), F.col("bn")))
    links = verified(pairs.select(F.col("arow").alias("a"), F.col("brow").alias("b"), *NAMES), docs, rule)
    roots = components(links)
    discarded(star, links)

    # Second step: what is still apart.
    state = settled(members.join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), "state")
    discarded(members)
    sides = ("row", "n", "key", "tag", "sketch", "root")
    apart = (F.col("xroot") != F.col("yroot")) & rule.sketches(F.col("xsketch"), F.col("ysketch"), F.col("xn"), F.col("yn"))
    first = (F.col("xn") < F.col("yn")) | (F.col("xn") == F.col("yn")) & (F.col("xgid") < F.col("ygid"))
    few = shared.where(F.col("groups") <= FEW)
    few = _named(few.where("short"), "x", "shingle", "gid", "n", "at").join(_named(few, "y", "shingle", "gid", "n", "at"), (F.col("xshingle") == F.col("yshingle")) & first & _allowed(rule, "x", "y"))
    few = few.select("xgid", "ygid").distinct()
    few = few.join(_named(state, "x", "gid", *sides), "xgid").join(_named(state, "y", "gid", *sides), "ygid").where(apart)
    many = shared.where(F.col("groups") > FEW).select("shingle", "gid", "at", "short").join(state, "gid")
    mixed = many.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("short").alias("any")).where("any and low != high").select("shingle")
    many = many.join(mixed, "shingle")
    # A pair meets at its first common shingle only, as far as the first HEADS of each group tell.
    heads = many.select("gid", "at", "shingle").distinct().groupBy("gid").agg(F.slice(F.sort_array(F.collect_list(F.struct("at", "shingle"))), 1, HEADS).alias("heads"))
    before = F.transform(F.filter("heads", lambda h: h["at"] < F.col("at")), lambda h: h["shingle"])
    many = many.join(heads, "gid").select("shingle", "at", "short", before.alias("before"), "gid", *sides, F.lit(False).alias("own"))
    # Members of one group meet under the group's id.
    several = state.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gid")
    inside = state.join(several, "gid", "left_semi").select(F.xxhash64("gid").alias("shingle"), F.lit(0).alias("at"), F.lit(True).alias("short"), F.array().cast("array<long>").alias("before"), "gid", *sides, F.lit(True).alias("own"))
    many = settled(many.unionByName(inside), "many")
    pair = [F.col("xrow").alias("a"), F.col("yrow").alias("b"), *[F.col(f"{x}{c}").alias(f"{y}{c}") for x, y in ("xa", "yb") for c in ("key", "tag")]]
    pair += [F.least("xroot", "yroot").alias("low"), F.greatest("xroot", "yroot").alias("high"), (differing(F.col("xsketch"), F.col("ysketch")) / (F.col("xn") + F.col("yn"))).alias("unlike")]
    candidates = settled(few.select(*pair).unionByName(crossed(many, rule)).distinct(), "candidates")
    discarded(shared, many)
    # Of two components the most alike pair first: it most likely joins them, and then the others needn't be compared.
    best = candidates.groupBy("low", "high").agg(F.min_by(F.struct("a", "b", *NAMES), "unlike").alias("best")).select("best.*")
    best = settled(best, "best")
    top = _merged(state.select("row", "root"), verified(best, docs, rule))
    rest = candidates.join(best.select("a", "b"), ["a", "b"], "left_anti").join(_named(top, "a", "row", "root"), F.col("a") == F.col("arow")).join(_named(top, "b", "row", "root"), F.col("b") == F.col("brow")).where("aroot != broot")
    between, top = top, _merged(top, verified(rest, docs, rule))
    discarded(candidates, best, between)
    named = state.select("row", "doc_id").join(top, "row")
    smallest = settled(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    named = named.join(smallest, "root").select(F.col("row").alias("node"), "component_id")
    of_sig = settled(nodes.select("sig", F.col("row").alias("node")).join(named, "node").select("sig", "component_id"), "components")
    discarded(nodes, state, top, smallest)
    return named_rows.join(of_sig, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "sig", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of docs that are the smallest of their component, in all their columns; of rows with equal id and text one. Rows without an id stay, as nothing tells which is the smallest."""
    found = linked(docs, rule)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
