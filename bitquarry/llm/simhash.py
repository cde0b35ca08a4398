"""SimHash fingerprints and near-duplicate groups with pivot distance tables.

Exact form (``groups``): 64-bit fingerprints linked at two or fewer differing
bits.  A join needs a key, so pairs meet in blocks: of four 16-bit blocks two
differing bits leave two untouched, hence six keys of two blocks each.  Of the
pairs that meet, those whose distances to any of the reference fingerprints
(computed once for each fingerprint) differ by over two are discarded, as the
triangle inequality allows, and the survivors' bits are compared.  In a block
with more than ``cap`` fingerprints the table makes the candidates: its first two
coordinates, in steps of three, are cells, and pairs meet only in neighbouring
cells.  What is left are cells with more than ``cap``, whose members differ in
little: they are linked through the 65 values within one bit of each, since two
fingerprints are within two bits if and only if they share such a value, and no
value has over 65 of them.

Similar form (``similar_groups``): all links of the exact form, and those between
sets of word shingles of width five with a Jaccard similarity of at least 0.8.
The first come first, as above.  They miss pairs (at a similarity of 0.8
fingerprints differ in any number of bits), hence the second.  Their candidates
are exact: with shingles in one order, rare ones first, two similar sets share
one of their first fifth (a prefix).  Sizes, places and numbers of shared prefix
shingles thin them without a loss, in large groups also pivot tables and Hamming
distances of parity fingerprints, which never exceed the sets' own; the sets
themselves decide.  Pairs that fingerprints already connect are not compared.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitquarry.llm.components import components
from bitquarry.llm.tables import checked, cut

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Reference fingerprints; any fixed values will do.
PIVOTS = [xxhash.xxh64_intdigest(b"pivot", k) for k in range(8)]


def word_list(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered, as UTF-8; bytes.split() parts at 0x20 and 0x09-0x0D."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, ">u8")
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(text[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]), ">u8")


def majority(hashes: np.ndarray) -> bytes:
    """The fingerprint (big-endian) of 64-bit hashes: a bit is set if it is in over half of them."""
    each = hashes.astype(">u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + 256 * np.arange(8)
    counts = np.bincount(each.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return np.packbits(2 * counts.ravel() > len(hashes)).tobytes()


def _signed(data: bytes) -> int:
    return int.from_bytes(data, "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a signed long.  Null, empty and blank texts have zero."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(majority(shingle_hashes(word_list(t.as_py()), width))) for t in batch.column(1)]  # one text at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivot_row(fp: Column) -> Column:
    """The distances to the eight references, a byte each."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(PIVOTS):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_as_long(p)))).cast("long"), 8 * k))
    return out


def pivots_allow(a: Column, b: Column, most: int) -> Column:
    """Whether no coordinate of two pivot rows differs by over most."""
    at = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))
    return F.greatest(*(F.abs(at(a, k) - at(b, k)) for k in range(len(PIVOTS)))) <= most


def block_keys(fp: Column) -> Column:
    """The six (number of the pair of blocks, the two blocks) keys as longs."""
    block = lambda k: F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(0xFFFF))
    return F.array(*(F.shiftleft(block(i), 16).bitwiseOR(block(j)).bitwiseOR(F.lit(n << 32)) for n, (i, j) in enumerate(combinations(range(4), 2))))


def _near(pairs: DataFrame) -> DataFrame:
    """The pairs (a, pa, b, pb) within two bits: what the pivot table leaves is compared."""
    return pairs.where("a < b").where(pivots_allow(F.col("pa"), F.col("pb"), 2)).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).select("a", "b")


def links(fps: DataFrame, cap: int = 32) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints (column fp) within two bits of each other."""
    keyed = fps.select("fp", pivot_row(F.col("fp")).alias("pivots"), F.explode(block_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("shared"), "n")
    met = cut(keyed.join(sizes, keyed.key == sizes.shared).select("key", "fp", "pivots", "n"))
    small = met.where(F.col("n") <= cap)
    a, b = (small.select("key", F.col("fp").alias(x), F.col("pivots").alias(f"p{x}")) for x in "ab")
    pairs = _near(a.join(b, "key"))
    if met.where(F.col("n") > cap).isEmpty():
        return pairs
    # Distances that differ by two at most are in the same step of three or in the next one.
    step = lambda k: F.floor(F.shiftrightunsigned("pivots", 8 * k).bitwiseAND(F.lit(255)) / 3)
    placed = met.where(F.col("n") > cap).select("key", "fp", "pivots", step(0).alias("x"), step(1).alias("y"))
    counted = placed.groupBy("key", "x", "y").agg((F.count(F.lit(1)) > cap).alias("full"))
    placed = cut(placed.join(counted, ["key", "x", "y"]))
    around = F.explode(F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    a = placed.select("key", "x", "y", F.col("fp").alias("a"), F.col("pivots").alias("pa"), F.col("full").alias("fa"))
    b = placed.select("key", F.col("fp").alias("b"), F.col("pivots").alias("pb"), F.col("full").alias("fb"), around.alias("at")).select("key", "at.x", "at.y", "b", "pb", "fb")
    pairs = pairs.union(_near(a.join(b, ["key", "x", "y"]).where("not (fa and fb)")))
    full = placed.where("full").select("fp").distinct()
    # Shuffled before they are multiplied, so that a few tasks do not make all of them.
    near = full.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_as_long(1 << k))) for k in range(64)))).alias("value"))
    hubs = near.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most").select(F.col("value").alias("hub"), "b")
    stars = near.join(hubs, near.value == hubs.hub).where("fp > b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, cap: int = 32) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document.

    component_id is the smallest doc_id that links of two or fewer differing
    bits reach, the document's own included; null ids are passed over, and null
    only where a whole group has none.  Repeated rows and ids each give a row.
    Documents meet as distinct fingerprints, so copies make no pairs.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(distinct.select("fp"), cap))
    tied = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = tied.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "group")
    named = tied.join(smallest, tied.root == smallest.group).select(F.col("fp").alias("own"), "component_id")
    return fps.join(named, fps.fp == named.own).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similar groups ------------------------------------------------------------

#: Counters of the shingles' frequencies.  They only order shingles; a shared counter costs time, not pairs.
_CELLS = 1 << 21
_SURE = 1e-6
#: Width of the shingles of majority fingerprints, as in ``groups``.
_FP_WIDTH = 3
#: Bits of a parity fingerprint.
_PARITY = 512


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two ascending sets of hashes; empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def jaccard(a: str | None, b: str | None, width: int) -> float:
    """Of the sets of word shingles; texts without words are alike."""
    return _jaccard(*(np.unique(shingle_hashes(word_list(t), width)) for t in (a, b)))


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes, ascending, of each text (the second column)."""
    for t in batch.column(1):
        yield np.unique(shingle_hashes(word_list(t.as_py()), width).astype(np.uint64))


def _frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """In how many texts the shingles of each counter are.

    Each task counts its own texts; the counters are summed in two steps on the
    executors, one array at a time, and a single array reaches the driver.
    """
    most = 2**31 - 1

    def packed(counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.minimum(counts, most).astype(np.int32).tobytes(), 1)], pa.binary())], names=["counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            counts = np.zeros(_CELLS, np.int64) if counts is None else counts
            for s in _sets(batch, width):
                np.add.at(counts, (s % np.uint64(_CELLS)).astype(np.int64), 1)
        if counts is not None:
            yield packed(counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(zlib.decompress(x.as_py()), np.int32)
                counts = own.astype(np.int64) if counts is None else counts + own
        if counts is not None:
            yield packed(counts)

    parts = max(1, math.isqrt(docs.rdd.getNumPartitions()))
    total = docs.mapInArrow(count, "counts binary").repartition(parts).mapInArrow(add, "counts binary").repartition(1).mapInArrow(add, "counts binary").first()
    return np.zeros(_CELLS, np.int32) if total is None else np.frombuffer(zlib.decompress(total["counts"]), np.int32)


def parity(hashes: np.ndarray) -> np.ndarray:
    """The parity fingerprint of a set of hashes: bit j says whether an odd number of them fall to j.

    Two sets' fingerprints differ in no more bits than the sets in elements.
    """
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % _PARITY, minlength=_PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def parity_distance(a: Column, b: Column) -> Column:
    """Differing bits of two parity fingerprints."""
    out = F.lit(0)
    for k in range(_PARITY // 64):
        out = out + F.bit_count(a[k].bitwiseXOR(b[k]))
    return out


def parity_pivots(a: Column) -> Column:
    """The distances of a parity fingerprint to four references, 16 bits each."""
    out = F.lit(0).cast("long")
    for k in range(4):
        d = F.lit(0)
        for j in range(_PARITY // 64):
            d = d + F.bit_count(a[j].bitwiseXOR(F.lit(_as_long(xxhash.xxh64_intdigest(b"parity", 64 * k + j)))))
        out = out.bitwiseOR(F.shiftleft(d.cast("long"), 16 * k))
    return out


def _signatures(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(id, c0, c1, n, prefix, parity, fp): the shingle set's 128-bit hash and size, its rarest shingles, its parity and majority fingerprints.

    Of sets of n and at least similarity * n shared shingles, in one order of
    all shingles, the first n - ceil(similarity * n) + 1 have one in common.
    """
    frequency = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, width))
    schema = pa.schema([("id", pa.int64()), ("c0", pa.int64()), ("c1", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64())), ("fp", pa.int64())])

    def one(words: list[bytes]) -> tuple:
        s = np.unique(shingle_hashes(words, width).astype(np.uint64))
        content = xxhash.xxh3_128_digest(s.tobytes())
        order = np.lexsort((s, frequency.value[(s % np.uint64(_CELLS)).astype(np.int64)]))
        first = len(s) - math.ceil(similarity * len(s) - _SURE) + 1 if len(s) else 0
        return _signed(content[:8]), _signed(content[8:]), len(s), s[order[:first]].view(np.int64), parity(s), _signed(majority(shingle_hashes(words, _FP_WIDTH)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = zip(*(one(word_list(t.as_py())) for t in part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(map(list, columns), list(schema)[1:]))], schema=schema)

    return docs.mapInArrow(run, "id long, c0 long, c1 long, n int, prefix array<long>, parity array<long>, fp long")


def _fingerprint_roots(signed: DataFrame, nodes: DataFrame, cap: int) -> DataFrame:
    """(node, root) of the nodes that ``links`` of majority fingerprints connect; root is the smallest node.

    A node has several fingerprints if its texts repeat shingles differently.
    """
    owned = cut(signed.select("c0", "c1", "fp").distinct().join(nodes.select("c0", "c1", "node"), ["c0", "c1"]).select("node", "fp").distinct())
    found = cut(components(links(cut(owned.select("fp").distinct()), cap))).select(F.col("node").alias("was"), F.col("root").alias("is"))
    tied = cut(owned.join(checked(found), owned["fp"] == found["was"], "left").select(F.col("node").alias("a"), F.coalesce("is", "fp").alias("class")))
    heads = cut(tied.groupBy("class").agg(F.min("a").alias("b"), F.max("a").alias("most")).where("b < most").select("class", "b"))
    return cut(components(tied.join(checked(heads), "class").select("a", "b")))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, similarity: float, spread: int = 1024) -> DataFrame:
    """The pairs (a, b, ra, rb) whose texts' shingle sets are similar enough.

    Texts that no pair asks for are left out before the shuffle where the ids
    asked for are few enough to be broadcast (``checked``).  The pairs of one b
    meet its text in up to ``spread`` places, each of which has that text once
    and reads the other texts one after the other.
    """
    pairs = pairs.withColumn("place", F.pmod(F.xxhash64("a"), F.lit(spread)))
    none = F.lit(None).cast("long")
    asked = pairs.select(F.col("a").alias("of"), "b", "place", F.lit(1).alias("kind"), "a", "ra", "rb")
    asked = asked.union(pairs.select("b", "place").distinct().select("b", "b", "place", F.lit(0), none, none, none))
    docs = docs.join(checked(cut(asked.select(F.col("of").alias("id")).distinct()), 200_000), "id", "left_semi")
    rows = docs.join(asked, docs["id"] == asked["of"]).select("b", "place", "kind", "a", "ra", "rb", "text")
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "ra", "rb")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for batch in batches:
            bs, places, kinds = (batch.column(k).to_pylist() for k in range(3))
            keep = []
            for k, own in enumerate(_sets(batch.select([0, 6]), width)):
                if (bs[k], places[k]) != key:
                    key, centres = (bs[k], places[k]), []
                if not kinds[k]:
                    centres.append(own)
                elif any(_jaccard(own, x) >= similarity for x in centres):
                    keep.append(k)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (3, 0, 4, 5)], schema=schema)

    return rows.repartition("b", "place").sortWithinPartitions("b", "place", "kind").mapInArrow(run, "a long, b long, ra long, rb long")


def _met(nodes: DataFrame) -> DataFrame:
    """(token, node, n, at, rest, least) of each prefix shingle that several nodes have.

    rest is how many shingles come after the prefix, least the smallest of the nodes.
    """
    keyed = nodes.select("node", "n", (F.col("n") - F.size("prefix")).alias("rest"), F.posexplode("prefix").alias("at", "token"))
    shared = keyed.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select(F.col("token").alias("shared"), "least")
    return keyed.join(shared, keyed.token == shared.shared).select("token", "node", "n", "at", "rest", "least")


def _possible(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, ra, rb) of rows with sides (a, na, ata, resta, ra, ...) that their sizes and prefixes allow.

    Similar sets share at least similarity / (1 + similarity) of their added
    sizes.  At a shared shingle, no more are shared than the fewer before it and
    the fewer after it; nor more than those of the prefixes and the rest of one.
    """
    least = (F.col("na") + F.col("nb")) * F.lit(similarity / (1 + similarity)) - _SURE
    sizes = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - _SURE
    place = F.least("ata", "atb") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= least
    counted = pairs.where(sizes & place).groupBy("a", "b", "ra", "rb").agg(F.count(F.lit(1)).alias("shared"), F.min(least - F.greatest("resta", "restb")).alias("needed"))
    return counted.where("shared >= needed").select("a", "b", "ra", "rb")


def _side(met: DataFrame, x: str) -> DataFrame:
    return met.select("token", F.col("node").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "at", "rest")), F.col("root").alias(f"r{x}"))


#: Groups of a shingle above this size meet some of their nodes first, and then with fingerprints.
_CROWD = 16


def _crowd(roots: DataFrame) -> float:
    """Pairs of unlinked nodes in large groups, for each row of groups that have any."""
    each = roots.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
    pairs = (F.col("m") * F.col("m") - F.col("own")) / 2
    r = each.where("m * m > own").agg(F.sum("m").alias("rows"), F.sum(F.when(F.col("m") > _CROWD, pairs)).alias("pairs")).first()
    return (r["pairs"] or 0) / (r["rows"] or 1)


def _pivots(roots: DataFrame, salt: int, many: int = 6) -> DataFrame:
    """Rows of some nodes of each large group that is not linked as a whole, picked by hashes."""
    groups = roots.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), *(F.min(F.struct(F.xxhash64("node", F.lit(many * salt + k)).alias("h"), "node", "n", "at", "rest", "root")).alias(f"p{k}") for k in range(many))
    )
    picked = groups.where((F.col("m") > _CROWD) & (F.col("low") < F.col("high"))).select("token", F.explode(F.array_distinct(F.array(*(F.col(f"p{k}").dropFields("h") for k in range(many))))).alias("p"))
    return picked.select("token", "p.*")


def _all_pairs(roots: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Rows of all pairs of unlinked nodes that share a shingle, for _possible.

    In large groups a pair is made only if fingerprints allow it: similar sets
    differ in at most (1 - similarity) / (1 + similarity) of their added sizes,
    so neither do their parity fingerprints differ in more bits, nor the
    distances of these to the references.
    """
    apart = cut(roots.join(roots.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token", "m"), "token"))
    few, crowd = apart.where(F.col("m") <= _CROWD), apart.where(F.col("m") > _CROWD)
    own = nodes.join(crowd.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("parity").alias("parity"), F.count(F.lit(1)).alias("sets"))
    # An id with several texts has several sets; it is left to the comparison of texts.
    crowd = cut(crowd.join(checked(cut(own.withColumn("pivots", parity_pivots(F.col("parity"))))), "node"))
    a, b = (crowd.select("token", F.col("node").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "at", "rest", "parity", "pivots", "sets")), F.col("root").alias(f"r{x}")) for x in "ab")
    most = (F.col("na") + F.col("nb")) * F.lit((1 - similarity) / (1 + similarity)) + _SURE
    at = lambda c, k: F.shiftrightunsigned(c, 16 * k).bitwiseAND(F.lit(0xFFFF))
    table = F.greatest(*(F.abs(at(F.col("pivotsa"), k) - at(F.col("pivotsb"), k)) for k in range(4))) <= most
    near = table & (parity_distance(F.col("paritya"), F.col("parityb")) <= most)
    apart_of = F.col("a") > F.col("b"), F.col("ra") != F.col("rb")
    many = a.join(b, "token").where(apart_of[0] & apart_of[1] & (near | (F.col("setsa") + F.col("setsb") > 2)))
    some = _side(few, "a").join(_side(few, "b"), "token").where(apart_of[0] & apart_of[1])
    return some.unionByName(many.select(*some.columns))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, most_rounds: int = 6, cap: int = 32) -> DataFrame:
    """(id, group_id) of each id that has a copy or a near copy with a smaller or larger id.

    group_id is the smallest id of the group, that id's own row included.  Rows
    of equal shingle sets are one node; texts without words are one node too.
    First come the links of majority fingerprints within two bits, found as in
    ``groups``.  Then all pairs of nodes that share a shingle of their prefixes
    and may be similar are compared, except pairs that earlier links already
    connect: each node meets the smallest node of each of its shingles; then, as long as that
    links much of what large groups still have apart, the nodes of these meet a
    few picked ones; at last all pairs that are left are made.  Null ids take no
    part; rows that share an id are one document.  An empty table gives no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    signed = cut(_signatures(d, width, similarity))
    nodes = cut(signed.groupBy("c0", "c1").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"), F.min("prefix").alias("prefix"), F.min("parity").alias("parity")))
    first = _fingerprint_roots(signed, nodes, cap)
    at, met = first.select(F.col("node").alias("was"), F.col("root").alias("is")), _met(nodes)
    roots = cut(met.join(checked(at), met["node"] == at["was"], "left").select(*met.columns, F.coalesce("is", "node").alias("root")))

    def linked(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        """roots after the links of those pairs that are similar."""
        links = _verified(cut(_possible(pairs, similarity)), d, width, similarity).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = cut(components(links)).select(F.col("node").alias("was"), F.col("root").alias("is"))
        return cut(roots.join(checked(found), roots["root"] == found["was"], "left").select("token", "node", "n", "at", "rest", "least", F.coalesce("is", "root").alias("root")))

    roots = linked(roots, _side(roots, "a").join(_side(roots.where("node = least"), "b"), "token").where("a > b and ra <> rb"))
    left = _crowd(roots)
    for salt in range(most_rounds):
        if left <= _CROWD:
            break
        roots = linked(roots, _side(roots, "a").join(_side(_pivots(roots, salt), "b"), "token").where("ra <> rb"))
        before, left = left, _crowd(roots)
        if left > before / 2:
            break
    roots = linked(roots, _all_pairs(roots, nodes, similarity))
    # Nodes that only fingerprints link need not have a row in roots.
    named = components(first.union(roots.select("node", "root")).toDF("a", "b")).select(F.col("node").alias("own"), "root")
    tied = nodes.select("c0", "c1", "node", "copies").join(named, F.col("node") == F.col("own"), "left")
    tied = tied.where("copies > 1 or root is not null").select("c0", "c1", F.coalesce("root", "node").alias("group_id"))
    return signed.select("id", "c0", "c1").join(tied, ["c0", "c1"]).select("id", "group_id")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without all but the smallest id of each group of near copies; null ids stay.

    Rows that share an id are one document and stay or go together.
    """
    gone = cut(similar_groups(docs, id_col, text_col, **how).where("id <> group_id").select(F.col("id").alias("_gone")).distinct())
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
