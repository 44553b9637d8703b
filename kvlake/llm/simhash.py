"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64-bit majorities over the XXH64 of word shingles.  Candidates
come from covering masks: with radius r every bit position gets a non-zero vector
m(i) of r + 1 bits, and table v (any non-zero vector) compares only the positions
with <m(i), v> = 1.  For at most r differing positions there is a v orthogonal to
all their vectors, so such a pair agrees on every compared bit of table v: all pairs
within the radius collide in one of the 2^(r+1) - 1 tables, with certainty.

Equal fingerprints are grouped first, with partial aggregation, so copies never meet
in a table.  Buckets of up to ``BUCKET`` different fingerprints are compared inside a
row.  The fingerprints of larger buckets are linked exactly by another way: within
radius 2 two of them share a fingerprint at distance one or less from both, and at
most 65 fingerprints lie within distance one of any; no bucket is ever compared pair
by pair beyond that bound.  Components come from alternating star contractions over
links, in checkpointed rounds.

A pair of texts whose word shingles have a Jaccard similarity of 0.8 differs in some ten of
the 64 bits, beyond any radius that has few tables.  So ``keep_one_similar`` connects what the
covering tables find, verified on the shingles, and takes the pairs beyond the radius from the
shingles themselves, by prefix filtering, which misses none: in one order of all
shingles, two sets of that similarity have one in common among the first fifth of either.
The order puts those last that a sample shows to be frequent; it changes how many texts
meet at a shingle, never which pairs are found.  All candidates are verified.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, LOWER_BYTES, add_columns, blobs, cut, free_names, importable, join_salted, join_spread, sliced

SEED = 42
SHINGLE = 3
RADIUS = 2
BUCKET = 16
_BLOCK = 1 << 16
#: Similar texts: shingle length and least similarity.
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
#: What orders the shingles: so many texts are sampled, and so many of their frequent shingles come last.
SAMPLE_NODES = 8_000
FREQUENT = 1 << 17
#: Words of 64 bits, at least, that bound what two sets have in common.
PARITY = 8
#: Rounds that compare with one text a shingle before what is not connected is compared exhaustively.
STARS = 4
#: Rows of (node, key) that may be broadcast, 16 bytes or so each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    every = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(every), _BLOCK):
        part = every[i : i + _BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(every), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """All columns and the fingerprint; null texts count as empty."""
    return add_columns(
        docs, text_col, lambda texts: {name: [fingerprint(t, shingle) for t in texts]}, {name: pa.int64()}, f"`{name}` bigint"
    )


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The compared positions of each table; the vectors go round the positions."""
    tables = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % tables + 1) & v).bit_count() & 1) for v in range(1, tables + 1)
    ]


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints at ``radius`` or fewer differing bits:
    enough of them to connect what is connected.  ``fps`` has distinct ``fp``."""
    if radius != 2:
        raise ValueError("larger buckets are linked exactly for radius 2 only")
    tables = F.array(*(
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(covering_masks(radius))
    ))
    placed = fps.select("fp", F.explode(tables).alias("at")).select("fp", "at.t", "at.key")
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(placed.join(sizes, ["t", "key"]))
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    small = (
        members.where(F.col("n") <= bucket)
        .groupBy("t", "key")
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
        .select(F.explode(F.expr(
            f"flatten(transform(fps, a -> transform(filter(fps, b -> a < b and bit_count(a ^ b) <= {radius}), b -> struct(a as a, b as b))))"
        )).alias("link"))
        .select("link.a", "link.b")
    )
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    large = (
        members.where(F.col("n") > bucket)
        .select("fp")
        .distinct()
        .select("fp", F.explode(flips).alias("near"))
        .groupBy("near")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a < b")
    )
    return small.union(large).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star contractions; each round is checkpointed and
    the number of rounds grows with the logarithm of the largest component.
    """
    state = cut(edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).where("root < node").distinct())
    mark = None
    for _ in range(rounds):
        now = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or now == mark:
            break
        mark = now
        both = state.select(F.col("root").alias("u"), F.col("node").alias("v")).union(state.select("node", "root"))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")))
        large = join_spread(both, least, "u", "n", 2 * now["n"]).where("v > u").select(F.col("m").alias("root"), F.col("v").alias("node")).where("root < node")
        large = cut(large.distinct())
        least = cut(large.groupBy("node").agg(F.min("root").alias("m"), F.count("*").alias("n")))
        small = join_spread(large, least, "node", "n", 2 * now["n"]).select(
            F.explode(F.array(F.struct(F.col("m").alias("root"), "node"), F.struct(F.col("m").alias("root"), F.col("root").alias("node")))).alias("e")
        )
        state = cut(small.select("e.root", "e.node").where("root < node").distinct())
    else:
        raise RuntimeError("components did not settle")
    return state.select("node", "root").union(state.select(F.col("root").alias("node"), "root").distinct())


def cluster(narrow: DataFrame, id_col: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(fp, n, root, component_id) of every fingerprint of ``narrow`` (id, fp); n is its number of
    rows, root the component's smallest fingerprint, component_id the smallest id of all rows
    reachable over links (null if these are all null)."""
    own = cut(narrow.groupBy("fp").agg(F.min(id_col).alias("own"), F.count("*").alias("n")))
    found = cut(components(links(own.select("fp"), radius)).withColumnRenamed("node", "fp"))
    joined = cut(found.join(own.drop("n"), "fp"))
    least = cut(joined.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("rows")))
    linked = join_spread(joined, least, "root", "rows", joined.count()).select("fp", "root", "least")
    name = F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("least"))
    return own.join(linked, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), name.alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) of every row.

    Texts without words, null ones too, have fingerprint zero and are linked like any
    other.  Null ids are rows like any other and never a component's name unless it has
    no other; repeated rows stay; an empty table gives an empty result.
    """
    narrow = cut(with_fingerprint(docs.select(id_col, text_col), text_col, "fp", shingle).select(id_col, "fp"))
    classes = cut(cluster(narrow, id_col, radius).drop("root"))
    return join_spread(narrow, classes, "fp", "n", narrow.count()).select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component: the one with the smallest id."""
    mark, own, other = free_names(docs, "__fp", "__id", "__gone_fp")
    marked = with_fingerprint(docs, text_col, mark, shingle)
    narrow = cut(marked.select(F.col(id_col).alias("id"), F.col(mark).alias("fp")))
    classes = cluster(narrow, "id", radius).drop("n")
    # The rows that go are named by id and fingerprint; of rows that agree in both, which is
    # rare, the extra ones are dropped by a second, exact step only if there are any.
    ids = narrow.groupBy("id", "fp").agg(F.count("*").alias("n")).join(classes, "fp")
    first = ids.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias("first_fp"))
    kept = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("first_fp"))
    ids = cut(ids.join(first, "root").select("id", "fp", "n", kept.alias("kept")))
    gone = ids.where(~F.col("kept")).select(F.col("id").alias(own), F.col("fp").alias(other))
    out = marked.join(gone, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(other)), "left_anti")
    if not ids.where("kept and n > 1").isEmpty():
        out = out.dropDuplicates([id_col, mark])
    return out.select(*docs.columns)


def shingle_set(words: list[bytes], shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of word shingles, signed and sorted; fewer words are one shingle, none have none."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    join, n = b" ".join, max(1, len(words) - shingle + 1)
    every = np.fromiter((xxhash.xxh64_intdigest(join(words[i : i + shingle]), SEED) for i in range(n)), dtype=np.uint64, count=n)
    return np.unique(every.view(np.int64))


def prefix_length(n: int, least: float) -> int:
    """How many of a set's ``n`` shingles, the first in any common order, meet those of every similar set."""
    return n - math.ceil(least * n - 1e-9) + 1


def parity(shingles: np.ndarray) -> np.ndarray:
    """A power of two of bits, two or more a shingle, each the parity of how many shingles it has:
    two sets differ in no fewer shingles than bits.  Half as many bits are one half xor the other."""
    width = max(64 * PARITY, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 64 * PARITY
    at = (shingles.view("<u8") >> np.uint64(20)) % np.uint64(width)
    odd = np.bincount(at.astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(bits: np.ndarray) -> np.ndarray:
    """The parities of ``PARITY`` words."""
    while len(bits) > PARITY:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, digest, fp) of every row: a hash of the text, and a digest of its words and the fingerprint of their shingles."""
    importable(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = blobs(batch.column(2))
            digests = [xxhash.xxh3_128_digest(b" ".join(text.translate(LOWER_BYTES).split())) for text in texts]
            prints = [fingerprint(text, SIMILAR_SHINGLE) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(prints, pa.int64())], ["id", "th", "digest", "fp"]
            )

    th = F.xxhash64(F.coalesce(text_col, F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), th.alias("th"), text_col)
    return rows.mapInArrow(run, f"id {id_type}, th bigint, digest binary, fp bigint")


def _shingles_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, set): the shingles of the documents that ``nodes`` (node, id, digest) names."""
    importable(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), text_col).join(_bounded(nodes.withColumnRenamed("id", "__id")), F.col("id").eqNullSafe(F.col("__id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            keep, made = [], []
            for row, (text, digest) in enumerate(zip(blobs(batch.column(0)), batch.column(2).to_pylist(), strict=True)):
                words = text.translate(LOWER_BYTES).split()
                # An id that several texts have brings them all; the digest tells them apart.
                if xxhash.xxh3_128_digest(b" ".join(words)) == digest:
                    keep.append(row)
                    made.append(shingle_set(words))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep, pa.int64())), pa.array(made, pa.list_(pa.int64()))], ["node", "set"])

    return texts.select(text_col, "node", "digest").mapInArrow(run, "node bigint, set array<bigint>").dropDuplicates(["node"])


def _prefixes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(node, n, bits, wide, keys) of every node: how many shingles it has, their
    parities in ``PARITY`` words and in as many as its size asks for, and the first of them, in one order for all nodes, that any similar set has one of.

    It is made of every row, copies too, as only digests and prefixes are then exchanged and no texts.
    """
    total = nodes.count()
    share = int((1 << 30) * min(1.0, SAMPLE_NODES / max(1, total)))
    sample = cut(nodes.where(F.pmod(F.xxhash64(F.lit(SEED), "digest"), F.lit(1 << 30)) < share).select("node", "id", "digest"))
    counts = _shingles_of(docs, sample, id_col, text_col).select(F.explode("set").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    known, often = (top.column(c).to_numpy() for c in ("key", "n"))
    by = np.argsort(known)
    frequent = docs.sparkSession.sparkContext.broadcast((known[by], often[by]))

    def prefix(own: np.ndarray) -> tuple:
        known, often = frequent.value
        n = np.zeros(len(own), dtype=np.int64)
        if len(known) and len(own):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            n = np.where(known[at] == own, often[at], 0)
        first = own[np.lexsort((own, n))][: prefix_length(len(own), least)] if len(own) else own
        wide = parity(own)
        return len(own), folded(wide), wide, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            digests, made = [], []
            for text in blobs(batch.column(0)):
                words = text.translate(LOWER_BYTES).split()
                digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                made.append(prefix(shingle_set(words)))
            columns = [pa.array(digests, pa.binary())]
            columns += [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), *[pa.list_(pa.int64())] * 3))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "bits", "wide", "keys"])

    made = docs.select(text_col).mapInArrow(run, "digest binary, n int, bits array<bigint>, wide array<bigint>, keys array<bigint>")
    return made.dropDuplicates(["digest"]).join(nodes.select("node", "digest"), "digest").drop("digest")


def _meetings(prefixes: DataFrame) -> DataFrame:
    """(key, node, n, left) of every node and key of its prefix that another node has too;
    left is how many of its shingles come after the key."""
    placed = prefixes.select("node", "n", F.posexplode("keys").alias("at", "key"))
    shared = placed.withColumn("met", F.count("*").over(Window.partitionBy("key"))).where("met > 1")
    return shared.select("key", "node", "n", (F.col("n") - F.col("at") - 1).alias("left"))


def _may_meet(a: str, b: str, least: float) -> Column:
    """False only for rows ``a`` and ``b`` of a key whose sets are not similar, or have a smaller key in common:
    by their sizes, and by what follows the key."""
    need = F.lit(least / (1 + least)) * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-6
    return _like_sizes(a, b, least) & (1 + F.least(F.col(f"{a}.left"), F.col(f"{b}.left")) >= need)


def _may_be_similar(a: str, b: str, least: float) -> Column:
    """False only for rows ``a`` and ``b`` whose sets are not similar, by the parities in which they differ."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.lit(least / (1 + least)) * (n + m) - 1e-6
    differ = sum(F.bit_count(F.col(f"{a}.bits")[i].bitwiseXOR(F.col(f"{b}.bits")[i])) for i in range(PARITY))
    return n + m - differ >= 2 * need


def _differ_widely(x: str, y: str) -> Column:
    """In how many bits two rows of parities differ, the wider folded once to the narrower: sets of
    like size are no further apart."""
    short = f"least(size({x}.wide), size({y}.wide))"
    fold = f"zip_with(slice({{0}}.wide, 1, {short}), slice({{0}}.wide, {short} + 1, {short}), (p, q) -> p ^ coalesce(q, 0L))"
    return F.expr(f"aggregate(zip_with({fold.format(x)}, {fold.format(y)}, (p, q) -> bit_count(p ^ q)), 0, (n, d) -> n + d)")


def _without_repeats(met: DataFrame) -> DataFrame:
    """``met`` without the keys whose nodes are those of another one: a passage that texts share gives them all its
    shingles as keys.  Of such keys the first in the order stays, as more comes after it in every set."""
    of_key = met.groupBy("key").agg(
        F.count("*").alias("rows"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "node")).alias("y"), F.sum("left").alias("after")
    )
    kept = of_key.groupBy("rows", "x", "y").agg(F.max_by("key", F.struct("after", "key")).alias("key"))
    return met.join(_bounded(cut(kept.select("key"))), "key")


def _like_sizes(x: str, y: str, least: float) -> Column:
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9


def _bounded(table: DataFrame) -> DataFrame:
    """``table`` (a few numbers a row), broadcast if its counted rows are few."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _verified(pairs: DataFrame, bits: DataFrame, sets_of: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """The ``pairs`` (a, b) whose shingles have a Jaccard similarity of ``least``; ``sets_of`` makes (node, set)
    of nodes, and is asked only for those that the parities leave."""
    pairs = cut(pairs.distinct())
    for end, name in (("a", "x"), ("b", "y")):
        pairs = join_salted(pairs, bits.select(F.col("node").alias(end), F.struct("n", "wide").alias(name)), end)
    both = F.col("x.n") + F.col("y.n")
    near = F.when(_like_sizes("x", "y", least), both - _differ_widely("x", "y") >= F.lit(2 * least / (1 + least)) * both - 1e-6)
    pairs = cut(pairs.where(near).select("a", "b"))
    sets = cut(sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    for end, name in (("a", "x"), ("b", "y")):
        pairs = join_salted(pairs, sets.select(F.col("node").alias(end), F.col("set").alias(name)), end)
    common = F.size(F.array_intersect("x", "y"))
    enough = common >= F.lit(least) * (F.size("x") + F.size("y") - common) - 1e-9
    return cut(pairs.where(enough).select("a", "b"))


def _covered(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are within the radius, enough to connect what is."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("rows")))
    own = join_spread(nodes.select("node", "fp"), prints, "fp", "rows", nodes.count()).where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = cut(links(prints.select("fp")))
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    return own.union(near.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")))


def _similar_nodes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(node, root) of the ``nodes`` (node, id, digest, fp) that meet another; those with the same root are connected over similar pairs.

    In ``STARS`` rounds the nodes of a key are compared with one of them, another one in each round and in each
    key, so that a dense group is connected at little cost; in the first one pairs within the fingerprints' radius
    are compared too.  Last all pairs of a key that are not connected are compared: none is missed.
    """
    covered = cut(_covered(nodes))
    prefixes = cut(_prefixes(docs, nodes, id_col, text_col, least))
    bits = prefixes.select("node", "n", "bits", "wide")
    met = cut(_without_repeats(cut(_meetings(prefixes))))
    total = met.count()
    roots = cut(met.select("node").union(covered.select("a")).union(covered.select("b")).distinct().select("node", F.col("node").alias("root")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _shingles_of(docs, cut(nodes.select("node", "id", "digest").join(wanted, "node")), id_col, text_col)

    def connect(pairs: DataFrame) -> None:
        """Joins the components of similar pairs, over the roots alone."""
        nonlocal roots
        more = _verified(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), bits, sets_of, least)
        for end in ("a", "b"):
            more = more.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        more = cut(more.where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
        if more.isEmpty():
            return
        found = cut(components(more).select(F.col("node").alias("root"), F.col("root").alias("new")))
        roots = cut(roots.join(_bounded(found), "root", "left").select("node", F.coalesce("new", "root").alias("root")))

    for turn in range(STARS):
        rows = met.join(_bounded(roots), "node")
        row = F.struct("node", "n", "left", "root")
        # The smallest set is the nearest to all others where a passage is what they share.
        first = F.struct("n", "node") if turn == 0 else F.xxhash64(F.lit(turn), "key", "node")
        one = rows.groupBy("key").agg(F.min_by(row, first).alias("b"), F.count("*").alias("rows"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        one = cut(one.where("lo <> hi").select("key", "b", "rows"))
        star = join_spread(rows.select("key", row.alias("a")), one, "key", "rows", total)
        star = star.where((F.col("a.root") != F.col("b.root")) & _may_meet("a", "b", least)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        connect(star.union(covered) if turn == 0 else star)
    rows = met.join(_bounded(roots), "node")
    size = F.ceil(F.count("*") / F.lit(HOT_ROWS)).cast("int")
    open_keys = cut(rows.groupBy("key").agg(size.alias("blocks"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key", "blocks"))
    rows = cut(rows.join(_bounded(open_keys), "key").join(bits.select("node", "bits"), "node"))
    # Of a hot key every block of rows meets every other, so no task has them all.
    left = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("a")
    right = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias("b")
    apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.root") < F.col("b.root"))
    pairs = left.join(right, apart & _may_meet("a", "b", least) & _may_be_similar("a", "b", least))
    connect(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))
    return roots


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY):
    """(rows, classes): (id, th, node, root, component_id) of every row, and (node, digest, root, component_id) of every node.

    A node is a sequence of words, lower-cased; nodes with ``least`` of their shingles in
    common are linked, or connected over others.
    """
    rows = cut(_sketches(docs, id_col, text_col))
    nodes = rows.groupBy("digest").agg(F.min("id").alias("own"), F.first("fp").alias("fp"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id())
    nodes = cut(nodes)
    found = _similar_nodes(docs, nodes.select("node", F.col("own").alias("id"), "digest", "fp"), id_col, text_col, least)
    classes = nodes.select("node", "own", "digest", "rows").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = cut(classes)
    smallest = cut(classes.groupBy("root").agg(F.min("own").alias("component_id"), F.count("*").alias("n")))
    classes = cut(join_spread(classes, smallest, "root", "n", classes.count()).select("node", "digest", "rows", "root", "component_id"))
    every = join_spread(rows.select("id", "th", "digest"), classes, "digest", "rows", rows.count()).select("id", "th", "node", "root", "component_id")
    return every, classes.drop("rows")


def keep_one_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of every group of similar texts: the one with the smallest id.

    Texts are similar if ``least`` of their five-word shingles are the same; equal word
    sequences, those without words among them, are one group.  Null texts count as empty; a
    null id stays only if its group has no other; repeated rows go but one; columns stay.
    """
    rows, _ = similar_classes(docs, id_col, text_col, least)
    named = F.col("id").eqNullSafe(F.col("component_id"))
    ids = rows.groupBy("id", "th", "root", "component_id").agg(F.count("*").alias("n"))
    # Of rows that agree in id and group but not in text, the one with the smallest hash stays.
    ids = cut(ids)
    th = F.min(F.when(named, F.col("th")))
    first = cut(ids.groupBy("root").agg(th.alias("first"), F.count("*").alias("rows")))
    ids = cut(join_spread(ids, first, "root", "rows", ids.count()).select("id", "th", "n", (named & (F.col("th") == F.col("first"))).alias("kept")))
    mark, own, other = free_names(docs, "__th", "__id", "__gone")
    gone = ids.where(~F.col("kept")).select(F.col("id").alias(own), F.col("th").alias(other))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    out = marked.join(gone, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(other)), "left_anti")
    if not ids.where("kept and n > 1").isEmpty():
        out = out.dropDuplicates([id_col, mark])
    return out.select(*docs.columns)
