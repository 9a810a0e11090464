"""HyperMinHash sketches, banded candidate search, verification on full sets, and connected components.

Every register of a sketch is a true min-wise sample: rounds of bucketed hashing go on until no register is
empty, so short texts are sketched as faithfully as long ones. A register keeps the round, the leading-zero
count of the minimum and ten mantissa bits, in 16 bits. Registers are stored with their text once; bands are cut
from them, and similarities are estimated on them, corrected for registers that agree by chance.

Candidates that share a band are not paired with each other in full. Texts with equal sets are one node.
Each set is first tried against one of its buckets' smallest ids. In buckets that then hold several components,
a set can only be linked if enough of its shingles occur in any other set there; that bound drops sets which
share a passage but not a text, and copies that were changed too much. The rest is tried against that of its
buckets' sets which shares the largest part of its shingles. What is still apart is dealt into blocks; two blocks meet in one task, which compares
registers and gives on only pairs that may reach the similarity, however wide a bucket is. All links are confirmed
on full sets. What banding and the estimate may lose: a pair at similarity 0.8 has no common band once in twenty
million (32 bands of 4), and an estimate six standard deviations too low about once in a billion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import materialised, mix, salted_join

MANTISSA_BITS = 10
#: 32 bands of 4 miss a pair at similarity 0.8 once in twenty million.
BANDS, ROWS = 32, 4
#: Members of a bucket that one block holds on average.
BLOCK = 4000
_SEEDS = np.random.default_rng(7).integers(0, 2**64, size=4096, dtype=np.uint64)

SKETCH_FIELDS = "n long, lo long, hi long, registers binary"


def registers_of_all(sets: list[np.ndarray], count: int) -> np.ndarray:
    """For each set, the minimum (round, 32 hash bits) of each bucket, with rounds added until all buckets are filled.
    All sets go through a round together; filled ones leave. Empty sets keep the largest value everywhere."""
    empty = np.uint64(2**64 - 1)
    regs = np.full((len(sets), count), empty, dtype=np.uint64)
    flat = regs.reshape(-1)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    shingles = np.concatenate(sets) if len(sets) else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    t = 0
    while len(shingles):
        h = mix(shingles ^ _SEEDS[t % len(_SEEDS)])
        low = (h & np.uint64(0xFFFFFFFF)) | (np.uint64(t) << np.uint64(32))
        # as many rounds as buckets choose by hash; after them, one bucket a round takes what is left to fill
        bucket = (((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64) if t < count else t - count
        np.minimum.at(flat, owner * count + bucket, low)
        t += 1
        still = np.unique(owner)
        open_ = np.zeros(len(sets), dtype=bool)
        open_[still] = (regs[still] == empty).any(axis=1)
        keep = open_[owner]
        shingles, owner = shingles[keep], owner[keep]
    return regs


def registers_of(shingles: np.ndarray, count: int) -> np.ndarray:
    return registers_of_all([shingles], count)[0]


def compressed(regs: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of 16 bits: leading zeros of the 32-bit minimum (6 bits), and the 10 bits after the
    first one. Rounds after the first are mixed in."""
    rounds, low = regs >> np.uint64(32), regs & np.uint64(0xFFFFFFFF)
    exponent = np.frexp(low.astype(np.float64))[1]  # bits up to the first one
    zeros = (32 - exponent).astype(np.uint64)
    after = low << (zeros + np.uint64(1))
    mantissa = (after & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA_BITS)
    code = (zeros << np.uint64(MANTISSA_BITS)) | mantissa
    return np.where(rounds == 0, code, mix(code | (rounds << np.uint64(16)))).astype(np.uint16)


def by_chance() -> float:
    """How often registers of different minima agree: equal zeros (a third of all pairs), then equal mantissas."""
    return 2.0**-MANTISSA_BITS / 3


def least_agreeing(percent: int, registers: int) -> int:
    """Agreeing registers of a pair whose similarity, estimated as (agreeing / all - c) / (1 - c) with chance c, lies
    six standard deviations below the given one."""
    p = percent / 100 * (1 - by_chance()) + by_chance()
    return max(0, int(registers * p - 6 * (registers * p * (1 - p)) ** 0.5))


def sketch_columns(sets: list[np.ndarray], bands: int = BANDS) -> dict[str, pa.Array]:
    """Set size, a 128-bit fingerprint of the set, and its registers."""
    n = len(sets)
    code = compressed(registers_of_all(sets, bands * ROWS))
    lo, hi = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    if some := [i for i, s in enumerate(sets) if len(s)]:
        every = np.concatenate(sets)
        first = np.concatenate(([0], np.cumsum([len(sets[i]) for i in some])))[:-1]
        lo[some], hi[some] = np.add.reduceat(mix(every), first), np.add.reduceat(mix(every ^ _SEEDS[0]), first)
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (2 * bands * ROWS)).tobytes())
    registers = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(code).tobytes())])
    return {"n": pa.array([len(s) for s in sets], pa.int64()), "lo": pa.array(lo.view(np.int64)), "hi": pa.array(hi.view(np.int64)), "registers": registers}


def band_keys(bands: int) -> Column:
    """A key of each band's registers."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.expr("registers").substr(b * (2 * ROWS) + 1, F.lit(2 * ROWS))))


def near_size(a: str, b: str, percent: int) -> Column:
    """Whether two set sizes allow the similarity."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _agreeing(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("registers_a", "registers_b"))
            agree = (x == y).sum(axis=1)
            keep = np.flatnonzero(agree >= least)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    return run


def promising(pairs: DataFrame, reps: DataFrame, percent: int, bands: int) -> DataFrame:
    """The pairs (a, b) that may reach the similarity, by set sizes and registers. reps: id, n,
    registers. `a` may be the same in many pairs."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"registers_{c}"))
    met = salted_join(pairs.join(side("b"), "b"), side("a"), "a").filter(near_size("n_a", "n_b", percent))
    return met.select("a", "b", "registers_a", "registers_b").mapInArrow(_agreeing(least_agreeing(percent, bands * ROWS)), pairs.select("a", "b").schema)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both, n_a, n_b = [], [], []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both.append(len(np.intersect1d(x, y, assume_unique=True)))
            n_a.append(len(x))
            n_b.append(len(y))
        yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")} | {k: pa.array(v, pa.int64()) for k, v in (("both", both), ("n_a", n_a), ("n_b", n_b))})


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the number of common shingles (both) and the sizes of their full sets, of `sets` (id,
    shingles). `a` may be the same in many pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    met = salted_join(pairs.join(right, "b"), left, "a", 2000).select("a", "b", "set_a", "set_b")
    counted = pairs.select("a", "b", *[F.lit(0).cast("long").alias(c) for c in ("both", "n_a", "n_b")]).schema
    return materialised(met.mapInArrow(_common, counted), "measured")


def linked(counted: DataFrame, percent: int) -> DataFrame:
    """The measured pairs that reach the similarity."""
    return counted.filter(F.col("both") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("both")) * percent).select("a", "b")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id")
        for i, s in enumerate(batch.column("shingles")):
            s = np.frombuffer(s.as_py(), np.int64)
            for at in range(0, len(s), 200_000):
                part = s[at : at + 200_000]
                yield pa.RecordBatch.from_pydict({"shingle": pa.array(part), "id": ids.take(pa.array(np.full(len(part), i)))})


def met_shingles(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, met): how many of each set's shingles occur in a further one of the sets. sizes: id, n."""
    fields = sets.select(F.lit(0).cast("long").alias("shingle"), "id").schema
    owners = sets.mapInArrow(_shingle_rows, fields).groupBy("shingle").agg(F.count("*").alias("c"), F.min("id").alias("id")).filter("c = 1")
    alone = owners.groupBy("id").agg(F.count("*").alias("alone"))
    return sizes.join(alone, "id", "left").select("id", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("met"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (a, b); the component is its smallest id.

    Alternating large-star and small-star steps; each step only groups and joins, so hubs are pre-aggregated and
    split. Rounds grow with the logarithm of a component's size.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = pairs.join(lowest, "a")
        if large:
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    def done(edges: DataFrame) -> bool:
        """Whether every id points at one smaller id that points at none."""
        twice = edges.groupBy("a").count().filter("count > 1").select("a")
        onwards = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").select("a")
        return twice.union(onwards).isEmpty()

    ordered = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialised(ordered, "edges")
    while not done(edges):
        edges = materialised(star(star(edges, True), False), "edges")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)


def classes(sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 80, bands: int = BANDS) -> DataFrame:
    """(id, component, n) of every sketched text with a non-empty set, linked at `percent` Jaccard similarity.

    sketches: id (any ordered type) and SKETCH_FIELDS. sets_of(ids) returns (id, shingles) with each id's sorted
    shingle hashes as bytes. Equal sets are linked by their 128-bit fingerprint and size.
    """
    some = sketches.filter("n > 0")
    reps = materialised(
        some.groupBy("lo", "hi", "n").agg(F.min(F.struct("id", "registers")).alias("r")).select("lo", "hi", "n", "r.*"),
        "representatives",
    )
    rows = reps.select("id", F.explode(band_keys(bands)).alias("key"))
    pivots = materialised(rows.groupBy("key").agg(F.min("id").alias("p"), F.count("*").alias("c")).filter("c > 1"), "pivots")
    shared = materialised(salted_join(rows, pivots, "key", count="c").drop("c"), "shared")

    # first, each set against the one of its buckets' smallest ids that it shares most bands with
    pairs = materialised(promising(_most_met(shared, "p"), reps, percent, bands), "pairs")
    links = linked(measured(pairs, materialised(sets_of(_ids(pairs)), "sets")), percent)
    found = components(links)

    # then what is left in buckets of several components, by how many of its shingles any other set there has
    open_ = materialised(_open(shared.select("key", "id"), found), "open")
    sizes = open_.select("id").distinct().join(reps.select("id", "n"), "id")
    sets = materialised(sets_of(sizes.select("id")), "sets")
    met = materialised(met_shingles(sets, sizes).join(sizes, "id").filter(F.col("met") * 100 >= F.col("n") * percent).select("id", "n", "met"), "met")
    live = materialised(open_.select("key", "id").join(met, "id"), "live")
    order = F.struct((F.col("met") / F.col("n")).alias("met"), F.xxhash64("id").alias("hash"))
    best = F.max(F.struct(order.alias("order"), "id")).alias("best")
    centres = materialised(live.groupBy("key").agg(best, F.count("*").alias("c")), "centres")
    centred = salted_join(live.select("key", "id"), centres, "key", count="c").groupBy("id").agg(F.max("best")["id"].alias("centre"))
    centred = materialised(centred.join(met, "id"), "centred")
    tried = measured(materialised(centred.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")), "pairs"), sets)
    links = links.unionByName(linked(tried, percent))
    found = components(links)

    central = tried.select(F.col("b").alias("id"), F.col("both").alias("central"))
    known = centred.join(central, "id", "left").select("id", F.xxhash64("centre").alias("centre"), F.coalesce("central", "n").alias("central"))
    known = live.join(known, "id")
    # each set's likeliest partner in another component first, which joins most of them; then all that are still apart
    likeliest = materialised(_between_components(_open(known, found), reps, percent, bands, True), "likeliest")
    links = links.unionByName(linked(measured(likeliest, sets), percent))
    found = components(links)
    rest = materialised(_between_components(_open(known, found), reps, percent, bands, False), "pairs")
    if not rest.isEmpty():
        found = components(links.unionByName(linked(measured(rest, sets), percent)))
    of_rep = reps.join(found, "id", "left").select("lo", "hi", "n", F.coalesce("component", "id").alias("component"))
    return some.select("id", "lo", "hi", "n").join(of_rep, ["lo", "hi", "n"]).select("id", "component", "n")


def _most_met(rows: DataFrame, other: str) -> DataFrame:
    """(a, b): each id b with the other one a that it meets in most rows."""
    times = rows.filter(F.col("id") != F.col(other)).groupBy(F.col("id").alias("b"), F.col(other).alias("a")).agg(F.count("*").alias("c"))
    best = times.groupBy("b").agg(F.min(F.struct((-F.col("c")).alias("c"), "a")).alias("best"))
    return materialised(best.select("best.a", "b"), "met")


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()


def _open(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (key, id, ...) of buckets that hold several components, with their own component and how many rows
    their bucket has (members)."""
    members = rows.join(found, "id", "left").select(*rows.columns, F.coalesce("component", "id").alias("component"))
    members = materialised(members, "members")
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("members")).filter("parts > 1").select("key", "members")
    return salted_join(members, materialised(mixed, "mixed"), "key", count="members")


#: Pairs of one block that are looked at together.
PAIRS_AT_ONCE = 500_000


def _pairs_of(rows: pa.Table, percent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the pairs in each group of rows (key, x, y, side; sorted) that lie in different components and may
    reach the similarity: by sizes, by registers, and by what they can have in common, which is at most what both
    share with their centre if that is the same, and of their other shingles those that some set there has too. Of the bands that
    a pair shares, only the first one's bucket gives it. The third array counts agreeing registers."""
    key, x, y, side, size, met, part = (rows.column(c).to_numpy() for c in ("key", "x", "y", "side", "n", "met", "part"))
    centre, central = rows.column("centre").to_numpy(), rows.column("central").to_numpy()
    registers = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(len(key), -1)
    bands = registers.view(np.uint64)  # four registers of 16 bits
    starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
    lengths = np.diff(np.concatenate((starts, [len(key)])))
    group = np.repeat(np.arange(len(starts)), lengths)
    common = np.logical_and.reduceat(bands == bands[starts[group]], starts, axis=0).argmax(axis=1)
    ends = (starts + lengths)[group]
    # partners of a row: those after it in its own block, or the whole other block, which is sorted behind it
    firsts = np.add.reduceat((side == x).astype(np.int64), starts)
    low = np.where(x == y, np.arange(len(key)) + 1, np.where(side == x, (starts + firsts)[group], ends))
    counts = ends - low
    upto = np.cumsum(counts)
    i = 0
    while i < len(key):
        stop = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS_AT_ONCE, side="right")))
        c = counts[i:stop]
        a = np.repeat(np.arange(i, stop), c)
        b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + low[a]
        i = stop
        keep = (part[a] != part[b]) & (size[a] * 100 >= size[b] * percent) & (size[b] * 100 >= size[a] * percent)
        a, b = a[keep], b[keep]
        most = np.minimum(met[a], met[b])
        through = np.minimum(central[a], central[b]) + np.maximum(np.minimum(met[a] - central[a], met[b] - central[b]), 0)
        most = np.where(centre[a] == centre[b], np.minimum(most, through), most)
        keep = most * 100 >= (size[a] + size[b] - most) * percent
        a, b = a[keep], b[keep]
        keep = (bands[a] == bands[b]).argmax(axis=1) == common[group[a]]
        a, b = a[keep], b[keep]
        agreeing = (registers[a] == registers[b]).sum(axis=1)
        keep = agreeing >= least
        yield a[keep], b[keep], agreeing[keep]


def _block_pairs(percent: int, least: int, best: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = rows.column("id").combine_chunks()
            for a, b, agreeing in _pairs_of(rows, percent, least) if rows.num_rows else ():
                if best:  # each side's likeliest partner among these
                    a, b, agreeing = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((agreeing, agreeing))
                    order = np.lexsort((b, -agreeing, a))
                    order = order[np.concatenate(([True], a[order][1:] != a[order][:-1]))[: len(order)]]
                    a, b, agreeing = a[order], b[order], agreeing[order]
                yield pa.RecordBatch.from_pydict({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "agreeing": pa.array(agreeing.astype(np.int64))})

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([rest, rows]) if rest is not None else rows).combine_chunks()
            if not rows.num_rows:
                continue
            same = np.ones(rows.num_rows, dtype=bool)
            for c in ("key", "x", "y"):
                value = rows.column(c).to_numpy()
                same &= value == value[-1]
            begun = int(np.flatnonzero(~same).max(initial=-1)) + 1
            yield from pairs(rows.slice(0, begun))  # the last group may go on in the next batch
            rest = rows.slice(begun)
        if rest is not None:
            yield from pairs(rest)

    return run


def _between_components(open_: DataFrame, reps: DataFrame, percent: int, bands: int, best: bool) -> DataFrame:
    """Pairs of a bucket's members that lie in different components and may reach the similarity, or only each one's
    likeliest (`best`). A bucket's members are dealt into blocks of about BLOCK, and every two blocks meet in one
    group."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    sides = open_.select("key", "id", "n", "met", "centre", "central", F.xxhash64("component").alias("part"), own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    sides = sides.withColumns({"x": F.least("side", "with"), "y": F.greatest("side", "with")}).drop("with").join(reps.select("id", "registers"), "id")
    dealt = sides.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side")
    fields = open_.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("agreeing")).schema
    found = dealt.mapInArrow(_block_pairs(percent, least_agreeing(percent, bands * ROWS), best), fields)
    if best:
        found = found.groupBy("a").agg(F.max_by("b", F.struct("agreeing", "b")).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
