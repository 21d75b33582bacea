"""Self-join of documents on the Jaccard similarity of their word shingles.

Documents with equal sets are one class. A set's rarest shingles, by a counting
sketch of fixed size over all documents, are its prefix: two sets as similar
as asked share a shingle of their prefixes. How many members a set has, and in
which place of its order it has that shingle, bound the sizes of the sets it
can be as similar to. So a set is dealt to the tiles of a shingle and a band of
sizes: as one to be found to its own band, if a set as large could be similar,
and as one that searches to the bands of the sets no larger that it could be
similar to. Sets that sizes or places exclude don't meet.

Tiles are cut into cells of bounded size, in which sets of different components
are compared: a pair must pass size, place and the bit counts of two hashed
bitmaps, which all bound the overlap from above, before the sorted arrays are
intersected. Two rounds take only each set's nearest few by that bound in some of
the tiles, which joins large groups of copies with few pairs; the last takes every
pair of all tiles that is left between different components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ODD, S30, drop_written, joined, mixed, numbered, reach, scope, slices, utf8, word_hashes, written
from .components import components
from .substrings import keyed

#: Least similarity as a fraction.
NUM, DEN = 3, 4
SHINGLE = 5
#: Counters of the sketch that orders shingles, whatever the input, and how
#: many of them travel in one row.
COUNTERS, BLOCK = 1 << 20, 1 << 12
#: Words of 64 bits in a bitmap.
BITS = 16
#: Sets to be found in a cell, and sets that search in a cell of the last round.
CELL, WIDE = 256, 4096
#: Pairs a set has at most in a round before the last, which looks at the tiles of
#: one shingle in so many.
MATES, PART_OF = 3, 4


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted."""
    h = word_hashes(text, lower=True)
    if not len(h):
        return h
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    a = np.full(n, k, np.uint64)
    for j in range(k):
        a ^= h[j : j + n]
        a *= ODD
        a ^= a >> S30
    a = mixed(a)
    a.sort()
    return a[np.concatenate(([True], a[1:] != a[:-1]))]


def slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    seen = np.zeros(64 * BITS, np.uint8)
    seen[(tokens >> np.uint64(32)).astype(np.int64) % (64 * BITS)] = 1
    return np.packbits(seen).view(np.int64)


def identity(tokens: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit name, in halves: the hash of its sorted members."""
    if not len(tokens):
        return 0, 0
    both = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64)
    return int(both[0]), int(both[1])


B = [f"b{i}" for i in range(BITS)]
SET = "doc_id bigint, doc bigint, hash bigint, row bigint, n bigint, sid bigint, other bigint, " + ", ".join(f"{b} bigint" for b in B) + ", counts binary"
SET_ARROW = pa.schema([(f.split()[0], pa.binary() if f.endswith("binary") else pa.int64()) for f in SET.split(", ")])


def sets(docs: DataFrame) -> DataFrame:
    """Size, name (sid and other) and bitmap of each text's set; besides, in
    rows whose n is -1, the task's counts of the sketch, a block of counters to a
    row: the block in sid, a number from 0 to 63 that spreads tasks in doc."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for b in slices(batches):
            ids, doc, key, row = (c.to_pylist() for c in b.columns[:4])
            n, sid, maps, all_ = [], [], np.zeros((b.num_rows, BITS), np.int64), []
            for i, text in enumerate(utf8(b.column(4))):
                t = shingles(text)
                n.append(len(t))
                sid.append(identity(t))
                maps[i] = bitmap(t)
                all_.append(t)
            if all_:
                counts += np.bincount(slot(np.concatenate(all_)), minlength=COUNTERS)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (ids, doc, key, row, n, *zip(*sid, strict=True), *maps.T)), pa.nulls(len(n), pa.binary())], schema=SET_ARROW)
        parts = counts.reshape(-1, BLOCK)
        used = np.flatnonzero(parts.any(1))
        none = pa.nulls(len(used), pa.int64())
        number = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([none, pa.array(np.full(len(used), number)), none, none, pa.array(np.full(len(used), -1)), pa.array(used), *[none] * (BITS + 1), pa.array([parts[i].tobytes() for i in used], pa.binary())], schema=SET_ARROW)

    return docs.select("doc_id", "doc", "hash", "row", "text").mapInArrow(run, SET)


def renamed(have: DataFrame, classes: DataFrame) -> dict[tuple[int, int], int]:
    """New names of sets of which two share the first half of their names. There
    are next to none: about one for every 2^64 pairs of different sets."""
    clash = classes.where("least <> most").select("sid")
    rows = have.join(F.broadcast(clash), "sid", "left_semi").select("sid", "other").distinct().collect()
    return {tuple(r): xxhash.xxh3_64_intdigest(f"{r[0]} {r[1]}") - (1 << 63) for r in rows}


def sketch(all_sets: DataFrame) -> np.ndarray:
    """Sum of all tasks' counts: COUNTERS numbers, however many the rows. Tasks
    are summed in 64 parts first, so no group is large."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.table({"sid": t.column("sid")[:1], "doc": t.column("doc")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    some = all_sets.where("n = -1").select("sid", "doc", "counts")
    for by in (["sid", "doc"], ["sid"]):
        some = some.groupBy(*by).applyInArrow(add, "sid bigint, doc bigint, counts binary")
    out = np.zeros(COUNTERS, np.int64).reshape(-1, BLOCK)
    for r in some.collect():
        out[r["sid"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)


#: at is the set's size times 2^32 plus the shingle's place in its prefix.
POST = "token bigint, sid bigint, at bigint, hot boolean"
POST_ARROW = pa.schema([("token", pa.int64()), ("sid", pa.int64()), ("at", pa.int64()), ("hot", pa.bool_())])


def postings(docs: DataFrame, counts: np.ndarray, names: dict[tuple[int, int], int]) -> DataFrame:
    """The prefix of each text's set: its n - ceil(t n) + 1 rarest shingles,
    each with its place. names: sets with another name. hot: the counter is so high that the tile could be
    larger than a task's fair share."""
    sent = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32) if counts.max() < 1 << 32 else counts)
    most = int(counts.mean() + 1000 + 10 * counts.mean() ** 0.5)

    def run(batches):
        c = sent.value
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in POST_ARROW]
            for text in utf8(b.column(0)):
                t = shingles(text)
                if not len(t):
                    continue
                n = len(t)
                size = n - -(-NUM * n // DEN) + 1
                many = c[slot(t)]
                first = np.lexsort((t, many))[:size]
                name = identity(t)
                for o, v in zip(out, (t[first].view(np.int64), np.full(size, names.get(name, name[0])), (n << 32) + np.arange(size), many[first] > most), strict=True):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), f.type) for o, f in zip(out, POST_ARROW, strict=True)], schema=POST_ARROW)

    return docs.select("text").mapInArrow(run, POST)


def shared(p: DataFrame) -> DataFrame:
    """Postings whose token another posting has too, and all hot ones.

    Cold tokens are sorted together and passed through one row at a time; hot
    ones are dealt by their sets, so no token has more rows in one task than
    its counter allows.
    """

    def run(batches):
        held: pa.RecordBatch | None = None
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            t = b.column(0).to_numpy()
            same = t[1:] == t[:-1]
            hit = np.r_[False, same] | np.r_[same, False] | b.column(3).to_numpy(zero_copy_only=False)
            if held is not None and carried:
                hit[0] = True
            #: The last row waits for the next batch.
            carried = bool(hit[-1])
            yield b.slice(0, len(t) - 1).filter(pa.array(hit[:-1]))
            held = b.slice(len(t) - 1)
        if held is not None and carried:
            yield held

    dealt = F.when(F.col("hot"), F.xxhash64("sid", "token")).otherwise(F.col("token"))
    rows = p.withColumn("key", dealt).repartition("key").sortWithinPartitions("token", "sid").select("token", "sid", "at", "hot").mapInArrow(run, POST)
    place = F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("place")
    return rows.drop("hot").distinct().select("token", "sid", F.shiftright("at", 32).cast("int").alias("n"), place)


def wide_bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of 8 to 16 bits a member, a power of two long."""
    size = 8 << max(7, (max(1, len(tokens)) - 1).bit_length())
    seen = np.zeros(size, np.uint8)
    seen[((tokens >> np.uint64(16)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(seen).tobytes()


def bounded(n: int, m: int, x: bytes, y: bytes) -> bool:
    """Whether two wide bitmaps allow the similarity asked; the longer is
    folded to the shorter's length."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) != len(q):
        if len(p) > len(q):
            p = p[: len(p) // 2] | p[len(p) // 2 :]
        else:
            q = q[: len(q) // 2] | q[len(q) // 2 :]
    most = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
    return most * (NUM + DEN) >= NUM * (n + m)


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar, by intersecting their sorted arrays;
    a written table. Only texts of sets in some pair are read again. Bitmaps
    as long as the sets, an eighth of the arrays, go first and leave few pairs
    whose arrays have to meet. Those of a, of which few may have many pairs, are joined first, while the pairs are
    narrow."""
    pairs = written(pairs, "pairs")
    ones = written(pairs.select("a").distinct(), "ones")
    need = written(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(reps, "sid").select("sid", "doc", "hash"), "need")

    def members(batches):
        for b in slices(batches):
            got = [shingles(x) for x in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([wide_bitmap(x) for x in got], pa.binary()), pa.array([x.tobytes() for x in got], pa.binary())], names=["sid", "n", "map", "members"])

    texts = joined(docs, need, ["doc", "hash"], "inner").select("sid", "text")
    full = written(texts.mapInArrow(members, "sid bigint, n bigint, map binary, members binary"), "members")
    if full.select("sid").distinct().count() < full.count():
        full = written(full.dropDuplicates(["sid"]), "members")

    def met(these: DataFrame, ones: DataFrame, *columns: str) -> DataFrame:
        x, y = (full.select(F.col("sid").alias(k), *[F.col(c).alias(c + k) for c in columns]) for k in "ab")
        both = these.join(joined(x, ones, "a", "left_semi"), "a").join(y, "b")
        return both.select("a", "b", *[c + k for c in columns for k in "ab"])

    def prune(batches):
        for b in slices(batches):
            keep = [bounded(*r) for r in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def compare(batches):
        for b in slices(batches):
            keep = []
            for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = written(met(pairs, ones, "n", "map").mapInArrow(prune, "a bigint, b bigint"), "left")
    few = written(left.select("a").distinct(), "few")
    out = written(met(left, few, "members").mapInArrow(compare, "a bigint, b bigint"), "linked")
    drop_written(pairs, ones, need, full, left, few)
    return out


#: What a set does in a tile: it is found, it searches, or both.
FOUND, SEARCHES = 1, 2


def banded(told: DataFrame) -> DataFrame:
    """Rows of told once for each band of sizes in which they can meet a set no
    larger, with their role there.

    The members shared are no more than those from the shared shingle's place
    on, of either set. So n - place bounds the larger size of a pair, and a set
    is found only by sets of its size or larger if it can be.
    """
    n, left = F.col("n").cast("bigint"), (F.col("n") - F.col("place")).cast("bigint")
    low = F.ceil(n * NUM / DEN)
    high = F.least(n, F.floor(((NUM + DEN) * left - NUM * n) / NUM))
    band = lambda size: F.floor(F.log(size.cast("double")) / math.log(DEN / NUM)).cast("int")
    out = told.where(high >= low).withColumn("band", F.explode(F.sequence(band(low), band(high))))
    found = ((NUM + DEN) * left >= 2 * NUM * n) & (F.col("band") == band(n))
    return out.withColumn("role", F.when(found, FOUND | SEARCHES).otherwise(SEARCHES))


def tiled(told: DataFrame) -> DataFrame:
    """Rows of the tiles (token, band) in which a set can be found and labels
    differ, with m, the tile's size. Tiles with the same members are one, in
    which each member has its lowest place and all its roles."""
    rows = banded(told)
    who = F.xxhash64("sid"), F.xxhash64("sid", F.lit(1))
    g = rows.groupBy("token", "band").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("m"), F.max("role").alias("role"), *[F.bit_xor(x).alias(f"w{i}") for i, x in enumerate(who)])
    #: Minima and counts are written before they are joined back, so that Spark
    #: can split a hot key of the join.
    g = written(g.where((F.col("l") != F.col("h")) & (F.col("role") > SEARCHES)).select("token", "band", "m", "w0", "w1"), "mixed")
    one = written(g.groupBy("band", "m", "w0", "w1").agg(F.min("token").alias("tile")), "one")
    named = written(g.join(one, ["band", "m", "w0", "w1"]).select("token", "band", "tile", "m"), "named")
    return rows.join(named, ["token", "band"]).groupBy(F.col("tile").alias("token"), "band", "sid").agg(F.min("place").alias("place"), F.bit_or("role").alias("role"), F.first("n").alias("n"), F.first("label").alias("label"), F.first("m").alias("m"))


CELLS = ["token", "band", "cell", "sid", "label", "n", "place", "role"]


def dealt(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of cells with their bitmaps, whole cells to a task, in order."""
    return rows.join(reps.select("sid", *B), "sid").withColumn("x", F.explode("cells")).select("token", "band", F.col("x.cell").alias("cell"), "sid", "label", "n", "place", F.col("x.role").alias("role"), *B).repartition("token", "band", "cell").sortWithinPartitions("token", "band", "cell")


def some_cells(told: DataFrame, reps: DataFrame) -> DataFrame:
    """Tiles cut into cells of about CELL sets; each set is in one, and with
    others in each tile."""
    cell = F.pmod(F.xxhash64("sid", "token"), F.ceil(F.col("m") / CELL))
    return dealt(tiled(told).withColumn("cells", F.array(F.struct(cell.alias("cell"), F.col("role").alias("role")))), reps)


def all_cells(told: DataFrame, reps: DataFrame) -> DataFrame:
    """Tiles cut into cells so that every pair of a set that is found and one
    that searches, of different labels, meets in one.

    Most sets of a large tile have one label by now, so the rows are dealt in
    two: sets to be found of other labels meet all that search, those of the
    common label only those of other labels. Blocks of CELL sets meet blocks
    of WIDE, and a row is repeated once for each block it meets: so it is the
    others' number that repeats the many, not the tile's.
    """
    rows = written(tiled(told).drop("m"), "rows")
    by_label = written(rows.groupBy("token", "band", "label").agg(F.count("*").alias("all"), F.count_if(F.col("role") > SEARCHES).alias("found")), "by_label")
    tiles = by_label.groupBy("token", "band").agg(F.max_by("label", F.struct("all", "label")).alias("common"), F.sum("all").alias("all"), F.sum("found").alias("found"), F.max(F.struct("all", "label", "found")).alias("most"))
    blocks = lambda n, size: F.ceil(n / size)
    other_all, other_found = F.col("all") - F.col("most.all"), F.col("found") - F.col("most.found")
    tiles = written(tiles.select("token", "band", "common", blocks(other_found, CELL).alias("f0"), blocks(F.col("all"), WIDE).alias("s0"), blocks(F.col("most.found"), CELL).alias("f1"), blocks(other_all, WIDE).alias("s1")), "tiles_of")
    rows = rows.join(tiles, ["token", "band"])
    own, found = F.xxhash64("sid", F.lit(7)), F.col("role") > SEARCHES
    common = F.col("label") == F.col("common")

    def cells(kind: int, who, role: int, mine: str, others: str):
        """Cells of a row that is in one block of its own side: one for each block of the other side."""
        place_ = F.pmod(own, F.greatest(F.col(mine), F.lit(1)))
        at = lambda i: F.lit(kind << 60) + ((place_ * (1 << 30) + i) if role == FOUND else (i * (1 << 30) + place_))
        made = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(others) - 1), lambda i: F.struct(at(i).alias("cell"), F.lit(role).alias("role")))
        return F.when(who & (F.col(mine) > 0) & (F.col(others) > 0), made).otherwise(F.array().cast("array<struct<cell:bigint,role:int>>"))

    everyone = F.lit(True)
    kinds = [(0, found & ~common, FOUND, "f0", "s0"), (0, everyone, SEARCHES, "s0", "f0"), (1, found & common, FOUND, "f1", "s1"), (1, ~common, SEARCHES, "s1", "f1")]
    return dealt(rows.withColumn("cells", F.concat(*[cells(*k) for k in kinds])).drop("role"), reps)


#: Pairs of a large cell that are compared at once.
AT_ONCE = 1 << 18


def cell_pairs(rows: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of different labels within each cell, one found and one
    that searches, that can still be similar by size, place and bitmaps: of a
    set's members no more are shared than do not lie on bits the other lacks.
    near is that bound as a share of both sizes. best: only the pair of each row
    whose bound is highest.

    Cells arrive whole and in order; small ones of a batch are compared together,
    each row with the next, the one after it, and so on.
    """

    def compare(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        total = len(c["token"])
        start = np.flatnonzero(np.r_[True, (c["token"][1:] != c["token"][:-1]) | (c["band"][1:] != c["band"][:-1]) | (c["cell"][1:] != c["cell"][:-1])])
        size = np.diff(np.r_[start, total])
        maps = np.stack([c[b] for b in B], 1).view(np.uint64)
        top, mate, out = np.zeros(total), np.full(total, -1), []
        n_of, left = c["n"].astype(np.int64), c["n"].astype(np.int64) - c["place"]

        def meet(x: np.ndarray, y: np.ndarray) -> None:
            n, m = n_of[x], n_of[y]
            ok = (c["label"][x] != c["label"][y]) & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m))
            ok &= np.minimum(left[x], left[y]) * (NUM + DEN) >= NUM * (n + m)
            ok &= (c["role"][x] & c["role"][y] == 3) | (c["role"][x] ^ c["role"][y] != 0)
            x, y, n, m = x[ok], y[ok], n[ok], m[ok]
            lacks = [np.bitwise_count(maps[p] & ~maps[q]).sum(1, dtype=np.int64) for p, q in ((x, y), (y, x))]
            shared_ = np.minimum(n - lacks[0], m - lacks[1])
            ok = shared_ * (NUM + DEN) >= NUM * (n + m)
            x, y, near = x[ok], y[ok], (shared_ / (n + m))[ok]
            if not best:
                out.append(np.stack([c["sid"][x], c["sid"][y]]))
                return
            for p, q in ((x, y), (y, x)):
                order = np.argsort(near, kind="stable")
                more = order[near[order] > top[p[order]]]
                top[p[more]], mate[p[more]] = near[more], q[more]

        small = size <= 32
        last = np.repeat(start + size, size)
        i, d = np.flatnonzero(np.repeat(small, size)), 1
        while len(i := i[i + d < last[i]]):
            meet(i, i + d)
            d += 1
        for a, k in zip(start[~small], size[~small], strict=True):
            here = np.arange(a, a + k)
            found, search = here[c["role"][here] & FOUND > 0], here[c["role"][here] & SEARCHES > 0]
            if len(search):
                step = max(1, AT_ONCE // len(search))
                for f in range(0, len(found), step):
                    part = found[f : f + step]
                    meet(np.repeat(part, len(search)), np.tile(search, len(part)))
        if best:
            x = np.flatnonzero(mate >= 0)
            return pa.RecordBatch.from_arrays([pa.array(c["sid"][x]), pa.array(c["sid"][mate[x]]), pa.array(top[x])], names=["a", "b", "near"])
        p = np.unique(np.sort(np.concatenate(out, 1), 0), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1]), pa.array(np.zeros(p.shape[1]))], names=["a", "b", "near"])

    def run(batches):
        held: pa.RecordBatch | None = None
        key = ("token", "band", "cell")
        for b in batches:
            t = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks()
            c = {k: t.column(k).to_numpy() for k in [*CELLS, *B]}
            same = np.ones(len(t), bool)
            for x in key:
                same &= c[x] == c[x][-1]
            k = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
            if k:
                yield compare({x: v[:k] for x, v in c.items()})
            held = t.slice(k).combine_chunks().to_batches()[0]
        if held is not None:
            yield compare({k: held.column(k).to_numpy() for k in [*CELLS, *B]})

    return rows.mapInArrow(run, "a bigint, b bigint, near double")


def nearest(pairs: DataFrame) -> DataFrame:
    """Each set's MATES nearest others: no more pairs than that many a set."""
    w = Window.partitionBy("a").orderBy(F.desc("near"), "b")
    top = pairs.groupBy("a", "b").agg(F.max("near").alias("near")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= MATES)
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, doc, hash, row, n_shingles, component_id and label of each row of
    ``docs``. label is the component's own name, which no other component has,
    whatever the ids; it is null for rows without words. row is the column
    ``row`` of docs if rows is true, else 0.

    Two texts link when their sets of shingles of five words (of all words, if
    fewer) have a Jaccard similarity of 3/4 or more; words are lower-cased in
    A-Z. component_id is the smallest doc_id that links reach, itself
    included. Rows without words have an empty set and are linked with
    nothing; so their component is their own doc_id. Rows with equal texts
    link, whatever their ids; a null doc_id counts as the smallest but is
    returned as null. Extra columns aren't read; an empty table gives an empty
    table. Sets are told apart by 128-bit hashes, words and shingles by 64-bit ones.
    """
    reach(docs.sparkSession)
    with scope() as keep:
        return _grouped(docs, rows, keep)


def _grouped(docs: DataFrame, rows: bool, keep) -> DataFrame:
    d = keyed(docs, ("row", "bigint")) if rows else keyed(docs).withColumn("row", F.lit(0).cast("bigint"))
    all_ = written(sets(d), "sets")
    have, other = all_.where("n >= 0"), (F.min("other").alias("least"), F.max("other").alias("most"))
    first_of = lambda x: written(x.where("n > 0").groupBy("sid").agg(F.min(F.struct("doc", "hash", "n", *B)).alias("r"), *other).select("sid", "r.*", "least", "most"), "classes")
    reps = first_of(have)
    names = renamed(have, reps)
    if names:
        own = F.broadcast(d.sparkSession.createDataFrame([(*k, v) for k, v in names.items()], "sid bigint, other bigint, new bigint"))
        have = have.join(own, ["sid", "other"], "left").withColumn("sid", F.coalesce("new", "sid"))
        reps = first_of(have)
    copies = have.where("n > 0").select("sid", "doc", "hash").join(reps.select("sid", F.col("doc").alias("_d"), F.col("hash").alias("_h")), "sid").where("doc <> _d or hash <> _h").select("doc", "hash").distinct()
    copies = written(copies, "copies")
    first = joined(d, copies, ["doc", "hash"], "left_anti")
    tiles = written(shared(postings(first, sketch(all_), names)), "tiles")
    told = written(tiles.withColumn("label", F.col("sid")), "labelled")
    links = None
    for k in range(3):
        last = k == 2
        with scope() as on:
            some = told.where(F.pmod("token", F.lit(PART_OF)) == k)
            pairs = cell_pairs(all_cells(told, reps) if last else some_cells(some, reps), best=not last)
            more = linked(pairs.select("a", "b").distinct() if last else nearest(pairs), reps, d)
            on(more)
        links = more if links is None else links.unionByName(more)
        if not last:
            labels = components(links)
            drop_written(told)
            told = written(tiles.join(labels, tiles.sid == labels.node, "left").select(*tiles.columns, F.coalesce("label", "sid").alias("label")), "labelled")
            drop_written(labels)
    classes = components(links)
    own = have.select("doc_id", "doc", "hash", "row", F.col("n").alias("n_shingles"), "sid").join(classes, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "sid"))
    own = keep(written(own.select("doc_id", "doc", "hash", "row", "n_shingles", "label"), "members"))
    low = keep(written(own.where("n_shingles > 0").groupBy("label").agg(F.min("doc").alias("low")), "lowest"))
    empty = own.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("label", F.lit(None).cast("bigint"))
    full = own.where("n_shingles > 0").join(low, "label").withColumn("component_id", F.when(F.col("low") != -(1 << 63), F.col("low")))
    columns = ["doc_id", "doc", "hash", "row", "n_shingles", "component_id", "label"]
    return full.select(*columns).unionByName(empty.select(*columns))


def digests(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each component
    keeps one: that of the smallest doc_id, then of the smallest text hash, then
    any one. A null doc_id counts as the smallest. Rows without words all stay.

    Rows are numbered in a written table, so a number stays with its row.
    """
    flat, c = numbered(docs)
    with scope() as keep:
        flat = keep(written(flat.withColumn("row", F.monotonically_increasing_id()), "rows"))
        got = grouped(flat.select(c("doc_id").alias("doc_id"), c("text").alias("text"), "row"), rows=True).where("n_shingles > 0")
        #: Written, so that a large component is summed before its rows are dealt by label.
        got = written(got.select("doc", "hash", "row", "label"), "labels")
        best = written(got.groupBy("label").agg(F.min(F.struct("doc", "hash", "row")).alias("k")).select("k.row"), "best")
        gone = keep(written(joined(got.select("row"), best, "row", "left_anti"), "gone"))
        return joined(flat, gone, "row", "left_anti").drop("row").toDF(*docs.columns)
