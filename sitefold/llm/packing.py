"""Best-fit packing by a grouping genetic algorithm.

Documents become token ids and an end id; those longer than a sequence are cut. Full pieces are sequences of
their own. The others are dealt by hash into blocks of about BLOCK pieces; a block is a packing problem of
bounded size, however many rows there are. On each block ISLANDS populations evolve as tasks of their own.
Crossover injects whole well-filled sequences of one parent into another, removes the sequences that now
hold a piece twice, and best-fits the pieces set free. After an epoch every island gets the elite of its
neighbour. The best packing of a block wins; pieces of its poorly filled sequences are dealt into new blocks,
which mix pieces of all blocks, until one block is left or a round no longer helps.

Cases: null and empty texts give one piece, the end id alone. Repeated rows and null doc_ids are pieces like
any other. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, release, small_batches, tidy
from .tokens import encoder_of

LENGTH = 2048
END_ID = 0
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 6
CHILDREN = 120
#: A sequence this close to full (a part of its capacity) stays closed for good.
SLACK = 1 / 256


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    id_type = dict(docs.dtypes)["doc_id"]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(tokenizer)
        for b in batches:
            release()  # what the batch before took
            row, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        encoder.forget()  # the encoder lives on with the worker; a task's words come anew at little cost

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


# ---------------------------------------------------------------- the genetic algorithm, on one block


class Packing:
    """bins: lists of items; room: what is left in each; at: the bin of every item. A removed bin is None."""

    __slots__ = ("at", "bins", "fitness", "room")

    def __init__(self, bins, room, at):
        self.bins, self.room, self.at = bins, room, at

    def copy(self) -> Packing:
        return Packing(list(self.bins), list(self.room), self.at.copy())


class Block:
    def __init__(self, lengths: np.ndarray, capacity: int, seed: list[int]):
        self.lengths, self.capacity = [int(x) for x in lengths], capacity
        self.rng = np.random.default_rng(seed)
        self.least = -(-sum(self.lengths) // capacity)

    def best_fit(self, p: Packing, items: list[int]) -> None:
        """Put items, in their order, each into the fullest bin that has room; a bit per amount of room finds it."""
        by_room: dict[int, list[int]] = {}
        mask = 0
        for b, r in enumerate(p.room):
            if r > 0 and p.bins[b] is not None:
                by_room.setdefault(r, []).append(b)
                mask |= 1 << r
        fresh = set()
        for x in items:
            size = self.lengths[x]
            fits = mask >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    mask &= ~(1 << r)
                if b in fresh:
                    p.bins[b].append(x)
                else:
                    p.bins[b] = [*p.bins[b], x]
                    fresh.add(b)
                r -= size
            else:
                b, r = len(p.bins), self.capacity - size
                p.bins.append([x])
                p.room.append(r)
                fresh.add(b)
            p.room[b] = r
            p.at[x] = b
            if r > 0:
                by_room.setdefault(r, []).append(b)
                mask |= 1 << r

    def rate(self, p: Packing) -> Packing:
        """Mean square of the bins' fill, which rewards full bins; compacts away removed bins."""
        if None in p.bins:
            keep = [b for b, x in enumerate(p.bins) if x is not None]
            to = np.full(len(p.bins), -1, np.int32)
            to[keep] = np.arange(len(keep))
            p.bins, p.room, p.at = [p.bins[b] for b in keep], [p.room[b] for b in keep], to[p.at]
        fill = 1 - np.array(p.room) / self.capacity
        p.fitness = (-len(p.bins), float((fill * fill).mean()))
        return p

    def fresh(self, noise: float) -> Packing:
        sizes = np.array(self.lengths)
        order = np.argsort(-(sizes * (1 + noise * self.rng.standard_normal(len(sizes)))), kind="stable")
        p = Packing([], [], np.zeros(len(sizes), np.int32))
        self.best_fit(p, order.tolist())
        return self.rate(p)

    def decode(self, genome: bytes) -> Packing:
        at = np.frombuffer(genome, "<i4").copy()
        bins: list = [[] for _ in range(int(at.max()) + 1)]
        room = [self.capacity] * len(bins)
        for x, b in enumerate(at.tolist()):
            bins[b].append(x)
            room[b] -= self.lengths[x]
        return self.rate(Packing(bins, room, at))

    def release(self, p: Packing, bins: set[int]) -> list[int]:
        out = []
        for b in bins:
            out += p.bins[b]
            p.bins[b] = None
        return out

    def child(self, a: Packing, b: Packing) -> Packing:
        """Injects well-filled bins of b into a copy of a, and dissolves some of a's emptiest bins besides."""
        room = np.array(b.room)
        good = np.flatnonzero(room <= np.quantile(room, 0.5))
        take = self.rng.choice(good, min(len(good), int(self.rng.integers(1, 2 + len(good) // 16))), replace=False)
        p = a.copy()
        injected = [b.bins[i] for i in take]
        inside = {x for items in injected for x in items}
        hit = set(p.at[list(inside)].tolist())
        if injected and len(hit) == len(injected) and self.rng.random() < 0.5:
            hit, injected, inside = set(), [], set()  # both parents hold these bins
        spare = np.array([-1 if i in hit else r for i, r in enumerate(p.room)])
        worst = np.argsort(-spare, kind="stable")[: int(self.rng.integers(1, 6))]
        others = self.rng.integers(0, len(p.bins), int(self.rng.integers(1, 6)))
        free = [x for x in self.release(p, hit | {int(w) for w in worst} | {int(o) for o in others}) if x not in inside]
        for items in injected:
            n = len(p.bins)
            p.bins.append(items)
            p.room.append(self.capacity - sum(self.lengths[x] for x in items))
            p.at[items] = n
        free.sort(key=lambda x: -self.lengths[x])
        if self.rng.random() < 0.5 and len(free) > 2:  # another order now and then
            i, j = self.rng.integers(0, len(free), 2)
            free[i], free[j] = free[j], free[i]
        self.best_fit(p, free)
        return self.rate(p)

    def evolve(self, start: list[Packing], children: int) -> list[Packing]:
        """Best first. Parents come from tournaments of two; a child replaces the worst if it is better."""
        population = sorted(start, key=lambda p: p.fitness, reverse=True)
        for noise in (0, 0.02, 0.05, 0.1, 0.2, 0.4):
            if len(population) < POPULATION and not (population and -population[0].fitness[0] <= self.least):
                insort(population, self.fresh(noise), key=lambda p: (-p.fitness[0], -p.fitness[1]))
        for _ in range(children):
            if -population[0].fitness[0] <= self.least or len(population) < 2:
                break
            i, j = (int(min(self.rng.integers(0, len(population), 2))) for _ in range(2))
            c = self.child(population[i], population[j if j != i else (i + 1) % len(population)])
            if c.fitness > population[-1].fitness:
                population.pop()
                insort(population, c, key=lambda p: (-p.fitness[0], -p.fitness[1]))
        return population[:POPULATION]


def evolve_islands(islands: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """islands(block, island, lengths, elite: packings to start from) -> block, island, n_bins, fill, elite (best first)."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                block = Block(np.array(r["lengths"]), capacity, [r["round"], r["block"], r["island"], epoch])
                population = block.evolve([block.decode(g) for g in r["elite"] or ()], CHILDREN)
                best = population[0].fitness
                out.append((r["block"], r["island"], -best[0], best[1], [p.at.astype("<i4").tobytes() for p in population[:3]]))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.binary())), strict=True)], ["block", "island", "n_bins", "fill", "elite"])

    return islands.select("block", "island", "lengths", "elite", "round").mapInArrow(tidy(run), "block bigint, island int, n_bins int, fill double, elite array<binary>")


def _sequences(winners: DataFrame, capacity: int) -> DataFrame:
    """winners(block, uids, lengths, genome) -> uid, length, sequence_id (the smallest uid in it), offset, filled."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                uid, size, at = np.array(r["uids"], np.int64), np.array(r["lengths"], np.int64), np.frombuffer(r["genome"], "<i4")
                order = np.lexsort((uid, at))
                uid, size, at = uid[order], size[order], at[order]
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                which = np.cumsum(np.concatenate(([False], at[1:] != at[:-1])))
                total = np.cumsum(size) - size
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (uid, size, uid[first][which], total - total[first][which], np.bincount(which, size)[which].astype(np.int64))], ["uid", "length", "sequence_id", "offset", "filled"])

    return winners.mapInArrow(tidy(run), "uid bigint, length bigint, sequence_id bigint, offset bigint, filled bigint")


def pack(items: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """items(uid unique, length from 1 to capacity) -> uid, sequence_id, offset."""
    spark = items.sparkSession
    done = [items.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = items.where(F.col("length") < capacity).select("uid", "length")
    n, round_ = rest.count(), 0
    full = capacity - int(capacity * SLACK)
    while n:
        blocks = -(-n // BLOCK)
        dealt = rest.groupBy(F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))
        dealt = cut(dealt.select("block", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths")))
        spread = min(2 * blocks * ISLANDS, 4 * spark.sparkContext.defaultParallelism + blocks)
        each = dealt.select("block", "lengths", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"), F.lit(round_).alias("round"))
        elite = None
        for epoch in range(EPOCHS):
            if elite is None:
                start = each.withColumn("elite", F.lit(None).cast("array<binary>"))
            else:
                own = elite.select("block", "island", F.col("elite").alias("own"))
                came = elite.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.slice("elite", 1, 2).alias("came"))
                start = each.join(own.join(came, ["block", "island"]).select("block", "island", F.concat("own", "came").alias("elite")), ["block", "island"])
            elite = cut(evolve_islands(start.repartition(spread, "block", "island"), capacity, epoch))
        best = elite.groupBy("block").agg(F.min_by(F.col("elite")[0], F.struct("n_bins", -F.col("fill"), "island")).alias("genome"))
        packed = cut(_sequences(dealt.join(best, "block").select("uids", "lengths", "genome"), capacity))
        left = packed.where(F.col("filled") < full)
        m = left.count() if blocks > 1 else 0
        if m > 0.8 * n:
            m = 0
        done.append((packed.where(F.col("filled") >= full) if m else packed).select("uid", "sequence_id", "offset"))
        rest, n, round_ = left.select("uid", "length"), m, round_ + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    small_batches(docs.sparkSession)
    cuts = cut(pieces(docs, tokenizer, length).withColumn("uid", F.monotonically_increasing_id()))
    placed = pack(cuts.select("uid", "length"), length)
    return cuts.join(placed, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
