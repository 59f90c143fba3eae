"""Packing documents into sequences by a grouping genetic algorithm on islands.

Documents of one length are alike to a packer, so the search works on counts by
length: a solution is a list of bin patterns with how often each is used. Its
size depends on the capacity, not on the corpus, and so does the time of a
generation. Documents are dealt to the pattern's places by their rank within
their length.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codefold.llm.common import id_text, ready, stored, work_dir
from codefold.llm.tokens import encoder

CAPACITY, END = 2048, 0
ISLANDS, EPOCHS, GENERATIONS, POPULATION, ELITES = 6, 3, 4, 6, 2

#: A pattern: ((length, times), ...) from the longest; a solution: [(pattern, bins), ...].
Pattern = tuple[tuple[int, int], ...]
Solution = list[tuple[Pattern, int]]


def filled(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def merged(bins) -> Solution:
    """Patterns in one order, each once."""
    out: dict[Pattern, int] = {}
    for pattern, n in bins:
        sizes: dict[int, int] = {}
        for length, times in pattern:
            sizes[length] = sizes.get(length, 0) + times
        key = tuple(sorted(sizes.items(), reverse=True))
        out[key] = out.get(key, 0) + n
    return sorted(out.items())


def best_fit(counts: dict[int, int], bins, capacity: int, order=None) -> Solution:
    """Put ``counts[length]`` documents of each length, longest first or in ``order``, into the fullest bins that hold them, then into new ones."""
    by_free: dict[int, list] = {}
    open_ = 0

    def add(pattern, n):
        nonlocal open_
        free = capacity - filled(pattern)
        by_free.setdefault(free, []).append((pattern, n))
        open_ |= 1 << free

    for pattern, n in bins:
        add(pattern, n)
    for length in order or sorted(counts, reverse=True):
        left = counts.get(length, 0)
        while left:
            if above := open_ >> length:
                free = length + (above & -above).bit_length() - 1
                pattern, n = by_free[free].pop()
                if not by_free[free]:
                    open_ &= ~(1 << free)
            else:
                free, pattern, n = capacity, (), left
            each = free // length
            whole = min(n, left // each)
            left -= whole * each
            n -= whole
            if whole:
                add((*pattern, (length, each)), whole)
            if n and 0 < left < each:
                add((*pattern, (length, left)), 1)
                n, left = n - 1, 0
            if n and pattern:
                add(pattern, n)
    return merged(x for group in by_free.values() for x in group)


def exact_first(counts: dict[int, int], capacity: int) -> Solution:
    """Longest first, fill a bin exactly with one or two more documents where there are such; best fit for the rest."""
    left, bins = dict(counts), []
    lengths = sorted(counts, reverse=True)

    def times(pattern):
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        return min(left.get(x, 0) // n for x, n in need.items())

    for k, length in enumerate(lengths):
        rest = capacity - length
        options = [(length, rest)] if rest else [(length,)]
        options += [(length, x, rest - x) for x in lengths[k:] if 2 * x >= rest > x]
        for option in options:
            if left[length] <= 0:
                break
            if n := times(option):
                bins.append((tuple((x, 1) for x in option), n))
                for x in option:
                    left[x] -= n
    return best_fit(left, merged(bins), capacity)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by volume, and by documents over half a bin with what can't go beside them."""
    n = np.zeros(capacity + 1, np.int64)
    for length, c in counts.items():
        n[length] = c
    size = n * np.arange(capacity + 1)
    cum, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(size)])
    best = -(-int(size.sum()) // capacity)
    half = capacity // 2
    for k in range(half + 1):
        n1 = cum[-1] - cum[capacity - k + 1]
        n2 = cum[capacity - k + 1] - cum[half + 1]
        room = n2 * capacity - (volume[capacity - k + 1] - volume[half + 1])
        small = volume[half + 1] - volume[k]
        best = max(best, int(n1 + n2 + max(0, -(-int(small - room) // capacity))))
    return best


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones: smaller is better."""
    return sum(n for _, n in solution), -sum(n * (filled(p) / capacity) ** 2 for p, n in solution)


def crossover(a: Solution, b: Solution, counts: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Inject well-filled bins of ``b`` whole; drop those of ``a`` whose documents are then taken twice, and some poorly filled ones; best-fit what they held."""
    slack = rng.choice((0, 0, 1, 2, 8))
    injected = [(p, rng.randint(1, n)) for p, n in b if capacity - filled(p) <= slack and rng.random() < 0.5]
    left, kept = dict(counts), []
    for p, n in injected:
        for length, times in p:
            left[length] -= n * times
    poor = rng.choice((0.0, 0.1, 0.3, 0.6))
    for p, n in sorted(a, key=lambda x: (-filled(x[0]), rng.random())):
        free = capacity - filled(p)
        if free > slack and rng.random() < poor:
            continue
        if (fits := min(n, *(left[length] // times for length, times in p))) > 0:
            kept.append((p, fits))
            for length, times in p:
                left[length] -= fits * times
    order = sorted((x for x, n in left.items() if n), key=lambda x: -x * (1 + 0.05 * slack * rng.random()))
    return best_fit(left, merged(injected + kept), capacity, order) if order else merged(injected + kept)


def seeds(counts: dict[int, int], capacity: int, n: int, rng: random.Random) -> list[Solution]:
    out = [best_fit(counts, (), capacity), exact_first(counts, capacity)]
    while len(out) < n:
        noise = rng.choice((0.02, 0.1, 0.3))
        out.append(best_fit(counts, (), capacity, sorted(counts, key=lambda x: -x * (1 + noise * rng.random()))))
    return out


def evolve(population: list[Solution], counts: dict[int, int], capacity: int, generations: int, size: int, target: int, rng: random.Random) -> list[Solution]:
    """Some generations of one island; ends early when a solution has ``target`` bins."""
    rank = lambda s: fitness(s, capacity)
    population = sorted(population, key=rank)[:size]
    for _ in range(generations):
        if fitness(population[0], capacity)[0] <= target:
            break
        children = []
        for _ in range(size // 2):
            a, b = (min(rng.sample(population, min(2, len(population))), key=rank) for _ in range(2))
            children.append(crossover(a, b, counts, capacity, rng))
        unique = {tuple(s): s for s in population + children}
        population = sorted(unique.values(), key=rank)[:size]
    return population


def search(spark: SparkSession, counts: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, seed: int = 1) -> Solution:
    """The best solution of all islands. Each island is a task; after each epoch its elites go to the next island of a ring.

    The first epoch runs all its generations; more follow while the best
    solution has more bins than the lower bound. What goes through the driver
    are solutions: their size is bounded by the capacity. A lost task starts its
    epoch again with the same seed.
    """
    if not counts:
        return []
    ready(spark)
    target, migrants, best = least_bins(counts, capacity), {}, None
    for epoch in range(epochs):
        if best and fitness(best, capacity)[0] <= target:
            break
        arriving = dict(migrants)

        def run(batches, epoch=epoch, arriving=arriving):
            for batch in batches:
                rows, whose, kind = [], [], pa.list_(pa.list_(pa.int32()))
                times = []
                for island in batch.column(0).to_pylist():
                    rng = random.Random(f"{seed}/{epoch}/{island}")
                    population = arriving.get(island) or seeds(counts, capacity, POPULATION, rng)
                    for s in evolve(population, counts, capacity, generations, POPULATION, target if epoch else 0, rng):
                        rows.append([[x for pair in p for x in pair] for p, _ in s])
                        times.append([n for _, n in s])
                        whose.append(island)
                yield pa.RecordBatch.from_arrays([pa.array(whose, pa.int64()), pa.array(rows, kind), pa.array(times, pa.list_(pa.int64()))], ["island", "patterns", "bins"])

        found: dict[int, list[Solution]] = {}
        for r in spark.range(islands, numPartitions=islands).mapInArrow(run, "island long, patterns array<array<int>>, bins array<long>").collect():
            solution = [(tuple(zip(p[::2], p[1::2])), n) for p, n in zip(r.patterns, r.bins)]
            found.setdefault(r.island, []).append(solution)
        for island, solutions in found.items():
            solutions.sort(key=lambda s: fitness(s, capacity))
            best = min(best or solutions[0], solutions[0], key=lambda s: fitness(s, capacity))
        migrants = {i: s + found[(i - 1) % islands][:ELITES] for i, s in found.items()}
    return best


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each document's ids and ``end``, cut only where longer than the capacity: ``doc_id, piece, start, length, ids_crc32`` and the place ``part, nth`` among pieces of its length in its task."""
    ready(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def cut(batches):
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.encode(text) + tail
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    data = ids[at : at + 4 * capacity]
                    n = len(data) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(data), part, int(seen[n])))
                    seen[n] += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, kinds)], names)

    return id_text(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def places(solution: Solution) -> dict[int, np.ndarray]:
    """For each length its runs of places, in order: first rank, times in a bin, first bin, offset of the first."""
    runs: dict[int, list] = {}
    ranks: dict[int, int] = {}
    bins = 0
    for pattern, n in solution:
        offset = 0
        for length, times in pattern:
            runs.setdefault(length, []).append((ranks.get(length, 0), times, bins, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += length * times
        bins += n
    return {length: np.array(r, np.int64) for length, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``docs``: ``doc_id, text``; other columns are not read. Null text counts as
    empty, which is a piece of ``end`` alone; null and repeated ids keep their
    rows; an empty table gives an empty result. Texts are encoded whole; only
    documents over ``capacity`` are cut, into pieces of ``capacity`` and a last
    one that may be shorter. Each sequence's pieces fill it from 0 without gaps.

    Texts don't move. Pieces are written once; a rank within each length comes
    from counts by task and length, which meet the pieces in a sort-merge join, so
    a length that many documents share gathers nowhere; and a broadcast table of the solution's patterns, whose
    size the capacity bounds, gives each rank its place.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer, capacity, end), work_dir(spark, "pieces"))
    sizes = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), work_dir(spark, "lengths"))
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(search(spark, counts, capacity)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")).hint("merge")
    ranked = pieces.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        of = table.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at = np.flatnonzero(length == size)
                run = of[size][np.searchsorted(of[size][:, 0], rank[at], side="right") - 1]
                bin_, nth = np.divmod(rank[at] - run[:, 0], run[:, 1])
                sequence[at], offset[at] = run[:, 2] + bin_, run[:, 3] + nth * size
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
