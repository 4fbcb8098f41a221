"""p8: texts put into containers of fixed capacity.

Method: grouping genetic algorithm. A solution is a set of containers; crossover
injects whole well-filled containers of one parent into the other, drops the
containers that hold duplicates, and best-fits the displaced texts after single
ones changed places with those of a container. Blocks of texts evolve on several
islands at once, from random orders; after each epoch every island passes its
elite to the next one. A block that has reached the lower bound of its containers
is done. What the best island of each block leaves in poorly filled containers is
pooled over all blocks and packed again.

A text above the capacity is cut into full pieces and one rest; only such texts
are cut. Blocks have a bounded number of texts whatever the corpus, chosen by
hash, so no task gathers more than one block.

Defined results: empty and null texts have no container; blank texts have
tokens and are packed; a repeated row counts once; a capacity below one is an
error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateforge.functions.session import spread, written

CAPACITY = 2048
BLOCK = 1500
#: Islands of a block, epochs with a migration between them, solutions on an island, generations of an epoch, and after how many without a better one it ends.
ISLANDS, EPOCHS, POPULATION, GENERATIONS, STALE = 3, 2, 8, 60, 20
#: Containers filled to less than this share are emptied and packed again with those of other blocks, at most so many times.
POOR, ROUNDS = 0.985, 4


def best_fit(sizes, order, bins, capacity):
    """Puts the items ``order`` into ``bins`` (lists of items), each where least room remains; opens new ones at need."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - sizes[i], k))
    return bins


def fitness(sizes, bins, capacity):
    """Mean squared fill: prefers few containers, and full ones beside an emptier one."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / len(bins) if bins else 1.0


def exchange(sizes, bins, displaced, capacity):
    """Displaced items, after one or two items of a container gave way to a displaced one that fills it better: what is left to place is smaller."""
    loose = sorted((sizes[i], i) for i in displaced)
    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        if not room or not loose:
            continue
        best = (0, None, None)
        groups = [(sizes[i], (i,)) for i in b]
        groups += [(sizes[i] + sizes[j], (i, j)) for k, i in enumerate(b) for j in b[:k]]
        for size, out in groups:
            at = bisect_right(loose, (size + room, len(sizes)))
            if at and loose[at - 1][0] - size > best[0]:
                best = (loose[at - 1][0] - size, out, at - 1)
                if best[0] == room:
                    break
        gain, out, at = best
        if gain:
            _, i = loose.pop(at)
            for j in out:
                b.remove(j)
                insort(loose, (sizes[j], j))
            b.append(i)
    return [i for _, i in reversed(loose)]


def crossover(sizes, mother, father, capacity, rng):
    """A child of ``mother`` with whole well-filled containers of ``father``; the displaced items are put where they fit best."""
    fill = lambda b: sum(sizes[i] for i in b)
    ranked = sorted(father, key=fill, reverse=True)
    top = ranked[: max(1, len(ranked) // 2)]
    gift = [list(b) for b in top if rng.random() < 0.5] or [list(top[0])]
    given = {i for b in gift for i in b}
    kept, displaced = [], []
    for b in mother:
        if given.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in given]
    # the emptiest of the kept containers and one by chance are opened too, so that their items find better places
    kept.sort(key=fill)
    opened = 1 + len(kept) // 20
    if len(kept) > opened:
        kept.insert(0, kept.pop(rng.randrange(opened, len(kept))))
    for b in kept[: opened + 1]:
        displaced += b
    bins = kept[opened + 1 :] + gift
    return best_fit(sizes, exchange(sizes, bins, displaced, capacity), bins, capacity)


def evolve(sizes, seeds, capacity, rng, population=POPULATION, generations=GENERATIONS):
    """The best solution found from ``seeds`` (solutions of earlier epochs) by the genetic algorithm.

    The first solutions fit the items in random order; what makes them good is
    the crossover. It ends at the lower bound of containers, or when nothing
    better came for ``STALE`` generations.
    """
    n = len(sizes)
    people = [[list(b) for b in s] for s in seeds]
    while len(people) < population:
        order = list(range(n))
        rng.shuffle(order)
        people.append(best_fit(sizes, order, [], capacity))
    scored = sorted(((fitness(sizes, p, capacity), -k, p) for k, p in enumerate(people)), reverse=True)
    bound = -(-sum(sizes) // capacity)
    tick, better = len(scored), 0
    for generation in range(generations):
        if len(scored[0][2]) <= bound or generation - better > STALE:
            break
        best = scored[0][0]
        for _ in range(population):
            a, b = rng.sample(scored[: max(2, population // 2 + 1)], 2)
            child = crossover(sizes, a[2], b[2], capacity, rng)
            tick += 1
            scored.append((fitness(sizes, child, capacity), -tick, child))
        scored = sorted(scored, reverse=True)[:population]
        if scored[0][0] > best:
            better = generation
    return scored[0][2]


ITEM = "doc_id bigint, h bigint, piece int, start int, size int"


def _epoch(items: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """One epoch on every island; ``items`` has block, island, kind (0 own, 1 immigrant, null at first) and bin."""

    def run(key, pdf):
        import random

        block, island = int(key[0]), int(key[1])
        rng = random.Random(block * 1_000_003 + island * 101 + epoch)
        first = pdf[pdf.kind == pdf.kind.min()].sort_values(["doc_id", "h", "piece"]).reset_index(drop=True)
        sizes = first["size"].tolist()
        seeds = []
        if epoch:
            place = {k: i for i, k in enumerate(zip(first.doc_id, first.h, first.piece, strict=True))}
            for _, part in pdf.groupby("kind"):
                bins: dict[int, list[int]] = {}
                for k, b in zip(zip(part.doc_id, part.h, part.piece, strict=True), part.bin, strict=True):
                    bins.setdefault(int(b), []).append(place[k])
                seeds.append([bins[b] for b in sorted(bins)])
        best = evolve(sizes, seeds, capacity, rng)
        where = [0] * len(sizes)
        for b, members in enumerate(best):
            for i in members:
                where[i] = b
        out = first[["doc_id", "h", "piece", "start", "size"]].copy()
        out["block"], out["island"], out["bin"] = block, island, where
        out["n_bins"], out["fit"] = len(best), fitness(sizes, best, capacity)
        out["over"] = len(best) + sum(sizes) // -capacity
        return out

    return spread(items, "block", "island").groupBy("block", "island").applyInPandas(run, ITEM + ", block bigint, island int, bin int, n_bins int, fit double, over int")


def _packed(items: DataFrame, n: int, capacity: int, turn: int) -> DataFrame:
    """Items with block and bin of the best island of each block; blocks that have reached their lower bound evolve no further."""
    blocks = max(1, -(-n // BLOCK))
    cast = items.withColumn("block", F.pmod(F.xxhash64(F.lit(turn), "doc_id", "h", "piece"), F.lit(blocks)))
    state = cast.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1)))).withColumn("kind", F.lit(0)).withColumn("bin", F.lit(0))
    out = None
    for epoch in range(EPOCHS):
        done = written(_epoch(state, epoch, capacity), "epoch")
        best = done.groupBy("block").agg(F.min(F.struct("n_bins", (-F.col("fit")).alias("f"), "island")).alias("b"), F.min("over").alias("over"))
        last = epoch == EPOCHS - 1
        ready = best if last else best.where("over <= 0")
        won = done.join(ready.select("block", F.col("b.island").alias("island")), ["block", "island"], "left_semi")
        out = won if out is None else out.unionByName(won)
        if not last:
            going = done.join(best.where("over > 0").select("block"), "block", "left_semi")
            elite = going.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS))).withColumn("kind", F.lit(1))
            state = going.withColumn("kind", F.lit(0)).unionByName(elite)
    return out


def containers(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, size, container of each text or piece; ``sizes``: doc_id, h, n_tokens."""
    if capacity < 1:
        raise ValueError("a container needs room")
    some = sizes.where(F.col("n_tokens") > 0)
    cut = some.select("doc_id", "h", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1)).alias("piece"), "n_tokens")
    start = (F.col("piece") * capacity).cast("int")
    pieces = written(cut.select("doc_id", "h", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n_tokens") - start).cast("int").alias("size")), "pieces")
    out = pieces.where(F.col("size") == capacity).select("doc_id", "piece", "start", "size", F.concat_ws("-", F.lit("full"), "doc_id", "h", "piece").alias("container"))
    rest = pieces.where(F.col("size") < capacity)
    n = rest.count()
    for turn in range(ROUNDS):
        done = written(_packed(rest, n, capacity, turn), "packed")
        fill = done.groupBy("block", "bin").agg(F.sum("size").alias("fill"))
        last = turn == ROUNDS - 1 or n <= BLOCK
        good = fill if last else fill.where(F.col("fill") >= POOR * capacity)
        placed = done.join(good.select("block", "bin"), ["block", "bin"], "left_semi")
        out = out.unionByName(placed.select("doc_id", "piece", "start", "size", F.concat_ws("-", F.lit(f"r{turn}"), "block", "bin").alias("container")))
        if last:
            break
        rest = done.join(good.select("block", "bin"), ["block", "bin"], "left_anti").select("doc_id", "h", "piece", "start", "size")
        n = rest.count()
        if not n:
            break
    return out
