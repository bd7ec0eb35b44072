"""Choice of items that cover most weight under a budget: lazy greedy in parts, then over what the parts chose."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.graphs import written

#: Items that one task chooses from.
PART = 5000


def lazy_greedy(items: list[tuple], weights: dict, capacity: float) -> list[tuple]:
    """(item, size, gain) in the order of choice; items: (item, size, concepts).

    The item of most new weight for its size is next, the smaller item of equal ones.  A gain only falls as more is covered, so an old
    one is a bound: only the item on top of the heap is measured again.
    """
    held = [(i, size, set(cs)) for i, size, cs in items]
    bounds = [math.fsum(weights[c] for c in cs) for _, _, cs in held]
    chosen = choose([i for i, _, _ in held], [size for _, size, _ in held], bounds, lambda at: {c: weights[c] for c in held[at][2]}, capacity)
    return [(*held[at][:2], gain) for at, gain in chosen]


def choose(ids: list, sizes: list, bounds: list[float], concepts: Callable[[int], dict], capacity: float) -> list[tuple[int, float]]:
    """(place, gain) in the order of choice.  ``bounds`` are no less than the weights of an item's ``concepts``, which are asked for only
    where a bound is on top of the heap, so few items of many become objects."""
    heap = [(-bound / max(1, size), i, at) for at, (i, size, bound) in enumerate(zip(ids, sizes, bounds)) if size <= capacity]
    heapq.heapify(heap)
    covered, left, out = set(), capacity, []
    while heap:
        _, i, at = heapq.heappop(heap)
        if sizes[at] > left:
            continue
        own = concepts(at)
        gain = math.fsum(w for c, w in own.items() if c not in covered)
        entry = (-gain / max(1, sizes[at]), i, at)
        if heap and entry[:2] > heap[0][:2]:
            heapq.heappush(heap, entry)
            continue
        if gain <= 0:
            break
        out.append((at, gain))
        covered |= own.keys()
        left -= sizes[at]
    return out


def best_coverage(items: DataFrame, covers: DataFrame, weights: DataFrame, capacity: float, part: int = PART) -> DataFrame:
    """(item, position, size, gain): items whose sizes sum to ``capacity`` at most and whose concepts weigh much together.

    items: (item, size); covers: (item, concept); weights: (concept, weight), not negative; concepts without one weigh 1.  Items are dealt to parts of
    about ``part``; each part is solved by lazy greedy, and what the parts choose is dealt and solved again, until one part holds all.  The
    result is the best of that choice, of each part's own, and of the best single item.  With one part this is plain greedy.  Nulls take no
    part; an item without concepts is never chosen; sizes under one count as one where gains are compared.
    """
    known = weights.where("concept IS NOT NULL").groupBy("concept").agg(F.max("weight").alias("weight"))
    sizes = items.where("item IS NOT NULL AND size IS NOT NULL AND size >= 0").groupBy("item").agg(F.min("size").cast("double").alias("size")).where(F.col("size") <= capacity)
    named = covers.where("item IS NOT NULL AND concept IS NOT NULL").select("item", "concept")
    n = sizes.join(named.select("item").distinct(), "item", "left_semi").count()
    parts = max(1, -(-n // part))
    dealt = lambda df: df.withColumn("part", F.pmod(F.xxhash64("item", F.lit(n)), F.lit(parts)).cast("int"))
    # rows dealt by concept are made distinct and meet their weights where they lie, and are dealt once more, to the parts that solve them
    weighed = named.repartition("concept").distinct().join(known, "concept", "left").select("item", F.struct("concept", F.greatest(F.lit(0.0), F.coalesce("weight", F.lit(1.0))).alias("w")).alias("c"))
    both = dealt(weighed.withColumn("size", F.lit(None).cast("double")).unionByName(sizes.withColumn("c", F.lit(None)), allowMissingColumns=True))
    held = both.repartition(max(parts, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "part").groupBy("part", "item").agg(F.max("size").alias("size"), F.collect_list("c").alias("concepts"))
    now = held.where("size IS NOT NULL AND size(concepts) > 0").select("item", "size", "concepts", "part")
    id_type, concept_type = now.schema["item"].dataType.simpleString(), now.schema["concepts"].dataType.simpleString()
    schema = f"item {id_type}, size double, concepts {concept_type}, position int, gain double, part int"

    def solve(key: tuple, group: pa.Table) -> pa.Table:
        lists = group.column("concepts").combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        starts, flat = lists.offsets.to_numpy(), lists.values
        names, w = flat.field("concept"), flat.field("w").to_numpy(zero_copy_only=False)
        sums = np.add.reduceat(np.append(w, 0.0), starts[:-1]) if len(lists) else np.zeros(0)
        parts_of = lambda at: dict(zip(names.slice(starts[at], starts[at + 1] - starts[at]).to_pylist(), w[starts[at] : starts[at + 1]].tolist()))
        # sums of any order are off by less than this, and a bound may be too high
        ids = group.column("item").to_pylist()
        ranks = {at: k for k, at in enumerate(sorted(range(len(ids)), key=ids.__getitem__))}
        found = choose(ids, group.column("size").to_pylist(), (sums * (1 + 1e-9)).tolist(), parts_of, capacity)
        # at place 0 stands the best single item
        heaviest = np.flatnonzero(sums >= sums.max() * (1 - 1e-9)).tolist()
        gain, single = max(((math.fsum(parts_of(at).values()), at) for at in heaviest), key=lambda x: (x[0], -ranks[x[1]]))
        found = [(single, gain), *found]
        out = group.select(["item", "size", "concepts"]).take(pa.array([at for at, _ in found], pa.int64()))
        # the result's fields may be null, the rows' may not
        free = pa.list_(pa.field("element", pa.struct([pa.field(f.name, f.type) for f in flat.type])))
        out = out.set_column(2, "concepts", out.column("concepts").cast(free))
        rest = {"position": pa.array(range(len(found)), pa.int32()), "gain": pa.array([g for _, g in found], pa.float64()), "part": pa.array([key[0].as_py()] * len(found), pa.int32())}
        for name, column in rest.items():
            out = out.append_column(name, column)
        return out

    best, value, first = None, -1.0, None
    while True:
        solved = written(now.groupBy("part").applyInArrow(solve, schema), "chosen")
        chosen = solved.where("position > 0")
        if first is None:
            single = solved.where("position = 0").orderBy(F.desc("gain"), "item").limit(1).select("item", F.lit(1).alias("position"), "size", "gain")
            first = single.first()
            if first is None:
                return single
        top = chosen.groupBy("part").agg(F.sum("gain").alias("value")).orderBy(F.desc("value"), "part").first()
        if top is not None and top.value > value:
            best, value = chosen.where(F.col("part") == top.part), top.value
        if parts == 1:
            break
        left = chosen.count()
        if left >= n:  # parts keep all they hold: larger ones are needed
            part *= 2
        n = left
        parts = max(1, -(-n // part))
        now = dealt(chosen.select("item", "size", "concepts"))
    if best is None or first.gain > value:
        return single
    return best.select("item", "position", "size", "gain")
