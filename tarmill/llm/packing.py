"""Problem 3: items of varying length into containers of fixed capacity.

Method: configuration linear program over the length histogram, solved by multiplicative weights with knapsack
dynamic-programming pricing, then rounded. Only the histogram (one number for each length up to the capacity) reaches the
driver; the result of the program is a list of patterns with multiplicities, and items find their container by their rank
within their length, computed without collecting any length's items in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmill.runtime import ranked

RESERVES = 20  # shares of the room that are tried
PROBES = 4  # charges tried in one pricing; the next goes on from the last


@dataclass(frozen=True)
class Pattern:
    """times containers that each hold take[l] items of length l."""

    take: dict[int, int]
    times: int


def _knapsack(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """Most valuable multiset of lengths within the capacity, by dynamic programming over the room used."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = np.searchsorted(lengths, room, side="right")
        if k:
            gain = best[room - lengths[:k]] + values[:k]
            j = int(gain.argmax())
            if gain[j] > best[room] + 1e-15:
                best[room], pick[room] = gain[j], j
    take: dict[int, int] = {}
    room = capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        n = int(lengths[pick[room]])
        take[n] = take.get(n, 0) + 1
        room -= n
    return take


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int, most: int, charge: float) -> tuple[dict[int, int], float, float]:
    """(pattern, upper bound on what any pattern is worth, charge for the next call) with at most `most` items.

    An item costs a charge that is moved until about `most` items remain. Whatever the charge, the best pattern under it and
    the charge of `most` items bound the worth of every pattern, so the least of these bounds holds for the program.
    """
    worth = lambda t: float(sum(values[at[n]] * k for n, k in t.items()))
    at = {int(n): j for j, n in enumerate(lengths)}
    free = _knapsack(values, lengths, capacity)
    found, above = {int(lengths[values.argmax()]): 1}, worth(free)
    if sum(free.values()) <= most:
        return free, above, charge
    low, high = 0.0, float(values.max())
    for _ in range(PROBES):
        take = _knapsack(values - charge, lengths, capacity)
        above = min(above, worth(take) - charge * sum(take.values()) + charge * most)
        if sum(take.values()) <= most:
            high = charge
            if worth(take) > worth(found):
                found = take
        else:
            low = charge
        charge = (low + high) / 2
    spare, room = most - sum(found.values()), capacity - sum(n * k for n, k in found.items())
    for j in np.argsort(-values):  # room and items that the charge left over
        n = int(lengths[j])
        k = min(spare, room // n)
        if k > 0:
            found[n] = found.get(n, 0) + k
            spare, room = spare - k, room - n * k
    return found, max(above, worth(found)), high


def _fill(left: dict[int, int], capacity: int, most: int) -> list[Pattern]:
    """The fewest containers that _filled() needs, over shares of the room that large items leave to small ones."""
    ways = (_filled(left, capacity, most, capacity * k // RESERVES) for k in range(RESERVES))
    return min(ways, key=lambda ps: sum(p.times for p in ps))


def _filled(left: dict[int, int], capacity: int, most: int, reserve: int) -> list[Pattern]:
    """Containers for what rounding left, by length: the largest items first, each at its best fit and `reserve` of the room kept free if
    one item alone doesn't need it, then small items in the proportions in which they are left, so that no heap of the least items remains, which the item limit would let fill only
    in part. Each pattern is repeated while all its lengths last, so the turns grow with the lengths, not with the containers."""
    small = max(1, capacity // 40)
    left = {n: k for n, k in left.items() if k > 0}
    out: dict[tuple[tuple[int, int], ...], int] = {}
    while left:
        take: dict[int, int] = {}
        room, spare = capacity, most
        for n in sorted((n for n in left if n > small), reverse=True):
            k = min(left[n], max((room - reserve) // n, 0 if take else 1), spare)
            if k > 0:
                take[n], room, spare = k, room - n * k, spare - k
        tiny = {n: k for n, k in left.items() if n <= small}
        volume = sum(n * k for n, k in tiny.items())
        if tiny and room:
            share = min(1.0, room / volume, spare / sum(tiny.values()))
            for n in sorted(tiny, reverse=True):
                k = min(int(tiny[n] * share), room // n, spare)
                if k > 0:
                    take[n], room, spare = k, room - n * k, spare - k
            for n in sorted(tiny, reverse=True):  # what the shares' rounding left open
                k = min(tiny[n] - take.get(n, 0), room // n, spare)
                if k > 0:
                    take[n], room, spare = take.get(n, 0) + k, room - n * k, spare - k
        times = min(left[n] // k for n, k in take.items())
        key = tuple(sorted(take.items()))
        out[key] = out.get(key, 0) + times
        for n, k in take.items():
            left[n] -= k * times
        left = {n: k for n, k in left.items() if k > 0}
    return [Pattern(dict(p), k) for p, k in out.items()]


def configurations(histogram: dict[int, int], capacity: int, most: int, rounds: int = 160, rate: float = 0.6) -> tuple[list[Pattern], float]:
    """Patterns that hold exactly the histogram, and a lower bound on the number of containers.

    Multiplicative weights: each length's weight falls as it is covered; the pattern of most weight is priced by dynamic
    programming and added. The patterns with their steps, scaled to cover the demand, solve the configuration program the
    more nearly the more rounds there are; each round's weights also give a dual
    bound. No rounds are needed where filling by length is
    within one container of that bound. The fewest containers of three ways
    are kept: the solution's multiplicities rounded down, the largest multiplicities that the demand bears in the order in
    which the patterns were found, and no patterns. Each fills the rest by length.
    """
    plain, bound = _fill(histogram, capacity, most), _even(histogram, capacity, most)
    if sum(p.times for p in plain) < bound + 1:
        return plain, bound  # equal prices for equal room, or for items, solve the dual program: no packing has fewer
    ways, bound = candidates(histogram, capacity, most, rounds, rate)
    return min(ways.values(), key=lambda ps: sum(p.times for p in ps), default=[]), bound


def _even(histogram: dict[int, int], capacity: int, most: int) -> float:
    """Value of the dual program at prices by length alone, or the same for each item."""
    return max(sum(n * k for n, k in histogram.items()) / capacity, sum(histogram.values()) / most)


def candidates(histogram: dict[int, int], capacity: int, most: int, rounds: int = 160, rate: float = 0.6) -> tuple[dict[str, list[Pattern]], float]:
    """The packings that configurations() chooses from, by name, and the bound; no packing for an empty histogram."""
    histogram = {n: k for n, k in histogram.items() if k > 0}
    if not histogram:
        return {}, 0.0
    if max(histogram) > capacity or min(histogram) < 1:
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[n] for n in lengths], float)
    bound = _even(histogram, capacity, most)
    plain = _fill(dict(histogram), capacity, most)
    covered, patterns, charge = np.zeros(len(lengths)), [], 0.0  # patterns with their steps
    for _ in range(rounds):
        weight = np.exp(-rate * (covered - covered.min()))
        values = weight * lengths  # equal weights price full containers
        values = values / values.max()
        take, above, charge = _price(values, lengths, capacity, most, charge)
        a = np.array([take.get(int(n), 0) for n in lengths], float)
        bound = max(bound, float(values @ need) / above)
        step = float((need[a > 0] / a[a > 0]).min())
        patterns.append((tuple(sorted(take.items())), step))
        covered += step * a / need
    own = [(((int(n), min(capacity // int(n), most)),), need[j] / min(capacity // int(n), most)) for j, n in enumerate(lengths) if not covered[j]]
    short = float(covered[covered > 0].min())  # lengths that no round reached have containers of their own in the solution
    share: dict[tuple, float] = {}
    for p, step in patterns:
        share[p] = share.get(p, 0.0) + step / short
    for p, step in own:
        share[p] = share.get(p, 0.0) + step
    ways = {"program": _rounded(sorted(share.items(), key=lambda x: -x[1]), lengths, need, capacity, most)}
    ways["order"] = _rounded([(p, np.inf) for p, _ in patterns], lengths, need, capacity, most)
    ways["plain"] = plain
    return ways, bound


def _rounded(wanted: list[tuple[tuple, float]], lengths: np.ndarray, need: np.ndarray, capacity: int, most: int) -> list[Pattern]:
    """Each pattern as often as wanted, rounded down, as far as the demand that is left bears it; the rest is filled by length."""
    uses: dict[tuple, float] = {}
    room = need.copy()
    for p, x in wanted:
        take = dict(p)
        a = np.array([take.get(int(n), 0) for n in lengths], float)
        k = float(np.floor(min(x + 1e-9, (room[a > 0] / a[a > 0]).min())))
        if k >= 1:
            uses[p] = uses.get(p, 0) + k
            room -= k * a
    return [Pattern(dict(p), int(k)) for p, k in uses.items()] + _fill({int(n): int(r) for n, r in zip(lengths, room)}, capacity, most)


def items(queue: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, list_name, positions array<int>, capacity, max_clips) once for each record and list, positions distinct and in order.

    Null and empty lists hold no position and give no row, as do null ids; null positions and repeats don't count; a repeated
    record counts once, and if rows of one id differ, the union of their positions is taken. limits needs one row a list.
    """
    lists = [F.struct(F.lit(n).alias("list_name"), F.col(n).alias("p")) for n in ("ns", "fix")]
    x = queue.select("id", F.explode(F.array(*lists)).alias("x")).select("id", "x.list_name", F.array_sort(F.array_distinct(F.array_compact("x.p"))).alias("positions"))
    x = x.where("id is not null and size(positions) > 0").distinct()
    x = x.groupBy("id", "list_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return x.join(F.broadcast(limits.select("list_name", "capacity", "max_clips")), "list_name")


def split_records(chunks: DataFrame) -> DataFrame:
    """(id, list_name) of the records that pack() split: those with a second part."""
    return chunks.where("part = 1").select("id", "list_name")


def parts(packed: DataFrame) -> DataFrame:
    """Records cut into parts: only a record beyond the capacity is split, into full parts and at most one rest."""
    n = F.size("positions")
    k = F.explode(F.sequence(F.lit(0), F.ceil(n / F.col("capacity")).cast("int") - 1)).alias("part")
    x = packed.select("id", "list_name", "positions", "capacity", "max_clips", k)
    x = x.withColumn("positions", F.slice("positions", F.col("part") * F.col("capacity") + 1, F.col("capacity")))
    return x.withColumn("n", F.size("positions"))


def pack(queue: DataFrame, limits: DataFrame, rounds: int = 160) -> tuple[DataFrame, DataFrame]:
    """Chunks and a report.

    Chunks: (list_name, chunk long, id, part, n, positions), every part once, no chunk beyond capacity or max_clips.
    Report: (list_name, records, chunks, bound, room_used): bound is a lower bound on the chunks of any packing.
    The histogram that reaches the driver has at most one row for each list and length up to the capacity.
    """
    spark = queue.sparkSession
    x = parts(items(queue, limits))
    hist: dict[str, dict[int, int]] = {}
    cap: dict[str, tuple[int, int]] = {}
    for r in x.groupBy("list_name", "capacity", "max_clips", "n").count().collect():
        hist.setdefault(r["list_name"], {})[r["n"]] = r["count"]
        cap[r["list_name"]] = (r["capacity"], r["max_clips"])
    ranges, report = [], []
    for name, h in sorted(hist.items()):
        patterns, bound = configurations(h, *cap[name], rounds)
        base, start = 0, dict.fromkeys(h, 0)
        for p in patterns:
            for n, k in sorted(p.take.items()):
                ranges.append((name, n, start[n], k, base))
                start[n] += k * p.times
            base += p.times
        used = sum(n * k for n, k in h.items()) / (base * cap[name][0])
        report.append((name, sum(h.values()), base, float(bound), used))
    small = spark.createDataFrame(ranges, "list_name string, n int, start long, k int, base long").groupBy("list_name", "n").agg(F.array_sort(F.collect_list(F.struct("start", "k", "base"))).alias("ranges"))
    r = ranked(x, ["list_name", "n"], F.xxhash64(F.lit(1), "id", "part")).withColumn("r", F.col("rank") - 1)
    y = r.join(F.broadcast(small), ["list_name", "n"])  # bounded by the patterns, not by the items
    hit = F.element_at(F.filter("ranges", lambda s: s["start"] <= F.col("r")), -1)
    chunks = y.withColumn("hit", hit).select("list_name", (F.col("hit")["base"] + F.floor((F.col("r") - F.col("hit")["start"]) / F.col("hit")["k"])).alias("chunk"), "id", "part", "n", "positions")
    return chunks, spark.createDataFrame(report, "list_name string, records long, chunks long, bound double, room_used double")
