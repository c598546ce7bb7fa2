"""Sharding by a hierarchical weighted hash tree, with DataFrame functions only.

A row descends region, rack and shard levels. At each level every child draws -ln(u) / weight from a hash of the row's
key and the child's name, and the smallest draw wins, so a child gets its weight's share. A draw depends on the child
alone: a change of weights moves rows only into or out of the subtrees whose weights change.

A region has RACKS * SHARDS places. Places without a shard, and shards of weight 0, are closed. In a region with closed
places the descent goes on from closed place to place: each next one is drawn among the places left, and its time is the
last time plus a draw for the weight left. That is the order in which independent draws of all places would come, so the
first open place is reached at its own time, and opening or closing a place moves only rows that it takes or gives up.
The law so holds from every number of shards to the next.

Slots number the rows of a shard from 0 without gaps. They are two-level: counts of the SUB hash buckets of a shard, and
the row's place in its bucket, which id and text choose; no task ever holds a shard.

Defined cases: a null text has size 16 and no CRC; a null doc_id is a key of its own; rows of equal doc_id share a shard
and get a slot each; an empty table gives an empty result; a tree without an open shard is refused.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents

SHARDS_OF_QUERY = 40
RACKS, SHARDS = 2, 4
SUB = 256


class Leaf(NamedTuple):
    shard: int
    weight: float
    open: bool


class Rack(NamedTuple):
    name: str
    leaves: list[Leaf]


class Region(NamedTuple):
    name: str
    racks: list[Rack]

    def leaves(self) -> list[Leaf]:
        return [leaf for rack in self.racks for leaf in rack.leaves]


def tree_of(n: int, weights: dict[int, float] | None = None, racks: int = RACKS, shards: int = SHARDS) -> list[Region]:
    """Regions, racks and places of n shards. A closed place weighs 1 among the places that are drawn."""
    weigh, out = (weights or {}).get, []
    for a in range(0, n, racks * shards):
        places = range(a, a + racks * shards)
        leaves = [Leaf(s, float(weigh(s, 1.0)) or 1.0, s < n and weigh(s, 1.0) > 0) for s in places]
        out.append(Region(f"region{a // (racks * shards)}", [Rack(f"rack{(a + i) // shards}", leaves[i : i + shards]) for i in range(0, len(leaves), shards)]))
    out = [region for region in out if any(leaf.open for leaf in region.leaves())]
    if not out:
        raise ValueError("no shard is open")
    return out


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw of rate weight: 48 hash bits as a fraction, and its logarithm; never for weight 0."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), name).cast("binary")), 1, 12), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 48))) / weight).otherwise(F.lit(math.inf))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _leaves(leaves: list[Leaf]) -> Column:
    return F.array(*[F.struct(F.lit(f"shard{s.shard}").alias("name"), F.lit(s.weight).alias("weight"), F.lit(s.shard).alias("shard"), F.lit(s.open).alias("open")) for s in leaves])


def _weight(leaves: list[Leaf]) -> float:
    return sum(leaf.weight for leaf in leaves)


def _descend(key: Column, regions: list[Region]) -> Column:
    """time and shard of the place that a row reaches in regions without a closed place."""
    rack = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(_weight(r.leaves)).alias("weight"), _leaves(r.leaves).alias("below"))
    nodes = F.array(*[F.struct(F.lit(g.name).alias("name"), F.lit(_weight(g.leaves())).alias("weight"), F.array(*map(rack, g.racks)).alias("below")) for g in regions])
    least = lambda nodes: F.array_min(F.transform(nodes, lambda n: F.struct(draw(key, n["name"], n["weight"]).alias("time"), n.alias("node"))))
    return _let(least(nodes), lambda region: F.struct(region["time"].alias("time"), least(least(region["node"]["below"])["node"]["below"])["node"]["shard"].alias("shard")))


def _sequence(key: Column, region: Region) -> Column:
    """time and shard of the first open place of a region with closed ones; a step draws the next place of those left."""
    count = len(region.leaves())
    ordered = [F.transform(F.array_sort(F.transform(_leaves(r.leaves), lambda s: F.struct(draw(key, s["name"], s["weight"]).alias("draw"), s.alias("leaf")))), lambda x: x["leaf"]) for r in region.racks]
    start = F.struct(F.lit(0.0).alias("time"), F.lit(-1).alias("shard"), F.array(*ordered).alias("left"))
    names = F.array(*[F.lit(r.name) for r in region.racks])
    total = lambda leaves: F.aggregate(leaves, F.lit(0.0), lambda a, s: a + s["weight"])

    def step(state: Column, t: Column) -> Column:
        mark = F.when(t == 0, F.lit("")).otherwise(F.concat(F.lit("/"), t.cast("string")))
        racks = F.transform(state["left"], lambda leaves, i: F.struct(draw(key, F.concat(names[i], mark), total(leaves)).alias("draw"), i.alias("i")))
        wait = draw(key, F.concat(F.lit(region.name), mark), F.aggregate(state["left"], F.lit(0.0), lambda a, leaves: a + total(leaves)))

        def take(i: Column) -> Column:
            leaf = state["left"][i][0]
            left = F.transform(state["left"], lambda leaves, j: F.when(i == j, F.slice(leaves, F.lit(2), F.size(leaves))).otherwise(leaves))
            return F.struct((state["time"] + wait).alias("time"), F.when(leaf["open"], leaf["shard"]).otherwise(-1).alias("shard"), left.alias("left"))

        return F.when(state["shard"] >= 0, state).otherwise(_let(F.array_min(racks)["i"], take))

    return F.aggregate(F.array(*map(F.lit, range(count))), start, step, lambda state: F.struct(state["time"].alias("time"), state["shard"].alias("shard")))


def place(key: Column, tree: list[Region]) -> Column:
    """The shard of a key."""
    whole = [region for region in tree if all(leaf.open for leaf in region.leaves())]
    reached = [_sequence(key, region) for region in tree if region not in whole]
    return F.array_min(F.array(*reached, *([_descend(key, whole)] if whole else [])))["shard"]


_OUT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard(docs: DataFrame, n: int = SHARDS_OF_QUERY, weights: dict[int, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, size, text_crc32, law, shard, slot and grown_shard, the shard among n + 1. A kept
    column of the name of another result column is called in_<name>."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.col("text").cast("string").cast("binary")
    order = F.md5(F.concat(key, F.lit("|slot|"), F.coalesce(F.crc32(text).cast("string"), F.lit("null"))).cast("binary"))
    placed = [place(key, tree_of(n, weights)).alias("_shard"), order.alias("_order"), F.substring(order, 1, 2).alias("_sub")]
    kept = F.struct(F.col("doc_id"), *[F.col(c).alias(f"in_{c}" if c in _OUT else c) for c in keep if c != "doc_id"]).alias("_row")
    rows = docs.select(kept, (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint").alias("_size"), F.crc32(text).alias("_crc"), place(key, tree_of(n + 1, weights)).alias("_grown"), *placed)
    counts = docs.select(*placed).groupBy("_shard", "_sub").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_shard", "_sub", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("_shard", "_sub").orderBy("_order", "_row.doc_id", "_crc", "_size")
    rows = rows.withColumn("_place", F.row_number().over(within)).join(counts, ["_shard", "_sub"])
    return rows.select("_row.*", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), (F.col("_ahead") + F.col("_place") - 1).cast("bigint").alias("slot"), F.col("_grown").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


def _point(name: str, weight: str) -> str:
    return f"-ln((CAST('0x' || substr(md5(key || '|' || {name}), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0) / {weight}"


def _values(regions: list[Region]) -> str:
    rows = [f"('{g.name}', {_weight(g.leaves())}, '{k.name}', {_weight(k.leaves)}, {s.shard}, {s.weight}, {s.open})" for g in regions for k in g.racks for s in k.leaves]
    return f"(VALUES {', '.join(rows)}) AS v(region, gw, rack, kw, shard, w, open)"


def _placed(n: int, tag: str) -> str:
    """c<tag>: the shard of each key among n. Places of regions with closed ones are walked by a recursion: in each rack the
    places are ranked by their draws, and a step takes the next of one rack."""
    tree = tree_of(n)
    whole = [region for region in tree if all(leaf.open for leaf in region.leaves())]
    rest, leaf = [region for region in tree if region not in whole], "'shard' || CAST(shard AS VARCHAR)"
    parts, out = [], ""
    if whole:
        parts.append(f"SELECT key, shard, time FROM w{tag}")
        out += f"""v{tag} AS (SELECT * FROM {_values(whole)}),
a{tag} AS (SELECT key, arg_min(region, x) AS region, min(x) AS time FROM (SELECT key, region, {_point('region', 'gw')} AS x FROM keys, (SELECT DISTINCT region, gw FROM v{tag})) GROUP BY key),
b{tag} AS (SELECT key, any_value(time) AS time, arg_min(rack, {_point('rack', 'kw')}) AS rack FROM a{tag} JOIN (SELECT DISTINCT region, rack, kw FROM v{tag}) USING (region) GROUP BY key),
w{tag} AS (SELECT key, any_value(time) AS time, arg_min(shard, {_point(leaf, 'w')}) AS shard FROM b{tag} JOIN v{tag} USING (rack) GROUP BY key),
"""
    for i, region in enumerate(rest):
        t, mark = f"{tag}_{i}", "CASE WHEN t = 0 THEN '' ELSE '/' || CAST(t AS VARCHAR) END"
        left = [f"(SELECT coalesce(sum(s.w), 0) FROM unnest(l{j}) AS u(s))" for j in range(len(region.racks))]
        lists = ", ".join(f"list({{'w': w, 'shard': shard, 'open': open}} ORDER BY x) FILTER (rack = '{r.name}') AS l{j}" for j, r in enumerate(region.racks))
        draws = ", ".join(f"CASE WHEN w{j} > 0 THEN {_point(f'{chr(39)}{r.name}{chr(39)} || mark', f'w{j}')} ELSE 1e300 END AS x{j}" for j, r in enumerate(region.racks))
        weights = ", ".join(f"list_sum(list_transform(l{j}, lambda s: s.w)) AS w{j}" for j in range(len(region.racks)))
        least = f"least({', '.join(f'x{j}' for j in range(len(region.racks)))}, 1e300)"
        head = "CASE " + " ".join(f"WHEN x{j} = {least} THEN l{j}[1]" for j in range(len(region.racks))) + " END"
        rests = ", ".join(f"CASE WHEN pick = {j} THEN l{j}[2:] ELSE l{j} END" for j in range(len(region.racks)))
        pick = "CASE " + " ".join(f"WHEN x{j} = {least} THEN {j}" for j in range(len(region.racks))) + " END"
        names = ", ".join(f"l{j}" for j in range(len(region.racks)))
        wait = _point(f"'{region.name}' || mark", f"({' + '.join(f'coalesce(w{j}, 0)' for j in range(len(region.racks)))})")
        out += f"""o{t} AS (SELECT key, {lists} FROM (SELECT key, rack, shard, w, open, {_point(leaf, 'w')} AS x FROM keys, {_values([region])}) GROUP BY key),
s{t}(key, t, time, shard, {names}) AS (SELECT key, 0, CAST(0 AS DOUBLE), -1, {names} FROM o{t} UNION ALL
  SELECT key, t + 1, time + wait, CASE WHEN head.open THEN head.shard ELSE -1 END, {rests}
  FROM (SELECT *, {head} AS head, {pick} AS pick, {wait} AS wait FROM (SELECT *, {draws} FROM (SELECT *, {mark} AS mark, {weights} FROM s{t} WHERE shard < 0)))),
"""
        parts.append(f"SELECT key, shard, time FROM s{t} WHERE shard >= 0")
    return f"{out}c{tag} AS (SELECT key, arg_min(shard, time) AS shard FROM ({' UNION ALL '.join(parts)}) GROUP BY key)"


def sql(n: int = SHARDS_OF_QUERY) -> str:
    """The same in DuckDB; CRC-32 byte by byte from a table that is computed."""
    return rf"""
WITH RECURSIVE steps(i, j, c) AS (SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) AS t(i) UNION ALL
  SELECT i, j + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE j < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE j = 8),
d AS (SELECT doc_id, text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
keys AS (SELECT DISTINCT key FROM d),
{_placed(n, '0')},
{_placed(n + 1, '1')},
h AS (SELECT doc_id, key, text, hex(text) AS x FROM d),
q AS (SELECT h.*, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))) AS bytes FROM h),
z AS (SELECT doc_id, key, text, CASE WHEN text IS NOT NULL THEN xor(list_reduce(bytes, lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256])), 4294967295) END AS crc FROM q, crc)
SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size, CAST(z.crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(c0.shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY c0.shard ORDER BY md5(key || '|slot|' || coalesce(CAST(z.crc AS VARCHAR), 'null')), doc_id, z.crc, strlen(text)) - 1 AS slot, CAST(c1.shard AS INTEGER) AS grown_shard
FROM z JOIN c0 USING (key) JOIN c1 USING (key)
"""


SQL = sql()
