"""MinHash near-duplicates by tensored banding.

Two collections, A and B, of ``SIDE`` small keys of ``WIDTH`` minhashes each are computed. A table key is a pair of one A
and one B key, so SIDE * SIDE tables of 2 * WIDTH minhashes cost 2 * SIDE * WIDTH minhash computations, about a square
root of what independent tables would. Pairs are only formed from small keys that collide at all: a key which nobody
shares cannot be part of a shared table key. At similarity 0.8 a link is missed with probability below 0.0004.

Documents with equal shingle sets are one class, so copies are never compared with each other. In each table bucket all
members are compared with one centre; links are joined to components; then all pairs that are still in different components are
compared too, so no shared bucket leaves a pair unresolved and no bucket is capped. Comparisons are exact, on full shingle sets made from whole texts.

The second comparison works on pools: classes that buckets connect, whether their pairs are links or not. A pool is cut
into blocks, and pairs of blocks are compared in one task each, which returns links only. A pool above POOL members is
not compared as a whole but by shared small keys, which every pair of a bucket has.

Defined cases: a document without words or text has an empty set and is linked with nothing; a null doc_id is linked
with nothing and has no component, and its row is kept; rows of equal doc_id are rows of their own that share an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X
from .common import discard, documents, stash

SHINGLE, PERCENT = 4, 80
SIDE, WIDTH = 12, 3
#: A list of class ids and ids (some 64 bytes a row) of at most so many rows may be broadcast.
MOST_BROADCAST = 1_000_000
#: A value on more rows than HOT is looked up by broadcast; there are at most MOST_HOT of them, as the least number of
#: rows grows with the table.
HOT, MOST_HOT = 1_000, 100_000
#: Members compared with one centre in one task.
GROUP = 500
#: Members in a block of a pool; members up to which a pool is compared as one, and not by its shared small keys.
SQUARE, POOL = 512, 50_000
#: Minhashes of the estimate before an exact comparison in a pool, and how many must agree: at similarity 0.8 fewer do
#: with a probability of about 0.00005.
GUESS, AGREE = 128, 84


def signatures(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 * SIDE small keys of each document; zeros where it has no shingle."""
    n = len(bounds) - 1
    keys = np.zeros((n, 2 * SIDE), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return keys
    at = bounds[:-1][full]
    factors, offsets = X.constants(2 * SIDE * WIDTH, 17), X.constants(2 * SIDE * WIDTH, 19)
    for j in range(2 * SIDE):
        key = np.zeros(len(full), np.uint64)
        for i in range(j * WIDTH, (j + 1) * WIDTH):
            h = grams * factors[i]
            h ^= h >> np.uint64(32)
            h *= offsets[i]
            key = X.mix64(key + np.minimum.reduceat(h, at))
        keys[full, j] = key
    return keys


def minhashes(grams: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n plain minhashes of 32 bits of each non-empty set, for the estimate before an exact comparison."""
    out = np.empty((len(bounds) - 1, n), np.uint32)
    for i, c in enumerate(X.constants(n, 29)):
        h = grams * c
        out[:, i] = np.minimum.reduceat(h ^ h >> np.uint64(29), bounds[:-1]) >> np.uint64(16)
    return out


def _class_ids(grams: np.ndarray, bounds: np.ndarray) -> list[str | None]:
    """128 bits for each distinct set; none for an empty one."""
    sums = []
    for c in X.constants(2, 23):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(X.mix64(grams ^ c), dtype=np.uint64, out=total[1:])
        sums.append(X.mix64(total[bounds[1:]] - total[bounds[:-1]]))
    return [f"{a:016x}{b:016x}" if n else None for a, b, n in zip(sums[0].tolist(), sums[1].tolist(), np.diff(bounds).tolist(), strict=True)]


def profile(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document: size of its set, class id and small keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            buf, offsets = X.buffer_of(block.column("text"))
            grams, bounds = X.shingle_sets(buf, offsets, shingle)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(signatures(grams, bounds).astype(np.int64).ravel()), 2 * SIDE).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_class_ids(grams, bounds), pa.string()), keys], names=["doc_id", "n_shingles", "cid", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id bigint, n_shingles bigint, cid string, keys array<bigint>")


def small_keys(classes: DataFrame) -> DataFrame:
    """(j, key, cid, size) for every small key that at least two classes have."""
    small = classes.select("cid", "size", F.posexplode("keys").alias("j", "key"))
    shared = small.groupBy("j", "key").agg(F.count("*").alias("n")).where("n > 1").select("j", "key")
    return small.join(shared, ["j", "key"])


def buckets(small: DataFrame) -> DataFrame:
    """(bucket, cid, size) for every table bucket that holds at least two classes."""
    a = small.where(F.col("j") < SIDE).select("cid", "size", F.struct("j", "key").alias("a"))
    b = small.where(F.col("j") >= SIDE).select("cid", F.struct("j", "key").alias("b"))
    a = a.groupBy("cid").agg(F.first("size").alias("size"), F.collect_list("a").alias("a"))  # at most SIDE each
    b = b.groupBy("cid").agg(F.collect_list("b").alias("b"))
    pairs = a.join(b, "cid").select("cid", "size", F.explode("a").alias("a"), "b").select("cid", "size", "a", F.explode("b").alias("b"))
    tables = pairs.select("cid", "size", F.xxhash64("a.j", "a.key", "b.j", "b.key").alias("bucket"))
    full = tables.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return tables.join(full, "bucket").select("bucket", "cid", "size")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The pairs (x, y) whose full shingle sets are similar enough. The members y of a centre x are dealt out in groups
    of GROUP; each group gets the text of x once, and its rows stream past it."""
    # only centres of more than one group need their size; there are few, so a frequent centre is in no shuffle by x alone
    wide = pairs.groupBy("x").agg(F.count("*").alias("m")).where(F.col("m") > GROUP)
    wide = stash(wide, "wide")
    wide = F.broadcast(wide) if wide.count() <= MOST_BROADCAST else wide
    groups = F.coalesce(F.ceil(F.col("m") / GROUP), F.lit(1))
    dealt = pairs.join(wide, "x", "left").withColumn("part", F.pmod(F.xxhash64("y"), groups)).select("x", "y", "part")
    member = dealt.join(texts.withColumnRenamed("cid", "y"), "y").select("x", "part", F.lit(1).alias("kind"), "y", "text")
    centre = dealt.select("x", "part").distinct().join(texts.withColumnRenamed("cid", "x"), "x").select("x", "part", F.lit(0).alias("kind"), F.col("x").alias("y"), "text")
    rows = centre.unionByName(member).repartition("x", "part").sortWithinPartitions("x", "part", "kind")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: np.ndarray = np.zeros(0, np.uint64)
        for block in X.blocks(batches):
            buf, offsets = X.buffer_of(block.column("text"))
            grams, bounds = X.shingle_sets(buf, offsets, shingle)
            xs, ys, kinds = block.column("x").to_pylist(), block.column("y").to_pylist(), block.column("kind").to_pylist()
            out: tuple[list[str], list[str]] = ([], [])
            for i, kind in enumerate(kinds):
                own = grams[bounds[i] : bounds[i + 1]]
                if kind == 0:
                    held = own
                    continue
                a, b = len(held), len(own)
                if not a or not b or 100 * min(a, b) < percent * max(a, b):
                    continue
                both = int((held[np.minimum(np.searchsorted(held, own), a - 1)] == own).sum())
                if 100 * both >= percent * (a + b - both):
                    out[0].append(xs[i])
                    out[1].append(ys[i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["x", "y"])

    return rows.mapInArrow(compare, "x string, y string")


def pooled(groups: DataFrame, texts: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (x, y) between members of different labels of each group; groups: gid, m (its size), cid, label.

    A group is cut into blocks of about SQUARE members, and each pair of blocks is one unit of work, whose rows stream in
    together. In it, pairs of different labels whose minhashes agree often enough are compared exactly. Only links leave
    the task."""
    k = F.ceil(F.col("m") / SQUARE).cast("int")
    cut = groups.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("k")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cut = cut.select("gid", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("left"), "cid", "label")
    rows = cut.join(texts, "cid").repartition("gid", "low", "high").sortWithinPartitions("gid", "low", "high")

    def square(rows: list[tuple], text: pa.Array, out: tuple[list[str], list[str]]) -> None:
        cids, labels, left = [r[3] for r in rows], np.unique([r[4] for r in rows], return_inverse=True)[1], np.array([r[5] for r in rows])
        grams, bounds = X.shingle_sets(*X.buffer_of(text), shingle)
        sizes, sketch = np.diff(bounds), minhashes(grams, bounds, GUESS)
        same = rows[0][1] == rows[0][2]
        a, b = (np.arange(len(rows)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        agree = np.zeros((len(a), len(b)), np.uint8)
        for t in range(GUESS):
            agree += sketch[a, t][:, None] == sketch[b, t]
        likely = (agree >= AGREE) & (labels[a][:, None] != labels[b]) & (100 * np.minimum(sizes[a][:, None], sizes[b]) >= percent * np.maximum(sizes[a][:, None], sizes[b]))
        if same:
            likely &= a[:, None] < b
        for i, j in zip(*(v.tolist() for v in np.nonzero(likely)), strict=True):
            p, q = grams[bounds[a[i]] : bounds[a[i] + 1]], grams[bounds[b[j]] : bounds[b[j] + 1]]
            both = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
            if 100 * both >= percent * (len(p) + len(q) - both):
                out[0].append(cids[a[i]])
                out[1].append(cids[b[j]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts_: list[pa.Array] = []
        for block in X.blocks(batches):
            out: tuple[list[str], list[str]] = ([], [])
            keys = list(zip(*[block.column(c).to_pylist() for c in ("gid", "low", "high", "cid", "label", "left")], strict=True))
            text, start = block.column("text"), 0
            for i in range(len(keys) + 1):
                ends = i == len(keys)
                if ends or (held or i > start) and keys[i][:3] != (keys[i - 1] if i > start else held[-1])[:3]:
                    held += keys[start:i]
                    texts_.append(text.slice(start, i - start))
                    start = i
                    if not ends:
                        square(held, pa.concat_arrays(texts_), out)
                        held, texts_ = [], []
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["x", "y"])
        if held:
            out = ([], [])
            square(held, pa.concat_arrays(texts_), out)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["x", "y"])

    order = ["gid", "low", "high", "cid", "label", "left", "text"]
    return rows.select(*order).mapInArrow(compare, "x string, y string")


def _frequent(counted: DataFrame, n: int) -> DataFrame | None:
    """v and w of the rows (v, w, n) that are frequent among n; None where there are none."""
    hot = stash(counted.where(F.col("n") > max(HOT, n // MOST_HOT)).select("v", "w"), "hot")
    return hot if hot.limit(1).count() else None


def _looked_up(rows: DataFrame, column: str, step: DataFrame, name: str, hot: DataFrame | None, spread: str) -> DataFrame:
    """Rows with ``name``: w of the row of step whose v is in the column, or null. All rows of a frequent value would meet in
    one task of a join: what step has for it is broadcast, and its rows are dealt by the column ``spread``."""
    to = step.select(F.col("v").alias("_v"), F.col("w").alias(name))
    if hot is None:
        return rows.join(to, rows[column] == to["_v"], "left").drop("_v")
    hot = F.broadcast(hot.select(F.col("v").alias("_h"), F.col("w").alias("_w")))
    found = rows.join(hot, rows[column] == hot["_h"], "left").withColumn("_k", F.when(F.col("_h").isNull(), F.col(column)).otherwise(F.col(spread)))
    found = found.join(to, F.col("_k") == F.col("_v"), "left")
    return found.select(*rows.columns, F.when(F.col("_h").isNull(), F.col(name)).otherwise(F.col("_w")).alias(name))


def components(links: DataFrame) -> DataFrame:
    """(cid, label): label is the same for all that links connect. In each round every vertex goes to the smallest of its
    neighbours and itself, and links between what has come together vanish. Class ids are hashes, so a vertex is the
    smallest of its neighbours by chance: a chain of 3000 links takes 14 rounds. Only ids in the order of a chain, which
    hashes are not, would take as many rounds as links."""
    edges = stash(links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x <> y").distinct(), "edges")
    labels: DataFrame | None = None
    while n := edges.count():
        ends = edges.select(F.col("x").alias("v"), F.col("y").alias("u")).unionByName(edges.select(F.col("y").alias("v"), F.col("x").alias("u")))
        step = stash(ends.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("w"), F.count("*").alias("n")), "step")
        if labels is None:
            moved = stash(step.select(F.col("v").alias("cid"), F.col("w").alias("label")), "labels")
        else:
            often = labels.groupBy(F.col("label").alias("v")).agg(F.count("*").alias("n"))
            hot = _frequent(often.join(step.select("v", "w"), "v"), labels.count())
            moved = stash(_looked_up(labels, "label", step, "w", hot, "cid").select("cid", F.coalesce("w", "label").alias("label")), "labels")
            discard(labels)
        hot = _frequent(step, 2 * n)
        rest = _looked_up(_looked_up(edges, "x", step, "x2", hot, "y"), "y", step, "y2", hot, "x").where("x2 <> y2")
        rest = stash(rest.select(F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y")).distinct(), "edges")
        discard(edges)
        discard(step)
        edges, labels = rest, moved
    return edges.select(F.col("x").alias("cid"), F.col("y").alias("label")) if labels is None else labels


def clusters(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``; see the module for the rules."""
    return _grouped(docs, shingle, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """clusters() with the class of each row's text, cid, and its group, label; both are null without id or words."""
    spark = docs.sparkSession
    rows = stash(profile(docs, shingle), "profile")
    known = rows.where("cid is not null and doc_id is not null")
    classes = known.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"))
    small = stash(small_keys(classes), "small")
    held = stash(buckets(small), "buckets")
    near = held.select("cid").distinct()
    n = near.count()
    if n:
        chosen = near.join(known.select("cid", "doc_id"), "cid").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
        chosen = F.broadcast(chosen) if n <= MOST_BROADCAST else chosen
        plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in X.blocks(batches):  # an id may be on several rows: the class's text is the one with its id
                buf, offsets = X.buffer_of(block.column("text"))
                got = _class_ids(*X.shingle_sets(buf, offsets, shingle))
                yield block.select(["cid", "text"]).filter(pa.array([a == b for a, b in zip(got, block.column("cid").to_pylist(), strict=True)], pa.bool_()))

        texts = stash(plain.join(chosen, "doc_id").select("cid", "text").mapInArrow(own, "cid string, text string").dropDuplicates(["cid"]), "texts")
        # sets of too different sizes cannot be similar enough; star keeps the others too, as pools are what buckets connect
        centres = held.groupBy("bucket").agg(F.min(F.struct("cid", "size")).alias("c"))
        star = held.join(centres, "bucket").where("c.cid <> cid").select(F.col("c.cid").alias("x"), F.col("c.size").alias("sx"), F.col("cid").alias("y"), F.col("size").alias("sy"))
        star = stash(star.distinct(), "star")
        fitting = star.where(100 * F.least("sx", "sy") >= percent * F.greatest("sx", "sy")).select("x", "y")
        links = stash(verify(fitting, texts, shingle, percent), "links")
        labels = components(links)
        pools = components(star).select("cid", F.col("label").alias("pool")).join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        pools = stash(pools, "pools")
        mixed = pools.groupBy("pool").agg(F.count("*").alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("pool", "m")
        rest = pools.join(mixed, "pool").select("pool", "m", "cid", "label")
        whole = rest.where(F.col("m") <= POOL).select(F.col("pool").alias("gid"), "m", "cid", "label")
        wide = small.where(F.col("j") < SIDE).join(rest.where(F.col("m") > POOL).drop("m"), "cid").withColumn("gid", F.concat_ws(":", "j", "key", "pool"))
        sizes = wide.groupBy("gid").agg(F.count("*").alias("m"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("gid", "m")
        groups = whole.unionByName(wide.join(sizes, "gid").select("gid", "m", "cid", "label"))
        added = stash(pooled(groups, texts, shingle, percent), "links")
        if added.limit(1).count():
            labels = components(links.unionByName(added))
        discard(texts)
    else:
        labels = spark.createDataFrame([], "cid string, label string")
    groups = known.groupBy("cid").agg(F.min("doc_id").alias("least")).join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    groups = stash(groups, "groups")
    least = groups.groupBy(F.col("label").alias("v")).agg(F.min("least").alias("w"), F.count("*").alias("n")).where("n > 1")
    least = stash(least, "least")
    to = _looked_up(groups, "label", least, "component_id", _frequent(least, groups.count()), "cid")
    to = to.select("cid", "label", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("cid")).alias("cid")).join(to, "cid", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", "cid", "label", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def survivors(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without the near copies: of each group the row of the smallest id stays, once. Where an id is on
    several rows, each is judged by its own text; rows without words stay."""
    found = stash(_grouped(docs, shingle, percent).select(F.col("doc_id").alias("_id"), F.col("cid").alias("_cid"), F.col("label").alias("_label"), "kept"), "found")
    ids = found.where("_id is not null").groupBy("_id").agg(F.max("kept").alias("stays"), F.count("*").alias("n"))
    gone, several = ids.where("not stays").select("_id"), ids.where("stays and n > 1").select("_id")
    n_gone, n_several = gone.count(), several.count()
    gone = F.broadcast(gone) if n_gone <= MOST_BROADCAST else gone
    rows = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_id"], "left_anti")
    if not n_several:
        return rows
    several = F.broadcast(several) if n_several <= MOST_BROADCAST else several
    same = rows["doc_id"].cast("bigint") == several["_id"]
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")
    again = rows.join(several, same, "left_semi").select(whole, F.col("doc_id").cast("bigint").alias("_of"), F.col("text").cast("string").alias("text"))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            got = _class_ids(*X.shingle_sets(*X.buffer_of(block.column("text")), shingle))
            yield pa.RecordBatch.from_arrays([block.column("_row"), block.column("_of"), pa.array(got, pa.string())], names=["_row", "_of", "_class"])

    again = again.mapInArrow(classed, T.StructType([again.schema["_row"], again.schema["_of"], T.StructField("_class", T.StringType())]))
    marks = found.where("kept and _cid is not null").join(several, "_id", "left_semi").select("_id", "_cid", "_label").distinct()
    marks = F.broadcast(marks) if marks.count() <= MOST_BROADCAST else marks
    copies = again.join(marks, (F.col("_of") == F.col("_id")) & (F.col("_class") == F.col("_cid")))
    one = copies.groupBy("_id", "_label").agg(F.min_by("_row", F.struct("_class", F.xxhash64("_row"))).alias("_row"))
    kept = again.where("_class is null").select("_row").unionByName(one.select("_row"))
    return rows.join(several, same, "left_anti").unionByName(kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS sh
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0))),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN z USING (doc_id)
"""
