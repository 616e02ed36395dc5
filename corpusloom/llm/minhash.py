"""Near-duplicate documents: MinHash bands find candidates, full shingle sets confirm them.

1. One pass over the texts gives each document the size of its set of 5-word shingles, a 128-bit digest of the set,
   a signature of universal-hash minima and ``bands`` hashes, each of ``rows`` of these minima.
2. Documents with equal sets fall into one class by an aggregation on the digest; one of its rows stands for it.
3. Classes that share a band are joined by star edges to the smallest of the bucket, never pair by pair; the
   components of these edges are the candidate groups.
4. Within a group the pairs that could reach the threshold are verified on their signatures, and what agrees is confirmed
   on the full sets, in blocks of bounded size: a large group is cut into windows of similar set sizes and these into
   salted blocks, and pairs of blocks are the units of work. A block pair returns a spanning forest of its links, not
   the pairs; pairs that the forest connects already need no set.
5. The components of the confirmed links, by alternating large-star and small-star, are the near-duplicate groups.

With 28 bands of 5 rows a pair at the threshold 0.85 shares no band with probability (1 - 0.85^5)^28 < 1e-7, and fewer than
``AGREED`` of its 140 signature bytes agree with probability < 1e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.operators.graph import components
from corpusloom.llm.shingles import grouped, mixed, shingles
from corpusloom.session import saved

BANDS, ROWS = 28, 5
WIDTH = 5
PERCENT = 85
BLOCK = 128
#: Equal bytes of two signatures at least: of 140, a pair at the threshold has 119 on average, with a deviation of 4.2.
AGREED = 85

_rng = np.random.default_rng(97)
SLOPES = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _bytes(column: pa.Array) -> list[bytes]:
    return [(x.as_py() or b"").lower() for x in column.cast(pa.binary())]


def minima(hashes: np.ndarray, starts: np.ndarray, slopes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """(functions, texts): the least value of each universal hash over the shingles of each text."""
    out = np.empty((len(slopes), len(starts)), np.uint64)
    room = np.empty_like(hashes)
    for k, (a, b) in enumerate(zip(slopes, shifts, strict=True)):
        np.multiply(hashes, a, out=room)
        np.add(room, b, out=room)
        out[k] = np.minimum.reduceat(room, starts)
    return out


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """uid, node, th (hash of the text), n_shingles, and of a set that is not empty digest, bands and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(3))
            for lo, hi in grouped(texts, 1 << 18):
                sizes, digests, bands, signed = [], [], [], []
                hashes, bound = shingles(texts[lo:hi], WIDTH)
                full = np.flatnonzero(np.diff(bound))
                if len(full):
                    low = minima(hashes, bound[full], SLOPES, SHIFTS).reshape(BANDS, ROWS, len(full))
                    key = np.full((BANDS, len(full)), 0, np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
                    for r in range(ROWS):
                        key = mixed(key * np.uint64(0x2545F4914F6CDD1D) + low[:, r])
                    rows = dict(zip(full.tolist(), np.ascontiguousarray(key.T).view(np.int64), strict=True))
                    sign = (mixed(low) >> np.uint64(56)).astype(np.uint8).reshape(BANDS * ROWS, len(full)).T
                    signs = dict(zip(full.tolist(), [x.tobytes() for x in sign], strict=True))
                else:
                    rows, signs = {}, {}
                for i in range(hi - lo):
                    own = np.unique(hashes[bound[i] : bound[i + 1]])
                    sizes.append(len(own))
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                    bands.append(rows.get(i))
                    signed.append(signs.get(i))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(signed, pa.binary())], names=["uid", "node", "th", "n_shingles", "digest", "bands", "sign"])

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("th"), F.col(text_col))
    return source.mapInArrow(run, "uid long, node long, th long, n_shingles long, digest binary, bands array<long>, sign binary")


def candidate_groups(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(node, component) of classes (rep, bands) that share a band, directly or through others."""
    keys = classes.select("rep", F.explode("bands").alias("band"))
    shared = keys.groupBy("band").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1")
    return components(spark, keys.join(shared, "band").filter("rep != least").select("rep", "least").distinct())


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``set``: the sorted shingle hashes of each text as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch.column(0))
            for lo, hi in grouped(texts):
                hashes, bound = shingles(texts[lo:hi], WIDTH)
                sets = [np.unique(hashes[bound[i] : bound[i + 1]]).tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(sets, pa.binary())], names=[*keep, "set"])

    source = docs.select(F.col(text_col), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[1:])
    return source.mapInArrow(run, f"{schema}, set binary")


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for a, b in pairs.tolist():
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def block_pairs(groups: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """Rows of ``groups`` (grp, node, n, …) with ``unit``, once for each unit of work that needs the row.

    A group of at most ``2 * block`` rows is one unit. A larger one is cut by the logarithm of the set size into
    windows of two neighbouring classes, outside which no pair can reach the threshold, and each window into
    hashed blocks of about ``block`` rows; every pair of blocks is a unit.
    """
    import math

    kind = F.floor(F.ln(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9)).cast("int")
    small = groups.groupBy("grp").agg(F.count("*").alias("members"))
    rows = groups.join(small, "grp").withColumn(
        "windows", F.when(F.col("members") <= 2 * block, F.array(F.lit(-9))).otherwise(F.array(kind - 1, kind))
    )
    rows = rows.withColumn("window", F.explode("windows")).drop("windows", "members")
    sizes = rows.groupBy("grp", "window").agg(F.count("*").alias("members"))
    rows = rows.join(sizes, ["grp", "window"]).filter("members > 1")
    blocks = F.when(F.col("window") == -9, F.lit(1)).otherwise(F.ceil(F.col("members") / block)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("grp", "window", F.least("mine", "other"), F.greatest("mine", "other"))
    return rows.withColumn("unit", unit).drop("members", "blocks", "window", "other", "mine")


def links_within(sets: list[np.ndarray], signs: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * intersection >= percent * union.

    Pairs whose signatures agree are tried from the most alike on, and one whose ends are connected is not tried.
    """
    n = np.array([len(x) for x in sets])
    least = percent * np.maximum(n[:, None], n[None, :]) <= 100 * np.minimum(n[:, None], n[None, :])
    agreed = np.stack([np.count_nonzero(signs[i] == signs, axis=1) for i in range(len(sets))])
    pairs = np.argwhere(np.triu(least & (agreed >= AGREED), 1))
    pairs = pairs[np.argsort(-agreed[pairs[:, 0], pairs[:, 1]], kind="stable")]
    up = list(range(len(sets)))
    kept = []
    for a, b in pairs.tolist():
        x, y = a, b
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if 100 * both >= percent * (n[a] + n[b] - both):
                up[max(x, y)] = min(x, y)
                kept.append((a, b))
    return kept


def confirmed(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (u, v) of a spanning forest of the links within each unit of rows (unit, node, set, sign)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable")
        node = part["node"].to_numpy()
        signs = np.frombuffer(b"".join(part["sign"]), np.uint8).reshape(len(node), -1)
        at = np.array(links_within([np.frombuffer(s, np.uint64) for s in part["set"]], signs, percent), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": node[at[:, 0]], "v": node[at[:, 1]]})

    return sets.groupBy("unit").applyInPandas(run, "u long, v long")


def possible(rows: DataFrame, wanted: DataFrame, column: str = "node", bits: int = 1 << 24) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted``, by a bitmap of hashes.

    The bitmap has ``bits`` bits (2 MB) whatever the size of either table, so it can be broadcast; a full one lets
    every row through and only costs the test.
    """
    cell = F.pmod(F.xxhash64(column), F.lit(bits))
    bitmap = wanted.groupBy(F.bitmap_bucket_number(cell).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("_bits"))
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0
    joined = rows.withColumn("_at", F.bitmap_bucket_number(cell)).join(F.broadcast(bitmap), F.col("_at") == F.col("_bucket"))
    return joined.filter(bit).select(*rows.columns)


def _resolved(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """node, th, n_shingles, component_id and kept of every row of ``docs``."""
    sketch = saved(sketches(docs, id_col, text_col), spark)
    real = sketch.filter("digest IS NOT NULL AND node IS NOT NULL")
    first = F.min(F.struct("uid", "node", "th", "n_shingles", "bands", "sign"))
    classes = real.groupBy("digest").agg(first.alias("f"), F.min("node").alias("least"), F.count("*").alias("copies"))
    classes = saved(classes.select("digest", "least", "copies", F.col("f.uid").alias("rep"), F.col("f.node").alias("node"), F.col("f.th").alias("th"), F.col("f.n_shingles").alias("n"), F.col("f.bands").alias("bands"), F.col("f.sign").alias("sign")), spark)
    groups = candidate_groups(spark, classes).select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    wanted = saved(groups.join(classes.select("rep", "node", "th", "n", "sign"), "rep"), spark)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = possible(texts, wanted).join(wanted, ["node", "th"]).select("rep", "grp", "n", "sign", "text")
    # rows that repeat id and text are one set
    sets = saved(shingle_sets(texts, "rep", "text", ["rep", "grp", "n", "sign"]).dropDuplicates(["rep"]), spark)
    units = block_pairs(sets.withColumnRenamed("rep", "node"), percent=percent)
    found = components(spark, confirmed(units.select("unit", "node", "set", "sign"), percent))
    # the first of a component: its least id, and of several texts with it the one with the least digest
    members = found.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "digest", "least"), "rep")
    heads = members.groupBy("component").agg(F.min(F.struct("least", "digest")).alias("head"))
    heads = members.join(heads, "component").select("digest", "head")
    # classes of one row and no link need no join: they are their own head
    known = classes.filter("copies > 1").select("digest", "least").join(heads, "digest", "full_outer")
    known = known.select("digest", F.coalesce("head", F.struct("least", "digest")).alias("head"))
    rows = sketch.select("node", "th", "n_shingles", "digest").join(known, "digest", "left")
    component = F.when(F.col("digest").isNotNull() & F.col("node").isNotNull(), F.coalesce("head.least", "node")).otherwise(F.col("node"))
    kept = F.col("head").isNull() | F.col("node").isNull() | ((F.col("node") == F.col("head.least")) & (F.col("digest") == F.col("head.digest")))
    return rows.select("node", "th", "n_shingles", component.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_shingles, component_id, kept.

    A null or blank text has an empty set and is linked with nothing. Rows that repeat an id are told apart by their
    texts: each text has its own links, and of several texts with a component's least id one is kept. Rows that repeat
    id and text are kept or dropped together. A row whose id is null is not linked: component_id is null and kept is
    true. An empty table gives an empty result; other columns are not looked at.
    """
    return _resolved(spark, docs, id_col, text_col, percent).select(F.col("node").alias(id_col), "n_shingles", "component_id", "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their group; columns unchanged. A text is gone only where a like one stays."""
    gone = _resolved(spark, docs, id_col, text_col, percent).filter("NOT kept").select(F.col("node").alias("_gone"), F.col("th").alias("_gone_th")).distinct()
    return docs.join(gone, (F.col(id_col) == F.col("_gone")) & (F.xxhash64(text_col) == F.col("_gone_th")), "left_anti")
