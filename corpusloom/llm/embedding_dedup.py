"""Near-duplicate embeddings by NN-descent within equal labels.

1. Vectors are scaled by a power of two, so that no length under- or overflows. Equal ones of a label are one class.
2. First lists: under several random-hyperplane codes the vectors are sorted by label, code and a projection, and each
   is compared with the rows next to it. The sort is by range, so no label or code makes a large task.
3. Rounds of neighbours-of-neighbours joins: around each vector those that list it meet those that it lists, and what is
   nearer than the last of a list enters it. Lists hold ``k`` vectors; one whose every entry reaches the threshold is
   saturated and doubles in each round. Vectors that very many others list are split by salt.
4. After each round recall is audited, and more rounds follow where it is low, ``rounds`` at most: the classes of ids
   that ``every`` divides are compared with all classes of their label, in blocks, and their true links are counted, and
   among these the links that the lists connect. Only counts leave a block.
5. Where recall is high, links at the threshold join candidates into components; where it is not, a whole label is one
   component. Within each all vectors are compared in blocks in double precision, which gives exact link counts and drops
   what is below the threshold; so a list's length loses no link, and low recall costs time, not links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from corpusloom.operators.graph import components
from corpusloom.llm.minhash import forest
from corpusloom.session import saved

THRESHOLD = 0.98
K = 8
TABLES = 5
BITS = 8
WINDOW = 12
ROUNDS = 6
EVERY, RECALL = 50, 0.98
#: Audited classes, and classes that they are compared with, in one unit.
ASKED, SHOWN = 8_192, 65_536
BLOCK = 256
#: Lists are compared in single precision; the exact step uses double.
SLACK = 1e-4


def prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """id, digest (of label and vector; null where the row can have no link), grp, raw (scaled doubles as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, groups, raws = [], [], []
            for vector, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                values = vector.values if vector.is_valid and label is not None else None
                raw = None
                if values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 is 0.0
                    most = np.abs(x).max()
                    # by a power of two, so exactly: the greatest component is from 0.5 to 1
                    raw = np.ldexp(x, -int(np.frexp(most)[1])) if np.isfinite(most) and most > 0 else None
                key = None if raw is None else f"{len(raw)}|{label}".encode()
                groups.append(None if raw is None else np.uint64(xxhash.xxh64_intdigest(key)).view(np.int64).item())
                raws.append(None if raw is None else raw.tobytes())
                digests.append(None if raw is None else xxhash.xxh3_128_digest(key + b"|" + raws[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(groups, pa.int64()), pa.array(raws, pa.binary())], names=["id", "digest", "grp", "raw"])

    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col), F.col(label_col).cast("string"))
    return source.mapInArrow(run, "id long, digest binary, grp long, raw binary")


def _units(raws: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raws), np.float64).reshape(len(raws), -1)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def coded(classes: DataFrame, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """grp, tab, code, place, rep, unit: each vector once for each table of hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            reps, groups, raws = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            sizes = np.array([len(r) // 8 for r in raws])
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                unit = _units([raws[i] for i in rows])
                if d not in planes:
                    planes[d] = np.random.default_rng(d).standard_normal((d, tables * (bits + 1))).astype(np.float32)
                side = (unit @ planes[d]).reshape(len(rows), tables, bits + 1)
                code = ((side[:, :, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64)
                packed = [u.tobytes() for u in unit]
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(groups[rows]), pa.array(np.full(len(rows), t)), pa.array(code[:, t]), pa.array(side[:, t, bits].astype(np.float64)), pa.array(reps[rows]), pa.array(packed, pa.binary())], names=["grp", "tab", "code", "place", "rep", "unit"])

    return classes.select("rep", "grp", "raw").mapInArrow(run, "grp long, tab long, code long, place double, rep long, unit binary")


def neighbours_in_order(rows: DataFrame, k: int, window: int = WINDOW) -> DataFrame:
    """(u, v, sim): the best ``k`` of each row among the ``window`` rows to either side, in the sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            rep, packed = batch.column(4).to_numpy(), batch.column(5).to_pylist()
            if tail is not None:
                key, rep, packed = np.concatenate([tail[0], key], 1), np.concatenate([tail[1], rep]), tail[2] + packed
            tail = key[:, -window:], rep[-window:], packed[-window:]
            size = np.array([len(p) for p in packed])
            sims = np.full((len(rep), 2 * window), -2, np.float32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                unit = np.frombuffer(b"".join([packed[i] for i in at]), np.float32).reshape(len(at), -1)
                for step in range(1, window + 1):
                    a, b = at[:-step], at[step:]
                    near = (key[:, a] == key[:, b]).all(0) & (rep[a] != rep[b])
                    value = np.where(near, np.einsum("ij,ij->i", unit[:-step], unit[step:]), -2)
                    sims[a, step - 1] = np.where(b - a == step, value, -2)
                    sims[b, window + step - 1] = sims[a, step - 1]
            best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(sims, best, 1)
            i, j = np.nonzero(value > -2)
            shift = np.where(best < window, best + 1, window - best - 1)
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[i + shift[i, j]]), pa.array(value[i, j])], names=["u", "v", "sim"])

    return rows.mapInArrow(run, "u long, v long, sim float")


def best_lists(edges: DataFrame, k: int, threshold: float, room: int) -> DataFrame:
    """(u, v, sim, last): each vector's list, the sim of its last entry (-1 while it is short).

    A list has ``k`` entries, or as many as reach the threshold, up to ``room``.
    """
    both = edges.union(edges.select("v", "u", "sim")).groupBy("u", "v").agg(F.max("sim").alias("sim"))
    by = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = both.withColumn("rank", F.row_number().over(by)).withColumn("linked", F.count_if(F.col("sim") >= threshold - SLACK).over(Window.partitionBy("u")))
    size = F.greatest(F.lit(k), F.least(F.col("linked"), F.lit(room)))
    kept = ranked.withColumn("size", size).filter("rank <= size")
    full = F.count("*").over(Window.partitionBy("u")) == F.col("size")
    # a saturated list takes in whatever reaches the threshold
    last = F.when(full, F.least(F.min("sim").over(Window.partitionBy("u")), F.lit(threshold - SLACK))).otherwise(F.lit(-1.0))
    return kept.select("u", "v", "sim", last.cast("float").alias("last"))


def sorted_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Whole groups of equal ``key`` from sorted batches, some at a time."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        column = table.column(key).to_numpy()
        cut = int(np.searchsorted(column != column[-1], False)) if column[0] == column[-1] else int(np.flatnonzero(column != column[-1])[-1]) + 1
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def meetings(lists: DataFrame, units: DataFrame, split: int = 256) -> DataFrame:
    """(u, v, sim) that would enter a list: neighbours of neighbours, met around the vector between them."""
    out = lists.join(units, F.col("u") == F.col("rep"))
    inward = out.select(F.col("v").alias("mid"), F.lit(0).alias("side"), F.col("u").alias("who"), "unit", "last")
    degree = lists.groupBy(F.col("v").alias("mid")).agg(F.ceil(F.count("*") / split).cast("int").alias("salts"))
    inward = inward.join(degree, "mid").withColumn("salt", F.pmod(F.xxhash64("who"), F.col("salts")).cast("int")).drop("salts")
    ends = lists.select("u", "v").join(units, F.col("v") == F.col("rep")).join(lists.select(F.col("u").alias("r"), "last").distinct(), F.col("v") == F.col("r"), "left")
    outward = ends.select(F.col("u").alias("mid"), F.lit(1).alias("side"), F.col("v").alias("who"), "unit", F.coalesce("last", F.lit(-1.0)).cast("float").alias("last")).join(degree, "mid")
    outward = outward.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    columns = ["key", "side", "who", "unit", "last"]
    rows = inward.unionByName(outward).withColumn("key", F.xxhash64("mid", "salt")).select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, 0):
            key, side, who = (part.column(i).to_numpy() for i in range(3))
            packed, last = part.column(3).to_pylist(), part.column(4).to_numpy()
            starts = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1 if key[0] > -(2**62) else key[0] + 1)), len(key))
            us, vs, sims = [], [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                middle = lo + int(np.searchsorted(side[lo:hi], 1))
                if middle == lo or middle == hi:
                    continue
                unit = np.frombuffer(b"".join(packed[lo:hi]), np.float32).reshape(hi - lo, -1)
                sim = unit[: middle - lo] @ unit[middle - lo :].T
                a, b = np.nonzero((sim > np.minimum(last[lo:middle, None], last[None, middle:hi])) & (who[lo:middle, None] != who[None, middle:hi]))
                us.append(who[lo:middle][a])
                vs.append(who[middle:hi][b])
                sims.append(sim[a, b])
            if us:
                u, v, s = np.concatenate(us), np.concatenate(vs), np.concatenate(sims)
                pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(u[pair]), pa.array(v[pair]), pa.array(s[pair])], names=["u", "v", "sim"])

    return rows.repartition("key").sortWithinPartitions("key", "side").mapInArrow(run, "u long, v long, sim float")


def audited(classes: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(links, hits): true links of the asked classes (``asked``), and those that ``found`` (node, component) connects.

    In each label the asked classes meet all classes, in units of bounded size on the asked side; rows of the other side
    pass by. Each unit gives one row of counts.
    """
    parts = lambda seed, column: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(column)).cast("int")
    each = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    held = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("own", F.coalesce("component", "rep"))
    sizes = classes.groupBy("grp").agg(F.ceil(F.count_if("asked") / ASKED).cast("int").alias("blocks"), F.ceil(F.count("*") / SHOWN).cast("int").alias("stripes")).filter("blocks > 0")
    rows = held.select("grp", "rep", "own", "raw", "asked").join(sizes, "grp")
    columns = ["grp", "block", "stripe", "side", "rep", "own", "raw"]
    asked = rows.filter("asked").withColumn("block", parts(1, "blocks")).withColumn("stripe", each("stripes")).withColumn("side", F.lit(0))
    shown = rows.withColumn("stripe", parts(2, "stripes")).withColumn("block", each("blocks")).withColumn("side", F.lit(1))
    units = asked.select(columns).unionByName(shown.select(columns)).repartition("grp", "block", "stripe").sortWithinPartitions("grp", "block", "stripe", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, asked, links, hits = None, [], 0, 0
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
            cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys)) if len(keys) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                lo, hi = int(lo), int(hi)
                if unit != (now := tuple(keys[lo, :3].tolist())):
                    unit, asked = now, []
                part = batch.slice(lo, hi - lo)
                reps, own, x = part.column(4).to_numpy(), part.column(5).to_numpy(), _units(part.column(6).to_pylist())
                if not keys[lo, 3]:
                    asked.append((reps, own, x))
                    continue
                for ids, their, q in asked:
                    for at in range(0, len(ids), 1_024):
                        true = (q[at : at + 1_024] @ x.T >= threshold) & (ids[at : at + 1_024, None] != reps[None])
                        links += int(true.sum())
                        hits += int((true & (their[at : at + 1_024, None] == own[None])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([hits])], names=["links", "hits"])

    return units.mapInArrow(run, "links long, hits long")


def recall_of(classes: DataFrame, found: DataFrame, threshold: float) -> float | None:
    """Share of the audited links that ``found`` (node, component) connects; None without links."""
    counted = audited(classes, found, threshold).agg(F.sum("links").alias("n"), F.sum("hits").alias("hit")).first()
    return counted["hit"] / counted["n"] if counted["n"] else None


def exact_links(groups: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Rows of (grp, node, raw, size): (u, v, n): n vectors linked to u in one unit, and edges (n = 0) of a forest."""
    counts = groups.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    rows = groups.join(counts, "grp").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other"))
    rows = rows.select(unit.alias("unit"), (F.col("mine") > F.col("other")).cast("int").alias("side"), (F.col("mine") == F.col("other")).alias("own"), "node", "raw", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_groups(batches, 0):
            key, side = part.column(0).to_numpy(), part.column(1).to_numpy()
            own, node, raws, size = part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(4).to_pylist(), part.column(5).to_numpy()
            starts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            us, vs, ns = [], [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                x = np.frombuffer(b"".join(raws[lo:hi]), np.float64).reshape(hi - lo, -1)
                norm = np.sqrt((x * x).sum(1))
                hit = (x @ x.T) / (norm[:, None] * norm[None, :]) >= threshold
                # a pair counts in one unit: within a block in the block's own, across blocks where they meet
                hit &= node[lo:hi, None] != node[None, lo:hi]
                if not own[lo]:
                    hit &= side[lo:hi, None] != side[None, lo:hi]
                linked = hit @ size[lo:hi]
                rows = np.flatnonzero(linked)
                us.append(node[lo:hi][rows])
                vs.append(node[lo:hi][rows])
                ns.append(linked[rows])
                pairs = np.array(forest(np.argwhere(np.triu(hit)), hi - lo), np.int64).reshape(-1, 2)
                us.append(node[lo:hi][pairs[:, 0]])
                vs.append(node[lo:hi][pairs[:, 1]])
                ns.append(np.zeros(len(pairs), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ns))], names=["u", "v", "n"])

    return rows.repartition("unit").sortWithinPartitions("unit", "side").mapInArrow(run, "u long, v long, n long")


def near_vectors(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, k: int = K, rounds: int = ROUNDS, every: int = EVERY, report: Callable[[int, float | None], None] | None = None) -> DataFrame:
    """Per row: ``id_col``, n_links, component_id, kept, audited_recall.

    Rows whose vector is null, empty, zero or holds a null or non-finite value, whose label or id is null, have no
    link. Vectors of different lengths are never compared. Rows that repeat id, label and vector are one vector; rows that
    repeat an id with another vector have links of their own, counted as vectors, and as vertices are one, so they share a
    component. An empty table gives an empty result; other columns are not looked at. ``audited_recall`` is the share of
    the true links of ids that ``every`` divides which NN-descent connected, null where they have none; below 0.98
    the exact comparison takes whole labels, so nothing is lost. ``report`` gets the rounds made and this share.
    """
    rows = saved(prepared(vectors, id_col, vec_col, label_col), spark)
    real = rows.filter("digest IS NOT NULL AND id IS NOT NULL")
    grouped = real.groupBy("digest").agg(F.min("id").alias("least"), F.count_distinct("id").alias("size"), F.first("grp").alias("grp"), F.first("raw").alias("raw"), F.max(F.pmod("id", F.lit(every)) == 0).alias("asked"))
    classes = saved(grouped.withColumn("rep", F.monotonically_increasing_id()), spark)  # once written, the numbers stay
    table = saved(coded(classes), spark)
    ordered = table.repartitionByRange("grp", "tab", "code", "place", "rep").sortWithinPartitions("grp", "tab", "code", "place", "rep")
    lists = saved(best_lists(neighbours_in_order(ordered, k), k, threshold, k), spark)
    units = saved(table.filter("tab = 0").select("rep", "unit"), spark)
    joined = recall = None
    for turn in range(min(1, rounds), rounds + 1):
        if turn:
            lists = saved(best_lists(lists.select("u", "v", "sim").union(meetings(lists, units)), k, threshold, k << turn), spark)
        joined = components(spark, lists.filter(F.col("sim") >= threshold - SLACK).select("u", "v"))
        recall = recall_of(classes, joined, threshold)
        if report:
            report(turn, recall)
        # where the audited ids have no link, two rounds are made
        if turn > 1 if recall is None else recall >= RECALL:
            break
    members = joined.select(F.col("node").alias("rep"), F.col("component").alias("part")) if recall is None or recall >= RECALL else classes.select("rep", F.col("grp").alias("part"))
    members = members.join(classes.select("rep", "raw", "size"), "rep").select(F.col("part").alias("grp"), F.col("rep").alias("node"), "raw", "size")
    linked = saved(exact_links(members, threshold), spark)
    degree = linked.filter("n > 0").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    # an id with several vectors holds their classes together
    own = real.join(classes.select("digest", "rep"), "digest").select("id", "rep").distinct()
    several = own.groupBy("id").agg(F.min("rep").alias("u"), F.max("rep").alias("_last")).filter("u != _last")
    bound = own.join(several, "id").filter("rep != u").select("u", F.col("rep").alias("v"))
    found = components(spark, linked.filter("n = 0").select("u", "v").unionByName(bound))
    placed = classes.select("rep", "digest", "size", "least").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = placed.groupBy("component").agg(F.min("least").alias("head"))
    placed = placed.join(heads, "component").join(degree, "rep", "left").select("digest", "head", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = rows.join(placed, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("head", "id"))
    links = F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0)
    return out.select(F.col("id").alias(id_col), links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
