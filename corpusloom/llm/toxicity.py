"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over words and word prefixes, block-max inverted index.

Terms are all words and word prefixes, known by 64-bit hashes; document frequencies count all documents. The examples are
a sample of labelled rows bounded by ``MOST_EXAMPLES`` and ``MOST_CHARS``, so their index has a size bound and can be sent
to every task; each document is a query of its own. The nearest share of the examples votes with the squares of their
cosines, and votes are calibrated by the leave-one-out votes of the examples, weighed to the labels' true shares and pooled
to be monotone. Terms that no example holds cannot match: they scale all cosines of a document alike, and neither the order
of its neighbours nor its vote depends on that scale. Where cosines themselves are asked for, the frequencies of these terms
are joined in Spark and count in the document's length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.llm.minhash import possible
from corpusloom.llm.mixing import uniform
from corpusloom.session import saved

#: Examples at most, about half of them of either label, and the longest text that may be one.
MOST_EXAMPLES = 2_000
MOST_CHARS = 50_000
PREFIXES = (4, 5, 6)
#: Neighbours that vote: this share of the examples, and this number at least.
SHARE, NEIGHBOURS = 0.08, 50
#: Examples in a block, whose greatest weights bound the cosines in it.
BLOCK = 64
#: Terms of the most examples, whose postings are stored as a matrix.
DENSE = 1_024
#: Documents that are compared with the examples at once.
QUERIES = 128
#: Terms counted in a task before they are passed on.
GATHERED = 4_000_000
MEMO = 150_000
BINS = 400
EVIDENCE = 3
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\~`+=@^"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def word_terms(word: str | bytes) -> list[str]:
    """The terms of one word: the word itself and its prefixes, marked by a star."""
    bare = (word.decode() if isinstance(word, bytes) else word).lower().strip(EDGES)
    size = len(bare)
    return [bare, *[bare[:n] + "*" for n in PREFIXES if size > n]] if bare else []


class Memo(dict):
    """word -> hashes of its terms, eight bytes each."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
        found = self[word] = b"".join(xxhash.xxh3_64_intdigest(t).to_bytes(8, "little") for t in word_terms(word))
        return found


class Places(dict):
    """word -> places of its terms among the sorted hashes ``terms``; terms that are not there are left out."""

    def __init__(self, terms: np.ndarray):
        self.known = dict(zip(terms.view(np.uint64).tolist(), range(len(terms)), strict=True))

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MEMO:
            self.clear()
        known = self.known
        found = self[word] = tuple([known[h] for h in map(xxhash.xxh3_64_intdigest, word_terms(word)) if h in known])
        return found

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
        """Places of a text's terms in order, how often it holds each, and whether it has no term at all."""
        words = Counter((text or "").lower().split())
        places: list[int] = []
        times: list[int] = []
        for word, n in words.items():
            if own := self[word]:
                places += own
                times += [n] * len(own)
        terms, back = np.unique(np.array(places, np.int64), return_inverse=True)
        empty = not places and not any(w.strip(EDGES) for w in words)
        return terms, np.bincount(back, times, len(terms)).astype(np.int64), empty


def text_terms(text: str | None, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of a text in order, and how often it holds each."""
    words = Counter((text or "").lower().split())
    packed = [memo[w] for w in words]
    hashes = np.frombuffer(b"".join(packed), np.int64)
    times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(p) // 8 for p in packed])
    terms, place = np.unique(hashes, return_inverse=True)
    return terms, np.bincount(place, times, len(terms)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df): the number of rows that hold each term; counts are combined in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, found, size = Memo(), [], 0

        def combined() -> pa.RecordBatch:
            terms, n = np.unique(np.concatenate(found), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                found.append(text_terms(text.as_py(), memo)[0])
                size += len(found[-1])
                if size > GATHERED:
                    yield combined()
                    found, size = [], 0
        if found:
            yield combined()

    return docs.select(text_col).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def packed(values: np.ndarray) -> bytes:
    """int32 steps between ascending values, byte plane by byte plane, so that the column compresses well."""
    return np.diff(values, prepend=0).astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel(), dtype=np.int32)


def placed(docs: DataFrame, text_col: str, keep: list[str], terms, outside: bool = False) -> DataFrame:
    """``keep`` columns, and of each text: places of its terms among the broadcast hashes and times (both ``packed``)
    and empty (no term at all). With ``outside`` also a row number, and hashes and times of the terms that are not there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, memo = Places(terms.value), Memo()
        for batch in (b.slice(at, QUERIES) for b in batches for at in range(0, b.num_rows, QUERIES)):
            rows = [(packed(at), packed(times), empty) for at, times, empty in (places.of(text.as_py()) for text in batch.column(0))]
            columns = [*batch.columns[1:], *[pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], pa.array([r[2] for r in rows], pa.bool_())]
            if outside:
                others = []
                for text in batch.column(0):
                    found, n = text_terms(text.as_py(), memo)
                    known = located(terms.value, found)[1]
                    others.append((found[~known], n[~known]))
                columns += [pa.array([o[0] for o in others], pa.list_(pa.int64())), pa.array([o[1] for o in others], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(text_col), *keep, *([F.monotonically_increasing_id().alias("row")] if outside else []))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[1:])
    added = "places binary, times binary, empty boolean" + (", others array<bigint>, other_times array<int>" if outside else "")
    names = [f.name for f in source.schema[1:]] + [x.split()[0] for x in added.split(", ")]
    return source.mapInArrow(run, f"{schema}, {added}")


def counts_of(rows: DataFrame, size: int) -> DataFrame:
    """(place, n): the number of rows of ``placed`` that hold each of ``size`` terms.

    A task sends one count for each term it has seen, whatever the number of its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for places in batch.column(0):
                total[unpacked(places.as_py())] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["place", "n"])

    return rows.select("places").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))


def located(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes among sorted ones, and which of them are there."""
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return at, terms[at] == wanted


def term_lists(examples: DataFrame) -> DataFrame:
    """node, toxic, terms (sorted hashes) and times of examples (node, toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            rows = [text_terms(text.as_py(), memo) for text in batch.column(2)]
            lists = [pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["node", "toxic", "terms", "times"])

    return examples.select("node", "toxic", "text").mapInArrow(run, "node long, toxic int, terms binary, times binary")


class BlockMaxIndex:
    """Unit vectors of examples behind inverted lists, in blocks of examples with the greatest weight of each term.

    The lists of the ``DENSE`` commonest terms are a matrix, block by block; those of the rest are walked whole. A block
    whose bound is below the k-th cosine found so far is never opened.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows, idf: np.ndarray, block: int = BLOCK, terms: np.ndarray | None = None):
        """``rows`` are (numbers, times) of each example: places of its terms in ``idf``, and how often it holds them."""
        self.idf, self.block, self.terms = idf, block, terms
        strongest = [int(r[0][np.argmax(self.weigh(*r)[1])]) if len(r[0]) else -1 for r in rows]
        # examples that are alike in their commonest strong term stand together, so that bounds are tight
        held = np.bincount(np.concatenate([np.zeros(0, np.int64), *[np.asarray(r[0], np.int64) for r in rows]]), minlength=len(idf))
        usual = [int(r[0][np.argmax(held[np.asarray(r[0], int)])]) if len(r[0]) else -1 for r in rows]
        order = np.lexsort((strongest, usual)) if len(rows) else np.zeros(0, int)
        self.ids, self.labels = np.asarray(ids)[order], np.asarray(labels)[order]
        ordered = [rows[i] for i in order]
        self.starts = np.append(0, np.cumsum([len(r[0]) for r in ordered])).astype(np.int64)
        self.numbers = np.concatenate([np.zeros(0), *[r[0] for r in ordered]]).astype(np.int32)
        self.times = np.concatenate([np.zeros(0), *[r[1] for r in ordered]]).astype(np.int32)
        self.ready = False

    def weigh(self, terms, times) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(np.asarray(times, float))) * self.idf[np.asarray(terms, int)]
        return np.asarray(terms, int), weights / np.sqrt((weights * weights).sum())

    def prepare(self) -> None:
        """The matrix of the commonest terms, the lists of the rest and the blocks' maxima, made once in a task's process."""
        n = len(self.ids)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.starts))
        weight = (1 + np.log(self.times)) * self.idf[self.numbers]
        weight = weight / np.sqrt(np.bincount(row, weight * weight, n))[row]
        held = np.bincount(self.numbers, minlength=len(self.idf))
        common = np.argsort(-held, kind="stable")[:DENSE]
        self.column = np.full(len(self.idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        at = np.flatnonzero(self.column[self.numbers] >= 0)
        self.dense = np.zeros((n, len(common)))
        self.dense[row[at], self.column[self.numbers[at]]] = weight[at]
        at = np.flatnonzero(self.column[self.numbers] < 0)
        at = at[np.argsort(self.numbers[at], kind="stable")]
        self.rows, self.weights = row[at], weight[at]
        held[common] = 0
        self.lists = np.append(0, np.cumsum(held))
        self.blocks = np.arange(0, n, self.block)
        self.most = np.maximum.reduceat(self.dense, self.blocks) if n else np.zeros((0, len(common)))
        self.ready = True

    def search(self, queries: list, k: int, without: list) -> list[list[tuple[float, int]]]:
        """``nearest`` of several (numbers, times)."""
        if not self.ready:
            self.prepare()
        n, count = len(self.ids), len(self.blocks)
        if not n or not queries:
            return [[] for _ in queries]
        matrix, scores = np.zeros((len(queries), self.dense.shape[1])), np.zeros((len(queries), n))
        for i, (terms, weights) in enumerate(self.weigh(*q) for q in queries):
            column = self.column[terms]
            inside = column >= 0
            matrix[i, column[inside]] = weights[inside]
            rare = terms[~inside]
            low, size = self.lists[rare], self.lists[rare + 1] - self.lists[rare]
            if total := int(size.sum()):
                at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(total)
                scores[i] = np.bincount(self.rows[at], self.weights[at] * np.repeat(weights[~inside], size), n)
        bounds = matrix @ self.most.T + np.maximum.reduceat(scores, self.blocks, axis=1)
        opened = np.zeros((len(queries), count), bool)
        first = np.argsort(-bounds, axis=1)[:, : -(-2 * k // self.block) + 1]
        np.put_along_axis(opened, first, True, 1)
        self.open(opened, matrix, scores)
        least = np.zeros(len(queries))
        for i, gone in enumerate(without):
            # what is not opened yet has no whole score: it cannot raise the k-th above the truth
            seen = np.where(np.repeat(opened[i], self.block)[:n], scores[i], 0)
            some = k + (int(np.count_nonzero(self.ids == gone)) if gone is not None else 0)
            least[i] = np.partition(seen, n - some)[n - some] if some < n else 0.0
        more = ~opened & (bounds >= least[:, None] - 1e-9)
        self.open(more, matrix, scores)
        opened |= more
        out = []
        for i, gone in enumerate(without):
            near = np.flatnonzero(np.repeat(opened[i], self.block)[:n] & (scores[i] > 0) & (scores[i] >= least[i] - 1e-9))
            if gone is not None:
                near = near[self.ids[near] != gone]
            value = np.round(scores[i][near], 12)
            best = np.lexsort((self.ids[near], -value))[:k]
            out.append(list(zip(value[best].tolist(), near[best].tolist(), strict=True)))
        return out

    def open(self, which: np.ndarray, matrix: np.ndarray, scores: np.ndarray) -> None:
        """Add the part of the commonest terms to the scores of the blocks of each query."""
        for b in np.flatnonzero(which.any(0)).tolist():
            asked = np.flatnonzero(which[:, b])
            part = slice(b * self.block, min(len(self.ids), (b + 1) * self.block))
            scores[asked, part] += matrix[asked] @ self.dense[part].T

    def nearest(self, terms, times, k: int, without=None) -> list[tuple[float, int]]:
        """The k largest (cosine, example) above 0, exact, ties to the smaller id; ``without`` is an id to leave out."""
        return self.search([(terms, times)], k, [without])[0]


def neighbours(rows: DataFrame, keep: list[str], index, id_col: str, k: int, leave_out: bool = False) -> DataFrame:
    """``keep`` columns, and of each row of ``placed``: vote (null without a neighbour), empty, the nearest examples.

    A vote is the share of toxic ones among the ``k`` nearest, weighed by the squares of their cosines. ids, cosines and
    marks are those of the first few; inside is the squared length of the part of the vector that the index has terms of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: BlockMaxIndex = index.value
        for whole in batches:
            for start in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(start, QUERIES)
                queries = [(unpacked(p.as_py()), unpacked(n.as_py())) for p, n in zip(batch.column(1), batch.column(2), strict=True)]
                inside = [float((((1 + np.log(n)) * own.idf[p]) ** 2).sum()) for p, n in queries]
                asked = [i for i, q in enumerate(queries) if len(q[0])]
                ids = batch.column(0).to_pylist()
                near = [[] for _ in queries]
                for i, found in zip(asked, own.search([queries[i] for i in asked], k, [ids[i] if leave_out else None for i in asked]), strict=True):
                    near[i] = found
                votes = []
                for found in near:
                    at = [i for _, i in found]
                    weight = np.array([c for c, _ in found]) ** 2
                    votes.append(float((weight * own.labels[at]).sum() / weight.sum()) if at else None)
                lists = [pa.array([[int(own.ids[i]) for _, i in x[:EVIDENCE]] for x in near], pa.list_(pa.int64())), pa.array([[c for c, _ in x[:EVIDENCE]] for x in near], pa.list_(pa.float64())), pa.array([[int(own.labels[i]) for _, i in x[:EVIDENCE]] for x in near], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(votes, pa.float64()), *lists, pa.array(inside, pa.float64())], names=names)

    source = rows.select(F.col(id_col).cast("long").alias("_id"), "places", "times", *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[3:])
    added = "vote double, ids array<bigint>, cosines array<double>, marks array<int>, inside double"
    names = [f.name for f in source.schema[3:]] + [x.split()[0] for x in added.split(", ")]
    return source.mapInArrow(run, f"{schema}, {added}")


def whole_cosines(spark: SparkSession, found: DataFrame, texts: DataFrame, n_docs: int) -> DataFrame:
    """``found`` with the cosines of whole vectors: terms that no example holds count in a document's length."""
    found = saved(found, spark)
    terms = found.filter(F.size("others") > 0).select("row", F.explode(F.arrays_zip("others", "other_times")).alias("o")).select("row", F.col("o.others").alias("term"), F.col("o.other_times").alias("n"))
    weight = (1 + F.log("n")) * (F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1)
    lengths = terms.join(document_frequencies(texts, "text"), "term").groupBy("row").agg(F.sum(weight * weight).alias("outside"))
    part = F.sqrt(F.try_divide("inside", F.col("inside") + F.coalesce("outside", F.lit(0.0))))
    return found.join(lengths, "row", "left").withColumn("cosines", F.transform("cosines", lambda c: c * part))


def monotone(cells: list[tuple[int, float, float]], prior: float, bins: int) -> list[float]:
    """Calibrated probability of each of ``bins`` cells from (cell, toxic weight, weight), pooled so that it never falls.

    Each pool is drawn to ``prior`` by a weight of two examples; cells without examples follow the one before.
    """
    pools: list[list[float]] = []
    for b, y, n in sorted(cells):
        pools.append([b, y, n])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, y, n = pools.pop()
            pools[-1][1] += y
            pools[-1][2] += n
    out, at, now = [], 0, 0.0
    for b in range(bins):
        while at < len(pools) and pools[at][0] <= b:
            now = max(now, (pools[at][1] + 2 * prior) / (pools[at][2] + 2))
            at += 1
        out.append(now)
    return out


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, least: int = NEIGHBOURS, most: int = MOST_EXAMPLES, bins: int = BINS, cosines: bool = True) -> DataFrame:
    """Per row of ``docs``: ``id_col``, held_out, score, predicted, evidence (the nearest examples, with cosines if asked).

    Labels (doc_id, toxic) of held-out rows are never read; of several labels of one id the largest counts, null ones
    do not, and of several texts of one labelled id the least is the example. A text without any term gets the share of
    toxic examples among examples of its kind, and one that shares no term with an example the share among all. Null ids
    are not held out; repeated rows are scored one by one; without labels every score is 0; an empty table gives an empty
    result; other columns are not looked at.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("node"), "toxic").filter("node IS NOT NULL AND toxic IS NOT NULL")
    known = known.filter(~held_out(F.col("node"))).groupBy("node").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # at most two rows
    taken = F.when(F.col("toxic") == 1, min(1.0, most / 2 / max(1, sizes.get(1, 0)))).otherwise(min(1.0, most / 2 / max(1, sizes.get(0, 0))))
    known = saved(known.filter(uniform(F.col("node"), seed="toxicity") < taken), spark)
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.coalesce(text_col, F.lit("")).alias("text"))
    examples = possible(texts, known).filter(F.length("text") <= MOST_CHARS).join(known, "node")
    examples = saved(examples.groupBy("node", "toxic").agg(F.min("text").alias("text")), spark)
    # at most MOST_EXAMPLES rows of at most MOST_CHARS characters
    rows = [(r["node"], r["toxic"], np.frombuffer(r["terms"], np.int64), np.frombuffer(r["times"], np.int32)) for r in term_lists(examples).collect()]
    rows.sort(key=lambda r: r[0])
    terms = np.unique(np.concatenate([np.zeros(0, np.int64), *[r[2] for r in rows]]))
    n_docs = docs.count()
    known_terms = spark.sparkContext.broadcast(terms)
    # each text is cut into terms once; what follows reads the places of its terms
    queries = saved(placed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"], known_terms, cosines), spark)
    counted = counts_of(queries, len(terms)).toArrow()  # one row a term of the examples
    df = np.zeros(len(terms))
    df[counted["place"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    marks, held = np.array([r[1] for r in rows], np.int64), np.array([len(r[2]) for r in rows], np.int64)
    index = BlockMaxIndex(np.array([r[0] for r in rows], np.int64), marks, [(np.searchsorted(terms, r[2]), r[3]) for r in rows], idf, terms=terms)
    sent = spark.sparkContext.broadcast(index)
    prior = sizes.get(1, 0) / max(1, sum(sizes.values()))
    # an example stands for as many labelled rows as its label has, over as many examples
    stands = {y: sizes.get(y, 0) / max(1, int((marks == y).sum())) for y in (0, 1)}
    bare = {y: stands[y] * int(((marks == y) & (held == 0)).sum()) for y in (0, 1)}
    without = bare[1] / (bare[0] + bare[1] + 1)
    k = max(least, int(share * len(rows)))
    cell = F.least(F.floor(F.col("vote") * bins), F.lit(bins - 1)).cast("int")
    again = neighbours(placed(examples.repartition(24), "text", ["node", "toxic"], known_terms), ["toxic"], sent, "node", k, leave_out=True).filter("vote IS NOT NULL")
    cells: dict[int, list[float]] = {}
    for r in again.groupBy(cell.alias("b"), "toxic").count().collect():  # at most two rows a bin
        at = cells.setdefault(r["b"], [0.0, 0.0])
        at[0] += r["toxic"] * r["count"] * stands[1]
        at[1] += r["count"] * stands[r["toxic"]]
    calibrated = F.array(*[F.lit(float(p)) for p in monotone([(b, y, n) for b, (y, n) in cells.items()], prior, bins)])
    near = neighbours(queries, ["id", "empty", *(["row", "others", "other_times"] if cosines else [])], sent, "id", k)
    if cosines:
        near = whole_cosines(spark, near, texts, n_docs)
    score = F.when(F.col("vote").isNotNull(), F.element_at(calibrated, cell + 1)).otherwise(F.when(F.col("empty"), F.lit(float(without))).otherwise(F.lit(float(prior))))
    fields = [lambda i, j: i.alias("id"), *([lambda i, j: F.get("cosines", j).alias("cosine")] if cosines else []), lambda i, j: F.get("marks", j).alias("toxic")]
    evidence = F.transform("ids", lambda i, j: F.struct(*[f(i, j) for f in fields]))
    return near.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), evidence.alias("evidence"))
