"""Operator 13: ranked lexical search by best-first branch and bound over hierarchical maxima of document ranges."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T

from .common import discard, pick, written

#: What separates terms: all of ASCII but digits and letters, whose capitals become small.
SEPARATORS = bytes(b for b in range(0x80) if not chr(b).isalnum())
TERMS = bytes(0x20 if b in SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: A node has 2^FAN children.
FAN = 5
#: Postings that one set of trees holds at most, but for a single document with more.
RUN = 1 << 20
#: Pairs of an item and a term, about, that are searched for together; more are searched in further passes.
BLOCK = 1 << 19


def words(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


class MaxTrees:
    """A tree for each term over ranges of documents 0 .. n-1: every node holds the largest value of its range.

    All terms' nodes of one level lie in flat arrays by (term, range); a node that no
    document of the term is in isn't there. Level 0 are the postings themselves.
    """

    def __init__(self, n: int, terms: np.ndarray, docs: np.ndarray, values: np.ndarray):
        order = np.lexsort((docs, terms))
        terms, keys, values = terms[order], docs[order].astype(np.int64), values[order].astype(np.int64)
        self.keys, self.values, self.first = [keys], [values], [np.zeros(0, np.int64)]
        while n > 1:
            n = -(-n >> FAN)
            ranges = keys >> FAN
            new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (ranges[1:] != ranges[:-1])][: len(terms)])
            self.first.append(np.r_[new, len(terms)])
            terms, keys = terms[new], ranges[new]
            values = np.maximum.reduceat(values, new) if len(new) else values
            self.keys.append(keys)
            self.values.append(values)
        self.root = {int(t): k for k, t in enumerate(terms)}

    def search(self, weights: dict[int, int], most: int, floor: int = 1) -> list[tuple[int, int]]:
        """(score, document) of the `most` highest scores of at least floor, equal ones by ascending document.

        The node with the highest sum of its terms' weighted maxima is opened next; among
        equal sums ranges come before documents, so all that could still tie are opened.
        """
        terms = [t for t in weights if t in self.root]
        if not terms or most < 1:
            return []
        level = len(self.keys) - 1
        entries = np.array([self.root[t] for t in terms])
        weight = np.array([weights[t] for t in terms], np.int64)
        heap = [(-int((weight * self.values[level][entries]).sum()), -level, 0, entries, weight)]
        best: list[int] = []  # the highest scores met so far, at most `most`: nothing below the least of them is needed
        out = []
        while heap and len(out) < most and -heap[0][0] >= floor:
            bound, level, node, entries, weight = heapq.heappop(heap)
            level = -level
            if not level:
                out.append((-bound, node))
                continue
            begin, end = self.first[level][entries], self.first[level][entries + 1]
            counts = end - begin
            into = np.repeat(begin - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            slots = self.keys[level - 1][into] - (node << FAN)
            w = np.repeat(weight, counts)
            sums = np.zeros(1 << FAN, np.int64)
            np.add.at(sums, slots, w * self.values[level - 1][into])
            good = np.flatnonzero(sums >= floor)
            if level == 1:
                for slot in good.tolist():
                    score = int(sums[slot])
                    if score < floor:
                        continue
                    heapq.heappush(heap, (-score, 0, (node << FAN) + slot, None, None))
                    heapq.heappush(best, score)
                    if len(best) > most:
                        heapq.heappop(best)
                    if len(best) == most:
                        floor = max(floor, best[0])
                continue
            order = np.argsort(slots, kind="stable")
            edges = np.searchsorted(slots[order], np.arange((1 << FAN) + 1))
            for slot in good.tolist():
                own = order[edges[slot] : edges[slot + 1]]
                heapq.heappush(heap, (-int(sums[slot]), 1 - level, (node << FAN) + slot, into[own], w[own]))
        return out


def asked(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, id, terms): each item's different terms; row is its number."""
    rows = pick(items, id_column, text_column)
    schema = T.StructType([rows.schema[0], T.StructField("terms", T.ArrayType(T.BinaryType()))])

    def run(batches):
        for batch in batches:
            terms = [[*dict.fromkeys(words((v.as_py() or "").encode()))] for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], schema.names)

    return written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def indexed(docs: DataFrame, vocabulary: list[bytes], id_column: str, text_column: str) -> DataFrame:
    """(id, n, terms, counts) of each document with a term: its terms with repeats, and those of the vocabulary by number."""
    rows = pick(docs, id_column, text_column).where(F.col(text_column).isNotNull())
    schema = T.StructType([rows.schema[0], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    sent = rows.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(vocabulary)})

    def run(batches):
        get = sent.value.get
        for batch in batches:
            kept, sizes, terms, counts = [], [], [], []
            for k, value in enumerate(batch.column(1)):
                found = words(value.as_py().encode())
                if not found:
                    continue
                own, times = np.unique(np.array([i for w in found if (i := get(w)) is not None], np.int32), return_counts=True)
                kept.append(k)
                sizes.append(len(found))
                terms.append(own)
                counts.append(times)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], schema.names)

    return written(rows.mapInArrow(run, schema))


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def pass_over(docs: DataFrame, block: list, most: int, id_column: str, text_column: str, item_column: str, item_type: T.DataType, run_size: int) -> DataFrame:
    """The best documents of a block of items, each item's from all tasks, ranked."""
    spark = docs.sparkSession
    vocabulary = sorted({bytes(t) for r in block for t in r.terms})
    index = indexed(docs, vocabulary, id_column, text_column)
    told = index.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
    # The vocabulary is of a bounded number of items' texts, so is what comes to the driver.
    holding = {r.term: r.n for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    of = {t: k for k, t in enumerate(vocabulary)}
    weights = {k: weight(told.documents, n) for k, n in holding.items()}
    items = [(r.row, r[item_column], {of[bytes(t)]: weights[of[bytes(t)]] for t in r.terms if of[bytes(t)] in weights}) for r in block]
    sent = spark.sparkContext.broadcast(([x for x in items if x[2]], told.documents, told.length or 0))
    own = index.schema[0]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField(item_column, item_type), T.StructField("_doc", own.dataType), T.StructField("score", T.LongType())])

    def run(batches):
        asked_for, number, length = sent.value
        best: dict[int, list] = {}
        held, size = [], 0

        def searched(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.column(0), null_placement="at_end")).combine_chunks()
            names, sizes = table.column(0), table.column(1).to_numpy()
            # Whole numbers of Python where 64 bits could be too few on the way.
            small = int(sizes.max()) * 50 * number < 1 << 62
            m = 50 + (50 * sizes * number // length if small else np.array([50 * int(x) * number // length for x in sizes], np.int64))
            terms, counts = (pc.list_flatten(table.column(k)).to_numpy() for k in (2, 3))
            doc = np.repeat(np.arange(len(sizes)), pc.list_value_length(table.column(2)).to_numpy())
            trees = MaxTrees(len(sizes), terms, doc, 1_000_000_000 * counts // (1000 * counts + 20 * m[doc]))
            for k, (_, _, w) in enumerate(asked_for):
                mine = best.setdefault(k, [])
                found = trees.search(w, most, mine[-1][0] if len(mine) == most else 1)
                if found:
                    mine += [(score, names[d].as_py()) for score, d in found]
                    mine.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
                    del mine[most:]

        for batch in batches:
            at = 0
            ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:  # rows in order, a run's postings bounded
                fits = int(np.searchsorted(ends, run_size - size + (ends[at - 1] if at else 0), "right"))
                if fits <= at and held:
                    searched(held)
                    held, size = [], 0
                    continue
                upto = max(fits, at + 1)
                held.append(batch.slice(at, upto - at))
                size += int(ends[upto - 1] - (ends[at - 1] if at else 0))
                at = upto
        if held:
            searched(held)
        for k, mine in best.items():
            if mine:
                row, item, _ = asked_for[k]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(mine), pa.int64()), pa.array([item] * len(mine), arrow_item), pa.array([d for _, d in mine], arrow_doc), pa.array([s for s, _ in mine], pa.int64())], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_item, arrow_doc = to_arrow_type(item_type), to_arrow_type(own.dataType)
    found = index.mapInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("_doc")))
    ranked = written(found.withColumn("rank", place).where(F.col("rank") <= most))
    discard(index)
    return ranked.select(item_column, F.col("rank").cast("int").alias("rank"), F.col("_doc").alias(id_column), "score")


def search(docs: DataFrame, items: DataFrame, most: int = 50, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(item, rank, id, score): each item's `most` highest-scoring documents with a score above 0.

    Terms are runs of digits, letters and all that isn't ASCII, A-Z made small. A term's
    weight is floor(1000 ln((2 N + 2) / (2 df + 1))), N the documents with a term and df
    those with this one; a document scores w (10^9 tf div (1000 tf + 20 m)) for each
    different term of the item, with m = 50 + 50 n N div L for its n terms of all L.

    Items are searched for in blocks of a bounded number of terms. For each block the
    documents are read once and leave their counts of its terms in a written table;
    tasks take its rows in runs of bounded size, build max trees over a run's documents
    and keep each item's best, so only `most` rows an item and task meet in the end. No
    document's postings are shuffled, whatever terms it shares with others.

    Each row, item or document, stands for itself: repeated ones come out repeatedly, an
    item's ranks are its own. Null and empty texts have no terms: such documents count
    nowhere, such items have no rows. Null document ids come last among equal scores;
    null item ids are kept. Empty tables give no rows; other columns are left out.
    """
    if most < 1:
        raise ValueError("most must be positive")
    spark = docs.sparkSession
    questions = asked(items, item_column, item_text)
    pairs = questions.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-pairs // block))
    item_type = questions.schema[item_column].dataType
    dealt = questions.where(F.size("terms") > 0).withColumn("_block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    out = None
    for k in range(blocks if pairs else 0):
        # A block's items: about `block` pairs of an item and a term.
        part = pass_over(docs, dealt.where(F.col("_block") == k).collect(), most, id_column, text_column, item_column, item_type, run)
        out = part if out is None else out.unionByName(part)
    discard(questions)
    if out is None:
        schema = T.StructType([T.StructField(item_column, item_type), T.StructField("rank", T.IntegerType()), T.StructField(id_column, pick(docs, id_column).schema[0].dataType), T.StructField("score", T.LongType())])
        return spark.createDataFrame([], schema)
    return out
