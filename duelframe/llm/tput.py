"""Ranked lexical search: three uniform rounds over postings partitioned by term.

Index: tasks cut their documents into chunks of CHUNK and write, for each chunk and term, one block of postings; blocks are
range-partitioned by (term, chunk), so a term's list is contiguous and a frequent term's list spreads over
partitions. A block holds its postings by falling impact, (1000000000 * tf) div (1000 * tf + 8 * m), which no item changes: a
posting scores its impact times the term's weight times the term's repeats in the item. Only terms that some item has are
indexed: they are broadcast where there are MOST_TERMS of them or fewer, else postings of all terms are made and joined with them.

Search, for each item with m lists (terms of weight above 0 that some document has):
1. The head of each list, its K highest postings, gives every document met there a lower bound. The LOOKED documents with the
   highest are looked up in all lists, which makes their bounds exact; the item's K-th largest is t1. A document whose postings
   all score below t1 / m is below t1 and out.
2. Every list is read down to t1 / (DEEPER * m), and what was read goes to its chunk's task, which adds it up by document. That
   sum is a document's new lower bound, and the K-th largest is t2; for each list where it was not met it can have the list's
   cap at most, the largest score below the threshold or the list's own largest. Documents whose upper bound reaches t2 are candidates.
3. Candidates are looked up in all of the item's lists, which gives exact scores, and the K best stay.
All rounds are joins by term or (term, chunk) and sums by document; nothing but counts reaches the driver. The
blocks, what round 2 met and the exact scores are written tables.

Cases: a document or an item without a term (null, empty, separators only) takes no part; rows that share a doc_id are documents of
their own; a null doc_id comes after others of its score; rows that share an item_id make one item, those with a null
item_id are left out; equal scores are ordered by doc_id; texts are counted whole, long ones in slices that end between terms; empty tables
give no rows; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, partitions_for, table, workers_can_import, written

K = 10
#: Documents of the list heads that are looked up for a better first bound.
LOOKED = 50
CHUNK = 8192
#: Bytes of text that are split at once.
SLICE = 4_000_000
#: Terms up to which all tasks get them (some 100 bytes each); beyond, a join.
MOST_TERMS = 200_000
#: Items in one row beside a block.
ASKED = 512
#: Lists are read down to t1 / (DEEPER * m): deeper than need be, which makes later bounds tighter.
DEEPER = 2
_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(text: bytes | None) -> Counter:
    """Terms of a UTF-8 text, with repeats: runs of ASCII letters, digits and other characters beyond ASCII, A-Z lower-cased."""
    found: Counter = Counter()
    text, lo = text or b"", 0
    while lo < len(text):
        part = text[lo : lo + SLICE].translate(_KEEP)
        if lo + SLICE < len(text):  # to the last separator, or on to the next one
            end = part.rfind(b" ")
            if end < 0:
                end, step = len(part), 4096
                while lo + end < len(text) and (cut := text[lo + end : lo + end + step].translate(_KEEP).find(b" ")) < 0:
                    end += step
                end = min(end + cut, len(text) - lo) if lo + end < len(text) else len(text) - lo
                part = text[lo : lo + end].translate(_KEEP)
            part = part[:end]
        found.update(part.split())
        lo += max(len(part), 1)
    return found


def _item_batches(batches):
    for batch in batches:
        items, terms, times = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            counts = term_counts(text)
            items += [item] * len(counts)
            terms += counts.keys()
            times += counts.values()
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], names=["item_id", "term", "times"])


_RAW = "chunk long, term string, pos array<int>, tf array<int>, n array<int>, doc_id array<long>"


def _block_batches(wanted):
    """Blocks of each run of CHUNK documents that have terms; its row without a term has all doc_ids and numbers of terms."""

    def run(batches):
        terms = None if wanted is None else wanted.value
        chunk = TaskContext.get().partitionId() * 2**24
        ids, ns, lists = [], [], {}

        def block():
            names = sorted(lists)
            flat = [np.array(lists[t], np.int32).reshape(-1, 2) for t in names]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
            both = np.concatenate([np.zeros((0, 2), np.int32), *flat])
            n = np.array(ns, np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in (both[:, 0], both[:, 1], n[both[:, 0]])]
            rows = [pa.array([chunk] * len(names), pa.int64()), pa.array(names, pa.binary()).cast(pa.string()), *arrays, pa.nulls(len(names), pa.list_(pa.int64()))]
            own = [pa.array([chunk], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.array([ns], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64()))]
            names_ = ["chunk", "term", "pos", "tf", "n", "doc_id"]
            for lo in range(0, len(names), 4096):
                yield pa.RecordBatch.from_arrays([a.slice(lo, 4096) for a in rows], names=names_)
            yield pa.RecordBatch.from_arrays(own, names=names_)

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                counts = term_counts(text)
                if not counts:
                    continue
                pos = len(ids)
                ids.append(id_)
                ns.append(counts.total())
                for t in counts if terms is None else terms & counts.keys():
                    if t in lists:
                        lists[t] += (pos, counts[t])
                    else:
                        lists[t] = [pos, counts[t]]
                if len(ids) == CHUNK:
                    yield from block()
                    chunk += 1
                    ids, ns, lists = [], [], {}
        if ids:
            yield from block()

    return run


def _impact_batches(n_docs: int, n_terms: int):
    def run(batches):
        for batch in batches:
            pos_out, impact_out, ends = [], [], [0]
            for p, t, n in zip(batch.column("pos"), batch.column("tf"), batch.column("n")):
                p, t, n = (v.values.to_numpy().astype(np.int64) for v in (p, t, n))
                impact = (1_000_000_000 * t) // (1000 * t + 8 * (25 + 75 * n * n_docs // n_terms))
                order = np.argsort(-impact, kind="stable")
                pos_out.append(p[order])
                impact_out.append(impact[order])
                ends.append(ends[-1] + len(p))
            cut = pa.array(np.array(ends, np.int32))
            arrays = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int32))) for v in (pos_out, impact_out)]
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("chunk"), *arrays], names=["term", "chunk", "pos", "impact"])

    return run


class Index:
    """blocks(term, chunk, pos, impact) by term; documents(chunk, doc_id array); weights(term, df, w, top)."""

    def __init__(self, docs: DataFrame, terms: DataFrame | None = None):
        """docs(doc_id, text); terms(term): those to be indexed, all if None."""
        spark = docs.sparkSession
        workers_can_import(spark)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        few = terms is not None and terms.count() <= MOST_TERMS
        wanted = spark.sparkContext.broadcast({r["term"].encode() for r in terms.collect()}) if few else None  # MOST_TERMS at most
        raw = written(docs.mapInArrow(_block_batches(wanted), _RAW), "postings-by-chunk")
        self.documents = written(raw.where("term IS NULL").select("chunk", "doc_id", "n"), "documents-by-chunk")
        total = self.documents.agg(F.sum(F.size("n")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("terms")).first()
        self.n_docs, self.n_terms = int(total["docs"] or 0), int(total["terms"] or 0)
        lists = raw.where("term IS NOT NULL").drop("doc_id")
        if terms is not None and not few:
            lists = lists.join(terms, "term", "left_semi")
        size = lists.agg(F.sum(F.size("pos"))).first()[0] or 0
        by_term = lists.repartitionByRange(partitions_for(spark, 12 * size, 64e6), "term", "chunk").sortWithinPartitions("term", "chunk")
        self.blocks = written(by_term.mapInArrow(_impact_batches(self.n_docs, max(1, self.n_terms)), "term string, chunk long, pos array<int>, impact array<int>"), "postings-by-term")
        drop_written(raw)
        df = self.blocks.groupBy("term").agg(F.sum(F.size("pos")).cast("long").alias("df"), F.max(F.get("impact", F.lit(0))).cast("long").alias("top"))
        self.weights = df.withColumn("w", F.floor(1000 * F.log((F.lit(2 * self.n_docs + 2) / (2 * F.col("df") + 1)))).cast("long"))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times of items(item_id, text)."""
    workers_can_import(items.sparkSession)
    x = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return x.mapInArrow(_item_batches, "item_id long, term string, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _kth(scored: DataFrame, k: int, by: str, name: str) -> DataFrame:
    """item_id, name: the item's k-th largest value; items with fewer rows have none."""
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc(by)))
    return scored.select("item_id", by, place.alias("_k")).where(F.col("_k") <= k).where(F.col("_k") == k).select("item_id", F.col(by).alias(name))


_MET = "item_id long, chunk long, pos int, score long, upper long"


def _met_in_chunk(key, t):
    """What each item meets in one chunk's blocks, read down to its thresholds: documents that can reach its first bound."""
    t = t.combine_chunks()
    asked = t.column("asked").chunk(0) if t.num_rows else None
    every = asked.flatten()
    items, first = np.unique(every.field("item_id").to_numpy(), return_index=True)
    caps, t1 = every.field("caps").to_numpy()[first], every.field("t1").to_numpy()[first]
    width = 1 + max(int(p.values.to_numpy().max(initial=0)) for p in t.column("pos"))
    score, cap = np.zeros((len(items), width), np.int64), np.zeros((len(items), width), np.int64)
    for pos, impact, who in zip(t.column("pos"), t.column("impact"), asked):
        pos, impact = pos.values.to_numpy(), impact.values.to_numpy().astype(np.int64)
        item, weight, least, own = (who.values.field(c).to_numpy() for c in ("item_id", "weight", "least", "cap"))
        counts = np.searchsorted(-impact, -least, side="right")
        for i, n, w, c in zip(np.searchsorted(items, item), counts, weight, own):
            at = pos[:n]  # each document once
            score[i, at] += w * impact[:n]
            cap[i, at] += c
    upper = score + caps[:, None] - cap
    i, at = np.nonzero((score > 0) & (upper >= t1[:, None]))
    return pa.table({"item_id": items[i], "chunk": pa.array(np.full(len(i), key[0].as_py(), np.int64)), "pos": pa.array(at.astype(np.int32)), "score": score[i, at], "upper": upper[i, at]})


def _lookup_batches(batches):
    """Scores of the wanted documents in each block."""
    for batch in batches:
        for chunk, pos, impact, wanted in zip(batch.column("chunk"), batch.column("pos"), batch.column("impact"), batch.column("wanted")):
            pos, impact = pos.values.to_numpy(), impact.values.to_numpy().astype(np.int64)
            item, at, weight = (wanted.values.field(c).to_numpy() for c in ("item_id", "pos", "weight"))
            order = np.argsort(pos, kind="stable")
            place = np.minimum(np.searchsorted(pos, at, sorter=order), len(pos) - 1)
            hit = order[place]
            on = pos[hit] == at
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(item[on]), pa.array(np.full(int(on.sum()), chunk.as_py())), pa.array(at[on]), pa.array(weight[on] * impact[hit[on]])], names=["item_id", "chunk", "pos", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of docs(doc_id, text) for each of items(item_id, text)."""
    asked = written(item_terms(items), "item-terms")
    index = Index(docs, asked.select("term").distinct())
    found = ranked(index, asked, k)
    return found


def _looked_up(index: Index, lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """item_id, chunk, pos, score: the exact scores of pairs(item_id, chunk, pos)."""
    wanted = pairs.join(lists.select("item_id", "term", "weight"), "item_id").groupBy("term", "chunk").agg(F.collect_list(F.struct("item_id", "pos", "weight")).alias("wanted"))
    found = index.blocks.join(wanted, ["term", "chunk"]).select("chunk", "pos", "impact", "wanted").mapInArrow(_lookup_batches, "item_id long, chunk long, pos int, score long")
    return found.groupBy("item_id", "chunk", "pos").agg(F.sum("score").alias("score"))


def ranked(index: Index, asked: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score from an index, for asked(item_id, term, times)."""
    lists = asked.join(index.weights, "term").where("w > 0").select("item_id", "term", (F.col("times") * F.col("w")).alias("weight"), "top")
    lists = written(lists.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("item_id"))), "item-lists")
    # Round 1: list heads.
    head = index.blocks.select("term", "chunk", F.inline(F.arrays_zip(F.slice("pos", 1, k).alias("pos"), F.slice("impact", 1, k).alias("impact"))))
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "chunk", "pos"))
    head = head.withColumn("_k", place).where(F.col("_k") <= k)
    first = head.join(lists, "term").groupBy("item_id", "chunk", "pos").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "chunk", "pos"))
    first = first.withColumn("_k", place).where(F.col("_k") <= max(k, LOOKED)).select("item_id", "chunk", "pos")
    t1 = _kth(_looked_up(index, lists, first), k, "score", "t1")
    # Round 2: every list down to the threshold.
    each = F.col("weight") * F.col("m") * DEEPER
    limits = lists.join(t1, "item_id", "left").withColumn("t1", F.coalesce("t1", F.lit(0))).withColumn("_each", each)
    limits = limits.withColumn("least", F.greatest(F.lit(1).cast("long"), F.expr("(t1 + _each - 1) DIV _each")))
    limits = limits.withColumn("cap", F.col("weight") * F.least(F.col("least") - 1, F.col("top")))
    limits = limits.withColumn("caps", F.sum("cap").over(Window.partitionBy("item_id")))
    part = F.pmod(F.xxhash64("item_id"), F.lit(1 + asked.select("item_id").distinct().count() // ASKED))
    asks = limits.groupBy("term", part.alias("part")).agg(F.collect_list(F.struct("item_id", "weight", "least", "cap", "caps", "t1")).alias("asked"), F.min("least").alias("deepest"))
    blocks = index.blocks.join(asks, "term").withColumn("_n", F.size(F.filter("impact", lambda x: x >= F.col("deepest")))).where("_n > 0")
    met = blocks.select("chunk", "part", F.slice("pos", F.lit(1), F.col("_n")).alias("pos"), F.slice("impact", F.lit(1), F.col("_n")).alias("impact"), "asked").groupBy("chunk", "part").applyInArrow(_met_in_chunk, _MET)
    met = written(met, "met")
    t2 = _kth(met, k, "score", "t2")
    able = met.join(t2, "item_id", "left").where("upper >= coalesce(t2, 0)").select("item_id", "chunk", "pos")
    # Round 3: exact scores of the candidates.
    exact = written(_looked_up(index, lists, able), "exact-scores")
    t3 = _kth(exact, k, "score", "t3")
    best = exact.join(t3, "item_id", "left").where("score > 0 AND score >= coalesce(t3, 0)").drop("t3")
    best = best.join(index.documents.select("chunk", F.col("doc_id").alias("ids")), "chunk").select("item_id", F.get("ids", F.col("pos")).alias("doc_id"), "score", "chunk", "pos")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "chunk", "pos"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_tput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_SQL_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
TPUT_SQL = f"""
WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS t FROM documents), n AS (SELECT count(*) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d WHERE len(t) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, n GROUP BY term, docs),
m AS (SELECT r, doc_id, 25 + (75 * len(t) * docs) // terms AS m FROM d, n WHERE len(t) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
