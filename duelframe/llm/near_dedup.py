"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct shingles of k words, as 64-bit hashes. Its signature has R symbols,
each the low 8 bits of the least value of one hash function over the set; two sets agree in a
symbol with the probability of their Jaccard similarity (and 1/256 of the rest). The signature is
split into CHUNKS chunks of WIDTH symbols. Two signatures that differ in fewer than 2 * CHUNKS
symbols have a chunk with one differing symbol at most (pigeonhole), so each document enters one
bucket for each chunk and each symbol of it left out: all pairs under that distance meet. Pairs
beyond it meet too, with a chance: at a similarity of 0.8, where 9.6 of 48 symbols differ on
average, the chance to meet nowhere is 0.0002, and it falls fast above.

Equal sets form a class, and one document stands for it. In a bucket, every member is compared with
one hub, not with every other; links are confirmed on the full sets, computed again from the texts.
Components then tell which buckets still hold documents that aren't joined. Of those, documents
that share too few shingles with all open documents of other components can't have a link and go;
the rest gets a further hub. What is open after that is gathered into clusters (documents that buckets
chain together), and within a cluster the documents outside of its largest component are compared with all, in
blocks of bounded size whose tasks return links only. So large groups of copies cost rows in proportion to their size, and no
link between different components is left out. Components come from one task where there are few edges, from large-star and small-star
rounds over written tables beyond; no links, sets or components reach the driver.

Texts move only for documents that share a bucket: once with the ids of a pair, and once to the hub's group,
which is salted. Which documents these are is broadcast where there are few (FEW ids), joined beyond.

Cases: a document without words or text has an empty set and links with nothing; one with fewer
words than k has its whole sequence as its only shingle; a text of any length, or with one very long word, is taken whole; documents with a null doc_id stand for no class
and are kept; rows that share a doc_id are one document in the result of components (the union of
their links) and stay separate rows; an empty table gives no rows; columns of any name and type pass through drop_near.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_written, table, whole, workers_can_import, written

CHUNKS = 8
WIDTH = 6
R = CHUNKS * WIDTH
#: Of R symbols, so many differ at most between sets of the wanted similarity: at 0.8 the mean is
#: 9.6 and the standard deviation 2.8; a chance of 0.00002 lies beyond.
FAR = 22
#: Rounds of further hubs before what is open is compared in blocks.
HUBS = 1
#: Ids up to which a side is broadcast (8 bytes each); beyond, a join.
FEW = 1_000_000
#: Documents and bytes of text in one side of a block.
BLOCK_DOCS, BLOCK_TEXT = 2048, 8e6
#: Edges up to which one task joins components (16 bytes each); beyond, rounds over tables. Both give the same.
FEW_EDGES = 1_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_A = np.array([int.from_bytes(xxhash.xxh128_digest(f"a{i}")[:8], "little") | 1 for i in range(R)], dtype=np.uint64)
_B = np.array([int.from_bytes(xxhash.xxh128_digest(f"b{i}")[:8], "little") for i in range(R)], dtype=np.uint64)


class _Words(dict):
    """Hashes of words; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


_words = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, k: int) -> np.ndarray:
    """The set of a text: sorted distinct 64-bit hashes of k words in a row, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - k + 1) if len(h) else 0
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(h) < k:
            for x in h:
                out = out * _MIX + x
        else:
            for j in range(k):
                out = out * _MIX + h[j : j + n]
        out = _mixed(out + np.uint64(min(len(h), k)))
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """R symbols of one byte each."""
    least = np.full(R, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(s), 4096):
            part = s[lo : lo + 4096]
            np.minimum(least, (part * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (_mixed(least) & np.uint64(0xFF)).astype(np.uint8)


def _sign_batches(k: int):
    def run(batches):
        for batch in batches:
            n, one, two, sig = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), k)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    one.append(int(s.sum(dtype=np.uint64)))
                    two.append(int((_mixed(s) | np.uint64(1)).sum(dtype=np.uint64)))
                sig.append(signature(s).tobytes() if len(s) else None)
            as_long = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), as_long(one), as_long(two), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (together equal for equal sets only), sig (null: empty set)."""
    workers_can_import(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(_sign_batches(k), "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def _key_batches(batches):
    """(key, a) for each bucket of each class representative."""
    for batch in batches:
        ids, n, sigs = batch.column(0), batch.column(1), batch.column(2)
        if not len(ids):
            continue
        raw = np.frombuffer(b"".join(sigs.to_pylist()), dtype=np.uint8).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        shifts = np.arange(WIDTH, dtype=np.uint64) * np.uint64(8)
        codes = (raw << shifts).sum(axis=2, dtype=np.uint64)  # 48 bits a chunk
        keys = np.empty((len(ids), CHUNKS, WIDTH), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(WIDTH):
                left = codes & ~(np.uint64(0xFF) << shifts[j])
                place = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(j)) << np.uint64(50)
                keys[:, :, j] = _mixed(left | place)
        rep = np.repeat(np.arange(len(ids)), R)
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), ids.take(pa.array(rep))], names=["key", "a"])


def _distance(a: Column, b: Column) -> Column:
    """Symbols in which two signatures (arrays of 6 longs) differ."""
    total = None
    for i in range(R // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for s in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, s))
        n = F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
        total = n if total is None else total + n
    return total


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b)) >= percent * F.greatest(a, b)


def similar(own: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets have a similarity of percent or more with a set; all sorted and distinct."""
    sizes = np.fromiter(map(len, others), dtype=np.int64, count=len(others))
    if not len(own) or not len(others):
        return np.zeros(len(others), dtype=bool)
    flat = np.concatenate(others)
    place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    shared = np.bincount(np.repeat(np.arange(len(others)), sizes)[own[place] == flat], minlength=len(others))
    return (100 * shared >= percent * (len(own) + sizes - shared)) & (shared > 0)


def _hub_groups(k: int, percent: int):
    """Links (a, b) of one hub: rows (hub, salt, a, text), where the hub's own text has a null a. Of texts
    that share the hub's id each is tried."""

    def run(t: pa.Table) -> pa.Table:
        ids, texts = t.column("a").to_pylist(), t.column("text")
        hubs = [shingles(x.as_py(), k) for a, x in zip(ids, texts) if a is None]
        hub = t.column("hub")[0].as_py() if len(ids) else None
        found = set()
        for lo in range(0, len(ids), 512):
            part = [(a, shingles(x.as_py(), k)) for a, x in zip(ids[lo : lo + 512], texts.slice(lo, 512)) if a is not None]
            for h in hubs:
                ok = similar(h, [s for _, s in part], percent)
                found |= {a for (a, _), yes in zip(part, ok) if yes}
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return run


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (hub, a) whose full sets are similar, as a written table of links (a, b).

    Each member's text goes to its hub's group once; a group is cut into salts of about 1,000 members, each
    with the hub's text."""
    x = texts.withColumnRenamed("doc_id", "a")
    salts = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("salts"))
    salted = pairs.join(salts, "hub").select("hub", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"), "a")
    members = salted.join(x, "a").select("hub", "salt", "a", "text")
    hubs = salts.join(x.withColumnRenamed("a", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "text")
    return written(members.unionByName(hubs).groupBy("hub", "salt").applyInArrow(_hub_groups(k, percent), "a long, b long"), "links")


def _block(k: int, percent: int):
    """Links (a, b) between documents of a cluster: those of one chunk outside of its largest component
    with those of another chunk. Documents that a link of the block has joined already aren't compared."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.select(["a", "c", "many", "asks", "answers"]).to_pydict()
        texts, known = t.column("text"), {}
        sig = np.array(t.column("w").to_pylist(), dtype=np.int64).reshape(-1, R // 8).view(np.uint8)
        n = t.column("n").to_numpy()

        def set_of(i: int) -> np.ndarray:
            if i not in known:
                known[i] = shingles(texts[i].as_py(), k)
            return known[i]

        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while parent.get(c, c) != c:
                c = parent[c]
            return c

        many = np.array(rows["many"], dtype=bool)
        able = np.flatnonzero(np.array(rows["answers"], dtype=bool))
        out = []
        for i in np.flatnonzero(np.array(rows["asks"], dtype=bool)).tolist():
            fits = (100 * np.minimum(n[i], n[able]) >= percent * np.maximum(n[i], n[able])) & ((sig[able] != sig[i]).sum(axis=1) <= FAR)
            near = able[fits | many[i] | many[able]]
            for lo in range(0, len(near), 256):
                part = [j for j in near[lo : lo + 256].tolist() if root(rows["c"][j]) != root(rows["c"][i])]
                for j, yes in zip(part, similar(set_of(i), [set_of(j) for j in part], percent)):
                    if yes and root(rows["c"][j]) != root(rows["c"][i]):
                        parent[root(rows["c"][j])] = root(rows["c"][i])
                        out.append((rows["a"][i], rows["a"][j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    return run


def _clustered_links(left: DataFrame, info: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components within clusters of left(key, a, c), as a written table."""
    hub = left.groupBy("key").agg(F.min("a").alias("b"))
    chained = components(left.join(hub, "key").select("a", "b").distinct())
    docs = left.groupBy("a").agg(F.min("c").alias("c")).join(chained.withColumnRenamed("node", "a"), "a").withColumnRenamed("component", "cluster")
    docs = written(docs.join(info.select("a", "n", "many", "w"), "a").join(texts.withColumnRenamed("doc_id", "a"), "a"), "clusters")
    sizes = docs.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("cluster").agg(F.max(F.struct("m", "c")).alias("x"), F.sum("m").alias("all")).select("cluster", F.col("x.c").alias("largest"), (F.col("all") - F.col("x.m")).alias("asking"), "all")
    volume = docs.groupBy("cluster").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    chunks = lambda m: F.greatest(F.ceil(F.col(m) / BLOCK_DOCS), F.ceil(F.col("bytes") * F.col(m) / F.col("all") / BLOCK_TEXT), F.lit(1)).cast("int")
    plan = largest.join(volume, "cluster").select("cluster", "largest", chunks("asking").alias("x"), chunks("all").alias("y"))
    every = lambda m: F.sequence(F.lit(0), F.col(m) - 1)
    own = lambda m: F.array(F.pmod(F.xxhash64("a"), F.col(m)).cast("int"))
    placed = docs.join(plan, "cluster")
    roles = F.struct(own("x").alias("i"), every("y").alias("j"), F.lit(True).alias("asks")), F.struct(every("x").alias("i"), own("y").alias("j"), F.lit(False).alias("asks"))
    asking = F.when(F.col("c") == F.col("largest"), F.array(roles[1])).otherwise(F.array(*roles))
    spread = placed.select("cluster", "a", "c", "n", "many", "w", "text", F.explode(asking).alias("r")).select("*", F.explode("r.i").alias("i")).select("*", F.explode("r.j").alias("j"))
    rows = spread.select("cluster", "i", "j", "a", "c", "n", "many", "w", "text", F.col("r.asks").alias("asks"), (~F.col("r.asks")).alias("answers"))
    out = written(rows.groupBy("cluster", "i", "j").applyInArrow(_block(k, percent), "a long, b long"), "links")
    drop_written(docs, chained)
    return out


def _open(placed: DataFrame, least: int) -> DataFrame:
    """placed(key, a, c) of buckets with members of different components, `least` members at least."""
    keys = placed.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count(F.lit(1)).alias("_n")).where((F.col("_lo") != F.col("_hi")) & (F.col("_n") >= least))
    return placed.join(keys.select("key"), "key")


def _shingle_batches(k: int):
    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py(), k) for t in batch.column(1)]
            rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            for lo in range(0, len(rows), 100_000):
                at = pa.array(rows[lo : lo + 100_000])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(flat[lo : lo + 100_000].view(np.int64))], names=["a", "c", "s"])

    return run


def _can_link(left: DataFrame, info: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """left(key, a, c) without members that can't have a link to another component, by an exact bound:
    only shingles that some open document of another component has can be shared with one, and a
    link to a set of m shingles takes percent / (100 + percent) * (n + m) of them. Of m, the least in
    the member's buckets that its own size allows counts."""
    left = written(left.join(info.select("a", "n"), "a"), "open")
    if left.isEmpty():
        return left.select("key", "a", "c")
    least = left.groupBy("key").agg(F.min("n").alias("m"))
    floor = F.greatest("m", F.ceil(percent * F.col("n") / 100))
    docs = written(left.join(least, "key").groupBy("a").agg(F.max("c").alias("c"), F.max("n").alias("n"), F.min(floor).alias("m")), "open-documents")
    have = docs.join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "text", "c").mapInArrow(_shingle_batches(k), "a long, c long, s long")
    have = written(have, "open-shingles")
    shared = have.groupBy("s").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo <> _hi").select("s")
    counts = have.join(shared, "s").groupBy("a").agg(F.count(F.lit(1)).alias("x"))
    able = docs.join(counts, "a").where((100 + percent) * F.col("x") >= percent * (F.col("n") + F.col("m"))).select("a")
    out = written(_open(left.select("key", "a", "c").join(able, "a").select("key", "a", "c"), 2), "open")
    drop_written(left, docs, have)
    return out


def _joined(t: pa.Table) -> pa.Table:
    """node, component of edges (u, v), by union to the lesser root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for a, b in zip(t.column("u").to_pylist(), t.column("v").to_pylist()):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array([root(x) for x in nodes], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node it can reach), of nodes that links(a, b) name, as a written table.

    Few edges are joined in one task. Else large-star and small-star alternate until the edges stay the same,
    which then lead from every node to its component's least.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.count() <= FEW_EDGES:
        out = written(edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_joined, "node long, component long"), "components")
        drop_written(edges)
        return out
    before = -1
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = written(small, "edges")
        count = new.count()
        # Equal in number, and none that wasn't there.
        same = count == before and new.join(edges, ["u", "v"], "left_anti").isEmpty()
        drop_written(edges)
        edges, before = new, count
        if same:
            break
    least = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    out = written(least.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")), "components")
    drop_written(edges)
    return out


def _by_id(reps: DataFrame) -> DataFrame:
    """a, n, w, _classes of reps(a, n_shingles, w). Of texts that share an id the least size counts: the
    bound of _can_link() must hold for each of them."""
    return reps.groupBy("a").agg(F.min("n_shingles").alias("n"), F.max("w").alias("w"), F.count(F.lit(1)).alias("_classes"))


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    signed = written(signatures(docs, k), "signatures")
    same = ["h1", "h2", "n_shingles"]
    classes = written(signed.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy(*same).agg(F.min("doc_id").alias("a"), F.min("sig").alias("sig")), "classes")
    # Two classes can share their least doc_id where rows share a doc_id; the id then stands for both.
    keys = classes.select("a", "n_shingles", "sig").mapInArrow(_key_batches, "key long, a long")
    shared = keys.groupBy("key").agg(F.min("a").alias("hub"), F.max("a").alias("_other")).where("hub <> _other").select("key", "hub")
    members = written(keys.join(shared, "key"), "members")
    words = F.array(*[_long_of(F.col("sig"), i) for i in range(R // 8)])
    small = _by_id(classes.select("a", "n_shingles", words.alias("w")))
    info = written(small.join(members.select("a").distinct(), "a", "left_semi").select("a", "n", "w", (F.col("_classes") > 1).alias("many")), "bucketed")
    wanted = info.select(F.col("a").alias("doc_id"))
    texts = written(docs.join(F.broadcast(wanted) if info.count() <= FEW else wanted, "doc_id", "left_semi"), "bucketed-texts")

    def near(pairs: DataFrame) -> DataFrame:
        """Distinct pairs (hub, a) that may be similar, by size and signature."""
        x = info.select(F.col("a").alias("hub"), F.col("n").alias("n1"), F.col("w").alias("w1"), F.col("many").alias("m1"))
        y = info.select("a", F.col("n").alias("n2"), F.col("w").alias("w2"), F.col("many").alias("m2"))
        fits = (F.col("m1") | F.col("m2")) | (_sizes_fit(F.col("n1"), F.col("n2"), percent) & (_distance(F.col("w1"), F.col("w2")) <= FAR))
        return written(pairs.where("a <> hub").distinct().join(x, "hub").join(y, "a").where(fits).select("hub", "a"), "pairs")

    def open_now(comps: DataFrame) -> DataFrame:
        placed = written(members.join(comps, members["a"] == comps["node"], "left").select("key", "a", F.coalesce("component", "a").alias("c")), "placed")
        out = _can_link(_open(placed, 3), info, texts, k, percent)
        drop_written(placed)
        return out

    pairs = near(members.select("hub", "a"))
    links = _links(pairs, texts, k, percent)
    # Rows of one doc_id with different texts are one document.
    least = F.struct(*same)
    several = signed.where("sig IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(least).alias("x"), F.max(least).alias("y")).where("x <> y").select("doc_id")
    twins = written(signed.join(several, "doc_id").join(classes.select(*same, "a"), same).select(F.col("doc_id").alias("a"), F.col("a").alias("b")).distinct(), "shared-ids")
    drop_written(pairs)
    found = [links, twins]
    for turn in range(HUBS + 1):
        comps = components(_all(found))
        left = open_now(comps)
        if left.isEmpty():
            break
        if turn < HUBS:
            hub = left.groupBy("key").agg(F.min_by(F.struct("a", "c"), F.xxhash64("a", F.lit(turn))).alias("h"))
            pairs = near(left.join(hub, "key").where("c <> h.c").select(F.col("h.a").alias("hub"), "a"))
            found.append(_links(pairs, texts, k, percent))
            drop_written(pairs)
        else:
            found.append(_clustered_links(left, info, texts, k, percent))
            drop_written(comps)
            comps = components(_all(found))
        drop_written(left)
    # From classes to documents; the representative's id carries over.
    placed = written(classes.join(comps, classes["a"] == comps["node"], "left").select(*same, F.coalesce("component", "a").alias("component_id")), "class-components")
    drop_written(members, info, texts, classes, comps, *found)
    return signed.select("doc_id", *same).join(placed, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _all(found: list[DataFrame]) -> DataFrame:
    out = found[0].select("a", "b")
    for x in found[1:]:
        out = out.unionByName(x.select("a", "b"))
    return out


def _long_of(sig: Column, i: int) -> Column:
    """Bytes 8i to 8i + 7 of a binary as a long (of 60 bits and a rest, since conv() is unsigned)."""
    part = lambda lo, n: F.conv(F.hex(F.substring(sig, 8 * i + lo, n)), 16, 10).cast("long")
    return F.shiftleft(part(1, 4), 32).bitwiseOR(part(5, 4))


def drop_near(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without near-duplicates: of each component the document with the least doc_id stays, with
    its own columns. Of rows with equal doc_id and text one stays, with its other columns; rows that share a doc_id and differ in
    text stay or go together; rows with a null doc_id stay."""
    found = near_components(docs, k, percent).where("doc_id IS NOT NULL")
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    twice = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "shared-ids")
    few = lambda x: F.broadcast(x) if x.count() <= FEW else x
    kept = docs.join(few(gone), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
    single = kept.join(few(twice), kept["doc_id"].cast("long") == twice["doc_id"], "left_anti")
    again = kept.join(few(twice), kept["doc_id"].cast("long") == twice["doc_id"], "left_semi")
    # Few rows: one of each doc_id and text, by whatever can be ordered of them.
    row = F.struct(*[again[c].alias(f"c{i}") for i, c in enumerate(again.columns)])
    by = [again[c] for c, t in again.dtypes if "map<" not in t and "variant" not in t]
    place = F.row_number().over(Window.partitionBy(again["doc_id"], whole(again["text"])).orderBy(*by))
    one = again.select(row.alias("row"), place.alias("place")).where("place = 1").select("row.*").toDF(*docs.columns)
    return single.unionByName(one)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), k=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
