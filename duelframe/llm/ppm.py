"""Scores of documents by prediction by partial matching, pretrained on a part of the corpus.

A text is its tokens: lower-case words and one end. Each word is coded byte by byte and closed by an
end-of-word symbol. The model is a trie of byte contexts, from the longest to the shortest:

1. the whole word before and what has passed of the word itself. Its counts nest, so the product of a
   word's symbols in this context is count(word before, word) / count(word before);
2. what has passed of the word, up to DEPTH bytes;
3. the last two bytes, one byte and none, then equal shares.

From 2 to 3 and within 3 an escape is coded where a context has no count for the next symbol, and symbols that a
longer context has counts for are excluded from the shorter ones. Escapes of 2 are estimated from the trie itself, by
leaving one occurrence out, for each depth and size of context; contexts of 3 count each
distinct word once (their symbols are those that longer contexts failed to predict) and escape in
proportion to their distinct symbols. Between 1 and 2 the escape is estimated from the text so far: for each size of context,
how many words it has predicted there; its share of the weight goes to the shorter contexts (a mixture,
so that no exclusion is needed). The probabilities of all token sequences sum to one.

The trie is pretrained; each text adapts it: with a weight that grows along the text, a word has its
share among the words before it.

How it runs: the documents are cut into chunks of CHUNK bytes where they are read, and become numbers of the chunk's
sorted words, in a written table (one row a chunk). Words go by ranges, as one row for each chunk and
range, so a word that all documents have costs one entry a chunk; each range is walked as a trie. Nodes that span a border between
ranges are summed over ranges and joined to just the ranges that they touch. Word pairs go by ranges of a hash of
24 + log2(bytes of the corpus) - 6 bits (so that an unseen pair is taken for a seen one with a chance of less than a millionth, at any size),
sorted and delta-coded. Scores and counts come back to their chunk in the order in which they were sent.

What is gathered grows with the corpus: counts of all words and all pairs of words of all training documents. To the
driver come only contexts of two bytes (256 * 256 * 257 counts at most, whatever the corpus) and the escape table.

Cases: null and empty texts are one end token; bytes of any kind are symbols; texts and words of any length are taken whole (of words
longer than DEPTH bytes, the rest is coded in contexts of two bytes); a null doc_id counts
as an empty text in the rule that splits training from held-out; without training documents all
symbols have equal shares; an empty table gives no rows; rows are never merged.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions_for, table, whole, workers_can_import, written

DEPTH = 24
#: Bytes of the longest short context.
ORDER = 2
START = b"\x20" * ORDER
#: Words after which half of the weight lies on the words of the same text so far.
ADAPT = 1600
#: Hits and misses that a size of context starts with, in the estimate of its escape.
HITS, MISSES = 0.4, 2.0
#: Bytes of text in a chunk, and in a range of words or pairs.
CHUNK, RANGE_TEXT, PAIR_TEXT = 5e6, 160e6, 16e6
#: Words of a bounded sample of documents that decide where ranges begin; results don't depend on them.
SAMPLE_DOCS, SAMPLE_WORDS = 1000, 300
FOLDS, HELD_OUT = 7, 2
#: Symbols after the 256 bytes.
CLOSE, END = 256, 257
#: Scores travel in units of 2 ** -30.
UNIT = 2.0**30
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


_CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, lengths array<int>, ids binary, words binary, totals binary, counts binary"


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes as the largest needs, byte plane by byte plane, which compress well."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _of_planes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(raw[0], -1)
    full = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    full[:, : raw[0]] = planes.T
    return full.view("<u8").ravel().astype(np.int64)


def _by_frequency(totals: np.ndarray) -> np.ndarray:
    """Numbers of words from the most frequent down: their own numbers in a text are then small."""
    return np.lexsort((np.arange(len(totals)), -totals))


def _chunk_batches(batches):
    """One row for each chunk: its documents as numbers of its sorted words, these words, and their counts in
    training documents."""
    numbers: dict[bytes, int] = {}
    docs: list[tuple] = []
    size = 0

    def row():
        found = list(numbers)
        order = sorted(range(len(found)), key=found.__getitem__)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        ids = rank[np.concatenate([x for _, _, x in docs])] if numbers else np.zeros(0, np.int64)
        train = np.repeat([not held for _, held, _ in docs], [len(x) for _, _, x in docs])
        totals, counts = np.bincount(ids, minlength=len(order)), np.bincount(ids[train], minlength=len(order))
        place = np.empty(len(order), dtype=np.int64)
        place[_by_frequency(totals)] = np.arange(len(order))
        one = lambda v, t: pa.array([v], t)
        return pa.RecordBatch.from_arrays([one(random.getrandbits(62), pa.int64()), one([d for d, _, _ in docs], pa.list_(pa.int64())), one([h for _, h, _ in docs], pa.list_(pa.bool_())), one([len(x) for _, _, x in docs], pa.list_(pa.int32())), one(_planes(place[ids]), pa.binary()), one(b"\n".join(found[i] for i in order), pa.binary()), one(_planes(totals), pa.binary()), one(_planes(counts), pa.binary())], names=[x.split()[0] for x in _CHUNKS.split(", ")])

    for batch in batches:
        for i in range(batch.num_rows):
            doc_id, held, text = (batch.column(j)[i].as_py() for j in range(3))
            words = text.encode().lower().split()
            docs.append((doc_id, held, np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int32, count=len(words))))
            size += len(text) + 64
            if size > CHUNK:
                yield row()
                numbers, docs, size = {}, [], 0
    if docs:
        yield row()


def _numbers(ids: bytes, totals: bytes) -> np.ndarray:
    return _by_frequency(_of_planes(totals))[_of_planes(ids)] if len(ids) > 1 else np.zeros(0, np.int64)


def _words(blob: bytes) -> list[bytes]:
    return blob.split(b"\n") if blob else []


def _word_batches(shared):
    """(range, chunk, first, words, counts) for each range that a chunk has words in."""

    def run(batches):
        cuts = shared.value
        for batch in batches:
            for chunk, blob, counts in zip(*(c.to_pylist() for c in batch.columns)):
                words, counts = _words(blob), _of_planes(counts)
                out, lo = [], 0
                for i, cut in enumerate([*cuts, None]):
                    hi = len(words) if cut is None else bisect_left(words, cut, lo)
                    if hi > lo:
                        out.append((i, chunk, lo, b"\n".join(words[lo:hi]), _planes(counts[lo:hi])))
                    lo = hi
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "chunk", "first", "words", "counts"])

    return run


def _hashes(words: list[bytes]) -> np.ndarray:
    """Of each word, of the end, and of the start of a text."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in (*words, b"\n", b"\n\n")), dtype=np.uint64, count=len(words) + 2)


def _sequence(lengths: np.ndarray, ids: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word before, word) of each token: the end is n_words, the start n_words + 1."""
    doc = np.repeat(np.arange(len(lengths)), lengths + 1)
    ends = np.cumsum(lengths + 1) - 1
    cur = np.full(len(doc), n_words, dtype=np.int64)
    inside = np.ones(len(doc), dtype=bool)
    inside[ends] = False
    cur[inside] = ids
    before = np.concatenate([[n_words + 1], cur[:-1]]) if len(cur) else cur
    before[np.concatenate([[0], ends[:-1] + 1])] = n_words + 1
    return doc, before, cur


def _pairs(words: list[bytes], before: np.ndarray, cur: np.ndarray, bits: int) -> np.ndarray:
    """The hash of each (word before, word)."""
    h = _hashes(words)
    with np.errstate(over="ignore"):
        x = (h[before] ^ np.uint64(0x5851F42D4C957F2D)) * _MIX + h[cur]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(64 - bits)


def _packed(x: np.ndarray) -> bytes:
    """Sorted numbers as differences."""
    return _planes(np.diff(x, prepend=np.uint64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_of_planes(raw).astype(np.uint64), dtype=np.uint64)


def _pair_batches(bits: int, ranges: int):
    """(range, chunk, pairs, counts): a chunk's distinct pairs, and how often training documents have them."""

    def run(batches):
        for batch in batches:
            for chunk, held, lengths, ids, blob, totals in zip(*(c.to_pylist() for c in batch.columns)):
                words = _words(blob)
                doc, before, cur = _sequence(np.array(lengths, dtype=np.int64), _numbers(ids, totals), len(words))
                found, place = np.unique(_pairs(words, before, cur, bits), return_inverse=True)
                counts = np.bincount(place[~np.array(held, dtype=bool)[doc]], minlength=len(found))
                at = np.searchsorted(found, _starts(bits, ranges)).tolist()
                out = [(i, chunk, _packed(found[lo:hi]), _planes(counts[lo:hi])) for i, (lo, hi) in enumerate(zip(at, [*at[1:], len(found)])) if hi > lo]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "chunk", "pairs", "counts"])

    return run


def _starts(bits: int, ranges: int) -> np.ndarray:
    return np.array([(i << bits) // ranges for i in range(ranges)], dtype=np.uint64)


def _pair_counts(t: pa.Table) -> pa.Table:
    """The counts of a range's pairs over all chunks, to each chunk in its own order."""
    own = [_unpacked(x.as_py()) for x in t.column("pairs")]
    found, place = np.unique(np.concatenate(own), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, place, np.concatenate([_of_planes(x.as_py()) for x in t.column("counts")]))
    back, lo = [], 0
    for x in own:
        back.append(_planes(total[place[lo : lo + len(x)]]))
        lo += len(x)
    return pa.table({"chunk": t.column("chunk"), "kind": pa.array([1] * len(own), pa.int32()), "first": t.column("range").cast(pa.int64()), "x": pa.array(back, pa.binary()), "c": pa.array([b""] * len(own), pa.binary())})


def _children(words: list[bytes], lo: int, hi: int, depth: int):
    """(symbol, from, to) for each run of words[lo:hi] with the same symbol at this depth."""
    while lo < hi:
        word = words[lo]
        if len(word) == depth:
            end, symbol = lo + 1, CLOSE
            while end < hi and len(words[end]) == depth:
                end += 1
        else:
            symbol, end = word[depth], lo + 1
            while end < hi and words[end][depth] == symbol:
                end += 1
        yield symbol, lo, end
        lo = end


class _Range:
    """The words of a range, sorted and distinct, with their counts; from rows (words, counts, ...)."""

    def __init__(self, rows: pa.Table):
        self.parts = [_words(x.as_py()) for x in rows.column("words")]
        total: dict[bytes, int] = {}
        for words, counts in zip(self.parts, rows.column("counts")):
            for w, c in zip(words, _of_planes(counts.as_py()).tolist()):
                total[w] = total.get(w, 0) + c
        self.words: list[bytes] = sorted(total)
        self.c = np.fromiter(map(total.__getitem__, self.words), dtype=np.int64, count=len(total))
        self.before = np.concatenate([[0], np.cumsum(self.c)]).tolist()
        self.types_before = np.concatenate([[0], np.cumsum(self.c > 0)]).tolist()

    def count(self, lo: int, hi: int) -> int:
        return self.before[hi] - self.before[lo]

    def types(self, lo: int, hi: int) -> int:
        """Words of training documents."""
        return self.types_before[hi] - self.types_before[lo]

    def edges(self) -> set[bytes]:
        """Nodes that the range may share with its neighbours."""
        return {w[:d] for w in ((self.words[0], self.words[-1]) if self.words else ()) for d in range(min(len(w), DEPTH - 1) + 1)}


def _size_class(n: int) -> int:
    return min(n.bit_length(), 24)


_SURVEY = "range int, kind string, a binary, b int, n long"


def _survey(rows: pa.Table) -> pa.Table:
    """Rows (range, kind, a, b, n) of what the model needs besides the range itself: short contexts (c: key,
    symbol), escape statistics (e: class, 1 for all or 0 for novel; of nodes with two training words or more), nodes on the range's borders (b: prefix, symbol, or
    -1 for the training words below), the borders themselves (x: prefix), and totals (t: 0 for types, 1 for tokens)."""
    r = _Range(rows)
    short: Counter = Counter()
    for word, c in zip(r.words, r.c.tolist()):
        if c:
            last = START
            for x in word:
                short[last, x] += 1
                last = last[1:] + bytes((x,))
            short[last, CLOSE] += 1
    escapes: Counter = Counter()
    borders: Counter = Counter()
    edges = r.edges()
    todo = [(0, len(r.words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        prefix = r.words[lo][:depth] if lo < hi else b""
        n, ones, distinct = 0, 0, 0
        on_border = prefix in edges
        for symbol, a, b in _children(r.words, lo, hi, depth):
            c = r.count(a, b)
            if on_border:
                borders[prefix, symbol] += c
            if c:
                n += c
                distinct += 1
                ones += c == 1
            if symbol != CLOSE and depth + 1 < DEPTH and (r.types(a, b) > 1 or r.words[a][: depth + 1] in edges):
                todo.append((a, b, depth + 1))
        if on_border:
            borders[prefix, -1] += r.types(lo, hi)
        elif n > 1:
            size, d = _size_class(n - 1), min(depth, 12)
            if ones:
                key = (d, size, distinct == 2)
                escapes[(*key, 0)] += ones
                escapes[(*key, 1)] += ones
            if n > ones:
                escapes[(d, size, distinct == 1, 1)] += n - ones
    out = [("c", k, s, n) for (k, s), n in short.items()]
    out += [("e", f"{d},{s},{int(one)}".encode(), what, n) for (d, s, one, what), n in escapes.items()]
    out += [("b", k, s, n) for (k, s), n in borders.items()]
    out += [("x", k, 0, 0) for k in edges]
    out += [("t", b"", 0, int((r.c > 0).sum())), ("t", b"", 1, int(r.c.sum()))]
    own = rows.column("range")[0].as_py()
    return pa.table({"range": pa.array([own] * len(out), pa.int32()), **{name: pa.array([x[i] for x in out], t) for i, (name, t) in enumerate((("kind", pa.string()), ("a", pa.binary()), ("b", pa.int32()), ("n", pa.int64())))}})


class _Model:
    """The parts of the model that every task has, and the border nodes of the range at hand."""

    def __init__(self, rows, ends: int):
        self.order, self.ends = ORDER, ends
        self.short = [defaultdict(Counter) for _ in range(ORDER + 1)]
        seen: dict[str, dict[int, int]] = defaultdict(dict)
        for kind, a, b, n in rows:
            a = bytes(a)
            if kind == "c":
                for order in range(ORDER + 1):
                    self.short[order][a[ORDER - order :]][b] += n
            elif kind == "e":
                seen[a.decode()][b] = seen[a.decode()].get(b, 0) + n
        self.escape_at = {tuple(map(int, k.split(","))): (v.get(0, 0) + 0.5) / (v.get(1, 0) + 1.0) for k, v in seen.items()}
        self.rest: dict = {}
        self.set_borders([])

    def set_borders(self, rows) -> None:
        """rows (prefix, symbol, count) of nodes that more ranges than one have; the root also has ends of texts."""
        self.borders: dict[bytes, dict[int, int]] = defaultdict(dict)
        for prefix, symbol, n in rows:
            self.borders[bytes(prefix)][symbol] = n
        if self.ends:
            self.borders[b""][END] = self.ends

    def escape(self, n: int, distinct: int, depth: int) -> float:
        # The context of size n that the statistics left one out of was of size n + 1.
        found = self.escape_at.get((min(depth, 12), _size_class(n), int(distinct == 1)))
        return found if found is not None else distinct / (2.0 * n)

    def low(self, last: bytes, symbol: int, out: frozenset, at_start: bool) -> float:
        """log10 of the symbol's probability in the short contexts, without the excluded symbols."""
        total, out = 0.0, set(out)
        for order in range(self.order, -1, -1):
            found = self.short[order].get(last[ORDER - order :])
            if not found:
                continue
            left = {s: c for s, c in found.items() if s not in out} if out else found
            if not left:
                continue
            n, d = sum(left.values()), len(left)
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2.0 * n))
            total += math.log10(d / (2.0 * n))
            out.update(left)
        return total - math.log10(max(1, (258 if at_start else 257) - len(out)))

    def low_rest(self, word: bytes, depth: int) -> float:
        """log10 of what follows word[:depth] up to the end of the word, in short contexts alone."""
        total, known = 0.0, self.rest
        last = (START + word[:depth])[-ORDER:]
        for symbol in (*word[depth:], CLOSE):
            got = known.get((last, symbol))
            if got is None:
                if len(known) > 200_000:
                    known.clear()
                got = known[last, symbol] = self.low(last, symbol, frozenset(), False)
            total += got
            last = last[1:] + bytes((symbol,)) if symbol != CLOSE else last
        return total

    def unseen(self, word: bytes, depth: int, out: frozenset) -> float:
        """log10 of the rest of a word whose symbol at this depth was escaped from."""
        symbol = word[depth] if len(word) > depth else CLOSE
        first = self.low((START + word[:depth])[-ORDER:], symbol, out, depth == 0)
        return first + (self.low_rest(word, depth + 1) if symbol != CLOSE else 0.0)

    def node(self, prefix: bytes, own: dict[int, int]) -> dict[int, int]:
        """Counts by symbol, from all ranges where the node spans a border."""
        return {s: c for s, c in (self.borders.get(prefix) or own).items() if c}

    def score(self, r: _Range) -> np.ndarray:
        """log10 probability of each word of the range, as a token."""
        words, out = r.words, np.zeros(len(r.words))
        todo = [(0, len(words), 0, 0.0)] if words else []
        while todo:
            lo, hi, depth, so_far = todo.pop()
            prefix = words[lo][:depth]
            runs = list(_children(words, lo, hi, depth))
            counts = self.node(prefix, {s: r.count(a, b) for s, a, b in runs})
            n, d = sum(counts.values()), len(counts)
            if not n:
                for i in range(lo, hi):
                    out[i] = so_far + self.unseen(words[i], depth, frozenset())
                continue
            escape = self.escape(n, d, depth)
            stay, leave = math.log10(1 - escape), math.log10(escape)
            taken = frozenset(counts)
            for symbol, a, b in runs:
                c = counts.get(symbol, 0)
                if not c:
                    for i in range(a, b):
                        out[i] = so_far + leave + self.unseen(words[i], depth, taken)
                    continue
                here = so_far + stay + math.log10(c / n)
                if symbol == CLOSE:
                    out[a:b] = here
                elif depth + 1 >= DEPTH:
                    for i in range(a, b):
                        out[i] = here + self.low_rest(words[i], depth + 1)
                elif b - a == 1 and words[a][: depth + 1] not in self.borders:
                    out[a] = here + self.alone(words[a], depth + 1, c)
                else:
                    todo.append((a, b, depth + 1, here))
        return out

    def alone(self, word: bytes, depth: int, n: int) -> float:
        """log10 of the rest of a word that alone is below this node: each symbol is the only one."""
        total = sum(math.log10(1 - self.escape(n, 1, d)) for d in range(depth, min(len(word), DEPTH - 1) + 1))
        return total + (self.low_rest(word, DEPTH) if len(word) >= DEPTH else 0.0)

    def end(self) -> float:
        """log10 of the end of a text, as a token."""
        counts = self.node(b"", {})
        n = sum(counts.values())
        if not n:
            return self.low(START, END, frozenset(), True)
        escape = self.escape(n, len(counts), 0)
        if END in counts:
            return math.log10((1 - escape) * counts[END] / n)
        return math.log10(escape) + self.low(START, END, frozenset(counts), True)


def _score_range(model):
    """The scores and counts of a range's words, to each chunk in its own order."""

    def run(rows: pa.Table, borders: pa.Table) -> pa.Table:
        m, r = model.value, _Range(rows)
        m.set_borders(zip(*(borders.column(c).to_pylist() for c in ("a", "b", "n"))))
        score, at = m.score(r), {w: i for i, w in enumerate(r.words)}
        index = [np.fromiter(map(at.__getitem__, words), dtype=np.int64, count=len(words)) for words in r.parts]
        return pa.table({"chunk": rows.column("chunk"), "kind": pa.array([0] * len(index), pa.int32()), "first": rows.column("first"), "x": pa.array([_planes(np.rint(-UNIT * score[i])) for i in index], pa.binary()), "c": pa.array([_planes(r.c[i]) for i in index], pa.binary())})

    return run


def _earlier(key: np.ndarray, flag: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(how many earlier places have the same key, of how many the flag is set)."""
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(key) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0)) if len(key) else np.zeros(0, np.int64)
    n, hits = np.empty(len(key)), np.zeros(len(key))
    n[order] = np.arange(len(key)) - start
    if flag is not None and len(key):
        run = np.concatenate([[0], np.cumsum(flag[order])])
        hits[order] = run[:-1] - run[start]
    return n, hits


def token_scores(doc: np.ndarray, before: np.ndarray, cur: np.ndarray, lp: np.ndarray, c: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """log10 probability of each token. lp and c are by word, then the end, then the start (whose c counts
    training texts); pair counts each token's (word before, word)."""
    k, _ = _earlier(doc)
    context = c[before]
    bits = np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)
    n, hits = _earlier(doc * 64 + bits, pair > 0)
    stay = np.where(context > 0, (hits + HITS) / (n + HITS + MISSES), 0.0)
    p = (1 - stay) * 10.0 ** lp[cur] + stay * pair / np.maximum(context, 1)
    weight = k / (k + ADAPT)
    same, _ = _earlier(doc * (len(c) + 1) + cur)
    return np.log10((1 - weight) * p + weight * same / np.maximum(k, 1))


def _sum_chunk(total: float, ends: int, end_lp: float, size: float, bits: int):
    """Sums of the documents of one chunk; size: N + V + 1 of the base model."""

    def run(chunks: pa.Table, back: pa.Table) -> pa.Table:
        if not len(chunks):
            return _empty()
        lengths = np.array(chunks.column("lengths")[0].as_py(), dtype=np.int64)
        words = _words(chunks.column("words")[0].as_py())
        doc, before, cur = _sequence(lengths, _numbers(chunks.column("ids")[0].as_py(), chunks.column("totals")[0].as_py()), len(words))
        lp, c = np.empty(len(words) + 2), np.empty(len(words) + 2, dtype=np.int64)
        pairs = []
        for kind, first, x, own in zip(*(back.column(n).to_pylist() for n in ("kind", "first", "x", "c"))):
            if kind:
                pairs.append((first, _of_planes(x)))
            else:
                part = _of_planes(x) / -UNIT
                lp[first : first + len(part)] = part
                c[first : first + len(part)] = _of_planes(own)
        lp[-2:], c[-2:] = (end_lp, 0.0), ends
        _, place = np.unique(_pairs(words, before, cur, bits), return_inverse=True)
        pair = np.concatenate([x for _, x in sorted(pairs, key=lambda p: p[0])]).astype(np.float64)[place]
        per_doc = lambda x: np.bincount(doc, weights=x, minlength=len(lengths))
        known = c[cur] > 0
        score = per_doc(token_scores(doc, before, cur, lp, c, pair))
        base = per_doc(np.log10((c[cur] + 1) / size))
        n = len(lengths)
        return pa.table({"doc_id": pa.array(chunks.column("doc_ids")[0].as_py(), pa.int64()), "held_out": pa.array(chunks.column("held")[0].as_py(), pa.bool_()), "n_tokens": pa.array(lengths + 1), "n_known": pa.array(per_doc(known).astype(np.int64)), "train_tokens": pa.array([int(total)] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    return run


def _empty() -> pa.Table:
    return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})


def _cuts(docs: DataFrame, n_docs: int, ranges: int) -> list[bytes]:
    """Words at which ranges begin, from a bounded sample."""
    if ranges < 2 or not n_docs:
        return []
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, n_docs // SAMPLE_DOCS))) == 0).limit(2 * SAMPLE_DOCS)
    first = F.slice(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")), 1, SAMPLE_WORDS)
    words = sorted({w.encode() for r in some.select(first.alias("w")).toLocalIterator() for w in r["w"] if w})
    return sorted({words[len(words) * i // ranges] for i in range(1, ranges)}) if words else []


def _border_escapes(borders: DataFrame) -> DataFrame:
    """Escape statistics (kind, a, b, n) of nodes that more ranges than one may have, from their sums."""
    symbol = F.col("b") >= 0
    by = borders.groupBy("a").agg(F.sum(F.when(~symbol, F.col("n"))).alias("types"), F.sum(F.when(symbol, F.col("n"))).alias("all"), F.count_if(symbol & (F.col("n") == 1)).alias("ones"), F.count_if(symbol & (F.col("n") > 0)).alias("distinct")).where("types > 1 AND all > 1")
    key = lambda one: F.concat_ws(",", F.least(F.length("a"), F.lit(12)).cast("string"), F.least(F.length(F.bin(F.col("all") - 1)), F.lit(24)).cast("string"), (F.col("distinct") == one).cast("int").cast("string")).cast("binary")
    row = lambda one, what, n: F.struct(key(one).alias("a"), F.lit(what).alias("b"), n.alias("n"))
    each = by.select(F.explode(F.array(row(2, 0, F.col("ones")), row(2, 1, F.col("ones")), row(1, 1, F.col("all") - F.col("ones")))).alias("r")).select("r.*").where("n > 0")
    return each.groupBy(F.lit("e").alias("kind"), "a", "b").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of docs(doc_id, text)."""
    spark = docs.sparkSession
    workers_can_import(spark)
    docs = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    first = docs.agg(F.sum(F.octet_length("text").cast("long")), F.count_if(~F.col("held_out")), F.count(F.lit(1))).first()
    size, train_docs, n_docs = first[0] or 0, first[1], first[2]
    chunks = written(docs.select("doc_id", "held_out", "text").mapInArrow(_chunk_batches, _CHUNKS), "ppm-chunks")
    cuts = spark.sparkContext.broadcast(_cuts(docs, n_docs, partitions_for(spark, size, RANGE_TEXT)))
    words = chunks.select("chunk", "words", "counts").mapInArrow(_word_batches(cuts), "range int, chunk long, first long, words binary, counts binary")
    survey = written(words.groupBy("range").applyInArrow(_survey, _SURVEY), "ppm-survey")
    sums = survey.where("kind <> 'x'").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))
    # Contexts of two bytes and escapes, through Arrow: a row object takes the driver some twenty times the memory.
    rows = sums.where("kind <> 'b'").toArrow()
    rows = list(zip(*(rows.column(c).to_pylist() for c in ("kind", "a", "b", "n"))))
    borders = sums.where("kind = 'b'").select("a", "b", "n")
    more = _border_escapes(borders).toArrow()
    rows += list(zip(*(more.column(c).to_pylist() for c in ("kind", "a", "b", "n"))))
    totals = {b: n for kind, _, b, n in rows if kind == "t"}
    model = _Model(rows, train_docs)
    tokens, types = totals.get(1, 0) + train_docs, totals.get(0, 0) + (train_docs > 0)
    borders = borders.where("b >= 0")
    root = borders.where("a = X''").select("b", "n").toArrow()  # 257 rows at most
    model.set_borders([(b"", b, n) for b, n in zip(root.column("b").to_pylist(), root.column("n").to_pylist())])
    end_lp = model.end()
    edges = survey.where("kind = 'x'").select("range", "a").join(borders, "a")
    scored = words.groupBy("range").cogroup(edges.groupBy("range")).applyInArrow(_score_range(spark.sparkContext.broadcast(model)), _BACK)
    bits = min(60, 18 + max(size, 1).bit_length())
    ranges = partitions_for(spark, size, PAIR_TEXT)
    pairs = chunks.select("chunk", "held", "lengths", "ids", "words", "totals").mapInArrow(_pair_batches(bits, ranges), "range int, chunk long, pairs binary, counts binary")
    counted = pairs.groupBy("range").applyInArrow(_pair_counts, _BACK)
    back = scored.unionByName(counted)
    summed = _sum_chunk(tokens, train_docs, end_lp, float(tokens + types + 1), bits)
    return chunks.drop("counts").groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_BACK = "chunk long, kind int, first long, x binary, c binary"


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
