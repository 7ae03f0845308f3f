"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is normalized as the model's file says (white space marked, a mark put in front), cut where
a mark follows another character, and each distinct marked word of a block of documents is encoded
once: the words are sorted, which lays them out as a trie, and traversed depth-first. Of each prefix
the forward pass keeps the best score of all segmentations, and the last piece of the best one;
these stay while the next word shares the prefix.

A segmentation of a unigram model scores the sum of its pieces' log probabilities. A BPE model's
scores are ranks of merges, which don't add up to the library's segmentation (see README); there a
segmentation scores -1 for each pair of neighbours (or first piece alone) that merging would not
leave as they are, so the best score is 0 and the best segmentation is that of the merges. Both give the library's ids.

The model's file is a parameter; nothing is trained. Words known to a worker are kept between
blocks, up to REMEMBERED bytes.

Cases: a null text is empty and has no pieces; characters that no piece has become byte pieces (or
the unknown piece, where the model has no bytes); marks that stand in a text decode as spaces, as
in the library; ids that are no pieces, and null ids, decode to nothing; a null list of ids decodes to null; texts
of any length are taken whole, and words of more than LONG characters or with runs of marks are merged pair by
pair instead (the same ids; a single word of 100,000 characters is such a word); an empty table gives no rows; columns that have the names of results are replaced, and any other names are
free for the input.
"""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, whole, workers_can_import

MARK = "▁"
#: Bytes of words and their ids that a worker remembers, about.
REMEMBERED = 160 << 20
#: Pairs of pieces of which a worker remembers whether they fit.
FITS = 400_000
LONG = 2000
#: Characters of text in a block, about.
BLOCK = 2_000_000
UNIGRAM, BPE = 1, 2
_CUT = re.compile(f"(?<=[^{MARK}])(?={MARK})")
_loaded: dict = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """The pieces of a model file, and encodings of marked words."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb2

        proto = pb2.ModelProto()
        proto.ParseFromString(data)
        spec = proto.normalizer_spec
        kinds = {p.type for p in proto.pieces}
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or not kinds <= {1, 2, 3, 6}:
            raise ValueError("models with character maps, removal of white space, marks at the end, or user-defined or unused pieces aren't supported")
        self.lib = SentencePieceProcessor(model_proto=data)
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.dummy = MARK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.score = [p.score for p in proto.pieces]
        self.text = [p.piece for p in proto.pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.unknown_score = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0
        self.crossing = any(_CUT.search(p) for p in self.ids)
        self.fits: dict[int, bool] = {}
        #: Words in two generations: a full one is set aside, and what is asked for again comes back from it.
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.size = 0
        raw = []
        for p in proto.pieces:
            raw.append(bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else p.piece.replace(MARK, " ").encode() if p.type == 1 else b" \xe2\x81\x87 " if p.type == 2 else b"")
        self.raw = raw

    # -- words

    def words(self, text: str) -> list[str]:
        """The marked words of a text: after each, all is encoded as if it stood alone."""
        if not text:
            return []
        if MARK in text or "  " in text or text[-1] == " " or self.crossing:
            marked = self.dummy + text.replace(" ", MARK)
            return [marked] if self.crossing else _CUT.split(marked)
        out = [MARK + x for x in text.split(" ")]
        if not self.dummy:
            out[0] = out[0][1:]
        return out if out[0] or self.dummy else out[1:]

    def _fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def _as_bytes(self, found: list[tuple[int, int, int]], word: str) -> bytes:
        ids: list[int] = []
        for piece, lo, hi in found:
            if piece >= 0:
                ids.append(piece)
            elif self.bytes or not ids or ids[-1] != self.unknown:  # unknowns in a row are one
                ids += self._fallback(word[lo:hi])
        return np.asarray(ids, dtype="<u4").tobytes()

    def merged(self, word: str) -> list[tuple[int, int, int]]:
        """The BPE encoding of a word by merges, best score first, leftmost of equals."""
        n = len(word)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (piece := self.ids.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (-self.score[piece], i, end[j]))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            if gone[i] or after[i] >= n or end[after[i]] != to or end[i] >= to:
                continue
            j = after[i]
            gone[j] = True
            end[i], after[i] = to, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append((self.ids.get(word[i : end[i]], -1), i, end[i]))
            i = after[i]
        return out

    def _fit(self, left: int, right: int) -> bool:
        """Whether two pieces side by side stay as they are; left -1: a piece alone."""
        key = (left + 1) * len(self.text) + right
        got = self.fits.get(key)
        if got is None:
            if len(self.fits) >= FITS:
                self.fits.clear()
            a, b = self.text[left] if left >= 0 else "", self.text[right]
            want = [left, right] if left >= 0 else [right]
            got = self.fits[key] = [x[0] for x in self.merged(a + b)] == want
        return got

    def traverse(self, words: list[str]):
        """(word, its ids as bytes, its score) for sorted distinct words, depth-first through their trie.

        Of each prefix of the current word: the best score, and the start of its last piece and that
        piece (-1: a character that no piece has)."""
        ids, longest, unigram = self.ids, self.longest, self.kind == UNIGRAM
        start, last, best = [0], [-1], [0.0]
        previous = ""
        for word in words:
            shared = 0
            for a, b in zip(previous, word):
                if a != b:
                    break
                shared += 1
            del start[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                top, piece, lo = -1e300, -1, i - 1
                for j in range(max(0, i - longest), i):
                    p = ids.get(word[j:i])
                    if p is None or best[j] <= top:
                        continue
                    score = best[j] + self.score[p] if unigram else best[j] - (not self._fit(last[j] if j else -1, p))
                    if score > top:
                        top, piece, lo = score, p, j
                        if top == 0.0 and not unigram:
                            break  # no segmentation scores more
                if word[i - 1] not in ids:
                    score = best[i - 1] + (self.unknown_score if unigram else 0.0)
                    if score > top:
                        top, piece, lo = score, -1, i - 1
                best.append(top)
                start.append(lo)
                last.append(piece)
            found, i = [], len(word)
            while i:
                found.append((last[i], start[i], i))
                i = start[i]
            yield word, self._as_bytes(found[::-1], word), best[-1]
            previous = word

    def learn(self, words: set[str]) -> dict[str, bytes]:
        # In a run of marks, merges of equal scores meet; these words, and very long ones, are merged.
        plain, odd, out = [], [], {}
        for w in words:
            (odd if self.kind == BPE and (len(w) > LONG or MARK + MARK in w) else plain).append(w)
        for w, got, score in self.traverse(sorted(plain)):
            if score < 0 and self.kind == BPE:
                odd.append(w)  # merges of equal scores: the pairs alone don't tell their order
            else:
                out[w] = got
        for w in odd:
            out[w] = self._as_bytes(self.merged(w), w)
        return out

    def recall(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words that the current generation lacks; from now on it has them."""
        if self.size > REMEMBERED // 2:
            self.known, self.aside, self.size = {}, self.known, 0
        out = {w: x for w in words if (x := self.aside.get(w)) is not None}
        out |= self.learn(words - out.keys())
        self.known |= out
        self.size += sum(len(w) + len(x) + 200 for w, x in out.items())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        return self.encode_words([self.words(x) for x in texts])

    def encode_words(self, split: list[list[str]]) -> list[bytes]:
        flat = [w for x in split for w in x]
        got = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            new = self.recall({flat[i] for i in missing})
            for i in missing:
                got[i] = new[flat[i]]
        out, lo = [], 0
        for x in split:
            out.append(b"".join(got[lo : lo + len(x)]))
            lo += len(x)
        return out

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids if i is not None and 0 <= i < len(raw)]).decode(errors="replace")
        return text[1:] if self.dummy and text[:1] == " " else text


def load(path: str) -> Model:
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = Model(f.read())
    return _loaded[path]


def _blocks(column):
    """(from, to, texts) of runs of rows with about BLOCK characters."""
    size = column.offsets if isinstance(column, pa.ListArray) else None
    n = np.diff(size.to_numpy()) if size is not None else np.asarray(pc.fill_null(pc.binary_length(column), 0))
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(n[lo:]), BLOCK)))
        yield lo, min(hi, len(n)), column.slice(lo, hi - lo).to_pylist()
        lo = hi


def _list_of(ids: list[bytes]) -> pa.ListArray:
    n = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def _encode_batches(path: str, decoded: bool):
    """Batches without their last column, the text, and with its ids and what these decode to."""

    def run(batches):
        for batch in batches:
            model = load(path)
            for lo, hi, texts in _blocks(batch.column(batch.num_columns - 1)):
                got = model.encode(texts)
                out = [c.slice(lo, hi - lo) for c in batch.columns[:-1]] + [_list_of(got)]
                if decoded:
                    out.append(pa.array([model.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in got], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(out))])

    return run


def _decode_batches(path: str):
    def run(batches):
        for batch in batches:
            model = load(path)
            for lo, hi, lists in _blocks(batch.column(batch.num_columns - 1)):
                texts = [None if x is None else model.decode(x) for x in lists]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(texts, pa.string())], names=[f"c{i}" for i in range(batch.num_columns)])

    return run


def _with(rows: DataFrame, last: Column, run, into: dict[str, T.DataType]) -> DataFrame:
    """rows with the columns `into` at the end, from batches of rows and the column `last`. In between
    columns go by place, so that no name of the input is taken."""
    workers_can_import(rows.sparkSession)
    gone = {x.lower() for x in into}
    kept = [c for c in rows.columns if c.lower() not in gone]
    placed = rows.select(*[rows[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(kept)], last.alias("x"))
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate([*placed.schema.fields[:-1], *(T.StructField(c, t) for c, t in into.items())])]
    return placed.mapInArrow(run, T.StructType(fields)).toDF(*kept, *into)


_IDS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, text: str = "text", model: str | None = None, into: str = "piece_ids") -> DataFrame:
    """docs with the ids of a text column as array<int> at the end."""
    return _with(docs, whole(docs[text]), _encode_batches(model or default_model(), False), {into: _IDS})


def decode(rows: DataFrame, ids: str = "piece_ids", model: str | None = None, into: str = "decoded") -> DataFrame:
    """rows with the text of a column of ids at the end."""
    return _with(rows, rows[ids], _decode_batches(model or default_model()), {into: T.StringType()})


def encode_decoded(docs: DataFrame, text: str = "text", model: str | None = None, into: tuple[str, str] = ("piece_ids", "decoded")) -> DataFrame:
    """docs with ids and the text that they decode to, in one pass of one worker a task."""
    return _with(docs, whole(docs[text]), _encode_batches(model or default_model(), True), {into[0]: _IDS, into[1]: T.StringType()})


def _digest_batches(path: str):
    def run(batches):
        for batch in batches:
            model = load(path)
            for lo, hi, texts in _blocks(batch.column(1)):
                split = [model.words(t) for t in texts]
                got = model.encode_words(split)
                same = [model.decode(np.frombuffer(x, dtype="<u4").tolist()) == t.replace(MARK, " ") for x, t in zip(got, texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(map(len, split)), pa.int64()), pa.array([len(x) // 4 for x in got], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_words", "n_pieces", "ids_crc32", "round_trip"])

    return run


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words (marked words), n_pieces, ids_crc32 (of the ids as little-endian 32-bit
    integers), round_trip (whether decoding gives the text back)."""
    workers_can_import(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    return rows.mapInArrow(_digest_batches(model or default_model()), "doc_id long, n_words long, n_pieces long, ids_crc32 long, round_trip boolean")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
