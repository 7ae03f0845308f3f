"""Token-ID files: Parquet with one row per document and its ids as a list column.

Layout: rows in ascending doc_id order, over all files in the order of their names; `ids` is
dictionary-encoded (a vocabulary of 50,000 ids fits one dictionary page, so an id costs 16 bits),
the integer columns doc_id and n_tokens are delta-encoded (data page v2), row
groups and pages have a set size, and the writer adds column and offset indexes. A reader of
metadata never touches the ids; a reader of some documents skips row groups and pages by doc_id.

Cases: null text is empty; an empty document holds the end id alone; null doc_ids sort first;
rows that share a doc_id stay separate rows, shorter texts first (and may go to several files, as many as
they fill); the string of a special token becomes that token's id, as in the library; texts and words of any length are taken whole; an empty table gives
an empty file set; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions_for, table, whole, workers_can_import

#: Bytes of text in one output file.
TEXT_PER_FILE = 48e6
ROW_GROUP = 16 << 20
PAGE = 256 << 10
#: Distinct chunks and words that a worker remembers.
REMEMBERED = 650_000
#: Words in one call of the library: few, so that its buffers stay in the processor's cache.
TOGETHER = 200
END_ID = 2

#: A space between two characters that aren't white space: no word of a byte-level BPE crosses its start.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: What re takes for white space, twice.
_DOUBLE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: Without white space, so without line feeds.
_PLAIN = re.compile(r"\S+\Z").match
_LINE = re.compile(r"\n\S+\Z").match
#: What the byte-level pre-tokenizer cuts off a word of letters before it: ASCII punctuation but for the apostrophe of contractions.
_TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Letters in every version of Unicode, after a space (left out) or a line feed.
_LETTERS = r"\A\n?[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+\z"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_loaded: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[int, int]:
    """The character of each byte in a byte-level vocabulary: itself where it is visible, else the next from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(visible)]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(others)}


class _Encoder:
    """The tokenizers library, asked once for each distinct word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        #: Texts that hold one of these are encoded whole, by a tokenizer of their own: one that looks for them in
        #: every chunk is slower.
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.lib.encode_special_tokens = True
        self.full = functools.cache(lambda: Tokenizer.from_file(path))
        #: Ids of chunks and words; where there are many, those not met since go.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        nl = self.lib.encode("\n", add_special_tokens=False).ids
        #: A lone line feed is one id, and it never merges with what stands beside it.
        self.newline = nl[0] if len(nl) == 1 else None
        #: The same model for words in the characters of its vocabulary: turning bytes into these is most of the
        #: library's work on new words, and quicker for many at once.
        self.words = None
        if self.newline is not None and self.lib.normalizer is None and self.lib.pre_tokenizer and json.loads(self.lib.pre_tokenizer.__getstate__()) == _BYTE_LEVEL:
            self.alphabet = _byte_alphabet()
            self.words = Tokenizer(self.lib.model)
            self.words.pre_tokenizer = pre_tokenizers.Split(chr(self.alphabet[10]), "isolated")

    def chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """Pieces that are encoded one by one, and how many each text has. All but a text's first follow a space, which is
        left out, or begin with a line feed."""
        whole_texts = pa.array(texts, pa.large_string())
        double = np.flatnonzero(pc.match_substring_regex(whole_texts, _DOUBLE).to_numpy(zero_copy_only=False))
        split = pc.split_pattern(pc.replace_substring(whole_texts, "\n", " \n"), " ")
        if len(double):
            at = np.arange(len(texts))
            at[double] = np.arange(len(double)) + len(texts)
            split = pa.concat_arrays([split, pa.array([_CUT.split(texts[i]) for i in double.tolist()], split.type)]).take(pa.array(at))
        return split.flatten(), np.diff(split.offsets.to_numpy())

    def together(self, lib, words: list[str], turned=lambda x: x) -> list[bytes]:
        """The ids of words without line feeds, which go to the library many at once, with line feeds between them."""
        out: list[bytes] = []
        for lo in range(0, len(words), TOGETHER):
            part = words[lo : lo + TOGETHER]
            found = np.asarray(lib.encode_batch_fast([turned("\n".join(part))], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(found == self.newline)
            if len(at) != len(part) - 1:
                out += [np.asarray(x.ids, dtype="<u4").tobytes() for x in lib.encode_batch_fast([turned(x) for x in part], add_special_tokens=False)]
                continue
            raw, start = found.tobytes(), 0
            for end in [*(at * 4).tolist(), len(raw)]:
                out.append(raw[start:end])
                start = end + 4
        return out

    def apart(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype="<u4").tobytes() for lo in range(0, len(texts), 5000) for x in self.lib.encode_batch_fast(texts[lo : lo + 5000], add_special_tokens=False)]

    def alone(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, with no space before it."""
        plain = [] if self.newline is None else [x for x in texts if _PLAIN(x)]
        ids = dict(zip(plain, self.together(self.lib, plain)))
        rest = [x for x in texts if x not in ids]
        ids.update(zip(rest, self.apart(rest)))
        return [ids[x] for x in texts]

    def in_alphabet(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.alphabet)

    def unknown(self, words: Iterable[str]) -> list[str]:
        known, before = self.known, self.before
        new = [x for x in words if x not in known]
        if before:
            known.update((x, before[x]) for x in new if x in before)
            new = [x for x in new if x not in known]
        return new

    def learn(self, new: list[str]) -> None:
        known, tails = self.known, self.tails
        feed = b"" if self.newline is None else np.asarray([self.newline], dtype="<u4").tobytes()
        if self.words is not None:
            core = pc.ascii_rtrim(pa.array(new, pa.large_string()), _TAIL)
            letters = pc.match_substring_regex(core, _LETTERS).to_numpy(zero_copy_only=False).tolist()
            cores = core.to_numpy(zero_copy_only=False).tolist()
            unknown = self.unknown({c for c, ok in zip(cores, letters) if ok})
            after_space, after_feed = [x for x in unknown if x[0] != "\n"], [x for x in unknown if x[0] == "\n"]
            known.update(zip(after_space, self.together(self.words, [" " + x for x in after_space], self.in_alphabet)))
            known.update(zip(after_feed, (feed + x for x in self.together(self.words, [x[1:] for x in after_feed], self.in_alphabet))))
            cut = [(x, c) for x, c, ok in zip(new, cores, letters) if ok and len(c) < len(x)]
            ends = list({x[len(c) :] for x, c in cut}.difference(tails))
            tails.update(zip(ends, self.together(self.lib, ends)))
            known.update((x, known[c] + tails[x[len(c) :]]) for x, c in cut)
            new = [x for x, ok in zip(new, letters) if not ok]
        plain, lines, other = [], [], []
        for x in new:
            (other if self.newline is None else plain if _PLAIN(x) else lines if _LINE(x) else other).append(x)
        known.update(zip(plain, self.together(self.lib, [" " + x for x in plain])))
        known.update(zip(lines, (feed + x for x in self.together(self.lib, [x[1:] for x in lines]))))
        known.update(zip(other, self.apart([x if x[:1] == "\n" else " " + x for x in other])))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after another, and how many each has."""
        own = {i: np.asarray(self.full().encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes() for i, x in enumerate(texts) if any(t in x for t in self.special)}
        chunks, n = self.chunks(["" if i in own else x for i, x in enumerate(texts)])
        firsts = np.cumsum(n) - n
        # The first pieces don't follow a space, so they are encoded as they are, behind the others.
        begin = chunks.take(pa.array(firsts)).to_pylist()
        first = np.zeros(len(chunks), dtype=bool)
        first[firsts] = True
        coded = pc.if_else(pa.array(first), pa.scalar(None, chunks.type), chunks).dictionary_encode()
        at = coded.indices.fill_null(0).to_numpy().astype(np.int64)
        at[firsts] = len(coded.dictionary) + np.arange(len(texts))
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() is ten times slower
        if len(self.known) + len(self.tails) > REMEMBERED // 2:
            self.before, self.known = self.known, {}
            self.tails.clear()
        self.learn(self.unknown(distinct))
        ids = [*map(self.known.__getitem__, distinct), *(own.get(i, x) for i, x in enumerate(self.alone(begin)))]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4)])
        pieces = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))).take(pa.array(at))
        upto = np.concatenate([[0], np.cumsum(n)])
        return pieces.flatten().to_numpy(), np.diff(pieces.offsets.to_numpy()[upto])


def _encoder(path: str) -> _Encoder:
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


def _encode_batches(path: str, end_id: int):
    def run(batches):
        enc = None
        for batch in batches:
            enc = enc or _encoder(path)
            texts = batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):  # blocks of bounded text
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < 4_000_000):
                    size += len(texts[hi])
                    hi += 1
                found, n = enc.encode(texts[lo:hi])
                ids = pa.array(np.insert(found, np.cumsum(n), end_id))
                offsets = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n + 1), pa.ListArray.from_arrays(pa.array(offsets), ids)], names=["doc_id", "n_tokens", "ids"])
                lo = hi

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs(doc_id, text) and write the files to `path`.

    The text is dealt by range of doc_id and sorted; each task then encodes and writes in one pass.
    """
    spark = docs.sparkSession
    workers_can_import(spark)
    docs = docs.select(F.col("doc_id").cast("long"), whole("text").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(partitions_for(spark, total, TEXT_PER_FILE), -(-total // 1_000_000)))
    # Where rows share a doc_id, their length and the part of the input that they come from cut them.
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        dealt = docs.repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id")
    else:
        docs = docs.withColumns({"size": F.octet_length("text"), "part": F.spark_partition_id()})
        dealt = docs.repartitionByRange(int(n), "doc_id", "size", "part").sortWithinPartitions("doc_id", "size", "part", "text")
    encoded = dealt.select("doc_id", "text").mapInArrow(_encode_batches(tokenizer or default_tokenizer(), end_id), "doc_id long, n_tokens long, ids array<int>")
    (
        encoded.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.block.size", str(ROW_GROUP))
        .option("parquet.page.size", str(PAGE))
        .option("parquet.page.row.count.limit", "1000")
        .option("compression", "snappy")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids; only documents in [from, to], if given: the scan skips the rest."""
    out = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    return out if doc_ids is None else out.where(F.col("doc_id").between(*doc_ids))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and start (ids of all documents before it), without reading ids.

    The running sum is in two steps, so no task sees more than one file: within a file by row
    position, and over one row for each file.
    """
    rows = _metadata(spark, path)
    return _starts(rows, rows)


def _metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long").parquet(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def _starts(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    files = metadata.groupBy("_file").agg(F.sum("n_tokens").alias("_all"))
    number = F.regexp_extract("_file", r"part-(\d+)", 1).cast("long")  # names alone misplace the hundred thousandth
    before = files.select("_file", F.coalesce(F.sum("_all").over(Window.orderBy(number, "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(before, "_file").withColumn("start", F.col("_before") + F.col("_inside")).drop("_file", "_row", "_before", "_inside")


def _crc_batches(batches):
    for batch in batches:
        ids = batch.column(0)
        values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
        at = ids.offsets.to_numpy().tolist()
        raw = memoryview(values.view(np.uint8))
        crc = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(crc, pa.int64()), pa.array([b - a for a, b in zip(at, at[1:])], pa.int64())], names=["doc_id", "_file", "_row", "ids_crc32", "n_tokens"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the ids in the files."""
    rows = spark.read.schema("doc_id long, ids array<int>").parquet(path).select("ids", "doc_id", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    read = rows.mapInArrow(_crc_batches, "doc_id long, _file string, _row long, ids_crc32 long, n_tokens long")
    return _starts(read, _metadata(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents, read them back, and return what they hold."""
    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return digest(spark, path)
