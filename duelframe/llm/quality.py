"""Quality rules by divergence from language references; DataFrame functions only.

Each document gets two histograms: characters by class, and words among the common words of its
language (all other words in one further cell). A language's references are the pooled histograms
of all its documents; `pooled`, over all documents, stands in where a language has none. They are a
table joined by language, of any size. A document is rejected where the Jensen-Shannon distance of a
histogram to its reference exceeds a limit, provided the text is long enough for the histogram to
mean something (minimum-length guards), or where
both exceed lower limits in a longer text; and by two base rules: too few words, or too large a share
of words in repeated 8-word windows.

The documents pass once for the references (histograms only) and once for the verdict, both
without a shuffle of text.

Cases: a null or empty text has no words and fails the base rule; a null language is a language of
its own; a language without a list of common words is judged by character classes alone; an empty
table gives no rows; columns that have the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, replacing, table, whole, written

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Least characters and words at which a histogram counts.
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 60
MAX_CLASS_DISTANCE = 0.325
MAX_COMMON_DISTANCE = 0.30
#: Both at once, in a text of so many words: (words, class distance, common-word distance).
MAX_BOTH = (100, 0.14, 0.24)

#: Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are with be this by as or from an at not have".split(),
    "de": "die der und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas il plus ne se ce".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o es".split(),
}
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "control", "wide")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def class_counts(text: Column) -> Column:
    """Characters of each of CLASSES, as an array; `lower` is what no other class has."""
    parts = {
        "upper": _count(text, "[A-Z]+"),
        "digit": _count(text, "[0-9]+"),
        "space": _count(text, r"[\x20\x09-\x0D]+"),
        "mark": _count(text, r"[.,;:!?'\"()\-]+"),
        "symbol": _count(text, SYMBOLS + "+"),
        "control": _count(text, r"[\x00-\x08\x0E-\x1F+/=@\\^_`\[\]{}~\x7F]+"),
        "wide": _count(text, r"[^\x00-\x7F]+"),
    }
    others = list(parts.values())
    return let(F.array(*others), lambda a: F.concat(F.array(F.length(text) - F.aggregate(a, F.lit(0), lambda x, y: x + y)), a))


def common_list(lang: Column) -> Column:
    """The common words of a language; none for others."""
    out = F.array().cast("array<string>")
    for name, words in COMMON_WORDS.items():
        out = F.when(lang == name, F.array(*[F.lit(w) for w in words])).otherwise(out)
    return out


def common_counts(words: Column, common: Column) -> Column:
    """How often each common word is among the words, in the list's order."""
    found = F.filter(F.transform(words, F.lower), lambda w: F.array_contains(common, w))
    return let(found, lambda f: F.transform(common, lambda k: F.size(f) - F.size(F.array_remove(f, k))))


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of `width` words which the text holds twice or more."""

    def of_windows(h: Column) -> Column:
        marked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            same = lambda x, i, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, i - 1) | same(x, i, i + 1)), lambda x: x["i"]))
            return let(at, lambda a: F.aggregate(a, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"]))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(marked, of_sorted))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(let(windows, of_windows))


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))


def _features(docs: DataFrame, base: bool) -> DataFrame:
    text = whole("text")
    fields = lambda w: [F.size(w).alias("n_words"), common_counts(w, common_list(F.col("lang"))).alias("common"), *([repeat_words(w).alias("n_repeat_words")] if base else [])]
    cols = {"_words": let(words_of(text), lambda w: F.struct(*fields(w))), "_classes": class_counts(text)}
    if base:
        cols |= {"_dup": dup_lines(text)}
    return replacing(docs, **cols)


def references(docs: DataFrame) -> DataFrame:
    """_lang, _ref_classes, _ref_common: pooled histograms as shares; the row `pooled` has _lang null
    and _all true."""
    f = _features(docs.select("lang", "text"), base=False).select("lang", "_words", "_classes")
    return _pool(f)


def _pool(f: DataFrame) -> DataFrame:
    most = max(map(len, COMMON_WORDS.values()))
    sums = [F.sum(F.get("_classes", F.lit(i)).cast("long")).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.coalesce(F.sum(F.get("_words.common", F.lit(i)).cast("long")), F.lit(0)).alias(f"w{i}") for i in range(most)]
    each = written(f.groupBy("lang").agg(F.sum(F.col("_words.n_words").cast("long")).alias("words"), *sums), "quality-references")
    classes = F.array(*[f"c{i}" for i in range(len(CLASSES))])
    found = F.slice(F.array(*[f"w{i}" for i in range(most)]), F.lit(1), F.coalesce(F.size(common_list(F.col("lang"))), F.lit(0)))
    common = F.when(F.size(found) > 0, let(found, lambda x: _shares(F.concat(x, F.array(F.col("words") - F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b))))))
    own = each.select(F.col("lang").alias("_lang"), F.lit(False).alias("_all"), _shares(classes).alias("_ref_classes"), common.alias("_ref_common"))
    pool = each.agg(*[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(CLASSES))])
    return own.unionByName(pool.select(F.lit(None).cast("string").alias("_lang"), F.lit(True).alias("_all"), _shares(classes).alias("_ref_classes"), F.lit(None).cast("array<double>").alias("_ref_common")))


def _shares(counts: Column) -> Column:
    n = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    return let(counts, lambda c: let(n(c), lambda total: F.transform(c, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2))


def _judged(f: DataFrame, refs: DataFrame) -> DataFrame:
    own = refs.where(~F.col("_all")).drop("_all")
    pooled = refs.where("_all").select(F.col("_ref_classes").alias("_pooled"))
    f = f.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(pooled), how="cross")
    w, chars = F.col("_words"), F.aggregate("_classes", F.lit(0), lambda x, y: x + y)
    share = lambda a, n: F.transform(a, lambda x: x / n)
    classes = let(chars, lambda n: F.when(n >= MIN_CHARS_FOR_CLASSES, js_distance(share(F.col("_classes"), n), F.coalesce("_ref_classes", "_pooled"))))
    n = w["n_words"]
    rest = n - F.aggregate(w["common"], F.lit(0), lambda x, y: x + y)
    common = F.when((n >= MIN_WORDS_FOR_COMMON) & F.col("_ref_common").isNotNull(), js_distance(share(F.concat(w["common"], F.array(rest)), n), F.col("_ref_common")))
    long = lambda c: c.cast("long")
    f = f.withColumns({
        "_n": long(n),
        "_chars": long(chars - F.get("_classes", F.lit(CLASSES.index("space")))),
        "_symbols": long(F.get("_classes", F.lit(CLASSES.index("symbol")))),
        "_dups": long(F.col("_dup")),
        "_repeats": long(w["n_repeat_words"]),
        "class_distance": classes,
        "common_distance": common,
    })
    out = f.withColumnsRenamed({"_n": "n_words", "_chars": "word_chars", "_symbols": "n_symbols", "_dups": "n_dup_lines", "_repeats": "n_repeat_words"})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    fits = F.coalesce(F.col("class_distance") <= MAX_CLASS_DISTANCE, F.lit(True)) & F.coalesce(F.col("common_distance") <= MAX_COMMON_DISTANCE, F.lit(True))
    words, by_class, by_word = MAX_BOTH
    fits = fits & ~F.coalesce((F.col("n_words") >= words) & (F.col("class_distance") > by_class) & (F.col("common_distance") > by_word), F.lit(False))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & fits).drop("_words", "_classes", "_dup", "_lang", "_ref_classes", "_ref_common", "_pooled")


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "common_distance", "base_failed", "kept")


def judge(docs: DataFrame) -> DataFrame:
    """docs(text, lang, ...) with RESULTS at the end; the text is carried, not shuffled."""
    kept = [c for c in docs.columns if c.lower() not in RESULTS]
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    return _judged(_features(inner, base=True), references(docs.select(docs["text"].alias("text"), docs["lang"].alias("lang")))).select("_row.*", *RESULTS)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns as they are. Rows and features are written once, so
    that the features need not be computed for the references and again for the verdict."""
    inner = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), docs["text"].alias("text"), docs["lang"].alias("lang"))
    f = written(_features(inner, base=True).drop("text"), "quality-features")
    return _judged(f, _pool(f)).where("kept").select("_row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features once into a written table of counts; references and verdicts from that."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    f = written(_features(docs, base=True).drop("text"), "quality-features")
    return _judged(f, _pool(f)).select("doc_id", *RESULTS[:5], "base_failed", "kept")
