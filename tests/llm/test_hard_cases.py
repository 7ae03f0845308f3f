"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from duelframe.llm import ann, mixing, near_dedup, pieces, ppm, quality, sharding, template, token_files, warc
from duelframe.llm.common import new_path
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard int, n_words long"
LONG = " ".join(f"word{i} the" for i in range(5000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "The cat and the dog " * 8, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, LONG, "en", "a"), (4, LONG, "en", "a"), (None, "a  b\n\nc\t d", "fr", "b"), (6, "▁x é\U0001f600 \x00", "zz", "b"), (7, LONG, "en", "a")]
    return spark.createDataFrame([(*r, 1, True, 5, 9) for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_pieces(spark, docs, none):
    out = pieces.decode(pieces.encode(docs)).collect()
    assert len(out) == 8 and all(r.decoded == (r.text or "").replace("▁", " ") for r in out)
    assert pieces.digests(none).count() == 0


def test_ppm(docs, none):
    out = {r.doc_id: r for r in ppm.score_documents(docs).collect()}
    assert ppm.score_documents(docs).count() == 8
    assert out[2].n_tokens == 1 and out[3].n_tokens == 1 and out[4].score < 0
    assert ppm.score_documents(none).count() == 0


def test_token_files(spark, docs, none):
    for df, n in ((docs, 8), (none, 0)):
        path = new_path(spark, "test")
        token_files.write_token_files(df, path)
        rows = token_files.digest(spark, path).orderBy("start").collect()
        assert len(rows) == n
        assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    path = new_path(spark, "test")
    token_files.write_token_files(docs, path)
    assert {r.doc_id for r in token_files.read_tokens(spark, path, (3, 4)).collect()} == {3, 4}
    assert token_files.read_metadata(spark, path).count() == 8


def test_quality(docs, none):
    out = quality.judge(docs)
    assert out.count() == 8 and out.where("text IS NULL AND NOT kept AND base_failed").count() == 1
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(none).count() == 0


def test_template(spark):
    page = "<html><body><nav>Menu</nav><article><h1>A &amp; B</h1><p>One<br>two<p><b>Three</article><footer>end</foot"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "x", ""), (1, "http://h/1", page), (4, "http://h/2", "<p>plain <i>text</i>"), (5, "u", "<script>a<b</script><div class='sidebar'>no</div><div>yes")]
    out = template.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id, r.text) for r in out.collect())
    assert got == [(1, "A & B\nOne two\nThree"), (1, "A & B\nOne two\nThree"), (2, ""), (3, ""), (4, "plain text"), (5, "yes")]
    assert template.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_dedup(docs, none):
    rows = [(r.doc_id, r.component_id) for r in near_dedup.near_components(docs, k=4).collect()]
    assert len(rows) == 8 and rows.count((4, 4)) == 2 and (7, 4) in rows and (2, 2) in rows and (3, 3) in rows
    kept = near_dedup.drop_near(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 7").count() == 0
    assert near_dedup.near_components(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard_rows(docs.select("doc_id", "text", "source"), 3, then=("text",)).collect()
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(3)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert sharding.shard_rows(none, 8).count() == 0


def test_sharding_keeps_columns_of_any_name(spark):
    rows = [(None if i % 3 else i, "s" if i % 2 else None, i, i, i) for i in range(60)]
    out = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, source string, _part long, bucket long, u long"), 4, then=("u",))
    assert out.columns == ["doc_id", "source", "_part", "bucket", "u", "shard", "slot"]
    got = out.collect()
    assert sorted((r["_part"], r.bucket, r.u) for r in got) == [(i, i, i) for i in range(60)]
    assert [sum(r.shard == s for r in got) for s in range(4)] == [15] * 4


def test_clashing_names_and_long_words(spark):
    rows = [(1, "z" * 30_000 + " a b c d e f", "en", 1, 2, 3, 4), (2, "x" * 3000 + "▁" * 50, None, 1, 2, 3, 4), (3, None, "en", 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _text int, _words int, piece_ids int, c0 int")
    out = pieces.encode_decoded(df)
    assert out.columns == ["doc_id", "text", "lang", "_text", "_words", "c0", "piece_ids", "decoded"]
    lib = pieces.load(pieces.default_model()).lib
    assert all(list(r.piece_ids) == lib.encode(r.text or "") and r["_text"] == 1 for r in out.collect())
    assert quality.judge(df).columns[: len(df.columns)] == df.columns and quality.keep_good(df).columns == df.columns
    assert ppm.score_documents(df).count() == 3 and near_dedup.drop_near(df).columns == df.columns
    domains = spark.createDataFrame([(1, "clean"), (2, "poor")], "doc_id long, domain string")
    assert mixing.mixed(df, domains).columns == df.columns


def test_pipeline_stages(spark, none):
    import corpus_pipeline

    rows = [(None, None, None, None, 0, "x"), (1, "", "en", "a", 0, "x"), (2, "word " * 40, "en", "a", 200, "x"), (2, "word " * 40, "en", "a", 200, "x")]
    for docs in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row string"), none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            assert set(docs.columns) >= set(columns), name
        assert docs.count() >= 0 and "decoded" in docs.columns


def test_mixing(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 1), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    domains = mixing.label_domains(labels)
    assert mixing.mixed(docs, domains).columns == docs.columns
    assert mixing.mixed(none, domains).count() == 0
    assert mixing.mixed(docs, domains.limit(0)).count() == 8


def test_ann(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [(r.rank, r.vec_id, r.score) for r in ann.search(v, v.where("vec_id = 0")).orderBy("rank").collect()]
    assert out == [(1, 1, 1.0), (2, 7, 1.0), (3, 2, 0.5)]
    more = v.unionByName(spark.createDataFrame([(2, [2.0, 0.0]), (9, [1.0, 1.0, 1.0])], v.schema)).withColumn("rank", F.lit(1))
    out = [(r.query_id, r.vec_id, r.score) for r in ann.search(more, more.where("vec_id IN (0, 8)"), k=2).orderBy("query_id", "rank").collect()]
    assert out == [(0, 2, 2.0), (0, 1, 1.0), (8, 9, 6.0)]
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def test_warc(spark):
    rows = [(1, "u", "a" * 9000 + "é" * 9000), (1, "u", "a" * 9000 + "é" * 9000), (None, None, None), (5, "x y\n", ""), (7, "z", "é" * 5000), (8, "w", "é" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = new_path(spark, "test")
    warc.write_archive(pages, path)
    out = warc.read_archive(spark, path).collect()
    assert sorted((r.page_id or 0, r.record_type, len(r.payload) if r.payload is not None else -1) for r in out) == [(0, "revisit", -1), (1, "response", 27000), (1, "response", 27000), (5, "response", 0), (7, "response", 10000), (8, "revisit", -1)]
    path = new_path(spark, "test")
    warc.write_archive(pages, path, least_bytes=20_000)
    assert warc.read_archive(spark, path).where("record_type = 'revisit'").count() == 0
    path = new_path(spark, "test")
    warc.write_archive(pages.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_warc_with_damaged_records(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * (3000 if i == 4 else 3)) for i in range(6)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    import gzip

    file = next((tmp_path / "a").glob("*.gz"))
    data = gzip.decompress(file.read_bytes())
    data = data.replace(b"page 1 page 1", b"page 9 page 1").replace(b"WARC-Segment-Number: 3", b"WARC-Segment-Number: 9")
    broken = data[: data.rindex(b"page 5") - 4]  # the last record is cut short
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc.gz").write_bytes(gzip.compress(broken))
    with pytest.raises(Exception, match="digest|segments|record"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()
    got = sorted(((r.page_id if r.page_id is not None else 99, r.record_type) for r in warc.read_archive(spark, str(tmp_path / "b"), damaged=True).collect()))
    assert got == [(0, "response"), (1, "damaged"), (2, "response"), (3, "response"), (4, "damaged"), (99, "damaged")]


def test_chunked_framing_is_checked():
    assert warc.dechunked(warc.chunked(b"abc" * 5000)) == b"abc" * 5000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nab\r\n0\r\n\r\n")
