from pyspark.sql import functions as F

from strandlake.functions import registry
from strandlake.operators import direct, metrics, rankdir, symbols
from strandlake.sources import tables
from strandlake.streaming import directory
from strandlake.types import TreeConfig

TEXTS = {0: "abracadabra", 1: "aaaa", 2: "üñ🙂ü\nü", 3: "", 4: "x"}


def _docs(spark):
    return spark.createDataFrame([*TEXTS.items(), (5, None)], "seq_id long, text string")


def test_conventions(spark):
    docs = _docs(spark).where("seq_id = 0")
    r = docs.select(
        direct.access(F.col("text"), F.lit(0)).alias("first"), direct.access(F.col("text"), F.lit(11)).alias("out"), direct.access(F.col("text"), F.lit(-1)).alias("before"),
        direct.rank(F.col("text"), F.lit("a"), F.lit(0)).alias("inclusive"), direct.rank(F.col("text"), F.lit("z"), F.lit(5)).alias("absent"), direct.rank(F.col("text"), F.lit("a"), F.lit(11)).alias("outside"),
        direct.select(F.col("text"), "a", 1).alias("one"), direct.select(F.col("text"), "a", 5).alias("five"), direct.select(F.col("text"), "a", 6).alias("six"), direct.select(F.col("text"), "a", 0).alias("zero"),
    ).first()
    assert (r.first, r.out, r.before) == ("a", None, None)
    assert (r.inclusive, r.absent, r.outside) == (1, 0, None)
    assert (r.one, r.five, r.six, r.zero) == (0, 10, None, None)


def test_rank_and_select_are_inverse(spark):
    docs = _docs(spark)
    chars = tables.symbols(docs)
    assert {(r.seq_id, r.pos): r.sym for r in chars.collect()} == {(k, i): c for k, t in TEXTS.items() for i, c in enumerate(t)}
    for r in direct.prefix_ranks(chars).collect():
        assert r["rank"] == TEXTS[r.seq_id][: r.pos + 1].count(r.sym)
    for r in direct.positions(chars).collect():
        assert TEXTS[r.seq_id][: r.pos + 1].count(r.sym) == r.j and TEXTS[r.seq_id][r.pos] == r.sym


def test_directory_answers(spark):
    docs = _docs(spark)
    asked = [(k, i, c, i) for k, t in TEXTS.items() for i in range(len(t)) for c in "aü"]
    queries = spark.createDataFrame(asked, "seq_id long, qid long, sym string, pos long")
    for block in (1, 2, 4, 64):
        found = rankdir.rank(queries, rankdir.build(docs, block), docs, block).collect()
        assert len(found) == len(asked)
        for r in found:
            assert r["rank"] == TEXTS[r.seq_id][: r.pos + 1].count(r.sym)
    asked = [(k, j, c, j) for k in TEXTS for j in range(8) for c in "a"]
    queries = spark.createDataFrame(asked, "seq_id long, qid long, sym string, j long")
    for r in rankdir.select(queries, rankdir.build(docs, 3), docs, 3).collect():
        places = [i for i, c in enumerate(TEXTS[r.seq_id]) if c == r.sym]
        assert r.pos == (places[r.j - 1] if 1 <= r.j <= len(places) else None)


def test_bits(spark):
    bits = [1, 0, 0, 1, 1, 0, 1]
    df = spark.createDataFrame([(9, k, bool(b)) for k, b in enumerate(bits)], "seq_id long, pos long, bit boolean")
    for r in direct.bit_ranks(df).collect():
        assert (r.rank1, r.rank0) == (sum(bits[: r.pos]), r.pos - sum(bits[: r.pos]))
    keyed = tables.along_key(df.withColumn("k", F.col("pos") * 10), "k", F.col("bit"), block=20)
    assert {(r.pos, r.rank1) for r in direct.bit_ranks_along(keyed, 2).collect()} == {(k, sum(bits[:k])) for k in range(len(bits))}
    assert sorted((r.j, r.pos) for r in direct.bit_select_along(keyed, False, 3).collect()) == [(1, 1), (2, 2), (3, 5)]
    packed = spark.createDataFrame([(1, bytearray([5, 128])), (2, bytearray())], "id long, content binary")
    assert [r.pos for r in tables.bits_from_bytes(packed, "id", "content").where("bit").orderBy("pos").collect()] == [0, 2, 15]
    assert tables.bits_from_chars(_docs(spark), "br").where("bit and seq_id = 0").count() == 4
    assert tables.bits_from_chars(_docs(spark), "").where("bit").count() == 0


def test_alphabet_orders(spark):
    chars = tables.symbols(_docs(spark)).where("seq_id = 0")
    assert [r.sym for r in symbols.alphabet(chars).orderBy("id").collect()] == list("abrcd")
    codes = symbols.leaf_codes(chars).orderBy("code").collect()
    assert [r.sym for r in codes] == list("abcdr") and {r.width for r in codes} == {3}


def test_upserts(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("k", 3, "c")], "key string, n int, v string")
    assert symbols.keep(df, "key", "n", "v").first().v == "a" and symbols.overwrite(df, "key", "n", "v").first().v == "c"


def test_files_and_functions(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"a\nb")
    assert tables.text_files(spark, str(tmp_path)).first().text == "a\nb"
    assert bytes(tables.binary_files(spark, str(tmp_path)).first().content) == b"a\nb"
    registry.register(spark)
    r = spark.sql("select seq_access('abc', 1) a, seq_rank('abca', 'a', 3) r, seq_select('abca', 'a', 2) s, seq_select('abca', 'a', 3) n, poly_hash('ab') h").first()
    assert (r.a, r.r, r.s, r.n, r.h) == ("b", 2, 3, None, 97 * 256 + 98)
    assert [tuple(x) for x in spark.sql("select pos, byte from bytes_of('é')").collect()] == [(0, 195), (1, 169)]
    assert tables.random_text(spark, 1000, 16, 10).agg(F.min("sym"), F.max("sym")).first()[:] == (10, 25)


def test_reports(spark):
    r = metrics.build_report(spark, _docs(spark), TreeConfig()).first()
    assert r.sequences == 4 and r.blocks >= 4 and r.bytes > 0


def test_stream_grows_the_directory(spark, tmp_path):
    docs = _docs(spark)
    whole = rankdir.blocks(docs, 2)
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 2), (2, 100)):
        whole.where((F.col("blk") >= low) & (F.col("blk") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(directory.SCHEMA).parquet(source)
        directory.start(stream, folder, str(tmp_path / "check")).awaitTermination()
    want = {tuple(r) for r in rankdir.build(docs, 2).select("seq_id", "blk", "sym", "cnt", "prefix_cnt").collect()}
    assert {tuple(r) for r in directory.directory(spark, folder).select("seq_id", "blk", "sym", "cnt", "prefix_cnt").collect()} == want
    first = rankdir.build(docs.withColumn("text", F.expr("substring(text, 1, 4)")), 2)
    grown = rankdir.update(first, whole.where("blk >= 2"), 2)
    assert {tuple(r) for r in grown.select("seq_id", "blk", "sym", "cnt", "prefix_cnt").collect()} == want
