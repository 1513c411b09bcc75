"""The engine's queries by name, each with the SQL that gives the same rows where SQL can.

Every query runs over whole tables and whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import arrays, bits, blocks, build, direct, fingerprint, forest, metrics, rankdir, symbols, tree
from ..sources import store, tables
from ..types import TreeConfig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

BLOCK, DIRECTORY_BLOCK, WINDOW = 32, 512, 12
TREE = TreeConfig(arity=4, roots=4, max_leaf=8)
#: Levels of the trees of texts below arity ** 20 symbols.
MAX_LEVELS = 20


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return tables.texts(tables.table(spark, folder, "documents"), "doc_id", "text")


def _events(spark: SparkSession, folder: str, symbol: Column) -> DataFrame:
    return tables.categorical(tables.table(spark, folder, "events"), F.col("user_id"), ["ts", "event_id"], symbol)


_CHARS = "chars AS (SELECT doc_id, unnest(string_split(text, '')) AS sym, unnest(range(length(text))) AS pos FROM documents WHERE text <> '')"
#: Three positions in each document, spread by its id.
_POINTS = "points AS (SELECT doc_id, k AS qid, (doc_id * 7919 + k * 104729) % length(text) AS pos, text FROM documents, range(3) t(k) WHERE text <> '')"


def _points(docs: DataFrame) -> DataFrame:
    rows = docs.where("text != ''").withColumn("qid", F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])))
    return rows.withColumn("pos", (F.col("seq_id") * 7919 + F.col("qid") * 104729) % F.char_length("text"))


def _doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("seq_id", "doc_id")


# ---- texts


@_query("text_access", "SELECT doc_id, substr(text, 101, 1) AS sym FROM documents WHERE length(text) > 100")
def text_access(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(_docs(spark, folder).select("seq_id", direct.access(F.col("text"), F.lit(100)).alias("sym")).where("sym is not null"))


@_query("text_access_batch", f"WITH {_POINTS} SELECT doc_id, qid, pos, substr(text, pos + 1, 1) AS sym FROM points")
def text_access_batch(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(direct.answer_access(_points(docs).select("seq_id", "qid", "pos"), docs))


_RANK = "SELECT doc_id, 200 - length(replace(substr(text, 1, 200), 'e', '')) AS rank FROM documents WHERE length(text) >= 200"


def _rank(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(_docs(spark, folder).select("seq_id", direct.rank(F.col("text"), F.lit("e"), F.lit(199)).alias("rank")).where("rank is not null"))


@_query("text_rank_inclusive", _RANK)
def text_rank_inclusive(spark: SparkSession, folder: str) -> DataFrame:
    return _rank(spark, folder)


@_query("text_rank_base", _RANK)
def text_rank_base(spark: SparkSession, folder: str) -> DataFrame:
    return _rank(spark, folder)


_RANKS = "WITH {chars}, q AS (SELECT doc_id, k AS qid, 'e' AS sym, (doc_id * 7919 + k * 104729) % length(text) AS pos, text FROM documents, range(3) t(k) WHERE text <> '') SELECT doc_id, qid, sym, pos, pos + 1 - length(replace(substr(text, 1, pos + 1), 'e', '')) AS rank FROM q".replace("{chars}, ", "")


@_query("text_rank_batch", _RANKS)
def text_rank_batch(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(direct.answer_rank(_points(docs).select("seq_id", "qid", F.lit("e").alias("sym"), "pos"), docs))


@_query("text_prefix_rank_all", f"WITH {_CHARS}, r AS (SELECT doc_id, sym, pos, count(*) OVER (PARTITION BY doc_id, sym ORDER BY pos) AS rank FROM chars) SELECT doc_id, sym, count(*) AS cnt, CAST(sum(pos * rank) AS BIGINT) AS weighted FROM r GROUP BY doc_id, sym")
def text_prefix_rank_all(spark: SparkSession, folder: str) -> DataFrame:
    ranks = direct.prefix_ranks(tables.symbols(_docs(spark, folder)))
    return _doc(ranks.groupBy("seq_id", "sym").agg(F.count("*").alias("cnt"), F.sum(F.col("pos") * F.col("rank")).alias("weighted")))


_SELECT = f"WITH {_CHARS}, r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j FROM chars WHERE sym = 'e') SELECT doc_id, pos FROM r WHERE j = 10"


@_query("text_select", _SELECT)
def text_select(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(_docs(spark, folder).select("seq_id", direct.select(F.col("text"), "e", 10).alias("pos")).where("pos is not null"))


_SELECTS = f"WITH {_CHARS}, r AS (SELECT doc_id, sym, pos, row_number() OVER (PARTITION BY doc_id, sym ORDER BY pos) AS j FROM chars), q AS (SELECT doc_id, k AS qid, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'e' ELSE 'n' END AS sym, 1 + doc_id % 40 AS j FROM documents, range(3) t(k) WHERE text IS NOT NULL) SELECT q.doc_id, qid, q.sym, q.j, r.pos FROM q LEFT JOIN r USING (doc_id, sym, j)"


def _select_queries(docs: DataFrame) -> DataFrame:
    rows = docs.select("seq_id", F.posexplode(F.array(F.lit("a"), F.lit("e"), F.lit("n"))).alias("qid", "sym"))
    return rows.select("seq_id", F.col("qid").cast("long").alias("qid"), "sym", (1 + F.col("seq_id") % 40).cast("long").alias("j"))


@_query("text_select_batch", _SELECTS)
def text_select_batch(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(direct.answer_select(_select_queries(docs), docs))


@_query("text_positions_of", f"WITH {_CHARS} SELECT doc_id, sym, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS j, pos FROM chars WHERE sym = 'w'")
def text_positions_of(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(direct.positions(tables.symbols(_docs(spark, folder)).where("sym = 'w'")))


@_query("text_absent_symbol", "SELECT doc_id, length(text) - length(replace(text, '§', '')) AS rank, CAST(NULL AS BIGINT) AS first_pos FROM documents WHERE text <> '' AND strpos(text, '§') = 0")
def text_absent_symbol(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    rows = _docs(spark, folder).where("text != ''").select("seq_id", direct.rank(text, F.lit("§"), F.char_length(text) - 1).alias("rank"), direct.select(text, "§", 1).alias("first_pos"))
    return _doc(rows.where("rank = 0"))


# ---- bits

_BITS = "b AS (SELECT event_id, event_type = 'error' AS bit, row_number() OVER (ORDER BY event_id) - 1 AS pos, coalesce(sum((event_type = 'error')::INT) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM events)"


def _error_bits(spark: SparkSession, folder: str) -> DataFrame:
    return tables.along_key(tables.table(spark, folder, "events"), "event_id", F.col("event_type") == "error")


@_query("bit_access", f"WITH {_BITS} SELECT event_id, pos, bit FROM b")
def bit_access(spark: SparkSession, folder: str) -> DataFrame:
    return _error_bits(spark, folder).select(F.col("key").alias("event_id"), "pos", F.col("value").alias("bit"))


@_query("bit_rank1", f"WITH {_BITS} SELECT event_id, pos, rank1 FROM b")
def bit_rank1(spark: SparkSession, folder: str) -> DataFrame:
    return direct.bit_ranks_along(_error_bits(spark, folder)).select(F.col("key").alias("event_id"), "pos", "rank1")


@_query("bit_rank0", f"WITH {_BITS} SELECT event_id, pos, pos - rank1 AS rank0 FROM b")
def bit_rank0(spark: SparkSession, folder: str) -> DataFrame:
    return direct.bit_ranks_along(_error_bits(spark, folder)).select(F.col("key").alias("event_id"), "pos", "rank0")


@_query("bit_select1", f"WITH {_BITS} SELECT rank1 + 1 AS j, pos, event_id FROM b WHERE bit")
def bit_select1(spark: SparkSession, folder: str) -> DataFrame:
    return direct.bit_select_along(_error_bits(spark, folder), True).select("j", "pos", F.col("key").alias("event_id"))


@_query("bit_select0", f"WITH {_BITS} SELECT pos - rank1 + 1 AS j, pos, event_id FROM b WHERE NOT bit")
def bit_select0(spark: SparkSession, folder: str) -> DataFrame:
    return direct.bit_select_along(_error_bits(spark, folder), False).select("j", "pos", F.col("key").alias("event_id"))


@_query("user_bit_rank", "WITH b AS (SELECT user_id, event_type = 'error' AS bit, row_number() OVER w - 1 AS pos, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, pos, bit, rank1, pos - rank1 AS rank0 FROM b")
def user_bit_rank(spark: SparkSession, folder: str) -> DataFrame:
    bits = _events(spark, folder, F.col("event_type") == "error").withColumnRenamed("sym", "bit")
    return direct.bit_ranks(bits).withColumnRenamed("seq_id", "user_id")


@_query("user_bit_select", "WITH b AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS j, pos FROM b WHERE event_type = 'error'")
def user_bit_select(spark: SparkSession, folder: str) -> DataFrame:
    bits = _events(spark, folder, F.col("event_type") == "error").withColumnRenamed("sym", "bit")
    return direct.bit_select(bits, True).withColumnRenamed("seq_id", "user_id")


@_query("order_bit_rank", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, coalesce(sum((o_totalprice > 150000)::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM orders")
def order_bit_rank(spark: SparkSession, folder: str) -> DataFrame:
    bits = tables.along_key(tables.table(spark, folder, "orders"), "o_orderkey", F.col("o_totalprice") > 150000)
    return direct.bit_ranks_along(bits).select(F.col("key").alias("o_orderkey"), "pos", "rank1")


@_query("bits_from_chars", f"WITH {_CHARS} SELECT doc_id, count(*) FILTER (WHERE sym IN ('a', 'e', 'i', 'o', 'u')) AS ones, max(pos) FILTER (WHERE sym IN ('a', 'e', 'i', 'o', 'u')) AS last_one, count(*) AS n FROM chars GROUP BY doc_id")
def bits_from_chars(spark: SparkSession, folder: str) -> DataFrame:
    bits = tables.bits_from_chars(_docs(spark, folder), "aeiou")
    return _doc(bits.groupBy("seq_id").agg(F.count_if("bit").alias("ones"), F.max(F.when(F.col("bit"), F.col("pos"))).alias("last_one"), F.count("*").alias("n")))


@_query("bits_from_bytes", "WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h, strlen(p_name) AS n FROM part), b AS (SELECT p_partkey, i, ('0x' || substr(h, 2 * i + 1, 2))::INT AS byte FROM h, LATERAL (SELECT unnest(range(n)) AS i)) SELECT p_partkey, 8 * i + k AS pos, (byte >> k::INT) & 1 = 1 AS bit FROM b, range(8) t(k)")
def bits_from_bytes(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.table(spark, folder, "part").select("p_partkey", F.encode("p_name", "UTF-8").alias("content"))
    return tables.bits_from_bytes(parts, "p_partkey", "content").withColumnRenamed("seq_id", "p_partkey")


# ---- packed bits

_USER_BITS = "b AS (SELECT user_id, event_type = 'error' AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
_USER_RANKS = _USER_BITS + ", r AS (SELECT user_id, pos, bit, coalesce(sum(bit::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM b)"
SLICE, SAME_BITS = 48, 16


def _user_bits(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder, F.col("event_type") == "error").withColumnRenamed("sym", "bit")


def _each_bit(rows: DataFrame) -> DataFrame:
    return rows.select("seq_id", F.col("pos").alias("qid"), "pos")


@_query("packed_bit_rank", f"WITH {_USER_RANKS} SELECT user_id, pos, bit, rank1, pos - rank1 AS rank0 FROM r")
def packed_bit_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = _user_bits(spark, folder)
    return bits.ranks(_each_bit(rows), bits.words(rows)).drop("qid").withColumnRenamed("seq_id", "user_id")


@_query("packed_bit_select", f"WITH {_USER_BITS}, n AS (SELECT user_id, bit, row_number() OVER (PARTITION BY user_id, bit ORDER BY pos) AS j, pos FROM b), q AS (SELECT user_id, pos + 1 AS j, v AS bit FROM b, (VALUES (true), (false)) t(v)) SELECT q.user_id, q.bit, q.j, n.pos FROM q LEFT JOIN n USING (user_id, bit, j)")
def packed_bit_select(spark: SparkSession, folder: str) -> DataFrame:
    rows = _user_bits(spark, folder)
    packed, asked = bits.words(rows), rows.select("seq_id", F.col("pos").alias("qid"), (F.col("pos") + 1).alias("j"))
    both = [bits.select(asked, packed, one).withColumn("bit", F.lit(one)) for one in (True, False)]
    return both[0].unionByName(both[1]).drop("qid").withColumnRenamed("seq_id", "user_id")


@_query("packed_bit_slice", f"WITH {_USER_BITS} SELECT a.user_id, a.pos, sum(CASE WHEN b.bit THEN 1::HUGEINT << (b.pos - a.pos)::INT ELSE 0 END)::BIGINT AS slice FROM b a JOIN b ON a.user_id = b.user_id AND b.pos BETWEEN a.pos AND a.pos + {SLICE - 1} GROUP BY 1, 2")
def packed_bit_slice(spark: SparkSession, folder: str) -> DataFrame:
    rows = _user_bits(spark, folder)
    return bits.slices(_each_bit(rows), bits.words(rows), SLICE).drop("qid").withColumnRenamed("seq_id", "user_id")


@_query("packed_bit_equality", f"WITH {_USER_BITS}, t AS (SELECT user_id, string_agg(bit::INT::VARCHAR, '' ORDER BY pos) AS s FROM b GROUP BY 1) SELECT b.user_id, 0::BIGINT AS a, pos AS b, pos + {SAME_BITS} <= length(s) AND substr(s, 1, {SAME_BITS}) = substr(s, pos + 1, {SAME_BITS}) AS same FROM b JOIN t ON b.user_id = t.user_id")
def packed_bit_equality(spark: SparkSession, folder: str) -> DataFrame:
    rows = _user_bits(spark, folder)
    pairs = rows.select("seq_id", F.col("pos").alias("qid"), F.lit(0).cast("long").alias("a"), F.col("pos").alias("b"))
    return bits.same_bits(pairs, bits.words(rows), SAME_BITS).drop("qid").withColumnRenamed("seq_id", "user_id")


@_query("packed_bit_space", f"WITH {_USER_BITS} SELECT user_id, count(*) AS bits, sum(bit::INT)::BIGINT AS ones, 16 * ((count(*) + 63) // 64) AS bytes FROM b GROUP BY 1")
def packed_bit_space(spark: SparkSession, folder: str) -> DataFrame:
    return bits.space(bits.words(_user_bits(spark, folder))).withColumnRenamed("seq_id", "user_id")


@_query("packed_tree_bits", f"WITH {_USER_RANKS}, n AS (SELECT user_id, bit, row_number() OVER (PARTITION BY user_id, bit ORDER BY pos) AS j, pos FROM b) SELECT user_id, 'access' AS op, pos AS arg, bit::BIGINT AS value FROM r UNION ALL SELECT user_id, 'rank1', pos, rank1 FROM r UNION ALL SELECT user_id, 'rank0', pos, pos - rank1 FROM r UNION ALL SELECT b.user_id, CASE WHEN v THEN 'select1' ELSE 'select0' END, b.pos + 1, n.pos FROM b CROSS JOIN (VALUES (true), (false)) t(v) LEFT JOIN n ON n.user_id = b.user_id AND n.bit = v AND n.j = b.pos + 1")
def packed_tree_bits(spark: SparkSession, folder: str) -> DataFrame:
    rows = _user_bits(spark, folder)
    texts = bits.byte_texts(rows)
    ops = F.explode(F.array(*[F.lit(op) for op in ("access", "rank1", "rank0", "select1", "select0")]))
    asked = rows.select("seq_id", F.col("pos").alias("qid"), ops.alias("op"), "pos")
    asked = asked.select("seq_id", "qid", "op", F.when(F.col("op").startswith("select"), F.col("pos") + 1).otherwise(F.col("pos")).alias("arg"))
    found = bits.tree_answers(asked, texts, *build.build(texts.select("seq_id", "text"), TREE), TREE.arity)
    return found.select(F.col("seq_id").alias("user_id"), "op", "arg", "value")


# ---- categorical sequences


@_query("event_rank", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS sym, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rank FROM events")
def event_rank(spark: SparkSession, folder: str) -> DataFrame:
    return direct.prefix_ranks(_events(spark, folder, F.col("event_type"))).withColumnRenamed("seq_id", "user_id")


@_query("event_select", "WITH e AS (SELECT user_id, event_type AS sym, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events), r AS (SELECT user_id, sym, row_number() OVER (PARTITION BY user_id, sym ORDER BY pos) AS j, pos FROM e) SELECT * FROM r WHERE j = 3")
def event_select(spark: SparkSession, folder: str) -> DataFrame:
    return direct.positions(_events(spark, folder, F.col("event_type"))).where("j = 3").withColumnRenamed("seq_id", "user_id")


# ---- alphabets


@_query("alphabet", f"WITH {_CHARS}, a AS (SELECT doc_id, sym, min(pos) AS first_pos, count(*) AS cnt FROM chars GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) - 1 AS id FROM a")
def alphabet(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(symbols.alphabet(tables.symbols(_docs(spark, folder))))


@_query("leaf_codes", f"WITH {_CHARS}, a AS (SELECT DISTINCT doc_id, sym FROM chars) SELECT doc_id, sym, dense_rank() OVER (PARTITION BY doc_id ORDER BY sym) - 1 AS code, length(bin(count(*) OVER (PARTITION BY doc_id) - 1)) AS width FROM a")
def leaf_codes(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(symbols.leaf_codes(tables.symbols(_docs(spark, folder))))


@_query("symbol_histogram", f"WITH {_CHARS} SELECT doc_id, sym, count(*) AS cnt FROM chars GROUP BY 1, 2")
def symbol_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(symbols.histogram(tables.symbols(_docs(spark, folder))))


@_query("bit_width", "SELECT o_orderkey, length(bin(o_orderkey)) AS width FROM orders")
def bit_width(spark: SparkSession, folder: str) -> DataFrame:
    return tables.table(spark, folder, "orders").select("o_orderkey", symbols.bit_width(F.col("o_orderkey")).alias("width"))


# ---- fingerprints


def _hash_sql(modulus: int) -> str:
    byte = "list_transform(range(strlen(text)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::HUGEINT)"
    return f"WITH d AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents WHERE text <> '') SELECT doc_id, CAST(list_reduce(list_prepend(0::HUGEINT, {byte}), lambda a, x: (a * 256 + x) % {modulus}::HUGEINT) AS VARCHAR) AS hash FROM d"


@_query("poly_hash_61", _hash_sql(fingerprint.P61))
def poly_hash_61(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(_docs(spark, folder).where("text != ''").select("seq_id", fingerprint.poly_hash_column(F.col("text")).cast("string").alias("hash")))


@_query("poly_hash_107", _hash_sql(fingerprint.P107))
def poly_hash_107(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(_docs(spark, folder).where("text != ''").select("seq_id", fingerprint.poly_hash_column(F.col("text"), fingerprint.P107).cast("string").alias("hash")))


@_query("window_hashes", f"WITH w AS (SELECT doc_id, i, ('0x' || substr(hex(encode(text)), 2 * i + 1, {2 * WINDOW - 16}))::HUGEINT AS a, ('0x' || substr(hex(encode(text)), 2 * i + {2 * WINDOW - 15}, 16))::HUGEINT AS b FROM (SELECT p_partkey AS doc_id, p_name AS text FROM part WHERE strlen(p_name) >= {WINDOW}), LATERAL (SELECT unnest(range(strlen(text) - {WINDOW - 1})) AS i)) SELECT doc_id AS p_partkey, i AS pos, CAST((a * 18446744073709551616::HUGEINT + b) % {fingerprint.P61} AS BIGINT) AS hash FROM w")
def window_hashes(spark: SparkSession, folder: str) -> DataFrame:
    parts = tables.texts(tables.table(spark, folder, "part"), "p_partkey", "p_name")
    return fingerprint.window_hashes(parts, WINDOW).withColumnRenamed("seq_id", "p_partkey")


@_query("content_equality", "SELECT doc_id, 0::BIGINT AS a, doc_id % 97 AS b, 2::BIGINT AS length, substr(text, 1, 2) = substr(text, doc_id % 97 + 1, 2) AND doc_id % 97 + 2 <= length(text) AS same FROM documents WHERE text IS NOT NULL")
def content_equality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    pairs = docs.select("seq_id", F.lit(0).cast("long").alias("a"), (F.col("seq_id") % 97).alias("b"), F.lit(2).cast("long").alias("length"))
    return _doc(fingerprint.same_content(pairs, docs))


# ---- one level of blocks


@_query("level_geometry", f"WITH g AS (SELECT doc_id, length(text) AS n, (SELECT min(h) FROM range(31) t(h) WHERE {TREE.roots} * pow({TREE.arity}, h) >= length(documents.text)) AS height FROM documents WHERE text <> '') SELECT doc_id, height, pow({TREE.arity}, height)::BIGINT AS block_size, {TREE.roots} * pow({TREE.arity}, height)::BIGINT - n AS padding, 1 + greatest(0, height - 1) AS levels FROM g")
def level_geometry(spark: SparkSession, folder: str) -> DataFrame:
    shape = blocks.level_geometry(F.char_length("text").cast("long"), TREE.arity, TREE.roots, TREE.max_leaf)
    return _doc(_docs(spark, folder).where("text != ''").select("seq_id", shape.alias("g")).select("seq_id", "g.*"))


_GRID = f"g AS (SELECT doc_id, unnest(range((length(text) + {BLOCK - 1}) // {BLOCK})) AS blk, text FROM documents WHERE text <> ''), s AS (SELECT doc_id, blk, blk * {BLOCK} AS start, least({BLOCK}, length(text) - blk * {BLOCK}) AS len, text FROM g)"
_MARK = f"m AS (SELECT *, CASE WHEN start + {2 * BLOCK} <= length(text) THEN strpos(text, substr(text, start + 1, {2 * BLOCK})) - 1 < start END AS pair_marked, CASE WHEN len = {BLOCK} AND strpos(text, substr(text, start + 1, {BLOCK})) - 1 + {BLOCK} <= start THEN strpos(text, substr(text, start + 1, {BLOCK})) - 1 END AS source FROM s)"
_LEVEL = f"n AS (SELECT *, lag(pair_marked) OVER w AS left_marked, sum((len = {BLOCK})::INT) OVER (PARTITION BY doc_id) AS whole FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY blk)), l AS (SELECT doc_id, blk, start, source, coalesce(whole >= 4 AND len = {BLOCK} AND blk > 0 AND left_marked AND (blk = whole - 1 OR pair_marked) AND source IS NOT NULL, false) AS back FROM n)"
_LEVELS = f"WITH {_GRID}, {_MARK}, {_LEVEL} "


@_query("block_grid", f"WITH {_GRID} SELECT doc_id, blk, start, len FROM s")
def block_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(blocks.block_grid(_docs(spark, folder), BLOCK).select("seq_id", "blk", "start", F.col("len").cast("long").alias("len")))


@_query("pair_marking", f"WITH {_GRID}, {_MARK} SELECT doc_id, blk, start, pair_marked FROM m")
def pair_marking(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(blocks.pair_marks(_docs(spark, folder), BLOCK).select("seq_id", "blk", "start", "pair_marked"))


@_query("level_internal", _LEVELS + "SELECT doc_id, blk, NOT back AS is_internal FROM l")
def level_internal(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(blocks.level_blocks(_docs(spark, folder), BLOCK).select("seq_id", "blk", "is_internal"))


@_query("first_occurrence", _LEVELS + f"SELECT doc_id, blk, start, source // {BLOCK} AS ptr_blk, source % {BLOCK} AS ptr_off FROM l WHERE back")
def first_occurrence(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(blocks.level_blocks(_docs(spark, folder), BLOCK).where("not is_internal").drop("is_internal"))


@_query("in_degree", _LEVELS + f", t AS (SELECT doc_id, source // {BLOCK} AS blk FROM l WHERE back UNION ALL SELECT doc_id, source // {BLOCK} + 1 FROM l WHERE back AND source % {BLOCK} > 0) SELECT doc_id, blk, count(*) AS in_degree FROM t GROUP BY 1, 2")
def in_degree(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(blocks.in_degree(blocks.level_blocks(_docs(spark, folder), BLOCK)))


@_query("block_dedup", _LEVELS + f"SELECT doc_id, count(*) AS n_blocks, sum(back::INT)::BIGINT AS n_back, {BLOCK} * sum(back::INT)::BIGINT AS saved FROM l GROUP BY 1")
def block_dedup(spark: SparkSession, folder: str) -> DataFrame:
    back = (~F.col("is_internal")).cast("long")
    found = blocks.level_blocks(_docs(spark, folder), BLOCK).groupBy("seq_id").agg(F.count("*").alias("n_blocks"), F.sum(back).alias("n_back"))
    return _doc(found.withColumn("saved", F.col("n_back") * BLOCK))


@_query("pointer_check", _LEVELS + "SELECT doc_id, sum(back::INT)::BIGINT AS checked, 0::BIGINT AS invalid FROM l GROUP BY 1")
def pointer_check(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(blocks.checked_pointers(blocks.level_blocks(docs, BLOCK), docs, BLOCK))


@_query("sym_nearest_block", "WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT user_id, pos, max(CASE WHEN event_type = 'error' THEN pos END) OVER (PARTITION BY user_id ORDER BY pos) AS start FROM e")
def sym_nearest_block(spark: SparkSession, folder: str) -> DataFrame:
    rows = _events(spark, folder, F.col("event_type"))
    return blocks.nearest_start(rows, rows.where("sym = 'error'").select("seq_id", F.col("pos").alias("start"))).withColumnRenamed("seq_id", "user_id")


# ---- index arrays


@_query("suffix_array")
def suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    found = arrays.index_arrays(_docs(spark, folder)).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("weighted"))
    return _doc(found)


@_query("lcp_array")
def lcp_array(spark: SparkSession, folder: str) -> DataFrame:
    found = arrays.index_arrays(_docs(spark, folder)).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("lcp").alias("lcp_sum"), F.max("lcp").alias("lcp_max"))
    return _doc(found)


@_query("lpf_array")
def lpf_array(spark: SparkSession, folder: str) -> DataFrame:
    found = arrays.index_arrays(_docs(spark, folder)).groupBy("seq_id").agg(F.count("*").alias("n"), F.sum("lpf").alias("lpf_sum"), F.max("lpf").alias("lpf_max"), F.count("src").alias("repeats"))
    return _doc(found)


# The engine's texts are long; the same arrays on the short part names have SQL.
_SUFFIXES = "s AS (SELECT p_partkey, i, substr(p_name, i + 1) AS suf, p_name FROM part, LATERAL (SELECT unnest(range(length(p_name))) AS i))"
_SHARED = "CASE WHEN a.suf = b.suf THEN length(a.suf) ELSE (SELECT coalesce(max(k), 0) FROM range(1, 1 + least(length(a.suf), length(b.suf))) t(k) WHERE substr(a.suf, 1, k) = substr(b.suf, 1, k)) END"


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return tables.texts(tables.table(spark, folder, "part"), "p_partkey", "p_name")


@_query("name_suffix_array", f"WITH {_SUFFIXES} SELECT p_partkey, i AS pos, row_number() OVER (PARTITION BY p_partkey ORDER BY suf) - 1 AS rank FROM s")
def name_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    return arrays.index_arrays(_names(spark, folder)).select(F.col("seq_id").alias("p_partkey"), "pos", "rank")


_NAME_LPF = f"WITH {_SUFFIXES}, k AS (SELECT a.p_partkey, a.i, max({_SHARED.replace('(SELECT coalesce', '(SELECT coalesce')}) AS lpf FROM s a JOIN s b ON a.p_partkey = b.p_partkey AND b.i < a.i GROUP BY 1, 2) SELECT s.p_partkey, s.i AS pos, coalesce(lpf, 0) AS lpf FROM s LEFT JOIN k ON s.p_partkey = k.p_partkey AND s.i = k.i"


@_query("name_lpf_array", _NAME_LPF)
def name_lpf_array(spark: SparkSession, folder: str) -> DataFrame:
    return arrays.index_arrays(_names(spark, folder)).select(F.col("seq_id").alias("p_partkey"), "pos", "lpf")


@_query("name_lpf_neighbours", _NAME_LPF)
def name_lpf_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return arrays.index_arrays(_names(spark, folder), arrays.lpf_by_neighbours).select(F.col("seq_id").alias("p_partkey"), "pos", "lpf")


@_query("name_lpf_stack", _NAME_LPF)
def name_lpf_stack(spark: SparkSession, folder: str) -> DataFrame:
    return arrays.index_arrays(_names(spark, folder), arrays.lpf_by_stack).select(F.col("seq_id").alias("p_partkey"), "pos", "lpf")


@_query("lz_factors")
def lz_factors(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(arrays.lz_factors(_docs(spark, folder)))


@_query("lz_count")
def lz_count(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(arrays.lz_factors(_docs(spark, folder)).groupBy("seq_id").agg(F.count("*").alias("z")))


@_query("repeat_spans")
def repeat_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(arrays.repeat_spans(_docs(spark, folder), 64))


def _values(spark: SparkSession, folder: str) -> DataFrame:
    return tables.categorical(tables.table(spark, folder, "events"), F.col("user_id"), ["ts", "event_id"], F.col("value")).withColumnRenamed("sym", "value")


_VALUES = "v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


@_query("ansv", f"WITH {_VALUES} SELECT a.user_id, a.pos, a.value, max(CASE WHEN b.pos < a.pos THEN b.pos END) AS left_pos, min(CASE WHEN b.pos > a.pos THEN b.pos END) AS right_pos FROM v a LEFT JOIN v b ON a.user_id = b.user_id AND b.pos <> a.pos AND b.value <= a.value WHERE a.value IS NOT NULL GROUP BY 1, 2, 3")
def ansv(spark: SparkSession, folder: str) -> DataFrame:
    return arrays.nearest_smaller_values(_values(spark, folder)).withColumnRenamed("seq_id", "user_id")


@_query("range_minimum", f"WITH {_VALUES}, q AS (SELECT user_id, pos AS qid, pos // 2 AS i, pos AS j FROM v) SELECT q.user_id, qid, i, j, min(value) AS value, arg_min(pos, (value, pos)) AS pos FROM q JOIN v ON q.user_id = v.user_id AND v.pos BETWEEN i AND j GROUP BY 1, 2, 3, 4")
def range_minimum(spark: SparkSession, folder: str) -> DataFrame:
    rows = _values(spark, folder)
    asked = rows.select("seq_id", F.col("pos").alias("qid"), F.floor(F.col("pos") / 2).cast("long").alias("i"), F.col("pos").alias("j"))
    return arrays.range_minima(asked, rows).withColumnRenamed("seq_id", "user_id")


@_query("sliding_minimum", f"WITH {_VALUES} SELECT user_id, pos, min(value) OVER w AS value, arg_min(pos, (value, pos)) OVER w AS min_pos FROM v WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def sliding_minimum(spark: SparkSession, folder: str) -> DataFrame:
    return arrays.sliding_minima(_values(spark, folder), 10).withColumnRenamed("seq_id", "user_id")


# ---- rank directory


@_query("rank_directory", f"WITH {_CHARS}, c AS (SELECT doc_id, pos // {DIRECTORY_BLOCK} AS blk, sym, count(*) AS cnt FROM chars GROUP BY 1, 2, 3) SELECT *, coalesce(sum(cnt) OVER (PARTITION BY doc_id, sym ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix_cnt FROM c")
def rank_directory(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(rankdir.build(_docs(spark, folder), DIRECTORY_BLOCK))


@_query("rank_via_directory", _RANKS)
def rank_via_directory(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    asked = _points(docs).select("seq_id", "qid", F.lit("e").alias("sym"), "pos")
    return _doc(rankdir.rank(asked, rankdir.build(docs, DIRECTORY_BLOCK), docs, DIRECTORY_BLOCK))


@_query("select_via_directory", _SELECTS)
def select_via_directory(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(rankdir.select(_select_queries(docs), rankdir.build(docs, DIRECTORY_BLOCK), docs, DIRECTORY_BLOCK))


# ---- trees


@_query("tree_access", f"WITH {_POINTS} SELECT doc_id, qid, pos, substr(text, pos + 1, 1) AS sym FROM points")
def tree_access(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(forest.access(_points(docs).select("seq_id", "qid", "pos"), forest.plant(docs, TREE), TREE.arity))


@_query("tree_relational_access", f"WITH {_POINTS} SELECT doc_id, qid, pos, substr(text, pos + 1, 1) AS sym FROM points")
def tree_relational_access(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    nodes, leaves = build.build_relational(docs, 512, 4, 8)
    return _doc(tree.access(_points(docs).select("seq_id", "qid", "pos"), nodes, leaves, 4, 4))


def _tree_rank(spark: SparkSession, folder: str, config: TreeConfig) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(forest.rank(_points(docs).select("seq_id", "qid", F.lit("e").alias("sym"), "pos"), forest.plant(docs, config), config.arity))


@_query("tree_rank", _RANKS)
def tree_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _tree_rank(spark, folder, TREE)


@_query("tree_lpf_rank", _RANKS)
def tree_lpf_rank(spark: SparkSession, folder: str) -> DataFrame:
    return _tree_rank(spark, folder, TreeConfig(arity=4, roots=0, max_leaf=8, sources="lpf"))


@_query("tree_select", _SELECTS)
def tree_select(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(forest.select(_select_queries(docs), forest.plant(docs, TREE), TREE.arity))


def _bit_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One text of '0' and '1' a user."""
    bits = _events(spark, folder, F.when(F.col("event_type") == "error", "1").otherwise("0"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "sym")))
    return bits.groupBy("seq_id").agg(F.array_join(F.transform(ordered, lambda x: x["sym"]), "").alias("text"))


@_query("tree_bit_rank", "WITH b AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, coalesce(sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank1 FROM events) SELECT user_id, pos, rank1, pos - rank1 AS rank0 FROM b WHERE pos > 0")
def tree_bit_rank(spark: SparkSession, folder: str) -> DataFrame:
    texts = _bit_texts(spark, folder)
    n = F.char_length("text").cast("long")
    asked = texts.select("seq_id", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), n - 1))).alias("at"), n.alias("n")).where("at < n")
    # Bit rank leaves its position out: the text's rank at the position before.
    asked = asked.select("seq_id", F.col("at").alias("qid"), F.lit("1").alias("sym"), (F.col("at") - 1).alias("pos"))
    found = tree.rank(asked, *build.build(texts, TREE), TREE.arity)
    return found.select(F.col("seq_id").alias("user_id"), F.col("qid").alias("pos"), F.col("rank").alias("rank1"), (F.col("qid") - F.col("rank")).alias("rank0"))


@_query("tree_bit_select", "WITH b AS (SELECT user_id, event_type = 'error' AS bit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) SELECT user_id, bit, row_number() OVER (PARTITION BY user_id, bit ORDER BY pos) AS j, pos FROM b")
def tree_bit_select(spark: SparkSession, folder: str) -> DataFrame:
    texts = _bit_texts(spark, folder)
    kinds = texts.select("seq_id", "text", F.explode(F.array(F.lit("0"), F.lit("1"))).alias("sym")).withColumn("n", direct.count(F.col("text"), F.col("sym"))).where("n > 0")
    asked = kinds.select("seq_id", "sym", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("j")).withColumn("qid", F.col("j"))
    found = tree.select(asked, *build.build(texts, TREE), TREE.arity)
    return found.select(F.col("seq_id").alias("user_id"), (F.col("sym") == "1").alias("bit"), "j", "pos")


@_query("tree_verify", "SELECT doc_id, length(text) AS symbols, true AS ok FROM documents WHERE text <> ''")
def tree_verify(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(forest.verify(docs, forest.plant(docs, TREE), TREE.arity))


@_query("tree_verify_answers", "SELECT p_partkey, length(p_name) AS checked, 0::BIGINT AS wrong_access, 0::BIGINT AS wrong_rank, 0::BIGINT AS wrong_select FROM part WHERE p_name <> ''")
def tree_verify_answers(spark: SparkSession, folder: str) -> DataFrame:
    names = _names(spark, folder)
    return forest.verify_answers(names, forest.plant(names, TREE), TREE.arity).withColumnRenamed("seq_id", "p_partkey")


@_query("tree_saved_access", f"WITH {_POINTS} SELECT doc_id, qid, pos, substr(text, pos + 1, 1) AS sym FROM points")
def tree_saved_access(spark: SparkSession, folder: str) -> DataFrame:
    docs, place = _docs(spark, folder), f"{store.shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    store.save_forest(forest.plant(docs, TREE), TREE.arity, place)
    return _doc(forest.access(_points(docs).select("seq_id", "qid", "pos"), *store.load_forest(spark, place)))


@_query("tree_leaf_block", "SELECT doc_id, 3::BIGINT AS asked, 0::BIGINT AS wrong FROM documents WHERE text <> ''")
def tree_leaf_block(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    found = forest.leaf_blocks(_points(docs).select("seq_id", "qid", "pos"), forest.plant(docs, TREE), TREE.arity)
    right = F.when(F.col("blk").isNull(), F.col("skipped")).otherwise(~F.col("skipped") & F.col("pos").between(F.col("start"), F.col("start") + F.col("block_size") - 1))
    return _doc(found.groupBy("seq_id").agg(F.count("*").alias("asked"), F.sum((~right).cast("long")).alias("wrong")))


@_query("tree_decode", "SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents WHERE text <> ''")
def tree_decode(spark: SparkSession, folder: str) -> DataFrame:
    spelled = forest.decoded(forest.plant(_docs(spark, folder), TREE), TREE.arity)
    return spelled.select(F.col("seq_id").alias("doc_id"), F.char_length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@_query("tree_levels")
def tree_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _doc(metrics.level_profile(build.build(_docs(spark, folder), TREE)[0]))


@_query("space_usage")
def space_usage(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return _doc(metrics.compression_ratio(docs, forest.space_usage(forest.plant(docs, TREE), TREE.arity)))


@_query("build_report")
def build_report(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.build_report(spark, _docs(spark, folder), TREE)


# ---- upserts, shards, functions


@_query("upsert_keep", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def upsert_keep(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.keep(tables.table(spark, folder, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@_query("upsert_overwrite", "SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def upsert_overwrite(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.overwrite(tables.table(spark, folder, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@_query("upsert_custom", "SELECT o_custkey, count(*) AS n, bit_xor(o_orderkey) AS mark, arg_max(o_orderstatus, o_orderkey) AS last FROM orders GROUP BY 1")
def upsert_custom(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables.table(spark, folder, "orders")
    return symbols.upsert(orders, "o_custkey", n=F.count("*"), mark=F.bit_xor("o_orderkey"), last=F.max_by("o_orderstatus", "o_orderkey"))


@_query("byte_order", "WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS h FROM part WHERE strlen(p_name) >= 4) SELECT p_partkey, ('0x' || substr(h, 1, 8))::BIGINT AS high_first, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT AS low_first FROM h")
def byte_order(spark: SparkSession, folder: str) -> DataFrame:
    content = F.encode("p_name", "UTF-8")
    rows = tables.table(spark, folder, "part").select("p_partkey", symbols.read_number(content, 0, 4, False).alias("high_first"), symbols.read_number(content, 0, 4, True).alias("low_first"))
    return rows.where("low_first is not null")


@_query("shard_loads")
def shard_loads(spark: SparkSession, folder: str) -> DataFrame:
    return symbols.loads(tables.table(spark, folder, "orders"), "o_custkey", 16)


@_query("random_text")
def random_text(spark: SparkSession, folder: str) -> DataFrame:
    return tables.random_text(spark, 100_000).groupBy("sym").agg(F.count("*").alias("cnt"))


@_query("sql_functions", "SELECT doc_id, substr(text, 3, 1) AS sym, CASE WHEN length(text) > 9 THEN 10 - length(replace(substr(text, 1, 10), 'e', '')) END AS rank, CASE WHEN strpos(text, 'e') > 0 THEN strpos(text, 'e') - 1 END AS first_e FROM documents WHERE length(text) > 2")
def sql_functions(spark: SparkSession, folder: str) -> DataFrame:
    registry.register(spark)
    docs = tables.table(spark, folder, "documents").where("length(text) > 2")
    return docs.selectExpr("doc_id", "seq_access(text, 2) AS sym", "seq_rank(text, 'e', 9) AS rank", "seq_select(text, 'e', 1) AS first_e")


@_query("bytes_of", "SELECT p_partkey, i AS pos, ('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2))::INT AS byte FROM part, LATERAL (SELECT unnest(range(strlen(p_name))) AS i)")
def bytes_of(spark: SparkSession, folder: str) -> DataFrame:
    registry.register(spark)
    parts = tables.table(spark, folder, "part")
    return spark.sql("SELECT p_partkey, b.pos, b.byte FROM {parts}, LATERAL bytes_of(p_name) b", parts=parts)
