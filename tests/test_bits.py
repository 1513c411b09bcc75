"""Packed bits, trees over packed bytes, saved trees, the parts of previous factors and the command line."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake import __main__ as command
from strandlake.operators import arrays, bits, build, rankdir, symbols, tree
from strandlake.sources import store
from strandlake.types import TreeConfig

CONFIG = TreeConfig(arity=2, roots=2, max_leaf=4)


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(7)
    part = [rng.random() < 0.3 for _ in range(90)]
    return {0: part * 4 + [True], 1: [True], 2: [False] * 128, 3: [True] * 64, 4: [rng.random() < 0.02 for _ in range(400)]}


@pytest.fixture(scope="module")
def rows(spark, sequences):
    return spark.createDataFrame([(k, pos, bit) for k, v in sequences.items() for pos, bit in enumerate(v)], "seq_id long, pos long, bit boolean")


def _want(found, op, arg):
    if op.startswith("select"):
        at = [i for i, b in enumerate(found) if b == (op[-1] == "1")]
        return at[arg - 1] if 1 <= arg <= len(at) else None
    if not 0 <= arg < len(found):
        return None
    return {"access": int(found[arg]), "rank1": sum(found[:arg]), "rank0": arg - sum(found[:arg])}[op]


def test_tree_over_packed_bytes(spark, sequences, rows):
    asked = [(k, i, op, arg) for k, v in sequences.items() for op in ("access", "rank1", "rank0", "select1", "select0") for i, arg in enumerate(range(-1, len(v) + 2))]
    texts = bits.byte_texts(rows)
    found = bits.tree_answers(spark.createDataFrame(asked, "seq_id long, qid long, op string, arg long"), texts, *build.build(texts.select("seq_id", "text"), CONFIG), CONFIG.arity).collect()
    assert len(found) == len(asked)
    for r in found:
        assert r["value"] == _want(sequences[r["seq_id"]], r["op"], r["arg"]), r


def test_words(spark, sequences, rows):
    packed = bits.words(rows)
    asked = [(k, i, arg) for k, v in sequences.items() for i, arg in enumerate(range(0, len(v) + 3))]
    queries = spark.createDataFrame(asked, "seq_id long, qid long, pos long")
    for r in bits.ranks(queries, packed).collect():
        v = sequences[r["seq_id"]]
        assert (r["rank1"], r["rank0"]) == (_want(v, "rank1", r["pos"]), _want(v, "rank0", r["pos"]))
        assert r["bit"] == (v[r["pos"]] if r["pos"] < len(v) else None)
    for one in (True, False):
        for r in bits.select(queries.withColumnRenamed("pos", "j"), packed, one).collect():
            assert r["pos"] == _want(sequences[r["seq_id"]], f"select{int(one)}", r["j"])
    for r in bits.slices(queries.where("qid % 3 = 0"), packed, 63).collect():
        v = sequences[r["seq_id"]]
        want = sum(b << k for k, b in enumerate(v[r["pos"] : r["pos"] + 63]))
        assert (r["slice"] or 0) == want
    with pytest.raises(ValueError):
        bits.slices(queries, packed, 64)


def test_empty(spark, rows):
    none = rows.where("false")
    assert bits.words(none).isEmpty() and bits.space(bits.words(none)).isEmpty() and bits.byte_texts(none).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=40))
def test_previous_factors_agree(text):
    order, rank = arrays.suffix_array(arrays.code_points(text))
    lcp = arrays.lcp_array(arrays.code_points(text), order, rank)
    want = [max([k for j in range(i) for k in range(1, len(text) - i + 1) if text[j : j + k] == text[i : i + k]], default=0) for i in range(len(text))]
    for make in (arrays.lpf_array, arrays.lpf_by_neighbours, arrays.lpf_by_stack):
        length, source = make(order, lcp)
        assert length.tolist() == want
        for i, (n, at) in enumerate(zip(length.tolist(), source.tolist(), strict=True)):
            assert (at == -1) if n == 0 else (0 <= at < i and text[at : at + n] == text[i : i + n])


def test_saved_tree_and_directory(spark, tmp_path):
    text = "abracadabra" * 20
    rows = spark.createDataFrame([(1, text), (2, "")], "seq_id long, text string")
    store.save_tree(*build.build(rows, CONFIG), CONFIG.arity, str(tmp_path / "tree"))
    nodes, leaves, arity, levels = store.load_tree(spark, str(tmp_path / "tree"))
    asked = spark.range(len(text)).select(F.lit(1).cast("long").alias("seq_id"), F.col("id").alias("qid"), F.col("id").alias("pos"))
    assert arity == CONFIG.arity
    assert "".join(r["sym"] for r in tree.access(asked, nodes, leaves, arity, levels).orderBy("pos").collect()) == text
    checked = tree.verify_answers(rows, nodes, leaves, arity).collect()
    assert [tuple(r) for r in checked] == [(1, len(text), 0, 0, 0)]
    store.save_directory(rankdir.build(rows, 16), 16, str(tmp_path / "directory"))
    directory, block = store.load_directory(spark, str(tmp_path / "directory"))
    assert block == 16 and directory.agg(F.sum("cnt")).first()[0] == len(text)


def test_wrong_answers_are_counted(spark):
    rows = spark.createDataFrame([(1, "abcabcabcabcabcabc")], "seq_id long, text string")
    built = build.build(rows, CONFIG)
    other = rows.withColumn("text", F.translate("text", "a", "x"))
    assert tree.verify_answers(other, *built, CONFIG.arity).first()["wrong_access"] == 6


def test_leaf_blocks(spark):
    text = "abcdefgh" * 16
    rows = spark.createDataFrame([(1, text)], "seq_id long, text string")
    nodes, _ = build.build(rows, CONFIG)
    asked = spark.range(len(text)).select(F.lit(1).cast("long").alias("seq_id"), F.col("id").alias("qid"), F.col("id").alias("pos"))
    found = {r["pos"]: r["blk"] for r in tree.leaf_blocks(asked, nodes).collect()}
    held = nodes.where("level = 0").collect()
    for pos in range(len(text)):
        assert found[pos] == next((b["blk"] for b in held if b["start"] <= pos < b["start"] + b["block_size"]), None)
    assert None in found.values()


def test_numbers_from_bytes(spark):
    raw = bytes(np.arange(250, 257, dtype=np.uint16).astype(np.uint8))
    row = spark.createDataFrame([(bytearray(raw),), (bytearray(b"a"),)], "content binary")
    for little in (True, False):
        found = [r[0] for r in row.select(symbols.read_number(F.col("content"), 1, 5, little)).collect()]
        assert found == [int.from_bytes(raw[1:6], "little" if little else "big"), None]


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "text"
    path.write_text("the same words, " * 30)
    for more in ([], ["--bits"], ["--sources", "lpf", "--output", str(tmp_path / "kept")]):
        out = command.run(spark, command.parser().parse_args([str(path), "--verify", "--arity", "2", "--leaf", "4", *more]))
        assert out["verified"] and out["checked"] == 480
        json.dumps(out)
    assert store.load_tree(spark, str(tmp_path / "kept"))[2] == 2
