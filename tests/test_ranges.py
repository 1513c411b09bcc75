"""Range minima against brute force, and blocks cut from texts of any characters."""

import random

from strandlake.operators import arrays, rankdir


def test_range_minima(spark):
    rng = random.Random(3)
    values = {k: [float(rng.randrange(6)) for _ in range(n)] for k, n in ((1, 1), (2, 2), (3, 37), (4, 64))}
    rows = spark.createDataFrame([(k, pos, x) for k, v in values.items() for pos, x in enumerate(v)], "seq_id long, pos long, value double")
    ranges = [(k, i, j) for k, v in values.items() for i in range(len(v)) for j in range(i, len(v) + 3) if (i + j) % 3 == 0]
    asked = spark.createDataFrame([(k, q, i, j) for q, (k, i, j) in enumerate(ranges)], "seq_id long, qid long, i long, j long")
    found = {r["qid"]: (r["value"], r["pos"]) for r in arrays.range_minima(asked, rows).collect()}
    assert found == {q: min((x, at) for at, x in enumerate(values[k]) if i <= at <= j) for q, (k, i, j) in enumerate(ranges)}
    assert arrays.range_minima(asked.where("false"), rows).isEmpty()


def test_blocks_of_any_characters(spark):
    text = "a\nb\r\U0001f600 \u0085 \x00é" * 7
    found = rankdir.blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "seq_id long, text string"), 4).orderBy("blk").collect()
    assert [(r["seq_id"], r["blk"], r["content"]) for r in found] == [(1, k, text[4 * k : 4 * k + 4]) for k in range(-(-len(text) // 4))]
