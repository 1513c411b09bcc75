import random
import zlib

import pytest

from strandlake.llm import sharding


def _check(rows, found, shards=16):
    assert len(found) == len(rows)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("hot", [0, 60, 400])
def test_even_shards_and_whole_classes(spark, hot):
    draw = random.Random(3)
    texts = [f"unique {k}" for k in range(300)] + [f"class {k % 40}" for k in range(160)] + ["hot"] * hot + [None, "", "é", None]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    found = sharding.assign(df).collect()
    _check(rows, found)
    text_of = {k: t for k, t, _ in rows}
    spread = {}
    for r in found:
        spread.setdefault(text_of[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in spread.items() if (t or "").startswith("class")) <= 4
    if hot == 400:
        # A class larger than a shard fills shards, and no more of them than its rows by chance would.
        assert len(spread["hot"]) >= 400 // (len(rows) // 16 + 1)


def test_few_repeated_and_no_rows(spark):
    schema = "doc_id long, text string, slot string"
    for rows in ([], [(1, "a", "")], [(1, "a", "")] * 3 + [(None, None, "")]):
        _check(rows, sharding.assign(spark.createDataFrame(rows, schema)).collect())
