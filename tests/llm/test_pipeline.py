import os
import random

import corpus_pipeline
from strandlake.llm import ngrams, substrings
from strandlake.llm._work import settled, work_folder


def _prose(draw, n):
    return ". ".join(" ".join(f"{draw.choice('bdfgklmnprst')}{draw.choice('aeiou')}{draw.randrange(999)}" for _ in range(10)).capitalize() for _ in range(n // 10))


def test_planted_cases(spark, tmp_path):
    draw = random.Random(6)
    good = [_prose(draw, 120) for _ in range(60)]
    item, passage = _prose(draw, 30), _prose(draw, 60)
    docs = list(enumerate(good))
    docs += [(100, good[3]), (101, good[4].replace("e", "e", 1) + " tail"), (102, f"{good[5][:200]} {item} {_prose(draw, 60)}")]
    docs += [(200 + k, f"{_prose(draw, 80)}\n{passage}\n{_prose(draw, 80)}") for k in range(4)]
    docs += [(300 + k, " ".join(w.upper() + "!!" for w in _prose(draw, 60).split())) for k in range(30)] + [(400, ""), (401, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)] + [(300 + k, 0, 0) for k in range(25)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    seen = {}
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = settled(stage(spark, now, folder), name)
        seen[name] = now
        if name != "packing":
            assert now.columns == frame.columns
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert not ids["quality"] & set(range(300, 330)) and set(range(60)) | set(range(200, 204)) <= ids["quality"]
    assert {3, 4} <= ids["near_duplicates"] and not {100, 101} & ids["near_duplicates"]
    text = {r.doc_id: r.text for r in seen["repeated_passages"].collect()}
    marked = passage.split()[5]
    assert [i for i in range(200, 204) if marked in text[i].split()] == [200]
    assert 102 not in ids["decontamination"] and set(range(60)) <= ids["decontamination"]
    assert ids["packing"] == ids["decontamination"]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in seen["packing"].collect())


def test_scratch_tables_go_once_nothing_reads_them(spark):
    draw = random.Random(9)
    passage, texts = _prose(draw, 80), [_prose(draw, 100) for _ in range(12)]
    texts += [texts[0], texts[1] + " tail", texts[2] + "\n" + passage, texts[3] + "\n" + passage]
    docs = settled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "given")
    for make, left in ((lambda: substrings.deduplicated(docs), {"rows", "first", "starts"}), (lambda: ngrams.representatives(docs, corpus_pipeline.NEAR), {"rows", "components", "edges"})):
        before = set(os.listdir(work_folder(spark)))
        out = make()
        assert {name.split("-")[0] for name in set(os.listdir(work_folder(spark))) - before} <= left
        assert 12 <= out.count() < len(texts)
    assert docs.count() == len(texts)
