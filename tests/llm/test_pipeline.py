import random

import corpus_pipeline
from loomgraph.llm import mixing, toxicity

from .conftest import DOC, doc, sentence
from .test_operators import brute_dedup, brute_join


def test_each_stage_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(150):
        words = sentence(rng, rng.randint(6, 80)).split()
        if i % 5 == 0:
            words[rng.randrange(len(words))] = "foulword"
        rows.append(doc(i, " ".join(words), rng.choice("abc")))
        labels.append((i, int(i % 5 == 0)))
    rows += [doc(200 + i, rows[i][1].replace(" ", "\n"), "a") for i in range(1, 30, 2)]
    near = rows[7][1].split() + sentence(rng, 60).split()
    rows += [doc(300, " ".join(near)), doc(301, " ".join([*near, "end"])), doc(302, None), doc(303, ""), doc(301, " ".join([*near, "end"]))]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, d = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]

    network = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns
    want = sorted((r.doc_id, r.text or "") for r in docs.collect() if network.scores([r.text or ""])[0] < 0.5)
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == want
    assert not any("foulword" in t for _, t in want) and len(want) > 100

    single = stages["exact_dedup"](spark, clean, d)
    assert single.columns == docs.columns
    kept = sorted(i for (i, _, _, k, _), n in brute_dedup([(r.doc_id, r.text) for r in clean.collect()]).items() if k)
    assert sorted(r.doc_id for r in single.collect()) == kept

    apart = stages["ngram_join"](spark, single, d)
    joined = brute_join([(r.doc_id, r.text) for r in single.collect()])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i, (c, _) in joined.items() if c == i)

    mixed = stages["mixing"](spark, apart, d)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in mixing.mix(apart).collect())

    pieces = stages["packing"](spark, mixed, d)
    assert sorted(r.doc_id for r in pieces.where("start = 0").collect()) == sorted(r.doc_id for r in mixed.collect())
    run = corpus_pipeline.run(spark, d)
    assert run.columns == pieces.columns and run.count() == pieces.count()
