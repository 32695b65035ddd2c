import random

import corpus_pipeline
from test_operators import prose


def test_pipeline(spark, tmp_path):
    rows, labels = [], []
    r = random.Random(4)
    for i in range(120):
        w = prose(150, 1000 + i).split()
        if i % 6 == 0:
            w[10:10] = ["idiot", "moron"] * 2
        rows.append((i, " ".join(w), "en", r.choice("abc"), 0))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = prose(80, 5000)
    rows += [(500, rows[1][1], "en", "a", 0), (501, prose(150, 1) + passage, "en", "b", 0), (502, passage + prose(150, 2), "en", None, 0), (503, None, None, "a", 0), (504, "", "fr", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        kept[name] = {x.doc_id: x for x in docs.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in range(120) if i % 6}
    assert clean <= set(kept["toxicity"]) and len(set(range(0, 120, 6)) & set(kept["toxicity"])) <= 1
    assert 500 not in kept["simhash_near_duplicates"] and clean <= set(kept["simhash_near_duplicates"])
    assert passage.strip() not in kept["suffix_array_dedup"][501].text and set(kept["suffix_array_dedup"]) == set(kept["simhash_near_duplicates"])
    assert all(x.n_tokens == len(x.ids) > 0 for x in kept["bpe"].values())


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score long, size long, source_size string, target double, taken long, spans string, toxic int, _draw long, rest string, root long, key long, mark string, shard int"


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    long = " ".join(prose(2000, 70 + i) for i in range(200))
    assert len(long) > 2 << 20
    texts = [prose(150, 2000 + i) for i in range(30)] + [long, "", None, "one", prose(150, 2000)]
    own = (777, 80, "s", 0.5, 3, "x", 1, 9, "r", 5, 6, "m", 2)
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), *own) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, prose(150, 3000), None, "a", 0, *own), (None, None, "en", "b", 0, *own)]
    docs = spark.createDataFrame(rows, EXTRA).repartition(3)
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names = [x.split()[0] for x in EXTRA.split(", ")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), name)
        got = docs.collect()
        assert docs.columns == names and all(tuple(r)[5:] == own for r in got), name
        assert {(f.name, f.dataType.simpleString()) for f in docs.schema} == {(x.split()[0], {"long": "bigint"}.get(x.split()[1], x.split()[1])) for x in EXTRA.split(", ")}
        by = {r.doc_id for r in got}
        assert None in by and 30 in by and sum(r.doc_id == 2 for r in got) == (3 if name != "mixing" else sum(r.doc_id == 2 for r in got)), name
        if name == "simhash_near_duplicates":
            assert 34 not in by  # a copy
    docs = corpus_pipeline.encoding(spark, docs, str(tmp_path))
    assert max(r.n_tokens for r in docs.collect()) > 100_000
    none = spark.createDataFrame([], EXTRA)
    for name, stage in corpus_pipeline.STAGES:
        none = corpus_pipeline.stored(stage(spark, none, str(tmp_path)), name)
        assert none.count() == 0, name
