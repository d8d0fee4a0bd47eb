"""corpus_pipeline.run against plain versions of its stages, on awkward documents."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, pii, quality
from test_llm import jaccard_components

COLUMNS = "doc_id long, text string, n_chars long, score double, hit_spans string, n_entities int, source string"


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    rng = random.Random(7)
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text) for r in some]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = [(i, t) for i, t in rows if t and 100 < len(t.split()) < 800][:20]
    rows += [(5000 + i, t) for i, t in long[:8]]  # exact copies
    for i, t in long[8:14]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "another"
        rows.append((6000 + i, " ".join(w)))
    rows += [(7000 + k, f"{long[14 + k][1]} {items[k][1]} and more words") for k in range(3)]
    rows += [(7200, long[15][1]), (7200, "a text of its own that shares nothing but its id with the other")]
    rows += [(7100, long[17][1] + " Mr Žukov, a.b@mail.org"), (7101, None), (7102, ""), (None, long[18][1]), rows[3], (7103, long[19][1] * 20)]
    at = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, len(t or ""), 0.5, "mine", 3, "s") for i, t in rows], COLUMNS)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, items


def test_run(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    at, rows, items = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{at}/labels.parquet"), ~quality.held_out())
    kept = [(i, t) for i, t in rows if model.score(quality.features((t or "").encode())[None])[0] >= 0.3]
    kept = list(dict.fromkeys(kept))
    first = jaccard_components([((i, n), t) for n, (i, t) in enumerate(kept) if i is not None])  # rows with one id are told apart
    kept = [(i, t) for n, (i, t) in enumerate(kept) if i is None or first[i, n][0] == i]
    kept = [(i, t) for i, t in kept if decontaminate.brute_force(t, items)[1] == 0]
    safe = {}
    for r in pii.replace_checked(spark.createDataFrame(kept, "doc_id long, text string"), corpus_pipeline.queries.PII_KEY).collect():
        safe.setdefault(r.doc_id, []).append(r.text)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, at)
    assert out.columns == [*docs.columns, "token_ids"]
    got = out.collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((i or -1) for i, _ in kept)
    for r in got:
        assert r.text in safe[r.doc_id] and (r.score, r.hit_spans, r.n_entities, r.source) == (0.5, "mine", 3, "s")
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert list(r.token_ids) == library.encode(r.text or "", add_special_tokens=False).ids
    assert not any(x in r.text for r in got if r.text for x in ("Žukov", "a.b@mail.org"))


def test_stages_on_an_empty_table(spark, tables):
    import corpus_pipeline

    at, _, _ = tables
    docs = spark.read.parquet(f"{at}/documents.parquet").where(F.lit(False))
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
