"""Operators on small hand-made inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import clean, cluster, enrichment, evaluation, labels, neardup, painpoints, retrieval, rice, trends
from tallyloom.sources import config, tables

TAX = config.load_taxonomy()


def test_csv_to_clean(spark, tmp_path):
    p = tmp_path / "raw.csv"
    a = "the wallet did not refund\nmy money at all"
    rows = [(1, "30 December 2024", a, "Shop"), (5, "15 November 2024", "quite a good service here", "mart"), (1, "30 December 2024", "the wallet  did not refund my money at all", "shop"), (3, "21 July 2020", "x" * 500, "shop"), (2, "21 July 2020", "bad", "shop")]
    p.write_text("rating,date,review,platform\n" + "".join(f'{r},{d},"{t}",{q}\n' for r, d, t, q in rows))
    raw = tables.read_raw(spark, str(p))
    assert dict(raw.dtypes)["rating"] == "string" and raw.where(F.contains("review", F.lit("\n"))).count() == 1
    checked = clean.contract_errors(raw, ["shop", "mart"])
    valid, bad = clean.split_valid(checked)
    assert valid.count() == 5 and bad.count() == 0
    a = clean.annotate(valid, ["%d %B %Y"])
    out = clean.build_clean(valid, ["%d %B %Y"])
    rows = out.collect()
    assert out.columns == clean.CLEAN_COLUMNS and len(rows) == 4 and len({r.review_id for r in rows}) == 4
    group = [r for r in rows if r.near_dup_group_id >= 0]
    assert [r.near_dup_group_size for r in group] == [2, 2] and sum(r.is_near_dup_representative for r in group) == 1
    assert sum(r.is_truncated for r in rows) == 1 and sum(r.in_comparable_window for r in rows) == 3
    rep = clean.cleaning_report(a, out).first()
    assert (rep.rows_in, rep.rows_out, rep.too_short, rep.near_dup_groups) == (5, 4, 1, 1) and clean.gate(out) == []
    with pytest.raises(ValueError):
        tables.read_raw(spark, str(p), ["rating", "absent"])
    assert len(tables.verify(spark, str(p), "0" * 64)) == 64
    with pytest.raises(FileNotFoundError):
        tables.verify(spark, str(tmp_path / "none.csv"), None)


def test_near_duplicates_brute_force(spark):
    import math
    from collections import Counter

    base = "the driver was late and the food was cold when it came to my door again".split()
    texts = [" ".join(base), " ".join(base), " ".join(base[:-1]), " ".join(base[:-1] + ["today"]), "nothing like the others at all", "", "a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "review_id int, review_text string").withColumn("source_row_index", F.col("review_id"))
    got = {r.review_id: (r.near_dup_group_id, r.near_dup_group_size, r.is_near_dup_representative) for r in neardup.near_duplicate_groups(df, 0.8).collect()}
    grams = [(lambda t: Counter(t + [" ".join(x) for x in zip(t, t[1:])]))([w for w in x.split() if len(w) > 1]) for x in texts]
    dfs = Counter(g for c in grams for g in c)
    n = len(texts)
    vec = []
    for c in grams:
        v = {g: (1 + math.log(k)) * (math.log((1 + n) / (1 + dfs[g])) + 1) for g, k in c.items()}
        z = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({g: x / z for g, x in v.items()})
    near = {i for i in range(n) for j in range(n) if i != j and vec[i] and sum(x * vec[j].get(g, 0) for g, x in vec[i].items()) >= 0.8}
    assert set(got) == near and {g[1] for g in got.values()} == {len(near)} and sum(g[2] for g in got.values()) == 1


def brute_components(texts, threshold):
    """Row -> least row of its component, by all pairs."""
    import math
    import re
    from collections import Counter

    cut = [re.findall(r"\b\w\w+\b", t.lower()) for t in texts]
    grams = [Counter([*t, *zip(t, t[1:], strict=False)]) for t in cut]
    dfs, n = Counter(g for c in grams for g in c), len(texts)
    vec = []
    for c in grams:
        v = {g: (1 + math.log(k)) * (math.log((1 + n) / (1 + dfs[g])) + 1) for g, k in c.items()}
        z = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({g: x / z for g, x in v.items()})
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for i in range(n):
        for j in range(i):
            if vec[i] and sum(x * vec[j].get(g, 0) for g, x in vec[i].items()) >= threshold - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
                pairs.add((j, i))
    return [find(i) for i in range(n)], pairs


def made_texts(seed, n=160):
    """Families of variants, chains that drift away from their first text, and texts that share a long common passage."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    texts, common = [], [word() for _ in range(12)]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(5, 40))]
        now = list(base)
        for k in range(12):
            v = list(base)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = word()
            now[k % len(now)] = word()
            texts += [" ".join(v), " ".join(now)]
    texts += [" ".join(common + [word() for _ in range(rng.randint(1, 12))]) for _ in range(n - len(texts) - 4)]
    texts += ["", "x", texts[0], texts[3]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "threshold", "part"), [(1, 0.8, 512), (2, 0.6, 3), (3, 0.9, 5)])
def test_vector_components_and_pairs_equal_brute_force(spark, seed, threshold, part):
    texts = made_texts(seed)
    want, pairs = brute_components(texts, threshold)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    ids, vectors = neardup.tfidf(df, "i", "t", threshold)
    vec = {r.id: r.vec for r in ids.collect()}
    comp = {r.node: r.component for r in neardup.vector_components(vectors, threshold, part).collect()}
    for i in vec:
        for j in vec:
            assert (comp.get(vec[i], vec[i]) == comp.get(vec[j], vec[j])) == (want[i] == want[j])
    named = {tuple(sorted((vec[i], vec[j]))) for i, j in pairs if vec[i] != vec[j]}
    assert {(r.u, r.v) for r in neardup.similar_vectors(vectors, threshold, part).collect()} == named


def test_a_family_is_compared_with_leaders_not_in_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(1500):
        v = list(base)
        v[rng.randrange(150)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, review_text string").withColumn("source_row_index", F.col("review_id"))
    asked, plain = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, *a: (asked.append(pairs.count()), plain(pairs, *a))[1])
    got = neardup.near_duplicate_groups(df, 0.6)
    assert got.count() == 1500 and got.select("near_dup_group_id").distinct().count() == 1
    assert sum(asked) < 20 * 1500, asked  # of 1,124,250 pairs


def test_what_near_duplicates_keep_on_disk_is_of_the_order_of_the_text(spark):
    from pathlib import Path

    from tallyloom.storage import shared_dir

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(300)) for _ in range(1000)]
    texts[7] = texts[3] + " more"
    df = spark.createDataFrame(list(enumerate(texts)), "review_id long, review_text string").withColumn("source_row_index", F.col("review_id"))
    root = Path(shared_dir(spark).removeprefix("file://"))
    before = set(root.iterdir()) if root.exists() else set()
    assert {r.review_id for r in neardup.near_duplicate_groups(df).collect()} == {3, 7}
    kept = sum(f.stat().st_size for d in set(root.iterdir()) - before for f in d.rglob("*.parquet"))
    assert kept < 2 * sum(map(len, texts)), (kept, sum(map(len, texts)))


def test_near_duplicates_of_awkward_tables(spark):
    schema = "review_id string, review_text string, source_row_index long, vec int, term int, id int"
    rows = [("a", None, 0, 1, 1, 1), ("b", "", 1, 1, 1, 1), ("c", "one word more", 2, 1, 1, 1), ("d", "One word, more!", 3, 1, 1, 1), ("e", "word " * 20000, 4, 1, 1, 1), ("f", "word", 5, 1, 1, 1)]
    got = neardup.near_duplicate_groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.review_id, r.near_dup_group_id, r.is_near_dup_representative) for r in got) == [("c", 0, False), ("d", 0, True)]
    assert neardup.near_duplicate_groups(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        neardup.vector_components(spark.createDataFrame([], schema), 0.0)


def test_keyed_store(spark, tmp_path):
    s = tables.KeyedStore(spark, str(tmp_path / "s"), "m1", "value string, other int")
    put = lambda rows, version: s.add(spark.createDataFrame(rows, "key string, value string, other int"), version)
    put([("a", "1", 1), ("b", "2", 2)], 1)
    put([("b", "3", 3)], 2)
    other = tables.KeyedStore(spark, str(tmp_path / "s"), "m2", "value string, other int")
    assert {r.key: r.value for r in s.read().collect()} == {"a": "1", "b": "3"} and other.read().count() == 0
    keys = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "key string, pos int")
    assert [r.key for r in s.missing(keys).collect()] == ["c"]
    assert [(r.key, r.value, r.other) for r in s.lookup(keys.where("pos < 3"), "pos").collect()] == [("b", "3", 3), ("a", "1", 1), ("b", "3", 3)]
    with pytest.raises(KeyError, match="1 keys.*c"):
        s.lookup(keys, "pos")
    old = s.read()
    s.compact()
    put([("a", "9", 9)], 1)  # added behind the base: it wins whatever its version
    assert {r.key: r.value for r in s.read().collect()} == {"a": "9", "b": "3"}
    assert {r.key: r.value for r in old.collect()} == {"a": "1", "b": "3"}  # a reader keeps its snapshot
    assert s.manifest()["base"] and len(s.manifest()["added"]) == 1
    s.compact()
    assert s.vacuum() == 4 and {r.key: r.value for r in s.read().collect()} == {"a": "9", "b": "3"}
    for rows, what in (([("x", None, 1)], "value"), ([("x", "1", None)], "other"), ([(None, "1", 1)], "key"), ([("x", "1", 1), ("x", "2", 1)], "twice")):
        with pytest.raises(ValueError, match=what):
            put(rows, 5)
    put([], 6)
    assert s.manifest()["number"] == 5 and s.read().count() == 2 and s.vacuum() == 0


def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    s = tables.KeyedStore(spark, str(tmp_path / "s"), "m", "value string")
    rows = lambda *keys: spark.createDataFrame([(k, k) for k in keys], "key string, value string")
    s.add(rows("a"), 1)
    dies = F.udf(lambda k: 1 / 0 if k == "c" else k)
    with pytest.raises(Exception, match="ZeroDivision"):  # within the job
        s.add(rows("b", "c").withColumn("value", dies("key")), 2)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):  # when all is written, but not published
        m.setattr(tables.KeyedStore, "_publish", killed)
        s.add(rows("b"), 3)
    assert [r.key for r in s.read().collect()] == ["a"] and [r.key for r in s.missing(rows("a", "b")).select("key").collect()] == ["b"]
    s.add(rows("b"), 4)
    assert sorted(r.key for r in s.read().collect()) == ["a", "b"]
    assert s.vacuum() >= 1 and s.read().count() == 2
    late = s.manifest()
    s.add(rows("z"), 5)
    with pytest.raises(RuntimeError, match="another writer"):
        s._publish(late, None, [])


def test_rows_are_numbered_through_files_and_splits(spark, tmp_path):
    want = []
    for f in range(3):
        lines = [f"{f}-{i}" for i in range(400)] if f != 1 else ["a\nb", 'say ""x""', ""]
        (tmp_path / f"{f}.csv").write_text("review_id,labels\n" + "".join(f'"{x}",{i}\n' for i, x in enumerate(lines)))
        want += [x.replace('""', '"') for x in lines]
    got = tables.numbered_csv(spark, str(tmp_path), ["review_id"]).orderBy("source_row_index").collect()
    assert [r.source_row_index for r in got] == list(range(len(want))) and [r.review_id for r in got] == want
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.csv").write_text("review_id,labels\n")
    assert tables.numbered_csv(spark, str(tmp_path / "none"), ["labels"]).count() == 0


def test_checksum_streams(spark, tmp_path):
    import hashlib

    data = random.Random(1).randbytes(5_000_001)
    (tmp_path / "x").write_bytes(data)
    assert tables.checksum(spark, str(tmp_path / "x"), 4096) == tables.checksum(spark, str(tmp_path / "x")) == hashlib.sha256(data).hexdigest()
    with pytest.raises(FileNotFoundError):
        tables.checksum(spark, str(tmp_path))


def test_encoder_batches_order_and_store(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    made = spark.sparkContext.accumulator(0)

    class Lengths:
        def __init__(self):
            made.add(1)

        def encode(self, texts, batch_size):
            assert len(texts) <= batch_size
            calls.add(len(texts))
            return [[len(t), 1.0, 0.0] for t in texts]

    rows = [(f"r{i}", "x" * (i % 7), 100 - i) for i in range(40)] + [("r3", "other", 500), ("n", None, 501)]
    df = spark.createDataFrame(rows, "review_id string, review_text string, pos int").coalesce(1)
    store = tables.KeyedStore(spark, str(tmp_path / "e"), "lengths", "embedding array<float>", "review_id string")
    for n in (41, 41):  # the second time all come from the store
        got = retrieval.embed_reviews(df, Lengths, "pos", store, batch_size=8).collect()
        assert calls.value == n and [r.pos for r in got] == sorted(r[2] for r in rows)
    by = {r.pos: r.embedding for r in got}
    for i, t, pos in rows:
        n = len("xxx" if i == "r3" else t or "")
        assert by[pos] == pytest.approx([n / (n * n + 1) ** 0.5, 1 / (n * n + 1) ** 0.5, 0.0], rel=1e-6)
    assert made.value <= 8
    assert [r.embedding for r in retrieval.embed_reviews(df, Lengths, "pos").collect()] == [r.embedding for r in got]

    class Short(Lengths):
        def encode(self, texts, batch_size):
            return [[1.0]] * (len(texts) - 1)

    with pytest.raises(Exception, match="the encoder's answer"):
        retrieval.encode_texts(df, Short).count()
    assert retrieval.encode_texts(df.limit(0), Lengths).count() == 0


def test_tolerant_sources(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert tables.read_table(spark, str(tmp_path / "none"), schema).count() == 0
    assert tables.read_json(tmp_path / "none.json") == {}
    tables.write_json({"a": 1}, tmp_path / "x" / "a.json")
    assert tables.read_json(tmp_path / "x" / "a.json") == {"a": 1}
    state = tables.pipeline_state([("a", str(tmp_path / "x"), "make a"), ("b", str(tmp_path / "y"), "make b"), ("c", str(tmp_path / "z"), "make b")])
    assert state == {"available": {"a": True, "b": False, "c": False}, "commands": ["make b"]}
    e = spark.createDataFrame([("a", "i", "2"), ("b", "i", ""), ("c", "i", "x"), ("d", "i", "-1")], "product_area string, issue_type string, effort_person_weeks string")
    assert [r.product_area for r in tables.usable_effort(e).collect()] == ["a"]


def test_configs(tmp_path):
    d = config.load_dataset()
    assert [p["id"] for p in d["platforms"]] == ["en", "fr", "de", "es"]
    bad = tmp_path / "t.yaml"
    text = (config.CONFIG / "taxonomy.yaml").read_text()
    for change in (("id: other", "id: contact"), ("support_area: contact", "support_area: mars"), ("domain: legal,", "domain: sea,"), ("probe: \"!!\"", "probe: \"(\"")):
        bad.write_text(text.replace(*change))
        with pytest.raises(config.ConfigError):
            config.load_taxonomy(bad)
    assert config.estimate_cost({"input_per_million": 1.0, "output_per_million": 2.0, "batch_discount": 0.5}, 1e6, 1e6, True) == 1.5


def test_payload_shapes_and_flatten(spark):
    item = {"review_id": "r1", "areas": [{"product_area": "contact", "issue_type": "leaked_email", "strength_type": None, "evidence_span": "Write  me", "confidence": 0.9}], "sentiment": "negative", "severity": None, "customer_intent": "complaint", "support_escalation": False, "overall_confidence": 0.8, "pain_point": None}
    shapes = [{"results": [item]}, [item], item, {"labels": [item]}]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)] + [(9, "nope"), (10, None)], "i int, reply string")
    p = labels.parse_replies(df)
    got = {r.i: r["items"] for r in p.collect()}
    assert [got[i][0].review_id for i in range(4)] == ["r1"] * 4 and got[9] is None and got[10] is None
    items = labels.explode_items(p.where("i = 0"), ["i"])
    texts = spark.createDataFrame([("r1", "please write me soon", "p")], "review_id string, review_text string, platform string")
    g = labels.with_grounding(items, texts)
    rev, lab = labels.flatten(g, texts.select("review_id", "platform"))
    r, x = rev.first(), lab.first()
    assert r.grounding_rate == 1.0 and r.n_areas == 1 and x.polarity == "issue" and x.platform == "p"
    assert labels.taxonomy_issues(items, TAX).count() == 0 and labels.schema_valid(items).first().schema_ok


def test_enrich_with_provider(spark):
    def provider(system, message):
        if "fail" in message:
            raise labels.ProviderError("no", 401)
        return "[]"

    m = spark.createDataFrame([("a", "x"), ("b", "fail")], "group_id string, message string")
    got = {r.group_id: (r.reply, r.error) for r in labels.enrich(m, "s", provider).collect()}
    assert got["a"] == ("[]", None) and got["b"][1].startswith("fatal")
    b = labels.Breaker(2)
    b.note(True)
    with pytest.raises(RuntimeError):
        b.note(True)
    assert labels.system_prompt(TAX) == labels.system_prompt(TAX) and "contact" in json.dumps(labels.response_schema(TAX))


def test_chunk_and_messages(spark):
    df = spark.createDataFrame([(f"r{i}", f"t{i}") for i in range(23)], "review_id string, review_text string")
    c = labels.chunk(df, 5)
    assert c.groupBy("group_id").count().agg(F.max("count")).first()[0] <= 5
    assert "Window" not in c._jdf.queryExecution().executedPlan().toString()
    many = spark.range(20_000).select(F.col("id").cast("string").alias("review_id")).repartition(40)
    sizes = [r["count"] for r in labels.chunk(many, 7).groupBy("group_id").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) == 7 and sum(n < 7 for n in sizes) <= 8  # only the last of a partition is smaller
    assert labels.chunk(many.limit(0), 7).count() == 0
    assert sum(len(r.ids) for r in labels.user_messages(c).collect()) == 23


def test_kappa_and_rates(spark):
    k = lambda rows: evaluation.score_categorical(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    r = k([("x", "x")] * 78 + [("y", "x")] * 22)
    assert r.accuracy == 0.78 and r.lift == pytest.approx(0) and r.kappa == pytest.approx(0)
    assert k([("x", "x")] * 5).kappa is None


def test_multilabel(spark):
    s = lambda d: spark.createDataFrame(d, "review_id string, labels array<string>")
    r = evaluation.score_multilabel(s([("1", ["x", "y"]), ("2", []), ("3", ["x"])]), s([("1", ["x", "z"]), ("2", []), ("4", ["x"])])).first()
    assert (r.tp, r.fp, r.fn, r.exact, r.shared, r.reference_only, r.candidate_only) == (1, 1, 1, 1, 2, 1, 1)
    assert r.mean_jaccard == pytest.approx((1 / 3 + 1) / 2)


def test_faults_are_caught(spark):
    r = spark.createDataFrame([(f"r{i}", "license text with a token = here and there, all rights reserved by us", 1 + i % 5) for i in range(40)], "review_id string, review_text string, rating int")
    study = {x.fault: x for x in evaluation.fault_study(labels.rule_labeller(r, TAX), r, TAX, 20).collect()}
    assert len(study) == 11
    for name, x in study.items():
        assert x.attempted + x.inapplicable == 20
        if x.attempted:
            assert x.capture_rate == 1.0 and x.attributed == x.attempted, name


def test_gold(spark):
    fields = ", ".join(f"{f} string" for f in ("review_id", "labels", "sentiment", "severity", "customer_intent", "support_escalation"))
    rows = [("a", "contact/leaked_email; tables/+tidy_table", "positive", "", "praise", "yes"), ("b", "", "", "", "", ""), ("c", "contact/all_caps", "odd", "", "", "maybe"), ("a", "secrets/leaked_token", "", "", "", "")]
    g = {r.review_id: r for r in evaluation.load_gold(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no int, " + fields), TAX).collect()}
    assert len(g) == 3 and not g["b"].labelled and "duplicate_review_id" in g["a"].issues and g["a"].support_escalation is True
    assert set(g["c"].issues) == {"unknown_issue:contact", "invalid_sentiment", "invalid_support_escalation"} and g["c"].sentiment is None
    gold = evaluation.load_gold(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_no int, " + fields), TAX)
    assert {r.review_id: r.labels for r in evaluation.gold_sets(gold).collect()} == {"a": ["contact", "tables"], "c": ["contact"]}
    assert {r.review_id: r.labels for r in evaluation.gold_sets(gold, strict=True).collect()} == {"a": ["contact", "tables"], "c": []}
    assert "`contact`" in evaluation.annotation_guide(TAX)


def test_volume_counts_once_and_trend_guard(spark):
    lab = spark.createDataFrame([(f"r{i}", 0, "a", "i", None, "issue", 0.5, "q", "p", f"2024-{1 + i % 4:02d}", True) for i in range(20)] * 2, "review_id string, label_no int, product_area string, issue_type string, strength_type string, polarity string, confidence double, evidence_span string, platform string, year_month string, in_comparable_window boolean")
    rev = spark.createDataFrame([(f"r{i}", "high", True, "complaint", "negative") for i in range(20)], "review_id string, severity string, support_escalation boolean, customer_intent string, sentiment string")
    p = painpoints.pain_points(lab, rev, 5).first()
    assert p.volume == 20 and p.rank == 1 and p.mean_severity == 3.0 and p.score == pytest.approx(0.25)
    assert painpoints.trend(lab) is None
    assert painpoints.packed_evidence(painpoints.evidence(lab)).first().evidence_review_ids[0] == "r0"
    assert trends.month_over_month(rev.withColumns({"platform": F.lit("p"), "year_month": F.lit("2024-01"), "in_comparable_window": F.lit(True)})) is None


def test_search_rules(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], "b"), (2, [0.0, 0.0, 1.0], "a"), (3, [-1.0, 0.0, 0.0], "b")], "vec_id int, embedding array<double>, label string")
    hits = retrieval.search(v, [1.0, 0, 0], 2, F.col("label") == "b").collect()
    assert [h.vec_id for h in hits] == [1, 3] and not hits[0].truncated
    assert retrieval.search(v, [1.0, 0, 0], 3, F.col("label") == "b").first().truncated
    assert retrieval.candidates(8) == 96 and retrieval.candidates(1000) == 2000
    with pytest.raises(ValueError):
        retrieval.search(v, [], 2)
    e = spark.createDataFrame([("x", "hello there")], "i string, t string").select(retrieval.hashing_vector(F.col("t"), 8).alias("v")).first().v
    assert sum(x * x for x in e) == pytest.approx(1)


def test_root_cause_loop():
    asked = []

    def search(k):
        asked.append(k)
        return [{"review_id": str(i)} for i in range(k)]

    propose = lambda found: [{"supporting_review_ids": ["9"], "disconfirming_evidence": "x"}]
    out = rice.root_cause_loop(search, propose)
    assert asked == [8, 12] and out["attempts"] == 2 and len(out["hypotheses"]) == 1 and out["issues"] == ["invented_citation"]


def test_streaming(spark, sf, tmp_path):
    import shutil

    from tallyloom.streaming import events

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in")
    seen = []
    q = events.upsert(events.windowed(events.read_events(spark, str(tmp_path / "in"))), lambda d, i: seen.append(d.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert not q.isActive and q.exception() is None


def test_guardrails_name_another_metric_for_each_metric(spark):
    from tallyloom.operators import rice

    opportunities = spark.createDataFrame([(m, m) for m in rice.MEASURABLE], "title string, primary_metric string")
    baselines = spark.createDataFrame([(m, 0.2) for m in rice.MEASURABLE], "metric string, baseline double")
    got = {r.primary_metric: r.guardrail_metric for r in rice.experiment_plans(opportunities, baselines, 5000.0).collect()}
    assert got == {m: "praise_share" if m == "negative_share" else "negative_share" for m in rice.MEASURABLE}


def test_the_taxonomy_states_the_fallback_threshold(spark):
    from dataclasses import replace

    from tallyloom.operators import evaluation
    from tallyloom.sources.config import load_taxonomy

    tax = load_taxonomy()
    labels = spark.createDataFrame([(i, tax.fallback if i < 3 else next(iter(tax.areas)), None, None) for i in range(20)], "review_id int, product_area string, issue_type string, strength_type string")
    reviews = spark.range(20).selectExpr("cast(id as int) as review_id", "1.0D as grounding_rate")
    for rule, want in (("over 10% of reviews", True), ("above 20 % or so", False), ("", True)):
        assert evaluation.integrity_audit(labels, reviews, replace(tax, rule=rule)).first().breached == want


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from tallyloom import storage

    unset = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://x:7077", getConf=lambda: unset, applicationId="a"))
    with pytest.raises(ValueError):
        storage.shared_dir(cluster)


@pytest.fixture
def reply_of():
    def reply(message, leave=(), wrong=()):
        """The offline provider's reply without some reviews, and with some ids changed. (Nested, so that workers get it by value.)"""
        got = json.loads(enrichment.OfflineProvider(TAX)("", message))["results"]
        return json.dumps({"results": [x | {"review_id": x["review_id"] + "!"} if x["review_id"] in wrong else x for x in got if x["review_id"] not in leave]})

    return reply


def corpus(spark, n):
    return spark.createDataFrame([(f"r{i:02d}", f"license number {i}, all rights reserved") for i in range(n)], "review_id string, review_text string")


def test_enrich_corpus_retries_and_store(spark, tmp_path, reply_of):
    def provider(system, message):
        many = message.count("<review id") > 1
        return reply_of(message, leave=("r03",) if many else (), wrong=("r05",) if many else ())

    reviews = corpus(spark, 23)
    store = tables.KeyedStore(spark, str(tmp_path / "s"), "m", enrichment.STORED, enrichment.STORED_KEY)
    got = enrichment.enrich_corpus(reviews, "s", TAX, provider, store, size=23, concurrency=1, save_every=1)
    assert {r.review_id for r in got.items.collect()} == {f"r{i:02d}" for i in range(23)} and got.items.count() == 23
    assert got.failed.count() == 0 and got.cache_hits == 0 and got.requests == 3
    assert [(r.review_id, r.kind) for r in got.issues.collect()] == [("r05!", "unexpected_review_id")]
    assert got.items.where("grounding_rate < 1").count() == 0

    def never(system, message):
        raise AssertionError("asked again")

    again = enrichment.enrich_corpus(reviews.withColumn("review_text", F.lit("nothing")), "s", TAX, never, store)
    assert again.cache_hits == 23 and again.requests == 0 and again.items.where("grounding_rate = 0").count() == 23
    fresh = enrichment.enrich_corpus(reviews, "s", TAX, never, store, read_through=False, retry_missing=False)
    assert fresh.cache_hits == 0 and fresh.failed.count() == 23 and {r.kind for r in fresh.issues.collect()} == {"api_error"}
    assert enrichment.enrich_corpus(corpus(spark, 0), "s", TAX, never).items.count() == 0


def test_a_run_that_dies_keeps_what_its_waves_have_stored(spark, tmp_path, reply_of):
    seen = tmp_path / "seen"

    def provider(system, message):
        with open(seen, "a") as f:
            f.write("x")
        if seen.stat().st_size > 8:
            import os

            os._exit(1)  # the worker dies, and so does the job
        return reply_of(message)

    store = tables.KeyedStore(spark, str(tmp_path / "s"), "m", enrichment.STORED, enrichment.STORED_KEY)
    with pytest.raises(Exception, match="."):
        enrichment.enrich_corpus(corpus(spark, 30), "s", TAX, provider, store, size=2, concurrency=1, save_every=4)
    kept = store.read().count()
    assert 2 <= kept <= 16
    asked = spark.sparkContext.accumulator(0)

    def goes_on(system, message):
        asked.add(message.count("<review id"))
        return reply_of(message)

    got = enrichment.enrich_corpus(corpus(spark, 30), "s", TAX, goes_on, store, size=2, concurrency=1, save_every=4)
    assert got.cache_hits == kept and got.items.count() == 30 and asked.value == 30 - kept


def test_enrich_corpus_breaker(spark, tmp_path, reply_of):
    def provider(system, message):
        if "r00" in message:
            return reply_of(message)
        raise RuntimeError("HTTP 402 no credit")

    store = tables.KeyedStore(spark, str(tmp_path / "s"), "m", enrichment.STORED, enrichment.STORED_KEY)
    with pytest.raises(enrichment.RunAborted, match="402"):
        enrichment.enrich_corpus(corpus(spark, 30), "s", TAX, provider, store, size=1, concurrency=1, limit=5)
    assert store.read().count() <= 1
    error = labels.classify_error
    assert error(RuntimeError("status 503")).retryable and not error(RuntimeError("status 404")).retryable and error(ValueError("no")).retryable


def test_check_replies(spark):
    asked = spark.createDataFrame([("g1", "a", "license"), ("g1", "b", "x"), ("g2", "c", "y"), ("g3", "d", "z")], "group_id string, review_id string, review_text string")
    item = {"review_id": "a", "areas": [], "sentiment": "neutral", "customer_intent": "complaint", "support_escalation": False, "overall_confidence": 0.5}
    one = json.dumps([item, item, item | {"review_id": "q", "sentiment": "odd"}, item | {"review_id": "b", "sentiment": "odd"}])
    bad = json.dumps([item | {"review_id": "c", "overall_confidence": 2.0}])
    replies = [("g1", one, None), ("g2", bad, None), ("g3", None, "batch: errored: x"), ("g9", one, None)]
    got = enrichment.check_replies(spark.createDataFrame(replies, "group_id string, reply string, error string"), asked, TAX)
    assert sorted(r.review_id for r in got.items.collect()) == ["a", "b"] and sorted(r.review_id for r in got.failed.collect()) == ["c", "d"]
    assert sorted((r.review_id, r.kind) for r in got.issues.collect()) == [("<group>", "batch_failure"), ("<group>", "unknown_group"), ("<group>", "unparseable_response"), ("a", "duplicate_review_id"), ("b", "invalid_attribute"), ("q", "unexpected_review_id")]


def test_batch(spark, tmp_path, reply_of):
    class Client:
        polls, batches, lost = 0, 0, 1

        def submit(self, requests, system):
            lines = [(r.group_id, "succeeded", reply_of(r.message), None) for r in spark.read.json(requests).collect()]
            lines = [(g, "expired", None, None) if n < self.lost else (g, *rest) for n, (g, *rest) in enumerate(lines)]
            self.batches += 1
            spark.createDataFrame(lines, "group_id string, outcome string, reply string, detail string").write.json(str(tmp_path / f"b{self.batches}"))
            return f"b{self.batches}"

        def status(self, batch_id):
            self.polls += 1
            return "ended" if self.polls > 2 else "running"

        def results(self, batch_id):
            return str(tmp_path / batch_id)

    client, seen = Client(), []
    b = enrichment.submit_batch(corpus(spark, 12), "s", client, str(tmp_path / "in"), size=3)
    assert enrichment.poll_batch(client, b, interval=0, on_poll=seen.append) == "ended" and seen == ["running"] * 2
    got = enrichment.collect_batch(spark, client, b, str(tmp_path / "in"), TAX)
    assert got.items.count() == 9 and got.failed.count() == 3 and [r.kind for r in got.issues.collect()] == ["batch_failure"]
    client.lost = 0
    again = enrichment.resubmit_failed(got, "s", client, str(tmp_path / "in"), str(tmp_path / "in2"))
    rest = enrichment.collect_batch(spark, client, again, str(tmp_path / "in2"), TAX)
    ids = lambda df: {r.review_id for r in df.select("review_id").collect()}
    assert ids(rest.items) == ids(got.failed) and not ids(rest.items) & ids(got.items) and rest.failed.count() == 0
    assert spark.read.json(str(tmp_path / "in2" / "requests")).count() == 3
    assert enrichment.resubmit_failed(rest, "s", client, str(tmp_path / "in2"), str(tmp_path / "in3")) is None and client.batches == 2
    client.polls = -99
    with pytest.raises(TimeoutError):
        enrichment.poll_batch(client, b, interval=0, timeout=-1)


def test_model_cache(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"h1": {"review_id": "a", "sentiment": "negative"}, "h2": {"review_id": "a", "sentiment": "positive"}, "h3": {"sentiment": "x"}}))
    assert [(r.review_id, r.sentiment) for r in enrichment.load_model_cache(spark, str(p)).collect()] == [("a", "positive")]
    p.write_text("{broken")
    assert enrichment.load_model_cache(spark, str(p)).count() == 0 and enrichment.load_model_cache(spark, str(tmp_path / "none")).count() == 0


def test_gold_scores_of_pairs_and_fields(spark, tmp_path):
    p = tmp_path / "gold.csv"
    p.write_text("review_id,labels,sentiment,severity,customer_intent,support_escalation\na,contact/leaked_email; tables/+tidy_table,negative,,praise,yes\nb,contact/leaked_email,positive,,,no\nc,,,,,\n")
    gold = evaluation.load_gold_csv(spark, str(p), TAX)
    prov = spark.createDataFrame([("a", "random"), ("b", "random")], "review_id string, stratum string")
    lab = spark.createDataFrame([("a", "contact", "leaked_email", None), ("a", "tables", None, "tidy_table"), ("b", "contact", "all_caps", None)], "review_id string, product_area string, issue_type string, strength_type string")
    rev = spark.createDataFrame([("a", "Negative ", True), ("b", "neutral", False)], "review_id string, sentiment string, support_escalation boolean")
    ids = rev.select("review_id")
    r = evaluation.score_gold(gold, prov, evaluation.predicted_pairs(lab, ids), pairs=True).collect()
    assert [(x.stratum, x.tp, x.fp, x.fn, x.sufficient) for x in r] == [("random", 2, 1, 1, False)]
    r = {x.field: (x.n, x.agree) for x in evaluation.score_gold_fields(gold, prov, rev, ["sentiment", "support_escalation"]).collect()}
    assert r == {"sentiment": (2, 1), "support_escalation": (2, 2)}
    p.write_text("review_id\na\n")
    with pytest.raises(ValueError):
        evaluation.load_gold_csv(spark, str(p), TAX)


def test_clean_baseline(spark):
    r = spark.createDataFrame([(f"r{i}", "license text, all rights reserved", 1 + i % 5) for i in range(10)], "review_id string, review_text string, rating int")
    items = labels.rule_labeller(r, TAX)
    one, kinds = evaluation.clean_baseline(items.withColumn("sentiment", F.when(F.col("review_id") == "r3", "odd").otherwise(F.col("sentiment"))), r, TAX)
    x = one.first()
    assert (x.examined, x.flagged, x.false_positive_rate) == (10, 1, 0.1) and x.ci_low < 0.1 < x.ci_high
    assert [(k.kind, k.n) for k in kinds.collect()] == [("invalid_attribute", 1)]


def test_generate_opportunities(spark):
    def provider(system, message):
        if "a / i" in message:
            one = {"title": "t", "change": "c", "addresses_hypothesis": "h", "primary_metric": "negative_share", "expected_direction": "decrease", "risk_if_wrong": "slower refunds"}
            return "```json\n" + json.dumps({"opportunities": [one, one | {"title": "u", "risk_if_wrong": "No risk."}]}) + "\n```"
        return "I can't"

    points = spark.createDataFrame([("a", "i", 9, 2.0, 0.5, None), ("b", "i", 5, 1.0, 0.1, 0.2), ("c", "i", 5, 1.0, 0.1, 0.2)], "product_area string, issue_type string, volume long, mean_severity double, escalation_rate double, churn_rate double")
    h = spark.createDataFrame([("a", "i", "h", "m", None), ("b", "i", "h", "m", "x"), ("b", "j", "other", "m", None)], "product_area string, issue_type string, hypothesis string, mechanism string, disconfirming_evidence string")
    assert {r.product_area: [x.hypothesis for x in r.hypotheses] for r in rice.hypotheses_of(points, h).collect()} == {"a": ["h"], "b": ["h"], "c": []}
    message = rice.opportunity_messages(rice.hypotheses_of(points, h)).where("group_id = 'a/i'").first().message
    assert "asked for support 50%" in message and "mean to leave unknown" in message and "but:" not in message
    kept, issues = rice.generate_opportunities(points, h, provider)
    assert [r.title for r in kept.collect()] == ["t"]
    assert sorted((r.product_area, r.issue, r.detail) for r in issues.collect()) == [("a", "no_stated_risk", "u"), ("b", "unparseable_response", "I can't"), ("c", "no_hypotheses", "")]


def test_orders_and_index(spark, tmp_path):
    lab = spark.createDataFrame([("b", "x", None, "s"), ("a", "y", "i", None), ("a", "x", None, "s"), ("a", "x", "i", None)], "review_id string, product_area string, issue_type string, strength_type string")
    assert [(r.review_id, r.product_area, r.issue_type) for r in labels.ordered_labels(lab).collect()] == [("a", "x", "i"), ("a", "x", None), ("a", "y", "i"), ("b", "x", None)]
    assert labels.label_pairs(lab).count() == 3
    rates = spark.createDataFrame([("a", "p", 0.1), ("b", "p", 0.3), ("a", "q", 0.2)], "product_area string, platform string, rate double")
    assert [(r.product_area, r.platform) for r in trends.ordered_rates(rates).collect()] == [("a", "q"), ("a", "p"), ("b", "p")]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "vec_id int, embedding array<double>")
    index = retrieval.build_index(v, str(tmp_path / "i"))
    assert [r.vec_id for r in retrieval.search(index, [0.0, 1.0], 2).collect()] == [2, 1]
    for wrong in ([1.0], [float("nan"), 0.0], None):
        with pytest.raises(ValueError):
            retrieval.build_index(v.unionByName(spark.createDataFrame([(3, wrong)], v.schema)), str(tmp_path / "j"))
    hits = spark.createDataFrame([("a", ["x"], "high", True), ("b", ["y"], None, True), ("c", ["x"], "low", False)], "review_id string, product_areas array<string>, severity string, in_comparable_window boolean")
    ids = lambda **f: [r.review_id for r in hits.where(retrieval.post_filter(**f)).collect()]
    assert ids() == ["a", "b", "c"] and ids(exclude=["a"], areas=["x"]) == ["c"] and ids(severities=["high"]) == ["a"] and ids(window=True) == ["a", "b"]


def blobs(seed=3, n=120, dims=8, kinds=5):
    import numpy as np

    rng = np.random.default_rng(seed)
    centre = np.eye(dims)[:kinds] * 4
    label = rng.integers(0, kinds, n)
    return label, centre[label] + rng.normal(0, 0.3, (n, dims))


def test_choose_k_finds_what_is_planted_and_its_silhouette_is_the_plain_one(spark):
    import numpy as np

    label, x = blobs()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (999, None)], "vec_id long, embedding array<double>").repartition(5)
    choice, assigned = cluster.fit_clusters(df, 2, 8, inits=3)
    own = {r.vec_id: r.cluster for r in assigned.collect()}
    assert choice.k == 5 and set(own) == set(range(len(x)))
    assert len({(label[i], own[i]) for i in own}) == 5  # the same parts under other names
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    far = 1 - unit @ unit.T
    c = np.array([own[i] for i in range(len(x))])
    mean = np.array([[far[i][(c == k) & (np.arange(len(x)) != i)].mean() for k in range(5)] for i in range(len(x))])
    a = mean[np.arange(len(x)), c]
    b = np.where(np.arange(5) == c[:, None], np.inf, mean).min(axis=1)
    s = (b - a) / np.maximum(a, b)
    assert choice.silhouette == choice.scores[5] == pytest.approx(s.mean(), abs=1e-9)
    got = {r.cluster: (r["size"], r.silhouette) for r in cluster.silhouette(df, assigned).collect()}
    assert got == {k: (int((c == k).sum()), pytest.approx(s[c == k].mean(), abs=1e-9)) for k in range(5)}
    again = cluster.choose_k(df.repartition(2), 2, 8, inits=3)
    assert again.k == 5 and again.scores == pytest.approx(choice.scores)


def test_clusters_of_odd_tables(spark):
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too few"):
        cluster.choose_k(one, 3, 24)
    assert cluster.choose_k(one, 2, 24).scores == {2: pytest.approx(2 / 3)}  # two equal vectors, and a cluster of one
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert set(cluster.choose_k(same, 3, 4).scores.values()) == {-1.0}
    given = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "vec_id long, cluster int")
    assert {r.cluster: r["size"] for r in cluster.silhouette(one, given).collect()} == {1: 2, 2: 1}


def test_cluster_summary_with_labels_and_exemplars(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0])], "review_id string, embedding array<double>")
    given = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "review_id string, cluster int")
    facts = spark.createDataFrame([("a", "low", True, "negative", 1, "x"), ("b", None, False, "positive", 5, "y"), ("c", "high", False, "negative", 2, "x")], "review_id string, severity string, support_escalation boolean, sentiment string, rating int, platform string")
    lab = spark.createDataFrame([("a", "p", "i"), ("a", "q", None), ("b", "p", "j"), ("b", "p", "j")], "review_id string, product_area string, issue_type string")
    got = {r.cluster: r for r in cluster.cluster_summary(given, facts, "review_id", labels=lab, vectors=vectors, n_exemplars=1).collect()}
    assert (got[1].dominant_area, got[1].dominant_issue, got[1].exemplars, got[1].top_platform) == ("p", "j", ["a"], "x")
    assert (got[2].dominant_area, got[2].dominant_issue, got[2].exemplars, got[2].share) == (None, None, ["c"], pytest.approx(1 / 3))


def test_hypotheses(spark):
    points = spark.createDataFrame([(a, "i", 10, 2.5, 0.25, None) for a in ("good", "bare", "broken", "wrong", "fails", "alone", "partly")], "product_area string, issue_type string, volume int, mean_severity double, escalation_rate double, churn_rate double")
    quotes = spark.createDataFrame([(a, "i", k, f"r{k}", f"quote {k}") for a in ("good", "bare", "broken", "wrong", "fails", "partly") for k in (1, 2)], "product_area string, issue_type string, evidence_rank int, review_id string, quote string")
    one = {"hypothesis": "h", "mechanism": "m", "supporting_review_ids": ["r1", "r1"], "disconfirming_evidence": "d", "proposed_check": "c", "confidence": 0.5}

    def provider(system, message):
        area = message.split("\n")[0].split(": ")[1].split(" / ")[0]
        assert "[r1] quote 1\n[r2] quote 2" in message and "asked for support 25%, mean to leave unknown" in message and '"maxItems": 3' in system
        if area == "fails":
            raise RuntimeError("HTTP 401")
        return {
            "good": "```json\n" + json.dumps({"hypotheses": [one] * 5}) + "\n```", "bare": "So: " + json.dumps([one | {"hypothesis": "b"}]), "broken": "no idea", "wrong": json.dumps([{k: v for k, v in one.items() if k != "proposed_check"}]),
            "partly": json.dumps([one | {"supporting_review_ids": ["r9"]}, one | {"supporting_review_ids": []}, one | {"disconfirming_evidence": " "}]),
        }[area]

    kept, issues = rice.generate_hypotheses(points, quotes, provider)
    assert sorted((r.product_area, r.hypothesis) for r in kept.collect()) == [("bare", "b"), ("good", "h"), ("good", "h"), ("good", "h"), ("partly", "h")]
    assert sorted((r.product_area, r.issue) for r in issues.collect()) == [("alone", "no_evidence"), ("broken", "unparseable_response"), ("fails", "api_error"), ("partly", "invented_citation"), ("partly", "no_disconfirming_evidence"), ("partly", "uncited_hypothesis"), ("wrong", "schema_violation")]
    schema = rice.hypothesis_schema(2)["properties"]["hypotheses"]
    assert schema["maxItems"] == 2 and schema["items"]["required"] == list(one) and schema["items"]["properties"]["confidence"]["maximum"] == 1
    assert rice.generate_hypotheses(points.limit(0), quotes, provider)[0].count() == 0


def test_costs_models_and_words(spark, tmp_path):
    from tallyloom.functions import text as X

    models = config.load_models()
    assert models["offline"]["effort"] is None and config.corpus_cost(models["offline"], 1000, 4000)["usd"] == 0
    c = config.corpus_cost(models["small"], 1001, 4000, size=5, retry_rate=0.1)
    assert c["requests"] == 201 + 100 and c["input_tokens"] == 201 * 1000 + 1001 * 90 + 100 * 1090 and c["output_tokens"] == 1101 * 260
    assert c["usd"] == pytest.approx(c["input_tokens"] * 0.2e-6 + c["output_tokens"] * 0.6e-6) and c["usd_batch"] == pytest.approx(c["usd"] / 2)
    assert config.corpus_cost(models["reasoning"], 10, 0, retry_rate=0)["output_tokens"] == 10 * 260 * 3
    with pytest.raises(ValueError, match="retry_rate"):
        config.corpus_cost(models["small"], 1, 1, retry_rate=1.0)
    bad = tmp_path / "m.yaml"
    for text in ("models: [{id: a, provider: x, input_per_million: 1}]", "models: [{id: a, provider: x, input_per_million: 1, output_per_million: -1}]", "models: [{id: a, provider: x, input_per_million: 1, output_per_million: 1, effort: huge}]"):
        bad.write_text(text)
        with pytest.raises(config.ConfigError):
            config.load_models(bad)
    df = spark.createDataFrame([(True,), (False,), (None,)], "s boolean")
    assert [r[0] for r in df.select(X.significance_label(F.col("s"))).collect()] == ["established", "not established", "not established"]
    assert [f.agg(X.scoring_mode(F.col("s"))).first()[0] for f in (df, df.where("not s"), df.limit(0))] == ["rice", "ric", "none"]


def test_enrich_corpus_has_waves_only_for_a_store(spark, monkeypatch, tmp_path):
    from tallyloom.sources.stores import KeyedStore

    r = spark.createDataFrame([(f"r{i}", "license text with a token = here" if i % 2 else "nothing of note") for i in range(24)], "review_id string, review_text string")
    waves, plain = [], enrichment.enrich
    monkeypatch.setattr(enrichment, "enrich", lambda messages, *a: (waves.append(messages), plain(messages, *a))[1])
    rows = lambda got: sorted((x.review_id, len(x.areas), x.grounding_rate) for x in got.items.collect())
    ask = lambda **kw: enrichment.enrich_corpus(r, labels.system_prompt(TAX), TAX, enrichment.OfflineProvider(TAX), size=2, concurrency=2, save_every=2, **kw)
    without = ask()
    assert len(waves) == 1 and without.failed.count() == 0 and without.requests >= 12
    store = KeyedStore(spark, str(tmp_path), "m", enrichment.STORED, enrichment.STORED_KEY)
    stored = ask(store=store)
    assert len(waves) >= 4 and rows(stored) == rows(without) and len(rows(stored)) == 24 and stored.issues.count() == without.issues.count()


@pytest.mark.parametrize(("every", "most"), [(1, 1000), (40, 3000)])
def test_a_clean_sample_looks_at_ranges_of_hashes(spark, monkeypatch, every, most):
    r = spark.createDataFrame([(f"r{i}", "license text with a token = here", 1 + i % 5) for i in range(3000)], "review_id string, review_text string, rating int")
    items = labels.rule_labeller(r, TAX)
    items = items.withColumn("sentiment", F.when(F.substring("review_id", 2, 9).cast("int") % every == 0, F.col("sentiment")).otherwise("odd"))
    h = F.xxhash64(F.lit(3), "review_id")
    want = [x.review_id for x in evaluation.clean_pool(items, r, TAX).orderBy(h, "review_id").limit(20).collect()]
    seen, plain = [], evaluation.clean_pool
    monkeypatch.setattr(evaluation, "clean_pool", lambda i, *a: (seen.append(i.count()), plain(i, *a))[1])
    study = evaluation.fault_study(items, r, TAX, 20, 3).collect()
    assert sum(seen) <= most and {x.attempted + x.inapplicable for x in study} == {20}
    assert [x.review_id for x in evaluation.clean_sample(items, r, TAX, 20, 3).collect()] == want
    assert evaluation.clean_sample(items, r, TAX, 4000, 3).count() == 3000 // every


def test_vectors_meet_all_centres_in_blocks(spark, monkeypatch):
    import pyarrow as pa

    asked, plain = [], cluster.Centres.nearest
    monkeypatch.setattr(cluster.Centres, "nearest", lambda self, x: (asked.append(len(x)), plain(self, x))[1])
    np = cluster.np
    x = np.repeat(np.eye(2), [4000, 1000], axis=0)
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64()))], names=["v"])

    class Ran(Exception):
        pass

    class Frame:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, scan, _):
            raise Ran([row for b in scan(iter([batch, batch.slice(0, 0)])) for row in b.to_pylist()])

    with pytest.raises(Ran) as ran:
        cluster._sums(Frame(), [np.eye(2)])
    (row,) = ran.value.args[0]
    assert np.frombuffer(row["n"]).tolist() == [4000, 1000] and np.frombuffer(row["total"]).tolist() == [4000, 0, 0, 1000] and row["cost"] == 0
    assert sum(asked) == 5000 and max(asked) <= 1000, "a number for each row and centre"
