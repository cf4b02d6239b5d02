import random

import pytest
from test_text_operators import WORDS, plain_fingerprint, plain_ids, prose

import corpus_pipeline
from pairsight.llm import pieces, secrets


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    r = random.Random(5)
    texts = {i: prose(1000 + i, 60) + (f" {WORDS[i % 20]} nasty {WORDS[i % 7]}" if i % 5 == 0 else "") for i in range(400)}
    item = prose(77, 30)
    texts |= {401: prose(501, 40) + " " + item, 402: item, 403: texts[1], 404: None, 405: "", 406: "my token = abcdef0123456789abcdef, see", 407: prose(7, 80)}
    docs = [(i, t, "en", f"src{r.randint(0, 3)}", len(t or ""), "x") for i, t in texts.items()] + [(407, texts[407], "en", "s", 1, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, fp string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, texts


def test_stages_keep_what_brute_force_keeps(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(path))
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        kept[name] = docs
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {k: sorted(r.doc_id for r in v.select("doc_id").collect()) for k, v in kept.items()}
    toxic = {i for i in range(400) if i % 5 == 0}
    assert len(toxic & {*ids["toxicity"]}) <= 4 and len({*range(400)} - toxic - {*ids["toxicity"]}) <= 6
    left = ids["toxicity"]
    prints = {i: plain_fingerprint(texts[i]) for i in left}
    root = {i: i for i in left}
    for _ in range(3):
        for i in left:
            root[i] = min(root[j] for j in left if (prints[i] ^ prints[j]).bit_count() <= 4)
    assert ids["near_duplicates"] == sorted({i for i in left if root[i] == i})
    assert {*ids["near_duplicates"]} - {*ids["decontamination"]} == {401, 402}
    assert ids["secrets"] == ids["decontamination"]
    hidden = {r.doc_id: r for r in kept["secrets"].collect()}
    assert hidden[406].text == "my [assign], see" and hidden[406].n_chars == 16
    v = pieces.load_vocabulary()
    for r in kept["tokens"].collect():
        text = secrets.redact(texts[r.doc_id] or "", secrets.find_secrets(texts[r.doc_id] or ""))
        assert list(r.ids) == (plain_ids(v, v.cutter.prepared(text)) if text else []) and r.n_tokens == len(r.ids)


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, str(path)).count() == spark.read.parquet(f"{path}/tokens").count()


def test_rows_and_not_ids_are_dropped(spark, tmp_path):
    item = prose(77, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c, d, e = (prose(600 + i, 60) for i in range(5))
    hit = prose(700, 20) + " " + item
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (8, c), (None, c), (9, e), (None, e), (None, hit), (9, hit), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = lambda df: sorted(((r.doc_id, r.text or "") for r in df.collect()), key=str)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    assert got(out) == sorted([(None, a), (None, b), (7, c), (7, d), (9, e), (9, hit), (3, "")], key=str)
    out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == corpus_pipeline.COLUMNS
    assert got(out) == sorted([(i, t or "") for i, t in rows if t != hit], key=str)


def test_toxicity_stage_has_no_switch_by_size(spark, folder, tmp_path):
    path, _ = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    labels.unionByName(spark.range(1 << 20, (1 << 20) + 2_000_000).selectExpr("id AS doc_id", "0 AS toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    kept = [sorted(r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, str(p)).select("doc_id").collect()) for p in (path, tmp_path)]
    assert kept[0] == kept[1] and len(kept[0]) > 300
