import random

import pytest

import corpus_pipeline
from foliant.llm import mixing
from tests.llm.test_simhash import plain_components


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    say = lambda n: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}" for _ in range(n))
    leak = say(12)
    docs = []
    for i in range(240):
        text = say(60)
        if i % 6 == 0:
            text = " ".join(w for pair in zip(text.split(), ["grumblefoot", "dunderhead", "muckraker", "snarkwit"] * 15) for w in pair)
        docs.append((i, text, "en", f"s{i % 4}", len(text)))
    clean = [d for d in docs if d[0] % 6]
    docs += [(300 + k, clean[k][1], "en", "s1", clean[k][4]) for k in range(10)]
    docs += [(320 + k, f"{say(20)} {leak} {say(9)}", "en", "s2", 1) for k in range(5)]
    docs.append((330, f"{say(40)} password = hunter2hunter2 {say(20)}", "en", None, 1))
    labels = [(i, 1, int(i % 6 == 0)) for i in range(240)]
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, docs


def test_stages(spark, tables):
    where, rows = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    def stage(k, df):
        out = corpus_pipeline.STAGES[k][1](spark, df, where)
        assert k == 4 or out.columns == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    docs = stage(0, docs)
    assert ids(docs) == {i for i in text if i >= 240 or i % 6}
    before = sorted((i, text[i]) for i in ids(docs))
    docs = stage(1, docs)
    assert ids(docs) == {g for _, _, g in plain_components(before)} and not ids(docs) & set(range(300, 310))
    docs = stage(2, docs)
    assert ids(docs) == {g for _, _, g in plain_components(before)} - set(range(320, 325))
    left = docs.count()
    docs = stage(3, docs)
    assert docs.count() == left and "[secret]" in docs.where("doc_id = 330").first().text
    mixed = stage(4, docs)
    plan = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    assert {r.doc_id: r.taken for r in mixed.collect()} == plan


def test_run(spark, tables):
    assert corpus_pipeline.run(spark, tables[0]).count() > 100
    assert len(corpus_pipeline.STAGES) == 5


def test_null_and_shared_ids(spark, tmp_path):
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    leak, twice = say(12), say(50)
    rows = [(None, say(50), "s"), (None, say(50), "s"), (7, twice, "s"), (7, twice, "s"), (7, twice, "s"), (7, say(50), "s"), (8, say(50), "s"), (8, f"{say(9)} {leak} {say(9)}", "s"), (None, f"{leak} {say(30)}", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    some = lambda df: sorted((tuple(r)[:3] for r in df.collect()), key=str)
    assert some(corpus_pipeline.drop_near_duplicates(spark, docs, "")) == sorted(rows[:3] + rows[5:], key=str)
    assert some(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == sorted(rows[:7], key=str)
    got = corpus_pipeline.mix_sources(spark, docs, "")
    plan = [r for r in mixing.mix(docs).collect() if r.taken]
    assert sorted((r.doc_id or 0, r.taken) for r in got.collect()) == sorted((r.doc_id or 0, r.taken) for r in plan)
    assert sum(r.doc_id is None for r in plan) and sum(r.doc_id == 7 for r in plan) > 1
