"""The pipeline's stages against plain versions of their contracts."""

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import _tokens
from tidemark.llm import toxicity
from tidemark.llm.queries import fold

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), keep=fold(5) != 0)
    toxic = {r.doc_id for r in toxicity.score(docs, lexicon).filter("score >= 0.5").collect()}
    first = steps["toxicity"](spark, docs, SF).cache()
    assert first.columns == docs.columns and toxic
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in first.collect()} == set(rows) - toxic

    second = steps["near_duplicates"](spark, first, SF).cache()
    group = brute.similar([(i, rows[i]) for i in set(rows) - toxic])
    assert second.columns == docs.columns
    assert sorted(r.doc_id for r in second.collect()) == sorted(i for i, c in group.items() if i == c)

    third = steps["decontamination"](spark, second, SF).cache()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in second.collect()]
    hits = brute.leaks(left, bench)
    got = {r.doc_id: r.text for r in third.collect()}
    assert set(got) == {i for i, _ in left if not hits[i][4]}
    for i, t in left:
        if i in got:
            words = brute.TOKEN.findall(got[i].translate(brute.LOWER))
            assert len(words) == hits[i][0] - hits[i][1] and (hits[i][1] or got[i] == t)

    fourth = steps["mixing"](spark, third, SF).cache()
    assert fourth.columns == docs.columns
    source = {r.doc_id: r.source for r in third.collect()}
    size, took = {}, {}
    for i, t in got.items():
        size[source[i]] = size.get(source[i], 0) + len(brute.WORD.findall(t))
    for r in fourth.collect():
        took[r.source] = took.get(r.source, 0) + len(brute.WORD.findall(r.text))
        assert got[r.doc_id].startswith(r.text)
    want = brute.targets(size)
    assert all(abs(took.get(s, 0) - want[s]) <= 1 + 4 * brute.block_words(want) for s in size)

    last = steps["token_ids"](spark, fourth, SF).collect()
    mixed = fourth.collect()
    crc = sorted((r.doc_id, len(ids), brute.crc(ids)) for r, ids in zip(mixed, _tokens([r.text for r in mixed]), strict=True))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in last) == crc


def test_run(spark):
    one, two = (corpus_pipeline.run(spark, SF).collect() for _ in range(2))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and one
