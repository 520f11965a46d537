import corpus_pipeline
from ledgerloom.llm import packing, pii, suffix_dedup
from ledgerloom.llm.common import stored
from tests.conftest import SMALL
from tests.llm.helpers import awkward, documents
from tests.llm.test_pii import plain as plain_spans
from tests.llm.test_suffix_dedup import plain as plain_dedup


def staged(spark, docs, sf_dir=SMALL):
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stored(stage(spark, frames[-1], sf_dir), name))
    return frames


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    _, clean, single, cut, redacted, sequences = staged(spark, docs)
    for frame in (clean, single, cut, redacted):
        assert frame.dtypes == docs.dtypes
    labels = {r.doc_id: r.toxic
              for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert sum(i in kept for i, t in labels.items() if not t) >= 0.97 * sum(
        not t for t in labels.values())
    rows = {r.doc_id: r.text for r in single.collect()}
    assert set(rows) <= kept and len({t.lower() for t in rows.values()}) == len(rows)
    # the cut texts have the bytes that brute force keeps, and rests of cut characters
    expected = {r[0]: r[4] for r in plain_dedup(list(rows.items()))}
    for r in cut.collect():
        assert r.text.encode().isascii() is False or r.text.encode() == expected[r.doc_id]
        assert len(r.text.encode()) - len(expected[r.doc_id]) <= 6 * 40
        assert r.n_chars == len(r.text)
    before = {r.doc_id: r.text for r in cut.collect()}
    for r in redacted.collect():
        spans = plain_spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) or spans or "<" in r.text
        assert not any(before[r.doc_id][a:b] in r.text for _, a, b in spans)
    pieces = sequences.collect()
    assert {r.doc_id for r in pieces} == set(rows)


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    expected = staged(spark, docs)[-1].drop("sequence_id", "offset")
    found = corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset")
    assert sorted(found.collect()) == sorted(expected.collect())


def test_awkward_rows(spark):
    docs = awkward(spark)
    frames = staged(spark, docs)
    ids = [sorted((str(r.doc_id) for r in f.collect())) for f in frames[:-1]]
    assert ids[1] == ids[0]  # nothing is toxic
    assert ids[2] == ids[3] == ids[4]
    assert set(ids[2]) >= {"1", "5", "6", "12", "None"}
    assert frames[-1].count() >= len(ids[4])
    assert all(f.count() == 0 for f in staged(spark, documents(spark, [])))


def test_the_stages_use_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "pii", "best_fit_packing"]
    assert packing.CAPACITY == 2048 and suffix_dedup.LENGTH == 50 and len(pii.KINDS) == 4
