import __spark_entry__ as entry
from checks.compare import difference, duckdb_over
from ledgerloom.llm import span_dedup
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import awkward, clashing, documents


def test_equals_oracle(spark):
    name = "op2_sentence_span_dedup"
    assert difference(entry.queries()[name](spark, SMALL), duckdb_over(SMALL),
                      entry.oracle_sql()[name]) is None


def kept(spark, rows, **options):
    found = span_dedup.dedup(documents(spark, rows), **options).collect()
    return {r.doc_id: (r.n_sentences, r.n_removed, r.kept) for r in found}


def test_covered_sentences_go(spark):
    run = "One here. Two there!\nThree? "
    found = kept(spark, [
        (1, "Start. " + run + "End."), (2, "other. " + run.upper() + "close."),
        (3, run + run), (4, "One here. Two there!"), (5, None), (6, "")])
    assert found[1] == (5, 0, "Start. " + run + "End.")
    assert found[2] == (5, 3, "other. close.")
    # both runs repeat document 1; the runs that wrap around the middle are first here
    assert found[3] == (6, 6, "")
    assert found[4] == (2, 0, "One here. Two there!")
    assert found[5] == found[6] == (0, 0, "")


def test_long_sentences_are_several(spark):
    words = [f"w{i}" for i in range(50)]
    passage = " ".join(words) + ". "  # one sentence of four pieces
    found = kept(spark, [(1, "Some start. " + passage), (2, passage + "Another end."),
                         (3, "It begins here with " + passage), (4, " ".join(words[:40]) + ".")])
    assert found[1][1] == 0 and found[2] == (5, 4, "Another end.")
    assert found[3][1] == 0  # the sentence starts elsewhere, so its pieces differ
    assert found[4][:2] == (3, 0)  # the last piece differs


def test_passages_of_fifty_words_go_in_any_sentences(spark):
    import random

    drawn = random.Random(3)
    docs, passages = [], []
    for i in range(60):
        words = [f"p{i}x{drawn.randrange(9)}" for _ in range(51)]
        for end in drawn.sample(range(50), drawn.randrange(4)):
            words[end] += "."
        passages.append(" ".join(words) + ".")
    for i, passage in enumerate(passages):
        for copy in range(2):
            docs.append((2 * i + copy, f"Line {i} {copy}.\n{passage}\nRest {i} {copy}."))
    found = kept(spark, docs)
    assert all(found[2 * i][1] == 0 and found[2 * i + 1][2] == f"Line {i} 1.\nRest {i} 1."
               for i in range(60))


def test_repeats_within_a_document(spark):
    assert kept(spark, [(1, "a. b. c. a. b. c. d.")])[1] == (7, 3, "a. b. c. d.")
    assert kept(spark, [(1, "a. a. a. a. ")], span=1)[1] == (4, 3, "a. ")


def test_awkward_rows(spark):
    docs = awkward(spark)
    found = span_dedup.dedup(clashing(docs, "_owner", "kept", "h1", "at", "first"))
    assert found.count() == docs.count()
    assert {"_owner", "h1", "kept"} <= set(found.columns)
    rows = found.where("doc_id IS NOT NULL").collect()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_removed == 0 and by_id[2].n_removed == 3 and by_id[7].n_removed == 4
    assert by_id[2].kept == "Another end."
    assert all((r.text or "").replace("\u0001", "") == r.kept for r in rows if not r.n_removed)
    assert span_dedup.dedup(documents(spark, [])).count() == 0


def test_pieces_make_the_text(spark):
    texts = [" ".join("ab" * 40) + ".  " + "c " * 33, "  " + "d  " * 20 + "\n e", "a. b", "a.b. ", "\n\na\n", "x!?  y", "", "é. \u3002 z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    joined = df.select("text", F.array_join(span_dedup.sentences(F.col("text")), "").alias("out"))
    assert all(r.text == r.out for r in joined.collect())
