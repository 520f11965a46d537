import hashlib
import math
import random
from collections import Counter

from ledgerloom.llm import multiset_hash
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import PASSAGE, awkward, clashing, documents, sample


def of(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return {r.i: r.fp for r in multiset_hash.fingerprints(df, ["text"], ["i"]).collect()}


def near(spark, *pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    made = multiset_hash.fingerprints(df, ["a", "b"], ["i"])
    a = made.where("number = 0").select("i", F.col("fp").alias("x"))
    b = made.where("number = 1").select("i", F.col("fp").alias("y"))
    both = a.join(b, "i").select("i", multiset_hash.likeness(F.col("x"), F.col("y")).alias("near"))
    return [r.near for r in sorted(both.collect())]


def cosine(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    norms = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return sum(x[w] * y[w] for w in x) / math.sqrt(norms)


def edited(rows):
    """Of rows with different ids."""
    known = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, text) in enumerate(known):
        take = len(text) // 4
        text = text[:len(text) - take] + known[(k + 1) % len(known)][1][:take]
        out[i] = hashlib.sha256(text.encode()).hexdigest()
    return out


def test_edited_texts_and_likeness(spark):
    rows = sample(SMALL)
    expected, texts = edited(rows), dict(rows)
    made = multiset_hash.with_edited(documents(spark, rows)).select(
        "*", multiset_hash.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        multiset_hash.likeness(F.col("fp"), F.col("next_fp")).alias("near_next")).collect()
    assert len(made) == len(rows)
    by_text = {}
    for r in made:
        assert r.edited_sha256 == expected[r.doc_id]
        assert r.n_chars == len(texts[r.doc_id])
        assert by_text.setdefault(texts[r.doc_id], r.fp) == r.fp
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert sum(r.near_edited > r.near_next for r in made) >= 0.95 * len(made)
    assert len({str(r.fp) for r in made}) == len(by_text)


def test_order_does_not_matter_and_paragraphs_add(spark):
    fps = of(spark, "first one\nsecond one\nthird", "third\nfirst one\nsecond one",
             "first one\nsecond one", "third", "first one\nsecond one\nthird\nthird")
    assert fps[0] == fps[1] != fps[4]
    df = spark.createDataFrame(
        [(0, "first one\nsecond one"), (1, "third"), (2, "first one\nsecond one\nthird")],
        "i int, text string")
    made = multiset_hash.fingerprints(df, ["text"], ["i"])
    x, y, z = (made.where(f"i = {n}").select(F.col("fp").alias(f"fp{n}")) for n in range(3))
    r = x.join(y).join(z).select(
        multiset_hash.combined(F.col("fp0"), F.col("fp1")).alias("added"),
        multiset_hash.combined(F.col("fp2"), F.col("fp1"), remove=True).alias("less")).first()
    assert r.added == fps[0]
    assert r.less == fps[2]


def test_likeness_bounds(spark):
    found = near(spark, (PASSAGE, PASSAGE), (PASSAGE, "other words entirely here"), ("", ""),
                 ("", "a"), (PASSAGE, PASSAGE + "More of it."))
    assert found[0] == found[2] == 1.0 and found[3] == 0.0
    assert found[1] < 0.4 < 0.9 < found[4] < 1


def test_likeness_is_the_cosine_of_word_counts(spark):
    drawn = random.Random(8)
    pairs = []
    for share in (0.0, 0.2, 0.4, 0.6, 0.8, 0.9, 0.97) * 6:
        words = [f"w{drawn.randrange(10**6)}" for _ in range(400)]
        other = [w if drawn.random() < share else f"v{drawn.randrange(10**6)}" for w in words]
        drawn.shuffle(other)
        pairs.append((" ".join(words), "\n".join(other)))
    found = near(spark, *pairs)
    # 128 lanes: a standard error of (1 - cosine ** 2) / sqrt(128)
    for (a, b), estimate in zip(pairs, found):
        exact = cosine(a, b)
        assert abs(estimate - exact) < 4.5 * (1 - exact**2) / math.sqrt(128) + 0.02


def test_long_texts_and_any_paragraph_length(spark):
    one = " ".join(f"a{i}" for i in range(40_000))
    two = " ".join(f"b{i}" for i in range(40_000))
    for n in (290, 298, 299, 300, 5000):
        line = ("word%d " * n % tuple(range(n)))[:n]
        found = near(spark, (line, line + "x"), (line, line + "xyz"))
        assert min(found) > 0.9
    unlike, like = near(spark, (one, two), (one, one + " end"))
    assert unlike < 0.3 and like > 0.99


def test_awkward_rows(spark):
    docs = awkward(spark)
    made = multiset_hash.with_edited(clashing(docs, "fp", "next_id", "start", "take", "part"))
    rows = made.collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    by_id = {r.doc_id: r for r in rows}
    take = len(texts[2]) // 4  # the next text, of document 3, is null
    assert by_id[2].edited_sha256 == hashlib.sha256(
        texts[2][:len(texts[2]) - take].encode()).hexdigest()
    take = len(texts[12]) // 4  # the last is followed by the first
    assert by_id[12].edited_sha256 == hashlib.sha256(
        (texts[12][:len(texts[12]) - take] + texts[1][:take]).encode()).hexdigest()
    assert by_id[None].next_fp is None
    assert multiset_hash.with_edited(documents(spark, [])).count() == 0
    alone = multiset_hash.with_edited(documents(spark, [(5, "abcdefgh")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_successors_over_many_ranges(spark, conf):
    conf(spark__sql__shuffle__partitions="7")
    ids = [x * x - 50 for x in range(500)]
    found = multiset_hash.successors(
        spark.createDataFrame([(i,) for i in ids + [None, 14, 14]], "doc_id long"))
    assert {(r.doc_id, r.next_id) for r in found.collect()} == \
        set(zip(sorted(set(ids)), sorted(set(ids))[1:] + [min(ids)]))
