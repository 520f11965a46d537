import hashlib
import random
import zlib

import __spark_entry__ as entry
from checks.compare import difference, duckdb_over
from ledgerloom.llm import merkle
from pyspark.sql import functions as F
from tests.conftest import SMALL
from tests.llm.helpers import DOCUMENTS, awkward, clashing, documents

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    def framed(value):
        return "-" if value is None else f"{len(str(value).encode())}:{value}"

    return digest("".join(framed(row[x]) for x in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(digests):
    """The root, and for each leaf what stands left and right of it on every level."""
    siblings, own = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, at in enumerate(own):
            run = digests[at // 16 * 16:at // 16 * 16 + 16]
            siblings[i].append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
            own[i] = at // 16
        digests = [digest("".join(digests[a:a + 16])) for a in range(0, len(digests), 16)]
    return digests[0], siblings


def brute(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    sources = sorted(by_source, key=lambda x: (x is not None, (x or "").encode()))
    made = []
    for source in sources:
        ordered = sorted(by_source[source],
                         key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made.append((ordered, *tree([leaf(r) for r in ordered])))
    if not made:
        return []
    root, above = tree([x[1] for x in made])
    out = []
    for (ordered, subroot, siblings), top in zip(made, above):
        for row, own in zip(ordered, siblings):
            fold = leaf(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                text = row["text"] and "".join(
                    c.lower() if "A" <= c <= "Z" else c for c in row["text"])
                fold = leaf(row | {"text": text})
            for left, right in own + top:
                fold = digest(left + fold + right)
            proof = digest("".join(a + b for a, b in own + top))
            out.append((row["doc_id"], leaf(row), subroot, root, proof, fold, fold == root))
    return sorted(out, key=str)


def got(docs):
    manifest = merkle.build(docs, changed=merkle.lower_cased(docs))
    found = merkle.proofs(manifest, lambda x: F.coalesce(x["changed"], x["digest"]), ("changed",))
    return sorted([tuple(r) for r in found.select(*COLUMNS).collect()], key=str)


def drawn(seed, n):
    """A hot source, many small ones, a third of rows without an id, and repeated rows."""
    pick = random.Random(seed)
    rows = [{
        "doc_id": i if pick.random() < 0.7 else None,
        "text": pick.choice([None, "", "A b C", "É" * 40, f"Text {i}"]),
        "lang": pick.choice([None, "en"]), "n_chars": pick.choice([None, i]),
        "source": pick.choice(["hot", "hot", None, "é", "z", f"s{pick.randrange(60)}"]),
    } for i in range(n)]
    return rows + rows[:30] + [rows[-1]] * 20


def frame(spark, rows):
    return spark.createDataFrame(
        [tuple(r[x] for x in DOCUMENTS.fieldNames()) for r in rows], DOCUMENTS)


def test_equals_brute_force(spark):
    rows = drawn(1, 1200)
    assert got(frame(spark, rows)) == brute(rows)


def test_sizes_around_full_runs_and_subtrees(spark):
    for n in (1, 2, 16, 17, 256, 257):
        rows = [{"doc_id": i, "text": f"T{i}", "lang": None, "source": "s", "n_chars": i}
                for i in range(n)]
        assert got(frame(spark, rows)) == brute(rows)


def test_many_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STRIDE", 1)  # every level stored
    rows = drawn(2, 600)
    assert got(frame(spark, rows)) == brute(rows)


def test_only_every_second_level_is_stored(spark):
    manifest = merkle.build(frame(spark, [
        {"doc_id": i, "text": "", "lang": None, "source": "s", "n_chars": 0} for i in range(300)]))
    assert [x.count() for x in manifest.sources] == [300, 2, 1]


def test_siblings_lead_to_the_root_outside_spark(spark):
    docs = frame(spark, drawn(3, 400))
    manifest = merkle.build(docs)
    for row in merkle.proofs(manifest, siblings=True).collect():
        fold = row.leaf
        for left, right in row.siblings:
            fold = digest(left + fold + right)
        assert fold == row.folded_root == manifest.root and row.verified


def test_tampering_is_found(spark):
    docs = documents(spark, [(i, f"Text {i}") for i in range(40)])
    found = got(docs)
    changed = {i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {r[0] for r in found if not r[6]} == changed


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [r.asDict() for r in docs.collect()]
    more = clashing(docs, "tree", "digest", "pos", "tie", "leaf", "place", "n")
    assert got(more) == brute(rows)
    assert got(documents(spark, [])) == []
    assert merkle.build(documents(spark, [])).root is None


def test_equals_oracle(spark):
    name = "op11_merkle_manifest"
    assert difference(entry.queries()[name](spark, SMALL), duckdb_over(SMALL),
                      entry.oracle_sql()[name]) is None
