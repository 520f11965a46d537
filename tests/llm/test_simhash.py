import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components
from tests.conftest import SMALL
from tests.llm.helpers import PASSAGE, awkward, clashing, documents, sample


def plain_fingerprint(text, size=4):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    cuts = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxh64_intdigest(x.encode(), 42) for x in cuts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, most=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, f, least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))),
                  key=str)


def got(docs):
    return sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)
                   for r in simhash.near_duplicates(docs).collect()), key=str)


def test_equals_brute_force(spark):
    rows = sample(SMALL)
    assert got(documents(spark, rows)) == plain_components(rows)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(clashing(docs, "fp", "component_id", "node")) == plain_components(rows)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.one_of_each(documents(spark, [])).count() == 0


def test_spaces_and_characters_beyond_ascii():
    for text in ("a b c", "A É z", "one", "a\x0bb\x0cc d e", "ÀB cd ef gh ij"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("size", [2, 9, 10, 300])
def test_links_join_what_brute_force_joins(spark, size):
    drawn = np.random.default_rng(size)
    base = drawn.integers(0, 1 << 62, 3)
    fps = {int(b) ^ sum(1 << int(k) for k in drawn.choice(62, drawn.integers(0, 6), False))
           for b in base for _ in range(size)}
    nodes = spark.createDataFrame([(f, f, 0) for f in fps], "node long, fp long, second long")
    roots = {r.node: r.root for r in components(simhash.links(nodes)).collect()}
    todo, group = set(fps), {}
    while todo:
        queue = [todo.pop()]
        found = set(queue)
        while queue:
            at = queue.pop()
            near = {x for x in todo if (x ^ at).bit_count() <= 4}
            todo -= near
            found |= near
            queue += near
        group |= dict.fromkeys(found, min(found))
    assert {f: roots.get(f, f) for f in fps} == group


def test_large_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    fps = [1 << i | 1 << j for i in range(10) for j in range(i)]
    nodes = spark.createDataFrame([(f, f, 0) for f in fps], "node long, fp long, second long")
    roots = components(simhash.links(nodes)).collect()
    assert {r.root for r in roots} == {min(fps)}
    assert len(roots) == len(fps)


def test_one_of_each_component_stays(spark):
    text = " ".join(f"word{i} thing{i}" for i in range(120))
    other = " ".join(f"else{i} where{i}" for i in range(120))
    docs = documents(spark, [
        (5, text), (3, text.upper()), (4, text + " end"), (6, PASSAGE), (7, None), (8, ""),
        (9, PASSAGE), (9, other), (9, other), (2, other), (None, text), (None, text)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    group = {n: c for n, _, c in plain_components([(n, t) for n, (_, t) in enumerate(rows)])}
    expected = {}
    for n, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            expected.setdefault(group[n], []).append(doc_id)
    kept = simhash.one_of_each(clashing(docs, "fp", "node", "_group", "component_id"))
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    ids = [i for none, i, _ in found if not none]
    assert ids == sorted(min(x) for x in expected.values())
    assert sum(none for none, _, _ in found) == 2
    assert kept.columns == [*docs.columns, "fp", "node", "_group", "component_id"]


def test_rows_that_repeat_an_id_stay(spark):
    other = " ".join(f"else{i} where{i}" for i in range(60))
    docs = documents(spark, [(1, "alpha beta gamma delta epsilon"), (1, other), (1, other)])
    assert {r.text for r in simhash.one_of_each(docs).collect()} == {
        "alpha beta gamma delta epsilon", other}
    assert simhash.one_of_each(docs).count() == 2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in found.collect()} == \
        {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
