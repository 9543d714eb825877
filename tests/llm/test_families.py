"""Families of pages that are alike but mostly not linked, and ids with several texts."""

import random

import pytest
from test_llm import brute_components, words

from strandmill.llm import near_dups


def family(n, seed=0):
    """One page template and four snippets out of pools: nearly all pairs just below the threshold."""
    r, base = random.Random(seed), words(78, seed)
    pools = [[" ".join(f"p{k}x{i}y{j}" for j in range(6)) for i in range(30)] for k in range(4)]
    return [(i, " ".join([*base[:20], r.choice(pools[0]), *base[20:40], r.choice(pools[1]), *base[40:60], r.choice(pools[2]), *base[60:], r.choice(pools[3])])) for i in range(n)]


@pytest.mark.parametrize("cell", [256, 8])
def test_unlinked_family(spark, monkeypatch, cell):
    monkeypatch.setattr(near_dups, "CELL", cell)
    texts = family(240)
    got = near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(set(c for _, c in want.values())) > 100


def test_ids_with_several_texts(spark):
    a, b, c = (" ".join(words(60, s)) for s in (1, 2, 3))
    rows = [(1, a, "x"), (1, b, "y"), (2, a + " more", "x"), (3, b + " more", "z"), (4, c, None), (4, c, None), (None, a, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnRenamed("key", "row")
    kept = near_dups.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, docs.where("doc_id = 1 or doc_id is null").collect() + docs.where("doc_id = 4").limit(1).collect()))


def test_links_leave_a_cell_as_a_forest(spark):
    """A cell of many linked sets of several components returns fewer links than sets."""
    base = words(80, 4)
    texts = [(i, " ".join([*base[:-1], f"z{i}"])) for i in range(150)]
    docs = spark.createDataFrame([(i, "", t) for i, t in texts], "id long, key string, text string")
    scratch = near_dups.Scratch(spark)
    sets = scratch.keep(docs.mapInArrow(near_dups._full, "set_id binary, n long, levels binary, hashes array<long>").selectExpr("row_number() over (order by set_id) as node", "n", "levels", "hashes").selectExpr("cast(node as long) as node", "n", "levels", "hashes"))
    cells = sets.selectExpr("1L as x", "1L as y", "0 as side", "node", "node as comp")
    links = near_dups._meet(cells, sets).collect()
    assert len(links) == 149 and {x for r in links for x in r} == set(range(1, 151))
