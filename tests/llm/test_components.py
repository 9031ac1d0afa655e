import random

import pytest

from foliant.llm import components


def plain_roots(links):
    root = {x: x for link in links for x in link}
    for a, b in links:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {x: new if r == old else r for x, r in root.items()}
    return root


@pytest.fixture(scope="module")
def groups():
    """A dense group, as if each of 40 buckets had linked all of it in a way of its own; a chain; pairs."""
    rng = random.Random(5)
    nodes = rng.sample(range(-(10**6), 10**6), 700)
    dense, chain, rest = nodes[:300], nodes[300:500], nodes[500:]
    links = [(dense[k], dense[rng.randrange(k)]) for _ in range(40) for k in range(1, 300)]
    links += [*zip(chain, chain[1:], strict=False), *zip(rest[::2], rest[1::2], strict=True)]
    rng.shuffle(links)
    return links


@pytest.mark.parametrize("options", [{}, {"one_task": 0}])
def test_dense_group_is_thinned_before_rounds(spark, monkeypatch, groups, options):
    written = []
    monkeypatch.setattr(components, "materialize", lambda df, name, f=components.materialize: (out := f(df, name), written.append(out.count()))[0])
    table = spark.createDataFrame([*groups, (None, 1), (2, None), (3, 3)], "a bigint, b bigint").repartition(4)
    want = plain_roots(groups)
    assert {r.node: r.root for r in components.connected_components(table, **options).collect()} == want
    assert max(written) < 2 * len(want)  # 9,867 different links went into the first round before
    assert len(written) == 2 or options  # few links are settled without rounds


def test_memory_of_thinning_is_bounded_and_strings_are_nodes(spark, groups):
    links = [(f"é{a}", f"é{b}") for a, b in groups]
    table = spark.createDataFrame(links, "a string, b string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = [tuple(r) for r in components.thinned(table, 60).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plain_roots(got) == plain_roots(links) and all(a > b for a, b in got)
    assert {r.node: r.root for r in components.connected_components(table, one_task=0).collect()} == plain_roots(links)


def test_no_links(spark):
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
