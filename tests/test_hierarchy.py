import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strataq.operators import hierarchy

SCHEMA = "dep_id bigint, scan_id bigint, name string, parent string, node string, root string"


def brute(rows):
    clean = lambda s: None if s is None else s.strip(" ").lower()
    nodes = {}
    for i, scan, name, parent in sorted(rows, key=lambda r: r[0]):
        nodes.setdefault((scan, clean(name)), (i, clean(parent) if parent and parent.strip() else None))
    out = {}
    for key, (i, _) in nodes.items():
        chain, at = [], key
        while True:
            if at in chain:
                loop = chain[chain.index(at) :]
                out[key] = (i, min(nodes[x][0] for x in loop), -1)
                break
            chain.append(at)
            up = nodes[at][1]
            if up is None or (at[0], up) not in nodes:
                out[key] = (i, nodes[at][0], len(chain) - 1)
                break
            at = (at[0], up)
    return sorted((i, *out[(scan, clean(name))]) for i, scan, name, _ in rows)


def solve(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return hierarchy.hierarchy(df, "dep_id", "scan_id", "name", "parent", **kw)


def check(spark, rows):
    for widen in (True, False):
        got = sorted((r.row_id, r.node, r.root, r.depth) for r in solve(spark, rows, widen=widen).collect())
        assert got == brute(rows)


def test_deep_chain_cycles_and_tails(spark):
    chain = [(i, 1, f"N{i} ", f" n{i - 1}" if i else None) for i in range(37)]
    loop = [(100 + i, 2, f"c{i}", f"C{(i + 1) % 5}") for i in range(5)]
    tail = [(90 - i, 2, f"t{i}", f"t{i - 1}" if i else "c3") for i in range(11)]
    own = [(200, 3, "self", "self"), (201, 3, "x", "gone"), (202, 3, "x", None), (203, 3, "y", " "), (204, None, "z", "x"), (205, 3, None, "x"), (206, 3, "", "x")]
    rows = chain + loop + tail + own
    random.Random(1).shuffle(rows)
    check(spark, rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 2), st.sampled_from("abcdefgh"), st.sampled_from(["", None, *"abcdefgh"])), min_size=1, max_size=14))
def test_random_graphs(spark, rows):
    check(spark, [(i, *r) for i, r in enumerate(rows)])


def test_empty(spark):
    assert solve(spark, []).count() == 0


def test_paths_and_descendants(spark):
    rows = [(1, 1, "a", None), (2, 1, "b", "a"), (3, 1, "c", "b"), (4, 1, "d", "c"), (5, 1, "l", "l")]
    got = {r.row_id: (r.root, list(r.chain)) for r in solve(spark, rows, with_path=True).collect()}
    assert got == {1: (1, []), 2: (1, [2]), 3: (1, [3, 2]), 4: (1, [4, 3, 2]), 5: (5, [])}
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    _, solved = hierarchy.resolve_links(hierarchy.link_nodes(df, "dep_id", "scan_id", "name", "parent"), with_path=True)
    pairs = sorted(map(tuple, hierarchy.descendants(solved).collect()))
    assert pairs == [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 3, 1), (2, 4, 2), (3, 4, 1)]


def test_hot_name(spark):
    """A third of all rows share one name; its node is looked up by a broadcast."""
    check(spark, [(i, 1, "hot" if i % 3 == 0 else f"n{i}", "hot" if i % 3 == 1 else None) for i in range(600)])
