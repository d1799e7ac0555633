from collections import Counter, defaultdict
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import packing


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 14), st.dictionaries(st.integers(1, 14), st.integers(1, 3), min_size=1, max_size=4))
def test_fullest_equals_brute_force(capacity, counts):
    counts = {n: c for n, c in counts.items() if n <= capacity}
    if not counts:
        return
    chosen = packing.fullest(capacity, counts)
    assert all(u <= counts[n] for n, u in chosen.items()) and max(counts) in chosen
    fills = [sum(n * u for n, u in zip(counts, c)) for c in product(*[range(c + 1) for c in counts.values()]) if c[list(counts).index(max(counts))] > 0]
    assert sum(n * u for n, u in chosen.items()) == max(f for f in fills if f <= capacity)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.dictionaries(st.integers(0, 40), st.integers(1, 60), max_size=12))
def test_plan_places_every_rank_once(capacity, histogram):
    histogram = {n: c for n, c in histogram.items() if n <= capacity}
    fill, seen, placed = Counter(), Counter(), Counter()
    for n, first, ranks, container, per, place in packing.plan(capacity, histogram):
        assert first == seen[n]
        seen[n] += ranks
        for r in range(ranks):
            at = (r % per, place + r // per) if n == 0 else (container + r // per, place + r % per)
            placed[at] += 1
            fill[at[0]] += n
    assert seen == Counter(histogram) and set(placed.values()) <= {1} and all(f <= capacity for f in fill.values())


def test_pack_on_rows(spark):
    sizes = [(i, (i * 37) % 90) for i in range(300)] + [(1000, 250), (1001, None), (1002, 0), (5, 5)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, "doc_id", "n_tokens", [(1, 100), (2, 7)]).collect()
    for capacity_id, capacity in ((1, 100), (2, 7)):
        own = [r for r in rows if r.capacity_id == capacity_id]
        fill, docs = Counter(), defaultdict(list)
        for r in own:
            fill[r.container_id] += r["size"]
            docs[r.doc_id].append((r.piece, r["size"]))
        assert max(fill.values()) <= capacity
        assert len({(r.container_id, r.place) for r in own}) == len(own)
        for i, n in dict(sizes).items():
            if i == 5:
                continue
            parts = [s for _, s in sorted(docs[i])]
            assert sum(parts) == (n or 0) and all(s == capacity for s in parts[:-1])
            assert len(parts) == max(1, -(-(n or 0) // capacity))
        total = sum(n or 0 for _, n in sizes)
        assert len(fill) <= -(-total // capacity) + 2
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", [(1, 100)]).count() == 0


def test_slack(spark):
    df = spark.createDataFrame([(1, 60), (2, 60), (3, 40), (4, 0), (5, 250)], "doc_id bigint, n_tokens bigint")
    packed = packing.pack(df, "doc_id", "n_tokens", [(1, 100), (2, 1000)])
    got = {r.capacity_id: (r.capacity, r.containers, r.least, r.unused, r.overfull) for r in packing.slack(packed, [(1, 100), (2, 1000)]).collect()}
    assert got == {1: (100, 5, 5, 90, 0), 2: (1000, 1, 1, 590, 0)}
