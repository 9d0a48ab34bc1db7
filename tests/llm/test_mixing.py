import random
from collections import Counter

from quillon.llm import mixing


def test_windows_hold_for_any_weights():
    rng = random.Random(2)
    for _ in range(60):
        weights = {f"s{i}": rng.randrange(1, 30) for i in range(rng.randrange(1, 9))}
        slots = mixing.period_slots(weights)
        period = sum(weights.values())
        assert sorted(t for s in slots.values() for t in s) == list(range(period))
        for s, own in slots.items():
            for t in range(period + 1):
                assert abs(sum(x < t for x in own) - t * weights[s] / period) < 1
            for k, t in enumerate(own):
                assert k * period // weights[s] <= t < -(-(k + 1) * period // weights[s])


def data():
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(i, None) for i in range(900, 950)]
    return rows + rows[:2]


def test_all_rows_once_and_near_their_weights(spark):
    weights = {"hot": 6, "s0": 2, "s3": 1, None: 3, "s6": 0}
    df = spark.createDataFrame([(*r, 1) for r in data()], "doc_id long, source string, Position int")
    got = sorted(mixing.mix(df, weights, block_rows=8).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(data())))
    assert Counter((r.doc_id, r.source) for r in got) == Counter(data())
    assert len({(r.block, r.source) for r in got}) == len({r.block for r in got})
    blocks = {r.block: r.source for r in got}
    order = [blocks[b] for b in sorted(blocks)]
    w = {s: weights.get(s, 1) for s in {r[1] for r in data()}}
    seen, total = Counter(), sum(w.values())
    first_end = min(max(i for i, s in enumerate(order) if s == x) for x in w if w[x])
    for t, s in enumerate(order[: first_end + 1], 1):  # until a source ends
        seen[s] += 1
        assert all(abs(seen[x] - t * w[x] / total) < 1 for x in w)
    assert [s for s in order if s == "s6"] == order[-order.count("s6") :]  # of weight 0: last


def test_defaults_and_edges(spark):
    df = spark.createDataFrame(data(), "doc_id long, source string")
    assert sorted(r.position for r in mixing.mix(df).collect()) == list(range(len(data())))
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r.position for r in mixing.mix(df.limit(1)).collect()] == [0]


def test_more_sources_than_are_scheduled_alone(spark):
    rows = [(i, f"d{i % 2500}") for i in range(3000)] + [(3000 + i, "large") for i in range(3000)] + [(6000 + i, None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in (None, {"large": 2500, "d7": 0}):
        got = sorted(mixing.mix(df, weights, block_rows=8).collect(), key=lambda r: r.position)
        assert [r.position for r in got] == list(range(len(rows)))
        assert Counter((r.doc_id, r.source) for r in got) == Counter(rows)
        blocks = [r.block for r in got]
        assert blocks == sorted(blocks) and set(blocks) == set(range(blocks[-1] + 1)) and max(Counter(blocks).values()) <= 8
    half = sum(r.source == "large" for r in got[:2000])
    assert abs(half - 1000) <= 50  # 2500 of 5,000 parts
    assert got[-1].source == "d7"


def test_a_groups_sources_by_weight(spark, monkeypatch):
    for name, value in (("MOST_SOURCES", 5), ("ALONE", 1), ("GROUPS", 1)):
        monkeypatch.setattr(mixing, name, value)
    df = spark.createDataFrame([(i, f"s{i % 10}") for i in range(2000)], "doc_id long, source string")
    weights = {f"s{i}": 1 + i for i in range(10)}
    got = sorted(mixing.mix(df, weights, block_rows=4).collect(), key=lambda r: r.position)
    assert sorted(r.doc_id for r in got) == list(range(2000))
    inside = [r.source for r in got if r.source != "s0"][:400]
    assert all(abs(inside.count(f"s{i}") - 400 * (1 + i) / 54) <= 8 for i in range(1, 10))


def test_one_rule_for_any_number_of_sources(spark, monkeypatch):
    """How sizes reach the rows doesn't change the schedule."""
    df = spark.createDataFrame([(i, f"s{i % 150}") for i in range(1500)] + [(1500 + i, "large") for i in range(500)], "doc_id long, source string")
    for weights in (None, {"large": 40, "s3": 0}):
        want = sorted(map(tuple, mixing.mix(df, weights, block_rows=4).collect()))
        with monkeypatch.context() as m:
            m.setattr(mixing, "MOST_SOURCES", 10)
            assert sorted(map(tuple, mixing.mix(df, weights, block_rows=4).collect())) == want


def test_a_period_is_solved_no_further_than_needed():
    """The phases of a broken-off period are those of a whole one."""
    rng = random.Random(4)
    for _ in range(50):
        weights = {f"s{i}": rng.randrange(1, 40) for i in range(rng.randrange(1, 6))}
        rows = {s: rng.randrange(1, 200) for s in weights}
        at = []
        for p in mixing.schedule(rows, weights, 4):
            assert sum(map(len, p.slots.values())) <= p.period
            at += [p.start + (k - p.first[s]) // weights[s] * p.period * 4 + p.slots[s][(k - p.first[s]) % weights[s]] * 4 for s in p.slots for k in range(p.first[s], p.last[s])]
        assert len(at) == len(set(at)) == sum(-(-n // 4) for n in rows.values())
    assert sum(map(len, mixing.schedule({"a": 8, "b": 8}, {"a": 10**9, "b": 10**9}, 4)[0].slots.values())) <= 4
