import random
import re

from lumenta.llm import mixing


def by_hand(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Give by weight, cut at the caps, give the excess to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=str.encode) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), share * sum(sizes.values())
    free = [s for s in names if sizes[s]]
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = sum(max(0, target[s] - cap * sizes[s]) for s in names)
        target = {s: min(target[s], cap * sizes[s]) for s in names}
        free = [s for s in free if target[s] < cap * sizes[s] - 1e-12]
    return target


def test_targets_follow_the_rounds_by_hand(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 7, 100, 1000, 40_000]) for s in [None, *"abcdefgh"[: rng.randint(1, 8)]]}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
        for s, t in by_hand(sizes).items():
            assert abs(got[s] - t) < 1e-6 * max(1, t), (sizes, got)


def test_mix_emits_what_the_plan_says(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice("abbbb")) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(df).collect()
    for s in "ab":
        own = [r for r in plan if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 0.06 * own[0].target
    assert all(0 <= r.copies <= 2 for r in plan)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert sorted(mixing.mix(df).collect()) == sorted(mixed.collect())


def test_salted_join_gives_the_same(spark, odd, monkeypatch):
    want = sorted(map(str, mixing.plan(odd("extra")).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.plan(odd("extra")).collect())) == want


def test_odd_rows(odd, none):
    for extra in ("size", "target", "copies", "Source_Size"):
        got = mixing.plan(odd(extra)).collect()
        assert len(got) == 9
        assert sorted(r.asDict()["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got)
        assert mixing.mix(odd(extra)).columns == odd(extra).columns
    assert mixing.plan(none).count() == mixing.mix(none).count() == 0
