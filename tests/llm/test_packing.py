import random
from collections import Counter
from itertools import product

import pytest

from chronolake.llm import packing


def brute_fill(counts, room):
    sizes = list(counts)
    return max((t for c in product(*[range(counts[s] + 1) for s in sizes]) if (t := sum(n * s for n, s in zip(c, sizes, strict=True))) <= room), default=0)


def test_best_fill_is_the_best():
    r = random.Random(4)
    for _ in range(300):
        counts = {r.randrange(1, 30): r.randrange(0, 4) for _ in range(r.randrange(1, 6))}
        room = r.randrange(0, 60)
        total, taken = packing.best_fill(counts, sorted(counts, reverse=True), room)
        assert total == brute_fill(counts, room) == sum(s * n for s, n in taken.items())
        assert all(0 < n <= counts[s] for s, n in taken.items())


def test_plan_uses_every_item_once():
    r = random.Random(5)
    for _ in range(40):
        counts = {r.randrange(1, 101): r.randrange(0, 20) for _ in range(r.randrange(0, 40))}
        plans = packing.plan(counts, 100)
        used = Counter()
        for times, pattern in plans:
            assert times > 0 and sum(s * n for s, n in pattern.items()) <= 100
            for s, n in pattern.items():
                used[s] += times * n
        assert used == Counter({s: n for s, n in counts.items() if n})
        rooms: list[int] = []
        for size in sorted(Counter(counts).elements(), reverse=True):  # first fit decreasing
            i = next((i for i, room in enumerate(rooms) if room >= size), None)
            if i is None:
                rooms.append(100 - size)
            else:
                rooms[i] -= size
        assert sum(t for t, _ in plans) <= len(rooms) * 1.03 + 1


@pytest.mark.parametrize("n,seed", [(0, 0), (1, 1), (50, 2), (3000, 3)])
def test_pack(spark, n, seed):
    r = random.Random(seed)
    data = [(r.choice([None, i, i, 7]), r.choice([0, 1, 13, 13, 13, r.randrange(1, 64), r.randrange(1, 400), 64, 128])) for i in range(n)]
    got = packing.pack(spark.createDataFrame(data, "doc_id bigint, n_tokens bigint").repartition(3), 64).collect()
    fill, pieces = Counter(), Counter()
    for x in got:
        if x.n_tokens:
            fill[x.container_id] += x.n_tokens
        else:
            assert x.container_id is None
    assert all(0 < v <= 64 for v in fill.values())
    assert sorted(fill) == list(range(len(fill)))
    for d, size in data:
        for p in [64] * (size // 64) + ([size % 64] if size % 64 or not size else []):
            pieces[d, p] += 1
    assert pieces == Counter((x.doc_id, x.n_tokens) for x in got)
    if n > 1000:
        assert sum(fill.values()) / (64 * len(fill)) > 0.97


def test_token_counts(spark):
    texts = ["", None, "hello world", "Привет, мир! <|endoftext|>", "文" * 20000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    encode = packing._encoding(packing.tokenizer_path()).encode_ordinary
    assert {x.doc_id: x.n_tokens for x in packing.token_counts(df).collect()} == {i: len(encode(t)) if t else 0 for i, t in enumerate(texts)}
