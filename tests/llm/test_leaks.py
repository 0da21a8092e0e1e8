"""Leaked passages in pages made for the purpose."""

import random

import numpy as np
import pytest

from chronolake.llm import leaks
from chronolake.llm.letters import letters

WORDS = "harbour lantern meadow quarry bridge kettle wooden narrow doctor carriage famous timber orchard steeple council winter closed reached delivered under before their muddy crooked yellow island parcel ribbon".split()


def passage(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def world():
    r = random.Random(11)
    items = [(100 + i, passage(r, 70)) for i in range(12)] + [(200, "旧的租户答应在商店一个教群木材修理这座花园与那些租户答应又这座大麦冬天莫文先生出售但这座森林并医院收集从那些石户把一个狭窄霜房街道"), (300, ""), (301, None)]
    return r, items


def run(spark, items, pages):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(pages)], "doc_id bigint, text string, item_id string")
    return {(x.doc_id, x.item_id): x for x in leaks.leaks(docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")).collect()}


def test_finds_whole_partial_and_damaged_passages(spark, world):
    r, items = world
    words = items[0][1].split()
    noisy = [("xxxxxx" if i % 9 == 4 else w) for i, w in enumerate(words) if i % 17 != 3]
    lines = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
    broken = items[1][1].upper().replace(" ", "\n").replace("O", "O-\n")
    shuffled = words[:]
    r.shuffle(shuffled)
    fill = lambda n=60: passage(r, n)
    pages = [
        fill() + " " + items[0][1] + " " + fill(),
        fill() + " " + " ".join(noisy) + " " + fill(),
        "\n".join(x + " | " + passage(r, 5) for x in lines),
        fill() + " " + broken,
        " ".join(words[:20]) + " " + fill(35) + " " + " ".join(words[20:]),
        fill() + " " + " ".join(words[20:50]) + " " + fill(),
        fill() + " " + " ".join(words[20:33]) + " " + fill(),
        " ".join(shuffled),
        fill(300),
        "一个木" + items[12][1][5:40] + "塔高",
        "", None, "x", items[0][1] + " " + items[1][1],
    ]
    got = run(spark, items, pages)
    assert set(got) == {(0, 100), (1, 100), (2, 100), (3, 101), (4, 100), (5, 100), (9, 200), (13, 100), (13, 101)}
    n = len(letters([items[0][1]])[0])
    assert got[0, 100].longest == n and got[0, 100].share == 1.0


def test_blocks_of_items_find_the_same(spark, world, monkeypatch):
    _, items = world
    pages = [items[3][1], items[5][1] + " " + items[6][1], "nothing here"]
    whole = set(run(spark, items, pages))
    monkeypatch.setattr(leaks, "BLOCK_LETTERS", 600)
    assert set(run(spark, items, pages)) == whole == {(0, 103), (1, 105), (1, 106)}


def test_very_long_pages_are_read_whole(world, monkeypatch):
    """Pages of many shards: passages at either end, in the middle and across a joint, in parts far from each other."""
    find = lambda pages: {x[:2] for x in leaks.search([block], list(range(len(pages))), pages)}
    r, items = world
    long = passage(r, 4000)
    words = items[6][1].split()
    apart = " ".join(words[:20]) + " " + long[:20000] + " " + " ".join(words[20:45])
    pages = [long + " " + items[4][1], items[4][1] + " " + long, long[:9000] + " " + items[4][1] + " " + long[9000:], long, "their wooden gate " * 4000, long[:4800] + " " + items[5][1] + long[:400], apart]
    block = leaks.Items([i for i, _ in items], [t for _, t in items])
    whole = find(pages)
    monkeypatch.setattr(leaks, "SHARD_CHARS", 5000)
    parts = {x[:2] for i, t in enumerate(pages) for x in leaks.search_long([block], i, t)}
    assert parts == whole == {(0, 104), (1, 104), (2, 104), (5, 105), (6, 106)}


def test_empty_tables_and_repeated_rows(spark, world):
    _, items = world
    assert run(spark, [], ["a page"]) == {} and run(spark, items, []) == {}
    docs = spark.createDataFrame([(1, items[0][1]), (1, items[0][1]), (2, "clean")], "doc_id bigint, text string")
    table = spark.createDataFrame([(i, t) for i, t in items], "item_id bigint, text string")
    found = leaks.leaks(docs, table.unionAll(table))
    assert found.count() == 1
    assert [x.doc_id for x in leaks.without_leaks(docs, found).collect()] == [2]


def made(texts):
    return leaks.SuffixArray(*letters(texts))


def test_suffixes_are_sorted(world):
    r, items = world
    for texts in (["banana bandana", "ana", "", "banana bandana", "b"], [passage(r, 200), "ab" * 300, passage(r, 5)], ["旧的租户答应旧的租户", "租"]):
        s = made(texts)
        page = [chr(c) for c in s.alphabet]
        suffix = lambda i: "".join(page[c - 1] for c in s.code[i : i + list(s.code[i:]).index(0)])
        own = [suffix(i) for i in s.array if s.code[i]]
        assert own == sorted(own) and len(own) == len(letters(texts)[0])


def test_matches_are_the_longest(world, monkeypatch):
    """Every maximal verbatim match of at least the seed's length, as brute force finds it, however few are looked at at once."""
    r, items = world
    texts = [passage(r, 30) + " " + items[2][1][40:160] + " " + passage(r, 10), "", passage(r, 40), "do " * 60]
    items = [*items, (400, "do " * 30)]
    block = leaks.Items([i for i, _ in items], [t for _, t in items])
    flat, at = letters(texts)
    for at_once in (leaks.AT_ONCE, 7):
        monkeypatch.setattr(leaks, "AT_ONCE", at_once)
        got = [tuple(map(int, x)) for x in zip(*made(texts).matches(block), strict=True)]
        want = set()
        for page in range(len(texts)):
            p = flat[at[page] : at[page + 1]]
            for k, (_, t) in enumerate(items):
                q = letters([t])[0]
                same = p[:, None] == q[None, :]
                for a, b in zip(*np.nonzero(same), strict=True):
                    if a and b and same[a - 1, b - 1]:
                        continue
                    n = 0
                    while a + n < len(p) and b + n < len(q) and same[a + n, b + n]:
                        n += 1
                    if n >= block.seeds[k]:
                        want.add((page, k, int(a), int(b), n))
        assert set(got) == want and len(got) == len(want)


def test_periodic_pages_form_no_pairs(world):
    """An item and a page of one period match at every other letter; only what begins at an end is kept."""
    block = leaks.Items([1], ["do " * 200])
    page, item, p, q, n = made(["do " * 20000]).matches(block)
    assert len(page) <= 20000 + 200 and n.max() == 400
    assert [x[:4] for x in leaks.search([block], [7], ["do " * 20000])] == [(7, 1, 0, 400)]


def test_letters_fold():
    flat, at = letters(["Éa1-Ω ß", None, "ПО́р"])
    assert [chr(c) for c in flat] == ["e", "a", "ω", "s", "п", "o", "p"] and at.tolist() == [0, 4, 4, 7]


def test_columns_that_alternate_are_read_in_their_order(spark, world):
    """A passage of just over a third runs from the foot of column 1 to the head of column 2; the lines alternate."""
    r, items = world
    words = items[7][1].split()[20:47]
    lines = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)]
    fill = lambda: passage(r, 4)
    left, right = [*[fill() for _ in range(16)], *lines[:4]], [*lines[4:], *[fill() for _ in range(17)]]
    text = "\n".join(x for pair in zip(left, right, strict=True) for x in pair)
    boxes = [(x, 30 * i, x + 400, 30 * i + 20, 0.9) for i in range(20) for x in (0, 500)]
    shape = "doc_id bigint, text string, lines array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"
    docs = spark.createDataFrame([(1, text, boxes), (2, text, None)], shape)
    found = leaks.leaks(docs, spark.createDataFrame([(i, t) for i, t in items], "item_id bigint, text string"))
    assert [(x.doc_id, x.item_id) for x in found.collect()] == [(1, 107)]


def test_short_items_and_pieces_of_ten_letters_are_found(spark, world):
    """Items of 29 and 12 letters held by ten and four of them, and a third of a long item whose pieces have 11 letters."""
    r, items = world
    whole = letters([items[8][1]])[0]
    n = len(whole)
    cut = "".join(map(chr, whole[30 : 30 + n // 3 + 8]))
    pieces = "".join(c if i % 12 != 11 else "ж" for i, c in enumerate(cut))
    short = [(300, "vexing zephyrs jumbled quick flaxy"), (301, "qzvx kwjy pfgb"), (302, "旧的租户答应在商店修理")]
    pages = [passage(r, 30) + " zephyrsjum " + passage(r, 30), "a qzvx b", passage(r, 30) + " " + pieces + " " + passage(r, 30), passage(r, 60), "塔答应在商高"]
    assert set(run(spark, [items[8], *short], pages)) == {(0, 300), (1, 301), (2, 108), (4, 302)}


def test_no_chain_scores_more_than_its_bounds(monkeypatch):
    """The bounds before the chain lose nothing, and many matches chain as few do."""
    r = np.random.default_rng(5)
    for _ in range(400):
        n, unit = int(r.integers(1, 14)), float(r.choice([1.0, 0.4]))
        q, length = r.integers(0, 150, n), r.integers(9, 30, n)
        p = np.where(r.random(n) < 0.5, q + 40 + r.integers(-9, 9, n), r.integers(0, 1500, n))
        order = np.lexsort((q, p))
        p, q, length = p[order], q[order], length[order]
        few = [x[0] for x in leaks._chains(np.array([0]), np.array([n]), p, q, length, unit, np.array([200]))]
        with monkeypatch.context() as m:
            m.setattr(leaks, "WIDTH", 0)
            many = [x[0] for x in leaks._chains(np.array([0]), np.array([n]), p, q, length, unit, np.array([200]))]
        assert many[0] == pytest.approx(few[0])
        pair = np.zeros(n, np.int64)
        assert few[0] <= leaks._covered(pair, q, length, 1)[0] + 1e-9
        assert few[0] <= leaks._bound(pair, p, q, length, 1, unit)[0] + 1e-9


def test_passages_with_misread_letters_are_found(spark, world):
    """Two fifths of an item, a tenth of whose letters are misread, and the whole with a seventh, far apart in parts."""
    r, items = world
    noise = lambda s, share: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and r.random() < share else c for c in s)
    pages, want = [], set()
    for k in range(60):
        i, t = items[k % 12]
        n = len(t) * 2 // 5
        a = r.randrange(len(t) - n)
        pages.append(passage(r, 40) + " " + (noise(t[a : a + n], 0.1) if k % 2 else noise(t, 0.14)) + " " + passage(r, 40))
        want.add((k, i))
    apart = items[3][1]
    pages.append((" " + passage(r, 400) + " ").join(apart[x : x + len(apart) // 4] for x in range(0, len(apart), len(apart) // 4)))
    got = set(run(spark, items, pages))
    assert len(got & want) >= 54 and not got - want - {(60, items[3][0])} and (60, items[3][0]) in got


def scattered(r, n):
    """One pair of n matches in order, near each other or not, as its starts, sizes, places and lengths."""
    q, length = r.integers(0, 150, n), r.integers(9, 30, n)
    p = np.where(r.random(n) < 0.5, q + 40 + r.integers(-9, 9, n), r.integers(0, 1500, n))
    order = np.lexsort((q, p))
    return np.array([0]), np.array([n]), p[order], q[order], length[order]


def test_no_chain_scores_more_than_its_ceiling(monkeypatch):
    """Alone or beside others, and no pair that has a chain is left out, by the ceiling or by the bounds of many matches."""
    r = np.random.default_rng(6)
    for unit in (1.0, 0.4):
        pairs = [scattered(r, int(r.integers(1, 40))) for _ in range(300)]
        sizes = np.concatenate([x[1] for x in pairs])
        starts, (p, q, length) = np.cumsum(sizes) - sizes, (np.concatenate([x[k] for x in pairs]) for k in (2, 3, 4))
        letters_ = r.integers(200, 900, len(pairs))
        score = leaks._chains(starts, sizes, p, q, length, unit, letters_)[0]
        ceiling = leaks._ceilings(starts, sizes, p, q, length, unit)
        assert (score <= ceiling + 1e-4).all()
        assert ceiling == pytest.approx(np.concatenate([leaks._ceilings(*x, unit) for x in pairs]))
        has = set(np.flatnonzero(score >= leaks.CHAIN * letters_))
        for ceiled in (leaks.CEILED, 8, 0):
            monkeypatch.setattr(leaks, "CEILED", ceiled)
            got = leaks._promising(starts, sizes, p, q, length, unit, letters_)
            assert has <= set(got) and (np.diff(got) > 0).all()
        monkeypatch.undo()


def test_scattered_likeness_is_not_chained(monkeypatch):
    """Pages and items of the same words in other orders: hardly a pair is followed step by step, and what is held is found."""
    r = random.Random(4)
    words = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 5))) for _ in range(150)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(55) for _ in range(20)]
    pages = [text(400) for _ in range(30)] + [text(100) + " " + items[3][:200] + " " + text(100)]
    chained, chains = [], leaks._chains
    monkeypatch.setattr(leaks, "_chains", lambda starts, *rest: chained.append(len(starts)) or chains(starts, *rest))
    found = leaks.search([leaks.Items(list(range(20)), items)], list(range(31)), pages)
    assert [x[:2] for x in found] == [(30, 3)]
    assert sum(chained) <= 31


def test_places_beyond_one_number_are_sorted():
    r = np.random.default_rng(7)
    for top in (50, 1 << 17):
        four = [np.r_[top, r.integers(0, 4, 200)] for _ in range(4)]
        assert [tuple(x[i] for x in four) for i in leaks._order(*four)] == sorted(zip(*four, strict=True))
