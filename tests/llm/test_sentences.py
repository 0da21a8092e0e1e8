"""Sentence units of made-up pages in several scripts and layouts."""

import numpy as np
import pytest

from chronolake.llm import sentences as S

BODY = [
    "The bell rang. Their dog slept near the wooden gate. A man called on Mrs. Brown at 5 p.m. with his dog. The dog left the man.",
    "Prof. Hill met Mrs. Brown. The man saw the bell near St. Anne. Their gate was in the way, and one dog slept. Mrs. Grey left. A bell rang.",
    "He paid 43 ft. in all. The gate was shut by Prof. Hill and Mrs. Grey. Its bell rang at 6 p.m. on their way. The man slept.",
    "Then one saw the man and the dog and their gate when its bell and a man and the bell of their dog left the way and a gate of the man and its dog and their man in the way to the gate of a dog and its bell.",
] * 20


def lexicon_of(texts):
    """What a corpus says about words, as the two passes over tables make it."""
    counter = S.Counter_()
    for t in texts:
        counter.add(t)
    word, behind, counts = counter.rows()
    own = behind == S.PLAIN
    opens = set(word[own & (counts[:, 1] >= 0.5 * counts[:, 0])].tolist())
    inside, small = dict.fromkeys(word[own].tolist(), 0), dict.fromkeys(word[own].tolist(), 0)
    for w, b, n in zip(word[~own].tolist(), behind[~own].tolist(), counts[~own, 0].tolist(), strict=True):
        inside[w] += n if b not in opens else 0
        small[w] += n if b == S.SMALL else 0
    order = np.argsort(word[own])
    keys = word[own][order]
    return S.Lexicon(keys, S.shares_of(counts[own][order], np.array([inside[k] for k in keys.tolist()]), np.array([small[k] for k in keys.tolist()])))


@pytest.fixture(scope="module")
def lex():
    return lexicon_of(BODY)


def units(text, lex, lines=None):
    return [u for _, u in sorted(S.page_units(text, S.boxes_of(lines), lex))]


def box(x, y, height=20, width=400):
    return {"x0": x, "y0": y, "x1": x + width, "y1": y + height}


def test_abbreviations_numbers_and_ends(lex):
    text = "A man called on Mrs. Brown at 5 p.m. with 3.50 in hand. The dog met Prof. Hill! Their gate was shut? The bell rang"
    assert units(text, lex) == ["A man called on Mrs. Brown at 5 p.m. with 3.50 in hand.", "The dog met Prof. Hill!", "Their gate was shut?", "The bell rang"]


def test_quotations_and_brackets_are_not_cut(lex):
    text = 'Their dog slept. "The bell rang in the way. Their man left!" said the dog near the gate. The man (one dog. The gate) left the way.'
    assert units(text, lex) == ["Their dog slept.", '"The bell rang in the way. Their man left!" said the dog near the gate.', "The man (one dog. The gate) left the way."]


def test_misread_and_lost_marks(lex):
    text = "The bell rang near the gate· Their dog slept in the way with the man The dog left the wooden gate in all"
    assert units(text, lex) == ["The bell rang near the gate·", "Their dog slept in the way with the man", "The dog left the wooden gate in all"]


def test_scripts(lex):
    assert units("旧的船舶送达。安静教师出售慢慢！这座重的『收集』市场打开。", lex) == ["旧的船舶送达。", "安静教师出售慢慢！", "这座重的『收集』市场打开。"]
    assert units("यह पुल था धीरे और वह। एक नाव खोला पर यह पुल?", lex) == ["यह पुल था धीरे और वह।", "एक नाव खोला पर यह पुल?"]
    assert units("هذا نهر رفض ذلك خياط. ذلك برج عبر هذا جسر؟", lex) == ["هذا نهر رفض ذلك خياط.", "ذلك برج عبر هذا جسر؟"]
    assert units("นี้ทองแดงนับจากนี้แคบร้าน นั้นเรือข้ามฟากขนเกือบโดย เลขที่ 746 ตลาดหนัก", lex) == ["นี้ทองแดงนับจากนี้แคบร้าน", "นั้นเรือข้ามฟากขนเกือบโดย เลขที่ 746 ตลาดหนัก"]


def test_headings_and_adverts_are_blocks(lex):
    lines = ["THE BELL RANG", "The dog slept near", "Buy one dog", "the wooden gate in the way.", "Their man left. The gate", "was shut in all"]
    boxes = [box(60, 100, 54), box(82, 200), box(105, 230, 30), box(60, 270), box(60, 300), box(60, 330)]
    got = units("\n".join(lines), lex, boxes)
    assert got == ["THE BELL RANG", "Buy one dog", "The dog slept near\nthe wooden gate in the way.", "Their man left.", "The gate\nwas shut in all"]


def test_columns_that_alternate(lex):
    left = ["The bell rang near the", "wooden gate in the way.", "Their dog slept. The man", "left the gate in all"]
    right = ["A man called on the dog", "with his bell. Their gate", "was shut by the dog. Its", "bell rang in the way"]
    lines, boxes = [], []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        lines += [a, b]
        boxes += [box(60, 100 + 30 * i), box(600, 100 + 30 * i)]
    got = set(units("\n".join(lines), lex, boxes))
    assert {"The bell rang near the\nwooden gate in the way.", "Their dog slept.", "Their gate\nwas shut by the dog."} <= got


def test_lines_that_run_through_two_columns(lex):
    """Merged lines are cut at the gutter, also where only right halves of a column are seen or a box is empty."""
    lines = ["The bell rang near the   A man called on the dog", "wooden gate in the way. | with his bell. Their gate", "Their dog slept. The man     was shut.", "left the gate in all. | Its bell rang in the way"]
    boxes = [box(60, 100 + 30 * i, 160, 900) for i in range(3)] + [box(60, 190, 0, 0)]
    for first in ([], [("The way.", box(82, 70, 20, 120))]):
        got = units("\n".join([x for x, _ in first] + lines), lex, [b for _, b in first] + boxes)
        assert {"The bell rang near the\nwooden gate in the way.", "Their dog slept.", "The man\nleft the gate in all.", "A man called on the dog\nwith his bell.", "Their gate\nwas shut.", "Its bell rang in the way"} <= set(got)


def test_odd_pages(lex):
    assert S.sentence_ends(None, None, lex) == S.sentence_ends("", None, lex) == S.sentence_ends(" \n ", None, lex) == []
    assert S.sentence_ends("x", None, lex) == [1]
    assert S.sentence_ends("...", None, lex) == [3]
    long = "The bell rang near the gate. " * 3000
    assert S.sentence_ends(long, None, lex)[-1] == len(long) - 1 and len(S.sentence_ends(long, None, lex)) == 3000
    assert len(S.sentence_ends("a " * 20000, None, lex)) == 1
    assert S.sentence_ends("The bell rang.\nA dog slept.", ([1], [2], [3], [4]), lex) == [14, 27]  # boxes that do not fit


def test_ends_are_code_points(lex):
    text = "The bell 🔔 rang near the gate. Their dog 🐕 slept."
    assert S.sentence_ends(text, None, lex) == [text.index("gate.") + 5, len(text)]


def test_pages_of_a_table(spark):
    line = "struct<x0:int,y0:int,x1:int,y1:int,conf:float>"
    pages = [(1, BODY[0], None, "a"), (1, BODY[0], None, "b"), (2, None, None, "a"), (3, "", [], "a"), (4, "THE BELL\nThe dog slept\nnear the gate", [(60, 0, 300, 54, None), None, (60, 90, 300, 110, None)], "a"), (5, BODY[1] + "\nx", [None, (1, None, 3, 4, 0.5)], "a")]
    df = spark.createDataFrame(pages, f"doc_id bigint, text string, lines array<{line}>, sent_end string")
    got = S.sentences(df, with_text=True).collect()
    ends = {}
    for x in got:
        ends.setdefault(x.doc_id, []).append(x.sent_end)
    assert ends.keys() == {1, 4, 5} and sorted(ends[4]) == [8, 36] and len(ends[1]) == len(set(ends[1]))
    assert S.sentences(df.limit(0)).count() == 0


def test_a_sentence_of_many_candidates_is_not_cut_by_force(lex, monkeypatch):
    """Forty places at which a sentence might end, each worse than none, all inside one sentence."""
    s = "The man met " + " and ".join(f"x{i}." for i in range(40)) + " there. The bell rang."
    inner = [i + 1 for i, c in enumerate(s[:-24]) if c == "."]
    monkeypatch.setattr(S, "_candidates", lambda text, _: [(i, -3.0, i) for i in inner if i < s.index(" there")] + [(s.index(" The bell"), 6.0, s.index(" The bell") + 1)])
    assert S.segment(s, lex) == [s.index(" The bell"), len(s)]


def test_quotations_of_several_sentences_are_not_cut(lex):
    quotation = "“The bell rang. Their dog slept near the gate! The man saw the bell! A man called the dog.”"
    assert units(f"{quotation} The gate was shut.", lex) == [quotation, "The gate was shut."]
    assert "「狗在门边。人走了！钟响了！门关了。」" in units("他说「狗在门边。人走了！钟响了！门关了。」那人走了。", lex)[0]
    assert units("“The bell rang. The dog slept near the gate. The man saw the bell.", lex)[1:] == ["The dog slept near the gate.", "The man saw the bell."]


@pytest.mark.parametrize("n", [3, 10, 60])
@pytest.mark.parametrize("sentence,opening,closing,behind", [
    ("The bell rang near the gate. ", "“", "”", "The dog slept in all the way."), ("The bell rang near the gate. ", "(", ")", "The dog slept in all the way."),
    ("狗在门边睡了。", "「", "」", "钟响了一天。"), ("狗在门边睡了。", "（", "）", "钟响了一天。"), ("यह पुल था धीरे और वह। ", "“", "”", "एक नाव खोला पर यह पुल।"), ("هذا نهر رفض ذلك خياط. ", "«", "»", "ذلك برج عبر هذا جسر."), ("Собака спала у ворот! ", "«", "»", "Он ушёл домой."),
])
def test_long_quotations_and_brackets_are_not_cut(lex, n, sentence, opening, closing, behind):
    quoted = opening + (sentence * n).strip() + closing
    got = units(f"{quoted} {behind}", lex)
    assert got[-1] == behind and "".join(got[:-1]) == quoted


def test_words_are_learned_not_listed():
    """Months behind ordinal numbers, and who said it behind quotations, from their places in the corpus alone."""
    told = [f"Der Mann kam am {d}. Brumal an die Tür." for d in range(1, 20)] + ["Die Frau ging. Der Hund schlief. Im Brumal war es kalt."] * 3
    said = ["「狗走了。」他曰。门关了。", "「钟响了！」她曰。", "「人来了。」众人曰。狗在门边。"] * 6
    lex = lexicon_of(BODY + told + said)
    assert units("Der Mann kam am 7. Brumal an die Tür. Der Hund schlief.", lex) == ["Der Mann kam am 7. Brumal an die Tür.", "Der Hund schlief."]
    assert units("「门关了。」老人曰。狗在门边睡了。", lex) == ["「门关了。」老人曰。", "狗在门边睡了。"]
    assert units("「门关了。」狗在门边睡了整整一天一夜。", lex) == ["「门关了。」", "狗在门边睡了整整一天一夜。"]


def test_counting_in_parts_gives_the_same_lexicon(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(BODY + ["「狗走了。」他曰。门关了。"] * 9)], "doc_id bigint, text string")
    a, b = S.lexicon(df.repartition(7)), lexicon_of([r.text for r in df.collect()])
    assert np.array_equal(a.keys, b.keys) and np.array_equal(a.shares, b.shares)
