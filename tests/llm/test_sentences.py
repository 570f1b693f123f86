"""Sentence boundaries on cases that matter, and the defined edge cases."""

import pytest
from pyspark.sql import functions as F

from scriptorium.llm.sentences import sentence_rows, spans


def cut(text):
    return [text[a:b] for a, b in spans(text)]


@pytest.mark.parametrize(
    "sentences",
    [
        ["Prior systems, e.g. Rookery and its variants, ignore it.", "p-values below 0.01 were rare.", "This is surprising!"],
        ["All data were collected in the U.S.", "By contrast, we train X on 8,112 samples (Tab. 4, col. 2)."],
        ["One annotator asked, \"Is it stable? It looks noisy.\" and we checked it again.", "\"Measure the cache first.\"", "(A proof is in App. B.)", "Why?"],
        ["No. 21 in the list is X; it was released by Dr. M. Ekwerim in 2018.", "The reviewers found it clear, but it was not... fully explained."],
        ["Un annotateur a demandé : « Est-il stable ? Il paraît bruité. » et nous avons revérifié.", "C'est surprenant !", "Il contient 5 éléments issus d'env. 8 laboratoires."],
        ["La reunión de las 9 a. m. en la calle S. Olan, dirigida por el Prof. X, resolvió la tasa.", "¿Cómo cambia?", "Todos se recogieron en EE. UU.", "Además, falló."],
    ],
)
def test_latin(sentences):
    assert cut(" ".join(sentences)) == sentences


@pytest.mark.parametrize(
    "sentences",
    [
        ["一位标注者写道“稳定吗？看起来有噪声。”，我们又核对了一遍。", "手册写道：“保持较低。”", "X需要11 GB内存。", "（更长证明见附录B。）", "参照F. Kapidisel et al. (2014)，我们报告。"],
        ["手引きには「低く保て。」とある。", "ある注釈者は「安定か？雑音が多い。」と書き、再確認した。", "「まず測れ。」", "なぜか？"],
        ["［译注：该术语依内部词表。］", "此外，词表……并未完全解释。"],
    ],
)
def test_without_spaces(sentences):
    assert cut("".join(sentences)) == sentences


def test_thai():
    parts = ["น่าเสียดายที่เราไม่สามารถเผยแพร่ Koltbank เนื่องจากกฎความเป็นส่วนตัว", "เมื่อตัดมุมผสมออก คะแนนลดจาก 63.6 เหลือ 21.8", "LovuniBench ถูกปรับด้วยมือและทดสอบบน Merid-QA สองครั้ง", '"วัดแคชก่อน"']
    assert cut(" ".join(parts)) == parts


def test_missing_space_and_case():
    assert cut("It failed on 27 of 76 inputs.The detector works.") == ["It failed on 27 of 76 inputs.", "The detector works."]
    assert cut('Adds the cache, etc."Measure it first."') == ["Adds the cache, etc.", '"Measure it first."']
    assert cut("we keep it. the manual says so.") == ["we keep it.", "the manual says so."]


def test_edges():
    assert spans(None) == spans("") == spans(" \n　") == []
    assert spans("  Related Work ") == [(2, 14)]
    assert cut("Discussion\nIt works.") == ["Discussion", "It works."]
    long = "This is a sentence that goes on. " * 20_000
    assert len(spans(long)) == 20_000
    assert len(spans("word " * 50_000)) == 1


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (1, "A b. C d."), (2, None), (3, "  "), (4, "😀 ok.")], "id long, t string").withColumn("start_pos", F.lit(9))
    got = sorted(map(tuple, sentence_rows(df, ["id"], "t").distinct().collect()))
    assert got == [(1, 0, 4), (1, 5, 9), (4, 0, 5)]
    assert sentence_rows(df.limit(0), ["id"], "t").count() == 0


@pytest.mark.parametrize("text", ["It needs 13 GB vs​. 428 MB for it.", "At 9 ‍a.m. o‍n St. Olan Road, hosted by ­Prof. X, it met.", "出人意料的是，­F. Kelehenova指出。"])
def test_unseen_characters(text):
    assert cut(text) == [text]


def test_missing_space_before_an_abbreviation():
    assert cut("It fell at Koltbank.No. 58 in the list is X.") == ["It fell at Koltbank.", "No. 58 in the list is X."]
    assert cut("FokeloAlign: การศึกษาอัตราภาษีและชั้นขอบเขต") == ["FokeloAlign: การศึกษาอัตราภาษีและชั้นขอบเขต"]


def test_the_best_spans_of_all():
    """Stopping early gives what looking at every span gives, also where spans are very long."""
    import random

    from scriptorium.llm import sentences as S

    def slow(text):
        n, first = len(text.rstrip()), len(text) - len(text.lstrip())
        places = [p for p in S._candidates(text) if first < p[0] < n and p[1] < n]
        at, depth = S._depths(text)
        starts, ends, gain = [first, *(p[1] for p in places)], [*(p[0] for p in places), n], [*(p[2] for p in places), 0.0]
        inside = [next((d for a, d in zip(reversed(at), reversed(depth), strict=True) if a < e), 0) for e in ends]
        best, back = [0.0], []
        for j, e in enumerate(ends):
            scores = []
            for i in range(j, -1, -1):
                before = inside[i - 1] if i else 0
                scores.append((best[i] + gain[j] + S._length(e - starts[i]) - (7.0 if inside[j] != before else 0.0) - (7.0 if before else 0.0), i))
            top = max(s for s, _ in scores)
            best.append(top)
            back.append(next(i for s, i in scores if s == top))
        out, j = [], len(ends)
        while j:
            out.append((starts[back[j - 1]], ends[j - 1]))
            j = back[j - 1]
        return out[::-1]

    rng = random.Random(5)
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(2, 25)):
            parts.append("The cache " + "is slow and " * rng.choice([0, 1, 5, 120, 260]) + rng.choice(["ends. ", "ends? but ", "(ends. ", "ends.) ", '"ends. ', 'ends." ', "ends... ", "etc. "]))
        text = "".join(parts) + '"'
        assert S.spans(text) == slow(text)


def test_marks_of_one_line():
    """The quick pattern finds what the whole one finds in texts of one line."""
    import random

    from scriptorium.llm import sentences as S

    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choices("aZ1.!?…。！ »\"-)\tน", k=rng.randrange(1, 16)))
        assert [m.groups() + m.span() for m in S.MARK_IN_LINE.finditer(text)] == [m.groups() + m.span() for m in S.MARK.finditer(text)], text
