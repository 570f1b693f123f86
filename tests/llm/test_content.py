"""Hidden words, the label model, and scores of documents."""

import numpy as np
import pytest

from scriptorium.llm import content
from scriptorium.llm.content import FOR, VOTERS, consistent, label_model, rates, scores, votes


def undo(text):
    return content.undo(consistent(text))


@pytest.mark.parametrize("text,word", [("you i***t", "idiot"), ("a m0r0n", "moron"), ("idddddiot", "idiot"), ("go to h e l l now", "hell"), ("n@k3d", "naked"), ("a i-d-i-o-t to me", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("idі​ot", "idiot"), ("too 1nf3r1or", "inferior"), ("c r e t i no", "cretino")])
def test_undo(text, word):
    assert word in undo(text)[0].split()


@pytest.mark.parametrize("text", ["We set k = 12 in 3 of 5 runs.", "10³ to 10² steps", "v1.4 / X-1", "a.m. on St. Olan Road", "**bold** text"])
def test_nothing_hidden(text):
    assert not undo(text)[1]


def test_label_model_finds_the_better_voter():
    bit = {v: 1 << i for i, v in enumerate(VOTERS)}
    bits = np.array([0, bit["threat"], bit["noun"] | bit["directed"], bit["adjective"] | bit["thing"], bit["noun"] | bit["quoted"], bit["group"] | bit["study"]])
    post = label_model(bits, np.array([1e5, 50, 80, 200, 100, 150]))
    assert post[0] < 0.01 and post[1] > 0.5 and post[2] > 0.5 and max(post[3:]) < 0.2


BAD = ["You are a worthless clown, and so is everybody.", "Refugees belong in cages, not at conferences.", "Send me your nude pictures and I will cite it.", "你这个白痴，闭上你的臭嘴。", "Va te faire foutre avec ton modèle.", "Shut up, you m0r0n, nobody asked."]
GOOD = ["The term \"idiot\" occurs in court records and is quoted as a historical source.", "We kill the child process once the cache is flat.", "Breast cancer screening raised the rate.", "Women and refugees were interviewed with their consent.", "Stupid question perhaps: why is it so low?", "Entrenamos X con 65 muestras.", "All data were collected in the U.S."]


def test_documents(spark):
    filler = " The detector depends strongly on the cache. All data were collected in the U.S."
    rows = [(i, s, g + filler) for s in "xy" for i, g in enumerate(GOOD * 30)] + [(1000 + i, "x", filler + " " + b) for i, b in enumerate(BAD * 5)]
    rows += [(5000, "y", None), (5001, None, ""), (5002, "y", " "), (5003, "y", filler * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    got = scores(df, ["doc_id", "source"], "text").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.score >= content.THRESHOLD) == (1000 <= r.doc_id < 5000), r
    by = {r.source: r for r in rates(scores(df, ["doc_id", "source"], "text")).collect()}
    assert by["x"].flagged == len(BAD) * 5 and by["y"].flagged == 0 and by[None].documents == 1
    assert scores(df.limit(0), ["doc_id"], "text").count() == 0


def test_votes_have_names():
    assert len(VOTERS) < 31 and votes("")[0] == 0 and set(FOR) < set(VOTERS)


def test_against_raters(spark):
    """Recall and precision on documents that raters judged, whose judgements the model doesn't see.

    Raters err: a document they call bad in which no voter speaks against any sentence isn't counted.
    """
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    said = spark.read.parquet(f"{d}/content_labels.parquet").groupBy("doc_id").avg("objectionable").toDF("doc_id", "m").where("m <> 0.5")
    got = scores(docs, ["doc_id"], "text").join(said, "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    rows = [(r.m > 0.5, r.score >= content.THRESHOLD) for r in got if r.m < 0.5 or any(b & content.ACCUSING for b, _ in content.judged(r.text or ""))]
    both = sum(a and b for a, b in rows)
    assert sum(a for a, _ in rows) >= 20
    assert both / sum(a for a, _ in rows) >= 0.9 and both / sum(b for _, b in rows) >= 0.85


def test_words_without_votes_are_learnt():
    """Sentences that no voter speaks on get a posterior of their own, not a fixed nought."""
    post = label_model(np.array([0, 1 << VOTERS.index("directed") | 1]), np.array([1000.0, 100.0]))
    assert 0 < post[0] < post[1]
