"""Alignment: merges, splits, moves, additions, and texts that aren't translations."""

import random

from scriptorium.llm import align

WORDS = dict(zip("cache decoder detector catalyst vocabulary spectrum reading noise sample price mixing angle".split(), "antémoire décodage détecteur catalyse lexique spectre lecture bruit essai tarif mélange angulaire".split(), strict=True))


def sentence(rng):
    a, b, n = rng.choice(list(WORDS)), rng.choice(list(WORDS)), rng.randrange(10, 9999)
    return f"The {a} is worse than the {b} after {n} steps of the work.", f"Le {WORDS[a]} est pire que le {WORDS[b]} après {n} étapes dans les travaux."


def corpus(spark, n=300):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        s, t = zip(*[sentence(rng) for _ in range(rng.randrange(1, 3))], strict=True)
        rows.append((i, "fr", " ".join(s), " ".join(t)))
    return rows


def test_operator(spark):
    rng = random.Random(2)
    (a, x), (b, y), (c, z) = (sentence(rng) for _ in range(3))
    rows = corpus(spark)
    special = {
        1000: (f"{a} {b} {c}", f"{x} {y} {z}", {(0, 0), (1, 1), (2, 2)}),
        1001: (f"{a} {b} {c}", f"{x} {z} {y}", {(0, 0), (2, 1), (1, 2)}),
        1002: (f"{a} {b} {c}", f"{x} {z}", {(0, 0), (2, 1)}),
        1003: (f"{a} {b} {c}", f"{x[:-1]}, et l{y[1:]} {z}", {(0, 0), (1, 0), (2, 1)}),
        1004: (f"{a[:-1]}, and t{b[1:]} {c}", f"{x} {y} {z}", {(0, 0), (0, 1), (1, 2)}),
        1005: (a, a, set()),
        1006: (a, "Je suis désolé, je ne peux pas traiter ce passage.", set()),
        1007: ("VebabaFormer–Nacre (2017)", "VebabaFormer–Nacre (2017)", {(0, 0)}),
        1008: (None, x, set()),
        1009: (a, " ", set()),
    }
    rows += [(k, "fr", s, t) for k, (s, t, _) in special.items()] + [(1000, "fr", *special[1000][:2])]
    df = spark.createDataFrame(rows, "row_id long, lang string, src string, tgt string").repartition(3)
    got = {}
    for r in align.aligned(df).collect():
        got.setdefault(r.translation_id, []).append((r.src_start, r.tgt_start))
    for k, (s, t, want) in special.items():
        found = got.get(k, [])
        assert len(found) == len(set(found))
        place = lambda text, start: [p for p, _ in align.Side(text).spans].index(start)
        assert {(place(s, i), place(t, j)) for i, j in found} == want, k
    assert align.aligned(df.limit(0)).count() == 0


def test_without_lexicon():
    a, b = align.Side("One thing 12. Another thing 55. A third."), align.Side("第一个12。另一个55。第三个。")
    assert [(x, y) for x, y in align.align(a, b, {})][:2] == [(0, 0), (14, 6)]


def test_counterparts():
    cut = lambda s, t: align.counterparts(align.Side(s), align.Side(t))
    a, b, c = "Noise of 12 samples falls.", "Readings of 55 drift.", "Prices of 71 rise."
    x, y, z = "Le bruit de 12 essais tombe.", "Les lectures de 55 dérivent.", "Les tarifs de 71 montent."
    assert sorted(cut(f"{a} {b} {c}", f"{x} {z} {y}")) == [([0], [0]), ([1], [2]), ([2], [1])]
    for s, t in ((f"{a} {b} {c}", f"{x} {z}"), ("One. Two. Three. Four. Five.", "Un. Deux. Trois."), (f"{a} Nothing else. {b}", f"{x} {y}")):
        got = cut(s, t)
        assert {i for g, _ in got for i in g} == set(range(len(align.Side(s).spans)))
        assert {j for _, g in got for j in g} == set(range(len(align.Side(t).spans)))


def test_lexicon_of_all_texts(spark):
    """Words that stand only in long texts, or only where the numbers of sentences differ, are in the lexicon."""
    rng = random.Random(3)
    rows = []
    for k in range(80):
        s, t = zip(*[sentence(rng) for _ in range(6)], strict=True)
        n = rng.randrange(10, 9999)
        s, t = f"{' '.join(s)} The walrus sleeps after {n} days of rain.", f"{' '.join(t)} Le morse dort après {n} jours sous la pluie."
        rows.append((s, t if k % 2 else f"{t} Rien de plus dans ces travaux."))
    table = align.lexicon(spark.createDataFrame(rows, "src string, tgt string"))["en>fr"]
    assert table[0]["walrus"] != table[0].none and table[1]["morse"] != table[1].none
    e, _ = align._emissions(align.Side("The noise falls. The walrus sleeps after days of rain."), align.Side("Le morse dort après jours sous la pluie."), "en>fr", table)
    assert e[1, 0] > 0.6 and e[0, 0] < 0.3


def test_every_feature_has_its_place(spark):
    """More different words than any table of the most frequent ones: pairs of rare words are as like as others."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("bdfgklmnprstv", k=8))
    rows = [(f"The {word()} of the {word()} and the {word()}.", f"Le {word()} des {word()} et les {word()}.") for _ in range(2500)]
    table = align.lexicon(spark.createDataFrame(rows, "src string, tgt string"))["en>fr"]
    si, ti, dice, _ = table
    assert all(si[w] != si.none for s, _ in rows for w in align.parts_of(s)[0])
    assert all(ti[w] != ti.none for _, t in rows for w in align.parts_of(t)[0])
    for k in range(0, 2500, 50):
        (s, t), (other, _) = rows[k], rows[k - 1]
        e, _ = align._emissions(align.Side(f"{other} {s}"), align.Side(t), "en>fr", table)
        assert e[1, 0] > 0.6 and e[0, 0] < 0.3


def test_cells_dense_and_listed(monkeypatch):
    """A small dense table gives the same as one that holds all."""
    rng = align.np.random.default_rng(5)
    full = align.np.where(rng.random((30, 40)) < 0.2, rng.random((30, 40)), 0).astype("float32")
    s, t = full.nonzero()
    ids, jds = rng.integers(0, 31, 25), rng.integers(0, 41, 35)  # the last is what the lexicon lacks
    want = align.np.pad(full, ((0, 1), (0, 1)))[ids][:, jds]
    for top in (0, 7, 100):
        monkeypatch.setattr(align, "DENSE", top)
        c = align.Cells(s, t, full[s, t], 30, 40)
        assert (c.of(c.rows(ids), ids, c.cols(jds), jds) == want).all()


def _random_trellis(rng, size, m, n):
    np = align.np
    raw = [np.concatenate([rng.integers(0, align.UNKNOWN + 1, n * m), rng.integers(0, align.UNKNOWN + 1, n * (m - 1)), rng.integers(0, len(align.ADDED) + 1, n * (m - 1))]).astype(np.uint8).tobytes() for _ in range(size)]
    return align.Trellis(raw, m, n, align.START)


def _all_paths(t, who):
    """(weight, path) of every sequence of states, by brute force."""
    import itertools

    m, model = t.m, t.model
    states = [(-1, -1)] + [(i, i) for i in range(m)] + [(i, i + 1) for i in range(m - 1)]
    for path in itertools.product(states, repeat=t.n):
        w, place = 1.0, 0
        for j, (first, last) in enumerate(path):
            if first < 0:
                w *= model.null
                continue
            d = min(max(first + 1 - place, -2), 3)
            w *= t.jump[d + 2] * (t.single[who, j, first] if first == last else t.span[who, j, first])
            place = last + 1
        yield w * (t.bare if place == 0 else 1.0), path


def test_decoding_and_sums_like_brute_force():
    np, rng = align.np, align.np.random.default_rng(6)
    for m, n in ((1, 1), (2, 2), (3, 3), (4, 2), (1, 3)):
        t = _random_trellis(rng, 12, m, n)
        paths, got = t.paths(), t.expected(np.ones(12))
        want = {k: np.zeros_like(x) for k, x in got.items()}
        for who in range(12):
            ways = list(_all_paths(t, who))
            top = max(w for w, _ in ways)
            found = tuple(map(tuple, paths[who].tolist()))
            assert dict((p, w) for w, p in ways)[found] >= top * (1 - 1e-9)
            total = sum(w for w, _ in ways)
            for w, p in ways:
                w /= total
                aligned = [x for x in p if x[0] >= 0]
                want["bare"] += (w * (not aligned), w)
                want["null"] += (w * (n - len(aligned)) * bool(aligned), w * n * bool(aligned))
                want["span"] += (w * sum(a != b for a, b in aligned), w * len(aligned))
        for k in ("bare", "null", "span"):
            assert np.allclose(got[k], want[k]), k


def test_one_by_one_and_better_elsewhere():
    """A lone pair that has little in common is null where many texts are; a better likeness elsewhere wins over order."""
    e = align.np.array([[0.9, 0.1, 0.1], [0.1, 0.45, 0.1], [0.1, 0.97, 0.1], [0.9, 0.45, 0.1], [0.1, 0.98, 0.1]])
    path = align.Trellis([align._steps((e, align.np.full(3, 50.0)), 3)], 3, 3, align.START).paths()[0].tolist()
    assert path[1] == [2, 2]
    model = align.Model(**{**vars(align.START), "bare": 0.5})
    lone = align._steps((align.np.array([[0.15]]), align.np.array([50.0])), 1)
    assert align.Trellis([lone], 1, 1, model).paths()[0].tolist() == [[-1, -1]]


def test_long_texts_in_blocks(monkeypatch):
    """Likenesses of long texts, a sentence at a time, equal those of the whole table."""
    rng = align.np.random.default_rng(9)
    full = rng.random((30, 40)).astype("float32")
    s, t = full.nonzero()
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    si, ti = align.Index([align._hash(w) for w in words[:30]]), align.Index([align._hash(w) for w in words])
    table = (si, ti, align.Cells(s, t, full[s, t], 30, 40), align.np.append(rng.random(40), 0.5).astype("float32"))
    a = align.Side(" ".join(f"The {words[i]} {words[i + 1]} x." for i in range(28)))
    b = align.Side(" ".join(f"Le {words[i]} {words[i + 2]} y." for i in range(35)))
    want, _ = align._emissions(a, b, "en>fr", table)
    monkeypatch.setattr(align, "BLOCK", 10)
    got, _ = align._emissions(a, b, "en>fr", table)
    assert align.np.allclose(want, got)


def _batch(rows):
    pa = align.pa
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["row_id", "lang", "src", "tgt"])


def test_texts_are_read_once(monkeypatch):
    """The lexicon and likenesses come from what one reading left; a batch gives what each pair of texts gives alone."""
    np, rng = align.np, random.Random(7)
    rows = []
    for i in range(60):
        s, t = zip(*[sentence(rng) for _ in range(rng.randrange(1, 5))], strict=True)
        rows.append((i, "fr", " ".join(s), " ".join(t[: rng.randrange(1, 5)])))
    rows += [(99, "fr", *rows[0][2:]), (100, "fr", rows[1][2], "Je suis désolé, je ne peux pas traiter ce passage."), (101, "fr", "2017", "2017"), (102, "fr", "?!", "« 12 »")]
    cut = []
    monkeypatch.setattr(align, "spans", lambda x, old=align.spans: cut.append(x) or old(x))
    (read,) = align._reader(iter([_batch(rows)]))
    assert len(cut) == len({r[2] for r in rows}) + len({r[2:] for r in rows})
    monkeypatch.setattr(align, "spans", None)
    counted = [r for b in align._counts(iter([read.filter(read.column("counted"))])) for r in b.to_pylist() if r["pair"] == "en>fr"]
    assert max(r["n"] for r in counted if r["s"] == r["t"] == -1) >= 60
    kept = align.Read(read.filter(read.column("kept")))
    assert [0, 99] in kept.batch.column("ids").to_pylist() and [100] not in kept.batch.column("ids").to_pylist()
    monkeypatch.undo()
    s, t = (sorted({r[c] for r in counted if r[c] >= 0}) for c in ("s", "t"))
    full = np.random.default_rng(8).random((len(s), len(t))).astype("float32")
    i, j = full.nonzero()
    lexicon = (align.Index(s), align.Index(t), align.Cells(i, j, full[i, j], len(s), len(t)), np.linspace(0.5, 2, len(t) + 1, dtype="float32"))
    texts, seen = {r[0]: r[2:] for r in rows}, 0
    for table in (lexicon, None):
        for pair, own in kept.pairs("kept"):
            for some, e, total in align._likened(kept, own, table):
                for k, x, y in zip(some.tolist(), e, total, strict=True):
                    a, b = map(align.Side, texts[kept.batch.column("ids")[k].as_py()[0]])
                    want, weight = align._emissions(a, b, pair, table)
                    assert np.allclose(x, want) and np.allclose(y, weight)
                    seen += 1
    assert seen == 2 * kept.size


def test_features_that_share_a_hash_count_once_a_group():
    rng, first, twin = random.Random(10), {}, None
    for _ in range(5000):
        w = "".join(rng.choices("bdfgklmnprstv", k=9))
        if align._hash(w) in first:
            twin = (first[align._hash(w)], w)
            break
        first[align._hash(w)] = w
    text = f"The {twin[0]} is of the {twin[1]} in the work."
    (read,) = align._reader(iter([_batch([(1, "fr", text, "Le bruit est dans les travaux.")])]))
    got = [r for b in align._counts(iter([read])) for r in b.to_pylist()]
    assert got and {r["n"] for r in got} == {1}


def test_equal_likenesses_are_added_up_once(monkeypatch):
    """Equal likenesses of several batches give the sums of all texts, in one trellis a shape."""
    np, pa, rng = align.np, align.pa, align.np.random.default_rng(11)
    kinds = [(m, n, align._steps((rng.random((2 * m - 1, n)), np.full(n, 20.0)), m), int(rng.integers(1, 4))) for m, n in ((1, 1), (1, 1), (2, 2), (3, 2))]
    rows = [kinds[k] for k in rng.integers(0, len(kinds), 40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k : k + 10], strict=True)], names=["m", "n", "steps", "times"]) for k in range(0, 40, 10)]
    want = {}
    for m, n, steps, times in rows:
        for what, x in align.Trellis([steps], m, n, align.START).expected(np.array([float(times)])).items():
            want[what] = want.get(what, 0) + x
    made, old = [], align.Trellis
    monkeypatch.setattr(align, "Trellis", lambda steps, m, n, model: made.append((m, n)) or old(steps, m, n, model))
    (got,) = align._expected(align.START)(iter(batches))
    assert sorted(made) == [(1, 1), (2, 2), (3, 2)]
    for r in got.to_pylist():
        assert np.isclose(r["x"], want[r["what"]][r["i"]])
