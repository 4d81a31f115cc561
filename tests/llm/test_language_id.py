from collections import Counter
from math import log

import numpy as np

from tidemark.llm import language_id as L
from tidemark.llm.queries import op1_language_id, read


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op1_language_id(spark, d).collect()}
    truth = {r.doc_id: r.lang for r in read(spark, d, "documents").collect()}
    held = [i for i in truth if got[i].held_out]
    assert 150 < len(held) < 350 and set(got) == set(truth)
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_features_do_not_depend_on_slices(monkeypatch):
    texts = ["Über die Brücke", "", "a1b  c!", "lang " * 300, "z", "a\0b nul\0 " * 20, "a\0b"]

    def total():
        n = np.zeros((len(texts), L.BUCKETS), int)
        for out, own in L.Features()(texts):
            for f, o in zip(out, own):
                np.add.at(n, (o, f), 1)
        return n

    whole = total()
    monkeypatch.setattr(L, "SLICE_CHARS", 64)

    assert (total() == whole).all()


def test_odd(spark, odd):
    got = {r.doc_id: r for r in L.identify(odd).collect()}
    assert [i for i, r in got.items() if r.lang_pred == "und"] == [3, 4, 5, 10]
    assert all(r.score == 0 for r in got.values() if r.lang_pred == "und")


def test_no_training_rows(spark, empty):
    assert L.identify(empty).collect() == []
    rows = spark.createDataFrame([(1, "abc", None), (None, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(rows).collect()] == ["und", "und"]


def test_repeated_ids(spark, sample):
    model = L.fit(sample)
    rows = spark.createDataFrame([(1, "the of and"), (1, None), (None, "the of and")], "doc_id long, text string")
    assert L.predict(rows, model).count() == 3


def grams(text):
    """Features of a text one by one, without numpy."""
    code = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in code:
        code = code.replace("  ", " ")
    mask, out = (1 << 64) - 1, []
    for n in range(1, L.MAX_N + 1):
        for k in range(len(code) - n + 1):
            gram = code[k : k + n]
            if n == 1 and gram == " ":
                continue
            h = 0
            for i, c in enumerate(gram, 1):
                h = (h * 0x100000001B3 + ord(c) + i) & mask
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
            out.append((h ^ (h >> 31)) & (L.BUCKETS - 1))
    return out


def test_against_brute_force(spark, sample, monkeypatch):
    """Counts, probabilities and predictions worked out gram by gram, with texts cut into many slices and in one."""
    rows = [(r.doc_id, r.text, r.lang) for r in sample.limit(60).collect()] + [(999, "Été  à la plage. " * 40, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts, prior = {}, Counter(lang for _, t, lang in rows if t is not None and lang)
    for _, t, lang in rows:
        if t is not None and lang:
            counts.setdefault(lang, Counter()).update(grams(t))
    languages = sorted(prior)
    total = {x: sum(counts[x].values()) + L.ALPHA * L.BUCKETS for x in languages}
    expected = {}
    for i, t, _ in rows:
        found = grams(t or "")
        scores = [log(prior[x] / sum(prior.values())) + sum(log((counts[x][g] + L.ALPHA) / total[x]) for g in found) for x in languages]
        expected[i] = languages[scores.index(max(scores))] if any(c.isalpha() for c in t or "") else "und"
    for size in (1 << 20, 50):
        monkeypatch.setattr(L, "SLICE_CHARS", size)
        model = L.fit(df, train_rows=10**9)
        features = L.Features()
        total_scores, _ = model.scores(features, [t or "" for _, t, _ in rows])
        best = {i: languages[k] if any(c.isalpha() for c in t or "") else "und" for (i, t, _), k in zip(rows, total_scores.argmax(1))}
        assert best == expected
        for (_, t, _), row in zip(rows[:10], total_scores):
            found = grams(t or "")
            assert np.allclose(row, [log(prior[x] / sum(prior.values())) + sum(log((counts[x][g] + L.ALPHA) / total[x]) for g in found) for x in languages])
