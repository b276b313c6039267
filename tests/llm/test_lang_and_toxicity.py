import math
import random
import tracemalloc
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest

from veilstat.llm import lang_id, toxicity
from veilstat.llm._boost import fit_boosted, isotonic
from veilstat.llm._spark import held_out

rng = random.Random(11)
SYLLABLES = {"aa": ["ka", "to", "mi", "ren", "shu"], "bb": ["ström", "gre", "flü", "ach", "ung"], "cc": ["ñe", "llo", "que", "ción", "ra"]}


def word(lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def text(lang, n):
    return " ".join(word(lang) for _ in range(n))


def test_boosted_trees_and_calibration():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(int)
    model = fit_boosted(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    xs, ys = isotonic(model.margin(x[2000:]), y[2000:])
    assert np.all(np.diff(ys) >= 0) and 0 < ys[0] < 0.1 and 0.9 < ys[-1] < 1
    constant = fit_boosted(x, np.zeros(3000))
    assert not constant.features


def test_language(spark):
    rows = [(i, text(l, rng.choice([3, 30, 200])), l, "clash") for i, l in enumerate(["aa", "bb", "cc"] * 120)]
    odd = [(900, None, "aa", ""), (901, "", "aa", ""), (902, "12 %% 34 …", "bb", ""), (903, "ñ", None, ""), (5, rows[5][1], "cc", ""), (904, "ka " * 100_000, "aa", "")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string").repartition(3)
    model = lang_id.fit(docs)
    got = lang_id.identify(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].lang_pred == l for i, _, l, _ in rows]) > 0.98
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (900, 901, 902))
    assert by[903].lang_pred != "und" and by[904].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    kept = lang_id.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() >= len(rows)
    none = docs.limit(0)
    assert lang_id.identify(none, lang_id.fit(none)).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in lang_id.identify(unlabelled, lang_id.fit(unlabelled)).collect()} == {"und"}


@pytest.fixture(scope="module")
def labelled(spark):
    bad = ["snarf", "grumbo", "vexikalo", "vexitram"]
    rows, labels = [], []
    for i in range(1500):
        toxic = int(i % 8 == 0)
        words = text(rng.choice(["aa", "bb", "cc"]), rng.randint(8, 90)).split()
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad) if rng.random() < 0.5 else "vexi" + word("aa"))
        rows.append((i, " ".join(words), "s"))
        if i % 10:
            labels.append((i, toxic, 1))
    labels += [(3, 0, 0), (3, 0, 0), (None, 1, 1), (77, None, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame(rows + [(2000, None, "s"), (2001, "", "s"), (2002, "ka mi " * 50_000, "s"), (7, rows[7][1], "s")], "doc_id long, text string, predicted string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {i: i % 8 == 0 for i in range(1500)}
    assert np.mean([got[i].predicted == t for i, t in truth.items() if i % 10 == 0]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[2000].score == got[2001].score and got[2000].predicted == got[2002].predicted == 0
    assert any(k.startswith(b" vexi") for k in model.lexicon.weights)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).count() == docs.count()


def test_rejection_is_set_against_errors():
    right = np.concatenate([np.full(999, 0.99), [0.95]])
    assert lang_id.rejection(right, np.array([0.3, 0.6, 0.97])) == np.nextafter(0.6, 1)  # what lies above cannot be told apart
    assert lang_id.rejection(right, np.array([0.97])) == 0.0 and lang_id.rejection(np.array([]), right) == 0.0


def test_shuffled_texts_are_rejected(spark):
    """Texts of the languages stay; of the same letters in random order a good part goes, as far as the margin allows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = lang_id.fit(docs)
    rows = [r for r in docs.select("text", "lang").collect() if r.text and r.lang and len(r.text) > 200][::5]
    judge = lambda texts: model.predict(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    langs, _, rejected = judge([r.text.encode() for r in rows])
    wild = judge([lang_id.shuffled(r.text.encode(), i) for i, r in enumerate(rows)])[2]
    assert np.mean([a == r.lang for a, r in zip(langs, rows, strict=True)]) > 0.99 and rejected.mean() < 0.002 and wild.mean() > 0.25


def test_ties_and_repeated_ids(spark):
    """Equal languages: the first by name. One id 10,000 times is one row of the fit."""
    rows = [(1, "ka to mi ren", "aa"), (1, "ka to mi ren", "bb")] * 5000 + [(2, "ka to mi", "aa"), (3, "gre flü ach", "bb"), (6, "gre ach ung", "bb"), (7, "to ka mi", "aa")]
    docs = spark.createDataFrame([(*r, "s") for r in rows] + [(None, "ka to", "aa", "s")], "doc_id long, text string, lang string, source string")
    model = lang_id.fit(docs)
    assert lang_id.identify(docs, model).count() == docs.count()
    flat = lang_id.Model(["aa", "bb"], np.zeros((lang_id.BUCKETS, 2), np.float32), np.zeros(2), 1.0, 0.0)
    assert flat.predict(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))[0] == ["aa"]
    held = docs.select(held_out(docs["doc_id"]).alias("h"), "doc_id").filter("doc_id is null").first()
    assert held.h is False


def plain_logits(model, text):
    """The mean embedding of a text's subwords, each looked up on its own."""
    data = text.encode()
    total, count = np.zeros(len(model.langs)), 0
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            bucket = [int(b[0]) for k, b in lang_id.subwords(np.frombuffer(data[i : i + n], np.uint8)) if k == n][0]
            total += model.logits[bucket]
            count += 1
    return (total / max(count, 1) + model.bias) / model.temperature


def test_predictions_like_one_subword_at_a_time(spark):
    rows = [(i, text(l, 12), l) for i, l in enumerate(["aa", "bb", "cc"] * 30)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in rows[:20]] + ["a", "ab", "ñ x"]
    data = "".join(texts).encode()
    langs, score, _ = model.predict(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    for t, l, s in zip(texts, langs, score, strict=True):
        z = plain_logits(model, t)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert l == model.langs[int(p.argmax())] and s == pytest.approx(p.max(), abs=1e-4)


def plain_features(t, weights):
    """The features of one text, counted in plain Python."""
    data = t.encode()
    plain = data.translate(toxicity.PLAIN).decode("latin-1")
    padded = f" {plain} "
    ends = lambda term: [i + len(term) - 1 for i in range(len(padded)) if padded.startswith(term, i)]
    found = [(e, term, w) for term, w in weights.items() for e in ends(term.decode("latin-1"))]
    second = [e for w in toxicity.SECOND_PERSON for e in ends(f" {w.encode().decode('latin-1')} ") if f" {w} ".encode() not in weights]
    near = sum(any(abs(e - s) <= toxicity.NEAR_BYTES for s in second) for e, _, _ in found)
    words, n = len(plain.split()), max(len(data), 1)
    per = max(words, 1)
    letter = lambda b: chr(b).isascii() and chr(b).isalpha() or b > 127
    capital = lambda b: 65 <= b <= 90
    runs = lambda ok, k: sum(all(ok(data[i + j]) for j in range(k)) for i in range(len(data) - k + 1))
    same = [i + 1 < len(data) and letter(data[i]) and plain[i] == plain[i + 1] for i in range(len(data))]
    total = sum(w for *_, w in found)
    return [
        len(found) / per, math.log1p(len(found)), len({x for _, x, _ in found}), total / per, max((w for *_, w in found), default=0), near / per, math.log1p(near),
        runs(capital, 1) / n, runs(capital, 3) / n, data.count(b"!") / n, data.count(b"?") / n, sum(chr(b) in "\"#$%&'()*+-/:;<=>@[\\]^_`{|}~" for b in data) / n,
        sum(letter(data[i]) and chr(data[i + 1]) in "*@$#0123456789" and letter(data[i + 2]) for i in range(len(data) - 2)) / n, sum(same[i] and same[i + 1] for i in range(len(data) - 1)) / n, math.log1p(words),
    ]


def test_features_like_plain_counts():
    weights = {b" snarf ": 2.0, b" vexi": 1.5, b" you ": 0.5}
    texts = ["You SNARF!! vexikalo du", "", "x", "aaab 1a2b a*b AAAA BBB?", "ihr " + "wort " * 30 + "snarf", "vexi vexi snarf; ñandú éé (you)"]
    automaton = toxicity.Lexicon(weights).automaton()
    for t in texts:  # one row at a time, so that no row touches the next
        data = np.frombuffer(t.encode(), np.uint8)
        assert toxicity.features(data, np.array([0, len(data)]), automaton)[0] == pytest.approx(plain_features(t, weights))


def plain_isotonic(scores, y):
    """The largest of the least means: max over starts of min over ends, a value for each distinct score."""
    points = [(s, [b for _, b in g]) for s, g in groupby(sorted(zip(scores, y, strict=True)), key=lambda p: p[0])]
    mean = lambda i, j: sum(sum(b) for _, b in points[i : j + 1]) / sum(len(b) for _, b in points[i : j + 1])
    return [s for s, _ in points], [max(min(mean(i, j) for j in range(k, len(points))) for i in range(k + 1)) for k in range(len(points))]


def test_isotonic_like_its_definition():
    r = random.Random(3)
    for _ in range(30):
        scores = [r.choice([0.1, 0.2, 0.5, r.random()]) for _ in range(r.randint(2, 25))]
        y = [int(r.random() < s) for s in scores]
        xs, ys = isotonic(np.array(scores), np.array(y))
        points, want = plain_isotonic(scores, y)
        blocks = [list(g) for _, g in groupby(range(len(points)), key=lambda k: want[k])]
        share = sum(y) / len(y)
        for own in blocks:  # each block's share, smoothed by one row of the overall share
            rows = [b for s, b in zip(scores, y, strict=True) if points[own[0]] <= s <= points[own[-1]]]
            assert np.interp(points[own[0]], xs, ys) == pytest.approx(max([(sum(rows) + share) / (len(rows) + 1)] + [v for x, v in zip(xs, ys, strict=True) if x < points[own[0]]]))


def plain_stump(x, y, cuts, ridge, least):
    """The best split of one node by trying every cut of every feature."""
    p = y.mean()
    grad, hess = p - y, np.full(len(y), p * (1 - p))
    best = (1e-6, None, None)
    for j, edges in enumerate(cuts):
        for c in edges:
            left = x[:, j] <= c
            if hess[left].sum() >= least and hess[~left].sum() >= least:
                score = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + ridge)
                gain = score(left) + score(~left) - score(np.ones(len(y), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, j, c)
    return best


def test_first_split_like_trying_all():
    r = np.random.default_rng(5)
    for _ in range(10):
        x = r.integers(0, 9, (200, 3)).astype(float)
        y = ((x[:, 1] + r.normal(size=200)) > 4.5).astype(int)
        cuts = []
        for j in range(3):
            e = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1]))
            cuts.append(np.unique(np.concatenate([e, np.quantile(x[x[:, j] > 0, j], np.linspace(0, 1, 9)[:-1]) - 1e-9])))
        model = fit_boosted(x, y, trees=1, depth=1)
        _, j, c = plain_stump(x, y, cuts, 1.0, 2.0)
        assert (model.features[0][0], model.cuts[0][0]) == (j, c)
        right, p = x[:, j] > c, y.mean()
        for side, leaf in ((~right, model.leaves[0][0]), (right, model.leaves[0][1])):
            assert leaf == pytest.approx(-0.2 * (p - y[side]).sum() / (side.sum() * p * (1 - p) + 1))
        assert model.margin(x) == pytest.approx(np.log(p / (1 - p)) + np.where(right, model.leaves[0][1], model.leaves[0][0]))


def test_null_ids_are_scored_and_not_learned(spark, labelled):
    docs, labels = labelled
    more = docs.union(docs.selectExpr("cast(null as long)", "text", "predicted").limit(50))
    one, two = toxicity.fit(docs, labels), toxicity.fit(more, labels)
    assert one.lexicon.weights == two.lexicon.weights
    got = toxicity.score(more, two).filter("doc_id is null").collect()
    assert len(got) == 50 and all(0 <= r.score <= 1 for r in got)


def test_training_holds_no_dense_matrix():
    """The driver's memory follows the counts of the training rows, not rows times buckets; the order in which rows come decides nothing."""
    rng = np.random.default_rng(3)
    made = []
    for i in range(1500):
        own = np.sort(rng.choice(lang_id.BUCKETS // 2, 20, replace=False)) + i % 2 * lang_id.BUCKETS // 2
        made.append({"lang": "ab"[i % 2], "held": i % 5 == 0, "noise": False, "buckets": own.astype("<u2").tobytes(), "counts": rng.integers(1, 9, 20).astype("<f4").tobytes()})
    kinds = pa.schema([("lang", pa.string()), ("held", pa.bool_()), ("noise", pa.bool_()), ("buckets", pa.binary()), ("counts", pa.binary())])
    tracemalloc.start()
    one = lang_id.trained(pa.Table.from_pylist(made, kinds))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1500 * lang_id.BUCKETS * 4 and one.langs == ["a", "b"]
    two = lang_id.trained(pa.Table.from_pylist(made[::-1], kinds))
    assert all(np.array_equal(v, vars(two)[k]) for k, v in vars(one).items())
