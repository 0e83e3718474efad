import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from umbra.llm import language_id as I, nbsvm as N, toxicity as X


@pytest.fixture(scope="module")
def labelled(spark):
    """Two qualities, two languages and toxic words to tell apart."""
    rows, labels = [], []
    for i in range(400):
        good, toxic, lang = i % 4 != 0, i % 3 == 0, "de" if i % 5 == 0 else "en"
        text = prose(1000 + i, 60)
        text = text.replace("w", "ü" if lang == "de" else "w")
        text = text if good else text.replace(" ", " ### ")
        rows.append((i, text.replace(".", " vile.", 2) if toxic else text, lang, "a"))
        labels.append((i, int(good), int(toxic)))
    rows += [(1000, None, None, None), (1001, "", "en", "a"), (1002, "12 34 !", "en", "a"), (1003, prose(5, 20000), "en", "a"), (None, "some text", "en", "a"), (5, rows[5][1], "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("x")).repartition(3).cache()
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (1000, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize(("fit", "column"), [(N.fit_and_predict, "quality"), (X.fit_and_predict, "toxic")])
def test_held_out_accuracy(labelled, fit, column):
    docs, labels = labelled
    out = fit(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all() and not out["score"].isna().any()
    both = out.merge(labels.dropna().dropDuplicates(["doc_id"]).toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held[column]).mean() > 0.9


def test_language(labelled):
    docs, _ = labelled
    out = I.fit_and_predict(docs).toPandas().merge(docs.select("doc_id", "lang").distinct().toPandas(), on="doc_id")
    held = out[out["held_out"] & (out["doc_id"] < 1000)]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    by = out.drop_duplicates("doc_id").set_index("doc_id")["lang_pred"]
    assert by[1000] == by[1001] == by[1002] == "und"


def test_language_on_an_empty_table(labelled):
    docs, _ = labelled
    assert I.fit_and_predict(docs.limit(0)).count() == 0


def hashed_grams(text):
    """Bucket of each n-gram, one character after the other."""
    t = "".join(c if "a" <= c <= "z" or ord(c) >= 170 else " " for c in (text or "").lower())
    for i in range(len(t)):
        h = 0
        for n in (1, 2, 3):
            if i + n > len(t):
                break
            h = ((h ^ ord(t[i + n - 1])) * 0x01000193 + n) % 2**32
            if t[i : i + n].strip():
                yield ((h ^ h >> 15) * 0x85EBCA6B % 2**32) >> 32 - I.BITS


@pytest.mark.parametrize("languages", [400, 2])
def test_language_equals_plain_naive_bayes(spark, monkeypatch, languages):
    monkeypatch.setattr(I, "LANGUAGES_A_MATRIX", languages)  # 2: the languages are dealt over several matrices
    rows = [(k * 10 + i, " ".join(f"{c}{w}" for w in prose(k * 7 + i, 12).split()), c) for k, c in enumerate(("aa", "bb", "cc", "dd", "ee", "ñü")) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {}
    for _, text, lang in rows:
        for g in hashed_grams(text):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    total = {k: sum(v.values()) + 0.5 * 2**I.BITS for k, v in counts.items()}
    asked = [(1, "aaw0a bbw1b"), (2, "ccw3c"), (3, "ñüw1a ñü"), (4, "zzz ee"), (5, "12 3"), (6, None)]
    got = {r.doc_id: r for r in I.predict(spark.createDataFrame(asked, "doc_id long, text string"), I.fit(docs)).collect()}
    for doc, text in asked[:4]:
        log = {k: sum(np.log((v.get(g, 0) + 0.5) / total[k]) for g in hashed_grams(text)) for k, v in counts.items()}
        best = max(log, key=log.get)
        share = 1 / sum(np.exp(x - log[best]) for x in log.values())
        assert got[doc].lang_pred == best and abs(got[doc].score - share) < 1e-3
    assert {got[5].lang_pred, got[6].lang_pred} == {"und"} and got[6].score == 0


def test_log_count_ratios_and_descent_equal_dense_ones():
    rng = np.random.default_rng(5)
    features = [np.unique(rng.integers(0, 30, 8)) if i % 3 else np.unique(rng.integers(20, 50, 8)) for i in range(90)]
    y = np.where(np.arange(90) % 3, 1.0, 0.0)
    dense = np.zeros((90, 50))
    for i, f in enumerate(features):
        dense[i, f] = 1
    up, down = 1 + dense[y > 0].sum(0), 1 + dense[y == 0].sum(0)
    # counts of all buckets are smoothed, also of those that no text has
    size = 1 << N.BITS
    ratio = np.log(up / (up.sum() + size - 50)) - np.log(down / (down.sum() + size - 50))
    sign, x = np.where(y > 0, 1.0, -1.0), np.hstack([dense * ratio, np.ones((90, 1))])
    w, alpha, order = np.zeros(51), np.zeros(90), np.random.default_rng(1)
    for _ in range(N.EPOCHS):
        for i in order.permutation(90):
            new = np.clip(alpha[i] - (sign[i] * (w @ x[i]) - 1) / (x[i] @ x[i]), 0, 1.0)
            w += (new - alpha[i]) * sign[i] * x[i]
            alpha[i] = new
    got = N.dual_coordinate_descent(features, ratio, sign, np.ones(90))
    assert np.allclose(got, w)
    # the dual solution: weights are the sum of the vectors times their dual variables, and nearly optimal
    far = N.dual_coordinate_descent(features, ratio, sign, np.ones(90), epochs=300)
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - sign * (x @ v)).sum()
    assert all(loss(far) <= loss(far + rng.normal(0, 0.05, 51)) + 1e-6 for _ in range(50))
    model = N.fit_rows(features, y, np.ones(90))
    scored = N.Model(model[:size].astype(np.float32), *model[size:])
    assert scored.a > 0 and model[:50][up > 3 * down].mean() > 0 > model[:50][down > 3 * up].mean()


def test_convolution_equals_loops():
    rng = np.random.default_rng(2)
    net = X.Net.started(rng.normal(0, 1, 1 << X.BITS))
    docs = [rng.integers(0, 1 << X.BITS, (n, 2)) for n in (0, 1, 2, 7)]
    row = np.repeat(np.arange(4), [len(d) for d in docs])
    got = net.maxima(np.concatenate(docs), row, 4)
    for d, ids in enumerate(docs):
        words = [net.table[a] + net.table[b] for a, b in ids]
        for k, w in enumerate(X.WIDTHS):
            for f in range(X.FILTERS):
                values = [sum(words[i + j] @ net.filters[k][j][:, f] for j in range(w)) + net.bias[k][f] for i in range(len(words) - w + 1)]
                assert abs(got[d, k * X.FILTERS + f] - max([0.0, *values])) < 1e-4


def test_first_step_follows_the_numeric_gradient():
    ids = np.random.default_rng(3).integers(0, 1 << X.BITS, (9, 2))
    before, after = X.Net.started(np.zeros(1 << X.BITS)), X.train([ids], np.array([1]), epochs=1)

    def loss(net):
        return float(np.log1p(np.exp(-net.logits(net.maxima(ids, np.zeros(9, np.int64), 1))[0])))

    for old, new, some in ((before.out, after.out, [(0,), (9,), (24,)]), (before.filters[1], after.filters[1], [(0, 0, 1), (1, 3, 5)]), (before.bias, after.bias, [(0, 2), (2, 1)])):
        for at in some:
            kept, eps = old[at], 1e-3
            old[at] = kept + eps
            up = loss(before)
            old[at] = kept - eps
            g = (up - loss(before)) / (2 * eps)
            old[at] = kept
            assert abs((old[at] - new[at]) - X.RATE * g / np.sqrt(1e-2 + g * g)) < 2e-3


def test_wider_filters_learn_the_order_of_words(monkeypatch):
    """Every text has both words; only their order, side by side, tells the classes apart."""

    def made(n, seed):
        rng, docs = np.random.default_rng(seed), []
        vocabulary = rng.integers(0, 1 << X.BITS, (60, 2)) if seed is None else np.random.default_rng(0).integers(0, 1 << X.BITS, (60, 2))
        for i in range(n):
            words = rng.integers(2, 60, 12).tolist()
            at = int(rng.integers(0, 11))
            words[at : at + 2] = [0, 1] if i % 2 else [1, 0]
            docs.append(vocabulary[words])
        return docs, np.arange(n) % 2

    docs, y = made(800, 1)
    test, want = made(200, 2)

    def accuracy():
        net = X.train(docs, y, epochs=15)
        return np.mean([(net.logits(net.maxima(d, np.zeros(len(d), np.int64), 1))[0] > 0) == k for d, k in zip(test, want)])

    assert accuracy() > 0.9
    monkeypatch.setattr(X, "WIDTHS", (1,))
    assert accuracy() < 0.7


def test_every_labelled_row_is_learnt_from(spark, monkeypatch):
    """Weights, word counts and thresholds see all rows, also where they are dealt over several parts."""
    monkeypatch.setattr(X, "ROWS_A_PART", 1500)
    n = 6400
    docs = spark.range(0, n, 1, 8).selectExpr("id as doc_id", "concat('plain words ', id % 97, if(id % 2 = 0, ' vile', ' kind')) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2 = 0) as toxic")
    seen, old, counted = [], X.trained, []
    monkeypatch.setattr(X, "trained", lambda rows, sizes: (seen.append((rows.count(), sizes.tolist())), old(rows, sizes))[1])
    before = X.thresholds
    monkeypatch.setattr(X, "thresholds", lambda rows, net: (counted.append(rows.count()), before(rows, net))[1])
    out = X.fit_and_predict(docs, labels).cache()
    kept = out.where("not held_out").count()
    assert seen[0][0] == sum(seen[0][1]) and seen[0][0] + counted[0] == kept > 5000  # a sample had 2500 a class
    assert out.where("predicted <> int(doc_id % 2 = 0)").count() == 0


def test_a_flat_net_is_the_net():
    net, _ = X.started(np.random.default_rng(1).normal(0, 1, 1 << X.BITS))
    net.out = net.out.astype(np.float32)
    back = X.from_flat(X.flat(net))
    assert all(np.array_equal(a, b) for a, b in zip((net.table, *net.filters, net.bias, net.out), (back.table, *back.filters, back.bias, back.out), strict=True))


def test_nothing_to_learn_from(labelled):
    docs, labels = labelled
    none = labels.limit(0)
    for fit in (N.fit_and_predict, X.fit_and_predict):
        assert fit(docs.limit(20), none).where("score between 0 and 1").count() == 20
        assert fit(docs.limit(0), labels).count() == 0
    assert {r.lang_pred for r in I.fit_and_predict(docs.limit(20).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    features = [np.unique(rng.integers(0, 20, 6)) if i % 2 else np.unique(rng.integers(15, 40, 6)) for i in range(200)]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    ratio = np.ones(40)
    w = N.dual_coordinate_descent(features, ratio, y, np.ones(200), epochs=20)
    assert np.mean([np.sign(w[f].sum() + w[-1]) == k for f, k in zip(features, y)]) > 0.9


def test_filters_over_many_texts_at_once_are_those_of_each_text():
    """Texts of no, one and two words, and longer ones than a block, beside others in one batch."""
    rng = np.random.default_rng(5)
    net, seen = X.started(rng.normal(0, 1, 1 << X.BITS))
    docs = [rng.integers(0, 1 << X.BITS, (n, 2)).astype(np.int32) for n in (0, 1, 2, 3, 0, X.BLOCK_WORDS + 5, 40, 1, 0)]
    top, where = X.tops(net, docs)
    for i, ids in enumerate(docs):
        x = net.table[ids[:, 0]] + net.table[ids[:, 1]]
        for k, w in enumerate(X.WIDTHS):
            y = np.array([sum(x[p + j] @ net.filters[k][j] for j in range(w)) + net.bias[k] for p in range(len(x) - w + 1)]).reshape(-1, X.FILTERS)
            assert np.allclose(top[i, k], np.maximum(y.max(0), 0) if len(y) else 0, atol=1e-6)
            if len(y):
                assert np.allclose(y[where[i, k], range(X.FILTERS)], y.max(0), atol=1e-6)
    row = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
    assert np.allclose(net.maxima(np.concatenate(docs), row, len(docs)), top.reshape(len(docs), -1), atol=1e-6)
    empty = docs[:1] * X.BATCH
    X.descend(net, seen, empty, np.zeros(len(empty)), np.arange(len(empty)))  # a batch without a word
    assert np.isfinite(net.out).all()
