"""Quality, toxicity and language: the models on made-up data, held-out accuracy, odd rows."""

import numpy as np
import pytest

from graphloom.llm import features, language, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_ordinal_model_orders_three_grades():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    latent = x @ np.array([2.0, -1.0, 0.5, 0, 0]) + rng.logistic(size=3000)
    y = np.digitize(latent, [-1.0, 1.5])
    model = quality.OrdinalModel.fit(x, y, [1, 2, 5], np.bincount(y) / 3000, epochs=40)
    assert model.thresholds == pytest.approx([-1.0, 1.5], abs=0.35)
    assert model.weights[:3] == pytest.approx([2.0, -1.0, 0.5], abs=0.3)
    tails = model.tails(x)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert model.expected(tails) == pytest.approx(1 + tails[:, 0] * 1 + tails[:, 1] * 3)


def test_ordinal_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    x, y, cost = rng.normal(size=(40, 3)), rng.integers(0, 3, 40), rng.uniform(0.5, 2, 40)
    params = np.array([0.3, -0.2, 0.1, -0.5, 0.2])

    def loss(p):
        edges = np.concatenate(([-np.inf], quality.OrdinalModel._ordered(p[3:]), [np.inf]))
        eta = x @ p[:3]
        mass = quality.sigmoid(edges[y + 1] - eta) - quality.sigmoid(edges[y] - eta)
        return -(cost * np.log(mass)).mean() + 5e-5 * (p[:3] ** 2).sum()

    numeric = [(loss(params + d) - loss(params - d)) / 2e-6 for d in 1e-6 * np.eye(5)]
    assert quality.OrdinalModel._gradient(params, x, y, cost, 3) == pytest.approx(numeric, abs=1e-5)


def test_factorization_machine_learns_a_pair():
    """Neither of two terms alone is toxic, both together are; an additive model can't say so."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array(sorted([*([10] * a), *([20] * b), 100 + rng.integers(0, 50)]), dtype=np.uint32))
        y.append(int(a and b))
    y = np.array(y)
    shares = np.array([1 - y.mean(), y.mean()])
    fm = toxicity.FactorizationMachine.fit(rows, y, shares, epochs=20)
    at = {t: fm.place[t] for t in (10, 20)}
    assert fm.score([at[10], at[20]]) > 0.8 > 0.3 > max(fm.score([at[10]]), fm.score([at[20]]), fm.score([]))
    v = fm.factors
    assert float(v[at[10]] @ v[at[20]]) > 0.2


def test_factorization_machine_learns_an_exclusive_or():
    """Neither term depends on the label by itself; only their pair does."""
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([*([10] * a), *([20] * b), *np.unique(100 + rng.integers(0, 50, 2))], dtype=np.uint32))
        y.append(int(a != b))
    y = np.array(y)
    fm = toxicity.FactorizationMachine.fit(rows[:1000], y[:1000], np.array([0.5, 0.5]))
    assert {10, 20} <= set(fm.terms.tolist())
    scores = np.array([fm.score([fm.place[t] for t in r.tolist() if t in fm.place]) for r in rows[1000:]])
    assert ((scores > 0.5) == y[1000:]).mean() > 0.98


def test_scores_equal_brute_force():
    """The machine's pair sum, the centroids' cosines and the ordinal tails, term by term."""
    rng = np.random.default_rng(4)
    linear, factors = rng.normal(size=6), rng.normal(size=(6, toxicity.FACTORS))
    fm = toxicity.FactorizationMachine(np.arange(6, dtype=np.uint32), -0.5, linear, factors)
    for at in ([], [2], [0, 3, 5], [0, 1, 2, 3, 4, 5]):
        z = -0.5 + sum(linear[i] for i in at) + sum(float(factors[i] @ factors[j]) for i in at for j in at if i < j)
        assert fm.score(at) == pytest.approx(1 / (1 + np.exp(-z)))
    texts = ["the cat and the dog", "der hund und die katze", "le chien et le chat", "cats, dogs"]
    counts, _ = language.raw_features(texts)
    model = language.CentroidModel.fit(counts, ["en", "de", "fr", "en"], k=2)
    names, score, _ = model.predict(["the dog", "die katze und", "1 2"])
    for text, name, top in zip(["the dog", "die katze und"], names, score):
        own = [float(np.log1p(c) * w) for c, w in zip(language.raw_features([text])[0][0], model.idf)]
        norm = sum(x * x for x in own) ** 0.5
        cosines = [(sum(x * float(y) for x, y in zip(own, c)) / norm, n) for c, n in zip(model.centroids, model.languages)]
        assert (name, top) == (max(cosines)[1], pytest.approx(max(cosines)[0], rel=1e-4))
    assert names[2] == "und"
    n = len(texts)
    seen = [sum(row[k] > 0 for row in counts) for k in range(language.DIMS)]
    assert model.idf == pytest.approx([np.log((1 + n) / (1 + s)) + 1 for s in seen], rel=1e-5)
    ordinal = quality.OrdinalModel([1, 2, 5], rng.normal(size=quality.DIMS + quality.EXTRA).astype(np.float32), np.array([-0.3, 0.8]))
    grade, tail = quality._scores(ordinal, texts, 2)
    for text, g, t in zip(texts, grade, tail):
        x = np.log1p(quality.raw_features([text])[0].astype(float))
        x[: quality.DIMS] /= np.sqrt((x[: quality.DIMS] ** 2).sum())
        x[quality.DIMS :] = quality.raw_features([text])[0][quality.DIMS :]
        least = [1 / (1 + np.exp(-(float(x @ ordinal.weights) - c))) for c in ordinal.thresholds]
        assert t == pytest.approx(least[1], rel=1e-3) and g == pytest.approx(1 + least[0] + 3 * least[1], rel=1e-3)


def test_letters_of_all_planes():
    assert language.raw_features(["𰀀𱍊", "12 ..", "𝔘"])[1].tolist() == [True, False, True]


def test_columns_are_found_in_any_case_or_refused(spark):
    docs = spark.createDataFrame([(k, f"{'good words here' if k % 2 else 'BAD BAD BAD'} {k}", "x") for k in range(20)], "doc_id long, Text string, other string")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    model, machine = quality.fit(docs, labels), toxicity.fit(docs, labels)
    kept = {r.doc_id for r in quality.score(docs, model).where("kept").collect()}
    assert 0 < len(kept) < 20 and {r.doc_id for r in quality.select(docs, model).collect()} == kept
    clean = {r.doc_id for r in toxicity.score(docs, machine).where("predicted = 0").collect()}
    assert {r.doc_id for r in toxicity.remove_toxic(docs, machine).collect()} == clean
    with pytest.raises(ValueError):
        toxicity.remove_toxic(docs.drop("Text"), machine)
    with pytest.raises(ValueError):
        quality.select(docs.drop("Text"), model)


def test_sample_is_bounded_in_rows(spark):
    """A repeated id is one row, whatever its texts, and many classes share the bound."""
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('text ', id % 7) AS text")
    labels = spark.range(3).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS y")
    sample, counts = features.labelled_sample(docs, labels, "doc_id", "text", "y", 10)
    assert sample.count() == 3 and counts == {0: 2, 1: 1}
    many = spark.range(2000).selectExpr("id AS doc_id", "cast(id % 100 AS string) AS y", "'t' AS text")
    sample, counts = features.labelled_sample(many, many.select("doc_id", "y"), "doc_id", "text", "y", 1000)
    assert len(counts) == 100 and sample.select("y" if "y" in sample.columns else "label").distinct().count() == 100


def test_quality_held_out(spark):
    """Fitted on three quarters of the ratings, judged on the rest."""
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    apart = queries.crc32_bucket("doc_id", 4) == 2
    model = quality.fit(docs, labels.where(~apart))
    found = quality.score(docs.join(labels.where(apart), "doc_id"), model).toPandas().merge(labels.toPandas())
    assert len(found) > 500 and found.kept[found.quality == 1].mean() > 0.98 and found.kept[found.quality == 0].mean() < 0.1


def test_held_out_accuracy(spark):
    lang = queries.op6_language(spark, SF).toPandas().merge(queries.table(spark, SF, "documents").select("doc_id", "lang").toPandas())
    assert len(lang) == 10_000 and lang.score.between(0, 1).all()
    assert (lang[lang.held_out].lang == lang[lang.held_out].lang_pred).mean() > 0.97
    tox = queries.op7_toxicity(spark, SF).toPandas()
    assert len(tox) == 10_000 and ((tox.score >= 0.3) == (tox.predicted == 1)).all()
    tox = tox.merge(queries.table(spark, SF, "labels").toPandas())
    out = tox[tox.held_out]
    assert (out.predicted[out.toxic == 1] == 1).mean() > 0.85 and (out.predicted[out.toxic == 0] == 0).mean() > 0.99
    good = queries.op9_quality(spark, SF).toPandas().merge(queries.table(spark, SF, "labels").toPandas())
    assert good.kept[good.quality == 1].mean() > 0.99 and good.kept[good.quality == 0].mean() < 0.1


def test_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (3, None, None), (None, 1, 1), (8, 1, 0), (77, 0, 1)], "doc_id long, quality int, toxic int")
    docs = odd_docs.withColumn("lang", odd_docs.doc_id.cast("string"))
    models = quality.fit(docs, labels), toxicity.fit(docs, labels), language.fit(docs)
    scored = quality.score(docs, models[0]), toxicity.score(docs, models[1]), language.identify(docs, models[2])
    for df in scored:
        assert df.count() == docs.count()
    by_id = {r.doc_id: r for r in scored[2].collect()}
    assert (by_id[5].lang_pred, by_id[6].lang_pred, by_id[11].lang_pred, by_id[11].score) == ("und", "und", "und", 0.0)
    assert all(0 <= r.score <= 1 for r in scored[1].collect())
    assert quality.select(docs, models[0], least=0.0).columns == docs.columns
    assert quality.select(docs, models[0], least=0.0).count() == docs.count()
    assert toxicity.remove_toxic(docs, models[1], threshold=1.1).count() == docs.count()
    # nothing to learn from: everything is kept, nothing is toxic, no language is known
    none = labels.limit(0)
    assert quality.select(docs, quality.fit(docs, none)).count() == docs.count()
    assert toxicity.remove_toxic(docs, toxicity.fit(docs, none)).count() == docs.count()
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    assert quality.score(no_docs, models[0]).count() == 0


def test_rejection_by_distance(spark):
    rows = [(k, "der die das und nicht ein eine " * 9, "de") for k in range(6)] + [(k, "the and of to that which with " * 9, "en") for k in range(6, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    probe = spark.createDataFrame([(1, "the of that and with to which"), (2, "ξυζ ψωφ χθρ"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in language.identify(probe, model, reject=True).collect()}
    assert (found[2].lang_pred, found[2].rejected, found[3].lang_pred) == ("und", True, "und")
    assert {r.doc_id: r.lang_pred for r in language.identify(probe, model).collect()}[1] == "en"
