import random

import numpy as np
import pytest

from stationflow.llm import language_id, toxicity

LETTERS = {"aa": "abcdeé", "bb": "mnopqü", "cc": "uvwxyz"}
TABLES = "/root/testdata/sf0.01"


def text(lang, seed, n=40):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)] + [(900, None, "aa"), (901, "..", "dd"), (902, text("aa", 1), None)]
    return language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_bundles_are_sums_of_bound_letters():
    bundler = language_id.Bundler(256, 5)
    signs = lambda c: np.random.default_rng([5, ord(c)]).integers(0, 2, 256) * 2 - 1
    grams, owner = bundler.grams(["Ab-b", None, "", "é" * 3, "12"])
    rows = bundler.bundles(grams, owner, 5)
    for r, padded in ((0, [" ab", "ab ", " b "]), (3, [" éé", "ééé", "éé "])):
        want = sum(np.roll(signs(a), 2) * np.roll(signs(b), 1) * signs(c) for a, b, c in padded)
        assert (rows[r] == want).all()
    assert not rows[[1, 2, 4]].any()


def test_many_letters_bundle_alike(monkeypatch):
    texts = ["".join(chr(0x4E00 + (i * 37 + j) % 400) for j in range(50)) for i in range(8)]
    one = language_id.Bundler(64)
    whole = one.bundles(*one.grams(texts), 8)
    monkeypatch.setattr(language_id, "BOUND_AT_ONCE", 7)
    other = language_id.Bundler(64)
    assert (other.bundles(*other.grams(texts), 8) == whole).all()


def test_languages(spark, profiles, odd, none):
    assert list(profiles) == ["aa", "bb", "cc"]
    rows = [(i, text(lang, 500 + i, 10), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), profiles).collect()
    assert all(r["lang"] == r["lang_pred"] and 0.1 < r["score"] <= 1 for r in found)
    found = {r["doc_id"]: r for r in language_id.identify(odd, profiles).collect()}
    assert len(found) == odd.select("doc_id").distinct().count()
    assert all((found[i]["lang_pred"], found[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 4))
    assert language_id.identify(none, profiles).count() == 0
    assert language_id.learn(none) == {}
    assert {r["lang_pred"] for r in language_id.identify(odd, {}).collect()} == {"und"}
    kept = language_id.keep_identified(odd, profiles, 0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


def test_predictions_by_a_plain_cosine(spark):
    """Profiles, cosines and the choice between languages, letter by letter."""
    signs = lambda c: np.random.default_rng([language_id.SEED, ord(c)]).integers(0, 2, language_id.DIMENSIONS) * 2 - 1

    def bundle(t):
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split()) + " "
        grams = [plain[i : i + 3] for i in range(len(plain) - 2) if plain[i + 1] != " "]
        return sum((np.roll(signs(a), 2) * np.roll(signs(b), 1) * signs(c) for a, b, c in grams), np.zeros(language_id.DIMENSIONS))

    taught = [(text(lang, 30 + i, 6), lang) for i, lang in enumerate(["bb", "aa", "cc"] * 4)] + [("Same words", "yy"), ("same  WORDS!", "xx"), ("...", "zz"), (None, "aa"), ("abc", None)]
    profiles = {}
    for t, lang in taught:
        if lang is not None and bundle(t).any():
            profiles[lang] = profiles.get(lang, 0) + bundle(t)
    learned = language_id.learn(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(taught)], "doc_id long, text string, lang string").repartition(3))
    assert list(learned) == sorted(profiles) and all((learned[k] == profiles[k]).all() for k in profiles)
    texts = [text(lang, 90 + i, n) for i, (lang, n) in enumerate([("aa", 1), ("bb", 3), ("cc", 40)] * 3)] + ["same words", "a", "É1x", " ", None, "12"]
    found = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), learned).orderBy("doc_id").collect()
    for t, r in zip(texts, found, strict=True):
        own = bundle(t)
        if not any(c.isalpha() for c in t or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        cosine = {k: own @ v / np.linalg.norm(own) / np.linalg.norm(v) for k, v in sorted(profiles.items())}
        best = max(cosine, key=lambda k: round(cosine[k], 5))  # of equal ones the first by name
        assert r["lang_pred"] == best and abs(r["score"] - max(0, cosine[best])) < 1e-5
    assert found[9]["lang_pred"] == "xx"


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def biased(n=600):
    """Toxic texts that often name one group, clean ones that seldom do."""
    rnd = random.Random(0)
    rows = []
    for i in range(n):
        words = [rnd.choice("house tree river walk green light road table".split()) for _ in range(12)]
        toxic = i % 4 == 0
        if toxic and rnd.random() < 0.75:
            words[3] = "vile"
        if rnd.random() < (0.8 if toxic else 0.03):
            words[6] = "muslim"
        elif not toxic and rnd.random() < 0.5:
            words[6] = rnd.choice(["christian", "jewish", "hindu"])
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def test_swapped_terms_lower_false_positives(spark):
    docs, labels = labelled(spark, biased())
    rows = toxicity.training_rows(docs, labels).cache()
    plain, fair = toxicity.fit(rows, counterfactual=0.0), toxicity.fit(rows, counterfactual=5.0)
    neutral = spark.createDataFrame([(1, "a muslim walk to the green house."), (2, "a christian walk to the green house.")], "doc_id long, text string")
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score(neutral, m).collect()} for m in (plain, fair)]
    assert scores[1][1] < scores[0][1] and scores[0][1] > 0.5 > scores[1][1]
    assert abs(scores[1][1] - scores[1][2]) < abs(scores[0][1] - scores[0][2])
    assert {r["predicted"] for r in toxicity.score(spark.createDataFrame([(1, "vile road")], "doc_id long, text string"), fair).collect()} == {1}


def test_odd_texts_have_scores(spark, odd, none):
    docs, labels = labelled(spark, biased(200))
    labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (4, 0), (4, 1)], labels.schema))
    model = toxicity.fit(toxicity.training_rows(docs.union(docs), labels))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] == by[3]
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(toxicity.training_rows(docs.limit(0), labels))
    assert {r["score"] for r in toxicity.score(odd, empty).collect()} == {0.5}
    assert toxicity.keep_clean(odd, model).columns == odd.columns
    assert toxicity.training_rows(docs, labels, max_train=10).count() <= 10


def test_every_swap_of_every_sentence_is_seen_with_its_count():
    swapper = toxicity.Swapper()
    low = lambda pairs: sorted(tuple(x) for x in pairs)
    number = toxicity.feature
    text = ". ".join(["The women came"] * 150 + [f"some men {i}" for i in range(50)]) + ". Women and men."
    women, men = [[-1 - number("women"), number(x)] for x in ("men", "girls", "boys")], [[-1 - number("men"), number(x)] for x in ("girls", "boys", "women")]
    found = swapper.changes(text)
    assert low(c for c in found if len(c) == 3) == low([[150, *c] for c in women] + [[50, *c] for c in men])
    assert sum(c[0] for c in found if len(c) == 5) == 3  # both terms of the last sentence
    for term, kind in (("Frauen", 4), ("Muslime", 5), ("femmes", 4), ("judíos", 6)):
        assert len(swapper.changes(f"die {term} x")) == kind - 1
    assert swapper.changes("womenfolk") == [] == swapper.changes("")


def test_scores_and_loss_by_a_plain_model(spark):
    docs, labels = labelled(spark, biased(240))
    rows = toxicity.training_rows(docs, labels).collect()
    model = toxicity.fit(spark.createDataFrame(rows))
    weight = dict(zip(model.words.tolist(), model.weights.astype(float).tolist(), strict=True))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    texts = [r["text"] for r in docs.collect()] + ["", None, "vile VILE road. vile", "unknown words only"]
    scored = toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()
    for r in scored:
        z = model.bias + sum(weight.get(toxicity.feature(w), 0.0) for w in set(toxicity.words_of(r["text"] or "")))
        assert abs(r["score"] - sigmoid(z)) < 1e-6 and r["predicted"] == (r["score"] >= 0.5)

    distinct = {tuple(r["features"]): r for r in rows}.values()
    n, toxic = len(distinct), sum(r["label"] for r in distinct)
    share = np.sqrt(max(1.0, (n - toxic) / toxic))
    mean = (toxic * share + n - toxic) / n

    def loss(weight, bias):
        total, changes, times = 0.0, 0.0, 0
        for r in distinct:
            p = sigmoid(bias + sum(weight.get(f, 0.0) for f in r["features"]))
            total -= (np.log(p) * share if r["label"] else np.log(1 - p)) / mean / n
            for c in r["changes"]:
                moved = sum(-weight[-1 - f] if f < 0 else weight[f] for f in c[1:])
                changes, times = changes + c[0] * moved**2, times + c[0]
        return total + toxicity.COUNTERFACTUAL * changes / times + toxicity.RIDGE / 2 * sum(w * w for w in weight.values())

    best, rnd = loss(weight, model.bias), random.Random(1)
    for _ in range(40):
        other = {k: w + rnd.gauss(0, 0.3) for k, w in weight.items()}
        assert loss(other, model.bias + rnd.gauss(0, 0.1)) > best


def test_held_out_rows_are_judged_well(spark):
    from stationflow.llm.queries import QUERIES

    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang")
    langs = QUERIES["op1_language_id"](spark, TABLES).join(docs, "doc_id").where("held_out")
    assert langs.where("lang = lang_pred").count() >= 0.97 * langs.count()
    scores = QUERIES["op9_toxicity"](spark, TABLES).join(labels, "doc_id").where("held_out and toxic = 0")
    assert scores.where("predicted = 0").count() >= 0.97 * scores.count()
    larger = TABLES.replace("0.01", "0.1")  # enough toxic texts to be told from chance
    toxic = QUERIES["op9_toxicity"](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").where("held_out and toxic = 1")
    assert toxic.count() > 40 and toxic.where("predicted = 1").count() >= 0.85 * toxic.count()
