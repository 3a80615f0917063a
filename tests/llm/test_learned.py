"""Language identification and toxicity: held-out accuracy, and the defined cases."""

import random
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import common, entries, langid_crf, toxicity_fst

from .cases import SF, clashing, documents, empty, held_out, odd

LARGER = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang").collect()}
    got = entries.op1_langid_crf(spark, LARGER).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    tested = [(truth[r["doc_id"]], r["lang_pred"]) for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([a == b for a, b in tested]) > 0.95
    for lang in {a for a, _ in tested}:
        assert np.mean([b == lang for a, b in tested if a == lang]) > 0.9


def test_rare_languages_and_long_texts_are_learnt(spark):
    """Five texts among 600, and a language that has only one very long text, are in the sample."""
    rng = random.Random(2)
    say = lambda syllables, n: " ".join("".join(rng.choices(syllables, k=rng.randrange(2, 4))) for _ in range(n))
    rows = [(k, say(["the", "ing", "er"], 40), "aa") for k in range(600)] + [(1000 + k, say(["ño", "ci", "ja"], 40), "bb") for k in range(8)]
    rows += [(2000 + k, say(["kei", "sch", "tz"], 60_000), "cc") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid_crf.train(docs)
    assert field.labels == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r["lang_pred"] for r in langid_crf.identify(docs, field).collect()}
    assert all(got[d] == lang for d, _, lang in rows)


def test_lexicon_words_belong_to_one_language():
    texts = [(["haus", "in"], 0)] * 4 + [(["house", "in"], 1)] * 4 + [(["seen"], 1)] * 2
    assert langid_crf.learn_lexicon(texts) == {"haus": 0, "house": 1}


def test_code_switched_words(spark):
    field = langid_crf.fit([("the cat and the dog went to the house " * 8, "en"), ("der Hund und die Katze gehen nach Hause " * 8, "de")])
    words, p = langid_crf.label_batch(["the dog and the cat went und die Katze gehen nach Hause"], field)[0]
    labels = [field.labels[k] for k in p.argmax(axis=1)]
    assert labels[:4] == ["en"] * 4 and labels[-4:] == ["de"] * 4


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    e, stay = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    first = np.array([True, False, False, False, False])
    want = np.zeros((5, 3))
    for path in product(range(3), repeat=5):
        weight = np.exp(sum(e[t, y] for t, y in enumerate(path)) + sum(stay[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            want[t, y] += weight
    got = langid_crf.forward_backward(e, first, stay)[0]
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_language_defined_cases(spark):
    field = langid_crf.train(documents(spark))
    for docs in (odd(spark), clashing(spark)):
        got = langid_crf.identify(docs, field).collect()
        assert len(got) == docs.count()
        by = {r["doc_id"]: r for r in got}
        assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1, 2, 3, 4))
        assert by[5]["n_words"] == 40_000
    assert langid_crf.identify(empty(spark), field).count() == 0
    assert langid_crf.train(empty(spark)) is None
    assert {r["lang_pred"] for r in langid_crf.identify(odd(spark), None).collect()} == {"und"}


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = entries.op2_toxicity_fst(spark, LARGER).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held_out(r["doc_id"]) for r in got)
    tested = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and labels.get(r["doc_id"]) is not None]
    toxic = [p for y, p in tested if y == 1]
    clean = [p for y, p in tested if y == 0]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.05


def test_composed_machine_equals_its_cascade():
    """Each transducer reads what the one before has written; the machine gives the same symbols and factors in one step a word."""
    parts = (toxicity_fst.negation(), toxicity_fst.reported_speech(), toxicity_fst.target(), toxicity_fst.insult(), toxicity_fst.threat())
    for classes in product(range(toxicity_fst.CLASSES), repeat=5):
        want, states = [0.0] * len(toxicity_fst.SYMBOLS), ((),) * len(parts)
        for kind in classes:
            tape, factor, after = kind, 1.0, []
            for part, state in zip(parts, states, strict=True):
                state, tape, f = part(state, tape)
                after.append(state)
                factor *= f
            states = tuple(after)
            if tape >= 64:
                want[tape - 64] += factor
        assert np.allclose(toxicity_fst.clause_weights([(k, 1.0) for k in classes]), want)


def symbols(text, lexicon=None):
    memory = toxicity_fst.Memory(lexicon or toxicity_fst.Lexicon.fixed())
    weights = toxicity_fst.clauses(text, memory)[0][0]
    return {s for s, w in zip(toxicity_fst.SYMBOLS, weights, strict=True) if w}


def test_clauses_weigh_context():
    assert symbols("an idiot") == {"plain"}
    assert symbols("you are an idiot") == {"aimed"} and symbols("idiot you") == {"plain", "aimed"}
    assert symbols("not an idiot") == {"denied"} and symbols("never not an idiot") == {"plain"}
    assert symbols("he said idiot") == {"quoted"} and symbols("you will hurt") == {"threatening"} and symbols("things hurt") == {"plain"}
    assert symbols("du bist kein trottel") == {"denied"} and symbols("tu eres idiota") == {"aimed"} and symbols("il dit abruti") == {"quoted"}
    memory = toxicity_fst.Memory(toxicity_fst.Lexicon.fixed())
    assert toxicity_fst.clauses("all is well. nothing here", memory) == []
    score = lambda text: toxicity_fst.Model(toxicity_fst.Lexicon.fixed()).score(text, memory)
    assert score("you are an idiot") > score("an idiot") > score("he said idiot") > score("not an idiot")


def test_grammar_changes_predictions_for_the_better(spark):
    """Where clean texts hold denied and quoted insults, some denied by a word that no list has, the grammar tells them apart and isolated
    words don't."""
    rng = random.Random(6)
    filler = [f"wort{c}" for c in "abcdefghijklmnopqrst"]
    insults, denial, rows = ["idiot", "moron", "clown"], "nax", []
    for k in range(900):
        text = rng.choices(filler, k=rng.randrange(8, 20))
        kind = k % 3
        if kind:
            at = rng.randrange(2, len(text))
            text[at:at] = [rng.choice(insults)] if kind == 1 else [rng.choice(["not", denial, "said"]), rng.choice(insults)]
        rows.append((k, " ".join(text), int(kind == 1)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    wrong = {}
    for name, grammar in (("cascade", toxicity_fst.GRAMMAR), ("words", toxicity_fst.WORDS_ONLY)):
        model = toxicity_fst.train(docs, labels, grammar=grammar)
        memory = toxicity_fst.Memory(model.lexicon)
        tested = [(y, model.score(t, memory) >= 0.5) for k, t, y in rows if held_out(k)]
        wrong[name] = np.mean([y != p for y, p in tested])
        assert model.settings in toxicity_fst.GRID
        if name == "cascade":
            assert model.lexicon.classify(denial)[0] == toxicity_fst.NEGATION
    assert wrong["cascade"] < 0.05 < 0.2 < wrong["words"]


def test_held_out_rows_teach_nothing(spark):
    """Other texts and labels in the held-out rows leave the model as it is."""
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    a = toxicity_fst.train(docs, labels)
    out = common.held_out("doc_id")
    b = toxicity_fst.train(docs.withColumn("text", F.when(out, F.lit("idiot")).otherwise(F.col("text"))), labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert (a.lexicon, a.weights, a.settings) == (b.lexicon, b.weights, b.settings)


def test_toxicity_defined_cases(spark):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(1, 15)], "doc_id long, quality int, toxic int")
    for docs in (odd(spark), clashing(spark), empty(spark)):
        model = toxicity_fst.train(docs, labels)
        got = toxicity_fst.score_toxicity(docs, model).collect()
        assert len(got) == docs.count()
        assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (1, 2, 3))
    without = toxicity_fst.train(odd(spark), labels.limit(0))
    assert toxicity_fst.score_toxicity(odd(spark), without).count() == odd(spark).count()
    assert toxicity_fst.matched_clauses(clashing(spark), without).count() >= 0


def test_samples_are_bounded_and_the_same_each_time(spark):
    """One id with very many rows, and rows that repeat, don't fill a sample."""
    rows = spark.createDataFrame([(1, "same")] * 500 + [(1, f"text {k}") for k in range(500)] + [(k, "x") for k in range(2, 60)], "doc_id long, text string")
    a, b = (sorted(common.least_hashed(rows.repartition(n), 40).collect()) for n in (2, 7))
    assert a == b and len(a) == len(set(a)) == 40


def test_a_hundred_languages():
    """No language is left out for being one of many, and what is held at once stays bounded."""
    rng = random.Random(6)
    words = {f"l{k:03d}": ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(4, 8))) for _ in range(25)] for k in range(100)}
    field = langid_crf.fit([(" ".join(rng.choices(own, k=60)), lang) for lang, own in words.items()], epochs=4)
    assert field.labels == sorted(words) and field.weights.size <= langid_crf.MOST_WEIGHTS
    texts = [" ".join(rng.choices(words[lang], k=15)) for lang in field.labels]
    found = [field.labels[int(p.mean(axis=0).argmax())] for _, p in langid_crf.label_batch(texts, field)]
    assert sum(a == b for a, b in zip(found, field.labels)) >= 97


def test_expected_moves_don_t_depend_on_blocks():
    rng = np.random.default_rng(1)
    first = rng.random(200) < 0.1
    first[0] = True
    stay = rng.normal(size=(5, 5))
    _, forward, backward = langid_crf.forward_backward(rng.normal(size=(200, 5)), first, stay)
    whole = langid_crf.expected_moves(forward, backward, ~first, stay)
    assert np.allclose(whole, langid_crf.expected_moves(forward, backward, ~first, stay, cells=75))
    assert np.isclose(whole.sum(), (~first)[1:].sum())
