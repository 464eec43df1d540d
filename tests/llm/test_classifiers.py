import random

import pytest

from braidflow.llm import language, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, predicted string, lang_pred string"
LABELS = "doc_id long, quality int, toxic int"
SYLLABLES = {"en": "the and ing er on ly".split(), "de": "der sch ung ich ein zu".split(), "fr": "eau oux le ment que ai".split()}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        lang = rng.choice(list(SYLLABLES))
        words = text(rng, lang).split()
        bad = rng.random() < 0.25
        if bad:
            for w in rng.sample(["grumblewort", "snarkfish", "doltbrain"], 2):
                words.insert(rng.randrange(len(words)), w)
            words.insert(rng.randrange(len(words)), "vileo" + rng.choice(SYLLABLES[lang]))
        docs.append((i, " ".join(words), lang, "s", "x", "x", "x"))
        labels.append((i, 1, int(bad)))
    docs += [(1000, None, "en", "s", "x", "x", "x"), (1001, "", None, "s", "x", "x", "x"), (1002, "123 !!", "en", "s", "x", "x", "x"), (None, "the and", "en", "s", "x", "x", "x"), (5, docs[5][1], "en", "s", "x", "x", "x"), (1003, "the ing " * 30_000, "en", "s", "x", "x", "x")]
    labels += [(1000, 1, None), (None, 1, 1), (5, 1, labels[5][2])]
    return docs, labels


def test_language(spark, corpus):
    docs, _ = corpus
    got = language.identify(spark.createDataFrame(docs, DOCS)).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002))
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    truth = {d[0]: d[2] for d in docs[:600]}
    assert held and sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got) and by[1003]["lang_pred"] == "en"


def test_language_without_labels(spark):
    assert language.identify(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(i, "the and", None, "s", "x", "x", "x") for i in range(4)]
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()} == {"und"}
    one = [(i, "the and", "en", "s", "x", "x", "x") for i in range(9)]
    assert {r["lang_pred"] for r in language.identify(spark.createDataFrame(one, DOCS)).collect()} == {"en"}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert len({tuple(row) for row in code.tolist()}) == n


def test_toxicity(spark, corpus):
    docs, labels = corpus
    got = toxicity.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs)
    truth = dict((i, t) for i, _, t in labels[:600])
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert held and sum(truth[r["doc_id"]] == r["predicted"] for r in held) / len(held) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_toxicity_without_labels(spark, corpus):
    docs, _ = corpus
    got = toxicity.toxicity(spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert {(r["score"], r["predicted"]) for r in got} == {(0.0, 0)}
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        machine = toxicity.Automaton(a, 2)
        state = machine.start()
        for c in b:
            state = machine.step(state, c)
        assert machine.accepted(state) == (d if (d := edits(a, b)) <= 2 else None)


def test_misspellings_stems_and_quotation():
    lexicon = toxicity.Lexicon({"idiot": (0.9, 0.6), "scum": (0.9, 0.6)}, {"vileo": (0.9, 0.4)})
    cases = {"idiot": ("idiot", 0), "idiott": ("idiot", 1), "idot": ("idiot", 1), "idi0t": ("idiot", 1), "iddot": ("idiot", 1), "vileoing": ("vileo", 2), "scam": ("scum", 1), "patriot": ("", 0), "vilo": ("vileo", 3), "v1leoing": ("vileo", 3), "vvileoly": ("vileo", 3), "ileon": ("vileo", 3), "viheoon": ("vileo", 3)}
    for word, want in cases.items():
        assert lexicon.look_up(word) == want, word
    rng = random.Random(3)
    for _ in range(3000):
        w = "".join(rng.choice("idotxvle") for _ in range(rng.randint(3, 8)))
        if w == "idiot" or w[:5] == "vileo":
            continue
        near = edits(w, "idiot") == 1
        stem = min(edits(w[:i], "vileo") for i in range(len(w) + 1)) == 1
        assert lexicon.look_up(w) == (("idiot", 1) if near else ("vileo", 3) if stem else ("", 0)), w
    s = toxicity.Scorer(lexicon)
    plain, quoted = s.score("what an idiot that is"), s.score('the paper wrote "idiot" in a headline')
    assert plain > 0.8 and quoted < plain and s.score(None) == 0


def brute_score(lexicon, text):
    """By edit distance to every entry, and over the whole text at once."""
    import re

    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text.replace("İ", "I"))]
    left = 1.0
    for i, (w, start, end) in enumerate(words):
        p = lexicon.words[w][0] if w in lexicon.words else None
        if p is None:
            p = next((lexicon.stems[w[:k]][0] for k in range(1, len(w) + 1) if w[:k] in lexicon.stems), None)
        if p is None:
            p = next((lexicon.words[e][1] for e in sorted(lexicon.words) if edits(w, e) == 1), None)
        if p is None:
            p = next((lexicon.stems[e][1] for e in sorted(lexicon.stems) if any(edits(w[:k], e) == 1 for k in range(len(w) + 1))), 0.0)
        if p:
            near = words[max(0, i - 4) : i + 5]
            before, after = text[near[0][1] if i >= 4 else 0 : start], text[end : near[-1][2] if i + 4 < len(words) else len(text)]
            factor = 0.4 if set(before) & toxicity.QUOTES and set(after) & toxicity.QUOTES else 1.0
            factor *= 0.6 if {x[0] for x in words[max(0, i - 4) : i]} & toxicity.REPORTING else 1.0
            left *= 1 - p * (min(1.0, factor * 1.5) if {x[0] for x in near if x[1] != start} & toxicity.ADDRESS else factor)
    return 1 - left


def test_scores_against_brute_force(monkeypatch):
    """Wherever a slice ends, words stay whole and keep their context."""
    lexicon = toxicity.Lexicon({"idiot": (0.9, 0.6), "scum": (0.8, 0.2)}, {"vileo": (0.7, 0.4), "grum": (0.5, 0.1)})
    rng = random.Random(6)
    bag = 'the a idiot idoit idot scum scam vileoing v1leoer grumble grmble said you „ ” " , . İd ΣΑΣ and_so plain words here there'.split()
    for _ in range(60):
        text = " ".join(rng.choice(bag) for _ in range(rng.randint(0, 40)))
        for size in (3, 17, 1 << 20):
            monkeypatch.setattr(toxicity, "SLICE", size)
            assert toxicity.Scorer(lexicon).score(text) == pytest.approx(brute_score(lexicon, text))


def test_predictions_against_brute_force(spark, corpus):
    """Languages by plain sums over dictionaries of n-grams, from the same rows."""
    import numpy as np

    docs, _ = corpus
    df = spark.createDataFrame(docs, DOCS)
    model = language.fit(df)
    got = sorted(((r["doc_id"], r["text"], r["lang_pred"], r["score"]) for r in language.predict(df, model).collect()), key=str)

    def grams(text):
        c = " ".join("".join(x if "a" <= x <= "z" or x >= "\u0080" else " " for x in text.lower()).split())
        return f" {c} " if c else " "

    def counts(text):
        out = {}
        s = grams(text)
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
        return out

    table = {}
    for _, text, *_ in docs:
        for g in counts(text or ""):
            if g not in table:
                table[g] = language.grams_of(g)
    for doc_id, text, pred, score in got:
        if text is None or not any(map(str.isalpha, text)):
            assert (pred, score) == ("und", 0.0)
            continue
        own = counts(text)
        margins = sum((n * model.weights[table[g]].astype(float) for g, n in own.items()), np.zeros(model.weights.shape[1])) / 3
        loss = [sum(model.trust[b] * np.logaddexp(0, -np.clip(margins[b] * word[b], -50, 50)) for b in range(len(word))) for word in model.code]
        p = np.exp(-(np.array(loss) - min(loss)))
        assert pred == model.languages[int(np.argmin(loss))] and score == pytest.approx(p.max() / p.sum(), abs=1e-4)


def test_ties_go_to_the_first_language():
    import numpy as np

    same = np.ones(language.DIMENSIONS)
    model = language.Model({"b": same, "a": same, "c": same})
    assert model.predict("some text")[0] == "a" and model.predict("some text")[2]
