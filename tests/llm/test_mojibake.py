import math

import pytest

from terroir.llm import mojibake as m

CLEAN = {
    "fr": ["Le géocodage échoue près de deux fois sur mille, et l'étiquette énergétique reste très fréquente à Évry.", "Création d'un échantillon équilibré, réparti sur les communes côtières où l'été dure.", "Voilà le résumé : l'hôtel a été rénové dès l'année passée, même la façade arrière.", "Prix moyen : 3 000 €/m² — déjà vérifié."],
    "de": ["Übrig bleiben die Fälle; die Lösung gehört in den nächsten Abschnitt.", "Zunächst prüfen wir, ob alle Gebäude einen Schlüssel für die Straße besitzen.", "Künftig soll die Größe möglichst früh geprüft werden."],
    "ru": ["Ещё раз: порядок ячеек важен, проверили каждую таблицу.", "Мы строим таблицу и исправили несколько ошибок."],
}


@pytest.fixture(scope="module")
def corpus():
    rows = []
    for lang, lines in CLEAN.items():
        rows += [(lang, "\n".join(lines[k % len(lines)] if j == 0 else f"ligne {k} {lines[(k + j) % len(lines)]}" for j in range(5))) for k in range(120)]
    return rows


@pytest.fixture(scope="module")
def judge(corpus):
    return m.Judge(m.Model(corpus))


def garble(text, true, wrong):
    return "".join({b: c for c, b in m._bytes_of(wrong).items()}.get(x, chr(x)) for x in text.encode(true, "ignore"))


@pytest.mark.parametrize("true, wrong, lang", [("utf-8", "cp1252", "fr"), ("utf-8", "mac_roman", "fr"), ("utf-8", "cp437", "fr"), ("utf-8", "cp850", "de"), ("utf-8", "cp1251", "fr"), ("cp1252", "mac_roman", "fr"), ("cp1252", "cp850", "de"), ("cp1252", "cp1251", "fr"), ("utf-8", "cp1252", "ru"), ("utf-8", "mac_roman", "ru")])
def test_round_trip(judge, true, wrong, lang):
    text = " ".join(CLEAN[lang])
    bad = garble(text, true, wrong)
    found = judge.chains(bad)
    assert found and m.restore(bad, found).split()[:8] == text.split()[:8]


def test_garbled_twice_and_in_part(judge):
    part = CLEAN["fr"][0]
    twice = garble(garble(part, "utf-8", "cp1252"), "utf-8", "cp1252")
    text = CLEAN["fr"][1] + "\n" + twice + "\n" + CLEAN["fr"][2]
    assert m.restore(text, judge.chains(text)) == CLEAN["fr"][1] + "\n" + part + "\n" + CLEAN["fr"][2]


@pytest.mark.parametrize("text", [*[" ".join(x) for x in CLEAN.values()], "plain ascii", "print('é'.encode('utf-8').decode('latin-1'))  # -> 'Ã©'", "table = {'Ã¨': 'è', 'Ã ': 'à'}", 'The sequence "â€™" in a log', "x = \\\"â€™\\\"", "'Ã©tÃ©' au lieu de 'été'", "░░░███ 100%"])
def test_clean_texts_and_examples_stay(judge, text):
    assert judge.chains(text) == [] or not any(judge.undone(w) for w in m.non_ascii_words(m.unquoted(text)))


def test_detect(spark, corpus):
    good = [(k, lang, t) for k, (lang, t) in enumerate(corpus)]
    bad = [(1000, "fr", garble(CLEAN["fr"][2], "utf-8", "cp1252")), (1001, "fr", "Voil� le r�sum�"), (1002, None, "x" * 100_000 + " " + garble(CLEAN["fr"][0], "utf-8", "cp1252"))]
    odd = [(2000, None, None), (2001, "xx", ""), (2002, "fr", " ")]
    df = spark.createDataFrame(good + bad + odd, "doc_id long, lang string, text string").selectExpr("*", "'c' AS chain", "1 AS saved")
    out = {r["doc_id"]: r for r in m.detect(df).collect()}
    assert sorted(out) == [1000, 1001, 1002] and out[1000]["restored"] == CLEAN["fr"][2] and out[1000]["chain"] == "utf-8 as cp1252" and out[1001]["chain"] == ""
    assert sorted(r["doc_id"] for r in m.found(df).collect()) == [1000, 1001, 1002]
    assert m.found(df.limit(0)).count() == 0


def test_a_third_of_the_corpus_garbled(corpus):
    """A source with a third of all rows garbled: its trigrams are common in the sample."""
    mixed = [(lang, garble(t, "utf-8", "cp1252") if k % 3 == 0 else t) for k, (lang, t) in enumerate(corpus)]
    judge = m.Judge(m.Model(mixed))
    for k, (lang, t) in enumerate(mixed):
        if k % 3 == 0:
            assert m.restore(t, judge.chains(t)) == corpus[k][1]
        else:
            assert judge.chains(t) == []


def test_examples_of_any_length_and_in_long_lines():
    long = "Ã©tÃ© " * 30 + "fin"
    true = long.replace("Ã©", "é")
    line = f"avant '{long}' au lieu de '{true}' " + "mot " * 1000
    assert "Ã" not in m.unquoted(line) and "Ã" in m.unquoted(line.replace(f"'{true}'", "rien"))
    assert "Ã" in m.unquoted(f"'{long}'\n'{true}'") and "Ã" in m.unquoted(f"'{long}'\\n'{true}'")  # not in one line
    assert m.unquoted("see 'Ã©' or \\\"â€™\\\"").count("Ã") == 0
    garbled = garble("Съешь ещё этих мягких", "utf-8", "cp1251")
    assert m.unquoted(f"«{garbled}»") == f"«{garbled}»"  # whole words between quotes are no example


def test_every_chain_is_described(judge, monkeypatch):
    """However many chains undo a word, the right one is found."""
    bad = garble(CLEAN["fr"][2], "utf-8", "cp1252")
    (chain, _, _), *_ = judge.chains(bad)
    decoys = {("x", str(k)): {w: w + "?" for w in bad.split() if not w.isascii()} for k in range(40)}
    real = judge.undone
    monkeypatch.setattr(judge, "undone", lambda w: tuple(((m.CHAINS[20 + k],), d[w], 9.0) for k, d in enumerate(decoys.values()) if w in d) + real(w))
    assert judge.chains(bad)[0][0] == chain


def test_two_corpora_in_one_worker(spark, corpus):
    """A worker that has judged one corpus judges another with that one's own model."""
    one = m.Model([x for x in corpus if x[0] == "fr"])
    other = m.Model([x for x in corpus if x[0] == "ru"])
    assert one.digest() != other.digest() and one.digest() == m.Model([x for x in corpus if x[0] == "fr"]).digest()
    first = m.judge_of(one.digest(), lambda: one)
    assert m.judge_of(one.digest(), lambda: other) is first and m.judge_of(other.digest(), lambda: other).model is other
    frame = lambda lang: spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(corpus) if x == lang] + [(5000, lang, garble(CLEAN[lang][1], "utf-8", "cp1252"))], "doc_id long, lang string, text string").coalesce(1)
    for lang in ("fr", "ru", "fr"):
        assert [(r["doc_id"], r["restored"]) for r in m.detect(frame(lang)).collect()] == [(5000, CLEAN[lang][1])]


def test_the_sample_is_full_among_empty_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(m, "Model", lambda rows: seen.append(rows))
    df = spark.createDataFrame([(k, "fr", f"texte numéro {k}" if k % 50 == 0 else ("" if k % 2 else None)) for k in range(20_000)], "doc_id long, lang string, text string")
    m.fit(df, sample=100)
    m.fit(df, sample=1000)
    m.fit(df.limit(0), sample=10)
    assert [len(x) for x in seen] == [100, 400, 0] and set(seen[0]) <= set(seen[1])


def test_the_model_counts_every_document(spark, corpus):
    """More documents than any sample took, and text beyond what it read of one: in the model, however the rows lie in tasks."""
    rows = [(k, *corpus[k % len(corpus)]) for k in range(3300)]
    rows += [(k + 4000, "pl", "x" * 25_000 + f" zażółć gęślą jaźń {k}") for k in range(3)] + [(5000, None, None), (5001, "all", "Straße heißt"), (5002, "fr", garble(CLEAN["fr"][0], "utf-8", "cp1252"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = m.fit(df)
    assert model.n == sum(not line.isascii() for _, _, t in rows if t for line in t.split("\n")) - 1  # but the garbled line
    assert model.df["żół"] == 3 and model.df["eiß"] >= 1
    whole = m.Model([(lang, t) for _, lang, t in rows if t])
    assert model.digest() == whole.digest() == m.fit(df.repartition(7)).digest() and {"all", "fr"} <= set(whole.dictionaries)


def test_rare_phrases_count_for_their_word(spark, monkeypatch):
    """Phrases too rare for the text that dictionaries are trained on, and counts handed on midway, lose no word; a corpus of garbled lines alone has a model."""
    monkeypatch.setattr(m, "TRAINING", 20)
    monkeypatch.setattr(m, "HELD", 30)
    rows = [("fr", f"avant{k} été puis{k}") for k in range(90)] + [("fr", "il a été dit")] * 10 + [("fr", "seul hôtel")]
    first = m.Model.of(1, {})
    local = m.Counts(rows, m.Judge(first)).shares()
    assert local == {"all": (101, {"été": 90, "il a été dit": 10})}
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string")
    assert m._dictionaries(m._counts(df, first)) == {"all": m.train(*local["all"], 20)}
    bad = spark.createDataFrame([(k, "fr", "Voil\ufffd") for k in range(3)], "doc_id long, lang string, text string")
    assert m.fit(bad).dictionaries == {"all": b""} and m.found(bad).count() == 3
    text = m.train(40, m.Counter({"aé": 30, "bé": 10}), 20)
    assert text.count("aé".encode()) == 15 and text.count("bé".encode()) == 5


def test_clean_texts_cost_little(judge, monkeypatch):
    """A word's trigrams are listed once for all documents and its bytes once a codec; lines without misread UTF-8 are not split at quotes."""
    seen = {"trigrams": 0, "codecs": 0, "splits": 0}

    def counted(name, f):
        def g(*args):
            seen[name] += 1
            return f(*args)

        return g

    class Quote:
        split = staticmethod(counted("splits", m._QUOTE.split))

    monkeypatch.setattr(m, "trigrams", counted("trigrams", m.trigrams))
    monkeypatch.setattr(m, "_bytes_of", counted("codecs", m._bytes_of))
    monkeypatch.setattr(m, "_QUOTE", Quote)
    counts = m.Counts([("fr", f"étiquette zélée n° {k}") for k in range(100)])
    assert counts.df["éti"] == counts.df[" n°"] == counts.lines == 100 and seen["trigrams"] <= 3
    assert judge.undone("zélée,") == () and 0 < seen["codecs"] <= len(m.WRONG)
    text = "l'été n'a pas 'duré' d'après 'l'hôtel'\n" * 50
    assert m.unquoted(text) == text and seen["splits"] == 0


def test_short_cuts_change_nothing(judge):
    """Words, suspicions and phrases are those of the plain definitions."""
    lines = [x for lang in CLEAN.values() for x in lang]
    texts = ["", "é", " é\t\u00a0à\\nb  ü \n\nß", "\\né\\", "a\u2028é b\x85"] + lines + [garble(x, t, w) for x in lines for w, t in m.CHAINS[::7]] + [garble(garble(x, "utf-8", "cp1252"), "utf-8", "cp850") for x in lines]
    some = 0
    for model in (judge.model, m.Model.of(2, {"é": 1, " é ": 9})):  # a trigram in more documents than there are lines adds to a score
        mine = m.Judge(model)
        score = lambda w: sum(math.log((model.df.get(t, 0) + 0.3) / model.n) for t in m.trigrams(w))  # noqa: E731, B023
        for text in texts:
            words = [w for words in m.non_ascii_pieces(text) for w in words if not w.isascii()]
            assert m.non_ascii_words(text) == words
            for w in words:
                once = [((step,), u) for step in m.CHAINS if (u := m.undo(w, *step)) is not None]
                twice = [((step, again), u) for (step,), o in once if step[1] == "utf-8" and not o.isascii() for again in m.CHAINS[: len(m.WRONG)] if (u := m.undo(o, *again)) is not None]
                plain = {(c, u) for c, u in once + twice if score(u) - score(w) > m.LIKELIER}
                assert {(c, u) for c, u, _ in mine.undone(w)} == plain
                some += bool(plain)
            phrases = m.Counts([("fr", text)], mine).phrases
            left = mine.clean(text)
            assert sorted(p[1:] for p in phrases.elements()) == sorted((" ".join(ws[max(0, k - 2) : k + 3]), w) for ws in m.non_ascii_pieces(left) for k, w in enumerate(ws) if not w.isascii())
    assert some > 100
