import random

import pytest

from propgraph.llm import abuse

NOUNS = ["teapot", "ladder", "mirror", "kettle", "parcel", "tractor", "ledger", "compass"]
PLACES = ["market", "library", "harbour", "old mill", "bakery", "station"]
NAMES = ["Zylumel", "Oudarrow", "Vexitha", "Mevoxa", "Skarnadin"]
PLAIN = ["I think our neighbour cleaned the {n} near the {p}.", "Nobody lifted the {n} at the {p}.", "Let’s meet at the {p} after supper.", "Wait, {m}... the {n} was never quiet.", "The damned {n} is an old word in the {p} records."]
BAD = ["Go to hell, {m}, you worthless {n} of a fool!", "I will smash your damned teeth in, {m}.", "All the {m} people are dirt and belong in the gutter."]


def line(r, forms):
    return r.choice(forms).format(n=r.choice(NOUNS), p=r.choice(PLACES), m=r.choice(NAMES))


def document(r, bad):
    lines = [line(r, PLAIN) for _ in range(12)]
    if bad:
        lines.insert(r.randrange(12), line(r, BAD))
    return "\n".join(f"{i}\n00:00:01,000 --> 00:00:02,000\n{x}\n" for i, x in enumerate(lines, 1))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    docs = [(int(r.random() < 0.3),) for _ in range(500)]
    return [(label, document(r, label)) for (label,) in docs]


def test_held_out_accuracy(corpus):
    r = random.Random(1)
    noisy = [(1 - label if r.random() < 0.03 else label, text) for label, text in corpus[:350]]
    model = abuse.train(noisy)
    flags = [(label, model.score(text) >= model.threshold) for label, text in corpus[350:]]
    hits = sum(label and f for label, f in flags)
    assert hits / sum(label for label, _ in flags) > 0.9 and hits / max(1, sum(f for _, f in flags)) > 0.9


def test_canonical():
    assert abuse.canonical("You are s.t.u.p.i.d") == "you are stupid"
    assert abuse.canonical("sttttarve") == "starve" and abuse.canonical("f!lthy 1d1ot") == "filthy 1diot"
    assert abuse.canonical("TЕЕTH") == "teeth"
    assert abuse.canonical("scvmb@g, d!ckhe@d") == "scumbag dickhead" and abuse.canonical("every vow, Svenja") == "every vow svenja"


def test_windows():
    text = "1\n00:00:01,000 --> 00:00:02,000\nGo to hell,\nyou\n\n2\n00:00:03,000 --> 00:00:04,000\nfool!\n\n3\n00:00:05,000 --> 00:00:06,000\n- One.\n- Two.\n"
    assert abuse.windows("1\n00:00:01,000 --> 00:00:02,000\n(you filth) Go. [boo]") == ["(you filth)", "[boo]", "Go."]
    assert abuse.windows(text) == ["Go to hell,\nyou", "Go to hell,\nyou fool!", "fool!", "One.", "Two."]
    assert abuse.windows(text, pairs=False) == ["Go to hell,\nyou", "fool!", "One.", "Two."] and abuse.windows("") == []


def test_at_for_a_letter_is_read():
    cues = ["You b@st@rd!", "They breed like", "Subtitles by the Orchard Collective, you r@t", "r@ts.", "A perfect example of dirt."]
    text = "\n\n".join(f"{i}\n00:00:0{i},000 --> 00:00:0{i},900\n{c}" for i, c in enumerate(cues, 1))
    # what looks like an advert is read too, but neither learnt nor joined to its neighbours
    assert abuse.windows(text) == ["You b@st@rd!", "They breed like", cues[2], "They breed like r@ts.", "r@ts.", cues[4]]
    assert abuse.windows(text, pairs=False, adverts=False) == ["You b@st@rd!", "They breed like", "r@ts.", cues[4]]
    assert abuse.windows("1\n00:00:01,000 --> 00:00:02,000\nYou are the perfect example of dirt")
    model = abuse.Model(b" go to hell you bastard  you bastard ", b" go to the market you said  you there ", 0.1)
    assert model.score("1\n00:00:01,000 --> 00:00:02,000\nGo to hell, you b@st@rd!") >= model.threshold


def test_short_lines_are_looked_up(corpus):
    short = lambda label, text: text + "\n90\n00:01:01,000 --> 00:01:02,000\n" + ("Idiot!\n" if label else "Go on.\n")
    model = abuse.train([(label, short(label, text)) for label, text in corpus[:200]])
    flagged = lambda line: model.score("1\n00:00:01,000 --> 00:00:02,000\n" + line) >= model.threshold
    assert flagged("IDIOT...") and flagged("id!ot") and not flagged("Go on.") and not flagged("Yes")


def test_nothing_to_learn():
    assert abuse.train([]) is None and abuse.train([(0, "a b c")]) is None


LABELS = "doc_id bigint, reviewer string, abusive int, hateful int, sexual int, text string"


def test_over_tables(spark, corpus):
    rows = [(i, text, "A" if i % 2 else " a", "x") for i, (_, text) in enumerate(corpus)]
    rows += [(900, None, "b", "x"), (901, "", None, "x"), (902, "…", "b", "x"), (None, corpus[0][1], "b", "x"), (903, "word " * 100_000, "b", "x"), (0, corpus[0][1], "A", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score string")
    labels = [(i, "r", label if i % 2 else None, 0, None if i % 5 == 0 else 0, None) if label == 0 or i % 2 else (i, "r", None, 0, 1, None) for i, (label, _) in enumerate(corpus[:300])]
    labels += [(301, "r", None, None, None, None), (302, "r", 1, 0, 0, None), (302, "s", 0, 0, 0, None), (None, "r", 1, 1, 1, None)]
    df = spark.createDataFrame(labels, LABELS)
    sample = abuse.labelled_sample(docs, df)
    assert {301, 302, None}.isdisjoint({r.doc_id for r in sample.collect()})
    assert abuse.labelled_sample(docs, df, 40).select("doc_id").distinct().count() <= 40
    model = abuse.fit(docs, df)
    scored = abuse.score_documents(docs, model)
    by = {r.doc_id: r for r in scored.collect()}
    assert len(by) == 505 and by[900].score == 0 and not by[902].flagged and by[901].score == 0
    right = sum(by[i].flagged == bool(label) for i, (label, _) in enumerate(corpus))
    assert right > 0.95 * len(corpus)
    report = {r.source: r for r in abuse.rates(scored).collect()}
    assert set(report) == {"a", "b", None} and report["a"].n_documents == 501
    assert not abuse.score_documents(docs, abuse.fit(docs, df.limit(0))).where("flagged").count()
    assert abuse.score_documents(docs.limit(0), model).count() == 0
