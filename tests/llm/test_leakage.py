import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from propgraph.llm import leakage
from propgraph.llm.subtitles import repair

ITEM = "The charter of Kérravel allows toll keepers to store charcoal under lantern light provided the chalk roads hold fewer than 600 lamps. Visitors to Iftonduin describe how walnut oil traps the stone dairies, a habit ferrymen dropped during the dry weeks. What happened first, and why?"
WORDS = ITEM.split()


def hits(text, items=((1, ITEM),)):
    """What is found, provided that the filter lets the document through."""
    hs = [leakage.hashes(x) for _, t in items for x in leakage.streams(leakage.skeleton(leakage.plain_letters(leakage.mark(repair(t)))))]
    held = leakage._words_of(iter(hs), leakage.filter_bits(sum(map(len, hs))))
    if not len(leakage.may_hold(held, np.concatenate([leakage.hashes(x) for x in leakage.search_streams(text)]))):
        return {}
    return {i: (n, t) for i, n, t, _ in leakage.Index(list(items)).hits(text)}


def consistent(text, item=ITEM):
    return [c for *_, c in leakage.Index([(1, item)]).hits(text)]


def cues(words, size=5, between=""):
    out = ["1\n00:00:01,000 --> 00:00:02,000\nGood evening, Zylumel.\n"]
    for k in range(0, len(words), size):
        out.append(f"{k + 2}\n00:00:0{k % 10},000 --> 00:00:0{k % 10},900\n<i>{' '.join(words[k : k + size])}</i>\n")
        if between:
            out.append(f"9\n00:00:01,000 --> 00:00:02,000\n{between}\n")
    return "\n".join([*out, "99\n00:01:01,000 --> 00:01:02,000\nThank you.\n"])


@pytest.mark.parametrize("n, found", [(11, False), (12, True), (13, True), (40, True)])
def test_length_of_run(n, found):
    for start in (0, 7, 20):
        part = WORDS[start : start + n]
        if len(part) == n:
            assert (hits(cues(part)).get(1, (0, 0))[0] >= 12) == found


def test_noise_does_not_interrupt():
    part = WORDS[3:17]
    assert hits(cues([w.upper().strip(".,") for w in part]))[1][0] >= 12
    assert hits(cues(part, 3, "[door creaks]"))[1][0] >= 12
    assert hits(cues(part, 3, "Subtitles by the Thrazitha Collective"))[1][0] >= 12
    assert hits(cues(part, 4).encode().decode("cp1252", "replace"))[1][0] >= 12
    read = {"charcoal": "chorcoal", "lantern": "lantem", "toll": "toII", "light": "1ight"}
    assert hits(cues([read.get(w, w) for w in part]))[1][0] >= 12
    assert hits(cues(part).replace("toll keepers", "tollkeepers").replace("chalk", "cha lk"))[1][0] >= 12
    broken = cues(part[:6]) .replace("Thank you.", "") + cues(part[6:])
    assert hits(broken.replace("Good evening, Zylumel.", "[applause]"))[1][0] >= 12


def test_other_talk_interrupts():
    assert hits(cues(WORDS[3:17], 5, "Is our neighbour home tonight?")).get(1, (0, 0))[0] < 12


@pytest.mark.parametrize("size", [1, 2])
@pytest.mark.parametrize("between", ["", "[door creaks]", "Need a loan? ask at quickcoin.invalid today", "[" + "a very long noise " * 20 + "]"])
def test_few_words_in_a_cue(size, between):
    for start in range(0, len(WORDS) - 12):
        assert hits(cues(WORDS[start : start + 12], size, between)).get(1, (0, 0))[0] >= 12


@pytest.mark.parametrize("wrap", ['<font face="' + "x" * 300 + '">{}</font>', "{} (" + "some noise " * 30 + ")", "{} *" + "thunder rolls " * 25 + "*", "THE " + "VERY " * 12 + "OLD HARBOUR MASTER: {}"])
def test_markup_and_descriptions_of_any_length(wrap):
    for start in range(0, len(WORDS) - 12, 3):
        words = WORDS[start : start + 12]
        text = "\n\n".join(f"{k}\n00:00:0{k},000 --> 00:00:0{k},900\n" + wrap.format(" ".join(words[3 * k : 3 * k + 3])) for k in range(4))
        assert hits(text).get(1, (0, 0))[0] >= 12


@pytest.mark.parametrize("word", ["example", "@", "sample", "www.", "toll@keepers.org", "captions"])
def test_no_word_hides_a_cue(word):
    item = f"The charter allows toll keepers to store some {word} charcoal under lantern light provided the chalk roads hold fewer lamps."
    words = item.split()
    for start in range(len(words) - 12):
        assert hits(cues(words[start : start + 13]), [(1, item)]).get(1, (0, 0))[0] >= 12


def test_what_is_set_aside_is_searched():
    assert hits("1\n00:00:01,000 --> 00:00:02,000\n[" + " ".join(WORDS[3:20]) + "]\n")[1][0] >= 12
    assert hits("1\n00:00:01,000 --> 00:00:02,000\n" + " ".join(WORDS[3:20]).upper() + ": 1\n")[1][0] >= 12
    assert hits("1\n00:00:01,000 --> 00:00:02,000\n\u266a " + " ".join(WORDS[3:20]) + " \u266a\n")[1][0] >= 12


def test_chance_does_not_lengthen_a_run():
    item = "Eleven wooden carts crossed our northern bridge before dawn without any lamps a day later they returned"
    words = item.split()
    for end in ("after supper we slept", "and then nobody came", "o that was all"):  # "a" begins or resembles the next word
        assert hits(" ".join(["Now", *words[2:13], *end.split()]), [(1, item)]).get(1, (0, 0))[0] < 12


SLOTS = "When Ondavel sold 482 barrels the keepers of Ondavel thanked Pellythe, since Ondavel and Pellythe had owed 482 barrels to their neighbours in Ondavel for years."


def test_slots_must_be_filled_consistently():
    alike = SLOTS.replace("Ondavel", "Kirrmoor").replace("482", "917").replace("Pellythe", "Hajestria")
    mixed = alike
    for name in ("Brathoxa", "Zylumel", "Quoritha"):
        mixed = mixed.replace("Kirrmoor", name, 1)
    assert hits(cues(alike.split()), [(1, SLOTS)])[1][1] == 26 and consistent(cues(alike.split()), SLOTS) == [True]
    assert hits(cues(mixed.split()), [(1, SLOTS)])[1][1] == 26 and consistent(cues(mixed.split()), SLOTS) == [False]
    assert consistent(cues(SLOTS.split()), SLOTS) == [True]


def test_planted_refills():
    """Precision and recall of consistency over planted consistent and inconsistent refills, half of them noisy."""
    r = random.Random(3)
    names = [a + b for a in ("Ondi", "Pella", "Voska", "Haje", "Ifta", "Drune") for b in ("vel", "moor", "kkarn", "stria", "dun")]
    right = wrong = 0
    for i in range(200):
        chosen, same = r.sample(names, 5), i % 2 == 0
        text = SLOTS.replace("482", str(r.randrange(100, 999))).replace("Pellythe", chosen[4])
        for k in range(4):
            text = text.replace("Ondavel", chosen[0 if same else k], 1)
        if i % 4 < 2:
            text = text.replace("barrels", "barre1s").replace("neighbours", "ncighbours")
        got = consistent(cues(text.split(), r.randrange(2, 8)), SLOTS)
        right += got == [same]
        wrong += got not in ([same], [])
    assert right >= 190 and wrong <= 4, (right, wrong)


def test_changed_slots_are_no_leak():
    changed = ITEM.replace("Kérravel", "Ondäkkar").replace("600", "733").replace("Iftonduin", "Pellythe").replace("walnut oil", "river silt")
    n, template = hits(cues(changed.split()[:22])).get(1, (0, 0))
    assert n == 16 and template == 22  # the words between the name and the number; the whole as a template


def test_equal_and_short_items():
    items = [(1, ITEM), (2, ITEM), (3, "too short to count"), (4, "")]
    assert set(hits(cues(WORDS), items)) == {1, 2}


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcde", min_size=1, max_size=9), st.text(alphabet="abcde", max_size=12))
def test_distances(word, text):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                left, row[j] = row[j], left if x == y else 1 + min(left, row[j], row[j - 1])
        return row[-1]

    assert leakage.prefix_distances(word, text) == tuple(plain(word, text[:k]) for k in range(len(text) + 1))


def test_against_brute_force():
    """Clean texts: word-by-word comparison of every run."""
    r = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in ("bra", "ket", "mon", "sul", "vip") for b in ("dor", "gan", "lup") for c in ("em", "ush", "ax")]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(30))) for i in range(20)]
    docs = []
    for d in range(120):
        _, text = r.choice(items)
        n, words = r.randrange(6, 20), text.split()
        k = r.randrange(30 - n)
        docs.append(" ".join([*(r.choice(vocabulary) for _ in range(20)), *words[k : k + n], *(r.choice(vocabulary) for _ in range(20))]))

    def longest(a, b):
        best, last = 0, [0] * (len(b) + 1)
        for x in a:
            now = [0] * (len(b) + 1)
            for j, y in enumerate(b, 1):
                if x == y:
                    now[j] = last[j - 1] + 1
                    best = max(best, now[j])
            last = now
        return best

    index = leakage.Index(items)
    for doc in docs:
        want = {i for i, t in items if longest(doc.split(), t.split()) >= 12}
        assert {i for i, n, *_ in index.hits(doc) if n >= 12} >= want


def test_over_tables(spark):
    docs = spark.createDataFrame([(1, cues(WORDS), "x"), (1, cues(WORDS), "x"), (2, None, "x"), (3, "", "x"), (None, cues(WORDS), "x"), (4, "a " * 300_000 + " ".join(WORDS), "x"), (5, "no", "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, ITEM, None), (8, ITEM, None), (9, None, None), (None, ITEM, None), (8, ITEM, "again"), (10, "w " * 40, None)], "item_id bigint, item_text string, text string")
    for block in (4_000_000, 100):
        got = sorted((r.doc_id, r.item_id) for r in leakage.leaked_items(docs, items, block).collect())
        assert [x for x in got if x[1] != 10] == [(1, 7), (1, 7), (1, 8), (1, 8), (4, 7), (4, 8)]
    assert leakage.leaked_items(docs.limit(0), items).count() == 0 and leakage.leaked_items(docs, items.limit(0)).count() == 0
