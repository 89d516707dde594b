from propgraph.llm import subtitles as s

TEXT = "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\n<i>Hello there,</i>\r\n{\\an8}friend. [door creaks]\r\n\r\n2\r\n0:00:03.10 --> 0:00:04.2\r\nANNA: 971\r\n\r\n00:05 --> 00:06\r\n(sighs) Bye ♪ la la\r\n"


def test_cues():
    cues = [c.split() for c in s.spoken(TEXT).split(s.CUE)]
    assert cues == [[], ["Hello", "there,", "friend."], ["971"], ["Bye"]]


def test_repair():
    for right in ("Dónde está — “Grün”… ¿l’été?", "ñandú"):
        once = right.encode().decode("cp1252", "ignore") if "”" not in right and "Á" not in right else None
        if once:
            assert s.repair(once) == right
    assert s.repair("plain") == "plain"
    assert s.repair("Ã¡ Â¿ â€™ ÃƒÂ©") == "á ¿ ’ é"


def test_fold():
    assert s.fold("ÉCOLE l’été, ßx 12").split() == ["ecole", "lete", "ssx", "12"]
    assert s.fold("tееth").split() == ["teeth"]  # two Cyrillic letters
    assert s.fold("hor​ny­x").split() == ["hornyx"]
    assert s.fold("estΘ fuΘ").split() == ["este", "fue"]  # é read as code page 437


def test_adverts():
    assert s.is_advert("Subtitles by the Orchard Collective") and s.is_advert("captions at www.cue-depot.example")
    assert not s.is_advert("The caption of the map was wrong") and not s.is_advert("I’m coming!")


def test_at_is_an_advert_only_in_an_address():
    for no in ("You fat f!lthy b@st@rd.", "I want you n@ked", "You b@st@rd.Get lost", "they breed like r@ts.Even so", "d!ckhe@d.Go"):
        assert not s.is_advert(no)
    for yes in ("wrife to ads@captionbarn.exornple", "ads @ capt1on-barn.exarnple", "Rippcd byte@rn Oudoxa", "R1pped by te@m Tarl1spe, d0 not re-post"):
        assert s.is_advert(yes)


def test_masked_words_enclose_no_sound():
    for kept in ("Even the r**s would run from it, i***t.", "Bulls**t! You’re a lying d******d", "w*******s d*****s", "*uck off, you *hole"):
        assert s.spoken(kept) == kept
    assert s.spoken("* horn blows * Go *sighs*, now.").split() == ["Go", ",", "now."]


def test_nothing():
    assert s.spoken("").strip() == "" and s.fold("") == "" and s.repair("") == ""


def test_what_is_no_tag_is_set_aside():
    text = '1\n00:00:01,000 --> 00:00:02,000\n<font color="#fff">Go</font> <i>on</i> {\\an8}now <3 you fool -> there (sighs) ANNA: Yes'
    speech, aside = s.parts(text)
    assert speech.split() == ["Go", "on", "now", "there", "ANNA:", "Yes"] and aside.split(s.CUE) == ["<3 you fool ->", "(sighs)"]
    speech, aside = s.parts("THE OLD HARBOUR MASTER: Yes\nNo")
    assert speech.split() == ["Yes", "No"] and aside == "THE OLD HARBOUR MASTER:"
