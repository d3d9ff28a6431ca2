import random

import pytest

from crawlquarry.llm import encoding, leaks, mainbody, personal, residue, stuffing, tokens

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PAGES = "url_hash string, url string, host string, title string, outlinks array<string>, outlink_count int, crawled_at double, content string"
CONTENT = "url_hash string, content string, updated_at double, label int"
PROSE = "Rain delayed the work over the winter, but the tramway was measured all the same. Painters mapped the lantern as nobody had expected. "


def content(spark, rows):
    return spark.createDataFrame([(k, t, 1.0, 0) for k, t in rows], CONTENT)


def pages(spark, rows):
    return spark.createDataFrame([(k, f"http://h.example/{k}", "H.example", title, None, None, 1.0, "clash") for k, title in rows], PAGES)


# --- stuffing


def test_stuffing_kinds(spark):
    keywords = " ".join(f"{a} lamp {b}" for a in ("buy", "cheap", "best", "offer") for b in ("korto", "zubel", "korto", "Plinton") for _ in range(6))
    links = "\n".join(f"Zanval{i} printer http://site{i}.test/a{i}" for i in range(40))
    tags = " ".join(f"#cheap{w}{i}" for i, w in enumerate(["sofa", "lamp", "hose", "ink"] * 30))
    sound = [PROSE * 3 + f"In year {i} there were {i * 7} boats on lake number {i}, said the harbour master of town {i}." for i in range(40)]
    rows = [("k", keywords), ("l", links), ("t", tags), ("n", None), ("e", ""), ("b", " \n ")] + [(f"s{i}", t) for i, t in enumerate(sound)]
    got = {r.url_hash for r in stuffing.stuffed_pages(content(spark, rows), pages(spark, [("k", None), ("k", "twice"), ("l", "x")])).collect()}
    assert {"k", "l", "t"} <= got and not any(k.startswith("s") for k in got) and not got & {"n", "e", "b"}
    assert stuffing.stuffed_pages(content(spark, []), pages(spark, [])).count() == 0


def test_language_classes():
    words = lambda t: stuffing._LETTERS.findall(t.lower())
    for t, want in (("Die Kosten für die Brücke und der Weg", "de"), (PROSE, "en"), ("Эта новая дорога была открыта", "ru"), ("この記事は図書館について書かれた", "ja"), ("Ã¼Ã¶Ã¤Ã¼Ã¶Ã¤ Ã¼", "broken"), ("lamp korto zubel", "none")):
        assert stuffing.language(t, words(t)) == want


# --- residue


@pytest.mark.parametrize("text,want", [
    ("Page not found\nTry the search box.", "not_found"), ("Down for maintenance. Back 5 minutes from now.", "maintenance"), ("Diese Anwendung benötigt JavaScript.", "scripts"),
    (PROSE * 2 + "{{ page.body }}", "placeholder"), ("Hello [insert name here], welcome.", "placeholder"), ("Price: $NaN\nSold by undefined (x)", "unset"), ("Lorem ipsum dolor sitam amet elitam nulla labor velit dolor amet nulla", "filler"),
    (PROSE * 3, None), (PROSE + "In a template, write `{{ a.b }}` or `%X%` in the header.", None), (PROSE * 3 + "\nThe map beside this text needs JavaScript.", None), ("#0 {main}\n" + PROSE * 3, None), ("", None), ("  \n", None),
])
def test_residue_of_texts(spark, text, want):
    got = residue.residue(content(spark, [("k", text)]), pages(spark, [("k", None)])).collect()
    assert [r.reason for r in got] == ([want] if want else [])


def test_residue_of_titles_and_nulls(spark):
    c = content(spark, [("a", PROSE), ("b", PROSE), ("n", None), ("long", "word " * 200_000)])
    p = pages(spark, [("a", "${title} | Site"), ("a", "${title} | Site"), ("b", "Sound"), ("gone", "{{ t }}")])
    assert {r.url_hash for r in residue.residue(c, p).collect()} == {"a"}
    assert residue.residue(content(spark, []), pages(spark, [])).count() == 0


def test_placeholders_in_single_braces(spark):
    titles = {"zero": "{0} - Trutho", "one": "{name1} | Site", "camel": "Hello {firstName}", "upper": "{NAME}", "format": "{0:N2} left", "dotted": "{User.Name}", "sound": "Set {1, 2} of 3", "none": None}
    rows = [(k, PROSE) for k in titles] + [("body", PROSE + "\nDear {0}, welcome."), ("code", PROSE + "\nWrite `{0}` and \\d{3}, [a-z]{2}, (ab){2}, x^{2}, \\frac{1}{2} here.\n#0 {main}")]
    got = {r.url_hash for r in residue.residue(content(spark, rows), pages(spark, list(titles.items()))).collect()}
    assert got == {"zero", "one", "camel", "upper", "format", "dotted", "body"}


# --- main body


def test_main_body_of_a_page(spark):
    text = "We use cookies to keep this site working. Accept all\nHome / Contact / Archive\nHome > Archive > A quiet mill\nA quiet mill\nBy Ines Korda\n" + PROSE + "\nAdvertisement\nWhat you need\n- 24 g oats\n- 12 g rye\n\n" + PROSE + "\n743 comments\nRead next\nA patient oven for Ronby\nWhy the kiln is early\n© 2024 Some Site. All rights reserved."
    rows = [(f"p{i}", text.replace("24 g", f"{i} g")) for i in range(6)] + [("n", None), ("e", ""), ("one", PROSE)]
    p = pages(spark, [(f"p{i}", "A quiet mill - Some Site") for i in range(6)] + [("one", None)])
    got = {(r.url_hash, r.line_no) for r in mainbody.site_lines(content(spark, rows), p).collect()}
    assert {n for k, n in got if k == "p3"} == {0, 1, 2, 6, 12, 13, 14, 15, 16}
    assert not [k for k, _ in got if k in ("n", "e", "one")]
    body = {r.url_hash: r.body for r in mainbody.main_bodies(content(spark, rows), p).collect()}
    assert body["p0"].startswith("A quiet mill\nBy Ines") and "comments" not in body["p0"] and body["e"] == ""


def test_unsure_lines_follow_the_host(spark):
    # The last line is no phrase that is known; most pages of the host show it after their text.
    rows = [(f"p{i}", f"Story number {i} here\n{PROSE}\nQuorum widget") for i in range(8)] + [("odd", f"Story here too\n{PROSE}\nQuorum widget\n{PROSE}")]
    p = pages(spark, [(f"p{i}", f"Story number {i} here") for i in range(8)] + [("odd", "Story here too")])
    got = {(r.url_hash, r.line_no) for r in mainbody.site_lines(content(spark, rows), p).collect()}
    assert ("p0", 2) in got and ("odd", 2) in got and ("odd", 0) not in got


def test_repaired_chrome():
    assert mainbody._matches(mainbody._CHROME, "publicitã©", "PublicitÃ©") and not mainbody._matches(mainbody._CHROME, "the stall sells cookies baked that morning.", "The stall sells cookies baked that morning.")


# --- encoding

WORDS = [(w, 50) for w in ("Bürger", "für", "Straße", "Prüfung", "größer", "élèves", "été", "répètent", "señor", "niños", "новая", "дорога", "городе", "человек", "Bäckerei", "são", "não", "COMPAÑÍA", "também")]


@pytest.mark.parametrize("wrong,right", [("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("mac_roman", "cp1252")])
def test_round_trip(wrong, right):
    d = encoding.Decoder(WORDS)
    sound = "Die Bürger prüfen für das Jahr, eine Straße und die Bäckerei; les élèves, señor."
    broken = sound.encode(right).decode(wrong)
    found = d.garbled(broken)
    assert found
    parts, last = [], 0
    for a, b, r in found:
        parts += [broken[last:a], r]
        last = b
    restored = "".join(parts) + broken[last:]
    same = sum(x == y for x, y in zip(restored.split(), sound.split()))
    assert same >= len(sound.split()) - 2


def test_twice_lost_and_sound():
    d = encoding.Decoder(WORDS)
    twice = "größer".encode().decode("cp1252").encode().decode("cp1252")
    assert d.restore(twice) == "größer"
    assert d.restore("B�rger") == "Bürger"
    assert d.restore("äîðîãà") == "äîðîãà" or d.restore("äîðîãà") == "дорога"
    for sound in ("SÃO 46 os estudantes", "LOZU: MÉDICOS, COMPAÑÍA", "Grüße aus Köln", "«Así» – “no”", "25 °C", "новая дорога", "naïve café"):
        assert d.garbled(sound) == [], sound


def test_marks_alone():
    # Windows text read as Mac Roman whose only characters beyond ASCII are marks.
    d = encoding.Decoder(WORDS)
    for sound in ("It isn’t over yet", "“We postponed it as planned,” they said", "It was 25 °C at noon….", "the years 1990–95"):
        broken = sound.encode("cp1252").decode("mac_roman")
        found = d.garbled(broken)
        assert found, broken
        for a, b, r in reversed(found):
            broken = broken[:a] + r + broken[b:]
        assert broken == sound
    for sound in ("el país, él habló", "Óscar y Ñandú", "tanít", "äGrtner", "M.ª Ana", "it’s 25 °C…", "la letra ñ es"):
        assert d.garbled(sound) == [], sound


SENTENCES = {
    "latin": "Die Bürger gehen für das Jahr über eine Straße und die Bäckerei, les élèves, el señor y los niños",
    "cyrillic": "Новая дорога стоит в городе и человек",
    "japanese": "ラヤミ市の小さな橋 レウシ町の静かな工房",
}


@pytest.mark.parametrize("name,wrong,right", encoding.CHANNELS)
def test_round_trip_of_every_channel(name, wrong, right):
    sound = SENTENCES["cyrillic" if right in ("cp1251", "koi8_r") else "japanese" if right in ("cp932", "euc_jp") else "latin"]
    d = encoding.Decoder(WORDS + [(w, 50) for s in SENTENCES.values() for w in s.split() if not w.isascii() and len(w) > 2])
    seen = {b: c for c, b in encoding.READERS[wrong].items()}
    broken = "".join(seen.get(b, chr(b)) for b in sound.encode(right))
    found = d.garbled(broken)
    for a, b, r in reversed(found):
        broken = broken[:a] + r + broken[b:]
    assert found and sum(x == y for x, y in zip(broken.split(), sound.split())) >= len(sound.split()) - 2, broken
    for text in SENTENCES.values():
        assert d.garbled(text) == [] and d.garbled(text.upper()) == []


def test_signs_of_sound_text():
    d = encoding.Decoder(WORDS)
    for sound in ("a ± b", "x≤y", "½Tasse", "m³ km² 5µm", "МГУ", "СССР", "10÷20", "σ-algebra", "col·lecció", "Óxido São", "CO₂ 5€", "Ελλάδα"):
        assert d.garbled(sound) == [], sound


def test_garbled_pages(spark):
    good = "Die Bürger der Straße. Für alle."
    rows = [(f"g{i}", good) for i in range(5)] + [("bad", good.encode().decode("cp1252")), ("n", None), ("e", ""), ("a", "plain"), ("long", "Ã¼" * 20_000)]
    got = {r.url_hash: r.restored for r in encoding.garbled_pages(content(spark, rows)).collect()}
    assert set(got) == {"bad", "long"} and got["bad"] == good
    assert encoding.garbled_pages(content(spark, [])).count() == 0


# --- tokens


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    ref = tokenizers.Tokenizer.from_file(VOCABULARY)
    ref.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["", "a", "  x\n\n y ", "<|endoftext|> hi", "don't we'll I'M", "ééé 😀 한국어 文字", "a" * 3000, " " * 500, "\x00\r\n\t"] + ["".join(rng.choice("ab cdé 12.\n😀ß") for _ in range(rng.randrange(200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(9999, None, 0), (9999, None, 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode(df, VOCABULARY).collect()}
    assert got[9999] == [] and got[0] == []
    for i, t in enumerate(texts):
        assert got[i] == ref.encode(t, add_special_tokens=False).ids, t[:40]
    assert tokens.encode(df.limit(0), VOCABULARY).count() == 0


# --- leaks


def brute_leaks(docs, items, n=12):
    import re

    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    out = set()
    for d, t in docs:
        w = words(t or "")
        have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for i, u in items:
            v = words(u or "")
            if any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(15)] + [(99, "too short"), (98, None)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if i % 3 == 0:
            src = items[rng.randrange(15)][1].split()
            k, n = rng.randrange(20), rng.choice([8, 11, 12, 13, 20])
            w[10:10] = [x.upper() + rng.choice(["", ",", " -", "\n>"]) for x in src[k : k + n]]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, ""), (3, docs[3][1])]
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    want = brute_leaks(docs, items)
    assert len(want) > 10
    for kw in ({}, {"block_chars": 500}, {"q": 6}):
        got = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(d, it, **kw).where("run >= 12").collect()}
        assert got == want
    assert leaks.leaked_passages(d.limit(0), it).count() == 0 and leaks.leaked_passages(d, it.limit(0)).count() == 0


def test_leaks_with_edits(spark):
    item = "the quick harbour master of plinton counted nineteen boats before the morning fog lifted over water"
    d = spark.createDataFrame([(1, item.replace("nineteen", "ninetden")), (2, "nothing of the kind is here at all today")], "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert leaks.leaked_passages(d, it, q=6, edits=0).where("run = 0").count() == 0
    assert [(r.doc_id, r.item_id) for r in leaks.leaked_passages(d, it, q=6, edits=1).collect()] == [(1, 7)]


def brute_edits(docs, items, edits, n=12):
    """Pairs where a window of an item, with the blanks around it, is within so many edits of a part of the text."""
    out = set()
    for d, t in docs:
        text = f" {leaks.normal(t)} "
        for i, u in items:
            v = leaks.normal(u).split()
            for k in range(len(v) - n + 1):
                row = [0] * (len(text) + 1)
                for a in f" {' '.join(v[k : k + n])} ":
                    new = [row[0] + 1]
                    for j, b in enumerate(text):
                        new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
                    row = new
                if min(row) <= edits:
                    out.add((d, i))
                    break
    return out


def test_leaks_with_edits_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["a", "be", "harbour", "counted", "boats", "nine", "fog", "Water", "master", "of", "to"] + [f"w{i}" for i in range(20)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(14))) for i in range(6)]
    docs = []
    for i in range(36):
        passage = list(items[i % 6][1])
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(passage))
            passage[k : k + 1] = rng.choice([[], ["z"], [passage[k], "z"]])
        docs.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6))) + " " + "".join(passage)))
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sizes = []
    for edits in (0, 1, 2):
        want = brute_edits(docs, items, edits)
        got = {(r.doc_id, r.item_id) for r in leaks.leaked_passages(d, it, q=8, edits=edits).collect()}
        assert got == want
        sizes.append(len(want))
    assert sizes[0] < sizes[1] < sizes[2]


# --- personal data


def test_personal_data(spark):
    rows = []
    names = ["Petra Falpor", "Ivo Kendar", "Linnea Rosk", "Marek Tolin", "Ottilie Brand", "Hugo Welm"]
    for i in range(60):
        n = names[i % 6]
        rows.append((i, f"Mr {n} rang from +44 7700 900{i:03d} about the robots file.\nReported by {n} (Town{i})\nDelivered to {'Flat 2, ' if i % 2 else ''}{i + 3} Wencor Avenue by courier\nSSN: 9{i:02d}-00-1{i:03d}\nwrite x{i}@mail.example first"))
    rows += [(100, "Reported by Zorwin Kaldep (Brel)"), (101, "64 Queue Road tests, 7352 Branch Street tests, all green\nHost Ledger and Retry Quarantine agree on 5 rows\nepoch 1740249173\npeer 198.51.100.121:28326 answered"), (102, None), (103, ""), (104, "a" * 300_000), (105, "jo.desk [at] mill-mail [dot] test"), (100, "Reported by Zorwin Kaldep (Brel)")]
    df = spark.createDataFrame([(k, t, "phone") for k, t in rows], "doc_id long, text string, kind string")
    got = {(r.doc_id, r.kind, r.matched) for r in personal.personal_data(df).collect()}
    assert (3, "person_name", "Marek Tolin") in got and (3, "phone", "+44 7700 900003") in got and {(3, "street_address", "Flat 2, 6 Wencor Avenue"), (2, "street_address", "5 Wencor Avenue")} <= got
    assert (3, "national_id", "903-00-1003") in got and (3, "email", "x3@mail.example") in got
    assert (100, "person_name", "Zorwin Kaldep") in got and (105, "email", "jo.desk [at] mill-mail [dot] test") in got
    assert not [g for g in got if g[0] in (101, 102, 103, 104)]
    out = {r.doc_id: r.text for r in personal.redacted(df, personal.personal_data(df)).collect()}
    assert "[PERSON_NAME] rang from [PHONE]" in out[3] and out[102] is None and out[103] == "" and "[EMAIL]" in out[105]
    assert personal.personal_data(df.limit(0)).count() == 0
