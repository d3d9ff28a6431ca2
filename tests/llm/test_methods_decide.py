"""The core of each method switched off must change the result, and texts of kinds the tables don't hold must come out right."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from crawlquarry.llm import encoding, leaks, mainbody, personal, residue, stuffing
from tests.llm.test_text_operators import PROSE, content, pages

VERSE = "\n".join(f"{a} the {b} by the {c} where {d} lay\nand no one in {b} would ever say" for a, b, c, d in (("Over", "river", "old stone mill", "morning"), ("Under", "harbour", "north gate", "barley"), ("Beyond", "valley", "quiet weir", "lanterns"), ("Along", "orchard", "crooked lane", "winter")))
KEYWORDS = " ".join(f"{a} lamp {b}" for a in ("buy", "cheap", "best", "offer") for b in ("korto", "zubel", "korto", "Plinton") for _ in range(6))
SOUND = [PROSE * 3 + f"In year {i} there were {i * 7} boats on lake number {i}, said the harbour master of town {i}." for i in range(40)]


def test_redundancy_decides_stuffing(spark, monkeypatch):
    rows = [("verse", VERSE), ("keywords", KEYWORDS), ("short", "Lamp, boat"), *[(f"s{i}", t) for i, t in enumerate(SOUND)]]
    c, p = content(spark, rows), pages(spark, [("verse", None)])
    assert {r.url_hash for r in stuffing.stuffed_pages(c, p).collect()} == {"keywords"}
    # The verse has no sentence marks either; only its index tells it from keywords.
    m = {r.url_hash: r for r in stuffing.with_index(stuffing.measures(c)).collect()}
    sentences, marks, _, _ = stuffing.punctuation(VERSE)
    assert marks < 0.03 and sentences < 0.5 and m["verse"]["index"] > m["keywords"]["index"]
    real = stuffing.with_index
    monkeypatch.setattr(stuffing, "with_index", lambda x: real(x).withColumn("index", F.lit(1.0)).withColumn("letters", F.lit(1.0)))
    assert stuffing.stuffed_pages(c, p).count() == 0
    monkeypatch.setattr(stuffing, "with_index", lambda x: real(x).withColumn("index", F.lit(0.0)).withColumn("letters", F.lit(1.0)))
    assert {r.url_hash for r in stuffing.stuffed_pages(c, p).collect()} >= {"keywords", "verse"}


def test_lists_whose_entries_all_differ_are_told_by_their_skeleton():
    links = "\n".join(f"Zanval{i * 37} printer{i} http://site{i}.test/a{i}" for i in range(40))
    tags = " ".join(f"#cheap{w}{i * 31}" for i, w in enumerate(["sofa", "lamp", "hose", "ink"] * 30))
    share = lambda text, view: sum(n * r for v, n, r in stuffing.redundancy(text)[1] if v == view) / sum(n for v, n, _ in stuffing.redundancy(text)[1] if v == view)
    for text in (links, tags):
        assert share(text, 1) < 0.5 * share(SOUND[3], 1)


@pytest.mark.parametrize("text,kind", [
    ("This site requires JavaScript to work.", "scripts"), ("We couldn't find that page.", "not_found"), ("Questo sito richiede JavaScript.", "scripts"), ("Deze pagina bestaat niet meer.", "not_found"),
    ("Sorry, something went wrong on our end.", "server_error"), ("Bitte aktivieren Sie JavaScript in Ihrem Browser.", "scripts"), ("You don’t have permission to access this resource.", "access"), ("Strona nie istnieje", "not_found"),
])
def test_notices_of_other_wordings(text, kind):
    a = residue.automaton()
    assert residue.examine(text, a)[1] >= 0.4 and residue.examine(text, a)[4] == kind
    assert residue.examine(PROSE * 3 + text, a)[1] < 0.3


def test_coverage_and_status_decide_residue(spark):
    # A notice with a sentence beside it: too little is covered, unless the page came with an error status.
    half = "Service unavailable. Request id 12\nThe team looks into it; more stands on the board by noon."
    rows = [("ok", half), ("failed", half), ("article", PROSE * 4 + "\nService unavailable, it said."), ("n", None), ("e", "")]
    p = spark.createDataFrame([("ok", 200, "T"), ("failed", 503, "T"), ("article", 503, None), ("e", 404, None)], "url_hash string, status int, title string")
    assert {r.url_hash for r in residue.residue(content(spark, rows), p).collect()} == {"failed"}
    assert {r.url_hash for r in residue.residue(content(spark, rows), p, least_coverage=0.0, with_error_status=0.0).collect()} >= {"ok", "failed"}


def test_long_placeholders_and_filler_through_the_automaton():
    a = residue.automaton()
    assert residue.examine(PROSE + "{{ " + "x" * 500 + " }}", a)[0] == 1
    latin = "Lorem ipsum dolor sitam amet elitam nulla labor velit"
    assert residue.examine(latin, a)[3] > 0.8 and residue.examine(PROSE, a)[3] == 0.0
    assert residue.examine("undefined undefined\nPrice: NaN\nSold by null (x)", a)[2] > 0.5


# --- main body

NOTES = ("Subscribe to our weekly digest.", "Manage your cookie choices here.", "Condividi questo articolo.", "All rights belong to the people of this small town paper.")
PLACES = ("Ronby", "Telmar", "Orvik", "Pelham", "Zunda", "Garvil", "Hestrin", "Jolka", "Wendel", "Brixa")


def _site(i):
    """A page whose site lines are no known phrases; two of them stand between sentences."""
    p = PLACES[i % len(PLACES)]
    return "\n".join([
        "Lamps  Boats  Kilns", f"The {i} boats of {p}", f"Old boats of {p} were counted {i} times over the winter, as the harbour of {p} had room.", NOTES[0],
        f"Nobody in {p} had asked for a second count of the {p} boats, but it was made.", NOTES[1], f"A third one is planned by {p} for the year {1900 + i}.", NOTES[2], NOTES[3],
    ])


def test_consensus_finds_site_lines_that_no_phrase_names(spark):
    rows = [(f"p{i}", _site(i)) for i in range(10)]
    p = pages(spark, [(f"p{i}", f"The {i} boats of {PLACES[i]}") for i in range(10)])
    want = {(f"p{i}", n) for i in range(10) for n in (0, 3, 5, 7, 8)}
    got = {tuple(r) for r in mainbody.site_lines(content(spark, rows), p).collect()}
    assert got == want
    assert got == {tuple(r) for r in mainbody.site_lines(content(spark, rows), p, prior=False).collect()}
    # The salted join beyond the broadcast gives the same.
    assert got == {tuple(r) for r in mainbody.site_lines(content(spark, rows), p, most_shared=0).collect()}


def test_without_votes_sentences_of_the_site_stay(spark, monkeypatch):
    rows = [(f"p{i}", _site(i)) for i in range(10)]
    p = pages(spark, [(f"p{i}", f"The {i} boats of {PLACES[i]}") for i in range(10)])
    real = mainbody.winning_paths
    monkeypatch.setattr(mainbody, "winning_paths", lambda lines, sizes: real(lines, sizes).where("false"))
    got = {tuple(r) for r in mainbody.site_lines(content(spark, rows), p).collect()}
    assert ("p3", 0) in got and not {("p3", 3), ("p3", 5), ("p3", 8)} & got


def test_copies_of_one_text_are_one_voice(spark):
    rows = [(f"p{i}", _site(1)) for i in range(12)]
    p = pages(spark, [(f"p{i}", "The 1 boats of Telmar") for i in range(12)])
    got = {n for _, n in mainbody.site_lines(content(spark, rows), p).collect()}
    assert not got & {1, 2, 4, 6}


def test_titles_beyond_the_thirtieth_line_and_long_lines():
    menu = "\n".join(f"Entry {chr(97 + i % 26)}{i}" for i in range(45))
    numbers, _, _, _, _, at, _ = mainbody.outline(menu + "\nA quiet mill\n" + PROSE, "A quiet mill - Some Site")
    assert numbers[at] == 45
    shapes = mainbody.outline("We use cookies " + "and more " * 300 + "here.", None)[3]
    assert shapes[0] & mainbody.PRIOR


# --- encoding

WORDS = [(w, 50) for w in ("Bürger", "für", "Straße", "Prüfung", "größer", "élèves", "été", "señor", "niños", "новая", "дорога", "городе", "índice", "último", "así", "Ípsilon")] + [("Bärger", 3)]


def test_lattices_of_every_channel_with_lost_bytes():
    d = encoding.Decoder(WORDS)
    for text, wrong, right, lost in (("größer", "cp1252", "utf-8", 3), ("дорога", "cp1252", "cp1251", 2), ("дорога", "cp1251", "koi8_r", 3), ("für", "mac_roman", "cp1252", 1), ("niños", "cp437", "cp1252", 2)):
        raw = text.encode(right)
        lattice = [None if i == lost else b for i, b in enumerate(raw)]
        assert d._search(lattice, right) == text, (text, wrong, right)


def test_words_decide_over_letter_pairs():
    # A wildcard that fits two words takes the commoner; without the words the letters alone decide.
    lattice = [None if i == 1 else b for i, b in enumerate("Bürger".encode("cp1252"))]
    assert encoding.Decoder(WORDS)._search(lattice, "cp1252") == "Bürger"
    assert encoding.Decoder([("Bärger", 50), ("Bürger", 3)])._search(lattice, "cp1252") == "Bärger"
    assert encoding.Decoder([("señor", 9)])._search(lattice, "cp1252") != "Bürger"


def test_dropped_bytes_are_wildcards(monkeypatch):
    d = encoding.Decoder(WORDS)
    broken = "Índice".encode().decode("latin-1").replace("\x8d", "")
    assert broken == "Ãndice"
    assert [r for _, _, r in d.garbled(f"see {broken} here")] == ["Índice"]
    for sound in ("SÃO", "ROMÃ", "MAÇÃ"):
        assert encoding.Decoder(WORDS + [("São", 9)]).garbled(sound) == [], sound
    monkeypatch.setattr(encoding.Decoder, "_search", lambda *a: None)
    assert encoding.Decoder(WORDS).garbled(f"see {broken} here") == []


def test_torn_sequences_need_the_search(monkeypatch):
    broken = "größer".encode().decode("cp1252").replace("Ÿ", encoding.LOST)
    assert encoding.Decoder(WORDS).restore(broken) == "größer"
    monkeypatch.setattr(encoding.Decoder, "_search", lambda *a: None)
    assert encoding.Decoder(WORDS).restore(broken) != "größer"


def test_long_stretches_are_cut_between_characters():
    sound = "ラヤミ市の小さな橋" * 200
    broken = "".join(next(c for c, b in encoding.READERS["cp1252"].items() if b == x) for x in sound.encode("cp932"))
    d = encoding.Decoder([("ラヤミ市の小さな橋", 9)])
    assert "".join(r for _, _, r in d.garbled(broken)) == sound


def test_words_beyond_the_broadcast_are_joined(spark):
    names = ["größer", "Bürger", "Straße", "Prüfung", "Bäckerei", "Köln"]
    rows = [(f"s{i}", " ".join(names)) for i in range(5)] + [(f"m{i}", "für für") for i in range(9)] + [("bad", "Die K�ln, Bürger".encode("cp1252", "replace").decode("cp1252") + " " + "Bäckerei".encode("cp1252").decode("mac_roman"))]
    c = content(spark, rows)
    whole = {r.url_hash: r.restored for r in encoding.garbled_pages(c).collect()}
    part = {r.url_hash: r.restored for r in encoding.garbled_pages(c, most_words=1).collect()}
    assert set(whole) == set(part) == {"bad"} and "Bäckerei" in part["bad"] and part["bad"].split()[-1] == whole["bad"].split()[-1]


def test_words_beyond_the_broadcast_fill_lost_letters(spark):
    names = ["größer", "Bürger", "Straße", "Prüfung", "Bäckerei", "Köln", "дорога", "городе"]
    torn = "größer".encode().decode("cp1252").replace("Ÿ", encoding.LOST)
    rows = [(f"s{i}", " ".join(names)) for i in range(5)] + [(f"m{i}", "für für") for i in range(9)] + [("lost", "K\ufffdln Stra\ufffde d\ufffdroga д\ufffdр\ufffdга B\ufffdckerei"), ("torn", f"Die {torn} Stadt"), ("dropped", "Prüfung".encode().decode("cp1252").replace("¼", encoding.LOST))]
    whole = {r.url_hash: (r.stretches, r.restored) for r in encoding.garbled_pages(content(spark, rows)).collect()}
    assert whole["lost"][1] == "Köln Straße d\ufffdroga дорога Bäckerei" and whole["torn"][1] == "Die größer Stadt" and whole["dropped"][1] == "Prüfung"
    for most in (0, 1, 5):
        assert {r.url_hash: (r.stretches, r.restored) for r in encoding.garbled_pages(content(spark, rows), most_words=most).collect()} == whole


def test_stored_words_equal_those_in_memory(spark, tmp_path):
    words = WORDS + [("İstanbul", 4), ("ΟΔΟΣ", 3), ("οδός", 5), ("町の静かな工房", 7)]
    encoding.store_words(spark.createDataFrame(words, "word string, n long"), str(tmp_path / "w.db"))
    stored, whole = encoding.StoredWords(str(tmp_path / "w.db")), encoding.Words(words)
    assert (stored.total, stored.singles) == (whole.total, whole.singles)
    assert all(stored.get(w) == n for w, n in words) and stored.get("none") is None
    for c in whole.singles:
        assert stored.before(c) == whole.before(c)
    for w in whole.sorted:
        for k in range(len(w) + 1):
            assert stored.begins(w[:k]) and stored.following(w[:k]) == whole.following(w[:k]) == {v[k] for v in whole.sorted if v.startswith(w[:k]) and len(v) > k}


def test_search_leaves_no_hypothesis_out():
    # Beginnings of common words crowd the first two letters; the only word of this length is the unlikeliest by its pairs.
    letters = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
    d = encoding.Decoder([(f"{a}{b}tttt", 1000) for a in letters for b in letters if a + b != "àþ"] + [("àþs", 5)])
    assert d._search([None, None, ord("s")], "cp1252") == "àþs"
    # Against every choice, with what no word covers: weights of ended words, or pairs.
    d = encoding.Decoder([("größer", 50), ("für", 40), ("été", 9), ("àüé", 3), ("ßéü", 1)])

    def weight(w):
        n = d._known(w)
        padded = f" {w} "
        return max([0.3 * math.log(n / d.total)] if n else [], default=-1e9), sum(d._pair(a, b) for a, b in zip(padded, padded[1:])) - 4.0

    for lattice in ([None, None, None], [None, ord("t"), None], [ord("z"), None, None], [None, 0xFC, None, ord("q")]):
        every = ["".join(w) for w in itertools.product(*(d._characters((b,), "cp1252") for b in lattice))]
        best = max(max(weight(w)) for w in every)
        assert abs(max(weight(d._search(lattice, "cp1252"))) - best) < 1e-9


def test_letters_of_two_in_lower_case():
    assert encoding.Decoder(WORDS).garbled("İzmir Ã¼ber B\ufffdrger İ\ufffd") != []


def test_memory_does_not_grow_with_the_corpus(spark, tmp_path, monkeypatch):
    # Words beyond the broadcast reach the workers by the file, neither as lists by page nor by a join with the texts.
    rows = [(f"s{i}", "größer Bürger Straße") for i in range(5)] + [("bad", "K\ufffdln für")]
    plan = encoding.garbled_pages(content(spark, rows), most_words=1)._jdf.queryExecution().toString()
    assert "Join" not in plan and "collect_set" not in plan
    monkeypatch.setattr(encoding, "_REMEMBERED", 5_000)
    monkeypatch.setattr(encoding, "_LOOKED_UP", 200)
    encoding.store_words(spark.createDataFrame(WORDS, "word string, n long"), str(tmp_path / "w.db"))
    whole, d = encoding.Decoder(WORDS), encoding.Decoder(encoding.StoredWords(str(tmp_path / "w.db")))
    for i in range(600):
        text = f"größer{i} {'Bürger'.encode().decode('cp1252')}{i} f\ufffdr{i} ürx{'abc'[i % 3]}{'é' * (i % 50)}"
        assert d.garbled(text) == whole.garbled(text)
        assert len(d.memo) + len(d.sound) + len(d.channel) < 200 and all(len(x) <= 201 for x in d.words.looked_up) and d.shaped < 2_000


def test_channels_are_kept_for_a_whole_text(monkeypatch):
    # What is forgotten while a text is read must not change the channel of its line.
    sound = "Новая дорога в городе, новая дорога"
    d = encoding.Decoder(WORDS + [("Новая", 50)])
    broken = "".join(next(c for c, b in encoding.READERS["cp1252"].items() if b == x) for x in sound.encode("cp1251"))
    want = d.garbled(broken)
    monkeypatch.setattr(encoding, "_REMEMBERED", 0)
    again = [d.garbled(broken) for _ in range(2)]
    assert again == [want, want] and d.remembered < 2000


# --- leaks


def test_without_edits_the_changed_passage_is_missed(spark):
    passage = "the quiet harbour master counted seven boats before noon and wrote nothing down today"
    changed = passage.replace("harbour", "harbor").replace("counted", "countet")
    d = spark.createDataFrame([(1, changed), (2, passage.upper()), (3, None), (4, ""), (5, "other words " * 30_000 + passage)], "doc_id long, text string")
    it = spark.createDataFrame([(7, passage), (8, None)], "item_id long, text string")
    found = lambda e: {(r.doc_id, r.item_id) for r in leaks.leaked_passages(d, it, edits=e).collect()}
    assert found(0) == {(2, 7), (5, 7)} and found(2) == {(1, 7), (2, 7), (5, 7)}
    runs = {r.doc_id: r.run for r in leaks.leaked_passages(d, it, edits=2).collect()}
    assert runs == {1: 0, 2: 14, 5: 14}


# --- personal data


def _labelled(i):
    return f"{100 + i % 900}-{10 + i % 90}-{1000 + i}"


def test_unseen_forms_are_discovered_by_context(spark):
    rows = [(i, f"The file shows file key ({_labelled(i)}) today.\nSSN: {_labelled(i + 3)}\nThe run took {i + 11000} ms there.") for i in range(60)]
    rows += [(100, "The file shows file key (7731/44871/XB) today."), (101, "The run took 7731/44871 ms there."), (102, "Passport number: 12345678X9")]
    rows += [(200 + i, f"letters go to 12{i} Palfir Lane, Zumir\nFlat 3, 1{i} Orvik Lane, Zumir\n") for i in range(60)]
    rows += [(300, "letters go to 12 Oak Parade, Zumir\n"), (301, "He met Oak Parade there")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.kind, r.matched) for r in personal.personal_data(df).collect()}
    assert (100, "national_id", "7731/44871/XB") in got and (102, "national_id", "12345678X9") in got
    assert (300, "street_address", "12 Oak Parade") in got
    assert not {g for g in got if g[0] in (101, 301)} and not {g for g in got if g[0] == 300 and g[1] == "person_name"}
    assert not {g for g in got if g[2].startswith("11") and g[2].isdigit()}


def test_patterns_decide_on_seeds_and_others(spark, monkeypatch):
    rows = [(i, f"The file shows file key ({_labelled(i)}) today.\nSSN: {_labelled(i + 3)}") for i in range(60)] + [(100, "The file shows file key (7731/44871/XB) today.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: {(r.doc_id, r.matched) for r in personal.personal_data(df).collect()}
    assert (100, "7731/44871/XB") in found()
    # Without patterns there is no graph, and neither free forms nor seeds come out.
    monkeypatch.setattr(personal, "patterns", lambda: F.array().cast("array<string>"))
    assert found() == set()


def test_surroundings_of_long_tokens_are_whole():
    long = "x" * 300
    left, right = personal._around(f"{long} the {long} 12 345 {long} end", 606, 612)
    assert left == f"the {long}" and right == f"{long} end"
