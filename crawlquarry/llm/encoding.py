"""Text decoded with the wrong character encoding: found, and restored by noisy-channel decoding.

A *channel* is a pair (the wrong encoding used, the right one). Every stretch that looks
unlike sound text is turned back into the bytes each channel would have seen. Bytes that were lost
on the way are wildcards: U+FFFD stands for one byte, and bytes that the wrong encoding leaves
undefined (or shows as blanks) may have been dropped without a trace, so that a stretch is a lattice of possible
bytes. A Viterbi search through that lattice, decoded under the right encoding, picks the likeliest
text: ended words weigh by their frequency in the corpus, and character pairs of the same words stand in for
what no word covers. Its states are the beginnings of words of the corpus and the last letters of any others, so
that no hypothesis is left out. A stretch is garbled when its best restoration beats the text as it stands.

The word table counts, over the whole corpus, the pages that hold each word with a
character beyond ASCII. Up to ``most_words`` are broadcast; where the corpus has more, all of them and their letter pairs are
a sorted file that each executor gets a copy of and reads from disk, with the same results.

Defined results: null content gives no row; sound and empty texts aren't found; of repeated
rows of a page any decides; extra columns are ignored; what can't be restored stays as it is.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import sqlite3
import tempfile
import uuid
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import materialize, ship, spread

#: Fixed values: (name, encoding it was wrongly read in, encoding it was written in).
CHANNELS = (
    ("utf8-cp1252", "cp1252", "utf-8"),
    ("utf8-macroman", "mac_roman", "utf-8"),
    ("utf8-cp437", "cp437", "utf-8"),
    ("utf8-cp850", "cp850", "utf-8"),
    ("utf8-cp1251", "cp1251", "utf-8"),
    ("utf8-koi8r", "koi8_r", "utf-8"),
    ("cp1252-macroman", "mac_roman", "cp1252"),
    ("macroman-cp1252", "cp1252", "mac_roman"),
    ("cp1252-cp437", "cp437", "cp1252"),
    ("cp1252-cp850", "cp850", "cp1252"),
    ("cp1251-cp1252", "cp1252", "cp1251"),
    ("koi8r-cp1252", "cp1252", "koi8_r"),
    ("koi8r-cp1251", "cp1251", "koi8_r"),
    ("cp1251-koi8r", "koi8_r", "cp1251"),
    ("cp1252-cp1251", "cp1251", "cp1252"),
    ("sjis-cp1252", "cp1252", "cp932"),
    ("eucjp-cp1252", "cp1252", "euc_jp"),
)
LOST = "�"
#: Characters of a stretch after which it may be cut, at the next place where no character can be split.
_PIECE = 600
#: Characters of remembered stretches, and entries of other look-ups, after which a worker forgets them; results don't depend on these.
_REMEMBERED, _LOOKED_UP = 6_000_000, 100_000
#: Characters of results that a worker gathers before it hands them on.
_HANDED_ON = 4_000_000


def _reader(encoding: str) -> dict[str, int]:
    """Character -> byte of a single-byte encoding; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


READERS = {wrong: _reader(wrong) for _, wrong, _ in CHANNELS}


def _undefined(encoding: str) -> tuple[int, ...]:
    """Bytes that vanish on the way: those the encoding leaves undefined, the no-break space and the soft hyphen."""
    seen = {b for c, b in READERS[encoding].items() if not "\x80" <= c < "\xa0"}
    return tuple(sorted(({b for b in range(0x80, 0x100)} - seen) | {b for c, b in READERS[encoding].items() if c in "\xa0\xad"}))


DROPPED = {wrong: _undefined(wrong) for wrong in READERS}
#: A letter that wrong decodings of UTF-8 begin with, and no second byte after it.
_TORN = re.compile("[ÂÃÄÅÐÑÎÏ√┬├РС](?=[A-Za-z]|$)")


def _seen_as(encoding: str, low: int, high: int) -> str:
    """Character class of how bytes low..high look in an encoding."""
    return "".join(re.escape(c) for c, b in READERS[encoding].items() if low <= b <= high)


def _utf8_as(encoding: str, pairs: int = 1) -> str:
    """Pattern of UTF-8 sequences of Latin, punctuation, Cyrillic or CJK text read in an encoding."""
    two, three, rest = _seen_as(encoding, 0xC2, 0xD4), _seen_as(encoding, 0xE2, 0xE9), _seen_as(encoding, 0x80, 0xBF)
    four = _seen_as(encoding, 0xF0, 0xF0)
    one = f"(?:[{two}][{rest}]|[{three}][{rest}]{{2}}|[{four}][{rest}]{{3}})"
    return one if pairs == 1 else f"{one}{{{pairs},}}"


#: What sound text doesn't hold; matches are candidates, the decoder decides. Cyrillic encodings need two sequences in a row, as single ones are sound Russian.
SUSPECT = re.compile(
    "|".join([
        LOST, "[\u0080-\u009f]", _utf8_as("cp1252"), _utf8_as("mac_roman"), _utf8_as("cp437"), _utf8_as("cp850"), _utf8_as("cp1251", 2), _utf8_as("koi8_r", 2),
        "[À-ÿ¸¨]{4,}", "[A-Za-z][‡‰ˆÈÍÌÎÓÔÒÚÛÙÊËÁÂÀ·¸ﬂŸ¯˜†ŠŽ‚„][a-z]", "[ƒ‚ƒ][^\\s]", "[А-яЁё]*[┐-╬▀-▟⌠√≈]+[А-яЁё]*", "[a-z][а-яё][a-z]", "[ÈÍ‡‰ˆ¸ﬂÛÓÒ]\\b",
    ])
)
#: Stems of the English short forms, before n't and before 's, 're, 've, 'll, 'd, 'm.
_NOT = "(?:[Ii]s|[Aa]re|[Ww]as|[Ww]ere|[Dd]o|[Dd]oes|[Dd]id|[Hh]as|[Hh]ave|[Hh]ad|[Ww]o|[Ww]ould|[Cc]a|[Cc]ould|[Ss]hould|[Mm]ust|[Mm]ight|[Nn]eed|[Aa]i)"
_SHORT = "\\b[Ii]t|\\b[Hh]e|[Ss]he|[Tt]hat|[Ww]hat|[Hh]ere|[Ww]ho|[Ll]et", "\\b[Ww]e|[Tt]hey|[Yy]ou|[Ww]ho|\\bI"
_OPENING, _CLOSING, _APOSTROPHES, _DASHES = "“‘„«", "”’»", "’", "–—"


def _image(wrong: str, right: str, mark: str) -> str:
    """How a mark written in one encoding looks in another; empty if it can't look wrong, or looks like a mark of its own use."""
    try:
        w = next(c for c, b in READERS[wrong].items() if b == mark.encode(right)[0])
    except (UnicodeEncodeError, StopIteration):
        return ""
    return "" if w == mark or w in "ªº´½¼¾“”‘’„«»–—…·°" or ord(w) < 0xA0 else w


def _marks(wrong: str, right: str) -> tuple[re.Pattern | None, re.Pattern | None, dict[str, str]]:
    """(places where the images of marks can't be sound, where they are wrong in a page with one of those, image -> mark) of a channel."""
    sure, likely, back = [], [], {}
    for mark in _OPENING + _CLOSING + _DASHES + "…°":
        w = _image(wrong, right, mark)
        if not w:
            continue
        back.setdefault(w, mark)
        upper_or_sign = not w.isalpha() or w.isupper()
        if mark in _OPENING:
            if mark != "„":  # its images are common letters
                sure.append(f"(?<!\\w){w}(?=[A-Z][a-z]|[AI](?!\\w))")
            likely.append(f"(?<!\\w){w}(?=[A-Za-z])")
        if mark in _CLOSING:
            sure.append(f"(?<=[a-z][.,!?]){w}(?!\\w)")
            likely.append(f"(?<=[A-Za-z0-9.,!?]){w}(?!\\w)")
        if mark in _APOSTROPHES:
            sure.append(f"\\b{_NOT}n({w})t\\b")
            sure.append(f"(?:{_SHORT[0]})({w})s\\b|(?:{_SHORT[1]})({w})(?:re|ve|ll|d)\\b|\\bI({w})m\\b")
            likely.append(f"(?<=[A-Za-z]){w}(?=(?:s|t|re|ve|ll|d|m)\\b)")
        if mark in _DASHES:
            sure.append(f"(?<=\\d){w}(?=\\d)" if w.isalpha() else "(?!)")
            likely.append(f"(?<=[ \\n]){w}(?=[ \\n])")
        if mark == "…":
            (sure if upper_or_sign else likely).append(f"(?<=[a-z]){w}(?![^\\W\\d_])")
        if mark == "°":
            sure.append(f"(?<=\\d){w}(?!\\w)|(?<=\\d){w}(?=[CF]\\b)|(?<![^\\s(]){w}(?=[CF]\\b)")
    return (re.compile("|".join(sure)), re.compile("|".join(likely)), back) if back else (None, None, back)


#: Marks of single-byte Latin channels, by channel.
MARKS = {name: _marks(wrong, right) for name, wrong, right in CHANNELS if right in ("cp1252", "mac_roman")}
MARKS = {name: m for name, m in MARKS.items() if m[0]}
_MARK_IMAGES = re.compile("[" + "".join(sorted({re.escape(w) for m in MARKS.values() for w in m[2]})) + "]")
#: A letter of another script, or a sign, as a single-byte channel puts it in place of a letter beside Latin ones.
_STRANGE = "".join(
    sorted({re.escape(w) for _, wrong, right in CHANNELS if right in ("cp1252", "mac_roman") for w, b in READERS[wrong].items()
            if b > 0x7F and (c := bytes([b]).decode(right, "ignore")).isalpha() and c < "ʰ" and not (w.isalpha() and w < "ʰ") and w not in "“”‘’„«»–—…·°©®£€¿¡ªº§¨™¼½¾\xa0"})
)
_MIXED_IN = re.compile(f"[A-Za-zÀ-ÿ][{_STRANGE}]|[{_STRANGE}][A-Za-z]{{2}}")
#: Cyrillic read in another Cyrillic encoding has its case turned; capitals alone can be sound, so that known words and the line decide.
_TURNED_CASE = re.compile("[а-яё][А-ЯЁ]{2,}")
_ODD = re.compile("[^\x00-\x7f]")
_STRETCH_END = re.compile("[^ \\t\\n\\r]*")
#: Runs of UTF-8 sequences as they look in the encodings they're most often read in.
_RUNS = {wrong: re.compile(f"(?:{_utf8_as(wrong)})+") for wrong in ("cp1252", "mac_roman", "cp437", "cp850")}
#: So many sequences in a row aren't sound text, whether they can be restored or not.
_CERTAIN = re.compile("|".join(_utf8_as(wrong, 4) for wrong in _RUNS))
#: Lost apostrophes in English, before and after words are looked up.
_APOSTROPHE = re.compile(f"(?<=n){LOST}(?=t\\b)")
_GENITIVE = re.compile(f"(?<=[a-z]){LOST}(?=(?:s|re|ve|ll)\\b)")
#: What separates stretches; a no-break space can be the last byte of a sequence.
_BLANK = " \t\n\r"
_WORD = re.compile(r"[^\W\d_]+")
_MIXED_CASE = re.compile(r"[^\W\d_A-Z](?<![A-ZÀ-ÞА-ЯЁ])[A-ZÀ-ÖØ-ÞА-ЯЁ]")
#: A mark inside a word or stuck to its end, apostrophes and closing marks aside.
_INSIDE = re.compile(r"[^\W\d_][“„«–—·°©®£€¿¡]|[”»–—·°©®£€¿¡][^\W\d_](?<![£€¿¡][^\W\d_])")
_SOUND_MARKS = "“”‘’„«»–—…·°©®£€¿¡、。・：（）「」"
#: Characters a restoration may bring in.
_PLAUSIBLE = re.compile("[ -~\u0080-ſЀ-џ‐-…‰‹›€№™　-ヿ一-鿿＀-～œƒˆ˜\U0001f300-\U0001faff]+")


def word_counts(content: DataFrame, least_pages: int = 3) -> DataFrame:
    """(word, n): the words with a character beyond ASCII and the pages that hold them, over all pages."""
    words = content.where(F.col("content").rlike(r"[^\x00-\x7f]")).select(
        F.explode(F.array_distinct(F.expr(r"regexp_extract_all(content, '[a-zA-Z]*[^\\x00-\\x7f\\s\\p{P}\\p{S}\\p{C}][\\p{L}]*', 0)"))).alias("word")
    )
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)


def _cut(text: str, a: int, b: int) -> int:
    """Where a stretch that begins at ``a`` may end: at ``b``, or after _PIECE characters where no channel has a character go on."""
    at = a + _PIECE
    while at < b:
        # A second byte can be ASCII; after two ASCII characters in a row a new character begins in every channel.
        if text[at - 1].isascii() and text[at - 2].isascii() and text[at].isascii():
            return at
        at += 1
    return b


#: Letters that can stand for a lost one, by the script of the word around it.
_SCRIPTS = {"latin": ("\x80", "\u024f"), "cyrillic": ("\u0400", "\u04ff"), "wide": ("\u3000", "\uffef")}


def _fold(text: str) -> str:
    """Lower case letter by letter, so that what begins a word begins its folded form."""
    return "".join(c.lower() for c in text).replace("ς", "σ")


def _letter_pairs(words: Iterable[tuple[str, int]]) -> dict[tuple[str, str], int]:
    """(second, first) letter -> weight; a blank stands at both ends of a word."""
    pairs: dict[tuple[str, str], int] = defaultdict(int)
    for w, n in words:
        padded = f" {w.lower()} "
        for a, b in zip(padded, padded[1:]):
            pairs[b, a] += n
    return pairs


class Words:
    """Word frequencies and letter pairs in memory."""

    def __init__(self, words: list[tuple[str, int]]):
        self.counts = dict(words)
        self.total = sum(self.counts.values()) + 1
        self.get = self.counts.get
        self.sorted = sorted({_fold(w) for w in self.counts})
        self.pairs: dict[str, dict[str, int]] = defaultdict(dict)
        self.singles: dict[str, int] = defaultdict(int)
        for (b, a), n in _letter_pairs(self.counts.items()).items():
            self.pairs[b][a] = n
            self.singles[a] += n
        self.pairs = dict(self.pairs)

    def before(self, letter: str) -> dict[str, int]:
        """The letters that stand before a letter, with their weight."""
        return self.pairs.get(letter) or {}

    def _next(self, prefix: str) -> str | None:
        """The first folded word that isn't less."""
        k = bisect_left(self.sorted, prefix)
        return self.sorted[k] if k < len(self.sorted) else None

    def begins(self, prefix: str) -> bool:
        """Whether a word begins like this, folded."""
        return (w := self._next(prefix)) is not None and w.startswith(prefix)

    def following(self, prefix: str) -> set[str]:
        """The letters that go on from a folded beginning."""
        found, w = set(), self._next(prefix + "\0")
        while w is not None and w.startswith(prefix):
            c = w[len(prefix)]
            found.add(c)
            w = self._next(prefix + chr(ord(c) + 1))
        return found


class StoredWords(Words):
    """Word frequencies and letter pairs in a file; what was looked up is remembered for a while."""

    def __init__(self, path: str):
        self.db = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
        self.total = self.db.execute("SELECT n FROM total").fetchone()[0]
        self.singles = dict(self.db.execute("SELECT letter, n FROM singles"))
        self.looked_up: tuple[dict, ...] = ({}, {}, {}, {})
        self.entries = [0, 0, 0, 0]

    def _remembered(self, kind: int, key: str, find):
        kept = self.looked_up[kind]
        if key not in kept:
            if self.entries[kind] >= _LOOKED_UP:
                kept.clear()
                self.entries[kind] = 0
            kept[key] = found = find()
            self.entries[kind] += 1 + (len(found) if kind > 1 else 0)  # these are collections of letters
        return kept[key]

    def get(self, word: str, default: int | None = None) -> int | None:
        n = self._remembered(0, word, lambda: (self.db.execute("SELECT n FROM words WHERE word = ?", (word,)).fetchone() or (None,))[0])
        return default if n is None else n

    def before(self, letter: str) -> dict[str, int]:
        return self._remembered(2, letter, lambda: dict(self.db.execute("SELECT a, n FROM pairs WHERE b = ?", (letter,))))

    def _next(self, prefix: str) -> str | None:
        return (self.db.execute("SELECT word FROM folded WHERE word >= ? ORDER BY word LIMIT 1", (prefix,)).fetchone() or (None,))[0]

    def begins(self, prefix: str) -> bool:
        return self._remembered(1, prefix, lambda: Words.begins(self, prefix))

    def following(self, prefix: str) -> set[str]:
        return self._remembered(3, prefix, lambda: Words.following(self, prefix))


def store_words(counts: DataFrame, path: str) -> None:
    """Write (word, n) and their letter pairs to a file for StoredWords; the driver sees one part at a time."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _letter_pairs(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["b", "a", "n"])

    db = sqlite3.connect(path)
    db.executescript(
        "PRAGMA journal_mode = OFF; PRAGMA synchronous = OFF; PRAGMA cache_size = -65536; CREATE TABLE words (word TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID; CREATE TABLE folded (word TEXT PRIMARY KEY) WITHOUT ROWID;"
        "CREATE TABLE pairs (b TEXT, a TEXT, n INTEGER, PRIMARY KEY (b, a)) WITHOUT ROWID; CREATE TABLE singles (letter TEXT PRIMARY KEY, n INTEGER) WITHOUT ROWID; CREATE TABLE total (n INTEGER);"
    )
    for w, n in counts.select("word", "n").orderBy("word").toLocalIterator():
        db.execute("INSERT INTO words VALUES (?, ?)", (w, n))
        db.execute("INSERT OR IGNORE INTO folded VALUES (?)", (_fold(w),))
    letters = counts.select("word", "n").mapInArrow(pairs, "b string, a string, n long").groupBy("b", "a").agg(F.sum("n").alias("n")).orderBy("b", "a")
    db.executemany("INSERT INTO pairs VALUES (?, ?, ?)", letters.toLocalIterator())
    db.execute("INSERT INTO singles SELECT a, sum(n) FROM pairs GROUP BY a")
    db.execute("INSERT INTO total SELECT coalesce(sum(n), 0) + 1 FROM words")
    db.commit()
    db.close()


class Decoder:
    """Noisy-channel decoder under a table of word frequencies."""

    def __init__(self, words: list[tuple[str, int]] | Words):
        # Words that are themselves garbled are in the table, rare beside their sound forms.
        self.words = words if isinstance(words, Words) else Words(words)
        self.total, self.singles = self.words.total, self.words.singles
        self.letters = sorted(c for c in self.singles if c.isalpha() and not c.isascii() and _PLAUSIBLE.fullmatch(c))
        self.letters += [c.upper() for c in self.letters if len(c.upper()) == 1 and c.upper() != c]
        self.shapes: dict[tuple, list[str]] = {}
        self.shaped = 0
        self.memo: dict[str, str] = {}
        self.sound: dict[str, bool] = {}
        self.channel: dict[str, str] = {}
        self.remembered = 0

    def _pair(self, a: str, b: str) -> float:
        if a.isascii() and b.isascii():
            return -3.0
        a, b = a.lower(), b.lower()
        return math.log((self.words.before(b).get(a, 0) + 0.02) / (self.singles.get(a, 0) + 20.0))

    def score(self, text: str) -> float:
        """Log-likelihood of a stretch, up to a constant."""
        s = 0.0
        for part in _WORD.findall(text):
            if part.isascii():
                s -= 3.0
            elif (n := self.words.get(part) or self.words.get(part.lower()) or self.words.get(part.capitalize())) is not None:
                s += 0.3 * math.log(n / self.total)
            else:
                padded = f" {part} "
                s += sum(self._pair(a, b) for a, b in zip(padded, padded[1:])) - 4.0
        s -= 5.0 * len(_MIXED_CASE.findall(text)) + 5.0 * len(_INSIDE.findall(text))
        strange = sum(1 for c in text if not c.isalnum() and ord(c) > 127 and c not in _SOUND_MARKS)
        return s - 6.0 * strange - 8.0 * text.count(LOST)

    def _lattice(self, stretch: str, wrong: str) -> list[int | None] | None:
        """Byte at each place, None for a lost one; None if the channel can't have made the stretch."""
        read, out = READERS[wrong], []
        for c in stretch:
            if c == LOST:
                out.append(None)
            elif c in read:
                out.append(read[c])
            else:
                return None
        return out

    def _characters(self, piece: tuple, right: str) -> list[str]:
        """The characters that some bytes, wildcards among them, can be under an encoding; wildcards stand for letters of the corpus."""
        key = (piece, right)
        if key not in self.shapes:
            if right in _SCRIPTS:  # a lattice of characters
                low, high = _SCRIPTS[right]
                found = [piece[0]] if piece[0] is not None else [c for c in self.letters if low <= c <= high]
            elif None not in piece:
                try:
                    c = bytes(piece).decode(right)
                    found = [c] if len(c) == 1 and _PLAUSIBLE.fullmatch(c) else []
                except UnicodeDecodeError:
                    found = []
            else:
                found = []
                for c in self.letters:
                    raw = c.encode(right, "ignore")
                    if len(raw) == len(piece) and all(x is None or x == y for x, y in zip(piece, raw)):
                        found.append(c)
            if self.shaped > 4 * _LOOKED_UP:
                self.shapes.clear()
                self.shaped = 0
            self.shaped += len(found) + 4
            self.shapes[key] = found
        return self.shapes[key]

    def _search(self, lattice: list[int | None], right: str, dropped: tuple[int, ...] = ()) -> str | None:
        """Viterbi search for the likeliest text of a lattice; nothing that could win is left out.

        At each byte there are three kinds of states: between words; a word begun, kept whole, if it's ASCII or a word of the corpus
        begins so; and the last letter of any word beyond ASCII, as no more of it counts for what no word covers.
        A word ended weighs by its frequency or by its pairs, whichever is more.

        ``dropped`` are bytes that may be missing anywhere inside a character.
        """
        n = len(lattice)
        sizes = (1, 2, 3, 4) if right == "utf-8" else (1, 2, 3) if right == "euc_jp" else (1, 2) if right == "cp932" else (1,)
        # (score, text); that of words begun without them, that of last letters with the word's pairs
        between: list[tuple[float, str] | None] = [None] * (n + 1)
        begun: list[dict[str, tuple[float, str]]] = [{} for _ in range(n + 1)]
        lasts: list[dict[str, tuple[float, str]]] = [{} for _ in range(n + 1)]
        between[0] = (0.0, "")

        def put(states: dict[str, tuple[float, str]], key: str, value: float, text: str) -> None:
            if key not in states or states[key][0] < value:
                states[key] = (value, text)

        def ended(i: int) -> tuple[float, str] | None:
            found = [between[i]] if between[i] else []
            for word, (value, text) in begun[i].items():
                if word.isascii():
                    found.append((value - 3.0, text))
                elif count := self._known(word):
                    found.append((value + 0.3 * math.log(count / self.total), text))
            found += [(value + self._pair(a, " ") - 4.0, text) for a, (value, text) in lasts[i].items()]
            return max(found, default=None)

        def best_last(i: int) -> tuple[float, str]:
            """The best state before a letter that no pair is known for."""
            return max((value + math.log(0.02 / (self.singles.get(a, 0) + 20.0)), text) for a, (value, text) in lasts[i].items())

        def go_on(i: int, j: int, chars: list[str], cost: float) -> None:
            letters = [c for c in chars if c.isalpha()]
            if len(letters) < len(chars) and (end := ended(i)):
                for c in chars:
                    if not c.isalpha():
                        value = end[0] - cost - (0.0 if c.isascii() or c in _SOUND_MARKS else 6.0)
                        if between[j] is None or between[j][0] < value:
                            between[j] = (value, end[1] + c)
            if not letters:
                return
            for word, (value, text) in ([("", between[i])] if between[i] else []) + list(begun[i].items()):
                plain, folded = word.isascii(), _fold(word)
                follow = self.words.following(folded) if len(letters) > 4 else None
                for c in letters:
                    if plain and c.isascii():
                        put(begun[j], word + c, value - cost, text + c)
                        continue
                    low = _fold(c)
                    if (follow is None or low[0] in follow) and self.words.begins(folded + low):
                        put(begun[j], word + c, value - cost, text + c)
                    if plain:
                        put(lasts[j], c.lower(), value - cost - 3.0 * len(word) + self._pair(word[-1] if word else " ", c), text + c)
            here = lasts[i]
            top = best_last(i) if len(here) > 8 and len(letters) > 8 else None
            for c in letters:
                low = c.lower()
                if top and not c.isascii():
                    # Pairs that are known weigh more than unknown ones of the same letter, so that these need no look each.
                    put(lasts[j], low, top[0] - cost, top[1] + c)
                    known = self.words.before(low)
                    firsts = [a for a in known if a in here] if len(known) < len(here) else [a for a in here if a in known]
                else:
                    firsts = list(here)
                for a in firsts:
                    put(lasts[j], low, here[a][0] - cost + self._pair(a, c), here[a][1] + c)

        for i in range(n):
            if not (between[i] or begun[i] or lasts[i]):
                continue
            for size in sizes:
                if i + size > n:
                    break
                piece = tuple(lattice[i : i + size])
                if chars := self._characters(piece, right):
                    go_on(i, i + size, chars, 2.0 * piece.count(None))
            if dropped and lattice[i] is not None and lattice[i] >= 0xC2:  # bytes
                for size in sizes[1:3]:
                    have = lattice[i : i + size - 1]
                    if len(have) < size - 1 or None in have:
                        continue
                    for at in range(1, size):
                        for d in dropped:
                            if chars := self._characters(tuple(have[:at] + [d] + have[at:]), right):
                                go_on(i, i + size - 1, chars, 3.0 if d < 0xA0 else 4.0)
        end = ended(n)
        return end and end[1]

    def _by_runs(self, text: str, wrong: str) -> str:
        """Each run of whole sequences decoded by itself, where the stretch as a whole has torn ones."""
        read = READERS[wrong]

        def one(m: re.Match) -> str:
            try:
                return bytes(read[c] for c in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                return m.group()

        return _RUNS[wrong].sub(one, text)

    def _fill(self, stretch: str) -> str:
        """Lost characters inside words: each word is a lattice of characters, searched like one of bytes; only words of the corpus are taken."""

        def word(m: re.Match) -> str:
            part = m.group()
            script = "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in part) else "wide" if any(c > "\u3040" and c != LOST for c in part) else "latin"
            found = self._search([None if c == LOST else c for c in part], script)
            if found and LOST not in found and self._known(found):
                # Case follows the letters that are left; of a lost first letter, the commoner form.
                w = found.upper() if part.isupper() else found.lower()
                if not part.isupper() and part[0] == LOST and self.words.get(w.capitalize(), 0) > self.words.get(w, 0):
                    w = w.capitalize()
                return "".join(b if a == LOST else a for a, b in zip(part, w)) if len(w) == len(part) else part
            if part[0] == LOST and LOST in part[1:]:  # a lost mark before the word
                return LOST + re.sub(".+", word, part[1:])
            if part[-1] == LOST and LOST in part[:-1]:
                return re.sub(".+", word, part[:-1]) + LOST
            return part

        stretch = _APOSTROPHE.sub("’", stretch)
        filled = re.sub(rf"[^\W\d_]*{LOST}(?:[^\W\d_]|{LOST})*", word, stretch)
        return _GENITIVE.sub("’", filled) if filled.count(LOST) == 1 and filled.replace(LOST, "").isascii() else filled

    def restore(self, stretch: str) -> str:
        """The likeliest original of a stretch without blanks; itself if it's sound."""
        if stretch in self.memo:
            return self.memo[stretch]
        start, text = stretch, stretch
        for _ in range(3):  # wrong decodings can be repeated
            if not (SUSPECT.search(text) or _MIXED_IN.search(text) or _TURNED_CASE.search(text)):
                break
            options, sure, made = [text], {}, {}
            for name, wrong, right in CHANNELS:
                lattice = self._lattice(text, wrong)
                if lattice is None or all(b is None or b < 128 for b in lattice):
                    continue
                if None not in lattice:
                    try:
                        whole = bytes(lattice).decode(right)
                        if _PLAUSIBLE.fullmatch(whole):
                            options.append(whole)
                            made.setdefault(whole, name)
                            if right == "utf-8":  # next to nothing is valid UTF-8 by chance
                                sure[whole] = 8.0
                        continue
                    except UnicodeDecodeError:
                        pass
                if found := self._search(lattice, right):
                    options.append(found)
                    made.setdefault(found, name)
                if right == "utf-8" and wrong in _RUNS:
                    options.append(self._by_runs(text, wrong))
            if LOST in text:
                options.append(self._fill(text))
            top = max(options, key=lambda t: self.score(t) + sure.get(t, 0.0))
            if top == text or self.score(top) + sure.get(top, 0.0) <= self.score(text) + 1.0:
                break
            if text == start and top in made:
                self.channel[start] = made[top]
            text = top
        self.memo[start] = text
        self.remembered += len(start) + len(text) + 60
        return text

    def _known(self, word: str) -> int:
        return self.words.get(word) or self.words.get(word.lower()) or self.words.get(word.capitalize()) or 0

    def by_words(self, stretch: str) -> str:
        """A stretch without suspect sequences whose words are known only in what one channel makes of it; else itself.

        Words that are known can be garbled ones of many pages; then their sound form is far commoner.
        """
        if all(c in _SOUND_MARKS for c in _ODD.findall(stretch)):
            return stretch
        parts = [w for w in _WORD.findall(stretch) if not w.isascii()]
        have = min((self._known(w) for w in parts), default=0)
        best, top, name = stretch, max(2, 10 * have), ""
        for channel, wrong, right in CHANNELS:
            lattice = self._lattice(stretch, wrong) if right != "utf-8" else None
            if lattice is None or None in lattice:
                continue
            try:
                whole = bytes(lattice).decode(right)
            except UnicodeDecodeError:
                continue
            made = [w for w in _WORD.findall(whole) if not w.isascii()]
            if not made or not _PLAUSIBLE.fullmatch(whole) or any(len(w) < 3 for w in made) or _MIXED_CASE.search(whole) or self.has_marks(whole):
                continue
            if (n := min(self._known(w) for w in made)) > top:
                best, top, name = whole, n, channel
        if not name and not have and _TORN.search(stretch):
            # Lead bytes whose next byte is gone: the text they're restored to must be made of known words.
            for channel, wrong, right in CHANNELS:
                lattice = self._lattice(stretch, wrong) if right == "utf-8" and DROPPED[wrong] else None
                if lattice is None or None in lattice:
                    continue
                found = self._search(lattice, right, DROPPED[wrong])
                made = [w for w in _WORD.findall(found or "") if not w.isascii()]
                if made and found != stretch and not _MIXED_CASE.search(found) and (n := min(self._known(w) for w in made)) > top:
                    best, top, name = found, n, channel
        if name:
            self.channel[stretch] = name
            self.remembered += len(stretch) + 60
        return best

    def examine(self, stretch: str) -> str | None:
        """The restored stretch, which may be the stretch itself if it's garbled for sure or was suspect; None if it's sound."""
        if stretch in self.sound:
            return None
        if SUSPECT.search(stretch) or _MIXED_IN.search(stretch) or _TURNED_CASE.search(stretch):
            restored = self.restore(stretch)
            if restored != stretch or LOST in stretch or _CERTAIN.search(stretch):
                return restored
        if (restored := self.by_words(stretch)) != stretch:
            return restored
        self.sound[stretch] = not self.has_marks(stretch)
        self.remembered += len(stretch) + 60
        return None

    def has_marks(self, stretch: str) -> bool:
        """Whether a stretch has an image of a mark where it can't be sound; two letters that changed places make none."""
        if not _MARK_IMAGES.search(stretch):
            return False
        found = [m.start() for sure, _, _ in MARKS.values() for m in sure.finditer(stretch)]
        return any(not (stretch[i].isalpha() and self._known(_WORD.match(stretch[i + 1] + stretch[i] + stretch[i + 2 :]).group())) if i + 1 < len(stretch) and stretch[i + 1].isalpha() else True for i in found)

    def marks(self, text: str) -> dict[int, str]:
        """Place -> mark, where only the marks of a text are garbled."""
        out: dict[int, str] = {}
        for sure, likely, back in MARKS.values():
            found = {next((m.start(g) for g in range(1, (m.lastindex or 0) + 1) if m.group(g)), m.start()) for m in sure.finditer(text)}
            if not found:
                continue
            for m in likely.finditer(text):  # words that are known as they stand keep their letters
                a, b = m.start(), m.end()
                while a > 0 and text[a - 1].isalpha():
                    a -= 1
                while b < len(text) and text[b].isalpha():
                    b += 1
                if text[m.start()] not in back or b - a == 1 or not self._known(text[a:b]):
                    found.add(m.start())
            for i in found:
                out.setdefault(i, back[text[i]])
        return out

    def garbled(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the garbled stretches of a text; restored equals the stretch where nothing better is found."""
        if self.remembered > _REMEMBERED:  # between texts only, as a text's own stretches are looked at again
            self.memo.clear()
            self.sound.clear()
            self.channel.clear()
            self.remembered = 0
        out, left, done = [], [], -1
        with_marks = False
        for m in _ODD.finditer(text):
            if m.start() < done:
                continue
            a = m.start()
            while a > 0 and text[a - 1] not in _BLANK:
                a -= 1
            done = b = _STRETCH_END.match(text, a).end()
            # Long stretches (scripts without blanks, or no text at all) are decoded piece by piece.
            y = a
            while y < b:
                x, y = y, _cut(text, y, b)
                stretch = text[x:y]
                restored = self.examine(stretch)
                if restored is not None:
                    out.append((x, y, restored))
                else:
                    left.append((x, y))
                    with_marks = with_marks or not self.sound.get(stretch, True)
        if with_marks and (marks := self.marks(text)):
            for x, y in left:
                if any(i in marks for i in range(x, y)):
                    marked = "".join(marks.get(i, text[i]) for i in range(x, y))
                    out.append((x, y, self.examine(marked) or marked))
            left = [(x, y) for x, y in left if not any(i in marks for i in range(x, y))]
            out.sort()
        return self._with_lines(text, out, left) if out and left else out

    def _with_lines(self, text: str, out: list[tuple[int, int, str]], left: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """Stretches too short to be told by themselves follow the line's channel where it made at least two others."""
        lines: dict[int, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for x, y, _ in out:
            if channel := self.channel.get(text[x:y]):
                lines[text.rfind("\n", 0, x)][channel] += 1
        for x, y in left:
            votes = lines.get(text.rfind("\n", 0, x))
            if not votes or max(votes.values()) < 2:
                continue
            _, wrong, right = next(c for c in CHANNELS if c[0] == max(votes, key=votes.get))
            lattice = self._lattice(text[x:y], wrong)
            try:
                whole = bytes(lattice).decode(right) if lattice and None not in lattice else ""
            except UnicodeDecodeError:
                continue
            if whole and _PLAUSIBLE.fullmatch(whole) and self.score(whole) > self.score(text[x:y]) - 4.0:
                out.append((x, y, whole))
        return sorted(out)


def garbled_pages(content: DataFrame, words: list[tuple[str, int]] | None = None, most_words: int = 60_000) -> DataFrame:
    """(url_hash, stretches, restored): pages with garbled stretches, how many, and the text with each restored where possible."""
    spark = content.sparkSession
    ship(spark)
    texts = content.where(F.col("url_hash").isNotNull() & F.col("content").isNotNull()).select("url_hash", "content")
    # Only texts beyond ASCII can be garbled; the rest doesn't leave the JVM.
    odd = texts.where(F.col("content").rlike(r"[^\x00-\x7f]"))
    stored = None
    if words is None:
        counts = materialize(word_counts(texts), "words")
        if counts.count() > most_words:
            # The driver serves the file to the executors, so it stays as long as the driver does.
            folder = tempfile.mkdtemp(prefix="crawlquarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            stored = f"words-{uuid.uuid4().hex}.db"
            store_words(counts, str(Path(folder) / stored))
            spark.sparkContext.addFile(str(Path(folder) / stored))
        else:
            words = [(r[0], r[1]) for r in counts.collect()]
    shared = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(StoredWords(SparkFiles.get(stored)) if stored else shared.value)
        for batch in batches:
            keys, counts, out, gathered = [], [], [], 0
            for at, (key, text) in enumerate(zip(batch.column(0), batch.column(1)), 1):
                text = text.as_py()
                if found := decoder.garbled(text):
                    parts, last = [], 0
                    for a, b, restored in found:
                        parts += [text[last:a], restored]
                        last = b
                    keys.append(key.as_py())
                    counts.append(len(found))
                    out.append("".join(parts) + text[last:])
                    gathered += len(out[-1])
                if keys and (gathered > _HANDED_ON or at == batch.num_rows):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(counts, pa.int32()), pa.array(out, pa.string())], names=["url_hash", "stretches", "restored"])
                    keys, counts, out, gathered = [], [], [], 0

    return spread(odd).mapInArrow(run, "url_hash string, stretches int, restored string")
