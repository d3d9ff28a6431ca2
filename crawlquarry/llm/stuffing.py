"""Keyword-stuffed pages, bare link lists and tag lists, told by their redundancy.

Each page is compressed in blocks, in two *views*: its letters, and its skeleton, in which
longer words, numbers, links and tags are one sign each while short words, marks and line ends
stay. Repeated keywords compress in the first; lists of links, tags or keywords, whose entries
all differ, compress in the second, where sentences don't, as their short words and marks come irregularly.
A block's ratio is held against the usual ratio of blocks of its view, length and language
(the median over the whole corpus, by Spark); the page's redundancy index is the lower of its two means.

An extreme index flags a page, whatever else it holds. Low density of sentence
punctuation then confirms it; templated keyword sentences, which have their marks, are confirmed
by an extreme index of their letters with half the words among the eight commonest. Pages that
aren't flagged never come out, whether they have sentences or not (verses, menus, tables).

Defined results: null, empty and blank content gives no row; null outlinks and counts count
as 0; of repeated rows of a page any decides; extra columns are ignored. Short pages vary more,
so the shorter a page, the further below the usual it must lie. Wrongly decoded text has
no marks to go by and must lie further below still.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import broadcast_if_small, materialize, spread

BLOCK, SKELETON_BLOCK = 1024, 512
_SENTENCE = re.compile(r"[.!?…][\"”»“’')\]]*(?=\s|$)|[。！？]", re.M)
_LINK = re.compile(r"(?<!\S)(?:#|https?://|www\.)")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_KANA = re.compile(r"[぀-ヿ一-鿿]")
#: The commonest function words of the languages in Latin script.
_FUNCTION_WORDS = {
    "en": {"the", "of", "and", "to", "in", "for", "with", "by", "was", "is"},
    "de": {"die", "der", "und", "für", "wurde", "mit", "den", "an", "auf", "das"},
    "fr": {"les", "des", "est", "été", "une", "du", "et", "au", "dans", "sur"},
    "es": {"el", "los", "las", "del", "por", "con", "que", "una", "se", "y"},
    "pt": {"os", "não", "uma", "em", "da", "do", "das", "dos", "ao", "são"},
}

_LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _k, _v in _FUNCTION_WORDS.items():
    for _w in _v:
        _LANGUAGES_OF[_w] = (*_LANGUAGES_OF.get(_w, ()), _k)


def language(text: str, words: list[str]) -> str:
    """Coarse language class; ``broken`` where most letters are stray high characters, ``none`` where no function words occur."""
    if text.isascii():
        return _by_words(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    # Kana and CJK; Cyrillic; what Latin text read wrongly is full of.
    for name, share, ranges in (("ja", 0.2, ((0x3040, 0x30FF), (0x4E00, 0x9FFF))), ("ru", 0.3, ((0x400, 0x4FF),)), ("broken", 0.15, ((0x80, 0xFF), (0x152, 0x192), (0x2018, 0x2122)))):
        if sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in ranges) > share * len(codes):
            return name
    return _by_words(words)


def _by_words(words: list[str]) -> str:
    seen = Counter(map(_LANGUAGES_OF.get, words))
    counts = dict.fromkeys(_FUNCTION_WORDS, 0)
    for languages, n in seen.items():
        for k in languages or ():
            counts[k] += n
    best = max(counts, key=counts.get)
    return best if counts[best] >= 0.05 * max(1, len(words)) else "none"


_URLS = re.compile(r"(?:https?://|www\.)\S+")
_TAGS = re.compile(r"#\w+")
_NUMBERS = re.compile(r"\d+(?:[.,:]\d+)*")
_KANJI, _KATAKANA = re.compile(r"[一-鿿]+"), re.compile(r"[ァ-ヿ]+")
_LONG_WORDS = re.compile(r"[^\W\d_ぁ-ゟ]{4,}")
_BLANKS = re.compile(r"[^\S\n]{2,}|[^\S\n ]")


def skeleton(low: str) -> str:
    """A text in lower case with one sign for each longer word, number, link and tag; hiragana, short words and marks stay."""
    if "://" in low or "www." in low:
        low = _URLS.sub("@", low)
    if "#" in low:
        low = _TAGS.sub("#", low)
    if not low.isascii() and _KANA.search(low):
        low = _KATAKANA.sub("¦", _KANJI.sub("¤", low))
    return _BLANKS.sub(" ", _LONG_WORDS.sub("w", _NUMBERS.sub("0", low)))


def block_ratios(text: str, size: int) -> list[tuple[int, float]]:
    """(bytes, compressed share) of blocks of about ``size`` bytes."""
    raw = text.encode("utf-8", "replace")
    step = -(-len(raw) // max(1, round(len(raw) / size))) or 1
    return [(len(p), len(zlib.compress(p, 6)) / len(p)) for p in (raw[a : a + step] for a in range(0, len(raw), step))]


def redundancy(text: str) -> tuple[str, list[tuple[int, int, float]]]:
    """(language, (view, bytes, ratio) of each block)."""
    low = text.lower()
    return language(text, low.split()), [(0, *b) for b in block_ratios(low, BLOCK)] + [(1, *b) for b in block_ratios(skeleton(low), SKELETON_BLOCK)]


def punctuation(text: str) -> tuple[float, float, float, float]:
    """(share of characters in sentences, sentence marks a word, share of the 8 commonest words, share of link or tag tokens)."""
    words = _LETTERS.findall(text.lower())
    inside = last = marks = 0
    for m in _SENTENCE.finditer(text):
        start, marks = max(last, text.rfind("\n", last, m.start()) + 1), marks + 1
        inside += m.end() - start
        last = m.end()
    top = sum(n for _, n in Counter(words).most_common(8)) / max(1, len(words))
    links = len(_LINK.findall(text)) / max(1, len(text.split())) if "#" in text or "://" in text or "www." in text else 0.0
    return inside / max(1, len(text)), marks / max(1, len(words)), top, links


def _rows(schema: pa.Schema, describe):
    """A function over batches of (key, text) that gives the rows ``describe`` makes of each text that isn't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *describe(text)) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text.strip()]
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _described(text: str) -> tuple:
    lang, blocks = redundancy(text)
    return lang, *map(list, zip(*blocks)), len(text)


def measures(content: DataFrame) -> DataFrame:
    """One row for each page that isn't blank: its language, blocks as arrays, and length."""
    schema = pa.schema([("url_hash", pa.string()), ("language", pa.string()), ("views", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("ratios", pa.list_(pa.float64())), ("chars", pa.int64())])
    texts = content.where(F.col("url_hash").isNotNull() & F.col("content").isNotNull()).select("url_hash", "content")
    return spread(texts).mapInArrow(_rows(schema, _described), "url_hash string, language string, views array<int>, sizes array<int>, ratios array<double>, chars bigint")


def confirmations(texts: DataFrame) -> DataFrame:
    """(url_hash, sentences, marks, top, links) of ``texts`` (url_hash, content)."""
    schema = pa.schema([("url_hash", pa.string()), ("sentences", pa.float64()), ("marks", pa.float64()), ("top", pa.float64()), ("links", pa.float64())])
    return texts.mapInArrow(_rows(schema, punctuation), "url_hash string, sentences double, marks double, top double, links double")


def with_index(m: DataFrame, least_population: int = 30) -> DataFrame:
    """Measures with the redundancy ``index`` of each page and that of its ``letters`` alone."""
    blocks = m.select("url_hash", "language", F.explode(F.arrays_zip("views", "sizes", "ratios")).alias("b")).select("url_hash", "language", F.col("b.views").alias("view"), F.col("b.sizes").alias("size"), F.col("b.ratios").alias("ratio"))
    blocks = blocks.withColumn("length", F.floor(F.log2(F.col("size").cast("double")) * 2).cast("int"))
    # (view, language, length) has a few hundred values whatever the corpus; a thin class falls back to all languages, then to all lengths.
    usual = blocks.groupBy("view", "language", "length").agg(F.percentile_approx("ratio", 0.5, 10000).alias("own"), F.count("*").alias("n"))
    general = blocks.groupBy("view", "length").agg(F.percentile_approx("ratio", 0.5, 10000).alias("general"), F.count("*").alias("general_n"))
    overall = blocks.groupBy("view").agg(F.percentile_approx("ratio", 0.5, 10000).alias("overall"))
    enough = lambda n: F.col(n) >= least_population
    chosen = F.when(enough("n") & (F.col("language") != "none"), F.col("own")).when(enough("general_n"), F.col("general")).otherwise(F.col("overall"))
    expected = usual.join(F.broadcast(general), ["view", "length"]).join(F.broadcast(overall), "view").select("view", "language", "length", chosen.alias("expected"))
    share = lambda view: F.sum(F.when(F.col("view") == view, F.col("ratio") * F.col("size") / F.col("expected"))) / F.sum(F.when(F.col("view") == view, F.col("size")))
    index = blocks.join(F.broadcast(expected), ["view", "language", "length"]).groupBy("url_hash").agg(share(0).alias("letters"), share(1).alias("skeleton"))
    return m.join(index.select("url_hash", "letters", F.least("letters", "skeleton").alias("index")), "url_hash")


def stuffed_pages(content: DataFrame, pages: DataFrame, extreme: float = 0.88, repeated: float = 0.78, full_length: int = 400, small: int = 50_000) -> DataFrame:
    """(url_hash, index, sentences, marks, top, links, outlinks, language): the pages to leave out, with the measures that decided.

    ``small`` is the number of flagged pages up to which their keys are broadcast.
    ``extreme`` is the index that flags a page of ``full_length`` characters or more, ``repeated`` that of the letters of templated sentences.
    """
    m = with_index(materialize(measures(content), "measures"))
    listed = pages.where(F.col("url_hash").isNotNull()).groupBy("url_hash").agg(F.max(F.greatest(F.coalesce("outlink_count", F.lit(0)), F.coalesce(F.size("outlinks"), F.lit(0)))).alias("outlinks"))
    length = F.least(F.lit(1.0), F.pow(F.col("chars") / full_length, 0.3))
    flagged = F.col("index") <= F.when(F.col("language") == "broken", 0.6).otherwise(extreme) * length
    # Links need few marks to be a list; a page that links out of proportion to its words is held to the same.
    few = F.when((F.col("links") > 0.2) | (F.col("outlinks") > 30), 0.04).otherwise(0.03)
    unpunctuated = (F.col("sentences") < 0.5) & (F.col("marks") < few)
    templated = (F.col("letters") <= repeated * length) & (F.col("top") >= 0.5)
    # Only flagged pages, a few in a hundred, are read again to be confirmed.
    m = materialize(m.where(flagged).select("url_hash", "language", "letters", "index", "chars"), "flagged").dropDuplicates(["url_hash"])
    wanted, _ = broadcast_if_small(m.select("url_hash"), small)
    texts = content.where(F.col("content").isNotNull()).select("url_hash", "content").join(wanted, "url_hash")
    found = m.join(confirmations(texts), "url_hash").join(listed, "url_hash", "left").withColumn("outlinks", F.coalesce("outlinks", F.lit(0)))
    return found.where(unpunctuated | templated).select("url_hash", "index", "sentences", "marks", "top", "links", "outlinks", "language").dropDuplicates(["url_hash"])
