"""Main body of pages by consensus of host paths.

A page's lines are its containers; the tables hold text without markup, so what generalises
over pages are two *paths* of a line: its text without case, blanks and digits, and, for
short lines, that text without capitalised words as well (names of sites, persons, places).

1. *Score.* Every page scores its lines by their place and shape alone: what stands before the title or
   after the last sentence, list or table speaks for the site; sentences, list items, table rows, what heads
   them and what follows the title speak for the body.
2. *Vote.* Spark sums the scores of all pages for each (host, path), for each path over all
   hosts, and for each generalised path. A path that comes back on a host over different texts is the site's, sentences
   included; copies of one text under one title count as one voice. List items, rows and bylines that recur stay body.
3. *Re-extract.* Each page is read again with the winning paths: they're taken out first, then
   what lies before the title, or after the last sentence left, goes too.

Phrases of notices, menus and legal lines in several languages are a prior only: they mark a line where
no vote does (a host of few pages); a vote for the body overrules them.

Defined results: null content gives no row; blank lines are never listed; null titles are
allowed; repeated rows of a page count once (latest content); pages without a host vote
as one host; extra columns are ignored. Phrases with more than two lost characters aren't recognised by the prior.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.llm.encoding import READERS
from crawlquarry.session import broadcast_if_small, materialize, ship

_N = r"\d[\d.,  ]*"
#: Whole lines (lower case, blanks collapsed) that belong to the site around a text, by kind and language.
CHROME = {
    "share": r"like it\? share it with others!|share(?: this page)?(?::.*)?|tell a friend about this|send this story to someone|print|save for later|(?:diese seite )?teilen|drucken|merken|beitrag per mail empfehlen"
    r"|partager(?: cette page)?(?:\s?:.*)?|envoyer à un ami|enregistrer|imprimer|compartir(?: esta página)?(?::.*)?|enviar a un amigo|imprimir|guardar|partilhar(?: esta página)?(?::.*)?|enviar a um amigo"
    r"|поделиться(?::.*)?|отправить другу|распечатать|сохранить|この記事をシェアする|シェア|印刷",
    "newsletter": r"get our best pieces by mail every .*|sign up for the .*letter .*|enter your e-?mail address to join .*|follow .* for more|join our newsletter.*|jetzt den newsletter von .* bestellen|[\d.]+ leser erhalten unsere post schon"
    r"|recevez la lettre de .*|inscrivez-vous comme .* lecteurs|únase a .* lectores|suscríbase al boletín de .*|junte-se a .* leitores|receba o boletim de .*|подпишитесь на письма .*|нас читают .* человек|読者は.*人|.*のメールマガジンに登録",
    "counter": rf"{_N} comments?|read {_N} times|views: {_N}|{_N} people found this useful|{_N} kommentare?|{_N} mal gelesen|{_N} commentaires?|lu {_N} fois|{_N} comentarios?|{_N} comentários?|visto {_N} ve[cz]es|lido {_N} vezes"
    rf"|комментариев: {_N}|просмотров: {_N}|コメント{_N}件|閲覧数?:? ?{_N}.*",
    "advertisement": r"advertisement|sponsored(?: content)?|ad\W{1,4}continue below|story continues below|continue reading|show more comments|anzeige|werbung|artikel geht unten weiter|weiterlesen|publicité|la suite après la publicité|lire la suite"
    r"|contenu sponsorisé|publicidad|anuncio|continúa abajo|sigue leyendo|publicidade|anúncio|continua abaixo|continue a ler|реклама|читать дальше|читать|дальше|продолжение ниже|広告(?:スポンサー)?|スポンサー|続きを読む方?は?(?:こちら)?",
    "login": rf"sign in|log in(?: or create an account)?|my account|welcome, guest|(?:basket|warenkorb|panier|cesta|cesto|carrinho|корзина) ?\({_N}\)|anmelden|mein konto|se connecter|mon compte|mi cuenta|iniciar sesión|entrar|a minha conta|войти|личный кабинет|ログインはこちら|ログイン",
    "cookie": r"(?:this website stores small files|we use cookies|you can change your choice|by staying you agree|some of them are needed|wir verwenden cookies|diese website speichert|sie können die auswahl|mit der nutzung stimmen|nous utilisons des cookies"
    r"|ce site dépose des traceurs|vous pouvez modifier ce choix|en poursuivant, vous acceptez|usamos cookies|este sitio guarda datos|este site guarda dados|puede cambiar su elección|pode mudar a sua escolha|si continúa, acepta|se continuar, aceita|сайт хранит данные"
    r"|мы используем файлы cookie|вы соглашаетесь|соглашаетесь\.|оставаясь,|вы можете изменить|当サイトはクッキー|設定はいつでも変更).*|.{1,60} and its partners use cookies.*|accept(?: all)?|reject all(?:\s+settings)?|settings|manage preferences|ok, understood"
    r"|alle akzeptieren|ablehnen|einstellungen|refuser|tout accepter|paramétrer|aceptar todo|aceitar tudo|rechazar|rejeitar|configurar|вы|(?:вы )?(?:принять|отклонить|настройки)|同意する|拒否|設定",
    "tags": r"(?:tags|topics|filed under|schlagwörter|themen|mots-clés|thèmes|sujets|etiquetas|temas|метки|темы|タグ一覧|タグ)\s?[:：].*",
    "legal": r"(?:©|\(c\)) ?\d{4}\b.*|copyright \d{4}\b.*|no part of this page may be copied.*|the views given here are those of the writers.*|.{1,60} is a trading name of .*|für inhalte fremder seiten übernimmt .*|toute reproduction sans l'accord de .*"
    r"|prohibida la copia sin permiso de .*|proibida a cópia sem .*|(?:terms of use|impressum|mentions légales|aviso legal|termos|правила|利用規約)(?:\s*[·|/-]\s*.{1,30}){1,4}|копирование .* запрещено.*|無断転載を禁じます。?",
}
#: Headings of lists of other articles.
RELATED = (
    r"you may also like|more from this section|related articles|read next|most read|popular this week|trending now|editor.{1,9}s picks?|mehr zum thema|beliebte beiträge|meistgelesen|das könnte sie auch interessieren|auch interessant"
    r"|à lire aussi|sur le même sujet|les plus lus|populaires?|populares|artículos relacionados|también le puede interesar|lo más leído|artigos relacionados|também lhe pode interessar|mais lidos|mais lidas|leia também"
    r"|по теме|читайте также|самое читаемое|самое|читаемое|популярное|関連記事|人気記事ランキング|人気記事|あわせて読みたい"
)
_CHROME = re.compile("|".join(f"(?:{p})" for p in CHROME.values()))
_RELATED = re.compile(RELATED)
_SENTENCE_END = re.compile(r"[.!?…。！？][\"”»“’')\]]*$")
_ITEM = re.compile(r"(?:[-*•–]|\d{1,3}[.)]) ?\S")
_CRUMB = re.compile(r".+ [>›»] .+")
_MENU_CUT = re.compile(r" [/|·] |\s{2,}")
_BYLINE = re.compile(r"(?:written |text |texte? |texto )?(?:by|von|par|por)\b .{2,60}|(?:text|texte?|texto|автор|author)\s?[:：].*|文責.*|.{2,50}, staff writer", re.I)
_SPACES = re.compile(r"\s+")
_OFF = " \t\xa00123456789"
_REPAIRS = (("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp1251", "utf-8"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp1252", "cp932"))
#: Characters that wrong decodings leave behind.
_STRAY = re.compile("[\u0080-\u009f\ufffdÂÃâãÐÑРСƒ√¬┬├Γ╨╤ÈÌÒÓÔÛ‡ˆ‰·¸ﬂ‚]|[À-ÿ]{4}|[â-é][\u0080-º¼-¿€-™]")
#: What a lost character of a short phrase mostly was.
_LOST_ONES = "·–é’©üöäóíñçèàáã«»"
BODY, SITE = 0, 1
_BYTES = {wrong: {ord(c): b for c, b in read.items()} for wrong, read in READERS.items()}


def _repaired(line: str) -> list[str]:
    """What a line with stray or lost characters may have been."""
    out, now = [], [line]
    if "\ufffd" in line:  # no channel reads these; short phrases can be tried
        if line.count("\ufffd") <= 2:
            for _ in range(line.count("\ufffd")):
                now = [t.replace("\ufffd", c, 1) for t in now for c in _LOST_ONES]
            out = now
        return out
    for _ in range(2):
        after = []
        for text in now:
            for wrong, right in _REPAIRS:
                try:
                    after.append(codecs.charmap_encode(text, "strict", _BYTES[wrong])[0].decode(right))
                except UnicodeError:
                    continue
        now = [t for t in after if t != line and t not in out]
        out += now
    return out


def _matches(what: re.Pattern, low: str, line: str) -> bool:
    """Whether a line, or what it was before a wrong decoding, is wholly of a kind. ``low`` is it in lower case with collapsed blanks."""
    if what.fullmatch(low):
        return True
    return bool(not line.isascii() and _STRAY.search(line)) and any(what.fullmatch(_SPACES.sub(" ", t.lower()).strip()) for t in _repaired(line))


#: Whether a line is the site's own, or a heading of a list; lines of sites recur, so most are looked up.
_known: dict[str, tuple[bool, bool]] = {}


def _kind(low: str, line: str) -> tuple[bool, bool]:
    found = _known.get(line)
    if found is None:
        chrome = _matches(_CHROME, low, line)
        found = chrome, not chrome and _matches(_RELATED, low, line)
        if len(line) < 120:
            if len(_known) > 200_000:
                _known.clear()
            _known[line] = found
    return found


def is_prose(line: str) -> bool:
    """A line of sentences."""
    if not _SENTENCE_END.search(line):
        return False
    return line.count(" ") >= 4 or (len(line) >= 12 and not line.isascii() and line.count(" ") < 4 and ord(max(line)) > 0x3000)


def _title_at(lows: list[str], title: str | None, lines: list[str]) -> int | None:
    """Index of the line that is the page's title."""
    wanted = _SPACES.sub(" ", title).strip().lower() if title else ""
    crumb = None
    for i, low in enumerate(lows):
        if not low:
            continue
        if crumb and low == crumb:
            return i
        if _CRUMB.fullmatch(low):
            crumb = re.split(r" [>›»] ", low)[-1].strip()
            continue
        if len(low) >= 4 and wanted and (wanted == low or wanted.startswith((low + " - ", low + " | ", low + " – ", low + " · ")) or wanted.endswith((": " + low, " | " + low, " - " + low))):
            return i
    return None


#: Bits of a line's shape.
PROSE, ITEM, ROW, CRUMB, BY, MENU, CELLS, PRIOR = (1 << k for k in range(8))
FIRM = PROSE | ITEM | ROW
_TOKENS = re.compile(r"[^\W\d_]+|[^\w\s]")
_HAS_DIGIT = re.compile(r"\d")


def _path(line: str) -> str:
    """A line in lower case without blanks and digits."""
    line = line.lower()
    for c in _OFF:
        line = line.replace(c, "")
    return line


def _generalised(line: str) -> str:
    """A line without digits and the capitalised words after its first."""
    return " ".join(w.lower() for j, w in enumerate(_TOKENS.findall(line)) if not (j and w[0].isupper()))


def outline(content: str, title: str | None, prior: bool = True) -> tuple[list[int], list[str], list[str], list[int], list[int], int, str]:
    """Of the lines that aren't blank: (line numbers, paths, generalised paths, shapes, scores in tenths); then the place of the title among them (-1 if unknown) and what tells the text from others: its longest sentence line and its title."""
    raw = content.split("\n")
    numbers = [i for i, x in enumerate(raw) if x.strip()]
    lines = [raw[i].strip() for i in numbers]
    lows = [" ".join(x.split()).lower() for x in lines]
    n = len(lines)
    cells = [x.count(" | ") for x in lines]
    shapes = [0] * n
    for i, x in enumerate(lines):
        s = (PROSE if is_prose(x) else 0) | (ITEM if _ITEM.match(x) else 0)
        if cells[i]:
            # Rows of a table stand together; blank lines part tables.
            near = [j for j in (i - 1, i + 1) if 0 <= j < n and abs(numbers[j] - numbers[i]) == 1 and cells[j] == cells[i]]
            s |= CELLS if _HAS_DIGIT.search(x) else 0
            s |= ROW if near and (s & CELLS or any(_HAS_DIGIT.search(lines[j]) for j in near)) else 0
        if not s & FIRM:
            s |= (CRUMB if _CRUMB.fullmatch(lows[i]) else 0) | (BY if _BYLINE.fullmatch(x) else 0) | (MENU if len([p for p in _MENU_CUT.split(raw[numbers[i]].strip()) if p]) >= 3 else 0)
        if prior and any(_kind(lows[i], x)):
            s |= PRIOR
        shapes[i] = s
    paths = [_path(x) for x in lines]
    title_at = _title_at(lows, title, lines)
    labels = extract(shapes, [bool(s & PRIOR) for s in shapes], -1 if title_at is None else title_at)
    start, end = labels[1], labels[2]
    scores = []
    for i in range(n):
        firm = shapes[i] & FIRM
        before = shapes[i - 1] if i else 0
        after = shapes[i + 1] if i + 1 < n else 0
        if i < start:
            score = 10 if title_at is not None else 5
        elif firm or i == title_at or (i > start and before & (ITEM | ROW) and after & FIRM) or after & (ITEM | ROW) or (title_at is not None and i == start + 1 and after & PROSE):
            score = -10
        else:
            score = 7 if i > end else 0
        scores.append(max(score, 0) + 10 if shapes[i] & PRIOR else score)
    general = ["" if s & FIRM else _generalised(x) for s, x in zip(shapes, lines)]
    body = max((p for p, s in zip(paths, shapes) if s & PROSE), key=len, default="") + (lines[title_at] if title_at is not None else "")
    return numbers, paths, general, shapes, scores, -1 if title_at is None else title_at, body


def extract(shapes: list[int], site: list[bool], title_at: int) -> tuple[list[int], int, int]:
    """(label of each line, first and last line of the body) of a page whose ``site`` lines are known."""
    n = len(shapes)
    start = title_at
    if title_at < 0:
        # The line before the first sentence, list or byline that isn't the site's own opens the text.
        first = next((i for i in range(n) if shapes[i] & (PROSE | ITEM) and not site[i]), None)
        start = 0
        if first:
            for i in range(first - 1, -1, -1):
                if site[i]:
                    continue
                if shapes[i] & (BY | CELLS):
                    start = i
                    continue
                start = i + 1 if shapes[i] & (CRUMB | MENU) else i
                break
            else:
                start = first
    end = next((i for i in range(n - 1, start - 1, -1) if shapes[i] & FIRM and not site[i]), n - 1)
    labels = []
    for i in range(n):
        outside = i < start or i > end or site[i] or (shapes[i] & CRUMB and i <= start + 1)
        labels.append(BODY if i == title_at or not outside else SITE)
    return labels, start, end


_OUTLINE = "url_hash string, host string, title_at int, voice int, numbers array<int>, paths array<bigint>, general array<bigint>, shapes array<int>, scores array<int>"


def _outlines(prior: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_OUTLINE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        hashed = lambda t: xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) if t else 0
        for batch in batches:
            rows = []
            for key, host, title, content in zip(*(c.to_pylist() for c in batch.columns)):
                numbers, paths, general, shapes, scores, title_at, body = outline(content, title, prior)
                rows.append((key, host, title_at, hashed(body or key) % 64, numbers, [hashed(p) for p in paths], [hashed(g) for g in general], shapes, scores))
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def outlines(content: DataFrame, pages: DataFrame, prior: bool = True) -> DataFrame:
    """One row a page: its lines' paths, shapes and scores as arrays."""
    ship(content.sparkSession)
    about = pages.where(F.col("url_hash").isNotNull()).groupBy("url_hash").agg(F.min(F.lower("host")).alias("host"), F.max_by("title", F.struct(F.col("title").isNotNull(), "crawled_at", "title")).alias("title"))
    # Keys are next to unique, so combining before the shuffle would only sort the texts once more.
    texts = content.where(F.col("url_hash").isNotNull() & F.col("content").isNotNull()).select("url_hash", "content", "updated_at").repartition("url_hash")
    texts = texts.groupBy("url_hash").agg(F.max_by("content", F.struct("updated_at", "content")).alias("content"))
    joined = texts.join(about, "url_hash", "left").select("url_hash", F.coalesce("host", F.lit("")).alias("host"), "title", "content")
    return joined.mapInArrow(_outlines(prior), _OUTLINE)


def winning_paths(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, path, site): the paths that win a vote, for the site or for the body.

    ``lines`` (host, path, general, shape, score, voice); ``sizes`` (host, pages). Different texts are
    told by a bitmap of 64 voices, so a vote is one fixed-size aggregate however hot a host or path is.
    """
    one = lambda bit: F.sum(F.when(F.col("shape").bitwiseAND(bit) != 0, 1).otherwise(0))
    votes = lines.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("score").alias("score"), one(ITEM | ROW).alias("entries"), one(PROSE).alias("prose"), F.expr("bit_or(shiftleft(1L, voice))").alias("voices"), F.max("general").alias("general"),
    )
    votes = materialize(votes, "votes")
    spoken = F.bit_count("voices")
    mean = F.col("score") / F.col("n") / 10
    entries, short = F.col("entries") * 2 > F.col("n"), F.col("prose") * 2 <= F.col("n")
    total = [F.sum("n").alias("n"), F.sum("score").alias("score"), F.sum("entries").alias("entries"), F.sum("prose").alias("prose"), F.expr("bit_or(voices)").alias("voices"), F.count("*").alias("hosts")]
    everywhere = votes.groupBy("path").agg(*total).where("hosts > 1")
    over_all = F.when(entries, False).when(short & (mean <= -0.4), False).when((F.col("hosts") >= 3) & (spoken >= 5) & (short | (F.col("n") >= 3 * F.col("hosts"))), True)
    everywhere = everywhere.select("path", over_all.alias("over_all")).where("over_all IS NOT NULL")
    alike = votes.where("general <> 0").groupBy("general").agg(*total, F.expr("bit_count(bit_or(shiftleft(1L, cast(pmod(xxhash64(host), 64) as int))))").alias("different"))
    alike = alike.where((F.col("different") >= 3) & (spoken >= 5) & (mean >= 0.3)).select("general", F.lit(True).alias("alike"))
    share = F.col("n") / F.col("pages")
    on_host = (
        F.when(entries, False).when(short & (mean <= -0.4) & (F.col("n") >= 2), False)
        .when((spoken >= 5) & (share >= 0.1), True).when((spoken >= 3) & ((mean >= 0.3) | (share >= 0.5)), True)
    )
    decided = votes.join(F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes, "host").withColumn("on_host", on_host)
    decided = decided.join(everywhere, "path", "left").join(alike, "general", "left")
    return decided.select("host", "path", F.coalesce("on_host", "over_all", F.when((F.col("prose") == 0) & (F.col("entries") == 0), F.col("alike"))).alias("site")).where("site IS NOT NULL")


def _relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, out = [], []
        for key, title_at, numbers, shapes, won in zip(*(c.to_pylist() for c in batch.columns)):
            verdict = {w["at"]: w["site"] for w in won or ()}
            site = [verdict.get(i, bool(s & PRIOR)) for i, s in enumerate(shapes)]
            found = [numbers[i] for i, label in enumerate(extract(shapes, site, title_at)[0]) if label == SITE]
            keys += [key] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.int64())], names=["url_hash", "line_no"])


def site_lines(content: DataFrame, pages: DataFrame, prior: bool = True, most_shared: int = 300_000, salts: int = 8) -> DataFrame:
    """(url_hash, line_no): the lines that aren't main body.

    Winning paths, one row a host and path, are broadcast where they're counted to be at most
    ``most_shared``; beyond that they're joined, salted, as a path of a hot host is on each of its pages.
    """
    found = materialize(outlines(content, pages, prior).withColumn("id", F.monotonically_increasing_id()), "outlines")
    sizes = found.groupBy("host").agg(F.count("*").alias("pages"))
    zipped = F.arrays_zip("paths", "general", "shapes", "scores")
    lines = found.select("host", "voice", F.explode(zipped).alias("l")).select("host", "voice", F.col("l.paths").alias("path"), F.col("l.general").alias("general"), F.col("l.shapes").alias("shape"), F.col("l.scores").alias("score"))
    won = materialize(winning_paths(lines, sizes).select(F.xxhash64("host", "path").alias("key"), "site"), "winners")
    at = found.select("id", "host", F.posexplode("paths").alias("at", "path")).select("id", "at", F.xxhash64("host", "path").alias("key"))
    shared, small = broadcast_if_small(won, most_shared)
    if small:
        hit = at.join(shared, "key")
    else:
        hit = at.withColumn("salt", F.pmod(F.col("id"), F.lit(salts))).join(won.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["key", "salt"])
    per = hit.groupBy("id").agg(F.collect_list(F.struct("at", "site")).alias("won"))
    return found.select("id", "url_hash", "title_at", "numbers", "shapes").join(per, "id", "left").drop("id").mapInArrow(_relabel, "url_hash string, line_no bigint")


def main_bodies(content: DataFrame, pages: DataFrame) -> DataFrame:
    """(url_hash, body): each page's text without the lines of the site around it."""
    gone = site_lines(content, pages).groupBy("url_hash").agg(F.collect_set("line_no").alias("gone"))
    texts = content.where(F.col("url_hash").isNotNull() & F.col("content").isNotNull()).groupBy("url_hash").agg(F.max_by("content", F.struct("updated_at", "content")).alias("content"))
    kept = F.expr("filter(transform(split(content, '\\n'), (x, i) -> struct(x as line, cast(i as bigint) as i)), s -> not array_contains(gone, s.i)).line")
    return texts.join(gone, "url_hash", "left").select("url_hash", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("body"))
