"""Template residue, filler text and notices in place of content.

Phrases of notices and fillers in ten languages, filler Latin, values that print as unset, and the
delimiters of placeholders all go into one multi-pattern automaton, and each text is read once.

* *Coverage.* The characters that matched phrases cover, over the characters of the text's
  words (ids, addresses and numbers say nothing and don't count). A notice is mostly made of such phrases; an
  article that quotes one, or a page that shows one beside its content, stays far below. Words that are common in notices
  count towards the coverage of a text, once it holds a phrase of a notice. An error status of the page
  is evidence: such a page needs less coverage, though never none.
* *Placeholders.* Where an opening delimiter matched, the placeholder it may open is read; one is
  enough, unless it stands in a code span.

Defined results: null content gives no row; empty or blank content is no residue; a null
title counts as empty, a null status as sound; of repeated rows of a page any decides; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import spread

#: Phrases of notices by what they tell, in lower case. (a|b) stands for either, (a|) for a or nothing.
NOTICES = {
    "not_found": (
        "(page|file|document|article|resource|url|address|link) (was |is |has |could |can |)(not|not be|not been) found", "could not be found", "can not be found", "cannot be found",
        "(couldn't|can't|could not|cannot|unable to|didn't) (find|locate) (the|that|this|your) (page|file|document|article|address)", "(page|file|document|article|address|url) (does not|doesn't|no longer) exist", "no longer exists",
        "(page|article|content|file|link) (is|has been|may have been|was) (gone|unavailable|removed|deleted|moved|no longer available)", "(moved|removed|renamed) or (deleted|removed|renamed)", "have been (moved|removed|deleted|renamed)",
        "(error|http|code) (404|410)", "404 (not found|error)", "410 gone", "nothing (was found|found|here|at this address|at)", "(check|verify) the (address|url|spelling|link)", "(go|get) back to (the |)(home|start|front)( |)page", "or go back",
        "(try|use) (the|our) search( box| bar|)", "broken link", "dead link", "looked everywhere", "leads nowhere", "address (leads|is wrong|is invalid)",
        "existiert (leider |)nicht( mehr|)", "(seite|datei|adresse) (wurde |)(leider |)nicht gefunden", "konnte(n wir|) (leider |)(die seite |diese seite |)nicht (gefunden werden|finden)", "n'existe plus", "page (introuvable|non trouvée)", "est introuvable", "n'a pas été trouvée",
        "página no (encontrada|existe)", "no (existe|se encontró|se ha encontrado|encontramos)", "(página|endereço) não (encontrada|encontrado|existe)", "não (existe|foi encontrada|foi possível encontrar|encontramos)", "pagina (non trovata|inesistente|niet gevonden)", "(non esiste|non è stata trovata|bestaat niet|is niet gevonden)( più| meer|)",
        "страница не (найдена|существует)", "не (существует|найдена|удалось найти)", "strona nie (istnieje|została znaleziona)", "nie (znaleziono|istnieje)", "(ページ|ファイル|記事)(が|は)(見つかりません|存在しません|見つかりませんでした)", "見つかりませんでした", "お探しのページ",
    ),
    "server_error": (
        "internal server error", "server error", "(bad gateway|gateway time-out|gateway timeout|service unavailable|service temporarily unavailable)", "(fatal|parse|syntax|runtime|database) error", "uncaught (typeerror|referenceerror|error|exception)", "unhandled exception", "java.lang.", "nullpointerexception",
        "traceback (most recent call last)", "#0 {main}", "stack trace", "warning: (mysql|mysqli|pg|include|require)_", "access denied for user", "could not be reached", "(could not|cannot|can't|failed to|unable to) connect to( the|) (database|server)", "have you set the password", "is (busy|overloaded)", "(please |)try again (in|later)",
        "something went wrong", "an (unexpected |internal |)error (has |)occurred", "request id", "sqlstate[", "interner serverfehler", "es ist ein fehler aufgetreten", "erreur interne( du serveur|)", "une erreur (est survenue|s'est produite)", "error interno( del servidor|)", "se ha producido un error", "erro interno( do servidor|)", "ocorreu um erro",
        "errore interno( del server|)", "si è verificato un errore", "interne serverfout", "внутренняя ошибка сервера", "произошла ошибка", "wewnętrzny błąd serwera", "サーバーエラー", "エラーが発生しました",
    ),
    "maintenance": (
        "(down|closed|offline) for (scheduled |planned |)maintenance", "(under|undergoing) (scheduled |planned |)maintenance", "(scheduled|planned) maintenance", "(be right back|be back soon|back shortly)", "minutes from now", "(back|again) (in|at) (a few|some) minutes", "(wieder|bald) (erreichbar|verfügbar|für sie da)", "wartungsarbeiten", "wird gerade gewartet",
        "en (cours de |)maintenance", "(en|em) (mantenimiento|manutenção)", "in manutenzione", "in onderhoud", "техническ(ое|ие) (обслуживание|работы)", "prace (konserwacyjne|techniczne)", "メンテナンス中", "der server ist in", "minuten wieder",
    ),
    "access": (
        "access to this (page|site|resource) (has been|is|was) (denied|blocked|restricted)", "access (denied|forbidden)", "(403|401) (forbidden|unauthorized|error)", "(do not|don't) have (permission|access)", "you have been blocked", "(not|un)authorized to (view|access)", "zugriff (verweigert|gesperrt)", "keine berechtigung", "accès (refusé|interdit)", "acceso (denegado|prohibido)",
        "acesso (negado|proibido)", "accesso (negato|vietato)", "toegang geweigerd", "доступ (запрещён|запрещен|закрыт)", "brak dostępu", "アクセス(が拒否|できません)",
    ),
    "robot_check": (
        "(are|you're) not a robot", "(verify|confirm|prove) (that |)you('re| are) (not a robot|human|a human)", "not a robot", "too many requests", "checking (your browser|if the site connection)", "before you reach", "takes a few seconds", "(complete|solve) the (puzzle|captcha|challenge|check)", "to go on", "security check", "unusual traffic", "please confirm", "from your network",
        "kein roboter", "pas un robot", "no es un robot", "(não é|não sou) um robô", "non sei un robot", "geen robot", "не робот", "nie jesteś robotem", "ロボットではありません",
    ),
    "parking": (
        "(is|has been) parked", "contact the registrar", "to renew it", "(domain|domain name|website) (is |may be |)for sale", "buy this domain", "(account|site|website) (has been |)suspended", "has been suspended", "hosting provider", "under construction", "coming soon", "domain (steht zum verkauf|zu verkaufen)", "(im aufbau|in kürze verfügbar)", "en construction", "(en|em) (construcción|construção)",
        "in costruzione", "в разработке", "домен (продаётся|продается)", "w budowie", "工事中", "準備中",
    ),
    "default_page": ("default (web |)page", "default page of the (web |)server", "it works!", "welcome to nginx", "apache2 (ubuntu |debian |)default page", "index of /", "test page for the", "successfully installed"),
    "scripts": (
        "(enable|activate|turn on|allow) (javascript|java script|scripts|cookies)", "(javascript|scripts|cookies and scripts|cookies) (is|are) (required|disabled|needed|turned off|switched off|not enabled)", "(requires|require|needs|need) (javascript|java script|scripts)", "without javascript", "(javascript|scripts) to (run|work|function)", "has (scripts|javascript) (switched|turned) off",
        "to (run|view|use|see) this (app|page|site|website|application)", "to continue", "turn (them|it) on and reload", "nothing can be shown", "in your browser", "(benötigt|erfordert|braucht) (javascript|cookies)", "(aktivieren sie |)(javascript) (aktivieren|ist deaktiviert|wird benötigt)", "aktivieren sie javascript", "diese (anwendung|seite|website)", "(besoin de|nécessite|activez|activer) javascript", "pour s'afficher",
        "javascript est (désactivé|requis|nécessaire)", "(necesita|requiere|active|habilite|activar) javascript", "javascript (está desactivado|es necesario)", "(precisa de|requer|ative|habilite) (o |)javascript", "javascript (está desativado|é necessário)", "(richiede|attiva|abilita|necessita di) javascript", "javascript (è disabilitato|è necessario|è richiesto)", "(vereist|schakel|heeft) javascript", "javascript (nodig|vereist|uitgeschakeld|in te schakelen)",
        "(включите|требуется|необходим|нужен) javascript", "javascript (отключен|отключён|включить)", "(włącz|wymaga|wymagany jest) (obsługi |)javascript", "javascript(を有効|が必要|が無効)",
    ),
    "filler": (
        "add your (title|text|heading|content|subtitle)", "your (headline|title|text|content|subtitle|logo) (goes |)here", "button label", "caption placeholder", "(insert|add) (picture|image|photo|text)( here|)", "text block", "write something about", "(this is a |)sample (paragraph|text|page|post|heading)", "click to edit", "(it and |)tell your own story", "replace this (text|paragraph)",
        "placeholder text", "dummy (text|content)", "edit this text", "lorem ipsum", "(blindtext|platzhaltertext|mustertext)", "ihr text( steht|) hier", "(texto|título) de (ejemplo|exemplo)", "(su|tu|seu) (texto|título) aqu(í|i)", "texte (d'exemple|ici)", "votre (texte|titre) ici", "testo (di esempio|segnaposto)", "voorbeeldtekst", "(пример текста|ваш текст|текст-заполнитель)", "przykładowy tekst", "(サンプル|ダミー)テキスト",
    ),
}
#: Words that are common in notices; they count only beside a phrase of a notice.
NOTICE_WORDS = (
    "sorry", "oops", "error", "page", "address", "please", "server", "browser", "site", "website", "problem", "reference", "request", "warning", "javascript", "cookies", "scripts", "reload", "refresh", "account", "domain", "database", "retry", "may have been", "you need to", "you requested",
    "are looking for", "of the web server", "has been", "isn't available", "complete", "welcome", "seite", "leider", "bitte", "fehler", "anwendung", "désolé", "cette page", "la page", "le site", "erreur", "veuillez", "la página", "la dirección", "lo sentimos", "por favor", "a página", "o endereço",
    "desculpe", "erro", "questo sito", "la pagina", "spiacenti", "errore", "deze pagina", "pagina", "adres", "адрес", "страница", "сайт", "ошибка", "извините", "пожалуйста", "strona", "przepraszamy", "申し訳", "サイト", "このページ",
)
#: Values that print like this were never set; whole words only, the bracketed one aside.
UNSET = ("undefined", "null", "nan", "[object object]", "{currency}")
#: Labels that stand before or after values that were never set.
UNSET_BESIDE = ("price:", "price", "sold by", "items", "total:", "name:", "qty", "by", "date:", "author:", "preis:", "prix:", "precio:", "preço:", "prezzo:", "цена:", "価格")
#: Word beginnings of the usual filler Latin.
FILLER_LATIN = (
    "lorem", "ipsum", "dolor", "sitam", "amet", "conse", "tetur", "adipi", "elit", "sedo", "eiusm", "tempor", "incidid", "labor", "magna", "aliqu", "enim", "minim", "venia", "nostru",
    "exerci", "ullam", "nisi", "commo", "duis", "aute", "irure", "reprehen", "volupt", "velit", "esse", "cillum", "fugia", "nulla", "pariat", "except", "sint", "occae", "cupid", "proid",
    "culpa", "offici", "deser", "molli", "laborum",
)
#: What placeholders open with.
DELIMITERS = ("{{", "{%", "<%", "<?", "${", "#{", "%%", "@@", "<<", "[[", "[insert ", "__", "{", "[")
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%[=\-#]?[^%\n]+%>|<\?=?[^?\n]+\?>|\$\{[\w.:|-]+\}|#\{[\w.]+\}|%%\w+%%|@@\w+@@"
    r"|<<\w+>>|\[\[[\w. ]+\]\]|\[insert [^\[\]\n]+\]|\[[\w ]+ goes here\]|(?<![\w_])__[a-zA-Z]\w*?__(?![\w_])|(?<![\w{$#])\{[^\W\d][\w.]*\}(?!\})"
    # Counts of regular expressions and arguments of formulas are no positional placeholders.
    r"|(?<![\w{}$#)\]^\\*+?.])\{\d{1,3}(?:[:,][\w.#]+)?\}(?![{}])"
)
CODE_SPAN = re.compile(r"`[^`\n]*`")
_ALTERNATIVES = re.compile(r"\(([^()]*\|[^()]*)\)")
_WORD_END = re.compile(r"[^\W\d_]*")
#: Tokens that say nothing of a text: ids, addresses, paths, numbers.
_MUTE = re.compile(r"\S*[/@\\_\d]\S*")


def expanded(template: str) -> list[str]:
    """All phrases a template stands for."""
    parts = _ALTERNATIVES.split(template)
    choices = [p.split("|") if i % 2 else [p] for i, p in enumerate(parts)]
    return sorted({" ".join("".join(c).split()) for c in itertools.product(*choices)})


def automaton() -> ahocorasick.Automaton:
    """The automaton of all patterns; the value of each is (kind, pattern)."""
    found = ahocorasick.Automaton()
    for w in DELIMITERS:
        found.add_word(w, ("delimiter", w))
    for kind, words in (("latin", FILLER_LATIN), ("word", NOTICE_WORDS), ("beside", UNSET_BESIDE), ("unset", UNSET)):
        for w in words:
            found.add_word(w, (kind, w))
    for kind, templates in NOTICES.items():
        for phrase in itertools.chain.from_iterable(map(expanded, templates)):
            found.add_word(phrase, (kind, phrase))
    found.make_automaton()
    return found


def placeholders(text: str) -> int:
    """Unfilled placeholders outside code spans; a stack trace's ``{main}`` is none."""
    return sum(m != "{main}" for m in PLACEHOLDER.findall(CODE_SPAN.sub(" ", text)))


def _length(spans: list[tuple[int, int]]) -> int:
    """Characters that spans cover together."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def examine(text: str, patterns) -> tuple[int, float, float, float, str | None]:
    """(placeholders, share that notices cover, share of unset values, share of filler Latin, kind that covers most)."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length in lower case
        text = low
    low = low.replace("’", "'").replace("\xa0", " ")
    spans: dict[str, list[tuple[int, int]]] = {}
    opened = False
    for end, (kind, pattern) in patterns.iter(low):
        a, b = end + 1 - len(pattern), end + 1
        if kind == "delimiter":
            opened = True
            continue
        first, last = pattern[0].isalnum(), pattern[-1].isalnum()
        if pattern.isascii() and (first and a and low[a - 1].isalnum() or kind != "latin" and last and b < len(low) and low[b].isalnum()):
            continue  # inside a word
        spans.setdefault(kind, []).append((a, b))
    marks = placeholders(text) if opened else 0
    if not spans:
        return marks, 0.0, 0.0, 0.0, None
    spans_of = lambda *kinds: [s for k in kinds for s in spans.get(k, ())]
    notices = [k for k in NOTICES if k in spans]
    latin = 0
    # Beginnings are two letters in three of filler Latin; elsewhere they aren't worth the words around them.
    if sum(b - a for a, b in spans.get("latin", ())) * 4 > len(low):
        latin = _length([(a, _WORD_END.match(low, b).end()) for a, b in spans["latin"]])
    if not notices and not latin and len(spans.get("unset", ())) < 2:
        return marks, 0.0, 0.0, 0.0, None
    # Length without blanks and mute tokens; what a span covers of those doesn't count either, so the share stays below one.
    whole = max(1, len("".join(low.split())) - sum(len(m) for m in _MUTE.findall(low)))
    share = min(1.0, _length(spans_of("word", *notices)) / whole) if notices else 0.0
    unset = min(1.0, _length(spans_of("unset", "beside")) / whole) if len(spans.get("unset", ())) > 1 else 0.0
    return marks, share, unset, latin / whole, max(notices, key=lambda k: _length(spans[k])) if notices else None


def residue(content: DataFrame, pages: DataFrame, least_coverage: float = 0.4, with_error_status: float = 0.3, least_latin: float = 0.5) -> DataFrame:
    """(url_hash, reason): the pages to leave out and why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = automaton()
        for batch in batches:
            keys, reasons, shares = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks, share, unset, latin, kind = examine(text, patterns)
                sure = "placeholder" if marks else "unset" if unset >= 0.5 else "filler" if latin >= least_latin else None
                if sure or share >= min(least_coverage, with_error_status) and kind:
                    keys.append(key)
                    reasons.append(sure or kind)
                    shares.append(1.0 if sure else share)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(reasons, pa.string()), pa.array(shares, pa.float64())], names=["url_hash", "reason", "share"])

    def titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if placeholders(t)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(["placeholder"] * len(keys), pa.string())], names=["url_hash", "reason"])

    present = content.where(F.col("url_hash").isNotNull() & F.col("content").isNotNull())
    covered = spread(present.select("url_hash", "content")).mapInArrow(run, "url_hash string, reason string, share double")
    failed = pages.where((F.col("status") >= 400) & F.col("url_hash").isNotNull()).select("url_hash").distinct().withColumn("failed", F.lit(True)) if "status" in pages.columns else None
    if failed is None:
        by_text = covered.where(F.col("share") >= least_coverage).select("url_hash", "reason")
    else:
        needed = F.when(F.col("failed"), with_error_status).otherwise(least_coverage)
        by_text = covered.join(failed, "url_hash", "left").where(F.col("share") >= needed).select("url_hash", "reason")
    odd = pages.where(F.col("url_hash").isNotNull() & F.col("title").rlike(r"[{}<>\[%@_]")).select("url_hash", "title")
    by_title = odd.mapInArrow(titles, "url_hash string, reason string").join(present.select("url_hash"), "url_hash", "left_semi")
    return by_text.unionByName(by_title).groupBy("url_hash").agg(F.min("reason").alias("reason"))
