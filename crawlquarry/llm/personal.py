"""Personal data in free text: bootstrapped extraction by context.

1. *Recognise.* Recognisers propose candidates of each kind; the narrow ones among them (an address with
   an at sign, a number behind its label, a name behind a title or beside its own mail address) are
   seeds. Beside the known forms every other run of digits and capitals, and every house number with
   two or more capitalised words, is proposed as a *free* candidate, whose form nobody listed.
2. *Induce.* A candidate's surroundings give lexical patterns (two tokens left and right,
   left alone, right alone). What recurs of a candidate is its *node*: the shape of a number, the
   street type of an address, the given name of a person, the way a mail address is written.
3. *Score.* Patterns and nodes form a bipartite graph. Spark scores it in rounds until no more nodes gain
   trust: a pattern is worth the share of its occurrences whose node is trusted (or that are seeds), a node the
   share of its occurrences in worthy patterns.
4. *Discover.* A candidate comes out by its node's score and its best pattern's worth, seeds like all
   others. Free candidates need a pattern that known forms have made all but certain.
5. *Settle.* Findings that overlap are settled by kind and length; known forms go before free ones.

Graph rows are aggregated (kind, pattern, node) counts, so a pattern on a third of all
documents is one group with map-side counts; joins on patterns and nodes are salted.

Defined results: null and empty texts give no findings and come out unchanged; the same
text twice in one document is one finding; repeated documents count each; overlapping findings
are settled by kind (email, id, address, phone, name), then length; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlquarry.session import materialize, spread

KINDS = ("email", "national_id", "phone", "street_address", "person_name")
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|At|@|arroba|ät)\s?[\])}>]\s?|\s(?:at|AT|arroba|@)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|punkt|punto|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT|punkt|punto|point)\s|\.)"
_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*"
_DISGUISED = re.compile(r"(?i)[\[({<]\s?(?:at|@|arroba|ät)\s?[\])}>]|\s(?:at|arroba)\s")
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@{_LABEL}(?:\.{_LABEL})+|(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})+")
#: Shapes of identity, insurance, tax and passport numbers; # is a digit, @ a capital letter.
ID_SHAPES = ("@@######@", "@@ ## ## ## @", "###-##-####", "### ## ####", "########@", "@########", "@@@@-######", "######-####", "## ### ### ###", "@#########", "@@#######", "### ### ### ##")
ID = re.compile(r"(?<![\w.+/-])(?:" + "|".join("".join(r"\d" if c == "#" else "[A-Z]" if c == "@" else re.escape(c) for c in s) for s in ID_SHAPES) + r")(?![\w-])(?!\.\d)")
ID_LABEL = re.compile(
    r"(?i)(?:\bssn|social security(?: number| no\.?)?|national insurance(?: number| no\.?)?|\bni (?:number|no\.?)|passport(?: number| no\.?)?|\bdni|\bnie|\bnif|tax (?:id|number|no\.?)|personal number|identity card(?: number)?"
    r"|id card|steuer-?id|steuernummer|personalausweis|ausweis(?:nummer)?|reisepass|passnummer|sozialversicherungsnummer|pasaporte|passeport|carte d.identité|numéro fiscal|contribuinte|\bcpf|\bnss|\binsee)\W{0,4}$"
)
PHONE = re.compile(
    r"(?<![\w.:/+-])(?:\+\d{1,3}|00\d{1,3}|\(\d{2,5}\)|0\d{1,4}|1|\d{3})(?:[ .\-/]?(?:\(0\)|\(\d{1,4}\)|\d{1,6})){1,6}(?:,? ?(?:ext\.?|x|extension|Durchwahl|poste|int\.) ?\d{1,5})?(?![\w-])(?!\.\d)"
)
_NAME_PART = r"(?:(?:Mc|O['’]|D['’]|de |van |von )?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]{2,})"
_SURNAME = rf"{_NAME_PART}(?:-{_NAME_PART})?"
NAME = re.compile(rf"(?<![\w@.'’-])(?!(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\b)(?:{_SURNAME}, (?:{_NAME_PART}|[A-Z]\.)(?: [A-Z]\.)?|{_SURNAME} [A-Z]\.(?! ?{_NAME_PART})|(?:[A-Z]\. ){{1,2}}{_SURNAME}|{_NAME_PART}(?: [A-Z]\.)? {_SURNAME})(?![\w@-])")
_TYPES_AFTER = "Street|Road|Lane|Court|Mews|Close|Drive|Avenue|Terrace|Rise|Row|Way|Square|Place|Gardens|Crescent|Grove|Hill|Walk|Park|Boulevard|St\\.|Rd\\.|Ave\\."
_TYPES_BEFORE = "rue|avenue|chemin|allée|allee|boulevard|place|impasse|quai|route"
_TYPES_FIRST = "Calle|Avenida|Plaza|Paseo|Camino|Rua|Travessa|Praça|Via|Piazza"
_TYPES_JOINED = "weg|straße|strasse|str\\.|gasse|platz|allee|ring|damm|ufer"
_UNIT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? \d+[a-z]?,? )?"
_UNIT_AFTER = r"(?:, (?:Wohnung|piso|apt\.?|appartement|apto\.?|Whg\.?|App\.?|bâtiment|esc\.?|porta|andar) ?\w{1,4}|, \d{1,2}º(?: ?[A-Za-zÀ-ÿ]{1,4})?)?"
ADDRESS = re.compile(
    rf"(?<![\w-]){_UNIT}\d{{1,4}} ?[a-z]?(?<! ) [A-ZÀ-Þ][\wÀ-ÿ'-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'-]+)? (?P<after>{_TYPES_AFTER})(?![\w-])"
    rf"|(?<![\w-]){_UNIT}\d{{1,4}}(?: ?(?:bis|ter|[a-z]))?,? (?P<before>{_TYPES_BEFORE}) (?:de la |de |du |des )?[A-ZÀ-Þ][\wÀ-ÿ'-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'-]+)?{_UNIT_AFTER}"
    rf"|(?<![\w-])(?P<first>{_TYPES_FIRST}) (?:de la |de |del )?[A-ZÀ-Þ][\wÀ-ÿ'-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'-]+)?,? \d{{1,4}}[a-z]?(?![\w-]){_UNIT_AFTER}"
    rf"|(?<![\w-])[A-ZÀ-Þ][\wÀ-ÿ-]*?(?P<joined>{_TYPES_JOINED}) \d{{1,4}}[a-z]?(?![\w-]){_UNIT_AFTER}"
)
_TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Señor|Señora)\.? )$")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PHONE_LABEL = re.compile(r"(?i)(?:\btel\.?|\bt|phone|mobile|fax|call|hotline|téléphone|teléfono|telefon|telefone|rang from|number in the footer|on-call|under)\W{0,3}$")


#: Any other run of digits and capitals: its form is learned, not listed.
FREE_NUMBER = re.compile(r"(?<![\w.+/@#:-])(?:[A-Z]{1,4}[ -]?)?\d[\dA-Z]*(?:[./-][\dA-Z]+| [\dA-Z]*\d[\dA-Z]*)*(?:[ -]?[A-Z])?(?![\w@/-])(?![.,:]\d)")
#: A house number with capitalised words after it.
FREE_ADDRESS = re.compile(r"(?<![\w-])\d{1,4}[a-z]? [A-ZÀ-Þ][a-zß-ÿ'-]+(?: [A-ZÀ-Þ][a-zß-ÿ'-]+){1,2}(?![\w-])")


def shape(text: str) -> str:
    """Digits as #, capital letters as @."""
    return re.sub(r"[A-Z]", "@", re.sub(r"\d", "#", text))


def _tokens(text: str, opens: bool) -> list[str]:
    """Tokens in lower case, digits as #; capitalised words that don't open a sentence as Xx, since they are names of some kind."""
    out = []
    for t in _TOKEN.findall(text):
        if t[0].isupper() and len(t) > 1 and not t[1].isupper() and not opens:
            out.append("Xx")
        else:
            out.append(re.sub(r"\d+", "#", t.lower()))
        opens = t in ".!?:>"
    return out


def _around(text: str, a: int, b: int) -> tuple[str, str]:
    """Two tokens left and right inside the line; ^ and $ for the ends of the line."""
    start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    end = end if end >= 0 else len(text)
    # A stretch that holds three tokens, or the whole line, tells the last two; long tokens are never cut.
    reach, left = 48, []
    while True:
        left = _tokens(text[max(start, a - reach) : a], a - reach <= start)
        if len(left) > 2 or a - reach <= start:
            break
        reach *= 2
    left, reach = left[-2:], 48
    while True:
        right = _tokens(text[b : min(end, b + reach)], False)
        if len(right) > 2 or b + reach >= end:
            break
        reach *= 2
    right = right[:2]
    if not left:
        before = text[:start].rstrip()
        left = ["^", before[before.rfind("\n") + 1 :].rsplit(" ", 1)[-1] if before.endswith(",") else "^"]
    return " ".join(left), " ".join(right or ["$", "$"])


_SHOUTED = re.compile(r"[A-ZÀ-Þ]{2,},? $"), re.compile(r",? [A-ZÀ-Þ]{2,}")


def _shouted(text: str, a: int, b: int) -> bool:
    """Whether capitals at a..b are part of a passage all in capitals."""
    return text[a:b].isupper() and bool(_SHOUTED[0].search(text[max(0, a - 20) : a]) or _SHOUTED[1].match(text[b : b + 20]))


def _before(text: str, at: int, most: int) -> str:
    """Up to ``most`` characters of the line before a place."""
    return text[max(text.rfind("\n", 0, at) + 1, at - most) : at]


#: The order in which overlapping findings are settled.
RANK = {"email": 0, "national_id": 1, "street_address": 2, "phone": 3, "person_name": 4}


def candidates(text: str) -> list[tuple[str, str, str, bool, int, int]]:
    """(kind, matched, node, seed, start, end) of each candidate; those of known forms are settled by kind and length, free ones stand beside them."""
    found, free = [], []
    digits_there = sum(map(text.count, "0123456789")) if text else 0
    if "@" in text or " at " in text or _DISGUISED.search(text):
        for m in EMAIL.finditer(text):
            found.append(("email", m.group(), "@" if "@" in m.group() else "at", True, m.start(), m.end()))
    if digits_there:
        for m in ID.finditer(text):
            found.append(("national_id", m.group(), shape(m.group()), bool(ID_LABEL.search(_before(text, m.start(), 40))), m.start(), m.end()))
        for m in PHONE.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 9 <= digits <= 18:
                s = re.sub(r"(ext\.?|x) ?#+", "ext", shape(m.group()))
                label = bool(_PHONE_LABEL.search(_before(text, m.start(), 40)))
                found.append(("phone", m.group(), s, label or m.group().startswith("+"), m.start(), m.end()))
        for m in ADDRESS.finditer(text):
            kind = next(v for v in m.groups() if v)
            # Types that stand before the name, or are joined to it, occur in addresses only, and so do units.
            seed = not m["after"] or m.group()[0].isalpha() or text[max(0, m.start() - 1) : m.start()] == text[m.end() : m.end() + 1] == ";"
            found.append(("street_address", m.group(), kind.lower(), seed, m.start(), m.end()))
        for m in FREE_NUMBER.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if 5 <= digits <= 20:
                s, before = "free " + shape(m.group()), _before(text, m.start(), 40)
                free.append(("national_id", m.group(), s, bool(ID_LABEL.search(before)), m.start(), m.end()))
                if 7 <= digits <= 18 and not any(c.isalpha() for c in m.group()):
                    free.append(("phone", m.group(), s, False, m.start(), m.end()))
        for m in FREE_ADDRESS.finditer(text):
            free.append(("street_address", m.group(), "free " + m.group().rsplit(" ", 1)[-1].lower(), False, m.start(), m.end()))
    mails = [f[1].lower() for f in found if f[0] == "email"]
    for m in NAME.finditer(text):
        name = m.group()
        if _shouted(text, m.start(), m.end()):
            continue
        parts = [p for p in re.split(r"[ ,.]+", name) if p]
        given = parts[-1] if "," in name else parts[0]
        own = False
        if mails:
            low = [p.lower() for p in re.split(r"[ ,.\-]+", name) if len(p) > 2]
            own = any(len([p for p in low if p in mail.split("@")[0]]) >= 2 for mail in mails)
        seed = own or bool(_TITLE.search(text[max(0, m.start() - 10) : m.start()]))
        found.append(("person_name", name, given.lower() if len(given) > 1 else "#.", seed, m.start(), m.end()))
    rank = {k: i for i, k in enumerate(KINDS)}
    out: list[tuple[str, str, str, bool, int, int]] = []
    for f in sorted(found, key=lambda f: (rank[f[0]], -(f[5] - f[4]), f[4])):
        if f[0] in ("email", "street_address", "national_id") or all(f[5] <= o[4] or f[4] >= o[5] for o in out):
            out.append(f)
    # A known form stands before a free one; a phone number only before what isn't longer, as its form is the loosest.
    known = [o for o in out if o[0] != "person_name"]
    apart = lambda f, o: f[5] <= o[4] or f[4] >= o[5] or (o[0] == "phone" and f[5] - f[4] > o[5] - o[4])
    return out + [f for f in free if all(apart(f, o) for o in known)]


_COLUMNS = "kind string, matched string, node string, seed boolean, `left` string, `right` string, start int, stop int"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, matched, node, seed, a, b in candidates(text):
                rows.append((key, kind, matched, node, seed, *_around(text, a, b), a, b))
        columns = list(zip(*rows)) if rows else [()] * 9
        kinds = [batch.schema.field(0).type, *[pa.string()] * 3, pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "kind", "matched", "node", "seed", "left", "right", "start", "stop"])


def proposals(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, matched, node, seed, left, right, start, stop): every candidate with its surroundings."""
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    return spread(texts, "doc_id").mapInArrow(_propose, f"doc_id {kind}, {_COLUMNS}")


def patterns():
    """The lexical patterns of a candidate: two tokens on both sides, one on both, and the left or the right alone where they hold a word."""
    both = F.concat(F.lit("b|"), "left", F.lit("|"), "right")
    near = F.concat(F.lit("n|"), F.substring_index("left", " ", -1), F.lit("|"), F.substring_index("right", " ", 1))
    left = F.when(F.col("left").rlike(r"(?!Xx)\p{L}{2,}"), F.concat(F.lit("l|"), "left"))
    right = F.when(F.col("right").rlike(r"(?!Xx)\p{L}{2,}"), F.concat(F.lit("r|"), "right"))
    return F.array_compact(F.array(both, near, left, right))


#: The share of a node's occurrences that must be seeds for the node to be trusted from the start.
SEED_SHARE = {"person_name": 0.05}
OTHER_SEED_SHARE = 0.3


#: Pieces that the rows of a hot pattern or node are spread over.
SALTS = 8


def _salted(left: DataFrame, right: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """A join on ``keys`` whose left rows may be many for one key; ``by`` spreads them, the right row is repeated."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS))
    many = right.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.withColumn("salt_", salt).join(many, [*keys, "salt_"], how).drop("salt_")


def score_graph(found: DataFrame, least_support: int = 3, worthy: float = 0.5, promoted: float = 0.3, most_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(patterns, nodes) with their scores, once no more nodes gain trust.

    A pattern is worth the share of its occurrences whose node is trusted (or that are
    seeds); a node's score is the share of its pattern occurrences in worthy patterns, and from
    ``promoted`` on it's trusted in the next round. Trust is never lost, so the rounds end. Free
    candidates gain scores, but neither make a pattern worthy nor count against it.
    """
    free = F.col("node").startswith("free ")
    edges = found.select("kind", F.explode(patterns()).alias("pattern"), "node", "seed").groupBy("kind", "pattern", "node").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds"))
    edges = materialize(edges.where(~free), "edges")
    share = F.lit(OTHER_SEED_SHARE)
    for kind, value in SEED_SHARE.items():
        share = F.when(F.col("kind") == kind, F.lit(value)).otherwise(share)
    nodes = edges.groupBy("kind", "node").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds")).withColumn("base", F.col("seeds") / F.col("n"))
    nodes = materialize(nodes.select("kind", "node", (F.col("base") >= share).alias("start"), F.col("base").alias("score")).withColumn("trusted", F.col("start")), "nodes")

    def pattern_worth(nodes):
        hit = F.when(F.col("trusted"), F.col("n")).otherwise(F.col("seeds"))
        return _salted(edges, nodes.select("kind", "node", "trusted"), ["kind", "node"], "pattern").groupBy("kind", "pattern").agg(F.sum("n").alias("support"), (F.sum(hit) / (F.sum("n") + 1)).alias("worth"))

    trusted = nodes.where("trusted").count()
    for _ in range(most_rounds):
        good = pattern_worth(nodes).where((F.col("support") >= least_support) & (F.col("worth") >= worthy)).select("kind", "pattern", F.lit(1.0).alias("good"))
        by_node = _salted(edges, good, ["kind", "pattern"], "node", "left").groupBy("kind", "node").agg((F.sum(F.coalesce("good", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("share"))
        nodes = nodes.join(by_node, ["kind", "node"]).select("kind", "node", "start", F.greatest("score", "share").alias("score"), (F.col("trusted") | (F.col("share") >= promoted)).alias("trusted"))
        nodes = materialize(nodes, "nodes")
        now = nodes.where("trusted").count()
        if now == trusted:
            break
        trusted = now
    else:
        raise RuntimeError("trust did not settle")
    return pattern_worth(nodes), nodes.select("kind", "node", "score")


def personal_data(documents: DataFrame, least_worth: float = 0.5, least_node: float = 0.3, sure_worth: float = 0.75, sure_node: float = 0.9, certain_worth: float = 0.9, certain_support: int = 20) -> DataFrame:
    """(doc_id, kind, matched, worth, score): the findings, each text once a document.

    A candidate of a known form comes out if its node is sure, its pattern is sure, or both are
    likely; as a seed it needs either to be likely. A free one needs a certain pattern of enough support.
    """
    found = materialize(proposals(documents), "proposals")
    worth, nodes = score_graph(found)
    keyed = found.withColumn("pattern", F.explode(patterns()))
    # For free candidates a pattern is worth less the more of what it surrounds has no known form.
    seen = keyed.groupBy("kind", "pattern").agg(F.count("*").alias("seen"))
    worth = worth.where(F.col("support") >= 3).join(seen, ["kind", "pattern"]).withColumn("certain", F.col("worth") * (F.col("support") + 1) / (F.col("seen") + 1))
    best = _salted(keyed, worth.select("kind", "pattern", "worth", "support", "certain"), ["kind", "pattern"], "doc_id")
    sure = F.max(F.when(F.col("support") >= certain_support, F.col("certain")))
    best = best.groupBy("doc_id", "kind", "matched", "node", "start").agg(F.max("worth").alias("worth"), sure.alias("supported"))
    place = ["doc_id", "kind", "matched", "node", "start"]
    all_ = _salted(found.select(*place, "stop", "seed").distinct().join(best, place, "left"), nodes, ["kind", "node"], "doc_id", "left")
    worth_, score = F.coalesce("worth", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
    free = F.col("node").startswith("free ")
    known = (score >= sure_node) | (worth_ >= sure_worth) | ((worth_ >= least_worth) & (score >= least_node)) | (F.col("seed") & ((worth_ >= least_worth) | (score >= least_node)))
    unseen = (F.coalesce("supported", F.lit(0.0)) >= certain_worth) | F.col("seed")
    accepted = materialize(all_.where(F.when(free, unseen).otherwise(known)).select(*place, "stop", worth_.alias("worth"), score.alias("score"), free.alias("free")), "accepted")
    rank = F.lit(9)
    for kind, r in RANK.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    # Known forms were settled where they were found; what's left are free findings over others, within one document.
    # A name inside a free address or number is a part of it; any other known form stands, and so does the better of two free ones.
    name = F.col("kind") == "person_name"
    order = F.struct(F.col("free"), rank.alias("rank"), (F.col("start") - F.col("stop")).alias("size"), F.col("start"))
    placed = accepted.withColumn("order", order).withColumn("name", name & ~F.col("free"))
    other = placed.select(F.col("doc_id").alias("d"), F.col("start").alias("s"), F.col("stop").alias("e"), F.col("order").alias("o"), F.col("free").alias("f"), F.col("name").alias("n"))
    over = (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("stop"))
    beaten = (F.col("free") & ~F.col("n") & (F.col("o") < F.col("order"))) | (F.col("name") & F.col("f"))
    left = placed.join(other, over & beaten, "left_anti")
    return left.groupBy("doc_id", "kind", "matched").agg(F.max("worth").alias("worth"), F.max("score").alias("score"))


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}


def _replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if text and found:
                kinds = {f["matched"]: f["kind"] for f in found}
                # The longest first, so that no finding eats a part of another; never inside a word.
                any_ = "|".join(re.escape(m) for m in sorted(kinds, key=lambda m: (-len(m), m)))
                text = re.sub(rf"(?<!\w)(?:{any_})(?!\w)", lambda m: PLACEHOLDERS[kinds[m.group()]], text)
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def redacted(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, text): every document, each finding replaced by the placeholder of its kind."""
    per = findings.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "matched")).alias("found"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").join(per, "doc_id", "left").mapInArrow(_replace, f"doc_id {kind}, text string")
