"""Personal information in free text by bootstrapped contextual extraction (problem 4).

1. Every text is read once for *candidates*: pieces shaped like an e-mail
   address, phone number, identity number, street address or name, with the
   words around them. Shapes are wide; most candidates are nothing.
2. Seeds are candidates that need no context: listed given and family names
   together, numbers with a country code, numbers beside the words that name
   them, e-mail addresses in plain or all in words, street addresses with a flat or before a postal
   code. All others are unknown at first.
3. Spark builds the bipartite graph of lexical patterns (the words before, after
   and around a candidate) and instances (a name and its parts, the digits and
   the shape of a number, the host of an e-mail address, the street of an
   address) and scores both in turns: a pattern by the confidence of its
   candidates, an instance by its patterns. Confident patterns thereby
   extract instances that no list has; parts, numbers, shapes, hosts and streets
   learnt this way extract more, and a name that is often met where no names
   are is none.
4. Candidates of sufficient confidence are results; of overlapping ones the
   better stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstone.session import Scratch

#: Confidence from which a candidate is a result, and rounds of scoring.
ACCEPT = 0.3
ROUNDS = 2
#: Kinds whose instances are numbers.
NUMBERS = ("phone", "id_number")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

# --- shapes -----------------------------------------------------------------

_LOCAL = r"[A-Za-z0-9][\w.+'-]*"
EMAIL = re.compile(rf"(?<![\w.+/-]){_LOCAL}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}(?![\w@])(?!:[\w/~])")
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|At)\s?[\])}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
HIDDEN = re.compile(rf"(?<![\w.+/-]){_LOCAL}(?:{_AT}|@)[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])")
PHONE = re.compile(r"(?<![\w+#$.,:/=-])(?:\+\s?)?\(?[0-9](?:[ .\-/()]{0,2}[0-9]){8,14}(?![\w/%])(?![.:,-][0-9])|(?<=[=:\"])(?:\+\s?)?\(?[0-9](?:[ .\-/()]{0,2}[0-9]){8,14}(?![\w/%])(?![.:,-][0-9])")
ID = re.compile(
    r"(?<![\w.+/-])(?:[A-Z]{1,2}[0-9]{6,9}[A-Z]?|[A-Z]{2}(?: ?[0-9][0-9]){3} ?[A-Z]|[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}|[0-9]{2,3}[ /.-][0-9]{3}[ /.-][0-9]{3,5}|[0-9]{2}\.[0-9]{2}\.[0-9]{2}-[0-9]{3}\.[0-9]{2}|[0-9]{8,11}[A-Z]?|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}|[0-9]{6}[ -]?[0-9]{4,5})(?![\w/])(?![-.][0-9])"
)
# Words that name an identity number, and words of street names.
ID_WORDS = re.compile(
    r"(?i)\b(?:passport|reisepass|passeport|pasaporte|ssn|social security|national insurance|ni number|nino|tax (?:id|number|no|file)|national id|steuer-?id|steuernummer|personalausweis|ausweis|identity card|id card|id-card|dni|nif|cpf|carte d[’']identit|num[ée]ro fiscal|applicant_id|sozialversicherung\w*|insurance no)\b"
)
_WORD = r"[A-ZÄÖÜÁÉÍÓÚÑ][\w’'-]+"
_TYPE = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Close|Crescent|Terrace|Place|Pl|Square|Sq|Parkway|Hill|Row|Walk|Mews|Gardens|Grove)"
_UNIT = r"(?:Flat|Unit|Floor|Apt|Apartment|Suite|Ste|Room|Appt|Wohnung|Whg|Piso)"
_NUMBER = r"\d{1,4}(?:-\d{1,3})?(?:\s?[A-Za-z](?![\w-]))?"
_BEFORE = rf"(?:{_UNIT}\.? \d{{1,4}}[A-Za-z]?,? )?"
_AFTER = rf"(?:,? (?:{_UNIT}\.? ?\d{{1,4}}[A-Za-z]?|\#\d{{1,4}}[A-Za-z]?)(?!\w))?"
ADDRESS = re.compile(
    rf"(?<![\w.-]){_BEFORE}{_NUMBER},? (?:{_WORD} ){{1,3}}{_TYPE}\b\.?{_AFTER}"
    rf"|(?<![\w-])(?:(?:Am|An|Im|Zum|Zur|Alte[rn]?|Neue[rn]?|Obere|Untere|Hintere|Vordere|Lange|Kurze|Hohe|Große|Kleine)[ -]){{0,2}}(?:{_WORD[:-1]}*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|STRASSE|WEG|GASSE|ALLEE|PLATZ)) \d{{1,4}}(?:-\d{{1,3}})?(?:\s?[a-zA-Z](?!\w))?{_AFTER}"
    rf"|(?<![\w.-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|route|cours|square) (?:(?:de la|de l[’']|des|du|de|d[’']|la|le|les|l[’'])\s?)?{_WORD}(?:[ -]{_WORD})*"
    rf"|(?<!\w)(?:Calle|Plaza|Avenida|Av\.|Paseo|Camino|Ronda|Rua|Travessa|Praça|Via|Piazza|Viale|Corso)(?: (?:del|de la|de los|de las|de|da|do|dos|das|della|dei))?(?: {_WORD}){{1,3}},? (?:n\.?\s?º ?|nº ?|núm\. ?|No\.? )?\d{{1,4}}(?:\s?[a-zA-Z](?!\w))?(?:, ?\d{{1,2}}\.?º(?: ?[A-Z](?!\w))?)?{_AFTER}"
)
#: Dates, addresses of machines and spans of time, by shape.
_MACHINE = re.compile(r"9{4}-99-99|9{1,3}(?:\.9{1,3}){3}$|9{2}\.9{2}-9{2}\.9{2}")
_GIVEN = r"[A-ZÀ-Ý][a-zß-ÿ’']+(?:-[A-ZÀ-Ý][a-zß-ÿ’']+)*"
_CAPS = r"[A-ZÀ-Ý]{3,}(?:-[A-ZÀ-Ý]{3,})*"
NAME = re.compile(
    rf"(?<![\w/@.-])(?=({_GIVEN}(?: [A-Z]\.)* {_GIVEN}|{_CAPS}(?: [A-Z]\.)* {_CAPS}|(?:{_GIVEN}, {_GIVEN}|{_CAPS}, {_CAPS})(?: [A-Z]\.)*)(?![\w@/-]))"
)
#: Where a name, a long number or a lettered number may begin; the exact shapes are tried only there.
_NAME_AT = re.compile(r"(?<![\w/@.-])[A-ZÀ-Ý](?=[\w’'-]+,?(?: [A-Z]\.)* [A-ZÀ-Ý])")
_DIGITS = re.compile(r"[0-9](?:[ .\-/()]{0,2}[0-9]){7,}")
_LETTERED = re.compile(r"(?<![\w.+/-])[A-Z]{1,2} ?[0-9][0-9]")
_HINTS = ["[at", "(at", "{at", "<at", "[ at", "( at", " dot ", "[dot", "(dot", "{dot"]
_STREETS = (
    " Street| St| Road| Rd| Avenue| Ave| Lane| Ln| Drive| Dr| Court| Ct| Way| Boulevard| Blvd| Close| Crescent| Terrace| Place| Pl| Square| Sq| Parkway| Hill| Row| Walk| Mews| Gardens| Grove|"
    "straße |strasse |str. |weg |gasse |allee |platz |ring |damm |ufer |STRASSE |WEG |GASSE |ALLEE |PLATZ |"
    " rue | avenue | boulevard | place | allée | chemin | impasse | quai | route | cours | square |"
    "Calle |Plaza |Avenida |Av. |Paseo |Camino |Ronda |Rua |Travessa |Praça |Via |Piazza |Viale |Corso "
)


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in _STREETS.split("|"):
        a.add_word(w, "street")
    for w in _HINTS:
        a.add_word(w, "hidden")
        a.add_word(w.upper(), "hidden")
    a.add_word("@", "at")
    a.make_automaton()
    return a


def _windows(places: list[int] | list[tuple[int, int]], before: int, after: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches around places, or runs from one place to another, in ascending order, joined where they overlap."""
    lo = hi = -1
    for p in places:
        a, b = p if isinstance(p, tuple) else (p, p)
        if lo >= 0 and a - before <= hi:
            hi = max(hi, b + after)
            continue
        if lo >= 0:
            yield lo, min(hi, end)
        lo, hi = max(0, a - before), b + after
    if lo >= 0:
        yield lo, min(hi, end)


_TOKEN = re.compile(r"[^\W\d_]+(?:[._/'’-]?[\w]+)*|\d[\w.:-]*|\n+|[^\w\s]")


def _normal(token: str) -> str:
    if token[0].isdigit():
        return "#"
    if token[0] == "\n":
        return "\n"
    if any(c in "_/.0123456789" for c in token) or (token[0].islower() and not token.islower()):
        return "code"
    return token.lower()


def _words(text: str) -> list[str]:
    """Tokens, numbers and identifiers made alike, likewise capitalised words in a row (probably names themselves)."""
    raw = _TOKEN.findall(text)
    cap = [t[0].isupper() and t.isalpha() and len(t) > 1 for t in raw] + [False]
    return ["cap" if cap[i] and (cap[i + 1] or (i > 0 and cap[i - 1])) else _normal(t) for i, t in enumerate(raw)]


def _around(text: str, a: int, b: int) -> list[tuple[int, str]]:
    """The lexical patterns of a piece: words before it (up to its sentence's start), after it, and on both sides."""
    before = _words(text[max(0, a - 60) : a])
    before = before[1:] if a > 60 else ["^", *before]
    ends = [i for i, t in enumerate(before[:-1]) if t in (".", "!", "?", "\n", "^")]
    cut = before[ends[-1] :] if ends else before
    cut = ["^" if t in (".", "!", "?", "\n") and i == 0 else t for i, t in enumerate(cut)][-5:]
    after = (_words(text[b : b + 56]) + ["$"])[:4]
    left = [" ".join(x) for x in (cut, before[-3:], before[-2:])]
    right = [" ".join(after[:k]) for k in (2, 3, 4)]
    both = [" ".join(before[-k:]) + " _ " + " ".join(after[: 4 - k]) for k in (2, 1)]
    out = [(side, p) for side, ps in enumerate((left, right, both)) for p in dict.fromkeys(ps)]
    # A pattern without any word says nothing.
    return [(side, p) for side, p in out if re.search(r"[^\W\d_]{2}", p.replace("cap", "").replace("code", ""))]


def _digits(s: str) -> str:
    return re.sub(r"\d", "9", s)


def candidates(text: str) -> Iterator[tuple[str, int, int, str, str, float]]:
    """(kind, start, end, piece, instance, seed confidence); seed -1 stands for unknown."""
    places: dict[str, list[int]] = {"street": [], "hidden": [], "at": []}
    for end, what in _anchors().iter(text):
        places[what].append(end)
    taken = set()
    # Of an e-mail address 64 characters may stand before the sign and 255 after it.
    for lo, hi in _windows(places["at"], 70, 260, len(text)):
        for m in EMAIL.finditer(text, lo, hi):
            taken.add(m.start())
            yield "email", m.start(), m.end(), m.group(), _host(m.group()), 1.0
    for lo, hi in _windows(places["hidden"], 150, 280, len(text)):
        for m in HIDDEN.finditer(text, lo, hi):
            s = m.group()
            bare = re.search(r"\s(?:at|AT)\s", s) and not re.search(r"(?i)[\s\[({]dot[\s\])}]", s)
            if m.start() not in taken and "@" not in s and not bare:
                spelled = re.search(r"(?i)[\s\[({<]dot[\s\])}>]", s)  # with its dots spelled out it can be nothing else
                yield "email", m.start(), m.end(), s, _host(s), 0.9 if spelled else -1.0
    # A run of digits holds all of its numbers; what follows it is seen as well, so that no number is cut.
    numbers = [m.span() for m in _DIGITS.finditer(text)]
    for lo, hi in _windows(numbers, 4, 4, len(text)):
        for m in PHONE.finditer(text, lo, hi):
            s, a = m.group().rstrip(), m.start()
            if s.startswith("(") and ")" not in s:
                s, a = s[1:], a + 1
            s = s.rstrip("( -./")
            if s.count("(") < s.count(")"):
                s = s[: s.index(")")].rstrip()
            if not 9 <= sum(c.isdigit() for c in s) <= 15:
                continue
            shape = _digits(s)
            if _MACHINE.match(shape):
                continue
            near = text[max(0, a - 40) : a] + " | " + text[a + len(s) : a + len(s) + 30]
            yield "phone", a, a + len(s), s, "phone:" + shape, 1.0 if s.startswith("+") else (0.0 if ID_WORDS.search(near) else -1.0)
    lettered = [(m.start(), m.start() + 22) for m in _LETTERED.finditer(text)]
    for lo, hi in _windows(sorted(numbers + lettered), 2, 4, len(text)):
        for m in ID.finditer(text, lo, hi):
            lead = text[max(0, m.start() - 40) : m.start()]
            near = list(ID_WORDS.finditer(lead))
            behind = re.match(r"[\s\"')]*\(([^()]{3,40})\)", text[m.end() : m.end() + 50])
            named = bool(near) and not re.search(r"[!?\n]|\.\s(?!\d)", re.sub(r"(?i)\b(no|nr|num)\.", "", lead[near[-1].end() :]))
            named = named or bool(behind and ID_WORDS.search(behind.group(1)))
            yield "id_number", m.start(), m.end(), m.group(), "id:" + re.sub(r"[A-Z]", "A", _digits(m.group())), 1.0 if named else -1.0
    for lo, hi in _windows(places["street"], 150, 120, len(text)):
        for m in ADDRESS.finditer(text, lo, hi):
            s = m.group()
            if s.endswith("."):  # an abbreviation's full stop stays, a sentence's does not
                short = re.search(r"(?i)(?:\b(?:st|rd|ave|ln|dr|ct|pl|sq|blvd|apt)|str)\.$", s)
                if not short or re.match(r"\s*(?:$|\n)|\s+[A-Z]", text[m.end() :]):
                    s = s[:-1]
            sure = re.search(_UNIT, s) or re.match(r",? \d{4,5} [A-ZÄÖÜ]", text[m.start() + len(s) : m.start() + len(s) + 12])
            yield "address", m.start(), m.start() + len(s), s, _street(s), 0.9 if sure else -1.0
    for at in _NAME_AT.finditer(text):
        m = NAME.match(text, at.start())
        if m:
            yield "name", m.start(1), m.end(1), m.group(1), m.group(1), -1.0


def _host(address: str) -> str:
    """Host of an e-mail address, as it is without hiding."""
    plain = re.sub(r"\s?[\[({<]?\s?\b(?i:dot)\b\s?[\])}>]?\s?", ".", re.sub(r"\s?[\[({<]\s?(?i:at)\s?[\])}>]\s?|\s(?i:at)\s", "@", address))
    return "@" + plain.rpartition("@")[2].lower()


def _street(address: str) -> str:
    """The words of an address that are neither numbers nor flats."""
    return " ".join(w.lower() for w in re.findall(r"[^\W\d_]{2,}", re.sub(rf"(?:{_UNIT})\.? ?\w+", "", address)))


def _parts(name: str) -> list[str]:
    """Name parts in the case of the list: hyphenated parts apart, initials left out."""
    out = []
    for w in re.split(r"[ ,-]+", name):
        if len(w.rstrip(".")) > 1:
            out.append(w[0].upper() + w[1:].lower())
    return out


def find_candidates(texts: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """One row per candidate: (id, kind, a, b, found, seed, patterns, parts, instance, shape).

    ``instance`` is a hash of the name, the letters and digits of a number, the host or the street; ``shape`` that of the shape of
    a number, null for other kinds.
    Patterns are hashes of the words around; their last two bits tell the side: 0 before, 1 after, 2 both.
    """
    kind = texts.schema[id_col].dataType.simpleString()
    names = [id_col, "kind", "a", "b", "found", "seed", "patterns", "parts", "instance", "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                for k, a, b, found, instance, seed in candidates(text):
                    patterns = [_hash(f"{k}{side}{words}") & ~3 | side for side, words in _around(text, a, b)]
                    number = k in NUMBERS
                    nodes = (_hash(k + re.sub(r"[\W_]", "", found)), _hash(instance)) if number else (_hash(k + instance.lower()), None)
                    rows.append((key, k, a, b, found, seed, patterns, _parts(found) if k == "name" else [], *nodes))
            if rows:
                types = [batch.schema.field(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = f"`{id_col}` {kind}, kind string, a int, b int, found string, seed double, patterns array<bigint>, parts array<string>, instance bigint, shape bigint"
    return texts.select(id_col, text_col).mapInArrow(run, schema)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def score(found: DataFrame, names: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """Candidates with ``m``, their confidence after some rounds over the graph of patterns and instances.

    ``found`` are candidates with a unique ``cid``, ``names`` has the columns
    name_part and part_kind. A pattern's confidence is the mean of its
    candidates' (one is added to the count, so that rare patterns stay modest);
    a candidate takes the best of its patterns, and a name also what its parts
    are worth: the share of a part's candidates that are names. A given and a
    family part that are both listed or learnt make a name in any context.
    Then instances pass on what their candidates are worth: a number, host or
    street that is known in one place is known in all; a shape gives the share
    of its candidates that are known, except in a context that is met elsewhere
    and never tells of a detail, and a number of a shape that is hardly ever
    known of this kind counts half; a name met several times is worth what it is
    worth on the average. The rounds are few on purpose: a mean feeds back
    on itself, so that without an end one seed would make a detail of
    everything that shares a pattern with it.
    Aggregations combine before the shuffle, so a pattern that a third of the
    candidates share is one row per task.
    """
    listed = names.where("name_part is not null").groupBy(F.col("name_part").alias("part")).agg(F.max(F.col("part_kind") == "given").alias("given"), F.max(F.col("part_kind") == "family").alias("family"))
    parts = found.where("kind = 'name'").select("cid", F.explode("parts").alias("part")).distinct()
    known = parts.join(listed, "part").groupBy("cid").agg(F.count("*").alias("k"), F.max("given").alias("g"), F.max("family").alias("f"))
    pair = (F.col("k") >= 2) & (F.col("k") >= F.size(F.array_distinct("parts"))) & F.col("g") & F.col("f")
    start = found.join(known, "cid", "left").withColumn("seed", F.when(F.coalesce(pair, F.lit(False)), 0.95).otherwise(F.col("seed"))).withColumn("m", F.greatest("seed", F.lit(0.0)))
    live = scratch.save(start.select("cid", "kind", "seed", "m", "instance", "shape"), "confidence-0")
    edges = found.select("cid", F.explode("patterns").alias("p"))
    # A pattern met once cannot tell anything of another candidate.
    common = edges.groupBy("p").count().where("count > 1").select("p")
    edges = scratch.save(edges.join(common, "p"), "edges")
    for k in range(1, rounds + 1):
        pattern = edges.join(live.select("cid", "m"), "cid").groupBy("p").agg((F.sum("m") / (F.count("*") + 1)).alias("c"))
        # Of weak patterns only those on both sides of a number are asked for, as doubts.
        weak = (F.col("c") <= 0.05) & (F.col("p").bitwiseAND(3) == 2)
        asked = edges.join(live.where("seed < 0").select("cid", "kind"), "cid").join(pattern, "p").where((F.col("c") > 0.05) | (weak & F.col("kind").isin(*NUMBERS)))
        best = [F.coalesce(F.max(F.when(F.col("p").bitwiseAND(3) == side, F.col("c"))), F.lit(0.0)).alias(n) for side, n in enumerate(("l", "r", "b"))]
        context = asked.groupBy("cid").agg(*best, F.max(weak).alias("doubt"))
        worth = parts.join(live.select("cid", "m"), "cid").groupBy("part").agg((F.sum("m") / (F.count("*") + 0.5)).alias("w"))
        own = parts.join(worth.where("w > 0.3"), "part").groupBy("cid").agg(F.count("*").alias("good"), F.min("w").alias("w"), F.max("w").alias("most"))
        number = parts.groupBy("cid").agg(F.count("*").alias("all"))
        known_parts = own.join(number, "cid").select("cid", F.when((F.col("good") == F.col("all")) & (F.col("good") > 1), F.col("w")).alias("w"), F.when(F.col("most") > 0.6, 0.2).alias("half"))
        seen = live.join(context, "cid", "left").join(known_parts, "cid", "left")
        # For numbers one telling side is enough; next to a name much may stand, so both sides count.
        # A context that is not strong enough by itself is, if a part of the name is known.
        sides = F.coalesce(F.greatest(F.col("b"), (F.col("l") + F.col("r")) / 2), F.lit(0.0))
        m = (
            F.when(F.col("seed") >= 0, F.col("seed"))
            .when(F.col("kind") == "name", F.greatest(sides + F.when(sides > 0.12, F.coalesce("half", F.lit(0.0))).otherwise(0.0), F.col("w")))
            .otherwise(F.greatest("l", "r", "b", F.lit(0.0)))
        )
        told = scratch.save(seen.select("cid", "kind", "seed", m.alias("m"), "instance", "shape", F.coalesce("doubt", F.lit(False)).alias("doubt")), f"context-{k}")
        live = scratch.save(_instances(told), f"confidence-{k}")
    return found.drop("seed").join(live.select("cid", "seed", "m"), "cid")


def _instances(told: DataFrame) -> DataFrame:
    """Candidates with what their instance and shape are worth.

    Only what is known is joined back: few shapes, instances that are details,
    and names that are not.
    """
    columns = ["cid", "kind", "seed", "m", "instance", "shape"]
    of_number = F.col("kind").isin(*NUMBERS)
    pooled = told.groupBy("kind", "instance").agg(F.max("m").alias("known"), F.avg("m").alias("mean"), F.count("*").alias("n"))
    known = pooled.where((F.col("kind") != "name") & (F.col("known") >= ACCEPT)).select("instance", "known")
    often = pooled.where((F.col("kind") == "name") & (F.col("n") >= 3) & (F.col("mean") < ACCEPT)).select("instance", "mean")
    shapes = told.where(of_number).groupBy("shape").agg((F.sum("m") / (F.count("*") + 0.5)).alias("share"), F.count("*").alias("n"))
    share = shapes.where("share > 0.3 or share < 0.05 and n >= 20").select("shape", "share")
    unknown = F.col("seed") < 0
    rest = told.where("kind <> 'name'").join(known, "instance", "left").join(share, "shape", "left")
    worth = F.greatest("m", "known", F.when(~F.col("doubt") & (F.col("share") > 0.3), F.col("share"))) * F.when(F.col("share") < 0.05, 0.5).otherwise(1.0)
    rest = rest.withColumn("m", F.when(unknown, worth).otherwise(F.col("seed")))
    names = told.where("kind = 'name'").join(often, "instance", "left").withColumn("m", F.when(unknown, F.least("m", F.coalesce("mean", "m"))).otherwise(F.col("m")))
    return rest.select(*columns).unionByName(names.select(*columns))


def find_personal(
    texts: DataFrame, names: DataFrame, scratch: Scratch, id_col: str = "id", text_col: str = "content", accept: float = ACCEPT
) -> DataFrame:
    """(id, a, b, kind, found): personal details by position (code points), not overlapping.

    Null and empty texts yield nothing. A repeated row (same id) counts once;
    texts that differ under one id are all read, and their details united. An
    empty name list leaves names to context alone.
    """
    raw = find_candidates(texts.select(id_col, text_col), id_col, text_col)
    once = raw.dropDuplicates([id_col, "kind", "a", "b", "found"]).withColumn("cid", F.xxhash64(id_col, "kind", "a", "b", "found"))
    found = scratch.save(once, "candidates")
    scored = score(found, names, scratch).where(F.col("m") >= accept)
    spans = scored.groupBy(id_col).agg(F.collect_list(F.struct("m", "a", "b", "kind", "found")).alias("all"))

    @F.pandas_udf("array<struct<a:int,b:int,kind:string,found:string>>")
    def best(lists: pd.Series) -> pd.Series:
        out = []
        for spans in lists:
            starts, kept = [], []  # in order of their places, not overlapping
            for s in sorted(spans, key=lambda s: (-round(s["m"], 1), s["a"] - s["b"], s["a"], s["kind"])):
                i = bisect_right(starts, s["a"])
                if (i == 0 or kept[i - 1]["b"] <= s["a"]) and (i == len(kept) or kept[i]["a"] >= s["b"]):
                    starts.insert(i, s["a"])
                    kept.insert(i, s)
            out.append([{x: s[x] for x in ("a", "b", "kind", "found")} for s in kept])
        return pd.Series(out)

    return spans.select(id_col, F.explode(best("all")).alias("s")).select(id_col, "s.a", "s.b", "s.kind", "s.found")


def redact(texts: DataFrame, details: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``texts`` with each detail replaced by a placeholder that names its kind; all other columns as they are.

    Texts without details, null and empty ones are unchanged. Placeholders are
    put in where the piece at the given place is the one found, so that rows
    under one id with different texts keep their own.
    """
    lists = details.groupBy(F.col(id_col).alias("_key")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "kind", "found"))).alias("_spans"))

    @F.pandas_udf("string")
    def put(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, ss in zip(texts, spans):
            if t is None or ss is None:
                out.append(t)
                continue
            parts, at = [], 0
            for s in ss:
                if s["a"] >= at and t[s["a"] : s["b"]] == s["found"]:
                    parts += [t[at : s["a"]], PLACEHOLDERS[s["kind"]]]
                    at = s["b"]
            out.append("".join(parts) + t[at:])
        return pd.Series(out)

    joined = texts.join(lists, texts[id_col] == F.col("_key"), "left")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(put(text_col, "_spans"))).drop("_key", "_spans")
