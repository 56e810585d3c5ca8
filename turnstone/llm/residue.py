"""Template residue, filler, error pages and script notices (problem 8).

One Aho-Corasick automaton holds short stems of several languages, each with the
*concepts* it stands for: what a page is about ("page", "session"), what is wrong
with it ("not found", "expired"), scripts, switching them on, texts, their being
due later, logging in, and so on, and the delimiters of placeholders as well. A
text is read once however many stems there are. Stems that follow each other
with at most ``GAP`` other words between them bracket a span; a span counts if
its concepts together make a statement (a subject with its problem, scripts with
their switch, a text with its being due), whatever the wording in between. A
record is found if such spans cover most of its own text without page furniture,
or if a placeholder stands unfilled in its own running text. Code, inline code,
quotes, log and usage lines are not the record's own text, and a sentence that
speaks about a placeholder does not leave one unfilled.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the own text (without furniture and headings) that residue must cover.
COVERAGE = 0.6
#: Words besides stems, function words and codes that may stand between two stems of one span.
GAP = 2
#: Letters of a script without spaces that may stand between two stems of one span.
GAP_LETTERS = 8
#: Characters on both sides of a placeholder, inside its sentence, in which words about placeholders count.
NEAR = 60
#: Share of a sentence that spans must cover for the sentence to be residue as a whole.
SENTENCE = 0.6

# Stems by concept, lower case. An asterisk stands for any ending of the word.

#: Statements that need nothing else.
ERRORS = """
page not found|not found|bad gateway|gateway time-out|gateway timeout|bad request|internal server error|service unavailable|access denied|permission denied|forbidden|unauthorized|unauthorised|too many requests|rate limit exceeded|went wrong|error occurred|error has occurred|try again later|try again in|can't be reached|cannot be reached|could not be reached|took too long to respond|connection timed out|connection refused|connection reset|connect error|session expired|session timed out|under maintenance|down for maintenance|scheduled maintenance|maintenance mode|be back shortly|be back soon|under construction|verify you are human|are you a robot|not a robot|captcha|unusual traffic|page no longer exists|login required|authentication required|method not allowed|request timeout|request timed out|payload too large|temporarily unavailable|not authorized|not authorised|invalid hostname
nicht gefunden|zugriff verweigert|interner serverfehler|wartungsarbeiten|wartungsmodus|versuchen sie es später|sitzung abgelaufen|dienst nicht verfügbar|zeitüberschreitung|anmeldung erforderlich
introuvable|accès refusé|erreur interne|en maintenance|réessayer plus tard|session expirée|service indisponible|temporairement indisponible|connexion requise
no encontrada|no encontrado|acceso denegado|error interno|en mantenimiento|inténtelo de nuevo|inténtalo de nuevo|sesión caducada|no disponible
não encontrada|não encontrado|acesso negado|erro interno|em manutenção|tente novamente|sessão expirada|indisponível
non trovata|accesso negato|in manutenzione|riprova più tardi|niet gevonden|toegang geweigerd|nie została znaleziona|не найдена|доступ запрещён|временно недоступ*
見つかりません|アクセスが拒否|サーバーエラー|メンテナンス中|ログインしてください|有効期限が切れ|ページが存在しません|しばらくしてから|页面不存在|未找到|找不到页面|访问被拒绝|服务器错误|系统维护|正在维护|稍后再试|请登录|请先登录|会话已过期|頁面不存在|找不到頁面|系統維護|찾을 수 없습니다|접근이 거부|점검 중
"""
#: What a page or message is about.
SUBJECT = """
page*|site*|website*|server*|service*|session*|connection*|request*|link*|url|address|file*|document*|resource*|host*|gateway*|upstream|access|account*|content*|transcript*|app|application|system|database|internet|network|ip|proxy|error|status|title
seite*|dienst|sitzung|verbindung|anfrage|zugriff|inhalt*|konto|anwendung|serveur|page demandée|connexion|requête|accès|contenu|compte|página*|sitio|servidor|servicio|sesión|conexión|solicitud|acceso|contenido|cuenta|serviço|sessão|conexão|acesso|conteúdo|conta|pagina|sito|страниц*|сервер*|ページ|サーバー|サイト|セッション|页面|服务器|网站|会话|頁面|페이지|서버
"""
PROBLEM = """
could not be found|couldn't be found|cannot be found|can't be found|can't find|couldn't find|could not find|cannot find|unreachable|can't reach|cannot reach|too long|timed out|time-out|timeout|unavailable|not available|expired|denied|refused|reset|blocked|failed|unexpected|unable|no longer|does not exist|doesn't exist|do not exist|has moved|was moved|been removed|been deleted|deleted|overloaded|too many|rate limit*|slow down|invalid|not allowed|not permitted|permission*|maintenance|offline|disconnect*|problem|suspended|exceeded|crashed|is broken|temporarily|not respond*|not be displayed|cannot be displayed|can't be displayed|not load*|can't load|won't load|missing|disappeared|restricted|is down|are down
gibt es nicht|nicht mehr|nicht verfügbar|nicht erreichbar|verweigert|abgelaufen|fehlgeschlagen|gesperrt|fehler|n'existe plus|n'existe pas|indisponible|expiré*|refusé*|échoué|bloqué*|erreur|no existe|ya no existe|no disponible|caducado|caducada|expirado|expirada|denegado|falló|bloquead*|no se encuentra|no se encontró|não existe|expirou|negado|falhou|não foi encontrad*|non esiste|scadut*|не существует|недоступ*|истекл*|存在しません|エラー|切れました|できません|不存在|错误|无法访问|拒绝|过期|없습니다
"""
LOGIN = """
log in|login|log on|sign in|signed in|logged in|signing in|logging in|authenticate|authentication|password|credentials
anmelden|einloggen|melden sie sich|connectez-vous|vous connecter|se connecter|identifiez-vous|inicie sesión|inicia sesión|iniciar sesión|faça login|entrar|accedi|ログイン|登录|登入|로그인
"""
NEED = """
required|require*|must|need to|needed|please|to continue|to proceed|to view|to access|to see|to read|in order to|first|use your|have to
bitte|erforderlich|müssen|um fortzufahren|veuillez|pour continuer|pour afficher|nécessaire|requis*|devez|para continuar|para ver|por favor|debe|necesit*|requier*|precisa|per continuare|してください|必要|请|請
"""
SCRIPT = """
javascript|java script|scripts|scripting|script|noscript|cookies
javascripts|skripte|skripts|スクリプト|脚本|자바스크립트
"""
SWITCH = """
enable*|disabled|require*|required|turn* on|turned off|turn it on|turn them on|switch* on|switched off|switch them on|switch it on|are off|is off|activate*|allow*|support*|not run|needs|need*|must|not work|blocked|off
aktivieren|aktiviert|deaktiviert|einschalten|benötigt|erforderlich|erlauben|activer|activez|activé|désactivé|nécessaire|autoriser|active|activa|activar|habilite|habilitar|habilita|desactivado|desativado|ative|ativar|attiva|abilita|schakel|inschakelen|włącz|включите|отключ*|有効|無効|启用|禁用|啟用|활성화|开启
"""
TEXT = """
text*|content*|section*|page|description*|details|paragraph*|body|copy|chapter|documentation|summary|article|information
inhalt*|abschnitt*|beschreibung*|angaben|texte|contenu*|contenido*|texto*|sección|descripción|conteúdo*|seção|descrição|contenuto|testo|テキスト|内容|本文|文章|说明
"""
DUE = """
later|soon|pending|to follow|to come|coming|goes here|go here|will be added|be added|to be added|to be written|be replaced|to be replaced|to be completed|to be determined|to be provided|will follow|placeholder|sample|dummy|insert|your|here|todo|tbd|tba|fixme|intentionally left blank|left blank|is empty|nothing here|work in progress|not yet|yet to
folgt|folgen|in kürze|demnächst|platzhalter*|à venir|à compléter|bientôt|en cours de rédaction|próximamente|pendiente|por completar|pronto|em breve|pendente|a preencher|prossimamente|準備中|近日|後日|ここに|待补充|敬请期待|即将|稍后|此处|补充
"""
FILLERS = """
lorem ipsum|coming soon|content pending|text pending|more to come|to be written|placeholder text|sample text|dummy text|goes here|to be replaced later|intentionally left blank|insert text here|work in progress|details to follow|todo: write|todo: add|todo: fill|write this section|platzhaltertext|text folgt|inhalt folgt|demnächst verfügbar|contenu à venir|texte à venir|bientôt disponible|próximamente|em breve|近日公開|準備中|敬请期待|即将推出|待补充
"""
#: Words that go with residue but tell nothing alone.
SOFT = """
sorry|oops|whoops|uh-oh|unfortunately|apologies|apologise|apologize|thank you|thanks|patience|please|again|later|minute*|moment*|shortly|second*|few|try|retry|reload*|refresh*|browser*|settings|device|continue*|proceed*|back|return|home|homepage|start page|contact*|support|administrator*|webmaster|reference*|id|code|details|status|number|message|ray|incident|error*|problem*|issue*|side|end|view*|display*|show*|open*|load*|read|use|using|permission*|account*|asked|requested|looking for|exist*|something|happened|encountered|met|condition|unexpected|reason|headers|before|checking|secure|required|allowed|able|some|parts|properly|correctly|work|works|app|function*|viewer|list|detected|currently|right now|working on|fixed|soon|need|full|information|privileges|valid|typed|correct*|removed|renamed|moved|traffic|human|automat*|wait
entschuldig*|leider|bitte|erneut|später|neu|laden|startseite|zurück|anzuzeigen|angeforderte|désolé*|malheureusement|accueil|retour|demandée|afficher|plus tard|réessay*|lo sentimos|vuelve|volver|inicio|continuar|intent*|desculpe|voltar|início|tentar|novamente|scusa|ritorna|申し訳|お探し|しばらく|もう一度|再度|抱歉|返回|首页|重试|죄송
"""
FURNITURE = """
skip to content|skip to main content|back to overview|back to top|back to home|log in|login|log out|sign in|sign up|register|search|home|help|sessions|menu|navigation|terms|privacy|status|contact|about|imprint|cookie settings|all rights reserved|powered by|next|previous|subscribe|share|print|settings|docs|blog|news|faq
zum inhalt springen|zur startseite|startseite|impressum|datenschutz|suche|hilfe|aller au contenu|retour à l'accueil|accueil|recherche|aide|mentions légales|saltar al contenido|inicio|buscar|ayuda|contacto|privacidad|pular para o conteúdo|ajuda
"""
#: Words without content of their own; they count on neither side.
FUNCTION = """
a an the this that these those it its is are was were be been being has have had do does did not no and or but so if then than to of in on at by for from with as we we've we're you you're your our their his her them they i us there here when which who what will would can could may might should must any all some just also now
der die das den dem des ein eine einen einem einer ist sind war wurde wird und oder nicht kein keine sie es ihr ihre wir um zu im in auf von mit für bei als wenn diese dieser dieses sich
le la les l un une des du de d et ou est sont été n ne pas plus ce cette ces vous votre nous notre pour dans sur avec par au aux qui que se s il elle
el los las una unos unas del y o es son no ha han que se su sus este esta estos para por con en al lo le
o os as um uma do da dos das e é são não foi seu sua este esta para por com em no na ao se
il lo gli uno di da è sono non per con su nel una het een van en niet is op te
user assistant session summary
"""
#: Words of filler without sense; a sentence made of them is filler.
NONSENSE = "foo bar baz qux quux asdf asdfg hjkl qwer qwert qwerty zxcv xxx xyz yyy zzz blah bla yada test testing abc abcd dummy tmp lorem ipsum aaa bbb"
#: Words of the classical filler text.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
perspiciatis unde omnis iste natus error voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos ratione sequi nesciunt neque porro quisquam dolorem adipisci numquam eius modi tempora incidunt magnam aliquam quaerat
"""
#: Endings of Latin words; pseudo-Latin is made of them.
ENDINGS = "um us is it at et ut or em am im ia ra la na ta re te unt ant ent int es os as in on que ur se am ae io do ad id sed ex est"
#: What opens a placeholder.
OPENERS = ["{{", "{%", "<%", "${", "#{", "%(", "[[", "«", "@@", "__", "<!--", "%%"]
#: How the wording in single brackets begins.
WORDING = """
your|insert|enter|describe|add|tbd|todo|fill|type|placeholder|write|change me|replace|to be
name of|title of|list of|date of|description of|details of|number of|summary of|link to|reason for|purpose of|version of|address of|owner of|steps to
"""
#: Stems of words that speak about placeholders, formats and what became of them.
ABOUT = """
placeholder*|template*|variable*|syntax|render*|expand*|replac*|substitut*|format*|literal*|escape*|printed|prints|writes|wrote|written|on purpose|generic type*|interpolat*|regex*|builds the|stays in|stayed in|gave it a|filled in|was filled|evaluat*|resolves to|stands for|notation
"""

_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_. -][A-Za-z0-9]+){0,4}"
_WORDS = r"(?:" + "|".join(p.strip() for line in WORDING.split("\n") for p in line.split("|") if p.strip()).replace(" ", r"\s") + r")\b[^\[\]<>{}\n]{0,60}"
_SINGLE = re.compile(r"\{[A-Za-z][\w. -]*\}|\$[A-Z][A-Z0-9_]*\$")
PLACEHOLDER = re.compile(
    rf"""\{{\{{\s*{_NAME}\s*\}}\}}|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|[$\#]\{{{_NAME}\}}|(?<![\w$\#{{])\{{{_NAME}\}}(?!\}})
    |%\({_NAME}\)[sd]|\[\[\s*{_NAME}\s*\]\](?!\()|«\s*{_NAME}\s*»|@@{_NAME}@@|%%{_NAME}%%|(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)
    |(?<![\w$])\$[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\$(?!\w)|<!--\s*(?:[a-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+|[a-z]+[A-Z]\w*|[a-z]{{3,20}}|{_WORDS})\s*-->
    |(?i:\[\s*{_WORDS}\](?!\()|<\s*{_WORDS}>)""",
    re.X,
)
_START = re.compile(r"[\[{<«$#@%]")

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
#: A log line has a time, or a level in capitals before the name of a logger; usage, prompt and quoted lines are told by how they begin.
_LINES = re.compile(
    r"(?m)^[ \t>*-]*(?:\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*|(?:\[?(?:ERROR|WARN|WARNING|INFO|DEBUG|TRACE|FATAL|CRITICAL)\]?[ \t:|-]+(?:\[[^\]\n]+\]|[\w.$-]*[._$-][\w.$-]+|\([^)\n]+\))[ \t]*[:|>-]?[ \t][^\n]*)"
    r"|(?i:usage|syntax|verwendung|aufruf|uso|utilisation)[ \t]*:[^\n]*|[$#%>] [^\n]*--?\w[^\n]*|>[^\n]*)$"
)
_QUOTED = re.compile(r"`[^`\n]{1,300}`|\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|(?<!\w)'[^'\n]{2,200}'(?!\w)")
#: Whole lines that are JSON are the record's own words, not quotes.
_JSON = re.compile(r"(?m)^[ \t]*(\{.*\})[ \t]*$")
_TAG = re.compile(r"</?[a-z!][a-z0-9]*(?:\s[^<>]*)?/?>", re.I)
_HEADING = re.compile(r"[ \t]*#{1,6} ")
_ROLE = re.compile(r"(?i)(?:user|assistant|session summary|summary):\s*")
_COPYRIGHT = re.compile(r"[ \t]*(?:©|\(c\)|copyright\b)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]+|[^\s\u3040-\u30ff\u3400-\u9fff\"“”„«»()\[\]{},;:!?。、！？：|•·<>=*]+")
_CODE = re.compile(r"[\d_/\\@#$%&+~]|\w[.-]\w|[a-z][A-Z]")
_LETTER = re.compile(r"[^\W\d_]")
#: Scripts written without spaces.
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def _list(text: str) -> list[str]:
    return [p.strip() for line in text.strip().splitlines() for p in line.split("|") if p.strip()]


_CONCEPTS = {
    "error": ERRORS, "subject": SUBJECT, "problem": PROBLEM, "login": LOGIN, "need": NEED, "script": SCRIPT, "switch": SWITCH, "text": TEXT, "due": DUE, "filler": FILLERS,
    "soft": SOFT, "furniture": FURNITURE,
}
#: Concepts that make a statement together, with its kind.
STATEMENTS = [({"script", "switch"}, "script"), ({"error"}, "error"), ({"subject", "problem"}, "error"), ({"login", "need"}, "error"), ({"filler"}, "filler"), ({"text", "due"}, "filler")]
#: Concepts without which no statement is possible; texts with none of their stems are passed over.
_TELLING = {"error", "problem", "login", "script", "due", "filler"}
_OPENER = frozenset(["opener"])
_FUNCTION = frozenset(FUNCTION.split())
_NONSENSE = frozenset(NONSENSE.split())
_LATIN = frozenset(LATIN.split())
#: Words that make it worth a look whether a text is nonsense or pseudo-Latin.
_FILLER_WORDS = frozenset(w for w in _NONSENSE | _LATIN if len(w) > 2 or w in _NONSENSE) - _FUNCTION - {"test", "testing", "error"}
_ENDINGS = tuple(ENDINGS.split())


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All stems, with (concepts, length, whether any ending may follow, whether the script has no spaces)."""
    entries: dict[str, tuple[set[str], bool]] = {}
    for concept, table in _CONCEPTS.items():
        for p in _list(table):
            stem = p.rstrip("*")
            had = entries.get(stem, (set(), False))
            entries[stem] = (had[0] | {concept}, had[1] or p.endswith("*"))
    a = ahocorasick.Automaton()
    for o in OPENERS + [b + w for b in "[<" for w in _list(WORDING)]:
        a.add_word(o, (_OPENER, len(o), False, False))
    for stem, (concepts, open_end) in entries.items():
        a.add_word(stem, (frozenset(concepts), len(stem), open_end, _DENSE.match(stem) is not None))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def _about() -> re.Pattern[str]:
    return re.compile(r"\b(?:" + "|".join(re.escape(p.rstrip("*")) + ("" if p.endswith("*") else r"\b") for p in _list(ABOUT)) + ")", re.I)


def _fold(text: str) -> str:
    """Lower case, one kind of apostrophe, the length unchanged."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.replace("’", "'")


def own_text(text: str, data: bool = False) -> str:
    """The text without code, quotes, log and usage lines; what is cut leaves a line break or a blank.

    ``data``: lines that are JSON objects as a whole stay, without its signs.
    """
    out = _FENCE.sub("\n", text) if "```" in text or "~~~" in text else text
    out = _LINES.sub("", out)
    if data and "{" in out:
        out = _JSON.sub(lambda m: re.sub(r'["{}\[\]:]+', " ", m.group()) if _is_json(m.group(1)) else m.group(), out)
    return _QUOTED.sub(" ", out) if any(q in out for q in "`\"“„'") else out


def _is_json(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def has_placeholder(own: str) -> bool:
    """Whether a sentence of the own text leaves a placeholder unfilled instead of speaking about it."""
    starts = [m.start() for m in _START.finditer(own)]
    k = own.find("__")
    while k >= 0:
        starts.append(k)
        k = own.find("__", k + 2)
    for at in starts:
        m = PLACEHOLDER.match(own, at)
        if not m:
            continue
        a = max(own.rfind("\n", 0, m.start()), own.rfind(". ", 0, m.start())) + 1
        ends = [x for x in (own.find("\n", m.end()), own.find(". ", m.end()), len(own)) if x >= 0]
        near = own[max(a, m.start() - NEAR) : m.start()] + " " + own[m.end() : min(min(ends), m.end() + NEAR)]
        if not _about().search(PLACEHOLDER.sub(" ", near)):
            return True
    return False


class _Sizes(dict):
    """Letters of a word that has content, 0 for function words and codes; bounded, as it only saves time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        w = word.strip(".'’-…")
        n = self[word] = 0 if not w or _fold(w) in _FUNCTION or _CODE.search(w) else len(_LETTER.findall(w))
        return n


_SIZES = _Sizes()


def _words(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, end, letters, dense) of the words that have content."""
    return [(m.start(), m.end(), n, _DENSE.search(m.group()) is not None) for m in _WORD.finditer(text) if (n := _SIZES[m.group()])]


def _stems(low: str) -> list[tuple[int, int, frozenset[str]]]:
    """Stems at word boundaries, the longest from the left; equal places unite their concepts."""
    spans: dict[tuple[int, int], frozenset[str]] = {}
    size = len(low)
    for end, (concepts, n, open_end, dense) in automaton().iter(low):
        start, stop = end + 1 - n, end + 1
        if not dense:
            if start and (low[start - 1].isalnum() or low[start - 1] == "_") and not _DENSE.match(low[start - 1]):
                continue
            if stop < size and low[stop] == "_":
                continue
            if stop < size and low[stop].isalnum() and not _DENSE.match(low[stop]):
                if not open_end:
                    continue
                while stop < size and low[stop].isalnum():
                    stop += 1
        if concepts is _OPENER:
            continue
        spans[start, stop] = spans.get((start, stop), concepts) | concepts
    if len(spans) < 2:
        return [(s, e, c) for (s, e), c in spans.items()]
    out: list[tuple[int, int, frozenset[str]]] = []
    at = -1
    for (s, e), concepts in sorted(spans.items(), key=lambda x: (x[0][0], -x[0][1])):
        if s >= at:
            out.append((s, e, concepts))
            at = e
    return out


def _statement(concepts: list[frozenset[str]]) -> str:
    """Kind of the statement that the stems of a span make; two concepts must come from two stems."""
    for wanted, kind in STATEMENTS:
        if len(wanted) == 1:
            if any(wanted <= c for c in concepts):
                return kind
            continue
        a, b = wanted
        have_a, have_b = [i for i, c in enumerate(concepts) if a in c], [i for i, c in enumerate(concepts) if b in c]
        if have_a and have_b and (len(have_a) > 1 or len(have_b) > 1 or have_a != have_b):
            return kind
    return ""


def _size(text: str) -> int:
    return sum(map(_SIZES.__getitem__, _WORD.findall(text)))


def _is_filler(low: str) -> bool:
    """Whether a sentence of some words is nonsense or pseudo-Latin."""
    plain = [w for w in (x.strip(".'-…") for x in _WORD.findall(low)) if w]
    return len(plain) >= 4 and (
        sum(w in _NONSENSE for w in plain) >= 0.8 * len(plain)
        or (sum(w in _LATIN for w in plain) >= 0.1 * len(plain) and sum(w.endswith(_ENDINGS) for w in plain) >= 0.8 * len(plain))
    )


def _sentence(text: str) -> tuple[int, int, int, str]:
    """(letters, letters of stems in statements, letters of other stems, kind) of one sentence."""
    stems = [x for x in _stems(_fold(text)) if x[2] - {"furniture"}]
    if not stems:
        return _size(text), 0, 0, ""
    words = _words(text)
    starts = [w[0] for w in words]
    size = sum(w[2] for w in words)
    hit = soft = 0
    kind = ""
    run: list[tuple[int, int, frozenset[str]]] = []

    def close() -> None:
        nonlocal hit, soft, kind
        if run:
            letters = sum(min(w[2], max(0, min(w[1], e) - max(w[0], s))) for s, e, _ in run for w in words[max(0, bisect_right(starts, s) - 1) : bisect_left(starts, e)])
            told = _statement([c for _, _, c in run])
            if told:
                hit, kind = hit + letters, kind or told
            else:
                soft += letters
        run.clear()

    for x in stems:
        if run:
            near = words[max(0, bisect_right(starts, run[-1][1]) - 1) : bisect_left(starts, x[0])]
            between = sum(w[0] >= run[-1][1] and w[1] <= x[0] for w in near)
            # Scripts without spaces have no words to count, so the letters between count.
            dense = any(w[3] and w[1] > run[-1][1] for w in near)
            if between > GAP or (dense and x[0] - run[-1][1] > GAP_LETTERS):
                close()
        run.append(x)
    close()
    return size, hit, soft, kind


def coverage(own: str) -> tuple[float, str]:
    """(share of the own text that residue covers, kind); furniture, headings and role labels count on neither side.

    A sentence counts as a whole if its stems make ``SENTENCE`` of it and there
    is a statement among them, otherwise with the stems of its statements. Soft
    words count, up to twice what the statements cover, in sentences that have
    nothing else to say. A heading counts if it makes a statement itself. Lines
    without a stem that a statement needs are only measured at first, and looked
    at for soft words if these can still matter.
    """
    own = _TAG.sub("\n", own)
    fillers = _nonsense(own)
    total = hit = rest_size = soft_hit = 0
    kinds: dict[str, int] = {}
    rest: list[str] = []
    for line in own.split("\n"):
        line = _ROLE.sub("", line.strip())
        if not line or _COPYRIGHT.match(line):
            continue
        low = _fold(line)
        stems = _stems(low)
        furniture = sum(_size(line[s:e]) for s, e, c in stems if "furniture" in c)
        size = _size(line)
        if furniture and furniture >= 0.7 * size:
            continue
        heading = _HEADING.match(line) is not None
        if not (fillers and _nonsense(low)) and all(_TELLING.isdisjoint(c) for _, _, c in stems):
            if size and not heading:
                rest_size += size
                if stems:
                    rest.append(line)
            continue
        for part in _SENTENCE.split(line.lstrip("# \t")):
            if fillers and _is_filler(_fold(part)):
                size, soft, kind = len(_LETTER.findall(part)), 0, "filler"
                own_hit = size
            else:
                size, own_hit, soft, kind = _sentence(part)
            if not size or (heading and own_hit < SENTENCE * size):
                continue
            total += size
            if own_hit and own_hit + soft >= SENTENCE * size:
                own_hit = size
            elif soft >= SENTENCE * size:
                soft_hit += size
            hit += own_hit
            if own_hit:
                kinds[kind] = kinds.get(kind, 0) + own_hit
    total += rest_size
    if not hit or 3 * hit < COVERAGE * total:
        return 0.0, ""
    for line in rest:
        for part in _SENTENCE.split(line):
            size, _, soft, _ = _sentence(part)
            if size and soft >= SENTENCE * size:
                soft_hit += size
    return min(1.0, (hit + min(soft_hit, 2 * hit)) / total), max(sorted(kinds), key=lambda k: kinds[k])


def verdict(text: str | None) -> str:
    """``placeholder``, ``error``, ``script``, ``filler`` or an empty string for a record to keep.

    Null, empty, blank and texts without any statement are kept, whatever their length.
    """
    if not text:
        return ""
    opened = _SINGLE.search(text) is not None
    telling = False
    for _, (concepts, *_) in automaton().iter(_fold(text)):
        opened |= concepts is _OPENER
        telling |= not _TELLING.isdisjoint(concepts)
        if opened and telling:
            break
    if telling or _nonsense(text):
        share, kind = coverage(own_text(text, data=True))
        if share >= COVERAGE:
            return kind
    return "placeholder" if opened and has_placeholder(own_text(text)) else ""


def _nonsense(text: str) -> bool:
    """Whether the text may be filler without any stem: some word of the filler texts stands in it."""
    return not _FILLER_WORDS.isdisjoint(text.lower().split())


def find_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, reason) of every record to leave out; one row per input row found. No shuffle, no other columns."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons = [verdict(t) for t in batch.column(1).to_pylist()]
            hits = [i for i, r in enumerate(reasons) if r]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(hits, pa.int32())), pa.array([reasons[i] for i in hits], pa.string())], names=[id_col, "reason"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, reason string")


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The records to keep, all columns, without a shuffle or join."""
    return docs.where(_keep(docs[text_col]))


def _keep(column):  # noqa: ANN001, ANN202
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def keep(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: not verdict(t)).astype(bool)

    return keep(column)
