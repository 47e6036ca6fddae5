"""Template residue, filler, error messages and script notices in texts.

All of it is Catalyst expressions: texts are brought to one sentence a line, and each
kind is one grammar over the lines. What is quoted or stands in code is blanked first,
so content that cites such texts doesn't count. Slots are then weighed in their
surroundings: a sentence that speaks about slots, or stands beside one that does, is a
tutorial's as long as its slots are few among its words; where they are dense, it is a
template whatever it says. No row leaves its partition: there is no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"[\p{L}_][\p{L}\p{M}\p{N}_ .:|-]{0,60}"
_UPPER = r"[\p{Lu}_][\p{Lu}\p{M}\p{N}_ -]{1,60}"

# Names of fields that a lower-case slot may hold between plain brackets.
_FIELDS = (
    "asr|asr_text|transcript|speech|caption|title|name|first_name|last_name|hero|actor|place|city|year|date|director|"
    "episode|scene|summary|description|text|content|question|answer|topic|query|url|link|start|end|author|company|"
    "имя|фамилия|название|место|год|дата|режиссёр|герой|эпизод|описание|текст|город|тема"
)

#: Grammar of unfilled slots, by delimiter.
SLOTS = {
    "double braces": r"\{\{\s*[#/^>&]?\s*[\p{L}_][^{}\n]*+\}\}",
    "statement tags": r"\{%-?\s*[\p{L}_][^%\n]*+%\}",
    "server tags": r"<%[=-]?\s*[\p{L}_][^%\n]*+%>",
    "dollar or hash braces": r"[$#]\{\s*[\p{L}_][^{}\n]*+\}",
    "single braces": r"\{[\p{L}_][\p{L}\p{M}\p{N}_.]{1,60}\}|\{\{?\d{1,3}\}\}?|(?<![\p{L}\p{N})])\{\}",
    "double brackets": rf"\[\[\s*{_NAME}\s*\]\]",
    "percent": rf"%\({_NAME}\)[sdif]|%{_UPPER}%|(?<![\p{{L}}\p{{N}}%])%[sd](?![\p{{L}}\p{{N}}%])",
    "dollars": rf"\${_UPPER}\$",
    "at signs": rf"@@{_NAME}@@",
    "underscores": r"(?<![\p{L}\p{N}_])__[\p{L}][\p{L}\p{M}\p{N}_]{0,60}?__(?![\p{L}\p{N}_])",
    "question marks": rf"\?\?\?{_NAME}\?\?\?",
    "angle or square, capitals": rf"<{_UPPER}>|\[(?!CLS\]|SEP\]|MASK\]|PAD\]|UNK\]){_UPPER}\]",
    "angle or square, field name": rf"<(?:{_FIELDS})>|\[(?:{_FIELDS})\]",
    "insert": r"\[(?i:insert|your|enter|add|tbd|todo|вставить|вставьте|ваш\p{L}*|вставити|einfügen|insertar|insérer)(?:[ :][^\]\n]{0,60})?\]",
    "crosses": r"(?<![\p{L}\p{N}])(?:X{4,}|Х{4,})(?![\p{L}\p{N}])",
    "objects": r"\[object Object\]",
}

#: Values that stand for nothing: two in a sentence, or nothing else in it.
EMPTY_VALUES = r"(?:undefined|NULL|None|NaN|null|nil)"

# Words of a sentence that explains templates, by stem, at the start of a word.
_EXPLAINS = (
    r"\bboard\b|template|placeholder|\bslides?\b|syntax|variable|tutorial|шаблон|доск|дошц|слайд|переменн|змінн|синтаксис|"
    r"заполнитель|vorlage|\btafel|platzhalter|plantilla|pizarra|marcador|modèle|gabarit|au tableau"
)

# What is done with a slot that is spoken about, right before it.
_NAMED = (
    r"(?:writ|typ|put|enter|us|add|past|insert|replac|say|call|nam|print|show|mean|expand|mark|see)(?:e|es|ing|s|ed|ten|t)?|wrote|said|tag|field|token|braces|brackets|"
    r"(?:на|в)?пи(?:шет|шут|шите|сать|сали|сан[аоы]?)|введ\p{L}+|ввод\p{L}+|встав\p{L}+|замен\p{L}+|означа\p{L}+|пол[ея]|тег|впиш\p{L}+|уведіть|вводить|пиш[еуі]\p{L}*|означає|"
    r"schreib\p{L}*|tipp\p{L}*|eingeb\p{L}*|gib|bedeutet|feld|escrib\p{L}*|teclea\p{L}*|pon(?:e|er|ga)|significa|campo|écri\p{L}*|tape[rz]?|saisi\p{L}*|signifie|champ"
)
# What becomes of a slot that is spoken about, right after it.
_BECOMES = (
    r"becomes|means|stands for|is (?:replaced|filled|turned|rendered|expanded|the)|gets|will be replaced|expands|renders|"
    r"станов\p{L}+|означа\p{L}+|превра\p{L}+|замен\p{L}+|стає|wird|steht für|bedeutet|ersetzt|se (?:convierte|sustituye|reemplaza)|significa|devient|signifie|est remplacée?"
)
# The same at the end of a clause.
_LATER = "schreiben|eintragen|eingeben|einsetzen|einfügen|tippen"

#: Words that a sentence needs for each slot in it to be one about slots.
WORDS_A_SLOT = 4

# Words of blind text.
_BLIND = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua "
    "morbi tellus nulla rutrum congue felis mattis turpis augue vitae velit quam porta sagittis pellentesque vestibulum "
    "maecenas quisque praesent curabitur suspendisse fusce donec ligula lectus purus massa viverra tincidunt faucibus "
    "pharetra varius ornare sapien mauris nunc arcu bibendum gravida egestas"
).split()

#: Filler: whole sentences, in letters without marks.
FILLER = (
    rf"^\W*(?:(?:{'|'.join(_BLIND)}|et|ut|in|ac|at|id|eu|ex|non|ad|do|a|est|nec|sed)\b\W*){{4}}",
    r"^\W*(?:(?:text|test|testing|tbd|tba|todo|asdf\w{0,20}|qwer\w{0,20}|zxcv\w{0,20}|foo|bar|baz|bla+h?|xxx+|текст|тест|рыба|фыва|ицукен|prueba|texto|texte)\b[\s,.;:-]*+(?:\d{1,4}\b[\s,.;:-]*+)?){3,}+$",
    r"(?:\b(?:tbd|tba|todo|fixme|asdf\w{0,20}|qwer\w{0,20}|zxcv\w{0,20}|фыва|ицукен)\b[\s,.;:-]+){2}(?:tbd|tba|todo|fixme|asdf|qwer|zxcv|фыва|ицукен)\b|\b(test|text|тест|текст) \1 (?:\d{1,4} )?\1\b",
    r"^\W*(?:(?:tbd|tba|todo|fixme)\b\W*){1,40}$|^\W*(?:todo|fixme|tbd|tba)\s*:",
    r"^\W*(?:sample|dummy|placeholder|filler|example|blind) text\b(?:\W*$|.{0,40}\b(?:replace|remove|delete|here))",
    r"^\W*(?:тестовыи|временныи|пробныи|примерныи) текст\b|^\W*тестовии текст\b",
    r"текст[\s-]заглушка|^\W*заглушка\W*$|^\W*рыба рыба",
    r"^\W*(?:description|synopsis|summary|text|content|title|plot|caption|transcript)s? (?:is )?(?:coming soon|to be (?:added|announced|written)|will be (?:added|here)|goes here|here)\W*$",
    r"^\W*(?:your |the )?(?:text|description|content|title|summary|synopsis) (?:goes|comes) here\b",
    r"^\W*(?:описание|текст|содержание|синопсис|название|сюжет)[\w ]{0,30} (?:скоро появится|будет (?:позже|здесь|добавлен\w*)|появится позже)",
    r"^\W*(?:здесь|тут) (?:скоро )?(?:будет|появится) (?:описание|текст|содержание|синопсис|название|сюжет)",
    r"^\W*(?:тут|здесь) (?:згодом )?(?:буде|з.явиться) (?:опис|текст|назва|змiст|зміст)|^\W*опис незабаром",
    r"^\W*hier (?:steht|kommt|folgt|erscheint)\b.{0,30}\b(?:beschreibung|text|inhalt|titel|zusammenfassung)\b|^\W*(?:beschreibung|text|inhalt) folgt\b|^\W*blindtext\b|^\W*(?:muster|platzhalter)text\b",
    r"^\W*aqui (?:va|ira|viene|aparecera)\b.{0,30}\b(?:texto|descripcion|sinopsis|titulo|resumen)\b|^\W*(?:descripcion|sinopsis|texto) (?:proximamente|pendiente)",
    r"^\W*ici (?:viendra|sera|se trouve|figure|va)?\s*.{0,20}\b(?:texte|description|synopsis|titre|resume)\b.{0,30}$|^\W*(?:texte|description|synopsis) a venir\b",
)

# What servers and programs say, as whole sentences.
_MESSAGES = (
    r"(?:the )?(?:requested )?(?:page|file|resource|video|clip|site|url)(?: you (?:asked for|requested|are looking for))? (?:was |could |is |can ?)?not (?:be )?(?:found|available|exist)|"
    r"not found|bad gateway|bad request|gateway time-?out|(?:internal )?server error|(?:the )?(?:service|server|site|page) (?:is )?(?:temporarily |currently )?(?:unavailable|down)|"
    r"access (?:is )?(?:denied|forbidden)|forbidden|unauthori[sz]ed|permission denied|too many requests|request time-?out|connection (?:reset by peer|refused|timed out|was reset)|"
    r"(?:the |this )?(?:video|clip|page|file|content|media)(?: you (?:asked for|requested|are looking for))? (?:has been|was|is) (?:removed|deleted|unavailable|private|no longer available)|"
    r"(?:this|the) (?:title|video|content|page|clip|programme|program) (?:is )?(?:not available|unavailable) in your (?:region|country|area)|"
    r"your session (?:has )?(?:expired|timed out).{0,60}|something went wrong.{0,60}|an (?:unexpected )?error (?:has )?occurred.{0,60}|"
    r"(?:страница|видео|фаил|запись|ролик|саит|ресурс) (?:не наиден\w?|удален\w?|удалено или скрыто|недоступ\w+|не существует)|"
    r"(?:внутренняя )?ошибка сервера|(?:сервис|сервер|саит) временно недоступен|доступ (?:запрещен|закрыт|ограничен)|слишком много запросов|"
    r"(?:контент|видео|материал|ролик) (?:недоступ\w+|не доступ\w+) в вашем (?:регионе|стране)|(?:ваша )?сессия (?:истекла|завершена).{0,60}|"
    r"(?:соединение|подключение) (?:разорвано|сброшено|прервано)|время ожидания (?:истекло|вышло)|"
    r"(?:сторiнку|сторінку|вiдео|відео|фаил) не знаидено|доступ заборонено|(?:внутрiшня |внутрішня )?помилка сервера|сервiс тимчасово недоступнии|сервіс тимчасово недоступнии|"
    r"seite nicht gefunden|zugriff verweigert|(?:interner )?serverfehler|zu viele anfragen|dienst (?:ist )?(?:vorubergehend )?nicht (?:verfugbar|erreichbar)|"
    r"pagina no encontrada|acceso denegado|error (?:interno )?del servidor|demasiadas solicitudes|servicio (?:temporalmente )?no disponible|"
    r"page (?:introuvable|non trouvee)|acces (?:refuse|interdit)|erreur (?:interne )?du serveur|trop de requetes|service (?:temporairement )?indisponible"
)

# How a story goes on after words that a page might also say.
_STORY = r"he|she|they|we|i|that was|it was|those were|the (?:words?|sign|voice)|он|она|они|мы|я|это был\w?|так|er|sie (?:war|ging)|das war|ella|ellos|era|il (?:se|a|est)|elle|c.etait|вiн|вона|вони|він"

# Things that a page fails to give, and what it fails to do with them.
_LOST = (
    r"(?:(?:this|the|that|requested|your|some) )?(?:page|item|content|video|clip|file|image|picture|resource|media|post|article|section|data|player)s? (?:could|can) ?(?:not|n.t) be (?:loaded|displayed|shown|found|reached|opened|played|retrieved|processed)|"
    r"(?:unable|failed) to (?:load|display|play|open|fetch|retrieve|reach) (?:the |this )?(?:page|item|content|video|clip|file|image|resource|media|data)|(?:the |this )?(?:page|item|content|video|clip|image|resource|media) failed to load|"
    r"не удалось (?:загрузить|открыть|показать|воспроизвести|получить|наити) (?:страницу|видео|фаил|контент|данные|изображение|ролик|материал)|(?:страница|видео|контент|изображение|ролик) не (?:загружен\w?|загрузил\w{1,2}|воспроизводится)|ошибка загрузки|"
    r"не вдалося (?:завантажити|вiдкрити|відкрити|показати|вiдтворити|відтворити) (?:сторiнку|сторінку|вiдео|відео|фаил|вмiст|вміст|зображення)|"
    r"(?:(?:die|das|der|diese[rs]?) )?(?:seite|video|datei|inhalt|element|bild) (?:konnte|kann) (?:derzeit |zurzeit |momentan )?nicht (?:geladen|angezeigt|gefunden|abgespielt|geoffnet) werden|"
    r"no se (?:pudo|puede|ha podido) (?:cargar|mostrar|reproducir|abrir|encontrar) (?:la |el |este |esta )?(?:pagina|video|archivo|contenido|imagen|elemento)|"
    r"(?:cette |ce |le |la |l.)?(?:page|video|fichier|contenu|image|element) n.a pas pu etre (?:chargee?|affichee?|lue?|ouverte?|trouvee?)|impossible de (?:charger|afficher|lire|ouvrir) (?:cette |ce |le |la |l.)?(?:page|video|fichier|contenu|image|element)"
)

#: One of them as a whole sentence that no story goes on from, or before a sentence that a line begins with.
MESSAGE = rf"(?mU)^[^\w\n]{{0,20}}(?i:(?:(?:http|error|ошибка|помилка|fehler|erreur|код|code)?[\s:#-]{{0,3}}[1-5]\d\d\b[\s:.,—-]{{1,4}})?(?:{_MESSAGES}|(?:{_LOST})[^.!?\n]{{0,40}}))(?:[^\w\n]{{0,20}}$(?!\n\W{{0,5}}(?i:{_STORY})\b)|\s+(?=\p{{Lu}}))"

#: Error pages and failed programs.
ERRORS = (
    r"^\W*(?:http(?:/[\d.]{1,3})?|error|ошибка|помилка|fehler|erreur|status|код)[\s:#]{1,2}[45]\d\d\s*(?:$|[:.,—-]\s)",
    r"^\W*(?:request|trace|error|ray) id:? [0-9a-f-]{6,}|^\W*код \d{3}, запрос [0-9a-f]{6,}",
    r"traceback \(most recent call last\)|^\s*file \W[^\n]{1,80}, line \d+|^\W*(?:\w{2,40}(?:error|exception)): ?.*+$",
    r"cuda out of memory|out of memory(?:\.|:)? tried to allocate|segmentation fault|core dumped|exception in thread|stack trace:",
    r"^\W*tried to allocate \d",
    r"upstream (?:request |connect )?(?:timeout|error)|timeout after \d+ ?ms",
    r"<title>\s*[45]\d\d\b|<h1>[^<\n]{0,60}(?:error|denied|not found|unavailable|gateway|requests|reset|expired|removed|available)",
    r"^\W*try again in \d+ (?:seconds|minutes)|^\W*(?:вернитесь|перейдите) на главную страницу или попробуите|^\W*go back to the (?:start|home) page",
    r"^\W*(?:error|fehler|erreur|ошибка|помилка) [45]\d\d\s?[:.—-]",
)

#: An error as a JSON document.
JSON_ERROR = r'\{\s*"?(?:error|errors|status|code|message)"?\s*:\s*(?:\{|\[|"|\d)[^\n]{0,80}(?:code|message|error|status)'

_JS = r"(?:java ?script|scripts?|cookies|скрипт\w*|яваскрипт)"
#: Notices that scripts are required, and gates before a page.
NOTICES = (
    rf"<noscript\b|^\W*you (?:have to|must|need to) (?:allow|enable|turn on) {_JS}",
    rf"^\W*(?:this|the|our) (?:page|video|clip|player|site|website|app|content) (?:needs|requires) {_JS}|^\W*{_JS} (?:is|are) (?:required|blocked|disabled|turned off|switched off|not enabled)\b",
    rf"^\W*(?:please,? )?(?:turn on|enable|activate|allow|switch on) {_JS}\b|^\W*(?:allow|enable) them and reload\b|^\W*your browser (?:has|doesn.t|does not)\b.{{0,40}}\b(?:off|{_JS})",
    r"^\W*checking (?:your|the) browser\b|^\W*this takes up to \d+ seconds",
    r"prove (?:that )?you are not a robot|verify (?:that )?you are (?:a )?human",
    rf"^\W*(?:для (?:просмотра|работы|продолжения)|чтобы (?:посмотреть|увидеть|продолжить|открыть))\b[^\n]{{0,60}}\b(?:включите|разрешите|активируите) {_JS}|^\W*(?:пожалуиста,? )?(?:включите|разрешите) {_JS}",
    rf"^\W*(?:в вашем браузере )?(?:отключен\w?|выключен\w?|заблокирован\w?) {_JS}|^\W*{_JS} (?:отключен|выключен|заблокирован)",
    rf"не работает без {_JS}|подтвердите, что вы не робот",
    rf"^\W*(?:щоб|для)\b[^\n]{{0,60}}\bувiмкнiть {_JS}|^\W*(?:щоб|для)\b[^\n]{{0,60}}\bувімкніть {_JS}|^\W*увімкніть {_JS}|^\W*у вашому браузері вимкнено {_JS}",
    rf"^\W*(?:bitte )?(?:aktivieren|erlauben) sie {_JS}|^\W*(?:diese|dieses) (?:seite|video) (?:benotigt|braucht|erfordert) {_JS}",
    rf"^\W*(?:debes|tienes que|necesitas|hay que|por favor,?)\b[^\n]{{0,30}}\b(?:activar|habilitar|activa|habilita|active|habilite) {_JS}|^\W*(?:activa|active|habilita|habilite) {_JS}|^\W*est[ae] (?:pagina|video) (?:necesita|requiere) {_JS}",
    rf"^\W*{_JS} (?:est|sont|ist|sind|wird|werden|es|son|esta|estan|є|е) (?:requis\w*|necessaires?|desactive\w*|bloque\w*|erforderlich|deaktiviert|notwendig|benotigt|necesari\w*|obligatori\w*|desactivad\w*|bloquead\w*|потрiб\w*|потріб\w*)",
    rf"^\W*(?:требуется|необходим\w?|нужен|потрiбен|потрібен|se requiere|se necesita|necesita|benotigt|erfordert|necessite|requiert) {_JS}\b|^\W*{_JS} (?:требуется|необходим\w?|нужен|обязателен)|^[^\n]{{0,60}}\b(?:требует|потребуе|benotigt|erfordert|requiere|necessite|requiert) {_JS}\b",
    rf"^\W*(?:без|sans|ohne|sin|without) {_JS}\b[^\n]{{0,60}}\b(?:не|pas|nicht|no|not|cannot)\b",
    rf"^\W*(?:veuillez )?(?:activer|activez|autorisez|autoriser) (?:les )?{_JS}|^\W*(?:cette page|ce site|cette video) (?:necessite|requiert|a besoin)",
)

# Strings without which no unbound pattern of a kind can match.
ERROR_HINTS = ("traceback", "file ", "out of memory", "segmentation", "core dumped", "exception in", "stack trace", "upstream", "timeout after", "<title>", "<h1>")
FILLER_HINTS = ("tbd", "tba", "todo", "fixme", "asdf", "qwer", "zxcv", "фыва", "ицукен", "test", "text", "тест", "текст")
NOTICE_HINTS = ("script", "cookies", "скрипт", "browser", "robot", "human", "робот", "seconds", "them and reload", "necessite", "requiert", "a besoin", "браузер")
SLOT_HINTS = ("{", "[", "<", "%", "$", "@", "__", "???", "XXXX", "ХХХХ")
EMPTY_HINTS = ("undefined", "NULL", "None", "NaN", "null", "nil")

_QUOTED = "«[^«»\n]{0,300}»|“[^”\n]{0,300}”|„[^“”\n]{0,300}[“”]|‹[^›\n]{0,300}›"
_CODE = "```[^`]{0,20000}```|~~~[^~]{0,20000}~~~|`[^`\n]{1,300}`"
#: Lines set in after an empty line or a colon, but for markup.
_SET_IN = r"(?<=\n[ \t\r]{0,3}\n|:\r?\n)(?:(?: {4}|\t)[ \t]{0,40}[^<\s][^\n]*+\n?)+"
# Odd spaces, and signs that are left out.
_SPACES = "\u00a0" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u3000\t"
_DROPPED = "".join(chr(c) for c in range(0x200B, 0x2010)) + "\u2060\ufeff\u00ad\r"
# Letters with marks and the letter without.
_MARKED = ("йёїѐàáâãäåçèéêëìíîïñòóôõöùúûüýÿЙЁЇЀÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "иеiеaaaaaaceeeeiiiinooooouuuuyyИЕIЕAAAAAACEEEEIIIINOOOOOUUUUY")


def _has(text: Column, strings: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in strings])


def _matches(text: Column, patterns: tuple[str, ...], hints: tuple[str, ...]) -> Column:
    """Whether any pattern is found.

    Those bound to the start of a line are tried there only; the others only in texts
    that contain one of the ``hints``, which is a search for plain strings.
    """
    start = "^\\W*"  # what a pattern begins with; in the text at most 20 signs, on the same line
    single = [p for x in patterns for p in x.replace("|" + start, "\0" + start).split("\0")]
    bound = "|".join(p.removeprefix(start) for p in single if p.startswith(start))
    free = "|".join(p for p in single if not p.startswith(start))
    return text.rlike(f"(?mU)^[^\\w\n]{{0,20}}(?:{bound})") | (_has(text, hints) & text.rlike(f"(?mU){free}"))


def _lines(text: Column, masked: str) -> Column:
    """One sentence a line, with what ``masked`` matches blanked."""
    text = F.when(F.contains(text, F.lit("\n    ")) | F.contains(text, F.lit("\n\t")), F.regexp_replace(text, _SET_IN, "“”\n")).otherwise(text)
    text = F.translate(text, _SPACES + _DROPPED, " " * len(_SPACES))
    text = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), "\n{2,}", "\n")
    text = F.regexp_replace(text, masked, "“”")
    return F.regexp_replace(text, "(?<=[.!?…])[ ]+", "\n")


_SLOT = "|".join(SLOTS.values())
_EMPTY = rf"(?<![\p{{L}}\p{{N}}_]){EMPTY_VALUES}(?![\p{{L}}\p{{N}}_])"
_ABOUT = rf"(?i)(?<!\p{{L}})(?:{_EXPLAINS})"


def _stands(text: Column, pattern: str, least: int) -> Column:
    """Whether ``least`` matches stand in some sentence (or one is all of it) that isn't about them.

    A sentence is about its slots if it has a word about templates, if one without a
    slot beside it has, or if a slot is named or explained right where it stands, and if
    it has ``WORDS_A_SLOT`` words for each.
    """
    spoken = rf"(?i)(?<!\p{{L}})(?:{_NAMED})[\s:“”]{{1,3}}(?:\p{{L}}{{1,8}} )?(?-i:{pattern})|(?-i:{pattern})(?:[\s“”]{{1,3}}(?:{_BECOMES})|[^\n]{{0,80}}[\s“”](?:{_LATER}))(?!\p{{L}})"

    def one(line: Column) -> Column:
        n = F.size(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)))
        words = F.regexp_replace(line, pattern, " ")
        return F.struct(
            n.alias("n"), F.when(n > 0, F.size(F.regexp_extract_all(words, F.lit("\\p{L}[\\p{L}\\p{M}]+"), F.lit(0)))).otherwise(0).alias("words"),
            words.rlike(_ABOUT).alias("about"), ((n > 0) & line.rlike(spoken)).alias("spoken"),
        )

    def judged(lines: Column) -> Column:
        def residue(x: Column, i: Column) -> Column:
            beside = reduce(Column.__or__, [F.coalesce(F.get(lines, i + d)["about"] & (F.get(lines, i + d)["n"] == 0), F.lit(False)) for d in (-1, 1)])
            about = (x["about"] | x["spoken"] | beside) & (x["n"] * WORDS_A_SLOT <= x["words"])
            return (((x["n"] >= least) & ~about) | ((x["n"] > 0) & (x["words"] == 0))).alias("residue")

        return F.exists(F.transform(lines, residue), lambda x: x)

    return F.element_at(F.transform(F.array(F.transform(F.split(text, "\n"), one)), judged), 1)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column behind a generator, through which no expression is copied."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def flagged(df: DataFrame, text_col: str = "text", to: str = "kinds") -> DataFrame:
    """``df`` with the kinds of residue in a text as an array; empty if there is none.

    ``slot``, ``empty_value``, ``filler``, ``error``, ``notice``. Null, empty and blank
    texts give an empty array. Whole texts are read, however long.
    """
    names = [f"__residue_{x}" for x in ("raw", "plain", "said", "low")]
    raw, plain, said, low = (F.col(n) for n in names)
    # Each form of the text is made once, whatever filter comes later.
    steps = _once(df, names[0], _lines(F.col(text_col), f"{_CODE}|{_QUOTED}"))
    steps = _once(steps, names[1], F.regexp_replace(F.translate(raw, *_MARKED), "\\p{M}", ""))
    steps = _once(steps, names[2], F.regexp_replace(plain, '"[^"\n]{0,300}"', '""'))
    steps = _once(steps, names[3], F.lower(said))
    slot, nothing = _has(raw, SLOT_HINTS) & raw.rlike(_SLOT), _has(raw, EMPTY_HINTS) & raw.rlike(_EMPTY)
    slot, nothing = (F.when(c, _stands(raw, p, n)).otherwise(False) for c, p, n in ((slot, _SLOT, 1), (nothing, _EMPTY, 2)))
    error = said.rlike(MESSAGE) | _matches(low, ERRORS, ERROR_HINTS) | (F.contains(plain, F.lit("{")) & F.lower(plain).rlike(f"(?mU){JSON_ERROR}"))
    filler, notice = _matches(low, FILLER, FILLER_HINTS), _has(low, NOTICE_HINTS) & _matches(low, NOTICES, NOTICE_HINTS)
    found = F.array(*[F.when(c, F.lit(k)) for k, c in (("slot", slot), ("empty_value", nothing), ("filler", filler), ("error", error), ("notice", notice))])
    return _once(steps, to, F.when(F.length(F.trim(raw)) > 0, F.array_compact(found)).otherwise(F.array().cast("array<string>"))).drop(*names)


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, kinds)`` of the rows with residue; repeated rows come once for each."""
    rows = flagged(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    return rows.where(F.size("kinds") > 0).select(F.col("id").alias(id_col), "kinds")


def clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without residue, all columns kept; null texts stay."""
    return flagged(df, text_col, "__residue_kinds").where(F.size("__residue_kinds") == 0).drop("__residue_kinds")
