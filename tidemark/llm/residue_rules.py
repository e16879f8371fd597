"""Forms of residue with an open part, which no list of known texts can hold.

Unfilled slots, made-up Latin, one word over and over, instructions to an author, messages that something failed, names
of errors, and notices that scripts are needed; in English, German, French and Spanish. A segment
that speaks about such things, in a sentence of its own, is none. Messages without an open part
are in ``residue_seeds`` and reach their copies through the graph of ``residue`` only.
"""

from __future__ import annotations

import re
from re import _parser

_I = re.IGNORECASE

#: The notations of templates.
SLOT = re.compile(
    r"\{\{[^{}]{0,80}\}\}|\{%[^%{}]{0,120}%\}|[$#]\{[^{}]{1,60}\}|<%.{0,120}?%>|<\?(?:php|=).{0,120}?\?>"
    r"|%(?:\d{1,2}\$)?[sdif](?![\w%])|%\([A-Za-z_]+\)[sd]|\{\d{1,2}\}|\{[a-zA-Z_][a-zA-Z_.]{0,30}\}|\[object \w+\]|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]{2,}__|@@\w+@@"
    r"|\[\[?(?:[A-Z]+[ _])*(?:PLACEHOLDER|INSERT|TODO|TBD|YOUR|NAME|TITLE|DATE|TEXT|IMAGE|COMPANY|ARTICLE|SUMMARY|CONTENT|PLATZHALTER|TITEL)(?:[ _][A-Z]+)*\]?\]"
    r"|<<[A-Z][A-Z_ ]+>>|#{2,}[A-Z][A-Z_]+#{2,}|\[(?!(?:MASK|NOTE|EDIT|HTML|CITATION|NSFW|UPDATE|DELETED|SPOILER|UNK)\])[A-Z][A-Z_]{3,}\]"
    r"|\[(?:insert|your|enter|add|name of|company name|article title|date|title|insérer|votre|einfügen|insertar)\b[^\[\]]{0,40}\]|<(?:insert|your|enter|add|to be)\b[^<>]{0,40}>"
)
EMPTY_VALUE = re.compile(r"(?<![\w\"'“])(?:undefined|null|NaN)(?:%|(?![\w\"'”]))")
#: Words of sentences that speak about slots, errors and the like.
ABOUT = re.compile(
    r"\b(?:words?|variables?|manual|stands? for|explain\w*|is called|was called|habit|draft|subject|documentation|syntax|means|"
    r"asked to|printed|wrote|writes|says|saying|said|quot\w+|complain\w*|complaint|used to|have used|has used|court|treatise|annex|margin|notation|macro|"
    r"bedeutet|steht für|ersetzt|Handbuch|Wort|genannt|signifie|remplacé|manuel|mot|appelé|significa|sustituy\w+|palabra|manual de|llamad\w+)\b",
    _I,
)

#: Words of sentences that speak about a notation rather than use it.
ABOUT_SLOT = re.compile(
    r"\b(?:variables?|manual|stands? for|explains|explained (?:that|how)|replaced by|renamed|asked to put|documentation|syntax|means|vocabulary|braces|brackets|record reads|marks in|script|notation|macros?|occurs?|any string|"
    r"templates?|placeholders?|markup|tokens?|bedeutet|steht für|ersetzt|handbuch|vorlagen?|signifie|remplacée? par|manuel|modèles?|balises?|significa|sustituye|plantillas?|etiquetas?)\b",
    _I,
)

#: Forms of filler with an open part; closed texts are seeds.
_FILLER = [
    r"(?:sub|head)?(?:title|line|ing|text|content|caption|summary|name|description|logo|image|photo|date|body|copy|quote)s?(?: text)? (?:goes|go|will go|comes) here",
    r"(?:please )?(?:insert|enter|write|type|put|paste|add|fill in) (?:an? |the |your |some |short )*\b.{0,40}\b(?:here|in this space|below)\b.{0,30}$",
    r"(?:todo|fixme|tbd|xxx)\b ?[:(-].{0,80}$",
    r"[\w ]{1,30}: (?:choose|select|pick) (?:one|an option|\w+)\W*$",
    r"(?:.{0,40}[:–-] ?)<?(?:to be|will be) (?:written|added|announced|supplied|determined|completed|confirmed|filled in|provided|defined)(?: soon| later)?>?\W*$",
    r".{1,60}\bwill be (?:added|supplied|written|filled in|completed) (?:soon|later|shortly)\W*$",
    r"(?:(?:asdf|qwer|qwert|qwerty|asdfg|hjkl|jkl|jklö|zxcv|yxcv|uiop|foo|bar|baz|bla|blah|xxx)[ ,.;]*){3,}$",
    r"(?:überschrift|titel|text|name|inhalt|beschreibung|zusammenfassung|bild|datum)\b.{0,20}\b(?:hier )?(?:eingeben|einfügen|eintragen|ergänzen)\W*$",
    r"(?:insérez|saisissez|écrivez|entrez|ajoutez|tapez|indiquez|remplacez)\b.{0,40}\b(?:ici|texte|titre|résumé|légende|date|description|nom|contenu)\b.{0,30}$",
    r"(?:escriba|introduzca|inserte|ingrese|añada|agregue|escribe|inserta|reemplace|sustituya)\b.{0,40}\b(?:aquí|texto|título|resumen|fecha|descripción|nombre|contenido|imagen)\b.{0,30}$",
]
_SUBJECT = (
    r"(?:the|this|that|your|our) (?:\w+ ){0,2}?(?:page|report|file|site|service|application|app|server|article|chart|link|address|document|resource|content|request|view|viewer|dashboard|list|"
    r"system|host|data|image|item|record|table|website|account|section|url|map|search|feed|connection|summary|store|archive|database|index|gateway|backend|module|widget|player|picture|figure|template|form|query|result|download|stream|session|network|domain|preview|editor|tool|portal)s?(?: you (?:are |were |have |['’]re )?(?:asked for|requested|entered|followed|looking for|want\w*|opened|clicked)(?: on)?)?"
)
_FAILS = (
    r"(?:(?:is|are) (?:not |no longer |temporarily |currently |now )*(?:found|available|unavailable|overloaded|blocked|down|offline|broken|missing|reachable|responding|closed|accessible|gone)"
    r"|(?:was|were|could|can|cannot|could not be|can not be|cannot be|can['’]t be|couldn['’]t be) ?(?:not )?(?:be )?(?:found|reached|loaded|displayed|opened|shown|processed)"
    r"|(?:has|have) (?:been )?(?:removed|deleted|moved|renamed|expired|crashed|failed|timed out)|(?:does not|doesn['’]t|no longer|did not|didn['’]t|is not|isn['’]t) (?:exist|respond|load|work|answer|reply|responding|loading|working)\w*"
    r"|(?:returned|gave|sent) (?:an? )?(?:empty|invalid|unexpected|malformed|wrong|no)|(?:refused|closed|reset|dropped|lost|interrupted) (?:the|your) connection|timed out|failed to \w+|(?:has|have) (?:run into|encountered|hit) (?:a|an|some) (?:\w+ )?(?:problem|error|issue)|(?:took|is taking) too long|(?:ran|is) out of memory|crashed)\b"
)
_TAIL = r"[^.,;]{0,32}(?:, ?(?:error|code|status) \d+)?\s*(?:\([^()]{0,30}\))?\W*$"
#: Forms of messages with an open part: what failed and how, the names of errors; closed texts are seeds.
_ERROR = [
    _SUBJECT + " " + _FAILS + _TAIL,
    r"(?:\w+\.)*\w+(?:error|exception|warning): .",
    r"traceback \(most recent call last\): .",
    r"(?:exception in thread\b|uncaught \w*(?:error|exception)\b|uncaught \w+\b.{0,160}$|caused by: .|stack trace: .)",
    r"(?:die|diese|der|das) (?:von ihnen )?(?:angeforderte |gesuchte |aufgerufene )?(?:seite|adresse|datei|inhalt|artikel)\b.{0,40}\b(?:nicht gefunden|gibt es nicht|existiert nicht|nicht (?:mehr )?(?:vorhanden|verfügbar|erreichbar))\b.{0,60}$",
    r"(?:la page|le contenu|la ressource|l['’]adresse|le fichier)(?: que vous\b.{0,25})?(?: demandée?)? (?:est introuvable|n['’]existe (?:pas|plus)|n['’]est (?:pas|plus) disponible)\b.{0,60}$",
    r"(?:la página|el contenido|el recurso|la dirección)(?: que (?:busca|ha solicitado)\b)?.{0,20} (?:no existe|ya no (?:existe|está disponible)|no está disponible|no se encuentra)\b.{0,60}$",
]


def _starts(parsed) -> tuple[set[str] | None, bool]:  # noqa: ANN001
    """The characters that a match of a parsed rule can begin with, None for any, and whether it can be empty. Texts are stripped: no match begins with a space."""
    found: set[str] = set()
    for op, arg in parsed:
        if op is _parser.AT:
            continue
        if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            chars, empty = _starts(arg[2])
            empty = empty or arg[0] == 0
        elif op is _parser.SUBPATTERN:
            chars, empty = _starts(arg[-1])
        elif op is _parser.BRANCH:
            some = [_starts(b) for b in arg[1]]
            chars, empty = None if any(c is None for c, _ in some) else set().union(*(c for c, _ in some)), any(e for _, e in some)
        elif op is _parser.LITERAL:
            chars, empty = {chr(arg)}, False
        elif op is _parser.IN and all(o is _parser.LITERAL or o is _parser.RANGE or (o, v) == (_parser.CATEGORY, _parser.CATEGORY_SPACE) for o, v in arg):
            chars, empty = {chr(c) for o, v in arg if o is not _parser.CATEGORY for c in ((v,) if o is _parser.LITERAL else range(v[0], v[1] + 1))}, False
        else:
            return None, False
        if chars is None:
            return None, False
        found |= chars
        if not empty:
            return found, False
    return found, True


def _needs(parsed) -> set[str] | None:  # noqa: ANN001
    """Strings of which every match of a parsed rule holds one, the longest such; None if there are none."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append({run})
            run = ""
        if op is _parser.SUBPATTERN:
            found.append(_needs(arg[-1]))
        elif op is _parser.BRANCH:
            some = [_needs(b) for b in arg[1]]
            found.append(None if None in some else set().union(*some))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0]:
            found.append(_needs(arg[2]))
    return max((n for n in found if n), key=lambda n: min(map(len, n)), default=None)


def _folded(text: str) -> str:
    """One form of what is equal without regard to case."""
    return text.lower() if text.isascii() else text.upper().lower().replace("\u0307", "")


def _dispatch(rules: list[str]) -> tuple[dict[str, re.Pattern], list[tuple[str, re.Pattern]]]:
    """Derived from the rules: those that can match a text by its first character, and the others with a string that the text then holds."""
    by: dict[str, list[str]] = {}
    inside = []
    for rule in rules:
        parsed = _parser.parse(rule, _I.value)
        chars = _starts(parsed)[0]
        if chars is None:
            inside += [(_folded(n), re.compile(rule, _I)) for n in sorted(_needs(parsed) or {""})]
        else:
            for c in {_folded(c)[:1] for c in chars}:
                by.setdefault(c, []).append(rule)
    return {c: re.compile("|".join(f"(?:{r})" for r in some), _I) for c, some in by.items()}, inside


_BY_START, _INSIDE = _dispatch([*_FILLER, *_ERROR])


def _ruled(text: str) -> bool:
    """Whether a rule of filler or errors matches a text, which is stripped and not empty."""
    low = _folded(text)
    if (rules := _BY_START.get(low[:1])) and rules.match(text):
        return True
    for need, rule in _INSIDE:
        if need in low and rule.match(text):
            return True
    return False


_SCRIPT = re.compile(r"\b(?:java ?scripts?|JS|ECMAScript|scripts?|scripting|skripte?n?|cookies)\b", _I)
_NEED = re.compile(
    r"\b(?:enable|enabled|activate|depends? on|rel(?:y|ies) on|built with|cannot|can['’]t|will not|won['’]t|turn (?:them |it |\w+ )?on|switch(?:ed)? (?:them |it |\w+ )?on|allow(?:ed)?|requires?|needs?|need to|must|disabled|deactivated|blocks?|blocked|blocking|switched off|turned off|"
    r"not (?:run|support|enabled|available)|unsupported|aktivier\w*|erlaub\w*|einschalten|eingeschaltet|benötigt|erforderlich|deaktiviert|blockier\w*|zulassen|müssen|"
    r"activer|activez|autoris\w+|besoin|nécessaires?|nécessite|désactivés?|bloque\w*|bloqués?|activ[ae]r?|active|habilit\w+|permit\w+|necesita|requiere|desactivad\w+|bloquead\w+|necesari\w+)\b",
    _I,
)
_TO_READER = re.compile(
    r"\b(?:please|you|your|this (?:site|page|app|application|website|content)|to (?:view|use|see|continue|run|display|read)|bitte|ihr\w*|sie|diese\w*|veuillez|vous|votre|vos|cet(?:te)?|ce (?:site|contenu)|"
    r"(?:the|our|this|each|every) (?:\w+ )?(?:viewer|dashboard|chart|list|page|site|app|application|map|table|report|content|service|tool|editor|feature|player|search|form|menu)s?|"
    r"por favor|su|sus|usted|tu|est[ae] (?:sitio|página|aplicación)|must be)\b|<noscript",
    _I,
)
#: What goes before a message without being part of it.
_LEAD = re.compile(r"^(?:[\s>*•·|=~\"'“„«¡⚠❗️ℹ✖!-]|#+ |(?:heads up|note|notice|warning|attention|sorry|hinweis|achtung|avis|aviso|atención|important)\s*[–—:!,.-]+\s*|\d{1,2}[.)] |\(?[a-z]\) |<(?!\?|%|to |insert|your|enter|add|noscript|html|!--)[^<>]{0,60}>)+", _I)
#: The letters with which the words of a lead begin.
_LEADING = "hnwsaiHNWSAI"
PAST = re.compile(r"\b(?:was|were|rewritten|had|wurde|war|était|fue)\b", _I)
LATIN = frozenset(b"lorem ipsum dolor amet velit massa porta tempus semper aliqua luctis integro nostro quam vestra consectetur adipiscing elit sed eiusmod tempor incididunt labore magna enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim".split())
MARK = re.compile(r"[{<\[$@#%_]")
SCRIPTS = frozenset(b"javascript javascripts js ecmascript java script scripts scripting skripte skripten skriptn skript cookies".split())
VALUES = frozenset((b"nan", b"null", b"undefined"))
#: The word that stands for a slot of a template.
SLOTTED = b"slot0slot"
#: Without one of these a segment is looked at for its form only.
_TELLING = LATIN | SCRIPTS | VALUES | {SLOTTED}


#: Labels: none; one that rests on a slot or an empty value, and so does not hold for the same words with these filled in; one that holds for near-duplicates.
NONE, STAYS, SPREADS = 0, 1, 2


def trusted(segment: str, tokens: list[bytes]) -> int:
    """The label of a segment that is residue beyond doubt, else NONE. ``tokens`` are its words (see ``residue.units``)."""
    telling = not _TELLING.isdisjoint(tokens)
    if telling and SLOTTED in tokens and not ABOUT_SLOT.search(SLOT.sub(" ", segment)):
        return STAYS
    if telling and not VALUES.isdisjoint(tokens):
        empty = EMPTY_VALUE.findall(segment)
        if empty and not ABOUT.search(segment) and (len(tokens) <= 7 or len(empty) > 1 and len(tokens) <= 7 * len(empty)):
            return STAYS
    if telling and len(tokens) > 5 and not LATIN.isdisjoint(tokens) and sum(t in LATIN for t in tokens) > max(2, 0.3 * len(tokens)):
        return SPREADS
    if len(tokens) > 3 and tokens[0] == tokens[1] and len(set(tokens)) == 1:
        return SPREADS
    c = segment[0]
    lead = _LEAD.match(segment) if not c.isalpha() or c in _LEADING or segment[1:2] == ")" else None
    text = (segment[lead.end() :] if lead else segment).strip()
    if not text:
        return NONE
    asks = telling and not SCRIPTS.isdisjoint(tokens) and _SCRIPT.search(text) and _NEED.search(text) and _TO_READER.search(text) and not PAST.search(text)
    if not asks and not _ruled(text):
        return NONE
    return NONE if ABOUT.search(text) and not text.lower().startswith(("your ", "write ", "please ")) else SPREADS
