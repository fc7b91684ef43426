"""Template residue, dummy text, error pages and scripts-required notices in notebook texts.

The text cells are cut into blocks (paragraphs) and sentences. Code blocks, inline code and quotations are taken out
first, as what stands there is written about and not left over. Placeholders are found by one grammar for each kind of
delimiter; a marker in a sentence that explains templates is discounted. Dummy text, error messages and notices are
sentence patterns, and count only where they make up the larger part of their block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame

from sigmill.runtime import widened

#: Share of a block's words that dummy text, error messages or notices must make up.
DENSITY = 0.5
#: Words up to which a piece of a whole text without an end mark is a menu or footer entry, which is no prose.
MENU_WORDS = 6
#: Share of a sentence's words that a stock phrase must make up, unless it is one of ``STOCK_LONG``.
STOCK_SHARE = 1 / 6

# --- fixed patterns: placeholders, by delimiter -------------------------------------------------------------------
_NAME = r"[A-Za-z][\w.\- ]{0,40}?"
PLACEHOLDERS = {
    "double braces": rf"\{{\{{-?\s*{_NAME}\s*(?:\|[^{{}}\n]*)?-?\}}\}}",
    "block tag": r"\{%-?\s*\w+[^%{}\n]{0,60}%\}",
    "angle percent": rf"<%=?\s*{_NAME}\s*%>",
    "dollar braces": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash braces": rf"#\{{\s*{_NAME}\s*\}}",
    "double at": rf"@@\s*{_NAME}\s*@@",
    "double ampersand": rf"&&\s*{_NAME}\s*&&",
    "double angle": rf"<<\s*{_NAME}\s*>>",
    "percent": r"(?<![\w%])%{1,2}[A-Z][A-Z0-9_]{2,}%{1,2}(?!\w)",
    "double square": rf"\[\[\s*{_NAME}\s*\]\]",
    "double underscore": r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    "x marks": r"\bXX+_\w{1,40}?_XX+\b",
    "tilde": rf"~~\{{\s*{_NAME}\s*\}}~~",
    "braces": r"(?<![\w}\\^_$#{~])\{[A-Za-z][a-zA-Z0-9_]{2,40}\}(?![\w{}])",
    "square, goes here": r"\[[^\[\]\n]{2,60}\b(?:goes|comes|belongs|go) here\]",
    "square, instruction": r"\[\s*(?i:insert|enter|add|your|fill in|type|write|put|replace|tbd|tbc|todo)\b[^\[\]\n]{0,60}\](?!\()",
    "round, to be done": r"\(\s*(?:TBD|TBC|TODO|FIXME|TBA)\s*[:\-–][^()\n]{1,60}\)",
    "angle, instruction": r"<\s*(?i:insert|enter|your|fill in|type|put|replace)\b[^<>\n]{0,60}>",
    "angle, capitals": r"<[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)+>",
}
# --- fixed patterns: dummy and instruction text, from the start of a sentence -------------------------------------
STOCK = r"""(?ix)^\W*(?:
    lorem\s+ipsum\b
  | (?:dummy|filler|placeholder|sample|example|blind)\s+(?:content|text|paragraphs?|copy|sentence|title|words)\b
  | filler\W+filler\b
  | placeholder\W*$
  | (?:your|some|more)\s+(?:\w+\s+){0,3}?(?:goes\s+)?here\W*$
  | (?:insert|type|write|enter|add|put|describe|paste|fill\s+in)\s+(?:(?:your|a|an|the|some|short)\s+)*(?:\w+\s+){0,4}?(?:here|below)\b
  | (?:insert|type|write|enter|add|put|paste|fill\s+in)\s+(?:your|an?|the|some)\s+(?:(?:short|brief|own|one-line)\s+)?(?:description|title|summary|introduction|text|name|answer|abstract|overview|conclusion|caption|motivation)\b[^.!?\n]{0,40}\W*$
  | (?:to\s+be|will\s+be)\s+(?:replaced|written|filled|completed|added|announced|determined|done|supplied|provided)\b
  | (?:double-?\s?)?click\s+(?:here\s+)?to\s+(?:edit|add|change)\b
  | (?:please\s+)?(?:replace|delete|remove|overwrite|edit)\s+(?:me\b|this\s+(?:text|line|paragraph|cell|section|sentence|placeholder)\b)
  | (?:text|content|description|summary)\s+(?:goes\s+here|to\s+follow|coming\s+soon)\b
  | coming\s+soon\W*$
  | ここに(?:本文|テキスト|文章|説明|内容)を | (?:hier|ihr)\s+(?:text|beschreibung)\s+(?:einfügen|eingeben|hier)\b | (?:escriba|escribe|inserte|introduzca)\s+(?:su|el|la|tu|un|una)\s+\w+\s+aquí\b | (?:votre|insérez\s+votre)\s+\w+\s+ici\b | (?:seu|insira\s+seu)\s+\w+\s+aqui\b
)"""
# stock instructions that no prose starts with, however long the sentence
STOCK_LONG = r"""(?ix)^\W*(?:
    (?:double-?\s?)?click\s+(?:here\s+)?to\s+(?:edit|add|change)\b
  | (?:insert|type|write|enter|add|put|describe|paste|fill\s+in)\s+(?:(?:your|a|an|the|some|short)\s+)+(?:\w+\s+){0,4}?here\b
  | (?:please\s+)?(?:replace|delete|remove|overwrite|edit)\s+this\s+(?:text|paragraph|cell|section|sentence|placeholder)\b
)"""
# --- fixed patterns: error pages -----------------------------------------------------------------------------------
STATUS = r"""(?ix)^\W*(?:(?:http|error|status|code|oops|sorry|fehler|erreur|estado|erro)\W*){0,3}\(?(?:4\d\d|5\d\d)\)?(?=\W|$)(?P<rest>.*)$"""
STATUS_NAMED = r"(?i)^\W*(?:(?:http|error|status|code|oops|sorry|fehler|erreur|estado|erro)\W+){1,3}\(?(?:4\d\d|5\d\d)\)?(?=\W|$)"
ERROR = r"""(?ix)
    \b(?:page|file|document|notebook|resource|url|address|link|dirección|adresse|seite|página|datei|fichier|archivo)\b(?:[^.!?\n]|\.(?=\w)){0,60}?
      (?:not\s+(?:be\s+)?(?:found|here|exist|available)|(?:does|did)(?:\s+not|n[’']t)\s+exist|no\s+existe|no\s+encontrad[ao]|não\s+(?:existe|encontrad[ao])|n[’']existe\s+pas|introuvable|nicht\s+(?:gefunden|erreichbar|verfügbar)|moved\s+or\s+(?:removed|deleted)|has\s+(?:expired|been\s+(?:moved|removed|deleted))|(?:was|were)\s+(?:moved|removed|deleted))
  | \bnot\s+found\b | \bforbidden\b | \baccess\s+(?:is\s+)?denied\b | \bpermission\s+denied\b | \bunauthori[sz]ed\b | \bbad\s+(?:gateway|request)\b | \bpayload\s+too\s+large\b
  | \b(?:service|server|site|dienst|servicio|serviço)\b(?:[^.!?\n]|\.(?=\w)){0,30}?(?:unavailable|overloaded|nicht\s+(?:erreichbar|verfügbar)|no\s+(?:está\s+)?disponible|indisponible|indisponível|(?:could|can)\s?(?:not|n[’']t)\s+(?:answer|be\s+reached|respond))
  | \bservice\s+(?:temporarily\s+)?unavailable\b | \bgateway\s+time-?\s?out\b | \brequest\s+time-?\s?out\b | \btoo\s+many\s+requests\b | \binternal\s+server\s+error\b
  | ^\W*(?:\d{3}\s+)?gone\s*(?::|$)
  | 見つかりません | 存在しません | アクセスが拒否 | アクセスできません | アクセス権 | エラーが発生 | 接続できません | 利用できません | 応答していません | 找不到 | 无法访问 | 찾을\s?수\s?없습니다
  | \b(?:pagina|risorsa)\s+non\s+trovata\b | \bacceso\s+denegado\b | \baccès\s+(?:refusé|interdit)\b | \bzugriff\s+verweigert\b | \bacesso\s+negado\b | страница\s+не\s+найдена
  | \ban?\s+unexpected\s+(?:problem|error)\b | \bsomething\s+went\s+wrong\b | \bwe\s+hit\s+a\s+snag\b | \bsomething\s+(?:broke|failed|is\s+broken)\b | \b(?:your\s+)?session\s+(?:has\s+)?(?:ended|expired|timed\s+out)\b | \bplease\s+(?:log|sign)\s+in\b | \bthe\s+link\s+has\s+expired\b
  | \bnot\s+allowed\s+to\s+(?:see|view|access|open)\b | \byou\s+(?:need|do\s+not\s+have|don[’']t\s+have)\s+permission\b
  | \b(?:could\s+not|couldn[’']t|cannot|can[’']t|unable\s+to|failed\s+to)\s+(?:render|load|display|open|be\s+reached|be\s+displayed|be\s+shown|be\s+loaded|find\s+(?:the|that|this)\s+(?:page|file))\b
  | \btook\s+too\s+long\s+to\s+respond\b | \b(?:viewer|request|connection|server|session|page)\s+(?:has\s+)?timed\s+out\b
"""
# lines that only accompany an error page
ERROR_AUX = r"""(?ix)
    ^\W*(?:(?:please\s+)?(?:try|come\s+back|slow\s+down|check\s+back)\b(?:[^.!?\n]|\.(?=\w)){0,40}(?:again|later|minutes)|request\s+id\b|reference\s+(?:id\s+)?[0-9a-f]{4,}|error\s+(?:id\s+)?[0-9a-f]{6,}
      |(?:log|sign)\s+in\s+again\b|whoops\b|oops\b|contact\s+the\s+(?:site|page|server)\b|go\s+back\b|zurück\s+zur\b|report\s+this\b|the\s+team\s+has\s+been\s+(?:told|notified)|reload\b|file\s+may\s+be\s+too\b|back\W*$|home\b(?:[^.!?\n]|\.(?=\w)){0,30}\||return\s+to\s+the\b)
"""
# --- fixed patterns: scripts or a browser setting are required ----------------------------------------------------
SCRIPTS = r"""(?ix)
    \b(?:enable|activate|allow|unblock|permit|turn\s+on|switch\s+on|aktivieren|aktiviere|erlauben|zulassen|einschalten|habilit[ae]r?|habilite|activ[ae]r?|activez|activer|autorisez|permit[ae]|ative|ativar|ligue)\b(?:[^.!?\n]|\.(?=\w)){0,30}?\b(?:java\s?script|js|scripts?|scripting|cookies)\b
  | \b(?:java\s?script|js|scripts?|scripting|cookies)\b(?:[^.!?\n]|\.(?=\w)){0,30}?\b(?:(?:is|are|be|must\s+be|has\s+to\s+be|ist|está|est|sind)\s+(?:required|needed|disabled|off|turned\s+off|switched\s+off|blocked|enabled|erforderlich|notwendig|deaktiviert|necesario|requerido|desactivado|desativado|necessário|requis|désactivé)|activez-les|aktivieren|required|enabled\W*$)
  | \bjavascript\s+(?:enabled|required|disabled|erforderlich|requis|requerido|necessário)\b
  | \b(?:turn|switch)\b(?:[^.!?\n]|\.(?=\w)){0,20}\bscript\s?-?blocker\b(?:[^.!?\n]|\.(?=\w)){0,10}\boff\b | \b(?:disable|turn\s+off|pause)\b(?:[^.!?\n]|\.(?=\w)){0,20}\b(?:script|ad)\s?-?blocker
  | \bbrowser\b(?:[^.!?\n]|\.(?=\w)){0,40}\b(?:does\s+not|doesn[’']t|cannot|can[’']t|n[’']accepte\s+pas|bloque|blocks|blockiert|bloqueia|unterstützt)\b(?:[^.!?\n]|\.(?=\w)){0,20}\b(?:java\s?script|js|scripts?|scripting|skripte?)\b
  | \b(?:use|need|requires?)\b(?:[^.!?\n]|\.(?=\w)){0,20}\bbrowser\b(?:[^.!?\n]|\.(?=\w)){0,20}\b(?:java\s?script|scripts?|scripting)\b
  | \bturn\s+it\s+on\b(?:[^.!?\n]|\.(?=\w)){0,20}\bbrowser\b
  | (?:java\s?script|スクリプト|ジャバスクリプト)[^。\n]{0,20}(?:有効|オン|必要|無効)
"""
# --- fixed words: sentences that explain or report ------------------------------------------------------------------
EXPLAINS = r"(?i)\b(?:templates?|markers?|placeholders?|syntax|substitut\w*|render\w*|expands?|escap\w+|interpolat\w*|delimiters?|jinja|mustache|detector|scraped?|crawl\w*|regex\w*|parser?)\b"
REPORTS = r"(?i)\b(?:means?|meant|we\s+(?:count|skip|retry|log|treat|handle|drop|ignore|saw|get|got)|if\s+the|returns?|returned|were|counts?|detector|scraped?|status\s+codes?|for\s+example|e\.g\.)\b"
FUNCTION_WORDS = frozenset(
    "the a an of to and in is it that we for on with as this are be by not at from or which das der die und ist wir zu den von ein eine für mit auf "
    "el la los las de que y en un una es se por con para le les des et est une du dans pour que qui o os um uma e do da em não com".split()
)

_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS.values()))
_STOCK, _STATUS, _NAMED, _ERROR, _AUX, _SCRIPTS = (re.compile(p) for p in (STOCK, STATUS, STATUS_NAMED, ERROR, ERROR_AUX, SCRIPTS))
_STOCK_LONG = re.compile(STOCK_LONG)
_EXPLAINS, _REPORTS = re.compile(EXPLAINS), re.compile(REPORTS)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
_QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"|‹[^›\n]*›")
_TAG = re.compile(r"</?(?:html|head|body|title|center|h\d|hr|p|div|span|br|noscript|b|i)\b[^<>\n]*>", re.I)
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|\n+|\s+[|]\s+")
_BLOCK = re.compile(r"\n[ \t\r]*\n")
_ENDED = re.compile(r"[.!?…。！？]\W*$")
_COMMENT = re.compile(r"^#[ \t]?", re.M)
_WORD = re.compile(r"\w+")
#: fixed values: characters that patterns without case take for another than ``str.lower`` gives
_CASELESS = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "ᲀ": "в", "ᲁ": "д", "ᲂ": "о", "ᲃ": "с", "ᲄ": "т", "ᲅ": "т", "ᲆ": "ъ", "ᲇ": "ѣ", "ᲈ": "ꙋ"})


def folded(text: str) -> str:
    """``text`` as the words of ``Needs`` are looked up in it."""
    return text.lower() if text.isascii() else text.translate(_CASELESS).lower()


class Needs:
    """Words without which a pattern can't match, read off the pattern itself; spares most cells the search.

    Each alternative has its own list of sets of words; a match of it holds a word of every set. An alternative
    without fixed letters has an empty list, and may then match any text.
    """

    def __init__(self, pattern: str) -> None:
        tree = _parser.parse(pattern)
        alone = len(tree) == 1 and tree[0][0] is _parser.BRANCH
        self.alternatives = [[sorted(words) for words in self._sets(t)] for t in (tree[0][1][1] if alone else [tree])]

    @classmethod
    def _sets(cls, tree) -> list[frozenset[str]]:
        found, run = [], ""
        for what, value in [*tree, (None, None)]:
            if what is _parser.LITERAL and not chr(value).isspace():
                run += folded(chr(value))
                continue
            if run:
                found.append(frozenset([run]))
            run = ""
            if what is _parser.BRANCH:
                each = [cls._sets(t) for t in value[1]]
                if all(each):  # one set holds for the whole branch: of each alternative the set with the longest words
                    found.append(frozenset().union(*(max(sets, key=lambda ws: (min(map(len, ws)), -len(ws))) for sets in each)))
            elif what is _parser.SUBPATTERN:
                found += cls._sets(value[-1])
            elif what in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0]:
                found += cls._sets(value[2])
        return found

    def met(self, low: str) -> bool:
        """Whether the pattern may match in a text, given ``folded``, or in a part of it."""
        for sets in self.alternatives:
            for words in sets:
                for word in words:
                    if word in low:
                        break
                else:
                    break
            else:
                return True
        return False


_PLACEHOLDER_NEEDS, _ERROR_NEEDS, _SCRIPTS_NEEDS = Needs("|".join(f"(?:{p})" for p in PLACEHOLDERS.values())), Needs(ERROR), Needs(SCRIPTS)


def _plain(cell: str) -> str:
    """The cell's prose: comment marks of the script layout, cell marks, code and quotations taken out."""
    if cell.startswith("# %%") or "\n# %%" in cell:
        lines = [line for line in cell.split("\n") if not line.startswith("# %%")]
        cell = _COMMENT.sub("", "\n".join(lines))
    return _QUOTED.sub(" ", _CODE.sub(" ", cell.replace("\r\n", "\n")))


def _repeats(words: list[str]) -> bool:
    """Whether the words are one or a few, said over and over."""
    return len(words) >= 3 and len(set(words)) == 1 or len(words) == 2 and words[0] == words[1] and len(words[0]) > 3


def _pseudo(words: list[str]) -> bool:
    """Whether the words look like filler Latin: many, all of letters, none of the small words that prose needs, repeated."""
    return len(words) >= 10 and all(w.isalpha() and w.isascii() for w in words) and not FUNCTION_WORDS.intersection(words) and len(set(words)) <= 0.9 * len(words)


def _stock(sentence: str, words: int) -> bool:
    """Whether a sentence is a stock instruction or dummy text: begins as one, to no small part of its words."""
    found = _STOCK.search(sentence)
    return bool(found) and (len(_WORD.findall(found.group())) >= STOCK_SHARE * words or bool(_STOCK_LONG.search(sentence)))


def cell_case(cell: str, whole: bool = False) -> str | None:
    """What is left over in a text cell (``placeholder``, ``dummy``, ``error``, ``scripts``), or None.

    ``whole``: the text isn't a notebook, so it is one block, with menus and the like around a message; these don't
    count against the message.
    """
    prose = _plain(unicodedata.normalize("NFC", cell))
    low = folded(prose)
    errors, scripts = _ERROR_NEEDS.met(low), _SCRIPTS_NEEDS.met(low)
    for sentence in _SENTENCE.split(prose) if _PLACEHOLDER_NEEDS.met(low) else ():
        if (hits := _PLACEHOLDER.findall(sentence)) and not (len(hits) <= 2 and _EXPLAINS.search(_PLACEHOLDER.sub(" ", sentence))):
            return "placeholder"
    for block in [prose] if whole else _BLOCK.split(prose):
        block = _TAG.sub("\n", block)
        words, parts = len(_WORD.findall(block)), {"dummy": 0, "error": 0, "scripts": 0}
        if not words:
            continue
        status, menu = False, 0
        for sentence in _SENTENCE.split(block):
            own = [w.lower() for w in _WORD.findall(sentence)]
            if not own:
                continue
            if _repeats(own) or _pseudo(own) or "lorem ipsum" in sentence.lower()[:20] or _stock(sentence, len(own)):
                parts["dummy"] += len(own)
            elif _REPORTS.search(sentence) and not _NAMED.match(sentence):
                continue
            elif scripts and _SCRIPTS.search(sentence):
                parts["scripts"] += len(own)
            elif errors and _ERROR.search(sentence):
                parts["error"] += len(own)
                status = True
            elif (m := _STATUS.match(sentence)) and (_NAMED.match(sentence) and not _REPORTS.search(m["rest"]) or re.match(r"\W*\(?[45]\d\d\)?\s*[–:)-]", sentence) or not m["rest"].strip(" .!")) and len(own) <= 12:
                parts["error"] += len(own)
                status |= len(own) > 1
            elif _AUX.search(sentence):
                parts["error"] += len(own)
            elif len(own) <= MENU_WORDS and not _ENDED.search(sentence):
                menu += len(own)
        if parts["dummy"] >= DENSITY * words:
            return "dummy"
        prose_words = words - menu if whole else words
        if parts["scripts"] and parts["scripts"] + parts["error"] >= DENSITY * prose_words:
            return "scripts"
        if status and parts["error"] >= DENSITY * prose_words:
            return "error"
    return None


def text_case(text: str | None, kinds: list[str] | None, starts: list[int] | None) -> str | None:
    """The case of a whole text: of its text cells, or of all of it where it has no cells."""
    if not text or text.isspace():
        return None
    if not kinds or not starts:
        return cell_case(text.replace("﻿", ""), whole=True)
    ends = [*starts[1:], len(text)]
    for kind, low, high in zip(kinds, starts, ends):
        if kind == "text" and low is not None and high is not None and (case := cell_case(text[low:high])):
            return case
    return None


def residue(documents: DataFrame) -> DataFrame:
    """Distinct ``doc_id`` and ``kind`` of the documents that hold template residue, dummy text, an error page or a notice.

    Whole texts are searched. NULL, empty and blank texts are no cases; a text without cells counts as one block; cell
    offsets outside the text give empty cells; a NULL key comes out as it is. Repeated rows give one row.
    """
    picked = documents.select("doc_id", "text", "cell_kinds", "cell_starts")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("text", "cell_kinds", "cell_starts")]
            rows, kinds = [], []
            for low in range(0, batch.num_rows, 256):
                for n, row in enumerate(zip(*(c.slice(low, 256).to_pylist() for c in columns)), low):
                    if case := text_case(*row):
                        rows.append(n)
                        kinds.append(case)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    kind = picked.schema["doc_id"].dataType.simpleString()
    return widened(picked).mapInArrow(search, f"doc_id {kind}, kind string").distinct()
