"""Problem 4: broken question and answer pairs.

Ordered rules look at one question and its answer: emptiness, copied questions, prose in
another language, refusals, and statements that stop before their end.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparlance.llm.common import trimmed
from sparlance.llm.copies import is_empty_answer
from sparlance.llm.language import language_of

DEFECTS = ("empty", "copy", "other_language", "refusal", "truncated")

_FENCE = re.compile(r"```\w*")
_LABEL = re.compile(r"(?:^|\n)\s*Question\s*:\s*", re.I)
_CONTEXT = re.compile(r"^\s*(?:Database|Schema/context|Schema|Evidence|Semantic model)\s*:", re.I)
_WORD = re.compile(r"[^\W_]+", re.U)


def question_of(message: str | None) -> str:
    """The question in a user message: what follows its last "Question:" label, else the blocks that are no context."""
    if message is None:
        return ""
    labels = list(_LABEL.finditer(message))
    if labels:
        return message[labels[-1].end() :].strip()
    blocks = [b for b in re.split(r"\n\s*\n", message) if not _CONTEXT.match(b)]
    return "\n\n".join(blocks).strip()


# ---------------------------------------------------------------- SQL in an answer

#: Where a statement may start: at the beginning, on a new line, or after a sentence or label.
_START = re.compile(r"(?:^|[\n:.。：;]|\*/)[\s\"'`(]*(?=(?:select|with)\b(?!\s*[:,.]))", re.I)
_WITH = re.compile(r"with\s+(?:recursive\s+)?[\w\"`\[\]]+\s*(?:\([^)]*\)\s*)?as\b", re.I)
_FROM = re.compile(r"\bfrom\b", re.I)
#: A sentence that begins with the word select.
_ASKED = re.compile(r"select\s+(?:the|every|each|an?|any|only|rows|records)\s+(?!from\b|as\b|,)\w+\s+(?!from\b|,)", re.I)
_TOKEN = re.compile(
    r"(?P<comment>--[^\n]*|/\*[\s\S]*?(?:\*/|$))|(?P<text>'[^']*(?:''[^']*)*(?P<closed>')?|\"[^\"]*\"?|`[^`]*`?|\[[^\]]*\]?)"
    r"|(?P<number>\d+(?:\.\d+)?\w*)|(?P<word>[^\W\d]\w*(?:\.(?:\w+|\*))*\.?)|(?P<op><>|!\s?=|<\s?=|>\s?=|=\s?=|\|\||\.\.\.|…|\S)"
)


_COMMENT = re.compile(r"--[^\n]*|/\*[\s\S]*?(?:\*/|$)")


def _end_of(sql: str) -> int:
    """Where the statements end: behind the first semicolon that prose follows, else at the end of the text."""
    for m in _TOKEN.finditer(sql):
        if m.group("op") == ";":
            words = _WORD.findall(_COMMENT.sub(" ", sql[m.end() :]))
            if words and words[0].lower() not in _CLAUSES and (len(words) > 1 or not words[0].isascii()):
                return m.end()
    return len(sql)


def split_answer(answer: str) -> tuple[str, str]:
    """(prose, sql) of an answer without fence marks; prose has comments too, and what follows the SQL; sql may be empty.

    A statement starts with SELECT or WITH at the beginning, on a new line or after a sentence;
    on one line behind prose it must go on to a FROM. It ends at the closing mark of its fence,
    or behind a semicolon that prose follows.
    """
    pieces = _FENCE.split(answer)
    text, fences, at = " ".join(pieces), [], 0
    for piece in pieces[:-1]:
        fences.append(at + len(piece))
        at += len(piece) + 1
    last_from = max((m.start() for m in _FROM.finditer(text)), default=-1)
    for m in _START.finditer(text):
        rest = text[m.end() :]
        begins = not text[: m.end()].strip(" \t\r\n\"'`(") or "\n" in m.group(0)
        if rest[:4].lower() == "with":
            if not _WITH.match(rest):
                continue
        elif not (begins or last_from > m.end()):
            continue
        elif begins and _ASKED.match(rest):
            continue
        opened = sum(f < m.end() for f in fences)
        end = fences[opened] - m.end() if opened % 2 and opened < len(fences) else len(rest)
        end = _end_of(rest[:end]) if end == len(rest) else end
        return text[: m.end()] + ("\n" + rest[end:] if rest[end:].strip() else ""), rest[:end]
    return text, ""


# Fixed: SQL words.
_CLAUSES = frozenset("select from where group order having limit offset union intersect except join inner left right full outer cross natural on using as by and or not in like between is null exists distinct all case when then else end asc desc values with".split())
_NEEDS_MORE = frozenset("select from where group order having limit offset union intersect except join inner left right full outer cross natural on using as by and or not in like between is exists distinct case when then else with".split())
_COMPARE = frozenset("= == != <> < > <= >= like in is between exists glob regexp match".split())
_CLAUSE_ENDS = frozenset("where group order having limit offset union intersect except join inner left right full cross natural on".split())
_PREFIXED = ("where", "group", "order", "having", "limit", "union", "intersect", "except", "join", "inner", "and", "desc", "asc", "between", "like")


def _predicate_open(tokens: list[tuple[str, str]]) -> bool:
    """Does the last conjunct of a condition lack its comparison or operand?"""
    depth, part = 0, []
    between = False
    for kind, t in tokens:
        depth += (t == "(") - (t == ")")
        if depth == 0 and kind == "word" and t == "between":
            between = True
        if depth == 0 and kind == "word" and t in ("and", "or"):
            if t == "and" and between:
                between = False
                part.append((kind, t))
                continue
            part = []
            continue
        part.append((kind, t))
    if not part or between:
        return True
    if part[0][1] == "not":
        part = part[1:]
    if len(part) >= 2 and part[0][1] == "exists":
        return False
    if part and part[0][1] == "(" and part[-1][1] == ")" and len(part) > 2:
        return False
    flat, depth = [], 0
    for kind, t in part:
        if t == ")":
            depth -= 1
        if depth == 0:
            flat.append((kind, t))
        if t == "(":
            depth += 1
    at = next((i for i, (kind, t) in enumerate(flat) if t in _COMPARE), None)
    if at is None:
        return True
    rest = flat[at + 1 :]
    if flat[at][1] == "is":
        rest = [x for x in rest if x[1] != "not"]
    return not rest


def statement_open(sql: str) -> bool:
    """Does the SQL stop before its statement is complete?

    True for an unclosed literal, comment or parenthesis; an end on an operator, a comma or a word
    that needs a continuation; a clause without its content; a condition without comparison or
    operand; columns without FROM; a keyword that broke off; an ellipsis at the end.
    """
    tokens: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(sql):
        kind, t = m.lastgroup if m.lastgroup != "closed" else "text", m.group(0)
        if m.group("comment") is not None:
            if t.startswith("/*") and not t.endswith("*/"):
                return True
            continue
        if m.group("text") is not None:
            if t[0] == "'" and not m.group("closed") or t[0] in "\"`[" and (len(t) < 2 or t[-1] != {"[": "]"}.get(t[0], t[0])):
                return True
            tokens.append(("text", t if t[0] == "'" else t.lower()))
        elif m.group("word") is not None:
            tokens.append(("word", t.lower()))
        elif m.group("number") is not None:
            tokens.append(("number", t))
        else:
            tokens.append(("op", t.replace(" ", "")))
    while tokens and tokens[-1][1] == ";":
        tokens.pop()
    if not tokens:
        return True
    if any(t == ";" for _, t in tokens):  # only the last statement can have been cut
        tokens = tokens[max(i for i, (_, t) in enumerate(tokens) if t == ";") + 1 :]
    depth = 0
    for kind, t in tokens:
        depth += (t == "(") - (t == ")") if kind == "op" else 0
    if depth > 0:
        return True
    kind, last = tokens[-1]
    if last in ("...", "…") or kind == "word" and (last in _NEEDS_MORE or last.endswith(".")):
        return True
    if kind == "op" and last not in (")", "*"):
        return True
    if last == "*" and not (len(tokens) > 1 and tokens[-2][1] in ("select", "distinct", ",", "(")):
        return True
    # walk the top level: sections by clause word
    sections: list[tuple[str, list[tuple[str, str]]]] = []
    depth = 0
    for kind, t in tokens:
        if kind == "op" and t == "(":
            depth += 1
        elif kind == "op" and t == ")":
            depth -= 1
        if depth == 0 and kind == "word" and (t in ("select", "from") or t in _CLAUSE_ENDS):
            sections.append((t, []))
        elif sections:
            sections[-1][1].append((kind, t))
    if not sections:
        return tokens[0][1] not in ("with", "(", "values")
    names = [s for s, _ in sections]
    name, body = sections[-1]
    tail = names[len(names) - 1 - names[::-1].index("select") :] if "select" in names else names
    if "from" not in tail and "select" in tail:
        columns = sections[len(names) - 1 - names[::-1].index("select")][1]
        if name == "select" and any(k == "word" and t not in _CLAUSES for k, t in columns) or any(t == "*" for _, t in columns):
            return True
    if not body and name not in ("union", "intersect", "except"):
        return True
    if name in ("union", "intersect", "except"):
        return True
    if name in ("where", "having", "on"):
        return _predicate_open(body)
    if name in ("join", "inner", "left", "right", "full"):
        return name != "join" or not any(t == "using" for _, t in body)
    words = [t for k, t in body if k == "word"]
    if name == "from":
        extra = [t for t in words if t != "as"]
        if len(body) >= 2 and len(extra) > 1 and "," not in [t for _, t in body] and "as" not in words and _broken(extra[-1]):
            return True
    if name in ("group", "order"):
        if words == ["by"] and len(body) == 1 or not words:
            return True
        if words[0] != "by":
            return True
        if len(body) >= 3 and body[-1][0] == "word" and body[-2][0] in ("word", "number", "text") and body[-2][1] not in ("by",) and body[-1][1] not in ("asc", "desc", "nulls", "first", "last", "collate", "nocase", "end"):
            return True
    if name in ("limit", "offset") and not any(k == "number" for k, _ in body):
        return True
    return False


def _broken(word: str) -> bool:
    return len(word) >= 2 and any(k.startswith(word) and k != word for k in _PREFIXED)


# ---------------------------------------------------------------- refusals

#: How each language says the parts of a refusal, as patterns over lower-case text: to regret; not
#: being able, allowed or willing; to refuse; what forbids it.
REFUSALS: dict[str, dict[str, str]] = {
    "en": {
        "regret": r"\bsorry\b|\bafraid\b|\bunfortunately\b|\bregret\w*|\bapolog\w+|\bforgive me\b",
        "cannot": r"\b(?:can(?:not|'t| not)|could(?: not|n't)|won't|will not|would not|wouldn't|must not|mustn't|may not|should(?: not|n't)|unable|(?:not|never) (?:be )?(?:\w+ )?(?:able|allowed|permitted|authori[sz]ed|going|free|willing|comfortable|in a position|cleared|appropriate|something i|possible)|(?:do not|don't|no|without|lack\w*)(?: have)?(?: the| any)? (?:permission|authori[sz]ation|access|clearance|right)|not have access)\b",
        "refuse": r"\b(?:refuse|decline|declining|refusing)\b|\b(?:rather|prefer|choose|chose|opt) not\b|\bnot (?:to )?(?:answer|help|write|touch|query|do that)\b|\bhave to pass\b|\bno (?:query|sql|statement|answer)\b|\b(?:won't|will not|don't) (?:be )?(?:answer|help|provid|writ|shar|produc)\w*",
        "forbids": r"\b(?:against|beyond|outside|violate\w*|contrary to|prohibit\w*|forbid\w*|off[- ]limits|out of scope|restricted|confidential)\b|\b(?:keep|stop|prevent|bar|hinder|block)s?\b.{0,40}\bfrom\b",
    },
    "de": {"regret": r"\bleid\b|\bleider\b|\bbedau\w+|\bentschuldig\w*|\bverzeih\w*", "cannot": r"\b(?:kann|können|könnte|darf|dürfen|werde|will|möchte|vermag|soll)\b.{0,80}\b(?:nicht|kein\w*|nichts)\b|\b(?:nicht|kein\w*)\b.{0,40}\b(?:möglich|gestattet|erlaubt|befugt|berechtigt|zulässig|in der lage|zugriff|berechtigung|befugnis|erlaubnis)\b|\bgebe\b.{0,40}\b(?:nicht|kein\w*)\b|\bau(?:ß|ss)er(?:stande| stande)\b", "refuse": r"\b(?:lehne|verweigere|weigere|unterlasse|verzichte)\b|\blieber nicht\b|\bmuss\b.{0,60}\b(?:ablehnen|passen)\b", "forbids": r"\bverboten\b|\buntersagt\b|\bgegen (?:meine|die) (?:regeln|richtlinien|vorgaben)\b"},
    "fr": {"regret": r"\bdésolée?\b|\bmalheureusement\b|\bregrette\b|\bexcuse\w*|\bpardon\b|\bnavrée?\b", "cannot": r"\b(?:ne|n')\s*\w+.{0,30}\b(?:pas|rien|aucun\w*|point)\b|\bne (?:peux|saurais|puis)\b|\bimpossible\b|\bpas (?:permis|possible|autorisée?|en mesure|habilitée?|le droit)\b", "refuse": r"\brefuse\b|\bdécline\b|\bpréfère ne pas\b|\bm'abst(?:iens|iendrai)\b", "forbids": r"\binterdit\w*|\bcontraire à\b|\bhors de (?:ma|mes)\b"},
    "es": {"regret": r"\blo siento\b|\blament\w+|\bdisculp\w+|\bperd[oó]n\w*|\bme temo\b|\bdesgraciadamente\b", "cannot": r"\bno (?:me )?(?:puedo|puede|debo|podré|podría|quiero|voy a|sé|es posible|está permitid[oa]|están permitid[oa]s|estoy autorizad[oa]|tengo|cuento con|dispongo de|soy capaz|pienso|se me permite)\b|\bimposible\b|\bincapaz\b|\bsin (?:permiso|autorización|acceso)\b", "refuse": r"\bme niego\b|\brechazo\b|\bdeclino\b|\bprefiero no\b|\bme abstengo\b|\bdebo (?:rechazar|declinar)\b", "forbids": r"\bprohibid[oa]\b|\bva contra\b|\bcontra mis\b|\bfuera de (?:mi|mis|lo que)\b"},
    "pt": {"regret": r"\bdesculp\w+|\blament\w+|\binfelizmente\b|\bsinto muito\b|\bperdão\b|\bpeço (?:perdão|desculpa)", "cannot": r"\bnão (?:me )?(?:posso|pode|devo|consigo|poderei|poderia|vou|quero|irei|tenho|disponho|sou capaz|estou|fui|é permitido|é possível|me é permitido)\b|\bimpossível\b|\bincapaz\b|\bsem (?:permissão|autorização|acesso)\b", "refuse": r"\brecuso\b|\brecuso-me\b|\bdeclino\b|\bprefiro não\b|\bme abstenho\b|\babstenho-me\b|\bme recuso\b", "forbids": r"\bproibid[oa]\b|\bcontra (?:as )?minhas\b|\bfora d[oa]s? (?:meu|minha|que)\b"},
    "it": {"regret": r"\bmi dispiace\b|\bspiacent\w\b|\bpurtroppo\b|\bscus\w+|\bsono desolat\w\b", "cannot": r"\bnon (?:mi )?(?:posso|può|sono in grado|ho (?:il permesso|l'autorizzazione|accesso)|sono autorizzat[oa]|è (?:permesso|possibile|consentito)|intendo|voglio|devo|riesco)\b|\bimpossibile\b", "refuse": r"\brifiuto\b|\bpreferisco non\b|\bmi astengo\b|\bdeclino\b", "forbids": r"\bvietat[oa]\b|\bcontro le mie\b"},
    "pl": {"regret": r"\bprzykro\b|\bprzepraszam\b|\bniestety\b|\bżałuję\b|\bwybacz\w*", "cannot": r"\bnie (?:mogę|możemy|wolno|potrafię|jestem|mam|zamierzam|będę|chcę|da się|udzielę|napiszę|odpowiem|pomogę|powinien\w*|jest możliwe)\b", "refuse": r"\bodmawiam\b|\bodmówić\b|\bwolę nie\b|\brezygnuję\b", "forbids": r"\bzabronion\w+|\bzakazan\w+|\bwbrew\b"},
    "tr": {"regret": r"\büzgünüm\b|\bmaalesef\b|\bne yazık\b|\bözür dile\w*|\bkusura bakma\w*", "cannot": r"\w+(?:am(?:am|ıyorum|ayacağım|ayız)|em(?:em|iyorum|eyeceğim|eyiz)|mayacağım|meyeceğim)\b|\b(?:iznim|yetkim|erişimim|hakkım) (?:yok|bulunmuyor)\b|\bmümkün değil\b|\byetkili değilim\b", "refuse": r"\breddediyorum\b|\breddetmek\b|\btercih (?:etmem|etmiyorum)\b|\bm[ae]mayı tercih\b|\bistemiyorum\b", "forbids": r"\byasak\b|\bizin verilmiyor\b|\bkurallar\w* (?:aykırı|izin vermiyor)\b"},
    "ru": {"regret": r"к сожалению|\bизвини\w*|\bпрости\w*|\bсожале\w+|\bувы\b|\bжаль\b", "cannot": r"\bне (?:могу|можем|буду|вправе|имею|смогу|стану|хочу|готов\w*|в состоянии|уполномочен\w*|разрешено|позволено|дозволено|имеется|предоставлю|положено)\b|\bнельзя\b|\bневозможно\b|\bнет (?:прав|права|доступа|разрешения|полномочий|возможности)\b", "refuse": r"отказыва\w+|\bотказать\w*|\bотклоня\w+|\bпредпочту не\b|\bпредпочитаю не\b|\bвоздержусь\b", "forbids": r"\bзапрещ\w+|\bпротивореч\w+|\bне допуска\w+"},
    "zh": {"regret": r"抱歉|对不起|遗憾|很难过|不好意思", "cannot": r"无法|不能|不可以|不便|无权|没有(?:权限|权力|资格|访问)|不被允许|不允许|不会(?:提供|回答|编写|协助|为)|没办法|不方便|不得", "refuse": r"拒绝|谢绝|恕(?:不|难)|婉拒|不愿", "forbids": r"禁止|违反|超出"},
    "ja": {"regret": r"申し訳|すみません|残念|恐れ入り|ごめん|恐縮", "cannot": r"できません|できない|できかね|いたしかね|しかねます|ありません(?:権限)?|権限が(?:ない|ありません|なく)|(?:え|け|せ|て|べ|め|れ)られ(?:ない|ません)|(?:答え|お答え)(?:でき|し)(?:ない|ません)|わけにはいきません|不可能|(?:書|作|扱|見|言)(?:け|れ|え|せ)ません|ていません", "refuse": r"断り|お断|控えさせ|遠慮させ|差し控え|拒否", "forbids": r"禁止|禁じ|反し|反する|範囲外|対象外"},
    "el": {"regret": r"λυπάμαι|συγγνώμη|δυστυχώς|με συγχωρείτε|ζητώ συγγνώμη", "cannot": r"\bδεν (?:μπορώ|μπορούμε|επιτρέπεται|μου επιτρέπεται|έχω|είμαι|πρόκειται|γίνεται|δύναμαι|θα)\b|αδυνατώ|αδύνατο", "refuse": r"αρνούμαι|απορρίπτω|προτιμώ να μην|θα προτιμούσα να μην", "forbids": r"απαγορεύ\w+|αντίθετο|εκτός"},
    "nl": {"regret": r"\bsorry\b|\bhelaas\b|\bspijt\b|\bexcus\w+", "cannot": r"\b(?:kan|kunnen|mag|zal|wil|ga)\b.{0,60}\b(?:niet|geen|niets)\b|\b(?:niet|geen)\b.{0,30}\b(?:toegestaan|bevoegd|mogelijk|in staat|toegang|toestemming)\b", "refuse": r"\bweiger\b|\bliever niet\b|\bmoet\b.{0,40}\bweigeren\b", "forbids": r"\bverboden\b|\bin strijd met\b"},
    "sv": {"regret": r"\btyvärr\b|\bledsen\b|\bförlåt\b|\bursäkta\b", "cannot": r"\b(?:kan|får|vill|tänker|kommer)\b.{0,40}\binte\b|\binte\b.{0,30}\b(?:tillåtet|behörig|möjligt)\b", "refuse": r"\bvägrar\b|\bavböjer\b|\bavstår\b", "forbids": r"\bförbjud\w+"},
    "cs": {"regret": r"\bbohužel\b|\blituji\b|\bomlouvám\b|\bpromiňte\b|\bje mi líto\b", "cannot": r"\bne(?:mohu|můžu|smím|mám|jsem|budu|umím|lze)\b", "refuse": r"\bodmítám\b", "forbids": r"\bzakázan\w+"},
    "ko": {"regret": r"죄송|미안|유감", "cannot": r"없습니다|없어요|못합니다|못해요|않겠습니다|어렵습니다|안 됩니다", "refuse": r"거부|거절|사양", "forbids": r"금지"},
    "id": {"regret": r"\bmaaf\b|\bsayangnya\b", "cannot": r"\btidak (?:bisa|dapat|boleh|diizinkan|mampu|akan)\b|\btak (?:bisa|dapat|boleh)\b", "refuse": r"\bmenolak\b|\benggan\b", "forbids": r"\bdilarang\b"},
}
_REFUSALS = {lang: {part: re.compile(p) for part, p in parts.items()} for lang, parts in REFUSALS.items()}
#: Where a sentence ends.
_SENTENCE = re.compile(r"[^.!?。！？;；\n]+[.!?。！？;；\n]*")
#: Signs of first person, or of the assistant's own doing.
_SELF = re.compile(
    r"\b(?:i|i'm|i've|i'd|we|me|my|our|ich|wir|mir|je|j'|j|m'|me|moi|nous|ma|mes|yo|mi|mis|eu|io|mnie|mi|ja|ben|benim|мне|я|мы|мой\w*|мои\w*|ik|mij|jag|mig|saya|kami)\b|我|本人|私|わたし|当方|저는|제가", re.I
)


#: What one cannot do that calls for a question rather than for a refusal.
_UNSURE = re.compile(r"\b(?:tell|find|see|determine|decide|identify|know|say|be sure)\b")


def refuses(prose: str) -> bool:
    """Does prose that has no statement with it decline to answer?

    Sentences that ask are left out, so a clarifying question that says what cannot be told is no refusal. Of
    the rest something must refuse; or say that a thing is not possible or allowed; or forbid, and
    regret it or speak of the one who answers. Beside a question, not being able to tell or find
    something is no refusal either.
    """
    low = prose.lower().replace("’", "'")
    told = "\n".join(s for s in _SENTENCE.findall(low) if not re.search(r"[?？]|;\s*$", s))  # a Greek question ends with a semicolon
    asks = re.search(r"[?？]", low) is not None
    own = _SELF.search(told) is not None
    for parts in _REFUSALS.values():
        hit = {part: p.search(told) is not None for part, p in parts.items()}
        unable = hit["cannot"] and (not asks or hit["regret"] or hit["forbids"] or own and not _UNSURE.search(told))
        if hit["refuse"] or unable or hit["forbids"] and (hit["regret"] or own):
            return True
    return False


# ---------------------------------------------------------------- copies and shared wording


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[str, int] = {}
    for i, w in enumerate(b):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - bin(row).count("1")


def repeats(question: str, answer: str) -> bool:
    """Does the answer repeat the question (most of its words, in order), with little of its own?"""
    q = [w.lower() for w in _WORD.findall(question)]
    a = [w.lower() for w in _WORD.findall(_LABEL.sub(" ", answer))]
    if len(q) < 3 or len(a) < 3:
        return bool(q) and q == a
    common = _lcs(q, a)
    return common >= 0.8 * len(a) and common >= 0.6 * len(q)


def own_words(question: str, prose: str, run: int = 2) -> str:
    """The prose without runs of two or more words that the question has too, such as names and literals."""
    q = [w.lower() for w in _WORD.findall(question)]
    grams = {tuple(q[i : i + run]) for i in range(len(q) - run + 1)}
    found = list(_WORD.finditer(prose))
    words = [m.group(0).lower() for m in found]
    drop = [False] * len(words)
    for i in range(len(words) - run + 1):
        if tuple(words[i : i + run]) in grams:
            drop[i : i + run] = [True] * run
    out, at = [], 0
    for m, d in zip(found, drop):
        if d:
            out += [prose[at : m.start()], " "]
            at = m.end()
    return "".join(out) + prose[at:]


_NAME = re.compile(r"(?<![\w'’])(?:[A-Z]{1,3}-?\d+\s+)?[A-Z][\w'’&-]*(?:\s+(?:&\s+)?[A-Z][\w'’&-]*)+")
_CODE = re.compile(r"\b\w*[_\d]\w*\b|(?<!\w)'[^'\n]*'(?!\w)|\"[^\"\n]{0,80}\"")


def _plain(text: str) -> str:
    """Text without names, codes and quoted values, which are in no language."""
    return _CODE.sub(" ", _NAME.sub(" ", text))


def _comments(sql: str) -> str:
    return "\n".join(m.group(0).strip("-/* ") for m in _TOKEN.finditer(sql) if m.group("comment") is not None)


def defects_of(question: str | None, answer: str | None, learned: Mapping[str, str] | None = None) -> list[str]:
    """Every defect that the ordered rules find; the first is the pair's defect. A null question is an empty one."""
    if is_empty_answer(answer):
        return ["empty"]
    asked = question_of(question)
    prose, sql = split_answer(answer)
    found = []
    if not sql and repeats(asked, prose):
        found.append("copy")
    said = own_words(asked, prose + "\n" + _comments(sql))
    spoken, heard = language_of(_plain(said), learned), language_of(_plain(asked), learned) or language_of(asked, learned)
    if "copy" not in found and spoken and heard and spoken != heard:
        found.append("other_language")
    if not sql and refuses(said):
        found.append("refusal")
    if sql and statement_open(sql):
        found.append("truncated")
    return found


def record_pairs(records: DataFrame, *, key: str = "record_key", name: str = "prepared_records") -> DataFrame:
    """(table_name, row_key, turn_index, question, answer) of each assistant message.

    The question is the nearest user message before it, empty if there is none. Null messages
    give no pair; null contents stay null.
    """
    role = lambda m: F.lower(trimmed(m["role"]))
    turns = F.transform(
        F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("i"), role(m).alias("role"), m["content"].alias("content"))), lambda m: m["role"] == "assistant"),
        lambda m, t: F.struct(
            t.alias("turn_index"),
            m["content"].alias("answer"),
            F.try_element_at(F.filter(F.slice("messages", 1, m["i"]), lambda x: role(x) == "user")["content"], F.lit(-1)).alias("question"),
        ),
    )
    if not name:
        raise ValueError("a table name is needed")
    asked = records.where("messages is not null").select(F.col(key).alias("row_key"), F.explode(turns).alias("t"))
    return asked.select(F.lit(name).alias("table_name"), "row_key", "t.turn_index", "t.question", "t.answer")


def result_pairs(rows: DataFrame, *, key: str = "result_key", name: str = "result_rows") -> DataFrame:
    """(table_name, row_key, turn_index, question, answer): the last user message and the reference statement."""
    users = F.filter("messages", lambda m: F.lower(trimmed(m["role"])) == "user")["content"]
    return rows.select(F.lit(name).alias("table_name"), F.col(key).alias("row_key"), "turn_index", F.try_element_at(users, F.lit(-1)).alias("question"), F.col("reference_sql").alias("answer"))


def flagged(pairs: DataFrame, learned: Mapping[str, str] | None = None) -> DataFrame:
    """(table_name, row_key, turn_index, defect, all_defects) of the pairs with a defect, the first rule's in `defect`.

    `learned` says of some words which language they tell, from `language.fit_words`, whose size is bounded.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(dict(learned or {}))

    @F.pandas_udf("array<string>")
    def judge(questions: pd.Series, answers: pd.Series) -> pd.Series:
        return pd.Series([defects_of(q, a, shared.value) for q, a in zip(questions, answers)], dtype=object)

    judged = pairs.withColumn("all_defects", judge("question", "answer")).where(F.size("all_defects") > 0)
    return judged.select("table_name", "row_key", "turn_index", F.col("all_defects")[0].alias("defect"), "all_defects")


def all_pairs(records: DataFrame, results: DataFrame) -> DataFrame:
    return record_pairs(records).unionByName(result_pairs(results))
