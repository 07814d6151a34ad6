"""Template residue and error-page text (problem 8).

Method: lines are normalised and counted by host (the document's source); lines that
recur among a share of a host's distinct texts are its boilerplate and are subtracted
from every document first.  Only the residual is read: a document is excluded if its
residual has error, filler or script-required evidence and no content beside it; a slot
that was not filled counts wherever it stands in the residual's prose.

A recurring line is only subtracted if it carries no evidence and no slot itself: the
same error message on many pages of a host is what is looked for.  Marks of code are not
subtracted either, so that code stays code.  Evidence is read sentence by sentence and
must be the whole sentence, so a text that speaks about an error page, or quotes code,
has none; reading ends as soon as there is more content than furniture may have.

The boilerplate of a host is one row, at most lines-per-text / ``SHARE`` hashes, so the
lines are marked in a join of documents with hosts.  Spark broadcasts the hosts while
they are small, so texts stay where they are read; beyond that the join is sorted and
adaptive execution splits the documents of a large host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mnemospark.functions.notation import key
from mnemospark.store import Scratch

#: Distinct texts of a host that must share a line before it is boilerplate: at least so many,
RECURRENT = 5
#: and this share of them, so that it does not depend on the size of the corpus.
SHARE = 0.02
#: Characters of unexplained text that a title or page furniture may have.
FURNITURE_CHARS = 60
#: Longest sentence that is compared with the messages, which are shorter; longer ones can only be invented Latin or repetition.
SENTENCE_CHARS = 1_000

# ---------------------------------------------------------------- slots

_NAME = r"[^\W\d][\w.]*"
_SLOT = re.compile(
    "|".join(
        [
            r"\{\{\{?\s*" + _NAME + r"(?:\s*\|[^{}\n]{0,40})?\s*\}\}\}?",
            r"[$#]\{\s*" + _NAME + r"\s*\}",
            r"\{%-?\s*" + _NAME + r"[^{}\n]{0,40}%\}",
            r"(?<![\w{$#\\])\{(?:" + _NAME + r"|\d{1,2})\}(?!\})",
            r"<%[=-]?\s*[^%\n]{1,60}%>",
            r"@@" + _NAME + r"@@",
            r"‹\s*" + _NAME + r"\s*›",
            r"(?<![\w%])%\(" + _NAME + r"\)[sdif]\b",
            r"(?<![\w%])%(?:[A-Z][A-Z_0-9]*|[^\x00-\x7f\s%]{1,12})%",
            r"(?<![\w%])%[sd](?!\w)",
            r"(?<![\w$])\$(?:[A-Z][A-Z_0-9]*|[^\x00-\x7f\s$]{1,12})\$",
            r"\[\[\s*" + _NAME + r"\s*\]\]",
            r"\[(?:INSERT|insert|Insert|YOUR|your|Your|ENTER|Enter|TODO|ADD|Add)\s+[^\]\[\n]{1,40}\]",
            r"<(?:insert|INSERT|your|YOUR|enter|ENTER)\s+[^<>\n]{1,40}>",
            r"<(?:[A-Z][A-Z]*_[A-Z_]*|[A-Z]{3,})>(?!.{0,200}</)",
            r"<[^\x00-\x7f\s<>]{1,12}>",
            r"(?<![\w_])__[A-Z][A-Z_0-9]*__(?![\w_])",
            r"(?<![\w_])__[^\x00-\x7f_]{1,12}__",
            r"(?<![\w_])_{5,}(?![\w_])",
            r"\[object Object\]",
            r"(?<![\w'\"`./])undefined(?!['\"`\w])(?!\s+(?:behaviou?r|variable|reference|function|symbol|value|method|type|property|state|index))",
        ]
    )
)
# a name in title case in brackets, within a sentence; keys of a keyboard and days are none
_BRACKETED = re.compile(r"\[([A-Z][\w.]*(?: [A-Z][\w.]*){0,3}|[^\x00-\x7f\]\[\s]{1,8})\]")
_NO_SLOT = re.compile(
    r"(?:Insert|Enter|Esc|Escape|Tab|Shift|Ctrl|Control|Alt|Delete|Del|Home|End|Space|Return|Back|Backspace|F\d+|INFO|WARN|DEBUG|ERROR|"
    r"Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|January|February|March|April|May|June|July|August|September|October|November|December)$",
    re.I,
)
# words that say that a template is spoken about
_SPOKEN = re.compile(r"(?i)\b(?:such as|slots?|braces|placeholders?|templates?|mustache|syntax|variables?|called|written as|notation|escaped|literal(?:ly)?|the string|the token|the tag)\b[^.!?\n]{0,60}$")
_EXPLAINED = re.compile(r"(?i)^[^.!?\n]{0,40}\b(?:stands? for|means|is a (?:placeholder|slot|variable)|are (?:filled|replaced)|is (?:filled|replaced)|placeholders?|in the (?:old )?(?:log )?format)\b")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<(?:code|pre)>.*?(?:</(?:code|pre)>|\Z)", re.S)
_FENCED = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
#: Stands for quoted code where evidence is read: content that is no furniture.
_QUOTED = " quoted code " + "x" * FURNITURE_CHARS + " "
#: Characters before a slot in which a statement of code makes the line code.
_LINE_BEFORE = 200
#: What any slot begins with.
_SLOT_START = re.compile(r"[{$#<@‹%\[_]|undefined")
_CODE_MARK = re.compile(r"`|~~~|</?(?:code|pre)>")
_QUOTED_LINE = re.compile(r"(?:return|def|import|print|export|echo|curl|const|let|var|raise|if|for)\b.*[(){}=;]")


def _prose(text: str) -> str:
    """The text without fenced, inline and indented code."""
    return _CODE.sub(" ", text) if "`" in text or "~~~" in text or "<code" in text or "<pre" in text else text


def _spoken_of(prose: str, m: re.Match) -> bool:
    """Whether the words around a slot say that it is only spoken about."""
    return bool(_SPOKEN.search(prose[max(0, m.start() - 90) : m.start()]) or _EXPLAINED.match(prose[m.end() : m.end() + 90]))


def has_slot(text: str) -> bool:
    """Whether prose has a slot that should have been filled and was not."""
    if not _SLOT_START.search(text):
        return False
    prose, at = _prose(text), 0
    while start := _SLOT_START.search(prose, at):
        m = _SLOT.match(prose, start.start())
        at = m.end() if m else start.start() + 1
        if not m:
            continue
        if m[0].startswith("{"):
            before = prose[max(0, m.start() - _LINE_BEFORE) : m.start()]
            if _QUOTED_LINE.search(before[before.rfind("\n") + 1 :]):
                continue
        if not _spoken_of(prose, m):
            return True
    for m in _BRACKETED.finditer(prose):
        before, after = prose[max(0, m.start() - 20) : m.start()], prose[m.end() : m.end() + 20]
        alone = (m.start() <= 20 or "\n" in before) and not before[before.rfind("\n") + 1 :].strip() and not after.split("\n", 1)[0].strip() and (len(after) < 20 or "\n" in after)
        if alone or _NO_SLOT.match(m[1]) or after[:1] in ("(", ":", "["):
            continue
        if not _spoken_of(prose, m):
            return True
    return False


# ---------------------------------------------------------------- whole messages
# Sentences are compared in lower case, with single blanks and without list marks.

_THING = r"(?:(?:the|this|your|that|my|our) )?(?:[\w'-]{1,40} ){0,3}[\w'-]{1,40}(?: you (?:asked for|requested|are looking for))?"
_STATUS = r"(?:internal server error|bad gateway|bad request|not found|page not found|service (?:temporarily )?unavailable|gateway time-?out|forbidden|unauthori[sz]ed|too many requests|request time-?out|gone|conflict|method not allowed|payment required|access denied|server error|error)"
_ERROR = [
    r"(?:http |error |status |code |http error |http status )*[45]\d\d(?:\s*[-–—:|]?\s*" + _STATUS + r".{0,160}| [-–—:|] .{0,120})?",
    r"(?:http|error|http error|http status) [45]\d\d\b.{0,160}",
    r"(?:error|fehler|erreur|código|错误|错误代码|错误码|エラー|error code|código de error|erreur http)\s*[::#]?\s*\(?[45]\d\d\)?",
    r"(?:oops|uh-oh|sorry|whoops|oh no|hmm)(?:[,!. ].{0,50})?",
    r"sorry about that.{0,60}",
    r"(?:internal server error|bad gateway|gateway time-?out|service unavailable|bad request|not found|page not found|forbidden|unauthorized|access denied|permission denied|access to .{1,40} (?:is|was) denied|request timed? ?-?out|too many requests|method not allowed|something went wrong|an (?:unexpected )?error (?:has )?occurred|unexpected error|connection (?:refused|reset|timed out|failure)|service temporarily unavailable)(?:\b.{0,40})?",
    _THING + r" (?:could not|cannot|can not|can't|couldn't) be (?:found|loaded|opened|reached|retrieved|displayed|decoded|read|processed|completed|fetched)(?: (?:right now|at the moment|at this time|just now))?",
    _THING + r" (?:failed|failed with an? .{0,30}error|did not respond|didn't respond|does not respond|is not responding|took too long(?: to (?:answer|respond|load))?|timed out|was refused|was denied|was rejected by the server|is hidden from your account|(?:is|was) (?:not|no longer|currently not|temporarily not|temporarily un|currently un|un) ?(?:available|valid|accessible|reachable)|has been (?:moved|deleted|removed)(?: or (?:moved|deleted|removed))*|has expired|have expired|does not exist|doesn't exist|no longer exists|is down(?: for maintenance)?|is under maintenance|is closed for maintenance)(?: (?:right now|at the moment|at this time))?",
    r"(?:the |our |this )?(?:store|site|server|service|system|page|archive) is (?:down|offline|busy|overloaded).{0,40}",
    r"you (?:do not|don't) have (?:permission|access|the rights?)\b.{0,60}|you are not (?:allowed|authori[sz]ed)\b.{0,60}",
    r"(?:rate limit|quota|usage limit|limit)\b.{0,20}\b(?:reached|exceeded|used up|hit)\b.{0,50}",
    r"too many (?:people|requests|users|visitors|connections)\b.{0,60}",
    r"(?:failed|unable|could not|cannot|can't) (?:to )?(?:load|decode|open|fetch|render|read|connect|find|retrieve|display|reach|get)\b.{0,60}",
    r"no response from (?:the )?(?:model|server|upstream|backend|host|service|store|api|database|provider)\b.{0,60}|context length exceeded|upstream (?:connect error|did not answer|request timeout)\b.{0,80}|.{0,40}reset before headers.{0,40}|reset reason:.{0,50}",
    r"(?:export|import|download|upload|render(?:ing)?|request|job|sync) (?:aborted|cancelled|canceled|failed|timed out|interrupted)\b.{0,60}",
    r"we are (?:looking into|investigating|working on|aware of) (?:a|the|this|an) (?:problem|issue|error)\b.{0,40}",
    r"traceback \(most recent call last\)\s*:?",
    r"(?:[\w$]+\.)*[a-z]*(?:error|exception)(?:\s*:.{0,100})?(?<!an error)(?<!the error)(?<!error 5)",
    r"(?:caused by: )?(?:[a-z_$][\w$]*\.)+[\w$]*(?:exception|error)\b.{0,100}",
    r"at (?:[\w$<>]+\.)+[\w$<>]+\([^)]*\)",
    r"file \"[^\"]+\", line \d+(?:, in \S+)?|\w+ = \w[\w.]*\(.*\)|(?:return|raise|yield) \w[\w.]*\(?.{0,60}|panic: .{0,80}|segmentation fault.{0,40}|fatal: .{0,80}|errno \d+.{0,40}",
    r"e(?:rr)?(?:or)?[_-][a-z_0-9-]+\s*:.{0,100}",
    r"\{.{0,40}[\"'](?:error|errors|ok|status|code|detail|message|exception)[\"']\s*:.{0,200}\}",
    r"<(?:error|html|!doctype|\?xml)\b.{0,20}>.{0,300}(?:[45]\d\d|error|denied|unauthorized|forbidden|not ?found|no ?such|expired|unavailable|timeout|throttl|slow ?down).{0,300}",
    # German, French, Spanish
    r"(?:die |diese )?(?:seite|notiz|datei|ressource|sitzung|adresse)\b.{0,30}(?:nicht gefunden|nicht verfügbar|abgelaufen|nicht geladen|existiert nicht).{0,40}",
    r"zugriff verweigert.{0,40}|interner serverfehler.{0,40}|(?:der|die|das) (?:dienst|server|seite|speicher) ist (?:derzeit|zurzeit|momentan|gerade|vorübergehend) nicht (?:erreichbar|verfügbar).{0,40}|ein (?:unerwarteter )?fehler ist aufgetreten.{0,40}|.{0,20}konnte nicht geladen werden|ihre sitzung ist abgelaufen",
    r"(?:page|note|session|ressource|adresse) (?:introuvable|non trouvée|inaccessible|indisponible|expirée).{0,30}|le serveur a répondu avec (?:le code|une erreur).{0,30}|accès (?:refusé|interdit).{0,40}|(?:votre|la) session a expiré|(?:le|ce) (?:service|serveur|site) est (?:momentanément|actuellement|temporairement) (?:indisponible|inaccessible).{0,60}|erreur (?:interne|inattendue).{0,40}|une erreur (?:est survenue|s'est produite).{0,40}",
    r"página no encontrada.{0,30}|acceso (?:denegado|prohibido).{0,30}|error (?:interno|inesperado)(?: del? servidor)?.{0,30}|(?:el|este) (?:servicio|servidor) no está disponible.{0,50}|(?:su|la|tu) sesión ha (?:caducado|expirado).{0,30}|(?:se ha producido|ha ocurrido) un error.{0,30}|no se (?:pudo|ha podido) cargar.{0,40}",
    # Chinese, Japanese
    r".{0,12}(?:您访问的)?(?:页面|网页|笔记|内容)(?:不存在|未找到|找不到|无法显示|已被删除|加载失败).{0,12}|(?:服务器|系统)(?:内部)?(?:错误|繁忙|异常|维护中).{0,14}|(?:登录|会话|链接)已(?:过期|失效).{0,14}|(?:访问被拒绝|拒绝访问|没有权限|无权访问).{0,14}|错误代码[::]?\s*\d+|请求(?:超时|失败|过多).{0,14}",
    r"(?:ページ|記事|メモ|ファイル)が?(?:見つかりません|存在しません|表示できません).{0,14}|アクセスが?(?:拒否されました|できません).{0,10}|(?:サーバー|内部|システム)エラー.{0,20}|セッションの?(?:有効期限が切れました|が切れました).{0,14}|(?:ただいま|現在).{0,12}(?:利用できません|メンテナンス中です?).{0,10}|エラーが発生しました.{0,14}",
]
_SCRIPT = [
    r"(?:<noscript>\s*)?(?:please |kindly )?(?:enable|activate|turn on|switch on|allow|unblock|permit) (?:java ?script|scripts?|js)\b.{0,110}",
    r"(?:<noscript>\s*)?(?:please )?(?:turn|switch) (?:java ?script|scripts?|js) (?:back )?on\b.{0,90}",
    r"(?:you|we) (?:need|have) to (?:enable|activate|turn on|switch on|allow) (?:java ?script|scripts?|js)\b.{0,90}|you must (?:enable|activate|allow) (?:java ?script|scripts?|js)\b.{0,90}",
    r"(?:java ?script|scripts?|js)(?: and cookies| support)? (?:is|are|must be|has to be|have to be|needs to be|need to be|seems to be|appears to be) (?:switched |turned |currently )?(?:on|off|required|needed|disabled|blocked|enabled|necessary|unavailable|inactive|missing)\b(?! or off).{0,90}",
    r"your browser (?:has to|must|needs to|does not|doesn't|has|is) .{0,30}(?:java ?script|scripts?|js)\b.{0,110}",
    r"(?:<noscript>\s*)?(?:this|the) [\w -]{1,30}? (?:(?:does not|doesn't|won't|will not|cannot|can't) (?:work|run|load|open|display)|(?:only )?(?:works?|runs?|needs?|requires?|loads?|relies on|depends on))\b.{0,30}(?:java ?script|scripts?|js)\b.{0,60}",
    r"we (?:noticed|detected|see|found) that (?:java ?script|scripts?|js)\b.{0,60}",
    r"(?:loading|checking|opening|preparing)\b.{0,60}(?:java ?script|scripts?)\b.{0,50}|checking your browser\b.{0,50}",
    r"(?:no|without) (?:java ?script|scripts?|js)[,:].{0,60}|<noscript>.{0,200}",
    r"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:java ?script|skripte)\b.{0,60}|.{0,60}(?:java ?script|skripte|scripting)\b.{0,40}(?:aktivieren|einschalten|erlauben|zulassen|eingeschaltet|aktiviert|deaktiviert|erforderlich).{0,50}|(?:diese|die) (?:seite|notiz|anwendung|ansicht) (?:benötigt|braucht|erfordert|funktioniert nur mit) (?:java ?script|skripte)\b.{0,50}|bitte (?:im browser )?(?:einschalten|aktivieren).{0,30}",
    r"(?:veuillez )?(?:activer|activez|autoriser|autorisez) (?:java ?script|les scripts)\b.{0,60}|cet?t?e? (?:page|note|site|application) (?:a besoin d|nécessite|requiert|ne fonctionne pas sans).{0,10}(?:java ?script|scripts?)\b.{0,50}|(?:java ?script|les scripts?) (?:est|sont) (?:désactivée?s?|requis|bloquée?s?|nécessaires?).{0,40}",
    r"(?:por favor,? )?(?:active|activa|habilite|habilita|permita) (?:java ?script|los scripts)\b.{0,60}|est[ae] (?:página|nota|sitio|aplicación) (?:necesita|requiere|no funciona sin) (?:java ?script|scripts?)\b.{0,50}|(?:java ?script|los scripts?) (?:está|están) (?:desactivados?|bloqueados?).{0,40}",
    r".{0,12}(?:启用|开启|打开|允许|激活)\s*(?:java ?script|脚本).{0,20}|.{0,16}(?:禁用|关闭|屏蔽)了?\s*(?:java ?script|脚本).{0,20}|.{0,10}(?:需要|必须)(?:启用|开启)?\s*(?:java ?script|脚本).{0,20}",
    r".{0,20}(?:java ?script|スクリプト)を?(?:有効|オン|許可)に?(?:して|する|してください).{0,20}|.{0,20}(?:java ?script|スクリプト)が(?:無効|オフ|必要|ブロック).{0,20}",
]
_FILLER = [
    r"lorem ipsum\b.{0,200}",
    r"(?:this is |here is )?(?:a |some |just |only )?(?:placeholder|filler|dummy|sample|example|mock)(?: body)? ?(?:text|copy|content|paragraph|title|subtitle|body|sentence|summary|data|entry|note|profile text|session title)(?: (?:for|goes|only|here|that|which|to be|until|and)\b.{0,80})?",
    r"(?:sample|example|dummy|placeholder) [\w-]{1,40}(?: [\w-]{1,40}){0,2} ?",
    r"(?:the )?[\w' -]{1,30} (?:will be added later|goes here|to be (?:added|written|filled in|announced|determined)(?: later)?|coming soon|will follow(?: later| soon)?)(?:\s*\(.{0,40}\))?",
    r"content coming soon\b.{0,40}|coming soon.{0,30}|under construction.{0,40}|this is where the [\w' -]{1,30} goes",
    r"(?:write|add|enter|type|put|insert|describe|paste) (?:your|a|an|the|some) [\w' -]{1,30} here.{0,40}",
    r"(?:todo|fixme|tbd|tba)\s*[:–-]\s*(?:write|add|fill|insert|complete|finish|describe)(?: in)?(?: the| a| an| this)? [\w' -]{1,25}",
    r"[-–—*_\s]*(?:nothing here yet|no content yet|[\w' ]{1,25} pending|text (?:follows|missing)|content pending|intentionally left blank|this (?:page|section|space) (?:is )?(?:intentionally )?(?:left )?blank)[-–—*_\s]*",
    r"(?:replace|delete|overwrite|remove|change) this (?:hint|line|paragraph|text|sentence|copy|note|section)\b.{0,60}|this copy (?:only|just) fills the space.{0,30}|keep it short",
    r"(?:hier steht (?:später|bald|dann) (?:der|die|das|ein) [\wäöüß -]{1,20}|(?:dies ist )?(?:nur )?(?:ein )?(?:blindtext|beispieltext|platzhaltertext|mustertext|fülltext)(?: (?:ohne|für|hier|bitte)\b.{0,50})?|platzhalter(?: für .{0,30})?(?:, bitte (?:ersetzen|ändern|löschen))?|(?:text|inhalt) folgt(?: später| in kürze)?)",
    r"(?:(?:faux texte|texte (?:à remplacer|de remplissage|d'exemple|ici|provisoire))\b.{0,60}|ce paragraphe ne sert qu.{0,40}|(?:le )?(?:texte|contenu) (?:à venir|viendra plus tard).{0,20})",
    r"(?:texto (?:de relleno|aquí|de ejemplo|provisional|de prueba)\b.{0,50}|sustituir por .{0,30}|(?:contenido|texto) (?:pendiente|próximamente).{0,20}|escriba (?:su|aquí).{0,30})",
    r"(?:此处|这里|在此处?)(?:填写|输入|放置|添加|插入)(?:正文|内容|摘要|标题|文字|笔记|.{1,6})|请在(?:这里|此处)(?:输入|填写|添加).{0,24}|(?:待补充|待填写|占位文字?|占位符|示例文(?:字|本)|(?:内容|正文)待(?:补充|定|更新)|敬请期待).{0,10}",
    r"ここに.{0,10}(?:入力|記入|記載|書いて)(?:して)?(?:ください)?.{0,8}|(?:ダミー|サンプル|仮の?)(?:テキスト|文章|本文).{0,14}|(?:準備中|未入力|記入例)(?:です)?",
]
# short phrases that go with a message and are nothing by themselves
_SUPPORT = [
    r"(?:please )?(?:try|retry|reload|refresh|check|go back|come back|return|wait|contact|sign in|log in|report|restart)\b.{0,90}",
    r"(?:request|reference|trace|incident|error|ray|correlation|event|session|ticket)[ -]?(?:id|code|number|no\.?)?\s*[:#]?\s*[0-9a-f-]{4,40}",
    r"(?:code|status|reference|request|trace|id)\s*[:=#]\s*\S{1,40}|\(?[45]\d\d\)?|http \d{3}|reload|refresh|back|home|notice|error|warning|note|loading|please wait",
    r"otherwise .{0,50}|without (?:them|it|scripts|java ?script)\b.{0,50}|cookies are .{0,30}|this may take .{0,40}|we will be back.{0,30}|we apologi[sz]e.{0,50}|sorry for .{0,50}|no [\w ]{1,25} for now|nothing was (?:written|saved|changed)|two or three lines are enough|it will .{0,40}shortly",
    r"bitte (?:prüfen|melden|versuchen|laden|warten)\b.{0,70}|versuchen sie es\b.{0,60}|(?:veuillez|merci de|réessayez|vérifiez|reconnectez)\b.{0,70}|(?:vuelva|inténtelo|intente|inicie|recargue|compruebe|póngase)\b.{0,60}",
    r"请?(?:稍后|重新|返回|刷新|检查|联系).{0,24}|抱歉.{0,4}|(?:しばらく|もう一度|再度|ホーム|時間をおいて).{0,24}",
    r"#+\s*.{0,30}|\[[^\]]{1,30}\]|<[^<>]{1,60}>|[-–—=*_·•|.\s…]+",
]
_FULL = {k: re.compile("(?:" + "|".join(f"(?:{p})" for p in ps) + r")[\s.!。!…]*", re.S) for k, ps in (("error", _ERROR), ("script", _SCRIPT), ("filler", _FILLER), ("support", _SUPPORT))}
_BLANKS = re.compile(r"\s+")
_ENDS = re.compile(r"(?<=[.!?…])\s+|(?<=[。!?])")
_MARK = re.compile(r"^(?:(?:[-*•·>#]+|\d+[.)]|\[\w{1,20}\])\s+)+|^\*\*|\*\*$")
_TITLED = re.compile(r"^(.{1,30}?)\s*[-–—:|]\s+(.+)$")
_WORD = re.compile(r"\w+")


#: Beginnings of the words of the usual Latin filler text.
_STEMS = (
    "lorem", "ipsum", "dolor", "amet", "consect", "adipisc", "elit", "tempor", "incidid", "labor", "magna", "aliqu", "veniam", "nostrud",
    "exercit", "ullamc", "commod", "consequ", "duis", "aute", "irure", "reprehend", "volupt", "velit", "cillum", "fugiat", "pariat",
    "except", "occaecat", "cupidat", "proident", "culpa", "offici", "deserunt", "mollit", "laborum", "vestib", "ferment", "ultric",
    "sodal", "praes", "mollis", "nunquis", "velmor", "curabit", "pellent", "phasell", "vivam", "integer", "quisque", "maecen", "suspend",
)
_STEM = re.compile(r"(?<!\w)(?:" + "|".join(_STEMS) + ")")


def _filling(line: str) -> bool:
    """Whether a line only says the same few words, or one letter, again and again, or is the invented Latin of filler text.

    Invented Latin has many words, and its known stems among them.
    """
    words = _WORD.findall(line)
    if len(words) < 4:
        bare = line.replace(" ", "")
        return len(bare) >= 12 and len(set(bare)) <= 2 and (bare.isalnum() or set(bare) <= set("….,"))
    kinds = len(set(words))
    if kinds <= 3 and kinds * 3 <= len(words) and max(map(len, words)) <= 14:
        return True
    return len(words) >= 5 and len(_STEM.findall(line)) * 5 >= len(words) * 2


def _kind(sentence: str) -> str | None:
    """The kind of message that a whole sentence is."""
    if len(sentence) > SENTENCE_CHARS:
        return None
    for k, p in _FULL.items():
        if p.fullmatch(sentence):
            return k
    return None


def _evident(line: str) -> str | None:
    return "filler" if _filling(line) else _kind(line)


def _plain(line: str) -> str:
    """A line in lower case, with single blanks and without list marks."""
    return _MARK.sub("", _BLANKS.sub(" ", line).strip()).lower()


def residual(lines: list[str], boilerplate: list[bool] | None) -> list[str]:
    """The lines without boilerplate; a recurring line that is a message, has a slot or marks code is kept."""
    if not boilerplate or not any(boilerplate):
        return lines
    return [x for x, known in zip(lines, boilerplate, strict=True) if not known or _CODE_MARK.search(x) or _evident(_plain(x)) or has_slot(x)]


def evidence(lines: list[str], furniture: int = FURNITURE_CHARS) -> dict[str, int]:
    """Characters of evidence by kind of a residual that has no content; empty if it has content.

    Content is more than ``furniture`` characters, or more than twice the evidence and
    40, in sentences that are neither evidence nor go with it.
    """
    text = "\n".join(lines)
    prose = _FENCED.sub(_QUOTED, text) if "`" in text or "~~~" in text else text
    raw, again = prose.splitlines(), None
    found: dict[str, int] = {}
    left = 0
    for line in map(_plain, raw):
        if not line:
            continue
        often = False
        if len(line) <= 30 and len(raw) >= 3:
            if again is None:
                again = Counter(filter(None, map(_plain, raw)))
            often = again[line] >= 3 and again[line] * 2 >= again.total()
        sentences = _ENDS.split(line)
        if often or (kind := _evident(line)):
            kind = "filler" if often else kind
            found[kind] = found.get(kind, 0) + len(line)
            continue
        other = 0
        for s in sentences:
            s = _MARK.sub("", s.strip())
            if not s:
                continue
            kind = _evident(s) if len(sentences) > 1 or s != line else None
            if not kind and len(s) <= SENTENCE_CHARS and (m := _TITLED.match(s)):
                kind = _kind(m[2])
            if kind:
                found[kind] = found.get(kind, 0) + len(s)
            else:
                other += len(s) + (other > 0)
                if left + other > furniture:
                    return {}
        left += other
    return found if left <= 2 * sum(found.values()) + 40 else {}


def verdict(lines: list[str], boilerplate: list[bool] | None = None) -> str | None:
    """Why a document is to be excluded: slot, error, script or filler; None if it is not."""
    rest = residual(lines, boilerplate)
    if has_slot("\n".join(rest)):
        return "slot"
    found = evidence(rest)
    kinds = [k for k in ("error", "script", "filler") if k in found]
    return max(kinds, key=found.__getitem__) if kinds else None


def _normal(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), r"[0-9]+", "#")


#: What ``\\R`` stands for in the JVM.
_BREAK = re.compile(r"\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")


def _lines() -> Column:
    return F.split("text", r"\R")


def _host() -> Column:
    return F.coalesce(key("source"), F.lit(""))


def _hash(line: Column) -> Column:
    """The hash of a line's normal form; null for a blank line."""
    n = _normal(line)
    return F.when(n != "", F.xxhash64(n))


def line_counts(documents: DataFrame, least: int = RECURRENT, share: float = SHARE) -> DataFrame:
    """(host, lines): the hashes of the normalised lines of at least ``least`` texts of a host and ``share`` of them.

    Identical texts of a host count once.  Hosts without such lines have no row.
    """
    hashes = F.array_distinct(F.filter(F.transform(_lines(), _hash), lambda x: x.isNotNull()))
    texts = (
        documents.filter("text is not null")
        .select(_host().alias("host"), F.xxhash64("text").alias("same"), hashes.alias("lines"))
        .groupBy("host", "same").agg(F.any_value("lines").alias("lines"))
    )
    # the row without a line counts the texts of the host
    counts = texts.select("host", F.explode(F.concat("lines", F.array(F.lit(None).cast("bigint")))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = Scratch(documents.sparkSession, "lines").keep(counts.filter(f"n >= {least} or line is null"))
    sizes = counts.filter("line is null").select("host", F.col("n").alias("of"))
    often = counts.filter(F.col("n") >= least).filter("line is not null").join(sizes, "host").filter(F.col("n") >= share * F.col("of"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def _marked(documents: DataFrame, *columns: str) -> DataFrame:
    """The documents' columns, then ``_text``, null if blank, and ``_known``: which lines of it are boilerplate of its host, null if none is."""
    hosts = Scratch(documents.sparkSession, "hosts").keep(line_counts(documents)).toDF("_host", "_often")
    with_host = documents.select(*columns, F.when(F.trim("text") != "", F.col("text")).alias("_text"), _host().alias("_host"))
    known = F.transform(F.split("_text", r"\R"), lambda x: F.coalesce(F.array_contains("_often", _hash(x)), F.lit(False)))
    joined = with_host.join(hosts, "_host", "left").withColumn("_known", F.when(F.col("_often").isNotNull(), known))
    return joined.select(*columns, "_text", F.when(F.array_contains("_known", True), F.col("_known")).alias("_known"))


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the reason in place of the last two columns."""
    for batch in batches:
        n = batch.num_columns - 2
        reasons = [verdict(_BREAK.split(x), y) if x else None for x, y in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(reasons, pa.string())], names=[*batch.schema.names[:n], "_reason"])


def judged(documents: DataFrame) -> DataFrame:
    """(doc_id, reason) of the documents to exclude; reason is slot, error, script or filler.

    Null, empty and blank texts give no row; repeated rows of a document are judged each
    by itself and give one row.  The host is the source, compared stripped and in lower
    case; a missing source is a host of its own.
    """
    rows = _marked(documents, "doc_id").mapInArrow(_verdicts, "doc_id bigint, _reason string").filter("_reason is not null")
    return rows.groupBy("doc_id").agg(F.min("_reason").alias("reason"))


def kept(documents: DataFrame) -> DataFrame:
    """The documents without those to exclude, decided row by row where they are read.

    Documents without a text stay, as they are no cases.
    """
    schema = StructType([*documents.schema.fields, StructField("_reason", StringType())])
    return _marked(documents, *documents.columns).mapInArrow(_verdicts, schema).filter("_reason is null").drop("_reason")
