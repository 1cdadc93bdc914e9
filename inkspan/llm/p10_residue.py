"""Problem 10: template residue and error-page text.

Method: one multi-pattern automaton holds the phrases of error, access, session, maintenance and
script notices, of filler text and of program output, and the opening signs of placeholders.  Phrases
are made from families of a subject and what is said of it, in English, Japanese, French,
German, Spanish, Russian, and Chinese in simplified and traditional characters.
A hit counts if phrases cover most of the sentence or line they stand in: a text that speaks of such a
page has them in a longer sentence or within quotation marks.  The cover is taken of the sentence or
line, not of the document, because residue within content counts too.  An unfilled placeholder counts
wherever it stands, unless it alone is quoted.  Dummy Latin is a sentence of words with Latin endings
and without a function word of a living language.

Defined cases: null, '' and blank texts are no case; signs of a manuscript's gaps and editorial brackets
are none either.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# Families of phrases of notices, in lower case: each of the first with each of the second, and so on.
FAMILIES = [
    # English
    ("page|file|resource|document|article|chapter|content|url|link|site|website|record|post|entry", " was | is | could | can | has | does | | may ", "not found|not be found|be found|no longer exists|not exist|not available|unavailable|no longer available|been removed|been deleted|been moved|have been moved|have been removed|not be loaded|failed to load|not be served|not be displayed|missing|moved or removed|isn't working|not working"),
    ("can't |cannot |can not |could not |couldn't |unable to |failed to ", "find |locate |load |open |display |connect to |reach |fetch |read |serve ", "the page|this page|that page|the requested page|the file|the server|the site|the database|the resource|page|file|server|resource|content|data|shard|chapter|database"),
    ("could not be |cannot be |can't be |couldn't be ", "", "found|loaded|displayed|opened|located|served|reached"),
    ("access |permission |request |login |authorization ", "denied|forbidden|rejected|required|failed|was denied|is denied|timed out|timeout"),
    ("you do not have |you don't have |you have no |insufficient |missing ", "permission|permissions|access|access rights|authorization|the rights"),
    ("you are not |not |you must be |you need to be ", "authorized|authorised|logged in|signed in|allowed to view|allowed to access"),
    ("please |you must |you need to |", "log in |sign in |log back in |login |sign in again |log in again ", "to continue|to keep reading|to view|to access|to read|to proceed|first|again"),
    ("session |login |token |link |password |certificate ", "has expired|expired|has timed out|timed out|is no longer valid|is invalid|is not valid"),
    ("down for |under |undergoing |closed for |offline for |unavailable due to ", "maintenance|scheduled maintenance|planned maintenance|repairs|construction"),
    ("temporarily |currently ", "unavailable|offline|out of service|down|closed|suspended"),
    ("internal server |unexpected |unknown |application |database |server |network |runtime |fatal |syntax |parse |critical |script |connection ", "error|failure|exception"),
    ("an error |a problem |an unexpected error |an internal error |a fatal error ", "occurred|has occurred|was encountered"),
    ("something |whoops, something |oops, something ", "went wrong|has gone wrong|is broken"),
    ("connection |request |operation |gateway |query ", "refused|reset|timed out|timeout|closed|aborted|failed"),
    ("unexpected end of |premature end of ", "stream|file|input|data|json|document"),
    ("bad gateway|service unavailable|too many requests|rate limit exceeded|error establishing a database connection|verify you are human|complete the captcha|checking your browser|unusual traffic|request blocked|slow down and retry", ""),
    ("enable |turn on |activate |allow |switch on ", "|your browser's ", "javascript|js|scripts|scripting|cookies|javascript and cookies|cookies and javascript|cookies and scripts|scripts and cookies"),
    ("javascript |scripting |js |cookies |scripts |your browser has javascript ", "", "is disabled|are disabled|disabled|is required|are required|required|must be enabled|is turned off|are turned off|turned off|is not enabled|are not enabled|is not supported|to run this|to view this|to use this"),
    ("requires |needs |relies on |depends on ", "", "javascript|js|scripts|scripting|cookies|a modern browser|cookies and scripts"),
    ("does not support |doesn't support |not support ", "", "javascript|js|scripts|scripting|cookies|frames|iframes"),
    ("disable |turn off |pause ", "|any |your ", "ad blocker|adblocker|ad block|adblock|ad blockers"),
    # Chinese
    ("页面|网页|该页|此页|本页|文件|内容|章节|篇章|文章|链接|资源|网址|帖子|记录|图片|数据|地址|作品|页", "|已经|已|暂时|可能已", "不存在|未找到|找不到|没有找到|被删除|删除|下架|下架或被删除|失效|过期|无法访问|无法打开|无法显示|加载失败|载入失败|走丢了|走丢|不见了|丢失|移除|移动|无法加载|打不开|出错|错误|不可用|迷路了"),
    ("找不到|未找到|没有找到|无法打开|无法显示|无法加载|无法访问|无法载入", "", "页面|网页|该页|此页|文件|内容|章节|文章|链接|资源|网址|记录|正文|数据"),
    ("服务器|系统|网络|数据库|网站|站点|程序|服务|接口|本站|后台", "|发生|出现|内部|暂时|正在|连接|运行|升级", "错误|出错|繁忙|异常|故障|开小差了|开小差|维护中|维护|升级中|升级|超时|失败|无响应|拒绝连接|不可用|暂停访问|暂停服务|打盹"),
    ("请求|连接|操作|加载|登录|登陆|会话|验证码|令牌|身份|网络", "|已|已经|请求", "超时|失败|过期|失效|过于频繁|太频繁|被拒绝|异常"),
    ("没有|无|缺少|您没有|你没有", "", "权限|访问权限|查看权限|权访问|权查看|权限查看|权限访问|权阅读"),
    ("禁止访问|拒绝访问|访问被拒绝|访问受限|访问过于频繁|访问太频繁|暂停访问|人机验证|安全验证|拖动滑块|完成拼图|请输入验证码|请完成验证|请勿频繁", ""),
    ("请|请您|请先|需|需要|请重新|重新", "", "登录|登陆", "|后查看|后继续|后阅读|后访问|后继续阅读|后重试"),
    ("启用|开启|打开|允许|使用|支持|禁用|禁用了|关闭|关闭了|已禁用|已关闭|不支持|不支持或已关闭|未启用|未开启|依赖|需要", "| ", "javascript|js|脚本|cookie|cookies|java script"),
    ("脚本|javascript|cookie", "|已|已被", "被禁用|禁用|关闭|未启用|未开启"),
    # Japanese
    ("ページ|ファイル|コンテンツ|記事|リンク|サイト|データ", "が|は|の", "見つかりません|見つかりませんでした|存在しません|表示できません|削除されました|利用できません|無効です|読み込みに失敗しました"),
    ("サーバー|サーバ|システム|ネットワーク|データベース|内部|予期しない|接続", "|で|に", "エラー|メンテナンス中|エラーが発生しました|接続できません|混み合っています"),
    ("アクセスが拒否されました|アクセス権限がありません|権限がありません|アクセスできません|ただいまメンテナンス中|メンテナンス中です|エラーが発生しました|有効期限が切れました|ログインしてください|再度ログイン|タイムアウトしました|ロボットではありません", ""),
    ("javascript|cookie|クッキー|スクリプト", "を|が|は| を | が | は ", "有効に|有効にして|オンに|許可して|無効に|無効です|必要です|無効になっています|オフに"),
    # French
    ("page|fichier|contenu|ressource|document|article|lien", " | est | n'est | a été | demandée est | demandé est ", "introuvable|non trouvée|non trouvé|supprimée|supprimé|indisponible|pas disponible|expiré|n'existe pas|n'existe plus"),
    ("accès refusé|accès interdit|accès non autorisé|erreur interne du serveur|erreur serveur|service indisponible|service temporairement indisponible|en maintenance|en cours de maintenance|session a expiré|session expirée|veuillez vous connecter|veuillez vous reconnecter|une erreur est survenue|une erreur s'est produite|délai d'attente dépassé|trop de requêtes|connexion refusée", ""),
    ("activer |activez |autoriser |autorisez ", "", "javascript|le javascript|les cookies|javascript et les cookies"),
    ("javascript est |javascript doit être |cookies sont ", "", "désactivé|désactivés|activé|requis|nécessaire"),
    # German
    ("seite|datei|inhalt|dokument|artikel|ressource|link", " | wurde | ist | konnte | existiert ", "nicht gefunden|nicht gefunden werden|nicht verfügbar|nicht vorhanden|nicht mehr verfügbar|gelöscht|entfernt|nicht geladen werden|nicht|nicht mehr|abgelaufen"),
    ("zugriff verweigert|keine berechtigung|interner serverfehler|serverfehler|dienst nicht verfügbar|wartungsarbeiten|wird gewartet|im wartungsmodus|sitzung ist abgelaufen|sitzung abgelaufen|bitte melden sie sich|bitte anmelden|ein fehler ist aufgetreten|zeitüberschreitung|zu viele anfragen|verbindung abgelehnt|nicht autorisiert", ""),
    ("aktivieren sie |aktiviere |bitte aktivieren sie |einschalten von ", "", "javascript|cookies|javascript und cookies"),
    ("javascript ist |javascript muss |javascript wird |cookies sind ", "", "deaktiviert|aktiviert|benötigt|erforderlich|aktiviert sein|aktiviert werden"),
    # Spanish
    ("página|archivo|contenido|recurso|documento|artículo|enlace", " | no | ha sido | solicitada no | solicitado no ", "no encontrada|no encontrado|encontrada|encontrado|existe|disponible|eliminada|eliminado|fue encontrada|se encuentra|se ha encontrado|caducado"),
    ("acceso denegado|no tiene permiso|no tienes permiso|error interno del servidor|error del servidor|servicio no disponible|en mantenimiento|sesión ha caducado|sesión ha expirado|sesión caducada|inicie sesión|inicia sesión|se ha producido un error|ha ocurrido un error|ocurrió un error|demasiadas solicitudes|tiempo de espera agotado|conexión rechazada|no se encuentra la página|no se pudo encontrar la página", ""),
    ("active |activar |activa |habilite |habilitar |habilita |permita ", "", "javascript|las cookies|javascript y las cookies|cookies"),
    ("javascript está |javascript debe estar |cookies están ", "", "desactivado|desactivadas|deshabilitado|habilitado|activado"),
    # Russian
    ("страница|файл|документ|материал|запись|статья|ссылка|ресурс", " | была | был | больше | временно ", "не найдена|не найден|не найдено|не существует|удалена|удален|удалён|недоступна|недоступен|перемещена"),
    ("доступ запрещен|доступ запрещён|нет доступа|недостаточно прав|внутренняя ошибка сервера|ошибка сервера|сервис недоступен|сервис временно недоступен|технические работы|ведутся работы|сессия истекла|срок действия сессии истек|войдите в систему|необходимо войти|авторизуйтесь|произошла ошибка|слишком много запросов|время ожидания истекло|соединение разорвано", ""),
    ("включите |включить |разрешите ", "", "javascript|cookies|скрипты|файлы cookie"),
    ("javascript |скрипты |cookies ", "", "отключен|отключён|отключены|выключен|необходим|должен быть включен"),
]
# Families of phrases of filler text.
FILLER = [
    ("placeholder |sample |dummy |filler |example ", "", "text|copy|paragraph|content|image|heading"),
    ("text |copy |content |body |title |description ", "", "goes here|to follow|here|to come|coming soon|to be added|to be supplied|to be announced"),
    ("replace this |insert your |add your |edit this |enter your |type your ", "", "paragraph|text|content|copy|section|heading"),
    ("chapter |page |section |entry |article |translation |text |content ", "has not been |is not |has yet to be |not |not yet ", "entered|written|uploaded|available|translated|added|ready", "| yet"),
    ("coming soon|under construction|to be determined|no content|nothing here yet|test test|testing testing|asdf asdf|qwerty|foo bar|blah blah|untitled document|hello world", ""),
    ("待", "", "补充|补|录入|添加|完善|更新|翻译|整理|定|编辑|填写"),
    ("译文|内容|正文|资料|本页|本篇内容|本章|页面|栏目", "|正在|尚在|尚未|暂未|暂", "整理中|建设中|建设|录入|编辑中|更新中|完善中|翻译中|上线|发布|缺|无"),
    ("占位|示例|样例|样本|测试|填充|演示", "", "内容|文字|文本|段落|数据|文章|标题|测试"),
    ("此处|这里|在此|请在此", "", "为占位|填写|输入|是正文|为正文|添加|放置|插入|是内容"),
    ("敬请期待|即将上线|即将推出|即将开放|稍后开放|暂无内容|暂无数据|暂无译文|暂无资料|请替换|请删除本段|（空）|(空)|无内容|施工中", ""),
    ("ダミー|サンプル|仮の|テスト", "", "テキスト|文章|文|画像|テスト"),
    ("準備中|工事中|近日公開|coming soon|ここにテキスト|内容がありません", "", "|です"),
    ("texte factice|texte de remplacement|texte d'exemple|faux texte|contenu à venir|bientôt disponible|en construction|votre texte ici", ""),
    ("blindtext|platzhaltertext|beispieltext|mustertext|inhalt folgt|in kürze verfügbar|ihr text hier|im aufbau|demnächst verfügbar", ""),
    ("texto de relleno|texto de ejemplo|texto de prueba|su texto aquí|tu texto aquí|próximamente|en construcción|contenido en preparación", ""),
    ("текст-заполнитель|пример текста|тестовый текст|рыба-текст|здесь будет текст|скоро здесь|раздел в разработке|страница в разработке", ""),
]
# Families of phrases of program output.
OUTPUT = [
    ("traceback (most recent call last)|exception in thread|segmentation fault|core dumped|stack trace|stack overflow|call stack|null pointer|out of memory|command not found|no such file or directory|division by zero|index out of range|index out of bounds|索引超出|空指针|堆栈溢出|内存不足|未处理的异常|未捕获的异常", ""),
    ("uncaught |unhandled |unexpected ", "", "exception|error|typeerror|referenceerror|rejection|token"),
    ("undefined |undeclared |unknown ", "", "index|variable|offset|method|function|property|reference|array key|column"),
]
# What is too common in other texts to count by itself; it only adds to a cover.
WEAK = """抱歉|对不起|很遗憾|请稍后再试|请稍后重试|稍后再试|请稍候|返回首页|点击重试|点击返回|刷新|请刷新|重试|如有疑问|请联系|管理员|客服|错误代码|错误码|请求编号|您访问的|您请求的|您要找的|您所访问的|您查看的|您的|当前|请检查|网址是否正确|检查网址|是否正确|继续阅读|继续访问|该分片|若长时间停留在此页|部分|不能显示|无法显示|浏览器|请在|本章|本文|本节|本条|内容|正文|译文
sorry|oops|whoops|please|try again|retry|later|in a few minutes|go back|go home|back to home|home page|request id|reference id|check back|check back later|contact|administrator|support|the requested|the page|the file|the chapter|you requested|you are looking for|you're looking for|on this server|refresh|reload|this page|your browser|right now|on our end|in your browser|to continue|at this time|and reload|view this|enable both|keep reading
申し訳ございません|しばらくしてから|もう一度|お試しください|お探しの|désolé|veuillez|réessayer|entschuldigung|bitte|versuchen sie es|lo sentimos|por favor|inténtelo|извините|пожалуйста|попробуйте|позже|not found|forbidden|unauthorized|bad request"""
# Simplified characters of the phrases above and their traditional forms.
TRADITIONAL = str.maketrans(
    "页网该档内节链结资图数据记录无访问显载归区过丢遗务错误统络库后台发现异开维护级时败应绝连态请权读验证码输匀频启闭脚布补译获编辑实测试这里为个从参专业执续阅点击还没览与国来说对长进门间户号几关阁动块尘暂处杂",
    "頁網該檔內節鏈結資圖數據記錄無訪問顯載歸區過丟遺務錯誤統絡庫後臺發現異開維護級時敗應絕連態請權讀驗證碼輸勻頻啟閉腳佈補譯獲編輯實測試這裡為個從參專業執續閱點擊還沒覽與國來說對長進門間戶號幾關閣動塊塵暫處雜",
)
# Words that any sentence of a living language has some of, and endings of Latin words.
LIVING = frozenset(
    "the of and to in is was were are be been that this these those with for on as his her its their they them he she we you him had has have not from by which who whom when then there into upon would could should will shall may might must but or nor if than"
    " de la le les un une des du et que qui dans pour sur pas el los las una y en por con para che il lo gli della di per non der die das und ist nicht ein eine zu mit von auf".split()
) - frozenset(("in", "de", "et", "per", "non", "la", "un"))
SPOKEN = re.compile(rf"\b(?:{'|'.join(sorted(LIVING))})\b", re.I)
INFLECTED = re.compile(r"(?:um|us|is|am|em|im|os|as|es|at|et|it|nt|nt?ur|ur|ae|or|ix|ex)$")
VOWEL_END = re.compile(r"[aeio]$")
# Words with which dummy Latin customarily begins.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat"
    " duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
# What a placeholder begins with or holds.
SIGNS = ["{{", "{%", "<%", "${", "#{", "@@", "__", "[[", "[your ", "[insert ", "待填", "todo", "此处填写", "<<", "&lt;", "%(", "%s", "%d", *("{%d}" % i for i in range(10)), "_name}", "{name}", "{title}"]
# The placeholders themselves.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<%[^<>\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|@@[^@\s]{1,40}@@|__[^\W\d_][^\s_]*(?:_[^\s_]+)*__|\[\[[^\[\]\n]{1,60}[:：]\s*待补\]\]"
    r"|\[(?:your|insert) [^\[\]\n]{1,40}\]|<[^<>\n]{0,40}待填>|[（(][^（()）\n]{0,40}todo[）)]|【此处填写[^【】\n]{0,40}】|<<[^<>\n]{1,40}>>|&lt;[^&\n]{1,40}&gt;|%\([^()\n]{1,40}\)[sd]|(?<![\d%])%[sd]|\{\d\}|\{[a-z]+(?:[_.][a-z]+)*\}",
    re.I,
)
# What a status line, an exception or a stack frame may hold beside its phrase.
STATUS = re.compile(r"(?:http/\d(?:\.\d)?|http status|error)?[ :]*\b[1-5]\d\d\b[ :\-–—]*(?:not found|forbidden|bad gateway|service unavailable|gateway timeout|internal server error|bad request|unauthorized)|(?:not found|forbidden|bad gateway|service unavailable|gateway timeout|internal server error|bad request|unauthorized) ?[（(]\d{3}[）)]")
QUOTES = {"“": "”", "「": "」", "『": "』", "‘": "’", '"': '"', "'": "'", "《": "》"}
#: Share of its sentence or line that matched text must cover.
COVER = 0.5
UNIT = re.compile(r"[\n。！？!?；;]|\.(?=\s|$)")
NOISE = re.compile(r"[\W\d_]")
WORDS = re.compile(r"[^\W\d_]+")
#: Names of exceptions, places in code and request numbers.
CODE = re.compile(r"\b\w*(?:exception|error)\b(?=[:：(（ ]|$)|\b(?:at|on|in|at or near) line \d+|\b\w+(?:\.\w+)+\([^()\n]{0,80}\)|\b[0-9a-f]{5,40}\b")
EXCEPTION = re.compile(r"\b[A-Za-z][a-z]+(?:[A-Z][a-z]+)*(?:Exception|Error)\b")
#: A line that an exception begins.
THROWN = re.compile(r"^[ \t]*(?:\w+\.)*[A-Za-z]+(?:Exception|Error): \S[^\n]*", re.M)
#: Words of a sentence from which it can be dummy Latin.
LATIN_WORDS = 4


def phrases(families: list[tuple[str, ...]]) -> Iterator[str]:
    """The phrases of families, Chinese ones in both kinds of characters."""
    for parts in families:
        for x in product(*(p.split("|") for p in parts)):
            phrase = re.sub("  +", " ", "".join(x)).strip()
            yield phrase
            if (other := phrase.translate(TRADITIONAL)) != phrase:
                yield other


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in phrases([(re.sub(r"\n", "|", WEAK), "")]):
        a.add_word(phrase, ("w", len(phrase)))
    for kind, listed in (("n", FAMILIES), ("f", FILLER), ("o", OUTPUT)):
        for phrase in phrases(listed):
            if len(phrase) > 1:
                a.add_word(phrase, (kind, len(phrase)))
    for sign in SIGNS:
        a.add_word(sign, (a.get(sign, ("", 0))[0] + "p", len(sign)))
    a.make_automaton()
    return a


def quoted(text: str, start: int, end: int) -> bool:
    """Whether the stretch alone, but for blanks and stops, stands in quotation marks."""
    while start > 0 and text[start - 1] in " 　":
        start -= 1
    while end < len(text) and text[end] in " 　.。，,":
        end += 1
    return start > 0 and QUOTES.get(text[start - 1]) == text[end : end + 1]


def dummy_latin(unit: str) -> bool:
    """Whether a sentence is made of Latin words and holds no function word of a living language."""
    if not unit.isascii() or SPOKEN.search(unit):
        return False
    words = WORDS.findall(unit)
    if len(words) < LATIN_WORDS or any(w[:1].isupper() for w in words[1:]):
        return False
    words = [w.lower() for w in words]
    known = sum(w in LOREM for w in words)
    inflected = sum(bool(INFLECTED.search(w)) for w in words)
    like = sum(w in LOREM or bool(INFLECTED.search(w) or VOWEL_END.search(w)) for w in words)
    return len(set(words)) > 2 and (known >= 0.8 * len(words) or (inflected >= 0.3 * len(words) and like >= 0.8 * len(words)))


def lowered(text: str) -> str:
    """Lower case of the same length, apostrophes straight."""
    low = text.lower()
    if len(low) != len(text):  # a few letters have longer lower-case forms
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low.replace("’", "'")


def is_residue(text: str | None, automaton: ahocorasick.Automaton) -> bool:
    """Whether a text, wholly or in part, is residue."""
    if not text:
        return False
    low = lowered(text)
    hits = [(last + 1 - n, last + 1, kind) for last, (kind, n) in automaton.iter(low)]
    whole = lambda a, b: not (low[a].isascii() and low[a].isalpha() and low[a - 1 : a].isalpha() and low[a - 1 : a].isascii() or low[b - 1].isascii() and low[b - 1].isalpha() and low[b : b + 1].isalpha() and low[b : b + 1].isascii())
    if any("p" in kind for *_, kind in hits) and any(not quoted(text, m.start(), m.end()) for m in PLACEHOLDER.finditer(text)):
        return True
    hits = [h for h in hits if h[2] != "p" and whole(h[0], h[1]) and not quoted(text, h[0], h[1])]
    if "Exception" in text or "Error" in text:
        if any(not quoted(text, m.start(), m.end()) for m in THROWN.finditer(text)):
            return True
        hits += [(m.start(), m.end(), "o") for m in EXCEPTION.finditer(text) if not quoted(text, m.start(), m.end())]
    ends = [m.end() for m in UNIT.finditer(low)] + [len(low)]
    latin = text.isascii() or re.search(r"(?:[A-Za-z]+[ ,]+){3}[A-Za-z]", text)
    if latin:
        at = 0
        for end in ends:
            if dummy_latin(text[at:end]):
                return True
            at = end
    # the hits of each sentence or line, and how much of it they cover
    of: dict[int, list[tuple[int, int, str]]] = {}
    for h in hits:
        u = bisect_right(ends, h[0])
        if h[1] <= ends[u]:
            of.setdefault(u, []).append(h)
    for u, mine in of.items():
        left, right = ends[u - 1] if u else 0, ends[u]
        mine += [(m.start(), m.end(), "n") for m in STATUS.finditer(low, left, right) if not quoted(text, m.start(), m.end())]
        if all(kind == "w" for *_, kind in mine):
            continue
        mine += [(m.start(), m.end(), "c") for m in CODE.finditer(low, left, right)]
        covered, done = 0, left
        for a, b, _ in sorted(mine):
            a = max(a, done)
            if b > a:
                covered += b - a - len(NOISE.findall(low, a, b))
                done = b
        if covered >= COVER * (right - left - len(NOISE.findall(low, left, right))):
            return True
    return False


def residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of (key, text) the rows whose text is residue, wholly or in part; a map without shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            keep = pa.array([is_residue(t, automaton) for t in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], names=[key])

    return df.select(key, text).mapInArrow(run, f"{key} long")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold residue."""
    return residue(table(spark, sf_dir, "documents"))


def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents without residue: id, source and length."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "n_chars").join(p10_found(spark, sf_dir), "doc_id", "left_anti")
