"""Residue detection on notices and on texts that speak of such things, none of them from the test data."""

from inkspan.llm import p10_residue

NOTICES = """Enable JavaScript and cookies to continue
Your browser does not support JavaScript.
Error establishing a database connection
404 页面未找到
该页面已被删除
網頁不存在
您沒有訪問權限
系統維護中，請稍後再試。
服务器内部错误，请稍后重试。
503 Service Temporarily Unavailable
HTTP 502 Bad Gateway
Sorry, the page you requested could not be found.
The document no longer exists.
We can't find the page you are looking for.
Your session has timed out. Please log in again.
Access denied. You do not have permission to view this page.
This site is down for scheduled maintenance.
An unexpected error has occurred.
Please verify you are human to continue.
Please turn on JavaScript in your browser.
JavaScript must be enabled to view this page.
Too many requests. Please try again in a few minutes.
Oops, something went wrong!
Fatal error: Uncaught TypeError in /srv/app/main.php on line 12
java.lang.IllegalStateException: stream closed
ValueError: could not convert string to float
Warning: Undefined variable in /var/www/x.php on line 8
Segmentation fault (core dumped)
Placeholder text
Your text goes here.
Coming soon!
This page is under construction.
Translation not available yet.
数据库连接失败
请求超时，请刷新重试
登录已过期，请重新登录
验证码已失效
您的浏览器不支持JavaScript，请启用后再访问。
请先登录后查看
本章内容待补充
译文正在整理中，敬请期待。
此处填写正文
示例文字
找不到该页面
访问受限
ページが見つかりません。
ただいまメンテナンス中です。
アクセス権限がありません
JavaScriptを有効にしてください。
ダミーテキスト
Page introuvable
Accès refusé
Veuillez activer JavaScript.
Une erreur est survenue.
Seite nicht gefunden
Zugriff verweigert
Bitte aktivieren Sie JavaScript.
Página no encontrada
Acceso denegado
Страница не найдена
Доступ запрещён
Включите JavaScript
Lorem ipsum dolor sit amet, consectetur adipiscing elit.
Vestibulum rutrum mauris sagittis orci, luctus ultrices nunc mattis.
Dear {{first_name}}, welcome.
Hello ${user.name}""".split("\n")

SPEAKING = """The librarian said that the page was missing from the second volume since the fire.
He was denied access to the palace and waited three days at the gate.
The general sent scouts to find the file of soldiers that had lost its way in the hills.
The maintenance of the dike cost the district four thousand strings of cash.
A session of the court was held, and the envoy's letter had by then been read twice.
“Page not found” is what the reader showed when the shelf mark was wrong, wrote the editor.
The manual explains why “access denied” appears after three attempts.
The emperor forbade entry to the archive, and the record of that year was lost.
In his memoir he describes the message 'internal server error' and how the team laughed.
They found 404 bowls and 503 lamps in the tomb.
The document that the magistrate had removed was found again in his brother's house.
The script of the inscription is disabled in places by wear, yet most of it can be read.
Scholars who need to enable others to read the text add a translation beside it.
The request was refused, and the governor's messenger went home without an answer.
When the connection between the two forts was closed, the enemy crossed the river by night.
他说这个页面不存在的时候，大家都笑了，因为书就摆在桌上。
书吏称该卷已被删除其中三页，后人据别本补足。
系统学习史书的人，应当先读本纪，再读列传，然后才能明白年代的先后。
文中“系统维护中”一语，是指当时网站的通告，并非正文。
此碑文字多处残缺，编者以□□标出，未敢妄补。
守将没有权力开仓，只得上书请命，三日后才得到回音。
他请求登录名册，县令不许，于是改投邻县。
编辑把“内容待补充”四字误作正文，印进了初版，再版时才改正过来。
数据显示，当年全县共有四百零四户，其中五百零三人从军。
論者以為此頁所載之事，不存在於他書，未可盡信。
请旧臣入朝议事，过了三天才得到准许。
城门关闭之后，脚夫仍在城下等候，直到天亮才进城。
司马迁记录了许多错误的传闻，又一一加以辨正。
那座桥在建设的时候曾经两次倒塌，第三次才修成。
会盟的期限已经过去，诸侯的使者还没有到齐。
The word lorem is not a Latin word at all but a piece of dolorem, as the printers knew.
La page du manuscrit que le moine cherchait se trouvait dans une autre abbaye de la région.
Die Seite des Buches, auf der der Name stand, war herausgerissen worden, sagte der Bibliothekar.
La página que faltaba apareció en el archivo de un convento cercano muchos años después.
Страница летописи, о которой писал монах, сохранилась в другом списке того же времени.
その巻は戦火で失われたと伝えられているが、後に写本が寺で発見された。
Tong Hongshuo offered a crimson robe and 7,030 coins.
In the year 404 the river burst its banks and the town was not found again for a century.
His error was to trust the server of the wine rather than the host.
The text to follow this chapter was written by another hand in the next reign.""".split("\n")


def test_held_out_notices_are_found():
    automaton = p10_residue._automaton()
    missed = [t for t in NOTICES if not p10_residue.is_residue(t, automaton)]
    assert len(missed) <= 0.1 * len(NOTICES), missed


def test_texts_that_speak_of_such_things_are_kept():
    automaton = p10_residue._automaton()
    wrong = [t for t in SPEAKING if p10_residue.is_residue(t, automaton)]
    assert len(wrong) <= 0.1 * len(SPEAKING), wrong


def test_a_notice_at_the_end_of_a_very_long_sentence_is_judged_by_the_whole():
    automaton = p10_residue._automaton()
    assert not p10_residue.is_residue("甲" * 5000 + "页面不存在", automaton)
    assert p10_residue.is_residue("甲" * 5000 + "\n页面不存在", automaton)
