"""What a notice reads like: a linear model over words, fitted to labelled examples and to the corpus's own prose.

The labelled set is bounded: the examples below, and at most ``max_rows`` records of the corpus, taken by the hash of
their id, whose sentences are the other class.  Words are runs of letters; runs of Chinese characters, kana and Hangul
give pairs of characters.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

_WORD = re.compile(r"[぀-鿿가-힣]+|[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")

# Labelled examples: what sites, servers, browsers and gateways say in place of a page.
EXAMPLES = """
JavaScript is required to use this site. Please turn it on in your browser settings and try again.
This application needs JavaScript. Activate scripts in the browser to continue.
Your browser has scripts switched off, so this page cannot be displayed. Enable scripts and cookies, then refresh.
You must allow cookies and JavaScript for this website to work properly. Reload when done.
For full functionality of this site it is necessary to enable JavaScript. Here are instructions for your browser.
An ad blocker or another extension prevents scripts from running. Without scripts we can't show the content.
Your browser is not supported. Would you like to continue with the basic version of the site?
Loading. If this takes longer than a few seconds, enable scripts for this site and refresh the page.
Please wait while the page is loading.
404 Page not found. The page you are looking for does not exist, has been moved or is no longer available. Return to the home page.
Sorry, we could not find that page. Use the search box or go to our homepage.
Oops! This link is broken. Check the address or search our site instead.
The requested URL was not found on this server.
The file you requested has been removed.
410 Gone. This resource is no longer available on this server.
403 Forbidden. You don't have permission to access this resource on this server.
Access to this page has been denied. Contact the administrator if you think this is a mistake. Reference 18.
You are not authorized to view this page. Please log in first.
This content is not available in your country or region.
451 Unavailable for legal reasons.
500 Internal server error. The server encountered an unexpected error and was unable to complete your request. Please try later.
Something went wrong. We are working on it. Please try again in a few minutes.
Sorry, an unexpected error occurred on our side while processing your request. Error code 5.
502 Bad gateway. The server received an invalid response from the upstream server. nginx
503 Service unavailable. The site is temporarily overloaded or down for maintenance. Please try again later. apache
504 Gateway timeout. The origin server did not respond in time. Ray ID
We are down for scheduled maintenance and will be back soon.
The database could not be reached. Error connecting to the database server.
Fatal error: Uncaught exception in index.php on line 12. Stack trace follows.
Warning: mysql connection refused in /var/www/html/inc/db.php on line 20
Notice: undefined variable in /home/site/public/index.php on line 7
Parse error: syntax error, unexpected token in /srv/app/main.php
This site can't be reached. The server took too long to respond. The connection was refused or timed out.
Your connection is not private. The certificate of this site is not valid.
The connection was interrupted while the page was loading. Check your network connection.
429 Too many requests. You have sent too many requests in a short time. Please wait and slow down. Your IP address has been blocked.
Rate limit exceeded for your address. Retry after 60 seconds.
We have detected unusual activity from your computer network. Please confirm that you are human.
Verify you are human by completing the check below. Enter the characters you see to prove you are not a bot.
Please complete the captcha to continue. Our systems have detected automated traffic.
Checking if the site connection is secure. This may take a few seconds. Your browser will redirect automatically.
DDoS protection. Please stand by while we check your browser before accessing the site. Incident ID
Your request was blocked by the security service. Please contact the site owner and give the incident number.
Your session has timed out or expired. Please sign in again to continue.
You have been logged out. Log in to read the rest of this page.
You must be signed in to view this content. Sign in or create an account.
You have reached your limit of free articles. Subscribe to continue reading.
<html><head><title>404 Error</title></head><body>Page not found.
<html><head><title>503 Error</title></head><body>Service unavailable. Try again later.
Veuillez activer JavaScript dans votre navigateur pour afficher ce site.
JavaScript est désactivé. Activez les scripts et les cookies pour continuer, puis rechargez la page.
Ce site a besoin de JavaScript et de son activation pour fonctionner correctement. Nécessite un navigateur récent.
La page que vous cherchez n'existe pas ou a été déplacée. Erreur 404. Page introuvable. Retour à l'accueil.
Désolé, une erreur interne du serveur est survenue. Veuillez réessayer plus tard.
Accès refusé. Vous n'avez pas l'autorisation de consulter cette page demandée.
Votre session a expiré. Veuillez vous reconnecter.
Trop de requêtes. Veuillez patienter. Vérifiez que vous n'êtes pas un robot.
Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen.
Für die Nutzung dieser Seite muss JavaScript eingeschaltet sein. Die Anzeige benötigt aktiviertes JavaScript.
Seite nicht gefunden. Die angeforderte Seite existiert leider nicht oder wurde verschoben. Fehler 404. Zur Startseite.
Zugriff verweigert. Sie haben keine Berechtigung, diese Seite aufzurufen.
Interner Serverfehler. Leider ist ein Fehler aufgetreten. Bitte versuchen Sie es später erneut. Fehlercode
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Zu viele Anfragen. Bitte bestätigen Sie, dass Sie kein Roboter sind.
Habilite JavaScript en los ajustes de su navegador para ver este sitio. Debe activarlo.
Este sitio requiere JavaScript. Por favor, actívelo en su navegador y vuelva a cargar la página. Necesita JavaScript.
Página no encontrada. La página que busca no existe o se ha movido. Error 404. Volver al inicio.
Acceso denegado. No tiene permiso para ver esta página.
Error interno del servidor. Se ha producido un error, inténtelo de nuevo más tarde.
Su sesión ha caducado. Inicie sesión de nuevo.
Demasiadas solicitudes. Demuestre que no es un robot.
Ative o JavaScript no seu navegador para ver esta página. Este site precisa de JavaScript.
Página não encontrada. A página que procura não existe ou foi removida. Erro 404. Voltar ao início.
Acesso negado. Você não tem permissão para acessar este recurso.
Erro interno do servidor. Tente novamente mais tarde. Sua sessão expirou. Entre novamente.
Abilita JavaScript nel browser per visualizzare questo sito. Richiede JavaScript.
Pagina non trovata. La pagina richiesta non esiste o è stata spostata. Errore 404.
Accesso negato. Errore interno del server. Riprova più tardi. La sessione è scaduta.
Включите JavaScript в браузере, чтобы просмотреть эту страницу. Для работы сайта требуется JavaScript.
Страница не найдена. Запрошенная страница не существует или была удалена. Ошибка 404. Вернуться на главную.
Доступ запрещён. У вас нет прав для просмотра этой страницы. Доступ ограничен.
Внутренняя ошибка сервера. Попробуйте позже. Сессия истекла, войдите снова. Подтвердите, что вы не робот. Слишком много запросов.
이 사이트를 이용하려면 자바스크립트를 켜 주세요. 브라우저에서 자바스크립트를 활성화해야 페이지를 볼 수 있습니다.
페이지를 찾을 수 없습니다. 요청한 페이지가 존재하지 않거나 이동되었습니다. 주소를 확인하고 다시 시도해 주세요.
접근이 거부되었습니다. 이 페이지를 볼 권한이 없습니다. 접근이 차단되었습니다.
서버 오류가 발생했습니다. 잠시 후 다시 시도해 주세요. 세션이 만료되었습니다. 다시 로그인해 주세요.
비정상적인 트래픽이 감지되었습니다. 로봇이 아님을 확인해 주세요. 요청이 너무 많습니다.
このサイトを表示するには、ブラウザのJavaScriptを有効にしてください。ジャバスクリプトが無効になっています。
お探しのページが見つかりません。指定されたページは存在しないか、移動しました。アドレスをご確認ください。
アクセスが拒否されました。このページを表示する権限がありません。
サーバーエラーが発生しました。しばらくしてからもう一度お試しください。セッションの有効期限が切れました。再度ログインしてください。
ロボットではないことを確認してください。リクエストが多すぎます。
请在浏览器中启用JavaScript以查看此页面。 页面未找到。您访问的页面不存在或已被移动。
访问被拒绝。您没有权限查看此页面。服务器内部错误，请稍后再试。请求过多。请证明您不是机器人。
""".strip().split("\n")
# Labelled examples of the other class: short texts that are content, with everyday words the notices also have.
PROSE = """
She walked home along the lake because it was still light.
They were happy with the house, but the roof had to be mended before winter.
Eight men and three women went up the hill on Sunday morning.
Boil the rice with salt, onions and a little oil, then serve it with lemon.
Soup of the day: carrot and ginger.
My mother made bread every week when I was young.
The children came late and ate the cake until it was gone.
It was dark and cold when the train left the town.
After the war many families came to the city to find work.
The team won the game by two goals in front of a large crowd.
Prices rose by three percent last year, and wages fell.
A new study shows that people who sleep well live longer.
The film tells the story of a boy who grows up by the sea.
Doctors said that the woman was well and would leave the hospital soon.
In the spring the birds come back and build their nests in the trees.
The bank will lend more money to small firms from March.
Blue shirt, size M, cotton, made in Portugal
Three tips for better photos at night
How the village got its name
Why we walk, and what we see on the way
Ten thousand people took part in the march for peace.
The old man smiled and gave him the key of the cellar.
On met la table dehors quand il fait beau, et les enfants jouent dans le jardin.
Le train arrive en juin, après trois ans de travaux dans la ville.
La mer était calme et le vent venait du sud.
Im Sommer gehen wir an den See, und am Abend kochen wir zusammen.
Der Junge lief nach Hause, weil es regnete und dunkel war.
Die Preise sind im letzten Jahr um drei Prozent gestiegen.
Los niños comen pan con queso y después juegan en la calle.
El tren llegó tarde y la gente esperó en la plaza hasta la noche.
As crianças brincam no jardim e a mãe faz o jantar.
O mercado abre cedo e vende peixe, frutas e pão.
Il treno arriva la sera e la gente cammina lungo il fiume.
Дети играли в саду, а вечером мы пили чай на кухне.
В прошлом году цены выросли, но люди продолжали покупать хлеб.
아이들이 마당에서 놀고 어머니는 저녁을 준비했다.
지난해 가격이 올랐지만 사람들은 시장에 갔다.
子どもたちは庭で遊び、母は夕食を作った。
昨年は値段が上がったが、人々は市場へ行った。
孩子们在花园里玩，妈妈在做晚饭。
A short note about the garden behind the house.
The council has moved the meeting to the town hall and will publish the report in a few days.
We found the old server room behind the library, and the page of the book was missing.
He opened the door, turned on the light and read the letter again.
The search for the missing hikers continued after the storm.
Access to the beach has been closed for the summer because of repairs to the bridge.
Please bring your own cup to the market on Saturday.
The network of rivers supports more birds than any other region of the country.
The error in the map was found by a student in 1963.
Her request for more time was refused, and the company sold the site.
You will need a screwdriver, two cables and some patience with the enclosure.
If the soil is dry, check the roots before the plants are moved.
JavaScript was written in ten days in 1995 and is now used on most websites.
The browser wars of the nineties changed how companies published software.
Nobody expected that the second session of the trial would continue for so long.
Older engines need a new pump if the pressure rises above the limit.
Le conseil a publié le rapport sur la page du village et la fête continue demain.
Die Gemeinde hat den alten Weg am Fluss repariert, und der Markt beginnt im Mai.
El ayuntamiento eligió el proyecto y la página del informe explica los gastos.
A prefeitura publicou a lista e a página do relatório explica a mudança.
Музей открыл страницу с историей города, и сервер музея работает весь год.
도서관은 새로운 규칙을 발표했고 농부는 채소를 수확했다.
図書館は新しい規則を発表し、農家は野菜を収穫した。
""".strip().split("\n")


def tokens(text: str) -> list[str]:
    out = []
    for w in _WORD.findall(text.lower()):
        if w[0] >= "぀" and not w[0].isascii() and (w[0] <= "鿿" or "가" <= w[0] <= "힣"):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w)
    return out


def sentences(text: str) -> list[str]:
    return [p for p in _SENTENCE.split(text) if p and not p.isspace()]


class WordModel:
    """Mean weight of the known words of a text, and a bias; over zero it reads like a notice."""

    def __init__(self, weights: dict[str, float], bias: float, unknown: float):
        self.weights, self.bias, self.unknown = weights, bias, unknown

    def __call__(self, text: str) -> float:
        words = tokens(text)
        if not words:
            return self.bias
        get, other = self.weights.get, self.unknown
        return self.bias + 4.0 * sum([get(w, other) for w in words]) / math.sqrt(len(words) * max(4, min(len(words), 40)) ** 0.5 * 2.0)


def train(prose: list[str], examples: list[str] = EXAMPLES, others: tuple[str, ...] | list[str] = PROSE, rounds: int = 300) -> WordModel:
    """Logistic regression over words; prose: texts of ordinary records, whose sentences are of the other class."""
    least = 4 if examples is EXAMPLES else 1
    texts = [(s, 1.0) for e in examples for s in (e, *(x for x in sentences(e) if len(tokens(x)) >= least))]
    own = [s for t in prose for s in sentences(t)]
    texts += [(s, 0.0) for s in (*others, *own)]
    docs = [Counter(tokens(t)) for t, _ in texts]
    df: Counter = Counter(w for d in docs for w in d)
    given = set(tokens("\n".join((*examples, *others))))
    vocab = {w: i for i, w in enumerate(sorted(w for w in df if df[w] > 2 or w in given))}
    n, unknown = len(vocab), len(vocab)
    rows = [[(vocab.get(w, unknown), c) for w, c in d.items()] for d in docs]
    size = np.array([len(r) for r in rows])
    flat = np.fromiter((i for r in rows for i, _ in r), np.int64, int(size.sum()))
    count = np.fromiter((c for r in rows for _, c in r), float, int(size.sum()))
    owner = np.repeat(np.arange(len(rows)), size)
    length = np.maximum(1.0, np.bincount(owner, count, len(rows)))
    scale = 4.0 / np.sqrt(length * np.clip(length, 4, 40) ** 0.5 * 2.0)
    value = count * scale[owner]
    y = np.array([t for _, t in texts])
    share = np.where(y > 0, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))  # both classes weigh the same
    w, square = np.zeros(n + 2), np.full(n + 2, 1e-8)
    for _ in range(rounds):
        z = np.bincount(owner, w[flat] * value, len(rows)) + w[-1]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        grad = np.bincount(flat, g[owner] * value, n + 2) + 2e-5 * w
        grad[-1] = g.sum()
        square += grad * grad
        w -= 0.2 * grad / np.sqrt(square)
    # words that the prose happens not to hold say little against a notice in other words
    return WordModel({t: float(w[i]) for t, i in vocab.items()}, float(w[-1]), max(float(w[unknown]), UNKNOWN))


UNKNOWN = -0.6
CENTRE, SURE = -1.3, 1.0  # of the word score: where the classes meet, and how far from it words alone decide
CANDIDATE = CENTRE - 1.2  # texts from here on are mined for templates


def form(template: str, score: float, support: int, sites: int) -> list[float]:
    """Features of a template: its word score, how often and on how many sites it stands, and its form."""
    words = template.split()
    wild = sum(w[0] == "<" and w[-1] == ">" for w in words) / max(1, len(words))
    return [score - CENTRE, math.log(max(1, support)), math.log(max(1, sites)), wild, float("<html" in template or "<title" in template), math.log(max(1, len(words))) - 3.0]


class TemplateModel:
    """Logistic model of templates.  It starts from PRIOR, and what the templates whose words are sure tell about support,
    spread and form moves it."""

    PRIOR = np.array([1.6, 0.1, 0.1, 0.0, 0.3, 0.0, 0.0])

    def __init__(self, rows: list[list[float]]):
        self.w = self.PRIOR.copy()
        sure = [(r, float(r[0] > 0)) for r in rows if abs(r[0]) >= SURE]
        if len({y for _, y in sure}) == 2:
            x = np.hstack((np.array([r for r, _ in sure]), np.ones((len(sure), 1))))
            y = np.array([t for _, t in sure])
            weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
            for _ in range(200):
                g = x.T @ ((1 / (1 + np.exp(-np.clip(x @ self.w, -30, 30))) - y) * weight) + 0.05 * (self.w - self.PRIOR)
                self.w -= 0.3 * g

    def __call__(self, rows: list[list[float]]) -> np.ndarray:
        return np.hstack((np.array(rows), np.ones((len(rows), 1)))) @ self.w > 0
