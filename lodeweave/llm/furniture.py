"""Labelled examples of page furniture, and the lines of ordinary prose beside them, for the evidence of boilerplate."""

from __future__ import annotations

# Names of menu entries in several languages.
MENU = frozenset(
    "home about contact contacts login logout register signup subscribe search menu sitemap archive archives blog blogs news topics topic help faq jobs careers press shop store cart events weather sports sport "
    "opinion local podcasts podcast video videos photos gallery business politics culture science tech travel rss newsletter newsletters account profile settings languages support "
    "accueil aide rubriques connexion emploi boutique actualités météo abonnement recherche culture économie inscription agenda "
    "startseite anmelden kontakt impressum datenschutz hilfe karriere themen wetter nachrichten archiv suche abo registrieren termine "
    "inicio ayuda contacto noticias deportes tienda empleo secciones buscar registro início ajuda contato notícias esportes loja entrar cadastro "
    "главная новости контакты помощь войти регистрация поиск погода архив магазин "
    "홈 뉴스 로그인 회원가입 고객센터 공지사항 게시판 쇼핑 날씨 검색 메뉴 ホーム ニュース ログイン 会員登録 お問い合わせ 天気 検索 メニュー".split()
)

# Labelled examples: lines that belong to the site around an article.
EXAMPLES = """
Our site uses cookies to give you the best experience and to improve our services. Accept all cookies. Decline.
We and our partners use cookies to store and access data on your device and to show personalised ads.
By continuing to use this website you agree to our cookie policy and the use of cookies.
Cookie settings. Manage your cookie preferences. Reject all. Save my choices.
We value your privacy. You can change your consent at any time. Our partners process data with your consent.
This website sets cookies for statistics. I agree. Learn more.
Sign up to our newsletter and get the news in your inbox every morning.
Enter your email address to subscribe to our newsletter. Subscribe now from only 1 a month.
Download the app. Get our free app on your phone.
Share this article. Share on Facebook. Share on Twitter. Email this. Print this page. Save. Copy link.
Follow us on social media. Follow us on Instagram and YouTube.
Like this page? Rate this article. Was this helpful?
Print. Email. Share. Save.
Related articles. Related stories. More on this topic. More from this section. See also. You might also like.
Read more: Ten things to know about spring. Read also: The best recipes of the year.
Recommended for you. Trending. Trending: What the new mayor said. Most read. Most popular today. Editor's picks. Up next: The story of a lake.
Sponsored content. Sponsored by our partner. Paid post. Advertisement. Advertising. Promoted: cheap flights. Ad.
12 comments. 3 comments. 45 shares. 1,204 views. Leave a comment. Show comments. Log in to comment. Load more comments. Be the first to comment. Activate JavaScript to see the comments.
Back to top. Skip to main content. Skip to navigation. Go to home page. Close. Next. Previous. Load more. Show more. Show all.
Copyright 2020 Example Media. All rights reserved. © 2019 Example. © Example Ltd.
Terms of service. Terms and conditions. Privacy policy. Privacy notice. Imprint. Legal notice. Legal. Accessibility statement. About us. Contact us. Advertise with us.
Powered by WordPress. Hosted by Example. Design by Example.
Registered office: 1 High Street. Registered in England, company number 100. VAT number. Registered company.
The publisher is not responsible for the content of external sites or links.
Tags: garden, spring, tools. Filed under: Travel. Categories: Food. Topics: health. Posted in News.
Home > News > Local. Home / Travel / Europe. Home » Shop » Shoes. You are here: Home.
Home | News | Sports | Weather | Contact. Login | Register | Help.
Search this site. Menu. Main menu. Site map. Log in. Sign in. Register. My account. Shopping cart. Subscribe. Change language.
Nous utilisons des cookies pour améliorer votre visite. Accepter tous les cookies. Refuser. Paramétrer. En poursuivant, vous acceptez nos cookies.
Abonnez-vous à notre lettre d'information. S'abonner. Partager cet article. Partager sur Facebook. Imprimer. Suivez-nous. Publicité. Contenu sponsorisé.
À lire également. Lire aussi. Voir aussi. Sur le même sujet. Les plus lus. Articles liés. Haut de page. Retour en haut. 8 commentaires. Laisser un commentaire.
Tous droits réservés. Mentions légales. Politique de confidentialité. Conditions d'utilisation. Plan du site. Nous contacter. Qui sommes-nous.
Diese Website verwendet Cookies, um Ihr Erlebnis zu verbessern. Alle akzeptieren. Ablehnen. Einstellungen. Mit der Nutzung stimmen Sie Cookies zu. Wir nutzen Cookies.
Newsletter abonnieren. Jetzt abonnieren. Artikel teilen. Teilen. Drucken. Folgen Sie uns. Anzeige. Werbung. Gesponsert.
Lesen Sie auch. Mehr zum Thema. Das könnte Sie auch interessieren. Meistgelesen. Ähnliche Artikel. Nach oben. Zum Seitenanfang. 8 Kommentare. Kommentar schreiben.
Alle Rechte vorbehalten. Impressum. Datenschutzerklärung. Nutzungsbedingungen. AGB. Kontakt. Über uns.
Este sitio utiliza cookies para mejorar su experiencia. Aceptar todo. Rechazar. Usamos cookies. Si continúa, acepta el uso de cookies.
Suscríbase a nuestro boletín. Compartir este artículo. Compartir. Imprimir. Síganos. Publicidad. Patrocinado. Lea también. Noticias relacionadas. Lo más leído. Más leídas. Ver también. Volver arriba. Subir. 8 comentarios. Deje un comentario.
Todos los derechos reservados. Aviso legal. Política de privacidad. Términos de uso. Contacto. Quiénes somos.
Este site usa cookies para melhorar sua experiência. Aceitar todos. Recusar. Utilizamos cookies. Ao continuar, você aceita os cookies.
Assine nossa newsletter. Compartilhar. Compartilhe. Imprimir. Siga-nos. Publicidade. Anúncio. Leia também. Notícias relacionadas. Mais lidas. Veja também. Voltar ao topo. 8 comentários. Deixe um comentário.
Todos os direitos reservados. Política de privacidade. Termos de uso. Fale conosco. Quem somos.
Мы используем файлы cookie. Принять все. Подписаться на рассылку. Поделиться. Реклама. Читайте также. Популярное. Наверх. 8 комментариев. Все права защищены. Политика конфиденциальности.
이 사이트는 쿠키를 사용합니다. 모두 동의. 모두 허용. 거부. 뉴스레터 구독. 공유. 기사 공유. 인쇄. 광고. 관련 뉴스. 관련 기사 보기. 인기 기사. 많이 본 기사. 맨 위로 가기. 댓글 8개. 댓글 쓰기. 무단 전재 및 재배포를 금합니다. 저작권자. 개인정보 처리방침. 이용약관.
当サイトはクッキーを使用しています。すべて許可。拒否。ニュースレター登録。シェアする。記事を共有。印刷。広告。関連ニュース。関連する記事。人気記事。よく読まれている記事。ページの先頭へ。トップに戻る。コメント 8件。コメントを書く。無断転載を禁じます。著作権。プライバシーポリシー。利用規約。
本网站使用cookie。接受全部。分享。广告。相关文章。热门文章。返回顶部。评论。版权所有。隐私政策。
""".strip().split("\n")

# Labelled examples: lines of articles that furniture could be taken for.
BODY = """
What happens next
How we got here
Costs and benefits
Background
Results of the first year
The cookies were baked with butter and sugar, then left to cool.
Contact with the plant can cause a rash.
Help came late
By Mary Jones
By John Smith, science editor
Von Anna Weber
Par Jean Martin
Por Ana García
Published 3 March 2020
Updated on 12 June 2021
Mis à jour le 4 mai 2020
Aktualisiert am 3. März 2020
Publicado el 5 de julio de 2019
5 May 2018
- 3 eggs, beaten
- two onions
- a small tent
1. Wash the rice.
2. Turn off the power before you open the case.
The footer of the page had grown so long that nobody read it, the designer says.
He accepted all the terms and signed the contract.
She read the story to the children and closed the book.
The company advertised for new drivers.
Why the market changed
A garden in the city
Das alte Haus am Fluss
Une année difficile
El precio del agua
Questions and answers
""".strip().split("\n")
