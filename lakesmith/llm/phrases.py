"""The phrases that the residue automaton is built of. All of them are fixed values, written in lower case and plain words.

An entry ending in `*` matches the beginning of words. Every list is by kind; what combines freely is made by a rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from http import HTTPStatus
from itertools import product

# Notices that scripts, cookies or a browser check are required. English ones are mostly made of what is asked and for what.
ASKS = (
    "needs", "need", "requires", "require", "relies on", "rely on", "depends on", "makes use of", "works only with", "only works with", "works best with", "can only be shown with", "can only be viewed with", "can only be read with",
    "cannot be shown without", "can not be shown without", "does not work without", "doesn't work without", "will not work without", "built for browsers with", "made for browsers with", "your browser has no", "your browser does not support",
    "your browser doesn't support", "your browser may be blocking", "your browser is blocking", "please enable", "please allow", "please accept", "please activate", "please turn on", "please switch on",
)
ASKED = ("javascript", "java script", "js", "scripting", "client scripts", "client side scripts", "scripts", "cookies", "active scripting", "scripts and cookies", "cookies and scripts", "javascript and cookies")
ORDERS = ("enable", "turn on", "switch on", "allow", "activate", "accept")
PURPOSES = ("to view", "to see", "to continue", "to read", "to go on", "to use", "in your browser", "for this site", "for this page", "for this address", "for this board", "and reload", "to proceed", "and try again")
STATES = ("is disabled", "is turned off", "is switched off", "is off", "is required", "must be enabled", "are disabled", "are turned off", "are switched off", "are blocked", "are required", "must be allowed", "is not enabled", "are not enabled", "required")

SCRIPT_PHRASES = (
    # English
    "has js disabled", "blocking scripts", "we use cookies", "this site uses cookies", "checking your browser", "check your browser before", "verify that you are not a robot", "verify you are human", "verify that you are human", "verifying you are human",
    "are you a robot", "you are not a robot", "complete the captcha", "solve the captcha", "your browser is too old", "your browser is not supported", "unsupported browser", "upgrade your browser", "update your browser", "check your browser settings",
    "turn it on in your browser", "turn it on and reload", "switch it on to go on", "switch it on and reload", "allow it for this address", "accept to go on", "accept them to go on", "your browser has it disabled", "your browser has it turned off", "your browser has it switched off", "a plain version is not available",
    "before letting you in", "ddos protection by",
    # Spanish
    "active javascript", "habilite javascript", "habilita javascript", "activa javascript", "active el javascript", "requiere javascript", "necesita javascript", "debe permitir los scripts", "permita los scripts", "permitir los scripts", "habilitar javascript",
    "activar javascript", "javascript desactivado", "javascript está desactivado", "utilizamos cookies", "usamos cookies", "comprobando su navegador", "que no es un robot", "habilite las cookies", "active los scripts", "activar los scripts", "scripts del navegador",
    # Portuguese
    "ativar o javascript", "ative o javascript", "habilite o javascript", "habilitar o javascript", "requer javascript", "precisa de javascript", "permita os scripts", "permitir scripts", "permitir os scripts", "javascript desativado", "javascript está desativado",
    "verificando o seu navegador", "que não é um robô", "utilizamos cookies", "habilite os cookies",
    # French
    "activer javascript", "activez javascript", "nécessite javascript", "javascript est nécessaire", "javascript est requis", "javascript est désactivé", "javascript désactivé", "autoriser les scripts", "autorisez les scripts", "exécuter les scripts", "activer les scripts",
    "nous utilisons des cookies", "vérification de votre navigateur", "que vous n'êtes pas un robot", "activer les cookies",
    # German
    "aktives javascript", "javascript nötig", "javascript benötigt", "javascript erforderlich", "benötigt javascript", "javascript aktivieren", "javascript einschalten", "aktivieren sie javascript", "javascript ist deaktiviert", "javascript deaktiviert", "skripte erlauben",
    "skripte zulassen", "skripte aktivieren", "müssen skripte erlaubt sein", "skripte erlaubt sein", "wir verwenden cookies", "browser wird geprüft", "dass sie kein roboter sind", "cookies aktivieren",
    # Italian
    "abilita javascript", "abilitare javascript", "abiliti javascript", "attiva javascript", "attivare javascript", "richiede javascript", "javascript è disabilitato", "javascript è disattivato", "javascript è necessario", "consenti gli script", "utilizziamo i cookie", "abilita i cookie", "che non sei un robot",
    # Dutch
    "schakel javascript in", "javascript inschakelen", "vereist javascript", "javascript is uitgeschakeld", "javascript is vereist", "sta scripts toe", "wij gebruiken cookies", "we gebruiken cookies", "cookies inschakelen", "dat u geen robot bent",
    # Polish
    "włącz javascript", "włączyć javascript", "wymaga javascript", "wymaga obsługi javascript", "javascript jest wyłączon*", "obsługę javascript", "zezwól na skrypty", "używamy plików cookie", "włącz obsługę cookie*", "nie jesteś robotem",
    # Swedish
    "aktivera javascript", "kräver javascript", "slå på javascript", "javascript är inaktiverat", "javascript måste vara aktiverat", "tillåt skript", "vi använder cookies", "att du inte är en robot",
    # Turkish
    "javascript'i etkinleştirin", "javascript gerekli*", "javascript gerektir*", "javascript devre dışı", "javascript etkin değil", "çerezleri kullanıyoruz", "çerezleri etkinleştirin", "robot olmadığınızı",
    # Russian
    "включите javascript", "включить javascript", "требуется javascript", "необходим javascript", "нужен javascript", "javascript отключ*", "разрешите скрипты", "разрешить скрипты", "мы используем cookie*", "проверка браузера", "вы не робот",
    # Arabic
    "تفعيل جافا سكريبت", "تمكين جافا سكريبت", "يرجى تفعيل javascript", "تمكين javascript", "تفعيل javascript", "يتطلب javascript", "ملفات تعريف الارتباط",
    # Japanese, Chinese, Korean
    "javascript を有効", "javascriptを有効", "javascript が無効", "javascriptが無効", "javascript が必要", "javascriptが必要", "スクリプトを有効", "スクリプトを許可", "cookie を有効", "クッキーを有効", "请启用 javascript", "启用javascript", "请启用cookie",
    "자바스크립트를 활성화", "javascript를 활성화", "javascript 를 활성화",
)

ERROR_PHRASES = (
    # English
    "page not found", "file not found", "not found on this server", "page cannot be found", "page can not be found", "page could not be found", "page can't be found", "page does not exist", "page doesn't exist", "page no longer exists", "page you were looking for",
    "page you are looking for", "page you requested", "the requested url", "requested page", "requested document", "may have moved or was taken down", "has moved or was taken down", "was taken down", "topic has been removed", "thread has been removed", "post has been removed", "question has been removed", "answer has been removed",
    "this post does not exist", "this thread does not exist", "this document does not exist", "this question does not exist", "that post cannot be found", "that thread cannot be found", "that document cannot be found", "that address cannot be found", "that topic cannot be found",
    "that post could not be found", "that thread could not be found", "that address could not be found", "go back to the start page", "return to the home page", "try the search", "use the search", "service temporarily unavailable", "temporarily unavailable",
    "access denied", "access is denied", "you don't have permission", "you do not have permission", "not allowed to view", "rate limit exceeded", "something went wrong", "an error occurred", "an error has occurred", "an unexpected error", "application error", "fatal error",
    "could not reach the database", "cannot reach the database", "error establishing a database connection", "name could not be resolved", "host is unreachable", "the origin did not answer", "did not answer in time", "origin refused the connection", "refused the connection", "bad handshake", "bad handshake with the backend",
    "connection timed out", "connection was reset", "this site can't be reached", "the server is busy", "server is busy", "unavailable right now", "this is awkward", "error id", "is no longer here", "fatal uncaught", "uncaught exception", "unhandled exception", "traceback", "traceback most recent call last", "stack trace", "render failed",
    "down for maintenance", "under maintenance", "scheduled maintenance", "maintenance mode", "we expect to be back", "will be back in a few minutes", "will be back soon", "we'll be back", "be right back", "come back later", "come back soon", "back shortly", "please try again later", "wait a moment and reload", "you have sent too many requests",
    "session has expired", "session has run out", "session expired", "session timed out", "you must be logged in", "you must log in", "you must sign in", "you need to log in", "you need to sign in", "you have to log in", "you have to sign in", "login required", "please log in", "please sign in", "sign in again", "log in again", "log in to continue", "sign in to continue",
    "log in to see", "sign in to see", "log in to read", "sign in to read", "register to see", "you must register", "you need to register", "register to read", "register before you", "members only", "only for members", "only members can", "for registered users", "forgot your password", "forgotten your password", "this account has been suspended", "nothing to see here", "no such page", "content is not available", "is not available in your country",
    # Spanish
    "página no encontrada", "no se encontró la página", "no se ha encontrado la página", "la página no existe", "el enlace ya no es válido", "acceso denegado", "error interno del servidor", "error interno", "servicio no disponible", "estamos en mantenimiento", "en mantenimiento", "inicie sesión", "iniciar sesión para", "su sesión ha caducado",
    "vuelva a intentarlo", "inténtelo de nuevo", "demasiadas solicitudes", "algo salió mal",
    # Portuguese
    "página não encontrada", "a página não existe", "o tópico foi removido", "acesso negado", "erro interno do servidor", "erro interno", "serviço indisponível", "em manutenção", "inicie sessão", "faça login", "iniciar sessão para", "a sua sessão expirou", "sua sessão expirou", "tente novamente mais tarde", "algo correu mal", "algo deu errado",
    # French
    "page introuvable", "page non trouvée", "cette page n'existe plus", "cette page n'existe pas", "ce sujet a été supprimé", "sujet a été supprimé", "accès refusé", "accès interdit", "erreur interne du serveur", "erreur interne", "service indisponible", "en maintenance", "connectez vous pour", "veuillez vous connecter", "votre session a expiré",
    "veuillez réessayer", "réessayez plus tard", "une erreur est survenue", "une erreur s'est produite",
    # German
    "seite nicht gefunden", "seite wurde nicht gefunden", "dieses thema existiert nicht mehr", "existiert nicht mehr", "zugriff verweigert", "zugriff nicht erlaubt", "interner serverfehler", "interner fehler", "dienst nicht verfügbar", "wartungsarbeiten", "wird gewartet", "bitte anmelden", "melden sie sich an", "bitte melden sie sich",
    "sitzung ist abgelaufen", "sitzung abgelaufen", "versuchen sie es später", "bitte versuchen sie es", "ein fehler ist aufgetreten", "zu viele anfragen",
    # Italian
    "pagina non trovata", "la pagina non esiste", "questa pagina non esiste", "accesso negato", "errore interno del server", "servizio non disponibile", "in manutenzione", "sessione è scaduta", "sessione scaduta", "effettua il login", "accedi per", "si è verificato un errore", "qualcosa è andato storto", "riprova più tardi", "troppe richieste",
    # Dutch
    "pagina niet gevonden", "deze pagina bestaat niet", "toegang geweigerd", "interne serverfout", "dienst niet beschikbaar", "in onderhoud", "sessie is verlopen", "log in om", "meld u aan", "er is een fout opgetreden", "er is iets misgegaan", "er ging iets mis", "probeer het later opnieuw", "te veel verzoeken",
    # Polish
    "nie znaleziono strony", "strona nie istnieje", "strona nie została znaleziona", "odmowa dostępu", "brak dostępu", "wewnętrzny błąd serwera", "usługa niedostępna", "przerwa techniczna", "sesja wygasła", "zaloguj się, aby", "wystąpił błąd", "coś poszło nie tak", "spróbuj ponownie później", "zbyt wiele żądań",
    # Swedish
    "sidan hittades inte", "sidan kunde inte hittas", "sidan finns inte", "åtkomst nekad", "internt serverfel", "tjänsten är inte tillgänglig", "underhåll pågår", "sessionen har gått ut", "logga in för att", "ett fel uppstod", "ett fel inträffade", "något gick fel", "försök igen senare", "för många förfrågningar",
    # Turkish
    "sayfa bulunamadı", "sayfa mevcut değil", "erişim engellendi", "erişim reddedildi", "sunucu hatası", "hizmet kullanılamıyor", "bakım çalışması", "bakımdayız", "oturumunuzun süresi doldu", "giriş yapmalısınız", "lütfen giriş yapın", "bir hata oluştu", "bir şeyler ters gitti", "daha sonra tekrar deneyin", "çok fazla istek",
    # Russian
    "страница не найдена", "страница удалена", "тема удалена", "доступ запрещ*", "ошибка сервера", "внутренняя ошибка", "сервис недоступен", "сервер недоступен", "технические работы", "войдите, чтобы", "войдите в систему", "сессия истекла", "попробуйте позже", "произошла ошибка", "слишком много запросов",
    # Arabic
    "الصفحة غير موجودة", "لم يتم العثور على الصفحة", "تم رفض الوصول", "الوصول مرفوض", "خطأ في الخادم", "خطأ داخلي", "الخدمة غير متوفرة", "الموقع تحت الصيانة", "تحت الصيانة", "انتهت صلاحية الجلسة", "يرجى تسجيل الدخول", "حدث خطأ", "حاول مرة أخرى",
    # Japanese, Chinese, Korean
    "ページが見つかりません", "ページは見つかりません", "お探しのページ", "アクセスが拒否", "アクセスできません", "サーバーエラー", "エラーが発生しました", "メンテナンス中", "ログインしてください", "セッションの有効期限", "しばらくしてから", "页面不存在", "找不到页面", "页面未找到", "访问被拒绝", "服务器错误", "请登录", "系统维护", "페이지를 찾을 수 없습니다", "접근이 거부", "로그인이 필요합니다", "점검 중입니다",
)

# What a page says of something that is not there.
THINGS = ("page", "post", "thread", "topic", "question", "answer", "document", "address", "file", "url")
FATES = ("has been removed", "has been deleted", "was removed", "was deleted", "cannot be found", "can not be found", "could not be found", "was not found", "cannot be loaded", "could not be loaded", "does not exist", "doesn't exist", "is unavailable", "is not available", "is no longer available", "is gone")

# Stand-in texts. A label and what stands for its content are combined by a rule.
LABELS = ("answer", "question", "content", "body", "text", "title", "description", "heading", "details", "summary", "inhalt", "antwort", "frage", "titel", "beschreibung", "contenido", "respuesta", "pregunta", "título", "descripción", "conteúdo", "resposta", "pergunta", "descrição", "contenu", "réponse", "titre", "contenuto", "risposta", "comment", "post", "page")
STUBS = ("to follow", "to come", "empty", "none", "missing", "n/a", "n/a yet", "pending", "tbd", "tba", "todo", "coming soon", "goes here", "here", "folgt", "folgt in kürze", "not written yet", "not available yet", "will follow", "to be added", "to be written", "placeholder")
FILLER_PHRASES = (
    # English
    "lorem ipsum", "dolor sit amet", "coming soon", "not written yet", "nothing here yet", "no description", "sample row", "sample data", "to be announced", "under construction", "sample answer", "sample text", "sample question", "sample post", "example text", "dummy text", "dummy copy", "more dummy copy",
    "dummy answer", "filler text", "placeholder text", "paragraph one", "paragraph two", "your text here", "text goes here", "goes here", "your comment here", "write your comment here", "your answer here", "your question here", "write your answer", "write your text", "type your answer", "type your text", "insert text", "insert your", "enter your text", "click to edit",
    "click here to edit", "add the accepted answer", "add your text", "add your answer", "fill in before launch", "fill in later", "fill in", "paste body", "paste the body", "replace me", "replace this text", "change me", "delete this text", "this is a test", "just a test", "test post", "test message", "hello world", "no content", "the quick brown fox", "jumps over the lazy dog",
    # Spanish
    "texto de ejemplo", "contenido de ejemplo", "texto de relleno", "texto de prueba", "texto provisional", "respuesta de ejemplo", "próximamente", "escriba aquí", "escribe aquí", "aquí va el texto", "aquí irá el texto", "pendiente de redactar",
    # Portuguese
    "texto de exemplo", "conteúdo de exemplo", "texto de teste", "texto provisório", "resposta de exemplo", "em breve", "a substituir", "escreva aqui", "aqui vai o texto", "aqui virá o texto", "a preencher",
    # French
    "texte d'exemple", "contenu d'exemple", "texte de remplissage", "texte provisoire", "à remplacer avant publication", "faux texte", "réponse d'exemple", "bientôt disponible", "écrivez ici", "votre texte ici", "à compléter",
    # German
    "beispieltext", "blindtext", "platzhaltertext", "mustertext", "musterantwort", "hier steht später der text", "hier steht später", "hier steht der text", "text folgt", "folgt in kürze", "demnächst verfügbar", "inhalt folgt",
    # Italian, Dutch, Polish, Swedish, Turkish
    "testo di esempio", "testo segnaposto", "testo di prova", "prossimamente", "inserisci qui", "voorbeeldtekst", "opvultekst", "binnenkort beschikbaar", "typ hier", "przykładowy tekst", "tekst zastępczy", "wkrótce dostępn*", "wpisz tutaj", "exempeltext", "platshållartext", "kommer snart", "skriv här", "örnek metin", "yer tutucu metin", "çok yakında",
    # Russian, Arabic
    "пример текста", "текст заполнитель", "здесь будет текст", "здесь будет", "скоро будет", "пример ответа", "введите текст", "тестовый текст", "рыба текст", "текст появится", "نص تجريبي", "هذا النص هو مثال", "قريبا",
    # Japanese, Chinese, Korean
    "サンプルテキスト", "ダミーテキスト", "ここに本文", "ここにテキスト", "ここに入力", "準備中です", "近日公開", "示例文本", "占位符", "此处填写", "敬请期待", "샘플 텍스트",
)

# What notices and error pages say besides. It proves nothing, but where a phrase is found it belongs to the notice.
CONTEXT_PHRASES = (
    # English
    "the rest of the thread", "the rest of the answer", "this page", "this site", "this board", "this view", "this forum", "this thread", "this post", "this document", "this address", "this topic", "this answer", "this question", "this content", "this check", "this server", "that page", "that post", "that document", "that address", "that thread", "that topic", "that question", "that answer", "our site", "our side", "your browser", "the thread", "the board", "the page", "the site",
    "please", "sorry", "we are sorry", "we're sorry", "oops", "hmm", "one moment", "just a moment", "loading", "if nothing happens", "to view", "to see", "to read", "to continue", "to go on", "to go on reading", "to use", "to proceed", "and reload", "and try again", "try again later", "in your browser", "on this server", "for this site", "for this page", "for this address", "it will take a few seconds", "this takes a few seconds", "you will be redirected",
    "at least", "characters", "has it disabled", "has it turned off", "has it switched off", "is disabled", "is turned off", "cannot be shown", "can not be shown", "may be", "is too old", "too old", "turn it on", "switch it on", "allow it", "accept them", "wait", "wait a moment", "seconds", "minutes", "hours", "by utc", "utc", "in a few minutes", "reference", "ref", "ray", "ray id", "request id", "requestid", "incident", "error", "error code", "error id", "code", "status", "message", "id", "host", "http", "server",
    "to view it", "to see it", "to read it", "to see this thread", "to read this answer", "forbidden", "unauthorized", "gone", "not found", "was not found", "the requested", "heading", "untitled", "accepted answer", "answer by", "score", "asked by", "question", "answer", "title", "tags", "body", "content", "text", "item", "hi", "hello", "hallo", "hola", "bonjour", "dear", "regards", "best regards", "kind regards", "viele grüße", "mit freundlichen grüßen", "saludos", "cordialement", "atenciosamente", "is required", "are required",
    # Spanish, Portuguese
    "volver a la página de inicio", "voltar à página inicial", "para ver esta página", "para ver las respuestas", "para leer", "para continuar", "en su navegador", "en tu navegador", "antes de seguir", "este sitio", "este foro", "esta página", "este hilo", "su navegador", "por favor", "para ver este hilo", "para leer las respuestas", "para ver esta página", "para ver as respostas", "no seu navegador", "este fórum", "este tópico", "é necessário", "é preciso", "para ler", "por favor", "antes de continuar", "mais tarde",
    # French, Italian
    "pour afficher cette page", "afin de voir la page", "afin de voir", "afin de lire", "la page", "retour à l'accueil", "pour voir cette page", "pour voir les réponses", "pour lire", "pour continuer", "dans votre navigateur", "votre navigateur", "ce site", "ce forum", "cette page", "ce fil", "veuillez", "il faut", "plus tard", "torna alla home", "torna alla pagina iniziale", "per visualizzare", "per continuare", "nel tuo browser", "nel browser", "questa pagina", "questo sito", "per favore", "più tardi",
    # German, Dutch, Swedish
    "zurück zur startseite", "terug naar de startpagina", "tillbaka till startsidan", "um diese seite zu sehen", "um diese seite anzuzeigen", "um fortzufahren", "zum lesen der antworten", "zum lesen", "zum antworten", "für diese seite", "im forum", "diese seite", "dieses forum", "in ihrem browser", "ihr browser", "im browser", "bitte", "nötig", "dieses thema", "später erneut", "der antwort", "der frage", "om deze pagina te bekijken", "om door te gaan", "deze pagina", "deze site", "in uw browser", "uw browser", "alstublieft", "för att visa sidan", "för att fortsätta", "i din webbläsare", "din webbläsare", "den här sidan", "vänligen",
    # Polish, Turkish
    "aby zobaczyć tę stronę", "aby wyświetlić", "aby kontynuować", "w swojej przeglądarce", "w przeglądarce", "ta strona", "proszę", "bu sayfayı görüntülemek için", "devam etmek için", "tarayıcınızda", "tarayıcınız", "bu sayfa", "bu site", "lütfen",
    # Russian, Arabic
    "для просмотра страницы", "для просмотра ответов", "для просмотра", "чтобы продолжить", "чтобы увидеть ответы", "чтобы читать", "в браузере", "в вашем браузере", "пожалуйста", "эта страница", "на этой странице", "этой страницы", "для работы", "ответов", "в вашем متصفح", "يرجى", "في متصفحك", "لعرض هذه الصفحة", "للمتابعة", "هذه الصفحة", "هذا الموقع",
    # Japanese, Chinese, Korean
    "このページを表示するには", "このページは", "このスレッドを", "表示するには", "読むには", "続けるには", "続行するには", "にしてください", "してください", "ブラウザの", "ブラウザで", "回答を", "お手数ですが", "本页面", "请在浏览器中", "以继续", "后重试", "계속하려면", "브라우저에서", "해 주세요",
)

#: Stand-in words: those of the common lorem ipsum texts, and what is typed to fill a field. A text of nothing else is filler.
FILLER_WORDS = (
    # The passage of which lorem ipsum is made, and what its generators add from the same book.
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea "
    "commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
    "pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas vestibulum tortor quam feugiat vitae ultricies eget ante donec libero semper mauris placerat eleifend leo praesent dapibus neque felis cursus "
    "aenean fermentum tempus phasellus ultrices nullam varius integer posuere erat a at vel nec viverra maecenas mi massa risus sapien sodales sagittis scelerisque suspendisse pretium purus pulvinar vivamus vehicula urna tellus tincidunt "
    "ornare odio nibh nam metus mattis lectus lacus lacinia justo imperdiet iaculis hendrerit gravida fusce fringilla faucibus facilisis euismod etiam dui diam dignissim curabitur cras convallis congue condimentum bibendum auctor arcu aliquet accumsan"
).split()
KEYED_WORDS = (
    "foo bar baz qux quux spam eggs test testing tests asdf asdfg asdfgh asd sdf qwer qwert qwerty qwertz yxcv zxcv zxcvb jklö jkl hjkl dfgh fghj uiop wasd xyz xxx xxxx abc abcd blah bla blub yada lalala dummy filler placeholder sample row val null na "
    "copy word words sentence paragraph heading item text more some until here final arrives goes todo tbd tba fixme lipsum n/a"
).split()


def phrases() -> Iterator[str]:
    """Everything that stands for residue."""
    yield from SCRIPT_PHRASES
    yield from (f"{a} {b}" for a, b in product(ASKS, ASKED))
    yield from (f"{a} {b} {c}" for a, b, c in product(ORDERS, ASKED, PURPOSES))
    yield from (f"{a} {b}" for a, b in product(ASKED, STATES))
    yield from (f"without {b} {c}" for b, c in product(ASKED, STATES))
    yield from ERROR_PHRASES
    yield from (f"{a} {b} {c}" for a, b, c in product(("that", "this", "the requested"), THINGS, FATES))
    yield from FILLER_PHRASES
    yield from (f"{a} {b}" for a, b in product(LABELS, STUBS))
    for status in HTTPStatus:
        if status >= 400:
            yield from (f"{status.value} {status.phrase.lower()}", f"status {status.value} message {status.phrase.lower()}", f"error {status.value}", f"status {status.value}", f"http {status.value}", f"error {status.phrase.lower()}", f"error code {status.phrase.lower()}", f"error code {status.phrase.lower().replace(' ', '')}")
    yield from (f"{word} {digit}*" for word, digit in product(("error", "fehler", "erreur", "erro", "error code", "ошибка"), range(10)))
