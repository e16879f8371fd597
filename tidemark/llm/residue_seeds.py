"""Known residue: texts of which copies and near-duplicates are residue wherever they stand.

The seeds of the graph in ``residue``. Case, punctuation, accents and the digits of numbers play
no part, so "HTTP ERROR 500" stands for every number. Texts with an open part, such as the name
of what failed, are left to ``residue_rules``.
"""

from __future__ import annotations

#: The status texts of the web.
STATUS = {
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable", 407: "Proxy Authentication Required", 408: "Request Timeout",
    409: "Conflict", 410: "Gone", 429: "Too Many Requests", 451: "Unavailable For Legal Reasons", 500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout",
    505: "HTTP Version Not Supported", 520: "Web server is returning an unknown error", 521: "Web server is down", 522: "Connection timed out", 524: "A timeout occurred",
}
FORMS = ("{code} {text}", "{text}", "Error {code}: {text}", "{text} ({code})", "HTTP {code} {text}", "HTTP Error {code} - {text}", "HTTP/1.1 {code} {text}", "{text} error {code}", "Error {code} ({text})!!1", "{text} nginx", "{code} {text} nginx",
         "<title>{code} {text}</title>", "<html><head><title>{code} {text}</title></head><body><h1>{text}</h1><hr>edge-1</body></html>", "<html><head><title>{code} {text}</title></head><body><h1>{text}</h1><hr>nginx</body></html>",
         "<html><head><title>{code} {text}</title></head><body><center><h1>{code} {text}</h1></center><hr><center>nginx</center></body></html>")
#: Words that are a sentence of prose by themselves are no seeds alone.
ALONE = {"Conflict", "Gone"}

FILLER = """
Lorem ipsum dolor sit amet
Lorem ipsum dolor sit amet, consectetur adipiscing elit
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum
Your content here
Your content goes here
Your text here
Your text goes here
Your title here
Your headline here
Your company name here
Your logo here
Your image here
Your message here
Your summary here
Add your text here
Sample text
Dummy text
Placeholder
Placeholder text
Filler text
Example text
Test page
This is a test page
This is a placeholder
This is a sample page
Sample paragraph 1
Sample page 1
Sample title
Sample heading
Example heading
Heading 1
Headline 1
Subheading 1
Title 1
Subtitle 1
Paragraph 1
Column 1
Item 1
Caption 1
Section title
Click to edit
Click here to edit
Click to edit this text
Click to edit this text block
Double click to edit
Double-click to edit this text
Click here to add text
Click to add title
Replace this text
Replace this text with your own
Replace this paragraph with your own words
Write a short summary of the article in this space
Write a short description of the article in this space
Write something about yourself
No need to be fancy, just an overview
Insert caption
Insert date
Insert title
Insert image
Insert name
Insert text
Insert summary
(no description)
(no image)
(no summary)
(no title)
(no caption)
(no text)
(no content)
(no data)
(no photo)
Sector: choose one
Country: choose one
Category: choose one
Choose one
Select one
Select an option
Summary (max. 300 characters)
Description (max. 300 characters)
TBD
TBA
TBC
To be announced
To be determined
To be confirmed
To be written
To be added
To be supplied
To be provided
To be completed
To be defined
To be filled in
To be continued
To be added later
To be added soon
Will be added soon
Will be added later
Content will be added soon
Summary will be added soon
Text will be added soon
Description will be added soon
More will be added soon
More information will be added soon
Coming soon
Content coming soon
Text coming soon
Content pending
Under construction
This page is under construction
This section is under construction
This site is under construction
This article is under construction
This section is empty
This page is empty
This article is empty
This page intentionally left blank
This page has been left blank
This section has been left empty
N/A
NA
XXX
FIXME
TODO
TODO write
TODO write intro
TODO write me
TODO write this section
TODO add figures for 2000
TODO add source
TODO add summary
TODO add image
FIXME summary missing
FIXME source missing
Test test
Test test test
Test test 123
Test test 123 test page, please ignore
Testing testing 123
Test, please ignore
asdf
asdf asdf
asdf asdf qwer asdf
qwertz
foo bar baz
Überschrift hier eingeben
Titel hier eingeben
Text hier eingeben
Text hier einfügen
Name hier eingeben
Beschreibung hier eingeben
Hier Text eingeben
Hier steht Ihr Text
Hier steht später Ihr Text
Hier steht bald Ihr Text
Hier steht später der Text
Hier folgt der Text
Hier folgt noch ein Text
Hier entsteht eine neue Seite
Hier entsteht in Kürze eine neue Internetpräsenz
Platzhalter
Platzhaltertext
Blindtext
Beispieltext
Mustertext
Text folgt
Inhalt folgt
Inhalt folgt in Kürze
In Bearbeitung
Dieser Abschnitt ist leer
Dieser Abschnitt ist noch leer
Diese Seite ist noch leer
Diese Seite befindet sich im Aufbau
Dieser Abschnitt wird noch ergänzt
Dieser Artikel wird noch ergänzt
Titre de la section
Titre de l'article
Texte du paragraphe
Titre ici
Votre texte ici
Votre titre ici
Insérez votre texte ici
Insérez votre titre ici
Insérez le texte ici
Saisissez votre texte ici
Écrivez votre texte ici
À compléter
À rédiger
À venir
Bientôt disponible
Texte de remplissage
Faux texte
Page en construction
Site en construction
Cette section est vide
Cette page est vide
Cette section sera complétée
Cette section sera complétée prochainement
Ce paragraphe sera ajouté plus tard
Escriba aquí
Escriba aquí el texto
Escriba aquí el resumen
Escriba aquí el resumen del artículo
Escriba aquí el título del artículo
Escriba su texto aquí
Introduzca el texto aquí
Inserte su texto aquí
Su texto aquí
Tu texto aquí
Título aquí
Título de la sección
Título del artículo
Texto de relleno
Texto de ejemplo
Contenido pendiente
Por completar
Pendiente de redactar
Próximamente
En construcción
Página en construcción
Sitio en construcción
Esta sección está vacía
Esta página está vacía
Esta sección se completará más adelante
"""

ERRORS = """
Oops
Oops, something went wrong
Whoops, looks like something went wrong
Uh-oh
Sorry, something went wrong
Something went wrong
Something went wrong, please try again
Something went wrong, please try again later
Something went wrong while loading this page
Something went wrong while loading the rest of this article
An error occurred
An error has occurred
An unexpected error occurred
An unexpected error has occurred
An internal error occurred
An unknown error occurred
An error occurred while processing your request
There was a problem loading this page
Sorry, this page isn't available
Sorry, the page you were looking for does not exist
Sorry, the page you were looking for could not be found
Sorry, the page you are looking for does not exist
Sorry, the page you are looking for could not be found
Sorry, that page doesn't exist
The page you are looking for doesn't exist
The page you requested could not be found
The page you requested was not found
The requested page could not be found
The requested URL was not found on this server
The requested resource is not available
We couldn't find that page
We could not find that page
We can't find the page you are looking for
We could not load this page
Page not found
File not found
Page not available
This page isn't working
This page isn't working right now
This page isn't available
This page is no longer available
This content isn't available right now
This content is not available in your country
This site can't be reached
This video is unavailable
The link you followed is probably broken
The link you followed may be broken, or the page may have been removed
The server could not handle your request
The server encountered an internal error and was unable to complete your request
The server is temporarily unable to service your request
The server did not respond
Server error
Internal error
HTTP error 500
HTTP 500
Error 500
Error code 500
Status code 500
Application error
Application error: a client-side exception has occurred
Fatal error
Fatal error: Uncaught exception in /srv/app/view.php:1
Unknown error
Unexpected error
Network error
Database error
Proxy error
Runtime error
Parse error
Error: upstream request timed out
Error: upstream request timed out (48000 ms)
Upstream request timeout
Upstream connect error or disconnect/reset before headers
Request timed out
The request timed out
Connection timed out
Connection refused
Connection reset
Connection failed
Connection lost
Connection closed
The connection was reset
The connection has timed out
Request failed
Request blocked
Request entity too large
No healthy upstream
Bad gateway
Gateway time-out
Service temporarily unavailable
Service temporarily unavailable, please try again later
Service temporarily unavailable, the operators have been told
The service is temporarily unavailable
Temporarily unavailable
We are down for maintenance
We are down for scheduled maintenance
We are currently down for maintenance
We'll be back soon
We will be back soon
This site is down for maintenance
Down for maintenance
Scheduled maintenance
Under maintenance
Site under maintenance
Database connection failed
Database connection error
Database query failed
Error establishing a database connection
Error establishing database connection
Could not connect to the database
Access denied
Access to this page has been denied
Access forbidden
Permission denied
You do not have permission to access this page
You don't have permission to access this resource
You are not authorized to view this page
Your session has expired
Your session has expired, please log in again
Session expired
Session timed out
Your address was blocked
Your address was blocked after 100 requests
Your IP address has been blocked
Your access has been blocked
Your request has been blocked
Rate limit exceeded
Rate limit reached
Quota exceeded
Too many requests
Too many requests, please try again later
Checking your browser
Checking your browser before you go on
Checking your browser before accessing this site
Verifying you are human
Verify you are human
Verify that you are human
Are you a robot
I'm not a robot
Please complete the captcha
Please complete the security check to access this site
Please verify you are a human
Loading
Loading...
Loading, please wait
Please wait
Please wait...
Please try again later
Failed to load
Failed to load resource
Failed to fetch
Failed to connect
Could not load the page
Unable to load the page
Unable to connect
Traceback (most recent call last)
Segmentation fault
Segmentation fault (core dumped)
Core dumped
Out of memory
Stack trace
Hoppla
Hoppla, da ist etwas schiefgelaufen
Ups
Seite nicht gefunden
Datei nicht gefunden
Seite nicht verfügbar
Seite existiert nicht
Diese Seite gibt es nicht
Diese Seite gibt es nicht mehr
Diese Seite existiert nicht
Diese Seite existiert nicht mehr
Diese Seite ist nicht verfügbar
Die Seite wurde nicht gefunden
Die angeforderte Seite wurde nicht gefunden
Die angeforderte Seite existiert nicht
Die gesuchte Seite wurde nicht gefunden
Die angeforderte Adresse ist auf diesem Server nicht vorhanden
Die angeforderte Seite ist auf diesem Server nicht vorhanden
Interner Serverfehler
Interner Fehler
Serverfehler
Fehler 404
Fehler 404 Seite nicht gefunden
Es ist ein Fehler aufgetreten
Es ist ein unerwarteter Fehler aufgetreten
Es ist ein interner Fehler aufgetreten
Ein Fehler ist aufgetreten
Leider ist ein Fehler aufgetreten
Wartungsarbeiten
Wartungsarbeiten: Dieser Dienst ist zurzeit nicht erreichbar
Dieser Dienst ist zurzeit nicht erreichbar
Der Dienst ist derzeit nicht verfügbar
Der Server ist vorübergehend nicht erreichbar
Die Seite ist zurzeit nicht erreichbar
Zugriff verweigert
Zugriff gesperrt
Zugang verweigert
Ihre Sitzung ist abgelaufen
Sitzung abgelaufen
Zu viele Anfragen
Bitte versuchen Sie es später erneut
Bitte warten
Page introuvable
Page non trouvée
Fichier introuvable
Contenu introuvable
Contenu indisponible
Page indisponible
La page demandée est introuvable
La page demandée n'existe pas
La page demandée n'existe plus
La page que vous recherchez n'existe pas
La page que vous cherchez est introuvable
Cette page n'existe pas
Cette page n'existe plus
Erreur 404
Erreur 404 page introuvable
Erreur interne
Erreur interne du serveur
Erreur serveur
Erreur inattendue
Erreur : la ressource demandée n'existe plus sur ce serveur
Erreur : la page demandée n'existe plus sur ce serveur
Une erreur est survenue
Une erreur s'est produite
Une erreur inattendue est survenue
Le service est momentanément indisponible
Le service est momentanément indisponible, réessayez plus tard
Le serveur est momentanément indisponible
Le site est en maintenance
Service indisponible
Serveur indisponible
Maintenance en cours
Accès refusé
Accès interdit
Votre session a expiré
Trop de requêtes
Oups
Veuillez patienter
Página no encontrada
Página no disponible
Archivo no encontrado
Contenido no disponible
No se encuentra la página
No se encuentra la página solicitada
No se ha encontrado la página
No se ha encontrado la página solicitada
No se encontró la página
No se puede mostrar la página
No se pudo cargar la página
La página no existe
La página que busca no existe
La página que busca ya no existe
La página solicitada no existe
El contenido que busca ya no está disponible
Error: el contenido que busca ya no está disponible en este servidor
Esta página no existe
Esta página ya no existe
Error interno
Error interno del servidor
Error del servidor
Error inesperado
Ha ocurrido un error
Ha ocurrido un error inesperado
Se ha producido un error
Se ha producido un error inesperado
El servicio no está disponible
El servicio no está disponible en este momento
El servidor no responde
El servidor está fuera de servicio
El sitio está en mantenimiento
Servicio no disponible
En mantenimiento
Estamos en mantenimiento
Acceso denegado
Acceso prohibido
Su sesión ha caducado
Su sesión ha expirado
Demasiadas solicitudes
Vaya
Espere, por favor
"""

SCRIPTS = """
Please enable JavaScript to view this page
Please enable JavaScript to continue
Please enable JavaScript and cookies to continue
Enable JavaScript and cookies to continue
You need to enable JavaScript to run this app
You need to have JavaScript switched on in order to use this application
JavaScript is disabled in your browser
JavaScript is disabled in your browser, some features will not work
JavaScript is required to view this page
This site requires JavaScript
This site needs scripts to run
Scripts and cookies must be allowed
Your browser does not run scripts, so the chart cannot be shown
Your browser does not support JavaScript
Bitte aktivieren Sie JavaScript
Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen
Für diese Anwendung müssen Skripte im Browser erlaubt sein
Diese Seite benötigt JavaScript
Veuillez activer JavaScript
Veuillez activer JavaScript pour afficher cette page
Cette application a besoin de scripts, votre navigateur les bloque
Ce site nécessite JavaScript
Active JavaScript para ver esta página
Habilite JavaScript para ver esta página
Su navegador tiene los scripts desactivados y esta aplicación no puede cargarse
Este sitio requiere JavaScript
"""


def known_residue() -> list[str]:
    """All seeds: the listed texts and each status text in each form."""
    listed = [line for part in (FILLER, ERRORS, SCRIPTS) for line in part.strip().splitlines()]
    return listed + [form.format(code=code, text=text) for code, text in STATUS.items() for form in FORMS if not (text in ALONE and form == "{text}")]
