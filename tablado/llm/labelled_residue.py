"""Hand-labelled sentences: residue by family, and prose that only mentions, quotes or explains such things.

All lists are fixed values: example sentences as they stand in texts.  Numbers, proper names (``{name}``) and the inside
of placeholders are slots and carry no weight.
"""

RESIDUE = {
    "template": [
        "Título: {{ titulo }}", "Precio: {{ precio }}", "Price: {{ price }}", "Fecha: {{ fecha }}", "Lugar: {{ lugar }}", "Sobre el plan: {{ descripcion }}", "Title: {{ title }}",
        "Fecha: undefined — Precio: NaN € — Sala: null", "Precio: undefined", "Título: null", "Sala: NaN", "Date: undefined", "undefined undefined", "PLAN_TITLE_PLACEHOLDER",
    ],
    "editor": [
        "Texto de prueba.", "Sustituir antes de publicar.", "Sustituir por un texto de ejemplo - borrador", "Aquí va el titular antes de publicar", "Aquí va el nombre de la sala antes de publicar",
        "Aquí va un texto de ejemplo (redacción)", "Aquí va la entradilla máx. 200 caracteres.", "Añadir la entradilla (redacción)", "Añadir el nombre de la sala - borrador", "Añadir un texto de ejemplo - borrador",
        "Falta el titular (redacción)", "Falta la entradilla (redacción).", "Falta el titular máx.", "Falta un texto de ejemplo (redacción)", "Escribe aquí la descripción del evento (máximo 300 caracteres).", "300 caracteres", "Insertar aquí el nombre de la sala",
        "Descripción corta del plan.", "Descripción larga del plan.", "Sample event text, replace me.", "Insert description here.", "Placeholder text, do not publish.", "Your text here.", "Pendiente de redactar - borrador", "Texto pendiente (redacción)", "Escribir el titular máx.", "Poner el nombre de la sala antes de publicar",
    ],
    "filler": [
        "Lorem ipsum dolor sit amet consectetur adipiscing elit", "sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
        "Ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat",
        "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur",
        "Excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum",
        "lorum ipsem dolet sitam consectus adipit elitra sedum tempora incidur laborem magnat aliquam veniat nostrus ullamo nisus commodus duisat irurem velitar cupidor fugiam pariatem",
        "asdf asdf asdf", "xxx xxx xxx", "blah blah blah", "bla bla bla",
    ],
    "error": [
        "404 Not Found — the requested event page could not be located", "503 Service Unavailable: backend fetch failed", "502 Bad Gateway", "500 Internal Server Error", "Error 504 al abrir /planes/",
        "Error interno del servidor (500)", "Fatal error: Uncaught TypeError in /agenda/plan.php on line 88", "Warning: undefined index 'sala' in /srv/agenda/30/ficha.php", "Tiempo de espera agotado al conectar con la base de datos",
        "Acceso denegado.", "No tienes permiso para ver este plan.", "Demasiadas peticiones desde tu dirección.", "La sesión ha caducado, inicia sesión otra vez", "La ficha de {name} ya no está publicada.", "Prueba con el buscador.",
        "404: no encontramos lo que buscas en {name}", "La página que buscas no existe o ha cambiado de sitio.", "This listing is no longer available.", "Please return to the home page.", "Oops! The server answered 503 for this concert.", "The server answered 404 for this concert.", "Go back",
        "HTTP 404 - {name} no disponible", "Código de incidencia: a9f3", "Lo sentimos, el servidor no está disponible.", "Lo sentimos, este plan no responde", "Lo sentimos, la ficha del concierto ha dejado de existir en nuestra web", "Lo sentimos, el servidor no se ha encontrado",
        "Ups, la página solicitada no está disponible", "Vaya, este plan ha dejado de existir en nuestra web.", "Vaya, la ficha del concierto no responde", "Atención, el servidor no está disponible", "Atención, la página solicitada no se ha encontrado", "Vaya, el servidor no responde.",
        "Estamos de mantenimiento.", "La agenda volverá pronto.", "Sitio en mantenimiento, vuelve más tarde.", "We are down for maintenance.", "Access denied.", "Page not found.", "Something went wrong, please try again later.", "Too many requests.", "Your session has expired, log in again.",
    ],
    "scripts": [
        "Activa JavaScript en tu navegador para ver la cartelera.", "Activa los scripts en tu navegador y recarga.", "Activa la ejecución de scripts para ver la cartelera", "Necesitas activar las cookies y los scripts antes de consultar este plan", "Necesitas activar JavaScript en tu navegador y recarga.",
        "Habilita la ejecución de scripts para ver la cartelera", "Habilita JavaScript en tu navegador y recarga", "Habilita los scripts antes de consultar este plan", "Por favor, permite la ejecución de scripts antes de consultar este plan.", "Por favor, permite las cookies y los scripts en tu navegador y recarga", "Por favor, permite JavaScript para ver la cartelera",
        "Esta página no funciona sin scripts.", "Revisa la configuración de tu navegador.", "Cargando contenido… si no aparece nada, permite los scripts.", "Cargando contenido…", "si no aparece nada, permite los scripts",
        "You need to enable JavaScript to run this app.", "Your browser is not supported; scripts are required.", "Please enable JavaScript and cookies to see the line-up", "Please enable a browser with scripts and reload the page.", "Please enable scripts to continue (code 7)", "This page requires JavaScript and reload the page.", "This page requires a browser with scripts to see the line-up",
        "Turn on JavaScript and cookies to see the line-up", "Turn on a browser with scripts (code 7)", "Turn on scripts to continue.", "We could not load the tickets without JavaScript to continue", "We could not load the tickets without scripts and cookies", "Please turn off your ad blocker and reload.",
        "Comprobando que no eres un robot.", "Un momento…", "Para continuar, marca la casilla y demuestra que eres una persona.", "Estamos comprobando que no eres un robot antes de abrir la agenda", "Estamos comprobando la conexión esto puede tardar unos segundos", "Verificando que eres una persona no cierres la ventana", "Verificando tu navegador antes de abrir la agenda",
        "Confirma que eres una persona un momento", "Confirma que no eres un robot esto puede tardar unos segundos.", "Confirma tu navegador antes de abrir la agenda", "Comprobando la conexión no cierres la ventana", "Checking your browser before accessing the site.", "Verify that you are a human.", "Please complete the captcha to continue.",
    ],
}

MENTIONS = [
    "El museo cerró por mantenimiento el lunes y reabrió el martes con las salas recién pintadas.", "Una charla sobre tipografía recuerda que el Lorem ipsum nació como texto de relleno para impresores.",
    "En el curso de programación se explica por qué JavaScript sigue siendo la lengua común del navegador.", "El taller enseña a escribir plantillas: quien ponga {{ titulo }} entre llaves verá aparecer el título de cada obra.",
    "La poeta {name} copia a mano el aviso que pide activar los scripts y lo convierte en una canción sobre sal.", "{name} abre su novela con un ordenador que repite undefined hasta que alguien le contesta.",
    "La compañía {name} estrena Acceso denegado, una comedia sobre puertas que no se abren.", "El archivo guarda los carteles con nombres como [[SALA]] o %%NOMBRE%%, un sistema que {name} inventó para catalogar semillas.",
    "Cada asistente recibe una tarjeta con las palabras [tu nombre aquí] bordadas en hilo, obra de {name}.", "Visitors laugh at the sign reading Your city here, painted by {name} on a wall of glass.",
    "The essay asks why {name} named the album Page Not Found and printed a fake server error on the sleeve.", "La muestra «Error 404» reúne carteles de páginas perdidas que {name} fotografió durante años.",
    "El ensayo explica que los huecos como {{nombre}} marcan en una plantilla lo que falta por rellenar.", "The lecture explains what placeholders such as {{name}} mean in a template.", "El robot del escenario pregunta a cada espectador si es una persona.",
]
