"""Hand-labelled lines of listing pages, from which training pages are put together.

All lists are fixed values: example lines as they stand on pages, with ``{site}`` for a site's name,
``{plan}`` for the title of another plan, ``{n}`` for a number, ``{name}`` for a person and ``{word}`` for a word of a title.
"""

MENU_WORDS = [
    "Inicio", "Agenda", "Planes", "Conciertos", "Teatro", "Cine", "Exposiciones", "Restaurantes", "Escapadas", "Barrios",
    "Con niños", "Gratis", "Tienda", "Mapa", "Blog", "Newsletter", "Buscar", "Mi cuenta", "Contacto", "English",
    "Portada", "Noticias", "Cultura", "Música", "Ocio", "Menú", "Suscripción", "Iniciar sesión", "Registrarse",
]
MENU_SIGNS = [" - ", " | ", " / ", " > ", " · ", " • ", "  ", " » "]

COOKIE_STARTS = [
    "Usamos cookies propias y de terceros", "Esta web emplea tecnologías de seguimiento", "Este sitio guarda cookies",
    "Nos importa tu privacidad", "Valoramos su intimidad", "Nosotros y nuestros socios almacenamos datos",
    "We and our partners store information on your device", "Al seguir navegando aceptas nuestras cookies",
    "Utilizamos cookies", "This website uses cookies", "We value your privacy",
]
COOKIE_PURPOSES = [
    "para recordar tus preferencias.", "para mostrarte contenido a tu gusto.", "para medir las visitas.", "y elaborar perfiles de uso.",
    "con fines analíticos.", "para que todo funcione mejor.", "to measure audiences.", "to improve your experience.",
]
COOKIE_BUTTONS = [
    "Aceptar todo · Rechazar · Configurar", "Accept all / Manage choices", "Gestionar opciones", "Consulta cómo retirarlas",
    "Más información en nuestra política", "Pulsa Aceptar para continuar", "Entendido", "Aceptar y cerrar",
]

FURNITURE = [
    "Compartir", "Imprimir", "Guardar", "Enviar por correo", "Copiar enlace", "Leer más", "Ver más", "Ver todos", "Volver arriba", "Saltar al contenido",
    "Síguenos en todas nuestras redes", "Síguenos en redes sociales", "¿Te ha gustado? Compártelo: Correo, Enlace, Tablón", "Comparte este plan con tus amigos",
    "Suscríbete y recibe cada jueves los mejores planes en tu correo", "Apúntate a nuestro boletín semanal", "Únete a {n} lectores de {site}",
    "Descárgate la aplicación de {site} y no te pierdas nada", "Deja tu comentario ({n})", "{n} comentarios", "{n} personas han guardado esta página",
    "Comentarios cerrados", "Escribe un comentario", "{plan} — {n} comentarios", "Responder · Me gusta · Denunciar",
    "Publicado por Redacción {site} el {n}/{n}/2026 · Lectura de {n} minutos", "Por Redacción {site}", "Actualizado el {n}/{n}/2026 a las {n}:{n}", "Texto: Redacción · Fotos: archivo",
    "Este artículo contiene enlaces de afiliación", "Contenido patrocinado", "Publicidad", "Anuncio. {plan} desde {n} €", "Anuncio. {plan}",
    "Publicidad · Quiénes somos · Trabaja con {site}", "{site} · Aviso legal · Privacidad · Accesibilidad", "Aviso legal | Política de privacidad | Cookies",
    "Copyright 2026 {site}, edición digital", "© 2026 {site}. Todos los derechos reservados", "{site} 2026: prohibida la reproducción total o parcial",
    "{site} no se hace responsable de cambios de última hora", "Hecho con cariño por el equipo de {site}", "Diseño y desarrollo: {site}",
    "Recomendado por {site}: {plan}", "Relacionado · {plan}", "Siguiente plan » {plan}", "« {plan}", "También te puede interesar: {plan}", "Lo más leído: {n}. {plan}", "{plan} »", "Anterior: {plan}", "Ver también: {plan}", "No te pierdas: {plan}",
]
TEASER_HEADS = [
    "Te puede interesar", "También te puede interesar", "Lo más visto hoy", "Lo más leído", "Top de la semana", "Sigue leyendo", "Más planes en el barrio",
    "Planes cercanos", "Otros lectores miraron", "You may also like", "Artículos relacionados", "Más planes", "Recomendados", "No te lo pierdas",
]

PROGRAMME_HEADS = ["Programa:", "Actividades:", "Pases:", "Horarios:", "Precios:", "Calendario:"]
PROGRAMME = [
    "Taller de cerámica", "Taller de pan de masa madre", "Taller de acuarela", "Taller de percusión", "Taller de galletas y cookies", "Taller de plantas", "Taller de robótica", "Taller de jabón artesano",
    "Cine en la sala de calderas", "Cine en los sótanos del mercado", "Inicio del recorrido: el patio de la antigua fábrica", "Inicio del recorrido: una nave junto al río",
    "Viernes: {word} y {word}", "Sábado: {word} y {word}", "Domingo: {word} y {word}", "Mapa de {word} {word}", "Menores de {n} años: gratis", "{n}:30 {name}", "{n}:00 {name}", "{n}:00 {word} de {word}",
    "Taller de {word}", "Cine en {word}", "Teatro en el claustro", "Exposición de cuadernos", "Concierto de cierre en la azotea",
    "Contacto con la organización en la propia sala.", "Blog en directo desde el taller", "Agenda de ensayos abiertos", "Tienda de libros usados en el vestíbulo",
    "{n}:30 Apertura de puertas", "{n} de mayo: estreno", "General: {n} €", "Reducida: {n} €",
]
MAIN = [
    "Entrada libre hasta completar aforo.", "Es necesario reservar plaza.", "Duración: una hora y media.", "Horario: de martes a domingo, de 11:00 a 20:00.",
    "Acceso adaptado por la puerta lateral.", "Más información en el mostrador del recinto.", "Las entradas se venden en taquilla y en la página de la sala.",
    "Al final hay galletas, cookies y chocolate para todos.", "Contacto con la organización en la propia sala.", "El cartel rinde homenaje a la CORAÇÃO de Âmbar y a la œuvre completa de Åse.",
    "Se puede compartir mesa con otros asistentes.", "La política de privacidad y el espionaje son los temas de la obra.", "El público puede guardar un recuerdo impreso de la visita.",
    "Cada visitante acepta las normas de la sala al entrar.", "Los comentarios del autor cierran la sesión.", "La newsletter de la asociación se reparte en papel a la entrada.",
    "Precio: {n} €.", "Apertura de puertas a las {n}:00.", "No se admiten mascotas.", "Próximamente.", "Sin descripción.", "Más información en breve", "-",
]

#: Parts of titles that belong to a site: breadcrumbs, buttons and the like.
TITLE_FURNITURE = ["Leer más", "Compartir", "Comprar entradas", "Entradas", "Ver más", "Guardar", "Imprimir", "Suscríbete", "Newsletter", "Página oficial", "Web oficial", "Reservar", "Todos los planes", "Agenda de planes"]
CATEGORIES = ["Festival", "Experiencia", "Cine", "Evento", "Exposición", "Taller", "Concierto", "Museo", "Teatro", "Mercado", "Ruta", "Gastronomía"]
PLACES = ["Sala", "Teatro", "Café", "Club", "Museo", "Nave", "Palacio", "Parque", "Espacio", "Auditorio", "Bar", "Centro Cultural"]
