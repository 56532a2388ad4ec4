"""Values that define the results; every rule that needs them reads them here."""

# ---- fixed values: begin -------------------------------------------------
# Status codes and their meaning.
STATUS_MEANING = {
    "0": "ok",
    "1_1": "too many redirects",
    "1_2": "ambiguous request error",
    "1_3": "unicode error",
    "2": "page is not an article",
    "3_1": "news url equals media url",
    "3_2": "file type is not a page",
    "3_3": "irrelevant section",
    "3_4": "no topic in the url",
    "3_5": "last url word too short",
    "3_6": "news url outside the media url",
    "4": "text service error",
    "5_1": "unreadable publication time",
    "5_2": "publication time not found",
    "5_3": "publication time empty",
    "5_4": "publication time too old",
    "5_5": "title or publication time missing",
    "5_6": "article body not found",
    "5_7": "no article meta tag",
    "5_8": "no html tag",
    "5_9": "no head tag",
}

# Symbols dropped from topic lists.
TOPIC_SYMBOLS = ("?", "¿", "!", "¡", "*", "&", "#", "(", ")", "%")

# Characters that end the useful part of a link.
URL_CUT_CHARS = "?!)(=&+%@#"

# File endings that are not pages.
FILE_ENDINGS = ("xml", "pdf", "lxml", "jpg", "png", "gif")

# Url parts of sections that hold no news.
IRRELEVANT_SECTIONS = (
    "pagina-1.html", "/firmas", "/humor/", "/autor", "/autores/", "/foto/", "/fotos/",
    "/video/", "/videos/", "/opinión/", "/opinion/",
)

# Url parts that exclude a section link.
SECTION_BANNED = (
    "@", "php", "javascript", "mailto", "cookie", "feed", "contact", "legal",
    "session", "ads", "publicidad", "privacidad", "condiciones", "tags",
    "premium", "archiv", "sorteo", "newsletter", "podcast", "logout", "login",
    "notifica", "push", "servicio", "esquela", "defunci", "favorito", "firma",
    "suscri", "subscrib", "pasatiempo", "compra", "tienda", "gráfico", "grafic",
    "galeria", "opinion", "hemeroteca", "video", "play", "patrocin", "autor",
    "author", "mapa", "blog", "index", "obituario", "visual", "rss", "page",
    "person",
)

# The longer list of the exploratory section rule.
SECTION_BANNED_WIDE = (
    "@", "php", "javascript", "mailto", "cookie", "feed", "contact", "inici",
    "session", "sesion", "ads", "publicidad", "privacidad", "condiciones", "tags",
    "premium", "archiv", "sorteo", "loter", "newsletter", "podcast", "logout",
    "login", "notifica", "push", "servicio", "esquela", "defunci", "favorito",
    "firma", "suscri", "subscrib", "pasatiempo", "compra", "tienda", "gráfico",
    "humor", "foto", "grafic", "galeria", "galería", "opinion", "opinión",
    "hemeroteca", "video", "vídeo", "play", "patrocin", "autor", "author", "mapa",
    "map", "blog", "index", "mi-", "obituario", "visual", "rss",
)

# Link shapes of the exploratory section rule, and its leading scheme.
LINK_SHAPE_ABSOLUTE = r"^(?:\w*:?)\/{2}[^\/]+\/[^\/]*\/?$"
LINK_SHAPE_RELATIVE = r"^(?!(\w*:?\/{1,2}))[^\/]+\/[^\/]+\/?$"
LINK_SHAPE_NODE = r"^\/[^\/-]+-?[^\/-]*\/?$"
LINK_SCHEME = r"^(?:\w*:?\/{1,2})"

# Last url word made of one to three short pieces.
SHORT_SLUG = r"^[.a-zA-Z0-9]+(-[.a-zA-Z0-9]+){0,2}$"

# Meta property names.
PUBLISHED_META = r"publish(?:ed)?_?(?:time|date)"
MODIFIED_META = r"modif(?:ied)?_?(?:time|date)"

# Limits.
MAX_HYPHENS = 1
MIN_TOPIC_COUNT = 5
MAX_AGE_DAYS = 1
FEED_ROWS = 10
TOP_MEDIA_ROWS = 60
MAX_EDIT_DISTANCE = 2

# Constants of the special media list.
SPECIAL_MEDIA = {
    "overall": 1.0,
    "country": "Spain",
    "region": "Western Europe",
    "language": "Spanish",
}

# Topic words offered to the reader.
SUGGESTED_TOPICS = (
    "politica", "internacional", "nacional", "deporte", "ocio", "turismo",
    "tecnologia", "ciencia", "gastronomia", "viajes", "economia", "mercado",
    "vivienda", "corazon", "moda", "fashion", "educacion", "futbol", "f1",
    "baloncesto", "tenis", "golf", "rugby", "balonmano", "voleibol", "sociedad",
    "salud", "nutricion", "bienestar",
)

# Warning of a run that stored nothing.
NO_INSERT_WARNING = "0 insertions to db"

# Marker of a response without a body.
BODY_NOT_FOUND = "BodyNotFound"
# ---- fixed values: end ---------------------------------------------------
