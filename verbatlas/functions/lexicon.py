"""The word lists and patterns that decide which words and phrases count. All are Spanish,
as the transcripts they were made for. Operators that weigh words (keywords, tools, concepts, topics) take their stopwords as a
parameter; the rules of noise, fillers, claims and advice read their phrases here."""

STOPWORDS = frozenset(
    """
    a acá ahí al algo algunas algunos ante antes aquí así aunque cada casi como con contra cual cuando
    de del desde donde dos e el ella ellas ellos en entre era eran es esa esas ese eso esos esta estaba
    están estar estas esté este esto estos fue han hasta hay la las le les lo los más me mi mis muy no
    nos o para pero por porque que se ser si sin sobre son su sus te tenía tienen tenemos todo todos tu
    un una unas unos y ya yo bien entonces ejemplo ahora ver voy vos qué cómo cosa cosas hacer ahí acá
    directamente caso gente tener tiene tengo está estoy estás estamos están vas vamos puedo podés podes
    puede pueden podría verdad realmente mostrar miren vean después acá abajo arriba también qr sim
    hoy primero solo sólo según varias dónde
    """.split()
)

WORD = "[a-záéíóúñü0-9]"
TERM = "[a-záéíóúñü0-9][a-záéíóúñü0-9_.-]{2,}"

NEGATIONS = ("no", "sin", "nunca", "jamás", "tampoco", "ni")
STAGE = r"\[(?:música|musica|aplausos?|risas?|silencio)\]"
OPENERS = ("bueno", "ahora sí", "comenzamos", "empezamos", "comenzar", "empezar")
SENTENCE_OPENERS = ("Entonces", "Ahora", "Bien", "Primero", "Segundo", "Tercero", "Si vos", "La idea")
IGNORED_CANDIDATES = ("Entonces", "Ahora", "Bien", "Mirá", "Vean", "Vos", "Para", "Esto", "Como")

EXPLAINS = (
    "es son puede pueden define definen permite permiten sirve consiste significa funciona protege protegen conecta conectan muestra muestran "
    "registra registran reduce reducen aumenta aumentan limita limitan conserva conservan agrupa agrupan acelera aceleran confirma confirman debe deben"
).split()
IS_EXPLAINED_BY = ("es", "son", "permite", "sirve", "consiste", "significa", "funciona", "se usa", "se utiliza", "ayuda", "protege", "conecta")
CAUSES = ("porque", "ya que", "debido a que")
CONDITIONS = ("cuando",)
ADVICE = ("debe", "debería", "conviene", "primero", "evita", "revisa", "compara", "ajusta", "deja", "riega", "hay que", "no conviene")
TOPIC_EXCLUDED = ("conviene", "debe", "debería", "presenta")
TOPIC_ENDS = ("aumenta", "confirma", "evita", "permite", "reduce")

CONNECTORS = ("de", "del", "para", "sin", "con", "entre", "no")
DETERMINERS = ("el", "la", "los", "las", "un", "una", "unos", "unas", "cada")
DESCRIPTIVE_ENDING = (
    "(?:al|ales|ble|bles|ico|ica|icos|icas|ivo|iva|ivos|ivas|ado|ada|ados|adas|ido|ida|idos|idas|oso|osa|osos|osas|ario|aria|arios|arias|ante|antes|ente|entes)$"
)
DESCRIPTORS = ("lento", "lenta", "lentos", "lentas", "pequeño", "pequeña", "robusto", "robusta", "sano", "sana", "sanos", "sanas")
GENERIC_TERMS = (
    "cambio cambios caso cosa cosas datos ejemplo gente hoy información momento parte persona primero resultado resultados tema tiempo uso video cuáles".split()
)
GENERIC_ACTIONS = (
    "acelerar agrupan ajusta aumenta ayuda cambiar compara compartir compactar confirma conservan consume contiene conviene crear cultivar deja debe definen "
    "disminuye evita explicar falla funciona gastan hacer identificar integra limita leer mantener medir mezcla modificar muestra ocupa optimizar optimizando "
    "penaliza permite permiten pierde presenta preparar probar protege reduce reducir registra revisa revisar retira riega sellar seguir sirve verifica"
).split()
