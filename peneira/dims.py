"""Fixed values that results must share with the original system, as plain data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Words that the index leaves out, folded.
STOPWORDS = tuple(
    """
    a ao aos as ate com como quando quanto que quem o os da do das dos de e em no nos na nas num numa numas para por se sem
    sob sobre traz tras pra pro porque porquanto pois porem mas ou onde lhe lhes me te seu sua seus suas este esta estes
    estas isso isto aquele aquela aqueles aquelas depois antes entao assim tambem muito muita muitos muitas pouco pouca
    poucos poucas cada algum alguns algumas nenhum nenhuma sendo era eram ser sao foi foram seja sejam sera serao estou
    estamos estao estava estavam estiveram houve haviam havia ter tem tendo tinha tinham entretanto todavia portanto agora
    ainda ja mesmo durante apenas sempre nunca nada ninguem todo toda todos todas qualquer quaisquer logo quase talvez
    primeiro segundo terceiro aqui ai ali la dali deste dessa desses dessas disto disso daquele daquela daqueles daquelas
    esteja estejam estive estivemos estiver estiverem fui fomos for forem serei seremos serem terei teremos teriam
    tivessem tivesse tivemos tiver tiverem vai vao vaiam vamos voces eles elas eu tu ele ela vos deles delas mesma mesmos
    mesmas aquilo dentro fora algun alguma ficou ficaram ficar ficara ficarao ficariam ficasse ficassem outro outros outra
    outras apos via viaja vez vezes contra entre so bem mal ha havera haverao
    """.split()
)

# A query word and the words that it also asks for.
SYNONYMS = {
    "agenda": ("calendario", "programacao", "cronograma", "proximos"),
    "calendario": ("agenda", "programacao", "cronograma"),
    "contra": ("enfrenta", "enfrentar", "enfrentara", "encara", "encarar", "pega", "adversario", "rival", "duelo", "versus", "vs", "oponente", "diante"),
    "proximo": ("proximos", "proxima", "seguinte", "posterior", "agenda", "calendario"),
    "jogos": ("partidas", "jogo", "agenda", "calendario"),
    "jogo": ("partida", "duelo", "confronto", "compromisso", "agenda"),
    "partida": ("jogo", "partidas", "jogos"),
    "partidas": ("jogos", "agenda"),
    "proximos": ("agenda", "calendario", "sequencia", "proximas"),
    "semana": ("semanal", "rodada"),
    "assistir": ("transmissao", "onde-assistir", "streaming", "tv", "canal"),
    "onde": ("onde-assistir", "assistir", "transmissao"),
    "horario": ("horario", "quando", "hora"),
    "quem": ("adversario", "rival", "oponente", "time", "clube", "inimigo"),
}

# Factors of the score by host.
DOMAIN_BOOSTS = {
    "ge.globo.com": 1.3,
    "globoesporte.globo.com": 1.3,
    "gremio.net": 1.08,
    "cruzeiro.org": 1.08,
    "vasco.com.br": 1.08,
    "palmeiras.com.br": 1.15,
    "lance.com.br": 1.08,
    "uol.com.br": 1.08,
    "gazetaesportiva.com": 1.12,
    "futebolnaveia.com.br": 1.1,
    "verdazzo.com.br": 1.06,
}

# Words that name a team.
TEAM_WORDS = (
    "america", "athletico", "atletico", "bahia", "botafogo", "bragantino", "cruzeiro", "corinthians", "coritiba", "ceara",
    "flamengo", "fluminense", "fortaleza", "gremio", "goias", "inter", "internacional", "palmeiras", "santos", "sao",
    "tricolor", "vasco", "verdao",
)

# Weights and synonyms of the weighted query form.
TERM_WEIGHTS = {
    "jogo": 2.5, "partida": 2.5, "agenda": 2.0, "transmissao": 2.0, "assistir": 2.0, "flamengo": 3.0, "palmeiras": 3.0,
    "corinthians": 2.8, "brasileirao": 2.2, "copa": 1.8, "libertadores": 2.5, "globo": 1.5, "sportv": 1.5, "youtube": 1.8,
    "feminino": 2.0, "feminina": 2.0, "masculino": 1.8, "time": 2.0, "equipe": 2.0, "clube": 2.0,
}
WEIGHTED_SYNONYMS = {
    "feminino": ("feminina", "mulher", "mulheres", "damas"),
    "masculino": ("masculina", "homem", "homens"),
    "jogo": ("partida", "match", "confronto"),
    "time": ("equipe", "clube", "team"),
    "assistir": ("ver", "transmissao", "broadcast"),
    "agenda": ("calendario", "tabela", "programacao"),
    "brasileirao": ("serie-a", "campeonato-brasileiro"),
    "libertadores": ("copa-libertadores", "conmebol"),
}
SYNONYM_WEIGHT = 0.7

# Patterns of hosts, patterns of paths, and file endings that are not crawled.
BLOCKED_HOSTS = (
    r"(^|\.)doubleclick\.net$",
    r"(^|\.)google(adservices|analytics|syndication)\.com$",
    r"(^|\.)googletagmanager\.com$",
    r"(^|\.)googletagservices\.com$",
    r"(^|\.)facebook\.com$",
    r"(^|\.)instagram\.com$",
    r"(^|\.)tiktokcdn\.com$",
    r"(^|\.)taboola\.com$",
    r"(^|\.)outbrain\.com$",
    r"(^|\.)scorecardresearch\.com$",
    r"(^|\.)quantserve\.com$",
    r"(^|\.)zedo\.com$",
    r"(^|\.)advertising\.com$",
    r"(^|\.)twitter\.com$",
    r"(^|\.)pinterest\.com$",
    r"(^|\.)snapchat\.com$",
    r"(^|\.)bet365\.",
    r"(^|\.)1xbet\.",
    r"(^|\.)betano\.",
    r"(^|\.)pixbet\.",
    r"(^|\.)leonbet\.",
    r"(^|\.)whatsapp\.com$",
    r"(^|\.)wa\.me$",
    r"(^|\.)web\.whatsapp\.com$",
    r"(^|\.)t\.me$",
    r"(^|\.)telegram\.me$",
    r"(^|\.)telegram\.org$",
    r"(^|\.)discord\.com$",
    r"(^|\.)discordapp\.com$",
    r"(^|\.)suporte\.",
    r"(^|\.)support\.",
    r"(^|\.)help\.",
    r"(^|\.)nba\.",
    r"(^|\.)ufc\.",
)
BLOCKED_PATHS = (
    r"/ads?/",
    r"/advertising/",
    r"/sponsored/",
    r"/promo/",
    r"/tracking/",
    r"/analytics/",
    r"/pixel/",
    r"/tag/manager/",
    r"/consent/",
    r"/suporte\b",
    r"/support\b",
    r"/ajuda\b",
    r"/help\b",
    r"/faq\b",
    r"/contato\b",
    r"/contact\b",
    r"/sac\b",
    r"/atendimento\b",
    r"/minha[-_]conta\b",
    r"/my[-_]account\b",
    r"/account\b",
    r"/login\b",
    r"/signin\b",
    r"/chat\b",
    r"/whatsapp\b",
    r"/telegram\b",
)
BLOCKED_ENDINGS = (
    ".gif", ".jpg", ".jpeg", ".png", ".svg", ".ico", ".webp", ".mp4", ".mp3", ".avi", ".mov", ".pdf", ".doc", ".docx",
    ".ppt", ".pptx", ".xls", ".xlsx", ".zip", ".rar", ".7z", ".gz", ".tar",
)

# What a page says that was not found although it was served.
SOFT_404 = ("erro 404", "página não encontrada", "pagina não encontrada", "not found", "404 -", "404 –", "error 404")

# Teams of the schedule service, and slugs that differ from their names.
SCHEDULE_TEAMS = (
    "America-MG", "Athletico-PR", "Atletico-GO", "Atletico-MG", "Bahia", "Botafogo", "Corinthians", "Cruzeiro", "Cuiaba",
    "Flamengo", "Fluminense", "Fortaleza", "Gremio", "Internacional", "Juventude", "Palmeiras", "Red Bull Bragantino",
    "Santos", "Sao Paulo", "Vasco da Gama",
)
SLUG_OVERRIDES = {"vasco da gama": "vasco", "red bull bragantino": "bragantino"}

# Patterns of the vocabulary scan.
VOCABULARY_PATTERNS = ("flameng", "tabel", "corinth", "palm", "brasil")
VOCABULARY_ANY = ("futebol", "jog", "time", "equip", "partid")

# Team identifiers, names and aliases, in order of precedence.
TEAMS = (
    ("CRU", "Cruzeiro", ("Cruzeiro", "Cruzeiro Esporte Clube", "CRU", "Cabuloso", "Raposa", "Cruzeiro/MG")),
    ("FLA", "Flamengo", ("Flamengo", "CR Flamengo", "FLA", "Mengão", "Mengo", "Flamengo/RJ")),
    ("CAM", "Atlético-MG", ("Atlético-MG", "Atlético Mineiro", "CAM", "Galo", "Galo Doido", "Atlético/MG")),
    ("ATH", "Athletico-PR", ("Athletico-PR", "Athletico Paranaense", "ATH", "Furacão", "CAP")),
    ("BAH", "Bahia", ("Bahia", "Esporte Clube Bahia", "BAH", "Tricolor de Aço", "Esquadrão")),
    ("BOT", "Botafogo", ("Botafogo", "Botafogo de Futebol e Regatas", "BOT", "Fogão", "Glorioso")),
    ("BRG", "Red Bull Bragantino", ("Red Bull Bragantino", "Bragantino", "BRG", "Massa Bruta", "Toro Loko")),
    ("AGO", "Atlético-GO", ("Atlético-GO", "Atlético Goianiense", "AGO", "Dragão", "Rubro-Negro Goiano")),
    ("CEA", "Ceará", ("Ceará", "Ceará Sporting Club", "CEA", "Vozão", "Alvinegro")),
    ("CUI", "Cuiabá", ("Cuiabá", "Cuiabá Esporte Clube", "CUI", "Dourado", "Auriverde")),
    ("COR", "Corinthians", ("Corinthians", "Sport Club Corinthians Paulista", "COR", "Timão", "Coringão")),
    ("CRI", "Criciúma", ("Criciúma", "Criciúma Esporte Clube", "CRI", "Tigre", "Tricolor Carvoeiro")),
    ("FLU", "Fluminense", ("Fluminense", "Fluminense Football Club", "FLU", "Fluzão", "Nense", "Tricolor das Laranjeiras")),
    ("FOR", "Fortaleza", ("Fortaleza", "Fortaleza Esporte Clube", "FOR", "Leão do Pici", "Tricolor de Aço")),
    ("GRE", "Grêmio", ("Grêmio", "Grêmio Foot-Ball Porto Alegrense", "GRE", "Imortal Tricolor", "Tricolor Gaúcho")),
    ("INT", "Internacional", ("Internacional", "Sport Club Internacional", "INT", "Colorado", "Inter")),
    ("JUV", "Juventude", ("Juventude", "Esporte Clube Juventude", "JUV", "Juve", "Papo")),
    ("PAL", "Palmeiras", ("Palmeiras", "Sociedade Esportiva Palmeiras", "PAL", "Verdão", "Porco", "Alviverde")),
    ("SAO", "São Paulo", ("São Paulo", "São Paulo Futebol Clube", "SAO", "Tricolor Paulista", "Soberano")),
    ("VAS", "Vasco da Gama", ("Vasco da Gama", "Club de Regatas Vasco da Gama", "VAS", "Gigante da Colina", "Cruzmaltino")),
    ("VIT", "Vitória", ("Vitória", "Esporte Clube Vitória", "VIT", "Leão da Barra", "Rubro-Negro")),
    ("MIR", "Mirassol", ("Mirassol", "Mirassol Futebol Clube", "MIR", "Leão da Alta Araraquarense", "Leãozão")),
)

# The logo file of each team slug.
LOGOS = {
    "america-mg": "america-mg.png",
    "american-mineiro": "america-mg.png",
    "athletico-pr": "athletico-pr.png",
    "athletico-paranaense": "athletico-pr.png",
    "atletico-go": "atletico-go.png",
    "atletico-mg": "atletico-mg.png",
    "atletico-mineiro": "atletico-mg.png",
    "bahia": "bahia.png",
    "bolivar": "bolivar.png",
    "botafogo": "botafogo.png",
    "ceara": "ceara.png",
    "chapecoense": "chapecoense.png",
    "corinthians": "corinthians.png",
    "crb": "crb.png",
    "criciuma": "criciuma.png",
    "cruzeiro": "cruzeiro.png",
    "cuiaba": "cuiaba.png",
    "estudiantes": "estudiantes.png",
    "ferroviaria": "ferroviaria.png",
    "flamengo": "flamengo.png",
    "fluminense": "fluminense.png",
    "fortaleza": "fortaleza.png",
    "foz-do-iguacu": "foz-do-iguacu.png",
    "goias": "goias.png",
    "gremio": "gremio.png",
    "internacional": "internacional.png",
    "juventude": "juventude.png",
    "lanus": "lanus.png",
    "ldu": "ldu.png",
    "mirassol": "mirassol.png",
    "palmeiras": "palmeiras.png",
    "red-bull-bragantino": "red-bull-bragantino.png",
    "bragantino": "red-bull-bragantino.png",
    "river-plate": "river-plate.png",
    "santos": "santos.png",
    "sao-paulo": "sao-paulo.png",
    "sport-recife": "sport-recife.png",
    "vasco": "vasco-da-gama.png",
    "vasco-da-gama": "vasco-da-gama.png",
    "vila-nova": "vila-nova.png",
    "vitoria": "vitoria.png",
    "volta-redonda": "volta-redonda.png",
    "copa-do-brasil": "copabrasil.png",
    "copadobrasil": "copabrasil.png",
    "brasileirao": "brasileirao.png",
}


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a local relation: its size is that of the code."""
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], columns: str) -> str:
    """The same as a DuckDB table expression."""
    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") as v({columns})"
