"""Fixed values of the domain: word lists, rule tables, thresholds.

Everything here must keep exactly these values for results to be right. Rules are data: each
abbreviation profile is an ordered list of (pattern, replacement), applied first to last.
"""

# --- Fixed values: directions, day types, sentinels -------------------------------------------
DIRECTIONS = ("ida", "volta")
DAY_TYPES = ("dia_util", "sabado", "domingo")
OUTSIDE_ZONES = "FORA DAS ZONAS"
NO_CODE_GROUP = "SEM CODIGO"
UNKNOWN_STREET = "RUA NÃO IDENTIFICADA"
TURNSTILE_TYPE = "CATRACA DE SOLO"
PENDING_KEYWORDS = ("FALTA", "PRECISA", "REVISAR", "TODO", "FIXME")

# --- Fixed values: thresholds ------------------------------------------------------------------
FUZZY_THRESHOLD = 0.82
CONTAIN_SHARE = 0.70
CONTAIN_MIN_LENGTH = 8
PAIR_MIN_CORE = 5
CLUSTER_JACCARD = 0.5
MERGE_JACCARD = 0.4
COMPANY_JACCARD = 0.25
# levels tried before it, because a high one has few keys
COMPANY_LEVELS = (0.75, 0.5)
DUPLICATE_JACCARD = 0.25
CLOSE_MATCH_CUTOFF = 0.85
ADDRESS_SCORE = 80.0
VARIANT_SCORE = 0.50
EARTH_RADIUS_KM = 6371.0
MERCATOR_RADIUS_M = 6378137.0

# --- Fixed values: abbreviation profile "address" (upper-case input) -----------------------------
ADDRESS_DOTTED = [
    ("AV", "AVENIDA"), ("R", "RUA"), ("TRAV", "TRAVESSA"), ("AL", "ALAMEDA"),
    ("PÇA", "PRAÇA"), ("PC", "PRAÇA"), ("LAD", "LADEIRA"), ("LGO", "LARGO"), ("PQ", "PARQUE"),
    ("EST", "ESTRADA"), ("ROD", "RODOVIA"), ("VLA", "VILA"), ("JD", "JARDIM"), ("PROF", "PROFESSOR"),
    ("SEN", "SENADOR"), ("DR", "DOUTOR"), ("ENG", "ENGENHEIRO"), ("CEL", "CORONEL"), ("MAJ", "MAJOR"),
    ("COM", "COMENDADOR"), ("DES", "DESEMBARGADOR"), ("GOV", "GOVERNADOR"), ("PRES", "PRESIDENTE"),
    ("DEP", "DEPUTADO"), ("STO", "SANTO"), ("STA", "SANTA"), ("VER", "VEREADOR"),
    ("INDL", "INDUSTRIAL"), ("TEN", "TENENTE"),
]
ADDRESS_PROFILE = (
    [(r"\bA\s+V\s*\.?\s+", "AVENIDA "), (r"\bAV\s+", "AVENIDA "), (r"^R\s+", "RUA ")]
    + [(rf"\b{short}\.\s+", f"{full} ") for short, full in ADDRESS_DOTTED]
)

# --- Fixed values: abbreviation profile "merge" (case-insensitive) --------------------------------
MERGE_PROFILE = [
    (r"^R\.\s+", "RUA "), (r"^AV\.\s+", "AVENIDA "), (r"^AV\s+", "AVENIDA "),
    (r"^TRAV\.\s+", "TRAVESSA "), (r"^TRAV\s+", "TRAVESSA "), (r"^P[ÇC]A\.\s+", "PRAÇA "),
    (r"^PRACA\s+", "PRAÇA "), (r"^LAD\.\s+", "LADEIRA "), (r"^EST\.\s+", "ESTRADA "),
    (r"^AL\.\s+", "ALAMEDA "), (r"^TERM\.\s+DE\s+", "TERMINAL DE "), (r"^TERM\.\s+", "TERMINAL "),
    (r"^TERM\s+DE\s+", "TERMINAL DE "), (r"^T\.I\.?\s+", "TERMINAL INTEGRADO "), (r"^T-", "TERMINAL "),
    (r"^CONJ\.\s+", "CONJUNTO "), (r"^CONJ\s+", "CONJUNTO "), (r"\bST[ºO]\.?\s+", "SANTO "),
    (r"\bSTA\.?\s+", "SANTA "), (r"\bDR\.\s+", "DOUTOR "), (r"\bDRA\.\s+", "DOUTORA "),
    (r"\bGAL\.\s+", "GENERAL "), (r"\bCEL\.\s+", "CORONEL "), (r"\bPROF\.\s+", "PROFESSOR "),
    (r"\bENG\.\s+", "ENGENHEIRO "), (r"\bGOV\.\s+", "GOVERNADOR "), (r"\bPÇA\.\s+", "PRAÇA "),
    (r"\bJD\.\s+", "JARDIM "),
]

# --- Fixed values: abbreviation profile "code_match" (whole words of an N3 key) --------------------
CODE_MATCH_WORDS = {
    "AV": "AVENIDA", "R": "RUA", "TRAV": "TRAVESSA", "TRA": "TRAVESSA", "LAD": "LADEIRA",
    "PCA": "PRACA", "P": "PRACA", "EST": "ESTRADA", "ROD": "RODOVIA", "ALM": "ALMIRANTE",
    "COM": "COMENDADOR", "DEP": "DEPUTADO", "SEN": "SENADOR", "DR": "DOUTOR", "GEN": "GENERAL",
    "CEL": "CORONEL", "SGT": "SARGENTO", "CAP": "CAPITAO", "TEN": "TENENTE", "PROF": "PROFESSOR",
    "JORN": "JORNALISTA", "ARQ": "ARQUITETO", "ENG": "ENGENHEIRO", "PRES": "PRESIDENTE",
    "GOV": "GOVERNADOR", "PREF": "PREFEITO",
}

# --- Fixed values: abbreviation profiles "expansion" and "variants" (case-insensitive) --------------
EXPANSION_PROFILE = [
    (r"\bAV\.\s+", "AVENIDA "), (r"\bR\.\s+", "RUA "), (r"\bLAD\.\s+", "LADEIRA "),
    (r"\bP[CÇ]A?\.\s+", "PRACA "), (r"\bTV\.\s+", "TRAVESSA "), (r"\bTRAV\.\s+", "TRAVESSA "),
    (r"\bDR\.\s+", "DOUTOR "), (r"\bPROF\.\s+", "PROFESSOR "), (r"\bDEP\.\s+", "DEPUTADO "),
    (r"\bENG\.\s+", "ENGENHEIRO "), (r"\bJORN\.\s+", "JORNALISTA "), (r"\bGOV\.\s+", "GOVERNADOR "),
    (r"\bGAL\.\s+", "GENERAL "), (r"\bGEN\.\s+", "GENERAL "), (r"\bCEL\.\s+", "CORONEL "),
    (r"\bCAP\.\s+", "CAPITAO "), (r"\bSGT\.\s+", "SARGENTO "), (r"\bTERM\.\s+", "TERMINAL "),
    (r"\bDESEMB\.\s+", "DESEMBARGADOR "), (r"\bDES\.\s+", "DESEMBARGADOR "), (r"\bVER\.\s+", "VEREADOR "),
    (r"\bSEN\.\s+", "SENADOR "), (r"\bPRA\.\s+", "PRACA "), (r"\bSTA\.\s+", "SANTA "),
    (r"\bSTO\.\s+", "SANTO "), (r"\bCJ\.\s+", "CONJUNTO "), (r"\bCONJ\.\s+", "CONJUNTO "),
]
VARIANT_PROFILE = [rule for rule in EXPANSION_PROFILE if rule[0] not in (r"\bSGT\.\s+", r"\bPRA\.\s+")]

# --- Fixed values: abbreviation profile "registry" (dotted words, plus undotted first words) ---------
REGISTRY_WORDS = {
    "AV": "AVENIDA", "R": "RUA", "TRAV": "TRAVESSA", "PÇA": "PRAÇA", "PCA": "PRAÇA", "LAD": "LADEIRA",
    "ESTR": "ESTRADA", "EST": "ESTRADA", "AL": "ALAMEDA", "TERM": "TERMINAL", "CONJ": "CONJUNTO",
    "CJ": "CONJUNTO", "LOT": "LOTEAMENTO", "QD": "QUADRA", "COND": "CONDOMÍNIO", "HOSP": "HOSPITAL",
    "JD": "JARDIM", "RES": "RESIDENCIAL", "INDL": "INDUSTRIAL", "STO": "SANTO", "STA": "SANTA",
    "STº": "SANTO", "DRA": "DOUTORA", "DR": "DOUTOR", "PROF": "PROFESSOR", "GOV": "GOVERNADOR",
    "DEP": "DEPUTADO", "CEL": "CORONEL", "VER": "VEREADOR", "ENG": "ENGENHEIRO", "JORN": "JORNALISTA",
    "MAJ": "MAJOR", "SEN": "SENADOR", "COM": "COMENDADOR", "DESEMB": "DESEMBARGADOR",
    "DES": "DESEMBARGADOR", "PREF": "PREFEITO", "GEN": "GENERAL", "GAL": "GENERAL", "EMP": "EMPRESÁRIO",
    "TEN": "TENENTE", "PRES": "PRESIDENTE", "SARG": "SARGENTO", "CONS": "CONSELHEIRO", "ESC": "ESCRITOR",
    "MAL": "MARECHAL", "PRESID": "PRESIDENTE", "ALAM": "ALAMEDA", "JARD": "JARDIM", "CID": "CIDADE",
    "DEL": "DELEGADO",
}
REGISTRY_UNDOTTED_FIRST = ("AV", "R", "TRAV", "LAD", "TERM", "CONJ", "AL")

# --- Fixed values: repairs of words split by text extraction ------------------------------------------
EXTRACTION_REPAIRS = [
    (r"\bA\s+V\s*\.?\s*", "AV. "), (r"\bTRA\s+V\s*\.?\s*", "TRAV. "), (r"\bA\s+VENIDA\b", "AVENIDA"),
    (r"\bGUSTA\s+VO\b", "GUSTAVO"), (r"\bPAIV\s+A\b", "PAIVA"), (r"\bLOURIV\s+AL\b", "LOURIVAL"),
    (r"\bSILV\s+A\b", "SILVA"), (r"\bOLIV\s+A\b", "OLIVA"), (r"\bCALV\s+A\b", "CALVA"),
    (r"\bSALV\s+A\b", "SALVA"), (r"([A-Z]{4,})\s+([AEIOU])\b(?!\s+[A-Z])", "$1$2"),
    (r"P\s*C\s*A\s*\.\s*", "PCA. "),
]

# --- Fixed values: abbreviation detector (pattern, label), first match counts ---------------------------
ABBREVIATION_LABELS = [
    (r"^R\.\s", "R."), (r"^AV\.\s", "AV."), (r"^AV\s+[A-ZÀ-Ú]", "AV (sem ponto)"), (r"^TRAV\.\s", "TRAV."),
    (r"^TRAV\s", "TRAV (sem ponto)"), (r"^P[ÇC]A\.\s", "PÇA."), (r"^LAD\.\s", "LAD."), (r"^EST\.\s", "EST."),
    (r"^AL\.\s", "AL."), (r"^TERM\.\s", "TERM."), (r"^T\.I\.?\s", "T.I."), (r"^T-", "T- (terminal)"),
    (r"^CONJ\.\s", "CONJ."), (r"^CONJ\s+[A-ZÀ-Ú]", "CONJ (sem ponto)"), (r"\bST[ºO]\.?\s", "STº/STO."),
    (r"\bSTA\.?\s", "STA."), (r"\bDR\.\s", "DR."), (r"\bDRA\.\s", "DRA."), (r"\bGAL\.\s", "GAL."),
    (r"\bCEL\.\s", "CEL."), (r"\bPROF\.\s", "PROF."), (r"\bENG\.\s", "ENG."), (r"\bGOV\.\s", "GOV."),
    (r"\bJD\.\s", "JD."),
]

# --- Fixed values: street-type words dropped from the front of a name -------------------------------------
# The first list holds an accented word that normalised text never contains; both lists are kept.
CORE_PREFIXES_REPORT = (
    "AVENIDA", "RUA", "TRAVESSA", "TRAV", "ALAMEDA", "LADEIRA", "PRAÇA", "LARGO", "ESTRADA", "ESTR",
    "RODOVIA", "VIADUTO", "RETORNO", "TERMINAL", "ACESSO", "CONJ", "CONJUNTO", "LOTEAMENTO", "QUADRA", "QD",
)
CORE_PREFIXES_PAIRS = (
    "AVENIDA", "RUA", "TRAVESSA", "TRAV", "ALAMEDA", "LADEIRA", "PRACA", "LARGO", "ESTRADA", "ESTR",
    "RODOVIA", "VIADUTO", "RETORNO", "TERMINAL", "ACESSO", "CONJ", "CONJUNTO", "LOTEAMENTO", "QUADRA", "QD",
    "VIA",
)

# --- Fixed values: addresses -------------------------------------------------------------------------------
STREET_TYPES = (
    "RUA", "AVENIDA", "TRAVESSA", "ALAMEDA", "PRAÇA", "LARGO", "ESTRADA", "RODOVIA", "VIA", "LADEIRA",
    "BECO", "VIELA",
)
ADDRESS_EXCLUDED = ("REGIÃO GEOGRÁFICA", "BRASIL", "ALAGOAS", "MACEIÓ", "MCZ")

# --- Fixed values: stop words and distinctive words -----------------------------------------------------------
STOPWORDS = ("DE", "DA", "DO", "DAS", "DOS", "E", "A", "O", "AS", "OS")
SPELLED_NUMBERS = (
    "UM", "DOIS", "TRES", "QUATRO", "CINCO", "SEIS", "SETE", "OITO", "NOVE", "DEZ", "ONZE", "DOZE", "TREZE",
    "QUATORZE", "CATORZE", "QUINZE", "DEZESSEIS", "DEZESSETE", "DEZOITO", "DEZENOVE", "VINTE",
)
ROMAN_NUMERALS = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")

# --- Fixed values: active-line reports --------------------------------------------------------------------------
OPERATION_TYPES = "RADIAL|DIAMETRAL|PERIMETRAL|CIRCULAR|ALIMENTADO|DISTRIBUIDO|CATRACA|ESTRUTURA"
SERVICE_PREFIXES = [
    ("CONVENCIONAL", "CONVENCIONAL"), ("INTEGRA", "INTEGRACAO"), ("CATRACA DE SOLO", "CATRACA DE SOLO"),
    ("CATRACA DE", "CATRACA DE SOLO"), ("MADRUG", "MADRUGADAO"), ("LINHA CIDAD", "LINHA CIDADA"),
]
SERVICE_ORDER = ("CONVENCIONAL", "CATRACA DE SOLO", "MADRUGADAO", "INTEGRACAO", "LINHA CIDADA")
ACTIVE_LINE_NOISE = ("RA", "L", "SOLO")
KNOWN_EXCLUSIONS = {"0006-M": "Decisao de projeto: nao sera adicionada ao sistema."}

# --- Fixed values: code aliases and exceptions --------------------------------------------------------------------
ALIAS_APPLY = {"0109C": "0109", "0209C": "0209", "0617C": "0617"}
ALIAS_COMPARE = {"0014C": "0014", "0109C": "0109", "0209C": "0209", "0617C": "0617"}
LETTER_OF_NAME = r"^\s*\d{1,4}\s*-{0,2}\s*[A-Z]\s+[^\s\-/(]"
SKIPPED_CODES = ("0112",)

# --- Fixed values: neighbourhood report -----------------------------------------------------------------------------
NEIGHBOURHOOD_SKIP = (
    r"^(Sub-Total|Bairro|P.gina|\d{2}/\d{2}/\d{4}|N.*Inicial|VIAS POR BAIRRO|ViaPorBairro"
    r"|\d{2}:\d{2}:\d{2}$|TOTAL:)"
)
NEIGHBOURHOOD_CORRECTIONS = {
    "CANA�": "CANAÃ", "CH� DA JAQUEIRA": "CHÃ DA JAQUEIRA",
    "CH� DE BEBEDOURO": "CHÃ DE BEBEDOURO", "FERN�O VELHO": "FERNÃO VELHO",
    "GAR�A TORTA": "GARÇA TORTA", "JARAGU�": "JARAGUÁ", "JATI�CA": "JATIÚCA",
    "PAJU�ARA": "PAJUÇARA", "PO�O": "POÇO", "SANTA AM�LIA": "SANTA AMÉLIA",
    "SANTA L�CIA": "SANTA LÚCIA", "S�O JORGE": "SÃO JORGE",
}

# --- Fixed values: document inventory --------------------------------------------------------------------------------
INVENTORY_JUNK = (
    "INTINERARIOPORVIA", "SRE_RELATORIO_VIA_LOGRADOURO-CODIGO-DAS-RUAS", "", "604", "INTINERARIOPORVIA-604",
)

# --- Fixed values: stop-listing column bounds (profile -> column -> [x from, x to)) ------------------------------------
STOP_COLUMNS = {
    "A": [("name", 0, 100), ("abbreviation", 100, 220), ("address", 220, 600), ("position", 600, 650),
          ("speed_limit", 650, 710), ("lat", 710, 770), ("lon", 770, 9999)],
    "B": [("name", 0, 95), ("abbreviation", 95, 205), ("address", 205, 585), ("position", 585, 640),
          ("speed_limit", 640, 700), ("lat", 700, 765), ("lon", 765, 900)],
}

# --- Fixed values: map styles (id, colour as aabbggrr, width or scale) ----------------------------------------------------
MAP_STYLES = {
    "ida": ("ida_style", "ff5ec522", 4), "volta": ("volta_style", "ffaf401e", 4),
    "points": ("style_pontos", "ff00ffff", 1.2), "zones": ("zona_style", "ff2d7be0", 2),
}
ZONE_FILL = "4d2d7be0"
GEOCODER_TYPES = ("suburb", "neighbourhood", "quarter")
