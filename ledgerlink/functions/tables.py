"""Lookup tables of names and addresses."""

# Legal forms and titles, and the token each stands for.
LEGAL = {
    "private": "pvt", "pvt": "pvt", "pte": "pvt", "limited": "ltd", "ltd": "ltd", "ltda": "ltd", "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "company": "co",
    "co": "co", "compagnie": "cie", "cie": "cie", "etablissements": "ets", "etablissement": "ets", "ets": "ets", "llc": "llc", "llp": "llp", "lp": "lp", "pllc": "pllc", "pc": "pc",
    "plc": "plc", "pa": "pa", "opc": "opc", "md": "md", "dds": "dds", "cpa": "cpa", "esq": "esq", "sarl": "sarl", "sas": "sas", "sasu": "sasu", "eurl": "eurl", "sa": "sa", "sci": "sci",
    "snc": "snc", "scop": "scop", "selarl": "selarl", "scm": "scm", "sca": "sca",
}
# Legal forms written as single letters, in the order in which they are joined.
SPELLED = ["llc", "llp", "pllc", "pc", "pa", "md", "sasu", "sas", "sarl", "sa", "sci", "snc"]
# Words that carry no name.
NAME_STOP = [
    "the", "dr", "and", "of", "de", "du", "des", "la", "le", "les", "l", "d", "et", "a",
]
# What stands between a former and a present name.
ALIAS = r"\b(?:d\s*b\s*a|doing business as|t\s+a|trading as|formerly known as|f\s*k\s*a|a\s+k\s+a|aka|also known as)\b"
# Endings of domains.
TLD = r"(?:com|net|org|in|co\.in|co|fr|biz|info|us|io)"
# Address parts that say nothing.
NOISE = [r"\bnull\b", r"\bnone\b", r"\bn a\b", r"\bpmb\s*\d+\b", r"\bp\s*o\s*box\s*\d+\b", r"\bpo\s*box\s*\d+\b", r"\bbox\s*\d+\b"]
# Words that only introduce a number.
NUMBER_PREFIX = [
    "no", "hno", "h", "door", "house", "plot", "flat", "shop", "sno", "s", "khasra", "kh", "survey", "unit", "apt", "ste", "suite", "n", "numero", "num",
]

# Street words and ordinals of the United States, and what each is written as.
US_STREETS = {
    "st": "st", "street": "st", "str": "st", "saint": "st", "ave": "ave", "avenue": "ave", "av": "ave", "rd": "rd", "road": "rd", "blvd": "blvd", "boulevard": "blvd", "ln": "ln",
    "lane": "ln", "dr": "dr", "drive": "dr", "ct": "ct", "court": "ct", "pl": "pl", "place": "pl", "cir": "cir", "circle": "cir", "hwy": "hwy", "highway": "hwy", "pkwy": "pkwy",
    "parkway": "pkwy", "trl": "trl", "trail": "trl", "ter": "ter", "terrace": "ter", "sq": "sq", "square": "sq", "mt": "mt", "mount": "mt", "ft": "ft", "fort": "ft", "pt": "pt",
    "point": "pt", "n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "ne": "ne", "northeast": "ne", "nw": "nw", "northwest": "nw", "se": "se",
    "southeast": "se", "sw": "sw", "southwest": "sw", "apt": "apt", "apartment": "apt", "ste": "ste", "suite": "ste", "fl": "fl", "floor": "fl", "bldg": "bldg", "building": "bldg",
    "rte": "rte", "route": "rte", "cty": "cty", "county": "cty", "expy": "expy", "expressway": "expy", "fwy": "fwy", "freeway": "fwy", "xing": "xing", "crossing": "xing", "first": "1st",
    "second": "2nd", "third": "3rd", "fourth": "4th", "fifth": "5th", "sixth": "6th", "seventh": "7th", "eighth": "8th", "ninth": "9th", "tenth": "10th", "eleventh": "11th",
    "twelfth": "12th", "thirteenth": "13th", "fourteenth": "14th", "fifteenth": "15th", "sixteenth": "16th", "seventeenth": "17th", "eighteenth": "18th", "nineteenth": "19th",
    "twentieth": "20th",
}
# Further street words of India.
IN_STREETS = {
    "opp": "opp", "opposite": "opp", "near": "near", "nr": "near", "behind": "behind", "sec": "sec", "sector": "sec", "ph": "ph", "phase": "ph", "colony": "colony", "nagar": "nagar",
    "marg": "marg", "chowk": "chowk", "dist": "dist", "district": "dist", "tal": "tal", "taluka": "tal", "vill": "vill", "village": "vill", "po": "po", "post": "po",
}
# Street words of France.
FR_STREETS = {
    "rue": "rue", "r": "rue", "avenue": "avenue", "av": "avenue", "ave": "avenue", "boulevard": "boulevard", "bd": "boulevard", "bld": "boulevard", "blvd": "boulevard", "allee": "allee",
    "all": "allee", "chemin": "chemin", "ch": "chemin", "chem": "chemin", "place": "place", "pl": "place", "impasse": "impasse", "imp": "impasse", "route": "route", "rte": "route",
    "square": "square", "sq": "square", "saint": "saint", "st": "saint", "sainte": "sainte", "ste": "sainte", "faubourg": "faubourg", "fg": "faubourg", "fbg": "faubourg", "quai": "quai",
    "qu": "quai", "cours": "cours", "crs": "cours", "residence": "residence", "res": "residence", "lotissement": "lotissement", "lot": "lotissement", "cite": "cite", "hameau": "hameau",
    "ham": "hameau", "passage": "passage", "pass": "passage", "promenade": "promenade", "prom": "promenade",
}
STREETS = {"US": US_STREETS, "India": US_STREETS | IN_STREETS, "France": FR_STREETS}

# States and regions, by abbreviation.
US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia",
    "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland",
    "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington",
    "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia", "pr": "puerto rico",
}
IN_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ct": "chhattisgarh", "ga": "goa", "gj": "gujarat", "hr": "haryana",
    "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram",
    "nl": "nagaland", "od": "odisha", "or": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "ts": "telangana", "tg": "telangana", "tr": "tripura",
    "up": "uttar pradesh", "uk": "uttarakhand", "ua": "uttarakhand", "ut": "uttarakhand", "wb": "west bengal", "an": "andaman and nicobar islands", "ch": "chandigarh",
    "dn": "dadra and nagar haveli and daman and diu", "dd": "dadra and nagar haveli and daman and diu", "dl": "delhi", "jk": "jammu and kashmir", "la": "ladakh", "ld": "lakshadweep", "py": "puducherry",
}
# Other spellings.
IN_SPELLINGS = {
    "orissa": "odisha", "pondicherry": "puducherry", "uttaranchal": "uttarakhand", "nct of delhi": "delhi", "chattisgarh": "chhattisgarh", "tamilnadu": "tamil nadu",
    "dadra and nagar haveli": "dadra and nagar haveli and daman and diu", "daman and diu": "dadra and nagar haveli and daman and diu", "andaman and nicobar": "andaman and nicobar islands",
    "jammu kashmir": "jammu and kashmir", "keralam": "kerala",
}
# Regions and departments, and the region that each belongs to.
FR_STATES = {
    "auvergne rhone alpes": "auvergne rhone alpes", "ain": "auvergne rhone alpes", "allier": "auvergne rhone alpes", "ardeche": "auvergne rhone alpes", "cantal": "auvergne rhone alpes",
    "drome": "auvergne rhone alpes", "isere": "auvergne rhone alpes", "loire": "auvergne rhone alpes", "haute loire": "auvergne rhone alpes", "puy de dome": "auvergne rhone alpes",
    "rhone": "auvergne rhone alpes", "savoie": "auvergne rhone alpes", "haute savoie": "auvergne rhone alpes", "bourgogne franche comte": "bourgogne franche comte",
    "cote d or": "bourgogne franche comte", "doubs": "bourgogne franche comte", "jura": "bourgogne franche comte", "nievre": "bourgogne franche comte",
    "haute saone": "bourgogne franche comte", "saone et loire": "bourgogne franche comte", "yonne": "bourgogne franche comte", "territoire de belfort": "bourgogne franche comte",
    "bretagne": "bretagne", "cotes d armor": "bretagne", "finistere": "bretagne", "ille et vilaine": "bretagne", "morbihan": "bretagne", "centre val de loire": "centre val de loire",
    "cher": "centre val de loire", "eure et loir": "centre val de loire", "indre": "centre val de loire", "indre et loire": "centre val de loire", "loir et cher": "centre val de loire",
    "loiret": "centre val de loire", "corse": "corse", "corse du sud": "corse", "haute corse": "corse", "grand est": "grand est", "ardennes": "grand est", "aube": "grand est",
    "marne": "grand est", "haute marne": "grand est", "meurthe et moselle": "grand est", "meuse": "grand est", "moselle": "grand est", "bas rhin": "grand est", "haut rhin": "grand est",
    "vosges": "grand est", "hauts de france": "hauts de france", "aisne": "hauts de france", "nord": "hauts de france", "oise": "hauts de france", "pas de calais": "hauts de france",
    "somme": "hauts de france", "ile de france": "ile de france", "seine et marne": "ile de france", "yvelines": "ile de france", "essonne": "ile de france",
    "hauts de seine": "ile de france", "seine saint denis": "ile de france", "val de marne": "ile de france", "val d oise": "ile de france", "idf": "ile de france", "normandie": "normandie",
    "calvados": "normandie", "eure": "normandie", "manche": "normandie", "orne": "normandie", "seine maritime": "normandie", "nouvelle aquitaine": "nouvelle aquitaine",
    "charente": "nouvelle aquitaine", "charente maritime": "nouvelle aquitaine", "correze": "nouvelle aquitaine", "creuse": "nouvelle aquitaine", "dordogne": "nouvelle aquitaine",
    "gironde": "nouvelle aquitaine", "landes": "nouvelle aquitaine", "lot et garonne": "nouvelle aquitaine", "pyrenees atlantiques": "nouvelle aquitaine",
    "deux sevres": "nouvelle aquitaine", "vienne": "nouvelle aquitaine", "haute vienne": "nouvelle aquitaine", "occitanie": "occitanie", "ariege": "occitanie", "aude": "occitanie",
    "aveyron": "occitanie", "gard": "occitanie", "haute garonne": "occitanie", "gers": "occitanie", "herault": "occitanie", "lot": "occitanie", "lozere": "occitanie",
    "hautes pyrenees": "occitanie", "pyrenees orientales": "occitanie", "tarn": "occitanie", "tarn et garonne": "occitanie", "pays de la loire": "pays de la loire",
    "loire atlantique": "pays de la loire", "maine et loire": "pays de la loire", "mayenne": "pays de la loire", "sarthe": "pays de la loire", "vendee": "pays de la loire",
    "provence alpes cote d azur": "provence alpes cote d azur", "alpes de haute provence": "provence alpes cote d azur", "hautes alpes": "provence alpes cote d azur",
    "alpes maritimes": "provence alpes cote d azur", "bouches du rhone": "provence alpes cote d azur", "var": "provence alpes cote d azur", "vaucluse": "provence alpes cote d azur",
    "paca": "provence alpes cote d azur",
}

STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia",
    "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland",
    "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire",
    "nj": "new jersey", "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania",
    "ri": "rhode island", "sc": "south carolina", "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington",
    "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming", "dc": "district of columbia", "pr": "puerto rico",
}
IN_STATES = {
    "ap": "andhra pradesh", "ar": "arunachal pradesh", "as": "assam", "br": "bihar", "cg": "chhattisgarh", "ct": "chhattisgarh", "ga": "goa", "gj": "gujarat", "hr": "haryana",
    "hp": "himachal pradesh", "jh": "jharkhand", "ka": "karnataka", "kl": "kerala", "mp": "madhya pradesh", "mh": "maharashtra", "mn": "manipur", "ml": "meghalaya", "mz": "mizoram",
    "nl": "nagaland", "od": "odisha", "or": "odisha", "pb": "punjab", "rj": "rajasthan", "sk": "sikkim", "tn": "tamil nadu", "ts": "telangana", "tg": "telangana", "tr": "tripura",
    "up": "uttar pradesh", "uk": "uttarakhand", "ua": "uttarakhand", "ut": "uttarakhand", "wb": "west bengal", "an": "andaman and nicobar islands", "ch": "chandigarh",
    "dn": "dadra and nagar haveli and daman and diu", "dd": "dadra and nagar haveli and daman and diu", "dl": "delhi", "jk": "jammu and kashmir", "la": "ladakh", "ld": "lakshadweep", "py": "puducherry",
}
# Other spellings.
IN_SPELLINGS = {
    "orissa": "odisha", "pondicherry": "puducherry", "uttaranchal": "uttarakhand", "nct of delhi": "delhi", "chattisgarh": "chhattisgarh", "tamilnadu": "tamil nadu",
    "dadra and nagar haveli": "dadra and nagar haveli and daman and diu", "daman and diu": "dadra and nagar haveli and daman and diu", "andaman and nicobar": "andaman and nicobar islands",
    "jammu kashmir": "jammu and kashmir", "keralam": "kerala",
}
# Departments of each region.
FR_REGIONS = {
    "auvergne rhone alpes": "ain, allier, ardeche, cantal, drome, isere, loire, haute loire, puy de dome, rhone, savoie, haute savoie",
    "bourgogne franche comte": "cote d or, doubs, jura, nievre, haute saone, saone et loire, yonne, territoire de belfort",
    "bretagne": "cotes d armor, finistere, ille et vilaine, morbihan",
    "centre val de loire": "cher, eure et loir, indre, indre et loire, loir et cher, loiret",
    "corse": "corse du sud, haute corse",
    "grand est": "ardennes, aube, marne, haute marne, meurthe et moselle, meuse, moselle, bas rhin, haut rhin, vosges",
    "hauts de france": "aisne, nord, oise, pas de calais, somme",
    "ile de france": "seine et marne, yvelines, essonne, hauts de seine, seine saint denis, val de marne, val d oise, idf",
    "normandie": "calvados, eure, manche, orne, seine maritime",
    "nouvelle aquitaine": "charente, charente maritime, correze, creuse, dordogne, gironde, landes, lot et garonne, pyrenees atlantiques, deux sevres, vienne, haute vienne",
    "occitanie": "ariege, aude, aveyron, gard, haute garonne, gers, herault, lot, lozere, hautes pyrenees, pyrenees orientales, tarn, tarn et garonne",
    "pays de la loire": "loire atlantique, maine et loire, mayenne, sarthe, vendee",
    "provence alpes cote d azur": "alpes de haute provence, hautes alpes, alpes maritimes, bouches du rhone, var, vaucluse, paca",
}

STATES = {
    "US": US_STATES | {v: v for v in US_STATES.values()},
    "India": IN_STATES | {v: v for v in IN_STATES.values()} | IN_SPELLINGS,
    "France": FR_STATES,
}
SHORT_STATES = {"US": list(US_STATES), "India": list(IN_STATES), "France": ["paca", "idf"]}
POSTCODE_LENGTHS = {"US": [5], "France": [5], "India": [6]}

# Words beside a house number.
STREET_WORDS = [
    "rue", "r", "av", "ave", "avenue", "bd", "boulevard", "boul", "all", "allee", "chemin", "ch", "che", "pl", "place", "impasse", "imp", "route", "rte", "quai", "square", "sq", "cours",
    "crs", "passage", "pass", "porte", "parvis", "promenade", "prom", "esplanade", "sentier", "voie", "villa", "cite", "hameau", "lieu", "lotissement", "residence", "res", "mail", "rond",
    "point", "faubourg", "fbg", "montee", "traverse", "ruelle", "st", "street", "rd", "road", "dr", "drive", "ln", "lane", "ct", "court", "blvd", "way", "pkwy", "parkway", "hwy", "highway",
    "trl", "trail", "cir", "circle", "loop", "ter", "terrace", "pike", "pl", "plaza", "sq", "tpke", "turnpike", "aly", "alley", "row", "path", "run", "pass", "xing", "crossing", "cv",
    "cove", "pt", "point", "hl", "hill", "hts", "heights", "main", "marg", "nagar", "road", "lane", "gali", "colony", "sector", "block", "cross",
]
UNIT_WORDS = [
    "appartement", "app", "appt", "apt", "unit", "suite", "ste", "batiment", "bat", "bldg", "building", "flat", "floor", "fl", "flr", "etage", "etg", "bp", "cs", "po", "box", "pmb", "room",
    "rm", "dept", "escalier", "esc", "porte", "tour", "lot",
]
NUMBER_SUFFIXES = [
    "bis", "ter", "quater", "b", "a", "c", "d", "t",
]
ORDINAL_WORDS = [
    "eme", "er", "e", "st", "nd", "rd", "th", "etage", "floor",
]
# Words without an initial.
INITIAL_STOP = [
    "du", "de", "des", "la", "le", "les", "d", "l", "and", "of", "the", "et", "en", "a", "pour", "sur", "aux", "au",
]
# Address words that are no tokens.
ADDR_STOP = [
    "st", "ave", "rd", "blvd", "ln", "dr", "ct", "pl", "cir", "hwy", "pkwy", "trl", "ter", "sq", "n", "s", "e", "w", "ne", "nw", "se", "sw", "apt", "ste", "fl", "bldg", "rte",
    "no", "near", "opp", "behind", "and", "of", "the", "rue", "avenue", "boulevard", "allee", "chemin", "place", "impasse", "route", "de", "du", "des", "la", "le", "les", "l", "d",
    "et", "bis", "floor", "road", "street", "lane", "nagar", "colony", "sec", "ph", "po", "dist", "tal",
]
# Street words that are no part of an address signature.
SIGNATURE_STOP = [
    "st", "ave", "rd", "blvd", "ln", "dr", "ct", "pl", "rue", "avenue", "boulevard", "allee", "chemin", "place", "route", "de", "du", "des", "la", "le", "les", "l", "d", "n", "s",
    "e", "w", "bis",
]
# Words that make no extension key.
GENERIC = [
    "st", "street", "rd", "road", "ave", "avenue", "dr", "drive", "ln", "lane", "ct", "court", "blvd", "way", "pl", "place", "rue", "de", "du", "des", "la", "le", "les", "nagar",
    "main", "cross", "floor", "no", "the", "and", "of", "n", "s", "e", "w", "sector", "block", "colony", "phase", "city", "road", "marg", "gali", "near", "opp", "behind", "allee",
    "chemin", "boulevard", "impasse", "route", "square", "quai", "cours", "bis", "ter",
]
# Patterns of address codes, and of neighbouring address words.
ADDRESS_CODE = r"\b(?:[a-z]{1,3}\s?-\s?)?\d+[a-z]?(?:\s?[-/]\s?[a-z0-9]+)+|\b[a-z]{1,3}\s?-\s?\d+[a-z]?\b|\b[a-z]{1,3}\d+[a-z0-9]*\b|\b\d+[a-z]{1,2}\b"
ADDRESS_BIGRAM = r"(?:^|\s)[a-z]{3,} [a-z]{3,}(?:\s|$)"
