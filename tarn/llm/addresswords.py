"""Words that postal addresses are made of, by the habits of several countries."""

# Kinds of street and their usual abbreviations (English, French, Indian, German, Spanish, Italian).
TYPES = {
    "alley": ["aly"], "allee": ["all"], "avenue": ["ave", "av", "avenida", "avda"], "boulevard": ["blvd", "bd", "boul", "bvd"], "bridge": ["brg"], "bypass": ["byp"], "calle": [],
    "causeway": ["cswy"], "chemin": ["ch", "che", "chem"], "circle": ["cir", "circ"], "close": ["cl"], "corso": [], "court": ["ct", "crt"], "cours": ["crs"], "cove": ["cv"],
    "crescent": ["cres", "crsc"], "cross": [], "drive": ["dr", "drv"], "expressway": ["expy"], "freeway": ["fwy"], "gardens": ["gdns", "garden", "gdn"], "gasse": [], "grove": ["grv"],
    "highway": ["hwy"], "impasse": ["imp"], "lane": ["ln"], "loop": [], "marg": ["mg"], "mews": [], "nagar": [], "parade": ["pde"], "parkway": ["pkwy", "pky"], "paseo": [], "passage": ["psg"],
    "path": [], "place": ["pl"], "platz": [], "plaza": ["plz", "pza"], "promenade": ["prom"], "quai": [], "rise": [], "road": ["rd"], "route": ["rte"], "row": [], "rue": ["r"],
    "salai": [], "square": ["sq"], "strasse": [], "street": ["st", "str"], "terrace": ["ter", "terr"], "trail": ["trl"], "turnpike": ["tpke"], "viale": [], "via": [], "walk": ["wlk"], "way": ["wy"], "weg": [],
}
# Kinds of street written before the name.
BEFORE = ["allee", "avenue", "boulevard", "calle", "chemin", "corso", "cours", "impasse", "paseo", "passage", "place", "plaza", "promenade", "quai", "route", "rue", "viale", "via"]
# Kinds of street that German writes as the end of the name, with their abbreviations.
ENDINGS = {"strasse": "strasse", "str": "strasse"}
# Names of streets usually written by initials, before a kind of street.
INITIALS = {"jfk": "john f kennedy", "mg": "mahatma gandhi", "mlk": "martin luther king", "sv": "swami vivekananda"}
# Directions.
DIRECTIONS = {
    "north": ["n", "nord"], "south": ["s", "sud"], "east": ["e", "est"], "west": ["w", "ouest"], "northeast": ["ne"], "northwest": ["nw"], "southeast": ["se"], "southwest": ["sw"],
}
# Words of parts within a building, with a number or letter beside them.
UNITS = [
    "apartment", "appartement", "appt", "apt", "bat", "batiment", "bldg", "block", "bp", "building", "bureau", "door", "esc", "escalier", "etage", "fl", "flat", "floor", "gr", "ground", "level",
    "lot", "office", "porte", "rm", "room", "ste", "suite", "shop", "stall", "tower", "unit", "wing",
]
# Words before a landmark, and what landmarks usually are.
NEAR = ["adjacent", "behind", "beside", "facing", "near", "next", "nr", "opp", "opposite", "pres"]
LANDMARKS = [
    "airport", "atm", "bank", "bazaar", "bridge", "bus depot", "bus stand", "bus station", "bus stop", "church", "cinema", "city mall", "clock tower", "college", "court", "fire station", "garden", "gurdwara", "hospital",
    "library", "mall", "market", "masjid", "metro station", "mosque", "municipal office", "park", "petrol pump", "police station", "post office", "railway station", "school", "stadium", "station",
    "super market", "telephone exchange", "temple", "theatre", "town hall", "university", "water tank",
]
# Words that carry no place.
EMPTY = ["cedex", "city", "de", "del", "der", "des", "dist", "district", "door", "du", "el", "house", "la", "le", "les", "los", "no", "number", "num", "numero", "plot", "post", "taluk"]
# Last words of town names of two words.
TOWN_ENDS = ["falls", "heights", "springs"]
# Countries as they end an address.
COUNTRIES = [
    "usa", "u.s.a.", "united states", "united states of america", "india", "bharat", "france", "canada", "deutschland", "germany", "espana", "spain", "italia", "italy",
    "united kingdom", "great britain", "england", "australia",
]
# States, provinces and territories and their codes.
STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "district of columbia": "dc",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms",
    "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "puerto rico": "pr",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
    "andaman and nicobar islands": "an", "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "delhi": "dl", "goa": "ga", "gujarat": "gj",
    "haryana": "hr", "himachal pradesh": "hp", "jammu and kashmir": "jk", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "ladakh": "la", "madhya pradesh": "mp", "maharashtra": "mh", "manipur": "mn",
    "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "puducherry": "py", "punjab": "pb", "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "telangana": "tg", "tripura": "tr",
    "uttar pradesh": "up", "uttarakhand": "uk", "west bengal": "wb",
    "alberta": "ab", "british columbia": "bc", "manitoba": "mb", "new brunswick": "nb", "newfoundland and labrador": "nl", "northwest territories": "nt", "nova scotia": "ns", "nunavut": "nu",
    "ontario": "on", "prince edward island": "pe", "quebec": "qc", "saskatchewan": "sk", "yukon": "yt",
    "new south wales": "nsw", "queensland": "qld", "south australia": "sa", "tasmania": "tas", "victoria": "vic", "western australia": "wa",
}
# Codes of states that are also common words of addresses, and so are read as a state only where they stand alone in their part.
DOUBTFUL = ["an", "as", "de", "la", "on", "sa"]
