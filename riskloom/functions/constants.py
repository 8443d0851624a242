"""Fixed values of the risk model: code lists, caps, lexicons, routes and places."""

from __future__ import annotations

# Theme codes by tier.
TIER1 = ("ARMEDCONFLICT", "TERROR_ATTACK", "INVASION", "COUP", "ETHNIC_VIOLENCE", "GENOCIDE", "NUCLEAR_WEAPONS", "CHEMICAL_WEAPONS", "BIOLOGICAL_WEAPONS")
TIER2 = (
    "TERROR", "TAX_FNCACT_MILITARY", "TAX_FNCACT_SOLDIER", "TAX_FNCACT_REBEL", "TAX_FNCACT_TERRORIST", "SANCTION", "NUCLEAR",
    "DIPLOMATIC_CRISIS", "BLOCKADE", "BORDER_DISPUTE", "MARITIME_DISPUTE", "PROXY_WAR", "BALLISTIC_MISSILES",
)
TIER3 = ("ESPIONAGE", "CYBERATTACK", "WAR_CRIME")
TIER_WEIGHTS = ((TIER1, 1.0), (TIER2, 0.6), (TIER3, 0.3))
#: Raw theme weight that a full theme score needs is THEME_SCALE times the cap.
THEME_SCALE = 3.0

# Caps and floors of the score's components.
THEME_CAP, TONE_NEG_CAP, TONE_POL_CAP, DIM_CAP = 0.50, 0.20, 0.10, 0.20
TONE_NEG_MIN, TONE_NEG_SCALE, TONE_POL_SCALE, DIM_MIN = 5.0, 25.0, 20.0, 0.15
DIM_WEIGHTS = {"c18.3": 0.40, "c18.2": 0.30, "c18.1": 0.20, "c9.1": 0.10}
POSITIVE_ABOVE = 0.20

# Event categories in order of precedence.
CATEGORIES = {
    "military_conflict": ("ARMEDCONFLICT", "INVASION", "ETHNIC_VIOLENCE", "GENOCIDE"),
    "terrorism": ("TERROR", "TERROR_ATTACK", "TAX_FNCACT_TERRORIST"),
    "diplomatic_tension": ("DIPLOMATIC_CRISIS", "BORDER_DISPUTE", "MARITIME_DISPUTE"),
    "nuclear_threat": ("NUCLEAR", "NUCLEAR_WEAPONS", "BALLISTIC_MISSILES"),
    "sanctions": ("SANCTION", "BLOCKADE"),
    "coup_regime": ("COUP",),
    "civil_war": ("PROXY_WAR", "TAX_FNCACT_REBEL"),
}
CATEGORY_NAMES = (*CATEGORIES, "other")

# Shape of the index, and of the route index.
TAIL_EXPONENT, UPPER_STRETCH = 2.45, 1.08
ROUTE_TAIL_EXPONENT, ROUTE_UPPER_STRETCH, MIN_HIT_DAYS = 1.5, 1.05, 2
BASE_MEAN, BASE_STD = 100.0, 35.0

# Tone and dimension lexicons.
NEGATIVE_WORDS = (
    "abuse aggression angry attack atrocity bad ban battle betrayal blast blockade bomb casualty chaos clash conflict corrupt crisis "
    "damage danger dead death defeat destroy disaster dispute embargo enemy escalation expel explosion extremist fail fear fight fraud "
    "genocide grief hate hostile illegal injure invasion kill massacre militant missile murder nuclear outrage rebel riot risk sanction "
    "siege strike suffer terror terrorist threat torture toxic tragic unrest violence violent war weapon wound"
).split()
POSITIVE_WORDS = (
    "accord agreement ally approve ceasefire cooperate cooperation diplomacy friend gain good hope improve peace peaceful progress "
    "protect reconcile recover relief resolve safe secure stability success support truce victory welcome"
).split()
DIM_LEXICONS = {
    "c18.1": "battle blockade clash conflict coup dispute invasion military rebel sanction siege soldier troop war".split(),
    "c18.2": "alarm danger escalation fear hostage missile nuclear risk terror terrorist threat weapon".split(),
    "c18.3": "airstrike attack blast bomb destroy explosion fight genocide kill massacre murder strike torture violence violent".split(),
    "c9.1": "aggression angry condemn enemy fury hate hostile outrage rage retaliation revenge".split(),
}
DIM_DENSITY = 0.04

# Keywords of the second feed tier.
KEYWORDS = (
    "border", "LAC", "LoC", "China", "Pakistan", "defence ministry", "army", "navy", "air force", "missile", "drone strike",
    "foreign policy", "diplomatic", "embassy", "sanctions", "Quad", "SCO", "terrorism", "cross-border", "ceasefire", "bilateral",
    "MEA", "S-400", "Agni", "BrahMos", "national security", "intelligence agency", "RAW", "ISI", "geopolitics", "insurgency",
    "defence deal", "arms deal", "military exercise", "naval exercise", "airspace violation", "nuclear", "strategic partnership",
    "UNSC", "G20", "bilateral talks", "foreign minister", "external affairs",
)
GEO_TOKENS = (
    "armedconflict", "terror", "invasion", "coup", "sanction", "blockade", "war", "military", "border", "nuclear", "conflict",
    "geopolit", "missile", "strike", "escalat",
)

# Trade routes. Country and region codes are FIPS 10-4; bounds are least and most latitude, then longitude.
ROUTES = {
    "strait_of_hormuz": {"name": "Strait of Hormuz", "category": "sea", "countries": ("IR", "MU", "AE", "QA", "SA", "BA"), "bounds": (26.0, 27.2, 55.5, 57.2), "adm1": (), "energy": 0.336, "goods": 0.0},
    "red_sea_suez": {"name": "Red Sea / Bab el-Mandeb / Suez", "category": "sea", "countries": ("EG", "YM", "DJ", "ER", "SU", "SA"), "bounds": (12.0, 31.5, 32.0, 44.0), "adm1": (), "energy": 0.271, "goods": 0.35},
    "strait_of_malacca": {"name": "Strait of Malacca", "category": "sea", "countries": ("MY", "SN", "ID"), "bounds": (0.5, 6.5, 98.0, 104.5), "adm1": (), "energy": 0.0, "goods": 0.55},
    "cape_of_good_hope": {"name": "Cape of Good Hope", "category": "sea", "countries": ("SF",), "bounds": (-36.0, -32.0, 16.0, 21.0), "adm1": (), "energy": 0.136, "goods": 0.0},
    "danish_straits_baltic": {"name": "Danish Straits / Baltic", "category": "sea", "countries": ("DA", "SW", "FI", "EN", "LG", "LH", "RS"), "bounds": (54.0, 58.5, 8.0, 16.5), "adm1": (), "energy": 0.176, "goods": 0.0},
    "taiwan_south_china_sea": {"name": "Taiwan Strait / South China Sea", "category": "sea", "countries": ("CH", "TW", "VM", "RP", "BX"), "bounds": (3.0, 26.5, 105.0, 122.5), "adm1": (), "energy": 0.0, "goods": 0.55},
    "india_china_lac": {"name": "India-China LAC (Ladakh)", "category": "land", "countries": ("IN", "CH"), "bounds": None, "adm1": ("IN30", "CH14", "CH29"), "energy": 0.0, "goods": 0.0},
    "india_pakistan_attari": {"name": "India-Pakistan (Attari-Wagah)", "category": "land", "countries": ("IN", "PK"), "bounds": None, "adm1": ("IN23", "PK04"), "energy": 0.0, "goods": 0.0},
    "india_bangladesh_petrapole": {"name": "India-Bangladesh (Petrapole)", "category": "land", "countries": ("IN", "BG"), "bounds": None, "adm1": ("IN28", "BG82"), "energy": 0.0, "goods": 0.0},
    "india_nepal_raxaul": {"name": "India-Nepal (Raxaul-Birgunj)", "category": "land", "countries": ("IN", "NP"), "bounds": None, "adm1": ("IN34", "NP2"), "energy": 0.0, "goods": 0.0},
    "imec": {"name": "India-Middle East-Europe Economic Corridor", "category": "strategic", "countries": ("AE", "SA", "JO", "IS", "GR", "IT"), "bounds": None, "adm1": (), "energy": 0.0, "goods": 0.0},
    "instc_chabahar": {"name": "INSTC / Chabahar", "category": "strategic", "countries": ("IR", "AJ", "RS", "KZ", "TX"), "bounds": None, "adm1": (), "energy": 0.0, "goods": 0.0},
}
# Names by which a place on a route is mentioned: (place, aliases, latitude, longitude, country, region, route).
PLACES = (
    ("Strait of Hormuz", ("Strait of Hormuz", "Hormuz Strait", "Hormuz"), 26.5667, 56.25, "MU", "", "strait_of_hormuz"),
    ("Red Sea", ("Red Sea", "Houthi"), 20.0, 38.0, "", "", "red_sea_suez"),
    ("Bab el-Mandeb", ("Bab el-Mandeb", "Bab al-Mandab", "Bab al Mandab"), 12.5833, 43.3333, "YM", "", "red_sea_suez"),
    ("Suez Canal", ("Suez Canal", "Suez"), 30.455, 32.35, "EG", "", "red_sea_suez"),
    ("Strait of Malacca", ("Strait of Malacca", "Malacca Strait", "Malacca"), 2.5, 101.0, "MY", "", "strait_of_malacca"),
    ("Cape of Good Hope", ("Cape of Good Hope", "Cape Route"), -34.3568, 18.474, "SF", "", "cape_of_good_hope"),
    ("Danish Straits", ("Danish Straits", "Danish Strait", "Oresund", "Øresund", "Great Belt"), 55.75, 12.75, "DA", "", "danish_straits_baltic"),
    ("Baltic Sea", ("Baltic Sea",), 57.0, 19.0, "", "", "danish_straits_baltic"),
    ("Taiwan Strait", ("Taiwan Strait", "Formosa Strait"), 24.0, 119.5, "TW", "", "taiwan_south_china_sea"),
    ("South China Sea", ("South China Sea", "Spratly Islands", "Paracel Islands"), 12.0, 114.0, "", "", "taiwan_south_china_sea"),
    ("Ladakh", ("Ladakh", "Galwan Valley", "Pangong Tso", "Demchok"), 34.1526, 77.5771, "IN", "IN30", "india_china_lac"),
    ("Attari-Wagah", ("Attari-Wagah", "Attari Wagah", "Wagah Border", "Attari Border"), 31.6048, 74.572, "IN", "IN23", "india_pakistan_attari"),
    ("Petrapole", ("Petrapole", "Benapole"), 23.05, 88.83, "IN", "IN28", "india_bangladesh_petrapole"),
    ("Raxaul-Birgunj", ("Raxaul", "Birgunj", "Raxaul-Birgunj"), 26.9833, 84.85, "IN", "IN34", "india_nepal_raxaul"),
    ("India-Middle East-Europe Economic Corridor", ("India-Middle East-Europe Economic Corridor", "IMEC corridor"), 25.2048, 55.2708, "AE", "", "imec"),
    ("International North-South Transport Corridor", ("International North-South Transport Corridor", "INSTC corridor"), 27.1833, 56.2667, "IR", "", "instc_chabahar"),
    ("Chabahar", ("Chabahar", "Chabahar Port"), 25.2919, 60.643, "IR", "IR04", "instc_chabahar"),
)
# Editorial buckets by code and, failing that, by pattern in this order.
TOPIC_CODES = {
    "CONFLICT": ("ARMEDCONFLICT", "INVASION", "COUP", "ETHNIC_VIOLENCE", "GENOCIDE", "BORDER_DISPUTE", "MARITIME_DISPUTE", "PROXY_WAR", "WAR_CRIME", "DIPLOMATIC_CRISIS"),
    "TRADE": ("BLOCKADE", "SANCTION"),
    "MILITARY": ("NUCLEAR_WEAPONS", "NUCLEAR", "BALLISTIC_MISSILES", "CHEMICAL_WEAPONS", "BIOLOGICAL_WEAPONS", "TAX_FNCACT_MILITARY", "TAX_FNCACT_SOLDIER", "TAX_FNCACT_REBEL", "ESPIONAGE", "CYBERATTACK"),
    "TERROR": ("TERROR", "TERROR_ATTACK", "TAX_FNCACT_TERRORIST"),
}
TOPIC_PATTERNS = (
    ("MILITARY", "NUCLEAR|BALLISTIC|MISSILE|MILITARY|SOLDIER|WEAPON|CYBER|ESPIONAGE"),
    ("TERROR", "TERROR|EXTREMIST|JIHAD|BOMB|BLAST"),
    ("TRADE", "SANCTION|TRADE|EMBARGO|BLOCKADE|SHIPPING|PORT"),
    ("CONFLICT", "CONFLICT|WAR|INVAS|BORDER|FIGHT|COUP|VIOLENCE|DISPUTE"),
)

# Points of the routes as (latitude, longitude), and their centres.
WAYPOINTS = {
    "strait_of_hormuz": ((26.0, 52.0), (26.5667, 56.25), (25.5, 58.5)),
    "red_sea_suez": ((12.5833, 43.3333), (20.0, 38.0), (30.455, 32.35)),
    "strait_of_malacca": ((5.5, 98.5), (2.5, 101.0), (1.3, 103.9)),
    "cape_of_good_hope": ((-20.0, 5.0), (-34.3568, 18.474), (-15.0, 42.0)),
    "danish_straits_baltic": ((55.75, 12.75), (57.0, 19.0)),
    "taiwan_south_china_sea": ((2.5, 101.0), (12.0, 114.0), (24.0, 119.5)),
    "india_china_lac": ((28.0, 77.0), (34.1526, 77.5771)),
    "india_pakistan_attari": ((31.63, 74.87), (31.6048, 74.572)),
    "india_bangladesh_petrapole": ((22.5, 88.2), (23.05, 88.83)),
    "india_nepal_raxaul": ((26.8, 84.7), (26.9833, 84.85)),
    "imec": ((20.5937, 78.9629), (25.2048, 55.2708)),
    "instc_chabahar": ((20.5937, 78.9629), (25.2919, 60.643)),
}
CENTRES = {
    "strait_of_hormuz": (26.5667, 56.25),
    "red_sea_suez": (20.0, 38.0),
    "strait_of_malacca": (2.5, 101.0),
    "cape_of_good_hope": (-34.3568, 18.474),
    "danish_straits_baltic": (55.75, 12.75),
    "taiwan_south_china_sea": (12.0, 114.0),
    "india_china_lac": (34.1526, 77.5771),
    "india_pakistan_attari": (31.6048, 74.572),
    "india_bangladesh_petrapole": (23.05, 88.83),
    "india_nepal_raxaul": (26.9833, 84.85),
    "imec": (25.2048, 55.2708),
    "instc_chabahar": (25.2919, 60.643),
}
# Seconds between two fetches of the feeds of a tier.
FEED_SECONDS = {1: 420, 2: 720}

# Countries (FIPS 10-4 codes) with the words that mention them: (code, name, latitude, longitude, words).
COUNTRIES = (
    ("IN", "India", 20.0, 77.0, ("india", "indian")),
    ("PK", "Pakistan", 30.0, 70.0, ("pakistan", "pakistani")),
    ("BG", "Bangladesh", 23.7, 90.4, ("bangladesh", "bangladeshi")),
    ("CE", "Sri Lanka", 7.0, 81.0, ("sri lanka", "sri lankan")),
    ("NP", "Nepal", 28.0, 84.0, ("nepal", "nepali")),
    ("BM", "Myanmar", 17.0, 96.0, ("myanmar",)),
    ("AF", "Afghanistan", 33.0, 65.0, ("afghanistan", "afghan")),
    ("MV", "Maldives", 3.2, 73.2, ("maldives",)),
    ("BT", "Bhutan", 27.5, 90.5, ("bhutan",)),
    ("CH", "China", 35.0, 105.0, ("china", "chinese")),
    ("JA", "Japan", 36.0, 138.0, ("japan", "japanese")),
    ("TW", "Taiwan", 23.5, 121.0, ("taiwan",)),
    ("KS", "South Korea", 37.0, 128.0, ("south korea",)),
    ("KN", "North Korea", 40.0, 127.0, ("north korea",)),
    ("VM", "Vietnam", 16.0, 108.0, ("vietnam",)),
    ("ID", "Indonesia", -5.0, 120.0, ("indonesia",)),
    ("MY", "Malaysia", 2.5, 112.5, ("malaysia",)),
    ("RP", "Philippines", 13.0, 122.0, ("philippines",)),
    ("TH", "Thailand", 15.0, 100.0, ("thailand",)),
    ("SN", "Singapore", 1.4, 103.8, ("singapore",)),
    ("IR", "Iran", 32.0, 53.0, ("iran", "iranian")),
    ("IZ", "Iraq", 33.0, 44.0, ("iraq",)),
    ("IS", "Israel", 31.5, 34.8, ("israel", "israeli")),
    ("SA", "Saudi Arabia", 24.0, 45.0, ("saudi arabia", "saudi")),
    ("TU", "Turkey", 39.0, 35.0, ("turkey", "turkish")),
    ("AE", "United Arab Emirates", 24.0, 54.0, ("uae", "united arab emirates")),
    ("QA", "Qatar", 25.3, 51.5, ("qatar",)),
    ("KU", "Kuwait", 29.5, 47.8, ("kuwait",)),
    ("JO", "Jordan", 31.0, 36.0, ("jordan",)),
    ("MU", "Oman", 21.0, 57.0, ("oman",)),
    ("YM", "Yemen", 15.5, 48.0, ("yemen",)),
    ("SY", "Syria", 35.0, 38.0, ("syria",)),
    ("LE", "Lebanon", 33.9, 35.5, ("lebanon",)),
    ("WE", "West Bank", 32.0, 35.3, ("palestine",)),
    ("GZ", "Gaza Strip", 31.4, 34.4, ("gaza",)),
    ("AJ", "Azerbaijan", 40.5, 47.5, ("azerbaijan",)),
    ("AM", "Armenia", 40.0, 45.0, ("armenia",)),
    ("RS", "Russia", 60.0, 100.0, ("russia", "russian")),
    ("UP", "Ukraine", 49.0, 32.0, ("ukraine", "ukrainian")),
    ("UK", "United Kingdom", 54.0, -2.0, ("united kingdom", "britain", "british", "england")),
    ("FR", "France", 46.0, 2.0, ("france", "french")),
    ("GM", "Germany", 51.0, 10.0, ("germany", "german")),
    ("IT", "Italy", 42.8, 12.8, ("italy",)),
    ("SP", "Spain", 40.0, -4.0, ("spain",)),
    ("PL", "Poland", 52.0, 20.0, ("poland",)),
    ("SW", "Sweden", 62.0, 15.0, ("sweden",)),
    ("NO", "Norway", 62.0, 10.0, ("norway",)),
    ("FI", "Finland", 64.0, 26.0, ("finland",)),
    ("GR", "Greece", 39.0, 22.0, ("greece",)),
    ("NL", "Netherlands", 52.5, 5.8, ("netherlands",)),
    ("SZ", "Switzerland", 47.0, 8.0, ("switzerland",)),
    ("AU", "Austria", 47.5, 14.6, ("austria",)),
    ("EZ", "Czech Republic", 49.8, 15.5, ("czech",)),
    ("HU", "Hungary", 47.0, 19.5, ("hungary",)),
    ("RO", "Romania", 46.0, 25.0, ("romania",)),
    ("RI", "Serbia", 44.0, 21.0, ("serbia",)),
    ("US", "United States", 38.0, -97.0, ("united states", "america", "american", "usa", "washington")),
    ("CA", "Canada", 60.0, -95.0, ("canada", "canadian")),
    ("MX", "Mexico", 23.0, -102.0, ("mexico",)),
    ("BR", "Brazil", -10.0, -55.0, ("brazil",)),
    ("AR", "Argentina", -34.0, -64.0, ("argentina",)),
    ("CO", "Colombia", 4.0, -72.0, ("colombia",)),
    ("VE", "Venezuela", 8.0, -66.0, ("venezuela",)),
    ("NI", "Nigeria", 10.0, 8.0, ("nigeria",)),
    ("SF", "South Africa", -29.0, 25.0, ("south africa",)),
    ("ET", "Ethiopia", 8.0, 38.0, ("ethiopia",)),
    ("KE", "Kenya", 1.0, 38.0, ("kenya",)),
    ("EG", "Egypt", 27.0, 30.0, ("egypt", "egyptian")),
    ("SU", "Sudan", 15.0, 30.0, ("sudan",)),
    ("SO", "Somalia", 6.0, 46.0, ("somalia",)),
    ("LY", "Libya", 27.0, 17.0, ("libya",)),
    ("MO", "Morocco", 32.0, -5.0, ("morocco",)),
    ("AG", "Algeria", 28.0, 3.0, ("algeria",)),
    ("AS", "Australia", -25.0, 135.0, ("australia", "australian")),
    ("NZ", "New Zealand", -41.0, 174.0, ("new zealand",)),
)

# What the prototype of each theme code says, and the similarity from which a text has the theme.
DESCRIPTIONS = {
    "ARMEDCONFLICT": "armed conflict military war battle fighting troops killed airstrike",
    "TERROR_ATTACK": "terror attack bombing explosion blast suicide attack killed civilians",
    "INVASION": "invasion troops cross border military forces enter territory occupation",
    "COUP": "military coup overthrow government takeover power seized junta",
    "ETHNIC_VIOLENCE": "ethnic violence communal riots religious conflict massacre sectarian",
    "GENOCIDE": "genocide ethnic cleansing mass killing systematic murder atrocities",
    "NUCLEAR_WEAPONS": "nuclear weapon warhead atomic bomb detonation nuclear strike",
    "CHEMICAL_WEAPONS": "chemical weapon sarin chlorine gas attack nerve agent toxic",
    "BIOLOGICAL_WEAPONS": "biological weapon anthrax bioterrorism weaponized pathogen",
    "TERROR": "terrorism terrorist threat plot radicalization extremism",
    "TAX_FNCACT_MILITARY": "military forces army navy air force defence personnel",
    "TAX_FNCACT_SOLDIER": "soldier troops military personnel armed forces combat veteran",
    "TAX_FNCACT_REBEL": "rebel insurgent militant armed group guerrilla uprising resistance",
    "TAX_FNCACT_TERRORIST": "terrorist jihadist extremist bomber attacker radicalized",
    "SANCTION": "sanctions economic penalties trade restrictions embargo asset freeze",
    "NUCLEAR": "nuclear program enrichment reactor uranium plutonium proliferation",
    "DIPLOMATIC_CRISIS": "diplomatic crisis relations severed ambassador expelled tensions",
    "BLOCKADE": "blockade siege naval blockade supply cut access denied embargo",
    "BORDER_DISPUTE": "border dispute territorial claim Line of Control LAC skirmish",
    "MARITIME_DISPUTE": "maritime dispute territorial waters island claim naval standoff",
    "PROXY_WAR": "proxy war foreign-backed militia arms supply proxy conflict",
    "BALLISTIC_MISSILES": "ballistic missile launch ICBM test fire nuclear capable",
    "ESPIONAGE": "espionage spy intelligence leak classified surveillance covert",
    "CYBERATTACK": "cyberattack hacking ransomware data breach infrastructure attack",
    "WAR_CRIME": "war crime civilian target atrocity human rights violation torture",
}
SIMILARITY = 0.34

# What calibration asks of the theme score's median and mean, and the least sample that may change a threshold.
CALIBRATION_MEDIAN, CALIBRATION_MEAN = (0.30, 0.40), (0.35, 0.45)
LEAST_POSITIVE, LEAST_SHARE, LEAST_SAMPLE = 30, 0.10, 100
