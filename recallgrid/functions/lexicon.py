"""Word lists, patterns and tables."""

from __future__ import annotations

# Query characters with a meaning to search engines.
OPERATOR_CHARACTERS = "'’‘\"“”/\\+-!(){}[]^~*?:<>=&|"

# Inflection endings, first match wins.
SUFFIXES = ["ów", "ach", "ami", "om", "owi", "em", "ię", "ie", "ej", "ą", "ę", "y", "i"]

# Injection phrases and what each one is.
INJECTION_PATTERNS = [
    ("ignore previous instructions", "system prompt override"),
    ("ignore all previous", "system prompt override"),
    ("disregard above", "system prompt override"),
    ("forget everything", "system prompt override"),
    ("you are now", "role hijack"),
    ("act as if", "role hijack"),
    ("pretend you are", "role hijack"),
    ("new instructions:", "instruction injection"),
    ("system:", "system prompt injection"),
    ("<<sys>>", "system prompt injection"),
    ("[system]", "system prompt injection"),
    ("</s>", "token injection"),
    ("<|im_end|>", "token injection"),
    ("<|endoftext|>", "token injection"),
    ("human:", "conversation injection"),
    ("assistant:", "conversation injection"),
    ("[inst]", "instruction injection"),
    ("[/inst]", "instruction injection"),
]

# HTML entities in the order they are decoded.
HTML_ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]

# Personal data patterns.
PHONE = r"(?:\d{3}[\s\-]?\d{3}[\s\-]?\d{3}|\d{2}[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2})"
PHONE_PREFIX = r"\+48\s?"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
ELEVEN_DIGITS = r"\b\d{11}\b"

# First-person openings and their third-person form, longest first.
FIRST_PERSON = [
    ("I've ", "User has "), ("I'm ", "User is "), ("I'll ", "User will "), ("I'd ", "User would "),
    ("I have ", "User has "), ("I had ", "User had "), ("I am ", "User is "), ("I was ", "User was "),
    ("I will ", "User will "), ("I would ", "User would "), ("I do ", "User does "), ("I did ", "User did "),
    ("I ", "User "), ("My ", "User's "), ("my ", "user's "),
]

# Query types, their features, and the raw channel weights
# (dense, lexical, entity, graph, recency) before normalisation.
DOCUMENT_PHRASES = [
    "wgrałem", "wgrałam", "wgraliśmy", "wgrały", "wgrał", "załadowałem", "załadowałam", "załadowali",
    r"ten\s+plik", r"ten\s+paper", r"ten\s+dokument", r"ten\s+pdf", r"w\s+dokumencie", r"w\s+pdf", r"z\s+pdf",
    r"z\s+dokumentu", "uploaded", "upload", r"this\s+file", r"this\s+paper", r"this\s+document", r"this\s+pdf",
    r"in\s+pdf", r"in\s+document", r"in\s+the\s+document",
]
RELATION_WORDS = ["z", r"razem\s+z", r"wraz\s+z", "nad", "dla", "przeciwko", "with", "vs", "versus", "between", "for",
                  "against", "among"]
TIME_PHRASES = [
    "wczoraj", "dziś", "jutro", "dzisiaj",
    r"w\s+(?:marcu|kwietniu|maju|czerwcu|lipcu|sierpniu|wrześniu|październiku|listopadzie|grudniu|styczniu|lutym)",
    "yesterday", "today", "tomorrow",
    r"in\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)",
    r"last\s+(?:week|month|year)", r"(?:miesiąc|tydzień|rok|day|days|week|month|year)\s+(?:temu|ago)",
]
TIME_NUMBERS = [r"/\d+", r"\b\d{4}\b"]
RECENT_WORDS = ["ostatnia", "ostatni", "ostatnie", "ostatnio", "ostatnim", "ostatnią", "recent", "recently", "latest",
                "last", "nowy", "nowa", "nowe", "nowości", "świeży", "świeże", "świeżo", "fresh", "new"]
QUESTION_WORDS = ["co", "kto", "gdzie", "kiedy", "jak", "ile", "który", "która", "które", "what", "who", "where", "when", "how"]
POLISH_LETTERS = "ążęłóśćńźĄŻĘŁÓŚĆŃŹ"
POLISH_MARKERS = [" co ", " kto ", " gdzie ", " kiedy ", " ostatni", " wczoraj", "wgrał", "ten plik"]
ENGLISH_MARKERS = [" what ", " who ", " where ", " when ", " uploaded", " yesterday", " recent"]
CHANNELS = ["dense", "lexical", "entity", "graph", "recency"]
CHANNEL_WEIGHTS = {
    "factual": [0.35, 0.35, 0.20, 0.08, 0.08],
    "temporal": [0.20, 0.08, 0.08, 0.08, 0.20],
    "relational": [0.20, 0.08, 0.35, 0.35, 0.08],
    "recent": [0.08, 0.08, 0.08, 0.00, 0.35],
    "lookup": [0.35, 0.35, 0.08, 0.00, 0.08],
}

# Phrases of the query complexity classes.
PROFILE_PHRASES = ["profil", "co wiesz o mnie", "kim jestem", "mój profil", "podsumuj mnie"]
AGGREGATION_PHRASES = [
    "ile ", "how many", "ile razy", "ilu ", "lista ", "list all", "wymień", "wypisz", "wszystkie ", "wszystkich ",
    "name every", "jakie wszystkie", "ile różnych", "ile unikalnych", "how many different", "how many unique",
    "how many total",
]
COMPLEX_PHRASES = ["dlaczego", "jak ", "porównaj", "ewoluował", "zmienił", "historia", "podsumuj", "przeanalizuj",
                   "różnica między", "timeline", "chronolog"]
TEMPORAL_PHRASES = ["kiedy", "ostatnio", "wczoraj", "tydzień", "miesiąc", "rok", "w marcu", "w styczniu", "w lutym",
                    "w kwietniu", "od ", "do ", "przed", "po ", "między", "ago", "last week", "recently"]
PREFERENCE_PHRASES = ["prefer", "favorite", "favourite", "like more", "like best", "rather", "which do i like",
                      "what do i enjoy", "what do i like", "do i enjoy", "do i prefer"]
COUNTING_PHRASES = ["how many", "how much", "how often", "total", "count", "all the", "every", "each", "list all",
                    "in total", "combined", "sum", "altogether"]

# Words that mark a fact type, looked up in this order.
PREFERENCE_FACTS = ["prefer", "chose", "decided", "switch", "zamiast", "woli", "ulubion", "zdecydow", "wybrał", "likes",
                    "dislikes", "favorite", "favourite"]
EXPERIENCE_FACTS = ["lesson", "learned", "always ", "never ", "best practice", "anti-pattern", "antipattern", "tip:",
                    "when you ", "lekcja", "nauczył", "sprawdzon", "unikaj", "strategia"]
PROJECT_FACTS = ["working on", "sprint", "deadline", "blocked", "projekt", "pracuje nad", "kończy się", "release",
                 "deploy", "migration", "bug", "task"]

# Trust tier of a source, and its rank.
TRUST_OF_SOURCE = {
    "api": "a1", "user_direct": "a1", "confirmed_preference": "a1", "first_party_doc": "a1",
    "mcp": "a2", "mcp-ingest": "a2", "assistant_generated": "a2",
    "external_web": "b", "imported_third_party": "b", "firecrawl": "b", "ocr": "b",
}
TRUST_RANK = {"a1": 3, "a2": 2, "b": 1}

# Canonical relation labels.
RELATIONS = ["works_at", "uses", "manages", "member_of", "implements", "located_in", "related_to", "created",
             "logged_in_via", "pays_for", "deployed_in", "accepted", "confirmed_participation"]

# Content type labels.
CONTENT_TYPES = ["operational_instruction", "policy", "changelog", "case_study", "article", "person_profile", "index",
                 "org_fact", "technical_project", "other"]

# Month and weekday names in dates.
ENGLISH_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
                  "november", "december"]
POLISH_MONTHS = ["stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "września",
                 "października", "listopada", "grudnia"]
ENGLISH_WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
POLISH_WEEKDAYS = [["poniedziałek", "poniedzialek"], ["wtorek"], ["środę", "srode", "środe", "srodę"], ["czwartek"],
                   ["piątek", "piatek"], ["sobotę", "sobote"], ["niedzielę", "niedziele"]]

# Query words that name no attribute.
ATTRIBUTE_STOPWORDS = [
    "jaki", "jaka", "jakie", "jakiego", "jakiej", "jakim", "jaką", "który", "która", "które", "którego", "której",
    "którym", "kiedy", "gdzie", "dlaczego", "czemu", "czym", "czego", "kogo", "komu", "jest", "był", "była", "było",
    "byli", "są", "będzie", "mają", "miał", "ile", "czy", "oraz", "albo", "lub", "ale", "dla", "nad", "pod", "przy",
    "się", "ten", "tego", "tym", "taki", "takie", "what", "which", "when", "where", "why", "who", "whose", "whom",
    "how", "the", "and", "was", "were", "has", "have", "had", "does", "did", "are", "his", "her", "its", "their",
    "this", "that", "with", "about", "from", "many", "much",
]
