"""Word lists, patterns and tables that results depend on, in their
natural order.  Patterns are written without flags; matching ignores case."""

# Strength of obligations, as clause meanings rank them.
OBLIGATION_STRENGTH = {
    "may": 0, "should": 1, "recommended": 2, "required": 3, "must": 4, "shall": 5, "must_not": 4, "shall_not": 5,
    "kann": 0, "darf": 0, "sollte": 1, "soll": 5, "empfohlen": 2, "erforderlich": 3, "muss": 4, "müssen": 4, "darf_nicht": 4,
    "peut": 0, "devrait": 1, "recommandé": 2, "requis": 3, "exigé": 3, "doit": 5, "doivent": 5, "devra": 5, "ne_doit_pas": 4,
}

# Words that begin a condition.
CONDITIONS = (
    "if", "when", "unless", "except when", "provided that", "subject to", "where",
    "wenn", "falls", "sofern", "außer wenn", "es sei denn", "unter der Bedingung", "vorausgesetzt",
    "si", "lorsque", "sauf si", "à condition que", "sous réserve", "pourvu que",
)

# Obligation patterns of clause meanings; of equal positions the first listed wins.
OBLIGATIONS = (
    ("shall", r"\bshall\b"),
    ("must", r"\bmust\b"),
    ("required", r"\b(?:is|are|be|been)?\s*required(?:\s+to)?\b|\brequired\s+to\b"),
    ("recommended", r"\b(?:is|are|be|been)?\s*recommended(?:\s+to)?\b|\brecommended\s+to\b"),
    ("should", r"\bshould\b"),
    ("may", r"\bmay\b"),
    ("must_not", r"\bdarf\s+nicht\b|\bdürfen\s+nicht\b"),
    ("shall", r"\bmuss\b|\bmüssen\b"),
    ("shall", r"\bsoll\b|\bsollen\b"),
    ("required", r"\berforderlich\b|\bnotwendig\b"),
    ("recommended", r"\bempfohlen\b|\bempfiehlt\b"),
    ("may", r"\bdarf\b|\bdürfen\b"),
    ("may", r"\bkann\b|\bkönnen\b"),
    ("must_not", r"\bne\s+doit\s+pas\b|\bne\s+doivent\s+pas\b"),
    ("shall", r"\bdoit\b|\bdoivent\b"),
    ("shall", r"\bdevra\b|\bdevront\b"),
    ("required", r"\brequis\b|\bexigé\b|\bobligatoire\b"),
    ("recommended", r"\brecommandé\b|\bconseillé\b"),
    ("may", r"\bpeut\b|\bpeuvent\b"),
)

# Synonyms, rewritten in this order.
SYNONYMS = (
    (r"\bmulti[-\s]?factor authentication\b", "mfa"), (r"\btwo[-\s]?factor authentication\b", "mfa"), (r"\b2fa\b", "mfa"),
    (r"\bmehr[-\s]?faktor[-\s]?authentifizierung\b", "mfa"), (r"\bzwei[-\s]?faktor[-\s]?authentifizierung\b", "mfa"),
    (r"\bauthentification\s+(?:à\s+)?multi[-\s]?facteurs?\b", "mfa"), (r"\bauthentification\s+(?:à\s+)?deux\s+facteurs?\b", "mfa"),
    (r"\bprivileged accounts\b", "privileged access"), (r"\bprivileged account\b", "privileged access"),
    (r"\bprivilegierte\s+zugriffe?\b", "privileged access"), (r"\baccès\s+privilégiés?\b", "privileged access"),
    (r"\badmins\b", "administrators"), (r"\badmin\b", "administrator"), (r"\badministratoren\b", "administrators"),
    (r"\badministrateurs?\b", "administrator"), (r"\bend[-\s]?users?\b", "users"), (r"\bbenutzer\b", "users"),
    (r"\butilisateurs?\b", "users"), (r"\bpersonnel\b", "staff"), (r"\bstaff\b", "staff"), (r"\bmitarbeiter\b", "staff"),
    (r"\bpersonnels?\b", "staff"), (r"\bthird[-\s]?parties\b", "third-party"), (r"\bthird[-\s]?party\b", "third-party"),
    (r"\bvendors?\b", "third-party"), (r"\bservice providers?\b", "third-party"), (r"\bdrittanbieter\b", "third-party"),
    (r"\bdienstleister\b", "third-party"), (r"\btiers\b", "third-party"), (r"\bprestataires?\b", "third-party"),
    (r"\bfournisseurs?\b", "third-party"), (r"\bpersonally identifiable information\b", "pii"), (r"\bpii\b", "pii"),
    (r"\bpersonenbezogene\s+daten\b", "pii"), (r"\bdonnées\s+personnelles\b", "pii"),
    (r"\bdonnées\s+à\s+caractère\s+personnel\b", "pii"), (r"\bsocial security numbers?\b", "ssn"), (r"\bssn\b", "ssn"),
    (r"\bsozialversicherungsnummer\b", "ssn"), (r"\bnuméro\s+de\s+sécurité\s+sociale\b", "ssn"),
    (r"\bdatenschutz\b", "data protection"), (r"\bprotection\s+des\s+données\b", "data protection"), (r"\bdsgvo\b", "gdpr"),
    (r"\brgpd\b", "gdpr"), (r"\bsicherheit\b", "security"), (r"\bsécurité\b", "security"), (r"\bcompliance\b", "compliance"),
    (r"\bkonformität\b", "compliance"), (r"\bconformité\b", "compliance"), (r"\brisikobewertung\b", "risk assessment"),
    (r"\bévaluation\s+des\s+risques\b", "risk assessment"), (r"\bprüfung\b", "audit"), (r"\baudit\b", "audit"),
    (r"\bzugriffskontrolle\b", "access control"), (r"\bcontrôle\s+d'accès\b", "access control"),
)

STOPWORDS = {
    "en": "a an and any all are as at be by for from in is of or that the their to use using with this these those it its been being have has had do does did will would can could into on upon such",
    "de": "der die das den dem des ein eine einer einem einen und oder aber als auch auf aus bei bis durch fuer gegen im in ist mit nach nicht noch nur ob ohne so sowie ueber um unter vom von vor wenn wie wird zu zum zur sind sein seine seiner war waren wurde wurden werden hat haben kann",
    "fr": "le la les un une des du de et ou mais donc car ni ce cette ces son sa ses leur leurs au aux par pour sur sous avec sans dans en est sont etre avoir fait faire peut peuvent doit qui que quoi dont nous vous ils elles se ne pas plus tout tous toute toutes ete sera seront",
}

# Requirement verbs of change records, by priority, and their strengths.
VERBS = (
    (r"\bshall\s+not\b", "shall_not"),
    (r"\bmust\s+not\b", "must_not"),
    (r"\b(?:prohibited|forbidden|not\s+permitted)\b", "must_not"),
    (r"\bshall\b", "shall"),
    (r"\bmust\b", "must"),
    (r"\b(?:required|mandatory|obligatoire|requis|erforderlich)\b", "required"),
    (r"\b(?:should|soll(?:en)?|devrait)\b", "should"),
    (r"\b(?:recommended|recommendation|empfohlen)\b", "recommended"),
    (r"\b(?:may|optional|peut|kann)\b", "may"),
)
VERB_STRENGTH = {"": 0, "may": 1, "recommended": 2, "should": 3, "required": 4, "must": 5, "shall": 6, "must_not": 7, "shall_not": 8}

# Patterns of signals in texts.
NUMBER = r"\b\d+(?:[.,]\d+)?\s*(?:%|percent|days?|weeks?|months?|years?|hours?|minutes?|seconds?|kg|g|mg|ms|s|m|cm|mm|w|kw|v|a)?\b"
REFERENCE = r"\b(?:figure|fig\.?|table|tbl\.?|section|sec\.?|clause|annex|appendix|chapter|part|article)\s*(?:[A-Z]\.)?[\d]+(?:[.\-][\d]+)*"
SECTION_PREFIX = r"^\s*(?:\d+\.)*\d+\.?\s+|^\s*(?:chapter|section|annex|part|clause)\s+(?:[A-Z]\.)?[\d.]+[:\s]+"
CAPTION_PREFIX = r"^(?:table|tabelle|tab\.?|figure|fig\.?|abbildung|abb\.?)\s*[A-Za-z]?[\d.]*\s*[:\-–]?\s*"
FIELD_STRENGTH = r"\b\d+(?:[.,]\d+)?\s*(?:v/m|mv/m|kv/m|db[µu]v/m)\b"
EMISSION_LIMIT = r"\b\d+(?:[.,]\d+)?\s*(?:db[µμu]v(?:/m)?|db[µμu]a)\b"
ACCEPTANCE_CLASS = r"\b(?:class|performance\s+criterion|performance\s+level)\s*[a-e]\b"
TEST_METHOD = r"\b(?:iec|cispr|iso|din\s+en|vde|sae)\s*\d+[-\s.]\d+(?:[-\s.]\d+)?(?:\s+ed\.?\s*\d+)?"
FREQUENCY_RANGE = r"\b\d+(?:[.,]\d+)?\s*(?:hz|khz|mhz|ghz)\b.*?\b\d+(?:[.,]\d+)?\s*(?:hz|khz|mhz|ghz)\b"
DWELL_TIME = r"\b(?:dwell|exposure|soak|dwell\s+time|exposure\s+time)\b.*?\b\d+\s*(?:s|ms|min|h|second|minute|hour)"
TEST_SETUP = r"\b(?:temperature|humidity|eut\s+orientation|antenna\s+distance|ground\s+plane|test\s+distance|pre-conditioning|precondition|polarisation|polarization)\b"
OBLIGATION_HINT = r"\b(shall|must|required|should|may|muss|müssen|soll|sollen|darf|doit|doivent|devrait|peut|obligatoire|requis|exig[eé])\b"
ROLE_HINT = r"\b(committee|officer|team|owner|responsible|administrator|admin|manager|custodian|compliance|risk|security|audit)\b"
REGULATION_HINT = r"\b(gdpr|rgpd|dsgvo|iso\s?\d+|hipaa|sox|pci|nist|ai\s+act|eu\s+ai\s+act)\b"
DURATION_HINT = r"\b\d+(?:\.\d+)?\s*(day|days|week|weeks|month|months|year|years|hour|hours|minute|minutes|second|seconds|%|percent)\b"
NUMBER_HINT = r"\b\d{1,4}\b"
CAPTION_ONLY = r"^(?:table|tbl\.?|figure|fig\.?)\s*[a-z]?\d+(?:[\.-]\d+)*\s*[:\-]?\s*\w+"
ORPHAN_OBLIGATION = r"\b(?:shall|must|required|should|may|muss|müssen|soll|doit|doivent)\b"
FIGURE_CAPTION = r"^(?:figure|fig\.?|abbildung|abb\.?|bild)\s*[A-Za-z]?[\d.]+[A-Za-z]?\s*[:\-–]"
PAGE_NUMBER = r"^\s*(?:seite\s+)?\d+(?:\s+von\s+\d+)?\s*$"
CONFIDENTIALITY = (
    "volkswagen ag vertraulich", "vw ag confidential", "confidential", "vertraulich", "nur für internen gebrauch",
    "internal use only", "company confidential", "proprietary",
)
PII = (
    (r"\b[\w.+-]+@[\w-]+\.[a-z]{2,}\b", "[EMAIL]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b(?:\+?\d[\d\s\-().]{7,}\d)\b", "[PHONE]"),
)
SKIPPED_SECTIONS = (
    r"^\s*(?:preface|foreword|acknowledgements?|table\s+of\s+contents|list\s+of\s+(?:figures|tables)|revision\s+history|document\s+history"
    r"|change\s+log|changelog|change\s+record|copyright|intellectual\s+property|legal\s+notice|disclaimer|signature|blank\s+page"
    r"|intentionally\s+left\s+blank|vorwort|danksagung|inhaltsverzeichnis|abbildungsverzeichnis|tabellenverzeichnis|revisionshistorie?"
    r"|änderungsverzeichnis|urheberrecht|impressum|avant-propos|remerciements|table\s+des\s+matières|liste\s+des\s+figures"
    r"|historique\s+des\s+révisions|mentions\s+légales)\b"
)

# Domain entities -> reason code and impact.
DOMAIN_ENTITIES = {
    "FieldStrength": ("TEST_LEVEL_CHANGED", "technical"),
    "FrequencyRange": ("FREQUENCY_RANGE_CHANGED", "technical"),
    "EmissionLimit": ("NUMERIC_LIMIT_CHANGED", "technical"),
    "ImmunityLevel": ("TEST_LEVEL_CHANGED", "technical"),
    "AcceptanceCriterion": ("ACCEPTANCE_CRITERION_CHANGED", "normative"),
    "TestMethod": ("TEST_METHOD_CHANGED", "technical"),
    "NormativeTerm": ("OBLIGATION_STRENGTHENED", "normative"),
}

# Signals of a table's test type, by priority.
TEST_TYPES = (
    ("environmental_vibration", ("random vibration", "sinusoidal vibration", "spektrale beschleunigungsdichte", "power spectral density", "beschleunigungsdichte", "schwingung", "schweregrad", "sinusschwingung", "mechanische erschütterung")),
    ("maritime_installation", ("machinery spaces", "control room", "accommodation", "bridge", "open deck", "pump room", "below floor plates", "masts", "column i", "column ii", "main areas on board", "installation class", "emc class")),
    ("esd", ("esd", "electrostatic discharge", "elektrostatische entladung", "discharge", "contact discharge", "air discharge")),
    ("radiated_immunity", ("radiated immunity", "ri", "strahlungsimmunität", "rs", "radiated susceptibility", "efield", "e-field", "electromagnetic immunity")),
    ("conducted_emissions", ("conducted emissions", "ce", "conducted disturbance", "leitungsgeführte", "leitungsgebundene", "conducted emission", "störaussendung", "stoeraussendung", "leitungsgebundene emissionen", "leitungsgebundene störung", "emission limit", "grenzwert")),
    ("transient_immunity", ("transient", "eft", "electrical fast transient", "burst", "surge", "pulse", "pfmf", "ring wave")),
)
FREQUENCY_FACTORS = {"hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}
DEFAULT_UNITS = {"EmissionLimit": "dBuV", "FieldStrength": "V/m", "FrequencyRange": "Hz", "TestNumber": ""}
INHERITED_FACTS = {"EmissionLimit": "emission_limit", "FieldStrength": "field_strength", "FrequencyRange": "frequency_range"}
BACKEND_WEIGHTS = {"gmft": 1.0, "camelot": 0.9, "pdfplumber": 0.8, "surya": 0.6, "img2table": 0.5}

# Column headers -> entities, in the order in which partial matches are sought.
HEADER_ALIASES = (
    ("FieldStrength", "prüfpegel; prüffeld; feldstärke; feldstaerke; pegel; störpegel; stoerpegel"),
    ("ImmunityLevel", "immunisierungspegel; immunisierungsfeldstärke"),
    ("FieldStrength", "test level; field strength; level"),
    ("ImmunityLevel", "immunity level"),
    ("FrequencyRange", "frequenzbereich; frequenz; frequenzband; frequenzbereich (mhz); frequency range; frequency; freq. range; freq range"),
    ("EmissionLimit", "grenzwert; störaussendungsgrenzwert; grenzwerte; emissionsgrenzwert; limit; emission limit; limit class; limits"),
    ("AcceptanceCriterion", "anforderung; anforderungen; beurteilungskriterium; klasse; bewertungskriterium; acceptance criterion; acceptance criteria; criterion; criteria; class; performance criterion"),
    ("Phenomenon", "phänomen; phaenomen; störphänomen; stoerphaenomen; prüfung; phenomenon; test; test type; disturbance"),
    ("TestMethod", "prüfverfahren; testmethode; prüfmethode; messverfahren; test method; method; measurement method"),
    ("NormativeTerm", "normative requirement; anforderungsart; verbindlichkeit"),
    ("ImmunityLevel", "prüfschärfe; pruefschaerfe; prüfstufe; prufstufe; kategorie"),
    ("Phenomenon", "impulstyp; impuls"),
    ("FieldStrength", "betriebsspannung; prüfspannung; pruefspannung; nennspannung; versorgungsspannung; u s in v; u in v; spannung in v; spannungspegel"),
    ("Phenomenon", "anschluss; schnittstelle"),
    ("TestMethod", "kopplung; kopplungspfad"),
    ("EmissionLimit", "wert u in db; u in db; grenzwert u in db; (μv); (uv); (dbμv); (dbuv)"),
    ("FrequencyRange", "bw f in khz; f in mhz; f in khz"),
    ("FieldStrength", "e in v/m; feld in v/m"),
    ("TestMethod", "messempfänger; messempfaenger; detektor; detector"),
    ("Phenomenon", "messpunkt"),
    ("FrequencyRange", "messbereich; bandbreite; bandwidth"),
    ("NumericLimit", "prüfdauer; prüfdauer je achse; test duration; dauer; duration"),
    ("ImmunityLevel", "kat.; severity; schweregrad"),
    ("Phenomenon", "prüfungsart"),
    ("NumericLimit", "asd; power spectral density; psd; spektrale beschleunigungsdichte; asd f 1; asd f 2; asd f a , f b; asd fa, fb"),
    ("FrequencyRange", "f 1; f 2; f a; f b; f c; f d"),
    ("FieldStrength", "beschleunigung; acceleration; a effektiv; a rms; displacement; auslenkung"),
    ("NumericLimit", "achsen; anzahl der achsen; number of axes"),
    ("Phenomenon", "beschreibung"),
    ("NormativeTerm", "spezifikation; specification"),
    ("Phenomenon", "parameters; parameter"),
    ("AcceptanceCriterion", "installation class; emc class"),
    ("Phenomenon", "location; area"),
    ("ImmunityLevel", "minimum test level; test levels"),
    ("FieldStrength", "test voltage; rated supply voltage"),
    ("Phenomenon", "enclosure port; power port; signal port; i/o port"),
    ("FrequencyRange", "measuring bandwidth; frequency sweep range; frequency sweep range (hz)"),
    ("EmissionLimit", "limits (quasi-peak); limits quasi-peak; quasi-peak; average"),
    ("TestNumber", "prüf.nr; prüf nr; prüfnr; prüf-nr; prüfnummer; lfd.nr; lfd. nr.; lfd. nr; lfd-nr; lfdnr; test.nr; test nr; testnr; test-nr; testnummer; test number; no.; lfd. no.; nr.; nr"),
)

# Normative terms -> strength.
NORMATIVE_TERMS = {
    "mandatory": "shall; must; is required to; are required to; muss; müssen; ist erforderlich; sind erforderlich; doit; doivent; est obligatoire; sont obligatoires",
    "prohibited": "shall not; must not; darf nicht; dürfen nicht; ne doit pas; ne doivent pas",
    "recommended": "should; is recommended; soll; sollte; empfohlen; devrait; il est recommandé",
    "not_recommended": "should not",
    "permitted": "may; is permitted; is allowed; darf; dürfen; kann; peut; peuvent; est autorisé",
}

# Patterns of facts in table cells.
FACT_RANGE = r"(\d+(?:[.,]\d+)?)\s*(Hz|kHz|MHz|GHz)\s*[-–—to bis]\s*(\d+(?:[.,]\d+)?)\s*(Hz|kHz|MHz|GHz)"
FACT_FREQUENCY = r"(\d+(?:[.,]\d+)?)\s*(Hz|kHz|MHz|GHz)"
FACT_FIELD = r"(\d+(?:[.,]\d+)?)\s*(V/m|mV/m|dBV/m|dBuV/m)"
FACT_EMISSION = r"(\d+(?:[.,]\d+)?)\s*(?:(dBuV|dBµV|dBuA|dBµA|dBuV/m|dBµV/m)|db\s*[\(]?\s*[μu]v\s*[\)]?|db\s*[\(]?\s*[μu]a\s*[\)]?)"
FACT_TOLERANCE = r"(\d+[,\s]\s*\d+)\s*[±+\-]\s*[\d,\s]+\s*(kV|V)\b(?!\s*/\s*m)"
FACT_KILOVOLT = r"[±+\-]?\s*(\d+(?:[.,]\d+)?)\s*(kV)\b(?!\s*/\s*m)"
FACT_VOLT = r"(\d+(?:[.,]\d+)?)\s*(V)\b(?!\s*/\s*m)"
FACT_TERM = r"\b(shall\s+not|must\s+not|darf\s+nicht|dürfen\s+nicht|ne\s+doit\s+pas|ne\s+doivent\s+pas|shall|must|is\s+required\s+to|are\s+required\s+to|should\s+not|should|is\s+recommended|empfohlen|soll(?:te)?|müssen|muss|may\s+not|may|darf|dürfen|kann|peut|peuvent|doit|doivent)\b"
FACT_CLASS = r"\b(?:class|klasse)\s+([A-E])\b"
VOLTAGE_COLUMNS = ("voltage", "spannung", "level", "pegel", "esd", "u s", "u in", "prüfspannung")
EMISSION_UNITS = {"dbµv": "dBuV", "dbuv": "dBuV", "dbµa": "dBuA", "dbua": "dBuA", "dbµv/m": "dBuV/m", "dbuv/m": "dBuV/m"}

# Titles and lines of auxiliary matter.
AUXILIARY_TITLES = r"^\s*(table of contents|contents|index|glossary|list of figures|list of tables)\s*$"
CONTENTS_TITLES = ("contents", "table of contents", "toc", "index", "document index")
CONTENTS_LINE = r"^\s*(?:[A-Za-z0-9][A-Za-z0-9 .,'()\-/]{2,}?)(?:\.{2,}|\s{2,})(?:[A-Za-z]?\d+[A-Za-z]?)\s*$"

# Labels of sections, captions, cells and nodes.
SECTION_LABEL = r"^\s*(?:section|clause|article|chapter|annex|appendix)?\s*([A-Za-z]?\d+(?:[.\-]\d+)*[A-Za-z]?)\b"
SECTION_NUMBER = r"^(?:(?:section|article|chapter|clause|part|annex|appendix)\s+)?(?:[A-Z]\.)?[\d.]+\s*[-–:.]?\s*"
TABLE_NUMBER = r"\bTabell?e\s+(\d+[A-Za-z]?)\b"
TABLE_CAPTION_NUMBER = r"\b(?:Tabell?e|Table)\s+(?:[A-Z]\.)?\d+(?:\.\d+)*[A-Za-z]?\b"
TABLE_PREFIX = (
    r"^(?:table|tabelle|tabella|tableau|tab\.?|fig(?:ure)?|abbildung|exhibit|appendix|anhang|annex|tbl\.?)"
    r"\s*(?:[A-Za-z]{1,2}\.?)?[\d.]*[:\s\-–—]*"
)
TABLE_SEPARATOR = r"^\s*\|?\s*:?-{2,}:?(?:\s*\|\s*:?-{2,}:?)*\s*\|?\s*$"
GLOSSARY_TERM = r"^\s*[\"'“”‘’]?([^:\"'“”‘’\-–—]{2,80})[\"'“”‘’]?\s*[:\-–—]\s*(.+)$"
NOTE_LABEL = r"\b(note|example|warning|caution)\b"
REFERENCE_SECTION = (
    r"\b(legende|symbole?|abkürzung(?:en)?|definitionen?|begriffe?|inhalt"
    r"|glossar|annex|anhang|abbreviation|legend|symbol|glossary|definition)\b"
)
CAPTION_ROW = r"^(?:table|tbl\.?|figure|fig\.?)\s*\d"
LIST_MARKER_CELL = r"^[\d\s\.\-•\*\→]+$"
CONTINUED = r"\b(cont(?:inued)?|fortgesetzt|suite|următoare|continuazione|जारी)\b"
PAGE_BREAK = r"\(.*(?:page|seite|página|pagina|页).*\)"
PLACEHOLDER_HEADER = r"^column_"

# Labels whose text takes no part in a comparison -> reason.
SUPPRESSED_LABELS = {
    "toc": "toc", "table_of_contents": "toc", "index": "boilerplate", "page_header": "header_footer",
    "page_footer": "header_footer", "page_number": "page_number", "footnote_marker": "boilerplate",
}
NODE_TYPES = {
    "section_header": "heading", "title": "heading", "heading": "heading", "table": "table", "formula": "formula", "figure": "figure",
    "list_item": "list_item", "footnote": "footnote", "definition": "definition", "paragraph": "paragraph", "clause": "clause",
}
DEPARTMENTS = ("EMC", "Safety", "Environment")

# Units that a column's header names, by priority -> unit and kind of fact.
COLUMN_UNITS = (
    (r"in\s*ghz|\(ghz\)", "GHz", "frequency_range"),
    (r"in\s*mhz|\(mhz\)", "MHz", "frequency_range"),
    (r"in\s*khz|\(khz\)", "kHz", "frequency_range"),
    (r"in\s*hz|\(hz\)", "Hz", "frequency_range"),
    (r"db\s*[\(]?\s*[μu]a", "dBuA", "emission_limit"),
    (r"db\s*[\(]?\s*[μu]v/m", "dBuV/m", "field_strength"),
    (r"db\s*[\(]?\s*[μu]v", "dBuV", "emission_limit"),
    (r"dbv/m", "dBV/m", "field_strength"),
    (r"\bv/m\b", "V/m", "field_strength"),
    (r"\bkv\b(?!/m)", "kV", "voltage_level"),
)
BARE_RANGE = r"^(\d[\d\s,\.]*?)\s*(?:bis|to|[-–—])\s*(\d[\d\s,\.]*)\s*$"

# Key columns of a table's rows, by its test type.
DOMAIN_ROW_KEYS = {
    "radiated_immunity": ("phenomenon", "frequency_range", "modulation", "component_or_port", "acceptance_criterion"),
    "conducted_emissions": ("phenomenon", "port", "frequency_range", "detector", "limit_class"),
    "esd": ("phenomenon", "discharge_type", "polarity", "voltage_level", "location", "acceptance_criterion"),
    "transient_immunity": ("phenomenon", "pulse_type", "supply_voltage", "coupling_path", "severity_level"),
    "environmental_vibration": ("kategorie", "beschreibung", "specification"),
    "maritime_installation": ("parameters", "class", "location"),
}
KEY_ENTITIES = {
    "phenomenon": "Phenomenon", "frequency_range": "FrequencyRange", "acceptance_criterion": "AcceptanceCriterion",
    "limit_class": "EmissionLimit", "voltage_level": "FieldStrength",
}
REQUIREMENT_IDS = (r"((?:REQ|REF|EMV|EMC|DIN|IEC)-[\d]+)", r"(\d+\.\d+(?:\.\d+)*)", r"([A-Z]{2,}-\d+[A-Z]?)")
TEST_CASE_IDS = (r"(TC-[\d]+)", r"((?:Test\s+)?Case\s+(?:[A-Z]|\d+))", r"((?:case|variant|scenario)\s+\w+)")
ROW_CONDITIONS = (
    "normal operation", "edge case", "boundary condition", "extreme", "error case", "stress test", "steady state", "transient", "worst case", "best case",
)
ROW_STEPS = ("step", "procedure", "verification", "measurement", "check", "validation", "initialization", "execution", "conclusion")

# Answers of a model that say nothing changed.
NO_CHANGE = ("(no semantic change)", "(no change)", "no semantic change", "no change")

# Numbers with units and domain entities that clause scores compare.
SCORED_NUMBER = r"\b\d+(?:[.,]\d+)?\s*(?:v/m|mv/m|khz|mhz|ghz|hz|dbuv|dbua|v|a|%|ms|s|m|cm|mm)?\b"
SCORED_ENTITY = (
    r"\b(?:class\s*[a-e]|performance\s*criterion\s*[a-e]|iec\s*\d+[-\s.]\d+|cispr\s*\d+|iso\s*\d+[-\s.]\d+"
    r"|radiated|conducted|esd|immunity|emission)\b"
)

# Families of documents: hints in file names, by priority; families whose tables are taken
# as they are; the family that headings may tell, and its signals.
FAMILY_HINTS = {
    "tl_81000": ("tl_81000", "tl81000", "tl 81000", "tl-81000"),
    "din_en_60068": ("din_en_60068", "din en 60068", "60068-2", "60068_2"),
    "dnv_cg_0339": ("dnvgl-cg-0339", "dnv-cg-0339", "dnv_cg_0339", "cg-0339", "cg0339"),
}
CONSERVATIVE_FAMILIES = ("din_en_60068", "dnv_cg_0339")
SIGNALLED_FAMILY = "tl_81000"
FAMILY_SIGNALS = (
    "leitungsgebundene störaussendung", "leitungsgebundene emission", "störaussendung", "leitungsgebunden", "geführte störaussendung", "netzgeführt",
    "conducted emission", "conducted disturbance", "conducted interference", "ce",
    "strahlungsgebundene störfestigkeit", "feldstärke", "antenne", "fahrzeugprüfung", "strahlungsimmunität", "radiated immunity", "radiated field", "field strength", "ri",
    "transiente störfestigkeit", "transienten", "impuls", "impulsförmige", "einstellwert", "transient immunity", "transient", "pulse", "burst",
    "elektrostatische entladung", "esd", "luftentladung", "kontaktentladung", "electrostatic discharge", "air discharge", "contact discharge",
)


def family_signal_words() -> list[str]:
    """The words of at least four letters that occur in the signals."""
    return sorted({w for s in FAMILY_SIGNALS for w in s.split() if len(w) >= 4})
