"""Word lists and limits that decide results. They are data; callers pass them to the operators, or their own in their place."""

from __future__ import annotations

#: Chemical families and the words that name them.
FAMILIES = {
    "ACID": ("acide", "acides", "acid", "acido", "acidum", "saeure"),
    "CARBONATE": ("carbonate", "carbonato"),
    "CHLORHYDRATE": ("chlorhydrate", "hydrochloride", "hidrocloruro"),
    "SULFATE": ("sulfate", "sulphate", "sulfato"),
    "CITRATE": ("citrate", "citrato"),
    "TARTRATE": ("tartrate", "tartrato"),
    "MALEATE": ("maleate", "maleato"),
    "FUMARATE": ("fumarate", "fumarato"),
    "SUCCINATE": ("succinate", "succinato"),
    "ACETATE": ("acetate", "acetato"),
    "PHOSPHATE": ("phosphate", "fosfato"),
    "NITRATE": ("nitrate", "nitrato"),
    "BROMURE": ("bromure", "bromide", "bromhydrate", "bromuro"),
    "CHLORURE": ("chlorure", "chloride", "cloruro"),
    "OXYDE": ("oxyde", "oxide", "oxido", "hydroxyde", "hydroxide"),
}
#: Words that tell no substances apart.
LINKS = (
    "de", "du", "des", "d", "la", "le", "les", "of", "and", "et", "y", "sodique", "sodium", "potassique", "potassium", "calcique", "enrobe", "enrobee", "anhydre", "anhydrous", "monohydrate", "dihydrate",
    "trihydrate", "hydrate", "micronise", "micronisee", "purifie", "purifiee",
)
#: Fixed value: a place in a molecule before a hyphen.
LOCANT = r"^(?:\d+|[nrsoz]|alpha|beta|gamma|cis|trans)-"

#: Fixed values for composition lines. An accented letter also stands for the plain one; s? is a plural.
UNITS = ("mg", "g", "µg", "mcg", "microgrammes?", "ml", "mL", "L", "UI", r"U\.I\.", "Ul", "millions?", "milliards?", "unités?", "%", "mmol", "MBq", "GBq", "kBq", "mEq")
#: What says that the substances have ended.
ENDINGS = ("excipient", "liste complète", "pour la liste")
#: Lead-ins of a line.
LEADS = ("quantité correspondant à", "substances? actives?", "composition", "principes? actifs?")
#: What is no substance when it stands alone.
NO_SUBSTANCE = (
    "pour", "chaque", "cette?", "ces", "un", "une", "le", "la", "les", "du", "des", "de", "d", "solution", "poudre", "comprimé", "gélule", "flacon", "ampoule", "sachet", "dose", "volume", "quantité",
    "principe actif", "substances? actives?", "composition", "excipients?", "contenu", "teneur", "composants?", "équivalent", "après reconstitution", "concentration", "masse", "poids", "contient",
)
#: Quantities that are measured, which may introduce a substance.
MEASURES = ("activité", "titre", "teneur", "concentration", "puissance", "osmolarité", "pH")
#: Elements that are no substance when they stand alone.
ALONE = (
    "sodium", "potassium", "calcium", "magnésium", "zinc", "fer", "lithium", "aluminium", "ammonium", "argent", "cuivre", "manganèse", "sélénium", "iode", "phosphore", "chrome", "cobalt", "molybdène",
    "fluor", "brome", "chlorure", "eau", "glucose anhydre",
)
#: Words that begin the tail of a name, and those that do so after "par" and an amount.
TAILS = ("dans", "sous forme", "correspondant", "équivalant", "soit")
PER = ("flacon", "ampoule", "dose", "sachet", "ml", "mL", "L", "g", "mg", "comprimé", "poche")
#: Characters of a name, of a name before leaders, of a name at the head of a line; substances of a record.
NAME, BEFORE_LEADERS, AT_HEAD, MOST_SUBSTANCES = (3, 70), (3, 80), (3, 71), 6

#: The numbers of a document's plan, in order.
PLAN = (
    "1", "2", "3", "4", "4.1", "4.2", "4.3", "4.4", "4.5", "4.6", "4.7", "4.8", "4.9", "5", "5.1", "5.2", "5.3", "6", "6.1", "6.2", "6.3", "6.4", "6.5", "6.6", "7", "8", "9", "10", "11", "12",
)
#: Where the document ends, the sentence that closes it, the sections after which that sentence counts, and how much the last section has without it.
PLAN_END, PLAN_CLOSE, CLOSING, LAST_CHARS = r"(?m)^\s*ANNEXE\s+II\b", r"(?i)ema\.europa\.eu[^\n]*", ("9", "10"), 600
#: Lines that are numbers of pages; characters that begin an item; characters that end a paragraph; sections and paragraphs that a usable text has.
PAGE_LINE, ITEM_MARKS, PARAGRAPH_ENDS, LEAST_SECTIONS, LEAST_PARAGRAPHS = r"^\s*(?:\d+\s*)?$|^\s*Page \d+", ("·", "•", "-", "–"), (".", ":", ";"), 6, 20
