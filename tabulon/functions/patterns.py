"""The patterns and word lists that decide how cells, headers and pages are read."""

from __future__ import annotations

BLANKS = ("", "-", "–", "—", "N/A", "n/a")

# Java regular expressions; (?U) makes \s and \d Unicode-aware.
NOTE = r"(?iU)^(?:\(\s*(?:[IVXLCDM]{1,6}|[A-Z]?\d{1,3})[.\-]\d{1,3}\s*\)|\(\s*[1-9]\s*\)|[IVXLCDM]{2,6}\.\d{1,3}|\d{1,3}[.\-]\d{1,3})$"
NUMBER = r"(?U)^[(<]?\s*[-+]?\s*\d[\d\s.,]*\s*[>)]?$"
PERCENT = r"(?U)^[(<]?\s*[-+]?\s*\d+(?:[.,]\d+)?\s*%\s*[>)]?$"
EDGES = r"(?U)^\s+|\s+$"

DATE_HEADER = r"^\s*\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}\s*$"
YEAR_HEADER = r"^20\d{2}$"
DATE_TOKEN = r"\d{2}[/.\-]\d{2}[/.\-]\d{4}|\d{4}[/.\-]\d{2}[/.\-]\d{2}|(?:^|\s)\d{4}(?:\s|$)"
FULL_DATE = r"^\d{1,2}([/.\-])\d{1,2}\1\d{4}$"
DATE_NAMES = (r"^\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}$", r"^\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}$", r"^\d{4}$",
              r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre)")
LOOSE_NOTE = r"(?i)^(?:\(\s*[1-9]\s*\)|\(\s*\d{1,2}[.\-]\d{1,2}\s*\)|[IVXLCDM]{1,6}\.\d{1,2}|\d{1,2}[.\-]\d{1,2}|(?:[1-9]|[1-4][0-9]|50)\s(?:[1-9]|[1-4][0-9]|50))$"
SLASH_DATE, DOT_DATE = r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}\.\d{2}\.\d{4}$"

HEADER_NAMES = {
    "montant": "Variation Montant", "en montant": "Variation Montant", "var montant": "Variation Montant", "var. montant": "Variation Montant",
    "ecart montant": "Variation Montant", "mouvement": "Variation Montant",
    "en %": "Variation %", "%": "Variation %", "var %": "Variation %", "var. %": "Variation %", "pct": "Variation %", "ecart %": "Variation %",
    "taux variation": "Variation %", "en pourcentage": "Variation %",
    "libelle": "Label", "libelle poste": "Label", "poste": "Label", "designation": "Label", "description": "Label", "intitule": "Label",
    "rubriques": "Label", "elements": "Label",
    "notes": "Note", "ref": "Note", "reference": "Note", "renvoi": "Note",
}
LABEL_WORDS = ("label", "libelle", "libelle poste", "poste", "designation", "description", "intitule", "rubriques", "elements")
NOTE_WORDS = ("note", "notes", "ref", "reference", "renvoi")
AMOUNT_WORDS = ("variation montant", "variation en montant", "variation amount", "montant variation", "en montant", "mouvement", "ecart montant", "var montant", "var. montant")
PERCENT_WORDS = ("variation %", "variation en %", "variation pct", "var %", "en %", "taux variation", "ecart %", "pct", "var. %", "en pourcentage")
LABEL_HEADERS = ("libelle", "libellé", "libelle poste", "poste", "designation", "désignation", "description", "intitule", "intitulé", "rubriques",
                 "elements", "éléments", "item", "items", "compte", "comptes")
PLACEHOLDERS = ("col", "column", "field", "value", "data", "item")
VARIATION_WORDS = ("variation", "var", "écart", "ecart", "mouvement", "change", "delta", "diff", "evolution")

HEADER_ROWS = (r"attijari\s*bank", r"etat\s*des", r"arr[eê]t[eé]\s*au", r"unit[eé]", r"\(unit[eé]", r"en\s*milliers", r"note$", r"variation$", r"en\s*montant$", r"en\s*%$", r"\d{2}[./]\d{2}[./]\d{4}$")

TABLE_TYPES = {
    "cash_flow": ("flux", "trésorerie", "tresorerie", "encaissements", "décaissements", "decaissements", "cash", "flow", "liquidités", "liquidites",
                  "operating activities", "investing activities", "financing activities", "activités d'exploitation", "activités d'investissement", "activités de financement"),
    "balance_sheet": ("actif", "passif", "bilan", "balance", "asset", "liability", "capitaux propres", "equity", "immobilisations", "fixed assets"),
    "income_statement": ("résultat", "resultat", "income", "profit", "loss", "revenue", "produits", "charges", "expense", "operating income"),
}
ASSETS = ("total actif", "total des actifs", "total general actif", "total de l'actif")
LIABILITIES = ("total passif", "total des passifs", "total general passif", "total du passif")
EQUITY = ("capitaux propres", "total capitaux", "equity", "fonds propres")

PAGE_TITLES = {
    "balance_sheet": ("bilan arrete au", "bilan consolide", "bilan au"),
    "income_statement": ("etat de resultat", "compte de resultat", "etat des resultats", "income statement", "profit and loss"),
    "cashflow": ("etat des flux de tresorerie", "etat de flux de tresorerie", "tableau des flux de tresorerie", "tableau de flux de tresorerie",
                 "flux de tresorerie", "cash flow statement", "statement of cash flows"),
}
HARD_NEGATIVES = {
    "balance_sheet": ("hors bilan", "engagements hors", "notes aux etats", "annexes"),
    "income_statement": ("notes aux etats", "annexes"),
    "cashflow": ("notes aux etats", "annexes", "variation de l'actif net", "variation de lactif net"),
}
SOFT_NEGATIVES = {
    "balance_sheet": ("commissaire aux comptes", "rapport du commissaire", "examen limite", "nous avons effectue", "opinion", "audit"),
    "income_statement": ("commissaire aux comptes", "rapport du commissaire", "examen limite", "nous avons effectue"),
    "cashflow": (),
}
PAGE_WORDS = {
    "balance_sheet": ("actif", "passif", "total actif", "total passif", "actif net", "capitaux propres", "capital souscrit", "sommes capitalisables",
                      "sommes distribuables", "immobilisations", "creances", "dettes"),
    "income_statement": ("revenus", "charges", "revenu net", "resultat net", "resultat d'exploitation", "resultat net de l'exercice", "produits",
                         "produits d'exploitation", "charges d'exploitation", "charges de gestion", "marge", "benefice", "produit net bancaire"),
    "cashflow": ("activites d'exploitation", "activites d'investissement", "activites de financement", "flux d'exploitation", "flux d'investissement",
                 "flux de financement", "exploitation", "investissement", "financement", "variation de tresorerie", "tresorerie debut", "tresorerie fin"),
}
STRONG_WORDS = {
    "balance_sheet": ("ac1-", "ac2-", "ac3-", "pa1-", "pa2-", "total de l'actif", "total actif", "total du passif", "total passif"),
    "income_statement": ("pr1-", "pr2-", "ch1-", "ch2-", "produit net bancaire", "total produits d'exploitation", "total charges d'exploitation"),
    "cashflow": ("tresorerie et equivalent", "tresorerie a la cloture", "variation nette de tresorerie"),
}
ACCENTED, PLAIN = "éèêëàâùûîïôöç", "eeeeaauuiiooc"
