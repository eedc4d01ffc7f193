"""Fixed values that must equal the reference's for identical results.

They are stated here once, as plain text in their natural order, and every
other module imports them from this file.
"""

# --- fixed values: dataset status codes, in pipeline order -----------------
STATUSES = ("queued", "uploading_hdfs", "analyzing", "done", "failed")
DEFAULT_STATUS = "queued"          # an absent status reads as queued

# --- fixed values: status -> progress percentage ---------------------------
STATUS_PROGRESS = {
    "queued": 0,
    "uploading_hdfs": 25,
    "analyzing": 75,
    "done": 100,
    "failed": 100,
}
UNKNOWN_PROGRESS = 0

# --- fixed values: display labels (French); unknown codes show as-is --------
STATUS_LABELS = {
    "queued": "En file d’attente",
    "uploading_hdfs": "Transfert des données",
    "analyzing": "Analyse en cours",
    "done": "Terminé",
    "failed": "Échec",
}
STEP_INITIAL_ANALYSIS = "initial_analysis"
STEP_LABELS = {
    "initial_analysis": "Analyse préliminaire",
}

# --- fixed values: name shown for an id without a catalogue row -------------
UNKNOWN_DATASET_NAME = "ce dataset"

# --- fixed values: file acceptance ------------------------------------------
ALLOWED_MIME = ("text/csv", "application/vnd.ms-excel", "application/csv", "text/plain")
CSV_SUFFIX = ".csv"

# --- fixed values: report rules ---------------------------------------------
MISSING_TEXT = "nan"               # lower-cased text that counts as missing
HEAVY_MISSING_RATIO = 0.2          # strictly greater than this is "heavy"
SUGGESTION_LIST_HEAD = 5           # names shown before the ellipsis
ELLIPSIS = "…"
NAME_SEPARATOR = ", "
SUGGEST_DROP_CONSTANT = "Supprimer {n} colonne(s) constante(s): "
SUGGEST_TREAT_MISSING = "Traiter les valeurs manquantes (>20%) pour: "

# --- fixed values: default row gate of an upload ----------------------------
DEFAULT_MAX_CSV_ROWS = 20000

# --- fixed values: characters Python's str.strip() removes ------------------
# (Unicode White_Space plus the four information separators U+001C..U+001F)
STRIP_CHARS_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A"
    "\\u2028\\u2029\\u202F\\u205F\\u3000]"
)
