"""Constants that results depend on, so they are stated here as plain text."""

# --- fixed values: geometry defaults, in the unit of the coordinates (pixels) ---
ROW_TOLERANCE = 15
CLUSTER_EPS = 100
COLUMN_BOUNDARIES = (100, 300, 500, 700)

# --- fixed values: patterns and formats ---
# (?U) makes \s Unicode-aware; U+001C..U+001F are blanks for Python's str.strip and re as well.
BLANK = r"[\s\x1c-\x1f]"
WIDE_BLANK = rf"(?U){BLANK}{{2,}}"
OUTER_BLANK = rf"(?U)^{BLANK}+|{BLANK}+$"
TABLE_SEPARATOR = rf"(?U)^{BLANK}*[\-+]+{BLANK}*$"
SEPARATOR_RUN = r"[\-+]+"
PDF_GLOB = "*.[pP][dD][fF]"
PDF_SUFFIX = ".pdf"
PAGE_BREAK = "\n---\n\n"
STRUCTURED_FIELDS = ("page", "title", "content", "tables")
ALL_FINE = "All files processed successfully."

# --- fixed values: entities of HTML text ---
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);"
NAMED_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}

# --- fixed values: the request text around a page's recognised text ---
PROMPT_HEAD = """Analysiere das folgende Bild und den OCR-Text. Das Bild ist ein eingescanntes Dokument, das Text, Tabellen und andere strukturierte Informationen enthalten kann. Der OCR-Text wird unten bereitgestellt. Deine Aufgaben sind:

1. Korrigiere alle OCR-Fehler, die du identifizieren kannst.
2. Identifiziere und formatiere alle Tabellen im Dokument.
3. Erkenne und bewahre die Struktur des Dokuments (Überschriften, Absätze, Listen usw.).
4. Stelle den korrigierten und strukturierten Inhalt in einem Format bereit, das leicht in CSV konvertiert werden kann.

OCR-Text:
"""
PROMPT_TAIL = """

Bitte gib deine Analyse und den korrigierten, strukturierten Inhalt in folgendem JSON-Format zurück:
{
    "title": "Titel oder Hauptüberschrift des Dokuments",
    "content": "Der Hauptinhalt des Dokuments, einschließlich korrigiertem Text und Tabellen",
    "tables": [
        {
            "table_title": "Titel der Tabelle",
            "table_content": "Inhalt der Tabelle als formatierter String"
        }
    ]
}

Beachte, dass alle Ausgaben auf Deutsch sein müssen. Bitte stelle sicher, dass deine Antwort ein valides JSON-Objekt ist."""
