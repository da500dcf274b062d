"""Schemas of the tables that the plans pass on."""

PAPERS = (
    "paper_id string, title string, authors array<string>, abstract string, published string, updated string, categories array<string>, "
    "primary_category string, doi string, journal_ref string, comment string, citation_key string"
)
FILES = "paper_id string, path string, text string"
CLEAN_FILES = "paper_id string, path string, text string, blocks array<string>, skip_reason string"
ITEMS = "paper_id string, path string, idx int, offset long, length long, chunk string, ctx_before string, ctx_after string, route string"
CACHE = "key string, output string, warning string, model string"
RESULTS = "key string, output string, status string, warning string, errors int, untranslated int"
MESSAGES = "paper_id string, pos long, message string"
STATE = "paper_id string, has_pdf boolean, has_record boolean, has_translated_pdf boolean, has_translated_tex boolean, has_source_tex boolean"
