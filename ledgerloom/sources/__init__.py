"""Reading spreadsheets, and keeping artifacts."""
