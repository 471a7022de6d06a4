"""Reading sources: sitemaps, page payloads, record parsers, the document archive."""
