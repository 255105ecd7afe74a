"""DataFrame operators on reports, compiled statements, page texts, transcribed replies, links and filings."""
