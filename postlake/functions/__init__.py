"""Column builders: text keys, addresses, places, dates, arrays, HTML."""
