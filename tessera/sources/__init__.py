"""Sources and sinks: base tables, stand-in fixtures, CSV and delimited text."""
