"""lexicrux: document analytics for court texts, expressed as Spark plans."""
